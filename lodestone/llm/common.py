"""What the operators share: shared-folder tables, Arrow batches cut by bytes, and word kernels in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestone.functions.storage import forget, settled, shared_folder

#: Tables between steps, under the names that this subpackage uses.
shared_dir, settle = shared_folder, settled
__all__ = ["ALNUM", "SPACE", "Words", "byte_view", "byte_words", "forget", "fresh", "keys", "mixed", "passes", "powers", "settle", "shared_dir", "text_column", "windows"]

#: Text bytes that one numpy pass takes at a time; a longer text makes a pass of its own.
PASS_BYTES = 1 << 20


def fresh(name: str, taken: list[str]) -> str:
    """The name, with as many _ as make it none of those taken (Spark's names do not tell cases apart)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def text_column(array: pa.Array) -> pa.Array:
    """Nulls as empty texts, with 64-bit offsets."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return pc.fill_null(array.cast(pa.large_string()), "")


def byte_view(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls, and where each text starts (one more for the end)."""
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64, len(array) + 1 + array.offset)[array.offset :]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def passes(batch: pa.RecordBatch, column: str, size: int = PASS_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of a batch with about `size` bytes of text each, and their texts."""
    texts = text_column(batch.column(batch.schema.get_field_index(column)))
    if not len(texts):
        return
    _, at = byte_view(texts)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(at, at[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield batch.slice(first, last - first), texts.slice(first, last - first)
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same everywhere."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + 12345))


_word_tables: dict[bytes, bytes] = {}


def byte_words(text: bytes, inside: bytes, size: int = PASS_BYTES) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, runs of the bytes `inside`, with only A to Z lower-cased: some `size` bytes of the text at a time,
    cut where no word is."""
    table = _word_tables.get(inside)
    if table is None:
        table = _word_tables[inside] = bytes(b if b in inside else 32 for b in range(256)).lower()
    first = 0
    while first < len(text):
        last = first + size
        if last < len(text):
            while last < len(text) and text[last] in inside:
                last += 1
        yield text[first:last].translate(table).split()
        first = last


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = keys(256, 7)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words that hold only letters and digits; all of a multi-byte character counts.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Words:
    """The words of a column of texts: runs of bytes for which `inside` holds, never across two texts."""

    def __init__(self, texts: pa.Array, inside: np.ndarray = ~SPACE):
        self.data, self.at = byte_view(texts)
        self.n_texts = len(texts)
        within = inside[self.data]
        first = within.copy()
        last = within.copy()
        if len(within):
            first[1:] &= ~within[:-1]
            last[:-1] &= ~within[1:]
            heads = self.at[:-1][self.at[:-1] < self.at[1:]]
            first[heads] = within[heads]
            tails = self.at[1:][self.at[:-1] < self.at[1:]] - 1
            last[tails] = within[tails]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, self.at)  # of the words of each text
        self.counts = np.diff(self.bounds)
        self.text_of = np.repeat(np.arange(self.n_texts), self.counts)
        self._sums = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans; equal spans have equal hashes wherever they stand."""
        with np.errstate(over="ignore"):
            if self._sums is None:
                n = len(self.data)
                self._sums = np.zeros(n + 1, np.uint64)
                np.cumsum(_BYTES[self.data] * powers(_BASE, n)[:n], out=self._sums[1:])
            h = (self._sums[end] - self._sums[start]) * powers(_BASE_INVERSE, len(self.data))[start]
            return mixed(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def per_text(self, words: np.ndarray) -> np.ndarray:
        """How many of the given words (by index or mask) each text has."""
        return np.bincount(self.text_of[words], minlength=self.n_texts).astype(np.int64)


def windows(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of each run of `width` words, by its first word; the last width - 1 have none."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i, k in enumerate(keys(width, seed) | np.uint64(1)):
            out += hashes[i : n + i] * k
        return mixed(out)
