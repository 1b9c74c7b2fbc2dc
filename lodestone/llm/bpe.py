"""Byte-level BPE as a monoid: a text is halved down to leaves, leaves are encoded, and neighbours are joined by encoding
again a window at their border that grows until the tokens outside it provably stay. Decoding concatenates up the tree.

Two facts bound the windows. Between texts: no match of the pattern holds white space after another character, so
each place where white space follows something else ends a match whatever stands around it, and tokens on its far
sides never change. Inside one long match: a sequence of tokens is the encoding of its bytes exactly if each pair of
neighbours is the encoding of its own bytes, so a window is wide enough when the pairs at both of its edges hold."""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import passes

#: Characters of a text that one leaf holds at most, and bytes of a match.
LEAF_CHARS = 4096
LEAF_BYTES = 128
#: Bytes that windows first take on each side.
WINDOW = 16
#: Characters that the pattern takes for white space (Unicode's White_Space property).
BLANKS = "\t\n\x0b\x0c\r \x85\xa0                　"


class Codec:
    """Encodes and decodes by a file of ranks. pattern splits texts before merges."""

    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.pieces = {v: k for k, v in ranks.items()}
        self.size = np.zeros(max(self.pieces) + 1, np.int64)
        for i, piece in self.pieces.items():
            self.size[i] = len(piece)
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes
        import re

        self.cut = re.compile(f"(?<=[^{BLANKS}])[{BLANKS}]")
        self.long = re.compile(f"[^{BLANKS}]{{{leaf_bytes}}}|[{BLANKS}]{{{leaf_bytes}}}")

    # Whole texts -------------------------------------------------------------------------------------------------

    def encode(self, text: str) -> np.ndarray:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf_chars:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The window reaches to the nearest sure cut on each side; cuts are looked for in spans that double."""
        a, span = lo, WINDOW
        while mid - span > lo:
            if cuts := [m.start() for m in self.cut.finditer(text, mid - span, mid)]:
                a = cuts[-1]
                break
            span *= 2
        else:
            if cuts := [m.start() for m in self.cut.finditer(text, lo, mid)]:
                a = cuts[-1]
        b, span = hi, WINDOW
        while True:
            if found := self.cut.search(text, mid + 1, min(hi, mid + span)):
                b = found.start()
                break
            if mid + span >= hi:
                break
            span *= 2
        keep = self._prefix(left, len(text[lo:a].encode("utf-8")))
        drop = len(right) - self._suffix(right, len(text[b:hi].encode("utf-8")))
        return np.concatenate([left[:keep], self._leaf(text[a:b]), right[drop:]])

    def _prefix(self, ids: np.ndarray, size: int) -> int:
        return int(np.searchsorted(np.cumsum(self.size[ids]), size, "right")) if size else 0

    def _suffix(self, ids: np.ndarray, size: int) -> int:
        return self._prefix(ids[::-1], size)

    def _leaf(self, text: str) -> np.ndarray:
        """A leaf's tokens. Matches beyond leaf_bytes, for which merging all at once takes long, are trees themselves."""
        if self.long.search(text):
            parts = [self.encode_match(m.group().encode("utf-8", "replace")) for m in self.pattern.finditer(text)]
            return np.array([x for p in parts for x in p], np.int64)
        return self.core.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

    # One match of the pattern ------------------------------------------------------------------------------------

    def encode_match(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf_bytes:
            return self.core._encode_single_piece(piece)
        mid = len(piece) // 2
        return self._join_match(self.encode_match(piece[:mid]), self.encode_match(piece[mid:]))

    def holds(self, a: int, b: int) -> bool:
        return self._pair(a, b)

    @functools.lru_cache(maxsize=1 << 16)  # noqa: B019  one codec lives as long as its process
    def _pair(self, a: int, b: int) -> bool:
        return self.core._encode_single_piece(self.pieces[a] + self.pieces[b]) == [a, b]

    def _join_match(self, left: list[int], right: list[int]) -> list[int]:
        if self.holds(left[-1], right[0]):
            return left + right
        i, j = 1, 1  # tokens of each side in the window
        while True:
            window = b"".join(self.pieces[x] for x in left[-i:]) + b"".join(self.pieces[x] for x in right[:j])
            got = self.core._encode_single_piece(window)
            open_left = i < len(left) and not self.holds(left[-i - 1], got[0])
            open_right = j < len(right) and not self.holds(got[-1], right[j])
            if not open_left and not open_right:
                return left[: len(left) - i] + got + right[j:]
            i, j = min(len(left), i * 2 if open_left else i), min(len(right), j * 2 if open_right else j)

    # Back --------------------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """Concatenates up the tree: leaves are looked up, halves are joined."""
        if len(ids) <= self.leaf_chars:
            return self.core.decode_bytes(ids.tolist())
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    return Codec(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256, and with_ids the ids. Null
    texts are empty texts, which have no tokens. Texts are encoded whole, row by row, also where ids are null or repeat; a very long
    one takes time and memory in proportion. Other columns are not read, so their names cannot clash; an empty table gives an empty
    table. One scan, no shuffle. path names a file that every worker has."""
    kind = docs.schema[id_col].dataType.simpleString()
    path = os.fspath(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part, texts in passes(batch, "text"):
                n, ids, back, all_ids = [], [], [], []
                for text in texts.to_pylist():
                    got = own.encode(text)
                    n.append(len(got))
                    ids.append(hashlib.sha256(got.astype("<u4").tobytes()).hexdigest())
                    back.append(hashlib.sha256(own.decode(got)).hexdigest())
                    if with_ids:
                        all_ids.append(got)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in all_ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), "text").mapInArrow(run, schema)
