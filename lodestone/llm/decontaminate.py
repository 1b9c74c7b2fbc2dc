"""Benchmark decontamination by the CGK embedding. A random walk reads a window: at each step it notes the character under
it, and a random bit of the step and the character says whether it moves on. Two walks that read the same characters
move alike; after an edit they drift and soon meet again, so that the edit distance of two windows becomes a Hamming distance
of what their walks noted. Samples of the noted characters, hashed, find the places where a text's walk agrees with an item's;
what is found is settled by the exact edit distance of the whole item.

The random bits repeat every block of steps, so the embedding of an item-sized window is a chain of blocks, and windows
share the blocks in which they meet: the blocks of all windows, one from every character, are walked once. A sample
takes its places from one block, since edits put two walks out of step for stretches: places spread over the embedding of a whole item
would hardly ever agree all at once where a fifth of the characters is edited, while some block of it nearly always does.
Every block of every window and every repetition is a try of its own; SAMPLES says how many steps, samples and
repetitions items of a length need for a recall of 0.99 at MAX_EDITS (tests/llm measure it against brute force).

Scale: the items (a bounded table: its size is checked) are sent to the executors as tables of hashes, in portions; all
whole texts are scanned once for each portion, without a shuffle. No pair of documents is ever made. Time and memory of a text
grow with its length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ALNUM, Words, keys, passes

#: Edits between an item and a window, as a share of the item's characters, that still count as contamination.
MAX_EDITS = 0.2
#: Of items from a number of characters on: steps of a block, characters sampled of them, repetitions. Measured (see above).
SAMPLES = ((64, 18, 13, 3), (40, 14, 11, 4), (24, 10, 9, 4), (10, 6, 6, 4), (5, 3, 3, 4))
#: Characters of a piece of an item, at most: Myers' bit vectors try pieces, a word each, before the whole item.
PIECE = 64
#: Bytes of items in one index (about a hundred times as many in memory); a larger table is taken in portions of that size.
PORTION_BYTES = 2 << 20
#: Characters that are walked at a time, pieces that are tried at a time, and places that share a trial.
CHUNK, TRIALS, NEAR = 1 << 14, 1 << 12, 16
#: Places before and after all texts where a trial may read, and steps between looks at which trials may still succeed.
MARGIN, LOOK = 4 * PIECE, 8
_STEP = np.uint32(0x9E3779B1)
_SPACE, _END = 32, 10


def edits_of(length: int) -> int:
    return int(MAX_EDITS * length)


def plain_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the texts' words (lower case) with one space between words and _END after each text that has
    words, and the numbers of those texts."""
    words = Words(pc.utf8_lower(texts), ALNUM)
    lengths = words.end - words.start
    out = np.full(int(lengths.sum()) + len(lengths), _SPACE, np.uint8)
    ends = np.cumsum(lengths + 1) - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = words.data[ALNUM[words.data]]
    some = np.flatnonzero(words.counts > 0)
    out[ends[words.bounds[1:][some] - 1]] = _END
    return np.frombuffer(out.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), some


class Walk:
    """One block of the embedding, and the places that are sampled of it. Of two steps that follow each other just one moves on
    from a character, so that all blocks read about as many characters."""

    def __init__(self, steps: int, samples: int, seed: int):
        bits = (keys(steps * 256, seed) >> np.uint64(40) & np.uint64(1)).reshape(steps, 256)
        bits[1::2] = 1 - bits[: steps // 2 * 2 : 2]
        self.steps, self.letters = steps, (keys(256, seed + 1) >> np.uint64(32)).astype(np.uint32)
        self.sampled = set(np.argsort(keys(steps, seed + 2))[:samples].tolist())
        self.moves = (bits << np.arange(steps, dtype=np.uint64)[:, None]).sum(axis=0).astype(np.uint32)  # a bit for each step

    def blocks(self, letters: np.ndarray, ends: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """From each place (letters has `steps` + 1 more at its end): the hash of the sampled characters and, if asked for, where
        the walk ends. From the last step to the first: what a walk from a place still reads is its character there and what
        a walk one step later reads, from the next place or the same."""
        n = len(letters) - self.steps - 1
        out, end = np.empty(n, np.uint32), np.empty(n if ends else 0, np.int64)
        for a in range(0, n, CHUNK):
            size = min(CHUNK, n - a)
            part = letters[a : a + size + self.steps + 1]
            letter, moves = self.letters.take(part, mode="clip"), self.moves.take(part, mode="clip")
            now = [np.zeros(len(part), np.uint32) for _ in range(1 + ends)]
            other, move = np.empty_like(letter), np.empty_like(letter)
            for s in range(self.steps - 1, -1, -1):
                m = size + s + 1  # places from which the walk can be told
                np.left_shift(moves[:m], np.uint32(31 - s), out=move[:m])
                on = move.view(np.int32)[:m]
                on >>= 31
                on = on.view(np.uint32)
                for k, h in enumerate(now):
                    diff = np.bitwise_xor(h[1 : m + 1] + np.uint32(1) if k else h[1 : m + 1], h[:m], out=other[:m])
                    diff &= on
                    h[:m] ^= diff
                if s in self.sampled:
                    h = now[0][:m]
                    h *= _STEP
                    h += letter[:m]
            out[a : a + size] = now[0][:size]
            if ends:
                end[a : a + size] = now[1][:size] + np.arange(a, a + size)
        return out, end


def padded(codes: np.ndarray, steps: int) -> np.ndarray:
    """Letters as the walks know them: codes modulo 256."""
    return np.concatenate([codes & np.uint32(255), np.zeros(steps + 1, np.uint32)]).astype(np.intp)


class Table:
    """Places of hashes, behind a sieve. The distinct hashes stand in order, and `first` says where those with the same highest
    bits begin."""

    def __init__(self, hashes: np.ndarray, leaves: np.ndarray):
        hashes = hashes * _STEP
        order = np.argsort(hashes, kind="stable")
        self.leaves = leaves[order]
        self.hashes, self.begin, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.shift = np.uint32(32 - min(31, max(10, int(32 * len(hashes)).bit_length())))
        self.sieve = np.zeros(1 << (32 - int(self.shift)), bool)
        self.sieve[hashes >> self.shift] = True
        self.coarse = np.uint32(32 - min(31, max(10, len(hashes).bit_length())))
        self.first = np.searchsorted(self.hashes >> self.coarse, np.arange(1 << (32 - int(self.coarse)), dtype=np.uint32))
        self.most = int(np.bincount(self.hashes >> self.coarse).max(initial=0))
        self.hashes = np.append(self.hashes, np.uint32(0xFFFFFFFF))
        self.begin, self.count = np.append(self.begin, 0), np.append(self.count, 0)

    def met(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, leaf) wherever a hash is one of the table's."""
        hashes = hashes * _STEP
        at = np.flatnonzero(self.sieve.take((hashes >> self.shift).astype(np.intp), mode="clip"))
        hashes = hashes[at]
        lo = self.first[hashes >> self.coarse]
        for _ in range(self.most):
            lo += self.hashes[lo] < hashes
        same = np.flatnonzero(self.hashes[lo] == hashes)
        at, lo = at[same], lo[same]
        n = self.count[lo]
        skip = np.cumsum(n) - n
        return np.repeat(at, n), self.leaves[np.repeat(self.begin[lo] - skip, n) + np.arange(int(n.sum()))]


class Index:
    """Walks, pieces and items. Items that allow no edit (four characters at most) are looked up as they are."""

    def __init__(self, ids: list, texts: list[str | None]):
        codes, some = plain_codes(pa.array([t or "" for t in texts], pa.large_string()))
        ends = np.flatnonzero(codes == _END)
        self.ids, self.plain = ids, [""] * len(texts)
        self.short: list[int] = []
        pieces, piece_codes = [], []  # of a piece: its item, where it begins there, its edits
        groups: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        for i, a, b in zip(some.tolist(), [0, *(ends + 1).tolist()], ends.tolist(), strict=False):
            item = codes[a:b]
            m = len(item)
            self.plain[i] = item.tobytes().decode("utf-32-le")
            k = edits_of(m)
            if not k:
                self.short.append(i)
                continue
            n = -(-m // PIECE)
            cut = (np.arange(n + 1) * m // n).tolist()
            groups.setdefault(next(j for j, s in enumerate(SAMPLES) if m >= s[0]), []).append((item, len(pieces), n))
            for f, g in zip(cut, cut[1:], strict=False):  # within its share of the edits one piece at least must be; one more lets others help
                pieces.append((i, f, k if n == 1 else k * (g - f) // m + 1))
                piece_codes.append(item[f:g])
        self.piece_item, self.piece_at, self.piece_edits = (np.array([p[j] for p in pieces], np.int64) for j in range(3))
        self.piece_chars = np.array([len(c) for c in piece_codes], np.int64)
        self.walks = [w for j, rows in sorted(groups.items()) for w in self._walks(j, rows)]
        # Letters of pieces by number; where there are too many, several share one, which only lets more through.
        letters = np.unique(np.concatenate(piece_codes)) if piece_codes else np.zeros(0, np.uint32)
        self.number = np.zeros(int(letters.max(initial=0)) + 2, np.int16)  # the last for all characters beyond
        self.number[letters] = np.arange(len(letters)) % 256 + 1
        self.masks = np.zeros((len(piece_codes), 257), np.uint64)
        for p, c in enumerate(piece_codes):
            bit = np.uint64(1) << np.arange(64 - len(c), 64).astype(np.uint64)
            np.bitwise_or.at(self.masks[p], self.numbers(c), bit)
            self.masks[p] |= self.below(np.array([len(c)]))
        self.masks = self.masks.ravel()

    @staticmethod
    def below(chars: np.ndarray) -> np.ndarray:
        """Bits under those of a piece, whose last character has the highest bit."""
        return ~(np.uint64(0xFFFFFFFFFFFFFFFF) << (64 - chars).astype(np.uint64))

    def _walks(self, j: int, rows: list[tuple[np.ndarray, int, int]]) -> Iterator[tuple[Walk, Table, np.ndarray, np.ndarray]]:
        """Of each repetition: the walk, a table of its blocks that lie in an item, and of each block the piece in which its middle lies
        and how far from the piece's start it begins."""
        _, steps, samples, repetitions = SAMPLES[j]
        codes = np.concatenate([x for item, _, _ in rows for x in (item, np.array([_END], np.uint32))])
        ends = np.flatnonzero(codes == _END)
        end = np.repeat(ends, np.diff(ends, prepend=-1))
        starts = np.concatenate([[0], ends[:-1] + 1])
        piece = np.concatenate([np.arange(p, p + n) for _, p, n in rows])
        begins = np.repeat(starts, [n for _, _, n in rows]) + self.piece_at[piece]
        for r in range(repetitions):
            walk = Walk(steps, samples, 10 * (j * 100 + r) + 41)
            h, last = walk.blocks(padded(codes, steps), ends=True)
            at = np.flatnonzero(last <= end)
            own = np.searchsorted(begins, (at + last[at]) // 2, "right") - 1
            yield walk, Table(h[at], np.arange(len(at))), piece[own], at - begins[own]

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        return self.number[np.minimum(codes, len(self.number) - 1)]

    def trials(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (piece, place) where a block says that the piece may begin at one of the NEAR places from there."""
        found = [np.zeros(0, np.int64)]
        letters = padded(codes, max((w.steps for w, *_ in self.walks), default=0))
        for walk, table, piece, offset in self.walks:
            at, one = table.met(walk.blocks(letters[: len(codes) + walk.steps + 1])[0])
            found.append(np.unique((piece[one] << 40) + (at - offset[one] + (1 << 20)) // NEAR))
        both = np.unique(np.concatenate(found))
        return both >> 40, (both & ((1 << 40) - 1)) * NEAR - (1 << 20)

    def tried(self, numbers: np.ndarray, piece: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which pieces stand near their places within the edits that they may have (or nearly, if letters share a number). A step
        takes one edit away at most, so a trial ends when too few steps are left for it."""
        out = np.zeros(len(piece), bool)
        numbers = np.pad(numbers, MARGIN)  # before and after all texts stands a number that no letter has
        order = np.argsort(self.piece_chars[piece] + 2 * self.piece_edits[piece], kind="stable")
        one = np.uint64(1)
        for a in range(0, len(order), TRIALS):
            rows = order[a : a + TRIALS]
            p, most = piece[rows], self.piece_edits[piece[rows]]
            x, row = place[rows] - most + MARGIN, p * 257
            left = int((self.piece_chars[p] + 2 * most).max()) + NEAR
            up, down = ~self.below(self.piece_chars[p]), np.zeros(len(p), np.uint64)
            score = self.piece_chars[p]
            best = score.copy()
            while left and len(rows):
                here, eq, d0, hp, t = (np.empty(len(rows), k) for k in (np.int64, np.uint64, np.uint64, np.uint64, np.uint64))
                for _ in range(min(LOOK, left)):
                    np.add(row, numbers.take(x, mode="clip"), out=here)
                    self.masks.take(here, out=eq, mode="clip")
                    np.bitwise_and(eq, up, out=d0)
                    d0 += up
                    d0 ^= up
                    d0 |= eq
                    d0 |= down
                    np.bitwise_or(d0, up, out=hp)
                    np.invert(hp, out=hp)
                    hp |= down
                    up &= d0  # the places where a row goes down
                    score -= np.right_shift(hp.view(np.int64), 63, out=here)
                    score += np.right_shift(up.view(np.int64), 63, out=here)
                    hp <<= one
                    up <<= one
                    np.bitwise_or(d0, hp, out=t)
                    np.invert(t, out=t)
                    up |= t
                    np.bitwise_and(hp, d0, out=down)
                    np.minimum(best, score, out=best)
                    x += 1
                left -= min(LOOK, left)
                out[rows[best <= most]] = True
                alive = (best > most) & (score - left <= most)
                if not left or not alive.any():
                    break
                if alive.sum() < 0.9 * len(rows):
                    rows, most, x, row, up, down, score, best = (v[alive] for v in (rows, most, x, row, up, down, score, best))
        return out


def best_window(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(edits, end) of the substring of text nearest to the pattern, if it takes `most` edits at most: Myers' bit
    vectors, exact. Of equal distances the first end counts."""
    m = len(pattern)
    if not m:
        return None
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | (1 << i)
    all_, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = all_, 0, m
    best = (m, 0)
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | down
        d0 = ((((eq & up) + up) ^ up) | x) & all_
        hp = down | (all_ & ~(d0 | up))
        hn = up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) & all_
        hn = (hn << 1) & all_
        up = hn | (all_ & ~(d0 | hp))
        down = hp & d0
        if score < best[0]:
            best = (score, i + 1)
    return best if best[0] <= most else None


def matches(index: Index, texts: pa.Array) -> list[tuple[int, int, int, int]]:
    """(text, item, edits, first word of the window) of the best window of each contaminated text and item."""
    codes, some = plain_codes(texts)
    ends = np.flatnonzero(codes == _END)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    best: dict[tuple[int, int], tuple[int, int]] = {}
    if index.short:
        whole = codes.tobytes().decode("utf-32-le")
        for i in index.short:
            at = whole.find(index.plain[i])
            while at >= 0:
                t = int(np.searchsorted(ends, at))
                best[t, i] = (0, at)
                at = whole.find(index.plain[i], int(ends[t]))
    piece, place = index.trials(codes)
    hit = np.flatnonzero(index.tried(index.numbers(codes), piece, place))
    piece, place = piece[hit], place[hit]
    spare = index.piece_edits[piece]
    regions: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, at, o, e in zip(index.piece_item[piece].tolist(), place.tolist(), index.piece_at[piece].tolist(), spare.tolist(), strict=True):
        m = len(index.plain[i])
        k = edits_of(m)
        lo, hi = at - e - o - k, at + NEAR + e + m - o + k
        for t in range(int(np.searchsorted(ends, lo)), min(int(np.searchsorted(starts, hi)), len(ends))):
            regions.setdefault((t, i), []).append((max(lo, int(starts[t])), min(hi, int(ends[t]))))
    for (t, i), rows in regions.items():
        rows.sort()
        joined = [rows[0]]
        for lo, hi in rows[1:]:
            if lo <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(hi, joined[-1][1]))
            else:
                joined.append((lo, hi))
        pattern = index.plain[i]
        for lo, hi in joined:
            text = codes[lo:hi].tobytes().decode("utf-32-le")
            if (got := best_window(pattern, text, edits_of(len(pattern)))) and got[0] < best.get((t, i), (10**9, 0))[0]:
                head = text[: got[1]][::-1][: len(pattern) + got[0]]
                back = best_window(pattern[::-1], head, got[0])
                best[t, i] = (got[0], lo + got[1] - back[1])
    return sorted((int(some[t]), i, e, int(np.count_nonzero(codes[starts[t] : at] == _SPACE))) for (t, i), (e, at) in best.items())


def portions(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes over the items, PORTION_BYTES of text each; null ids and texts without words are left out."""
    ids, texts, size = [], [], 0
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col).dropDuplicates()
    for row in rows.toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1].encode("utf-8", "replace"))
        if size >= PORTION_BYTES:
            yield Index(ids, texts)
            ids, texts, size = [], [], 0
    yield Index(ids, texts)


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, item_id, edits, item_chars, first_word): each item that a document holds within MAX_EDITS of the item's
    characters (lower-case letters and digits; other characters part words). Of several windows of an item in a text the one of
    fewest edits counts, and of equal ones the first; equal items under several ids all count. Null ids of documents stay null; null
    and empty texts hold nothing; repeated rows give repeated results; very long texts are walked whole, in time and memory
    proportional to them. Items without an id or words are left out; an empty table on either side gives an empty result. Only the id
    and the text of docs are read, so other names cannot clash."""
    kind, item = docs.schema[id_col].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    arrow = pa.int64() if item == "bigint" else None
    out = None
    for index in portions(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for part, texts in passes(batch, "text"):
                    if got := matches(index, texts):
                        t, i, e, f = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(t)), pa.array([index.ids[k] for k in i], arrow), pa.array(e, pa.int32()), pa.array([len(index.plain[k]) for k in i], pa.int32()), pa.array(f, pa.int64())], [id_col, "item_id", "edits", "item_chars", "first_word"])

        one = docs.select(id_col, "text").mapInArrow(run, f"{id_col} {kind}, item_id {item}, edits int, item_chars int, first_word bigint")
        out = one if out is None else out.unionByName(one)
    return out


def cleaned(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs that hold no item, in their own columns, whatever their names: one scan for each portion of the items, no
    shuffle. Null and empty texts hold nothing and stay; repeated rows stay or go together; very long texts take time and memory in
    proportion; an empty table gives an empty one, and without items all rows stay."""
    for index in portions(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in passes(batch, "text"):
                    keep = np.ones(len(texts), bool)
                    keep[[m[0] for m in matches(shared.value, texts)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
