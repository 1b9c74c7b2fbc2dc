"""Token counts by prefix dynamic programming for a byte-level BPE. For each prefix there is exactly one token that can
stand last: the one whose pair with the last token of the prefix before it is an encoding of its own. The count at a
prefix is the count there plus one. So a table has the exact count at every prefix, and how much of a text fits a
budget, or what a cut would cost, is read off without encoding again.

White space after another character parts a text into segments (white space, then other characters) that no prefix
can change afterwards; a segment's table is made once for each distinct segment of a worker and looked up after
that, and a text's table is the running sum of its segments'."""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import BLANKS
from lodestone.llm.common import passes

LIMIT = 1024
#: Distinct segments whose totals a worker keeps, and whose tables; then it starts anew (results do not depend on it).
TOTALS, CACHE = 1 << 20, 1 << 15
#: Prefixes of matches whose last tokens a worker keeps, and the bytes of the longest such match.
STATES, STATE_BYTES = 1 << 19, 40


def _byte_letters() -> dict[str, int]:
    """The letters by which such files write bytes: printable ones stand for themselves, others for 256 and on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Counter:
    """Counts tokens as the library does for a byte-level BPE file (tokenizer.json)."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocabulary = {as_bytes(k): v for k, v in model["vocab"].items() if all(c in letters for c in k)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: dict[bytes, int] = {}
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        for i, (a, b) in enumerate(merges):
            a, b = as_bytes(a), as_bytes(b)
            if a + b not in self.rank:
                self.rank[a + b] = i
                self.parts[a + b] = (a, b)
        self.pair_rank = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(merges)}
        self.tokens = {t for t in vocabulary if len(t) == 1 or t in self.parts}
        self.longest = max(map(len, self.tokens))
        # Tokens by their last three bytes: the lengths that a token ending so may have, longest first.
        ends: dict[bytes, set[int]] = {}
        for t in self.tokens:
            ends.setdefault(t[-3:], set()).add(len(t))
        self.lengths = {k: tuple(sorted(v | ({2} if k[-2:] in self.tokens else set()) | {1}, reverse=True)) for k, v in ends.items()}
        self.state: dict[bytes, tuple[int, bytes]] = {b"": (0, b"")}  # of each prefix, its count and last token
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(pattern)
        self.segment = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")
        self.held: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.totals: dict[str, int] = {}

    # One match of the pattern ------------------------------------------------------------------------------------

    def merge(self, piece: bytes) -> list[bytes]:
        """Plain merging, lowest rank first, leftmost first; for short pieces."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = self.pair_rank.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def holds(self, a: bytes, b: bytes) -> bool:
        """Whether a, b is the encoding of its bytes."""
        got = self.held.get((a, b))
        if got is None:
            if len(self.held) >= TOTALS:
                self.held.clear()
            got = self.held[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return got

    def table(self, piece: bytes) -> list[int]:
        """The number of tokens of each prefix of the piece, by bytes, from 0 on."""
        n = len(piece)
        count, last = [0] * (n + 1), [b""] * (n + 1)
        held, holds, tokens, lengths = self.held, self.holds, self.tokens, self.lengths
        for i in range(1, n + 1):
            end = piece[max(0, i - 3) : i]
            for k in lengths.get(end) or lengths.get(end[-2:]) or (1,):
                if k > i:
                    continue
                t = piece[i - k : i]
                if t not in tokens:
                    continue
                if k == i:
                    if k > 1 and not self.alone(t):
                        continue
                else:
                    before = last[i - k]
                    ok = held.get((before, t))
                    if not (holds(before, t) if ok is None else ok):
                        continue
                count[i], last[i] = count[i - k] + 1, t
                break
            else:  # a token of one byte always exists in such files
                t = piece[i - 1 : i]
                count[i], last[i] = count[i - 1] + 1, t
        return count

    def last(self, piece: bytes) -> int:
        """The number of tokens of a piece; the same table, kept by prefix, so that pieces with a common start share it."""
        if len(piece) > STATE_BYTES:
            return self.table(piece)[-1]
        state, held, tokens, lengths = self.state, self.held, self.tokens, self.lengths
        got = state.get(piece)
        if got is not None:
            return got[0]
        if len(state) > STATES:
            state.clear()
            state[b""] = (0, b"")
        n = len(piece)
        i = n - 1
        while piece[:i] not in state:
            i -= 1
        for j in range(i + 1, n + 1):
            end = piece[max(0, j - 3) : j]
            for k in lengths.get(end) or lengths.get(end[-2:]) or (1,):
                if k > j:
                    continue
                t = piece[j - k : j]
                if t not in tokens:
                    continue
                count, before = state[piece[: j - k]]
                if k == j:
                    if k > 1 and not self.alone(t):
                        continue
                else:
                    ok = held.get((before, t))
                    if not (self.holds(before, t) if ok is None else ok):
                        continue
                state[piece[:j]] = (count + 1, t)
                break
            else:
                state[piece[:j]] = (state[piece[: j - 1]][0] + 1, piece[j - 1 : j])
        return state[piece][0]

    def alone(self, token: bytes) -> bool:
        """Whether a token is the encoding of its own bytes."""
        return self.holds(b"", token)

    # Segments ----------------------------------------------------------------------------------------------------

    def by_characters(self, piece: str) -> list[int]:
        """The table of a piece at the ends of its characters."""
        data = piece.encode("utf-8", "replace")
        t = self.table(data)
        if len(data) == len(piece):
            return t
        return [t[k] for k in itertools.accumulate((len(c.encode("utf-8", "replace")) for c in piece), initial=0)]

    def prefixes(self, segment: str) -> tuple[int, ...]:
        """The number of tokens of each prefix of a segment, by characters, from 0 on; time grows with its length. A cut within the
        white space before a segment leaves one match; a later cut changes the match that it falls in, and none before it; a
        match begun by an apostrophe and cut is matched anew, any other stays one match."""
        got = self.known.get(segment)
        if got is not None:
            return got
        blanks = len(segment) - len(segment.lstrip(BLANKS))
        out, before = self.by_characters(segment[:blanks]) if blanks else [0], 0
        for m in self.pattern.finditer(segment):
            s, e = m.span()
            t = self.by_characters(m[0])
            for k in range(max(s, blanks) + 1, e + 1):
                if segment[s] == "'" and k - s < 4:
                    out.append(before + sum(self.table(p.encode("utf-8", "replace"))[-1] for p in self.pattern.findall(segment[s:k])))
                else:
                    out.append(before + t[k - s])
            before += t[-1]
        if len(self.known) >= CACHE:
            self.known.clear()
        out = tuple(out)
        if len(segment) <= 64:
            self.known[segment] = out
        return out

    def total(self, segment: str) -> int:
        got = self.totals.get(segment)
        if got is None:
            if len(self.totals) >= TOTALS:
                self.totals.clear()
            word = segment[1:] if segment[0] == " " else segment
            if word.isalpha():  # one match of the pattern
                got = self.last(segment.encode("utf-8", "replace"))
            else:
                got = sum(self.last(p.encode("utf-8", "replace")) for p in self.pattern.findall(segment))
            if len(segment) <= 64:
                self.totals[segment] = got
        return got

    # Texts -------------------------------------------------------------------------------------------------------

    def segments(self, text: str) -> list[str]:
        """Special strings are segments of their own."""
        if self.split is None or not any(s in text for s in self.special):
            return self.segment.findall(text)
        return [s for i, part in enumerate(self.split.split(text)) for s in ([part] if i % 2 else self.segment.findall(part))]

    def sums(self, segments: list[str]) -> list[int]:
        """The number of tokens up to the end of each segment."""
        special = set(self.special)
        totals, total = self.totals, self.total
        return list(itertools.accumulate(1 if s in special else totals.get(s) or total(s) for s in segments))

    def count(self, text: str) -> int:
        sums = self.sums(self.segments(text))
        return sums[-1] if sums else 0

    def at_every_prefix(self, text: str) -> list[int]:
        """The number of tokens of text[:k] for each k. A cut inside a special string makes ordinary text of its part,
        after the segment before it."""
        out, before, special = [0], 0, set(self.special)
        tail = ""
        for s in self.segments(text):
            if s in special:
                whole = self.segments_plain(tail)
                base = before - sum(self.total(x) for x in whole[-1:])
                for k in range(1, len(s)):
                    out.append(base + sum(self.total(x) for x in self.segments_plain((whole[-1] if whole else "") + s[:k])))
                before += 1
                out.append(before)
                tail = ""
            else:
                table = self.prefixes(s)
                out += [before + x for x in table[1:]]
                before += table[-1]
                tail = s
        return out

    def segments_plain(self, text: str) -> list[str]:
        return self.segment.findall(text)

    def fitting(self, text: str, budget: int, segments: list[str] | None = None, sums: list[int] | None = None) -> int:
        """The length of the longest prefix of whole segments, and then characters of the next, of at most `budget`
        tokens at each of its ends, from the tables."""
        segments = self.segments(text) if segments is None else segments
        sums = self.sums(segments) if sums is None else sums
        if not sums or sums[-1] <= budget:
            return len(text)
        k = bisect.bisect_right(sums, budget)
        size = sum(map(len, segments[:k]))
        if segments[k] in self.special:
            return size
        before = sums[k - 1] if k else 0
        table = self.prefixes(segments[k])
        return size + max(i for i, x in enumerate(table) if before + x <= budget)


@functools.lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    """One for each worker process."""
    return Counter(path, pattern)


def counted(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT, id_col: str = "doc_id") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit), fitting_chars (the longest prefix within the limit), a row for each row
    of docs, also where ids are null or repeat. Null texts are empty texts; very long ones take time and memory in proportion. Other
    columns are not read, so their names cannot clash; an empty table gives an empty table. One scan of whole texts, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    path = os.fspath(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for batch in batches:
            for part, texts in passes(batch, "text"):
                size, n, fit = [], [], []
                for text in texts.to_pylist():
                    segments = own.segments(text)
                    sums = own.sums(segments)
                    size.append(len(text.encode("utf-8", "replace")))
                    n.append(sums[-1] if sums else 0)
                    fit.append(own.fitting(text, limit, segments, sums))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n]), pa.array(fit, pa.int64())], [id_col, "n_bytes", "n_tokens", "over_limit", "fitting_chars"])

    return docs.select(F.col(id_col), "text").mapInArrow(run, f"{id_col} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fitting_chars bigint")
