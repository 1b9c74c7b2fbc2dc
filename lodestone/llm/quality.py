"""Quality rules as a ledger: every rule is evaluated once per text, its measurement and failure bit are stored, and
policies are masks over the bits. Trying another policy, or leaving a rule out, never reads a text again."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Words, mixed, passes, settle, windows

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in a window that may repeat.
WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "longest_word", "n_ellipses", "n_stutters")


@dataclass(frozen=True)
class Rule:
    """bit: its place in the ledger, never used again for another rule. fails: over the measures, in whole numbers."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 25 * n_words"),
    Rule(6, "ellipses", "10 * n_ellipses > 3 * n_lines"),
    Rule(7, "very_long_word", "longest_word > 2000"),
    Rule(8, "few_words_in_total", "n_words < 50"),
    Rule(9, "stutters", "10 * n_stutters > 3 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject under it."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[name] for name in self.rules)


POLICIES = {
    p.version: p
    for p in (
        Policy("base", ("few_words", "repeated_windows")),
        # Without repeated_lines: alone, it rejects only texts that are labelled good (see ablation()).
        Policy("2026-1", ("few_words", "repeated_windows", "symbols", "ellipses", "stutters")),
        Policy("2026-2-strict", tuple(r.name for r in RULES)),
    )
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text; a null or empty text has zeros. Sizes of texts have no limit."""
    words = Words(texts)
    n, data, at = len(texts), words.data, words.at
    hashes = words.hashes()

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[at[1:]] - total[at[:-1]]

    whole = np.zeros(256, bool)
    whole[[*range(0x80), *range(0xC0, 0x100)]] = True  # first bytes of characters
    inner = whole.copy()
    inner[[0x20, 9, 10, 11, 12, 13]] = False
    out = {"n_words": words.counts.astype(np.int64), "word_chars": per_text(inner[data]), "n_symbols": per_text(_SYMBOL[data])}

    own = mixed(np.arange(1, n + 1, dtype=np.uint64))
    breaks = np.flatnonzero(data == 10)
    line_start = np.union1d(at[:-1], breaks + 1)
    line_start = line_start[line_start < len(data)]
    text_end = at[1:][np.searchsorted(at, line_start, "right") - 1]
    next_break = np.append(breaks, len(data))[np.searchsorted(breaks, line_start)]
    line_end = np.minimum(next_break, text_end)
    has_word = np.searchsorted(words.start, line_start) < np.searchsorted(words.start, line_end)
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_text = np.searchsorted(at, line_start, "right") - 1
    out["n_lines"] = np.bincount(line_text, minlength=n).astype(np.int64)
    with np.errstate(over="ignore"):
        _, seen = np.unique(words.span_hash(line_start, line_end) + own[line_text], return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_text[seen], minlength=n)

    w = windows(hashes, WINDOW, 3)
    inside = words.text_of[: len(w)] == words.text_of[WINDOW - 1 :][: len(w)]
    repeated = np.zeros(len(hashes), bool)
    where = np.flatnonzero(inside)
    with np.errstate(over="ignore"):
        key = w[where] + own[words.text_of[where]]
    ranked = np.sort(key)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if len(twice):
        place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        firsts = where[twice[place] == key]
        for i in range(WINDOW):
            repeated[firsts + i] = True
    out["n_repeat_words"] = words.per_text(repeated)

    again = np.zeros(len(hashes), bool)  # words equal to the one before
    again[1:] = (hashes[1:] == hashes[:-1]) & (words.text_of[1:] == words.text_of[:-1])
    out["n_stutters"] = words.per_text(again)

    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, words.text_of, words.end - words.start)
    out["longest_word"] = longest  # in bytes
    dots = np.zeros(len(data), bool)
    stop = data == 46
    if len(data) > 2:
        dots[2:] = stop[2:] & stop[1:-1] & stop[:-2]
    ends = words.end[np.searchsorted(words.start, line_end) - 1] - 1 if len(line_end) else line_end  # of each line's last word
    out["n_ellipses"] = np.bincount(line_text[dots[ends] & (ends - 2 >= line_start)], minlength=n).astype(np.int64)
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measures, and `failed`: a long with bit b set where rule b fails. One scan, no shuffle.

    Null and empty texts measure 0 everywhere (so few_words fails); null ids stay null; repeated rows are measured
    row by row; other columns are not read."""
    fields = [docs.schema[id_col], *(("n", m) for m in MEASURES)]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in passes(batch, "__text"):
                got = measure(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[m]) for m in MEASURES)], ["__id", *MEASURES])

    schema = f"__id {kind}, " + ", ".join(f"{m} bigint" for _, m in fields[1:])
    measured = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, schema)
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint") for r in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("failed", total).withColumnRenamed("__id", id_col)


def passes_policy(failed: str | Column, policy: Policy) -> Column:
    """True where no rule of the policy fails."""
    column = F.col(failed) if isinstance(failed, str) else failed
    return column.bitwiseAND(F.lit(policy.mask).cast("bigint")) == 0


def ablation(rows: DataFrame, policies: dict[str, Policy] | None = None) -> DataFrame:
    """For each policy and each of its rules: texts kept by the whole policy, kept without that rule, and rejected by
    that rule alone. The ledger shrinks to one row per bit pattern (2 ** rules at most), in one aggregation of one scan; the rest
    is bitwise work on those rows."""
    patterns = settle(rows.sparkSession, rows.groupBy("failed").agg(F.count("*").alias("n")), "patterns")
    cases = [F.struct(F.lit(p.version).alias("policy"), F.lit(r.name).alias("rule"), F.lit(p.mask).cast("bigint").alias("mask"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for p in (policies or POLICIES).values() for r in RULES if r.name in p.rules]
    hit = F.col("failed").bitwiseAND(F.col("c.mask"))
    count = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    return patterns.withColumn("c", F.explode(F.array(*cases))).groupBy("c.policy", "c.rule").agg(
        count(hit == 0).alias("kept"), count(hit.bitwiseAND(F.bitwise_not("c.bit")) == 0).alias("kept_without"), count(hit == F.col("c.bit")).alias("rejected_alone")
    )


def judged(docs: DataFrame, policy: str = "2026-1") -> DataFrame:
    """The ledger with the verdict of one policy: base_failed and kept. Odd rows as in ledger(); an empty table gives an empty one."""
    rows = ledger(docs)
    base = ~passes_policy("failed", POLICIES["base"])
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & passes_policy("failed", POLICIES[policy]))
