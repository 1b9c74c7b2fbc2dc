"""Language identification: hashed subwords have embeddings, a text is their average, and a linear softmax over it gives the
languages; both are trained by stochastic gradient descent in numpy. Scores are calibrated by a temperature, and predictions below a
calibrated score are marked as rejected.

Scale: training takes at most `max_rows` labelled rows, dealt evenly over languages by a hash of the id, and MAX_BYTES of their
whole texts, to the driver (a documented bound); prediction is one scan of all whole texts without a shuffle, with a table of a few MB."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import forget, passes, settle, text_column

ORDERS = (1, 2, 3, 4)  # characters in a subword, its word's border counted as one
SPACE_BITS = 17  # subwords are hashed to 2 ** SPACE_BITS embeddings
WIDTH = 16
#: Labelled rows that training takes at most; beyond, those with the smallest hash of their id, as many of each language as there are.
MAX_ROWS = 4000
#: Bytes of their texts that training takes at most, in the same order.
MAX_BYTES = 16 << 20
#: Characters that the descent reads at most beyond its first two passes.
MAX_READ = 64 << 20
#: Characters of a run of words that is learnt besides its text.
MAX_SPAN = 4000
#: Of the learnt rows, one in so many is left to calibration.
CALIBRATED = 5
#: Share of right answers among those that are not rejected, on the rows of calibration.
PRECISION = 0.99
UNKNOWN = "und"


@functools.cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether it is a letter, and whether it may stand inside a word (letters and marks)."""
    kind = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    return kind == "L", (kind == "L") | (kind == "M")


class Subwords:
    """The hashed subwords of texts, each as often as it occurs. Words are runs of letters and marks, lower-cased; a subword lies in
    one word, with its borders.

    any_letter: of each text. n: of its subwords. orders: the places of subwords in all characters and their hashes, for each order. start: where
    each text's characters begin."""

    def __init__(self, texts: list[str]):
        is_letter, inside = letters()
        codes = np.frombuffer("\0".join(["", *(t.lower() for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t.lower()) for t in texts], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes + 1)])  # of the border before each text
        letter = np.concatenate([[0], np.cumsum(is_letter[codes])])
        self.any_letter = letter[first[1:]] > letter[first[:-1]]
        within = inside[codes]
        keep = within.copy()
        keep[1:] |= within[:-1]  # a border after each word; what else is between words goes
        keep[first] = True
        kept = np.concatenate([[0], np.cumsum(keep)])
        self.start = kept[first[:-1]]
        codes = np.where(within, codes, 0)[keep]
        border = codes == 0
        self.orders, self.n = [], np.zeros(len(texts), np.int64)
        h = codes * np.uint32(0x9E3779B1)
        clear = np.ones(len(codes), bool)  # no border within the characters so far, but for the first
        for n in range(1, max(ORDERS) + 1):
            if n > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + codes[n - 1 :] * np.uint32(0x9E3779B1)
                clear = clear[:-1] & ~border[n - 2 : len(codes) - 1] if n > 2 else clear[:-1]
            if n in ORDERS:
                empty = border[: len(clear)] & border[n - 1 :] if n < 3 else np.zeros(len(clear), bool)  # borders alone are no subword
                at = np.flatnonzero(clear & ~empty)
                x = h[at]
                x = (x ^ (x >> np.uint32(16))) * np.uint32(0xC2B2AE3D)
                self.orders.append((at, x >> np.uint32(32 - SPACE_BITS)))
                self.n += np.diff(np.append(np.searchsorted(at, self.start), len(at)))

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Of each text, the sum of its subwords' rows."""
        out = np.zeros((len(self.start), table.shape[1]))  # sums in doubles, the same wherever a text stands
        for at, x in self.orders:
            begin = np.append(np.searchsorted(at, self.start), len(at))
            some = begin[1:] > begin[:-1]
            if some.any():
                out[some] += np.add.reduceat(table[x], begin[:-1][some], axis=0, dtype=np.float64)
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, subword), each as often as it occurs."""
        text = [np.searchsorted(self.start, at, "right") - 1 for at, _ in self.orders]
        return np.concatenate(text), np.concatenate([x for _, x in self.orders]).astype(np.int64)


@dataclass
class Model:
    """langs: those learnt, in order. table: of each hashed subword, its embedding, or what it adds to each language's logit. output: from embeddings
    to logits, where the table holds embeddings. least: scores below are rejected."""

    langs: list[str]
    table: np.ndarray
    output: np.ndarray | None
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, subwords: Subwords) -> np.ndarray:
        mean = subwords.sums(self.table) / np.maximum(subwords.n, 1)[:, None]
        return (mean if self.output is None else mean @ self.output) + self.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def spans(texts: list[str], rng: np.random.Generator, each: int) -> list[tuple[int, str]]:
    """(text, itself) and some random runs of 1 to 40 of its words: short texts are to be known too."""
    out = []
    for i, t in enumerate(texts):
        words = t.split()
        out.append((i, t))
        for _ in range(each):
            size = int(min(len(words), 40 ** rng.random()))
            first = int(rng.integers(0, len(words) - size + 1))
            run = " ".join(words[first : first + size])
            if len(run) <= MAX_SPAN:
                out.append((i, run))
    return out


def fit(texts: list[str], langs: list[str], steps: int = 2500, rate: float = 4.0, group: int = 16, precision: float = PRECISION) -> Model:
    """steps: groups of texts that the descent takes, in whole passes over the texts and their spans. Texts without a letter teach nothing. With one language, or none, there is nothing to tell apart."""
    names = sorted(set(langs))
    place = {x: i for i, x in enumerate(names)}
    rng = np.random.default_rng(11)
    weights = np.zeros((WIDTH, len(names)))
    embeddings = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << SPACE_BITS, WIDTH))
    bias = np.zeros(len(names))
    if len(names) > 1:
        learnt = [(i, t) for i, t in spans(texts, rng, 4) if i % CALIBRATED or len(texts) < 10 * CALIBRATED]
        order, step, turns = np.arange(len(learnt)), 0, -(-len(learnt) // group)
        epochs = max(2, min(20, -(-steps // turns), MAX_READ // max(1, sum(len(t) for _, t in learnt))))
        for _ in range(epochs):
            rng.shuffle(order)
            for at in range(0, len(order), group):
                some = [learnt[k] for k in order[at : at + group]]
                found = Subwords([t for _, t in some])
                text, x = found.pairs()
                used, x = np.unique(x, return_inverse=True)
                share = np.bincount(text * len(used) + x, minlength=len(some) * len(used)).reshape(len(some), -1) / np.maximum(found.n, 1)[:, None]
                own = embeddings[used]
                mean = share @ own
                error = softmax(mean @ weights + bias)
                error[np.arange(len(some)), [place[langs[i]] for i, _ in some]] -= 1
                error[~found.any_letter] = 0
                pace = rate * (1 - step / (epochs * turns))
                # Few subwords with large shares: steps that no logit overshoots.
                steep = (share @ share.T).sum(1).max() * np.linalg.norm(weights, 2) ** 2 / 2
                embeddings[used] = own - pace / max(1, pace * steep) * (share.T @ (error @ weights.T))
                weights -= pace / max(1, pace * (mean**2).sum(1).max() / 2) * (mean.T @ error) / group
                bias -= min(pace, 1) * error.mean(0)
                step += 1
    few = len(names) <= WIDTH
    model = Model(names, (embeddings @ weights if few else embeddings).astype(np.float32), None if few else weights, bias)
    held = [(i, t) for i, t in spans(texts, rng, 2) if i % CALIBRATED == 0]
    found = Subwords([t for _, t in held])
    if len(names) > 1 and found.any_letter.any():
        logits = model.logits(found)[found.any_letter]
        truth = np.array([place[langs[i]] for i, _ in held])[found.any_letter]
        loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
        p = softmax(logits / model.temperature)
        score, right = p.max(1), p.argmax(1) == truth
        order = np.argsort(-score, kind="stable")
        share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero(share >= precision)
        model.least = float(score[order[enough[-1]]]) if len(enough) else 1.0
    return model


def predictions(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The language, its score and whether it is rejected, of each text. Without a letter: UNKNOWN, 0, rejected."""
    found = Subwords(texts)
    if not model.langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    p = softmax(model.logits(found) / model.temperature)
    score = np.where(found.any_letter, p.max(1), 0.0)
    langs = [model.langs[k] if known else UNKNOWN for k, known in zip(p.argmax(1), found.any_letter, strict=True)]
    return langs, score, ~found.any_letter | (score < model.least)


def trained(docs: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id") -> Model:
    """docs: id, text and lang of the rows that may be learnt from. Null ids and languages are left out; a row counts once, with any of
    its texts and languages where an id repeats."""
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # A row's turn is about its place among the hashes of its language: languages take turns, and no language is gathered in one task.
    size = rows.groupBy("lang").agg(F.count("*").alias("n"))
    turn = F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) * F.col("n")
    some = rows.select(id_col, "lang").join(size, "lang").withColumn("turn", turn.cast("double")).orderBy("turn", id_col, "lang").limit(max_rows)
    some = some.groupBy(id_col).agg(F.min("turn").alias("turn"))
    picked = rows.select(id_col, "lang", "text").join(F.broadcast(some), id_col).groupBy(id_col).agg(F.min_by("lang", "text").alias("lang"), F.min("text").alias("text"), F.min("turn").alias("turn"))
    picked = settle(spark, picked.select("lang", "text", "turn", F.xxhash64(id_col).alias("h")), "learnt", few=True)
    sizes = picked.select("turn", "h", F.octet_length("text").alias("n")).orderBy("turn", "h").collect()  # max_rows narrow rows at most
    total, last = 0, (0, 0)
    for r in sizes:
        total += r["n"]
        if total > MAX_BYTES and last != (0, 0):
            break
        last = (r["turn"], r["h"])
    got = picked.where((F.col("turn") < last[0]) | ((F.col("turn") == last[0]) & (F.col("h") <= last[1]))).toArrow().sort_by([("turn", "ascending"), ("h", "ascending")])
    forget(spark, picked)
    return fit(text_column(got.column("text")).to_pylist(), got.column("lang").to_pylist())


def identified(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """id, lang_pred, score (0 to 1) and rejected of each row of docs, also where ids are null or repeat; a language of the model for
    every text with a letter, UNKNOWN for null texts and those without. Very long texts take time and memory in proportion. Other columns are not
    read, so their names cannot clash; an empty table gives an empty table."""
    shared = spark.sparkContext.broadcast(model)  # 2 ** SPACE_BITS rows of WIDTH numbers at most: 8 MB
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in passes(batch, batch.schema.names[1]):
                langs, score, rejected = predictions(shared.value, texts.to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], [id_col, "lang_pred", "score", "rejected"])

    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double, rejected boolean")
