"""Toxicity scores from a linear classifier on character n-grams whose features are scaled by naive Bayes log-count
ratios (NB-SVM with a logistic loss), trained on labelled texts.

Scale: training takes at most `max_rows` labelled rows, drawn by a hash of the id, and MAX_BYTES of their whole texts, to the
driver (a documented bound); scoring is one scan of all whole texts without a shuffle, with a model of a few hundred KB."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import forget, passes, settle

ORDERS = (3, 4, 5, 6)  # characters in an n-gram
SPACE_BITS = 20  # n-grams are hashed to 2 ** SPACE_BITS features
#: Labelled rows that training takes at most; beyond, those with the smallest hash of their id.
MAX_ROWS = 6000
#: Bytes of their texts that training takes at most, in the same order.
MAX_BYTES = 64 << 20
#: Features that the model keeps at most, by the evidence in their counts.
MAX_FEATURES = 1 << 15
#: Log-likelihood ratio of its counts that a feature needs (a million features are tried).
MIN_GAIN = 10
THRESHOLD = 0.3
#: Training takes so many texts apart, weighs so many features and steps through so many texts at a time.
STEP, SLICE, BLOCK = 8, 1 << 16, 256


@dataclass
class Model:
    """place: of each hashed n-gram, its row in weight plus one, or 0. weight: log-count ratio times coefficient."""

    place: np.ndarray
    weight: np.ndarray
    bias: float


def grams(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Where each text (lower case, one space between words and around them) starts in the joined characters, the hashed
    n-grams at each place, and the sizes of the texts."""
    texts = [" " + " ".join(t.lower().split()) + " " for t in texts]
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.concatenate([[0], np.cumsum(size + 1)])
    out, h = [], codes * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        if len(h) < 2:
            h = np.zeros(0, np.uint32)
        else:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + codes[n - 1 :] * np.uint32(0x9E3779B1)
        if n in ORDERS:
            x = (h ^ (h >> np.uint32(16))) * np.uint32(0xC2B2AE3D)
            out.append(x >> np.uint32(32 - SPACE_BITS))
    return start, out, size


def found(texts: list[str], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature), once each, for the n-grams that the model knows. No n-gram crosses two texts."""
    start, orders, size = grams(texts)
    pairs = []
    for n, h in zip(ORDERS, orders, strict=True):
        f = place[h]
        at = np.flatnonzero(f)
        text = np.searchsorted(start, at, "right") - 1
        ok = at + n <= start[text] + size[text]
        pairs.append(text[ok] * np.int64(1 << SPACE_BITS) + f[at[ok]] - 1)
    pairs = np.unique(np.concatenate(pairs))
    return pairs >> SPACE_BITS, pairs & ((1 << SPACE_BITS) - 1)


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> Model:
    """Without labels of both kinds the model is the share of toxic labels (a half without labels).

    It is fitted on the driver: a few texts are taken apart at a time, features are weighed a slice at a time, and of each text only its
    known features are held, in two bytes each."""
    n, bits = len(texts), 1 << SPACE_BITS
    share = (toxic.sum() + 0.5) / (n + 1)
    plain = Model(np.zeros(bits, np.uint16), np.zeros(1), float(np.log(share / (1 - share))))
    if not n or toxic.min() == toxic.max():
        return plain

    def parts(place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, n, STEP):
            text, feature = found(texts[i : i + STEP], place)
            yield text + i, feature

    count = np.zeros((2, bits), np.int32)
    for text, feature in parts(np.arange(1, bits + 1, dtype=np.int32)):
        for k in (0, 1):
            np.add.at(count[k], feature[toxic[text] == k], 1)
    size = np.array([(toxic == k).sum() for k in (0, 1)], float)
    able, worth = [], []
    for first in range(0, bits, SLICE):
        part = count[:, first : first + SLICE].astype(float)
        total, expected = part.sum(0), part.sum(0) * size[1] / n
        with np.errstate(divide="ignore", invalid="ignore"):  # the evidence: a log-likelihood ratio of the counts
            gain = np.nan_to_num(part[1] * np.log(part[1] / expected)) + np.nan_to_num(part[0] * np.log(part[0] / (total - expected)))
        gain[total < min(3, n)] = 0
        able.append(np.flatnonzero(gain > MIN_GAIN) + first)
        worth.append(gain[able[-1] - first])
    keep = np.concatenate(able)[np.argsort(-np.concatenate(worth), kind="stable")[:MAX_FEATURES]]
    if not len(keep):
        return plain
    place = np.zeros(bits, np.uint16)
    place[keep] = np.arange(1, len(keep) + 1)
    p, q = (count[1, keep] + 1) / (size[1] + 2), (count[0, keep] + 1) / (size[0] + 2)
    r = np.log(p / q)
    del count
    cols, known = [], np.zeros(n, np.int64)
    for text, feature in parts(place):
        cols.append(feature.astype(np.uint16))
        known += np.bincount(text, minlength=n)
    cols, norm = np.concatenate(cols), np.sqrt(np.maximum(known, 1.0))
    ends = np.concatenate([[0], np.cumsum(known)])

    def blocks() -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """The first and last of some texts, and of each of their features its text (from 0), place and value."""
        for i in range(0, n, BLOCK):
            j = min(n, i + BLOCK)
            row, col = np.repeat(np.arange(j - i), known[i:j]), cols[ends[i] : ends[j]].astype(np.intp)
            yield i, j, row, col, r[col] / norm[i:j][row]

    w, bias = np.zeros(len(keep)), plain.bias
    m = v = np.zeros(len(keep) + 1)
    for t in range(1, rounds + 1):  # Adam on the logistic loss
        e, g = np.zeros(n), np.zeros(len(keep))
        for i, j, row, col, x in blocks():
            z = np.bincount(row, weights=x * w[col], minlength=j - i) + bias
            e[i:j] = 1 / (1 + np.exp(-z)) - toxic[i:j]
            np.add.at(g, col, x * e[i:j][row])
        g = np.append(g / n + ridge * w, e.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        d = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - d[:-1], bias - d[-1]
    return Model(place, w * r, float(bias))


def scores(model: Model, texts: list[str]) -> np.ndarray:
    n = len(texts)
    text, feature = found(texts, model.place)
    known = np.sqrt(np.maximum(np.bincount(text, minlength=n), 1.0))
    z = np.bincount(text, weights=model.weight[feature], minlength=n) / known + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def trained(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id") -> Model:
    """labels: (id, toxic 0/1) of the rows that may be learnt from. Null ids and labels are left out; a row counts
    once; of rows that share an id the text is that of any of them."""
    some = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    some = some.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    rows = docs.select(id_col, "text").join(F.broadcast(some), id_col).groupBy(id_col).agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = settle(docs.sparkSession, rows.select("text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64(id_col).alias("h")), "learnt", few=True)
    sizes = rows.groupBy("h").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).orderBy("h").collect()  # max_rows narrow rows at most
    total, last = 0, None
    for r in sizes:
        total += r["n"]
        if total > MAX_BYTES and last is not None:
            break
        last = r["h"]
    got = rows.where(F.col("h") <= F.lit(last)).orderBy("h").select(F.coalesce("text", F.lit("")).alias("text"), "toxic").toArrow()
    forget(docs.sparkSession, rows)
    texts, toxic = got.column("text").to_pylist(), got.column("toxic").to_numpy().astype(np.int64)
    del got  # the texts are held once while the model is fitted
    return fit(texts, toxic)


def scored(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """id and `score` (0 to 1) of each row of docs, also where ids are null or repeat. Null and empty texts get the score of a text
    without evidence; very long ones take time and memory in proportion. Other columns are not read, so their names cannot clash;
    an empty table gives an empty table."""
    shared = spark.sparkContext.broadcast(model)  # at most a few MB: place has 2 ** SPACE_BITS rows, weight MAX_FEATURES
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in passes(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(shared.value, texts.to_pylist()))], [id_col, "score"])

    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} {kind}, score double")


def cleaned(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Whole rows of docs that score below the threshold, in their own columns, whatever their names: one scan, no shuffle. Null
    and empty texts have the score of a text without evidence; repeated rows stay or go together; very long texts take time and memory in
    proportion; an empty table gives an empty table."""
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in passes(batch, batch.schema.names[at]):
                yield part.filter(pa.array(scores(shared.value, texts.to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
