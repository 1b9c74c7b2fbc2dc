"""Near duplicates by BagMinHash: the multiset of a text's five-word shingles is a bag of weighted elements; for each
element, Poisson processes over dyadic layers of its weight ([0,1), [1,2), [2,4), ...) throw points at the signature's
components, in order of time, until none can lower a component any more. Equal components are then an unbiased
estimate of the weighted Jaccard similarity. Bands of components give candidates; the true overlap of the multisets
decides.

Scale: texts are read twice: for signatures, and for the texts of candidates, which a Bloom filter of bounded size picks
before any shuffle. Exact copies collapse to one representative before any pairing. In a bucket every member meets the
bucket's first member only (a star), so a hot bucket costs its size, not its square. After these links are joined to
components, the members that the stars left outside a bucket's largest component meet the others in cells of bounded
size, behind a bound on the distance of their signatures; members that the cell has already joined are not compared
again. Hot buckets and leaders are split (cells, salt, or the skew handling of adaptive joins)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Words, forget, fresh, keys, mixed, passes, powers, settle, windows

WIDTH = 5  # words in a shingle
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
#: Longs that hold four bits of each component.
PRINTS = math.ceil(BANDS * ROWS * 4 / 64)
#: Pairs of one leader that one task verifies.
LEADER_CHUNK = 512
#: Members of a bucket in one side of a cell, about.
CELL = 512
#: Bits of the filter that picks candidates' texts: 16 for each candidate, and this many at most (beyond, more texts are
#: shuffled than needed, and the result is the same).
MOST_BITS = 1 << 26

_SIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """(text, shingle, count) for each distinct shingle of each text, sorted by text and shingle. Words are runs of
    non-white-space in lower case. A text of one to four words is one shingle; a text without words has none."""
    words = Words(pc.utf8_lower(texts))
    h = words.hashes()
    w = windows(h, WIDTH, 11)
    owner = words.text_of[: len(w)]
    inside = owner == words.text_of[WIDTH - 1 :][: len(w)]
    text, value = owner[inside], w[inside]
    short = np.flatnonzero((words.counts > 0) & (words.counts < WIDTH))
    if len(short):
        with np.errstate(over="ignore"):
            extra = []
            for t in short:
                own = h[words.bounds[t] : words.bounds[t + 1]]
                extra.append(mixed(np.array([(own * keys(len(own), 13)).sum() + np.uint64(len(own))], np.uint64))[0])
        text, value = np.concatenate([text, short]), np.concatenate([value, np.array(extra, np.uint64)])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(text)))
    return text[first], value[first], count, words


def signatures(text: np.ndarray, value: np.ndarray, count: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash of each text: n x m times of the first points; rows of texts without elements stay infinite."""
    sig = np.full((n, m), np.inf)
    flat = sig.reshape(-1)
    if not len(text):
        return sig
    with np.errstate(over="ignore"):
        who, seed, low, width, weight = [], [], [], [], []
        layer, lo, hi = 0, 0, 1
        while True:
            on = np.flatnonzero(count > lo)
            if not len(on):
                break
            who.append(text[on])
            seed.append(mixed(value[on] + np.uint64(layer + 1) * _SIX))
            low.append(np.full(len(on), lo))
            width.append(np.full(len(on), hi - lo))
            weight.append(count[on])
            layer, lo, hi = layer + 1, hi, hi * 2
        who, seed, low, width, weight = map(np.concatenate, (who, seed, low, width, weight))
        time = np.zeros(len(who))
        step = np.uint64(0)
        while len(who):
            step += np.uint64(2)
            a = mixed(seed + step * _SIX)
            b = mixed(seed + (step + np.uint64(1)) * _SIX)
            time = time - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
            part = ((b & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
            cell = low + (((b >> np.uint64(32)) * width.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            ok = cell < weight
            np.minimum.at(flat, (who * m + part.astype(np.int64))[ok], time[ok])
            ids, back = np.unique(who, return_inverse=True)
            alive = time < sig[ids].max(axis=1)[back]
            if not alive.all():
                who, seed, low, width, weight, time = (x[alive] for x in (who, seed, low, width, weight, time))
    return sig


def prints(texts: pa.Array) -> dict[str, np.ndarray]:
    """Of each text: its weight, two digest longs of its word sequence, band hashes and four bits of each component."""
    text, value, count, words = shingles(texts)
    n = len(texts)
    sig = signatures(text, value, count, n).view(np.uint64)
    h = words.hashes()
    place = np.arange(len(h)) - words.bounds[words.text_of]
    out = {"weight": np.bincount(text, weights=count, minlength=n).astype(np.int64)}
    with np.errstate(over="ignore"):
        for name, base in (("d1", 0x2545F4914F6CDD1D), ("d2", 0xD1342543DE82EF95)):
            top = int(words.counts.max(initial=0))
            terms = np.concatenate([[np.uint64(0)], np.cumsum(h * powers(base, top)[place], dtype=np.uint64)])
            out[name] = (terms[words.bounds[1:]] - terms[words.bounds[:-1]] + words.counts.astype(np.uint64) * _SIX).view(np.int64)
        folded = mixed(sig)
        band = np.zeros((n, BANDS), np.uint64)
        for i, k in enumerate(keys(ROWS, 17) | np.uint64(1)):
            band += folded[:, i::ROWS] * k
        out["bands"] = mixed(band + np.arange(BANDS, dtype=np.uint64) * _SIX).view(np.int64)
        nibble = (folded >> np.uint64(60)).astype(np.uint64)
        packed = np.zeros((n, PRINTS), np.uint64)
        for i in range(BANDS * ROWS):
            packed[:, i // 16] |= nibble[:, i] << np.uint64(4 * (i % 16))
        out["prints"] = packed.view(np.int64)
    return out


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, weight, d1, d2, bands (array), p0.. (longs of four bits per component)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in passes(batch, "text"):
                got = prints(texts)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(texts) + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(got["bands"].reshape(-1)))
                columns = [part.column(0), *(pa.array(got[k]) for k in ("weight", "d1", "d2")), bands, *(pa.array(np.ascontiguousarray(got["prints"][:, i])) for i in range(PRINTS))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "weight", "d1", "d2", "bands", *(f"p{i}" for i in range(PRINTS))])

    schema = f"id {kind}, weight bigint, d1 bigint, d2 bigint, bands array<bigint>, " + ", ".join(f"p{i} bigint" for i in range(PRINTS))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def far_bound(threshold: float) -> int:
    """Bits in which the prints of a pair at the threshold differ, and five standard deviations more."""
    m, miss = BANDS * ROWS, 1 - threshold
    return math.ceil(m * 2 * miss + 5 * math.sqrt(m * (5 * miss - (2 * miss) ** 2)))


def overlap_enough(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float) -> bool:
    """Whether two multisets (sorted values, counts) have the similarity asked for; exact."""
    (v, c), (w, d) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    if not len(v):
        return False
    place = np.minimum(np.searchsorted(w, v), len(w) - 1)
    both = int(np.minimum(np.where(w[place] == v, d[place], 0), c).sum())
    return both >= threshold * (int(c.sum()) + int(d.sum()) - both) - 1e-9


class Sieve:
    """A Bloom filter over the hashes of ids, of at most MOST_BITS bits, sent to each executor: built in a few tasks from a
    narrow table, put together on the driver a portion at a time."""

    def __init__(self, spark: SparkSession, ids: DataFrame):
        n = ids.count()
        bits = self.bits = min(MOST_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
        places = self.places

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(bits, bool)
            for batch in batches:
                out[places(bits, batch.column(0).to_numpy())] = True
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(out).tobytes()], pa.binary())], ["bits"])

        whole = np.zeros(bits // 8, np.uint8)
        for row in ids.select(F.xxhash64(ids.columns[0]).alias("h")).coalesce(8).mapInArrow(build, "bits binary").toLocalIterator():
            whole |= np.frombuffer(row["bits"], np.uint8)
        self.shared = spark.sparkContext.broadcast(whole)

    @staticmethod
    def places(bits: int, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.concatenate([mixed(h.view(np.uint64) + np.uint64(k) * _SIX) & np.uint64(bits - 1) for k in range(1, 5)]).reshape(4, -1)

    def rows(self, docs: DataFrame, id_col: str, inside: bool) -> DataFrame:
        """Rows whose id may be one of the ids (all that are, and few others), or those whose id is surely none; no shuffle."""
        bits, shared, places, names = self.bits, self.shared, self.places, docs.columns

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.unpackbits(shared.value).view(bool)
            for batch in batches:
                hit = own[places(bits, batch.column(len(names)).to_numpy())].all(axis=0)
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names).filter(pa.array(hit if inside else ~hit))

        return docs.select(*docs.columns, F.xxhash64(id_col).alias(fresh("hash", names))).mapInArrow(pick, docs.schema)


def picked(spark: SparkSession, texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts (id, text) of some ids, and of few others, one row for each id."""
    some = Sieve(spark, ids).rows(texts.where("id is not null").select("id", "text"), "id", inside=True)
    return some.groupBy("id").agg(F.first("text").alias("text"))


def dealt(spark: SparkSession, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (id, leader) with a salt, LEADER_CHUNK of a leader to each, and the (leader, salt) there are. Only leaders of more
    pairs than that are looked up: a table small enough to send to each task, so that no task gets all pairs of a leader."""
    hot = settle(spark, pairs.groupBy("leader").agg(F.ceil(F.count("*") / LEADER_CHUNK).cast("bigint").alias("chunks")).where("chunks > 1"), "hot-leaders", few=True)
    chunks = F.coalesce("chunks", F.lit(1).cast("bigint"))
    salted = pairs.join(hot, "leader", "left").select("id", "leader", F.pmod(F.xxhash64("id"), chunks).alias("salt"))
    leaders = pairs.select("leader").distinct().join(hot, "leader", "left").select("leader", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)).alias("salt"))
    return salted, leaders


def verified(spark: SparkSession, pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Those of (id, leader) whose multisets of shingles overlap enough. The text of a leader is sent once for each
    LEADER_CHUNK of its pairs, the text of a member once for each pair; a task holds one leader's shingles."""
    salted, leaders = dealt(spark, pairs)
    docs = docs.hint("merge")  # texts move in the same way at every size
    members = salted.select("leader", "salt", F.lit(1).alias("member"), "id").join(docs, "id")
    leaders = leaders.select("leader", "salt", F.lit(0).alias("member"), F.col("leader").alias("id")).join(docs, "id")
    rows = leaders.unionByName(members).select("leader", "salt", "member", "id", "text").repartition("leader", "salt").sortWithinPartitions("leader", "salt", "member")
    kind = pairs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, bag = None, None, None
        for batch in batches:
            for part, texts in passes(batch, "text"):
                text, value, count, _ = shingles(texts)
                at = np.searchsorted(text, np.arange(len(texts) + 1))
                ids, leads, salts, member = (part.column(i).to_pylist() for i in (3, 0, 1, 2))
                kept = []
                for i in range(len(texts)):
                    v, c = value[at[i] : at[i + 1]], count[at[i] : at[i + 1]]
                    if not member[i]:
                        if now != (leads[i], salts[i]):
                            now, head, bag = (leads[i], salts[i]), v, c
                        continue
                    if now != (leads[i], salts[i]) or not len(v) or not len(head):
                        continue
                    if overlap_enough((head, bag), (v, c), threshold):
                        kept.append((ids[i], leads[i]))
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in kept], part.column(0).type) for j in (0, 1)], ["id", "leader"])

    return rows.mapInArrow(run, f"id {kind}, leader {kind}")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, root): root is the smallest id that links lead to. Alternating large and small stars; each round is two
    aggregations and two joins on narrow rows, written to the shared folder; the number of rounds grows with the
    logarithm of the longest chain."""
    edges = links.select(F.greatest("id", "leader").alias("u"), F.least("id", "leader").alias("v")).where("u <> v").distinct()
    edges, before = settle(spark, edges, "edges", few=True), None
    stored = edges
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        edges = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("low"))
        edges = edges.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        old, edges = stored, settle(spark, edges, "edges", few=True)
        stored = edges
        forget(spark, old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now


def late_links(spark: SparkSession, members: DataFrame, roots: DataFrame, wide: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (id, leader) that the stars missed: in each bucket with more than one component, members outside the
    largest one against each other and against it. Members are dealt by hash into blocks of about CELL, and each pair
    of blocks that holds such members is a cell of its own; a bucket whose members lie in one component makes none."""
    placed = members.join(roots, "id", "left").select("band", "bucket", "id", F.coalesce("root", "id").alias("root"))
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    blocks = lambda n: F.ceil(n / CELL).cast("bigint")
    shape = main.select("bucket", "main", blocks(F.col("n") - F.col("most")).alias("minor"), blocks(F.col("most")).alias("major"))
    shape = settle(spark, shape, "shapes", few=True)  # of its true size: small, it goes to each task, and no task gets a whole bucket
    split = placed.join(shape, "bucket").withColumn("outside", F.col("root") != F.col("main"))
    block = F.pmod(F.xxhash64("id"), F.when(F.col("outside"), F.col("minor")).otherwise(F.col("major")))
    count = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    cells = F.when(
        F.col("outside"),
        F.concat(F.transform(count(F.col("minor")), lambda j: F.struct(F.least(j, F.col("block")).alias("a"), F.greatest(j, F.col("block")).alias("b"))), F.transform(count(F.col("major")), lambda j: F.struct(F.col("block").alias("a"), (j + F.col("minor")).alias("b")))),
    ).otherwise(F.transform(count(F.col("minor")), lambda j: F.struct(j.alias("a"), (F.col("block") + F.col("minor")).alias("b"))))
    rows = split.withColumn("block", block).select("band", "bucket", "id", "root", "outside", F.explode(cells).alias("cell")).select("band", "bucket", "cell.a", "cell.b", "id", "root", "outside")
    rows = rows.join(wide, "id").join(texts.hint("merge"), "id").repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    kind, limit = members.schema["id"].dataType.simpleString(), far_bound(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, band, cell, form = None, 0, [], None

        def compared() -> pa.RecordBatch:
            kept = joined(cell, band, limit, threshold)
            return pa.RecordBatch.from_arrays([pa.array([k[j] for k in kept], form) for j in (0, 1)], ["id", "leader"])

        for batch in batches:
            for part, some in passes(batch, "text"):
                text, value, count, _ = shingles(some)
                at = np.searchsorted(text, np.arange(len(some) + 1))
                names = part.schema.names
                column = {c: part.column(names.index(c)).to_pylist() for c in ("band", "bucket", "a", "b", "id", "root", "outside")}
                words = np.stack([part.column(names.index(f"p{i}")).to_numpy() for i in range(PRINTS)], axis=1).view(np.uint64)
                bands = part.column(names.index("bands")).flatten().to_numpy().reshape(-1, BANDS)
                form = part.schema.field("id").type
                for i in range(len(some)):
                    key = (column["bucket"][i], column["a"][i], column["b"][i])
                    if key != now:
                        if len(cell) > 1:
                            yield compared()
                        now, band, cell = key, column["band"][i], []
                    cell.append((column["id"][i], column["root"][i], column["outside"][i], words[i], (value[at[i] : at[i + 1]], count[at[i] : at[i + 1]]), bands[i]))
        if len(cell) > 1:
            yield compared()

    return rows.mapInArrow(run, f"id {kind}, leader {kind}").distinct()


def joined(cell: list[tuple], band: int, limit: int, threshold: float) -> list[tuple]:
    """Links that join the components of a cell: members outside the main one against all, nearest prints first, without
    pairs that are joined already, or whose first common band is another (its bucket compares them)."""
    up: dict = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    all_prints, all_bands = np.stack([c[3] for c in cell]), np.stack([c[5] for c in cell])
    out = []
    for i, (id_, root, outside, own, bag, _) in enumerate(cell):
        if not outside:
            continue
        far = np.bitwise_count(all_prints ^ own).sum(axis=1)
        near = np.flatnonzero(far <= limit)
        if not len(near):
            continue
        common = (all_bands[near] == all_bands[i]).argmax(axis=1)
        near = near[common == band]
        for j in near[np.argsort(far[near], kind="stable")].tolist():
            other = cell[j]
            if (other[2] and j <= i) or find(root) == find(other[1]):
                continue
            if overlap_enough(bag, other[4], threshold):
                out.append((id_, other[0]))
                a, b = sorted((find(root), find(other[1])))
                up[b] = a
    return out


def groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, class_id (the smallest id of the document's group; its own where it has no
    duplicate), n_shingles.

    Texts without words (null, empty, white space) have no shingles and equal nothing. Rows that share an id are one
    document, and of exact copies the smallest id stands for all. A null id has a null class. Very long texts take time and memory
    in proportion. Other columns are not read, so their names cannot clash. An empty table gives an empty table."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints_ = settle(spark, signed(narrow, "id", "text"), "prints")
    bound = [f"p{i}" for i in range(PRINTS)]
    same = prints_.where("weight > 0 and id is not null").groupBy("d1", "d2", "weight").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("bands", *bound)))
    same = settle(spark, same, "classes", few=True)

    spread = same.select(F.col("rep").alias("id"), F.posexplode("bands").alias("band", "bucket"))
    busy = settle(spark, spread.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("leader")).where("n > 1"), "buckets", few=True)
    members = settle(spark, spread.join(busy, "bucket").select("band", "bucket", "id", "leader"), "members", few=True)
    wide = same.select(F.col("rep").alias("id"), *bound)

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs whose prints are not too far for the threshold."""
        salted, leaders = dealt(spark, pairs)
        left, right = wide, wide.select(F.col("id").alias("leader"), *(F.col(c).alias(f"q{c}") for c in bound)).join(leaders, "leader")
        far = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"q{c}"))) for c in bound[1:]), F.bit_count(F.col(bound[0]).bitwiseXOR(F.col(f"q{bound[0]}"))))
        return salted.join(left, "id").join(right, ["leader", "salt"]).where(far <= far_bound(threshold)).select("id", "leader")

    pairs = settle(spark, members.where("id <> leader").select("id", "leader").distinct(), "pairs", few=True)
    stars = settle(spark, near(pairs), "stars", few=True)
    texts = settle(spark, picked(spark, narrow, members.select("id").distinct()), "texts", few=True)
    links = settle(spark, verified(spark, stars, texts, threshold), "links")
    roots = components(spark, links)
    late = settle(spark, late_links(spark, members.where("id <> leader").select("band", "bucket", "id"), roots, same.select(F.col("rep").alias("id"), "bands", *bound), texts, threshold), "late", few=True)
    if not late.isEmpty():
        roots = components(spark, roots.select("id", F.col("root").alias("leader")).unionByName(late))
    for table in (busy, members, pairs, stars, texts, links, late):  # nothing reads them any more
        forget(spark, table)

    classes = same.select("d1", "d2", "weight", F.col("rep")).join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").select("d1", "d2", "weight", F.coalesce("root", "rep").alias("class_id"))
    out = prints_.select("id", "d1", "d2", "weight").join(classes, ["d1", "d2", "weight"], "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"), F.col("weight").alias("n_shingles"))


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents with one row left of each group: the one with the smallest doc_id; of rows that repeat it, any one. Rows with a
    null doc_id, and one row of each id without words, stay. All columns of docs are kept, whatever their names. Very long texts take time
    and memory in proportion; an empty table gives an empty table."""
    found = settle(spark, groups(spark, docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("class_id").alias("class_id")), "groups", few=True)
    gone = found.where("doc_id <> class_id").select("doc_id")
    gone = settle(spark, gone, "gone", few=True)
    sieve = Sieve(spark, gone)  # most documents need no join
    kept = sieve.rows(docs, "doc_id", inside=False).unionByName(sieve.rows(docs, "doc_id", inside=True).join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns))
    repeated = settle(spark, found.where("doc_id = class_id and n > 1").select("doc_id"), "repeated", few=True)
    if repeated.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(docs.columns)
