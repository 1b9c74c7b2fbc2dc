"""An audit of how far the sources of a language differ in their words: exact whole-number distances between all sources, and for
each source the words that stand out most. Counts meet in dense numpy tiles of int64, one for each block of terms and pair of
group tiles; a tile broadcasts all its pairs, partial matrices are summed, and the best terms of the blocks are merged.

Scale: one scan of the texts, counted in the task; one shuffle of distinct (lang, source, term) rows by (lang, term), which
serves the counts, the number of documents and the choice of terms. A tile holds TERMS_A_BLOCK terms (about) and 2 * GROUPS_A_TILE groups at most,
whatever the sizes of vocabularies and languages. The only quadratic part is the answer itself, a row for each pair of sources."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import byte_words, settle

#: Bytes of terms. Letters of ASCII and all of a character beyond it; only A to Z are lower-cased.
TERM_BYTES = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
MIN_DOCS = 30
UNIT = 1_000_000_000
PRIOR = 5
TOP = 50
TERMS_A_BLOCK = 512
GROUPS_A_TILE = 256
#: Distinct entries that a task counts before it hands them on.
HELD = 200_000
#: Occurrences in a group up to which shares are exact in 64 bits.
MAX_TOTAL = (1 << 63) // 1000


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term): partial counts, several rows for a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, seen) in held.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([seen[t] for t in terms], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), strict=True):
                n, seen = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                own: set[bytes] = set()
                for words in byte_words(text.as_py(), TERM_BYTES):
                    n.update(words)
                    own.update(words)
                seen.update(own)
                size += len(n)
                if size > HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    whole = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return whole.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n, all_n (occurrences in the language), head (true in one row of each term of a language)."""
    term = Window.partitionBy("lang", "term")
    summed = counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = summed.withColumns({"all_docs": F.sum("docs").over(term), "all_n": F.sum("n").over(term), "head": F.row_number().over(term.orderBy("source")) == 1})
    return rows.where(F.col("all_docs") >= min_docs).select("lang", "source", "term", "n", "all_n", "head")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * count / total), exact: a long division by three digits of a thousand. count <= total <= MAX_TOTAL."""
    whole, rest = count // total, count % total
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // total, rest % total
    return 1 + whole


def tile(table: pa.Table) -> pa.Table:
    """One tile: rows of a block of terms and of one or two tiles of groups. Rows without a term name the groups: all of them,
    with their totals. Out: (g, h, value, terms) for g < h, the sum of differences over the terms that are here, and how many those are (a term
    of other tiles only is not); and (g, term, value) of the terms that stand out most."""
    lang, a, b = (table.column(c)[0].as_py() for c in ("lang", "a", "b"))
    term = table.column("term").combine_chunks()
    named = term.is_valid().to_numpy(zero_copy_only=False)
    g, n, all_n, total = (table.column(c).to_numpy() for c in ("g", "n", "all_n", "total"))
    groups, place = np.unique(g[~named], return_index=True)
    totals = total[~named][place]
    all_total = table.column("all_total")[0].as_py()
    if max(totals.max(), all_total) > MAX_TOTAL:
        raise ValueError(f"a group holds more than {MAX_TOTAL} occurrences and terms")
    terms = term.filter(pa.array(named)).dictionary_encode()
    words = terms.dictionary.cast(pa.binary()).to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)  # by UTF-8
    column = np.empty(len(words), np.int64)
    column[order] = np.arange(len(words))
    at = column[terms.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
    count = np.zeros((len(groups), len(words)), np.int64)
    count[np.searchsorted(groups, g[named]), at] = n[named]
    in_lang = np.zeros(len(words), np.int64)
    in_lang[at] = all_n[named]
    p = shares(count + PRIOR, totals[:, None]) if words else count
    first = groups // GROUPS_A_TILE == a
    rows, others = np.flatnonzero(first), np.flatnonzero(groups // GROUPS_A_TILE == b)
    out: list[tuple] = []
    step = max(1, (1 << 20) // max(1, len(others) * len(words)))  # pairs that are broadcast at once
    for i in range(0, len(rows), step):
        mine = rows[i : i + step]
        apart = np.abs(p[mine][:, None, :] - p[others][None, :, :]).sum(2)
        for j, k in zip(*np.nonzero(groups[mine][:, None] < groups[others][None, :]), strict=True):
            out.append((lang, int(groups[mine[j]]), int(groups[others[k]]), None, int(apart[j, k]), len(words)))
    if a == b and words:
        over = p - shares(in_lang + PRIOR, np.int64(all_total))
        for i in rows:
            able = np.flatnonzero((count[i] > 0) & (over[i] > 0))
            best = able[np.argsort(-over[i][able], kind="stable")[:TOP]]  # ties: by UTF-8
            out += [(lang, int(groups[i]), None, words[order[k]].decode(), int(over[i][k]), 0) for k in best]
    kinds = {"lang": pa.string(), "g": pa.int32(), "h": pa.int32(), "term": pa.string(), "value": pa.int64(), "terms": pa.int64()}
    return pa.table(dict(zip(kinds, zip(*out, strict=True) if out else ([],) * len(kinds), strict=True)), pa.schema(kinds.items()))


def audited(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: each other source of the language and the sum, over the terms in at least
    min_docs of its documents, of the differences of shares, farthest first. Part `term`: the TOP terms whose share most exceeds that in
    the language.

    Null texts, languages and sources count as empty ones; a group without terms is there with the shares of counts of 0, and in a
    language without kept terms all values are 0. Repeated rows count each; ties go by the item's UTF-8. Very long texts are counted in slices.
    Other columns are not read; an empty table gives an empty one."""
    kept = settle(spark, kept_terms(docs, min_docs), "kept")
    langs = kept.groupBy("lang").agg(F.sum(F.col("head").cast("long")).alias("size"), F.sum("n").alias("all_n"))
    named = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    some = named.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    groups = some.select(
        "lang", "source",
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("g"),
        (F.floor((F.count("*").over(Window.partitionBy("lang")) - 1) / GROUPS_A_TILE)).cast("int").alias("last_tile"),
        "size", F.greatest(F.lit(1), F.ceil(F.col("size") / TERMS_A_BLOCK)).cast("int").alias("blocks"),
        (F.col("n") + PRIOR * F.col("size")).alias("total"), (F.col("all_n") + PRIOR * F.col("size")).alias("all_total"),
    )
    groups = settle(spark, groups, "groups")  # a row for each source of a language: small beside their pairs, which are the result
    headings = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long"), "all_n": F.lit(0).cast("long")})
    cells = kept.join(groups, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int"))
    fields = ["lang", "block", "g", "term", "n", "all_n", "total", "all_total", "last_tile"]
    own = F.floor(F.col("g") / GROUPS_A_TILE).cast("int")
    rows = cells.select(fields).unionByName(headings.select(fields)).withColumn("other", F.explode(F.sequence(F.lit(0), "last_tile"))).withColumns({"a": F.least(own, "other"), "b": F.greatest(own, "other")})
    tiles = rows.drop("other", "last_tile").groupBy("lang", "block", "a", "b").applyInArrow(tile, "lang string, g int, h int, term string, value long, terms long")
    tiles = settle(spark, tiles, "tiles")
    name = groups.select("lang", "g", "source", "size", F.expr(f"1 + {PRIOR * UNIT} div nullif(total, 0)").alias("unseen"))
    sums = tiles.where("h is not null").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    both = sums.select("lang", F.explode(F.array(F.struct("g", "h"), F.struct(F.col("h").alias("g"), F.col("g").alias("h")))).alias("x"), "value", "terms").select("lang", "x.*", "value", "terms")
    named_both = both.join(name, ["lang", "g"]).join(name.select("lang", F.col("g").alias("h"), F.col("source").alias("item"), F.col("unseen").alias("its")), ["lang", "h"])
    pairs = named_both.withColumn("value", F.col("value") + F.coalesce((F.col("size") - F.col("terms")) * F.abs(F.col("unseen") - F.col("its")), F.lit(0)))
    terms = tiles.where("term is not null").drop("terms").join(name, ["lang", "g"]).withColumnRenamed("term", "item")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    best = terms.withColumn("part", F.lit("term")).withColumn("rank", rank).where(F.col("rank") <= TOP)
    return pairs.withColumn("part", F.lit("pair")).withColumn("rank", rank).select(columns).unionByName(best.select(columns))


#: The same rows in DuckDB.
ORACLE_SQL = rf"""
with d as (select row_number() over () as row, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
v as (select lang, term, count(*) as c from w group by lang, term having count(distinct row) >= {MIN_DOCS}),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as c from w join v using (lang, term) group by all),
gn as (select g.lang, g.source, coalesce(sum(c.c), 0)::bigint as n from g left join c using (lang, source) group by all),
ln as (select lang, count(*) as size, sum(c)::bigint as n from v group by lang),
p as (select gn.lang, gn.source, v.term, coalesce(c.c, 0) as c, 1 + ({UNIT} * (coalesce(c.c, 0) + {PRIOR})) // (gn.n + {PRIOR} * ln.size) as p,
  1 + ({UNIT} * (v.c + {PRIOR})) // (ln.n + {PRIOR} * ln.size) as q
  from gn join ln using (lang) join v using (lang) left join c on c.lang = gn.lang and c.source = gn.source and c.term = v.term),
pair as (select a.lang, a.source, b.source as item, coalesce(s.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term group by all) s
  on s.lang = a.lang and s.source = a.source and s.item = b.source),
term as (select lang, source, term as item, (p - q)::bigint as value from p where c > 0 and p > q),
ranked as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pair
  union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from term)
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= {TOP}"""
