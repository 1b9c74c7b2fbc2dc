"""Names of pages that never change: keys against a registry of the pages that stand already, and a map of old keys to new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.storage import settled
from lodestone.functions.text import slug

#: Digits of a hash in a name: at least, by default, and at most.
FIRST, MOST = 12, 64


def normal_path(path: Column) -> Column:
    """A page's path with / between its parts, none of them empty or a dot; null if it is no relative Markdown path inside the folder."""
    plain = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/(\\./|/)+", "/"), "^\\./+", "")
    bad = F.rlike(path, F.lit(r"^[/\\]|[:\x00-\x1f]")) | F.rlike(plain, F.lit(r"(^|/)\.\.(/|$)")) | ~F.rlike(plain, F.lit(r"[^/.][^/]*\.md$"))
    return F.when(~bad, plain)


def problems(pages: DataFrame, legacy: DataFrame) -> DataFrame:
    """pages (path, key) and legacy (old, new) -> (subject, problem): empty_key, bad_path, repeated_path (also if spelt otherwise),
    empty_legacy, ambiguous_legacy (an old key that stands for several) and ambiguous_key (several pages whose key is, or stands for, one)."""
    empty = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    own = pages.select("path", "key", normal_path(F.col("path")).alias("at"))
    rows = own.select(F.col("path").alias("subject"), F.when(empty("key"), "empty_key").when(empty("path") | F.col("at").isNull(), "bad_path").alias("problem"))
    many = own.where("at is not null").groupBy("at").agg(F.count("*").alias("n")).where("n > 1").select(F.col("at").alias("subject"), F.lit("repeated_path").alias("problem"))
    old = legacy.select(F.col("old").alias("subject"), F.when(empty("old") | empty("new"), "empty_legacy").alias("problem"))
    several = legacy.groupBy("old").agg(F.count_distinct("new").alias("n")).where("n > 1").select(F.col("old").alias("subject"), F.lit("ambiguous_legacy").alias("problem"))
    twice = _current(pages, legacy).groupBy("_hash").agg(F.count_distinct("path").alias("n")).where("n > 1")
    spelt = pages.select("key").unionByName(legacy.select(F.col("new").alias("key"))).withColumn("_key", F.sha2("key", 256))
    twice = spelt.join(twice, F.col("_key").eqNullSafe(F.col("_hash")), "left_semi").select(F.col("key").alias("subject"), F.lit("ambiguous_key").alias("problem")).distinct()
    return rows.where("problem is not null").unionByName(many).unionByName(old.where("problem is not null")).unionByName(several).unionByName(twice)


def _current(pages: DataFrame, legacy: DataFrame) -> DataFrame:
    """(_hash, path): pages by the hash of the key that theirs stands for now. Keys may be of any length, which no planner knows, so only
    their hashes are joined."""
    now = legacy.select(F.sha2("old", 256).alias("_hash"), F.sha2("new", 256).alias("_new")).distinct()
    return pages.select(F.sha2("key", 256).alias("_hash"), normal_path(F.col("path")).alias("path")).where("path is not null").join(now, "_hash", "left").select(F.coalesce("_new", "_hash").alias("_hash"), "path")


def resolved(keys: DataFrame, pages: DataFrame, legacy: DataFrame, column: str = "key", first: int = FIRST) -> DataFrame:
    """keys with page_name and `known`. A key that has a page in the registry, under itself or under an old key that stands for it, keeps that
    path, whatever it is called. Any other gets its slug and the shortest start of its hash, of `first` digits at least, that is no
    name of the registry and that no other new key of that slug shares: adding the names to the registry (extended()) lets the next
    batch go on, and no name ever changes. Several pages for one key: known is true and page_name null (see problems()).

    Of the sorted hashes of a slug only neighbours are compared; names that are taken are found by an equi-join at the lengths that
    the registry has. Repeated keys have one name; null keys have none. Keys are hashed once, into a table, and meet by their hashes: a
    key itself moves only where the caller asks for that column."""
    mine = _current(pages, legacy).groupBy("_hash").agg(F.count_distinct("path").alias("_n"), F.min("path").alias("_path"))
    hashed = keys.where(F.col(column).isNotNull()).select(slug(F.col(column)).alias("_slug"), F.sha2(column, 256).alias("_hash")).distinct()
    asked = settled(keys.sparkSession, hashed, "keys").join(mine, "_hash", "left")
    new = asked.where("_n is null").select("_slug", "_hash")
    beside = Window.partitionBy("_slug").orderBy("_hash")
    new = new.withColumns({"_before": F.lag("_hash").over(beside), "_after": F.lead("_hash").over(beside)})
    # of sorted hashes the neighbours share the longest start
    shared = lambda c: F.coalesce(F.length(F.regexp_extract(F.concat_ws(" ", "_hash", c), r"^([0-9a-f]*)[0-9a-f]* \1", 1)), F.lit(0))
    new = new.withColumn("_least", F.greatest(F.lit(first), shared("_before") + 1, shared("_after") + 1)).drop("_before", "_after")
    named = r"^(.*)--([0-9a-f]{1,64})\.md$"
    taken = pages.select(normal_path(F.col("path")).alias("path")).where(F.rlike("path", F.lit(named))).select(F.regexp_extract("path", named, 1).alias("_slug"), F.regexp_extract("path", named, 2).alias("_start")).distinct()
    lengths = taken.agg(F.array_sort(F.collect_set(F.length("_start"))).alias("_lengths"))  # one row of MOST numbers at most
    tries = new.join(lengths).select("_slug", "_hash", F.explode("_lengths").alias("_n")).withColumn("_start", F.left("_hash", F.col("_n")))
    hits = tries.join(taken, ["_slug", "_start"], "left_semi").groupBy("_hash").agg(F.collect_set("_n").alias("_taken"))
    new = new.join(hits, "_hash", "left")
    free = F.array_min(F.filter(F.sequence(F.col("_least"), F.lit(MOST)), lambda n: ~F.coalesce(F.array_contains("_taken", n), F.lit(False))))
    names = new.select("_hash", F.concat("_slug", F.lit("--"), F.left("_hash", free), F.lit(".md")).alias("page_name"), F.lit(False).alias("known"))
    old = asked.where("_n is not null").select("_hash", F.when(F.col("_n") == 1, F.col("_path")).alias("page_name"), F.lit(True).alias("known"))
    rows = keys.withColumn("_hash", F.sha2(column, 256)).join(names.unionByName(old), "_hash", "left")
    return rows.select(column, *(c for c in keys.columns if c != column), "page_name", "known")


def extended(pages: DataFrame, named: DataFrame, column: str = "key") -> DataFrame:
    """The registry (path, key) with the new pages of resolved()."""
    return pages.select("path", "key").unionByName(named.where("not known").select(F.col("page_name").alias("path"), F.col(column).alias("key")).distinct())
