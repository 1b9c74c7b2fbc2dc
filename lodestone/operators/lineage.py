"""The catalogue's pair of tables, index and graph, and the questions that are asked of them.

objects (run_id, page_id, id, kind, schema, name, signature, key, scope), operations (run_id, page_id, id, order, kind, reads,
writes, calls, dynamic): facts of published runs. Nothing here is collected; each question is a filter, a join or a closure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import percent_encoded
from lodestone.operators import graph

# Kinds that share one name space.
RELATIONS = ("table", "view", "materialized_view", "ctas")
REASONS = ("source_changed", "source_missing", "project_root_unavailable", "source_unreadable")


def nodes(objects: DataFrame) -> DataFrame:
    """Managed objects, one row per key; repeated keys are what repeated() reports."""
    return objects.where("scope is null and key is not null and page_id is not null").dropDuplicates(["key"]).select("key", "page_id", F.col("id").alias("object_id"), "kind", "schema", "name", "signature", "run_id")


def repeated(rows: DataFrame, *columns: str) -> DataFrame:
    """(columns, n) that stand more than once."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def _class(kind):
    """Kinds that may answer for one another: all relations; any other kind only itself."""
    return F.when(kind.isin(*RELATIONS), "relation").otherwise(kind)


def resolved(uses: DataFrame, known: DataFrame) -> DataFrame:
    """uses (kind, schema, name, signature, key, scope, ...) with (to, resolution, candidates). In this order: an object of its own
    scope; a managed key; for a relation, the only relation of that schema and name; undocumented where it has a key;
    unresolved, with all of that schema and name that it may mean: relations for a relation, all overloads for a routine whose
    signature is not known. An unknown schema is a schema of its own. known: nodes()."""
    exact = known.select("key", F.lit(True).alias("_exact"))
    alike = known.groupBy(_class(F.col("kind")).alias("_c"), F.col("schema").alias("_s"), F.col("name").alias("_n")).agg(F.sort_array(F.collect_set("key")).alias("_keys"))
    same = (_class(F.col("kind")) == F.col("_c")) & F.col("schema").eqNullSafe(F.col("_s")) & (F.col("name") == F.col("_n"))
    rows = uses.join(exact, "key", "left").join(alike, same, "left")
    one = F.col("kind").isin(*RELATIONS) & (F.coalesce(F.size("_keys"), F.lit(0)) == 1)
    how = F.when(F.col("scope").isNotNull(), "scoped").when(F.col("_exact") | one, "published").when(F.col("key").isNotNull(), "undocumented").otherwise("unresolved")
    label = F.to_json(F.array("kind", "schema", "name", "signature"))
    to = F.when(F.col("scope").isNotNull() | F.coalesce("_exact", F.lit(False)), F.col("key")).when(one, F.element_at("_keys", 1)).otherwise(F.coalesce("key", F.concat(F.lit("@external:"), percent_encoded(label))))
    candidates = F.when(how == "unresolved", F.coalesce("_keys", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("resolution", how).withColumn("to", to).withColumn("candidates", candidates).drop("_exact", "_c", "_s", "_n", "_keys")


def edges(objects: DataFrame, operations: DataFrame) -> DataFrame:
    """(from, to, kind, resolution, candidates, page_id, run_id, operation_id, ordinal) from each page's own object to what its
    operations read, write and call. Sorted order is kept in ordinal; dangling ids are what orphans() reports."""
    listed = [operations.select("run_id", "page_id", F.col("id").alias("operation_id"), F.lit(k).alias("use"), F.explode(c).alias("object_id")) for k, c in (("read", "reads"), ("write", "writes"), ("call", "calls"))]
    uses = listed[0].unionByName(listed[1]).unionByName(listed[2]).dropDuplicates()
    target = objects.select("run_id", F.col("id").alias("object_id"), "kind", "key", "schema", "name", "signature", "scope")
    found = resolved(uses.join(target, ["run_id", "object_id"]), nodes(objects))
    owner = nodes(objects).select("run_id", "page_id", F.col("key").alias("from"))
    rows = found.join(owner, ["run_id", "page_id"]).select("from", "to", F.col("use").alias("kind"), "resolution", "candidates", "page_id", "run_id", "operation_id")
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("from").orderBy("to", "kind", "operation_id")).cast("bigint"))


def orphans(objects: DataFrame, operations: DataFrame) -> DataFrame:
    """(run_id, operation_id, object_id) that no object of the run answers."""
    ids = operations.select("run_id", F.col("id").alias("operation_id"), F.explode(F.array_distinct(F.concat("reads", "writes", "calls"))).alias("object_id"))
    return ids.join(objects.select("run_id", F.col("id").alias("object_id")), ["run_id", "object_id"], "left_anti").select("run_id", "operation_id", "object_id")


def gaps(operations: DataFrame) -> DataFrame:
    """Operations whose names are only known as they run."""
    return operations.where("dynamic").select("page_id", "run_id", F.col("id").alias("operation_id"))


def index(pages: DataFrame, files: DataFrame) -> DataFrame:
    """pages (page_id, status, page_sha256, ...) with page_state against files (page_id, sha256 now): current, changed, missing."""
    now = files.select("page_id", F.col("sha256").alias("_now"))
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("page_sha256").isNull() | (F.col("_now") == F.col("page_sha256")), "current").otherwise("changed")
    return pages.join(now, "page_id", "left").withColumn("page_state", state).drop("_now")


#: How pages that nothing manages name their key.
LEGACY_KEY = r"(?iu)(?:canonical_key|canonical key|канонический ключ|ключ)\s*[:|]\**\s*`?([^`\n|]+)"


def legacy(files: DataFrame, pages: DataFrame) -> DataFrame:
    """files (page_id, text) that are no managed page (pages: page_id) and no index: (page_id, status, key) as legacy pages, with the key that
    their text names first (null where it names none). Null texts name none; paths with a hidden folder are no pages."""
    own = files.where(~F.rlike("page_id", F.lit(r"(^|/)\.")) & (F.col("page_id") != "index.md")).join(pages.select("page_id").distinct(), "page_id", "left_anti")
    key = F.nullif(F.trim(F.regexp_extract(F.coalesce("text", F.lit("")), LEGACY_KEY, 1)), F.lit(""))
    return own.select("page_id", F.lit("legacy").alias("status"), key.alias("key"))


def outdated(inputs: DataFrame, files: DataFrame) -> DataFrame:
    """inputs (page_id, root, path, sha256) against files (root, path, sha256, readable): one row per input that drifted."""
    roots = files.select("root").distinct().withColumn("_root", F.lit(True))
    now = files.select("root", "path", F.col("sha256").alias("_now"), "readable")
    rows = inputs.join(now, ["root", "path"], "left").join(roots, "root", "left")
    reason = F.when(F.col("_root").isNull(), REASONS[2]).when(F.col("readable").isNull(), REASONS[1]).when(~F.col("readable"), REASONS[3]).when(~F.col("_now").eqNullSafe(F.col("sha256")), REASONS[0])
    return rows.withColumn("reason", reason).where("reason is not null").select("page_id", "root", "path", "reason")


def listed(nodes_: DataFrame, edges_: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes by key, edges by their ends, kind and operation, pages by id: the orders in which documents show them. Range-partitioned
    sorts: no task gets more than its share."""
    return nodes_.orderBy("key"), edges_.orderBy("from", "to", "kind", "operation_id"), pages.orderBy("page_id")


def known(edges_: DataFrame, nodes_: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (key) with known: a node, an end of an edge or a candidate."""
    names = nodes_.select("key").unionByName(edges_.select(F.col("from").alias("key"))).unionByName(edges_.select(F.col("to").alias("key"))).unionByName(edges_.select(F.explode("candidates").alias("key")))
    return keys.join(names.distinct().withColumn("_k", F.lit(True)), "key", "left").withColumn("known", F.coalesce("_k", F.lit(False))).drop("_k")


def limitations(pages: DataFrame, edges_: DataFrame, gaps_: DataFrame) -> DataFrame:
    """(limitation, n): what an answer does not know."""
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("limitation"), "n")
    return count(pages.where("status = 'legacy'"), "legacy_pages").unionByName(count(edges_.where("resolution = 'unresolved'"), "unresolved_edges")).unionByName(count(gaps_, "dynamic_gaps"))


def of_page(spark: SparkSession, pages: DataFrame, nodes_: DataFrame, edges_: DataFrame, page_id: str, max_depth: int = 32) -> dict[str, DataFrame]:
    """Everything about one page: its keys, what they use, who uses them, and whom a change affects. A legacy page has no keys."""
    page = pages.where(F.col("page_id") == page_id).withColumn("lineage_verified", F.col("status") == "managed")
    keys = nodes_.where(F.col("page_id") == page_id).select("key").distinct()
    mine = keys.withColumnRenamed("key", "node")
    return {
        "page": page,
        "keys": keys,
        "dependencies": graph.dependencies(edges_).join(mine, "node", "left_semi"),
        "consumers": graph.consumers(edges_).join(mine, "node", "left_semi"),
        "affected": graph.closure(spark, edges_.select("from", "to", "kind", "candidates", "ordinal"), keys.select(F.col("key").alias("seed")), "downstream", max_depth),
    }
