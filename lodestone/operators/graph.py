"""Lineage graphs as tables: nodes (key, ...), edges (from, to, kind, candidates, ordinal)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.storage import settled


#: Levels after which the states seen so far become one table again.
COMPACT = 8


def hops(edges: DataFrame, direction: str) -> DataFrame:
    """(at, to, possible, relation, ordinal): the steps that a walk may take, each once. Downstream: against read, write and
    call edges to the one who uses the node; through candidate lists, as possible; and from a writer to what it writes."""
    if direction == "upstream":
        return edges.select(F.col("from").alias("at"), F.col("to"), F.lit(False).alias("possible"), F.col("kind").alias("relation"), "ordinal")
    users = edges.select(F.col("to").alias("at"), F.col("from").alias("to"), F.lit(False).alias("possible"), F.col("kind").alias("relation"), "ordinal")
    listed = edges.select(F.explode("candidates").alias("at"), "from", "to", "kind", "ordinal").where(~F.col("at").eqNullSafe(F.col("to")))
    listed = listed.select("at", F.col("from").alias("to"), F.lit(True).alias("possible"), F.col("kind").alias("relation"), "ordinal")
    written = edges.where("kind = 'write'").select(F.col("from").alias("at"), "to", F.lit(False).alias("possible"), F.col("kind").alias("relation"), "ordinal")
    return users.unionByName(listed).unionByName(written)


def closure(spark: SparkSession, edges: DataFrame, seeds: DataFrame, direction: str = "downstream", max_depth: int = 32) -> DataFrame:
    """(seed, node, possible, depth, via, relation, ordinal) for all seeds (one column, seed) at once.

    A state is a node with its sticky flag `possible`; the seed is never returned; of several first discoveries the one
    of the least rank (parent's place, then edge's order) gives via, relation and ordinal. Each level is one join of
    the frontier to the steps, one aggregation, one anti join against the states seen and one sort; levels end with the frontier
    or max_depth."""
    steps = hops(edges, direction).withColumnRenamed("possible", "maybe")
    frontier = seeds.select("seed", F.col("seed").alias("node"), F.lit(False).alias("possible"), F.lit(0).cast("bigint").alias("rank"))
    seen = frontier.select("seed", "node", "possible")
    found, depth = None, 0
    while depth < max_depth:
        depth += 1
        next_ = frontier.join(steps, frontier["node"] == steps["at"]).select("seed", F.col("to").alias("node"), (F.col("possible") | F.col("maybe")).alias("possible"), F.col("node").alias("via"), "relation", "ordinal", F.col("rank").alias("parent"))
        first = F.min_by(F.struct("via", "relation", "ordinal", "parent"), F.struct("parent", "ordinal", "via", "relation"))
        next_ = next_.where("node <> seed").groupBy("seed", "node", "possible").agg(first.alias("f")).select("seed", "node", "possible", "f.*")
        next_ = next_.join(seen, ["seed", "node", "possible"], "left_anti")
        # Ranks need only grow in this order: a sort over all seeds, dealt by range, numbers them without a task for each seed.
        next_ = next_.orderBy("seed", "parent", "ordinal", "node", "possible").withColumn("rank", F.monotonically_increasing_id()).withColumn("depth", F.lit(depth))
        next_ = settled(spark, next_, "graph")
        if next_.isEmpty():
            break
        found = next_ if found is None else found.unionByName(next_)
        seen = seen.unionByName(next_.select("seed", "node", "possible"))
        if depth % COMPACT == 0:
            seen = settled(spark, seen, "seen")
        frontier = next_.select("seed", "node", "possible", "rank")
    if found is None:
        found = seeds.select("seed", F.col("seed").alias("node"), F.lit(False).alias("possible"), F.lit("").alias("via"), F.lit("").alias("relation"), F.lit(0).cast("bigint").alias("ordinal"), F.lit(0).alias("depth")).limit(0)
    return found.select("seed", "node", "possible", "depth", "via", "relation", "ordinal")


def dependencies(edges: DataFrame) -> DataFrame:
    """Per node: sorted distinct reads, writes and calls."""
    of = lambda k: F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("to"))))
    return edges.groupBy(F.col("from").alias("node")).agg(of("read").alias("reads"), of("write").alias("writes"), of("call").alias("calls"))


def consumers(edges: DataFrame) -> DataFrame:
    """Per node: sorted distinct readers, writers and callers, and those that may use it."""
    of = lambda k: F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("from"))))
    sure = edges.groupBy(F.col("to").alias("node")).agg(of("read").alias("read_by"), of("write").alias("written_by"), of("call").alias("called_by"))
    maybe = edges.select("from", F.explode("candidates").alias("node")).groupBy("node").agg(F.sort_array(F.collect_set("from")).alias("possible_consumers"))
    return sure.join(maybe, "node", "full")


def required_facts(spark: SparkSession, facts: DataFrame, seeds: DataFrame) -> DataFrame:
    """Ids that foreign keys (id, ref) join to the seeds (id), in either direction: semi-naive rounds to the fixpoint."""
    both = facts.select("id", "ref").unionByName(facts.select(F.col("ref").alias("id"), F.col("id").alias("ref"))).distinct()
    seen = new = settled(spark, seeds.select("id").distinct(), "graph")
    while True:
        new = settled(spark, new.join(both, "id").select(F.col("ref").alias("id")).distinct().join(seen, "id", "left_anti"), "graph")
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
