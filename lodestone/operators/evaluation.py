"""The whole gate over the tables of many runs, and what it stands on: flags of an inventory, facts against SQL in both
directions, policies that hold together, and the reports and pages made of the results.

inventory (run_id, path, scope, construct, ordinal, start_line, reads, writes, calls, formulas, conditions, source); facts'
operations as in operators.gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import gate
from lodestone.operators.column_types import expression_tokens

# Constructs that give their run its kind, before what its items declare.
KINDS = (("VIEW", "view"), ("MATERIALIZED_VIEW", "materialized_view"), ("CTAS", "ctas"))
# Kinds that constructs declare.
DECLARED = {"FUNCTION": "function", "PROCEDURE": "procedure", "CREATE_TABLE": "table"}
# Names of the flags that a construct sets.
SET_BY = (("EXECUTE", "has_dynamic_sql"), ("TRIGGER", "has_triggers"), ("INDEX", "has_indexes"), ("GRANT", "has_access_rules"), ("REVOKE", "has_access_rules"))
BROKEN = ("broken_link", "broken_anchor", "broken_line")


def flags(inventory: DataFrame) -> DataFrame:
    """One row per run: what its inventory has, as policies use it: has_reads, has_writes, has_calls, has_formulas, has_conditions,
    has_date_boundary, has_dynamic_sql, has_unknowns, has_triggers, has_indexes, has_constraints, has_access_rules, returns_table,
    source_count (different relations that are read) and object_kind.

    The kind is that of a view, a materialised view or a table made by a query, in this order, wherever one stands; else what the first item that
    declares a kind declares (object_kind, or its construct); else function. Items are in the order of path, start_line and ordinal.
    Columns that an inventory may lack: object_kind, dynamic, constraints, returns_table, start_line, ordinal; null lists are empty."""
    have = set(inventory.columns)
    some = lambda c: F.coalesce(F.bool_or(F.size(c) > 0), F.lit(False))
    is_set = lambda c: F.coalesce(F.bool_or(c), F.lit(False)) if c in have else F.lit(False)
    declared = F.coalesce(*([F.col("object_kind")] if "object_kind" in have else []), reduce(lambda a, b: a.when(F.col("construct") == b[0], b[1]), list(DECLARED.items())[1:], F.when(F.col("construct") == "FUNCTION", "function")))
    place = F.struct("path", *(F.col(c) for c in ("start_line", "ordinal") if c in have))
    constructs = {name: [c for c, n in SET_BY if n == name] for _, name in SET_BY}
    rows = inventory.withColumn("_declared", declared).groupBy("run_id").agg(
        some("reads").alias("has_reads"), some("writes").alias("has_writes"), some("calls").alias("has_calls"), some("formulas").alias("has_formulas"), some("conditions").alias("has_conditions"),
        F.coalesce(F.bool_or(F.rlike(F.upper("source"), F.lit(r"\b(DATE|TIMESTAMP|INTERVAL)\b"))), F.lit(False)).alias("has_date_boundary"),
        *(F.coalesce(F.bool_or(F.col("construct").isin(names)), F.lit(False)).alias(flag) for flag, names in constructs.items()),
        is_set("dynamic").alias("has_unknowns"), (some("constraints") if "constraints" in have else F.lit(False)).alias("has_constraints"), is_set("returns_table").alias("returns_table"),
        F.collect_set("construct").alias("_kinds"), F.min_by("_declared", F.when(F.col("_declared").isNotNull(), place)).alias("_first"),
    )
    read = inventory.select("run_id", F.explode("reads").alias("r")).groupBy("run_id").agg(F.count_distinct("r").alias("source_count"))
    kind = reduce(lambda a, b: a.when(F.array_contains("_kinds", b[0]), b[1]), KINDS[1:], F.when(F.array_contains("_kinds", KINDS[0][0]), KINDS[0][1]))
    rows = rows.withColumn("object_kind", F.coalesce(kind, "_first", F.lit("function"))).drop("_kinds", "_first")
    return rows.join(read, "run_id", "left").withColumn("source_count", F.coalesce("source_count", F.lit(0)).cast("bigint"))


def prefixed(identifiers: DataFrame, prefixes: DataFrame) -> DataFrame:
    """identifiers (..., identifier) and prefixes (prefix, ...) -> rows of both for each prefix that starts an identifier, with its
    length `_n`. An identifier meets prefixes by an equi-join on its starts of the lengths that prefixes have, so the plan does not grow
    with their number. An empty prefix starts everything but null."""
    lengths = prefixes.where("prefix is not null").agg(F.collect_set(F.length("prefix")).alias("_lengths"))  # one row, as long as the longest prefix at most
    starts = identifiers.where("identifier is not null").join(lengths).withColumn("_n", F.explode("_lengths")).where(F.col("_n") <= F.length("identifier")).drop("_lengths")
    return starts.withColumn("prefix", F.left("identifier", F.col("_n"))).join(prefixes, "prefix")


def longest_prefix(identifiers: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(identifier, prefix): of the prefixes that start an identifier the longest; identifiers without one are left out."""
    return prefixed(identifiers.select("identifier").distinct(), prefixes.select("prefix").distinct()).groupBy("identifier").agg(F.max_by("prefix", "_n").alias("prefix"))


def active_profiles(identifiers: DataFrame, profiles: DataFrame) -> DataFrame:
    """identifiers (run_id, identifier) and profiles (profile, prefix) -> (run_id, profile) of the profiles of which a prefix starts any
    identifier of the run."""
    return prefixed(identifiers.select("run_id", "identifier").distinct(), profiles.select("prefix", "profile").distinct()).select("run_id", "profile").distinct()


def policy_problems(policy: Mapping) -> list[str]:
    """What a policy document says that cannot hold: rules without an id or twice, sources and categories that there are not, groups
    and sections that name no rule, codes that are both editorial and blocking. A policy is a small document."""
    rules, out = [r.get("rule_id") for r in policy.get("rules", [])], []
    out += [f"rule {i} has no id" for i, r in enumerate(rules) if not r]
    out += [f"rule {r} stands more than once" for r in sorted({r for r in rules if r and rules.count(r) > 1})]
    for r in policy.get("rules", []):
        if r.get("source", "section") not in ("section", "inventory", "profile", "gap"):
            out.append(f"rule {r.get('rule_id')} has the source {r['source']}")
        if r.get("category", "technical") not in ("technical", "editorial"):
            out.append(f"rule {r.get('rule_id')} has the category {r['category']}")
    for part in ("groups", "sections"):
        for name, some in policy.get(part, {}).items():
            out += [f"{part[:-1]} {name} names {r}, which is no rule" for r in some if r not in rules]
    both = set(policy.get("always_blocking", [])) & set(policy.get("editorial", []))
    return out + [f"code {c} is editorial and blocks" for c in sorted(both)]


def plan(items: DataFrame, rules: Sequence[Mapping], anchor: Sequence[str], gaps: DataFrame, profiles: DataFrame) -> DataFrame:
    """(run_id, id, rule_id, source, blocking, category): obligations of the policy, of the inventory's gaps (run_id, path, line,
    reason), which block, and of active profiles; of several with one id the first source counts."""
    own = gate.required(items, rules, anchor).withColumn("source_rank", F.lit(0))
    tail = [F.lit(True).alias("blocking"), F.lit("technical").alias("category")]
    gap = gaps.select("run_id", gate.obligation_id(F.lit("gap"), F.lit("note"), F.col("path"), F.col("line"), F.col("reason")).alias("id"), F.lit("gap").alias("rule_id"), F.lit("gap").alias("source"), *tail, F.lit(1).alias("source_rank"))
    profile = profiles.select("run_id", gate.obligation_id(F.lit("access"), F.lit("profile"), F.col("profile")).alias("id"), F.lit("access").alias("rule_id"), F.lit("profile").alias("source"), *tail, F.lit(2).alias("source_rank"))
    return gate.first_by_source(own.unionByName(gap).unionByName(profile)).drop("source_rank")


def fact_problems(inventory: DataFrame, operations: DataFrame) -> DataFrame:
    """(run_id, subject, problem): constructs of the SQL without an operation, operations without a construct, and pairs whose reads,
    writes or calls differ as sets. operations (run_id, path, kind, id, order, start_line, end_line, reads, writes, calls)."""
    at = inventory.select("run_id", "path", F.col("construct").alias("kind"), F.row_number().over(gate.Window.partitionBy("run_id", "path", "construct").orderBy("start_line", "scope", "ordinal")).alias("ordinal"), F.col("start_line").alias("line"), "reads", "writes", "calls")
    found = gate.matched(at.select("run_id", "path", "kind", "ordinal", "line"), operations)
    subject = F.concat_ws(":", "path", "kind", F.col("ordinal").cast("string"))
    absent = found.where("operation_id is null").select("run_id", subject.alias("subject"), F.lit("no_operation").alias("problem"))
    extra = operations.select("run_id", "path", F.col("id").alias("operation_id")).join(found.where("operation_id is not null").select("run_id", "path", "operation_id"), ["run_id", "path", "operation_id"], "left_anti")
    extra = extra.select("run_id", F.col("operation_id").alias("subject"), F.lit("no_construct").alias("problem"))
    both = found.where("operation_id is not null").join(at, ["run_id", "path", "kind", "ordinal", "line"]).join(operations.select("run_id", "path", F.col("id").alias("operation_id"), *(F.col(c).alias(f"_{c}") for c in ("reads", "writes", "calls"))), ["run_id", "path", "operation_id"])
    same = lambda c: F.sort_array(F.array_distinct(F.col(c))) == F.sort_array(F.array_distinct(F.col(f"_{c}")))
    differing = [both.where(~F.coalesce(same(c), F.lit(False))).select("run_id", F.col("operation_id").alias("subject"), F.lit(f"{c}_differ").alias("problem")) for c in ("reads", "writes", "calls")]
    return reduce(DataFrame.unionByName, differing, absent.unionByName(extra))


def expression_problems(sql: DataFrame, facts: DataFrame) -> DataFrame:
    """sql and facts (run_id, expression): (run_id, expression, problem) of expressions that only one side has, whatever their
    spelling."""
    a, b = (df.where("expression is not null").withColumn("key", expression_tokens("expression")).groupBy("run_id", "key").agg(F.min("expression").alias(n)) for df, n in ((sql, "a"), (facts, "b")))
    rows = a.join(b, ["run_id", "key"], "full")
    problem = F.when(F.col("b").isNull(), "no_fact").when(F.col("a").isNull(), "no_sql")
    return rows.select("run_id", F.coalesce("a", "b").alias("expression"), problem.alias("problem")).where("problem is not null")


def evaluated(required: DataFrame, checks: DataFrame, problems: Mapping[str, DataFrame]) -> DataFrame:
    """One row per run: the score of its obligations and the number of problems of each kind (name -> rows with run_id); a run with
    any problem is not ready, whatever its score. Runs that only have problems are revised."""
    score = gate.scored(required, checks)
    rows = score
    for name, some in problems.items():
        rows = rows.join(some.groupBy("run_id").agg(F.count("*").alias(name)), "run_id", "full")
    total = reduce(lambda a, b: a + b, [F.coalesce(n, F.lit(0)) for n in problems], F.lit(0))
    rows = rows.withColumn("problems", total.cast("bigint"))
    verdict = F.when(F.col("decision") == "blocked", "blocked").when((F.col("problems") > 0) | F.col("decision").isNull(), "revise").otherwise(F.col("decision"))
    return rows.withColumn("decision", verdict).select("run_id", *(F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in problems), "problems", "decision")


def barred(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """rows of evaluated() with `changed`: how many inputs of the run (changed: run_id, one row each; see sources.snapshots.guarded)
    changed while the gate read them. Such a run is blocked, whatever it was found to be: its verdict stands for no one state."""
    n = changed.groupBy("run_id").agg(F.count("*").alias("changed"))
    rows = rows.join(n, "run_id", "left").withColumn("changed", F.coalesce("changed", F.lit(0)).cast("bigint"))
    return rows.withColumn("decision", F.when(F.col("changed") > 0, "blocked").otherwise(F.col("decision")))


# Reports and pages ---------------------------------------------------------------------------------------------------


def broken_links(issues: DataFrame) -> DataFrame:
    """issues of operators.lint -> one row per file: how many links, anchors and lines of it lead nowhere."""
    of = lambda c: F.count_if(F.col("code") == c).alias(c)
    return issues.where(F.col("code").isin(*BROKEN)).groupBy("file").agg(*(of(c) for c in BROKEN), F.count("*").alias("broken"))


def decided_at(decisions: DataFrame) -> DataFrame:
    """decisions with `at`: timestamp, else generated_at, else issued_at."""
    return decisions.withColumn("at", F.coalesce(*gate.TIMES))


def cache_statistics(entries: DataFrame) -> DataFrame:
    """entries (key, bytes): how many, and their megabytes to two places, halves to even."""
    return entries.agg(F.count("*").alias("entries"), F.bround(F.coalesce(F.sum("bytes"), F.lit(0)).cast("decimal(38,0)") / F.lit(1048576).cast("decimal(38,0)"), 2).cast("double").alias("megabytes"))


def mixed_metadata(rows: DataFrame) -> DataFrame:
    """rows (file, page_id, ...) whose file is not named by the hash of its page, or that lack a page: (file, problem)."""
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.json$", "")
    problem = F.when(F.col("page_id").isNull(), "no_page").when(stem != F.sha2("page_id", 256), "other_name")
    return rows.select("file", problem.alias("problem")).where("problem is not null")


def rendered(rows: DataFrame) -> DataFrame:
    """rows (page, section, ordinal, line) -> (page, markdown): sections in order, each a heading and its lines. A page is one row, as
    long as the page."""
    ordered = F.array_sort(F.collect_list(F.struct("section", F.col("ordinal").cast("long").alias("ordinal"), "line")))
    parts = rows.groupBy("page", "section").agg(ordered.alias("r")).select("page", "section", F.concat(F.lit("## "), "section", F.lit("\n\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("part"))
    return parts.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "part"))), lambda x: x["part"]), "\n\n").alias("markdown"))
