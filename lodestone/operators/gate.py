"""Obligations, checks, and the gate's verdict, as joins and grouped counts keyed by run_id.

policy rules (rule_id, kind, source, applies: a condition tree, blocking, category); items (run_id, ..., one column per feature);
required (run_id, id, ...), checks (run_id, plan_check_id, status, blocking, ...)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.rules import READY_PERCENT, predicate

# What a check may find.
STATUSES = ("ok", "defect", "inconclusive", "not_applicable")
# Columns of a fact that are no claims of its page.
NO_CLAIMS = ("id", "source_refs")


def obligation_id(rule: Column, kind: Column, *anchor: Column) -> Column:
    """rule:kind: and 16 digits of the hash of what they stand on, written as a JSON list."""
    return F.concat(rule, F.lit(":"), kind, F.lit(":"), F.left(F.sha2(F.to_json(F.array(*(a.cast("string") for a in anchor))), 256), F.lit(16)))


def required(items: DataFrame, rules: Sequence[Mapping], anchor: Sequence[str]) -> DataFrame:
    """(run_id, id, rule_id, source, blocking, category) for each rule and each item to which it applies. Rules come from a
    policy document, so each is a compiled predicate: one scan of the items, no join. always, or a condition."""
    applying = [F.when(F.lit(bool(r.get("always"))) | predicate(r.get("applies") or {"_or": []}), F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r.get("source", "section")).alias("source"), F.lit(bool(r.get("blocking"))).alias("blocking"), F.lit(r.get("category", "technical")).alias("category"), F.lit(n).alias("rank"))) for n, r in enumerate(rules)]
    rows = items.withColumn("_rule", F.explode(F.array_compact(F.array(*applying))))
    made = obligation_id(F.col("_rule.rule_id"), F.col("kind"), *(F.col(a) for a in anchor))
    rows = rows.select("run_id", made.alias("id"), "_rule.*")
    return rows.groupBy("run_id", "id").agg(F.min_by(F.struct("rule_id", "source", "blocking", "category"), "rank").alias("r")).select("run_id", "id", "r.*")


def severity(checks: DataFrame, always_blocking: Sequence[str], never_editorial: Sequence[str]) -> DataFrame:
    """checks with blocking and category as the policy overrides them for their defect codes."""
    hard, technical = F.coalesce(F.col("defect_code").isin(*always_blocking), F.lit(False)), F.coalesce(F.col("defect_code").isin(*never_editorial), F.lit(False))
    return checks.withColumn("blocking", F.coalesce("blocking", F.lit(False)) | hard).withColumn("category", F.when(technical | hard, "technical").otherwise(F.col("category")))


def answered(required_: DataFrame, checks: DataFrame) -> DataFrame:
    """(run_id, id, status, blocking, error, sure): each obligation by its one result. No result, several, one that is no status, and
    not_applicable for an obligation that applies count as inconclusive and are errors; another status for one that does not apply is
    an error and counts as it is. sure: the status is the one given. required_ may have applicable (true where it has not) and
    category (technical obligations block)."""
    has = lambda c, other: F.coalesce(F.col(c), other) if c in required_.columns else other
    own = required_.select("run_id", "id", (F.coalesce("blocking", F.lit(False)) | (has("category", F.lit("")) == "technical")).alias("blocking"), has("applicable", F.lit(True)).alias("applicable"))
    n = checks.groupBy("run_id", F.col("plan_check_id").alias("id")).agg(F.count("*").alias("n"), F.max("status").alias("status"), F.max("blocking").alias("_blocking"))
    rows = own.join(n, ["run_id", "id"], "left")
    unsure = (
        F.when(F.col("n").isNull(), "missing_result").when(F.col("n") > 1, "several_results").when(F.col("applicable") & (F.col("status") == "not_applicable"), "applicable_not_answered")
        .when(F.col("status").isNull() | ~F.col("status").isin(*STATUSES), "unknown_status")
    )
    error = F.coalesce(unsure, F.when(~F.col("applicable") & (F.col("status") != "not_applicable"), "inconsistent_applicability"))
    return rows.select("run_id", "id", F.when(unsure.isNull(), F.col("status")).otherwise("inconclusive").alias("status"), (F.col("blocking") | F.coalesce("_blocking", F.lit(False))).alias("blocking"), error.alias("error"), unsure.isNull().alias("sure"))


def scored(required_: DataFrame, checks: DataFrame) -> DataFrame:
    """One row per run: counts, percentages and decision. Checks beside the plan never raise a score, but they can block. An
    obligation without a proper result is an error, which keeps a run from being ready but does not block it."""
    rows = answered(required_, checks)
    beside = checks.withColumn("id", F.col("plan_check_id")).join(required_.select("run_id", "id"), ["run_id", "id"], "left_anti").where("blocking and status in ('defect', 'inconclusive')")
    rows = rows.withColumn("planned", F.lit(True)).unionByName(beside.select("run_id", "id", "status", F.lit(True).alias("blocking"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("sure"), F.lit(False).alias("planned")))
    of = lambda s: F.count_if(F.col("planned") & (F.col("status") == s))
    blocking = lambda s: F.count_if(F.col("blocking") & F.col("sure") & (F.col("status") == s))
    n = rows.groupBy("run_id").agg(
        F.count_if("planned").alias("total"), *(of(s).alias(s) for s in STATUSES), F.count("error").alias("errors"),
        blocking("defect").alias("blocking_defects"), blocking("inconclusive").alias("blocking_inconclusive"),
    )
    resolved_, none = F.col("ok") + F.col("defect"), (F.col("errors") + F.col("blocking_defects") + F.col("inconclusive")) == 0
    verdict = F.when(F.col("blocking_inconclusive") > 0, "blocked").when(none & (resolved_ > 0) & (F.col("ok") * 100 >= resolved_ * READY_PERCENT), "ready").otherwise("revise")
    percent = lambda a, b: F.bround(F.try_divide(F.lit(100.0) * a, b), 2)
    return n.withColumn("coverage_percent", percent(resolved_, resolved_ + F.col("inconclusive"))).withColumn("accuracy_percent", percent(F.col("ok"), resolved_)).withColumn("decision", verdict)


def matched(occurrences: DataFrame, operations: DataFrame) -> DataFrame:
    """occurrences (run_id, path, kind, ordinal, line) with operation_id: each, in their order, takes the operation of its kind and path
    of least order whose lines hold it and that none before it took; null where none is left. Both are dealt by file and kind and
    come sorted, operations first, so that a task holds one file's operations of one kind and streams the rest."""
    by = ["run_id", "path", "kind"]
    no = F.lit(None)
    left = occurrences.select(*by, F.lit(1).alias("side"), F.col("ordinal").cast("long").alias("a"), F.col("line").cast("long").alias("b"), no.cast("long").alias("c"), no.cast("string").alias("id"))
    right = operations.select(*by, F.lit(0).alias("side"), F.col("order").cast("long").alias("a"), F.col("start_line").cast("long").alias("b"), F.col("end_line").cast("long").alias("c"), F.col("id").cast("string").alias("id"))
    rows = left.unionByName(right).repartition(*by).sortWithinPartitions(*by, "side", "a", "b", "id")

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, free = None, None
        for batch in batches:
            out, taken = [], []
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            sides, a, b, c, ids = (batch.column(x).to_pylist() for x in ("side", "a", "b", "c", "id"))
            for i, key in enumerate(keys):
                if key != now:
                    now, free = key, _Free()
                if sides[i]:
                    out.append(i)
                    taken.append(free.take(b[i]))
                else:
                    free.add(b[i], c[i], ids[i])
            if out:
                at = pa.array(out, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(x).take(at) for x in (*by, "a", "b")), pa.array(taken, pa.string())], [*by, "ordinal", "line", "operation_id"])

    own = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    return rows.mapInArrow(greedy, f"{own}, ordinal long, line long, operation_id string")


class _Free:
    """Operations that are left, in their order, in a tree of the least start and the greatest end below each node: the first that holds
    a line is found by descent past all that cannot."""

    def __init__(self):
        self.rows: list[tuple[int, int, str]] = []
        self.low: list[float] | None = None

    def add(self, start: int, end: int, id_: str) -> None:
        self.rows.append((start, end, id_))

    def _build(self) -> None:
        self.size = 1 << max(0, len(self.rows) - 1).bit_length()
        self.low, self.high = [float("inf")] * (2 * self.size), [float("-inf")] * (2 * self.size)
        for i, (start, end, _) in enumerate(self.rows):
            self.low[self.size + i], self.high[self.size + i] = start, end
        for k in range(self.size - 1, 0, -1):
            self._mend(k)

    def _mend(self, k: int) -> None:
        self.low[k], self.high[k] = min(self.low[2 * k : 2 * k + 2]), max(self.high[2 * k : 2 * k + 2])

    def take(self, line: int) -> str | None:
        if not self.rows:
            return None
        if self.low is None:
            self._build()
        todo = [1]
        while todo:
            k = todo.pop()
            if line is None or self.low[k] > line or self.high[k] < line:
                continue
            if k >= self.size:
                found = self.rows[k - self.size][2]
                self.low[k], self.high[k] = float("inf"), float("-inf")
                while k > 1:
                    k //= 2
                    self._mend(k)
                return found
            todo += [2 * k + 1, 2 * k]
        return None


#: Where a decision says when it was made, the first that it has.
TIMES = ("timestamp", "generated_at", "issued_at")


def evidence_problems(refs: DataFrame, ledger: DataFrame) -> DataFrame:
    """refs (run_id, fact_id, root, path, start_line, end_line, sha256) against ledger (root, path, sha256, n_lines): rows with
    the first problem of each: absent path, lines, hash, file, drift, range."""
    known = ledger.select(F.coalesce("root", F.lit("project")).alias("root"), "path", F.col("sha256").alias("_sha"), "n_lines")
    own = (
        F.when(F.col("path").isNull() | (F.trim("path") == ""), "no_path")
        .when(F.col("start_line").isNull() | F.col("end_line").isNull() | (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), "bad_lines")
        .when(F.col("sha256").isNull() | ~F.rlike("sha256", F.lit("^[0-9a-f]{64}$")), "bad_hash")
    )
    # what references show by themselves goes to the join as one word, their hashes as bytes: a large ledger moves every reference
    rows = refs.select("run_id", "fact_id", F.coalesce("root", F.lit("project")).alias("root"), "path", "end_line", own.alias("_own"), F.when(own.isNull(), F.unhex("sha256")).alias("_hash"))
    rows = rows.join(known, ["root", "path"], "left")
    problem = F.coalesce("_own", F.when(F.col("_sha").isNull(), "not_an_input").when(F.col("_sha") != F.lower(F.hex("_hash")), "changed").when(F.col("end_line") > F.col("n_lines"), "beyond_end"))
    return rows.withColumn("problem", problem).where("problem is not null").select("run_id", "fact_id", "root", "path", "problem")


def dangling(facts: Mapping[str, DataFrame], links: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(run_id, from_group, id, field, missing) of ids that no row of the other group has. links: (group, field, group meant);
    fields are ids or lists of ids."""
    out = []
    for group, field, meant in links:
        rows = facts[group]
        one = rows.select("run_id", "id", (F.explode(field) if rows.schema[field].dataType.typeName() == "array" else F.col(field)).alias("missing")).where("missing is not null")
        out.append(one.join(facts[meant].select("run_id", F.col("id").alias("missing")), ["run_id", "missing"], "left_anti").select("run_id", F.lit(group).alias("from_group"), "id", F.lit(field).alias("field"), "missing"))
    return reduce(DataFrame.unionByName, out)


def disagreeing(artifacts: DataFrame) -> DataFrame:
    """artifacts (bundle, name, run_id, page_id, schema_version): bundles whose parts name several runs or pages or another version."""
    n = artifacts.groupBy("bundle").agg(F.count_distinct("run_id").alias("runs"), F.count_distinct("page_id").alias("pages"), F.count_if(F.col("run_id").isNull()).alias("unnamed"), F.max(~F.col("schema_version").eqNullSafe(2)).alias("other_version"))
    return n.where("runs <> 1 or pages > 1 or unnamed > 0 or other_version")


def claims(facts: DataFrame, *fields: str) -> DataFrame:
    """(run_id, fact_id, field, value): the fields of facts, each as JSON, one row per field that has a value."""
    fields = fields or tuple(c for c in facts.columns if c not in (*NO_CLAIMS, "run_id"))
    text = [F.struct(F.lit(f).alias("field"), F.to_json(F.struct(F.col(f).alias("v"))).alias("value")) for f in fields]
    rows = facts.select("run_id", F.col("id").alias("fact_id"), F.explode(F.array(*text)).alias("c"))
    return rows.select("run_id", "fact_id", "c.field", F.regexp_extract("c.value", r"(?s)^\{\"v\":(.*)\}$", 1).alias("value")).where("value <> ''")


def claim_problems(expected: DataFrame, shown: DataFrame) -> DataFrame:
    """(run_id, fact_id, field, problem): missing from the page, different there, or unsupported by facts. Values are JSON."""
    by = ["run_id", "fact_id", "field"]
    rows = expected.select(*by, F.col("value").alias("a"), F.lit(True).alias("_e")).join(shown.select(*by, F.col("value").alias("b"), F.lit(True).alias("_s")), by, "full")
    problem = F.when(F.col("_s").isNull(), "missing").when(F.col("_e").isNull(), "unsupported").when(~F.col("a").eqNullSafe(F.col("b")), "different")
    return rows.withColumn("problem", problem).where("problem is not null").select(*by, "problem")


def page_claims(blocks: DataFrame) -> DataFrame:
    """Claims of a page's tables (blocks of operators.markdown): rows `| claim:fact | field | JSON |`; other tables have none."""
    schema = "doc string, fact_id string, field string, value string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc"], batch["text"], strict=True):
                for line in text.split("\n"):
                    cells = [c.strip() for c in line.strip().removeprefix("|").removesuffix("|").replace("\\|", "\0").split("|")]
                    if len(cells) == 3 and cells[0].startswith("claim:"):
                        out.append((doc, cells[0][6:], cells[1], cells[2].strip("`").replace("\0", "|")))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return blocks.where("kind = 'table'").select("doc", "text").mapInPandas(run, schema)


def access(dependencies: DataFrame, pattern: str, matrix: DataFrame) -> DataFrame:
    """dependencies (run_id, owner_schema, schema, use) with family, layer and decision. pattern captures family, project and
    layer of a schema; matrix (use, kinship: same|other, layer, decision) is a policy's, its absence means unconfirmed."""
    part = lambda c, n: F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))
    rows = dependencies.withColumn("family", part("schema", 1)).withColumn("layer", part("schema", 3))
    rows = rows.withColumn("kinship", F.when((part("owner_schema", 1) == F.col("family")) & part("owner_schema", 2).eqNullSafe(part("schema", 2)), "same").otherwise("other"))
    return rows.join(matrix, ["use", "kinship", "layer"], "left").withColumn("decision", F.coalesce("decision", F.lit("unconfirmed")))


def metrics(decisions: DataFrame, transactions: DataFrame, mutations: DataFrame) -> DataFrame:
    """One row: decisions by verdict, when the first was ready (at its timestamp, else generated_at, else issued_at, of those that decisions
    have), blocking totals of ready ones (blocking_defects: how many, or a list of them), publishes per page (rolled-back
    ones count, catalogue rebuilds do not), and the rate of mutations that passed as ready."""
    of = lambda d: F.count_if(F.col("decision") == d)
    listed = decisions.schema["blocking_defects"].dataType.typeName() == "array"
    defects = F.greatest(F.size("blocking_defects"), F.lit(0)).cast("bigint") if listed else F.col("blocking_defects")
    at = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in TIMES if c in decisions.columns))
    ready = F.col("decision") == "ready"
    d = decisions.agg(of("ready").alias("ready"), of("revise").alias("revise"), of("blocked").alias("blocked"), F.min(F.when(ready, at)).alias("first"), F.coalesce(F.sum(F.when(ready, defects)), F.lit(0)).alias("ready_blocking"))
    t = transactions.where("kind <> 'catalogue' and state in ('committed', 'rolled_back')").agg(F.count("*").alias("publishes"), F.try_divide(F.count("*"), F.count_distinct("page_id")).alias("mean_iterations"))
    m = mutations.agg(F.avg(F.coalesce("false_ready", F.col("decision") == "ready").cast("double")).alias("error_rate"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(d).join(one(t), "_one").join(one(m), "_one").drop("_one")


def numbered(operations: DataFrame) -> DataFrame:
    """operations with order 1..n within their run, in the order of their files and lines."""
    return operations.withColumn("order", F.row_number().over(Window.partitionBy("run_id").orderBy("path", "start_line", "end_line", "id")))


def repeated_subjects(runs: DataFrame) -> DataFrame:
    """runs (subject, repeat, facts_sha256, decision, errors): variants of each subject's outcome; one where it is stable."""
    return runs.groupBy("subject").agg(F.count_distinct(F.struct("facts_sha256", "decision", F.to_json("errors"))).alias("variants"), F.count("*").alias("repeats"))


def first_by_source(checks: DataFrame) -> DataFrame:
    """One row per (run_id, id): that of the least source_rank."""
    w = Window.partitionBy("run_id", "id").orderBy("source_rank")
    return checks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
