"""Repeated runs of cases against what was written down for them: golden facts, subjects, variants, and mutations of facts.

Facts and expectations come as rows (case, part, name, value): one for each thing that is claimed, such as a dependency, a count or
a column's type."""

from __future__ import annotations

import copy
import subprocess
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def operation_counts(operations: DataFrame) -> DataFrame:
    """operations (case, kind) as facts: how often each kind occurs."""
    return operations.groupBy("case", F.col("kind").alias("name")).agg(F.count("*").cast("string").alias("value")).select("case", F.lit("operations").alias("part"), "name", "value")


def golden_problems(expected: DataFrame, actual: DataFrame, whole: Sequence[str] = ()) -> DataFrame:
    """(case, part, name, value, problem): expected rows that the facts have not, or not as often; and, in the parts that are expected
    whole, rows that nobody expected, for the cases that expect anything of that part."""
    by = ["case", "part", "name", "value"]
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    a, b = (df.groupBy(*by).agg(F.count("*").alias("n")).alias(n) for df, n in ((expected, "a"), (actual, "b")))
    rows = a.join(b, same, "full").select(*(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in by), F.coalesce("a.n", F.lit(0)).alias("_want"), F.coalesce("b.n", F.lit(0)).alias("_have"))
    asked = expected.where(F.col("part").isin(*whole)).select("case", "part").distinct().withColumn("_whole", F.lit(True))
    problem = F.when(F.col("_have") < F.col("_want"), "missing").when((F.col("_have") > F.col("_want")) & F.col("_whole"), "unexpected")
    return rows.join(asked, ["case", "part"], "left").withColumn("problem", problem).where("problem is not null").select(*by, "problem")


def subject_problems(runs: DataFrame, subjects: DataFrame) -> DataFrame:
    """runs (case, repeat, subject) against subjects (case, subject), as multisets: (case, repeat, subject, problem) of subjects that a
    repeat left out, made twice or made up."""
    wanted = runs.select("case", "repeat").distinct().join(subjects.groupBy("case", "subject").agg(F.count("*").alias("want")), "case")
    rows = wanted.join(runs.groupBy("case", "repeat", "subject").agg(F.count("*").alias("have")), ["case", "repeat", "subject"], "full")
    want, have = F.coalesce("want", F.lit(0)), F.coalesce("have", F.lit(0))
    problem = F.when(have < want, "omitted").when((want == 0) & (have > 0), "invented").when(have > want, "repeated")
    return rows.withColumn("problem", problem).where("problem is not null").select("case", "repeat", "subject", "problem")


def report(runs: DataFrame, subjects: DataFrame, repeats: int) -> DataFrame:
    """One row: cases, subjects, repeats, results, how many were right, the most variants of one subject, and whether all is right: each
    subject once in each repeat, each result right. runs (case, repeat, subject, facts_sha256, decision, errors, valid)."""
    variants = runs.groupBy("case", "subject").agg(F.count_distinct(F.struct("facts_sha256", "decision", F.to_json("errors"))).alias("v"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    a = runs.agg(F.count("*").alias("results"), F.count_if("valid").alias("right"))
    b = subjects.agg(F.count_distinct("case").alias("cases"), F.count("*").alias("subjects"))
    c = variants.agg(F.coalesce(F.max("v"), F.lit(0)).alias("most_variants"))
    d = subject_problems(runs, subjects).agg(F.count("*").alias("subject_problems"))
    rows = one(a).join(one(b), "_one").join(one(c), "_one").join(one(d), "_one").withColumn("repeats", F.lit(repeats)).drop("_one")
    return rows.withColumn("valid", (F.col("subject_problems") == 0) & (F.col("right") == F.col("results")) & (F.col("results") == F.col("subjects") * repeats))


def mutated(facts: Mapping, group: str, selector: Mapping, field: str, value) -> dict:
    """A copy of a facts document with one field changed, at a dotted path (numbers are places of a list), of the first fact of the group
    that the selector matches. A document is one run's."""
    out = copy.deepcopy(dict(facts))
    found = next((f for f in out[group] if all(f.get(k) == v for k, v in selector.items())), None)
    if found is None:
        raise ValueError("the selector matches no fact")
    step = lambda at, k: at[int(k)] if isinstance(at, list) else at[k]
    *path, last = field.split(".")
    for k in path:
        found = step(found, k)
    found[int(last) if isinstance(found, list) else last] = value
    return out


def adapted(command: Sequence[str], request: str, folder: str, timeout: float = 120) -> str:
    """Run an external maker of facts on a request file, without a shell; what it prints. On the driver, one case at a time."""
    if not command or not all(isinstance(x, str) for x in command):
        raise ValueError("a command is a list of texts")
    try:
        done = subprocess.run([x.replace("{request}", request) for x in command], cwd=folder, capture_output=True, text=True, timeout=timeout, shell=False)
    except subprocess.TimeoutExpired as e:
        raise ValueError(f"no answer in {timeout} s") from e
    if done.returncode:
        raise ValueError(f"exit {done.returncode}: {done.stderr[-300:]}")
    return done.stdout
