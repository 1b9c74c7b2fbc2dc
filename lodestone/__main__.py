"""python -m lodestone COMMAND: the catalogue's operations over files and tables. Exit codes: 0 done or ready, 1 not ready or
faults found, 2 bad input."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import identity
from lodestone.functions.storage import settled
from lodestone.operators import ddl, evaluation, gate, graph, lineage, lint, markdown, regression
from lodestone.sources import artifacts, publication, snapshots


def session() -> SparkSession:
    spark = SparkSession.builder.appName("lodestone").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def printed(df: DataFrame) -> int:
    """One JSON object per row, as rows arrive; the number of rows."""
    n = 0
    for line in df.toJSON().toLocalIterator():
        print(line)
        n += 1
    return n


def texts(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path from the folder, text) of the files below it whose names match; hidden folders are left out."""
    root = str(Path(folder).resolve()).rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    name = F.replace(F.regexp_replace("path", "^file:/*", "/"), F.lit(root), F.lit(""))
    return rows.select(name.alias("path"), F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "").alias("text")).where(~F.rlike("path", F.lit(r"(^|/)\.")))


def inventory(spark, a) -> int:
    files = texts(spark, a.folder, "*.sql").withColumnRenamed("text", "sql")
    printed(ddl.walked(files))
    return 1 if printed(ddl.notes(files)) else 0


def plan(spark, a) -> int:
    rules = json.loads(Path(a.policy).read_text())["rules"]
    printed(gate.required(spark.read.parquet(a.items), rules, a.anchor.split(",")))
    return 0


def gated(spark, a) -> int:
    """The verdict per run; with --required and --checks as tables."""
    rows = gate.scored(spark.read.parquet(a.required), spark.read.parquet(a.checks)).collect()  # one row per run asked for
    for r in rows:
        print(json.dumps(r.asDict(), default=str))
    return 0 if rows and all(r["decision"] == "ready" for r in rows) else 1


def linted(spark, a) -> int:
    files = texts(spark, a.folder, "*")
    lines = F.size(F.split("text", "\n"))
    blocks = markdown.parsed(files.where(F.endswith("path", F.lit(".md"))).withColumnRenamed("path", "doc"))
    meta = spark.read.parquet(a.metadata) if a.metadata else spark.createDataFrame([], "page_id string, key string")
    return 1 if printed(lint.lint(blocks, files.select("path", lines.alias("n_lines")), meta)) else 0


def query(spark, a) -> int:
    """Answers from the tables edges, nodes, pages, inputs and files below --catalogue: all of one commit, where that has them."""
    at = snapshots.current(spark, a.catalogue)
    table = lambda n: at.table(spark, n) if n in at.folders else spark.read.parquet(f"{a.catalogue}/{n}")
    if a.outdated:
        return 1 if printed(lineage.outdated(table("inputs"), table("files"))) else 0
    edges = table("edges")
    if a.page:
        for name, df in lineage.of_page(spark, table("pages"), table("nodes"), edges, a.page, a.max_depth).items():
            printed(df.withColumn("part", F.lit(name)))
        return 0
    key = a.dependencies or a.consumers or a.affected
    if not key:
        raise ValueError("ask for a page or a key")
    asked = spark.createDataFrame([(key,)], "key string")
    if not lineage.known(edges, table("nodes"), asked).first()["known"]:
        raise ValueError(f"unknown key: {key}")
    if a.affected:
        printed(graph.closure(spark, edges.select("from", "to", "kind", "candidates", "ordinal"), asked.select(F.col("key").alias("seed")), "downstream", a.max_depth))
    else:
        printed((graph.dependencies if a.dependencies else graph.consumers)(edges).where(F.col("node") == key))
    return 0


def index(spark, a) -> int:
    """Rebuild nodes, edges and gaps below --catalogue from its objects and operations, as one commit; nothing is committed if those change
    meanwhile or another commit comes first."""
    based_on = snapshots.current(spark, a.catalogue).number
    inputs = [f"{a.catalogue}/{n}" for n in ("objects", "operations")]
    before = settled(spark, snapshots.frame(spark, inputs, content=False), "frame")
    objects, operations = (spark.read.parquet(x) for x in inputs)
    if printed(lineage.repeated(objects.where("scope is null and key is not null and page_id is not null"), "key")) + printed(lineage.orphans(objects, operations)):
        return 1
    made = {"nodes": lineage.nodes(objects), "edges": lineage.edges(objects, operations), "gaps": lineage.gaps(operations)}

    def unchanged() -> None:
        if not snapshots.differences(before, snapshots.frame(spark, inputs, content=False)).isEmpty():
            raise snapshots.Conflict("objects or operations changed while they were read; try again")

    snapshots.commit(spark, a.catalogue, made, based_on, check=unchanged)
    return 0


def metrics(spark, a) -> int:
    read = lambda n: spark.read.parquet(f"{a.catalogue}/{n}")
    printed(gate.metrics(read("decisions"), read("transactions"), read("mutations")))
    return 0


def names(spark, a) -> int:
    key = identity.routine_key(F.lit(a.kind), F.lit(a.schema), F.lit(a.name), F.lit(a.arguments)) if a.arguments is not None else F.concat_ws("+", F.lit(a.kind), identity.percent_encoded(F.lit(a.schema)), identity.percent_encoded(F.lit(a.name)))
    return 0 if printed(identity.page_names(spark.range(1).select(key.alias("key")).where("key is not null"))) else 2


def bundle(spark, a) -> int:
    """Files below a folder against a ledger (name, sha256); --save copies them to a new place if they agree."""
    if a.save:
        print(json.dumps({"files": artifacts.saved(spark, a.folder, a.save, spark.read.parquet(a.ledger))}))
        return 0
    return 1 if printed(artifacts.drifted(spark, spark.read.parquet(a.ledger), a.folder)) else 0


def publish(spark, a) -> int:
    """Copy the files of a run's folder into a tree, all or none; --recover only repairs."""
    root = Path(a.tree)
    if a.recover:
        with publication.locked(root):
            print(json.dumps(publication.repair(root)))
        return 0
    run = Path(a.run_)
    files = {str(p.relative_to(run)): p.read_bytes() for p in sorted(run.rglob("*")) if p.is_file()}
    if a.dry_run:
        print(publication.preview(root, files))
        return 0
    print(publication.publish(root, run.name, publication.prepare(root, files)))
    return 0


def validated(spark, a) -> int:
    """Artifacts below a folder of runs: files that are no strict JSON, and a policy that does not hold together."""
    bad = artifacts.strict_json(spark, a.folder, "run_id string").where("not valid").select(F.element_at(F.split("path", "/"), -1).alias("file"), F.lit("invalid_json").alias("problem"))
    found = printed(bad)
    for problem in evaluation.policy_problems(json.loads(Path(a.policy).read_text())) if a.policy else []:
        print(json.dumps({"problem": problem}))
        found += 1
    return 1 if found else 0


def regressed(spark, a) -> int:
    """The report of repeated runs below --runs against --subjects, and of golden facts where both tables are given."""
    runs, subjects = spark.read.parquet(a.runs), spark.read.parquet(a.subjects)
    found = printed(regression.subject_problems(runs, subjects))
    if a.expected and a.actual:
        found += printed(regression.golden_problems(spark.read.parquet(a.expected), spark.read.parquet(a.actual), a.whole.split(",") if a.whole else ()))
    row = regression.report(runs, subjects, a.repeats).first()
    print(json.dumps(row.asDict()))
    return 0 if row["valid"] and not found else 1


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(required=True)

    def command(name, run, *options):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for o in options:
            o, kind = (o, {}) if isinstance(o, str) else o
            c.add_argument(o, **kind)

    needed, flag = {"required": True}, {"action": "store_true"}
    command("inventory", inventory, "folder")
    command("plan", plan, "items", "policy", ("--anchor", {"default": "kind,ordinal"}))
    command("gate", gated, ("--required", needed), ("--checks", needed))
    command("lint", linted, "folder", "--metadata")
    command("query", query, ("--catalogue", needed), "--page", "--dependencies", "--consumers", "--affected", ("--outdated", flag), ("--max-depth", {"type": int, "default": 32}))
    command("index", index, ("--catalogue", needed))
    command("metrics", metrics, ("--catalogue", needed))
    command("identity", names, "kind", "schema", "name", "--arguments")
    command("bundle", bundle, "folder", "ledger", "--save")
    command("validate", validated, "folder", "--policy")
    command("regression", regressed, ("--runs", needed), ("--subjects", needed), ("--repeats", {"type": int, "default": 3}), "--expected", "--actual", "--whole")
    command("publish", publish, "tree", ("--run", {"dest": "run_", "metavar": "FOLDER"}), ("--dry-run", flag), ("--recover", flag))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(None if a.run is publish else session(), a)
    except (ValueError, OSError, publication.Conflict) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
