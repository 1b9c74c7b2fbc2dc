import hashlib
import json
import sys

import pytest
from lodestone.__main__ import main
from lodestone.functions import identity
from lodestone.operators import ddl, gate, lineage, regression, rules
from lodestone.sources import artifacts, pdf
from pyspark.sql import functions as F

FACT = "case string, part string, name string, value string"
RUN = "case string, repeat int, subject string, facts_sha256 string, decision string, errors array<string>, valid boolean"


def test_golden(spark):
    expected = spark.createDataFrame([("c", "reads", "s.t", None), ("c", "reads", "s.u", None), ("c", "type", "a", "int"), ("d", "type", "a", "int")], FACT)
    actual = spark.createDataFrame([("c", "reads", "s.t", None), ("c", "reads", "s.x", None), ("c", "type", "a", "int"), ("c", "type", "b", "int"), ("d", "type", "a", "text"), ("d", "reads", "q", None)], FACT)
    got = sorted((r["case"], r["part"], r["name"], r["problem"]) for r in regression.golden_problems(expected, actual, ["reads"]).collect())
    assert got == [("c", "reads", "s.u", "missing"), ("c", "reads", "s.x", "unexpected"), ("d", "type", "a", "missing")]
    counts = regression.operation_counts(spark.createDataFrame([("c", "SELECT"), ("c", "SELECT")], "case string, kind string"))
    assert [tuple(r) for r in counts.collect()] == [("c", "operations", "SELECT", "2")]


def test_subjects_and_report(spark, tmp_path, capsys):
    subjects = spark.createDataFrame([("c", "a"), ("c", "b")], "case string, subject string")
    good = [("c", i, s, "h", "ready", [], True) for i in (1, 2) for s in "ab"]
    runs = spark.createDataFrame(good, RUN)
    assert regression.subject_problems(runs, subjects).count() == 0
    r = regression.report(runs, subjects, 2).first()
    assert (r["cases"], r["subjects"], r["results"], r["right"], r["most_variants"], r["valid"]) == (1, 2, 4, 4, 1, True)
    bad = spark.createDataFrame([*good[:3], ("c", 1, "a", "i", "ready", [], True), ("c", 2, "z", "h", "ready", [], True)], RUN)
    assert sorted((r["repeat"], r["subject"], r["problem"]) for r in regression.subject_problems(bad, subjects).collect()) == [(1, "a", "repeated"), (2, "b", "omitted"), (2, "z", "invented")]
    assert not regression.report(bad, subjects, 2).first()["valid"] and regression.report(bad, subjects, 2).first()["most_variants"] == 2
    runs.write.parquet(f"{tmp_path}/runs")
    subjects.write.parquet(f"{tmp_path}/subjects")
    assert main(["regression", "--runs", f"{tmp_path}/runs", "--subjects", f"{tmp_path}/subjects", "--repeats", "2"]) == 0
    assert main(["regression", "--runs", f"{tmp_path}/runs", "--subjects", f"{tmp_path}/subjects", "--repeats", "3"]) == 1
    capsys.readouterr()


def test_mutations_and_adapters(tmp_path):
    facts = {"columns": [{"id": 1, "refs": [{"line": 3}]}, {"id": 2, "refs": []}]}
    got = regression.mutated(facts, "columns", {"id": 1}, "refs.0.line", 9)
    assert got["columns"][0]["refs"][0]["line"] == 9 and facts["columns"][0]["refs"][0]["line"] == 3
    with pytest.raises(ValueError):
        regression.mutated(facts, "columns", {"id": 7}, "x", 1)
    assert regression.adapted([sys.executable, "-c", "import sys; print(sys.argv[1])", "{request}"], "r.json", str(tmp_path)).strip() == "r.json"
    for command in ([sys.executable, "-c", "raise SystemExit(3)"], [], [sys.executable, "-c", "import time; time.sleep(9)"]):
        with pytest.raises(ValueError):
            regression.adapted(command, "r", str(tmp_path), timeout=1)


SQL = "create table s.t (id int); create index i on s.t (id); grant select on s.t to x; create view s.v as select id from s.t; grant select on s.gone to x; insert into s.t select id from s.u; create function s.f(a int) returns int language sql as 'select 1'; create function s.f(a text) returns int language sql as 'select 1'"


def test_owners_and_subjects(spark):
    rows = ddl.walked(spark.createDataFrame([("a.sql", SQL)], "path string, sql string"))
    got = sorted((r["construct"], r["scope"].split("@")[0], r["owner"]) for r in ddl.owned(rows).collect() if r["construct"] != "SELECT")
    assert got == [
        ("CREATE_TABLE", "s.t", "s.t"), ("FUNCTION", "s.f(integer)", "s.f(integer)"), ("FUNCTION", "s.f(text)", "s.f(text)"), ("GRANT", "s.gone", None), ("GRANT", "s.t", "s.t"),
        ("INDEX", "s.t", "s.t"), ("INSERT", "unresolved+insert", "s.t"), ("VIEW", "s.v", "s.v"),
    ]
    wanted = spark.createDataFrame([("a.sql", x) for x in ("v", "s.t", "s.f", "s.f(text)", "none")], "path string, subject string")
    assert {r["subject"]: (r["n"], r["scope"]) for r in ddl.subjects(rows, wanted).collect()} == {"v": (1, "s.v"), "s.t": (1, "s.t"), "s.f": (2, None), "s.f(text)": (1, "s.f(text)"), "none": (0, None)}


def test_keys_sections_orders(spark):
    objects = [("table", "s", "a b", None, None, "table+s+a%20b"), ("table", None, "t", None, None, None), ("cte", "s", "c", None, "own", None), ("function", "s", "f", None, None, None), ("function", "s", "f", "a int", None, "function+s+f(integer)")]
    df = spark.createDataFrame(objects, "kind string, schema string, name string, arguments string, scope string, want string")
    key = identity.object_key(*(F.col(c) for c in ("kind", "schema", "name", "arguments", "scope")))
    assert all(r["k"] == r["want"] for r in df.select(key.alias("k"), "want").collect())
    items = spark.createDataFrame([(1, True, 5), (2, None, 5), (3, False, 0)], "id int, flagged boolean, n int")
    ids = lambda s: [r["id"] for r in items.where(rules.applicable(s)).collect()]
    assert ids({"always_applicable": True}) == [1, 2, 3] and ids({"conditional": "flagged"}) == [1] and ids({"conditional": "flagged", "applies": {"n_gte": 5}}) == [1, 2] and ids({}) == []
    ops = spark.createDataFrame([("r", "b", 1, 1, "x"), ("r", "a", 2, 2, "y"), ("r", "a", 1, 9, "z")], "run_id string, path string, start_line int, end_line int, id string")
    assert {r["id"]: r["order"] for r in gate.numbered(ops).collect()} == {"z": 1, "y": 2, "x": 3}
    nodes, edges, pages = lineage.listed(spark.createDataFrame([("b",), ("a",)], "key string"), spark.createDataFrame([("b", "a", "read", "1"), ("a", "b", "read", "2"), ("a", "b", "call", "3")], "`from` string, `to` string, kind string, operation_id string"), spark.createDataFrame([("q",), ("p",)], "page_id string"))
    assert [r["key"] for r in nodes.collect()] == ["a", "b"] and [r["operation_id"] for r in edges.collect()] == ["3", "2", "1"] and [r["page_id"] for r in pages.collect()] == ["p", "q"]


def test_images(spark):
    df = spark.createDataFrame([("![a](x/y/i$1.png) ![b](gone.png)", ["i$1.png"]), ("none", [])], "md string, names array<string>")
    assert [r[0] for r in df.select(pdf.relinked(F.col("md"), F.col("names"))).collect()] == ["![a](images/i$1.png) ![b](gone.png)", "none"]
    df = spark.createDataFrame([("a<!-- image -->b<!-- image -->c", ["1.png"]), ("x", ["1.png"])], "md string, names array<string>")
    assert [r[0] for r in df.select(pdf.placed(F.col("md"), F.col("names"))).collect()] == ["a![](images/1.png)b<!-- image -->c", "x"]
    df = spark.createDataFrame([("text", "a \"b\".pdf", 3, [("b.png", 2048), ("a.png", 100)])], "md string, source string, n int, images array<struct<name string, bytes long>>")
    r = df.select(pdf.titled(F.col("md"), F.col("source"), F.col("n"), "fast").alias("t"), pdf.image_table(F.col("images")).alias("i")).first()
    assert r["t"] == '---\nsource: "a \\"b\\".pdf"\npages: 3\nmode: fast\n---\n\ntext' and r["i"].split("\n")[2:] == ["| a.png | 0.1 |", "| b.png | 2.0 |"]
    images = spark.createDataFrame([("p", "a.png", 1), ("p", "a.png", 1), ("p", "b.png", 2)], "path string, name string, bytes long")
    assert [r["name"] for r in pdf.image_catalogue(images, spark.createDataFrame([("p", "![](q/a.png)")], "path string, markdown string")).collect()] == ["a.png"]


def test_artifact_sets_archives_and_copies(spark, tmp_path, capsys):
    for run, facts in (("r1", '{"run_id": "r1"}'), ("r2", '{"run_id": "r2", "run_id": "x"}')):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "facts.json").write_text(facts)
    got = artifacts.artifact_set(spark, f"file://{tmp_path}/runs", {"facts": "run_id string"})["facts"]
    assert {r["run"]: (r["valid"], r["value"] and r["value"]["run_id"]) for r in got.collect()} == {"r1": (True, "r1"), "r2": (False, None)}
    assert main(["validate", f"{tmp_path}/runs"]) == 1 and [json.loads(x)["problem"] for x in capsys.readouterr().out.splitlines()] == ["invalid_json"]
    records = spark.createDataFrame([("r1", "p", "k", "d"), ("r2", "p", "k", "d"), ("r3", "p", "k", "d")], "run_id string, page_id string, key string, page_sha256 string")
    documented = spark.createDataFrame([("r1", "p", "k"), ("r2", "p", "other"), ("r3", "p", "k"), ("r3", "p", "l")], "run_id string, page_id string, key string")
    manifests = spark.createDataFrame([("r1", "p", "m", "d", "v"), ("r2", "p", "m", "e", "v"), ("r3", "p", "m", "d", "v")], "run_id string, page_id string, sha256 string, draft_sha256 string, validation_sha256 string")
    decisions = spark.createDataFrame([("r1", "ready", "m", "v"), ("r2", "revise", "m", "w")], "run_id string, decision string, manifest_sha256 string, validation_sha256 string")
    problems = sorted((r["run_id"], r["problem"]) for r in artifacts.archive_problems(records, documented, manifests, decisions).collect())
    assert problems == [("r2", "not_ready"), ("r2", "other_draft"), ("r2", "other_key"), ("r2", "other_validation"), ("r3", "not_one_identity"), ("r3", "not_ready"), ("r3", "other_manifest"), ("r3", "other_validation")]
    assert artifacts.saved(spark, f"file://{tmp_path}/runs/r1", f"file://{tmp_path}/kept/r1") == 1
    assert (tmp_path / "kept/r1/facts.json").read_text() == '{"run_id": "r1"}'
    with pytest.raises(ValueError):
        artifacts.saved(spark, f"file://{tmp_path}/runs/r1", f"file://{tmp_path}/kept/r1")
    rows = artifacts.ledger(spark, f"file://{tmp_path}/kept").collect()
    assert [(r["name"], r["sha256"]) for r in rows] == [("r1/facts.json", hashlib.sha256(b'{"run_id": "r1"}').hexdigest())]
