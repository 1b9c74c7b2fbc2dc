import json
import random
from pathlib import Path

from lodestone.functions.storage import shared_folder
from lodestone.operators import evidence


def brute(value, location):
    """Every object with all fields, by recursion."""
    out = []
    if isinstance(value, dict):
        if set(evidence.FIELDS) <= value.keys():
            out.append((location, value))
        for k, v in value.items():
            out += brute(v, f"{location}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += brute(v, f"{location}.{i}")
    return out


def made(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.2:
        return rng.choice([1, "x", None, True, 2.5, {}, []])
    if kind < 0.5:
        return {rng.choice("abc") + str(i): made(rng, depth - 1) for i in range(rng.randrange(4))}
    if kind < 0.7:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    ref = {"path": rng.choice(["p", None, 5]), "start_line": rng.choice([1, "2", None]), "end_line": 3, "sha256": "ab"}
    if rng.random() < 0.3:
        del ref[rng.choice(list(ref))]
    if rng.random() < 0.3:
        ref["root"] = "run"
    if rng.random() < 0.5:
        ref["more"] = made(rng, depth - 1)
    return ref


def test_references_at_every_depth_equal_brute_force(spark):
    rng = random.Random(7)
    docs = [(f"r{i}", rng.choice(["facts", "inventory"]), made(rng, 6)) for i in range(120)]
    rows = [(r, a, json.dumps(d)) for r, a, d in docs] + [("n", "facts", None), ("bad", "facts", "{"), ("scalar", "facts", "5")]
    got = evidence.references(spark, spark.createDataFrame(rows, "run_id string, artifact string, document string")).collect()
    want = {(r, where): v for r, a, d in docs for where, v in brute(d, a)}
    assert len(got) == len(want) and max(where.count(".") for _, where in want) >= 5
    for r in got:
        v = want[r["run_id"], r["location"]]
        assert r["root"] == v.get("root", "project") and r["end_line"] == 3 and r["sha256"] == "ab"
        assert r["path"] == (None if v["path"] is None else str(v["path"])) and r["start_line"] == (None if v["start_line"] is None else int(v["start_line"]))


def test_problems_and_odd_tables(spark):
    deep = {"path": "gone.sql", "start_line": 1, "end_line": 2, "sha256": "a" * 64}
    doc = {"path": "a.sql", "start_line": 1, "end_line": 2, "sha256": "a" * 64, "x": [{"y": {"z": [deep]}}, {**deep, "path": "a.sql", "sha256": "b" * 64}, {**deep, "path": "a.sql", "end_line": 99}]}
    kind = "run_id long, artifact string, document string, value string, location int"
    rows = spark.createDataFrame([(1, "facts", json.dumps(doc), "v", 0)], kind)
    ledger = spark.createDataFrame([(None, "a.sql", "a" * 64, 10)], "root string, path string, sha256 string, n_lines long")
    got = {(r["location"], r["problem"]) for r in evidence.problems(spark, rows, ledger).collect()}
    assert got == {("facts.x.0.y.z.0", "not_an_input"), ("facts.x.1", "changed"), ("facts.x.2", "beyond_end")}
    assert evidence.problems(spark, rows.limit(0), ledger).count() == 0
    long = {"x": "y" * 3_000_000, "r": [deep] * 5}
    assert evidence.references(spark, spark.createDataFrame([(1, "f", json.dumps(long), "", 0)] * 2, kind)).count() == 10


def test_references_are_found_in_one_pass_that_writes_nothing(spark):
    kept = Path(shared_folder(spark).removeprefix("file://"))
    before = set(kept.iterdir()) if kept.exists() else set()
    ref = '{"path":1.50,"start_line":12345678901234567890,"end_line":3,"sha256":{"b":1,"a":[2]},"x\\ud83d\\ude00":[%s]}'
    deep = ref % (ref % (ref % ""))
    kind = "run_id long, artifact string, document string"
    rows = spark.createDataFrame([(1, "f", " " + deep), (2, None, "[" * 40 + deep + "]" * 40), (3, "f", "[" * 40 + deep)], kind)
    got = {(r["run_id"], r["location"]): r for r in evidence.references(spark, rows).collect()}
    assert set(got) == {(1, "f" + ".x😀.0" * k) for k in range(3)} | {(2, ".".join(["0"] * 40) + ".x😀.0" * k) for k in range(3)}
    assert {(r["path"], r["start_line"], r["end_line"], r["sha256"]) for r in got.values()} == {("1.5", None, 3, '{"a":[2],"b":1}')}
    assert (set(kept.iterdir()) if kept.exists() else set()) == before  # each level was a table
