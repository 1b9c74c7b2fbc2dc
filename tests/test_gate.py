import pytest
from lodestone.operators import gate, markdown

REQUIRED = "run_id string, id string, blocking boolean"
CHECKS = "run_id string, plan_check_id string, status string, blocking boolean"


def verdict(spark, required, checks):
    r = gate.scored(spark.createDataFrame([("r", i, b) for i, b in required], REQUIRED), spark.createDataFrame([("r", i, s, b) for i, s, b in checks], CHECKS)).first()
    return r["decision"], r["ok"], r["defect"], r["inconclusive"], r["errors"]


@pytest.mark.parametrize("required, checks, want", [
    ([(f"c{i}", False) for i in range(20)], [(f"c{i}", "ok" if i < 17 else "defect", False) for i in range(20)], ("ready", 17, 3, 0, 0)),
    ([(f"c{i}", False) for i in range(20)], [(f"c{i}", "ok" if i < 16 else "defect", False) for i in range(20)], ("revise", 16, 4, 0, 0)),
    ([("a", True), ("b", False)], [("a", "defect", False), ("b", "ok", False)], ("revise", 1, 1, 0, 0)),
    ([("a", True), ("b", False)], [("b", "ok", False)], ("revise", 1, 0, 1, 1)),
    ([("a", True), ("b", False)], [("a", "inconclusive", False), ("b", "ok", False)], ("blocked", 1, 0, 1, 0)),
    ([("a", False)], [], ("revise", 0, 0, 1, 1)),
    ([("a", False)], [("a", "ok", False), ("a", "ok", False)], ("revise", 0, 0, 1, 1)),
    ([("a", False)], [("a", "not_applicable", False)], ("revise", 0, 0, 1, 1)),
    ([("a", False)], [("a", "ok", False), ("x", "ok", False), ("y", "defect", False)], ("ready", 1, 0, 0, 0)),
    ([("a", False)], [("a", "ok", False), ("x", "inconclusive", True)], ("blocked", 1, 0, 0, 0)),
    ([("a", False)], [("a", "ok", False), (None, "defect", True)], ("revise", 1, 0, 0, 0)),
])
def test_score(spark, required, checks, want):
    assert verdict(spark, required, checks) == want


def test_obligations_that_do_not_apply(spark):
    required = spark.createDataFrame([("r", "a", False, True, "editorial"), ("r", "b", False, False, "editorial"), ("s", "a", False, True, "editorial"), ("s", "b", False, False, "editorial"), ("t", "a", False, True, "technical"), ("t", "b", False, True, None)], REQUIRED + ", applicable boolean, category string")
    checks = spark.createDataFrame([("r", "a", "ok", False), ("r", "b", "not_applicable", False), ("s", "a", "ok", False), ("s", "b", "ok", False), ("t", "a", "defect", False), ("t", "b", "ok", False)], CHECKS)
    got = {r["run_id"]: r for r in gate.scored(required, checks).collect()}
    assert (got["r"]["decision"], got["r"]["not_applicable"], got["r"]["coverage_percent"], got["r"]["errors"]) == ("ready", 1, 100.0, 0)
    assert (got["s"]["decision"], got["s"]["ok"], got["s"]["errors"]) == ("revise", 2, 1)
    assert (got["t"]["decision"], got["t"]["blocking_defects"]) == ("revise", 1)


def test_required(spark):
    rules = [{"rule_id": "a", "always": True, "blocking": True}, {"rule_id": "b", "applies": {"has_reads": True}}, {"rule_id": "c"}]
    items = spark.createDataFrame([("r", "select", 1, True), ("r", "select", 2, None), ("r", "select", 2, None)], "run_id string, kind string, ordinal int, has_reads boolean")
    got = gate.required(items, rules, ["kind", "ordinal"]).collect()
    assert sorted((r["rule_id"], r["blocking"]) for r in got) == [("a", True), ("a", True), ("b", False)] and len({r["id"] for r in got}) == 3
    checks = spark.createDataFrame([("bad", False, "editorial"), (None, None, "editorial")], "defect_code string, blocking boolean, category string")
    assert sorted((r["blocking"], r["category"]) for r in gate.severity(checks, ["bad"], []).collect()) == [(False, "editorial"), (True, "technical")]


def test_greedy_match(spark):
    o = spark.createDataFrame([("r", "f", "SELECT", 1, 3), ("r", "f", "SELECT", 2, 3), ("r", "f", "SELECT", 3, 9), ("r", "f", "UPDATE", 1, 1)], "run_id string, path string, kind string, ordinal long, line long")
    p = spark.createDataFrame([("r", "f", "SELECT", "wide", 1, 1, 9), ("r", "f", "SELECT", "narrow", 2, 3, 3)], "run_id string, path string, kind string, id string, `order` int, start_line int, end_line int")
    assert {(r["kind"], r["ordinal"]): r["operation_id"] for r in gate.matched(o, p).collect()} == {("SELECT", 1): "wide", ("SELECT", 2): "narrow", ("SELECT", 3): None, ("UPDATE", 1): None}


def test_greedy_match_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    files = [(f"f{k}", [(i, rng.randrange(40)) for i in range(rng.randrange(1, 30))], [(i, a := rng.randrange(40), a + rng.randrange(9), str(i)) for i in range(rng.randrange(0, 30))]) for k in range(20)]
    o = spark.createDataFrame([("r", f, "X", i, line) for f, at, _ in files for i, line in at], "run_id string, path string, kind string, ordinal long, line long")
    p = spark.createDataFrame([("r", f, "X", n, i, a, b) for f, _, ops in files for i, a, b, n in ops], "run_id string, path string, kind string, id string, `order` int, start_line int, end_line int")
    want = {}
    for f, at, ops in files:
        free = sorted(ops)
        for i, line in at:
            k = next((k for k, x in enumerate(free) if x[1] <= line <= x[2]), None)
            want[f, i] = free.pop(k)[3] if k is not None else None
    assert {(r["path"], r["ordinal"]): r["operation_id"] for r in gate.matched(o, p).collect()} == want


def test_evidence_and_links(spark):
    h = "0" * 64
    refs = [("r", "a", None, "f", 1, 2, h), ("r", "b", None, "f", 1, 9, h), ("r", "c", None, "g", 1, 1, h), ("r", "d", None, "f", 2, 1, h), ("r", "e", None, "f", 1, 1, "1" * 64), ("r", "f", None, "f", 1, 1, "x"), ("r", "g", None, None, 1, 1, h)]
    ledger = spark.createDataFrame([("project", "f", h, 2)], "root string, path string, sha256 string, n_lines int")
    got = {r["fact_id"]: r["problem"] for r in gate.evidence_problems(spark.createDataFrame(refs, "run_id string, fact_id string, root string, path string, start_line int, end_line int, sha256 string"), ledger).collect()}
    assert got == {"b": "beyond_end", "c": "not_an_input", "d": "bad_lines", "e": "changed", "f": "bad_hash", "g": "no_path"}
    facts = {"objects": spark.createDataFrame([("r", "o")], "run_id string, id string"), "operations": spark.createDataFrame([("r", "p", ["o", "q"], None)], "run_id string, id string, reads array<string>, scope string")}
    assert [(r["field"], r["missing"]) for r in gate.dangling(facts, [("operations", "reads", "objects"), ("operations", "scope", "objects")]).collect()] == [("reads", "q")]
    parts = spark.createDataFrame([("x", "r", 2), ("x", "r", 2), ("y", "r", 2), ("y", "s", 2), ("z", None, 2), ("v", "r", 1)], "bundle string, run_id string, schema_version int").withColumn("page_id", gate.F.lit("p"))
    assert sorted(r["bundle"] for r in gate.disagreeing(parts).collect()) == ["v", "y", "z"]


def test_claims(spark):
    facts = spark.createDataFrame([("r", "c1", "bigint", None, ["a"]), ("r", "c2", "te|xt", True, [])], "run_id string, id string, type string, nullable boolean, source_refs array<string>")
    expected = gate.claims(facts)
    assert {(r["fact_id"], r["field"]): r["value"] for r in expected.collect()} == {("c1", "type"): '"bigint"', ("c2", "type"): '"te|xt"', ("c2", "nullable"): "true"}
    page = "| Claim | Field | Value |\n|---|---|---|\n| claim:c1 | type | `\"text\"` |\n| claim:c2 | type | \"te\\|xt\" |\n| claim:c9 | type | 1 |\n"
    shown = gate.page_claims(markdown.parsed(spark.createDataFrame([("r", page)], "doc string, text string"))).withColumnRenamed("doc", "run_id")
    assert {(r["fact_id"], r["field"], r["problem"]) for r in gate.claim_problems(expected, shown).collect()} == {("c1", "type", "different"), ("c2", "nullable", "missing"), ("c9", "type", "unsupported")}


def test_access_and_metrics(spark):
    uses = spark.createDataFrame([("r", "a_x_core", "a_x_raw", "read"), ("r", "a_x_core", "b_y_raw", "read"), ("r", "a_x_core", "other", "call")], "run_id string, owner_schema string, schema string, use string")
    matrix = spark.createDataFrame([("read", "same", "raw", "allowed"), ("read", "other", "raw", "denied")], "use string, kinship string, layer string, decision string")
    assert {r["schema"]: r["decision"] for r in gate.access(uses, "^([a-z]+)_([a-z]+)_([a-z]+)$", matrix).collect()} == {"a_x_raw": "allowed", "b_y_raw": "denied", "other": "unconfirmed"}
    d = spark.createDataFrame([("ready", 0, "2"), ("blocked", 3, "1")], "decision string, blocking_defects int, timestamp string")
    t = spark.createDataFrame([("publish", "committed", "p"), ("publish", "rolled_back", "p"), ("catalogue", "committed", None), ("publish", "prepared", "q")], "kind string, state string, page_id string")
    m = spark.createDataFrame([(None, "ready"), (False, "ready"), (None, "revise"), (None, "blocked")], "false_ready boolean, decision string")
    r = gate.metrics(d, t, m).first()
    assert (r["ready"], r["blocked"], r["first"], r["ready_blocking"], r["publishes"], r["mean_iterations"], r["error_rate"]) == (1, 1, "2", 0, 2, 2.0, 0.25)  # only a ready decision says when the first was ready
    lists = spark.createDataFrame([("ready", ["a", "b"], None, "9"), ("ready", None, "", "8"), ("ready", [], "7x", None), ("revise", ["c"], "1", "1")], "decision string, blocking_defects array<string>, timestamp string, generated_at string")
    r = gate.metrics(lists, t, m).first()
    assert (r["ready"], r["first"], r["ready_blocking"]) == (3, "7x", 2)
    runs = spark.createDataFrame([("s", 1, "h", "ready", []), ("s", 2, "h", "ready", []), ("t", 1, "h", "ready", []), ("t", 2, "i", "ready", [])], "subject string, repeat int, facts_sha256 string, decision string, errors array<string>")
    assert {r["subject"]: r["variants"] for r in gate.repeated_subjects(runs).collect()} == {"s": 1, "t": 2}
