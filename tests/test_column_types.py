import pytest
from lodestone.operators import column_types as typing
from lodestone.operators import evaluation


@pytest.mark.parametrize("expression, want", [
    ("cast(a as numeric(3, 1))", ("cast", "numeric(3,1)", None)), ("a + b::int8", ("cast", "bigint", None)), ("now()", ("call", "timestamp with time zone", None)), ("COUNT(*)", ("call", "bigint", None)),
    ("sum(x)", ("call", None, None)), ("A", ("column", None, "a")), ('t."B"', ("column", "t", "B")), ("s.t.c", ("column", "s.t", "c")), ("a + 1", ("other", None, None)), ("f(a) + f(b)", ("other", None, None)), ("'x'", ("other", None, None)), ("", ("other", None, None)),
])
def test_shapes(expression, want):
    assert typing.shape(expression) == want


def test_inferred(spark):
    columns = spark.createDataFrame([("s.t", "id", "bigint"), ("s.t", "v", "text"), ("s.u", "id", "bigint"), ("s.u", "v", "date")], "table string, column string, type string")
    variables = spark.createDataFrame([("f", "g", "p", "integer")], "path string, scope string, name string, type string")
    relations = [("t", "s.t"), ("u", "s.u")]
    rows = [("f", "g", i, x, relations if i < 9 else []) for i, x in enumerate(["id", "v", "u.v", "s.t.v", "p", "x.v", "now()", "id::date", "id + 1", "id"])]
    df = spark.createDataFrame(rows, "path string, scope string, id long, expression string, relations array<struct<alias string, table string>>")
    got = {r["id"]: r["type"] for r in typing.inferred(df, columns, variables).collect()}
    assert got == {0: "bigint", 1: None, 2: "date", 3: "text", 4: "integer", 5: None, 6: "timestamp with time zone", 7: "date", 8: None, 9: None}


def test_mappings(spark):
    fills = spark.createDataFrame([("f", "g", 1, "s.t", ["id", "v", "z"], ["a", "b"]), ("f", "g", 2, "s.t", [], ["a"]), ("f", "g", 3, "s.x", ["q"], ["a"])], "path string, scope string, id long, target string, columns array<string>, expressions array<string>")
    maps = typing.mapped(fills)
    assert sorted((r["id"], r["position"], r["column"], r["expression"]) for r in maps.collect()) == [(1, 1, "id", "a"), (1, 2, "v", "b"), (3, 1, "q", "a")]
    columns = spark.createDataFrame([("s.t", "id", "bigint"), ("s.t", "w", "text")], "table string, column string, type string")
    types = spark.createDataFrame([("f", "g", 1, 1, "date")], "path string, scope string, id long, position int, type string")
    assert sorted((r["position"], r["problem"]) for r in typing.type_problems(maps.where("position = 1 or column = 'q'"), types, columns).collect()) == [(1, "type_mismatch")]
    shown = spark.createDataFrame([("s.t", "id"), ("s.t", "v")], "table string, column string")
    assert [(r["missing"], r["unknown"]) for r in typing.complete(shown, columns).collect()] == [(["w"], ["v"])]


INVENTORY = "run_id string, path string, scope string, construct string, ordinal int, start_line int, reads array<string>, writes array<string>, calls array<string>, formulas array<string>, conditions array<string>, source string"
OPERATIONS = "run_id string, path string, kind string, id string, `order` int, start_line int, end_line int, reads array<string>, writes array<string>, calls array<string>"


def test_whole_gate(spark):
    inventory = spark.createDataFrame([("r", "f", "g", "INSERT", 1, 2, ["a"], ["b"], [], [], [], "insert"), ("r", "f", "g", "SELECT", 1, 3, ["a", "a"], [], [], ["x+1"], ["d > date '2020-01-01'"], "select d > DATE '2020'"), ("s", "f", "v", "VIEW", 1, 1, [], [], [], [], [], "")], INVENTORY)
    f = {r["run_id"]: r for r in evaluation.flags(inventory).collect()}
    assert (f["r"]["has_reads"], f["r"]["has_calls"], f["r"]["has_formulas"], f["r"]["has_date_boundary"], f["r"]["object_kind"]) == (True, False, True, True, "function") and f["s"]["object_kind"] == "view" and not f["s"]["has_reads"]
    operations = spark.createDataFrame([("r", "f", "INSERT", "o1", 1, 1, 2, ["a"], ["b"], []), ("r", "f", "SELECT", "o2", 2, 3, 3, ["a", "c"], [], []), ("r", "f", "DELETE", "o3", 3, 3, 3, [], [], [])], OPERATIONS)
    problems = evaluation.fact_problems(inventory, operations)
    assert sorted((r["run_id"], r["subject"], r["problem"]) for r in problems.collect()) == [("r", "o2", "reads_differ"), ("r", "o3", "no_construct"), ("s", "f:VIEW:1", "no_operation")]
    sql = spark.createDataFrame([("r", "Sum(a) + 1"), ("r", "b"), ("r", None)], "run_id string, expression string")
    facts = spark.createDataFrame([("r", "sum( A )+1"), ("r", "c")], "run_id string, expression string")
    assert sorted((r["expression"], r["problem"]) for r in evaluation.expression_problems(sql, facts).collect()) == [("b", "no_fact"), ("c", "no_sql")]
    required = spark.createDataFrame([("r", "a", False), ("t", "a", False)], "run_id string, id string, blocking boolean")
    checks = spark.createDataFrame([("r", "a", "ok", False), ("t", "a", "ok", False)], "run_id string, plan_check_id string, status string, blocking boolean")
    got = {r["run_id"]: (r["facts"], r["problems"], r["decision"]) for r in evaluation.evaluated(required, checks, {"facts": problems}).collect()}
    assert got == {"r": (2, 2, "revise"), "s": (1, 1, "revise"), "t": (0, 0, "ready")}


def test_policy_and_plan(spark):
    rules = [{"rule_id": "a", "always": True}, {"rule_id": "a"}, {"source": "x", "category": "y"}]
    policy = {"rules": rules, "groups": {"g": ["a", "b"]}, "always_blocking": ["c"], "editorial": ["c"]}
    assert evaluation.policy_problems(policy) == ["rule 2 has no id", "rule a stands more than once", "rule None has the source x", "rule None has the category y", "group g names b, which is no rule", "code c is editorial and blocks"]
    assert evaluation.policy_problems({"rules": [{"rule_id": "a"}]}) == []
    items = spark.createDataFrame([("r", "select", 1)], "run_id string, kind string, ordinal int")
    gaps = spark.createDataFrame([("r", "f", 3, "loop"), ("r", "f", 3, "loop")], "run_id string, path string, line int, reason string")
    profiles = evaluation.active_profiles(spark.createDataFrame([("r", "core_x"), ("r", "core_y"), ("s", "z")], "run_id string, identifier string"), spark.createDataFrame([("p", "core_"), ("q", None)], "profile string, prefix string"))
    got = evaluation.plan(items, rules[:1], ["kind", "ordinal"], gaps, profiles).collect()
    assert sorted((r["run_id"], r["source"], r["blocking"]) for r in got) == [("r", "gap", True), ("r", "profile", True), ("r", "section", False)]


def test_reports(spark):
    issues = spark.createDataFrame([("broken_link", "a"), ("broken_anchor", "a"), ("unlisted_page", "a"), ("broken_link", "b")], "code string, file string")
    assert {r["file"]: (r["broken_link"], r["broken"]) for r in evaluation.broken_links(issues).collect()} == {"a": (1, 2), "b": (1, 1)}
    assert [r["at"] for r in evaluation.decided_at(spark.createDataFrame([(None, "b", "c"), (None, None, None)], "timestamp string, generated_at string, issued_at string")).collect()] == ["b", None]
    stats = evaluation.cache_statistics(spark.createDataFrame([("a", 1048576 + 5243), ("b", 0)], "key string, bytes long")).first()
    assert (stats["entries"], stats["megabytes"]) == (2, 1.0)
    rows = spark.createDataFrame([("p", "b", 2, "two"), ("p", "b", 10, "ten"), ("p", "a", 1, "x")], "page string, section string, ordinal int, line string")
    assert evaluation.rendered(rows).first()["markdown"] == "## a\n\nx\n\n## b\n\ntwo\nten"
    import hashlib

    files = [(f"m/{hashlib.sha256(b'p').hexdigest()}.json", "p"), ("m/x.json", "p"), ("m/y.json", None)]
    assert sorted(r["problem"] for r in evaluation.mixed_metadata(spark.createDataFrame(files, "file string, page_id string")).collect()) == ["no_page", "other_name"]


def test_flags_as_policies_use_them(spark):
    kind = "run_id string, path string, construct string, ordinal int, start_line int, reads array<string>, writes array<string>, calls array<string>, formulas array<string>, conditions array<string>, source string, object_kind string, dynamic boolean, constraints array<string>, returns_table boolean"

    def item(run, construct, line=1, reads=(), declared=None, **more):
        return (run, "f", construct, 1, line, list(reads), [], [], [], None, "", declared, more.get("dynamic"), more.get("constraints"), more.get("returns_table"))

    rows = [
        item("a", "FUNCTION", 1), item("a", "VIEW", 2), item("a", "CTAS", 3, ["x", "y"]), item("a", "SELECT", 4, ["y", "z"]),
        item("b", "CTAS", 2), item("b", "MATERIALIZED_VIEW", 9), item("c", "CTAS", 5), item("c", "PROCEDURE", 1),
        item("d", "SELECT", 1), item("d", "PROCEDURE", 3), item("d", "FUNCTION", 2), item("e", "PROCEDURE", 2), item("e", "SELECT", 1, declared="migration"),
        item("f", "EXECUTE", dynamic=True), item("f", "TRIGGER", constraints=["pk"]), item("f", "INDEX", returns_table=True), item("f", "REVOKE"), item("g", "SELECT"),
    ]
    df = spark.createDataFrame(rows, kind)
    got = {r["run_id"]: r.asDict() for r in evaluation.flags(df).collect()}
    assert {k: r["object_kind"] for k, r in got.items()} == {"a": "view", "b": "materialized_view", "c": "ctas", "d": "function", "e": "migration", "f": "function", "g": "function"}
    assert got["a"]["source_count"] == 3 and got["g"]["source_count"] == 0
    names = ("has_dynamic_sql", "has_unknowns", "has_triggers", "has_indexes", "has_constraints", "has_access_rules", "returns_table")
    assert all(got["f"][n] for n in names) and not any(got["g"][n] for n in names)
    few = evaluation.flags(df.drop("object_kind", "dynamic", "constraints", "returns_table", "start_line", "ordinal"))
    assert few.count() == 7 and set(few.columns) == set(got["a"])


def test_many_prefixes(spark):
    import random

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    prefixes = {(f"p{rng.randrange(9)}", word(rng.randrange(0, 17))) for _ in range(20_000)} | {("none", None)}
    names = [(f"r{i % 50}", word(rng.randrange(25))) for i in range(400)] + [("r0", None)]
    ids, profiles = spark.createDataFrame(names, "run_id string, identifier string"), spark.createDataFrame(list(prefixes), "profile string, prefix string")
    want = {(r, p) for r, x in names if x is not None for p, y in prefixes if y is not None and x.startswith(y)}
    out = evaluation.active_profiles(ids, profiles)
    assert {(r["run_id"], r["profile"]) for r in out.collect()} == want
    longest = {x: max((y for _, y in prefixes if y is not None and x.startswith(y)), key=len, default=None) for _, x in names if x is not None}
    assert {r["identifier"]: r["prefix"] for r in evaluation.longest_prefix(ids, profiles).collect()} == {k: v for k, v in longest.items() if v is not None}
    size = lambda df: len(df._jdf.queryExecution().analyzed().toString())
    few = evaluation.active_profiles(ids, profiles.limit(10_000).limit(3))
    assert abs(size(out) - size(few)) < 500  # the plan does not grow with the prefixes
    assert evaluation.active_profiles(ids, profiles.limit(0)).count() == 0


def test_columns_as_of_a_place_equal_brute_force(spark):
    import random

    rng = random.Random(9)
    changes = [(f"t{rng.randrange(3)}", f"c{rng.randrange(5)}", rng.randrange(40), rng.choice(["int", "text", None])) for _ in range(60)]
    uses = [("p", "s", i, rng.randrange(-1, 45), f"t{rng.randrange(4)}", ["c0", f"c{rng.randrange(7)}"], ["x", "y", "z"], [(f"c{rng.randrange(6)}", "e")] if i % 3 == 0 else None) for i in range(300)]
    uses += [("p", "s", 900, 5, "t0", [], ["x"], None), ("p", "s", 901, 5, "t0", None, None, [])]
    statements = spark.createDataFrame(uses, "path string, scope string, id long, at long, target string, columns array<string>, expressions array<string>, sets array<struct<column: string, expression: string>>")
    maps = typing.assigned(statements)
    rows = [(r["id"], r["at"], r["target"], r["position"], r["column"]) for r in maps.collect()]
    assert len(rows) == 2 * 300 + 100
    given = {(i, p): rng.choice(["int", "text", None]) for i, _, _, p, _ in rows}
    types = spark.createDataFrame([("p", "s", i, p, t) for (i, p), t in given.items()], "path string, scope string, id long, position int, type string")

    def at(table, column, place):
        own = sorted({c[2] for c in changes if c[:2] == (table, column) and c[2] <= place})
        return max((c[3] for c in changes if c[:3] == (table, column, own[-1]) and c[3]), default=None) if own else None

    want = set()
    for i, place, table, p, column in rows:
        if not any(c[0] == table and c[3] and c[2] <= place for c in changes):
            continue
        kind = at(table, column, place)
        if kind is None:
            want.add((i, p, column, "dropped_column" if any(c[:2] == (table, column) and c[3] and c[2] <= place for c in changes) else "unknown_column"))
        elif given[i, p] and given[i, p] != kind:
            want.add((i, p, column, "type_mismatch"))
    df = spark.createDataFrame(changes, "table string, column string, at long, type string")
    got = {(r["id"], r["position"], r["column"], r["problem"]) for r in typing.problems_at(maps, types, df).collect()}
    assert got == want and {x[3] for x in want} == {"dropped_column", "unknown_column", "type_mismatch"}
    assert typing.problems_at(maps, types, df.limit(0)).count() == 0


def test_types_that_statements_bring_need_no_join(spark):
    kind = "path string, scope string, id long, at long, target string, columns array<string>, expressions array<string>, types array<string>, sets array<struct<column:string,expression:string,type:string>>"
    rows = spark.createDataFrame([("f", "s", 1, 5, "t", ["a", "b", "gone"], ["x", "y", "z"], ["text", None], []), ("f", "s", 2, 5, "t", ["a"], ["x"], None, [("b", "y", "text"), ("c", "z", "text")])], kind)
    changes = spark.createDataFrame([("t", "a", 1, "integer"), ("t", "b", 1, "integer"), ("t", "gone", 1, "text"), ("t", "gone", 4, None)], "table string, column string, at long, type string")
    maps = typing.assigned(rows)
    brought = typing.problems_at(maps, None, changes)
    want = {(1, 1, "a", "type_mismatch"), (1, 3, "gone", "dropped_column"), (2, 1, "b", "type_mismatch"), (2, 2, "c", "unknown_column")}
    assert {(r["id"], r["position"], r["column"], r["problem"]) for r in brought.collect()} == want and brought.count() == 4
    plan = brought._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan  # uses stay where they are


def test_uses_are_not_shuffled_for_small_histories_of_large_tables(spark, tmp_path):
    """Of a table that is too large for a broadcast come histories that are small: only when written does the planner know."""
    spark.range(300_000).selectExpr("'t' as table", "concat('c', id % 3) as column", "id % 50 as at", "'text' as type", "sha2(cast(id as string), 256) as more").write.parquet(f"{tmp_path}/t")
    changes = spark.read.parquet(f"{tmp_path}/t").where("length(more) = 64")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        uses = spark.range(100).selectExpr("'t' as table", "concat('c', id % 4) as column", "id as at")
        out = typing.as_of(uses, changes.drop("more"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and out.where("present").count() == 75
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
