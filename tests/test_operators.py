import pytest
from lodestone.operators import ddl, graph, rules
from lodestone.sources import sql_text
from pyspark.sql import functions as F

EDGES = [("producer", "input", "read", []), ("producer", "output", "write", []), ("reader", "output", "read", []), ("caller", "reader", "call", []), ("reader", "caller", "call", []), ("possible", None, "call", ["caller"])]


def edges(spark):
    rows = [(a, b, k, c, i) for i, (a, b, k, c) in enumerate(EDGES)]
    return spark.createDataFrame(rows, "`from` string, `to` string, kind string, candidates array<string>, ordinal long")


def test_downstream_closure(spark):
    seed = spark.createDataFrame([("input",)], "seed string")
    got = {(r["node"], r["possible"]): r for r in graph.closure(spark, edges(spark), seed).collect()}
    assert {k: r["depth"] for k, r in got.items()} == {("producer", False): 1, ("output", False): 2, ("reader", False): 3, ("caller", False): 4, ("possible", True): 5}
    assert got["reader", False]["via"] == "output"
    assert graph.closure(spark, edges(spark), seed, max_depth=1).count() == 1 and graph.closure(spark, edges(spark), seed, max_depth=0).count() == 0


def walked(edges, seed, direction, depth):
    """First discoveries by a queue, edges in their order."""
    out, seen, queue = {}, {(seed, False)}, [(seed, False, 0)]
    for node, maybe, d in queue:
        if d >= depth:
            continue
        for a, b, kind, candidates, n in edges:
            hops = []
            if direction == "upstream":
                hops += [(b, False)] if a == node else []
            else:
                hops += [(a, False)] if b == node else [(a, True)] if node in candidates else []
                hops += [(b, False)] if a == node and kind == "write" else []
            for to, possible in hops:
                state = (to, maybe or possible)
                if to == seed or state in seen:
                    continue
                seen.add(state)
                out[state] = (d + 1, node, kind, n)
                queue.append((*state, d + 1))
    return out


@pytest.mark.parametrize("direction", ["downstream", "upstream"])
def test_closure_equals_a_queue(spark, direction):
    """via, relation, ordinal and the sticky flag, on random cyclic graphs."""
    import random

    rng = random.Random(4)
    for depth in (2, 32):
        edges_ = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.choice(["read", "write", "call"]), [f"n{rng.randrange(12)}"] if rng.random() < 0.3 else [], i) for i in range(24)]
        df = spark.createDataFrame(edges_, "`from` string, `to` string, kind string, candidates array<string>, ordinal long")
        seeds = ["n0", "n1", "n2"]
        got = {(r["seed"], r["node"], r["possible"]): (r["depth"], r["via"], r["relation"], r["ordinal"]) for r in graph.closure(spark, df, spark.createDataFrame([(s,) for s in seeds], "seed string"), direction, depth).collect()}
        assert got == {(s, *k): v for s in seeds for k, v in walked(edges_, s, direction, depth).items()}


def test_one_hop(spark):
    d = {r["node"]: r for r in graph.dependencies(edges(spark)).collect()}
    assert d["producer"]["reads"] == ["input"] and d["producer"]["writes"] == ["output"]
    c = {r["node"]: r for r in graph.consumers(edges(spark)).collect()}
    assert c["caller"]["possible_consumers"] == ["possible"] and c["output"]["read_by"] == ["reader"]


def test_fixpoint(spark):
    facts = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "e")], "id string, ref string")
    assert sorted(r["id"] for r in graph.required_facts(spark, facts, spark.createDataFrame([("a",)], "id string")).collect()) == ["a", "b", "c"]


def test_predicates(spark):
    df = spark.createDataFrame([("table", 3, True, None), ("view", 0, False, "x"), (None, None, None, None)], "kind string, n int, flag boolean, note string")
    keep = lambda c: [r["kind"] for r in df.where(rules.predicate(c)).collect()]
    assert keep({"kind": ["table", "x"]}) == ["table"] and keep({"n_gte": 1}) == ["table"] and keep({"flag": False}) == ["view", None]
    assert keep({"_or": [{"n_gte": 1}, {"note": "x"}]}) == ["table", "view"] and keep({"note": None}) == ["table", None] and len(keep({})) == 3


@pytest.mark.parametrize("row, want", [((85, 15, 0, 0), "ready"), ((84, 16, 0, 0), "revise"), ((9, 0, 1, 1), "blocked"), ((9, 0, 1, 0), "revise"), ((0, 0, 0, 0), "revise"), ((99, 1, 0, 1), "revise")])
def test_decision(spark, row, want):
    df = spark.createDataFrame([row], "ok int, defect int, unknown int, blocking int")
    assert df.select(rules.decision(F.col("ok"), F.col("defect"), F.col("unknown"), F.col("blocking"))).first()[0] == want


def test_lexer():
    text = "select 'a;--' /* x /* y */ z */, \"q;\" -- c\nfrom t where a = E'\\';' and $f$ ; $f$"
    code, bodies, issues = sql_text.masked(text)
    assert len(code) == len(text) and code.count("\n") == 1 and ";" not in code and not issues and text[slice(*bodies[0])] == " ; "
    assert sql_text.masked("'x")[2] == ["unterminated string"]
    assert sql_text.parts("a, f(b, c), 'd,e'") == ["a", "f(b, c)", "'d,e'"] and sql_text.parts("") == [""]
    with pytest.raises(ValueError):
        sql_text.parts("a)")
    assert sql_text.expression_key("SUM( a )  + 'X'") == sql_text.expression_key("sum(A)+'X'") != sql_text.expression_key("sum(a)+'x'")


def test_ddl_fold(spark):
    rows = [
        ("p", 2, "alter table s.t add column note text not null default 'x', alter column amount type numeric(18,4); alter table s.t rename column old to updated_on"),
        ("p", 1, "create table s.t (id bigint primary key, amount numeric(12,2), old date, gone text); alter table s.t drop column gone"),
        ("q", 1, "create table a (x int)"), ("q", 2, "do something odd; create table b (y int)"), ("r", 1, "create table a (x int)"), ("r", 2, "create table a (x int)"),
        ("s", 1, 'create table a ("X y" int); alter table a rename column "X y" to z; alter table a rename to b'), ("t", 1, "create table a (x int); insert into a values (1)"), ("u", None, "create table a (x int)"),
    ]
    got = ddl.rebuilt(spark.createDataFrame(rows, "project string, position int, sql string")).collect()
    p = sorted((r["position"], r["column"], r["type"], r["not_null"], r["default"]) for r in got if r["project"] == "p")
    assert p == [(1, "id", "bigint", True, None), (2, "amount", "numeric(18,4)", False, None), (3, "updated_on", "date", False, None), (4, "note", "text", True, "'x'")]
    of = lambda x: [(r["status"], r["table"], r["column"]) for r in got if r["project"] == x]
    assert of("q") == [("unsupported", "a", "x")] and of("r") == [("unsupported", "a", "x")] and of("s") == [("resolved", "b", "z")] and of("t") == [("unsupported", None, None)] and of("u") == [("ambiguous", None, None)]


def test_inventory(spark):
    sql = "insert into a.b select 1;\n\nselect ';';\nwith x as (select 1) select * from x;\ncreate or replace view v as select 1"
    got = [(r["line"], r["kind"], r["ordinal"], r["target"]) for r in ddl.inventoried(spark.createDataFrame([("f", sql)], "path string, sql string")).collect()]
    assert got == [(1, "INSERT", 1, "a.b"), (3, "SELECT", 1, None), (4, "SELECT", 2, None), (5, "CREATE", 1, "v")]
