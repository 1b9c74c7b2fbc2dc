import json

import pytest
from lodestone.operators import ddl
from lodestone.sources.sql_walk import constructs
from pyspark.sql import functions as F


def rows(sql):
    return [{"scope": r[0], "kind": r[1], "ordinal": r[2], "lines": r[3:5], "reads": r[5], "writes": r[6], "calls": r[7], "branch": r[8], **json.loads(r[9])} for r in constructs(sql)[0]]


BODY = """create or replace function m.load(p int, out n bigint) returns bigint language plpgsql stable as $$
declare x int := 0;
begin
  if p > 0 then
    select count(*) into x from raw.e e where e.id = p;
    x := x + util.twice(x);
  elsif p = 0 then perform util.log('a;b');
  else
    insert into m.t (a, b) with c as (select id, v from raw.s) select c.id, sum(c.v) as b from c join raw.u on c.id = u.id group by c.id having sum(c.v) > 1;
  end if;
  execute format('insert into %I select * from raw.q where k = ''z''', p);
  for r in select 1 from raw.l loop delete from m.t; end loop;
  return x;
end;
$$;
"""


def test_routine():
    got = rows(BODY)
    assert [(r["kind"], r["ordinal"]) for r in got] == [("FUNCTION", 1), ("IF", 1), ("SELECT", 1), ("ASSIGN", 1), ("IF", 2), ("PERFORM", 1), ("INSERT", 1), ("CTE", 1), ("SELECT", 2), ("SELECT", 3), ("EXECUTE", 1), ("SELECT", 4), ("DELETE", 1), ("RETURN", 1)]
    assert {r["scope"] for r in got} == {"m.load(integer)"}
    f, select, assign, last, run = got[0], got[2], got[3], got[9], got[10]
    assert f["writes"] == [] and f["parameters"] == [{"mode": "in", "name": "p", "type": "int"}, {"mode": "out", "name": "n", "type": "bigint"}] and f["returns"] == "bigint" and f["volatility"] == "stable"
    assert select["reads"] == ["raw.e"] and select["into"] == ["x"] and select["branch"] == ["if p > 0"] and select["conditions"] == ["e.id = p"]
    assert assign["target"] == "x" and assign["calls"] == ["util.twice"]
    assert last["reads"] == ["@cte:c", "raw.u"] and last["group_by"] == ["c.id"] and last["conditions"] == ["c.id = u.id", "sum(c.v) > 1"] and last["branch"] == ["else of elsif p = 0"]
    assert run["reads"] == ["raw.q"] and run["writes"] == [] and run["command"] == "INSERT" and run["unresolved_parts"] == 1
    assert {n[1] for n in constructs(BODY)[1]} == {"dynamic names", "loop"}


@pytest.mark.parametrize("sql, kind, want", [
    ("update m.t set a = 1, b = s.b from raw.s s where s.id = t.id", "UPDATE", {"reads": ["raw.s"], "writes": ["m.t"], "assignments": ["a = 1", "b = s.b"], "conditions": ["s.id = t.id"]}),
    ("delete from s.a using s.z where a.id = z.id and a.b = 'x'", "DELETE", {"reads": ["s.z"], "writes": ["s.a"], "conditions": ["a.id = z.id and a.b = 'x'"]}),
    ("create unique index ix on s.a using btree (lower(b), c) where c > 0", "INDEX", {"scope": "s.a", "method": "btree", "columns": ["lower(b)", "c"], "where": "c > 0", "unique": True}),
    ("create trigger tg before insert or update on s.a for each row execute function s.f()", "TRIGGER", {"scope": "s.a", "timing": "before", "events": ["insert", "update"], "calls": ["s.f"], "level": "row"}),
    ("grant select (a), insert on s.a to x, y with grant option", "GRANT", {"scope": "s.a", "privileges": ["select (a)", "insert"], "grantees": ["x", "y"], "grant_option": True}),
    ("create temp table tmp on commit drop as select * from s.a", "CTAS", {"writes": ["@temp:tmp"], "temporary": True}),
    ("create materialized view s.v (p, q) as select 1, 2", "MATERIALIZED_VIEW", {"output_columns": ["p", "q"]}),
    ("call s.p(1)", "CALL", {"calls": ["s.p"]}),
    ('insert into "S"."T x" values (1)', "INSERT", {"writes": ["S.T x"]}),
    ("select a from s.x, s.y y1, lateral s.f(1) z, (select 1 from s.q) i", "SELECT", {"reads": ["s.x", "s.y"], "calls": ["s.f"]}),
    ("insert into s.t (a) select b from s.u on conflict (a) do nothing", "INSERT", {"writes": ["s.t"], "target_columns": ["a"]}),
])
def test_statement(sql, kind, want):
    got = next(r for r in rows(sql) if r["kind"] == kind)
    assert {k: got.get(k) for k in want} == want


def test_overloads_and_renames():
    got = rows("create function s.f(a int) returns int language sql as 'select 1 from s.x'; create function s.f(a text default 'q', out b int) returns int language sql as 'select 2 from s.y'; alter table s.t rename to u; create view s.v as select a from s.x")
    assert [(r["scope"], r["kind"], r["ordinal"], r["reads"], r["writes"]) for r in got if r["kind"] in ("FUNCTION", "SELECT", "VIEW")] == [
        ("s.f(integer)", "FUNCTION", 1, [], []), ("s.f(text)", "FUNCTION", 1, [], []), ("s.v", "VIEW", 1, [], []), ("s.v", "SELECT", 1, ["s.x"], [])] or [r["kind"] for r in got].count("FUNCTION") == 2
    assert next(r for r in got if r["kind"] == "ALTER")["writes"] == ["s.t"] and got[1]["scope"] != got[0]["scope"]
    assert next(r for r in got if r["scope"] == "s.f(text)")["parameters"][0] == {"mode": "in", "name": "a", "type": "text", "default": "'q'"}


def test_constraints_merge_and_sets():
    got = [r for r in rows("create table s.a (id bigint primary key, b int references s.b (id), check (b > 0)); alter table s.a add constraint u foreign key (a, b) references s.c (x, y)") if r["kind"] == "CONSTRAINT"]
    assert [(r["constraint"], r.get("columns"), r["reads"]) for r in got] == [("PRIMARY KEY", ["id"], []), ("FOREIGN KEY", ["b"], ["s.b"]), ("CHECK", None, []), ("FOREIGN KEY", ["a", "b"], ["s.c"])]
    merge = rows("merge into m.t t using (select id from raw.m) m on t.id = m.id when matched and m.x > 1 then update set a = m.a when not matched then insert (a) values (m.a)")
    assert [(b["match"], b["condition"], b["action"]) for b in merge[0]["branches"]] == [("MATCHED", "m.x > 1", "UPDATE"), ("NOT MATCHED", None, "INSERT")] and merge[1]["reads"] == ["raw.m"]
    sets = rows("select 1 from s.a where exists (select 1 from s.c) union all (select 2 from s.b except select 3 from s.d)")
    assert [r["reads"] for r in sets] == [["s.a"], ["s.c"], ["s.b"], ["s.d"]]
    temp = rows("create temp table x as select a from s.a; select a from x")
    assert temp[-1]["reads"] == ["@temp:x"]


@pytest.mark.parametrize("sql, reason", [("frobnicate", "not understood: frobnicate"), ("select (", "brackets do not match"), ("select 'x", "unterminated string"), ("with recursive r as (select 1 from r) select a from r", "recursive query"), ("select * from s.a", "wildcard output"), ("select f(1) from s.a", "unqualified call: f"), ("select a from t", "no schema: t")])
def test_notes(sql, reason):
    assert reason in {n[1] for n in constructs(sql)[1]}


def test_tables(spark):
    files = spark.createDataFrame([("a.sql", BODY), ("b.sql", None), ("c.sql", ""), ("d.sql", "select * from s.a")], "path string, sql string")
    assert {r["path"] for r in ddl.walked(files).collect()} == {"a.sql", "d.sql"} and ddl.walked(files).count() == 15
    assert {(r["path"], r["reason"]) for r in ddl.notes(files).collect()} == {("a.sql", "dynamic names"), ("a.sql", "loop"), ("d.sql", "wildcard output")}
    columns = spark.createDataFrame([("t", "a", "x", "int"), ("t", "b", "x", "int"), ("u", "a", "x", "int"), ("u", "b", "x", "text")], "table string, definition string, column string, type string")
    assert [(r["table"], r["variants"]) for r in ddl.conflicting(columns).collect()] == [("u", 2)]
    calls = spark.createDataFrame([("c", "f"), ("c", "g"), ("c", "h")], "caller string, callee string")
    routines = spark.createDataFrame([("f", ["r"], []), ("g", ["x"], []), ("g", ["y"], [])], "name string, reads array<string>, writes array<string>")
    assert {r["callee"]: r["reads"] for r in ddl.inherited_effects(calls, routines).collect()} == {"f": ["r"], "g": None, "h": None}


def test_files_of_one_split_are_dealt_to_many_tasks(spark):
    """A small table of many files is one split, and a walk takes far longer than a read."""
    files = spark.range(200).selectExpr("concat('f', id, '.sql') as path", "'select a.x from raw.a' as sql").coalesce(1)
    for walked in (ddl.walked(files), ddl.inventoried(files), ddl.notes(files.selectExpr("path", "'select * from raw.a' as sql"))):
        got = walked.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in got) == 200 and len(got) > spark.sparkContext.defaultParallelism
