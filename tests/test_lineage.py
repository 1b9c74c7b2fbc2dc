import pytest
from lodestone.functions import identity
from lodestone.operators import lineage
from pyspark.sql import functions as F


@pytest.mark.parametrize("given, want", [
    ("INT8", "bigint"), ("varchar ( 16 )", "character varying(16)"), ("timestamptz", "timestamp with time zone"), ("timestamp(3) with time zone", "timestamp with time zone(3)"),
    ("float(24)", "real"), ("float(25)", "double precision"), ("Double  Precision", "double precision"), ("numeric(18, 4)", "numeric(18,4)"), ('"char"', "pg_catalog.char"), ("pg_catalog.int4", "integer"), ('"pg_catalog"."bool"[]', "boolean[]"), ('pg_catalog.varchar(3)', "character varying(3)"), ('"MyType"', '"MyType"'), ('S."T"', 's."T"'), ("pg_catalog.other", "pg_catalog.other"), ('"int"', "int"), ("int[3][]", "integer[3][]"), ("s.my_type", "s.my_type"),
])
def test_types(given, want):
    assert identity.type_name(given) == want


def test_arguments():
    assert identity.argument_types("") == []
    assert identity.argument_types("a int, INOUT b varchar(3) default 'x,y', out c text, variadic d int[], double precision, timestamp with time zone, e timestamp with time zone, int[]") == [
        "integer", "character varying", "integer[]", "double precision", "timestamp with time zone", "timestamp with time zone", "integer[]"]
    with pytest.raises(ValueError):
        identity.type_name("float(99)")
    for known in ("pg_catalog.int8", '"text"', "s.mine", "jsonb", "time with time zone", "regclass", "timestamptz(3)", "varchar(3)[]"):
        assert "(" not in identity.type_name(known, for_identity=True)
    for unknown in ("mine", '"Mine"', "mine[]"):
        assert identity.type_name(unknown) and pytest.raises(ValueError, identity.type_name, unknown, for_identity=True)


def test_keys_and_names(spark):
    rows = spark.createDataFrame([("s", "f+g", "a int, b text"), ("s", "h", None), ("s", "i", "float(99)")], "schema string, name string, args string")
    got = [r[0] for r in rows.select(identity.routine_key(F.lit("function"), F.col("schema"), F.col("name"), F.col("args"))).collect()]
    assert got == ["function+s+f%2Bg(integer,text)", None, None]
    # a short start makes hashes meet: names grow until they differ
    keys = spark.createDataFrame([("k" + "-" * (i % 3) + "!" * i,) for i in range(200)] + [(None,), ("k",)], "key string")
    named = identity.page_names(keys, first=1).collect()
    names = {r["key"]: r["page_name"] for r in named if r["key"]}
    assert len(named) == 202 and len(set(names.values())) == len(names) and all(n.startswith("k--") for n in names.values()) and [r for r in named if r["key"] is None][0]["page_name"] is None
    import hashlib

    digest = {k: hashlib.sha256(k.encode()).hexdigest() for k in names}
    for k, n in names.items():
        start = n[3:-3]
        assert digest[k].startswith(start) and sum(d.startswith(start) for d in digest.values()) == 1
        assert len(start) == 1 or sum(d.startswith(start[:-1]) for d in digest.values()) > 1


OBJECTS = "run_id string, page_id string, id string, kind string, schema string, name string, signature string, key string, scope string"
OPERATIONS = "run_id string, page_id string, id string, `order` int, kind string, reads array<string>, writes array<string>, calls array<string>, dynamic boolean"


@pytest.fixture(scope="module")
def facts(spark):
    o = [
        ("r1", "p1", "o1", "function", "s", "f", "()", "function+s+f()", None), ("r1", None, "o2", "table", "s", "t", None, "table+s+t", None), ("r1", None, "o3", "cte", None, "c", None, "@cte:c", "s.f"),
        ("r1", None, "o4", "table", "x", "gone", None, "table+x+gone", None), ("r1", None, "o5", "table", None, "t", None, None, None), ("r1", None, "o6", "table", "s", "v", None, "table+s+v", None),
        ("r2", "p2", "o1", "table", "s", "t", None, "table+s+t", None), ("r3", "p3", "o1", "view", "s", "v", None, "view+s+v", None),
    ]
    p = [("r1", "p1", "a", 1, "INSERT", ["o2", "o3", "o5"], ["o4"], [], False), ("r1", "p1", "b", 2, "EXECUTE", ["o6"], [], ["o9"], True), ("r3", "p3", "a", 1, "SELECT", ["o1"], [], [], False)]
    return spark.createDataFrame(o, OBJECTS), spark.createDataFrame(p, OPERATIONS)


def test_graph(spark, facts):
    objects, operations = facts
    got = {(r["from"], r["to"], r["kind"]): (r["resolution"], r["candidates"]) for r in lineage.edges(objects, operations).collect()}
    f = "function+s+f()"
    assert got == {
        (f, "table+s+t", "read"): ("published", []), (f, "@cte:c", "read"): ("scoped", []), (f, "@external:%5B%22table%22%2Cnull%2C%22t%22%2Cnull%5D", "read"): ("unresolved", []),
        (f, "table+x+gone", "write"): ("undocumented", []), (f, "view+s+v", "read"): ("published", []), ("view+s+v", "view+s+v", "read"): ("published", []),
    }
    assert [(r["operation_id"], r["object_id"]) for r in lineage.orphans(objects, operations).collect()] == [("b", "o9")]
    assert [r["operation_id"] for r in lineage.gaps(operations).collect()] == ["b"]
    asked = spark.createDataFrame([(f,), ("table+x+gone",), ("table+s+t",), ("nobody",)], "key string")
    assert {r["key"]: r["known"] for r in lineage.known(lineage.edges(objects, operations), lineage.nodes(objects), asked).collect()} == {f: True, "table+x+gone": True, "table+s+t": True, "nobody": False}


def test_resolution(spark):
    """Kinds, overloads, missing schemas and ctas."""
    known = spark.createDataFrame([("table+s+t", "table", "s", "t"), ("function+s+t()", "function", "s", "t"), ("function+s+g(integer)", "function", "s", "g"), ("function+s+g(text)", "function", "s", "g"), ("table+s+two", "table", "s", "two"), ("view+s+two", "view", "s", "two"), ("table+s+c", "table", "s", "c"), ("table++bare", "table", None, "bare")], "key string, kind string, schema string, name string")
    uses = [
        ("call of a table's namesake", "function", "s", "t", "()", "function+s+t()"), ("call of an unknown overload", "function", "s", "g", None, None), ("call with a key", "function", "s", "g", "(date)", "function+s+g(date)"),
        ("two relations", "table", "s", "two", None, "materialized_view+s+two"), ("ctas", "ctas", "s", "c", None, "ctas+s+c"), ("no schema", "table", None, "t", None, None), ("none either side", "view", None, "bare", None, None), ("gone", "table", "x", "t", None, "table+x+t"), ("call, no key", "procedure", "s", "t", None, None),
    ]
    df = spark.createDataFrame([(*u, None) for u in uses], "what string, kind string, schema string, name string, signature string, key string, scope string")
    got = {r["what"]: (r["resolution"], r["to"] if not r["to"].startswith("@") else "@", r["candidates"]) for r in lineage.resolved(df, known).collect()}
    assert got == {
        "call of a table's namesake": ("published", "function+s+t()", []), "call of an unknown overload": ("unresolved", "@", ["function+s+g(integer)", "function+s+g(text)"]), "call with a key": ("undocumented", "function+s+g(date)", []),
        "two relations": ("undocumented", "materialized_view+s+two", []), "ctas": ("published", "table+s+c", []), "no schema": ("unresolved", "@", []), "none either side": ("published", "table++bare", []), "gone": ("undocumented", "table+x+t", []), "call, no key": ("unresolved", "@", []),
    }


def test_page(spark, facts):
    objects, operations = facts
    pages = spark.createDataFrame([("p1", "managed", "a"), ("p2", "managed", "b"), ("p3", "managed", "c"), ("old", "legacy", None)], "page_id string, status string, page_sha256 string")
    files = spark.createDataFrame([("p1", "a"), ("p2", "x"), ("old", "y")], "page_id string, sha256 string")
    assert {r["page_id"]: r["page_state"] for r in lineage.index(pages, files).collect()} == {"p1": "current", "p2": "changed", "p3": "missing", "old": "current"}
    e = lineage.edges(objects, operations)
    got = lineage.of_page(spark, pages, lineage.nodes(objects), e, "p2")
    assert {(r["node"], r["possible"]) for r in got["affected"].collect()} >= {("function+s+f()", False)} and got["consumers"].first()["read_by"] == ["function+s+f()"]
    assert lineage.of_page(spark, pages, lineage.nodes(objects), e, "old")["keys"].count() == 0
    assert {r["limitation"]: r["n"] for r in lineage.limitations(pages, e, lineage.gaps(operations)).collect()} == {"legacy_pages": 1, "unresolved_edges": 1, "dynamic_gaps": 1}


def test_outdated(spark):
    inputs = spark.createDataFrame([("p", "project", n, "h") for n in ("same", "other", "gone", "shut")] + [("p", "elsewhere", "a", "h")], "page_id string, root string, path string, sha256 string")
    files = spark.createDataFrame([("project", "same", "h", True), ("project", "other", "i", True), ("project", "shut", None, False)], "root string, path string, sha256 string, readable boolean")
    assert {(r["path"], r["reason"]) for r in lineage.outdated(inputs, files).collect()} == {("other", "source_changed"), ("gone", "source_missing"), ("shut", "source_unreadable"), ("a", "project_root_unavailable")}


def test_legacy_pages(spark):
    files = [("a.md", "x\nCanonical key: `table+s+t`\n"), ("b.md", "| КЛЮЧ | view+s+v | x"), ("c.md", "canonical_key:** function+s+f() \nКлюч: later"), ("d.md", None), ("e.md", "no key"), ("index.md", "Key"), (".tmp/f.md", "Ключ: x"), ("m.md", "Ключ: x")]
    got = {r["page_id"]: r["key"] for r in lineage.legacy(spark.createDataFrame(files, "page_id string, text string"), spark.createDataFrame([("m.md",)], "page_id string")).collect()}
    assert got == {"a.md": "table+s+t", "b.md": "view+s+v", "c.md": "function+s+f()", "d.md": None, "e.md": None}
