import hashlib

import pytest
from lodestone.operators import markdown
from lodestone.sources import artifacts, pdf

TEXT = """# Top {#top}

Some words
in a paragraph.

## Part

- one
- two

## Part

<!-- nothing -->

Setext
------

| a | b |
|---|---|
| 1 | 2 |

```sql
# not a heading
```
    indented
"""


def test_blocks_sections_and_coverage(spark):
    rows = markdown.parsed(spark.createDataFrame([("d", TEXT), ("e", None), ("f", "")], "doc string, text string"))
    kinds = [(r["kind"], r["first"], r["last"]) for r in sorted(rows.collect(), key=lambda r: r["first"])]
    assert kinds == [("heading", 1, 1), ("paragraph", 3, 4), ("heading", 6, 6), ("list", 8, 9), ("heading", 11, 11), ("comment", 13, 13), ("heading", 15, 16), ("table", 18, 20), ("code", 22, 24), ("code", 25, 25)]
    s = {r["section"]: (r["level"], r["end"]) for r in markdown.sections(rows).collect()}
    assert s == {"top": (1, None), "part": (2, 11), "part-1": (2, 15), "setext": (2, None)}
    filled = markdown.contents(rows)
    assert {r["section"]: (r["n_blocks"], r["has_text"]) for r in filled.collect()} == {"top": (5, True), "part": (1, True), "part-1": (0, False), "setext": (3, True)}
    required = spark.createDataFrame([("d", f"f{i}") for i in range(4)], "doc string, fact string")
    entries = spark.createDataFrame([("d", "f0", "part"), ("d", "f1", "part-1"), ("d", "f2", "gone")], "doc string, fact string, section string")
    got = {(r["fact"], r["problem"]) for r in markdown.coverage(required, entries, filled).collect()}
    assert got == {("f1", "empty_section"), ("f2", "unknown_section"), ("f3", "not_covered")}


def test_strict_json_and_journal(spark, tmp_path):
    for name, data in (("a", b'\xef\xbb\xbf{"id": 1}'), ("b", b'{"id": 1, "id": 2}'), ("c", b'{"id": NaN}'), ("d", b"{"), ("e", b'{"id": 3, "t": "NaN"}')):
        (tmp_path / f"{name}.json").write_bytes(data)
    got = {r["path"][-6]: r for r in artifacts.strict_json(spark, str(tmp_path), "id long").collect()}
    assert {k: r["valid"] for k, r in got.items()} == {"a": True, "b": False, "c": False, "d": False, "e": True}
    assert got["a"]["value"]["id"] == 1 and got["b"]["value"] is None and got["d"]["sha256"] == hashlib.sha256(b"{").hexdigest()
    folder = str(tmp_path / "journal")
    artifacts.recorded(spark.createDataFrame([("gate", 1), ("plan", 2)], "stage string, n long"), folder)
    (tmp_path / "journal" / "torn.json").write_text('{"stage": "lint", "n": 3}\n[1]\n{"stage": "li')
    assert sorted(r["n"] for r in artifacts.journal(spark, folder, "stage string, n long").collect()) == [1, 2, 3]


def test_ledger(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.sql").write_text("select 1")
    (tmp_path / "b.sql").write_text("select 2")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ledger = spark.createDataFrame([("x/a.sql", sha("select 1")), ("b.sql", sha("old")), ("c.sql", "x")], "name string, sha256 string")
    assert {(r["name"], r["reason"]) for r in artifacts.drifted(spark, ledger, str(tmp_path)).collect()} == {("b.sql", "source_changed"), ("c.sql", "source_missing")}


def test_pdf_plug_in(spark):
    files = spark.createDataFrame([("a", b"one"), ("b", b"one"), ("c", b"two")], "path string, content binary")
    with pytest.raises(pdf.BackendUnavailable):
        pdf.extracted(files, "none")
    pdf.register("fake", lambda data: f"# {data.decode()}\n-----\n![x](images/p.png) ![y](q.png)")
    first = pdf.extracted(files, "fake")
    assert first.count() == 3 and not any(r["from_cache"] for r in first.collect())
    again = pdf.extracted(files, "fake", first.where("path = 'a'").select("cache_key", "markdown")).collect()
    assert {r["path"]: r["from_cache"] for r in again} == {"a": True, "b": True, "c": False}
    assert sorted((r["path"], r["page"]) for r in pdf.pages(first).collect())[:2] == [("a", 1), ("a", 2)]
    assert first.select(pdf.image_names(first["markdown"])).first()[0] == ["p.png", "q.png"]
