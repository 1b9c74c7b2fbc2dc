import random
import re
from pathlib import Path

from lodestone.llm import licenses


def test_texts_notices_and_odd_rows(spark):
    mit = licenses.MIT_GRANT + licenses.PERMISSIVE_WARRANTY
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 Some One\n\n" + mit.replace(". ", ".\n\n")), (2, mit.upper().replace(",", " ;")),
        (3, "Words before.\nReleased under the MIT licence!\nand after\nLicensed under CC BY-NC 4.0."), (4, mit + " not"), (5, None), (6, ""), (None, mit), (2, mit),
    ]
    df = spark.createDataFrame([(*r, "d") for r in rows], "doc_id long, text string, digest string")
    got = licenses.scanned(spark, df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert {i: by[i]["license"] for i in by} == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: None, None: "MIT"}
    assert by[3]["n_notices"] == 2 and by[3]["notices"] == "CC-BY-NC-4.0,MIT" and by[5]["n_notices"] == 0 and by[5]["notices"] is None
    assert by[5]["digest"] == by[6]["digest"] and len({r["digest"] for r in got if r["doc_id"] == 2}) == 1
    assert licenses.scanned(spark, df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = licenses.scanned(spark, df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


#: Names of files in the folder where Debian keeps the texts, and the licences that they are.
FILES = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def rewritten(rng, text):
    """The same licence in other case, punctuation, line breaks (but for those after its own copyright lines) and spelling, under
    another copyright line."""
    out = " ".join(text.split(" ")) if rng.random() < 0.5 else "\n".join(p if re.search(r"copyright|©", p, re.I) else " ".join(p.split()) for p in text.split("\n\n"))
    out = out.upper() if rng.random() < 0.5 else out.replace("; ", " ;\t").replace("license", "licence")
    return f"Copyright (c) {rng.randrange(1990, 2030)} Some One\n\n{out}\n"


def test_whole_texts_of_planted_documents(spark):
    rng = random.Random(3)
    texts = {v: Path("/usr/share/common-licenses", k).read_text(encoding="utf-8", errors="replace") for k, v in FILES.items() if Path("/usr/share/common-licenses", k).exists()}
    texts |= {n: t for n, t in licenses.LICENSES if len(t) > 300}
    rows = [(i, n, rewritten(rng, t)) for i, (n, t) in enumerate(texts.items())] + [(1000 + i, None, rewritten(rng, t) + " and more") for i, t in enumerate(texts.values())]
    df = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scanned(spark, df).collect()}
    assert got == {i: n for i, n, _ in rows} and len(texts) >= 8


def test_a_table_of_ones_own_and_lines_of_any_length(spark):
    own = spark.createDataFrame([("long", "word " * 3000), ("short", "Be ok"), ("none", ""), (None, "x")], "license string, text string")
    df = spark.createDataFrame([(1, "a\n" + "WORD; " * 3000 + "\nbe OK!\nx"), (2, "word\n" * 3000), (3, "MIT")], "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["n_notices"], r["notices"]) for r in licenses.scanned(spark, df, texts=own).collect()}
    assert got == {1: (None, 2, "long,short"), 2: ("long", 0, None), 3: (None, 0, None)}
    assert licenses.scanned(spark, df, texts=own.limit(0)).where("license is not null or n_notices > 0").count() == 0


def test_copyright_lines_keep_letters_of_every_script(spark):
    texts = ["Привет мир © 2020 Иван", "中文内容很长 (c) 2020 某某", "© 2020 Иван", "12 -- (c) 2020 某某\nrest", "Ελλάδα copyright 2020"]
    import duckdb
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    forms = [r[0] for r in df.orderBy("doc_id").select(licenses.whole_form(licenses.canonical_lines(F.col("text")))).collect()]
    assert forms == ["привет мир 2020 иван", "中文内容很长 c 2020 某某", "", "rest", "ελλάδα copyright 2020"]
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = {r[0]: r[1] for r in con.execute(f"select doc_id, digest from ({licenses.oracle_sql()})").fetchall()}
    assert {r["doc_id"]: r["digest"] for r in licenses.scanned(spark, df).collect()} == want and len(set(want.values())) == 5


def test_any_number_of_known_texts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(900, "MIT License\n\nReleased under the MIT License.\nx\nLicensed under CC BY 4.0.\nLicensed under CC BY 4.0."), (901, None), (901, ""), (None, "word " * 220_000 + "\nReleased under the MIT License.")], "doc_id long, text string"))
    want = sorted(map(str, licenses.scanned(spark, docs).collect()))
    monkeypatch.setattr(licenses, "MAX_KNOWN", 5)
    got = licenses.scanned(spark, docs)
    assert sorted(map(str, got.collect())) == want and any("n_notices=3" in x for x in want)
    assert "Python" not in got._jdf.queryExecution().toString()
    assert licenses.scanned(spark, docs.limit(0)).count() == 0
