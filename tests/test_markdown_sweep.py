import random
from collections import Counter

from lodestone.operators import markdown

BLOCKS = "doc string, kind string, level int, first int, last int, text string, anchor string"


def pages(rng, n):
    rows = []
    for d in range(n):
        at = 1
        for _ in range(rng.randrange(40)):
            kind = rng.choice(["heading", "heading", "paragraph", "code", "comment", "rule", "list"])
            last = at + rng.randrange(3)
            rows.append((f"d{d}", kind, rng.randrange(1, 7) if kind == "heading" else 0, at, last, rng.choice(["One two", "one  two", "...", "", "Été_1"]), rng.choice([None, None, "own"]) if kind == "heading" else None))
            at = last + 1 + rng.randrange(2)
    return rows


def test_sweep_equals_the_product_of_blocks_and_sections(spark):
    rows = pages(random.Random(2), 60)
    df = spark.createDataFrame(rows, BLOCKS).repartition(5)
    heads = {}
    for d, kind, level, first, *_ in rows:
        if kind == "heading":
            after = [r[3] for r in rows if r[0] == d and r[1] == "heading" and r[3] > first and r[2] <= level]
            heads[d, first] = (level, min(after, default=10**9))
    for r in markdown.enclosing(df).collect():
        want = sorted(f for (d, f), (level, end) in heads.items() if d == r["doc"] and f < r["first"] < end and (r["kind"] != "heading" or level < r["level"]))
        assert sorted(r["within"]) == want == r["within"]
    names = {(r["doc"], r["first"]): r["section"] for r in markdown.sections(df).collect()}
    want = Counter()
    text = Counter()
    for d, kind, _, first, _, t, _ in rows:
        if kind not in ("heading", "comment", "rule"):
            for (e, f), (_, end) in heads.items():
                if d == e and f < first < end:
                    want[d, names[d, f]] += 1
                    text[d, names[d, f]] += any(c.isalnum() for c in t)
    got = {(r["doc"], r["section"]): (r["n_blocks"], r["has_text"]) for r in markdown.contents(df).collect()}
    assert got == {(d, names[d, f]): (want[d, names[d, f]], text[d, names[d, f]] > 0) for d, f in heads}
    plan = markdown.enclosing(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan  # that of repartition() above, and one
    assert markdown.contents(df.limit(0)).count() == 0


def test_allowed_sections(spark):
    required = spark.createDataFrame([("d", f, g) for f, g in (("f1", "operations"), ("f2", "operations"), ("f3", "errors"), ("f4", "errors"), ("f5", "errors"))], "doc string, fact string, group string")
    entries = spark.createDataFrame([("d", "f1", "flow"), ("d", "f2", "errors"), ("d", "f3", "empty"), ("d", "f4", "none")], "doc string, fact string, section string")
    filled = spark.createDataFrame([("d", "flow", 2, True), ("d", "errors", 1, True), ("d", "empty", 1, False)], "doc string, section string, n_blocks int, has_text boolean")
    allowed = spark.createDataFrame([("operations", "flow"), ("operations", "flow"), ("errors", "errors")], "group string, section string")
    got = {(r["fact"], r["problem"]) for r in markdown.coverage(required, entries, filled, allowed).collect()}
    assert got == {("f2", "wrong_section"), ("f3", "empty_section"), ("f4", "unknown_section"), ("f5", "not_covered")}
    assert {r["fact"] for r in markdown.coverage(required, entries, filled).collect()} == {"f3", "f4", "f5"}


def test_adjacent_equals_brute_force(spark):
    rng = random.Random(6)
    docs = {f"d{i}": [(rng.random() < 0.4, rng.choice([None, None, "m"]), rng.choice([None, None, "t"])) for _ in range(rng.randrange(30))] for i in range(50)}
    rows = [(d, n, b, m, t) for d, lines in docs.items() for n, (b, m, t) in enumerate(lines, 1)]
    df = spark.createDataFrame(rows, "doc string, line int, blank boolean, mark string, target string").repartition(4)
    want = {}
    for d, lines in docs.items():
        for i, (_, m, _) in enumerate(lines):
            if m:
                at = next((k for k in range(i + 1, len(lines)) if lines[k][2]), None)
                ok = at is not None and all(lines[k][0] for k in range(i + 1, at))
                want[d, i + 1] = at + 1 if ok else None
    out = markdown.adjacent(df)
    assert {(r["doc"], r["line"]): r["target_line"] for r in out.collect()} == want and None in want.values()
    plan = markdown.adjacent(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(doc") == 1 and plan.count("Sort [doc") == 1


TEXT = """<!-- wiki-doc:section intro -->

# Overview

text

<a id="list"></a>
- one
- two

<!-- wiki-doc:fragment part -->

A paragraph.

<!-- wiki-doc:section lost -->
no heading here

<!-- wiki-doc:section a -->
<!-- wiki-doc:section b -->
## Twice

<!-- wiki-doc:fragment part -->
```
code
```

<!-- wiki-doc:fragment end -->
"""


def test_markers_and_anchors(spark):
    docs = spark.createDataFrame([("p", TEXT), ("q", None), ("r", "")], "doc string, text string")
    got = {(r["line"], r["mark"], r["id"], r["target_line"], r["problem"]) for r in markdown.marked(docs, markdown.parsed(docs)).collect()}
    assert got == {
        (1, "section", "intro", 3, None), (7, "anchor", "list", 8, None), (11, "fragment", "part", 13, "repeated_id"), (15, "section", "lost", None, "no_heading"),
        (18, "section", "a", None, "no_heading"), (19, "section", "b", 20, None), (22, "fragment", "part", 23, "repeated_id"), (27, "fragment", "end", None, "no_block"),
    }
