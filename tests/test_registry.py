import hashlib
import random
import re

import pytest
from lodestone.functions import text as T
from lodestone.operators import registry
from pyspark.sql import functions as F


def slug(key):
    s = re.sub("-+", "-", re.sub("[^a-z0-9]", "-", key.lower().replace(")", ""))).strip("-")[:80].rstrip("-")
    return s or "object"


def brute(batch, pages, legacy, first):
    """path of each key: the registry's, else the shortest free start that no other new key has, by trying."""
    out = {}
    new = sorted(k for k in set(batch) if not [p for p, old in pages.items() if legacy.get(old, old) == k])
    for k in set(batch) - set(new):
        found = [p for p, old in pages.items() if legacy.get(old, old) == k]
        out[k] = found[0] if len(found) == 1 else None
    name = lambda k, n: f"{slug(k)}--{hashlib.sha256(k.encode()).hexdigest()[:n]}.md"
    for k in new:
        out[k] = next(name(k, n) for n in range(first, 65) if all(name(k, n) != name(o, n) for o in new if o != k) and name(k, n) not in pages)
    return out


def test_names_stay_over_batches_and_equal_brute_force(spark):
    rng = random.Random(8)
    keys = ["k" + "-!"[i % 2] * i for i in range(150)] + [f"function+s+f{i}(a)" for i in range(40)] + ["???", "é", "Long " * 60]
    rng.shuffle(keys)
    pages, legacy = {"old/page.md": keys[0], "k--3.md": "elsewhere", "x.md": "old key", "a.md": "twice", "b.md": "twice"}, {"old key": keys[1]}
    reg = spark.createDataFrame(list(pages.items()), "path string, key string")
    old = spark.createDataFrame(list(legacy.items()), "old string, new string")
    seen = {}
    for batch in (keys[:70], keys[40:140] + ["twice"], keys):
        rows = spark.createDataFrame([(k,) for k in batch + batch[:3] + [None]], "key string")
        named = registry.resolved(rows, reg, old, first=1)
        got = {r["key"]: r["page_name"] for r in named.collect()}
        assert named.count() == len(batch) + 4 and got.pop(None) is None
        assert got == brute(batch, pages, legacy, 1)
        assert all(seen.get(k, n) == n for k, n in got.items())
        seen |= got
        pages |= {n: k for k, n in got.items() if n and n not in pages}
        reg = spark.createDataFrame([(r["path"], r["key"]) for r in registry.extended(reg, named).collect()], "path string, key string")
        assert {r["path"]: r["key"] for r in reg.collect()} == pages
    assert len({n for n in seen.values() if n}) == len(seen) - 1  # `twice` has none
    assert registry.resolved(rows.limit(0), reg, old).count() == 0
    assert registry.resolved(rows, reg.limit(0), old.limit(0)).where("page_name is not null").count() == len(keys) + 3


@pytest.mark.parametrize("path, want", [
    ("a.md", "a.md"), ("./a//b\\c.md", "a/b/c.md"), ("a/./b.md", "a/b.md"), ("/a.md", None), ("\\a.md", None), ("C:a.md", None), ("a/../b.md", None), ("..\\b.md", None), ("a.txt", None), (".md", None), ("a\nb.md", None), ("a..b.md", "a..b.md"),
])
def test_paths(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(registry.normal_path(F.col("p"))).first()[0] == want


def test_problems(spark):
    pages = spark.createDataFrame([("a.md", "k1"), ("./a.md", "k2"), ("b.md", ""), ("/c.md", "k3"), (None, "k4"), ("d.md", "o1"), ("e.md", "k5")], "path string, key string")
    legacy = spark.createDataFrame([("o1", "k5"), ("o2", "x"), ("o2", "y"), ("o3", None)], "old string, new string")
    got = {(r["subject"], r["problem"]) for r in registry.problems(pages, legacy).collect()}
    assert got == {("a.md", "repeated_path"), ("b.md", "empty_key"), ("/c.md", "bad_path"), (None, "bad_path"), ("k5", "ambiguous_key"), ("o2", "ambiguous_legacy"), ("o3", "empty_legacy")}


def test_slugs(spark):
    keys = ["function+core+orders_summary+(bigint)", "a)b", "--", "", "x" * 79 + "-y" * 5, "Été"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select(T.slug(F.col("k"))).collect()
    assert [r[0] for r in got] == [slug(k) for k in keys]


def test_keys_of_any_length_move_as_hashes(spark):
    """No join, grouping or window of a batch carries a key: only its slug and its hash, so that a broadcast is no longer than the planner thinks."""
    rows = spark.range(40).select("id", F.concat(F.lit("k"), F.repeat(F.lit("!"), (F.col("id") * 10_000).cast("int"))).alias("key"))
    reg = rows.where("id < 10").select(F.concat(F.lit("p/"), "id", F.lit(".md")).alias("path"), F.concat(F.lit("old "), "key").alias("key"))
    named = registry.resolved(rows, reg, rows.where("id < 10").select(F.concat(F.lit("old "), "key").alias("old"), F.col("key").alias("new")), first=2)
    assert named.columns == ["key", "id", "page_name", "known"]
    got = {r["id"]: r["page_name"] for r in named.select("id", "page_name", "known").collect()}
    want = brute(keys := ["k" + "!" * 10_000 * i for i in range(40)], {f"p/{i}.md": "old " + k for i, k in enumerate(keys[:10])}, {"old " + k: k for k in keys[:10]}, 2)
    assert got == {i: want[k] for i, k in enumerate(keys)}
    plan = named.select("id", "page_name", "known")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if re.search("Join|Aggregate|Window|Sort", line)]
    assert joins and not [line for line in joins if re.search(r"\b(key|old|new)#", line)], joins
