import collections
import random

import numpy as np
import pyarrow as pa
from lodestone.llm import common, minhash


def bag(text):
    w = (text or "").lower().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def classes(docs):
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = [(i, bag(t)) for i, t in docs]
    for k, (i, a) in enumerate(bags):
        for j, b in bags[:k]:
            if a and b and (i == j or similarity(a, b) >= minhash.THRESHOLD):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in docs}


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(1)
    base = [rng.choice("abcdefgh") for _ in range(60)]
    for edits in (0, 2, 6):
        other = list(base)
        for _ in range(edits):
            other[rng.randrange(60)] = "z"
        a, b = " ".join(base * 2), " ".join(other * 2)
        text, value, count, _ = minhash.shingles(pa.array([a, b]).cast(pa.large_string()))
        sig = minhash.signatures(text, value, count, 2, 4096)
        assert np.isfinite(sig).all()
        assert abs((sig[0] == sig[1]).mean() - similarity(bag(a), bag(b))) < 0.04


def test_counts_change_the_estimate():
    a, b = "a b c d e f " * 2, "a b c d e f " * 40
    text, value, count, _ = minhash.shingles(pa.array([a, b]).cast(pa.large_string()))
    sig = minhash.signatures(text, value, count, 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - similarity(bag(a), bag(b))) < 0.03


def planted(rng, groups, copies):
    docs, word = [], lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = word()
            docs.append(" ".join(w))
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    docs = planted(rng, 60, 9)
    n = len(docs)
    docs += [(n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, "Hot word"), (n + 4, "hot WORD"), (n + 5, docs[0][1]), (n + 6, docs[0][1].upper())]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, bucket string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.groups(spark, df).collect()}
    assert got == classes(docs)
    kept = {r["doc_id"] for r in minhash.deduplicated(spark, df).collect()}
    assert kept == set(classes(docs).values())


def test_a_star_that_its_leader_does_not_join(spark):
    """Members that share buckets but no leader with enough overlap still meet each other."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(80):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash.groups(spark, df).collect()} == classes(docs)


def test_empty_nulls_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.groups(spark, empty).count() == 0 and minhash.deduplicated(spark, empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["class_id"]) for r in minhash.groups(spark, df).collect())
    assert got == [(-1, None), (4, 4), (4, 4), (9, 4)]
    assert sorted((r["doc_id"] or -1) for r in minhash.deduplicated(spark, df).collect()) == [-1, 4]


def test_a_hot_leader_is_dealt_in_chunks(spark, monkeypatch):
    """More pairs than a chunk for one leader: same groups, and no (leader, salt) with all of them."""
    monkeypatch.setattr(minhash, "LEADER_CHUNK", 8)
    base = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join([*base, f"x{i}"])) for i in range(60)] + [(100 + i, f"other text {i} of six words") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash.groups(spark, df).collect()} == classes(docs)
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 60)] + [(70, 69)], "id long, leader long")
    salted, leaders = minhash.dealt(spark, pairs)
    sizes = {(r["leader"], r["salt"]): r["count"] for r in salted.groupBy("leader", "salt").count().collect()}
    assert sum(sizes.values()) == 60 and max(sizes.values()) < 25
    assert set(sizes) <= {(r["leader"], r["salt"]) for r in leaders.collect()}


def test_very_long_texts_and_clashing_names(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(150_000))
    docs = [(1, long, 1), (2, long + " end", 2), (3, "x" * 1_000_000, 3), (4, "x" * 1_000_000, 4), (5, "", 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, hash int")
    got = {r["doc_id"]: r["class_id"] for r in minhash.groups(spark, df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    kept = minhash.deduplicated(spark, df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5]


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs with edits of 1 to 4 % of their words: nearly all of those that reach the similarity are grouped, and none below it."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    docs, want = [], {}
    for k in range(300):
        w = [word() for _ in range(rng.randrange(40, 200))]
        x = list(w)
        for _ in range(round(len(w) * rng.choice([0.01, 0.02, 0.03, 0.04]))):
            x[rng.randrange(len(x))] = word()
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(x))]
        want[2 * k + 1] = similarity(bag(" ".join(w)), bag(" ".join(x))) >= minhash.THRESHOLD
    got = {r["doc_id"]: r["class_id"] for r in minhash.groups(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i, near in want.items() if not near)
    near = [i for i, near in want.items() if near]
    assert len(near) > 100 and sum(got[i] == i - 1 for i in near) >= 0.99 * len(near)


def test_tables_out_of_a_shuffle_have_few_files(spark, monkeypatch):
    """However many partitions a shuffle has: no file for each of them; prints and links, which Python makes, keep theirs. The rows are all there."""
    found = {}

    def settle(spark, df, name, **kw):
        out = common.settle(spark, df, name, **kw)
        found[name] = max(found.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(minhash, "settle", settle)
    changed = {"spark.sql.shuffle.partitions": "29", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    words = [f"w{k}" for k in range(400)]
    docs = [(i, " ".join(words[i % 150 : i % 150 + 40])) for i in range(300)]
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        rows = minhash.groups(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["doc_id"]: r["class_id"] for r in rows} == classes(docs)
    assert {"classes", "members", "pairs", "stars", "texts", "edges"} <= found.keys()
    assert max(found[k] for k in found if k not in ("prints", "links")) <= 2 * spark.sparkContext.defaultParallelism, found
