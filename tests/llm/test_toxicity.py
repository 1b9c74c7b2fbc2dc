import random
import tracemalloc

import duckdb
import numpy as np
from lodestone.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        if i % 5 == 0:
            w[rng.randrange(len(w))] = rng.choice(["xylqo", "wzznk", "Xylqov"])
        texts.append(" ".join(w))
        labels.append(int(i % 5 == 0))
    return texts, np.array(labels)


def test_held_out_accuracy():
    texts, y = corpus(1500, 1)
    model = toxicity.fit(texts[:1000], y[:1000])
    s = toxicity.scores(model, texts[1000:])
    hit = (s >= 0.3) == (y[1000:] == 1)
    assert hit.mean() > 0.97


def test_scores_do_not_depend_on_the_batch():
    texts, y = corpus(300, 2)
    model = toxicity.fit(texts, y)
    texts += ["", "x", "abc", "é" * 5000]
    one = np.concatenate([toxicity.scores(model, [t]) for t in texts])
    assert np.allclose(one, toxicity.scores(model, texts))
    assert ((one >= 0) & (one <= 1)).all()


def test_training_holds_little_on_the_driver():
    texts, y = corpus(1200, 4)
    texts = [" ".join([t] * 8) for t in texts]
    tracemalloc.start()
    toxicity.fit(texts, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # was 100 MB: every feature's figures at once, and three numbers for each feature of each text


def test_training_without_both_kinds():
    for y in (np.zeros(0, int), np.zeros(3, int), np.ones(3, int)):
        s = toxicity.scores(toxicity.fit(["a b"] * len(y), y), ["", "anything"])
        assert len(s) == 2 and ((s >= 0) & (s <= 1)).all()


def test_frames(spark):
    texts, y = corpus(400, 3)
    docs = spark.createDataFrame([*((i, t, 7) for i, t in enumerate(texts)), (None, None, 1), (400, "", 2), (0, texts[0], 7)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([*((i, int(v)) for i, v in enumerate(y)), (None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.trained(docs, labels)
    rows = toxicity.scored(spark, docs, model).collect()
    assert len(rows) == 403 and all(0 <= r["score"] <= 1 for r in rows)
    bad = {r["doc_id"] for r in rows if r["score"] >= 0.3}
    assert len(bad ^ {i for i, v in enumerate(y) if v}) < 8
    kept = toxicity.cleaned(spark, docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {*range(401), None} - bad
    empty = docs.limit(0)
    assert toxicity.scored(spark, empty, toxicity.trained(empty, labels.limit(0))).count() == 0


def test_held_out_rows_of_the_tables():
    import zlib

    d = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select d.doc_id, text, toxic from '{d}/documents.parquet' d join '{d}/labels.parquet' l using (doc_id) order by 1").fetchall()
    held = [zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows]
    train, test = [r for r, h in zip(rows, held, strict=True) if not h], [r for r, h in zip(rows, held, strict=True) if h]
    model = toxicity.fit([r[1] for r in train], np.array([r[2] for r in train]))
    s, y = toxicity.scores(model, [r[1] for r in test]), np.array([r[2] for r in test]) == 1
    rank = np.argsort(np.argsort(s))
    area = (rank[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum())
    assert area > 0.97
    # About a tenth of the toxic labels of these tables stands on texts without any insult.
    assert (s >= 0.3)[y].mean() > 0.85 and (s >= 0.3)[~y].mean() < 0.02


def grams(text):
    """Hashed n-grams of a text, one by one."""
    t = " " + " ".join(text.lower().split()) + " "
    m, out = (1 << 32) - 1, set()
    for n in toxicity.ORDERS:
        for i in range(len(t) - n + 1):
            h = ord(t[i]) * 0x9E3779B1 & m
            for c in t[i + 1 : i + n]:
                h = (((h ^ (h >> 15)) * 0x85EBCA77) + ord(c) * 0x9E3779B1) & m
            out.add((((h ^ (h >> 16)) * 0xC2B2AE3D) & m) >> (32 - toxicity.SPACE_BITS))
    return out


def test_features_and_scores_equal_brute_force():
    rng = random.Random(5)
    words = ["bad", "awful", "nice", "Straße", "日本", "a", "!!"] + ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(40)]
    texts = ["", " ", "a", "x" * 50_000, *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(200))]
    everything = np.arange(1, (1 << toxicity.SPACE_BITS) + 1)
    text, feature = toxicity.found(texts, everything)
    assert [set(feature[text == i].tolist()) for i in range(len(texts))] == [grams(t) for t in texts]
    toxic = np.array([int("bad" in t or "awful" in t) for t in texts])
    model = toxicity.fit(texts, toxic)
    known = {int(f): float(model.weight[p - 1]) for f, p in enumerate(model.place) if p}
    assert 10 < len(known) < len(set().union(*map(grams, texts)))
    for t, got in zip(texts, toxicity.scores(model, texts), strict=True):
        own = [known[f] for f in grams(t) if f in known]
        assert abs(got - 1 / (1 + np.exp(-np.clip(sum(own) / max(1, len(own)) ** 0.5 + model.bias, -60, 60)))) < 1e-9
    assert ((toxicity.scores(model, texts) > 0.5) == toxic).mean() > 0.97


def test_the_bound_on_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_BYTES", 20_000)
    sizes, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: sizes.append(sum(len(t.encode()) for t in texts)) or fit(texts, toxic))
    docs = spark.createDataFrame([(i, ("nice words " if i % 2 else "bad awful ") * 20) for i in range(200)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) toxic")
    model = toxicity.trained(docs, labels)
    rows = {r["doc_id"]: r["score"] for r in toxicity.scored(spark, docs, model).collect()}
    assert 19_000 < sizes[0] <= 20_000
    assert len(rows) == 200 and all((s > 0.5) == (i % 2 == 0) for i, s in rows.items())
