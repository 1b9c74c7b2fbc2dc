import random
import unicodedata
import zlib

import duckdb
import numpy as np
from lodestone.llm import language, queries


def subwords(text):
    """Hashed subwords of a text, one by one."""
    words, own = [], ""
    for c in text.lower() + "\0":
        if unicodedata.category(c)[0] in "LM":
            own += c
        elif own:
            words.append(own)
            own = ""
    m, out = (1 << 32) - 1, []
    for w in words:
        t = [0, *map(ord, w), 0]
        for n in language.ORDERS:
            for i in range(len(t) - n + 1):
                run = t[i : i + n]
                if not any(run):
                    continue
                if n == 1 and not run[0]:
                    continue
                h = run[0] * 0x9E3779B1 & m
                for c in run[1:]:
                    h = (((h ^ (h >> 15)) * 0x85EBCA77) + c * 0x9E3779B1) & m
                out.append((((h ^ (h >> 16)) * 0xC2B2AE3D) & m) >> (32 - language.SPACE_BITS))
    return out


TEXTS = ["", " ", "a", "…", "Ab, cd!! -- É ét", "\0\0", "x\0y", "日本 語", "हिन्दी में", "12 34", "don't", "a" * 3000, "Straße  STRASSE\nﬁ"]


def test_subwords_and_scores_equal_brute_force():
    rng = np.random.default_rng(2)
    table = rng.normal(size=(1 << language.SPACE_BITS, 3)).astype(np.float32)
    model = language.Model(["a", "b", "c"], table, None, np.array([0.1, 0.0, -0.2]), 0.7, 0.5)
    rand = random.Random(1)
    texts = TEXTS + ["".join(rand.choices("ab é.́日 ", k=rand.randrange(30))) for _ in range(300)]
    found = language.Subwords(texts)
    text, x = found.pairs()
    for i, t in enumerate(texts):
        assert sorted(x[text == i].tolist()) == sorted(subwords(t)), t
    langs, score, rejected = language.predictions(model, texts)
    for i, t in enumerate(texts):
        own = subwords(t)
        if not any(c.isalpha() for c in t):
            assert (langs[i], score[i], rejected[i]) == (language.UNKNOWN, 0, True)
            continue
        z = (table[own].astype(float).mean(0) + model.bias) / 0.7
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert abs(score[i] - p.max()) < 1e-9 and langs[i] == "abc"[p.argmax()] and rejected[i] == (p.max() < 0.5)


def test_many_languages_keep_embeddings():
    rng = random.Random(3)
    sets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 9)) for _ in range(20)]
    texts = [(k, " ".join("".join(rng.choices(s, k=5)) for _ in range(60))) for k, s in enumerate(sets) for _ in range(30)]
    rng.shuffle(texts)
    model = language.fit([t for _, t in texts[:500]], [f"l{k}" for k, _ in texts[:500]])
    assert model.output is not None and model.table.shape[1] == language.WIDTH
    langs, score, _ = language.predictions(model, [t for _, t in texts[500:]])
    assert np.mean([a == f"l{k}" for a, (k, _) in zip(langs, texts[500:], strict=True)]) > 0.95


def test_held_out_accuracy_and_calibration():
    rows = duckdb.sql("select doc_id, text, lang from '/root/testdata/sf0.1/documents.parquet' where lang is not null order by 1").fetchall()
    held = [zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows]
    train, test = [r for r, h in zip(rows, held, strict=True) if not h][:1200], [r for r, h in zip(rows, held, strict=True) if h]
    model = language.fit([r[1] for r in train], [r[2] for r in train])
    langs, score, rejected = language.predictions(model, [r[1] for r in test])
    right = np.array([a == r[2] for a, r in zip(langs, test, strict=True)])
    assert right.mean() > 0.99 and rejected.mean() < 0.02
    # Runs of three words: scores say how often they are right, and what is not rejected is.
    rng = random.Random(5)
    short = [(lambda w, i: " ".join(w[i : i + 3]))(w, rng.randrange(max(1, len(w) - 2))) for w in (r[1].split() for r in test)]
    langs, score, rejected = language.predictions(model, short)
    right = np.array([a == r[2] for a, r in zip(langs, test, strict=True)])
    assert abs(score.mean() - right.mean()) < 0.03
    assert right[~rejected].mean() > 0.98 and right[~rejected].mean() >= right.mean()


def test_learns_only_from_its_rows(spark, tmp_path):
    docs = [(i, "abba baab abab" if i % 2 else "cdcd dccd ddcc", "x" if i % 2 else "y", "s", "q", 0.5) for i in range(200)]
    docs = [(d[0], d[1], *((d[2],) if zlib.crc32(str(d[0]).encode()) % 5 else ("wrong",)), *d[3:]) for d in docs]
    docs += [(None, "abba", "wrong", "s", "q", 0.5), (1000, "efef", None, None, None, None), (1001, None, "wrong", "s", "q", 0.1), (1002, "12 !", "wrong", "s", "q", 0.1), (1, "abba baab abab", "x", "s", "q", 0.5), (1003, "ab" * 200_000, "x", "s", "q", 0.5)]
    path = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, lang_pred string, score double").write.parquet(f"{path}/documents.parquet")
    got = queries.op13_language_id(spark, path).collect()
    assert len(got) == len(docs) and {r["lang_pred"] for r in got} == {"x", "y", "und"}
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == ("x" if i % 2 else "y") for i in range(200))
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(200)) and not by[None]["held_out"]
    assert by[1001]["lang_pred"] == by[1002]["lang_pred"] == "und" and by[1003]["lang_pred"] == "x"
    empty = f"{path}/none"
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{empty}/documents.parquet")
    assert queries.op13_language_id(spark, empty).count() == 0
    spark.createDataFrame([(5, "word", None)], "doc_id long, text string, lang string").write.mode("overwrite").parquet(f"{empty}/documents.parquet")
    assert [(r["lang_pred"], r["score"]) for r in queries.op13_language_id(spark, empty).collect()] == [("und", 0.0)]


def test_bounds_of_the_sample(spark, monkeypatch):
    taken, fit = [], language.fit
    monkeypatch.setattr(language, "fit", lambda texts, langs: taken.append((sum(map(len, texts)), sorted(langs))) or fit(texts, langs))
    docs = spark.createDataFrame([(i, f"word{'abcd'[i % 4]} " * 20, "rare" if i % 50 == 0 else "often") for i in range(1000)], "doc_id long, text string, lang string")
    language.trained(docs, max_rows=100)
    assert taken[-1][1] == ["often"] * 80 + ["rare"] * 20
    monkeypatch.setattr(language, "MAX_BYTES", 5000)
    language.trained(docs, max_rows=100)
    assert 4800 < taken[-1][0] <= 5000
