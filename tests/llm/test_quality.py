import collections
import random
import re

import duckdb
from lodestone.llm import quality

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = BLANK.findall(text or "")
    lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum((text or "").count(c) for c in quality.SYMBOLS),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
        "longest_word": max((len(w.encode()) for w in words), default=0),
        "n_stutters": sum(a == b for a, b in zip(words, words[1:], strict=False)),
        "n_ellipses": sum(x.rstrip(" \t\r\x0b\x0c").endswith("...") for x in lines),
    }


def cases():
    rng = random.Random(5)
    out = [None, "", " \n\t ", "a", "a b c d", "a b c d e a b c d e", "é ü ß a b", "x...\ny... \nz", "l\nl\nl \n\nl", "\n\n", "w " * 30000, "q" * 3_000_000]
    out += [" ".join(rng.choice("ab cd ef gh ##a\n b... é".split(" ")) for _ in range(rng.randrange(200))) for _ in range(300)]
    return out


def test_measures_equal_brute_force(spark):
    texts = cases()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: r.asDict() for r in quality.judged(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert {k: got[i][k] for k in want} == want, (i, t and t[:80])
        assert got[i]["base_failed"] == (want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"])
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_real_texts_and_ablation(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path)
    rows = quality.judged(docs)
    got = {r["doc_id"]: r for r in rows.collect()}
    for i, t in duckdb.sql(f"select doc_id, text from '{path}'").fetchall():
        want = brute(t)
        assert {k: got[i][k] for k in want} == want
    for r in quality.ablation(rows).collect():
        mask = quality.POLICIES[r["policy"]].mask
        bit = next(1 << x.bit for x in quality.RULES if x.name == r["rule"])
        assert r["kept"] == sum(not g["failed"] & mask for g in got.values())
        assert r["kept_without"] == sum(not g["failed"] & mask & ~bit for g in got.values())
        assert r["rejected_alone"] == sum(g["failed"] & mask == bit for g in got.values())


def test_empty_table_nulls_and_repeats(spark):
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = quality.judged(spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")).collect()
    assert len(rows) == 3 and all(r["base_failed"] for r in rows)
