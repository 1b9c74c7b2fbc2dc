import random
import re
from collections import Counter
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from lodestone.llm import divergence
from lodestone.llm.common import byte_words

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, min_docs):
    """The contract, one step at a time, in fractions."""
    docs = [(t or "", lang or "", s or "") for t, lang, s in docs]
    out = set()
    for lang in {d[1] for d in docs}:
        own = [(TERMS.findall(t.translate(UPPER)), s) for t, other, s in docs if other == lang]
        df = Counter(w for words, _ in own for w in set(words))
        kept = sorted((w for w, n in df.items() if n >= min_docs), key=str.encode)
        count = {s: Counter() for _, s in own}
        for words, s in own:
            count[s].update(w for w in words if w in set(kept))
        everything = sum(count.values(), Counter())
        v = len(kept)

        def share(c, kept=kept, v=v):
            return {w: 1 + floor(Fraction(10**9 * (c[w] + 5), sum(c.values()) + 5 * v)) for w in kept}

        p, q = {s: share(c) for s, c in count.items()}, share(everything)
        for s in count:
            pairs = sorted(((-sum(abs(p[s][w] - p[t][w]) for w in kept), t.encode()) for t in count if t != s))
            terms = sorted((q[w] - p[s][w], w.encode()) for w in kept if count[s][w] and p[s][w] > q[w])[:50]
            for part, rows in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -x, i) for i, (x, item) in enumerate(rows, 1)}
    return out


def rows(df):
    got = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_brute_force_over_several_tiles_of_groups(spark):
    rng = random.Random(3)
    words = ["The", "the", "THE", "ÄPFEL", "äpfel", "日本", "ét", "x1y", "_", "42", *("w" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(600))]
    docs = [(" ".join(rng.choices(words, k=rng.randrange(30))), "en", f"s{rng.randrange(270)}") for _ in range(3000)]
    docs += [("the the the", "en", "hot")] * 500 + [("a b", "fr", "s1"), ("", "fr", "s2"), (None, None, None), ("a", None, ""), ("...", "de", "s1")]
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    assert len({d[2] for d in docs}) > divergence.GROUPS_A_TILE
    assert rows(divergence.audited(spark, df, 10)) == brute(docs, 10)


def test_odd_tables(spark):
    kind = "text string, lang string, source string, term string, n long, LANG_ string, g int, total long"
    none = spark.createDataFrame([], kind)
    assert rows(divergence.audited(spark, none)) == set()
    docs = [("b a" * 3, "x", "s"), ("b a" * 3, "x", "s"), ("A " + "y" * 3_000_000 + " a", "x", "t"), (None, "x", "u")]
    df = spark.createDataFrame([(*d, "q", 1, "r", 2, 3) for d in docs], kind)
    assert rows(divergence.audited(spark, df, 1)) == brute(docs, 1)


def test_shares_are_exact_for_large_counts():
    rng = random.Random(1)
    total = [divergence.MAX_TOTAL, divergence.MAX_TOTAL - 7, *(rng.randrange(1, divergence.MAX_TOTAL) for _ in range(200))]
    count = [rng.randrange(t + 1) for t in total]
    got = divergence.shares(np.array(count), np.array(total))
    assert got.tolist() == [1 + 10**9 * c // t for c, t in zip(count, total, strict=True)]
    import pyarrow as pa

    rows = {"lang": ["x"], "block": [0], "a": [0], "b": [0], "g": [0], "term": pa.array([None], pa.string()), "n": [0], "all_n": [0], "total": [divergence.MAX_TOTAL + 1], "all_total": [5]}
    with pytest.raises(ValueError, match="occurrences"):
        divergence.tile(pa.table(rows))


@pytest.mark.parametrize("size", [1, 2, 7, 1 << 20])
def test_words_in_slices(size):
    text = "Ab é日本 c_D9e  \x1f\x7f" * 9
    got = [w.decode() for words in byte_words(text.encode(), divergence.TERM_BYTES, size) for w in words]
    assert got == TERMS.findall(text.translate(UPPER))
