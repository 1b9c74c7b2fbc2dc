import hashlib
import random
import time

import duckdb
import numpy as np
import public_tokenizers
import pytest
from lodestone.llm import bpe, token_count
from tokenizers import Tokenizer

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "'", "'r", "'re", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "日本", "語", "1", "23", "!!", "...", "-", "The", "thonble", "\xa0", "　", "😀", "x" * 70, "ab" * 90, "'s", "<|endoftext|>", "\x1c", "\x85", "​", "= ", "    "]


def texts(n, seed):
    rng = random.Random(seed)
    return ["", "a", " ", *("".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(n))]


@pytest.mark.parametrize("leaf", [(4096, 128), (3, 2), (17, 6)])
def test_tree_equals_the_library(leaf):
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN, *leaf)
    for t in texts(400, leaf[0]):
        ids = codec.encode(t)
        assert ids.tolist() == codec.core.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_long_texts_without_white_space():
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(3)
    for t in ("a" * 20000, "".join(rng.choice("abcdeé") for _ in range(20000)), " " * 9000 + "x", "日本語" * 3000):
        assert codec.encode(t).tolist() == codec.core.encode_ordinary(t)


def test_counts_equal_the_library_at_every_prefix():
    counter = token_count.Counter(JSON, public_tokenizers.PATTERN)
    library = Tokenizer.from_file(JSON)
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for k, t in enumerate(texts(600, 9)):
        assert counter.count(t) == n(t), t
        if k < 150:
            assert counter.at_every_prefix(t) == [n(t[:i]) for i in range(len(t) + 1)], t


def test_very_long_texts():
    """Runs without white space, apostrophes in them, and long white space: time grows with the length."""
    counter = token_count.Counter(JSON, public_tokenizers.PATTERN)
    library = Tokenizer.from_file(JSON)
    rng = random.Random(5)
    for t in ("x'" + "q" * 3000, "".join(rng.choice("abc'tré1!") for _ in range(3000)), " " * 2500 + "x", "'" * 2500 + "re" * 300):
        table = counter.at_every_prefix(t)
        some = [0, 1, 2, 3, 5, 100, len(t) - 2, len(t) - 1, len(t)]
        assert [table[k] for k in some] == [len(library.encode(t[:k], add_special_tokens=False).ids) for k in some]
    began = time.perf_counter()
    for t in ("a" * 1_000_000, "'" + "".join(rng.choice("abcdefgh") for _ in range(300_000)), "'a" * 200_000, "'" * 500_000, " " * 500_000 + "x", "é" * 300_000):
        k = counter.fitting(t, 1024)
        assert 0 < k < len(t)
    assert time.perf_counter() - began < 60


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, n_tokens int, n_bytes int, ids_sha256 int")
    assert [r["n_tokens"] for r in token_count.counted(docs, JSON, public_tokenizers.PATTERN).collect()] == [2]
    assert [r["n_tokens"] for r in bpe.encoded(docs, RANKS, public_tokenizers.PATTERN).collect()] == [2]


def test_fitting_needs_no_more_tokens():
    counter = token_count.Counter(JSON, public_tokenizers.PATTERN)
    for t in texts(100, 4):
        table = counter.at_every_prefix(t)
        for budget in (0, 1, 5, 40):
            k = counter.fitting(t, budget)
            assert table[k] <= budget or "<|endoftext|>" in t
            if k < len(t) and "<|endoftext|>" not in t:
                assert table[-1] > budget


def test_frames(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path)
    extra = spark.createDataFrame([(None, None), (-1, ""), (-1, "")], "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) lang", "'x' source", "0L n_chars")
    docs = docs.unionByName(extra)
    library, codec = Tokenizer.from_file(JSON), bpe.Codec(RANKS, public_tokenizers.PATTERN)
    whole = dict(duckdb.sql(f"select doc_id, text from '{path}'").fetchall()) | {None: "", -1: ""}
    counts = token_count.counted(docs, JSON, public_tokenizers.PATTERN).collect()
    codes = bpe.encoded(docs, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(counts) == len(codes) == len(whole) + 1
    for r in counts:
        t = whole[r["doc_id"]]
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024)
    for r in codes:
        t = whole[r["doc_id"]]
        ids = codec.core.encode_ordinary(t)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert token_count.counted(docs.limit(0), JSON, public_tokenizers.PATTERN).count() == 0
    assert bpe.encoded(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
