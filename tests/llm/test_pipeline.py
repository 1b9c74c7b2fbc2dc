import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from lodestone.llm import bpe, decontaminate, pii, queries, toxicity
from tests.llm.test_minhash import classes

DIR = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = queries.toxicity_model(spark, docs, DIR)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    s = toxicity.scores(model, list(rows.values()))
    rows = {i: t for (i, t), x in zip(rows.items(), s, strict=True) if x < toxicity.THRESHOLD}
    rows = {i: rows[i] for i, root in classes(list(rows.items())).items() if i == root}
    index = decontaminate.Index(*zip(*((r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()), strict=True))
    plain = [" ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) for t in rows.values()]
    near = {k for k, t in enumerate(plain) if any(decontaminate.best_window(x, t, int(decontaminate.MAX_EDITS * len(x))) for x in index.plain)}
    assert near
    rows = {i: t for k, (i, t) in enumerate(rows.items()) if k not in near}
    cipher = pii.Cipher(queries.pii_key(spark))
    codec = bpe.Codec(public_tokenizers.path(queries.BPE_RANKS), public_tokenizers.PATTERN)
    want = set()
    for i, t in rows.items():
        ids = codec.core.encode_ordinary(pii.replaced(cipher, t)[0])
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, DIR).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_columns_and_take_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13)], "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        at = some
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, DIR)
            assert at.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, at, DIR).count() == (3 if some is docs else 0)
