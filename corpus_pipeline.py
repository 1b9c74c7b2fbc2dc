"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, tokens. Each stage reads all
that the one before it kept, from a written table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, decontaminate, minhash, pii, toxicity
from lodestone.llm.common import forget, shared_dir
from lodestone.llm.queries import BPE_RANKS, pii_key, table, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of a classifier trained on the labels that may be learnt from. Null and empty texts have the score
    of a text without evidence; repeated rows stay or go together; other columns, whatever their names, go along; no rows give none."""
    return toxicity.cleaned(spark, docs, toxicity_model(spark, docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest doc_id; of rows that repeat it, any one. Rows with a null doc_id, and texts without
    words, are no one's duplicates; other columns go along; no rows give none."""
    return minhash.deduplicated(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows stay or go together; other columns go along; no
    rows give none."""
    return decontaminate.cleaned(spark, docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in their texts. n_chars stays that of the document as it came in. Null texts stay null; rows with equal
    texts get equal ones; other columns go along; no rows give none."""
    return pii.pseudonymised(spark, docs, pii_key(spark)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the tokens and of the texts that they decode to, one row per row. Null and empty texts have no tokens;
    long ones are encoded in halves; other columns are not read; no rows give none."""
    return bpe.encoded(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("bpe", encode),
]

#: SQL expresses none of these stages; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; between stages, tables in the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            forget(spark, before)  # the next stages read only this one's table
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
