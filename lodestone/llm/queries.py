"""The operators of this subpackage over whole tables, with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, divergence, html_text, language, licenses, minhash, pii, quality, search, token_count, toxicity, warc

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
COUNTED = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no classifier learns from. A null id is not held out, and never learnt from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.trained(docs, labels.where(~held_out()))


def pii_key(spark: SparkSession) -> bytes:
    """spark.lodestone.pii.secret (a name that Spark's own pages and logs redact); where it is unset, a random one for this session: surrogates then agree within the session, and
    nobody can undo them or make them again."""
    if not spark.conf.get("spark.lodestone.pii.secret", None):
        spark.conf.set("spark.lodestone.pii.secret", secrets.token_hex(32))
    return spark.conf.get("spark.lodestone.pii.secret").encode()


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(spark, table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.scored(spark, docs, toxicity_model(spark, docs, sf_dir))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "n_lines", "n_stutters", "n_ellipses", "longest_word")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(spark, table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(spark, table(spark, sf_dir, "pages"))
    return warc.read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.counted(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNTED), public_tokenizers.PATTERN)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(spark, table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.found(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))  # as held_out(): never learnt from
    rows = language.identified(spark, docs, language.trained(docs.where(~out)))
    return rows.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_text, op2_near_duplicates, op3_toxicity, op4_quality, op5_licenses, op6_decontamination, op7_warc, op8_bpe, op9_token_counts, op10_pii, op11_source_divergence, op12_ranked_search, op13_language_id)}


_BITS = " + ".join(f"(case when {r.fails} then {1 << r.bit} else 0 end)" for r in quality.RULES)
_POLICY = " or ".join(f"({r.fails})" for r in quality.RULES if r.name in quality.POLICIES["2026-1"].rules)

QUALITY_SQL = rf"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
w as (select row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
places as (select row, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5),
runs as (select row, i, array_to_string(words[i:i + 4], ' ') as run from places),
twice as (select row, i from (select row, i, count(*) over (partition by row, run) as n from runs) where n > 1),
repeated as (select row, count(distinct i + k) as n from twice, range(0, 5) as r(k) group by row),
lines as (select row, unnest(string_split(text, chr(10))) as line from d),
full_lines as (select row, line from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
line_counts as (select row, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines,
  count(*) filter (where regexp_matches(line, '\.\.\.[\x20\x09-\x0D]*$')) as n_ellipses from full_lines group by row),
measured as (select doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_lines, 0) as n_lines,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, coalesce(n_ellipses, 0) as n_ellipses,
  coalesce(list_max(list_transform(words, lambda x: strlen(x))), 0) as longest_word,
  len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) as n_stutters
  from w left join line_counts using (row) left join repeated r using (row))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed, not ({_POLICY}) as kept, ({_BITS})::bigint as failed,
  n_lines, n_stutters, n_ellipses, longest_word from measured"""

WARC_SQL = f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select payload_digest, max(page_id) as last from p where payload_bytes >= {warc.REVISIT_BYTES} group by payload_digest having count(*) > 1)
select page_id, payload_bytes, payload_digest, case when page_id is distinct from last and last is not null then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from last then last end as refers_to from p left join m using (payload_digest)"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quality": QUALITY_SQL, "op5_licenses": licenses.oracle_sql(), "op7_warc": WARC_SQL, "op11_source_divergence": divergence.ORACLE_SQL, "op12_ranked_search": search.ORACLE_SQL}
