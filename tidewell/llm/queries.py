"""The thin queries of this package: each derives its contract's columns from an operator's result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import backoff, byte_bpe, langid, line_crf, token_shards
from tidewell.llm.common import held_out, may_learn, table
from tidewell.llm.decontam import decontaminate
from tidewell.llm.exact_dedup import exact_dedup
from tidewell.llm.ngram_join import jaccard_components
from tidewell.llm.quotes import reply_order
from tidewell.llm.secrets import KINDS, scan_secrets, spans_text


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    per_word = F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")).otherwise(F.lit(0.0))
    return backoff.score(docs).select("doc_id", "n_words", "score", per_word.alias("score_per_word"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reply_order(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "text", "reply_to", "n_quoted", "n_linked", "n_confirmed", F.col("order_key.branch").alias("branch"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = line_crf.learn(docs, table(spark, sf_dir, "labels"), may_learn(F.col("doc_id")))
    out = line_crf.score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_digest")).alias("text_sha256"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, may_learn(F.col("doc_id")))
    return langid.identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return out.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def _file(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = _file("byte_bpe_multi_50k.tiktoken")
    out = byte_bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_shards.write_shards(table(spark, sf_dir, "documents"), _file("word_bpe_49k.json"), end_id=2)
    return token_shards.read_shards(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_score": op1_lm_score,
        "op2_decontaminate": op2_decontaminate,
        "op3_chat_format": op3_chat_format,
        "op4_quality": op4_quality,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_jaccard": op6_jaccard,
        "op7_language": op7_language,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_secrets": op9_secrets,
        "op10_token_shards": op10_token_shards,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_lm_score": r"""
            WITH w AS (
                SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
            ), t AS (
                SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w
            ), u AS (
                SELECT word, count(*) AS n FROM t GROUP BY word
            ), k AS (
                SELECT doc_id, pos, word AS w2, coalesce(lag(word) OVER (PARTITION BY doc_id ORDER BY pos), ' start') AS w1 FROM t
            ), b AS (
                SELECT w1, w2, count(*) AS n FROM k GROUP BY w1, w2
            ), s AS (
                SELECT b.w1, b.w2, CAST(round(ln(CASE WHEN b.n >= 2 THEN b.n / CAST(coalesce(u1.n, (SELECT count(*) FROM w WHERE len(ws) > 0)) AS DOUBLE)
                       ELSE 0.4::DOUBLE * u2.n / (SELECT count(*) FROM t) END) * 1000000) AS BIGINT) AS micro
                FROM b LEFT JOIN u u1 ON b.w1 = u1.word JOIN u u2 ON b.w2 = u2.word
            ), d AS (
                SELECT k.doc_id, count(*) AS n_words, CAST(sum(s.micro) AS BIGINT) AS micro FROM k JOIN s ON k.w1 = s.w1 AND k.w2 = s.w2 GROUP BY k.doc_id
            )
            SELECT w.doc_id, coalesce(d.n_words, 0) AS n_words, CAST(coalesce(d.micro, 0) AS DOUBLE) / 1000000 AS score,
                   CASE WHEN d.n_words > 0 THEN CAST(d.micro AS DOUBLE) / 1000000 / d.n_words ELSE CAST(0 AS DOUBLE) END AS score_per_word
            FROM w LEFT JOIN d ON w.doc_id = d.doc_id
        """,
        "op5_exact_dedup": r"""
            WITH n AS (
                SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
            ), r AS (
                SELECT doc_id, norm, row_number() OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS rn, count(*) OVER (PARTITION BY norm) AS group_size,
                       first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id
                FROM n
            )
            SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r
        """,
    }
