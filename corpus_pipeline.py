"""A corpus pipeline over ``documents``: each stage's rows are written as Parquet and are the next one's documents.

language       rejects texts without letters and texts whose n-grams are mostly in no learned language
exact          keeps one of equal texts
near           keeps one document of each component of near-duplicates: five-word shingles, a similarity of 0.8 or more
decontaminate  drops documents that the benchmark contaminates
encode         gives the remaining documents' token ids and checks that they decode to the text

Defined results: a null, empty or letterless text is rejected by the first stage; of rows
that repeat an id and a text one stays; rows that share an id with different texts are
judged each for itself, and of those in one component of near-duplicates one stays; a null
id goes only with its component; an empty table gives an empty result; documents may have
any other columns, whatever their names, and all stages but the last return them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import byte_bpe, decontam, exact_dedup, langid, ngram_join
from tidewell.llm.common import may_learn, table
from tidewell.plans.staging import compact, stage

#: Share of a text's n-grams that must be in its language.  Running prose has over 0.9, short or mixed texts over 0.5.
LEAST_KNOWN = 0.2
#: Words of a shingle and least similarity in percent of near-duplicates.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(docs, may_learn(F.col("doc_id")))
    return langid.keep_identified(docs, model, LEAST_KNOWN)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    out = byte_bpe.round_trip(compact(docs, docs), ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("encode", encode)]

#: The language model and the near-duplicate components have no SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}", "zstd")
    return docs
