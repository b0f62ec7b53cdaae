"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Three combining steps, each keyed by digest *and* whole normalised text, so equal
digests never stand in for equal content:

1. local: the map-side half of the first aggregation leaves one row for each text
   and map task, as the salt is the task's own partition;
2. salted: groups of (digest, salt, text) spread the copies of one text over
   ``salts`` reducers;
3. global: one row for each salt winner meets in (digest, text).

Membership goes back to the rows by digest alone, after it was proved that every
digest has one text; otherwise by digest and text.  Classes that hold over one row
in ``HOT_SHARE`` are at most ``HOT_SHARE`` in number, so they may be broadcast, and
their rows are dealt over the salts.

Defined results: a null text is empty; empty texts are equal to each other; a null
id stays only if no other row of its length does; of rows that repeat id and text
exactly one is kept; an empty table gives an empty result; columns other than id
and text are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import ASCII_SPACE, unused
from tidewell.plans.staging import compact, parts_of, stage

#: A class is hot if it holds more than one row in so many.
HOT_SHARE = 2000
_TOP, _BASE = Decimal(2**63), Decimal(2**65)


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """One number that orders rows by length, then by smaller id; a null id comes last."""
    by_id = F.coalesce(F.lit(_TOP) - doc_id.cast("bigint").cast("decimal(20,0)"), F.lit(Decimal(0)))
    return (n_chars.cast("decimal(10,0)") * F.lit(_BASE) + by_id).cast("decimal(38,0)")


def _rank_id(rank: Column) -> Column:
    by_id = rank % F.lit(_BASE)
    return F.when(by_id != 0, (F.lit(_TOP) - by_id).cast("bigint"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, n_chars, text_digest (binary).

    Texts are equal if they are identical after ``ASCII_SPACE`` is deleted.  Of equal
    texts the longest original stays, then the smallest id.  Ids are integers.
    """
    raw = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_raw"))
    rows = raw.select("_id", F.length("_raw").alias("_n"), F.regexp_replace("_raw", ASCII_SPACE, "").alias("_norm")).select(
        "_id", "_norm", digest(F.col("_norm")).alias("_dig"), _rank(F.col("_n"), F.col("_id")).alias("_rank"), "_n"
    )
    local = rows.withColumn("_salt", F.spark_partition_id() % salts)
    salted = local.groupBy("_dig", "_salt", "_norm").agg(F.max("_rank").alias("_rank"), F.count(F.lit(1)).alias("_size"))
    whole = salted.groupBy("_dig", "_norm").agg(F.max("_rank").alias("_top"), F.sum("_size").alias("_size"))
    n = docs.count()
    classes = stage(whole.select("_dig", "_top", "_size"), "dedup-classes", rows=n, width=80, least=parts_of(docs))

    key = ["_dig"]
    if not classes.groupBy("_dig").count().filter("count > 1").isEmpty():  # two texts share a digest: content joins the key
        key, classes = ["_dig", "_norm"], stage(whole, "dedup-texts")
    thin = stage(rows.select("_id", "_n", "_rank", *key, F.monotonically_increasing_id().alias("_row")), "dedup-rows", rows=n, width=100, least=parts_of(docs))

    first = thin.groupBy(*key, F.col("_rank").alias("_top")).agg(F.min("_row").alias("_first"))
    classes = stage(classes.join(first, [*key, "_top"]), "dedup-winners", rows=n, width=90)
    total = classes.agg(F.sum("_size")).first()[0] or 0
    hot = classes.filter(F.col("_size") * HOT_SHARE > total).select(*key, F.lit(True).alias("_hot"))
    salted_classes = classes.withColumn("_salt", F.explode(F.when(F.col("_size") * HOT_SHARE > total, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    dealt = thin.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.hash("_row"), F.lit(salts))).otherwise(F.lit(0)))
    return dealt.join(salted_classes, [*key, "_salt"]).select(
        F.col("_id").alias("doc_id"), _rank_id(F.col("_top")).alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_row") == F.col("_first")).alias("kept"), F.col("_n").alias("n_chars"), F.col("_dig").alias("text_digest")
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with their columns.

    Rows that repeat a kept row's id, text class and length are one row, as any of them may stay.
    """
    k_id, k_dig, k_n, dig, n = unused(docs, "k_id", "k_dig", "k_n", "dig", "n")
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias(k_id), F.col("text_digest").alias(k_dig), F.col("n_chars").alias(k_n))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.withColumns({dig: _sha256(F.regexp_replace(text, ASCII_SPACE, "")), n: F.length(text)})
    found = own.join(kept, F.col(id_col).cast("bigint").eqNullSafe(F.col(k_id)) & (F.col(dig) == F.col(k_dig)) & (F.col(n) == F.col(k_n)), "left_semi")
    repeats = docs.groupBy(F.col(id_col).alias(k_id)).count().filter("count > 1")
    if not repeats.isEmpty():  # ids repeat in this table: of their equal rows one stays
        found = found.dropDuplicates([dig])
    return compact(found.drop(dig, n), docs)
