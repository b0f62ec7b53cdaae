"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The characters that count as white space in the contracts of this package.
ASCII_SPACE = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of an Arrow batch that a Python worker is sent, where the session sets no bound of its own.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` would also fold other alphabets."""
    return F.translate(text, UPPER, UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    """Rows whose labels may be learned from: a known id that is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def doc_key(doc_id: Column, text: Column) -> Column:
    """Key of a row for joining results back: equal rows share it, rows that merely repeat an id do not."""
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), doc_id.isNull(), F.coalesce(text, F.lit("")))


def in_arrow(df: DataFrame, work: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow``, with batches of bounded size however long the texts are."""
    conf = df.sparkSession.conf
    if conf.get(BATCH[0], None) is None:
        conf.set(*BATCH)
    return df.mapInArrow(work, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        own = f"_{name}"
        while own in taken:
            own += "_"
        out.append(own)
    return out
