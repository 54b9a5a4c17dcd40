"""Shared helpers: staged tables, batch sizes, ids and texts of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stillpoint.functions.tables import discard, new_path, returning
from stillpoint.functions.tables import written as staged

__all__ = ["bounded_batches", "discard", "held_out", "new_path", "order_id", "packed_rows", "returning", "staged"]

HELD_LAST = (1 << 63) - 1


def bounded_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 0) -> None:
    """Texts are long: Arrow batches of Spark's default of 10,000 rows of them would fill a
    Python worker. A smaller size that the session has is kept. With ``megabytes`` a batch ends
    at about so many: an executor holds each several times outside its heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    if megabytes:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def order_id(column: str) -> Column:
    """A document id for ordering; a null id sorts after every other one."""
    return F.coalesce(F.col(column).cast("long"), F.lit(HELD_LAST))


def packed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` holds every input column, so that no column of the input can clash with
    the working columns ``did`` and ``txt``. A null text counts as empty."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        order_id(id_col).alias("did"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("txt"),
    )


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """True for rows whose crc32 of the id as text leaves ``remainder``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
