"""Order inside long groups: positions and running counts by spans.

A group (a video, a log) may be one of a few that hold most rows. Its rows are ordered in
spans, each by itself, and only one row a span is ordered over the whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stillpoint.functions.tables import written

#: Seconds of a video, and lines of a log, that one task orders at most.
SECONDS, LINES = 86_400.0, 50_000


def running_count(rows: DataFrame, key: str, span: Column, order: list[Column], flag: Column, name: str, total: str) -> DataFrame:
    """Number of rows with ``flag`` up to each row in ``order`` (peers included) as
    ``name``, and in its whole group as ``total``. ``span`` must not fall along ``order``,
    and peers must share one. Rows with a null key have no group and are left out."""
    hit = F.count(F.when(flag, 1))
    inner = Window.partitionBy(key, "_span").orderBy(*order)
    ahead = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # one row a span
    dealt = rows.withColumn("_span", span)
    spans = dealt.groupBy(key, "_span").agg(hit.alias("_all"))
    spans = spans.select(key, "_span", F.coalesce(F.sum("_all").over(ahead), F.lit(0)).alias("_before"), F.sum("_all").over(Window.partitionBy(key)).alias(total))
    out = dealt.withColumn("_own", hit.over(inner)).join(spans, [key, "_span"])
    return out.withColumn(name, F.col("_own") + F.col("_before")).drop("_span", "_own", "_before")


def placed(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """The position of each row in the order of the whole table, from 0. The table is cut
    into ranges that are written once, so that no task has more than a range."""
    ranges = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_range").orderBy(*order)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = ranges.withColumn("_own", F.row_number().over(own)).join(sizes, "_range")
    return out.withColumn(name, F.col("_before") + F.col("_own") - 1).drop("_range", "_own", "_before")
