"""Candidate events: generators, filters, dedup, spacing and caps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stillpoint.functions.ids import millis
from stillpoint.functions.ranks import best_first, source_priority
from stillpoint.functions.spans import SECONDS

#: Room for the events of one source in the order of a union.
LANE = 1 << 40


def scene_filter(frames: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Frames whose score is strictly above the threshold; one that is no number isn't."""
    return frames.filter((F.col("score") > threshold) & ~F.isnan("score"))


def nonnegative_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("t") >= 0)


def seed_events(videos: DataFrame) -> DataFrame:
    """One event at the start of each video."""
    return videos.select("video_ord", "video_id", F.lit(0.0).alias("t"), F.lit("seed").alias("source"), F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("ord"))


def _steps(duration: Column, interval: float) -> Column:
    return F.when(duration > 0, F.floor(duration / interval)).otherwise(0).cast("long")


def periodic_events(videos: DataFrame, interval: float) -> DataFrame:
    """Events at every multiple of the interval up to the duration, which may be one."""
    n = _steps(F.col("duration"), interval)
    steps = videos.filter(n >= 1).select("video_ord", "video_id", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("i"))
    return steps.select("video_ord", "video_id", (F.col("i") * F.lit(float(interval))).alias("t"), F.lit("periodic").alias("source"), F.lit(0.0).alias("score"), F.col("i").alias("ord"))


def tail_events(videos: DataFrame, interval: float) -> DataFrame:
    """An event shortly before the end, unless the last periodic one is near it."""
    half, d = interval / 2, F.col("duration")
    tail = F.greatest(F.lit(0.0), d - F.lit(min(1.0, max(0.1, half))))
    n = _steps(d, interval)
    apart = (n < 1) | (tail - n * F.lit(float(interval)) > half)
    return videos.filter((d > 0) & (tail > 0) & apart).select(
        "video_ord", "video_id", tail.alias("t"), F.lit("periodic").alias("source"), F.lit(0.0).alias("score"), (n + 1).alias("ord")
    )


def event_union(*sources: DataFrame) -> DataFrame:
    """Events of all sources; the order of the arguments is the order of ties."""
    lanes = [s.withColumn("ord", F.col("ord") + F.lit(k * LANE)) for k, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, lanes)


def read_attempts(frames: DataFrame) -> DataFrame:
    """Times at which to try reading a frame: its own, then a little earlier, in order."""
    back = F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 1.0)])
    tries = F.array_distinct(F.transform(back, lambda o: F.greatest(F.lit(0.0), F.col("t") - o)))
    return frames.select("*", F.posexplode(tries).alias("attempt", "attempt_t"))


def scene_dedupe(scenes: DataFrame) -> DataFrame:
    """The earliest scene of each millisecond of a video, not the best one."""
    order = Window.partitionBy("video_ord", millis(F.col("t"))).orderBy("t", "ord")
    return scenes.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def _islands(events: DataFrame, spacing: float, span: float) -> DataFrame:
    """Number the stretches of a video between gaps of at least ``spacing``.

    A video is ordered in spans: within a span by a window, between spans over one row a
    span, so a very long video is no single task."""
    part = Window.partitionBy("video_ord", "_span").orderBy("t", "ord")
    inner = events.withColumn("_span", F.floor(F.col("t") / span)).withColumn("_last", F.lag("t").over(part))
    whole = inner.groupBy("video_ord", "_span").agg(
        F.min("t").alias("_low"), F.max("t").alias("_high"), F.count(F.when(F.col("t") - F.col("_last") >= spacing, 1)).alias("_inner")
    )
    spans = Window.partitionBy("video_ord").orderBy("_span")
    whole = whole.withColumn("_prior", F.lag("_high").over(spans))
    cut = F.coalesce(F.col("_low") - F.col("_prior") >= spacing, F.lit(True)).cast("long")
    before = F.sum(F.col("_inner") + cut).over(spans) - F.col("_inner")
    whole = whole.select("video_ord", "_span", before.alias("_before"))
    far = F.coalesce(F.col("t") - F.col("_last") >= spacing, F.lit(False)).cast("long")
    own = F.sum(far).over(part.rowsBetween(Window.unboundedPreceding, 0))
    return inner.withColumn("_own", own).join(whole, ["video_ord", "_span"]).withColumn("_island", F.col("_before") + F.col("_own")).drop("_span", "_last", "_own", "_before")


def _fold(batches: Iterator[pa.RecordBatch], spacing: float) -> Iterator[pa.RecordBatch]:
    """Kept events of rows sorted by island and time. What is held between batches is the
    last kept event alone."""
    held = key = last = rank = None
    for batch in batches:
        kept, at = [], -1  # place of the last kept event, -1 while it is ``held``
        columns = [batch.column(c).to_pylist() for c in ("video_ord", "_island", "t", "_priority", "_score")]
        for i, (video, island, t, priority, score) in enumerate(zip(*columns)):
            if (video, island) != key or t - last >= spacing:
                if at >= 0:
                    kept.append(at)
                elif held is not None:
                    yield held
                key, last, rank, at = (video, island), t, (priority, score), i
            elif (priority, score) > rank:
                last, rank, at = t, (priority, score), i
        if kept:
            yield batch.take(pa.array(kept))
        if at >= 0:
            held = batch.slice(at, 1)
    if held is not None:
        yield held


def spacing_merge(events: DataFrame, spacing: float, span: float = SECONDS) -> DataFrame:
    """Keep events at least ``spacing`` apart: by ascending time, an event near the last
    kept one replaces it if it ranks strictly higher, and is dropped otherwise.

    Only the last kept event can be near, and a gap of ``spacing`` between neighbours of
    the input always starts a new kept event, so the stretches between such gaps are
    folded apart from each other, each as a sorted stream of which one event is held.
    """
    if spacing == 0:
        return events
    islands = _islands(events, spacing, span)
    ranked = islands.withColumn("_priority", source_priority(F.col("source"))).withColumn("_score", F.coalesce("score", F.lit(0.0)))
    dealt = ranked.repartition("video_ord", "_island").sortWithinPartitions("video_ord", "_island", "t", "ord")
    return dealt.mapInArrow(lambda it: _fold(it, spacing), dealt.schema).select(*events.columns)


def candidate_cap(events: DataFrame, most: int | None) -> DataFrame:
    """The ``most`` highest-ranking events of each video; None keeps all."""
    if most is None:
        return events
    order = Window.partitionBy("video_ord").orderBy(*best_first(source_priority(F.col("source")), F.col("score"), F.col("t"), F.col("ord")))
    return events.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")
