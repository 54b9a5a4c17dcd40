"""Time within a video: nearest segments, neighbours, slices and ordered chains.

A video may be long, so none of these orders a whole one in a task: times are taken in
spans, and what a span needs of the others is carried by one row a span."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stillpoint.functions.spans import SECONDS, running_count
from stillpoint.functions.tables import kept, scratch, written


def _span(t: Column, span: float) -> Column:
    return F.floor(t / span)


def nearest_segment(frames: DataFrame, segments: DataFrame, span: float = SECONDS) -> DataFrame:
    """For each frame (video_id, frame_id, t) the segment (video_id, segment_id, t) of its
    video at the least distance, on ties the earlier, then the smaller id; none if the
    video has none. Segments without a time take no part, frames without one have none.

    Both kinds are ordered together and the last segment before and the first after are
    running extremes, first inside a span and then over spans, so no range join is needed."""
    seg = F.struct(F.col("t").cast("double").alias("t"), (-F.col("segment_id")).cast("long").alias("back"))
    ahead = F.struct(F.col("t").cast("double").alias("t"), F.col("segment_id").cast("long").alias("id"))
    f = frames.select("video_id", "t", "frame_id", F.lit(None).cast("struct<t:double,back:long>").alias("before"), F.lit(None).cast("struct<t:double,id:long>").alias("after"))
    s = segments.filter("t is not null").select("video_id", "t", F.lit(None).cast(frames.schema["frame_id"].dataType).alias("frame_id"), seg.alias("before"), ahead.alias("after"))
    both = f.unionByName(s).withColumn("_span", _span(F.col("t"), span))
    spans = both.groupBy("video_id", "_span").agg(F.max("before").alias("_last"), F.min("after").alias("_first"))
    order = Window.partitionBy("video_id").orderBy("_span")  # one row a span
    spans = spans.select(
        "video_id", "_span", F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.min("_first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    up = F.max("before").over(Window.partitionBy("video_id", "_span").orderBy("t"))
    down = F.min("after").over(Window.partitionBy("video_id", "_span").orderBy(F.desc("t")))
    placed = both.withColumn("before", up).withColumn("after", down).filter("frame_id is not null").join(spans, ["video_id", "_span"], "left")
    placed = placed.withColumn("before", F.coalesce("before", "_earlier")).withColumn("after", F.coalesce("after", "_later"))
    early, late = F.col("t") - F.col("before.t"), F.col("after.t") - F.col("t")
    first = F.col("after").isNull() | (early <= late)
    return placed.select("video_id", "frame_id", "t", F.when(first, -F.col("before.back")).otherwise(F.col("after.id")).alias("segment_id"), F.when(first, early).otherwise(late).alias("distance"))


def neighbors(hits: DataFrame, frames: DataFrame, n: int, span: float = SECONDS) -> DataFrame:
    """Each hit (video_id, frame_id) expanded to the ±n nearest frames of its video by
    position, each frame once. Hits that are no frame, and frames without a time, are left out."""
    order = [F.col("t"), F.col("frame_id")]
    numbered = running_count(frames.select("video_id", "frame_id", "t"), "video_id", _span(F.col("t"), span), order, F.lit(True), "_n", "_all").drop("_all")
    around = hits.select("video_id", "frame_id").distinct().join(numbered.drop("t"), ["video_id", "frame_id"])
    around = around.select("video_id", F.explode(F.sequence(F.col("_n") - n, F.col("_n") + n)).alias("_n")).distinct()
    return numbered.join(around, ["video_id", "_n"]).select("video_id", "frame_id", "t")


def temporal_slice(frames: DataFrame, part: str, share: float = 0.25, anchors: DataFrame | None = None, span: float = SECONDS) -> DataFrame:
    """The ``first`` or ``last`` share of a video's frames, or those ``after`` its anchor
    (video_id, anchor_t). A share counts the frames before a frame among all others of its
    video, as a percent rank; frames of equal time and id stand together, those without a
    time take no part."""
    if part == "after":
        return frames.join(anchors.select("video_id", "anchor_t"), "video_id").filter(F.col("t") > F.col("anchor_t")).drop("anchor_t")
    if part not in ("first", "last"):
        raise ValueError(f"unknown part: {part}")
    turn = F.asc if part == "first" else F.desc
    up = _span(F.col("t"), span)
    tied = frames.groupBy("video_id", "t", "frame_id").agg(F.count(F.lit(1)).alias("_tied"))
    rows = frames.join(tied, ["video_id", "t", "frame_id"])
    rows = running_count(rows, "video_id", up if part == "first" else -up, [turn("t"), turn("frame_id")], F.lit(True), "_n", "_all")
    # a running count ends with the last of equals, a rank begins with their first
    rank = F.col("_n") - F.col("_tied")
    return rows.filter(rank <= F.lit(share) * (F.col("_all") - 1)).select(*frames.columns)


def sequences(hits: DataFrame, steps: list[str], gap: float) -> DataFrame:
    """For each video the best chain of hits (video_id, step, t, frame_id, score): one for
    each step, strictly later than the one before and by at most ``gap``. Ties of the total
    go to the chain of smaller ids.

    Each step keeps the best chain that ends in each hit: the best predecessor is the
    maximum over a range window of the chains of the step before, so no pair is made. The
    window works in spans as long as the gap; a chain is seen by its span and the next."""
    reach = round(gap * 1_000_000)
    if reach < 1:
        raise ValueError("gap must be positive")
    micros = F.round(F.col("t") * 1_000_000).cast("long")
    at_span = F.floor(F.col("_at") / reach)
    chains = hits.filter(F.col("step") == steps[0]).select("video_id", "t", "frame_id", F.col("score").alias("total"), F.array("frame_id").alias("chain"))
    for step in steps[1:]:
        now = hits.filter(F.col("step") == step).select("video_id", "t", "frame_id", "score", F.lit(None).cast("struct<total:double,back:long,chain:array<long>>").alias("best"))
        now = now.withColumn("_at", micros).withColumn("_span", at_span)
        then = chains.select("video_id", "t", F.lit(None).cast("long").alias("frame_id"), F.lit(None).cast("double").alias("score"),
                             F.struct(F.col("total"), (-F.element_at("chain", -1)).alias("back"), F.col("chain")).alias("best"))
        then = then.withColumn("_at", micros).withColumn("_span", F.explode(F.array(at_span, at_span + 1)))
        before = Window.partitionBy("video_id", "_span").orderBy("_at").rangeBetween(-reach, -1)
        found = now.unionByName(then).withColumn("prior", F.max("best").over(before)).filter("frame_id is not null and prior is not null")
        chains = found.select("video_id", "t", "frame_id", (F.col("prior.total") + F.col("score")).alias("total"), F.array_append("prior.chain", F.col("frame_id")).alias("chain"))
    best = chains.groupBy("video_id").agg(F.min(F.struct((-F.col("total")).alias("less"), F.col("chain"))).alias("b"))
    return best.select("video_id", (-F.col("b.less")).alias("total"), F.col("b.chain").alias("chain"))


def query_sequences(hits: DataFrame, steps: DataFrame) -> DataFrame:
    """For each query and video the best chain of hits, one for each of the query's steps.

    ``steps`` has a row for each sub-event of a query: ``query_id``, ``step`` (1, 2, 3, …),
    and ``gap``, the most seconds between a hit of this step and the one before (null: no
    limit; of the first step it means nothing). ``hits`` has ``query_id, step, video_id, t,
    frame_id, score``. A chain's times rise strictly; the highest sum of scores wins, ties go
    to the chain whose ids are smaller from the first step on. Returns ``query_id, video_id,
    total, chain``. Queries that lack a number of their steps have no chain.

    A frontier holds the best chain that ends in each hit of the last step of every query;
    a step extends it for all queries at once. The best predecessor of a hit is found
    without pairs: time is cut into spans as long as the gap, so it lies in the hit's own
    span, among the chains before the hit, or in the span before, among the chains from the
    hit's time less the gap on. Both are running extremes of a span."""
    spark = hits.sparkSession
    reach = F.round(F.col("gap") * 1_000_000).cast("long")
    asked = steps.select("query_id", "step", reach.alias("_reach")).filter("step = 1 or _reach is null or _reach > 0")
    own = hits.select("query_id", "step", "video_id", "frame_id", F.round(F.col("t") * 1_000_000).cast("long").alias("at"), "score").filter("at is not null and score is not null")
    key = ["query_id", "video_id"]
    best = "struct<total:double,back:array<long>>"
    with scratch(spark):
        own = written(own.join(asked, ["query_id", "step"]), "step-hits")
        lengths = steps.groupBy("query_id").agg(F.max("step").alias("_last"), F.count_distinct("step").alias("_n"), F.min("step").alias("_first"))
        lengths = written(lengths.filter("_first = 1 and _n = _last").select("query_id", "_last"), "lengths")
        most = lengths.agg(F.max("_last")).first()[0] or 0
        first = own.filter("step = 1").select(*key, "at", F.struct(F.col("score").cast("double").alias("total"), F.array(-F.col("frame_id")).alias("back")).alias("best"))
        frontier = written(first, "frontier")
        done = [frontier.join(lengths.filter("_last = 1"), "query_id", "left_semi")]
        span = F.when(F.col("_reach").isNull(), 0).otherwise(F.floor(F.col("_at") / F.col("_reach"))).cast("long")
        for step in range(2, most + 1):
            reaches = asked.filter(F.col("step") == step).select("query_id", "_reach")
            chains = frontier.join(reaches, "query_id").select(*key, F.col("at").alias("_at"), "_reach", F.col("best"), F.lit(None).cast("long").alias("hit"), F.lit(None).cast("boolean").alias("later"))
            # numbered, so that equal hits are told apart and come together again
            now = written(own.filter(F.col("step") == step).withColumn("hit", F.monotonically_increasing_id()), "now")
            none = F.lit(None).cast(best).alias("best")
            before = now.select(*key, F.col("at").alias("_at"), "_reach", none, "hit", F.lit(False).alias("later"))
            after = now.filter("_reach is not null").select(*key, (F.col("at") - F.col("_reach")).alias("_at"), "_reach", none, "hit", F.lit(True).alias("later"))
            both = chains.unionByName(before).unionByName(after).withColumn("_span", span)
            order = Window.partitionBy(*key, "_span").orderBy("_at")
            up = F.max("best").over(order.rangeBetween(Window.unboundedPreceding, -1))
            down = F.max("best").over(order.rangeBetween(0, Window.unboundedFollowing))
            prior = both.select("hit", F.when(F.col("later"), down).otherwise(up).alias("prior")).filter("hit is not null and prior is not null")
            prior = prior.groupBy("hit").agg(F.max("prior").alias("prior"))
            longer = F.struct((F.col("prior.total") + F.col("score")).alias("total"), F.array_append("prior.back", -F.col("frame_id")).alias("back"))
            frontier = written(now.join(prior, "hit").select(*key, "at", longer.alias("best")), "frontier")
            done.append(frontier.join(lengths.filter(F.col("_last") == step), "query_id", "left_semi"))
        chains = reduce(DataFrame.unionByName, done).groupBy(*key).agg(F.max("best").alias("best"))
        return kept(chains.select(*key, F.col("best.total").alias("total"), F.transform("best.back", lambda x: -x).alias("chain")), "chains")


def temporal_proximity(hits: DataFrame, frames: DataFrame, anchors: DataFrame, scale: float, span: float = SECONDS) -> DataFrame:
    """A hit list of how near the frames of other hits are to a query's moments: 1 / (1 +
    distance / ``scale``) from the nearest anchor (query_id, video_id, t) of the query in the
    frame's video. ``frames`` has item_id, video_id and t. Hits without a frame, and frames
    of videos without an anchor of the query, have no row.

    Each query's videos are videos of their own to ``nearest_segment``, so the nearest
    anchors are running extremes and no ranges are joined."""
    own = F.to_json(F.struct(F.col("query_id"), F.col("video_id"))).alias("video_id")
    asked = hits.select("query_id", "item_id").distinct().join(frames.select("item_id", "video_id", "t"), "item_id")
    asked = asked.select(own, F.struct("query_id", "item_id").alias("frame_id"), "t")
    moments = anchors.select(own, F.lit(0).cast("long").alias("segment_id"), "t")
    near = nearest_segment(asked, moments, span).filter("distance is not null")
    near = near.select("frame_id.query_id", "frame_id.item_id", (1 / (1 + F.col("distance") / F.lit(float(scale)))).alias("score"))
    return near.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
