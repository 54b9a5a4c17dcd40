"""Search over keyframes: text postings, vector top-k, fusion and reranking, evaluation.

Hit lists have the columns ``query_id, item_id, score``. Queries are the small side by
nature; they are broadcast only through Spark's own size check, never by force.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stillpoint.functions.tables import written
from stillpoint.operators.postings import Segment, document_frequency, matches, query_terms, segment_of, terms, text_index
from stillpoint.operators.vectors import HELD, top_hits, unit, video_scores


def top_k(hits: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k best hits of each query with their ``rank``, ties by item."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "item_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _segments(index) -> list[Segment]:
    """Of a stored index, or of a table of postings."""
    return [segment_of(index)] if isinstance(index, DataFrame) else index.segments()


def text_exact(index, queries: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Items that hold every distinct term of a query; the score is the sum of their term
    frequencies. With ``items``, ``phrase`` tells whether the query occurs as it is.

    ``index`` is a ``TextStore`` or a table of postings. The hits are written before their
    texts are met, so that Spark knows how few they are."""
    hits = matches(_segments(index), queries, 0).withColumn("score", F.col("score").cast("long"))
    if items is None:
        return hits
    hits = written(hits, "hits")
    texts = items.join(hits.select("item_id").distinct(), "item_id", "left_semi").select("item_id", F.lower("text").alias("_text"))
    asked = queries.select("query_id", F.lower("text").alias("_query"))
    return hits.join(texts, "item_id").join(asked, "query_id").withColumn("phrase", F.contains("_text", "_query")).drop("_text", "_query")


def text_fuzzy(index, queries: DataFrame, distance: int = 1) -> DataFrame:
    """Items that hold, for every distinct term of a query, a term within edit distance 1;
    each term counts its best posting, tf / (1 + distance)."""
    if distance != 1:
        raise ValueError("edit distance 1 is supported")
    return matches(_segments(index), queries, 1)


def vector_top_k(items: DataFrame, queries: DataFrame, k: int, lanes: int | None = None, held: int = HELD, seen: Observation | None = None) -> DataFrame:
    """Exact cosine top-k over integer ids; a hit on the query's own id is left out.
    Vectors of different lengths don't compare. ``seen`` observes ``pairs`` and ``skipped``."""
    one = F.lit(0).alias("part")
    return top_k(top_hits(items.select("item_id", "vec", one), queries.select("query_id", "vec", one), k, lanes, held, seen), k)


def color_filter(items: DataFrame, color, column: str = "dominant_colors") -> DataFrame:
    return items.filter(F.array_contains(column, color))


def color_search(items: DataFrame, queries: DataFrame, k: int, lanes: int | None = None, held: int = HELD) -> DataFrame:
    """Top-k by vector among items that have the query's colour (column ``color``). A task
    has the items and queries of one colour. A null colour has no items."""
    own = items.select("item_id", "vec", F.explode(F.array_distinct("dominant_colors")).alias("part")).filter("part is not null")
    return top_k(top_hits(own, queries.filter("color is not null").select("query_id", "vec", F.col("color").alias("part")), k, lanes, held), k)


def index_filter(hits: DataFrame, items: DataFrame, predicate: Column) -> DataFrame:
    """Hits whose item satisfies a predicate over its objects or metadata."""
    return hits.join(items.filter(predicate).select("item_id"), "item_id", "left_semi")


def has_object(label: str, least: float = 0.0, column: str = "detected_objects") -> Column:
    return F.exists(column, lambda o: (o["label"] == label) & (o["score"] >= least))


def fan_out(**lists: DataFrame) -> DataFrame:
    """One row a query and item with the min-max normalised score of each hit list, null
    where a list lacks it. A list whose scores are all equal counts as 1."""
    parts = [hits.select("query_id", "item_id", "score", F.lit(name).alias("signal")) for name, hits in lists.items()]
    both = reduce(DataFrame.unionByName, parts)
    span = Window.partitionBy("query_id", "signal")
    low, high = F.min("score").over(span), F.max("score").over(span)
    scaled = both.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))
    return scaled.groupBy("query_id", "item_id").pivot("signal", list(lists)).agg(F.max("score"))


def weighted_rerank(signals: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """Top-k by the weighted sum of signals; a missing one is 0."""
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) * F.lit(float(w)) for s, w in weights.items()), F.lit(0.0))
    return top_k(signals.select("query_id", "item_id", total.alias("score")), k)


def feedback_rerank(hits: DataFrame, labels: DataFrame, plus: float, minus: float) -> DataFrame:
    """Re-rank hits: ``plus`` for items labelled relevant (1), less ``minus`` for others (0)."""
    joined = hits.drop("rank").join(labels.select("item_id", "relevant"), "item_id", "left")
    change = F.when(F.col("relevant") == 1, plus).when(F.col("relevant") == 0, -minus).otherwise(0.0)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return joined.withColumn("score", F.col("score") + change).drop("relevant").withColumn("rank", F.row_number().over(order))


def clip_to_video(items: DataFrame, frames: DataFrame, k: int, lanes: int | None = None) -> DataFrame:
    """Videos (an integer id) ranked by the sum over a clip's frames of the best match of
    each frame. ``frames`` has ``clip_id, query_id, vec``; ``items`` has ``video_id`` too."""
    best = video_scores(items, frames, lanes).join(frames.select("query_id", "clip_id"), "query_id")
    votes = best.groupBy("clip_id", "video_id").agg(F.sum("best").alias("score"))
    return top_k(votes.withColumnsRenamed({"clip_id": "query_id", "video_id": "item_id"}), k).withColumnsRenamed({"query_id": "clip_id", "item_id": "video_id"})


def retrieval_eval(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Recall@k and mean reciprocal rank over the queries of ``truth`` (query_id, item_id)."""
    found = truth.select("query_id", "item_id").distinct().join(ranked.select("query_id", "item_id", "rank"), ["query_id", "item_id"], "left")
    each = found.groupBy("query_id").agg(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias("recall"), F.min("rank").alias("first"))
    return each.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("recall").alias("recall_at_k"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))
