"""Candidate and keyframe rows, review decisions, worklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stillpoint.functions.ids import candidate_id, keyframe_id
from stillpoint.functions.ranks import best_first, review_priority


def candidate_rows(events: DataFrame, root: str) -> DataFrame:
    """Manifest rows of planned events; ``events`` has ``video_path`` too."""
    cid = candidate_id(F.col("video_id"), F.col("source"), F.col("t"))
    return events.select(
        cid.alias("candidate_id"), "video_id", "video_path", F.col("t").alias("timestamp_seconds"),
        F.concat(F.lit(root.rstrip("/") + "/"), "video_id", F.lit("/"), cid, F.lit(".jpg")).alias("image_path"),
        "source", "score", F.lit("pending").alias("decision"), F.lit('{"selector":"scene_plus_periodic"}').alias("metadata"), "video_ord", "ord",
    )


def last_decisions(rows: DataFrame) -> DataFrame:
    """The decision of the last row of each candidate."""
    return rows.groupBy("candidate_id").agg(F.max_by("decision", "ord").alias("decision"))


def carry_decisions(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates with their earlier decision, else pending."""
    earlier = decisions.select("candidate_id", F.col("decision").alias("_earlier"))
    joined = candidates.join(earlier, "candidate_id", "left")
    return joined.withColumn("decision", F.coalesce("_earlier", F.lit("pending"))).select(*candidates.columns)


def worklist(rows: DataFrame, files: DataFrame, path: str = "image_path", overwrite: bool = False) -> DataFrame:
    """Rows whose file is absent from ``files`` (column ``path``), or all of them."""
    if overwrite:
        return rows
    return rows.join(files.select(F.col("path").alias(path)).distinct(), path, "left_anti").select(*rows.columns)


def review_filter(candidates: DataFrame, pending: str = "accept") -> DataFrame:
    """Drop rejected candidates, and pending ones if the policy is ``reject``."""
    gone = ["rejected"] if pending == "accept" else ["rejected", "pending"]
    return candidates.filter(~F.col("decision").isin(gone))


def keyframe_cap(candidates: DataFrame, most: int | None) -> DataFrame:
    """The ``most`` best candidates of each video id by decision plus source."""
    if most is None:
        return candidates
    priority = review_priority(F.col("decision"), F.col("source"))
    order = Window.partitionBy("video_id").orderBy(*best_first(priority, F.col("score"), F.col("timestamp_seconds"), F.col("ord")))
    return candidates.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def with_entry(metadata: Column, key: str, value: Column) -> Column:
    """A JSON object (as text) whose entry ``key`` is set to a string; it comes last."""
    parsed = F.from_json(F.coalesce(metadata, F.lit("{}")), "map<string,variant>")
    others = F.map_filter(parsed, lambda k, _: k != key)
    text = F.variant_get(F.parse_json(F.to_json(F.array(value))), "$[0]", "variant")
    return F.to_json(F.map_concat(others, F.create_map(F.lit(key), text)))


def keyframe_rows(candidates: DataFrame, root: str) -> DataFrame:
    """Keyframe manifest rows; the metadata gains the review decision."""
    kid = keyframe_id(F.col("video_id"), F.col("timestamp_seconds"))
    return candidates.select(
        kid.alias("keyframe_id"), "candidate_id", "video_id", "video_path", "timestamp_seconds",
        F.concat(F.lit(root.rstrip("/") + "/"), "video_id", F.lit("/"), kid, F.lit(".jpg")).alias("image_path"),
        "source", "score", with_entry(F.col("metadata"), "review_decision", F.col("decision")).alias("metadata"), F.col("image_path").alias("source_image"), "ord",
    )


def run_summary(candidates: DataFrame, keyframes: DataFrame | None = None) -> DataFrame:
    """Counts of candidates and keyframes; no keyframes after preparing."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    parts = candidates.select(one.alias("c"), none.alias("k"))
    if keyframes is not None:
        parts = parts.unionByName(keyframes.select(none.alias("c"), one.alias("k")))
    return parts.agg(F.coalesce(F.sum("c"), none).alias("candidate_count"), F.coalesce(F.sum("k"), none).alias("keyframe_count"))
