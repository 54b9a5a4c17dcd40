"""The shared test tables seen as videos, events and manifests, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1_704_067_200_000_000
STEP = 21_600.0

#: name -> (query, SQL or None)
REGISTRY: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def add(fn):
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate events: a user is a video, an event a frame of it."""
    micros = F.unix_micros(F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp"))
    kind = F.when(F.col("event_type").isin("error", "purchase"), "scene").when(F.col("event_type") == "signup", "seed").otherwise("periodic")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_ord"), F.col("user_id").cast("string").alias("video_id"), ((micros - EPOCH) / F.lit(1e6)).alias("t"),
        kind.alias("source"), (F.col("value") / 500).alias("score"), F.col("event_id").alias("ord"),
    )


EV = """ev AS (
  SELECT user_id AS video_ord, CAST(user_id AS VARCHAR) AS video_id, (epoch_us(ts) - 1704067200000000) / CAST(1000000 AS DOUBLE) AS t,
    CASE WHEN event_type IN ('error', 'purchase') THEN 'scene' WHEN event_type = 'signup' THEN 'seed' ELSE 'periodic' END AS source,
    value / 500 AS score, event_id AS ord
  FROM events
)"""


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a user; the last event is its end."""
    return events(spark, sf_dir).groupBy("video_ord", "video_id").agg(F.max("t").alias("duration")).withColumn("path", F.concat(F.lit("/videos/"), "video_id", F.lit(".mp4")))


VID = """vid AS (
  SELECT video_ord, video_id, max(t) AS duration, '/videos/' || video_id || '.mp4' AS path FROM ev GROUP BY video_ord, video_id
)"""

PRIO = "CASE source WHEN 'scene' THEN 3 WHEN 'seed' THEN 2 WHEN 'periodic' THEN 1 ELSE 0 END"
DPRIO = "CASE decision WHEN 'accepted' THEN 3 WHEN 'pending' THEN 2 ELSE 0 END"
CID = "video_id || '_' || source || '_t' || lpad(CAST(CAST(round_even(t * 1000, 0) AS BIGINT) AS VARCHAR), CAST(greatest(10, length(CAST(CAST(round_even(t * 1000, 0) AS BIGINT) AS VARCHAR))) AS INTEGER), '0')"
KID = "video_id || '_keyframe_t' || lpad(CAST(CAST(round_even(t * 1000, 0) AS BIGINT) AS VARCHAR), CAST(greatest(10, length(CAST(CAST(round_even(t * 1000, 0) AS BIGINT) AS VARCHAR))) AS INTEGER), '0')"


def decided(ord_column: str = "ord"):
    return F.when(F.col(ord_column) % 3 == 0, "accepted").when(F.col(ord_column) % 3 == 1, "pending").otherwise("rejected")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewed candidate manifest: every event, decided by its id."""
    from stillpoint.operators.review import candidate_rows

    rows = candidate_rows(events(spark, sf_dir).withColumn("video_path", F.concat(F.lit("/videos/"), "video_id", F.lit(".mp4"))), "/out/candidates")
    return rows.withColumn("decision", decided())


CAND = f"""cand AS (
  SELECT {CID} AS candidate_id, video_id, '/videos/' || video_id || '.mp4' AS video_path, t,
    '/out/candidates/' || video_id || '/' || {CID} || '.jpg' AS image_path, source, score,
    CASE ord % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'pending' ELSE 'rejected' END AS decision,
    '{{"selector":"scene_plus_periodic"}}' AS metadata, video_ord, ord
  FROM ev
)"""
