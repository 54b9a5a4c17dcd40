"""The keyframe index in tables: each part of it is written once by keyframe, bucketed and
sorted alike, and the index is their join, without another shuffle.

Parts come from different tools at different times. A part is replaced as a whole: its new
version is a table of its own, and a small file that names the versions is replaced in one
rename after it, so readers see a part before or after.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillpoint.functions.tables import discard, point, pointed
from stillpoint.operators.temporal import nearest_segment

#: Columns of each part after its key ``frame_id``.
PARTS = {
    "keyframes": "video_id string, timestamp_ms long, keyframe_path string",
    "embeddings": "clip_embedding array<float>",
    "texts": "ocr_text string",
    "colors": "dominant_colors array<string>",
    "objects": "detected_objects array<struct<label:string,score:double>>",
    "speech": "asr_window_id long, asr_text string",
    "metadata": "source_metadata_ref string",
}


class KeyframeStore:
    """The index at ``path``; ``buckets`` is fixed by the first writer."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        state = pointed(spark, f"{self.path}/CURRENT")
        found = json.loads(state) if state else {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "parts": {}}
        self.buckets, self.parts = found["buckets"], found["parts"]

    def put(self, part: str, rows: DataFrame) -> None:
        """Write or replace a part; a keyframe has at most one row of it (of several the
        least by value). Rows without a keyframe id are left out."""
        columns = [c.split()[0] for c in PARTS[part].split(", ")]
        version = f"index_{part}_{uuid.uuid4().hex}"
        rows = rows.filter("frame_id is not null").select(F.col("frame_id").cast("long").alias("frame_id"), *[F.col(c).cast(kind) for c, kind in self._kinds(part)])
        rows = rows.groupBy("frame_id").agg(F.min(F.struct(*columns)).alias("r")).select("frame_id", "r.*")
        try:
            spread = rows.repartition(self.buckets, "frame_id")
            spread.write.format("parquet").bucketBy(self.buckets, "frame_id").sortBy("frame_id").option("path", f"{self.path}/{version}").saveAsTable(version)
            old, parts = self.parts.get(part), {**self.parts, part: version}
            point(self.spark, f"{self.path}/CURRENT", json.dumps({"buckets": self.buckets, "parts": parts}))
        except BaseException:
            self._forget(version)
            raise
        self.parts = parts
        if old:
            self._forget(old)

    @staticmethod
    def _kinds(part: str) -> list[tuple[str, str]]:
        return [tuple(c.split(" ", 1)) for c in PARTS[part].split(", ")]

    def put_speech(self, frames: DataFrame, segments: DataFrame) -> None:
        """Link frames (video_id, frame_id, t) to the nearest segment (video_id, segment_id,
        t, text) of their video."""
        near = nearest_segment(frames, segments).filter("segment_id is not null").select("video_id", "frame_id", "segment_id")
        linked = near.join(segments.select("video_id", "segment_id", "text"), ["video_id", "segment_id"])
        self.put("speech", linked.select("frame_id", F.col("segment_id").alias("asr_window_id"), F.col("text").alias("asr_text")))

    def table(self, part: str) -> DataFrame:
        """A part; without rows if nobody has written it."""
        if part not in self.parts:
            return self.spark.createDataFrame([], f"frame_id long, {PARTS[part]}")
        name = self.parts[part]
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (frame_id long, {PARTS[part]}) USING parquet CLUSTERED BY (frame_id) SORTED BY (frame_id) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
        )
        return self.spark.table(name)

    def index(self) -> DataFrame:
        """One row a keyframe with all of its parts, null where it lacks one."""
        out = self.table("keyframes")
        for part in PARTS:
            if part != "keyframes":
                out = out.join(self.table(part), "frame_id", "left")
        return out

    def _forget(self, version: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {version}")
        discard(self.spark, f"{self.path}/{version}")

    def drop(self) -> None:
        for version in self.parts.values():
            self._forget(version)
        discard(self.spark, self.path)
