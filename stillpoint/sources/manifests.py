"""Candidate and keyframe manifests in JSON Lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stillpoint.functions.tables import discard, exists, move, point, pointed
from stillpoint.schemas import DECISIONS
from stillpoint.sources.videos import fail, numbered_lines


def _rows(lines: DataFrame) -> DataFrame:
    v = F.try_parse_json("line")
    wrong = v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT")
    bad = F.parse_json(fail("line ", F.col("line_no").cast("string"), F.lit(": not a JSON object")))
    rows = lines.filter(F.trim(F.regexp_replace("line", r"\s", "")) != "")
    return rows.select(F.col("line_no").cast("long").alias("ord"), F.when(wrong, bad).otherwise(v).alias("v"))


def _required(key: str, kind: str) -> Column:
    present = F.try_variant_get("v", f"$.{key}", "variant").isNotNull()
    value = F.variant_get("v", f"$.{key}", kind)
    return F.when(~present | F.is_variant_null(F.try_variant_get("v", f"$.{key}", "variant")), fail(f"{key} is missing").cast(kind)).otherwise(value).alias(key)


def _metadata() -> Column:
    m = F.try_variant_get("v", "$.metadata", "variant")
    return F.when(m.isNull() | F.is_variant_null(m), "{}").when(F.schema_of_variant(m).startswith("OBJECT"), F.to_json(m)).otherwise(fail("metadata must be an object")).alias("metadata")


def _common() -> list[Column]:
    texts = [_required(k, "string") for k in ("candidate_id", "video_id", "video_path")]
    return [*texts, _required("timestamp_seconds", "double"), _required("image_path", "string"), _required("source", "string"), F.variant_get("v", "$.score", "double").alias("score")]


def parse_candidates(lines: DataFrame) -> DataFrame:
    """Candidate rows of (line_no, line), strictly: an unknown decision, a null one
    included, is an error; a missing one is pending; a null score is allowed."""
    decision = F.try_variant_get("v", "$.decision", "variant")
    text = F.try_variant_get("v", "$.decision", "string")
    known = F.coalesce(text.isin(list(DECISIONS)), F.lit(False))
    value = F.when(decision.isNull(), "pending").when(known, text).otherwise(fail("unknown decision"))
    return _rows(lines).select(*_common(), value.alias("decision"), _metadata(), "ord")


def parse_keyframes(lines: DataFrame) -> DataFrame:
    return _rows(lines).select(_required("keyframe_id", "string"), *_common(), _metadata(), "ord")


CANDIDATE_KEYS = ["candidate_id", "video_id", "video_path", "timestamp_seconds", "image_path", "source", "score", "decision", "metadata"]
KEYFRAME_KEYS = ["keyframe_id", "candidate_id", "video_id", "video_path", "timestamp_seconds", "image_path", "source", "score", "metadata"]


def json_lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON object a row as ``value``: fixed key order, nulls kept, metadata nested."""
    parts = [F.parse_json("metadata").alias(k) if k == "metadata" else F.col(k) for k in keys]
    return rows.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("value"), *[c for c in ("video_ord", "ord") if c in rows.columns])


#: Output orders: prepared candidates by input video, keyframes by video id; then by time.
CANDIDATE_ORDER = ["video_ord", "timestamp_seconds", "ord"]
KEYFRAME_ORDER = ["video_id", "timestamp_seconds", "ord"]


def _pointer(path: str) -> str:
    return f"{path.rstrip('/')}.current"


def current(spark: SparkSession, path: str) -> str | None:
    """The folder that holds the manifest of ``path``: the version that its pointer names
    while a version is put in place, else ``path`` itself; None if there is neither."""
    named = pointed(spark, _pointer(path))
    if named and exists(spark, named):
        return named
    return path if exists(spark, path) else None


def settle(spark: SparkSession, path: str) -> None:
    """Put the version that the pointer names in place, also one that an earlier writer
    left behind. At every step ``current`` finds a whole manifest: the version until it has
    been moved, then ``path``."""
    named = pointed(spark, _pointer(path))
    if named and exists(spark, named):
        discard(spark, path)
        move(spark, named, path)
    if named:
        discard(spark, _pointer(path))


def write_manifest(rows: DataFrame, keys: list[str], path: str, order: list[str]) -> int:
    """Replace ``path`` by JSON Lines in the given global order; returns the number of rows,
    counted while they are written.

    A version is a folder of its own. It becomes the manifest when a pointer to it appears,
    in one rename; only then do the old lines go. So ``rows`` may come from the manifest
    that they replace, and a writer that dies leaves the old manifest or the new one."""
    spark, seen = rows.sparkSession, Observation()
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    try:
        json_lines(rows.orderBy(*order), keys).select("value").observe(seen, F.count(F.lit(1)).alias("n")).write.text(fresh)
    except BaseException:
        discard(spark, fresh)
        raise
    settle(spark, path)
    point(spark, _pointer(path), fresh)
    settle(spark, path)
    return seen.get["n"]


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """The candidate manifest at ``path``, strictly; ``ord`` is the number of its line."""
    return parse_candidates(numbered_lines(spark, current(spark, path) or path))


def read_keyframes(spark: SparkSession, path: str) -> DataFrame:
    """The keyframe manifest at ``path``, strictly; ``ord`` is the number of its line."""
    return parse_keyframes(numbered_lines(spark, current(spark, path) or path))
