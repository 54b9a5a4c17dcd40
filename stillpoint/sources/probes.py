"""Outputs of video tools: probe payloads and scene-detector logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillpoint.functions.spans import LINES, running_count
from stillpoint.operators.events import scene_dedupe
from stillpoint.sources.videos import fail

# Line ends as Python's splitlines has them.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


#: The log format, as fixed values: the numbers of a frame line, a score and a showinfo line.
#: White space and digits are those of Unicode. What stands after a key up to the first
#: character that no number has is a number, or an error.
FRAME = r"(?U)frame:\s*\d+\s+pts:\s*-?\d+\s+pts_time:\s*([-+0-9.eE]+)"
SCORE = r"lavfi\.scene_score=([-+0-9.eE]+)"
SHOWINFO = r"(?U)showinfo.*pts_time:\s*([-+0-9.eE]+)"


def one_payload(probes: DataFrame) -> DataFrame:
    """``payload`` of each path; two unlike ones are an error."""
    given = F.nullif(F.col("payload"), F.lit(""))
    found = probes.groupBy("path").agg(F.min(given).alias("low"), F.max(given).alias("high"))
    return found.select("path", F.when(F.col("low") != F.col("high"), fail("two payloads: ", F.col("path"))).otherwise(F.col("low")).alias("payload"))


def parse_probe(payloads: DataFrame) -> DataFrame:
    """``duration`` of each video: null if the payload is empty, or its format has none, a
    null one, or N/A. A payload that isn't JSON, isn't an object, whose format isn't one, or
    whose duration is no finite number, is an error."""
    v = F.parse_json(F.nullif(F.col("payload"), F.lit("")))
    shape, inner = F.try_variant_get(v, "$.format", "variant"), F.try_variant_get(v, "$.format.duration", "variant")
    wrong = ~F.schema_of_variant(v).startswith("OBJECT") | (shape.isNotNull() & ~F.schema_of_variant(shape).startswith("OBJECT"))
    none = v.isNull() | inner.isNull() | F.is_variant_null(inner) | (F.try_variant_get(v, "$.format.duration", "string") == "N/A")
    value = F.variant_get(v, "$.format.duration", "double")
    odd = F.isnan(value) | (F.abs(value) == float("inf"))
    duration = F.when(wrong, fail("probe payload has no format").cast("double")).when(F.coalesce(none, F.lit(False)), None)
    return payloads.select("video_ord", "video_id", duration.when(odd, fail("duration is not finite").cast("double")).otherwise(value).alias("duration"))


#: Lines of one part of a log, at most.
PART = 1 << 40


def split_log(texts: DataFrame) -> DataFrame:
    """(video_ord, video_id, text) to numbered lines. Several texts of a video are told
    apart by their ``part``, a small number, and read one after another."""
    if "part" not in texts.columns:
        return texts.select("video_ord", "video_id", F.posexplode(F.split("text", LINE_END)).alias("line_no", "line"))
    lines = texts.select("video_ord", "video_id", "part", F.posexplode(F.split("text", LINE_END)).alias("n", "line"))
    return lines.select("video_ord", "video_id", (F.col("part").cast("long") * PART + F.col("n")).alias("line_no"), "line")


def _number(pattern: str) -> Column:
    """The text of the number that ``pattern`` finds in a line; null if it finds none."""
    return F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))


def parse_scene_log(lines: DataFrame, span: int = LINES) -> DataFrame:
    """Scenes of (video_ord, video_id, line_no, line): a frame line opens a scene, the last
    score line before the next frame is its score; showinfo times stand in for videos
    without any frame line. One scene a millisecond. A number that isn't one is an error.
    Logs are numbered by spans of lines."""
    frame = _number(FRAME)
    marked = lines.select("video_ord", "video_id", "line_no", frame.alias("frame"), F.when(frame.isNull(), _number(SCORE)).alias("mark"), F.when(frame.isNull(), _number(SHOWINFO)).alias("info"))
    marked = marked.filter("frame is not null or mark is not null or info is not null")
    marked = running_count(marked, "video_ord", F.floor(F.col("line_no") / span), [F.col("line_no")], F.col("frame").isNotNull(), "scene", "frames")
    framed = marked.filter("scene > 0").groupBy("video_ord", "video_id", "scene").agg(
        F.max(F.col("frame").cast("double")).alias("t"), F.max_by(F.col("mark").cast("double"), F.when(F.col("mark").isNotNull(), F.col("line_no"))).alias("score"), F.min("line_no").cast("long").alias("ord")
    )
    shown = marked.filter("frames = 0 and info is not null")
    shown = shown.select("video_ord", "video_id", F.col("info").cast("double").alias("t"), F.lit(None).cast("double").alias("score"), F.col("line_no").cast("long").alias("ord"))
    return scene_dedupe(framed.select("video_ord", "video_id", "t", "score", "ord").unionByName(shown))
