"""Video lists: folders, JSON Lines and JSON manifests.

Readers are thin; parsing works on DataFrames of lines or payloads. ``video_ord`` is the
position of a record; for text it is given by ``line_no``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stillpoint.functions.ids import tidy_path, video_id
from stillpoint.functions.spans import placed
from stillpoint.schemas import VIDEO_SUFFIXES

OWN_KEYS = ("id", "video_id", "path", "video_path", "metadata")


def fail(message: str, *parts: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), *parts)).cast("string")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, or of the ordered files of a folder that Spark wrote, with their
    number from 1, in order."""
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    raw = spark.read.text(path).select(file.alias("file"), start.alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    sizes = raw.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    ahead = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # one row a split of a file
    before = sizes.select("file", "start", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return raw.join(before, ["file", "start"]).select((F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")


def listed_videos(files: DataFrame, root: str) -> DataFrame:
    """Video records of the files (column ``path``) below ``root`` with a video suffix in
    any case, in path order, folder by folder."""
    base = root.removeprefix("file://").rstrip("/") + "/"
    plain = F.regexp_replace("path", "^file:(//)?(?=/)", "")
    found = files.select(plain.alias("path")).filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(list(VIDEO_SUFFIXES)))
    numbered = placed(found.withColumn("_order", F.split("path", "/")), ["_order"], "video_ord")
    relative = F.when(F.startswith("path", F.lit(base)), F.substring("path", F.lit(len(base) + 1), F.length("path"))).otherwise(F.col("path"))
    return numbered.select(
        F.col("video_ord").cast("long").alias("video_ord"), video_id(F.col("path"), base).alias("video_id"), "path", F.to_json(F.struct(relative.alias("relative_path"))).alias("metadata")
    )


def discover_videos(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``listed_videos`` of a folder; contents are not read.

    Spark's file listing leaves out names that begin with ``_`` or ``.`` and empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path")
    return listed_videos(files, root)


def parse_jsonl(lines: DataFrame, name: str = "manifest") -> DataFrame:
    """``payload`` of each line that isn't blank; bad JSON is an error with its place."""
    payload = F.try_parse_json("line")
    bad = fail(f"{name}:", F.col("line_no").cast("string"), F.lit(": invalid JSONL row"))
    rows = lines.filter(F.trim(F.regexp_replace("line", r"\s", "")) != "")
    return rows.select(F.col("line_no").cast("long").alias("video_ord"), F.when(payload.isNull(), F.parse_json(bad)).otherwise(payload).alias("payload"))


def parse_json(texts: DataFrame) -> DataFrame:
    """``payload`` of each entry of a whole manifest text: a list, or an object whose
    ``videos`` (or, if that is missing or null, ``items``) is a list."""
    doc = F.parse_json("text")
    top = F.schema_of_variant(doc)
    inner = F.coalesce(F.try_variant_get(doc, "$.videos", "variant"), F.try_variant_get(doc, "$.items", "variant"))
    inner = F.when(F.is_variant_null(F.try_variant_get(doc, "$.videos", "variant")), F.try_variant_get(doc, "$.items", "variant")).otherwise(inner)
    found = F.when(top.startswith("ARRAY"), doc).otherwise(inner)
    wrong = found.isNull() | ~F.schema_of_variant(found).startswith("ARRAY")
    items = F.when(wrong, F.parse_json(fail("JSON manifest must be a list or an object with 'videos'"))).otherwise(found)
    return texts.select(F.posexplode(F.variant_get(items, "$", "array<variant>")).alias("video_ord", "payload")).withColumn("video_ord", F.col("video_ord").cast("long"))


def _truthy(payload: Column, key: str) -> Column:
    value = F.try_variant_get(payload, f"$.{key}", "string")
    return F.when(~value.isin("", "false") & ~((value == "0") & ~F.schema_of_variant(F.try_variant_get(payload, f"$.{key}", "variant")).startswith("STRING")), value)


def normalise_rows(rows: DataFrame, base: str) -> DataFrame:
    """Video records of ``payload`` rows: strings are paths, objects have ``path`` or
    ``video_path``, an id or none, and further keys that go over ``metadata``."""
    p = F.col("payload")
    kind = F.schema_of_variant(p)
    is_text, is_object = kind == "STRING", kind.startswith("OBJECT")
    raw = F.when(is_text, F.variant_get(p, "$", "string")).otherwise(F.coalesce(_truthy(p, "path"), _truthy(p, "video_path")))
    raw = F.when(~is_text & ~is_object, fail("manifest video rows must be strings or objects")).when(raw.isNull(), fail("manifest video object requires a path")).otherwise(raw)
    path = tidy_path(F.when(raw.startswith("/"), raw).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), raw)))
    given = F.when(is_object, F.coalesce(_truthy(p, "video_id"), _truthy(p, "id")))
    meta = F.when(is_object, F.try_variant_get(p, "$.metadata", "variant"))
    none = meta.isNull() | F.is_variant_null(meta)
    wrong = ~none & ~F.schema_of_variant(meta).startswith("OBJECT")
    meta = F.when(none, F.parse_json(F.lit("{}"))).when(wrong, F.parse_json(fail("metadata must be an object"))).otherwise(meta)
    own = F.variant_get(meta, "$", "map<string,variant>")
    more = F.map_filter(F.try_variant_get(F.when(is_object, p).otherwise(F.parse_json(F.lit("{}"))), "$", "map<string,variant>"), lambda k, _: ~k.isin(list(OWN_KEYS)))
    merged = F.map_concat(F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(more), k)), more)
    return rows.select("video_ord", F.coalesce(given, video_id(path, base)).alias("video_id"), path.alias("path"), F.to_json(merged).alias("metadata"))


def missing_videos(videos: DataFrame, files: DataFrame, most: int = 3) -> DataFrame:
    """The first records whose path is in no row of ``files``."""
    return videos.join(files.select("path").distinct(), "path", "left_anti").orderBy("video_ord").limit(most)


def require_videos(videos: DataFrame, files: DataFrame) -> None:
    if gone := [r["path"] for r in missing_videos(videos, files).collect()]:
        raise FileNotFoundError(f"missing videos: {', '.join(gone)}")


def video_paths(videos: DataFrame) -> DataFrame:
    return videos.select("path")


def source_kinds(sources: DataFrame) -> DataFrame:
    """``kind`` of each source (``source``, ``is_directory``): ``directory``, or ``jsonl`` or
    ``json`` by suffix in any case; null if it can't be read."""
    suffix = F.lower(F.regexp_extract("source", r"\.([^./]+)$", 1))
    return sources.withColumn("kind", F.when(F.col("is_directory"), "directory").when(suffix.isin("jsonl", "json"), suffix))


def source_kind(source: str, is_directory: bool) -> str:
    """``directory``, ``jsonl`` or ``json`` by suffix, in any case."""
    if is_directory:
        return "directory"
    for kind in ("jsonl", "json"):
        if source.lower().endswith("." + kind):
            return kind
    raise ValueError(f"unsupported video source: {source}")


def load_videos(spark: SparkSession, source: str, recursive: bool = True) -> DataFrame:
    """Read a video source of any kind; a missing source is an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(source)
    kind = source_kind(source, fs.getFileStatus(path).isDirectory())
    if kind == "directory":
        return discover_videos(spark, source, recursive)
    base = source.removeprefix("file://").rpartition("/")[0]
    if kind == "jsonl":
        return normalise_rows(parse_jsonl(numbered_lines(spark, source), source), base)
    return normalise_rows(parse_json(spark.read.text(source, wholetext=True).select(F.col("value").alias("text"))), base)
