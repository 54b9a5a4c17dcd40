"""Tables over a whole collection: index rows, objects, evidence, profile, duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillpoint.functions.components import connected_components
from stillpoint.functions.links import candidate_groups, spanned
from stillpoint.functions.tables import kept, scratch, written
from stillpoint.operators.search import terms


def keyframe_index(keyframes: DataFrame, video_metadata: DataFrame | None = None, **parts: DataFrame) -> DataFrame:
    """Keyframes left-joined with each part on ``frame_id`` and metadata on ``video_id``."""
    out = keyframes
    for part in parts.values():
        out = out.join(part, "frame_id", "left")
    return out if video_metadata is None else out.join(video_metadata, "video_id", "left")


def object_counts(frames: DataFrame, column: str = "detected_objects") -> DataFrame:
    """Number of objects of each class of each keyframe."""
    return frames.select("frame_id", F.explode(column).alias("o")).groupBy("frame_id", F.col("o.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def answer_evidence(ranked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """For each question its top-k hits in order, with their text."""
    hits = ranked.filter(F.col("rank") <= k).join(index, "item_id", "left")
    gathered = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "text"))).alias("e"))
    return gathered.select("query_id", F.size("e").alias("n_hits"), F.array_join(F.transform("e", lambda x: x["item_id"].cast("string")), ",").alias("item_ids"),
                           F.array_join(F.transform("e", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("evidence"))


def hit_evidence(ranked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """A row for each of a question's top-k hits (query_id, item_id, rank): what the keyframe
    index (``frame_id``, ``ocr_text``, ``detected_objects``, ``asr_window_id``, ``asr_text``)
    knows of it. ``objects`` names each class once, in order, with the number of its objects.
    Hits that the index lacks have nulls, and no objects."""
    best = ranked.filter(F.col("rank") <= k).select("query_id", "rank", F.col("item_id").alias("frame_id"))
    labels = F.array_sort(F.transform("detected_objects", lambda o: o["label"]))
    counted = F.transform(F.array_distinct(labels), lambda x: F.concat(x, F.lit(" x "), F.size(F.filter(labels, lambda y: y == x)).cast("string")))
    known = index.select("frame_id", "ocr_text", F.array_join(counted, ", ").alias("objects"), "asr_window_id", "asr_text")
    return best.join(known, "frame_id", "left").withColumn("objects", F.coalesce("objects", F.lit(""))).withColumnRenamed("frame_id", "item_id")


def question_evidence(hits: DataFrame) -> DataFrame:
    """The rows of ``hit_evidence`` as one text a question, hit by hit in order of rank: its
    text, its objects, its transcript. A question has at most k hits."""
    told = F.concat_ws("\n", F.coalesce("ocr_text", F.lit("")), "objects", F.coalesce("asr_text", F.lit("")))
    gathered = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", told.alias("told")))).alias("e"))
    return gathered.select("query_id", F.size("e").alias("n_hits"), F.array_join(F.transform("e", lambda x: x["told"]), "\n").alias("evidence"))


def corpus_profile(videos: DataFrame) -> DataFrame:
    """By topic and in total: videos, hours, shortest, longest, and 1 - keyframes / frames.
    ``videos`` has topic, duration, keyframes, frames; the total has a null topic."""
    return videos.rollup("topic").agg(
        F.count(F.lit(1)).alias("videos"), (F.sum("duration") / 3600).alias("hours"), F.min("duration").alias("shortest"), F.max("duration").alias("longest"),
        (1 - F.sum("keyframes") / F.sum("frames")).alias("reduction"),
    )


def normal_text(text: Column) -> Column:
    return F.array_join(terms(text), " ")


def exact_groups(items: DataFrame) -> DataFrame:
    """Group of each item: the smallest item with the same normalised text."""
    key = F.sha2(normal_text(F.col("text")), 256)
    firsts = items.select("item_id", key.alias("k")).groupBy("k").agg(F.min("item_id").alias("group_id"))
    return items.select("item_id", key.alias("k")).join(firsts, "k").select("item_id", "group_id")


def _band_keys(frames: Iterator[pd.DataFrame], bands: int, rows: int) -> Iterator[pd.DataFrame]:
    """MinHash bands of sets of hashes: the least values of ``rows`` multiplications each.
    A helper: the engine's own array functions took 40 times as long for the same keys."""
    factors = np.random.default_rng(23).integers(1, 1 << 63, bands * rows, dtype="u8") * np.uint64(2) + np.uint64(1)
    mix = np.uint64(0x9E3779B97F4A7C15)
    for frame in frames:
        for lo in range(0, len(frame), 500):
            part = frame.iloc[lo : lo + 500]
            keys = []
            for grams in part["grams"]:
                g = np.asarray(grams, "i8").view("u8")
                least = np.min([(factors[:, None] * g[s : s + 2048]).min(1) for s in range(0, len(g), 2048)], axis=0).reshape(bands, rows)
                key = np.zeros(bands, "u8")
                for r in range(rows):
                    key = (key ^ (least[:, r] >> np.uint64(16))) * mix
                keys.append(key.view("i8"))
            yield pd.DataFrame({"item_id": np.repeat(part["item_id"].to_numpy(), bands), "band": np.tile(np.arange(bands, dtype="i4"), len(part)), "key": np.concatenate(keys)})


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.set_column(batch.schema.get_field_index("grams"), "grams", pa.array([np.asarray(g.values, "i8").tobytes() for g in batch.column("grams")], pa.binary()))


def duplicate_groups(items: DataFrame, threshold: float = 0.8, width: int = 5, bands: int = 32, rows: int = 6, block: int = 512) -> DataFrame:
    """Group of each item: the smallest item it is linked with, exactly or nearly.

    Texts with equal normal form are one. The others meet in MinHash bands; items that
    share a band, directly or through others, are a candidate group. Groups are what links
    of exact Jaccard over word n-grams connect: in a candidate group of at most about
    ``block`` items every pair is verified, in a larger one every pair that isn't settled by
    pivots (``spanned``). No band is dropped, and a pair never becomes a row."""
    with scratch(items.sparkSession):
        return kept(_grouped(items, threshold, width, bands, rows, block), "duplicate-groups")


def _grouped(items: DataFrame, threshold: float, width: int, bands: int, rows: int, block: int) -> DataFrame:
    exact = written(exact_groups(items), "exact")
    reps = items.join(exact.filter("item_id = group_id").select("item_id"), "item_id", "left_semi")
    def hashed(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
        return F.when(F.size(w) >= width, runs).when(F.size(w) > 0, F.array(F.xxhash64(w)))

    # inside transform the words are split once a text, not once a gram
    grams = F.transform(F.array(terms(F.col("text"))), hashed)[0]
    sets = written(reps.select("item_id", F.array_distinct(grams).alias("grams")).filter("grams is not null"), "grams")
    keyed = written(sets.mapInPandas(lambda it: _band_keys(it, bands, rows), "item_id long, band int, key long"), "bands")
    met = keyed.groupBy("band", "key").agg(F.min("item_id").alias("b"), F.max("item_id").alias("last")).filter("b <> last").drop("last")
    edges = keyed.join(met, ["band", "key"]).filter("item_id <> b").select(F.col("item_id").alias("a"), "b")
    members = written(candidate_groups(edges, sets.select(F.col("item_id").alias("rid"), F.size("grams").alias("n")), block), "members")
    candidates = sets.select(F.col("item_id").alias("rid"), "grams").join(members, "rid")
    candidates = candidates.select("rid", F.lit(1).cast("long").alias("weight"), "grp", "blocks", "own", F.size("grams").alias("n"), "grams")
    candidates = candidates.mapInArrow(_packed, "rid long, weight long, grp long, blocks int, own int, n int, grams binary")
    links = spanned(candidates, threshold, block=block).select(F.col("rid").alias("a"), F.col("root").alias("b"))
    roots = connected_components(links).select(F.col("node").alias("group_id"), "root")
    return exact.join(roots, "group_id", "left").select("item_id", F.coalesce("root", "group_id").alias("group_id"))
