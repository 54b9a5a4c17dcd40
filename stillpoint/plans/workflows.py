"""Whole jobs: plan, prepare, finalize, run.

``plan``, ``prepare``, ``finalize`` and ``run`` are the transformations. The jobs around
them read a video source or a manifest, check it, write the manifests in order and count.
Decoding stays outside: what video tools said of the videos comes as tables, and the
frames that they are to read and write are worklists.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stillpoint.functions.tables import kept, scratch, written
from stillpoint.operators import events as ev
from stillpoint.operators import review as rv
from stillpoint.options import ReviewOptions, SelectionOptions
from stillpoint.sources import manifests as mf
from stillpoint.sources import probes as pr
from stillpoint.sources import videos as vs


def plan(videos: DataFrame, scenes: DataFrame, options: SelectionOptions) -> DataFrame:
    """Planned events of ``videos`` (video_ord, video_id, duration): seeds, scenes and
    periodic events, merged under the spacing and capped. Each record is planned apart,
    also if two share a video id.

    Scenes are planned as they were found, those without a score included: the threshold
    is applied where frames are scored, by the detector or by ``scene_filter``."""
    found = ev.scene_dedupe(scenes)
    regular = ev.periodic_events(videos, options.interval).unionByName(ev.tail_events(videos, options.interval))
    both = ev.event_union(ev.seed_events(videos), found.select("video_ord", "video_id", "t", "source", "score", "ord"), regular)
    return ev.candidate_cap(ev.spacing_merge(ev.nonnegative_events(both), options.spacing), options.max_candidates)


def prepare(videos: DataFrame, scenes: DataFrame, root: str, options: SelectionOptions, earlier: DataFrame | None = None) -> DataFrame:
    """Candidate rows with the decisions of an earlier manifest. ``videos`` has ``path``."""
    events = plan(videos, scenes, options).join(videos.select("video_ord", F.col("path").alias("video_path")), "video_ord")
    rows = rv.candidate_rows(events, root)
    return rows if earlier is None else rv.carry_decisions(rows, rv.last_decisions(earlier))


def finalize(candidates: DataFrame, root: str, options: ReviewOptions) -> DataFrame:
    """Keyframe rows of reviewed candidates."""
    return rv.keyframe_rows(rv.keyframe_cap(rv.review_filter(candidates, options.pending), options.max_keyframes), root)


def run(videos: DataFrame, scenes: DataFrame, root: str, selection: SelectionOptions, review: ReviewOptions, earlier: DataFrame | None = None) -> DataFrame:
    return finalize(prepare(videos, scenes, f"{root}/candidates", selection, earlier), f"{root}/keyframes", review)


@dataclass(frozen=True)
class JobResult:
    """What a job left: the paths of its manifests, its counts, and the images still to be
    made (``worklist``; for candidates with the times to try and the image quality)."""

    candidates_manifest: str
    keyframes_manifest: str | None
    candidate_count: int
    keyframe_count: int
    worklist: DataFrame


def extraction_worklist(rows: DataFrame, files: DataFrame, options: SelectionOptions) -> DataFrame:
    """Reading attempts of the candidates whose image is absent, or of all if ``overwrite``."""
    missing = rv.worklist(rows, files, overwrite=options.overwrite).select("video_path", "image_path", F.col("timestamp_seconds").alias("t"))
    return ev.read_attempts(missing).withColumn("quality", F.lit(options.image_quality))


def export_worklist(rows: DataFrame, files: DataFrame, options: ReviewOptions) -> DataFrame:
    """Copies from candidate to keyframe images that are absent, or all if ``overwrite``."""
    return rv.worklist(rows, files, overwrite=options.overwrite).select("source_image", "image_path")


def prepare_job(
    spark: SparkSession, source: str, out: str, files: DataFrame, probes: DataFrame, logs: DataFrame, options: SelectionOptions, recursive: bool = True
) -> JobResult:
    """Load and check a video source, plan candidates, carry the decisions of the manifest
    that an earlier run left below ``out``, and replace it.

    ``files`` (path) lists what exists, ``probes`` (path, payload) and ``logs`` (path, text)
    are what video tools said; a video without them has no duration and no scenes. Several
    logs of a path (what a tool wrote to its outputs) are read in the order of their
    ``part``; two of one part, or two unlike payloads of a path, are an error, as are
    videos that don't exist, before anything is planned."""
    manifest = f"{out.rstrip('/')}/manifests/candidate_keyframes.jsonl"
    logs = logs if "part" in logs.columns else logs.withColumn("part", F.lit(0))
    with scratch(spark):
        videos = written(vs.load_videos(spark, source, recursive), "videos")
        vs.require_videos(videos, files)
        twice = logs.groupBy("path", "part").count().filter("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"{twice[0]['path']}: two logs of part {twice[0]['part']}")
        timed = pr.parse_probe(videos.select("video_ord", "video_id", "path").join(pr.one_payload(probes), "path", "left"))
        lines = pr.split_log(videos.join(logs, "path").select("video_ord", "video_id", "part", "text"))
        scenes = pr.parse_scene_log(lines).withColumn("source", F.lit("scene"))
        earlier = mf.read_candidates(spark, manifest) if mf.current(spark, manifest) else None
        rows = kept(prepare(timed.join(videos.select("video_ord", "path"), "video_ord"), scenes, f"{out.rstrip('/')}/candidates", options, earlier), "candidates")
        n = mf.write_manifest(rows, mf.CANDIDATE_KEYS, manifest, mf.CANDIDATE_ORDER)
    return JobResult(manifest, None, n, 0, extraction_worklist(rows, files, options))


def finalize_job(spark: SparkSession, manifest: str, out: str, files: DataFrame, options: ReviewOptions) -> JobResult:
    """Read a reviewed candidate manifest strictly, select keyframes and replace the keyframe
    manifest below ``out``."""
    target = f"{out.rstrip('/')}/manifests/keyframes.jsonl"
    seen = Observation()
    with scratch(spark):
        candidates = written(mf.read_candidates(spark, manifest).observe(seen, F.count(F.lit(1)).alias("n")), "candidates")
        rows = kept(finalize(candidates, f"{out.rstrip('/')}/keyframes", options), "keyframes")
        n = mf.write_manifest(rows, mf.KEYFRAME_KEYS, target, mf.KEYFRAME_ORDER)
    return JobResult(manifest, target, seen.get["n"], n, export_worklist(rows, files, options))


def run_job(
    spark: SparkSession, source: str, out: str, files: DataFrame, probes: DataFrame, logs: DataFrame, selection: SelectionOptions, review: ReviewOptions, recursive: bool = True
) -> JobResult:
    """Prepare, then finalize what was prepared."""
    return finalize_job(spark, prepare_job(spark, source, out, files, probes, logs, selection, recursive).candidates_manifest, out, files, review)
