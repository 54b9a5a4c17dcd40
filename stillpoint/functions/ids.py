"""Identifiers of videos, candidates and keyframes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(t: Column) -> Column:
    """Half-even milliseconds."""
    return F.rint(t * 1000).cast("long")


def tidy_path(path: Column) -> Column:
    """A path without repeated or trailing slashes and ``/./`` steps."""
    flat = F.regexp_replace(F.regexp_replace(path, r"/(\./)+", "/"), r"/{2,}", "/")
    flat = F.regexp_replace(flat, r"(?<=.)/\.?$", "")
    return F.regexp_replace(flat, r"^\./(?=.)", "")


def video_id(path: Column, base: str | None = None) -> Column:
    """Slug of the path relative to ``base`` (else of the file name) without its last
    suffix, and ten digits of the SHA-1 of the whole path."""
    path = tidy_path(path)
    name = F.element_at(F.split(path, "/"), -1)
    label = name
    if base:
        root = base.rstrip("/") + "/"
        label = F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(name)
    label = F.regexp_replace(label, r"(?<=[^/])\.[^./]+$", "")
    slug = F.lower(F.regexp_replace(F.regexp_replace(label, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    return F.concat(F.when(slug == "", "video").otherwise(slug), F.lit("-"), F.substring(F.sha1(path), 1, 10))


def candidate_id(video: Column, source: Column, t: Column) -> Column:
    return F.format_string("%s_%s_t%010d", video, source, millis(t))


def keyframe_id(video: Column, t: Column) -> Column:
    """As a candidate's id without the source: candidates of one millisecond share it."""
    return F.format_string("%s_keyframe_t%010d", video, millis(t))
