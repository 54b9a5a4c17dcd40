"""Job requests as a table: the checks of the options, one row a request."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _finite(name: str) -> Column:
    value = F.col(name).cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def checked_requests(requests: DataFrame) -> DataFrame:
    """``requests`` with ``policy``, the pending policy without white space around it and in
    lower case, and ``problem``, the first option that a job can't run with, else null.

    The options are those of ``SelectionOptions`` and ``ReviewOptions``; caps may be null."""
    policy = F.lower(F.trim("pending"))
    cap = lambda name: F.col(name).isNull() | (F.col(name) > 0)
    sound = {
        "scene_threshold": _finite("scene_threshold") & F.col("scene_threshold").between(0, 1),
        "interval": _finite("interval") & (F.col("interval") > 0),
        "spacing": _finite("spacing") & (F.col("spacing") >= 0),
        "max_candidates": cap("max_candidates"),
        "image_quality": F.coalesce(F.col("image_quality") > 0, F.lit(False)),
        "pending": F.coalesce(policy.isin("accept", "reject"), F.lit(False)),
        "max_keyframes": cap("max_keyframes"),
    }
    problem = reduce(lambda rest, name: F.when(~sound[name], name).otherwise(rest), reversed(sound), F.lit(None).cast("string"))
    return requests.withColumn("policy", policy).withColumn("problem", problem)
