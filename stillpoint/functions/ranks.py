"""Ranks of events. A null score ranks as 0.0; earlier events win ties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Priorities of sources and of decisions.
SOURCES = {"scene": 3, "seed": 2, "periodic": 1}
REVIEWS = {"accepted": 3, "pending": 2, "rejected": 0}


def _priority(value: Column, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, priority in table.items():
        out = F.when(value == name, priority).otherwise(out)
    return out


def source_priority(source: Column) -> Column:
    return _priority(source, SOURCES)


def review_priority(decision: Column, source: Column) -> Column:
    """The sum of both: a pending scene outranks an accepted periodic frame."""
    return _priority(decision, REVIEWS) + source_priority(source)


def best_first(priority: Column, score: Column, t: Column, *ties: Column) -> list[Column]:
    return [priority.desc(), F.coalesce(score, F.lit(0.0)).desc(), t.asc(), *[x.asc() for x in ties]]
