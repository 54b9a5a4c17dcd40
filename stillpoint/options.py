"""Job options, checked on the driver before any job starts."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, fields


class OptionError(ValueError):
    """An option that a job can't run with."""


def _number(name: str, value, low: float, high: float = math.inf, open_low: bool = False) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise OptionError(f"{name} must be a finite number")
    if value < low or value > high or (open_low and value == low):
        raise OptionError(f"{name} is out of range")
    return float(value)


def _cap(name: str, value) -> int | None:
    if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value <= 0):
        raise OptionError(f"{name} must be a positive integer or None")
    return value


def _from_mapping(kind, given: Mapping):
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        raise OptionError(f"unknown options: {', '.join(sorted(unknown))}")
    return kind(**given)


@dataclass(frozen=True)
class SelectionOptions:
    """How candidates are planned; times are seconds."""

    scene_threshold: float = 0.35
    interval: float = 20.0
    spacing: float = 2.0
    max_candidates: int | None = 120
    image_quality: int = 2
    overwrite: bool = False

    def __post_init__(self):
        _number("scene_threshold", self.scene_threshold, 0, 1)
        _number("interval", self.interval, 0, open_low=True)
        _number("spacing", self.spacing, 0)
        _cap("max_candidates", self.max_candidates)
        if _cap("image_quality", self.image_quality) is None:
            raise OptionError("image_quality must be a positive integer")
        if not isinstance(self.overwrite, bool):
            raise OptionError("overwrite must be true or false")

    @classmethod
    def of(cls, given: Mapping) -> SelectionOptions:
        return _from_mapping(cls, given)


@dataclass(frozen=True)
class ReviewOptions:
    """How reviewed candidates become keyframes."""

    pending: str = "accept"
    max_keyframes: int | None = None
    overwrite: bool = False

    def __post_init__(self):
        policy = str(self.pending).strip().lower()
        if policy not in ("accept", "reject"):
            raise OptionError("pending must be accept or reject")
        object.__setattr__(self, "pending", policy)
        _cap("max_keyframes", self.max_keyframes)

    @classmethod
    def of(cls, given: Mapping) -> ReviewOptions:
        return _from_mapping(cls, given)
