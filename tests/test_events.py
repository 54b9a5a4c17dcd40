"""Golden micro-tables of the selection operators, worked out by hand, and properties."""

import random

import pytest
from pyspark.sql import functions as F

from stillpoint.functions.ids import candidate_id, keyframe_id
from stillpoint.operators import events as ev
from stillpoint.operators import review as rv
from stillpoint.options import OptionError, ReviewOptions, SelectionOptions
from stillpoint.schemas import EVENTS

VIDEOS = "video_ord long, video_id string, duration double"


def make(spark, rows, video=1):
    return spark.createDataFrame([(video, f"v{video}", float(t), s, None if x is None else float(x), i) for i, (t, s, x) in enumerate(rows)], EVENTS)


def times(df):
    return [(r.t, r.source) for r in df.orderBy("video_ord", "t", "ord").collect()]


def test_threshold(spark):
    frames = make(spark, [(1, "scene", 0.35), (2, "scene", 0.36), (3, "scene", None), (4, "scene", float("nan")), (5, "scene", float("inf"))])
    assert [t for t, _ in times(ev.scene_filter(frames))] == [2.0, 5.0]


@pytest.mark.parametrize(
    "duration,interval,want",
    [(65, 20, [20, 40, 60]), (75, 20, [20, 40, 60, 74]), (60, 20, [20, 40, 60]), (10, 20, [9]), (1.0, 20, []), (0.5, 20, []), (0.3, 0.1, [0.1, 0.2]), (None, 20, []), (0, 20, []), (-1, 20, [])],
)
def test_periodic_and_tail(spark, duration, interval, want):
    v = spark.createDataFrame([(1, "v", None if duration is None else float(duration))], VIDEOS)
    got = ev.periodic_events(v, interval).unionByName(ev.tail_events(v, interval)).orderBy("t").collect()
    assert [r.t for r in got] == want


MERGES = [
    ([(0, "seed", 1), (1.5, "scene", 0.4), (3.0, "scene", 0.3), (3.6, "periodic", 0)], [(1.5, "scene"), (3.6, "periodic")]),
    ([(0, "seed", 1), (0.5, "scene", 0.4), (2.0, "scene", 0.5), (3.5, "scene", 0.6), (5.0, "scene", 0.7)], [(5.0, "scene")]),
    ([(0, "seed", 1), (2.0, "periodic", 0)], [(0, "seed"), (2.0, "periodic")]),
    ([(-0.04, "scene", 0.9), (0, "seed", 1)], [(0, "seed")]),
    ([(10, "scene", None), (11, "scene", 0.2)], [(11, "scene")]),
    ([(10, "scene", 0.5), (11, "scene", 0.5)], [(10, "scene")]),
]


@pytest.mark.parametrize("rows,want", MERGES)
def test_spacing_merge(spark, rows, want):
    assert times(ev.spacing_merge(ev.nonnegative_events(make(spark, rows)), 2.0)) == want


def test_spacing_zero_keeps_all(spark):
    assert len(times(ev.spacing_merge(make(spark, [(0, "seed", 1), (0, "scene", 0.5)]), 0))) == 2


def scan(rows, spacing):
    """The plain rule: compare with the first kept event that is near."""
    rank = lambda r: ({"scene": 3, "seed": 2, "periodic": 1}[r[1]], r[2] or 0.0, -r[0])
    kept = []
    for r in sorted(rows, key=lambda x: x[0]):
        near = next((i for i, k in enumerate(kept) if abs(k[0] - r[0]) < spacing), None)
        if near is None:
            kept.append(r)
        elif rank(r) > rank(kept[near]):
            kept[near] = r
    return sorted((k[0], k[1]) for k in kept)


@pytest.mark.parametrize("span,rows_a_batch", [(86_400.0, 10_000), (7.0, 2)])
def test_spacing_merge_random(spark, span, rows_a_batch):
    rng = random.Random(4)
    frames, want = None, {}
    for video in range(12):
        rows = [(rng.randint(0, 160) / 4, rng.choice(["scene", "seed", "periodic"]), rng.choice([None, 0.1, 0.5, 0.9])) for _ in range(rng.randint(1, 60))]
        want[video] = scan(rows, 2.0)
        one = make(spark, rows, video)
        frames = one if frames is None else frames.unionByName(one)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        out = ev.spacing_merge(frames, 2.0, span=span).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    got = {}
    for r in out:
        got.setdefault(r.video_ord, []).append((r.t, r.source))
    assert {v: sorted(x) for v, x in got.items()} == want


def test_candidate_cap(spark):
    rows = make(spark, [(0, "seed", 1), (10, "scene", 0.4), (20, "scene", 0.9), (30, "periodic", 0), (50, "periodic", 0)])
    for k, want in ((3, [0, 10, 20]), (4, [0, 10, 20, 30]), (1, [20]), (None, [0, 10, 20, 30, 50])):
        assert [t for t, _ in times(ev.candidate_cap(rows, k))] == want


def test_scene_dedupe(spark):
    for given, want in (([1.0001, 1.0004, 1.0006], [1.0001, 1.0006]), ([0.0005, 0.0015, 0.0025], [0.0005, 0.0015])):
        assert [t for t, _ in times(ev.scene_dedupe(make(spark, [(t, "scene", 0.5) for t in given])))] == want


def test_read_attempts(spark):
    out = ev.read_attempts(make(spark, [(5, "scene", 1), (0, "scene", 1), (0.3, "scene", 1)])).orderBy("ord", "attempt").collect()
    assert [r.attempt_t for r in out] == [5, 4.75, 4.5, 4, 0, 0.3, 0.3 - 0.25, 0]


def test_ids(spark):
    df = spark.createDataFrame([(20.0,), (1.0005,), (12345678.901,)], "t double")
    got = df.select(candidate_id(F.lit("v"), F.lit("periodic"), F.col("t")), keyframe_id(F.lit("v"), F.col("t"))).collect()
    assert got[0][0] == "v_periodic_t0000020000" and got[0][1] == "v_keyframe_t0000020000"
    assert got[1][0].endswith("t0000001000") and got[2][0].endswith("t12345678901")


def reviewed(spark):
    rows = [("a", "accepted", "scene", 0.1, 40.0), ("b", "pending", "scene", 0.3, 30.0), ("c", "pending", "seed", 1.0, 0.0), ("d", "accepted", "periodic", 0.0, 20.0), ("e", "rejected", "scene", 0.9, 10.0)]
    return spark.createDataFrame([("v", *r, i) for i, r in enumerate(rows)], "video_id string, candidate_id string, decision string, source string, score double, timestamp_seconds double, ord long")


def test_review(spark):
    for policy, k, want in (("accept", None, "cdba"), ("accept", 3, "cba"), ("accept", 2, "ba"), ("reject", None, "da")):
        out = rv.keyframe_cap(rv.review_filter(reviewed(spark), policy), k).orderBy("timestamp_seconds").collect()
        assert "".join(r.candidate_id for r in out) == want


def test_carry_decisions(spark):
    old = spark.createDataFrame([("x", "accepted", 1), ("x", "rejected", 2), ("y", "accepted", 3), ("z", "accepted", 4)], "candidate_id string, decision string, ord long")
    new = spark.createDataFrame([("x", "pending"), ("y", "pending"), ("w", "pending")], "candidate_id string, decision string")
    got = {r.candidate_id: r.decision for r in rv.carry_decisions(new, rv.last_decisions(old)).collect()}
    assert got == {"x": "rejected", "y": "accepted", "w": "pending"}


def test_options():
    assert ReviewOptions.of({"pending": " Reject "}).pending == "reject"
    for bad in ({"scene_threshold": 2}, {"interval": 0}, {"spacing": float("nan")}, {"max_candidates": 0}, {"nope": 1}, {"image_quality": 0}):
        with pytest.raises(OptionError):
            SelectionOptions.of(bad)
    with pytest.raises(OptionError):
        ReviewOptions.of({"pending": "maybe"})
