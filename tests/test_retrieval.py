"""Search, time and corpus operators against brute force: nulls, ties, repeats, spans, empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillpoint.functions.spans import placed
from stillpoint.operators import corpus as co
from stillpoint.operators import search as se
from stillpoint.operators import temporal as te

SPANS = [86_400.0, 3.0]


def frames_of(spark, seed=1, repeats=True):
    rng = random.Random(seed)
    rows = [(f"v{rng.randrange(3)}", i, rng.choice([0.0, 1.0, 2.5, rng.randrange(40) / 4])) for i in range(80)]
    return rows, spark.createDataFrame(rows, "video_id string, frame_id long, t double")


@pytest.mark.parametrize("span", SPANS)
def test_nearest_segment(spark, span):
    rows, frames = frames_of(spark)
    rng = random.Random(5)
    segs = [(f"v{rng.randrange(2)}", k, rng.randrange(12) / 1.0) for k in range(14)]
    out = te.nearest_segment(frames.unionByName(spark.createDataFrame([("v0", 99, None)], frames.schema)), spark.createDataFrame([*segs, ("v0", 77, None)], "video_id string, segment_id long, t double"), span)
    got = {r.frame_id: (r.segment_id, r.distance) for r in out.collect()}
    assert got.pop(99) == (None, None)
    for v, f, t in rows:
        own = sorted((abs(s - t), s, k) for w, k, s in segs if w == v)
        assert got[f] == ((own[0][2], own[0][0]) if own else (None, None))
    assert te.nearest_segment(frames.filter("false"), spark.createDataFrame(segs, "video_id string, segment_id long, t double")).count() == 0


@pytest.mark.parametrize("span", SPANS)
def test_neighbors_and_slices(spark, span):
    rows, frames = frames_of(spark, 2)
    hits = frames.filter("frame_id % 7 = 0").unionByName(frames.filter("frame_id = 0"))
    want = set()
    for v in {r[0] for r in rows}:
        own = sorted((t, f) for w, f, t in rows if w == v)
        for k, (_, f) in enumerate(own):
            if f % 7 == 0:
                want |= {x[1] for x in own[max(0, k - 2) : k + 3]}
    got = [r.frame_id for r in te.neighbors(hits, frames, 2, span).collect()]
    assert sorted(got) == sorted(want)
    for part in ("first", "last"):
        want = []
        for v in {r[0] for r in rows}:
            own = sorted(((t, f) for w, f, t in rows if w == v), reverse=part == "last")
            want += [f for k, (_, f) in enumerate(own) if k / max(1, len(own) - 1) <= 0.25]
        assert sorted(r.frame_id for r in te.temporal_slice(frames, part, 0.25, span=span).collect()) == sorted(want)
    twice = spark.createDataFrame([("v", 1, 0.0), ("v", 1, 0.0), ("v", 2, 5.0), ("w", 3, 1.0)], frames.schema)
    assert sorted(r.frame_id for r in te.temporal_slice(twice, "first", 0.0, span=span).collect()) == [1, 1, 3]
    assert te.neighbors(hits.filter("false"), frames, 2).count() == 0 == te.temporal_slice(frames.filter("false"), "last").count()
    with pytest.raises(ValueError):
        te.temporal_slice(frames, "middle")


def test_sequences(spark):
    rng = random.Random(3)
    rows = [(f"v{rng.randrange(2)}", rng.choice("abc"), rng.randrange(60) / 2, i, rng.randrange(4) / 4) for i in range(90)]
    hits = spark.createDataFrame(rows, "video_id string, step string, t double, frame_id long, score double")
    best = {}
    for v, s1, t1, f1, x1 in rows:
        for w, s2, t2, f2, x2 in rows:
            if s1 == "a" and s2 == "b" and v == w and 0 < t2 - t1 <= 3:
                for u, s3, t3, f3, x3 in rows:
                    if s3 == "c" and u == v and 0 < t3 - t2 <= 3:
                        best.setdefault(v, set()).add(x1 + x2 + x3)
    got = {r.video_id: (r.total, r.chain) for r in te.sequences(hits, ["a", "b", "c"], 3.0).collect()}
    assert {v: t for v, (t, _) in got.items()} == {v: max(x) for v, x in best.items()}
    score, step = {r[3]: r[4] for r in rows}, {r[3]: r[1] for r in rows}
    assert all(sum(score[f] for f in chain) == total and "".join(step[f] for f in chain) == "abc" for total, chain in got.values())
    assert te.sequences(hits.filter("false"), ["a", "b"], 3.0).count() == 0
    with pytest.raises(ValueError):
        te.sequences(hits, ["a", "b"], 0)


def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)], [rng.choice(["red", "blue"]), "any"]) for i in range(150)]
    rows += [(200, rows[3][1], ["red", "red"]), (201, rows[3][1], None), (202, None, ["red"]), (203, [0.0] * 6, ["red"]), (204, [float("nan")] * 6, ["red"]), (205, [None] * 6, ["red"]), (206, [], ["red"])]
    return rows, spark.createDataFrame(rows, "item_id long, vec array<double>, dominant_colors array<string>")


def test_vectors(spark):
    rows, items = vectors(spark)
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    color = {i: set(c or []) for i, _, c in rows}
    asked = items.filter("item_id % 50 = 3 or item_id > 201").select(F.col("item_id").alias("query_id"), "vec", F.lit("red").alias("color"))
    for name, run, some in (
        ("all", lambda: se.vector_top_k(items, asked, 5, lanes=3, held=2), lambda i: True),
        ("red", lambda: se.color_search(items, asked, 5, lanes=3), lambda i: "red" in color[i]),
    ):
        got = {}
        for r in run().collect():
            got.setdefault(r.query_id, []).append((r.rank, r.item_id, round(r.score, 9)))
        want = {}
        for q in (3, 53, 103):
            order = sorted((-round(float(good[q] @ good[i]), 9), i) for i in good if i != q and some(i))[:5]
            want[q] = [(k, i, -s) for k, (s, i) in enumerate(order, 1)]
        assert {q: sorted(x) for q, x in got.items()} == want, name
    assert se.vector_top_k(items.filter("false"), asked, 5).count() == 0 == se.vector_top_k(items, asked.filter("false"), 5).count()
    videos = items.select("item_id", "vec", (F.col("item_id") % 7).alias("video_id"))
    clips = asked.select(F.lit(1).alias("clip_id"), "query_id", "vec")
    want = {v: sum(max(float(good[q] @ good[i]) for i in good if i % 7 == v and i != q) for q in (3, 53, 103)) for v in range(7)}
    got = [(r.rank, r.video_id, round(r.score, 9)) for r in se.clip_to_video(videos, clips, 4, lanes=3).orderBy("rank").collect()]
    assert got == [(k, v, round(s, 9)) for k, (v, s) in enumerate(sorted(want.items(), key=lambda x: (-x[1], x[0]))[:4], 1)]


def test_stretches_around_pivots_are_skipped_exactly(spark):
    from pyspark.sql import Observation

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8)) * 4
    vecs = np.concatenate([c + rng.normal(size=(60, 8)) * 0.2 for c in centres])
    vecs = np.concatenate([vecs, vecs[:30]])  # ties
    items = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "item_id long, vec array<double>").repartition(5)
    asked = items.filter("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    seen = Observation()
    got = {}
    for r in se.vector_top_k(items, asked, 10, lanes=2, held=9, seen=seen).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.item_id
    units = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for q in range(0, len(vecs), 50):
        scores = np.einsum("j,ij->i", units[q], units)
        scores[q] = -9
        assert [got[q][k] for k in range(1, 11)] == np.lexsort((np.arange(len(vecs)), -np.round(scores, 12)))[:10].tolist()
    pairs, skipped = seen.get["pairs"], seen.get["skipped"]
    assert pairs == len(vecs) * len(got) and skipped > 0.5 * pairs


def test_vector_tasks_hold_queries_only(spark):
    """No row has two vectors, and a task's state doesn't grow with its items."""
    items = spark.range(5_000).selectExpr("id AS item_id", "array(cos(id), sin(id), 1D) AS vec")
    asked = items.filter("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    from stillpoint.operators import vectors as ve

    rows = ve.dealt(items.selectExpr("item_id AS id", "vec", "0 AS part", "0 AS pivot", "0D AS far"), asked.selectExpr("query_id AS id", "vec", "0 AS part"), 4, 30)
    assert rows.count() == 5_000 * 4 + 100 * 4 and set(rows.columns) == {"id", "vec", "part", "pivot", "far", "item", "size", "lane", "asks"}
    held = rows.filter("not item").groupBy("lane", "asks").count().collect()
    assert len(held) == 16 and max(r["count"] for r in held) < 60


def test_query_sequences(spark):
    rng = random.Random(7)
    steps = [(1, 1, None), (1, 2, 3.0), (1, 3, 1.5), (2, 1, None), (3, 1, None), (3, 2, None), (4, 1, None), (4, 3, 2.0), (5, 2, 1.0), (6, 1, None), (6, 2, 0.0)]
    asks = spark.createDataFrame(steps, "query_id long, step int, gap double")
    gaps = {(q, s): g for q, s, g in steps}
    rows = [(q, s, f"v{rng.randrange(2)}", rng.randrange(40) / 4, rng.randrange(60), rng.randrange(4) / 4) for q, s, _ in steps for _ in range(25)]
    rows += [(1, 2, "v0", None, 5, 1.0), (1, 2, None, 1.0, 5, 1.0), (1, 2, "v0", 1.0, 5, None), (9, 1, "v0", 1.0, 1, 1.0), rows[0], rows[30]]
    hits = spark.createDataFrame(rows, "query_id long, step int, video_id string, t double, frame_id long, score double")
    want = {}
    sound = [r for r in rows if r[3] is not None and r[5] is not None]
    for q, n in ((1, 3), (2, 1), (3, 2)):
        chains = [(v, t, x, (f,)) for w, s, v, t, f, x in sound if w == q and s == 1]
        for step in range(2, n + 1):
            gap = gaps[q, step]
            chains = [(v, t, total + x, (*c, f)) for v, at, total, c in chains for w, s, u, t, f, x in sound if w == q and s == step and u == v and t > at and (gap is None or t - at <= gap)]
        for v, _, total, c in chains:
            old = want.get((q, v))
            if old is None or (-total, c) < (-old[0], old[1]):
                want[q, v] = (total, c)
    got = {(r.query_id, r.video_id): (r.total, tuple(r.chain)) for r in te.query_sequences(hits, asks).collect()}
    assert got == want and {q for q, _ in want} == {1, 2, 3}
    assert te.query_sequences(hits.filter("false"), asks).count() == 0 == te.query_sequences(hits, asks.filter("false")).count()


def test_temporal_proximity(spark):
    hits = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10), (1, 10), (1, 99)], "query_id long, item_id long")
    frames = spark.createDataFrame([(10, "a", 5.0), (11, "a", 90_000.0), (12, "b", 1.0), (13, "a", 0.0)], "item_id long, video_id string, t double")
    anchors = spark.createDataFrame([(1, "a", 8.0), (1, "a", 100_000.0), (2, "b", 1.0), (1, "c", 1.0)], "query_id long, video_id string, t double")
    got = {(r.query_id, r.item_id): r.score for r in te.temporal_proximity(hits, frames, anchors, 3.0).collect()}
    assert got == {(1, 10): 0.5, (1, 11): 1 / (1 + 10_000 / 3)}


def test_text(spark):
    items = spark.createDataFrame([(1, "Red fox, red hen"), (2, "red  foxes"), (3, None), (4, ""), (5, "fox RED"), (5, "fox again")], "item_id long, text string")
    queries = spark.createDataFrame([(1, "red fox"), (2, ""), (3, None), (4, "absent"), (5, "fox fox")], "query_id long, text string")
    postings = se.text_index(items)
    assert {(r.query_id, r.item_id, r.score) for r in se.text_exact(postings, queries).collect()} == {(1, 1, 3), (1, 5, 3), (5, 1, 1), (5, 5, 2)}
    assert {(r.query_id, r.item_id): r.phrase for r in se.text_exact(postings, queries.filter("query_id = 1"), items.filter("item_id < 5")).collect()} == {(1, 1): True}
    assert {(r.query_id, r.item_id) for r in se.text_fuzzy(postings, spark.createDataFrame([(1, "rad foxs")], "query_id long, text string")).collect()} == {(1, 1), (1, 2), (1, 5)}
    assert se.text_exact(se.text_index(items.filter("false")), queries).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1.0), (1, 11, 3.0), (2, 10, 5.0)], "query_id long, item_id long, score double")
    b = spark.createDataFrame([(1, 11, 2.0), (1, 12, 2.0)], a.schema)
    fan = se.fan_out(x=a, y=b)
    assert {(r.query_id, r.item_id): (r.x, r.y) for r in fan.collect()} == {(1, 10): (0.0, None), (1, 11): (1.0, 1.0), (1, 12): (None, 1.0), (2, 10): (1.0, None)}
    ranked = se.weighted_rerank(fan, {"x": 0.5, "y": 0.5}, 2)
    assert {(r.query_id, r.rank): (r.item_id, r.score) for r in ranked.collect()} == {(1, 1): (11, 1.0), (1, 2): (12, 0.5), (2, 1): (10, 0.5)}
    again = se.feedback_rerank(ranked, spark.createDataFrame([(12, 1), (11, 0), (99, None)], "item_id long, relevant int"), 0.5, 0.25)
    assert {(r.query_id, r.rank): (r.item_id, r.score) for r in again.collect()} == {(1, 1): (12, 1.0), (1, 2): (11, 0.75), (2, 1): (10, 0.5)}
    result = se.retrieval_eval(ranked, spark.createDataFrame([(1, 12), (1, 11), (3, 1)], "query_id long, item_id long"), 1).first()
    assert (result.n_queries, result.recall_at_k, result.mrr) == (2, 0.25, 0.5)


def test_corpus(spark):
    items = spark.createDataFrame([(1, "A b"), (2, "a,  B!"), (3, None), (4, ""), (5, "c"), (5, "c")], "item_id long, text string")
    assert sorted((r.item_id, r.group_id) for r in co.exact_groups(items).collect()) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (5, 5)]
    assert co.exact_groups(items.filter("false")).count() == 0 == co.duplicate_groups(items.filter("false")).count()


def test_positions(spark):
    rng = random.Random(6)
    values = [rng.randrange(30) for _ in range(200)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long").repartition(5)
    got = sorted((r.place, r.v, r.i) for r in placed(df, ["v", "i"], "place").collect())
    assert got == [(k, v, i) for k, (v, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))]
    assert placed(df.filter("false"), ["v"], "place").count() == 0
