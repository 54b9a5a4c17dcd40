"""The keyframe index: whole rows, plans without a shuffle, replaced parts."""

import pytest

from stillpoint.functions.tables import new_path
from stillpoint.operators import corpus as co
from stillpoint.sources import index_store
from stillpoint.sources.index_store import PARTS, KeyframeStore


def frame(spark, part, rows):
    return spark.createDataFrame(rows, f"frame_id long, {PARTS[part]}")


@pytest.fixture
def store(spark):
    made = KeyframeStore(spark, new_path(spark, "index"), 3)
    made.put("keyframes", frame(spark, "keyframes", [(1, "a", 0, "p1"), (2, "a", 9000, "p2"), (3, "b", 0, "p3"), (None, "b", 0, "p4")]))
    made.put("texts", frame(spark, "texts", [(1, "red fox"), (3, None), (9, "no frame"), (1, "red fox")]))
    made.put("objects", frame(spark, "objects", [(1, [("cat", 0.5), ("ant", 0.1), ("cat", 0.2)]), (2, [])]))
    segments = spark.createDataFrame([("a", 7, 1.0, "hello"), ("a", 8, 8.5, None), ("c", 9, 0.0, "none")], "video_id string, segment_id long, t double, text string")
    made.put_speech(spark.createDataFrame([("a", 1, 0.0), ("a", 2, 9.0), ("b", 3, 0.0)], "video_id string, frame_id long, t double"), segments)
    yield made
    made.drop()


def test_rows_are_whole(spark, store):
    got = {r.frame_id: r for r in store.index().collect()}
    assert sorted(got) == [1, 2, 3] and set(got[1].asDict()) == {"frame_id", *(c.split()[0] for p in PARTS.values() for c in p.split(", "))}
    assert (got[1].ocr_text, got[1].asr_window_id, got[1].asr_text, got[1].clip_embedding) == ("red fox", 7, "hello", None)
    assert (got[2].ocr_text, got[2].asr_window_id, got[2].asr_text) == (None, 8, None) and got[3].asr_window_id is None
    opened = KeyframeStore(spark, store.path)
    assert opened.buckets == 3 and sorted(r.frame_id for r in opened.index().collect()) == [1, 2, 3]


def test_the_parts_are_joined_without_a_shuffle(spark, store):
    for part in ("embeddings", "colors", "metadata"):
        store.put(part, spark.createDataFrame([], f"frame_id long, {PARTS[part]}"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = store.index()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") == len(PARTS) - 1 and "Exchange" not in plan


def test_a_part_is_replaced_as_a_whole(spark, store, monkeypatch):
    store.put("texts", frame(spark, "texts", [(2, "blue")]))
    text = lambda s: {r.frame_id: r.ocr_text for r in s.index().collect()}
    assert text(store) == {1: None, 2: "blue", 3: None}
    with monkeypatch.context() as m:
        m.setattr(index_store, "point", lambda *a: (_ for _ in ()).throw(RuntimeError("the driver dies")))
        with pytest.raises(RuntimeError):
            store.put("texts", frame(spark, "texts", [(3, "green")]))
    assert text(store) == text(KeyframeStore(spark, store.path)) == {1: None, 2: "blue", 3: None}


def test_evidence(spark, store):
    ranked = spark.createDataFrame([(5, 1, 1), (5, 2, 2), (5, 3, 3), (6, 99, 1)], "query_id long, item_id long, rank int")
    hits = co.hit_evidence(ranked, store.index(), 2)
    got = {(r.query_id, r.rank): (r.ocr_text, r.objects, r.asr_text) for r in hits.collect()}
    assert got == {(5, 1): ("red fox", "ant x 1, cat x 2", "hello"), (5, 2): (None, "", None), (6, 1): (None, "", None)}
    told = {r.query_id: (r.n_hits, r.evidence) for r in co.question_evidence(hits).collect()}
    assert told == {5: (2, "red fox\nant x 1, cat x 2\nhello\n\n\n"), 6: (1, "\n\n")}
