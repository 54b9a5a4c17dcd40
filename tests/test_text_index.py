"""The stored text index, and search by the rarest term: plans, updates, failures, brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stillpoint.functions.tables import new_path
from stillpoint.operators import postings as po
from stillpoint.operators import search as se
from stillpoint.sources import text_store
from stillpoint.sources.text_store import TextStore, co_located

WORDS = ["red", "rad", "read", "fox", "foxes", "hen", "he", "h", "über", "ubér", "the"]


def texts_of(seed, n=120):
    rng = random.Random(seed)
    odd = [None, "", "...", "the " * 50]
    return [(k, rng.choice(odd) if rng.random() < 0.1 else "the " + " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 12)))) for k in range(n)]


def frame(spark, rows, name="item_id"):
    return spark.createDataFrame(rows, f"{name} long, text string")


def split(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def near(a, b):
    if a == b:
        return 0
    short, long = sorted((a, b), key=len)
    if len(long) - len(short) == 1:
        return 1 if any(long[:i] + long[i + 1 :] == short for i in range(len(long))) else 2
    return 1 if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 else 2


def brute(items, queries, distance):
    out = {}
    for q, asked in queries:
        wanted = set(split(asked))
        for i, text in items:
            words = split(text)
            best = [max((words.count(w) / (1 + near(t, w)) for w in set(words) if near(t, w) <= distance), default=0) for t in wanted]
            if wanted and all(best):
                out[q, i] = round(sum(best), 9)
    return out


@pytest.fixture
def store(spark):
    made = TextStore.create(spark, new_path(spark, "index"), frame(spark, texts_of(1)), buckets=3)
    yield made
    made.drop()


QUERIES = [(1, "the red fox"), (2, "rad"), (3, "the"), (4, "fox hen über the he"), (5, "absent fox"), (6, ""), (7, None), (8, "he h the red rad read foxes fox"), (9, "fox fox"), (10, "THE Über")]


@pytest.mark.parametrize("distance", [0, 1])
@pytest.mark.parametrize("part", [po.PART, 7])
def test_search_against_brute_force(spark, store, distance, part):
    items = texts_of(1)
    more = [(k + 1000, t) for k, t in texts_of(2, 60)]
    store.add(frame(spark, more), part)  # with small parts, frequent terms are cut into many
    find = se.text_fuzzy if distance else se.text_exact
    with co_located(spark):
        got = {(r.query_id, r.item_id): round(r.score, 9) for r in find(store, frame(spark, QUERIES, "query_id")).collect()}
    assert got == brute(items + more, QUERIES, distance)
    plain = find(se.text_index(frame(spark, items + more)), frame(spark, QUERIES, "query_id"))
    assert {(r.query_id, r.item_id): round(r.score, 9) for r in plain.collect()} == got


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_update_equals_rebuild(spark, store, monkeypatch):
    monkeypatch.setattr(text_store, "MOST_SEGMENTS", 3)
    everything = texts_of(1)
    for step in range(1, 5):  # the last one merges
        more = [(k + 1000 * step, t) for k, t in texts_of(step + 1, 20)]
        everything += more
        store.add(frame(spark, more))
        again = TextStore.create(spark, new_path(spark, "again"), frame(spark, everything))
        assert rows(store.postings()) == rows(again.postings()) == rows(se.text_index(frame(spark, everything)))
        assert rows(store.frequencies()) == rows(again.frequencies())
        again.drop()
    assert len(store.names) == 2
    opened = TextStore(spark, store.path)
    assert opened.names == store.names and rows(opened.postings()) == rows(store.postings())


def test_no_exchange_on_the_side_of_the_index(spark, store, monkeypatch):
    monkeypatch.setattr(po, "ROUNDS", [(1, 1), (2, None)])
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}.items():
            spark.conf.set(k, v)
        with co_located(spark):
            for find in (se.text_exact, se.text_fuzzy):
                lines = find(store, frame(spark, QUERIES, "query_id"))._jdf.queryExecution().executedPlan().toString().split("\n")
                scans = [k for k, line in enumerate(lines) if "FileScan" in line and "text_" in line]
                assert len(scans) >= 4
                for k in scans:  # from a scan up to the first join above it
                    depth, at = re.search(r"[A-Za-z*(]", lines[k].split("FileScan")[0] + "F").start(), k
                    while "Join" not in lines[at]:
                        assert "Exchange" not in lines[at], "\n".join(lines)
                        at -= 1
                    assert depth > 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_only_the_rarest_term_brings_items(spark):
    """Rows of the joins with postings: the rarest term's list, then items times terms."""
    rng = random.Random(4)
    items = [(k, "the of and " + ("rare" if k % 500 == 7 else "") + " " + " ".join(rng.choice(WORDS) for _ in range(5))) for k in range(2_000)]
    queries = frame(spark, [(q, "the of and rare") for q in range(50)], "query_id")
    segment = po.segment_of(se.text_index(frame(spark, items)))
    seen = []

    class Counted:
        def join(self, other, on):
            out = segment.postings.join(other, on)
            seen.append(out.count())
            return out

    hits = po.matches([po.Segment(Counted(), segment.frequencies, segment.keys)], queries, 0)
    assert hits.count() == 50 * 4
    assert seen == [50 * 4, 50 * 4 * 3, 0]  # every list of every query: 50 * (4 + 3 * 2000)


def test_failed_update_leaves_the_store(spark, store, monkeypatch):
    import os

    want, names = rows(store.postings()), list(store.names)
    bad = frame(spark, [(5000, "new words")]).withColumn("text", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        store.add(bad)
    monkeypatch.setattr(text_store, "point", lambda *a: (_ for _ in ()).throw(RuntimeError("the driver dies")))
    with pytest.raises(RuntimeError):
        store.add(frame(spark, [(5000, "new words")]))
    opened = TextStore(spark, store.path)
    assert opened.names == names and rows(opened.postings()) == want
    assert all(os.path.isdir(f"{store.path.removeprefix('file://')}/{n}") for n in names)


def test_items_are_indexed_once(spark, store):
    with pytest.raises(ValueError):
        store.add(frame(spark, [(3, "again"), (7000, "new")]))
    with pytest.raises(FileExistsError):
        TextStore.create(spark, store.path, frame(spark, []))
    with pytest.raises(FileNotFoundError):
        TextStore(spark, new_path(spark, "none"))
    store.add(frame(spark, [(None, "no id"), (8000, "twice"), (8000, "twice twice")]))
    assert rows(store.postings().filter("item_id >= 7000")) == [("twice", 8000, 3)]


def test_empty_store(spark):
    store = TextStore.create(spark, new_path(spark, "empty"), frame(spark, []))
    assert rows(store.postings()) == [] == rows(se.text_exact(store, frame(spark, QUERIES, "query_id")))
    store.drop()
