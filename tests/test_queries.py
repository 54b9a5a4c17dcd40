"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from stillpoint.operators import corpus

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if n in entry.registry.REGISTRY]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False, name=None)], key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if sql := entry.oracle_sql().get(name):
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_duplicate_groups_by_brute_force(spark):
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    sets = {}
    for i, t in zip(docs.doc_id, docs.text):
        w = [x for x in re.split(r"[^\w]|_", t.lower()) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    got = {r.item_id: r.group_id for r in entry.queries()["duplicate_groups"](spark, SF).collect()}
    assert got == group


def test_duplicate_groups_through_a_middle_member(spark):
    """a ~ x and x ~ y, but not a ~ y: x isn't the smallest of any band that it shares with both."""
    rows = []
    for k in range(20):
        words = [f"w{k}x{i}" for i in range(210)]
        x = words[:-22] + [f"t{k}x{i}" for i in range(22)]
        y = [f"h{k}x{i}" for i in range(22)] + x[22:]
        rows += [(3 * k + n, " ".join(w)) for n, w in enumerate((words, x, y))]
    items = spark.createDataFrame(rows, "item_id long, text string")
    for block in (2048, 1):
        got = {r.item_id: r.group_id for r in corpus.duplicate_groups(items, bands=8, rows=1, block=block).collect()}
        assert got == {i: i - i % 3 for i, _ in rows}
