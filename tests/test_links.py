"""Classes through pivots: equal to all pairs, in a shuffle that grows with the rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from stillpoint.functions import links as li
from stillpoint.functions.components import connected_components

T = 0.8


def packed(sets):
    return [np.array(sorted(s), "u8").tobytes() for s in sets]


def frame(spark, sets, groups, block):
    size = {g: -(-groups.count(g) // block) for g in set(groups)}
    rows = [(i, 1, g, size[g], hash((i, 7)) % size[g], len(s), raw) for i, (s, g, raw) in enumerate(zip(sets, groups, packed(sets)))]
    return spark.createDataFrame(rows, "rid long, weight long, grp long, blocks int, own int, n int, grams binary").repartition(4)


def plain(sets, groups):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if groups[a] == groups[b] and both >= T * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def classes(links, n):
    found = {r.node: r.root for r in connected_components(links.selectExpr("rid AS a", "root AS b")).collect()}
    return [found.get(i, i) for i in range(n)]


def near_copies(rng, base, n, changes, fresh):
    return [set(rng.sample(base, len(base) - k)) | {next(fresh) for _ in range(k)} for k in (rng.randrange(changes) for _ in range(n))]


@pytest.mark.parametrize("seed", range(4))
def test_classes_of_mixed_groups(spark, seed):
    """Tight clusters, chains, loners and bridges in groups of many blocks."""
    rng, fresh = random.Random(seed), iter(range(10**6, 10**9))
    sets, groups = [], []
    for g in range(3):
        for _ in range(rng.randrange(1, 5)):
            base = [next(fresh) for _ in range(60)]
            some = near_copies(rng, base, rng.randrange(1, 60), 9, fresh)
            chain = [set(base)]
            for _ in range(rng.randrange(25)):  # each link of the chain leaves a few grams of the one before
                last = chain[-1]
                chain.append(set(rng.sample(sorted(last), len(last) - 5)) | {next(fresh) for _ in range(5)})
            sets += some + chain
            groups += [g] * (len(some) + len(chain))
    order = list(range(len(sets)))
    rng.shuffle(order)
    sets, groups = [sets[i] for i in order], [groups[i] for i in order]
    for block in (16, 4096):
        assert classes(li.spanned(frame(spark, sets, groups, block), T, block=block), len(sets)) == plain(sets, groups)


def test_a_large_group_is_shuffled_a_few_times(spark, monkeypatch):
    rng, fresh = random.Random(9), iter(range(10**6, 10**9))
    base = [next(fresh) for _ in range(40)]
    n, block = 4_000, 64
    sets = near_copies(rng, base, n - 3, 4, fresh) + [{next(fresh) for _ in range(40)} for _ in range(3)]
    seen = []
    real = li._checked

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(li, "_checked", counted)
    got = classes(li.spanned(frame(spark, sets, [1] * n, block), T, block=block), n)
    assert got == [0] * (n - 3) + [n - 3, n - 2, n - 1]
    # all pairs of blocks: n * n / block rows, 250,000; here the three loners meet nobody
    assert sum(seen) <= n


def test_estimates_of_recall_come_with_the_links(spark):
    sets = [set(range(20))] * 5 + [set(range(1, 21))] * 5
    made = li.spanned(frame(spark, sets, [1] * 10, 4), T, lambda s: np.stack([s, s**2]), block=4).collect()
    assert all(len(r.mass) == 2 for r in made)
    for r in made:
        if r.met == 1:
            assert r.mass[0] == pytest.approx(1.0) or r.mass[0] == pytest.approx(21 / 19)


def test_pivot_rows_of_one_block():
    sets = packed([set(range(10)), set(range(10)), set(range(1, 11)), set(range(50, 60))])
    batch = pa.record_batch([pa.array([0, 1, 2, 3]), pa.array([7] * 4), pa.array([0] * 4, pa.int32()), pa.array([True, False, False, False]), pa.array(sets, pa.binary())], names=["rid", "grp", "own", "pivot", "grams"])
    rows = [r for b in li._to_pivots(iter([batch]), T, None) for r in b.to_pylist()]
    assert {(r["rid"], r["root"]) for r in rows} == {(1, 1), (2, 2), (3, 3), (1, 0), (2, 0)}
    assert all(len(r["near"]) == li.PIVOTS for r in rows)


def test_pivots_are_rooted_by_group():
    edges = [[{"a": 3, "b": 3}, {"a": 3, "b": 9}, {"a": 5, "b": 9}, {"a": 7, "b": 7}], [{"a": 1, "b": 1}]]
    batch = pa.record_batch([pa.array([1, 2]), pa.array([4, 2], pa.int32()), pa.array(edges)], names=["grp", "blocks", "edges"])
    rows = [r for b in li._rooted(iter([batch])) for r in b.to_pylist()]
    assert [dict(zip(r["pivots"], r["roots"])) for r in rows] == [{3: 3, 5: 3, 7: 7, 9: 3}, {1: 1}]


def test_a_group_that_pivots_hardly_settle(spark, monkeypatch):
    """Pairs of near copies, more of them than pivots: one round of pivots, the rest pair by pair."""
    rounds, real = [], li._pivot_round

    def counted(*args):
        rounds.append(1)
        return real(*args)

    monkeypatch.setattr(li, "_pivot_round", counted)
    sets = [set(range(100 * (i // 2), 100 * (i // 2) + 40)) | {10**6 + i} for i in range(120)]
    groups = [1] * len(sets)
    assert classes(li.spanned(frame(spark, sets, groups, 8), T, block=8), len(sets)) == plain(sets, groups)
    assert len(rounds) == 1


def test_components_of_stars_take_one_round(spark, monkeypatch):
    """Stars are told from one shuffle; paths across tasks take a few rounds."""
    from stillpoint.functions import components

    tables = []
    monkeypatch.setattr(components, "new_path", lambda session, tag, f=components.new_path: tables.append(tag) or f(session, tag))
    stars = [(10 * k + i, 10 * k) for k in range(50) for i in range(1, 10)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(stars, "a long, b long").repartition(7)).collect()}
    assert found == dict(stars) and tables.count("low") == 1
    tables.clear()
    names = list(range(2000))
    random.Random(1).shuffle(names)
    path = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long").repartition(40)
    rows = connected_components(path).collect()
    assert {r.node for r in rows} == set(range(1, 2000)) and {r.root for r in rows} == {0} and len(rows) == 1999 and tables.count("low") <= 12


def test_components_in_rounds_and_in_one_task_are_the_same(spark, monkeypatch):
    """A graph of few edges takes no round, whatever its paths; what a task can't hold takes rounds until it can."""
    from stillpoint.functions import components

    tables = []
    monkeypatch.setattr(components, "new_path", lambda session, tag, f=components.new_path: tables.append(tag) or f(session, tag))
    rng, names = random.Random(2), list(range(600))
    rng.shuffle(names)
    edges = list(zip(names[:400], names[1:400])) + [(rng.choice(names[400:]), rng.choice(names[400:])) for _ in range(150)] + [(5, 5)]
    root = {n: n for n in names}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {n: r for n, r in root.items() if n != r}
    df = spark.createDataFrame(edges, "a long, b long").repartition(40)
    for rows, most in ((None, 1 << 18), (len(edges), 1 << 18), (None, 100), (None, 0), (None, 300)):
        tables.clear()
        monkeypatch.setattr(components, "HELD", most)
        assert {r.node: r.root for r in connected_components(df, rows).collect()} == want
        assert (len(tables) == 2) == (most == 1 << 18)
    assert connected_components(df.filter("false"), 0).count() == 0


def test_narrow_tables_are_few_files(spark, tmp_path, monkeypatch):
    from stillpoint.functions import tables

    monkeypatch.setattr(tables, "NARROW", 400)
    tables.gathered(spark.range(1000, numPartitions=64), 1000).write.parquet(f"{tmp_path}/t")
    files = list(tmp_path.glob("t/part-*"))
    assert len(files) == 3 and spark.read.parquet(f"{tmp_path}/t").count() == 1000


def several_groups(seed):
    rng, fresh = random.Random(seed), iter(range(10**6, 10**9))
    sets, groups = [], []
    for g in range(2):
        for _ in range(4):
            some = near_copies(rng, [next(fresh) for _ in range(60)], 30, 12, fresh)
            sets += some
            groups += [g] * len(some)
    return sets, groups


@pytest.mark.parametrize("most", [10, 200_000])
def test_classes_with_narrow_tables_read_together(spark, monkeypatch, most):
    """The same classes whether narrow tables are one task's work or shuffled."""
    from stillpoint.functions import tables

    monkeypatch.setattr(tables, "NARROW", most)
    sets, groups = several_groups(11)
    assert classes(li.spanned(frame(spark, sets, groups, 16), T, block=16, rows=len(sets)), len(sets)) == plain(sets, groups)


def test_near_duplicates_take_few_tasks(spark):
    """A group of several blocks in a session of 40 partitions: only what holds grams, texts or
    signatures is dealt out to all of them."""
    from stillpoint.llm import jaccard

    rng, words = random.Random(4), [f"w{k}" for k in range(4000)]
    base, rows = [rng.choice(words) for _ in range(120)], []
    for i in range(120):
        text = list(base)
        for _ in range(rng.randrange(6)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, i, " ".join(text)))
    df = spark.createDataFrame(rows, "did long, rid long, txt string").repartition(8)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before, sc = {k: spark.conf.get(k) for k in held}, spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("near-duplicates", "tasks")
        gone = {r.rid for r in jaccard.later_rows(df, df.select("rid"), block=16).collect()}
        told = sc.statusTracker()
        stages = {s for j in told.getJobIdsForGroup("near-duplicates") for s in told.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for s in stages if (i := told.getStageInfo(s)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    sets = [set(jaccard.shingles(t, 5).tolist()) for _, _, t in rows]
    assert gone == {i for i, root in enumerate(plain(sets, [0] * len(sets))) if i != root}
    assert 0 < tasks < 2600, tasks
