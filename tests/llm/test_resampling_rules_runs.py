"""Importance resampling, compression bands and periodic runs against plain restatements."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from stillpoint.llm import compression, periodic, resampling
from stillpoint.llm.registry import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_features string, row string, raw string"
ODD = [None, "", " \n\t", "a", "ß Ωmega 漢字 " * 9, "same same " * 40, "x" * 50_000, "\u0001\u0000end of", "a b c d e f g h " * 30 + "\nA B\nA B\n  \n"]


def odd_documents(spark):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice(["alpha", "Beta", "c3", "über", "|", "x\ny", "x\nx y"]) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    rows = [(k // 2 if k % 7 else None, t, "clash", "clash", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:12], SCHEMA).repartition(5)


# importance resampling


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features_of(text, longest):
    words = words_of(text)
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, buckets, longest, least_words, percent):
    """(id, text) rows to sorted (id, features, weight, score, rank) rows."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features_of(text, longest):
                counts[bucket(f)] += 1
    gains = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + buckets) / ((s[b] + 1.0) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        found = features_of(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gains[bucket(f)] for f in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text)) >= least_words])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return rows


def told(rows):
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("longest,least,percent", [(1, 20, 10), (3, 5, 50), (1, 1, 100), (1, 20, 0)])
def test_resample_as_restated(spark, longest, least, percent):
    docs = odd_documents(spark)
    target = ["alpha beta alpha", None, "über c3 c3", ""]
    made = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), buckets=97, longest=longest, least_words=least, percent=percent, last_keys=4)
    assert made.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got, want = made.collect(), plain_resample([(r.doc_id, r.text) for r in docs.collect()], target, 97, longest, least, percent)
    assert sorted(r.rank for r in got if r.rank) == list(range(1, sum(1 for r in want if r[4]) + 1))
    # rows of one id and score may change places among themselves
    assert told([(*r[:4], None) for r in got]) == told([(*r[:4], None) for r in want])
    assert sorted((r.rank, str(r.doc_id), r.score) for r in got if r.rank) == sorted((r[4], str(r[0]), r[3]) for r in want if r[4])


def test_resample_query(spark):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], 10_000, 1, 20, 10)
    assert told(queries()["op11_importance_resampling"](spark, SF).collect()) == told(want)


def test_resample_of_nothing(spark):
    docs, none = odd_documents(spark), spark.createDataFrame([], "text string")
    assert resampling.resample(docs.limit(0), none).collect() == []
    assert resampling.resample(docs, none).count() == docs.count()


def test_key_selection_is_exact(spark):
    rng = random.Random(3)
    for spread in (3, 10**6):
        keys = [(rng.randrange(spread), rng.randrange(5), k) for k in range(3_000)]
        frame = spark.createDataFrame(keys, "turned long, did long, row long").repartition(6)
        for rank in (1, 2, 1500, 2999, 3000):
            assert resampling.select_key(frame, 3_000, rank, last_keys=10) == list(sorted(keys)[rank - 1])


def test_medians_of_many_blocks(monkeypatch, spark):
    monkeypatch.setattr(resampling, "BLOCK", 64)
    import pyarrow as pa

    values = np.random.default_rng(1).permutation(5_000)
    batches = [pa.record_batch([pa.array(part), pa.array(part * 0), pa.array(part * 0)], names=resampling.KEY) for part in np.array_split(values, 90)]
    (row,) = (b.to_pylist()[0] for b in resampling._medians(iter(batches)))
    assert row["n"] == 5_000 and 5_000 // 8 <= row["turned"] <= 5_000 * 7 // 8


# compression bands


def plain_counts(text):
    blank = " \t\n\x0b\x0c\r"
    text = text or ""
    words = [w for w in re.split(f"[{blank}]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(blank)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(marked)


def test_quality_rules_as_restated(spark):
    docs = odd_documents(spark)
    made = compression.quality_rules(docs)
    got = made.collect()
    assert len(got) == docs.count()
    want = []
    for r in docs.collect():
        n = plain_counts(r.text)
        raw = (r.text or "").encode()
        ratio = len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(raw)) / max(1, len(raw))
        want.append((r.doc_id, *n, n[0] < 20 or 100 * n[4] > 30 * n[0], round(ratio, 9)))
    mine = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, round(r.ratio, 9)) for r in got]
    assert sorted(mine, key=str) == sorted(want, key=str)
    assert not any(r.kept and r.base_failed for r in got)
    assert compression.quality_rules(docs.limit(0)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), st.integers(2, 9))
def test_repeats_by_window(words, window):
    windows = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    assert compression.repeated_words(words, window) == len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(window)})


def test_bands_reject_repetitive_and_random_texts(spark):
    rng = random.Random(8)
    prose = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(900))
    varied = " ".join(f"{rng.choice('ab')}{k % 7} turn of the" for k in range(3_000))  # no window of eight words comes often
    random_text = " ".join("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(70)) for _ in range(120))
    half = prose + " " + random_text[: len(prose)]
    rows = spark.createDataFrame(list(enumerate([prose, varied, random_text, half, prose[:300]])), "doc_id long, text string")
    kept = {r.doc_id: (r.kept, r.n_bad_chunks) for r in compression.quality_rules(rows).collect()}
    assert [kept[k][0] for k in range(5)] == [True, False, False, False, True]
    assert kept[3][1] > 0  # the whole text's ratio is fine, half of its chunks aren't


def test_quality_rules_keep_good_documents(spark):
    rules, labels = queries()["op12_quality_rules"](spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = rules.join(labels.filter("quality = 1"), "doc_id").filter("not base_failed")
    assert good.count() > 250 and good.filter("not kept").count() == 0


# periodic runs


def plain_runs(words, least=12):
    found = {}
    for d in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - d:
            j = i
            while j < len(words) - d and words[j] == words[j + d]:
                j += 1
            if j > i and j - i + d >= max(least, 2 * d):
                found.setdefault((i, j - i + d), d)
            i = max(j, i + 1)
    return sorted((s, n, d) for (s, n), d in found.items())


def plain_row(doc_id, text, plant):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if plant and n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(left)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=12), st.integers(1, 9)), max_size=6), st.integers(1, 14))
def test_runs_of_texts_against_every_period(parts, least):
    words = np.array([x for part, times in parts for x in part * times], "i8")
    got = periodic.find_runs([np.zeros(30, "i8"), words, words[::-1]], least)
    assert got[got[:, 0] == 0].tolist() == [[0, 0, 30, 1]]
    for k, text in ((1, words), (2, words[::-1])):
        assert [tuple(r) for r in got[got[:, 0] == k][:, 1:].tolist()] == plain_runs(text.tolist(), least)


@pytest.mark.parametrize("plant", [True, False])
def test_periodic_runs_as_restated(spark, plant):
    docs = odd_documents(spark)
    got = periodic.periodic_runs(docs, plant=plant).drop("n_kept").collect()
    assert sorted([tuple(r)[:8] for r in got], key=str) == sorted([plain_row(r.doc_id, r.text, plant) for r in docs.collect()], key=str)
    assert all(hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 for r in got)
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_periodic_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries()["op13_periodic_runs"](spark, SF).collect()
    assert sorted(tuple(r)[:8] for r in got) == sorted(plain_row(r.doc_id, r.text, True) for r in docs)


def test_transform_is_exact():
    rng = np.random.default_rng(2)
    for t in periodic.TRANSFORMS:
        a, b = (rng.integers(0, t.prime, (3, 16)).astype("u8") for _ in range(2))
        assert (t.inverse(t.forward(a)) == a).all()
        got = t.inverse(t.reduced(t.forward(a) * t.forward(b)))
        for r in range(3):
            want = [sum(int(a[r, i]) * int(b[r, (k - i) % 16]) for i in range(16)) % t.prime for k in range(16)]
            assert got[r].tolist() == want


def test_large_numbers_take_more_primes():
    words = np.arange(3_000_000 - 64, 3_000_000)  # squared differences beyond one prime
    text = np.concatenate([words, words, words[:9]])
    assert periodic.find_runs([text]).tolist() == [[0, 0, 137, 64]]


def test_long_texts_of_one_word_and_nested_runs():
    assert periodic.find_runs([np.zeros(150_000, "i8")]).tolist() == [[0, 0, 150_000, 1]]
    nested = np.array(([0] * 100 + [1]) * 60, "i8")
    assert len(periodic.find_runs([nested])) == 61
