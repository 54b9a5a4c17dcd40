"""Scores and fingerprints against plain restatements of their rules."""

import hashlib
import zlib

import numpy as np
import regex
import xxhash
from pyspark.sql import functions as F

from stillpoint.llm import fingerprints, language, quality, toxicity
from stillpoint.llm.wordgrams import word_ids

LAST = (1 << 63) - 1
MASK = (1 << 64) - 1
SF = "/root/testdata/sf0.001"


def documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(120).collect()
    odd = [(10_001, None), (10_002, ""), (10_003, " \n"), (10_004, "x"), (10_005, "1234 !!"), (10_006, "\u6f22\u5b57\u30c6\u30b9\u30c8\u3067\u3059 \U0001f600 \u00e9"), (10_007, "Zq" * 3000), (None, "a row without an id"), (10_008, "twice"), (10_008, "twice")]
    return spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows] + [(*o, "en") for o in odd], "doc_id long, text string, lang string")


def gram_id(gram: str, bits: int) -> int:
    rolled = 0
    for c in gram:
        rolled = (rolled * 1_000_003 + ord(c)) & MASK
    golden = 0x9E3779B97F4A7C15
    mixed = ((rolled ^ (rolled >> 29)) * golden + len(gram)) & MASK
    mixed = ((mixed ^ (mixed >> 32)) * golden) & MASK
    return mixed >> (64 - bits)


def word_grams(word: str, low: int, high: int) -> list[str]:
    marked = f"\x02{word}\x03"
    return [marked[i : i + n] for n in range(low, high + 1) for i in range(len(marked) - n + 1)]


def test_language_gram_by_gram(spark):
    docs = documents(spark)
    names, idf, weights, temperature = model = language.fit_language(docs)
    learned = [r for r in docs.collect() if r.text is not None and (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 != 2)]
    in_texts = {}
    for r in learned:
        for g in {gram_id(g, language.BITS) for w in language.letters(r.text) for g in word_grams(w, 1, 4)}:
            in_texts[g] = in_texts.get(g, 0) + 1
    assert all(abs(idf[g] - (np.log((1 + len(learned)) / (1 + n)) + 0.1)) < 1e-9 for g, n in in_texts.items())
    texts = {}
    for r in docs.collect():
        texts.setdefault(LAST if r.doc_id is None else r.doc_id, r.text or "")
    for r in language.identify_language(docs, model).collect():
        ids = [gram_id(g, language.BITS) for w in language.letters(texts[r.did]) for g in word_grams(w, 1, 4)]
        if not ids:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        logits = weights[-1].copy()
        for g in ids:
            logits += language.SCALE / len(ids) * idf[g] * weights[g]
        chance = np.exp(logits / temperature - (logits / temperature).max())
        chance /= chance.sum()
        assert abs(chance.max() - r.score) < 1e-6 and abs(chance[names.index(r.lang_pred)] - chance.max()) < 1e-9


def plain_gru(p, side, xs):
    h, u, states = toxicity.HIDDEN, p[f"{side}_u"], {}
    state = np.zeros(h)
    for t in range(len(xs)) if side == "f" else range(len(xs) - 1, -1, -1):
        g, hu = xs[t] @ p[f"{side}_w"] + p[f"{side}_bias"], state @ u
        z, r = 1 / (1 + np.exp(-(g[:h] + hu[:h]))), 1 / (1 + np.exp(-(g[h : 2 * h] + hu[h : 2 * h])))
        new = np.tanh(g[2 * h :] + r * hu[2 * h :])
        state = z * state + (1 - z) * new
        states[t] = state
    return [states[t] for t in range(len(xs))]


def test_toxicity_window_by_window(spark):
    docs = documents(spark)
    labels = docs.filter("doc_id is not null").select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    p, slope, offset = model = toxicity.fit_toxicity(docs, labels)
    assert slope != 0
    texts = {}
    for r in docs.collect():
        texts.setdefault(LAST if r.doc_id is None else r.doc_id, r.text or "")
    rows = toxicity.score_toxicity(docs, model).collect()
    for r in sorted(rows, key=lambda r: r.did)[::7] + [r for r in rows if r.did > 10_000]:
        words = regex.findall(r"\w+", texts[r.did].lower())
        xs = []
        for w in words:
            grams = [p["gram"][gram_id(g, toxicity.GRAM_BITS)] for g in word_grams(w, toxicity.LOW, toxicity.HIGH)]
            xs.append(np.r_[p["word"][word_ids([w], toxicity.WORD_BITS)[0]], np.mean(grams, axis=0) if grams else np.zeros(toxicity.GRAM_DIM)])
        logits, start = [], 0
        while True:
            own = xs[start : start + toxicity.WINDOW]
            states = [np.r_[a, b] for a, b in zip(plain_gru(p, "f", own), plain_gru(p, "b", own))]
            raw = np.array([np.tanh(s @ p["att_w"] + p["att_b"]) @ p["att_v"] for s in states])
            weight = np.exp(raw - raw.max()) / np.exp(raw - raw.max()).sum() if len(raw) else raw
            context = sum((w * s for w, s in zip(weight, states)), np.zeros(2 * toxicity.HIDDEN))
            logits.append(context @ p["out_w"] + p["out_b"][0])
            if start + toxicity.WINDOW >= len(xs):
                break
            start += toxicity.STRIDE
        want = 1 / (1 + np.exp(-(slope * max(logits) + offset)))
        assert abs(want - r.score) < 1e-3 and r.predicted == int(r.score >= 0.3)


def test_toxicity_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(400)] + [(i, "word " * 50) for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, toxic int")
    seen = []
    train, toxicity.train = toxicity.train, lambda texts, y, prior: seen.append((len(texts), sum(map(len, texts)), prior))
    try:
        toxicity.fit_toxicity(docs, labels, per_class=5)
        toxicity.fit_toxicity(docs, labels, per_class=5, class_chars=600)
    finally:
        toxicity.train = train
    assert seen[0][0] == 10 and seen[1][0] <= 6 and seen[1][1] <= 1200


def test_quality_by_plain_densities(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    label = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1)}
    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    x = {i: np.array(quality.statistics(t)) for i, t in texts.items()}
    own = {c: np.array([x[i] for i in texts if not out(i) and label.get(i) == c]) for c in (0, 1)}
    both = sum(len(v) * np.cov(v.T, bias=True) for v in own.values()) / sum(map(len, own.values()))
    density = {}
    for c, v in own.items():
        s = 0.95 * np.cov(v.T, bias=True) + 0.05 * both
        s = 0.99 * s + 0.01 * (np.trace(s) / len(s) + 1e-6) * np.eye(len(s))
        prior = np.log((len(v) + 1) / (sum(map(len, own.values())) + 2))
        inverse, log_det = np.linalg.inv(s), np.linalg.slogdet(s)[1]
        density[c] = {i: -0.5 * (y - v.mean(0)) @ inverse @ (y - v.mean(0)) - 0.5 * log_det + prior for i, y in x.items()}
    for r in quality.classify_quality(docs, labels).collect():
        want = 1 / (1 + np.exp(-np.clip(density[1][r.did] - density[0][r.did], -500, 500)))
        assert abs(want - r.score) < 1e-4 and r.held_out == out(r.did)


UNSPACED = r"\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Thai}\p{Script=Lao}\p{Script=Khmer}\p{Script=Myanmar}"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def plain_winnow(text: str, k: int, w: int) -> list[tuple[int, int]]:
    """Position and hash of the chosen k-grams."""
    units = regex.findall(rf"[{UNSPACED}]|[^ \t\n\x0b\f\r{UNSPACED}]{{1,8}}", text.lower())
    h = [xxhash.xxh64(u.encode(), seed=42).intdigest() for u in units]

    def pair(a, b):
        one = xxhash.xxh64((a & MASK).to_bytes(8, "little"), seed=42).intdigest()
        return one if b is None else xxhash.xxh64((b & MASK).to_bytes(8, "little"), seed=one).intdigest()

    def span(i, size):
        if i >= len(h):
            return None
        if size == 1:
            return h[i]
        half = 1
        while half * 2 < size:
            half *= 2
        return pair(span(i, half), span(i + size - half, half))

    grams = [span(i, k) for i in range(max(1, len(h) - k + 1))] if h else [xxhash.xxh64(b"", seed=42).intdigest()]
    chosen = []
    for lo in range(max(1, len(grams) - w + 1)):
        window = grams[lo : lo + w]
        least = min(window, key=lambda g: signed(g) >> fingerprints.PLACE_BITS)
        at = max(i for i, g in enumerate(window) if g >> fingerprints.PLACE_BITS == least >> fingerprints.PLACE_BITS)  # rightmost
        if (lo + at, least >> fingerprints.PLACE_BITS) not in chosen[-1:]:
            chosen.append((lo + at, least >> fingerprints.PLACE_BITS))
    return chosen


def alike(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b)


def test_fingerprints_by_a_plain_winnower(spark):
    docs = documents(spark)
    pairs = sorted(((LAST if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect()), key=lambda p: (-p[0], -signed(xxhash.xxh64(p[1].encode(), seed=42).intdigest())))
    want = []
    for (i, a), (_, b) in zip(pairs, pairs[1:] + pairs[:1]):
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        own, other = plain_winnow(a, 3, 6), plain_winnow(edited, 3, 6)
        text = lambda f: " ".join(f"{p:x}:{h:x}" for p, h in f)
        want.append((i, len(a), hashlib.sha256(edited.encode()).hexdigest(), text(own), text(other), alike(own, other), alike(own, plain_winnow(b, 3, 6))))
    for options in ({}, {"parts": 1}, {"parts": 3}, {"part_bytes": 20_000}):
        assert sorted(tuple(r) for r in fingerprints.fingerprint_edits(docs, **options).collect()) == sorted(want)
    empty = docs.filter("false")
    assert fingerprints.fingerprint_edits(empty).count() == 0 == fingerprints.winnow(empty).count()
    assert sorted((r.did, r.n_chars, r.fingerprint) for r in fingerprints.winnow(docs).collect()) == sorted((w[0], w[1], w[3]) for w in want)


def test_a_frequent_id_is_many_ranges(spark):
    """Half of the rows lack an id: their ranges are cut by the hashes of their texts."""
    rows = [(None if i % 2 else i, f"text {i} of many words, each its own {i * i}") for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("did"), F.xxhash64("text").alias("th"), F.col("text").alias("txt"))
    edges = fingerprints.range_borders(own, 1 << 20, 40)
    sizes = [r["count"] for r in own.groupBy(fingerprints._below(edges)).count().collect()]
    assert 30 <= len(sizes) <= 80 and max(sizes) < 3 * 2_000 / 40
    got = {(r.did, r.edited_sha256) for r in fingerprints.fingerprint_edits(docs, parts=40).collect()}
    pairs = sorted(((LAST if i is None else i, t) for i, t in rows), key=lambda p: (-p[0], -signed(xxhash.xxh64(p[1].encode(), seed=42).intdigest())))
    want = {(i, hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()) for (i, a), (_, b) in zip(pairs, pairs[1:] + pairs[:1])}
    assert got == want


def test_fingerprints_keep_the_guarantee(spark):
    """Texts that share w + k - 1 units in a row share a chosen k-gram; a shared beginning of a
    short text, or one without spaces, is seen."""
    shared = "seven quick foxes jumped over nine very lazy dogs in march "
    texts = [(1, "some first words here " + shared + "then an end"), (2, "another start altogether, " + shared + "and other things follow"), (3, "\u6f22\u5b57\u4eee\u540d\u4ea4\u3058\u308a\u6587\u306e\u4f8b\u3067\u3059\u304b\u3089" * 3), (4, "q7" * 200)]
    assert fingerprints.shared_units(3, 6) == 8
    got = {r.did: {g >> fingerprints.PLACE_BITS for g in r.grams} for r in fingerprints.winnow(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1] & got[2] and len(got[3]) > 1
    edits = {r.did: r.near_edited for r in fingerprints.fingerprint_edits(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(edits[i] > 0 for i in (1, 2, 4))


def test_winnowing_picks_rightmost_least(spark):
    text = " ".join(["a", "b"] * 20)
    r = fingerprints.winnow(spark.createDataFrame([(1, text)], "doc_id long, text string"), k=2, w=4).first()
    places = [fingerprints.PLACES - (g & fingerprints.PLACES) for g in r.grams]
    assert len({g >> fingerprints.PLACE_BITS for g in r.grams}) == 1  # two k-grams, the lesser one always
    assert all(b - a == 2 for a, b in zip(places, places[1:])) and places[0] in (2, 3)
