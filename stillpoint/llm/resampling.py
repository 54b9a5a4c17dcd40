"""Resampling towards a target distribution: documents are drawn with chances that follow
how much likelier their hashed n-grams are under the target texts than under the corpus.

Counts of hashed features are arrays, one a partition, added up over all texts. A
document's weight is the sum of its features' gains, looked up in an array; a fixed random
number of its id turns the weight into a score, and the highest scores are drawn.

The lowest drawn score is found without a sort of the table: each round takes the median of
every block of keys that remain, the weighted median of those as a pivot, and discards the
keys on the pivot's side that can't hold the cutoff. Only the drawn rows are sorted, range
by range.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillpoint.functions.spans import placed
from stillpoint.functions.tables import kept, scratch
from stillpoint.llm.common import order_id, staged

#: A-Z become a-z; other ASCII characters that aren't digits or letters become blanks.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Features that a worker remembers; beyond it the memory is emptied.
REMEMBERED = 300_000
#: Keys of one block, and keys that the driver picks the cutoff from at the end.
BLOCK, LAST_KEYS = 100_000, 20_000
KEY = ["turned", "did", "row"]


class Buckets:
    """Bucket of each feature of a text: the crc32 of its bytes modulo ``buckets``."""

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest = buckets, longest
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        words = text.translate(PLAIN).split()
        features = list(words)
        for n in range(2, self.longest + 1):
            features += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for f in features:
            if f not in known:
                known[f] = zlib.crc32(f) % self.buckets
        return np.fromiter((known[f] for f in features), "i8", len(features))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("raw").to_pylist()]


def _count(batches: Iterator[pa.RecordBatch], make: Buckets) -> Iterator[pa.RecordBatch]:
    total = np.zeros(make.buckets, "i8")
    for batch in batches:
        for text in _texts(batch):
            total += np.bincount(make.of(text), minlength=make.buckets)
    has = np.flatnonzero(total)
    yield pa.record_batch([pa.array(has), pa.array(total[has])], names=["bucket", "n"])


def _weigh(batches: Iterator[pa.RecordBatch], make: Buckets, gains) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [make.of(text) for text in _texts(batch)]
        n, weight = (pa.array([f(x) for x in found], pa.int64()) for f in (len, lambda x: int(gains.value[x].sum())))
        yield pa.record_batch([batch.column("id"), n, weight], names=["id", "n_features", "weight"])


def feature_counts(texts: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    """Features of all texts by bucket; a null text has none. Each partition adds up its
    own array; ``buckets`` numbers reach the driver."""
    make = Buckets(buckets, longest)
    raw = texts.select(F.col(text_col).cast("string").cast("binary").alias("raw"))
    total = np.zeros(buckets, "i8")
    for r in raw.mapInArrow(lambda it: _count(it, make), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]
    return total


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of the smoothed shares) for each bucket."""
    size, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(corpus.tolist(), target.tolist())], "i8")


def _middle(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """Lower weighted median of the rows of ``keys`` and the sum of the weights."""
    order = np.lexsort(keys.T[::-1])
    reached = np.cumsum(weights[order])
    return keys[order[np.searchsorted(reached, (reached[-1] + 1) // 2)]], int(reached[-1])


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a partition: the weighted median of its blocks' medians, and its keys' number."""
    found, held, n = [], [], 0

    def block() -> None:
        keys = np.concatenate(held)
        found.append(_middle(keys, np.ones(len(keys), "i8")))
        held.clear()

    for batch in batches:
        held.append(np.stack([np.asarray(batch.column(c)) for c in KEY], axis=1))
        n += batch.num_rows
        if n >= BLOCK:
            block()
            n = 0
    if n:
        block()
    if found:
        key, size = _middle(np.stack([k for k, _ in found]), np.array([s for _, s in found]))
        yield pa.record_batch([pa.array([x]) for x in (*key.tolist(), size)], names=[*KEY, "n"])


def after(key: list[int]) -> Column:
    """True for rows whose key is larger."""
    a, b, c = (F.col(x) for x in KEY)
    return (a > key[0]) | ((a == key[0]) & ((b > key[1]) | ((b == key[1]) & (c > key[2]))))


def select_key(keys: DataFrame, size: int, rank: int, last_keys: int = LAST_KEYS) -> list[int]:
    """The ``rank``-th smallest (from 1) of ``size`` distinct keys.

    A round reads what remains twice, brings one row a partition to the driver, and leaves
    at most seven eighths of the keys (as a rule half). What remains is written anew when it
    has shrunk to a quarter, so that all rounds together read a few times the table. The
    last ``last_keys`` keys are picked from on the driver."""
    left = keys.select(*KEY)
    stored = size
    while size > last_keys:
        rows = left.mapInArrow(_medians, "turned long, did long, row long, n long").collect()
        pivot, _ = _middle(np.array([[r[c] for c in KEY] for r in rows]), np.array([r["n"] for r in rows]))
        pivot = pivot.tolist()
        upper = left.filter(after(pivot)).count()
        if rank <= size - upper:
            left, size = left.filter(~after(pivot)), size - upper
        else:
            left, size, rank = left.filter(after(pivot)), upper, rank - (size - upper)
        if size * 4 <= stored:
            left, stored = staged(left, "keys"), size
    rest = np.array([[r[c] for c in KEY] for r in left.collect()])
    return rest[np.lexsort(rest.T[::-1])[rank - 1]].tolist()


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = 10_000,
    longest: int = 1, least_words: int = 20, percent: int = 10, seed: int = 2024, last_keys: int = LAST_KEYS,
) -> DataFrame:
    """Draw ``percent`` of the documents with at least ``least_words`` words.

    Returns ``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank``, one row for each
    input row: the rank is 1, 2, 3, … by descending score, ties to the smaller id, and null
    for rows that aren't drawn. Features are the runs of 1 to ``longest`` words.

    A null text has no features and a weight of 0. A null id stays null, draws as the empty
    id, and counts as the largest. Rows that share an id are rows of their own; those with
    equal scores, too, are ranked in one fixed order. An empty corpus gives no rows, an
    empty target a gain for rare features alone. Other columns are not read.
    """
    spark = docs.sparkSession
    make = Buckets(buckets, longest)
    with scratch(spark):
        gains = spark.sparkContext.broadcast(bucket_gains(feature_counts(docs, text_col, buckets, longest), feature_counts(target, target_col, buckets, longest)))
        raw = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
        weighed = raw.mapInArrow(lambda it: _weigh(it, make, gains), "id long, n_features long, weight long")
        drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
        chance = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / 4294967296.0))).cast("long")
        scored = weighed.select("id", "n_features", "weight", (F.col("weight") + chance).alias("score"), F.monotonically_increasing_id().alias("row"))
        scored = staged(scored, "scores").withColumns({"turned": -F.col("score"), "did": order_id("id")})
        words = F.col("n_features")
        if longest > 1:  # n words have n + (n - 1) + … runs
            least = sum(max(0, least_words - n + 1) for n in range(1, longest + 1))
        else:
            least = least_words
        able = scored.filter(words >= least)
        size = able.count()
        want = percent * size // 100
        out = ["id", "n_features", "weight", "score"]
        if not want:
            return kept(scored.select(F.col("id").alias("doc_id"), *out[1:], F.lit(None).cast("long").alias("rank")), "resampled")
        cut = select_key(able, size, want, last_keys)
        winner = (words >= least) & ~after(cut)
        ranked = placed(scored.filter(winner).select(*out, *KEY), KEY, "place").select(*out, (F.col("place") + 1).cast("long").alias("rank"))
        others = scored.filter(~winner).select(*out, F.lit(None).cast("long").alias("rank"))
        return kept(ranked.unionByName(others).withColumnRenamed("id", "doc_id"), "resampled")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target)


_HEX = "instr('0123456789ABCDEF', substr(hx, CAST({} AS BIGINT), 1)) - 1"
ORACLE = {
    "op11_importance_resampling": rf"""
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, xor(c >> 1, (c & 1) * 3988292384) FROM step WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
dw AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
bw AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
vocab AS (SELECT w, hex(encode(w)) AS hx FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
bytes AS (SELECT w, list_transform(range(1, CAST(length(hx) // 2 + 1 AS BIGINT)), lambda p: ({_HEX.format("2 * p - 1")}) * 16 + {_HEX.format("2 * p")}) AS bs FROM vocab),
bucket AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(bs, lambda b: CAST(b AS BIGINT))), lambda c, b: xor(c >> 8, tab[CAST(xor(c & 255, b) + 1 AS BIGINT)])), 4294967295) % 10000 AS b
  FROM bytes, crc
), s AS (SELECT b, count(*) AS n FROM dw JOIN bucket USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bw JOIN bucket USING (w) GROUP BY b),
gain AS (
  SELECT s.b, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * ((SELECT sum(n) FROM s) + 10000) / (CAST(s.n + 1 AS DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (b)
), weighed AS (SELECT doc_id, count(*) AS n, sum(g) AS wt FROM dw JOIN bucket USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(wt, 0) AS BIGINT) AS weight,
    CAST(coalesce(wt, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weighed USING (doc_id)
), ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * able // 100 THEN rank END AS rank FROM scored s LEFT JOIN ranked r USING (doc_id)
"""
}
