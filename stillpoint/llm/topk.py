"""Exact top-k search by exhaustive term-at-a-time accumulation.

Components are terms. A block of candidates is a set of postings by term: the places of
the candidates whose weight on the term is not zero, and those weights. Each query row of
a block scatters its weight times the postings of each of its terms into a dense score
array; partition selection then keeps the k best of the block, and the blocks' results
are merged by query.

Queries are dealt in groups of a bounded size. A task has one lane of candidates and one
group of queries: its queries come first and are held, the candidates stream by in blocks,
and the best k of each query so far are its state. So no row has more than one vector, and
what a task holds depends on neither table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stillpoint.functions.tables import kept, scratch
from stillpoint.llm.common import staged

#: Beyond this size of a component the accumulators are Python integers.
SMALL = 1 << 24
INT64 = np.iinfo("i8")


def sound(vec: Column) -> Column:
    """True for vectors that are not null, not empty and hold finite numbers only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vec, finite) & (F.size(vec) > 0), F.lit(False))


def integers(vecs: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) as a matrix; shorter vectors are filled with zeros."""
    n = np.diff(np.asarray(vecs.offsets))
    x = np.floor(np.asarray(vecs.flatten()) * scale)
    kind = "i8" if not len(x) or np.abs(x).max() < SMALL else object
    values = x.astype("i8") if kind == "i8" else np.array([int(v) for v in x], object)
    out = np.zeros((len(n), int(n.max())), kind)
    out[np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(k) for k in n])] = values
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Dense scores, a term at a time over the postings of the candidates."""
    kind = object if object in (queries.dtype, candidates.dtype) else "i8"
    scores = np.zeros((len(queries), len(candidates)), kind)
    for term in range(min(queries.shape[1], candidates.shape[1])):
        places = np.flatnonzero(candidates[:, term])
        asking = np.flatnonzero(queries[:, term])
        if len(places) and len(asking):
            part = np.multiply.outer(queries[asking, term], candidates[places, term])
            if len(places) == len(candidates) and len(asking) == len(queries):
                scores += part
            else:
                scores[np.ix_(asking, places)] += part
    return scores if kind == "i8" else np.clip(scores, INT64.min, INT64.max).astype("i8")


class Best:
    """The k best candidates of each query so far, ties to smaller ids."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int):
        self.ids, self.values, self.k = ids, values, k
        self.least = np.full(len(ids), INT64.min)  # the k-th score
        self.found = [(np.zeros(0, "i8"),) * 3]

    def take(self, ids: np.ndarray, values: np.ndarray) -> None:
        scores = accumulate(self.values, values)
        other = self.ids[:, None] != ids[None]
        edge = self.least
        if len(ids) > self.k:  # partition selection inside the block
            edge = np.maximum(edge, np.partition(np.where(other, scores, INT64.min), -self.k, axis=1)[:, -self.k])
        q, i = np.nonzero((scores >= edge[:, None]) & other)
        self.found.append((q, ids[i], scores[q, i]))
        if sum(len(f[0]) for f in self.found) > 4 * self.k * len(self.ids):
            self.merge()

    def merge(self) -> None:
        q, i, s = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((i, ~s, q))  # ~s falls as s rises, the smallest score included
        q, i, s = q[order], i[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep, last = place < self.k, np.flatnonzero(place == self.k - 1)
        self.found = [(q[keep], i[keep], s[keep])]
        self.least[q[last]] = s[last]

    def rows(self) -> pa.RecordBatch:
        self.merge()
        q, i, s = self.found[0]
        return pa.record_batch([pa.array(self.ids[q], pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])


def _padded(parts: list[np.ndarray]) -> np.ndarray:
    """Matrices of different widths as one, filled with zeros."""
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


def _search(batches: Iterator[pa.RecordBatch], k: int, scale: int, block_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows by lane and group, the queries of each before its candidates."""
    key, state, held = None, None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(c)).astype("i8") for c in ("lane", "asks", "item")]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            lane, asks, item = (int(c[lo]) for c in columns)
            if (lane, asks) != key:
                if state:
                    yield state.rows()
                key, state, held = (lane, asks), None, []
            part = batch.slice(lo, hi - lo)
            if not item:
                held.append((np.asarray(part.column("vid")), integers(part.column("vec"), scale)))
                continue
            if held:
                state, held = Best(np.concatenate([i for i, _ in held]), _padded([v for _, v in held]), k), []
            for at in range(0, part.num_rows if state else 0, block_rows):
                block = part.slice(at, block_rows)
                state.take(np.asarray(block.column("vid")), integers(block.column("vec"), scale))
    if state:
        yield state.rows()


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding",
    query_rows: int = 1024, block_rows: int = 4096, lanes: int | None = None,
) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest integer inner product for each query.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``. A component x counts as
    floor(scale * x). Ties go to the smaller id; a query's own id is no candidate; fewer
    than ``k`` candidates give as many rows.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor
    do rows without an id. Vectors of different lengths meet on their common components.
    Rows that repeat an id count each as a candidate, and once as a query (the first by
    value). Scores beyond 64 bits are held at the border. Empty tables give an empty
    result. Other columns are not read.
    """
    spark = vectors.sparkSession
    lanes = lanes or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def rows(df: DataFrame) -> DataFrame:
        vec = F.col(vec_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias("vid"), vec.alias("vec")).filter(F.col("vid").isNotNull() & sound(F.col("vec")))

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    with scratch(spark):
        asked = staged(rows(queries).groupBy("vid").agg(F.min("vec").alias("vec")), "queries")
        groups = max(1, -(-asked.count() // query_rows))
        asked = asked.select("vid", "vec", F.lit(False).alias("item"), F.pmod(F.xxhash64("vid"), F.lit(groups)).cast("int").alias("asks")).withColumn("lane", all_of(lanes))
        own = rows(vectors).select("vid", "vec", F.lit(True).alias("item"), F.pmod(F.xxhash64("vid", "vec"), F.lit(lanes)).cast("int").alias("lane")).withColumn("asks", all_of(groups))
        dealt = own.unionByName(asked).repartition("lane", "asks").sortWithinPartitions("lane", "asks", "item", "vid")
        found = dealt.mapInArrow(lambda it: _search(it, k, scale, block_rows), "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return kept(ranked.select("query_id", "rank", "vec_id", "score"), "top-k")


def op3_exact_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


ORACLE = {
    "op3_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
}
