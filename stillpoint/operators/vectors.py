"""Exact vector search: a stated set of queries against all items, in blocks.

Queries are dealt in groups of a bounded size. A task has one lane of items and one group of
queries: its queries come first and are held, its items stream by, so what it holds doesn't
depend on how many there are of either, and a pair of an item and a query is never a row.

For a top-k, items lie around pivots, in order of their distance from them. The best k of
every query so far are the task's state. By the triangle inequality no item of a stretch is
nearer to a query than the query's distance from the pivot and the stretch's distances from
it allow, so stretches that can't beat a query's k-th score are skipped for it, exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Vectors that items are grouped around, and queries that a task holds, about.
PIVOTS, HELD = 64, 4_096
#: Scores closer than this are compared by their exact values and ids.
CLOSE = 1e-9
KEYS = ["part", "size", "lane", "asks"]


def unit(rows: DataFrame, column: str = "vec") -> DataFrame:
    """Vectors at length 1, as doubles. Null and empty vectors, those with a null or
    non-finite component and those of length 0 have no direction: their rows go."""
    vec = F.col(column).cast("array<double>")
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))
    sound = norm.isNotNull() & (norm > 0) & (norm < float("inf"))
    return rows.withColumn(column, F.when(sound, F.transform(vec, lambda x: x / norm))).filter(F.col(column).isNotNull())


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long rows as a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def pivots_of(items: DataFrame, count: int = PIVOTS) -> np.ndarray | None:
    """At most ``count`` of the vectors, of one length, chosen by a hash of their ids."""
    some = [r["vec"] for r in items.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(count).collect()]
    some = [v for v in some if len(v) == len(some[0])]
    return np.array(some) if some else None


def _around(batches: Iterator[pa.RecordBatch], pivots: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Each item's nearest pivot and its distance from it; none for vectors of another length."""
    for batch in batches:
        pivot, far = np.full(batch.num_rows, -1, "i4"), np.zeros(batch.num_rows)
        vecs = batch.column("vec")
        some = np.flatnonzero(np.diff(np.asarray(vecs.offsets)) == (pivots.shape[1] if pivots is not None else -1))
        if len(some):
            dots = _matrix(vecs.take(pa.array(some))) @ pivots.T
            pivot[some] = dots.argmax(1)
            far[some] = np.sqrt(np.maximum(0, 2 - 2 * dots.max(1)))
        yield batch.append_column("pivot", pa.array(pivot)).append_column("far", pa.array(far))


def dealt(items: DataFrame, queries: DataFrame, lanes: int | None, held: int) -> DataFrame:
    """Rows of items (id, vec, part and more columns) and queries (id, vec, part), each task's
    queries before its items. ``asks`` is a group of queries, ``lane`` one of items."""
    n = lanes or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-queries.count() // held))

    def all_of(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    own = items.withColumns({"item": F.lit(True), "size": F.size("vec"), "lane": F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")}).withColumn("asks", all_of(groups))
    asked = queries.withColumns({"item": F.lit(False), "size": F.size("vec"), "asks": F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")}).withColumn("lane", all_of(n))
    order = [c for c in ("pivot", "far", "video_id") if c in own.columns]
    both = own.unionByName(asked, allowMissingColumns=True)
    return both.repartition(*KEYS).sortWithinPartitions(*KEYS, "item", *order, "id")


class TopK:
    """The best k items of each query so far."""

    columns = "query_id long, item_id long, score double, pairs long, skipped long"

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int, pivots: np.ndarray | None):
        self.ids, self.vecs, self.k = ids, vecs, k
        self.least = np.full(len(ids), -np.inf)  # the k-th score
        self.far = None
        if pivots is not None and pivots.shape[1] == vecs.shape[1]:
            self.far = np.sqrt(np.maximum(0, 2 - 2 * (vecs @ pivots.T)))
        self.best = (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))
        self.fresh: list[tuple] = []
        self.pairs = self.skipped = 0

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pivot, far = np.asarray(batch.column("pivot")), np.asarray(batch.column("far"))
        ids, vecs = np.asarray(batch.column("id")), _matrix(batch.column("vec"))
        edges = np.r_[0, np.flatnonzero(pivot[1:] != pivot[:-1]) + 1, len(pivot)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            for a in range(lo, hi, 1024):
                b = min(a + 1024, hi)
                self._stretch(ids[a:b], vecs[a:b], pivot[a], far[a], far[b - 1])
        yield from ()

    def _stretch(self, ids: np.ndarray, vecs: np.ndarray, pivot: int, low: float, high: float) -> None:
        alive = np.arange(len(self.ids))
        if pivot >= 0 and self.far is not None:
            own = self.far[:, pivot]
            gap = np.maximum(0, np.maximum(own - high, low - own) - CLOSE)
            alive = np.flatnonzero(1 - gap * gap / 2 >= self.least - CLOSE)
        self.pairs += len(self.ids) * len(ids)
        self.skipped += (len(self.ids) - len(alive)) * len(ids)
        if not len(alive):
            return
        scores = self.vecs[alive] @ vecs.T
        scores[self.ids[alive][:, None] == ids[None]] = -np.inf
        edge = self.least[alive]
        if len(ids) > self.k:
            edge = np.maximum(edge, np.partition(scores, -self.k, axis=1)[:, -self.k])
        q, i = np.nonzero((scores >= edge[:, None] - CLOSE) & (scores > -np.inf))
        q = alive[q]
        # one sum a pair, in the order of its components, whatever block the pair came in
        self.fresh.append((q, ids[i], np.einsum("ij,ij->i", self.vecs[q], vecs[i])))
        if sum(len(f[0]) for f in self.fresh) >= 4 * self.k * len(self.ids):
            self._settle()

    def _settle(self) -> None:
        q, i, s = (np.concatenate(x) for x in zip(self.best, *self.fresh))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.best, self.fresh = (q[keep], i[keep], s[keep]), []
        last = np.flatnonzero(place == self.k - 1)
        self.least[q[last]] = s[last]

    def finish(self) -> Iterator[pa.RecordBatch]:
        self._settle()
        q, i, s = self.best
        zero = np.zeros(len(q), "i8")
        yield pa.record_batch([pa.array(self.ids[q], pa.int64()), pa.array(i, pa.int64()), pa.array(s), pa.array(zero), pa.array(zero)], names=["query_id", "item_id", "score", "pairs", "skipped"])
        told = [pa.array([None], pa.int64())] * 2 + [pa.array([None], pa.float64()), pa.array([self.pairs]), pa.array([self.skipped])]
        yield pa.record_batch(told, names=["query_id", "item_id", "score", "pairs", "skipped"])


class VideoBest:
    """The best score of each query by video; items of a video come one after another."""

    columns = "query_id long, video_id long, best double"

    def __init__(self, ids: np.ndarray, vecs: np.ndarray):
        self.ids, self.vecs = ids, vecs

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            video, ids = np.asarray(part.column("video_id")), np.asarray(part.column("id"))
            scores = self.vecs @ _matrix(part.column("vec")).T
            scores[self.ids[:, None] == ids[None]] = -np.inf
            first = np.r_[0, np.flatnonzero(video[1:] != video[:-1]) + 1]
            best = np.maximum.reduceat(scores, first, axis=1)
            q, v = np.nonzero(best > -np.inf)
            yield pa.record_batch([pa.array(self.ids[q]), pa.array(video[first][v]), pa.array(best[q, v])], names=["query_id", "video_id", "best"])

    def finish(self) -> Iterator[pa.RecordBatch]:
        yield from ()


def _searched(batches: Iterator[pa.RecordBatch], make: Callable) -> Iterator[pa.RecordBatch]:
    """Hold the queries of each key, pass its items by them."""
    key = work = None
    held: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.select(KEYS).to_pydict()
        keys = list(zip(*names.values(), np.asarray(batch.column("item"), dtype=bool).tolist()))
        cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(lo, hi - lo)
            if keys[lo][:-1] != key:
                if work:
                    yield from work.finish()
                key, work, held = keys[lo][:-1], None, []
            if not keys[lo][-1]:
                held.append((np.asarray(part.column("id")), _matrix(part.column("vec"))))
            elif held:
                work = work or make(*(np.concatenate(x) for x in zip(*held)))
                yield from work.take(part)
    if work:
        yield from work.finish()


def top_hits(items: DataFrame, queries: DataFrame, k: int, lanes: int | None = None, held: int = HELD, seen: Observation | None = None) -> DataFrame:
    """``query_id, item_id, score``: the k best items of each query by cosine among those of
    its ``part``, of every lane, ties to the smaller id; a query's own id is left out.

    ``seen`` observes the number of ``pairs`` of items and queries, and how many of them were
    ``skipped`` by their distances from a pivot."""
    items = unit(items.select(F.col("item_id").cast("long").alias("id"), "vec", "part").filter("item_id is not null"))
    asked = unit(queries.select(F.col("query_id").cast("long").alias("id"), "vec", "part").filter("query_id is not null"))
    pivots = pivots_of(items)
    own = items.mapInArrow(lambda it: _around(it, pivots), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema) + ", pivot int, far double")
    rows = dealt(own, asked, lanes, held)
    found = rows.mapInArrow(lambda it: _searched(it, lambda ids, vecs: TopK(ids, vecs, k, pivots)), TopK.columns)
    if seen:
        found = found.observe(seen, F.sum("pairs").alias("pairs"), F.sum("skipped").alias("skipped"))
    return found.filter("query_id is not null").select("query_id", "item_id", "score")


def video_scores(items: DataFrame, queries: DataFrame, lanes: int | None = None, held: int = HELD) -> DataFrame:
    """``query_id, video_id, best``: each query's best cosine with an item of each video."""
    items = unit(items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("id"), "vec", F.col("video_id").cast("long").alias("video_id"), F.lit(0).alias("part")))
    asked = unit(queries.filter("query_id is not null").select(F.col("query_id").cast("long").alias("id"), "vec", F.lit(0).alias("part")))
    rows = dealt(items.filter("video_id is not null"), asked, lanes, held)
    return rows.mapInArrow(lambda it: _searched(it, VideoBest), VideoBest.columns).groupBy("query_id", "video_id").agg(F.max("best").alias("best"))
