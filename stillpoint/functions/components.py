"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stillpoint.functions.tables import UNMARKED, discard, gathered, kept, new_path, scratch

#: Edges that a task contracts at a time. What is left of a graph is one task's work once it
#: has no more; larger graphs take rounds.
HELD = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to one for each node but the smallest that it is connected with, with that one."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    at, root = at.reshape(2, -1), np.arange(len(names))
    while True:
        low, last = np.minimum(root[at[0]], root[at[1]]), root.copy()
        for side in at:
            np.minimum.at(root, last[side], low)  # the roots of both ends, so that all that hangs on them follows
            np.minimum.at(root, side, low)
        root = root[root]
        if (root == last).all():
            break
    rest = root != np.arange(len(names))
    return names[rest], names[root[rest]]


def _contracted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A bounded number of a task's edges at a time becomes a forest of stars."""
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        a, b = forest(*(np.concatenate([np.asarray(x.column(c)) for x in held]) for c in ("a", "b")))
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= most:
            yield out()
            held = []
    if held:
        yield out()


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(``a``, ``b``) edges to (``node``, ``root``) rows, the root being the smallest node.

    A graph of at most ``HELD`` edges is contracted by one task, and that is all. Of a larger
    one each task first contracts its own edges. A round then hangs each node's larger
    neighbours, and then its smaller ones, on the smallest neighbour, until what is left is
    one task's work, or until all are stars, however many rounds that takes (about the
    logarithm of the longest path, less what tasks have contracted). The smallest neighbours
    tell whether all are stars, so the last round is one shuffle and no other only finds that
    nothing changes. No shuffle gathers a node's neighbours, and the result of a round is a
    table in the shared folder; the tables before it are deleted. Nodes without an edge to
    another node don't appear.

    Each table has a file for each task, so rounds over a small graph cost far more than the
    graph; with ``rows``, about the number of edges, these are ``gathered`` first.
    """
    spark, held = edges.sparkSession, HELD
    paths: list[str] = []

    def table(df: DataFrame, tag: str) -> DataFrame:
        paths.append(new_path(spark, tag))
        df.write.options(**UNMARKED).parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    def counted(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
        seen = Observation()
        return table(df.observe(seen, F.count(F.lit(1)).alias("n")), tag), seen.get["n"]

    def contracted(df: DataFrame) -> DataFrame:
        return df.mapInArrow(lambda it: _contracted(it, held), "a long, b long")  # a > b

    with scratch(spark):
        try:
            edges = edges.filter("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
            now, n = counted(edges if rows is None else gathered(edges, rows), "edges")
            while True:
                if n > held:
                    now, n = counted(contracted(now), "forest")
                if n <= held:
                    low = table(contracted(now.coalesce(1)).select(F.col("a").alias("node"), F.col("b").alias("root")), "low")
                    return kept(low, "components")
                seen = Observation()
                ends = now.select(F.col("a").alias("node"), "b", F.lit(False).alias("hub")).unionByName(now.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("b"), F.lit(True).alias("hub")))
                ends = ends.groupBy("node").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max("hub").alias("hub")).filter("low is not null")
                low = table(ends.observe(seen, F.count_if(F.expr("low <> high or hub")).alias("open")).select("node", F.col("low").alias("root")), "low")
                if not seen.get["open"]:
                    return kept(low, "components")
                # an edge's larger end goes to the smallest neighbour of the smaller end, itself included
                large = now.join(low.withColumnRenamed("node", "b"), "b", "left").select("a", F.coalesce("root", "b").alias("b"))
                # smaller neighbours of each node, and the node, go to the smallest of them
                least = large.groupBy("a").agg(F.min("b").alias("m"))
                small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
                now, n = counted(small.filter("a <> b").distinct(), "edges")
                while len(paths) > 1:
                    discard(spark, paths.pop(0))
        finally:
            for path in paths:
                discard(spark, path)
