"""A text index in tables: built once, added to without a rebuild, searched without a
shuffle of its postings.

A store is a folder of segments. A segment has three tables, bucketed and sorted: postings
by term and part, document frequencies by term, shortened terms by key. A small file names
the segments that count; it is replaced in one rename after a new segment is whole, so
readers see a store before or after a change, and a writer that dies leaves the store as it
was. Many small segments are merged into one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillpoint.functions.tables import discard, point, pointed
from stillpoint.operators.postings import PART, Segment, cut_postings, frequency_parts, term_keys, text_index

#: Segments beyond which they are merged.
MOST_SEGMENTS = 8
TABLES = {
    "postings": ("term string, part int, item_id long, tf long", ["term", "part"], ["term", "part", "item_id"]),
    "frequencies": ("term string, df long, parts int", ["term"], ["term"]),
    "keys": ("key string, term string", ["key"], ["key"]),
    "items": ("item_id long", ["item_id"], ["item_id"]),
}


@contextmanager
def co_located(spark: SparkSession) -> Iterator[None]:
    """Joins inside may use a table's buckets by some of the join's keys: a posting is met by
    term, part and item where it lies by term and part."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class TextStore:
    """The store at ``path``; ``buckets`` is fixed when it is created."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        state = pointed(spark, f"{self.path}/CURRENT")
        if state is None:
            raise FileNotFoundError(f"no text index at {path}")
        found = json.loads(state)
        self.buckets, self.names = found["buckets"], found["segments"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, items: DataFrame, buckets: int | None = None) -> TextStore:
        """Index ``items`` (item_id, text); rows of one item count together."""
        if pointed(spark, f"{path.rstrip('/')}/CURRENT") is not None:
            raise FileExistsError(f"there is a text index at {path}")
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        point(spark, f"{path.rstrip('/')}/CURRENT", json.dumps({"buckets": buckets, "segments": []}))
        store = cls(spark, path)
        store.add(items)
        return store

    def _table(self, segment: str, kind: str) -> str:
        """The table's name in this session, which learns of it here."""
        schema, by, order = TABLES[kind]
        name = f"{segment}_{kind}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({', '.join(by)}) SORTED BY ({', '.join(order)}) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{segment}/{kind}'"
        )
        return name

    def _write(self, segment: str, kind: str, rows: DataFrame) -> None:
        schema, by, order = TABLES[kind]
        names = [c.split()[0] for c in schema.split(", ")]
        rows = rows.select(*names).repartition(self.buckets, *by)
        rows.write.format("parquet").bucketBy(self.buckets, *by).sortBy(*order).option("path", f"{self.path}/{segment}/{kind}").saveAsTable(f"{segment}_{kind}")

    def _commit(self, names: list[str]) -> None:
        point(self.spark, f"{self.path}/CURRENT", json.dumps({"buckets": self.buckets, "segments": names}))
        self.names = names

    def table(self, segment: str, kind: str) -> DataFrame:
        return self.spark.table(self._table(segment, kind))

    def segments(self) -> list[Segment]:
        return [Segment(*[self.table(name, kind) for kind in ("postings", "frequencies", "keys")]) for name in self.names]

    def postings(self) -> DataFrame:
        """``term, item_id, tf`` of all segments."""
        empty = self.spark.createDataFrame([], "term string, item_id long, tf long")
        return reduce(DataFrame.unionByName, [s.postings.select("term", "item_id", "tf") for s in self.segments()], empty)

    def frequencies(self) -> DataFrame:
        """``term, df``: the sum over the segments, as no item is in two."""
        empty = self.spark.createDataFrame([], "term string, df long")
        rows = reduce(DataFrame.unionByName, [s.frequencies.select("term", "df") for s in self.segments()], empty)
        return rows.groupBy("term").agg(F.sum("df").alias("df"))

    def _segment(self, postings: DataFrame, items: DataFrame, part: int) -> str:
        name = f"text_{uuid.uuid4().hex}"
        try:
            self._write(name, "items", items)
            flat = f"{self.path}/{name}/flat"
            postings.write.parquet(flat)
            made = self.spark.read.schema("term string, item_id long, tf long").parquet(flat)
            self._write(name, "frequencies", frequency_parts(made, part))
            known = self.table(name, "frequencies")
            self._write(name, "keys", term_keys(known))
            self._write(name, "postings", cut_postings(made, known))
            discard(self.spark, flat)
        except BaseException:
            self._forget(name)
            raise
        return name

    def add(self, items: DataFrame, part: int = PART) -> None:
        """Add items that the store doesn't have; one that it has is an error. Null ids and
        items without a term have no postings."""
        items = items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
        ids = items.select("item_id").distinct()
        for name in self.names:
            again = self.table(name, "items").join(ids, "item_id").limit(3).collect()
            if again:
                raise ValueError(f"indexed already: {', '.join(str(r['item_id']) for r in again)}")
        names = [*self.names, self._segment(text_index(items), ids, part)]
        self._commit(names)
        if len(names) > MOST_SEGMENTS:
            self.merge(part)

    def merge(self, part: int = PART) -> None:
        """One segment of all."""
        old = self.names
        ids = reduce(DataFrame.unionByName, [self.table(name, "items") for name in old])
        self._commit([self._segment(self.postings(), ids, part)])
        for name in old:
            self._forget(name)

    def _forget(self, name: str) -> None:
        for kind in TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}_{kind}")
        discard(self.spark, f"{self.path}/{name}")

    def drop(self) -> None:
        for name in self.names:
            self._forget(name)
        discard(self.spark, self.path)
