"""Line dedup over levelled sorted runs of line hashes.

Documents are taken in batches of ascending id. The keys that earlier batches have
seen live in sorted runs: tables bucketed and sorted by hash. Each new batch
merge-anti-joins its keys with every run (the batch is shuffled once, the runs never),
writes the keys that are left as a run of level 0, and once a level holds ``fanout``
runs they are compacted into one run of the next level. A line goes if its key was in
a run, or if a document with a smaller id in the same batch has it.

Runs and joins carry 128-bit hashes, never lines. One very common line is one key in
the runs (pre-aggregated on the map side); on the side of the documents it is a skewed
join key that adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stillpoint.llm.common import discard, new_path, packed_rows, returning

HASH = ["h1", "h2"]
#: A row: its id and a hash of its text, so that rows which share an id, or lack one, don't
#: gather each other's lines. Ids alone are compared; a clash of hashes only joins two lists.
ROW = ["did", "th"]


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    return line.strip(b" \t\n\v\f\r").lower()


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the key; None if it has under ``min_chars`` code points."""
    key = line_key(line)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _hash_lines(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, found = [], []
        for text in batch.column("txt").to_pylist():
            own = {h for line in text.encode().split(b"\n") if (h := line_hash(line, min_chars)) is not None}
            counts.append(len(own))
            found.extend(own)
        both = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
        ids = [pa.array(np.repeat(np.asarray(batch.column(c)), counts)) for c in ROW]
        yield pa.record_batch([*ids, pa.array(both[:, 0]), pa.array(both[:, 1])], names=[*ROW, *HASH])


def _keep_lines(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, drops = batch.column("txt").to_pylist(), batch.column("drops")
        hashes = np.stack([np.asarray(drops.values.field(h)) for h in HASH], axis=1).astype("<i8").tobytes()
        at = 16 * np.asarray(drops.offsets)
        kept, n_lines, n_dropped, sha = [], [], [], []
        for text, begin, end in zip(texts, at[:-1], at[1:]):
            lines = text.encode().split(b"\n")
            n_lines.append(len(lines))
            if end > begin:
                gone = {hashes[i : i + 16] for i in range(begin, end, 16)}
                lines = [x for x in lines if line_hash(x, min_chars) not in gone]
            n_dropped.append(n_lines[-1] - len(lines))
            out = b"\n".join(lines)
            sha.append(hashlib.sha256(out).hexdigest())
            kept.append(out.decode())
        yield pa.record_batch(
            [batch.column("row"), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())],
            names=["row", "kept", "n_lines", "n_dropped", "kept_sha256"],
        )


class SortedRuns:
    """Levelled sorted runs of line hashes in the shared folder."""

    def __init__(self, spark, fanout: int, buckets: int):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets
        self.root = new_path(spark, "line-runs")
        self.levels: list[list[str]] = []

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            keys.select(*HASH).repartition(self.buckets, *HASH).sortWithinPartitions(*HASH)
            .write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.root}/{name}").saveAsTable(name)
        )
        return name

    def unseen(self, keys: DataFrame) -> DataFrame:
        for name in [n for level in self.levels for n in level]:
            keys = keys.join(self.spark.table(name).hint("merge"), HASH, "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """A new run of level 0; full levels are compacted upwards."""
        new, level = self._write(keys), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                return
            old, self.levels[level] = self.levels[level], []
            both = self.spark.table(old[0])
            for name in old[1:]:
                both = both.unionByName(self.spark.table(name))
            new = self._write(both)
            for name in old:
                self._drop(name)
            level += 1

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        for name in [n for level in self.levels for n in level]:
            self._drop(name)
        discard(self.spark, self.root)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """Drop every line whose key also occurs in a document with a smaller id.

    Returns ``row`` (a struct of every input column), ``kept`` (the remaining lines),
    ``n_lines``, ``n_dropped`` and ``kept_sha256``, one row for each input row.

    A null or empty text is one empty line and keeps it. Keys under ``min_chars`` code
    points are never dropped. Rows that repeat an id count as one document: none of
    them loses a line to another. A null id counts as the largest id. An empty table
    gives an empty result. Columns of the input with any name stay inside ``row``.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = packed_rows(docs, id_col, text_col).withColumn("th", F.hash("txt"))
    edges = rows.agg(F.percentile_approx("did", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    edges = sorted(set(edges or []))
    number = sum((F.when(F.col("did") > e, 1).otherwise(0) for e in edges), F.lit(0))
    lines_path, drops_path = new_path(spark, "lines"), new_path(spark, "line-drops")
    (
        rows.select(*ROW, "txt").mapInArrow(lambda it: returning(_hash_lines(it, min_chars)), "did long, th int, h1 long, h2 long")
        .withColumn("batch", number).write.partitionBy("batch").parquet(lines_path)
    )
    lines = spark.read.schema("did long, th int, h1 long, h2 long, batch int").parquet(lines_path)
    runs = SortedRuns(spark, fanout, buckets)
    try:
        for b in range(len(edges) + 1):
            own = lines.filter(F.col("batch") == b).select(*ROW, *HASH)
            keys = own.groupBy(*HASH).agg(F.min("did").alias("first"))
            fresh_path = f"{runs.root}/fresh-{b}"
            runs.unseen(keys).write.parquet(fresh_path)
            fresh = spark.read.schema("h1 long, h2 long, first long").parquet(fresh_path)
            (
                own.join(fresh, HASH, "left").filter(F.col("first").isNull() | (F.col("first") < F.col("did")))
                .select(*ROW, *HASH).write.mode("append").parquet(drops_path)
            )
            if b < len(edges):
                runs.add(fresh)
            discard(spark, fresh_path)
    finally:  # a failing batch leaves no tables either
        runs.close()
        discard(spark, lines_path)
    drops = spark.read.schema("did long, th int, h1 long, h2 long").parquet(drops_path)
    # equal rows have equal lines: what they lose is listed once
    drops = drops.groupBy(*ROW).agg(F.collect_set(F.struct(*HASH)).alias("drops"))
    joined = rows.join(drops, ROW, "left").select("row", "txt", "drops")
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("kept string, n_lines long, n_dropped long, kept_sha256 string").fields])
    return joined.mapInArrow(lambda it: returning(_keep_lines(it, min_chars)), schema)


ORACLE = {
    "op8_line_dedup": r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT *, min(doc_id) OVER (PARTITION BY key) AS first FROM k
), m AS (
  SELECT *, length(key) >= 10 AND first < doc_id AS gone FROM f
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
}


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")
