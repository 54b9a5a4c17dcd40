"""Corpus pipeline: toxicity filter, line dedup, near-duplicate removal, removal of repeated
passages, packing. Each stage works on all that its predecessor kept, and its result is a
table in the shared folder.

In every stage a null text counts as empty, rows that share or lack an id are rows of their
own, and an empty table gives an empty one. The filters return the columns that they were
given, whatever their names; a stage that changes texts sets ``n_chars``, where there is one.
A document that a stage empties stays, as an empty text, and is packed as its end token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stillpoint.functions.tables import kept, scratch
from stillpoint.llm import jaccard, line_dedup, packing, suffix_dedup, toxicity
from stillpoint.llm.common import bounded_batches, order_id

#: Row numbers begin here, far from ids.
FAR = 1 << 62
#: About the largest Arrow batch, however long the rows are; one row may be longer.
BATCH_MB = 2


def _documents(docs: DataFrame, rows: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` from ``row``, with a new text and its length."""
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(text.alias(c))
        elif c == "n_chars":
            columns.append(F.length(text).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("row")[c].alias(c))
    return rows.select(*columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go; it learns from the labelled rows of
    the tables in ``sf_dir``. Rows of equal text go or stay together, whatever their id; an
    empty text is judged, too. Without labels of both kinds all share one score."""
    bounded_batches(spark, megabytes=BATCH_MB)
    source, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(source, labels))


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id has go; every document stays. Rows that share
    an id lose nothing to each other; a null id counts as the largest."""
    bounded_batches(spark, megabytes=BATCH_MB)
    return _documents(docs, line_dedup.dedup_lines(docs), F.col("kept"))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays, of several
    rows with that id one.

    Documents are compared by the texts that they came with, as the later of two near copies
    has lost the lines that they share; those that stay are then compared by the texts that
    they have here. An id that several rows share, or none, doesn't tell which text a row
    came with: such rows are compared by what is left of them. Texts without words are no
    duplicates."""
    bounded_batches(spark, megabytes=BATCH_MB)
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own_id = F.col("doc_id").cast("long")

    def near(column: str) -> Column:
        return F.col(column).cast("long").between(-FAR, FAR - 1)

    single = [df.groupBy(own_id.alias("rid")).count().filter(F.col("count") == 1).filter(near("rid")).select("rid") for df in (docs, source)]
    ids = kept(single[0].join(single[1], "rid"), "ids")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    odd = docs.select(own_id.alias("odd")).distinct()
    odd = kept(odd.join(ids, F.col("odd") == ids["rid"], "left_anti"), "odd")  # mostly few: the texts needn't be shuffled
    others = docs.select(row, own_id.alias("_id")).join(odd, F.col("_id").eqNullSafe(F.col("odd")), "left_semi")
    others = kept(others.select("row", order_id("_id").alias("did"), (F.monotonically_increasing_id() + FAR).alias("rid")), "others")
    rest = others.select("did", "rid", F.col("row.text").cast("string").alias("txt"))
    stay = ids.unionByName(others.select("rid"))
    for df in (source, docs):
        # rows that go by their id have that as their number, so no table of whole rows is written for the search
        texts = df.filter(near("doc_id")).select(order_id("doc_id").alias("did"), own_id.alias("rid"), F.col("text").cast("string").alias("txt"))
        stay = stay.join(jaccard.later_rows(texts.unionByName(rest), stay), "rid", "left_anti")
    # the join of whole rows is shuffled at any size, so that a small table tells what a large one takes
    whole = docs.select(row, own_id.alias("_id")).filter(near("_id"))
    whole = whole.join(stay.select(F.col("rid").alias("_id")).hint("merge"), "_id", "left_semi").select("row")
    return whole.unionByName(others.join(stay, "rid", "left_semi").select("row")).select("row.*")


def repeat_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that start in a document with a smaller id go; every
    document stays. Rows that share an id lose nothing to each other; a null id counts as
    the largest. A character of which a byte goes is gone."""
    bounded_batches(spark, megabytes=BATCH_MB)
    return _documents(docs, suffix_dedup.remove_repeats(docs, as_text=True), F.col("kept"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row for each piece of a document, with the
    columns of ``op10`` and none of ``docs`` but the id (a null one as 2^63 - 1)."""
    bounded_batches(spark, megabytes=BATCH_MB)
    return packing.pack_documents(docs, packing.byte_vocabulary()).withColumnRenamed("did", "doc_id")


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_filter),
    ("ngram_jaccard_join", near_duplicate_filter),
    ("suffix_array_dedup", repeat_filter),
    ("best_fit_packing", pack),
]

#: A trained network and BPE ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote on its way is deleted once its
    result is a table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):
        for name, stage in STAGES:
            with scratch(spark):
                docs = kept(stage(spark, docs, sf_dir), name)
        return kept(docs, "packed")
