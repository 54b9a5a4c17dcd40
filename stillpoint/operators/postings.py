"""Text search over postings, rarest term first.

A segment of an index holds the postings of its own items. A term of very many items is cut
into ``parts`` by a hash of the item, so that no task has a whole long list. Whoever knows
the item of a posting knows its part: only the rarest term of a query, which is where items
come from, asks for all parts of a list.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Postings of one part of a term.
PART = 1_000_000
#: Terms of a query that are looked up together: the rarest, the next few, the rest.
ROUNDS = [(1, 1), (2, 4), (5, None)]


@dataclass(frozen=True)
class Segment:
    """``postings`` (term, part, item_id, tf), ``frequencies`` (term, df, parts) and
    ``keys`` (key, term): the strings that terms leave with at most one character deleted."""

    postings: DataFrame
    frequencies: DataFrame
    keys: DataFrame


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def text_index(items: DataFrame) -> DataFrame:
    """Postings ``term, item_id, tf``."""
    words = items.select("item_id", F.explode(terms(F.col("text"))).alias("term"))
    return words.groupBy("term", "item_id").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, n_terms``: the distinct terms of each query and their number."""
    own = queries.select("query_id", F.array_distinct(terms(F.col("text"))).alias("ts"))
    return own.select("query_id", F.size("ts").alias("n_terms"), F.explode("ts").alias("term"))


def shortened(term: Column) -> Column:
    """The term and what is left of it with one character deleted."""
    cuts = F.transform(F.sequence(F.lit(1), F.length(term)), lambda i: F.concat(F.substring(term, F.lit(1), i - 1), F.substring(term, i + 1, F.length(term))))
    return F.array_distinct(F.concat(F.array(term), cuts))


def part_of(item: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(item), parts).cast("int")


def segment_of(postings: DataFrame, part: int = PART) -> Segment:
    """A segment that isn't stored: ``postings`` has term, item_id and tf."""
    frequencies = frequency_parts(postings, part)
    return Segment(cut_postings(postings, frequencies), frequencies, term_keys(frequencies))


def frequency_parts(postings: DataFrame, part: int = PART) -> DataFrame:
    """``term, df, parts`` of postings."""
    return document_frequency(postings).withColumn("parts", F.ceil(F.col("df") / part).cast("int"))


def cut_postings(postings: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``term, part, item_id, tf``: the lists of frequent terms, which are few, in parts."""
    cut = postings.join(frequencies.filter("parts > 1").select("term", "parts"), "term", "left")
    return cut.select("term", part_of(F.col("item_id"), F.coalesce("parts", F.lit(1))).alias("part"), "item_id", "tf")


def term_keys(frequencies: DataFrame) -> DataFrame:
    return frequencies.select(F.explode(shortened(F.col("term"))).alias("key"), "term")


def _exact(segment: Segment, asked: DataFrame) -> DataFrame:
    """Each term ``q`` of a query with itself."""
    return segment.frequencies.join(asked, "term").select("query_id", "n_terms", F.col("term").alias("q"), "term", F.lit(0).alias("d"), "df", "parts")


def _near(segment: Segment, asked: DataFrame) -> DataFrame:
    """Each term ``q`` of a query with the terms of a segment within edit distance 1: two
    such terms share one of their shortened forms, so no vocabulary is paired with all
    queries."""
    own = asked.select(F.col("term").alias("q")).distinct().select("q", F.explode(shortened(F.col("q"))).alias("key"))
    met = segment.keys.join(own, "key").select("q", "term").distinct().withColumn("d", F.levenshtein("q", "term")).filter(F.col("d") <= 1)
    found = segment.frequencies.join(met, "term").select("q", "term", "d", "df", "parts")
    return asked.withColumnRenamed("term", "q").join(found, "q").select("query_id", "n_terms", "q", "term", "d", "df", "parts")


def matches(segments: list[Segment], queries: DataFrame, distance: int) -> DataFrame:
    """``query_id, item_id, score`` of the items that hold, for every distinct term of a
    query, a term within ``distance`` (0 or 1); each counts its best tf / (1 + distance).

    The postings of a query's rarest term (the one whose terms within the distance have the
    fewest postings) are its first items. They meet the other terms' postings by term and
    item, in rounds, and those that miss one leave: a list of a frequent term is never
    paired with its queries."""
    asked = query_terms(queries)
    wanted = reduce(DataFrame.unionByName, [(_near if distance else _exact)(s, asked).withColumn("seg", F.lit(k)) for k, s in enumerate(segments)])
    sizes = wanted.groupBy("query_id", "q", "n_terms").agg(F.sum("df").alias("size"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("size", "q"))
    sizes = sizes.withColumns({"place": place, "found": F.count(F.lit(1)).over(Window.partitionBy("query_id"))}).filter("found = n_terms")
    wanted = wanted.join(sizes.select("query_id", "q", "place"), ["query_id", "q"])
    out = None
    for low, high in ROUNDS:
        now = wanted.filter(F.col("place").between(low, high) if high else F.col("place") >= low)
        if out is None:
            asks = now.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            met = [s.postings.join(asks.filter(F.col("seg") == k), ["term", "part"]) for k, s in enumerate(segments)]
        else:
            asks = out.select("query_id", "seg", "item_id", "score").join(now, ["query_id", "seg"]).withColumn("part", part_of(F.col("item_id"), F.col("parts")))
            met = [s.postings.join(asks.filter(F.col("seg") == k), ["term", "part", "item_id"]) for k, s in enumerate(segments)]
        columns = ["query_id", "seg", "item_id", "q", "n_terms", F.col("tf") / (1 + F.col("d"))]
        found = reduce(DataFrame.unionByName, [m.select(*columns[:-1], columns[-1].alias("s")) for m in met])
        best = found.groupBy("query_id", "seg", "item_id", "q", "n_terms").agg(F.max("s").alias("s"))
        hits = best.groupBy("query_id", "seg", "item_id", "n_terms").agg(F.sum("s").alias("score"), F.count(F.lit(1)).alias("n"))
        due = F.least(F.col("n_terms"), F.lit(high)) - (low - 1) if high else F.col("n_terms") - (low - 1)
        hits = hits.filter(F.col("n") == due).drop("n")
        if out is None:
            out = hits
        else:  # queries with fewer terms are done
            more = out.join(hits.select("query_id", "seg", "item_id", F.col("score").alias("more")), ["query_id", "seg", "item_id"], "left")
            more = more.filter((F.col("n_terms") < low) | F.col("more").isNotNull())
            out = more.withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0))).drop("more")
    return out.select("query_id", "item_id", "score")
