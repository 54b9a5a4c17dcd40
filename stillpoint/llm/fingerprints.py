"""Document fingerprints by winnowing, in DataFrame functions only.

A text is read as units of up to eight code points: a lower-cased run without white space
is cut into eights from its start, and a character of a script that is written without
spaces is a unit of its own. So words begin new units, and a long text without spaces has
many.

Units are hashed once. Hashes of spans of 2, 4, ... units are rolled up from two halves,
and that of a k-gram from two spans that cover it, so a k-gram costs the logarithm of k.
Of every window of w k-grams the smallest hash is chosen, the rightmost on ties, with its
position. Two texts that share w + k - 1 units in a row (``shared_units``) share a chosen
k-gram.

A chosen k-gram is one long: its hash above, the complement of its position below, so
that the least long of a window is the least hash at its rightmost place. Nothing is
exploded: every step maps the arrays of one row.

The next document in descending id comes from a window over ranges of ids, cut by bytes
of text. The borders of the ranges are ids of the table, and a row at
a border is also a guest of the range above, so the text is shuffled once and no range
needs another. A document's own k-grams are chosen after that shuffle and before the
window, once for itself and for the document that it follows.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stillpoint.llm.common import order_id

#: Bits of a chosen k-gram that hold the position (as complement); the rest holds the hash.
PLACE_BITS = 26
PLACES = (1 << PLACE_BITS) - 1
#: Scripts written without spaces, as names of the pattern language.
UNSPACED = "".join(rf"\p{{Is{name}}}" for name in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
UNIT = rf"[{UNSPACED}]|[^\s{UNSPACED}]{{1,8}}"
#: Ranges for each task: ranges are dealt to tasks by hash, and several even that out.
SHARE = 8
#: Borders of ranges are taken at this many times as many quantiles as there are ranges.
FINE = 2
#: With more tasks than this the borders would be a large literal; ranges are longer instead.
MOST_TASKS = 20_000


def shared_units(k: int, w: int) -> int:
    """Units in a row that two texts must share to be sure of a common chosen k-gram."""
    return w + k - 1


def units(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(UNIT), 0)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(values: Column, length: int, both) -> Column:
    """For each place what ``both`` makes of the ``length`` values from it, by doubling.
    Places near the end, where a span would reach over it, are to be cut off."""

    def longer(values: Column, far: int) -> Column:
        return _let(values, lambda v: F.transform(v, lambda x, i: both(x, F.get(v, i + far))))

    size, out = 1, values
    while size < length:
        step = min(size, length - size)
        size, out = size + step, longer(out, step)
    return out


def chosen_grams(text: Column, k: int, w: int) -> Column:
    """Chosen k-grams of a text, in order, each once. Texts under k units are one gram."""
    hashes = F.transform(units(text), lambda x: F.xxhash64(x))

    def grams(h: Column) -> Column:
        rolled = _spans(h, k, lambda a, b: F.xxhash64(a, b))
        whole = F.slice(rolled, 1, F.greatest(F.size(h) - (k - 1), F.lit(1)))
        some = F.when(F.size(h) > 0, whole).otherwise(F.array(F.xxhash64(F.lit(""))))
        return F.transform(some, lambda x, i: x.bitwiseAND(F.lit(~PLACES)).bitwiseOR(F.lit(PLACES) - i.cast("long") % PLACES))

    def least(g: Column) -> Column:
        return F.slice(_spans(g, w, lambda a, b: F.least(a, b)), 1, F.greatest(F.size(g) - (w - 1), F.lit(1)))

    return F.array_distinct(_let(_let(hashes, grams), least))


def fingerprint(grams: Column) -> Column:
    """``position:hash`` of each chosen k-gram, in hexadecimal."""
    return F.array_join(F.transform(grams, lambda g: F.concat(F.lower(F.hex(F.lit(PLACES) - g.bitwiseAND(F.lit(PLACES)))), F.lit(":"), F.lower(F.hex(F.shiftrightunsigned(g, PLACE_BITS))))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of chosen hashes."""
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))


def hash_set(grams: Column) -> Column:
    return F.array_distinct(F.transform(grams, lambda g: F.shiftrightunsigned(g, PLACE_BITS)))


def winnow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, w: int = 6) -> DataFrame:
    """Fingerprint of every whole text: ``did``, ``n_chars``, ``grams`` (array of longs, see
    the module) and ``fingerprint``.

    A null text counts as empty. A text of under ``k`` units has one gram, the hash of what
    units it has; an empty one has the gram of nothing. Equal texts have equal fingerprints.
    Repeated rows have each their own result; a null id counts as the largest; an empty
    table gives an empty result. Other columns are not read. Positions are numbers of units
    and wrap after 2^26.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(order_id(id_col).alias("did"), text.alias("txt")).withColumn("grams", chosen_grams(F.col("txt"), k, w))
    return out.select("did", F.length("txt").cast("long").alias("n_chars"), "grams", fingerprint(F.col("grams")).alias("fingerprint"))


def range_borders(rows: DataFrame, part_bytes: int, parts: int | None = None) -> list[tuple[int, int]]:
    """Ascending rows of the table, as (``did``, ``th``), that cut it into ranges of even
    shares of ``txt``, the largest last: ``parts`` of them, or so many that a task's share
    of ranges has about ``part_bytes``, or less if tasks would be fewer than the session's
    partitions. An id that many rows share is cut by the hashes of their texts."""
    total, top = rows.agg(F.sum(F.octet_length("txt")), F.max(F.struct("did", "th"))).first()
    if top is None:
        return [(0, 0)]
    top = tuple(top)
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or SHARE * min(max(least, math.ceil(total / part_bytes)), max(least, MOST_TASKS))
    if parts == 1:
        return [top]
    quantiles = rows.agg(F.percentile_approx("did", [i / (FINE * parts) for i in range(1, FINE * parts)], 10 * FINE * parts)).first()[0]
    low, high = -(1 << 63), (1 << 63) - 1
    fine = {(high, high)}
    for edge, often in Counter(quantiles).items():
        if often == 1:
            fine.add((edge, high))
        else:  # the id has several shares of the rows: cells of its hashes
            fine |= {(edge - 1, high)} | {(edge, low + (j << 64) // often - 1) for j in range(1, often + 1)}
    fine = sorted(fine)
    # bytes and largest row of each cell, then a border whenever a share is full
    cells = rows.groupBy(_below(fine).alias("part")).agg(F.sum(F.octet_length("txt")).alias("n"), F.max(F.struct("did", "th")).alias("last"))
    borders, held = [], 0
    for cell in sorted(cells.collect()):  # at most 2 * FINE * parts rows
        held += cell["n"]
        if held >= total / parts or tuple(cell["last"]) == top:
            borders.append(tuple(cell["last"]))
            held = 0
    return borders


def _array(values: list[int]) -> Column:
    """One literal, however many values."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _below(edges: list[tuple[int, int]]) -> Column:
    """How many of the ascending edges lie below (``did``, ``th``), by bisection."""
    steps = [1 << i for i in range(len(edges).bit_length() - 1, -1, -1)]
    dids, hashes = (_array(list(x)) for x in zip(*edges))

    def move(at: Column, step: Column) -> Column:
        did, th = F.get(dids, at + step - 1), F.get(hashes, at + step - 1)
        return F.when((did < F.col("did")) | ((did == F.col("did")) & (th < F.col("th"))), at + step).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), move)


def with_next(rows: DataFrame, edges: list[tuple[int, int]], added: dict[str, Column]) -> DataFrame:
    """``rows`` (``did``, ``th``, ``txt``) with the columns ``added`` and, as ``next``, the
    struct of all but the id of the row that follows in descending (``did``, ``th``); after
    the last comes the first."""
    placed = rows.withColumn("part", _below(edges))
    dids, hashes = (_array(list(x)) for x in zip(*edges))
    at_border = (F.get(dids, F.col("part")) == F.col("did")) & (F.get(hashes, F.col("part")) == F.col("th"))
    guest_of = (F.col("part") + 1) % len(edges)
    here = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")))
    both = F.concat(here, F.array(F.struct(guest_of.alias("part"), F.lit(True).alias("guest"))))
    dealt = placed.select("did", "th", "txt", F.inline(F.when(at_border, both).otherwise(here)).alias("part", "guest"))
    dealt = dealt.repartition(max(1, math.ceil(len(edges) / SHARE)), "part").select("*", *[c.alias(name) for name, c in added.items()])
    # guests come from the range below; in range 0 the guest is the first row of all
    order = Window.partitionBy("part").orderBy("guest", F.desc("did"), F.desc("th"))
    out = dealt.withColumn("next", F.lead(F.struct("txt", *added)).over(order))
    return out.filter(~F.col("guest")).drop("part", "guest", "th")


def fingerprint_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, w: int = 6, part_bytes: int = 32 << 20, parts: int | None = None
) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness.

    The edited text is the text whose last floor(n_chars / 2) code points are replaced by
    the first as many (or all) of the next document in descending id; after the last comes
    the first, so a single document is its own next. Rows that repeat an id follow each
    other by descending hash of the text, by which a frequent id is many ranges. Nulls, empty texts and tables as for ``winnow``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(order_id(id_col).alias("did"), text.alias("txt")).select("did", F.xxhash64("txt").alias("th"), "txt")
    rows = with_next(rows, range_borders(rows, part_bytes, parts), {"own": chosen_grams(F.col("txt"), k, w)})
    n, half = F.length("txt"), F.floor(F.length("txt") / 2).cast("int")
    edited = F.concat(F.substring(F.col("txt"), F.lit(1), n - half), F.substring(F.col("next.txt"), F.lit(1), half))
    rows = rows.select("did", "own", F.col("next.own").alias("following"), n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.select("did", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "following", chosen_grams(F.col("edited"), k, w).alias("other"))
    own = hash_set(F.col("own"))
    return rows.select(
        "did", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(own, hash_set(F.col("other"))).alias("near_edited"), likeness(own, hash_set(F.col("following"))).alias("near_next"),
    )


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("did", "doc_id")
