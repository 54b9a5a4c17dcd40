"""N-gram Jaccard join over a MinHash LSH forest.

A document is its set of word 5-grams. Equal sets are one class, pre-aggregated by hash.
Each class has a signature: for each of ``trees`` tries a label of ``deepest`` MinHash
symbols. The labels of a trie are kept as a sorted sequence (range-partitioned and sorted
by Spark), so a node of the trie, the classes that share a prefix, is a stretch of it, and
the longest prefix that a class shares with any other one is read off its two neighbours.
Only classes whose prefix is long enough to matter go on.

Matched prefixes are shortened level by level. At the full depth all classes that share a
node meet. A class rests once the recall that its own links imply reaches the target: a
link of similarity s has met by depth d with a known chance, so the links found so far
tell how many are still to be expected; a class without links counts as having a partner
at the threshold. Classes that don't rest meet all others, resting or not, by shorter
prefixes, until none is left. If a link found late lowers the estimate of a class at rest,
that class goes on, too. The estimate rests on links that were found: between two classes
that both rest on much closer copies, a link at the threshold has been looked for by whole
labels alone (``least_recall``).

Who meets below the full depth is screened by the agreement of whole signatures, so that
chains of unlike documents don't grow into one group. Groups of what met are verified
exactly, every pair of them on the whole sets, by pairs of bounded blocks, so neither a
large group nor a frequent prefix is one task and pairs never become rows: a task returns
one row a class with the weight of its links and a spanning tree of them. Where classes
are asked for, but no counts, large groups are settled through pivots instead.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillpoint.functions.components import connected_components
from stillpoint.functions.links import LINKS, blocked, spanned, verified
from stillpoint.functions.tables import gathered, kept, scratch, together
from stillpoint.llm.common import order_id, returning, staged
from stillpoint.llm.wordgrams import WORDS

PRIME = np.uint64(0x100000001B3)
MIX = np.uint64(0xD6E8FEB86659FD93)
REMEMBERED = 150_000
#: Bytes of a symbol of a label. Two values look alike by chance once in 65,536 times.
SYMBOL = 2
#: Sets of a block where classes alone are asked for: pivots keep the shuffle small anyway.
CLASS_BLOCK = 256
#: Nodes of more classes than this are screened row by row.
FEW = 16


class WordHashes(dict):
    """64-bit hash by word, remembered within a bound."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h
        return h


_HASHES = WordHashes()


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams; a text of fewer words, but at
    least one, is one gram."""
    words = WORDS.findall(text.lower())
    if not words:
        return np.empty(0, "u8")
    h = np.array([_HASHES[w] for w in words], "u8")
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), "u8")
    for j in range(min(width, len(h))):
        out = out * PRIME + h[j : j + n]
        out ^= out >> np.uint64(29)
        out *= MIX
    return np.unique(out ^ (out >> np.uint64(32)))


def meeting_chance(similarity, depth: int, trees: int):
    """The chance that a pair shares a prefix of ``depth`` symbols in one of the tries."""
    return 1 - (1 - similarity**depth) ** trees


def least_recall(threshold: float, trees: int, deepest: int) -> float:
    """The chance to find a link at the threshold between two classes that other, much
    closer links have put to rest: they share a whole label of one of the tries. 0.973 for
    the defaults, 0.999 at a similarity of 0.85; a class is missed only if all of its
    links with the rest of its group are."""
    return float(meeting_chance(threshold, deepest, trees))


def prefix_lengths(threshold: float, trees: int, deepest: int, recall: float, step: int = 2) -> list[int]:
    """Levels of the search: from the full depth in steps to the longest prefix by which a
    pair at the threshold, the hardest there is, meets with the target recall."""
    for floor in range(deepest, 0, -1):
        if meeting_chance(threshold, floor, trees) >= recall:
            return sorted({floor, *range(deepest, floor, -step)}, reverse=True)
    raise ValueError("the target recall needs more trees")


def signature(grams: np.ndarray, factors: np.ndarray) -> bytes:
    """One symbol for each factor: the least product with a gram, mixed. As bytes, symbols
    sort by value."""
    least = np.full(len(factors), np.iinfo("u8").max, "u8")
    for lo in range(0, len(grams), 2048):
        np.minimum(least, (factors[:, None] * grams[lo : lo + 2048]).min(1), out=least)
    mixed = (least ^ (least >> np.uint64(29))) * MIX
    return (mixed >> np.uint64(64 - 8 * SYMBOL)).astype(">u2").tobytes()


def symbols(signatures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), ">u2").reshape(len(signatures), -1)


def _sketch(batches: Iterator[pa.RecordBatch], width: int, values: int) -> Iterator[pa.RecordBatch]:
    factors = np.random.default_rng(17).integers(1, 1 << 63, values, dtype="u8") * np.uint64(2) + np.uint64(1)
    for batch in batches:
        n, hashes, signs = [], [], []
        for text in batch.column("txt").to_pylist():
            grams = shingles(text or "", width)
            hashes.append(xxhash.xxh3_128_digest(grams.tobytes()))
            n.append(len(grams))
            signs.append(signature(grams, factors) if len(grams) else b"")
        h1, h2 = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2).T
        columns = [batch.column("did"), batch.column("rid"), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), pa.array(signs, pa.binary())]
        yield pa.record_batch(columns, names=["did", "rid", "n", "h1", "h2", "sign"])


def _matched(batches: Iterator[pa.RecordBatch], floor: int, deepest: int) -> Iterator[pa.RecordBatch]:
    """Rows of a trie in order: those that share ``floor`` symbols or more with a neighbour,
    and how many. The first and last row of a task may share all with a row of another
    task and stay."""
    held, before = None, deepest
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        own, tree = symbols(rows.column("label")), np.asarray(rows.column("tree"))
        alike = (own[1:] == own[:-1]) & (tree[1:] == tree[:-1])[:, None]
        shared = np.cumprod(alike, axis=1).sum(1)
        longest = np.maximum(np.r_[before, shared[:-1]], shared) if len(shared) else shared
        some = np.flatnonzero(longest >= floor)
        yield rows.take(pa.array(some)).append_column("matched", pa.array(longest[some], pa.int32()))
        held, before = rows.slice(rows.num_rows - 1), int(shared[-1]) if len(shared) else before
    if held is not None:
        yield held.append_column("matched", pa.array([deepest], pa.int32()))


def _agreeing(rows: pa.RecordBatch, new: np.ndarray, least: float) -> pa.RecordBatch:
    """Whole nodes (a node begins where ``new``): which groups have classes that agree on
    ``least`` of their signatures, as a spanning forest of groups."""
    grp, active, own, i, j = (np.asarray(rows.column(c)) for c in ("grp", "active", "own", "i", "j"))
    signs, run = symbols(rows.column("sign")), np.cumsum(new) - 1
    start, size = np.flatnonzero(new), np.bincount(run)
    across, few = i != j, size[run] <= FEW
    met = []

    def screen(a: np.ndarray, b: np.ndarray) -> None:
        open_pairs = (grp[a] != grp[b]) & (active[a] | active[b]) & (~across[a] | (own[a] != own[b]))
        a, b = a[open_pairs], b[open_pairs]
        for lo in range(0, len(a), 4096):
            x, y = a[lo : lo + 4096], b[lo : lo + 4096]
            good = (signs[x] == signs[y]).mean(1) >= least
            met.append((grp[x[good]], grp[y[good]]))

    for gap in range(1, FEW):
        a = np.flatnonzero(few[:-gap] & (run[gap:] == run[:-gap]))
        if not len(a):
            break
        screen(a, a + gap)
    for lo, n in zip(start[size > FEW], size[size > FEW]):
        for a in range(lo, lo + n - 1):
            screen(np.full(lo + n - 1 - a, a), np.arange(a + 1, lo + n))
    a, b = (np.concatenate(x) for x in zip(*met)) if met else (np.empty(0, "i8"),) * 2
    names, at = np.unique(np.r_[a, b], return_inverse=True)
    at, root = at.reshape(2, -1), np.arange(len(names))
    while True:  # the smallest group that each is connected with
        low, last = np.minimum(root[at[0]], root[at[1]]), root.copy()
        np.minimum.at(root, at[0], low)
        np.minimum.at(root, at[1], low)
        root = root[root]
        if (root == last).all():
            break
    own_root = root == np.arange(len(names))
    return pa.record_batch([pa.array(names[~own_root], pa.int64()), pa.array(names[root[~own_root]], pa.int64())], names=["a", "b"])


def _screen(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held = batch if held is None else pa.concat_batches([held, batch])
        if held is None or not held.num_rows:
            continue
        keys = np.stack([np.asarray(held.column(c)).astype("i8") for c in ("node", "i", "j")], axis=1)
        new = np.r_[True, (keys[1:] != keys[:-1]).any(1)]
        end = len(new) if batch is None else int(np.flatnonzero(new)[-1])
        if end:
            yield _agreeing(held.slice(0, end), new[:end], least)
        held = held.slice(end)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            grams = pa.array([shingles(t or "", width).tobytes() for t in part.column("txt").to_pylist()], pa.binary())
            yield pa.record_batch([*[part.column(c) for c in ("rid", "weight", "n")], grams], names=["rid", "weight", "n", "grams"])


def _meetings(nodes: DataFrame, signs: DataFrame, screen: float | None, block: int) -> DataFrame:
    """(``a``, ``b``) edges between groups with classes in one node of a trie, at least one
    of them active. ``nodes`` has a row for each class of a node.

    Without a ``screen`` all groups of a node meet its smallest. Otherwise the classes of a
    node are compared: active ones with all others, in pairs of blocks, so that a frequent
    prefix is many tasks and resting classes are sent only to where active ones are."""
    many = F.count_if(~F.col("active"))
    open_nodes = nodes.groupBy("tree", "prefix").agg(
        F.min("grp").alias("least"), F.max("grp").alias("most"), F.ceil(many / block).cast("int").alias("resting"), F.ceil(F.count_if("active") / block).cast("int").alias("asking")
    )
    met = nodes.join(open_nodes.filter("least <> most and asking > 0"), ["tree", "prefix"])
    if screen is None:
        return met.filter("grp <> least").select(F.col("grp").alias("a"), F.col("least").alias("b")).distinct()
    blocks = F.col("resting") + F.col("asking")
    own = F.when(F.col("active"), F.col("resting") + F.pmod(F.xxhash64("rid"), F.col("asking"))).otherwise(F.pmod(F.xxhash64("rid"), F.greatest("resting", F.lit(1)))).cast("int")
    met = met.select("rid", "grp", "active", F.xxhash64("tree", "prefix").alias("node"), own.alias("own"), F.when(F.col("active"), 0).otherwise(F.col("resting")).alias("from"), blocks.alias("blocks"))
    met = met.join(signs, "rid").withColumn("p", F.explode(F.sequence(F.col("from"), F.col("blocks") - 1)))
    met = met.select("node", F.least("own", "p").alias("i"), F.greatest("own", "p").alias("j"), "own", "grp", "active", "sign")
    dealt = met.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")
    return dealt.mapInArrow(lambda it: returning(_screen(it, screen)), "a long, b long")


def _expected(levels: list[int], threshold: float, trees: int) -> Column:
    """Share of a class's links that its level is expected to have found."""
    unseen = F.array(*[F.lit(float(meeting_chance(threshold, d, trees))) for d in levels])[F.col("level")]
    return F.coalesce(F.col("met") / F.col("mass"), unseen)


def _links(classes: DataFrame, rows: DataFrame, width: int, threshold: float, trees: int, deepest: int, recall: float, screen: float, block: int, counts: bool) -> tuple[DataFrame, DataFrame]:
    """Verified links of the classes, as rows of ``verified``, and the final state of the
    classes that met others: ``level`` (place in ``prefix_lengths``), ``met``, ``mass``."""
    levels = prefix_lengths(threshold, trees, deepest, recall)
    size = SYMBOL * deepest
    # a set of n grams has no partner but itself if n / (n + 1) is under the threshold
    able = classes.filter(F.col("n") >= threshold * (F.col("n") + 1) - 1e-9)
    tries = able.select("rep", "sign", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    tries = tries.select("tree", F.substring("sign", F.col("tree") * size + 1, F.lit(size)).alias("label"), F.col("rep").alias("rid"))
    ordered = tries.repartitionByRange("tree", "label", "rid").sortWithinPartitions("tree", "label", "rid")
    tries = staged(ordered.mapInArrow(lambda it: returning(_matched(it, levels[-1], deepest)), "tree int, label binary, rid long, matched int"), "tries")
    some = staged(classes.select(F.col("rep").alias("rid"), "weight", "n").join(tries.select("rid").distinct(), "rid"), "met")
    # the texts meet a few numbers alone, a table that is often small enough for a broadcast join
    texts = rows.select("rid", "txt").join(some, "rid")
    sets = staged(texts.mapInArrow(lambda it: returning(_sets(it, width)), "rid long, weight long, n long, grams binary"), "sets")
    signs, n_met = classes.select(F.col("rep").alias("rid"), "sign"), some.count()

    def chances(similarity: np.ndarray) -> np.ndarray:
        return np.stack([meeting_chance(similarity, d, trees) for d in levels])

    state = some.select("rid", F.col("rid").alias("grp"), F.lit(0).alias("level"), F.lit(True).alias("active"), F.lit(None).cast("long").alias("met"), F.lit(None).cast("double").alias("mass"))
    found = sets.sparkSession.createDataFrame([], LINKS)
    for turn in itertools.count():
        level = min(turn, len(levels) - 1)
        prefix = F.substring("label", F.lit(1), F.lit(SYMBOL * levels[level])).alias("prefix")
        nodes = tries.filter(F.col("matched") >= levels[level]).select("tree", prefix, "rid").join(state.select("rid", "grp", "active"), "rid")
        roots = connected_components(_meetings(nodes, signs, screen if turn else None, block), n_met)
        state = state.withColumn("level", F.when(F.col("active"), level).otherwise(F.col("level"))).select("rid", "grp", "level")
        if not roots.isEmpty():
            roots = together(roots, n_met)
            roots = together(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), n_met).withColumnRenamed("node", "grp")
            state = together(state, n_met).join(roots, "grp", "left").select("rid", F.coalesce("root", "grp").alias("grp"), "level", F.col("root").isNotNull().alias("changed"))
            state = staged(gathered(state, n_met), "groups")
            # groups that grew are verified as a whole, the results of the others stay
            changed = state.filter("changed").select("rid", "grp")
            grown = together(changed.select(F.col("rid").alias("node"), F.col("grp").alias("root")), n_met)
            members = staged(gathered(blocked(grown, together(some, n_met), block, 4_000_000), n_met), "members")
            candidates = sets.select("rid", "weight", "n", "grams").join(members, "rid")
            new = verified(candidates, threshold, chances) if counts else staged(gathered(spanned(candidates, threshold, chances, block, n_met), n_met), "spanned")
            found = staged(gathered(found.join(changed.select("rid"), "rid", "left_anti").unionByName(new), n_met), "found") if turn else new
        sums = [F.sum(F.col("mass")[k]).alias(f"m{k}") for k in range(len(levels))]
        tallies = found.groupBy("rid").agg(F.sum("met").alias("met"), *sums)
        state = state.join(tallies, "rid", "left").select("rid", "grp", "level", "met", F.array(*[f"m{k}" for k in range(len(levels))])[F.col("level")].alias("mass"))
        state = state.withColumn("active", (F.col("level") < len(levels) - 1) & (_expected(levels, threshold, trees) < recall))
        state = staged(gathered(state, n_met), "state")
        if state.filter("active").isEmpty():
            return found, state


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, trees: int = 32, deepest: int = 10,
    recall: float = 0.9999, screen: float = 0.65, block: int = 512,
) -> DataFrame:
    """Class and number of links of every document.

    Returns ``did``, ``class_id`` (the smallest id that the document is connected with by
    links) and ``n_links`` (the number of other rows whose set of word ``width``-grams has
    a Jaccard similarity of at least ``threshold`` with this one's, copies included), one
    row for each input row.

    ``recall`` is the chance to find a link at the threshold, unless both of its ends rest
    on closer links (then ``least_recall``); closer pairs are found with a higher one.
    ``screen`` is the agreement of signatures under which a pair that met by a
    shortened prefix isn't followed up: with 320 symbols a pair at 0.8 lies 6.7 standard
    deviations above 0.65.

    Words are runs of word characters in lower case. A text with fewer than ``width`` words
    is one gram. A null or empty text, or one without words, has no links and is a class of
    its own. Rows are linked by their texts only: rows that share an id may be of different
    classes. A null id counts as the largest id. An empty table gives an empty result. Other
    columns are not read.
    """
    with scratch(docs.sparkSession):
        rows = docs.select(order_id(id_col).alias("did"), F.col(text_col).cast("string").alias("txt"))
        rows = staged(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
        out = _classified(rows, width, threshold, trees, deepest, recall, screen, block)
        return kept(out.select("did", "class_id", "n_links"), "near-duplicates")


def _classified(
    rows: DataFrame, width: int = 5, threshold: float = 0.8, trees: int = 32, deepest: int = 10, recall: float = 0.9999, screen: float = 0.65, block: int = 512,
    only: DataFrame | None = None, counts: bool = True,
) -> DataFrame:
    """``did``, ``rid``, ``class_id``, ``n_links`` and ``first_rid`` of each of the ``rows``
    (``did``, ``rid``, ``txt``), a table whose ``rid`` is fixed and no two rows share. With
    ``only`` (``rid``) the other rows take no part. Without ``counts``, ``n_links`` means
    nothing, and large groups take less work.

    ``first_rid`` is the row of the class with the smallest id, of several the one with the
    smallest ``rid``. Equal sets are a node, named by such a row of theirs."""
    sketch = rows.mapInArrow(lambda it: returning(_sketch(it, width, trees * deepest)), "did long, rid long, n long, h1 long, h2 long, sign binary")
    sketch = staged(sketch if only is None else sketch.join(only.hint("merge"), "rid", "left_semi"), "sketch")
    some = sketch.filter("n > 0")
    classes = some.groupBy("h1", "h2").agg(F.min_by(F.struct("did", "rid", "n", "sign"), F.struct("did", "rid")).alias("r"), F.count(F.lit(1)).alias("weight"))
    classes = staged(classes.select("h1", "h2", F.col("r.did").alias("least_did"), F.col("r.rid").alias("rep"), F.col("r.n").alias("n"), F.col("r.sign").alias("sign"), "weight"), "classes")
    found, state = _links(classes, rows, width, threshold, trees, deepest, recall, screen, block, counts)

    links = found.groupBy("rid").agg(F.sum("links").alias("links")).withColumnRenamed("rid", "rep")
    roots = connected_components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")), state.count()).withColumnRenamed("node", "rep")
    reps = classes.select("h1", "h2", "rep", "least_did", "weight").join(links, "rep", "left").join(roots, "rep", "left")
    linked_reps = reps.filter("links is not null").select(F.coalesce("root", "rep").alias("root"), F.struct(F.col("least_did").alias("did"), F.col("rep").alias("rid")).alias("one"))
    firsts = linked_reps.groupBy("root").agg(F.min("one").alias("first"))
    reps = reps.withColumn("root", F.coalesce("root", "rep")).join(firsts, "root", "left")
    reps = reps.select(
        "h1", "h2", F.coalesce("first.did", "least_did").alias("class_id"), F.coalesce("first.rid", "rep").alias("first_rid"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
    )
    out = sketch.select("did", "rid", "n", "h1", "h2").join(reps, ["h1", "h2"], "left")
    alone = F.col("n") == 0
    return out.select(
        "did", "rid", F.when(alone, F.col("did")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(alone, F.col("rid")).otherwise(F.col("first_rid")).alias("first_rid"),
    )


def later_rows(rows: DataFrame, only: DataFrame, **options) -> DataFrame:
    """``rid`` of those ``rows`` (``did``, ``rid``, ``txt``) that are not the first of their
    class among the rows that ``only`` (``rid``) names; no two of those share a ``rid``."""
    with scratch(rows.sparkSession):
        return kept(_classified(rows, only=staged(only, "only"), counts=False, **{"block": CLASS_BLOCK, **options}).filter("rid <> first_rid").select("rid"), "later-rows")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class of ``docs``, the one with the smallest id, with all its columns.
    Rows are judged each by itself, whatever other rows share its id; of several rows of a
    class with the smallest id, null ids included, one stays."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    with scratch(docs.sparkSession):
        rows = kept(docs.select(row, order_id(id_col).alias("did"), F.monotonically_increasing_id().alias("rid")), "rows")
        texts = rows.select("did", F.col("row")[text_col].cast("string").alias("txt"), "rid")
        gone = kept(_classified(texts, counts=False, **{"block": CLASS_BLOCK, **options}).filter("rid <> first_rid").select("rid"), "near-duplicates")
        return rows.join(gone, "rid", "left_anti").select("row.*")


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("did", "doc_id")
