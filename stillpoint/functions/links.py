"""Groups of sets that met, verified pair by pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stillpoint.functions.components import connected_components
from stillpoint.functions.tables import returning, together, written


def overlaps(sets: list[np.ndarray], first: int, same: bool) -> np.ndarray:
    """Sizes of the intersections of the first ``first`` sets with the others (with each
    other if ``same``). Rare grams are paired over their few owners, common ones are
    multiplied as columns of a matrix, in blocks of columns."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    start = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    count = np.diff(np.r_[start, len(grams)])
    left = np.arange(first)
    right = left if same else np.arange(first, n)
    inter = np.zeros((first, len(right)), "f4")
    shift = 0 if same else first
    rare = np.repeat((count > 1) & (count <= 16), count)
    o, column = owner[rare], np.repeat(np.arange(len(count)), count)[rare]
    for gap in range(1, 16):
        if gap >= len(o):
            break
        hit = column[gap:] == column[:-gap]
        if not hit.any():
            break
        a, b = o[:-gap][hit], o[gap:][hit]  # a < b
        if not same:
            cross = (a < first) & (b >= first)
            a, b = a[cross], b[cross] - shift
        np.add.at(inter, (a, b), 1)
    common = np.flatnonzero(count > 16)
    for lo in range(0, len(common), 2048):
        part = common[lo : lo + 2048]
        c = count[part]
        at = np.repeat(start[part] - np.cumsum(c) + c, c) + np.arange(c.sum())
        matrix = np.zeros((n, len(part)), "f4")
        matrix[owner[at], np.repeat(np.arange(len(part)), c)] = 1
        product = matrix[left] @ matrix[right].T
        inter += np.triu(product, 1) if same else product
    return inter + inter.T if same else inter


def similarities(sets: list[np.ndarray], first: int, same: bool) -> np.ndarray:
    """Jaccard similarity of the first ``first`` sets with the others."""
    inter = overlaps(sets, first, same)
    size = np.array([len(s) for s in sets], "f8")
    other = slice(0, first) if same else slice(first, None)
    return inter / (size[:first, None] + size[None, other] - inter)


def spanning(links: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that each id of ``a`` and of ``b`` is connected with."""
    top = np.iinfo("i8").max
    la, lb = a.copy(), b.copy()
    while True:
        na = np.minimum(la, np.where(links, lb[None, :], top).min(1, initial=top))
        nb = na if same else np.minimum(lb, np.where(links, na[:, None], top).min(0, initial=top))
        if (na == la).all() and (nb == lb).all():
            return la, lb
        la, lb = na, nb


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that share their keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([np.asarray(batch.column(k)) for k in keys], axis=1)
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            if held and tuple(values[lo]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = tuple(values[lo])
    if held:
        yield pa.Table.from_batches(held)


LINKS = "rid long, links long, root long, met long, mass array<double>"
#: (similarities) -> for each of several depths the chance that a pair has met by it.
Chances = Callable[[np.ndarray], np.ndarray]


def _verify(batches: Iterator[pa.RecordBatch], threshold: float, chances: Chances | None) -> Iterator[pa.RecordBatch]:
    for table in runs(batches, ["grp", "i", "j"]):
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own = np.asarray(table.column("own"))
        order = np.argsort(own != i, kind="stable")
        ids, weight = np.asarray(table.column("rid"))[order], np.asarray(table.column("weight"))[order]
        raw = table.column("grams").to_pylist()
        sets = [np.frombuffer(raw[k], "u8") for k in order]
        same = i == j
        first = len(sets) if same else int((own == i).sum())
        if first == 0 or (not same and first == len(sets)) or len(sets) < 2:
            continue
        other = slice(0, first) if same else slice(first, None)
        alike = similarities(sets, first, same)
        links = (alike >= threshold - 1e-9) & (ids[:first, None] != ids[None, other])
        ra, rb = spanning(links, ids[:first], ids[other], same)
        near, met = links @ weight[other].astype("i8"), links.sum(1)
        if not same:
            near, met = np.r_[near, links.T @ weight[:first].astype("i8")], np.r_[met, links.sum(0)]
            ra = np.r_[ra, rb]
        has = met > 0
        columns = [pa.array(ids[has]), pa.array(near[has], pa.int64()), pa.array(ra[has]), pa.array(met[has], pa.int64())]
        a, b = np.nonzero(links)
        mass = []
        for inverse in 1 / chances(alike[a, b]) if chances else []:
            total = np.bincount(a, inverse, first)
            mass.append((total if same else np.r_[total, np.bincount(b, inverse, len(sets) - first)])[has])
        lists = pa.array(np.stack(mass, axis=1).tolist() if mass else [[]] * int(has.sum()), pa.list_(pa.float64()))
        yield pa.record_batch([*columns, lists], names=["rid", "links", "root", "met", "mass"])


def blocked(groups: DataFrame, loads: DataFrame, block: int, block_grams: int) -> DataFrame:
    """(``node``, ``root``) rows of groups, roots included, to rows of ``candidate_groups``.
    A block has about ``block`` sets and ``block_grams`` grams in all; ``loads`` has the
    number of grams ``n`` of each set ``rid``."""
    members = groups.select(F.col("node").alias("rid"), F.col("root").alias("grp")).join(loads.select("rid", "n"), "rid")
    count, grams = F.count(F.lit(1)) / block, F.sum("n") / block_grams
    sizes = members.groupBy("grp").agg(F.ceil(F.greatest(count, grams)).cast("int").alias("blocks"))
    members = members.join(sizes, "grp").withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    return members.select("rid", "grp", "blocks", "own")


def candidate_groups(edges: DataFrame, loads: DataFrame, block: int, block_grams: int = 4_000_000) -> DataFrame:
    """(``a``, ``b``) edges of sets that met to rows of each set ``rid``: its group ``grp``,
    the number of ``blocks`` of the group, and its ``own`` block."""
    groups = connected_components(edges)
    return blocked(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()), loads, block, block_grams)


def verified(sets: DataFrame, threshold: float, chances: Chances | None = None) -> DataFrame:
    """Every pair of sets of a group verified, by pairs of blocks: for a block pair and a
    set with links its number of ``links``, weighted, and of linked sets (``met``), and the
    smallest ``root`` they reach. With ``chances``, ``mass`` has for each depth the sum over
    the linked sets of 1 / the chance to have met them.

    ``sets`` has the columns of ``candidate_groups``, ``weight`` and ``grams``, the distinct
    64-bit hashes of the set as bytes."""
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("p")
    pairs = sets.select("rid", "weight", "grp", "own", "grams", partner)
    pairs = pairs.select("rid", "weight", "grp", "own", "grams", F.least("own", "p").alias("i"), F.greatest("own", "p").alias("j"))
    return written(_checked(pairs, threshold, chances), "links")


def _checked(pairs: DataFrame, threshold: float, chances: Chances | None) -> DataFrame:
    """Every pair of the sets of block ``i`` with those of block ``j``; a set's ``own`` is one of them."""
    dealt = pairs.select("rid", "weight", "grp", "own", "grams", "i", "j").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "rid")
    return dealt.mapInArrow(lambda it: returning(_verify(it, threshold, chances)), LINKS)


#: Pivots that a group's members are compared with at a time, and how often at most.
PIVOTS, ROUNDS = 8, 3
SEEN = "rid long, near array<float>, links long, root long, met long, mass array<double>"


def _to_pivots(batches: Iterator[pa.RecordBatch], threshold: float, chances: Chances | None) -> Iterator[pa.RecordBatch]:
    """Members of a block with the pivots of their group: a row for each member with its
    similarities, and one more for each further pivot that it is linked with."""
    for table in runs(batches, ["grp", "own"]):
        pivot = np.asarray(table.column("pivot"))
        order = np.argsort(~pivot, kind="stable")
        ids = np.asarray(table.column("rid"))[order]
        raw = table.column("grams").to_pylist()
        sets, first = [np.frombuffer(raw[k], "u8") for k in order], int(pivot.sum())
        if first in (0, len(sets)):
            continue
        alike = similarities(sets, first, False).T
        near = np.zeros((len(alike), PIVOTS), "f4")
        near[:, :first] = alike
        linked = (alike >= threshold - 1e-9) & (ids[first:, None] != ids[None, :first])
        m, p = np.nonzero(linked)
        rows, root = np.r_[np.arange(len(alike)), m], np.r_[ids[first:], ids[:first][p]]
        met = np.r_[np.zeros(len(alike), "i8"), np.ones(len(m), "i8")]
        mass = np.zeros((len(rows), 0))
        if chances:
            mass = np.concatenate([np.zeros((len(alike), len(chances(alike[:1, 0])))), (1 / chances(alike[m, p])).T])
        columns = [ids[first:][rows], near[rows].tolist(), np.zeros(len(rows), "i8"), root, met, mass.tolist()]
        kinds = [pa.int64(), pa.list_(pa.float32()), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["rid", "near", "links", "root", "met", "mass"])


def _pivot_round(members: DataFrame, candidates: DataFrame, threshold: float, chances: Chances | None, rows: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows of ``_to_pivots`` of all ``members`` and pivots drawn from ``candidates`` (rid, grp), and those pivots."""
    drawn = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("rid"), "rid"))
    chosen = written(together(candidates.select("rid", "grp"), rows).withColumn("_n", drawn).filter(F.col("_n") <= PIVOTS).select("rid"), "chosen")
    pivots = members.join(chosen, "rid").select("rid", "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), F.lit(True).alias("pivot"), "grams")
    both = members.select("rid", "grp", "own", F.lit(False).alias("pivot"), "grams").unionByName(pivots)
    dealt = both.repartition("grp", "own").sortWithinPartitions("grp", "own", F.desc("pivot"), "rid")
    return written(dealt.mapInArrow(lambda it: returning(_to_pivots(it, threshold, chances)), SEEN), "pivots"), chosen


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of connected pivots of a group to the smallest pivot that each is connected with."""
    for batch in batches:
        pivots, roots = [], []
        for edges in batch.column("edges").to_pylist():
            names, at = np.unique([(e["a"], e["b"]) for e in edges], return_inverse=True)
            at, root = at.reshape(-1, 2), np.arange(len(names))
            while True:
                low, last = np.minimum(root[at[:, 0]], root[at[:, 1]]), root.copy()
                np.minimum.at(root, at[:, 0], low)
                np.minimum.at(root, at[:, 1], low)
                if (root == last).all():
                    break
            pivots.append(names.tolist())
            roots.append(names[root].tolist())
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (pivots, roots)]
        yield pa.record_batch([batch.column("grp"), batch.column("blocks"), *lists], names=["grp", "blocks", "pivots", "roots"])


def _classes(members: DataFrame, links: list[DataFrame], pivots: list[DataFrame], rows: int | None) -> DataFrame:
    """Members with the class ``cls`` that links with pivots put them in, named by its
    smallest pivot, and whether they are no pivot and linked with none (``alone``).

    Members meet through pivots only, and a group has ``PIVOTS * ROUNDS`` of them at most:
    one small row a group tells which of its pivots are connected, and goes to each block."""
    edges = [x.select("rid", "root") for x in links] + [x.select("rid", F.col("rid").alias("root")) for x in pivots]
    linked = together(reduce(DataFrame.unionByName, edges), rows).groupBy("rid").agg(F.array_sort(F.collect_set("root")).alias("linked"))
    found = written(together(members.select("rid", "grp", "blocks", "own", "before"), rows).join(linked, "rid", "left"), "linked")
    found = together(found, rows)
    pairs = found.select("grp", "blocks", F.explode(F.transform("linked", lambda p: F.struct(F.col("linked")[0].alias("a"), p.alias("b")))).alias("edge"))
    groups = pairs.groupBy("grp").agg(F.max("blocks").alias("blocks"), F.collect_set("edge").alias("edges"))
    roots = groups.mapInArrow(_rooted, "grp long, blocks int, pivots array<long>, roots array<long>")
    roots = roots.select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), F.map_from_arrays("pivots", "roots").alias("root"))
    named = found.join(roots, ["grp", "own"], "left")
    return named.select("rid", "grp", "before", F.coalesce(F.col("root")[F.col("linked")[0]], "rid").alias("cls"), F.col("linked").isNull().alias("alone"))


def spanned(sets: DataFrame, threshold: float, chances: Chances | None = None, block: int = 512, rows: int | None = None) -> DataFrame:
    """As many verified links as tell which sets of a group are connected, as rows of
    ``verified`` without counts: a group of n near copies is shuffled a few times, not
    n / ``block`` times.

    The members of a group of several blocks first meet a few pivots of it. Those linked
    with a pivot are settled with it; further pivots come from the others, as long as each
    round settles half of them. A group whose members are all connected is done: its other
    links tell nothing new. In any other group every pair of members that aren't connected
    yet could still be linked. One minus the Jaccard similarity is a metric, so members that
    differ by more than one minus the threshold in their distance from any pivot aren't
    linked, nor are sets of too unlike sizes. Blocks of settled classes and of the rest are
    compared pair by pair where these bounds leave any room, each pair of blocks exactly.

    ``sets`` has the columns of ``candidate_groups``, ``weight``, ``n`` and ``grams``. With
    ``rows``, about their number or more, tables without grams are read ``together``."""
    small = verified(sets.filter("blocks = 1"), threshold, chances)
    large = written(sets.filter("blocks > 1").withColumn("before", F.lit(None).cast("long")), "large")
    if large.isEmpty():
        return small
    links, pivots, coordinates = [], [], []
    asking = candidates = large
    for turn in range(ROUNDS):
        seen, chosen = _pivot_round(asking, candidates, threshold, chances, rows)
        links.append(seen.filter("rid <> root").drop("near"))
        pivots.append(chosen)
        coordinates.append(seen.filter("rid = root").select("rid", F.col("near").alias(f"near{turn}")))
        named = together(written(_classes(large, links, pivots, rows), "named"), rows)
        told = named.groupBy("grp").agg(F.min("cls").alias("least"), F.max("cls").alias("most"), F.count_if("alone").alias("left"), F.coalesce(F.max("before"), F.count(F.lit(1))).alias("before"))
        open_groups = written(told.filter("least <> most").select("grp", "left", "before"), "open")
        going = open_groups.filter((F.col("left") > block) & (F.col("left") <= F.col("before") / 2)).select("grp")
        if turn == ROUNDS - 1 or going.isEmpty():
            break
        large = written(large.drop("before").join(open_groups.select("grp", F.col("left").alias("before")), "grp"), "large")
        asking = large.join(going, "grp", "left_semi")
        candidates = named.filter("alone").join(going, "grp", "left_semi")
    if not open_groups.isEmpty():
        rest = named.select("rid", "grp", "cls").join(together(open_groups.select("grp"), rows), "grp", "left_semi").join(together(large.select("rid", "n"), rows), "rid")
        for part in coordinates:
            rest = rest.join(together(part, rows), "rid", "left")
        links.append(_across(large, together(written(rest, "rest"), rows), len(coordinates), threshold, chances, block, rows))
    return reduce(DataFrame.unionByName, links, small)


def _across(sets: DataFrame, rest: DataFrame, turns: int, threshold: float, chances: Chances | None, block: int, rows: int | None) -> DataFrame:
    """Links between those ``sets`` that ``rest`` puts in different classes ``cls`` of a group.
    Large classes are blocks of their own, the members of small ones share blocks. The grams
    come in once it is known which blocks meet."""
    sizes = rest.groupBy("grp", "cls").agg(F.count(F.lit(1)).alias("size"))
    pools = sizes.filter(F.col("size") < block // 2).groupBy("grp").agg(F.sum("size").alias("pool"))
    dealt = rest.join(sizes, ["grp", "cls"]).join(pools, "grp", "left")
    own_class = F.when(F.col("size") >= block // 2, F.col("cls"))
    blocks = F.ceil(F.when(own_class.isNotNull(), F.col("size")).otherwise(F.col("pool")) / block).cast("long")
    dealt = dealt.withColumn("one", own_class).withColumn("own", F.xxhash64("grp", F.coalesce("one", F.lit(-1).cast("long")), F.pmod(F.xxhash64("rid"), blocks)))
    dealt = together(written(dealt.drop("size", "pool"), "blocks"), rows)
    axes = [F.coalesce(F.col(f"near{t}")[k], F.lit(0.0).cast("float")) for t in range(turns) for k in range(PIVOTS)]
    bounds = [f(x).alias(f"{f.__name__}{i}") for i, x in enumerate(axes) for f in (F.min, F.max)]
    told = together(written(dealt.groupBy("grp", "own", "one").agg(F.min("n").alias("n_low"), F.max("n").alias("n_high"), *bounds), "told"), rows)
    a, b = told.alias("a"), told.alias("b")
    room = (F.col("a.n_high") >= F.col("b.n_low") * (threshold - 1e-9)) & (F.col("b.n_high") >= F.col("a.n_low") * (threshold - 1e-9))
    for i in range(len(axes)):  # similarities to a pivot: bounds of floats, a little widened
        for x, y in (("a", "b"), ("b", "a")):
            room &= F.col(f"{x}.max{i}") + F.lit(1 - threshold + 1e-5) >= F.col(f"{y}.min{i}")
    one_class = F.coalesce(F.col("a.one") == F.col("b.one"), F.lit(False))
    pairs = a.join(b, "grp").filter((F.col("a.own") <= F.col("b.own")) & ~one_class & room)
    pairs = pairs.select("grp", F.col("a.own").alias("i"), F.col("b.own").alias("j"))
    sides = pairs.select("grp", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))
    whole = sets.select("rid", "weight", "grams").join(dealt.select("rid", "grp", "own"), "rid")
    return written(_checked(whole.join(sides, ["grp", "own"]), threshold, chances), "across")
