"""Periodic runs: maximal stretches of words that repeat with a smallest period.

Periods from 2b - 1 to 4b - 2 are found at the scale of blocks of b words, for b = 1, 2, 4,
… Any stretch of one period holds an aligned block; the block occurs again one period
later. An exact number-theoretic transform of the squared differences between a block and
the window after it tells every distance at which no word differs. Neighbouring blocks with
the same distance are one seed, which is extended word by word, by less than a block at
each end, to the whole stretch.

Stretches of different periods that cover the same words are one run, of the smallest
period: if the period of a stretch of two periods isn't its smallest, the smallest divides
it, and both reach equally far.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Primes c * 2**k + 1 and a generator of each (fixed values); transforms of up to 2**25.
PRIMES = [(2013265921, 31), (469762049, 3), (167772161, 3)]
#: Numbers transformed at once, and words of one batch of texts.
ELEMENTS, BATCH_WORDS = 1 << 17, 200_000
FAR = 1 << 40


class Transform:
    """Number-theoretic transform of rows, modulo one prime. Forward results are in
    bit-reversed order, which the inverse takes back; products need no other order."""

    def __init__(self, prime: int, generator: int):
        self.prime, self.generator = prime, generator
        self.known: dict[tuple[int, bool], np.ndarray] = {}

    def reduced(self, x: np.ndarray) -> np.ndarray:
        return x - x // np.uint64(self.prime) * np.uint64(self.prime)

    def powers(self, size: int, inverse: bool) -> np.ndarray:
        """Powers 0 to size / 2 - 1 of a root of unity of order ``size``."""
        if (size, inverse) not in self.known:
            root = pow(self.generator, (self.prime - 1) // size, self.prime)
            root = pow(root, -1, self.prime) if inverse else root
            out = np.ones(1, "u8")
            while len(out) < size // 2:
                out = np.concatenate([out, self.reduced(out * np.uint64(pow(root, len(out), self.prime)))])
            self.known[size, inverse] = out
        return self.known[size, inverse]

    def forward(self, x: np.ndarray) -> np.ndarray:
        rows, size = x.shape
        prime, half = np.uint64(self.prime), size // 2
        while half:
            x = x.reshape(rows, -1, 2, half)
            a, b = x[:, :, 0], x[:, :, 1]
            total = a + b
            out = np.empty_like(x)
            out[:, :, 0] = np.where(total >= prime, total - prime, total)
            out[:, :, 1] = self.reduced((a + prime - b) * self.powers(2 * half, False))
            x, half = out, half // 2
        return x.reshape(rows, size)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        rows, size = x.shape
        prime, half = np.uint64(self.prime), 1
        while half < size:
            x = x.reshape(rows, -1, 2, half)
            a, b = x[:, :, 0], self.reduced(x[:, :, 1] * self.powers(2 * half, True))
            total, rest = a + b, a + prime - b
            out = np.empty_like(x)
            out[:, :, 0] = np.where(total >= prime, total - prime, total)
            out[:, :, 1] = np.where(rest >= prime, rest - prime, rest)
            x, half = out, half * 2
        return self.reduced(x.reshape(rows, size) * np.uint64(pow(size, -1, self.prime)))


TRANSFORMS = [Transform(*p) for p in PRIMES]


def zero_distances(codes: np.ndarray, squares: np.ndarray, starts: np.ndarray, b: int, transform: Transform) -> np.ndarray:
    """For each block of ``b`` codes the distances 2b - 1 to 4b - 2, as columns, at which the
    sum of its squared differences to the text is zero modulo the prime. ``squares`` are
    running sums of squared codes modulo the prime."""
    first = 2 * b - 1
    block = np.zeros((len(starts), 4 * b), "u8")
    window = np.zeros((len(starts), 4 * b), "u8")
    block[:, :b] = codes[starts[:, None] + np.arange(b - 1, -1, -1)]
    window[:, : 3 * b - 1] = codes[starts[:, None] + np.arange(first, first + 3 * b - 1)]
    product = transform.reduced(transform.forward(block) * transform.forward(window))
    cross = transform.inverse(product)[:, b - 1 : 3 * b - 1]
    own = squares[starts + b] - squares[starts]
    at = starts[:, None] + np.arange(first, first + 2 * b)
    other = squares[at + b] - squares[at]
    return transform.reduced(own[:, None] + other + np.uint64(2) * (np.uint64(transform.prime) - cross)) == 0


def extension(keys: np.ndarray, at: np.ndarray, distance: np.ndarray, sign: int) -> np.ndarray:
    """How many words from ``at`` on, in the direction of ``sign``, equal those ``distance``
    later. Texts end at keys of their own, so no extension leaves its text."""
    out = np.zeros(len(at), "i8")
    alive, width = np.arange(len(at)), 4
    while len(alive):
        still = []
        for lo in range(0, len(alive), max(1, (1 << 20) // width)):
            some = alive[lo : lo + max(1, (1 << 20) // width)]
            place = at[some, None] + sign * (out[some, None] + np.arange(width))
            same = keys.take(place, mode="clip") == keys.take(place + distance[some, None], mode="clip")
            whole = same.all(1)
            out[some] += np.where(whole, width, same.argmin(1))
            still.append(some[whole])
        alive, width = np.concatenate(still), min(2 * width, 4096)
    return out


def smallest(runs: np.ndarray) -> np.ndarray:
    """(start, end, period) rows by start and end, of the same words the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.r_[True, (np.diff(runs[:, :2], axis=0) != 0).any(1)][: len(runs)]]


def explained(known: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Stretches that lie in the farthest ``known`` run that begins before them, where its
    period divides theirs: they are parts of that run, however far they are extended."""
    if not len(known):
        return np.zeros(len(lo), bool)
    reach = np.maximum.accumulate(known[:, 1])
    farthest = np.maximum.accumulate(np.where(known[:, 1] == reach, np.arange(len(known)), 0))
    at = np.searchsorted(known[:, 0], lo, "right") - 1
    run = known[farthest[np.maximum(at, 0)]]
    return (at >= 0) & (run[:, 1] >= hi) & (d % run[:, 2] == 0)


def find_runs(texts: list[np.ndarray], least: int = 12) -> np.ndarray:
    """Runs of several texts, each given as numbers of its words (equal for equal words):
    rows of (text, start, length, period), by text, start and period."""
    longest = max(map(len, texts), default=0)
    sizes = np.array([len(t) + 1 for t in texts], "i8")
    starts = np.cumsum(sizes) - sizes + 1  # a mark before each text and after the last
    n = int(sizes.sum()) + 1
    pad = 4 * max(longest, 4)
    keys = -1 - np.arange(n, dtype="i8")  # marks: each its own
    codes = np.zeros(n + pad, "u8")
    limit = np.zeros(n, "i8")
    base = 0
    for text, at in zip(texts, starts):
        if len(text):
            keys[at : at + len(text)] = text + base
            codes[at : at + len(text)] = text + 1
            limit[at : at + len(text)] = at + len(text)
            base += int(text.max()) + 1
    order = np.argsort(keys, kind="stable")
    ahead = np.full(n, FAR)  # distance to the next of the same words
    same = keys[order[1:]] == keys[order[:-1]]
    ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
    worst = ahead  # of each block, the largest such distance
    highest = int(codes.max(initial=0))
    runs = np.zeros((0, 3), "i8")
    sums = {}
    b = 1
    while 2 * (2 * b - 1) <= longest:
        used, most = [], 1
        for t in TRANSFORMS:  # as many primes as it takes for zero to mean zero
            used.append(t)
            most *= t.prime
            if most > b * highest * highest:
                break
        blocks = np.flatnonzero(worst <= 4 * b - 2) * b  # no distance for blocks with a word that doesn't come again
        seeds = []
        per = max(1, ELEMENTS // (4 * b))
        for lo in range(0, len(blocks), per):
            x = blocks[lo : lo + per]
            zero = np.ones((len(x), 2 * b), bool)
            for t in used:
                if t.prime not in sums:
                    squares = t.reduced(t.reduced(codes) * t.reduced(codes))
                    sums[t.prime] = np.concatenate([np.zeros(1, "u8"), np.cumsum(squares, dtype="u8")])
                rows = np.flatnonzero(zero.any(1))
                if len(rows):
                    zero[rows] &= zero_distances(t.reduced(codes), sums[t.prime], x[rows], b, t)
            i, d = np.nonzero(zero)
            d, x = d + 2 * b - 1, x[i]
            inside = d + x + b <= limit[x]
            seeds.append(d[inside] * n + x[inside])
        if seeds:
            s = np.sort(np.concatenate(seeds))  # by distance, then place
            first = np.flatnonzero(np.r_[True, np.diff(s) != b][: len(s)])
            (d, x), covered = np.divmod(s[first], n), np.diff(np.r_[first, len(s)]) * b
            enough = np.maximum(least, 2 * d)
            able = (covered + 2 * (b - 1) + d >= enough) & ~explained(runs, x, x + covered + d, d)
            d, x, covered, enough = d[able], x[able], covered[able], enough[able]
            lo = x - extension(keys, x - 1, d, -1)
            hi = x + covered + extension(keys, x + covered, d, 1) + d
            long = hi - lo >= enough
            runs = smallest(np.concatenate([runs, np.stack([lo, hi, d], axis=1)[long]]))
        worst = np.maximum(worst[: len(worst) // 2 * 2 : 2], worst[1::2])
        b *= 2
    if not len(runs):
        return np.zeros((0, 4), "i8")
    text = np.searchsorted(starts, runs[:, 0], "right") - 1
    out = np.stack([text, runs[:, 0] - starts[text], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Positions that the words of a text of ``n`` words are taken from where its id asks
    for a planted repeat; None where it stays as it is."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed", "n_kept"]
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string, n_kept long"


def described(doc_id: int | None, words: list[bytes], runs: np.ndarray) -> tuple:
    """A row of ``SCHEMA`` for the runs of one text."""
    told = "".join(f"{s},{n},{p}\n" for _, s, n, p in runs.tolist())
    best: tuple = (None,) * 4
    kept = words
    if len(runs):
        _, s, n, p = min(runs.tolist(), key=lambda r: (-r[2], r[1], r[3]))
        best = (s, n, p, 1000 * n // p)
        edge = np.zeros(len(words) + 1, "i8")
        np.add.at(edge, runs[:, 1] + runs[:, 3], 1)
        np.add.at(edge, runs[:, 1] + runs[:, 2], -1)
        kept = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
    left = b" ".join(kept)
    return (doc_id, len(runs), *best, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(left).hexdigest(), left, len(kept))


def _detect(batches: Iterator[pa.RecordBatch], least: int, plant: bool, with_text: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 6 + [pa.string()] * 3 + [pa.int64()]

    def flush(held: list[tuple]) -> pa.RecordBatch:
        runs = find_runs([ids for _, _, ids in held], least)
        cut = np.searchsorted(runs[:, 0], np.arange(len(held) + 1))
        rows = [described(i, words, runs[cut[k] : cut[k + 1]]) for k, (i, words, _) in enumerate(held)]
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        columns[8] = [x.decode("utf-8", "replace") for x in columns[8]] if with_text else [None] * len(rows)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=COLUMNS)

    for batch in batches:
        held, total = [], 0
        for doc_id, raw in zip(batch.column("id").to_pylist(), batch.column("raw").to_pylist()):
            words = (raw or b"").split()
            seen: dict[bytes, int] = {}
            ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), "i8", len(words))
            if plant and (source := planted(len(words), doc_id)) is not None:
                words, ids = [words[i] for i in source.tolist()], ids[source]
            held.append((doc_id, words, ids))
            total += len(words)
            if total >= BATCH_WORDS:
                yield flush(held)
                held, total = [], 0
        if held:
            yield flush(held)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, plant: bool = False, with_text: bool = True) -> DataFrame:
    """Find every run of at least ``least`` words and two periods in every whole text.

    Returns ``doc_id``, ``n_runs``, the longest run's ``start``, ``length``, ``period`` and
    ``exponent_milli`` (ties to the smaller start, then period; null without a run), a digest
    of all runs, a digest of the text ``collapsed`` to the first period of each run, that
    text (null unless ``with_text``) and its words: one row for each input row, without a
    shuffle. ``plant`` first repeats a part of the texts whose id asks for it.

    A null or empty text has no words and no runs. Repeated rows are searched each; a null
    id stays null and plants nothing. An empty table gives an empty result. A text takes
    some 200 bytes a word of memory. Other columns are not read.
    """
    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    return raw.mapInArrow(lambda it: _detect(it, least, plant, with_text), SCHEMA)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return periodic_runs(docs, plant=True, with_text=False).drop("collapsed")
