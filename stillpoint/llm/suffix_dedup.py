"""Suffix-array dedup: repeated byte strings by merging shard Burrows-Wheeler transforms.

Two equal strings of ``length`` bytes contain the same minimiser (the least hash of their
k-byte strings, the rightmost on ties), so the strings that share a minimiser can be
compared apart from all others. The corpus is cut into runs of neighbouring strings with
one minimiser; runs whose minimiser occurs in one document only can't repeat and stay
where they are. Nor can runs of which no other document has the minimiser with either of its
sides: a string has half of its other bytes, or more, on one side of its minimiser. The
others go to the bucket of their minimiser.

Inside a bucket runs are grouped into shards. Each shard is suffix-sorted by itself, which
gives its Burrows-Wheeler transform and its last-to-first mapping. The shards' transforms
are then merged by iterative interleave refinement: starting from shard after shard, the
interleave is passed stably through the transform's symbols once for each symbol of
depth; places where neighbours first differ are the common-prefix borders, and after
``length`` rounds the intervals between borders are the repeated strings. The suffixes of
the shards are never sorted together. Equal runs are merged once, and runs that share
neither side of their minimiser with a different run needn't be: only their own copies have
their strings.

A minimiser of more run bytes than a bucket has (a passage's edge in many contexts) is no
bucket: its strings are dealt one by one, by a hash of the whole string, and compared by
themselves.

Documents travel as compressed chunks. A chunk sends each of its distinct runs once, with
the smallest id that has it, and gets back one bit a string: whether a smaller id has that
string. A passage in a third of all documents is one run a chunk. Chunks grow with the
number of buckets, from ``chunk_bytes`` to ``chunk_most``, so that their messages (one for
each bucket that they have runs of) don't become many and small; minimisers are looked for
in blocks, so that a chunk's size costs little memory.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stillpoint.functions.links import runs
from stillpoint.functions.tables import kept, scratch
from stillpoint.llm.common import packed_rows, returning, staged

MIX = np.uint64(0xD6E8FEB86659FD93)
TOP = np.iinfo("i8").max
#: Documents of a chunk, however short.
MOST_TEXTS = 20_000
CHUNK_SCHEMA = "chunk long, dids binary, sizes binary, body binary, rest binary, n_bytes long"


#: Strings whose minimisers are looked for at a time.
BLOCK = 1 << 17
#: Bits of a packed minimiser that hold the place inside a block (as complement).
PLACE_BITS = 24


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Pack documents into chunks of about ``most`` bytes of text, across batches."""
    packer, part, made = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0
    texts: list[bytes] = []
    dids: list[int] = []
    rest: list[pa.RecordBatch] = []
    held = 0

    def chunk() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest[0].schema) as out:
            for rows in rest:
                out.write_batch(rows)
        columns = [np.array(dids, "<i8").tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(), packer.compress(b"".join(texts)), packer.compress(sink.getvalue().to_pybytes())]
        return pa.record_batch([pa.array([(part << 32) + made], pa.int64()), *[pa.array([c], pa.binary()) for c in columns], pa.array([held], pa.int64())], names=["chunk", "dids", "sizes", "body", "rest", "n_bytes"])

    for batch in batches:
        rows, ids, lo = pa.record_batch([batch.column("row")], names=["row"]), batch.column("did").to_pylist(), 0
        for hi, text in enumerate(batch.column("txt").to_pylist(), 1):
            texts.append(text.encode("utf-8", "surrogatepass"))
            dids.append(ids[hi - 1])
            held += len(texts[-1])
            if held >= most or len(texts) >= MOST_TEXTS:
                rest.append(rows.slice(lo, hi - lo))
                yield chunk()
                texts, dids, rest, held, lo, made = [], [], [], 0, hi, made + 1
        if lo < batch.num_rows:
            rest.append(rows.slice(lo))
    if texts:
        yield chunk()


def run_hashes(grams: np.ndarray, at: np.ndarray, size: np.ndarray, length: int, k: int) -> np.ndarray:
    """Hashes of the runs of ``size`` bytes at ``at``, from those of k-byte strings that cover them."""
    code = size.astype("u8")
    for j in [*range(0, 2 * length - k, k), 2 * length]:
        code = (code ^ grams[at + np.minimum(j, size - k)]) * MIX
        code ^= code >> np.uint64(32)
    return code


def side_hashes(grams: np.ndarray, place: np.ndarray, first: np.ndarray, count: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run a hash of the bytes on the left of its minimiser at ``place`` and one of
    those on the right, half of a string's other bytes; 0 if none of the run's strings
    reaches so far. Every string reaches so far on one of the sides: two runs that share one
    share the minimiser and the hash of that side."""
    half = (length - k + 1) // 2
    one = np.uint64(1 << 48)
    left = np.where(place - first >= half, np.maximum(grams[np.maximum(place - half, 0)] * MIX, one), np.uint64(0))
    right = np.where(place - first - count + 1 <= length - k - half, np.maximum(grams[np.minimum(place + half, len(grams) - 1)] * MIX, one), np.uint64(0))
    return left, right


def shared_sides(key: np.ndarray, sides: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which runs share their key and the hash of a side with another one."""
    found = np.zeros(len(key), bool)
    for side in sides:
        some = np.flatnonzero(side)
        code = key[some] ^ side[some]
        order = np.argsort(code)
        same = code[order[1:]] == code[order[:-1]]
        found[some[order[1:][same]]] = True
        found[some[order[:-1][same]]] = True
    return found


def distinct_runs(text: np.ndarray, at: np.ndarray, size: np.ndarray, code: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of each run's string among the distinct ones, by hash, and a run of each.

    Runs of one hash are compared. Where two differ, neighbours in the given order do: a
    string may then have several numbers, but no number several strings."""
    if not len(at):
        return np.empty(0, "i8"), np.empty(0, "i8")
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    for kind in (None, "stable"):
        order = np.argsort(code, kind=kind)
        new = np.r_[True, code[order[1:]] != code[order[:-1]]]
        again = np.flatnonzero(~new)
        for part in np.split(again, range(1 << 16, len(again), 1 << 16)):
            a, b = order[part - 1], order[part]
            same = size[a] == size[b]
            for shift in (0, size[b] - length):  # a run is shorter than two strings
                same &= (windows[at[a] + np.where(same, shift, 0)] == windows[at[b] + shift]).all(axis=1)
            new[part] = ~same
        if new.sum() == len(order) - len(again):
            break
    number = np.empty(len(order), "i8")
    number[order] = np.cumsum(new) - 1
    return number, order[new]


class Runs:
    """The runs of a chunk: for each its first string, its number of strings, its
    minimiser, its document's place and hashes of what is left and right of its minimiser.
    ``of_key`` numbers the distinct runs in the order of ``keys``, hashes of whole runs;
    ``one`` has a run of each. With ``loads`` the bytes of each are there, too."""

    def __init__(self, row: dict, length: int, k: int, loads: bool = False):
        self.dids, self.sizes = np.frombuffer(row["dids"], "<i8"), np.frombuffer(row["sizes"], "<i8")
        self.body = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, int(self.sizes.sum())))
        self.length = length
        text, ends = np.frombuffer(self.body, "u1"), np.cumsum(self.sizes)
        parts = [self._block(text, ends, lo, length, k) for lo in range(0, len(text) - length + 1, BLOCK)]
        empty = np.empty(0, "i8")
        self.first, self.count, self.doc, self.minimiser, self.left, self.right, code = (np.concatenate(c) for c in zip(*parts)) if parts else (empty, empty, empty, empty.view("u8"), empty.astype("u2"), empty.astype("u2"), empty.view("u8"))
        self.of_key, self.one = distinct_runs(text, self.first, self.count + length - 1, code, length)
        self.keys = code[self.one]
        if loads:
            self.loads = self.count[self.one] + length - 1

    def _block(self, text: np.ndarray, ends: np.ndarray, lo: int, length: int, k: int) -> tuple[np.ndarray, ...]:
        """Runs that begin among the BLOCK strings from ``lo``: first string, number of
        strings, document, minimiser, hashes of its left and right side, hash of the run."""
        w, strings = length - k + 1, len(text) - length + 1
        hi = min(lo + BLOCK, strings)
        base, last = max(0, lo - 1), min(hi + w, strings)  # a run has at most w strings
        grams = self._hashes(text[base : last + 2 * length], k)
        low = np.uint64((1 << PLACE_BITS) - 1)
        packed = grams[: last - base + w - 1] & ~low
        packed |= low - np.arange(len(packed), dtype="u8")
        span = 1
        while span * 2 <= w:
            packed = np.minimum(packed[:-span], packed[span:])
            span *= 2
        if span < w:
            packed = np.minimum(packed[: len(packed) - (w - span)], packed[w - span :])
        new = np.empty(len(packed), bool)
        new[0] = lo == 0
        np.not_equal(packed[1:], packed[:-1], out=new[1:])
        starts = np.r_[0, ends[:-1]]
        new[starts[np.searchsorted(starts, lo) : np.searchsorted(starts, last)] - base] = True  # no run reaches into the next document
        first = np.flatnonzero(new)
        count = np.diff(np.r_[first, last - base])
        first, count = first[first + base < hi], count[first + base < hi]
        doc = np.searchsorted(ends, first + base, side="right")
        # a run ends before the next one, or where the strings inside the document do
        count = np.minimum(count, ends[doc] - length + 1 - (first + base))
        some = count > 0
        first, count, doc = first[some], count[some], doc[some]
        place = (low - (packed[first] & low)).astype("i8")
        left, right = ((side >> np.uint64(48)).astype("u2") for side in side_hashes(grams, place, first, count, length, k))
        return first + base, count, doc, grams[place], left, right, run_hashes(grams, first, count + length - 1, length, k)

    @staticmethod
    def _hashes(text: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all k-byte strings, by doubling."""
        out, size, power = text.astype("u8") + np.uint64(1), 1, 0x100000001B3
        while size < k:
            step = min(size, k - size)
            more, out = out[step:], out[:-step] * np.uint64(power)
            out += more
            size, power = size + step, (power * power + 2) % (1 << 64)
        out ^= out >> np.uint64(29)
        out *= MIX
        out ^= out >> np.uint64(32)
        return out

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the distinct runs by bucket, the buckets that occur, and their borders in it."""
        number = (self.minimiser[self.one] % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
        order = np.argsort(number, kind="stable")
        number = number[order]
        border = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True]) if len(order) else np.zeros(1, "i8")
        return order, number[border[:-1]].astype("i8"), border

    def marked(self, masks: list[dict], which: str, buckets: int) -> np.ndarray:
        """The distinct runs that the masks mark, in the order of their buckets, and which of
        the buckets each is in."""
        order, present, border = self.by_bucket(buckets)
        at = np.searchsorted(present, [m["bucket"] for m in masks])
        n = border[at + 1] - border[at]
        bits, start = unpacked([m[which] for m in masks])
        bucket = np.repeat(at, n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        some = bits[np.repeat(start, n) + inner]
        place = np.sort((border[bucket] + inner)[some])
        return order[place], np.searchsorted(border, place, side="right") - 1

    def hot(self, masks: list[dict], buckets: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The strings of runs with hot minimisers.

        Returns the strings' places and for each the number of its distinct string; the
        distinct strings, in order of their parts, with the border of each part, and the
        smallest id of each."""
        marked = np.zeros(len(self.keys), bool)
        marked[self.marked(masks, "hot", buckets)[0]] = True
        run = np.flatnonzero(marked[self.of_key])
        c = self.count[run]
        at = np.repeat(self.first[run] - np.cumsum(c) + c, c) + np.arange(c.sum())
        if not len(at):
            return at, at, np.empty(0, f"S{self.length}"), np.zeros(parts + 1, "i8"), at
        text = np.frombuffer(self.body, "u1")
        taken = np.empty((len(at), self.length), "u1")
        for lo in range(0, len(at), 1 << 16):
            taken[lo : lo + (1 << 16)] = text[at[lo : lo + (1 << 16), None] + np.arange(self.length)]
        strings, one, which = np.unique(taken.view(f"S{self.length}")[:, 0], return_index=True, return_inverse=True)
        part = (self._hashes(text, self.length)[at[one]] % np.uint64(parts)).astype("i8")
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), "i8")
        place[order] = np.arange(len(order))
        which = place[which]
        least = np.full(len(strings), TOP)
        np.minimum.at(least, which, np.repeat(self.dids[self.doc[run]], c))
        return at, which, strings[order], np.searchsorted(part[order], np.arange(parts + 1)), least

    def candidates(self, masks: list[dict], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct runs that may have a string of another document, by bucket.

        Returns their numbers, the border of each bucket that has some, and for each the
        smallest id."""
        own, bucket = self.marked(masks, "mask", buckets)
        border = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(own) else np.zeros(1, "i8")
        return own, border, self.least()[own]

    def least(self) -> np.ndarray:
        """The smallest id of each distinct run."""
        least = np.full(len(self.keys), TOP)
        np.minimum.at(least, self.of_key, self.dids[self.doc])
        return least


def packed(bits: np.ndarray, border: np.ndarray) -> list[bytes]:
    """A packed mask of the bits between each two borders."""
    n = np.diff(border)
    end = np.cumsum((n + 7) // 8)
    start = end - (n + 7) // 8
    room = np.zeros(int(end[-1]) * 8 if len(end) else 0, bool)
    room[np.repeat(start * 8 - border[:-1], n) + np.arange(len(bits))] = bits
    data = np.packbits(room).tobytes()
    return [data[s:e] for s, e in zip(start.tolist(), end.tolist())]


def unpacked(masks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bits of all packed masks, one after the other, and where each mask's begin."""
    size = np.array([len(m) for m in masks], "i8")
    return np.unpackbits(np.frombuffer(b"".join(masks), "u1")).astype(bool), (np.cumsum(size) - size) * 8


def _keys(batches: Iterator[pa.RecordBatch], length: int, k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The distinct runs of each chunk by bucket: 32 bits of the minimiser's hash beyond the
    bucket, the hashes of its two sides; ``flags`` tells which of them two documents of the
    chunk have."""
    for batch in batches:
        for row in batch.to_pylist():
            r = Runs(row, length, k)
            order, present, border = r.by_bucket(buckets)
            # a run of several documents is in one that is not the first of its runs'
            many = np.zeros(len(r.keys), bool)
            many[r.of_key[r.dids[r.doc] != r.dids[r.doc[r.one]][r.of_key]]] = True
            run, many = r.one[order], many[order]
            keys, sides = (r.minimiser[run] // np.uint64(buckets)).astype("<u4"), np.stack([r.left[run], r.right[run]], axis=1).astype("<u2")
            keys, sides = keys.tobytes(), sides.tobytes()
            out = [(b, row["chunk"], keys[4 * s : 4 * e], sides[4 * s : 4 * e], m) for b, s, e, m in zip(present.tolist(), border[:-1].tolist(), border[1:].tolist(), packed(many, border))]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, kinds)], names=["bucket", "chunk", "keys", "sides", "flags"])


def _repeated(batches: Iterator[pa.RecordBatch], most: int, run_bytes: int) -> Iterator[pa.RecordBatch]:
    """For each chunk and bucket a mask of the runs that may have a string of another
    document, and one of those among them whose minimiser has more than ``most`` bytes of
    them, with their bytes; a run counts as ``run_bytes``.

    A string that two runs have is at the same distance from their minimiser, and so are the
    bytes of its longer side: the runs share the hash of that side, too."""
    for table in runs(batches, ["bucket"]):
        sent = [np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()]
        keys = np.concatenate(sent).astype("u8")
        sides = np.frombuffer(b"".join(table.column("sides").to_pylist()), "<u2").reshape(-1, 2)
        many = np.concatenate([np.unpackbits(np.frombuffer(f, "u1"), count=len(s)) for f, s in zip(table.column("flags").to_pylist(), sent)]).astype(bool)
        many |= shared_sides(keys << np.uint64(16), sides.T.astype("u8"))
        large = np.zeros(len(many), bool)
        own = np.flatnonzero(many)
        if len(own) * run_bytes > most:
            which, count = np.unique(keys[own], return_inverse=True, return_counts=True)[1:]
            large[own] = (count * run_bytes > most)[which]
        border = np.cumsum([0, *[len(s) for s in sent]])
        some = pa.array(np.flatnonzero(np.logical_or.reduceat(many, border[:-1])))
        hot_bytes = np.add.reduceat(large, border[:-1], dtype="i8") * run_bytes
        columns = [*[table.column(c).combine_chunks() for c in ("chunk", "bucket")], *[pa.array(packed(m, border), pa.binary()) for m in (many & ~large, large)], pa.array(hot_bytes)]
        yield pa.record_batch([c.take(some) for c in columns], names=["chunk", "bucket", "mask", "hot", "hot_bytes"])


def _send(batches: Iterator[pa.RecordBatch], length: int, k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for row in batch.to_pylist():
            if not row["masks"]:
                continue
            r = Runs(row, length, k)
            own, border, least = r.candidates(row["masks"], buckets)
            run = r.one[own]
            start, size, least = r.first[run], (r.count[run] + length - 1).astype("<i4"), least.astype("<i8")
            strings = [r.body[s:e] for s, e in zip(start.tolist(), (start + size).tolist())]
            bucket = (r.minimiser[run[border[:-1]]] % np.uint64(buckets)).tolist()
            out = [(b, row["chunk"], size[s:e].tobytes(), packer.compress(b"".join(strings[s:e])), least[s:e].tobytes()) for b, s, e in zip(bucket, border[:-1].tolist(), border[1:].tolist())]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, kinds)], names=["bucket", "chunk", "sizes", "body", "least"])


def _send_hot(batches: Iterator[pa.RecordBatch], length: int, k: int, buckets: int, parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            _, _, strings, border, least = Runs(row, length, k).hot(row["masks"], buckets, parts)
            some = np.flatnonzero(np.diff(border))
            sent = [(strings[s:e].tobytes(), least[s:e].astype("<i8").tobytes()) for s, e in zip(border[some], border[some + 1])]
            columns = [pa.array(some, pa.int64()), pa.array([row["chunk"]] * len(some), pa.int64()), *[pa.array([x[j] for x in sent], pa.binary()) for j in (0, 1)]]
            yield pa.record_batch(columns, names=["bucket", "chunk", "strings", "least"])


def _judge_hot(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """For each chunk of a part one bit for each of its strings: whether a smaller id than
    the chunk's smallest has it."""
    for table in runs(batches, ["bucket"]):
        own = [np.frombuffer(x, "<i8") for x in table.column("least").to_pylist()]
        strings = np.frombuffer(b"".join(table.column("strings").to_pylist()), f"S{length}")
        one, which = np.unique(strings, return_inverse=True)
        flat, smallest = np.concatenate(own), np.full(len(one), TOP)
        np.minimum.at(smallest, which, flat)
        bits = [np.packbits(b).tobytes() for b in np.split(smallest[which] < flat, np.cumsum([len(x) for x in own])[:-1])]
        yield pa.record_batch([*[table.column(c).combine_chunks() for c in ("chunk", "bucket")], pa.array(bits, pa.binary())], names=["chunk", "bucket", "bits"])


def shard_transform(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order, Burrows-Wheeler transform and last-to-first mapping of one shard.

    ``text`` holds strings, each followed by a 0, and is read as a circle. Suffixes are
    ordered by 7 symbols; then those that are not yet alone are ordered within their group
    by the order of the suffix 7, 14, 28, ... symbols on, until ``depth`` is covered.
    """
    n = len(text)
    key = text.astype("i8")
    for j in range(1, 7):
        key = (key << 8) | np.roll(text, -j)
    order, slots, rank = np.argsort(key), np.arange(n), np.empty(n, "i8")
    members, key, covered = order, key[order], 7
    while True:
        border = np.r_[True, key[1:] != key[:-1], True]
        group = slots[np.maximum.accumulate(np.where(border[:-1], np.arange(len(slots)), 0))]
        rank[members] = group  # the first slot of a suffix's group
        if covered >= depth:
            break
        shared = ~(border[:-1] & border[1:])
        members, slots = members[shared], slots[shared]
        if not len(members):
            break
        key = rank[members] * n + rank[(members + covered) % n]
        turn = np.argsort(key)
        members, key = members[turn], key[turn]
        order[slots] = members
        covered *= 2
    place = np.empty(n, "i8")
    place[order] = np.arange(n)
    before = order - 1
    before[before < 0] = n - 1
    return order, text[before], place[before]


def merge_transforms(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge the transforms of shards by interleave refinement to ``depth`` symbols.

    A round passes the interleave stably through the transform, two symbols at a time. An
    interval of one suffix can only have intervals of one suffix before it, so such
    suffixes leave the interleave as soon as they are alone. Returns, in merged order, the
    place of each remaining suffix in the shards' own orders one after another, and the
    number of its interval of common prefixes of ``depth`` symbols.
    """
    offset = np.cumsum([0, *[len(o) for o, _, _ in shards]])
    kind = "i4" if offset[-1] < 1 << 31 else "i8"
    symbols = np.concatenate([b for _, b, _ in shards])
    first = np.concatenate([(lf + o).astype(kind) for (_, _, lf), o in zip(shards, offset)])
    place, block = np.arange(len(symbols), dtype=kind), np.zeros(len(symbols), kind)
    steps = [(symbols, first)] * (depth % 2)
    if depth > 1:
        steps += [((symbols[first].astype("u2") << np.uint16(8)) | symbols, first[first])] * (depth // 2)
    for symbol_of, to in steps:
        symbol = symbol_of[place]
        order = np.argsort(symbol, kind="stable")
        symbol, block, place = symbol[order], block[order], to[place[order]]
        border = np.ones(len(place) + 1, bool)
        border[1:-1] = (block[1:] != block[:-1]) | (symbol[1:] != symbol[:-1])
        shared = ~(border[:-1] & border[1:])
        block = np.cumsum(border[:-1], dtype=kind)[shared]
        place = place[shared]
    return place, block


def seen_before(strings: list[bytes], least: np.ndarray, length: int, shard: int) -> list[np.ndarray]:
    """For each string the smallest id of each of its ``length``-byte substrings among all
    the strings; ``least`` has the smallest id of each string."""
    sizes = np.array([len(s) for s in strings], "i8")
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes + 1) // shard)) + 1
    shards, dids, home, base = [], [], [], 0
    kind = "i4" if int(sizes.sum()) + len(sizes) < 1 << 31 else "i8"
    for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(strings)]):
        own = sizes[lo:hi]
        text = np.frombuffer(b"\xff".join(strings[lo:hi]) + b"\xff", "u1") + np.uint8(1)  # ends become 0
        order, transform, mapping = shard_transform(text, length)
        string = np.repeat(np.arange(hi - lo), own + 1)
        rest = np.repeat(np.cumsum(own + 1), own + 1) - 1 - np.arange(len(text))
        shards.append((order, transform, mapping))
        dids.append(np.where(rest >= length, least[lo:hi][string], TOP)[order])
        home.append((order + base).astype(kind))
        base += len(text)
    counts = np.maximum(0, sizes - length + 1)
    smallest = np.repeat(np.where(counts > 0, least, TOP), sizes + 1)  # of a string that is alone: its own
    place, block = merge_transforms(shards, length)
    if len(place):
        at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        of_block = np.minimum.reduceat(np.concatenate(dids)[place], at)
        smallest[np.concatenate(home)[place]] = np.repeat(of_block, np.diff(np.r_[at, len(block)]))
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    return [smallest[s : s + n] for s, n in zip(starts, counts)]


def _judge(batches: Iterator[pa.RecordBatch], length: int, k: int, shard: int) -> Iterator[pa.RecordBatch]:
    """For each chunk of a bucket one bit for each string of each of its runs: whether a
    smaller id than the chunk's smallest for that run has the string."""
    unpacker = zstandard.ZstdDecompressor()
    for table in runs(batches, ["bucket"]):
        sent = [np.frombuffer(x, "<i4") for x in table.column("sizes").to_pylist()]
        size = np.concatenate(sent).astype("i8")
        body = b"".join(unpacker.decompress(x.as_py(), max_output_size=int(s.sum())) for x, s in zip(table.column("body"), sent))
        own = np.frombuffer(b"".join(table.column("least").to_pylist()), "<i8")
        text, start, counts = np.frombuffer(body, "u1"), np.cumsum(size) - size, size - length + 1
        grams = np.concatenate([Runs._hashes(text[lo : lo + BLOCK + k - 1], k) for lo in range(0, len(text) - k + 1, BLOCK)])
        which, one = distinct_runs(text, start, size, run_hashes(grams, start, size, length, k), length)
        least = np.full(len(one), TOP)
        np.minimum.at(least, which, own)
        some = np.flatnonzero(_partly_shared(grams, start[one], counts[one], length, k))
        flat, begin = np.repeat(least, counts[one]), np.cumsum(counts[one]) - counts[one]
        if len(some):
            strings = [body[s:e] for s, e in zip(start[one[some]].tolist(), (start + size)[one[some]].tolist())]
            del body, text, grams
            n = counts[one[some]]
            flat[np.repeat(begin[some] - np.cumsum(n) + n, n) + np.arange(n.sum())] = np.concatenate(seen_before(strings, least[some], length, shard))
        at = np.repeat(begin[which] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        border = np.r_[0, np.cumsum(counts)][np.cumsum([0, *[len(s) for s in sent]])]
        yield pa.record_batch([*[table.column(c).combine_chunks() for c in ("chunk", "bucket")], pa.array(packed(flat[at] < np.repeat(own, counts), border), pa.binary())], names=["chunk", "bucket", "bits"])


def _partly_shared(grams: np.ndarray, first: np.ndarray, count: np.ndarray, length: int, k: int) -> np.ndarray:
    """Which of distinct runs may share a string with another one: the others have nothing
    to be merged with."""
    low, window = np.uint64((1 << PLACE_BITS) - 1), np.arange(length - k + 1)
    place = np.empty(len(first), "i8")
    for lo in range(0, len(first), 1 << 13):
        part = first[lo : lo + (1 << 13)]
        place[lo : lo + (1 << 13)] = part + np.argmin((grams[part[:, None] + window] & ~low) | (low - window.astype("u8")), axis=1)
    return shared_sides(grams[place], side_hashes(grams, place, first, count, length, k))


def spread(flags: np.ndarray, length: int) -> np.ndarray:
    """Positions covered by a string that starts at a flagged position."""
    covered = np.cumsum(flags, dtype="i4")
    covered[length:] -= covered[:-length].copy()
    return covered > 0


def _cut(batches: Iterator[pa.RecordBatch], length: int, k: int, buckets: int, parts: int, as_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            r = Runs(row, length, k)
            flags = np.zeros(len(r.body), bool)
            if row["bits"]:
                own, border, least = r.candidates(row["masks"], buckets)
                n = r.count[r.one[own]]
                bits, start = unpacked([reply["bits"] for reply in sorted(row["bits"], key=lambda x: x["bucket"])])
                inner = np.cumsum(n) - n
                start = np.repeat(start - inner[border[:-1]], np.diff(border)) + inner
                at = np.full(len(r.keys), -1)
                at[own] = np.arange(len(own))
                run = np.flatnonzero(at[r.of_key] >= 0)
                string, c = at[r.of_key[run]], r.count[run]
                inner = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                # an id above the chunk's smallest for this run has all of it from that one
                later = r.dids[r.doc[run]] > least[string]
                flags[np.repeat(r.first[run], c) + inner] = bits[np.repeat(start[string], c) + inner] | np.repeat(later, c)
            if row["hot_bits"]:
                at, which, _, border, least = r.hot(row["masks"], buckets, parts)
                before = np.zeros(len(least), bool)
                for reply in row["hot_bits"]:
                    s, e = border[reply["bucket"]], border[reply["bucket"] + 1]
                    before[s:e] = np.unpackbits(np.frombuffer(reply["bits"], "u1"), count=int(e - s)).astype(bool)
                doc = np.searchsorted(np.cumsum(r.sizes), at, side="right")
                flags[at] = before[which] | (r.dids[doc] > least[which])
            gone = spread(flags, length)
            ends = np.cumsum(r.sizes)
            starts = ends - r.sizes
            border = gone.copy()  # where a removed run begins
            border[1:] &= ~gone[:-1]
            border[starts[r.sizes > 0]] = gone[starts[r.sizes > 0]]
            n_removed, n_spans = (np.diff(np.r_[0, np.cumsum(x)][np.r_[0, ends]]) for x in (gone, border))
            left = np.frombuffer(r.body, "u1")[~gone].tobytes()
            ends = np.cumsum(r.sizes - n_removed)
            kept = [left[s:e] for s, e in zip((ends - (r.sizes - n_removed)).tolist(), ends.tolist())]
            sha = [hashlib.sha256(x).hexdigest() for x in kept]
            if as_text:
                kept = [x.decode("utf-8", "ignore") for x in kept]
            rest = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rest"])).read_all().combine_chunks()
            columns = [rest.column("row").combine_chunks(), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(r.sizes), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha)]
            yield pa.record_batch([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["row", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, k: int = 20, chunk_bytes: int = 1 << 20, chunk_most: int = 8 << 20,
    bucket_bytes: int = 2 << 20, shard_bytes: int = 1 << 18, as_text: bool = False,
) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts in a document
    with a smaller id. Overlaps count, and strings are judged on the input.

    Returns ``row`` (a struct of every input column but the text), ``kept`` (binary, or with
    ``as_text`` a string without the characters of which bytes were removed), ``n_bytes``,
    ``n_removed``, ``n_spans`` and ``kept_sha256``, one row for each input row.

    A null text counts as empty; texts under ``length`` bytes lose nothing. Rows that share
    an id count as one document and lose nothing to each other. A null id counts as the
    largest id. An empty table gives an empty result. Columns of the input with any name
    stay inside ``row``.
    """
    rest = [c for c in docs.columns if c != text_col]
    rows = packed_rows(docs, id_col, text_col).withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in rest]))
    total = rows.agg(F.sum(F.octet_length("txt"))).first()[0] or 0
    buckets = max(8, math.ceil(total / bucket_bytes))
    # a chunk has a message for each bucket: chunks grow with the number of buckets
    size = min(max(chunk_bytes, buckets << 10), max(chunk_bytes, chunk_most))
    chunks = staged(rows.mapInArrow(lambda it: returning(_chunks(it, size)), CHUNK_SCHEMA), "chunks")

    run_bytes = length + (length - k) // 2

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition("bucket").sortWithinPartitions("bucket", "chunk")

    keys = chunks.mapInArrow(lambda it: returning(_keys(it, length, k, buckets)), "bucket long, chunk long, keys binary, sides binary, flags binary")
    masks = staged(by_bucket(keys).mapInArrow(lambda it: returning(_repeated(it, bucket_bytes, run_bytes)), "chunk long, bucket long, mask binary, hot binary, hot_bytes long"), "masks")
    # a run of hot bytes has at most length - k + 1 strings
    hot_bytes = masks.agg(F.sum("hot_bytes")).first()[0] or 0
    parts = math.ceil(hot_bytes * length * (length - k + 1) / run_bytes / bucket_bytes)
    with_hot = masks.filter("hot_bytes > 0").select("chunk").distinct()
    masks = masks.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "mask", "hot")).alias("masks"))
    sent = chunks.select("chunk", "dids", "sizes", "body").join(masks, "chunk")
    sent = sent.mapInArrow(lambda it: returning(_send(it, length, k, buckets)), "bucket long, chunk long, sizes binary, body binary, least binary")
    bits = staged(by_bucket(sent).mapInArrow(lambda it: returning(_judge(it, length, k, shard_bytes)), "chunk long, bucket long, bits binary"), "bits")
    bits = bits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits"))
    replies = masks.join(bits, "chunk", "left")
    if parts:
        hot = chunks.select("chunk", "dids", "sizes", "body").join(masks.join(with_hot, "chunk"), "chunk")
        hot = hot.mapInArrow(lambda it: returning(_send_hot(it, length, k, buckets, parts)), "bucket long, chunk long, strings binary, least binary")
        hot = staged(by_bucket(hot).mapInArrow(lambda it: returning(_judge_hot(it, length)), "chunk long, bucket long, bits binary"), "hot-bits")
        replies = replies.join(hot.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("hot_bits")), "chunk", "left")
    else:
        replies = replies.withColumn("hot_bits", F.lit(None).cast("array<struct<bucket:bigint,bits:binary>>"))
    told = chunks.select("chunk", "dids", "sizes", "body", "rest").join(replies, "chunk", "left")
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(f"kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").fields])
    return told.mapInArrow(lambda it: returning(_cut(it, length, k, buckets, parts, as_text)), schema)


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    with scratch(spark):
        out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        return kept(out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256"), "repeats")
