"""BPE encoding and decoding by speculation and verification.

Words whose ids are not yet known are handled together, a batch at a time. Greedy longest
match proposes tokens for each word. A proposal is the BPE encoding exactly if every
token is its own encoding and no merge would ever cross the border of two adjacent
tokens; both are tested with array operations over all adjacent pairs of all proposals.
Only words with a failing pair go through the exact merge procedure. The ids of
white-space delimited chunks are remembered by each worker, within a bound.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillpoint.llm.common import order_id
from stillpoint.llm.packing import byte_of_symbol

#: Chunks that a worker remembers; beyond it the memory is emptied.
REMEMBERED = 600_000

#: White space as the vocabulary's own pre-tokenizer has it (a fixed value). Python's
#: str.split() also splits at the four separators below, which count as letters of a
#: word there.
SPACE = "\t\n\v\f\r \x85\xa0  -     　"
ODD = regex.compile("[\x1c-\x1f]")
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+")
NEVER = np.iinfo("i8").max


class WordBpe:
    """A BPE vocabulary with word ends, read from its public file.

    ``ids(texts)`` gives the ids of each text as little-endian unsigned 32-bit integers,
    ``text(ids)`` the decoded text.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.size = size
        self.names = np.full(size, "", dtype=object)
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.names[i] = token
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.rank = np.full(size, -1)
        #: rank by a * size + b, token by rank
        self.merges: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges[x * size + y] = rank
            self.merged.append(z)
            self.left[z], self.right[z], self.rank[z] = x, y, rank
        keys = np.fromiter(self.merges, "i8", len(self.merges))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order
        self.longest = max(map(len, self.vocab))
        self.symbols = {b: c for c, b in byte_of_symbol().items()}
        self.table = {b: self.symbols[b] for b in range(256)}
        self.own = self._own_encoding()
        #: pairs tested before, in order, and whether something crosses their border
        self.tested, self.verdict = np.empty(0, "i8"), np.empty(0, bool)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.known: dict[str, bytes] = {}
        self.exact_words = self.new_words = 0

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; NEVER where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def crossing(self, a: np.ndarray, b: np.ndarray, until: np.ndarray) -> np.ndarray:
        """True where a merge before rank ``until`` would cross the border of a and b.

        The two tokens are taken apart along the border, latest merge first, and each
        state that once stood there is looked up. ``until_a`` and ``until_b`` are the
        ranks at which the current parts are merged away from the border; on a tie the
        merge further left goes first.
        """
        bad = np.zeros(len(a), bool)
        live = np.arange(len(a))
        until_a, until_b = until.copy(), until.copy()
        a, b = a.copy(), b.copy()
        while len(live):
            rank = self._merge_rank(a, b)
            hit = (rank < until_a) & ((rank < until_b) | ((rank == until_b) & (until_b < until[live])))
            bad[live[hit]] = True
            ra, rb = self.rank[a], self.rank[b]
            go = ~hit & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb, until_a, until_b = (x[go] for x in (live, a, b, ra, rb, until_a, until_b))
            first = ra > rb
            until_a, until_b = np.where(first, ra, until_a), np.where(first, until_b, rb)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return bad

    def _own_encoding(self) -> np.ndarray:
        """Tokens that are the encoding of their own string: both parts are, and nothing
        crosses their border before their own merge."""
        own = np.ones(self.size, bool)
        merged = np.flatnonzero(self.rank >= 0)
        bad = self.crossing(self.left[merged], self.right[merged], self.rank[merged])
        own[merged[bad]] = False
        for z in merged[np.argsort(self.rank[merged])]:
            own[z] &= own[self.left[z]] and own[self.right[z]]
        return own

    def exact(self, word: str) -> list[int]:
        """The merge procedure itself: lowest rank first, leftmost on ties."""
        vocab, merges, size = self.vocab, self.merges, self.size
        parts = [vocab[c] for c in word[:-1]]
        parts.append(vocab[word[-1] + self.end])
        ranks = [merges.get(a * size + b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            parts[i] = z = self.merged[best]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merges.get(parts[i - 1] * size + z, NEVER)
            if i < len(ranks):
                ranks[i] = merges.get(z * size + parts[i + 1], NEVER)
        return parts

    def _exact_long(self, word: str) -> list[int]:
        """As ``exact`` for very long words: a heap of pairs over a linked list."""
        import heapq

        parts = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.end]]
        n = len(parts)
        after, before, version = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
        heap: list[tuple] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.merges.get(parts[i] * self.size + parts[j])) is not None:
                heapq.heappush(heap, (rank, i, version[i], version[j]))

        for i in range(n - 1):
            offer(i)
        gone = [False] * n
        while heap:
            rank, i, vi, vj = heapq.heappop(heap)
            j = after[i]
            if gone[i] or version[i] != vi or j >= n or version[j] != vj:
                continue
            parts[i], gone[j] = self.merged[rank], True
            version[i] += 1
            version[j] += 1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p, g in zip(parts, gone) if not g]

    def propose(self, word: str) -> list[int]:
        """Greedy longest match over the word with its end mark."""
        vocab, end, out, i, n = self.vocab, self.end, [], 0, len(word)
        while i < n:
            token = vocab.get(word[i:] + end) if n - i <= self.longest else None
            if token is not None:
                out.append(token)
                break
            for j in range(min(n - 1, i + self.longest), i, -1):
                if (token := vocab.get(word[i:j])) is not None:
                    out.append(token)
                    i = j
                    break
            else:  # the last symbol exists with its end mark only
                out.append(vocab[word[i:] + end])
                break
        return out

    def incompatible(self, pairs: np.ndarray) -> np.ndarray:
        """True for pairs whose tokens are not the encoding of their joint string."""
        keys, where = np.unique(pairs, return_inverse=True)
        at = np.searchsorted(self.tested, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.tested)
        known[inside] = self.tested[at[inside]] == keys[inside]
        bad = np.zeros(len(keys), bool)
        bad[known] = self.verdict[at[known]]
        new = keys[~known]
        bad[~known] = found = self.crossing(new // self.size, new % self.size, np.full(len(new), NEVER))
        if len(self.tested) > 2 * REMEMBERED:
            self.tested, self.verdict = keys, bad
        else:
            self.tested, self.verdict = np.insert(self.tested, at[~known], new), np.insert(self.verdict, at[~known], found)
        return bad[where]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words in the vocabulary's symbols: speculate, verify, repair."""
        if not words:
            return []
        found = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, found), "i8", len(found))
        flat = np.fromiter(chain.from_iterable(found), "i8", int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        failed = np.zeros(len(words), bool)
        failed[owner[~self.own[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        failed[owner[inner[self.incompatible(flat[inner] * self.size + flat[inner + 1])]]] = True
        for i in np.flatnonzero(failed):
            found[i] = self.exact(words[i]) if len(words[i]) < 200 else self._exact_long(words[i])
        self.new_words += len(words)
        self.exact_words += int(failed.sum())
        return found

    def _learn(self, chunks: set[str]) -> None:
        """Remember the ids of new chunks."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = {c: [w.encode().decode("latin-1").translate(self.table) for w in WORD.findall(c)] for c in chunks}
        words = list({w for ws in split.values() for w in ws})
        ids = {w: array("I", x).tobytes() for w, x in zip(words, self.encode_words(words))}
        for c, ws in split.items():
            self.known[c] = b"".join([ids[w] for w in ws])

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case letter by letter."""
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # no final form of sigma: letters are taken one by one
            text = text.replace("Σ", "σ")
        return text.lower()

    def ids(self, texts: list[str]) -> list[bytes]:
        parts: list[list] = []
        for text in texts:
            own: list = []
            for k, span in enumerate(self.splitter.split(text) if any(s in text for s in self.special) else [text]):
                if k % 2:
                    own.append(np.array([self.special[span]], "<u4").tobytes())
                else:
                    span = self.normal(span)
                    own.append(regex.split(f"[{SPACE}]+", span) if ODD.search(span) else span.split())
            parts.append(own)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        if new := {c for own in parts for span in own if isinstance(span, list) for c in span if c not in known}:
            self._learn(new)
        return [b"".join([s if isinstance(s, bytes) else b"".join([known[c] for c in s]) for s in own]) for own in parts]

    def text(self, ids: bytes) -> str:
        """The file names no decoder: tokens are joined by single spaces."""
        return " ".join(self.names[np.frombuffer(ids, "<u4")].tolist())


_LOADED: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One vocabulary for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def _coded(batches: Iterator[pa.RecordBatch], path: str, keep: bool) -> Iterator[pa.RecordBatch]:
    bpe = word_bpe(path)
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            ids = bpe.ids(part.column("txt").to_pylist())
            decoded = [bpe.text(x).encode() for x in ids]
            out = [
                part.column("did"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
            ]
            names = ["did", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                out += [pa.array([np.frombuffer(x, "<u4").astype("i4") for x in ids], pa.list_(pa.int32())), pa.array([x.decode() for x in decoded])]
                names += ["ids", "decoded"]
            yield pa.record_batch(out, names=names)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns ``did``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with
    ``keep_ids``, ``ids`` and ``decoded``, one row for each input row.

    A null text counts as empty; an empty text has no ids and decodes to an empty text.
    Repeated rows give repeated results, a null id the largest id, an empty table an
    empty result. Other columns are not read.
    """
    rows = docs.select(order_id(id_col).alias("did"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("txt"))
    schema = "did long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return rows.mapInArrow(lambda it: _coded(it, tokenizer, keep_ids), schema)


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    out = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_vocabulary(), keep_ids=False)
    return out.withColumnRenamed("did", "doc_id")
