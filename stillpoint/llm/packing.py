"""Best-fit packing of documents into token sequences.

A bin has three capacities: tokens, documents, attention cost (the sum of squared piece
lengths). Pieces are placed in descending length; among the bins that satisfy every
constraint the one with the best score wins, the score being either the norm of the
weighted residual capacities after placement (smallest wins) or the weighted dot product
of piece and residual capacities (largest wins).

Tokens are counted where the texts lie; only piece lengths are shuffled, dealt by a hash
into shards of a bounded number of pieces, each packed by one task. A shard wastes at
most its few last bins, so the number of sequences stays within a fraction of a per cent
of one packing over everything.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillpoint.functions.tables import kept, scratch
from stillpoint.llm.common import order_id, returning, staged

#: Chunks that a worker remembers; beyond it the memory is emptied.
REMEMBERED = 300_000

PIECE_SCHEMA = "did long, piece int, start long, length long, ids_crc32 long"


def byte_of_symbol() -> dict[str, int]:
    """The byte that each visible symbol of a byte-level vocabulary stands for: printable
    Latin-1 characters stand for themselves, the other bytes for U+0100 and up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """Ids of a byte-level BPE vocabulary, as little-endian unsigned 32-bit integers.

    A text is split at single spaces. Inside a text whose white space is simple, a piece
    of the vocabulary's pattern never crosses such a split, so the ids of ` chunk` are
    remembered by chunk. A text with other white space next to a space, or with a special
    token, is encoded as a whole.
    """

    #: The pattern of this vocabulary's published pre-tokenizer (a fixed value).
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = byte_of_symbol()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(symbol[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.coder = tiktoken.Encoding("byte-level", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return self.coder.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()

    def _first(self, chunk: str) -> bytes | None:
        """Ids of a chunk; None if it can't be encoded apart from its neighbours."""
        if not chunk or chunk != chunk.strip() or chunk[0].isspace() or chunk[-1].isspace():
            return None
        return np.array(self.coder.encode_ordinary(" " + chunk), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole(text)
        head, *chunks = text.split(" ")
        if not head or head != head.strip():
            return self.whole(text)
        known = self.known
        try:
            found = [known[c] for c in chunks]
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for c in chunks:
                if c not in known:
                    known[c] = self._first(c)
            found = [known[c] for c in chunks]
        if None in found:
            return self.whole(text)
        return np.array(self.coder.encode_ordinary(head), "<u4").tobytes() + b"".join(found)


_LOADED: dict[str, ByteTokens] = {}


def byte_tokens(path: str) -> ByteTokens:
    """One vocabulary for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteTokens(path)
    return _LOADED[path]


def cut(n: int, most: int) -> list[int]:
    """Piece lengths of ``n`` tokens: one piece, or full ones after a shorter first."""
    return [n - most * (math.ceil(n / most) - 1)] + [most] * (math.ceil(n / most) - 1)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, most: int, end_id: int) -> Iterator[pa.RecordBatch]:
    tokens, end = byte_tokens(path), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        out: list[tuple] = []
        for did, text in zip(batch.column("did").to_pylist(), batch.column("txt").to_pylist()):
            ids = memoryview(tokens.ids(text) + end)
            start = 0
            for piece, length in enumerate(cut(len(ids) // 4, most)):
                out.append((did, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                start += length
        columns = list(zip(*out)) or [[]] * 5
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["did", "piece", "start", "length", "ids_crc32"])


def pack(
    lengths: np.ndarray, tokens: int, documents: int, attention: int, weights=(1.0, 1e-3, 1e-3), score: str = "norm"
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, by vector best-fit in descending length.

    ``score``: ``norm`` or ``dot``. A piece that alone breaks a capacity raises.
    """
    order = np.argsort(-lengths, kind="stable")
    capacity = np.array([tokens, documents, attention], "f8")
    need = np.stack([lengths, np.ones_like(lengths), lengths.astype("i8") ** 2], axis=1).astype("f8") / capacity
    if len(need) and need.max() > 1 + 1e-12:
        raise ValueError("a piece is larger than a bin")
    scale = np.sqrt(np.array(weights, "f8"))
    least = need[order[-1]] if len(need) else None
    bins, offsets = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8")
    residual, name = np.empty((len(lengths), 3)), np.empty(len(lengths), "i8")
    open_bins = made = 0
    eps = 1e-9
    for i in order:
        want = need[i]
        at = -1
        if open_bins:
            left = residual[:open_bins]
            fits = np.flatnonzero((left[:, 0] >= want[0] - eps) & (left[:, 1] >= want[1] - eps) & (left[:, 2] >= want[2] - eps))
            if len(fits):
                cand = left[fits]
                value = (((cand - want) * scale) ** 2).sum(1) if score == "norm" else -(cand * want * weights).sum(1)
                at = fits[value.argmin()]
        if at < 0:
            at = open_bins
            residual[at], name[at] = 1.0, made
            open_bins, made = open_bins + 1, made + 1
        bins[i] = name[at]
        offsets[i] = round((1 - residual[at, 0]) * tokens)
        residual[at] -= want
        if (residual[at] < least - eps).any():  # closed: not even the smallest piece fits
            open_bins -= 1
            residual[at], name[at] = residual[open_bins], name[open_bins]
    return bins, offsets


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = 2048, end_id: int = 0,
    documents: int | None = None, attention: int | None = None, weights=(1.0, 1e-3, 1e-3), score: str = "norm", shard_pieces: int = 16_000,
) -> DataFrame:
    """Pack every document into sequences of at most ``tokens`` tokens.

    Returns one row for each piece: ``did`` (the id), ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id`` and ``offset``. Only documents of more than ``tokens``
    tokens (with their end token) are cut, the first piece taking what is over.
    ``documents`` and ``attention`` bound a bin's pieces and its sum of squared lengths;
    None leaves them at what ``tokens`` implies.

    A null or empty text is its end token alone. Rows that repeat an id are packed each.
    A null id counts as the largest. An empty table gives an empty result. Other columns
    are not read.
    """
    documents, attention = documents or tokens, attention or tokens * tokens
    rows = docs.select(order_id(id_col).alias("did"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("txt"))
    with scratch(docs.sparkSession):
        pieces = staged(rows.mapInArrow(lambda it: returning(_pieces(it, tokenizer, tokens, end_id)), PIECE_SCHEMA), "pieces")
        shards = max(1, math.ceil(pieces.count() / shard_pieces))

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "did", "piece"], ascending=[False, True, True], kind="stable")
            bins, pdf["offset"] = pack(pdf["length"].to_numpy(), tokens, documents, attention, weights, score)
            pdf["sequence_id"] = bins * shards + pdf["shard"]
            return pdf[["did", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

        dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("did", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
        return kept(dealt.groupBy("shard").applyInPandas(one, PIECE_SCHEMA + ", sequence_id long, offset long"), "packed")


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    out = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_vocabulary())
    return out.withColumnRenamed("did", "doc_id")
