"""Quality rules by compression: whole texts and fixed chunks of them must compress neither
too well (repetitive) nor too badly (random), within limits that depend on their length.

Short texts compress badly whatever they say, long ones well, so every band of lengths has
its own limits. Some plain counts of words, symbols and repeats are a base rule before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least bytes, least ratio and largest ratio of each band, longest last. Prose lies between
#: 0.4 and 0.6 from a kilobyte on; six random bits a byte, as of base64, are above 0.75.
BANDS = [(0, 0.0, 99.0), (64, 0.30, 1.35), (128, 0.30, 1.15), (256, 0.30, 0.95), (512, 0.28, 0.83), (1024, 0.25, 0.74), (4096, 0.22, 0.73), (16_384, 0.18, 0.72), (131_072, 0.14, 0.70)]

BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
SYMBOL = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
#: Bytes that begin a code point.
LEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rules:
    """``chunk`` bytes are judged at a time; a text goes if more than ``bad_share`` of its
    chunks lie outside their band. ``window`` words make a repeat."""

    bands: list[tuple[int, float, float]] = field(default_factory=lambda: list(BANDS))
    chunk: int = 2048
    bad_share: float = 0.25
    level: int = 3
    least_words: int = 20
    window: int = 8
    repeat_percent: int = 30

    def within(self, sizes: np.ndarray, ratios: np.ndarray) -> np.ndarray:
        least, low, high = np.array(self.bands).T
        band = np.searchsorted(least, sizes, "right") - 1
        return (ratios >= low[band]) & (ratios <= high[band])


def repeated_words(words: list[bytes], window: int) -> int:
    """Words in windows of ``window`` words that the text has twice or more. Windows are
    numbered exactly, by pairs of numbers of shorter ones."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    single = np.fromiter((seen.setdefault(w, len(seen)) for w in words), "i8", n)
    if len(seen) == n:
        return 0
    ids, span = single, 1
    while span < window:
        more = min(span, window - span)  # the last step overlaps if the window is no power of two
        pair = ids[: len(ids) - more] * (n + 1) + ids[more:]
        ids, span = np.unique(pair, return_inverse=True)[1], span + more
    again = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edge = np.zeros(n + 1, "i8")
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def counts(raw: bytes, window: int) -> list[int]:
    """Words, code points in words, symbols, repeated lines and words in repeats."""
    words = raw.split()
    by_byte = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return [len(words), int(by_byte[LEAD & ~BLANK].sum()), int(by_byte[SYMBOL].sum()), len(lines) - len(set(lines)), repeated_words(words, window)]


def _judge(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    size_of = zstandard.ZstdCompressor(level=rules.level, write_content_size=False, write_checksum=False).compress
    for batch in batches:
        rows = []
        for raw in batch.column("raw").to_pylist():
            raw = raw or b""
            row = counts(raw, rules.window)
            failed = row[0] < rules.least_words or 100 * row[4] > rules.repeat_percent * row[0]
            parts = [raw[i : i + rules.chunk] for i in range(0, len(raw), rules.chunk)]
            if len(parts) > 1 and len(parts[-1]) < rules.chunk // 2:  # a short rest belongs to the last chunk
                parts[-2:] = [parts[-2] + parts[-1]]
            sizes = np.array([len(x) for x in [raw, *parts]])
            ratios = np.array([len(size_of(x)) for x in [raw, *parts]]) / np.maximum(sizes, 1)
            good = rules.within(sizes, ratios)
            bad = int((~good[1:]).sum())
            passed = bool(good[0]) and bad <= rules.bad_share * len(parts)
            rows.append((*row, failed, not failed and passed, float(ratios[0]), len(parts), bad))
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64(), pa.int64(), pa.int64()]
        columns = zip(*rows) if rows else [[]] * len(kinds)
        names = ["doc_id", *COUNTS, "base_failed", "kept", "ratio", "n_chunks", "n_bad_chunks"]
        yield pa.record_batch([batch.column("id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)


SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules | None = None) -> DataFrame:
    """Judge every whole text by its counts and its zstandard ratios.

    Returns ``doc_id``, the counts ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``base_failed`` (too few words, or too large a share
    in repeats), ``kept``, the whole text's ``ratio`` of compressed to plain bytes, and its
    chunks and those outside their band: one row for each input row, without a shuffle.

    A null or empty text has no words and fails. Repeated rows are judged each; a null id
    stays null. An empty table gives an empty result. Other columns are not read.
    """
    rules = rules or Rules()
    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    return raw.mapInArrow(lambda it: _judge(it, rules), SCHEMA)


def op12_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
