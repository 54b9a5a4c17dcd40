"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class is a Gaussian over transformed statistics of whole texts. Class covariances
are shrunk towards their pooled covariance and towards a multiple of the identity, and
factored once; a score is the difference of the two Mahalanobis log-densities.

Counts, means and scatter matrices are sums over every labelled row that may be learned
from: each partition adds up its own, so the fit moves a few numbers a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillpoint.functions.tables import kept, scratch
from stillpoint.llm.common import held_out, order_id, staged

STATISTICS = [
    "log_bytes", "log_words", "word_length", "distinct_words", "commonest_word", "repeated_neighbours", "upper", "digits", "symbols", "pipes",
    "exclamations", "spaces", "distinct_lines", "line_words", "entropy", "plain_words", "short_words",
]
UPPER, LOWER, DIGIT = (np.array([chr(b) in s for b in range(256)]) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"))
SYMBOL = np.array([chr(b) in "#$%&*+-/<=>@[\\]^_`{|}~" for b in range(256)])


def share(part: float, whole: float) -> float:
    """log-odds of a share, held away from 0 and 1."""
    p = min(max((part + 0.02) / (whole + 0.04 + 1e-9), 0.0005), 0.9995)
    return float(np.log(p / (1 - p)))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text; an empty text has them too."""
    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, size = len(words), len(raw)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    chance = count[count > 0] / max(size, 1)
    ends = sum(map(str.isalpha, words))
    return [
        np.log1p(size), np.log1p(n), np.log1p(size / max(n, 1)), share(len(seen), n) / np.log(n + 3), share(max(seen.values(), default=0), n),
        share(sum(map(str.__eq__, words, words[1:])), n), share(count[UPPER].sum(), size), share(count[DIGIT].sum(), size),
        share(count[SYMBOL].sum(), size), share(count[124], n), share(count[33], n), share(count[32], size), share(len(set(lines)), len(lines)),
        np.log1p(n / max(len(lines), 1)), float(-(chance * np.log(chance)).sum()), share(ends, n), share(sum(len(w) < 4 for w in words), n),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([statistics(t or "") for t in batch.column("txt").to_pylist()], "f8").reshape(batch.num_rows, len(STATISTICS))
        yield pa.record_batch([batch.column("did"), batch.column("held_out"), *[pa.array(c) for c in x.T.copy()]], names=["did", "held_out", *STATISTICS])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and products of each class, as (class, i, j, value) rows."""
    d = len(STATISTICS)
    total = np.zeros((2, d + 1, d + 1))
    for batch in batches:
        x = np.stack([np.asarray(batch.column(c)) for c in STATISTICS] + [np.ones(batch.num_rows)], axis=1)
        y = np.asarray(batch.column("label"))
        for c in (0, 1):
            total[c] += x[y == c].T @ x[y == c]
    c, i, j = (a.ravel() for a in np.indices(total.shape))
    yield pa.record_batch([pa.array(c), pa.array(i), pa.array(j), pa.array(total.ravel())], names=["c", "i", "j", "v"])


class Discriminant:
    """Two Gaussians with shrunk covariances and cached Cholesky factors."""

    def __init__(self, moments: np.ndarray, pooled: float, identity: float):
        n = moments[:, -1, -1]
        mean = moments[:, :-1, -1] / np.maximum(n, 1)[:, None]
        cov = moments[:, :-1, :-1] / np.maximum(n, 1)[:, None, None] - mean[:, :, None] * mean[:, None, :]
        both = (cov * n[:, None, None]).sum(0) / max(n.sum(), 1)
        d = cov.shape[1]
        self.prior = np.log((n + 1) / (n.sum() + 2))
        self.mean, self.inverse, self.log_det = mean, [], []
        for c in (0, 1):
            s = (1 - pooled) * cov[c] + pooled * both
            s = (1 - identity) * s + identity * (np.trace(s) / d + 1e-6) * np.eye(d)
            chol = np.linalg.cholesky(s)
            self.inverse.append(np.linalg.inv(chol))
            self.log_det.append(2 * np.log(np.diag(chol)).sum())

    def score(self, x: np.ndarray, temper: float = 1.0) -> np.ndarray:
        """Probability of class 1: the log-density difference through a sigmoid."""
        density = [-0.5 * (((x - self.mean[c]) @ self.inverse[c].T) ** 2).sum(1) - 0.5 * self.log_det[c] + self.prior[c] for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(temper * (density[1] - density[0]), -500, 500)))


def _score(batches: Iterator[pa.RecordBatch], model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.stack([np.asarray(batch.column(c)) for c in STATISTICS], axis=1)
        score = model.value.score(x)
        out = [batch.column("did"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype("i4"))]
        yield pa.record_batch(out, names=["did", "held_out", "score", "predicted"])


def classify_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5,
    pooled: float = 0.05, identity: float = 0.01, modulus: int = 3, remainder: int = 1,
) -> DataFrame:
    """Score every whole text for quality.

    Returns ``did``, ``held_out``, ``score`` (0 to 1, the probability of label 1) and
    ``predicted`` (1 if the score reaches ``threshold``), one row for each input row.

    Rows with crc32(id as text) mod ``modulus`` = ``remainder`` are held out: their labels
    are not learned from. Labels other than 0 and 1, null ones included, are not used; an
    id with several labels counts with its smallest. Without any label every score is
    near 0.5. A null text counts as empty and has a score. Repeated rows are scored each;
    a null id counts as the largest, is never held out and has no label. An empty table
    gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(order_id(id_col).alias("did"), F.col(text_col).cast("string").alias("txt"), held_out(id_col, modulus, remainder).alias("held_out"))
    schema = "did long, held_out boolean, " + ", ".join(f"{c} double" for c in STATISTICS)
    with scratch(spark):
        measured = staged(rows.mapInArrow(_statistics, schema), "quality-statistics")
        known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        known = known.groupBy(F.col(id_col).cast("long").alias("did")).agg(F.min(label_col).cast("int").alias("label"))
        learn = measured.filter(~F.col("held_out")).join(known, "did").select(*STATISTICS, "label")
        moments = np.zeros((2, len(STATISTICS) + 1, len(STATISTICS) + 1))
        summed = learn.mapInArrow(_moments, "c long, i long, j long, v double").groupBy("c", "i", "j").agg(F.sum("v").alias("v"))
        for r in summed.collect():  # a fixed number of rows
            moments[r["c"], r["i"], r["j"]] = r["v"]
        model = spark.sparkContext.broadcast(Discriminant(moments, pooled, identity))
        return kept(measured.mapInArrow(lambda it: _score(it, model, threshold), "did long, held_out boolean, score double, predicted int"), "quality")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify_quality(docs, labels).withColumnRenamed("did", "doc_id")
