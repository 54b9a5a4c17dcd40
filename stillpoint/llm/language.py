"""Language identification: sparse multinomial logistic regression on TF-IDF character
n-grams, fitted by follow-the-regularised-leader with elastic net, then calibrated by a
temperature.

Features are hashed n-grams of 1 to 4 characters of lower-cased words with their borders;
the term frequency is relative to all n-grams of the text. A logit is linear in the
counts, so each distinct word contributes a fixed row that is computed once per worker.

Document frequencies cover every learnable document. The classifier is fitted on a sample
of at most ``per_language`` documents and ``language_chars`` characters of each language,
taken by hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stillpoint.llm.common import held_out, order_id
from stillpoint.llm.wordgrams import LETTERS, WordTable, grams, sums

BITS, LOW, HIGH = 15, 1, 4
#: Relative frequencies are small; this brings the features near 1.
SCALE = 200.0


def letters(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each partition: in how many texts each feature occurs."""
    found = np.zeros(1 << BITS, "i8")
    texts_seen = 0
    for batch in batches:
        texts = batch.column("txt").to_pylist()
        for lo in range(0, len(texts), 64):
            words = [list(dict.fromkeys(letters(t or ""))) for t in texts[lo : lo + 64]]
            flat = [w for ws in words for w in ws]
            if flat:
                owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
                seen = np.zeros((len(words), 1 << BITS), bool)
                for ids, counts in grams(flat, LOW, HIGH, BITS):
                    seen[np.repeat(owner, counts), ids] = True
                found += seen.sum(0)
        texts_seen += len(texts)
    at = np.flatnonzero(found)
    yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(found[at], texts_seen))], names=["feature", "n"])


def features(words: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and TF-IDF values of one text."""
    if not words:
        return np.empty(0, "i8"), np.empty(0)
    ids = np.concatenate([i for i, _ in grams(words, LOW, HIGH, BITS)])
    at, counts = np.unique(ids, return_counts=True)
    return at, SCALE * counts / len(ids) * idf[at]


class Ftrl:
    """Multinomial logistic regression, follow-the-regularised-leader (proximal), with
    elastic net. Weights under the l1 threshold are exactly zero."""

    def __init__(self, classes: int, alpha=0.3, beta=1.0, l1=0.02, l2=0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((2, (1 << BITS) + 1, classes))

    @property
    def weights(self) -> np.ndarray:
        z = self.z
        out = np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n)) / self.alpha + self.l2))
        out[-1] = -z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha)  # the bias isn't penalised
        return out

    def step(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        weights = self.weights
        ids = np.concatenate([i for i, _ in rows])
        values = np.concatenate([v for _, v in rows])
        counts = np.array([len(i) for i, _ in rows])
        logits = sums(values[:, None] * weights[ids], counts) + weights[-1]
        error = softmax(logits)
        error[np.arange(len(rows)), labels] -= 1
        each = np.repeat(error, counts, axis=0) * values[:, None]
        gradient = np.stack([np.bincount(ids, each[:, c], len(self.z)) for c in range(each.shape[1])], axis=1)
        gradient[-1] = error.sum(0)
        gradient /= len(rows)
        sigma = (np.sqrt(self.n + gradient**2) - np.sqrt(self.n)) / self.alpha
        self.z += gradient - sigma * weights
        self.n += gradient**2


def softmax(logits: np.ndarray) -> np.ndarray:
    out = np.exp(logits - logits.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: np.ndarray, classes: int, idf: np.ndarray, epochs: int = 6) -> tuple[np.ndarray, float]:
    """Weights (the last row is the bias) and the temperature, the latter from a fifth of
    the rows that the weights were not fitted on."""
    rows = [features(letters(t), idf) for t in texts]
    turn = np.random.default_rng(7).permutation(len(rows))
    check, learn = turn[: len(turn) // 5], turn[len(turn) // 5 :]
    model = Ftrl(classes)
    rng = np.random.default_rng(11)
    for _ in range(epochs if len(learn) else 0):
        for part in np.array_split(rng.permutation(learn), max(1, len(learn) // 32)):
            model.step([rows[i] for i in part], labels[part])
    weights, temperature = model.weights, 1.0
    if len(check):
        logits = np.stack([v @ weights[i] + weights[-1] for i, v in (rows[j] for j in check)])
        loss = {t: -np.log(softmax(logits / t)[np.arange(len(check)), labels[check]] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
        temperature = float(min(loss, key=loss.get))
    return weights, temperature


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    names, idf, weights, temperature = model.value
    by_feature = np.concatenate([SCALE * idf[:, None] * weights[:-1], np.ones((len(idf), 1))], axis=1)

    def rows(words: list[str]) -> np.ndarray:
        return sum(sums(by_feature[ids], counts) for ids, counts in grams(words, LOW, HIGH, BITS))

    table = WordTable(rows)
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            words = [letters(t or "") for t in part.column("txt").to_pylist()]
            counts = np.fromiter(map(len, words), "i8", len(words))
            at = table.look_up(words)
            if len(at) and names:
                total = sums(table.rows[at], counts)
                chance = softmax((total[:, :-1] / np.maximum(total[:, -1:], 1) + weights[-1]) / temperature)
                best = chance.argmax(1)
                lang = [names[b] if n else "und" for b, n in zip(best, counts)]
                score = np.where(counts > 0, chance[np.arange(len(best)), best], 0.0)
            else:
                lang, score = ["und"] * len(words), np.zeros(len(words))
            yield pa.record_batch([part.column("did"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], names=["did", "held_out", "lang_pred", "score"])


def fitting_sample(learnable: DataFrame, per_language: int, language_chars: int, salts: int = 16, longest: int | None = None) -> DataFrame:
    """(``did``, ``txt``, ``lang``) rows, of each language the first by hash of the id: at
    most ``per_language`` of them, and no more characters than ``language_chars`` beyond the
    first. Rows without an id, and texts of more than ``longest`` characters, take no part;
    rows that share id and text are one.

    Ranks are taken in two steps, inside a salt of a language and then over what is left,
    so that no task has more than ``salts`` times ``per_language`` keys of a language in the
    last step, however frequent it is; the texts join the chosen keys at the end."""
    keys = learnable.filter("id_known").select("lang", "did", F.xxhash64("txt").alias("h"), F.length("txt").alias("n"))
    keys = keys.filter(F.col("n") <= longest) if longest is not None else keys
    keys = keys.groupBy("lang", "did", "h").agg(F.max("n").alias("n")).withColumn("turn", F.xxhash64("did"))
    order = [F.col("turn"), F.col("did"), F.col("h")]
    part = Window.partitionBy("lang", F.pmod("turn", F.lit(salts))).orderBy(*order)
    some = keys.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= per_language)
    whole = Window.partitionBy("lang").orderBy(*order)
    some = some.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= per_language)
    some = some.withColumn("chars", F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = some.filter((F.col("r") == 1) | (F.col("chars") <= language_chars)).select("lang", "did", "h")
    rows = learnable.filter("id_known").select("lang", "did", F.xxhash64("txt").alias("h"), "txt")
    rows = rows.join(F.broadcast(chosen), ["lang", "did", "h"], "left_semi")  # at most per_language keys a language
    return rows.groupBy("lang", "did", "h").agg(F.first("txt").alias("txt")).select("did", "txt", "lang")


def _rows(docs: DataFrame, id_col: str, text_col: str, modulus: int, remainder: int, *more) -> DataFrame:
    return docs.select(order_id(id_col).alias("did"), F.col(text_col).cast("string").alias("txt"), held_out(id_col, modulus, remainder).alias("held_out"), *more)


def fit_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600, language_chars: int = 6_000_000,
    most_languages: int = 256, most_chars: int = 24_000_000, modulus: int = 4, remainder: int = 2,
) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Languages, inverse document frequencies, weights and temperature.

    Rows with crc32(id as text) mod ``modulus`` = ``remainder`` are held out: nothing is
    learned from them, nor from rows without text or language. Document frequencies count
    all others. The weights are fitted on their ``fitting_sample``, at most ``per_language``
    rows and ``language_chars`` characters of a language, and ``most_chars`` of all, shared
    evenly: a text longer than its language's share isn't fitted on. More than
    ``most_languages`` languages are an error."""
    rows = _rows(docs, id_col, text_col, modulus, remainder, F.col(lang_col).cast("string").alias("lang"), F.col(id_col).isNotNull().alias("id_known"))
    learnable = rows.filter(~F.col("held_out") & F.col("txt").isNotNull() & F.col("lang").isNotNull())
    n_languages = learnable.select("lang").distinct().limit(most_languages + 1).count()
    if n_languages > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    counted = learnable.select("txt").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    idf = np.zeros(1 << BITS)
    seen = {r["feature"]: r["n"] for r in counted.collect()}  # at most 2^BITS + 1 rows
    n_docs = seen.pop(-1, 0)
    for k, n in seen.items():
        idf[k] = np.log((1 + n_docs) / (1 + n)) + 0.1
    share = most_chars // max(1, n_languages)
    sample = fitting_sample(learnable, per_language, min(language_chars, share), longest=share).toPandas().sort_values(["did", "txt"])
    names = sorted(sample["lang"].unique())
    weights, temperature = fit(sample["txt"].tolist(), sample["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(), len(names), idf)
    return names, idf, weights, temperature


def identify_language(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Predict the language of every whole text with a model of ``fit_language``.

    Returns ``did``, ``held_out``, ``lang_pred``, ``score`` (the calibrated probability of
    the predicted language), one row for each input row.

    A null text, or one without a letter (Unicode category L), is ``und`` with score 0; so
    is every text if there was no language to learn from. Repeated rows are predicted each;
    a null id counts as the largest and is never held out. An empty table gives an empty
    result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = _rows(docs, id_col, text_col, modulus, remainder)
    return rows.select("did", "txt", "held_out").mapInArrow(lambda it: _predict(it, shared), "did long, held_out boolean, lang_pred string, score double")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify_language(docs, fit_language(docs)).withColumnRenamed("did", "doc_id")
