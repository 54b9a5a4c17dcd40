"""Toxicity: a bidirectional gated recurrent network with attention pooling.

The input of a step is a word: its own hashed embedding beside the mean of the hashed
embeddings of its character 3- to 5-grams. A text is cut into overlapping windows that
together cover all of it; each window is read in both directions, pooled by attention and
scored, and the text's score is that of its worst window, calibrated.

The network is trained in numpy, on the driver, on a bounded sample of labelled rows (at
most ``per_class`` rows of each class, and so many characters, taken by hash of the id). A label belongs to a text, not
to a window: each pass scores all windows of the sample and learns from each text's worst
ones. Scoring runs where the texts lie; what a word adds to the gates is computed once
for each distinct word of a worker.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stillpoint.functions.tables import give_back
from stillpoint.llm.common import held_out, order_id, returning
from stillpoint.llm.wordgrams import WORDS, WordTable, grams, sums, word_ids

WORD_BITS, GRAM_BITS, LOW, HIGH = 14, 15, 3, 5
WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
WINDOW, STRIDE = 48, 32
#: Words whose n-grams are computed at a time in training.
BLOCK = 20_000
#: Share of words whose own vector stays in a training step; weight decay.
KEPT, DECAY = 0.3, 0.1


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and length of every window of texts with ``counts`` words. A window
    begins every STRIDE words until one reaches the end; a text without words has one."""
    many = 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(counts)), many)
    start = STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
    return text, start, np.minimum(WINDOW, counts[text] - start)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d, h = WORD_DIM + GRAM_DIM, HIDDEN
    shapes = {"word": (1 << WORD_BITS, WORD_DIM), "gram": (1 << GRAM_BITS, GRAM_DIM), "att_w": (2 * h, ATTENTION), "att_b": (ATTENTION,), "att_v": (ATTENTION,), "out_w": (2 * h,), "out_b": (1,)}
    for side in ("f", "b"):
        shapes |= {f"{side}_w": (d, 3 * h), f"{side}_u": (h, 3 * h), f"{side}_bias": (3 * h,)}
    scale = {"word": 0.3, "gram": 0.3}
    return {k: (rng.normal(size=s) * scale.get(k, 1 / np.sqrt(s[0]))).astype("f4") if len(s) > 1 or k in ("att_v", "out_w") else np.zeros(s, "f4") for k, s in shapes.items()}


def run_side(p: dict, side: str, gates: np.ndarray, mask: np.ndarray, keep: bool):
    """One direction over (steps, windows, 3 * HIDDEN) inputs of the gates. Returns the
    states of all steps and, for training, what the way back needs."""
    h, u = HIDDEN, p[f"{side}_u"]
    states = np.zeros((len(gates) + 1, gates.shape[1], h), "f4")
    cache = []
    steps = range(len(gates)) if side == "f" else range(len(gates) - 1, -1, -1)
    before = np.zeros((gates.shape[1], h), "f4")
    for t in steps:
        hu = before @ u
        zr = sigmoid(gates[t, :, : 2 * h] + hu[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        new = np.tanh(gates[t, :, 2 * h :] + r * hu[:, 2 * h :])
        m = mask[t][:, None]
        after = before + m * (1 - z) * (new - before)
        if keep:
            cache.append((t, before, z, r, new, hu[:, 2 * h :], m))
        states[t] = before = after
    return states[:-1], cache


def back_side(p: dict, side: str, cache: list, d_states: np.ndarray, grad: dict) -> np.ndarray:
    """Gradients of one direction; returns those of the gates' inputs."""
    h, u = HIDDEN, p[f"{side}_u"]
    d_gates = np.zeros((*d_states.shape[:2], 3 * h), "f4")
    carried = np.zeros(d_states.shape[1:], "f4")
    for t, before, z, r, new, hn, m in reversed(cache):
        d = d_states[t] + carried
        dm = d * m
        d_new = dm * (1 - z) * (1 - new**2)
        d_z = -dm * (new - before) * z * (1 - z)
        d_r = d_new * hn * r * (1 - r)
        d_gates[t] = np.concatenate([d_z, d_r, d_new], axis=1)
        d_hu = np.concatenate([d_z, d_r, d_new * r], axis=1)
        grad[f"{side}_u"] += before.T @ d_hu
        carried = d - dm * (1 - z) + d_hu @ u.T
    return d_gates


def pool(p: dict, states: np.ndarray, mask: np.ndarray):
    """Attention over the steps, then the logit of each window."""
    hidden = np.tanh(states @ p["att_w"] + p["att_b"])
    raw = np.where(mask > 0, hidden @ p["att_v"], -1e9)
    weight = np.exp(raw - raw.max(0)) * (mask > 0)
    weight /= np.maximum(weight.sum(0), 1e-9)
    context = (weight[:, :, None] * states).sum(0)
    return context @ p["out_w"] + p["out_b"][0], hidden, weight, context


def gram_table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each word, word after word, and their number for each word."""
    parts = list(grams(words, LOW, HIGH, GRAM_BITS))
    total = sum(c for _, c in parts)
    out = np.empty(int(total.sum()), "i4")
    fill = np.cumsum(total) - total  # where each word's next grams go
    for ids, c in parts:
        out[np.repeat(fill - np.cumsum(c) + c, c) + np.arange(len(ids))] = ids
        fill = fill + c
    return out, total


def all_rows(p: dict, words: list[str]) -> np.ndarray:
    """``word_rows`` of a whole vocabulary, a block at a time."""
    out = np.empty((len(words), 6 * HIDDEN), "f4")
    for i in range(0, len(words), BLOCK):
        out[i : i + BLOCK] = word_rows(p, words[i : i + BLOCK])
    return out


class Trainer:
    """Adam over the network's parameters; words of the sample are rows of a table."""

    def __init__(self, vocabulary: list[str], seed: int = 5):
        self.p = initial(np.random.default_rng(seed))
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0
        self.rng = np.random.default_rng(seed + 1)
        self.word_of = word_ids(vocabulary, WORD_BITS) if vocabulary else np.empty(0, "i8")
        tables = [gram_table(vocabulary[i : i + BLOCK]) for i in range(0, len(vocabulary), BLOCK)]
        self.gram_of = np.concatenate([t for t, _ in tables] or [np.empty(0, "i4")])
        self.gram_n = np.concatenate([c for _, c in tables] or [np.empty(0, "i8")])
        self.gram_at = np.cumsum(self.gram_n) - self.gram_n

    def inputs(self, places: np.ndarray) -> np.ndarray:
        n = self.gram_n[places]
        at = np.repeat(self.gram_at[places] - np.cumsum(n) + n, n) + np.arange(n.sum())
        mean = sums(self.p["gram"][self.gram_of[at]], n) / np.maximum(n, 1)[:, None]
        return np.concatenate([self.p["word"][self.word_of[places]], mean.astype("f4")], axis=1)

    def step(self, places: np.ndarray, mask: np.ndarray, labels: np.ndarray, weights: np.ndarray, rate: float) -> float:
        """One update on windows given as (steps, windows) places in the vocabulary."""
        p = self.p
        own, where = np.unique(places, return_inverse=True)
        x = self.inputs(own)
        stays = (self.rng.random(len(own)) < KEPT)[:, None] / np.float32(KEPT)  # dropout of whole words' own vectors
        x[:, :WORD_DIM] *= stays
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        states, caches = [], []
        for side in ("f", "b"):
            gates = (x @ p[f"{side}_w"] + p[f"{side}_bias"])[where.reshape(places.shape)]
            s, c = run_side(p, side, gates, mask, True)
            states.append(s)
            caches.append(c)
        both = np.concatenate(states, axis=2)
        logit, hidden, weight, context = pool(p, both, mask)
        chance = sigmoid(logit)
        d_logit = ((chance - labels) * weights / weights.sum()).astype("f4")
        grad["out_w"] = context.T @ d_logit
        grad["out_b"][0] = d_logit.sum()
        d_context = d_logit[:, None] * p["out_w"]
        d_weight = (both * d_context).sum(2)
        d_raw = weight * (d_weight - (weight * d_weight).sum(0))
        grad["att_v"] = (hidden * d_raw[:, :, None]).sum((0, 1))
        d_hidden = d_raw[:, :, None] * p["att_v"] * (1 - hidden**2)
        grad["att_b"] = d_hidden.sum((0, 1))
        grad["att_w"] = both.reshape(-1, both.shape[2]).T @ d_hidden.reshape(-1, ATTENTION)
        d_both = weight[:, :, None] * d_context + d_hidden @ p["att_w"].T
        d_x = np.zeros_like(x)
        for k, side in enumerate(("f", "b")):
            d_gates = back_side(p, side, caches[k], d_both[:, :, k * HIDDEN : (k + 1) * HIDDEN], grad)
            flat = d_gates.reshape(-1, 3 * HIDDEN)
            by_word = np.stack([np.bincount(where.ravel(), flat[:, j], len(own)) for j in range(flat.shape[1])], axis=1).astype("f4")
            grad[f"{side}_bias"] = flat.sum(0)
            grad[f"{side}_w"] = x.T @ by_word
            d_x += by_word @ p[f"{side}_w"].T
        np.add.at(grad["word"], self.word_of[own], d_x[:, :WORD_DIM] * stays)
        n = self.gram_n[own]
        at = np.repeat(self.gram_at[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        np.add.at(grad["gram"], self.gram_of[at], np.repeat(d_x[:, WORD_DIM:] / np.maximum(n, 1)[:, None], n, axis=0))
        self.t += 1
        for k, g in grad.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.002 * (g * g - self.v[k])
            fix = np.sqrt(1 - 0.998**self.t) / (1 - 0.9**self.t)
            p[k] -= rate * (fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-8) + DECAY * p[k])
        return float(-(np.log(np.where(labels > 0, chance, 1 - chance) + 1e-7) * weights).sum() / weights.sum())


def word_rows(p: dict, words: list[str]) -> np.ndarray:
    """What each word adds to the gates of both directions."""
    total, n = np.zeros((len(words), GRAM_DIM)), np.zeros(len(words))
    for ids, counts in grams(words, LOW, HIGH, GRAM_BITS):
        total += sums(p["gram"][ids], counts)
        n += counts
    x = np.concatenate([p["word"][word_ids(words, WORD_BITS)], (total / np.maximum(n, 1)[:, None]).astype("f4")], axis=1)
    return np.concatenate([x @ p["f_w"] + p["f_bias"], x @ p["b_w"] + p["b_bias"]], axis=1).astype("f4")


def window_logits(p: dict, rows: np.ndarray, places: np.ndarray, counts: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Logit of every window of texts whose words lie at ``places`` of ``rows``, and the
    text of each window. Windows of like length are scored together."""
    text, start, size = windows(counts)
    begin = (np.cumsum(counts) - counts)[text] + start
    out = np.empty(len(text), "f4")
    order = np.argsort(size, kind="stable")
    for lo in range(0, len(order), block):
        part = order[lo : lo + block]
        steps = np.arange(max(1, size[part].max()))[:, None]
        mask = (steps < size[part]).astype("f4")
        gates = rows[places[np.minimum(begin[part] + steps, len(places) - 1)]] if len(places) else np.zeros((1, len(part), 6 * HIDDEN), "f4")
        both = np.concatenate([run_side(p, s, gates[:, :, k : k + 3 * HIDDEN], mask, False)[0] for s, k in (("f", 0), ("b", 3 * HIDDEN))], axis=2)
        out[part] = pool(p, both, mask)[0]
    return out, text


def worst(logits: np.ndarray, text: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(logits, np.flatnonzero(np.r_[True, text[1:] != text[:-1]])) if len(text) else logits


def train(texts: list[str], labels: np.ndarray, prior: float, epochs: int = 7, most: int = 256) -> tuple[dict, float, float]:
    """Parameters, and slope and offset of the calibration. ``prior`` is the share of
    label 1 among all rows that could be learned from; the loss is weighted to it."""
    rng = np.random.default_rng(3)
    place: dict[str, int] = {}
    counts, flat = [], array("i")  # words as numbers: the words of all texts are never held at once
    for text in texts:
        own = words_of(text)
        counts.append(len(own))
        flat.extend([place.setdefault(w, len(place)) for w in own])
    counts, places, vocabulary = np.array(counts), np.array(flat, "i8"), list(place)
    del place, flat
    trainer = Trainer(vocabulary)
    if not vocabulary or len(set(labels)) < 2:
        return trainer.p, 0.0, float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))
    text, start, size = windows(counts)
    begin = (np.cumsum(counts) - counts)[text] + start
    aside = rng.random(len(labels)) < 0.2  # for the calibration
    batch = min(most, max(16, len(labels) // 20))
    balance = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
    for epoch in range(epochs):
        if epoch:
            rows = all_rows(trainer.p, vocabulary)
            value = window_logits(trainer.p, rows, places, counts)[0] + rng.normal(size=len(text)) * 0.05
            del rows
        else:
            value = rng.normal(size=len(text))
        order = np.lexsort((-value, text))
        first = np.flatnonzero(np.r_[True, text[order][1:] != text[order][:-1]])
        nth = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        chosen = order[nth < (4 if epoch == 0 else 2 if epoch < 3 else 1)]
        chosen = chosen[(size[chosen] > 0) & ~aside[text[chosen]]]
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for part in np.array_split(rng.permutation(chosen), max(1, len(chosen) // batch)):
            steps = np.arange(size[part].max())[:, None]
            mask = (steps < size[part]).astype("f4")
            trainer.step(places[np.minimum(begin[part] + steps, len(places) - 1)], mask, labels[text[part]].astype("f4"), balance[text[part]].astype("f4"), rate)
    rows = all_rows(trainer.p, vocabulary)
    top = worst(*window_logits(trainer.p, rows, places, counts))
    weights = np.where(labels == 1, prior / (labels == 1).mean(), (1 - prior) / (labels == 0).mean())
    if len(set(labels[aside])) < 2:
        aside[:] = True
    return trainer.p, *calibrate(top[aside], labels[aside], weights[aside])


def calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic calibration, by Newton steps with a light ridge."""
    center, spread = x.mean(), x.std() + 1e-6
    feature = np.stack([(x - center) / spread, np.ones_like(x)], axis=1).astype("f8")
    beta = np.zeros(2)
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(feature @ beta, -30, 30)))
        gradient = feature.T @ (w * (chance - y)) + 0.01 * beta
        beta -= np.linalg.solve((feature * (w * chance * (1 - chance))[:, None]).T @ feature + 0.05 * np.eye(2), gradient)
    return float(beta[0] / spread), float(beta[1] - beta[0] * center / spread)


def scores(p: dict, slope: float, offset: float, table: WordTable, texts: list[str]) -> np.ndarray:
    split = [words_of(t) for t in texts]
    counts = np.fromiter(map(len, split), "i8", len(split))
    places = table.look_up(split)  # before the rows are read: new words make new rows
    logits, text = window_logits(p, table.rows, places, counts)
    return 1 / (1 + np.exp(-np.clip(slope * worst(logits, text).astype("f8") + offset, -500, 500)))


def _score(batches: Iterator[pa.RecordBatch], model, threshold: float, clean: bool, text_col: str = "") -> Iterator[pa.RecordBatch]:
    p, slope, offset = model.value
    table = WordTable(lambda words: word_rows(p, words))
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = part.column("row").field(text_col) if clean else part.column("txt")
            score = scores(p, slope, offset, table, [t or "" for t in texts.to_pylist()])
            if clean:
                kept = part.filter(pa.array(score < threshold))
                yield pa.record_batch([kept.column("row")], names=["row"])
            else:
                yield pa.record_batch([part.column("did"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype("i4"))], names=["did", "held_out", "score", "predicted"])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 1500,
    class_chars: int = 8_000_000, modulus: int = 4, remainder: int = 2,
) -> tuple[dict, float, float]:
    """Train on labelled rows: of each class the first by hash of the id, at most
    ``per_class`` rows and, beyond the first, ``class_chars`` characters.

    Held-out ids, null ids and labels other than 0 and 1, null ones included, are not used.
    An id with several labels counts with its largest, one with several texts with one of
    them (the least by hash). Without both labels every text will get the prior."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col, modulus, remainder))
    known = known.groupBy(F.col(id_col).cast("long").alias("did")).agg(F.max(label_col).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    turn = [F.xxhash64("did"), F.col("did")]
    parts = [known.filter(F.col("label") == c).orderBy(*turn).limit(per_class) for c in (0, 1)]
    ids = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * per_class rows
    rows = docs.select(F.col(id_col).cast("long").alias("did"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("txt"))
    rows = rows.join(ids, "did").groupBy("did", "label").agg(F.min_by("txt", F.xxhash64("txt")).alias("txt"))
    order = Window.partitionBy("label").orderBy(*turn)  # at most per_class rows
    rows = rows.withColumn("r", F.row_number().over(order)).withColumn("chars", F.sum(F.length("txt")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sample = rows.filter((F.col("r") == 1) | (F.col("chars") <= class_chars)).select("did", "txt", "label").toPandas().sort_values("did")
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    model = train(sample["txt"].tolist(), sample["label"].to_numpy(), prior)
    del sample
    give_back()  # the driver trains once and stays
    return model


def score_toxicity(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Score every whole text.

    Returns ``did``, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier) and
    ``predicted`` (1 if the score reaches ``threshold``), one row for each input row.

    A null text counts as empty; a text without words is one empty window and has a score.
    A model trained without both labels gives every text the prior. Repeated rows are
    scored each; a null id counts as the largest and is never held out. An empty table
    gives an empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(order_id(id_col).alias("did"), F.col(text_col).cast("string").alias("txt"), held_out(id_col, modulus, remainder).alias("held_out"))
    return rows.mapInArrow(lambda it: returning(_score(it, shared, threshold, False)), "did long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: tuple, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is under ``threshold``.

    Each row is judged by its own text, whatever its id: repeated rows go or stay together.
    A null or empty text is one empty window and has a score like any other. An empty table
    gives an empty result with the same columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(lambda it: returning(_score(it, shared, threshold, True, text_col)), rows.schema).select("row.*")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_toxicity(docs, fit_toxicity(docs, labels)).withColumnRenamed("did", "doc_id")
