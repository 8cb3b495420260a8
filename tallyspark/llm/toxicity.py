"""Toxicity scores by a bidirectional gated recurrent network with attention pooling (operator 12).

A word is read twice: by its number in a vocabulary (0 for others), and character by character (bytes of UTF-8) by a
recurrent layer with attention pooling. Both vectors together are a step of a second such layer, which reads a
window of words and gives the chance that the window is toxic. Windows overlap by half, cover the whole text, and
all are scored; a text's score is that of its worst window.

Training is numpy in one task on a bounded sample (``SAMPLE`` labelled rows, ``SPREAD`` windows of each): first on windows
that carry their text's label, then, a few times, on the windows that are worst in their texts so far.
"""

from __future__ import annotations

import pickle
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common, gru, tokens

#: Words in a window, and from one window's start to the next.
WINDOW, STRIDE = 32, 16
#: Bytes of a word that are one input; longer words are several, which overlap by half.
LETTERS = 16
#: Labelled rows that the network is trained on, and windows of each, at most.
SAMPLE, SPREAD = 6000, 24
#: Words that a vocabulary holds at most, and texts of the sample that a word of it stands in at least.
VOCABULARY, LEAST_TEXTS = 10_000, 5
#: Numbers that stand for a character, for a word by its number, and states of a layer in each direction.
CHARACTER, NUMBER, STATES, ATTENTION = 6, 8, 8, 8
#: How strongly word numbers' vectors are drawn to zero, so that words of few texts are not learnt by heart.
DECAY = 1e-5
#: Windows, and words, that go through a layer at a time.
BATCH = 2048


def words_of(text: bytes) -> list[bytes]:
    """Inputs of a text: its words, A-Z lower-cased, long ones in overlapping pieces."""
    words = text.lower().split()  # these know A-Z and the six kinds of white space only
    if any(len(w) > LETTERS for w in words):
        half = LETTERS // 2
        words = [w[i : i + LETTERS] for w in words for i in range(0, max(1, len(w) - half), half)]
    return words


def window_starts(n: int) -> np.ndarray:
    """Where the windows of n words start: every STRIDE words, until one reaches the end."""
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (T, N) of words, and which are there (T, N, 1)."""
    size = np.array([len(w) for w in words])
    mask = np.arange(max(1, size.max(initial=0)))[:, None] < size
    out = np.zeros(mask.shape, np.int64)
    out.T[mask.T] = np.frombuffer(b"".join(words), np.uint8)
    return out, mask[:, :, None]


def added(places: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Vectors (..., d) added up by place."""
    flat, rows = places.ravel(), values.reshape(-1, values.shape[-1])
    return np.stack([np.bincount(flat, column, size) for column in rows.T], axis=1).astype(values.dtype)


class Network:
    """Parameters and vocabulary; ``score`` needs nothing else."""

    def __init__(self, vocabulary: list[bytes], prior: float, seed: int = 12):
        rng = np.random.default_rng(seed)
        self.vocabulary = {w: i for i, w in enumerate(vocabulary, 1)}
        small = lambda *shape: (0.1 * rng.standard_normal(shape)).astype(np.float32)
        self.p = gru.new_layer(rng, "letters", CHARACTER, STATES, ATTENTION) | gru.new_layer(rng, "words", NUMBER + 2 * STATES, STATES, ATTENTION)
        self.p |= {"character": 5 * small(256, CHARACTER), "number": small(len(vocabulary) + 1, NUMBER), "out": small(2 * STATES), "bias": np.array([np.log(prior / (1 - prior))], np.float32)}
        self.p["number"][0] = 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.array([self.vocabulary.get(w, 0) for w in words], np.int64)

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """The vectors that the first layer reads from words' characters; words of like length go together."""
        out = np.zeros((len(words), 2 * STATES), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        table = gru.projected(self.p, "letters", self.p["character"])
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            chars, mask = letters([words[i] for i in part])
            out[part] = gru.forward(self.p, "letters", {side: x[chars] for side, x in table.items()}, mask)
        return out

    def chances(self, words: list[bytes], windows: np.ndarray) -> np.ndarray:
        """The chance of each window (N, T), given as places in ``words``, -1 where there is no word."""
        inputs = np.concatenate([self.p["number"][self.numbers(words)], self.spelled(words)], axis=1)
        table = gru.projected(self.p, "words", np.concatenate([inputs, np.zeros((1, inputs.shape[1]), np.float32)]))
        out = np.empty(len(windows), np.float32)
        for at in range(0, len(windows), BATCH):
            part = np.ascontiguousarray(windows[at : at + BATCH].T)
            pooled = gru.forward(self.p, "words", {side: x[part] for side, x in table.items()}, (part >= 0)[:, :, None])
            out[at : at + BATCH] = pooled @ self.p["out"] + self.p["bias"]
        return 1 / (1 + np.exp(-out.astype(np.float64)))

    def learn(self, words: list[bytes], windows: np.ndarray, labels: np.ndarray, optimiser: gru.Adam, rng: np.random.Generator) -> float:
        """One step on windows (N, T) with labels; the loss. Half of the words are read by their characters only."""
        used, inverse = np.unique(windows, return_inverse=True)
        inverse = inverse.reshape(windows.shape).T
        here = [words[i] if i >= 0 else b"" for i in used.tolist()]
        chars, there = letters(here)
        of_chars = self.p["character"][chars]
        spelled, kept_letters = gru.forward(self.p, "letters", gru.projected(self.p, "letters", of_chars), there, keep=True)
        numbers = self.numbers(here)[inverse]
        numbers[rng.random(numbers.shape) < 0.5] = 0
        mask = (windows.T >= 0)[:, :, None]
        x = np.concatenate([self.p["number"][numbers], spelled[inverse]], axis=2)
        pooled, kept = gru.forward(self.p, "words", gru.projected(self.p, "words", x), mask, keep=True)
        chance = 1 / (1 + np.exp(-(pooled @ self.p["out"] + self.p["bias"])))
        error = ((chance - labels) / len(labels)).astype(pooled.dtype)
        grads: gru.Params = {"out": pooled.T @ error, "bias": error.sum(keepdims=True)}
        of_x = gru.backward(self.p, "words", x, mask, kept, error[:, None] * self.p["out"], grads)
        grads["number"] = added(numbers, of_x[:, :, :NUMBER], len(self.p["number"])) + DECAY * self.p["number"]
        grads["number"][0] = 0
        of_spelled = added(inverse, of_x[:, :, NUMBER:], len(spelled))
        of_chars = gru.backward(self.p, "letters", of_chars, there, kept_letters, of_spelled, grads)
        grads["character"] = added(chars, of_chars, 256)
        optimiser.step(grads)
        return float(-np.mean(np.log(np.maximum(1e-9, np.where(labels > 0.5, chance, 1 - chance)))))


def fit(texts: list[list[list[bytes]]], labels: np.ndarray, epochs: int = 12, rounds: int = 3, batch: int = 64) -> Network:
    """A network from texts given as lists of windows of words. Texts come in a set order; reruns agree."""
    held: dict[bytes, int] = {}
    for windows in texts:
        for w in {w for window in windows for w in window}:
            held[w] = held.get(w, 0) + 1
    often = sorted((w for w, n in held.items() if n >= LEAST_TEXTS), key=lambda w: (-held[w], w))[:VOCABULARY]
    network = Network(often, float(np.clip(labels.mean(), 0.01, 0.99)))
    words = sorted(held)
    place = {w: i for i, w in enumerate(words)}
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    windows = np.full((owner.size, WINDOW), -1, np.int64)
    for row, window in zip(windows, (w for t in texts for w in t), strict=True):
        row[: len(window)] = [place[w] for w in window]
    rng, optimiser = np.random.default_rng(5), gru.Adam(network.p, 0.01)

    def train(chosen: np.ndarray, times: int) -> None:
        for _ in range(times):
            order = rng.permutation(chosen)
            for at in range(0, order.size, batch):
                part = order[at : at + batch]
                network.learn(words, windows[part], labels[owner[part]], optimiser, rng)

    # small samples go round more often, each time with two windows of a text on average
    for _ in range(int(np.clip(36_000 / (2 * len(texts)), 3, epochs))):
        train(np.flatnonzero(rng.random(owner.size) < 2 * len(texts) / owner.size), 1)
    for turn in range(rounds):
        optimiser.rate = 0.01 / (1 + turn)
        chance = network.chances(words, windows)
        worst = np.lexsort((chance, owner))[np.cumsum(np.bincount(owner, minlength=len(texts))) - 1]
        train(worst, 1)
    return network


def held_out() -> Column:
    """Whether a row's label is kept from training: crc32 of its decimal doc_id divides by 5; a missing doc_id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes | None:
    """A network trained on the labels (doc_id, toxic) that are not held out; None where there is none of one kind.

    At most ``sample`` labelled doc_ids take part, those of least hash; of rows that share a doc_id the one whose text has
    the least hash. Of each at most SPREAD windows are taken, spread by a seed of the text.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    chosen = known.orderBy(common.order_hash(F.col("doc_id")), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().cast("binary").alias("body")).join(F.broadcast(chosen), "doc_id")

    def windows(batches):
        for batch in common.slices(batches, "body"):
            out = []
            for body in batch["body"].to_pylist():
                words = words_of(body)
                starts = window_starts(len(words))
                seed = tokens.ranges(tokens.prefix(tokens.word_hashes(np.frombuffer(body, np.uint8), True)), np.zeros(1, np.int64), np.full(1, len(body.split())))[0]
                picked = np.sort(random.Random(int(seed)).sample(starts.tolist(), min(SPREAD, starts.size)))
                out.append([b" ".join(words[s : s + WINDOW]) for s in picked.tolist()])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(out, pa.list_(pa.binary()))], names=["doc_id", "label", "windows"])

    cut = rows.select("doc_id", "label", "body").mapInArrow(windows, "doc_id long, label int, windows array<binary>")
    one = cut.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("windows").alias("tie"), "label", "windows")).alias("row")).select("doc_id", "row.label", "row.windows")

    def run(pdf):
        pdf = pdf.sort_values("doc_id")
        labels_ = pdf["label"].to_numpy(np.float32)
        if labels_.min() == labels_.max():
            return pd.DataFrame({"network": [None]})
        made = fit([[w.split() for w in ws] for ws in pdf["windows"]], labels_)
        return pd.DataFrame({"network": [pickle.dumps(made)]})

    # SAMPLE texts of SPREAD windows at most: bounded for one task
    made = one.groupBy(F.lit(0).alias("all")).applyInPandas(run, "network binary").collect()
    return bytes(made[0]["network"]) if made and made[0]["network"] is not None else None


def score(docs: DataFrame, network: bytes | None) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_windows, worst_word) of each whole text.

    score is the chance of the worst window, which starts at word worst_word; a text without words is one empty window.
    Without a network (no labels, or of one kind only) all scores are 0. Scores read the text only; equal texts get equal
    scores up to rounding. Rows with a missing or repeated doc_id are rows like others. An empty table gives no
    rows. Other columns are not read.
    """

    def run(batches):
        net = pickle.loads(network) if network is not None else None
        for batch in common.slices(batches, "body"):
            known: dict[bytes, int] = {}
            texts = [np.array([known.setdefault(w, len(known)) for w in words_of(body)], np.int64) for body in batch["body"].to_pylist()]
            starts = [window_starts(x.size) for x in texts]
            count = np.array([s.size for s in starts])
            first = np.cumsum(count) - count
            before = np.cumsum([0, *(x.size for x in texts)])
            flat = np.concatenate([*texts, np.full(WINDOW, -1)])
            at = np.concatenate(starts)[:, None] + np.arange(WINDOW)
            inside = at < np.repeat(np.diff(before), count)[:, None]
            windows = np.where(inside, flat[np.minimum(at + np.repeat(before[:-1], count)[:, None], flat.size - 1)], -1)
            chance = net.chances(list(known), windows) if net is not None else np.zeros(len(windows))
            best = np.maximum.reduceat(chance, first)
            is_best = np.flatnonzero(chance == np.repeat(best, count))
            owner = np.repeat(np.arange(count.size), count)
            worst = np.full(count.size, chance.size)
            np.minimum.at(worst, owner[is_best], is_best)
            word = np.concatenate(starts)[worst]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(best), pa.array((best >= 0.5).astype(np.int32)), pa.array(count), pa.array(word)], names=["doc_id", "held_out", "score", "predicted", "n_windows", "worst_word"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), common.whole_text().cast("binary").alias("body"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_windows long, worst_word long")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
