"""Quality classifier from weak labels (operator 1).

Heuristic labellers vote on each document or do not: seven know one kind of junk each and vote bad, one
votes good where nothing looks odd. They overlap, and none is always right. Expectation-maximisation over
the counts of vote patterns (there are at most 2**8, whatever the corpus) estimates how often each votes
on good and on bad documents and gives every pattern a posterior. Posteriors label a bounded sample of documents, on which a hashed
linear scorer is trained; the scorer rates every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common, tokens

U = np.uint64

#: About this many documents (by a hash of doc_id and text) train the scorer; statistics and votes cover all documents.
SAMPLE = 20_000
TRAINERS = 8
BITS = 15
KEEP_FROM = 0.5
PRIOR = 0.002

#: Words in a window that "sameness" counts distinct words in.
WINDOW = 2000

#: (name, bad from, plain to): a statistic at or above the one is a vote for bad; "clean" votes good where no
#: statistic is above the other.
LABELLERS = (
    ("symbols", 0.04, 0.01),
    ("shouting", 0.02, 0.005),
    ("capitals", 0.5, 0.2),
    ("sameness", 0.85, 0.7),
    ("repeats", 0.3, 0.1),
    ("word_length", 6.0, 4.0),
    ("loners", 0.1, 0.02),
)
_MAJOR = np.zeros(256, bool)
_MAJOR[65:91] = True
_MINOR = np.zeros(256, bool)
_MINOR[97:123] = True
_PLAIN = np.zeros(256, bool)  # letters, digits, other scripts
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SYMBOL = ~_PLAIN & ~tokens.SPACE
_SYMBOL[[ord(c) for c in ".,;:'\"-()?!"]] = False


def sameness(words: np.ndarray) -> float:
    """One less distinct/total, averaged over the fewest windows of WINDOW words that cover all words.

    Distinct words grow slower than words, so a fixed window keeps short and long documents comparable.
    The windows are spread evenly from the first word to the last; a document shorter than one is a window itself.
    """
    size = min(WINDOW, words.size)
    starts = np.linspace(0, words.size - size, -(-words.size // size)).astype(np.int64)
    return float(np.mean([1 - np.unique(words[at : at + size]).size / size for at in starts.tolist()]))


def statistics(buf: np.ndarray) -> np.ndarray:
    """One number for each labeller; not a number where it has nothing to go by."""
    out = np.full(len(LABELLERS), np.nan)
    counts = np.bincount(buf, minlength=256)
    solid = counts.sum() - counts[tokens.SPACE].sum()
    if not solid:
        return out
    letters = counts[_MAJOR].sum() + counts[_MINOR].sum()
    words = tokens.word_hashes(buf, fold=True)
    out[0] = counts[_SYMBOL].sum() / solid
    out[1] = counts[ord("!")] / solid
    out[2] = counts[_MAJOR].sum() / letters if letters else np.nan
    if words.size >= 40:
        out[3] = sameness(words)
        start = np.arange(words.size - 4)
        out[4] = 1 - np.unique(tokens.ranges(tokens.prefix(words), start, start + 5)).size / start.size
    out[5] = abs(solid / words.size - 6)
    plain = np.concatenate(([0], np.cumsum(_PLAIN[buf])))
    first, last = tokens.word_bounds(buf)
    out[6] = (plain[last] == plain[first]).mean()
    return out


_BAD, _PLAIN_TO = np.array([x[1] for x in LABELLERS]), np.array([x[2] for x in LABELLERS])
N_VOTES = len(LABELLERS) + 1


def votes(stats: np.ndarray) -> np.ndarray:
    """Whether each labeller votes; the last one is "clean"."""
    odd = stats > _PLAIN_TO  # what is not a number is neither
    return np.append(stats >= _BAD, not odd.any() and not np.isnan(stats).all())


def pattern(vote: np.ndarray) -> int:
    return int((vote << np.arange(N_VOTES)).sum())


def expectation_maximisation(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """The posterior of good for each vote pattern, from how often patterns occur.

    Each labeller has its own chance to vote on good and on bad documents; votes are taken as independent
    given the quality. The start takes a document with votes for bad as bad, one with a vote for good as
    good. A weak prior (PRIOR of the documents) holds a labeller to vote more often where it is right.
    """
    if not counts:
        return {}
    n = np.array(list(counts.values()), float)
    cast = (np.array(list(counts))[:, None] >> np.arange(N_VOTES)) & 1
    one = np.stack([1 - cast, cast], axis=2).astype(float)
    post = np.where(cast[:, :-1].any(axis=1), 0.1, np.where(cast[:, -1] > 0, 0.9, 0.6))
    strength = PRIOR * n.sum() + 1
    right = np.append(np.full(len(LABELLERS), False), True)
    for _ in range(rounds):
        prior = np.clip((n * post).sum() / n.sum(), 1e-3, 1 - 1e-3)
        logs = []
        for weight, share, good in ((n * post, prior, True), (n * (1 - post), 1 - prior, False)):
            expected = np.where(right == good, 0.5, 0.02)
            chance = np.einsum("p,plv->lv", weight, one) + strength * np.stack([1 - expected, expected], axis=1)
            chance /= chance.sum(axis=1, keepdims=True)
            logs.append(math.log(share) + np.einsum("plv,lv->p", one, np.log(chance)))
        then = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
        if np.abs(then - post).max() < 1e-9:
            break
        post = then
    return dict(zip(counts, post.tolist(), strict=True))


def hashed(buf: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots and values: shares of hashed 4-byte strings, and one slot for each statistic's step."""
    size = 1 << BITS
    slots = np.zeros(0, np.int64)
    if buf.size >= 4:
        b = buf.astype(np.uint32)
        grams = b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]
        slots = ((grams * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    steps = np.where(np.isnan(stats), 99, np.clip(np.nan_to_num(stats) * 10, 0, 60).astype(np.int64) + 100 * votes(stats)[:-1])
    own = tokens.mix((np.arange(stats.size) * 1000 + steps).astype(U)).astype(U) % U(size)
    return np.concatenate((slots, own.astype(np.int64))), np.concatenate((np.full(slots.size, 4.0 / max(1, slots.size)), np.full(own.size, 0.5)))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().cast("binary").alias("body"))


def posteriors(docs: DataFrame) -> dict[int, float]:
    """Posterior of each vote pattern over all documents."""

    def run(batches):
        for batch in common.slices(batches, "body"):
            yield pa.RecordBatch.from_arrays([pa.array([pattern(votes(statistics(b))) for b in tokens.rows_of(batch.column(1))], pa.int32())], names=["pattern"])

    counts = _keyed(docs).mapInArrow(run, "pattern int").groupBy("pattern").agg(F.count("*").alias("n")).collect()
    return expectation_maximisation({r["pattern"]: r["n"] for r in sorted(counts)})


def train(docs: DataFrame, post: dict[int, float], sample: int = SAMPLE) -> np.ndarray:
    """Weights of the scorer: trained by a few tasks on parts of the sample, then averaged.

    A row is in the sample by a hash of its doc_id and text; reruns give the same weights.
    """
    total = docs.count()
    text = common.whole_text()
    own = F.xxhash64("doc_id", text)  # rows without a doc_id of their own are told apart by their text
    near = F.shiftrightunsigned(own, 4) < int(2**60 * min(1.0, sample / max(1, total)))
    rows = docs.filter(near).select(F.pmod(own, F.lit(TRAINERS)).alias("part"), F.sha2(text, 256).alias("order"), text.cast("binary").alias("body"))

    def fit(pdf):
        data = []
        for body in pdf.sort_values("order")["body"]:  # rows of one text are alike, so the order is one
            buf = np.frombuffer(body, np.uint8)
            stats = statistics(buf)
            slots, values = hashed(buf, stats)
            slots, inverse = np.unique(slots, return_inverse=True)
            data.append((slots, np.bincount(inverse, values), post[pattern(votes(stats))]))
        weights, squares, bias, bias_square = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6), 0.0, 1e-6
        rng = np.random.default_rng(7)
        for _ in range(8):
            for i in rng.permutation(len(data)):
                slots, values, target = data[i]
                error = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + values @ weights[slots])))) - target
                step = error * values + 1e-5 * weights[slots]
                squares[slots] += step * step
                weights[slots] -= 0.2 * step / np.sqrt(squares[slots])
                bias_square += error * error
                bias -= 0.2 * error / math.sqrt(bias_square)
        return pd.DataFrame([{"n": len(data), "weights": np.append(weights, bias).tobytes()}])

    parts = rows.groupBy("part").applyInPandas(fit, "n long, weights binary").collect()
    if not parts:
        return np.zeros((1 << BITS) + 1)
    return np.average([np.frombuffer(p["weights"]) for p in parts], axis=0, weights=[p["n"] for p in parts])


def rate(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, posterior, score, kept) of each row: the weak label's and the scorer's chance of good quality.

    kept is score >= 0.5. A missing or empty text gets no votes: its posterior is that of the pattern of no
    votes. Equal texts get equal results. An empty table gives no rows; other columns are not read. The
    sample that trains the scorer is bounded (``sample``); votes and their statistics cover all documents.
    """
    post = posteriors(docs)
    weights = train(docs, post, sample)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "body"):
            measured = [(b, statistics(b)) for b in tokens.rows_of(batch.column(1))]
            posterior = np.array([post[pattern(votes(stats))] for _, stats in measured])
            score = np.array([score_of(b, stats, weights) for b, stats in measured])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(posterior), pa.array(score), pa.array(score >= KEEP_FROM)], names=["doc_id", "posterior", "score", "kept"])

    return _keyed(docs).mapInArrow(run, "doc_id long, posterior double, score double, kept boolean")


def score_of(buf: np.ndarray, stats: np.ndarray, weights: np.ndarray) -> float:
    """The scorer's chance of good quality."""
    slots, values = hashed(buf, stats)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, weights[-1] + values @ weights[slots]))))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, all columns as they are. An empty table stays empty."""
    weights = train(docs, posteriors(docs))

    def run(batches):
        for batch in common.slices(batches, "text"):
            texts = pc.fill_null(batch.column(batch.schema.names.index("text")), "").cast(pa.binary())
            yield batch.filter(pa.array([score_of(b, statistics(b), weights) >= KEEP_FROM for b in tokens.rows_of(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(common.documents(spark, sf_dir))
