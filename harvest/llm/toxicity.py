"""Toxicity of texts: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are its n-grams inside words (their blanks included), as shares of all its n-grams, hashed
into a table of fixed size. All labelled training rows give each feature its log-count ratio between the two
labels; a logistic regression on the scaled shares is then fitted on a bounded sample of those rows, as many
of either label. A word's part of the score is the same wherever it stands, so it is added up once for each
distinct word of a slice of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvest.llm.common import Words, bounded_batches, text_slices
from harvest.llm.language import held_out
from harvest.session import cut_lineage

LENGTHS = range(3, 7)       # characters of an n-gram
FEATURES = 1 << 18          # places of the hashed features
PSEUDO = 0.02               # share of one text that every feature is given in either label
SAMPLE = 2_000              # rows of each label that the regression is fitted on, at most
SAMPLE_CHARS = 8_000        # of a sampled row at most; longer rows count for the ratios only
ROUNDS = 100                # steps of the regression
PENALTY = 1e-4
RATE = 100.0                # shares are in per cent
THRESHOLD = 0.7
_BLOCK = 1 << 14            # features that are summed up together
_FAN_IN = 32
_UNIT = float(1 << 40)      # shares are added as integers, so that no order of tasks changes a sum
_MIX = np.uint64(0x9E3779B97F4A7C15)
_OUT = "doc_id long, held_out boolean, score double, predicted int"


@dataclass
class Model:
    """``bias`` plus the sum of ``weights`` over a text's features, in shares, is the log odds of label 1."""

    weights: np.ndarray
    bias: float


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of every n-gram of every word, with a blank at either end; words in order."""
    text = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(text))      # characters from here to the word's end
    value, found, whose = np.zeros(len(text), np.uint64), [], []
    for n in range(1, LENGTHS.stop):
        value = (value[:len(text) - n + 1] + text[n - 1:] + np.uint64(1)) * _MIX
        value ^= value >> np.uint64(29)
        if n in LENGTHS:
            at = np.flatnonzero(left[:len(value)] >= n)
            found.append((value[at] >> np.uint64(64 - 18)).astype(np.int32) & (FEATURES - 1))
            whose.append(owner[at])
    whose, found = np.concatenate(whose), np.concatenate(found)
    order = np.argsort(whose, kind="stable")
    return whose[order], found[order]


class Texts:
    """The distinct words of some texts, and how often each text has each."""

    def __init__(self, texts: pa.Array):
        words = Words(pc.utf8_lower(pc.fill_null(texts, "")))
        self.n = len(texts)
        self.words = [w.decode("utf-8", "surrogatepass") for w in words.distinct()]
        self.text, self.word = words.owner, words.ids
        whose, self.feature = features(self.words) if self.words else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.whose = whose
        self.grams = np.bincount(whose, minlength=len(self.words)).astype(np.float64)       # n-grams of each word
        self.total = np.maximum(self.per_text(self.grams), 1)                               # and of each text

    def per_text(self, of_words: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, of_words[self.word], minlength=self.n) if len(self.word) else np.zeros(self.n)

    def per_feature(self, of_texts: np.ndarray) -> np.ndarray:
        """Sum over texts of their value times their share of each feature."""
        of_words = np.bincount(self.word, (of_texts / self.total)[self.text], minlength=len(self.words)) if len(self.word) else np.zeros(0)
        return np.bincount(self.feature, of_words[self.whose], minlength=FEATURES) if len(self.feature) else np.zeros(FEATURES)

    def mean(self, of_features: np.ndarray) -> np.ndarray:
        """Sum over features of their value times their share of each text."""
        of_words = np.bincount(self.whose, of_features[self.feature], minlength=len(self.words)) if len(self.feature) else np.zeros(len(self.words))
        return self.per_text(of_words) / self.total


def _summed(parts: DataFrame) -> DataFrame:
    """Sums of (block, sums) by block, in two steps, so that no task gets a row from every other."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                values = np.frombuffer(sums, np.int64)
                held[block] = held[block] + values if block in held else values
        for block, values in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=["block", "sums"])

    schema = "block int, sums binary"
    salted = parts.repartition(F.col("block"), F.col("part") % _FAN_IN).select("block", "sums")
    return salted.mapInArrow(add, schema).repartition("block").mapInArrow(add, schema)


def log_count_ratios(rows: DataFrame) -> tuple[np.ndarray, tuple[int, int]]:
    """(ratio of each feature, number of texts of either label) over all ``rows`` of (text, toxic)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = np.zeros((FEATURES // _BLOCK, 2, _BLOCK), np.int64)
        for batch in batches:
            for part in text_slices(batch):
                texts, label = Texts(part.column("text")), part.column("toxic").to_numpy()
                for y in (0, 1):
                    share = np.rint(texts.per_feature((label == y).astype(np.float64)) * _UNIT / (1 << 10)).astype(np.int64)
                    sums[:, y] += share.reshape(-1, _BLOCK)
        for block in np.flatnonzero(sums.any(axis=(1, 2))):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sums[block].tobytes()], pa.binary())],
                names=["block", "part", "sums"])

    parts = rows.mapInArrow(count, "block int, part int, sums binary")
    found = np.zeros((2, FEATURES))
    for r in _summed(parts).collect():          # a table of fixed size
        own = slice(r["block"] * _BLOCK, (r["block"] + 1) * _BLOCK)
        found[:, own] = np.frombuffer(r["sums"], np.int64).reshape(2, _BLOCK) * ((1 << 10) / _UNIT)
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    if not clean or not toxic:
        return np.zeros(FEATURES), (clean, toxic)
    least = PSEUDO / min(clean, toxic)
    return np.log((found[1] / toxic + least) / (found[0] / clean + least)), (clean, toxic)


def sampled(rows: DataFrame, n: tuple[int, int], sample: int) -> list[tuple[str, int]]:
    """At most ``sample`` distinct texts of either label, those with the smallest hashes."""
    out = []
    short = rows.where(F.length("text") <= SAMPLE_CHARS).withColumn("hash", F.xxhash64("text"))
    for label in (0, 1):
        own = short.where(F.col("toxic") == label)
        distinct = own.agg(F.approx_count_distinct("hash")).first()[0]
        thin = own.where(F.pmod("hash", F.lit(1 << 20)) < F.lit(min(1.0, 4 * sample / max(1, distinct)) * (1 << 20)))
        chosen = thin.groupBy("hash").agg(F.min("text").alias("text")).orderBy("hash").limit(sample)
        out += [(r["text"], label) for r in chosen.collect()]       # sample * SAMPLE_CHARS at most
    return out


def fitted(rows: list[tuple[str, int]], ratios: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> Model:
    """Logistic regression on shares times ``ratios``, each label of equal weight, by accelerated gradient steps."""
    label = np.array([y for _, y in rows], np.float64)
    if not len(rows) or label.min() == label.max():
        return Model(np.zeros(FEATURES), 0.0 if not len(rows) else (4.0 if label[0] else -4.0))
    texts = Texts(pa.array([t for t, _ in rows], pa.string()))
    importance = np.where(label == 1, 0.5 / label.sum(), 0.5 / (len(label) - label.sum()))
    scale = RATE * ratios
    # the largest curvature of the loss is at most a quarter of the weighted mean of squared feature lengths
    direction = texts.per_feature(importance) * scale
    for _ in range(8):
        direction /= np.linalg.norm(direction) + 1e-30
        direction = scale * texts.per_feature(importance * texts.mean(scale * direction))
    length = np.linalg.norm(direction) + 1          # the bias is taken as a feature of that squared size, to be as quick
    step = 1 / (0.5 * length + penalty)
    theta, bias = np.zeros(FEATURES), 0.0
    ahead, ahead_bias, t = theta, bias, 1.0
    for _ in range(rounds):
        odds = np.clip(texts.mean(scale * ahead) + ahead_bias, -50, 50)
        error = importance * (1 / (1 + np.exp(-odds)) - label)
        new = ahead - step * (scale * texts.per_feature(error) + penalty * ahead)
        new_bias = ahead_bias - step * length * error.sum()
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, ahead_bias = new + (before - 1) / t * (new - theta), new_bias + (before - 1) / t * (new_bias - bias)
        theta, bias = new, new_bias
    return Model(scale * theta, float(bias))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The classifier of ``docs`` by the ``toxic`` of their ids in ``labels``.

    Rows without id, text or a label of 0 or 1 teach nothing; an id with both labels counts as toxic. With
    one label only, or none, every text gets the same score.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max("toxic").cast("int").alias("toxic"))
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    # the labels grow with the texts, so neither side is ever sent whole
    rows = cut_lineage(texts.join(known.hint("shuffle_hash"), "_id").select("text", "toxic"))
    ratios, n = log_count_ratios(rows)
    return fitted(sampled(rows, n, sample), ratios)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD, modulus: int = 3, rest: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; only its text is looked at. Null and empty texts score alike."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in batches:
            for part in text_slices(batch):
                odds = np.clip(Texts(part.column("text")).mean(weights) + bias, -700, 700)
                chance = 1 / (1 + np.exp(-odds))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(chance), pa.array((chance >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       held_out(modulus, rest).alias("held_out")).mapInArrow(score, _OUT)
