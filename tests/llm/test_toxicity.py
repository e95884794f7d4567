import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harvest.llm import queries, toxicity
from harvest.llm.toxicity import FEATURES, PSEUDO, Texts, features, fitted, learned, log_count_ratios, scored

TEXTS = ["you fool", "nice day nice", "", None, " \n", "Ünïcode ÜNÏ 漢字", "x" * 5_000, "fool " * 700, "a", "you fool"]


def grams(text):
    """Number of each n-gram of a text."""
    found = Counter()
    for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()):
        found.update(f" {w} "[i:i + n] for n in range(3, 7) for i in range(len(w) + 2 - n + 1))
    return found


def place(gram):
    """Feature of an n-gram: that of the middle of a word which has it."""
    word = gram.strip(" ")
    whose, found = features([word])
    every = [f" {word} "[i:i + n] for n in range(3, 7) for i in range(len(word) + 2 - n + 1)]
    return int(found[every.index(gram)])


def shares(text):
    found, out = grams(text), np.zeros(FEATURES)
    for g, n in found.items():
        out[place(g)] += n / sum(found.values())
    return out


def test_shares_equal_brute_force():
    texts, values = Texts(pa.array(TEXTS, pa.string())), np.random.default_rng(1).normal(size=FEATURES)
    want = np.array([shares(t) for t in TEXTS])
    assert np.allclose(texts.mean(values), want @ values)
    assert np.allclose(texts.per_feature(np.arange(10.0)), np.arange(10.0) @ want)


def test_equal_ngrams_share_a_feature_wherever_they_stand():
    whose, found = features(["abcdef", "xxabcdef"])
    one, two = ([int(f) for f, w in zip(found, whose) if w == k] for k in (0, 1))
    assert len(one) == 6 + 5 + 4 + 3 and place("cdef ") in one and place("cdef ") in two and place(" abc") not in two


def test_ratios_equal_brute_force(spark):
    rows = [(t or "", k % 2) for k, t in enumerate(TEXTS * 9)] + [("you are a fool", 1), ("what a nice day", 0)]
    ratios, n = log_count_ratios(spark.createDataFrame(rows, "text string, toxic int").repartition(5))
    sums = [sum((shares(t) for t, y in rows if y == k), np.zeros(FEATURES)) for k in (0, 1)]
    least = PSEUDO / min(n)
    assert n == (46, 46) and np.allclose(ratios, np.log((sums[1] / n[1] + least) / (sums[0] / n[0] + least)), atol=1e-6)


def test_regression_finds_the_least_loss():
    rows = [("good word here", 0), ("nice plain text", 0), ("bad fool word", 1), ("fool text", 1), ("plain fool", 0)]
    ratios = np.ones(FEATURES)
    texts, label = Texts(pa.array([t for t, _ in rows])), np.array([y for _, y in rows])
    weight = np.where(label == 1, 0.5 / 2, 0.5 / 3)

    def loss(model):
        odds = texts.mean(model.weights) + model.bias
        theta = model.weights / toxicity.RATE
        return (weight * np.log1p(np.exp(-odds * (2 * label - 1)))).sum() + 0.05 * (theta ** 2).sum()

    best = fitted(rows, ratios, rounds=400, penalty=0.1)
    rng = np.random.default_rng(3)
    for _ in range(20):
        moved = toxicity.Model(best.weights + texts.per_feature(rng.normal(size=5)) * 3, best.bias + rng.normal() / 20)
        assert loss(best) <= loss(moved) + 1e-9


def test_held_out_documents(spark):
    """Of the rows not learned from, toxic ones are found and clean ones left alone."""
    sf_dir = "/root/testdata/sf0.1"
    found = queries.QUERIES["op12_toxicity"](spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    rate = {r["toxic"]: r["p"] for r in found.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert rate[1] >= 0.85 and rate[0] <= 0.01


def test_labels_of_every_kind(spark, make):
    """Null labels and ids, texts without label, other values and clashing names teach nothing; a twice labelled id is toxic."""
    docs = make([(i, f"vile scum number {i}" if i % 2 else f"a fine day number {i}") for i in range(80)] + [(None, "scum"), (900, None)])
    rows = [(i, i % 2) for i in range(80)] + [(1, 0), (3, None), (None, 1), (5, 7), (5000, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int").withColumns({n: F.lit("x") for n in ("text", "_id", "hash", "count")})
    got = {r.doc_id: r for r in scored(docs, learned(docs, labels)).collect()}
    assert len(got) == 82 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all((got[i].score > 0.5) == bool(i % 2) for i in range(80)) and got[None].score > 0.5


@pytest.mark.parametrize("values", [[], [0], [1], [None]])
def test_one_label_or_none(spark, make, values):
    labels = spark.createDataFrame([(i, y) for y in values for i in range(5)], "doc_id long, toxic int")
    docs = make([(i, f"text {i}") for i in range(6)])
    scores = {r.score for r in scored(docs, learned(docs, labels)).collect()}
    assert len(scores) == 1 and (scores.pop() > 0.7) == (values == [1])


def test_awkward_tables(spark, awkward):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    model = learned(awkward, labels)
    got = scored(awkward, model).collect()
    assert len(got) == awkward.count() and all(math.isfinite(r.score) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert scored(awkward.limit(0), learned(awkward.limit(0), labels)).count() == 0
