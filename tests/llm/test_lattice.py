import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from harvest.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def pieces():
    return lattice.vocabulary(PATH)


@pytest.fixture(scope="module")
def spelled(pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    number = {int(k): i for i, k in enumerate(pieces.keys)}
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i))
    return {p: number[lattice._hash(p)] for p in names if lattice._hash(p) in number}


def paths(word, pieces, spelled):
    """(probability, pieces) of every segmentation, bytes for single characters included."""
    first = len(pieces.keys)

    def rest(at):
        if at == len(word):
            yield 1.0, ()
            return
        own = tuple(first + b for b in word[at].encode())
        steps = [(own, at + 1)] + [((spelled[word[at:end]],), end) for end in range(at + 1, len(word) + 1) if word[at:end] in spelled]
        for used, end in steps:
            p = math.exp(sum(pieces.log_p[k] for k in used))
            for q, more in rest(end):
                yield p * q, used + more

    yield from rest(0)


def test_marginals_and_expectations_equal_all_paths(pieces, spelled):
    words, counts = ["the", "tion", "é", "x", "漢", "thth1", ""], np.array([3.0, 1, 2, 5, 1, 1, 4])
    got, expected = lattice.marginals(words, pieces, counts)
    want = np.zeros(len(pieces.log_p))
    for k, (w, c) in enumerate(zip(words, counts)):
        every = list(paths("▁" + w, pieces, spelled))
        total = sum(p for p, _ in every)
        assert abs(got[k] - math.log(total)) < 1e-9
        for p, used in every:
            for piece in used:
                want[piece] += c * p / total
    assert np.abs(want - expected).max() < 1e-6


def test_long_words_stay_finite(pieces):
    got, _ = lattice.marginals(["a" * 30_000, "漢" * 3_000], pieces)
    assert np.isfinite(got).all() and (got < -1_000).all()


def folded(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def check(rows, got, sent):
    held = {i: i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(w for i, t in rows if not held[i] for w in [*folded(t), None])
    n, v = sum(counts.values()), len(counts)
    left = Counter()
    for i, t in rows:
        w = [*folded(t), None]
        left[i, held[i], len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == left


@pytest.mark.parametrize("sent", [0, 40, 10**6])
def test_base_scores_equal_brute_force(spark, make, sent):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("The the OF a b c d e É é zz q1 漢".split(), k=rng.randrange(30)))) for i in range(80)]
    rows += [(5, rows[5][1]), (5, "other text"), (None, "no id"), (200, None), (201, "")]
    got = lattice.score_documents(make(rows), PATH, sent_words=sent).collect()
    check(rows, got, sent)
    assert all(r.score < 0 for r in got)


def test_scores_don_t_depend_on_what_is_sent(spark, real):
    few, many = ({r.doc_id: r.score for r in lattice.score_documents(real, PATH, sent_words=n).collect()} for n in (50, 10**6))
    assert few.keys() == many.keys() and max(abs(few[i] - many[i]) for i in few) < 1e-6


def test_rounds_raise_the_likelihood_and_probabilities_sum_to_one(spark, pieces):
    words = spark.createDataFrame([("the", 50, 50), ("tion", 20, 20), ("other", 5, 5), ("unseen", 0, 3)], "word string, c long, n long")

    def likelihood(model):
        return float((lattice.marginals(["the", "tion", "other"], model)[0] * [50, 20, 5]).sum() + 10 * model.end)

    models = [lattice.trained(words, 10, pieces, rounds) for rounds in (0, 1, 2, 3)]
    values = [likelihood(m) for m in models]
    assert values == sorted(values) and all(abs(np.exp(m.log_p).sum() - 1) < 1e-9 for m in models)


def test_empty_table(spark, awkward):
    assert lattice.score_documents(awkward.limit(0), PATH).count() == 0
    assert lattice.score_documents(awkward.where("doc_id IS NULL"), PATH).first().train_tokens == 0
