import random
import re

import numpy as np
import pytest

from harvest.llm.components import components
from harvest.llm.near_duplicates import BANDS, ROWS, SLOTS, band_keys, linked, near_duplicates, signatures, without_copies

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    """{id: (set size, component)} by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            common = len(x & y)
            if x and y and (a == b or 100 * common >= 75 * (len(x) + len(y) - common)):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i, _ in sets}


def family(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_groups_equal_brute_force(spark, make):
    """A large family of edits around one text, chains, exact copies, case, spaces, short texts."""
    rng = random.Random(11)
    base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
    texts = [family(rng, base, rng.randrange(9)) for _ in range(330)]
    chain = list(base)
    for k in range(0, 120, 4):
        chain[k] = f"c{k}"
        texts.append(" ".join(chain))
    texts += [texts[0].upper(), texts[1].replace(" ", "\n\t")] + [texts[5]] * 40
    texts += [" ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 90))) + " one line that all of these texts share" for _ in range(120)]
    texts += ["one", "ONE", "a b", "a  b", "b a", "", None, " \n"]
    ids = rng.sample(range(10**12), len(texts))
    rows = list(zip(ids, texts))
    want = brute(rows)
    got = near_duplicates(make(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    sizes = {i: len(shingles(t)) for i, t in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got)


def test_awkward_rows(spark, make, awkward):
    got = near_duplicates(awkward).collect()
    assert len(got) == awkward.count() and near_duplicates(awkward.limit(0)).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[None].component_id is None and by[None].kept
    assert by[5].component_id == 4 and not by[5].kept and by[2].n_shingles == 0 and by[1].kept


def test_rows_of_one_id_are_one_document(spark, make):
    rows = [(1, "a b c d e f"), (7, "a b c d e f"), (7, "q r s t u v"), (9, "q r s t u v"), (3, "other words here")]
    got = {(r.doc_id, r.component_id) for r in near_duplicates(make(rows)).collect()}
    assert got == {(1, 1), (7, 1), (9, 1), (3, 3)}


def test_one_of_each_group_stays(spark, make):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "q r s t u v"), (3, "q r s t u v"), (None, "a b c d e f"), (4, None)]
    left = without_copies(make(rows))
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "a b c d e f"), (1, "a b c d e f"), (3, "q r s t u v"), (4, "")]
    assert left.columns == make(rows).columns


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(0, k) for k in range(300, 340)] + [(k, k + 1) for k in range(500, 530)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root if find(n) != n}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    errors, plain = [], []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 140).astype(np.uint64)
        a, b = np.unique(pool[:120]), np.unique(pool[20:])
        true = 100 / 140
        s = signatures([a, b])
        errors.append((s[0] == s[1]).mean() - true)
        plain.append(np.sqrt(true * (1 - true) / SLOTS))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < np.mean(plain)          # lower variance than plain MinHash


def test_signatures_are_full_and_equal_for_equal_sets():
    one, many = np.array([5], np.uint64), np.arange(1, 3_000, dtype=np.uint64)
    s = signatures([one, many, np.zeros(0, np.uint64), one])
    assert (s[[0, 1, 3]] < np.iinfo(np.uint64).max).all() and (s[0] == s[3]).all() and s.shape == (4, SLOTS)
    assert sorted((s[0] >> np.uint64(52)).tolist()) == list(range(SLOTS))            # each rank once
    keys = band_keys(s)
    assert keys.shape == (4, BANDS) and BANDS * ROWS <= SLOTS and (keys[0] == keys[3]).all() and not (keys[0] == keys[1]).any()


def test_full_comparison():
    rng = random.Random(2)
    sets = [set(rng.sample(range(40), rng.randrange(0, 30))) for _ in range(50)]
    label = linked([np.array(sorted(s), np.uint64) for s in sets])
    root = list(range(50))
    for _ in range(50):
        for i in range(50):
            for j in range(50):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    root[i] = min(root[i], root[j])
    assert label.tolist() == root
