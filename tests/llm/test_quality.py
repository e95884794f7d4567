import random
import re

import pytest
import zstandard
from hypothesis import given, settings, strategies as st

import pyarrow as pa

from harvest.llm.quality import BAD_CHUNKS, BANDS, CHUNK, judged, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in text.split("\n")]
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    data, coder = text.encode(), zstandard.ZstdCompressor(level=3)

    def usual(part):
        low, high = next((a, b) for most, a, b in BANDS if len(part) <= most)
        return low <= (len(part) / len(coder.compress(part)) if part else 0) <= high

    chunks = [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)] if len(data) > CHUNK else []
    fine = usual(data) and sum(not usual(c) for c in chunks) <= BAD_CHUNKS * max(1, len(chunks))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed, not failed and fine)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@given(st.lists(st.one_of(st.none(), st.text("ab \n\t#é \x1c", max_size=120)), max_size=5))
@settings(max_examples=150, deadline=None)
def test_counts_equal_brute_force(texts):
    got = judged(pa.array(texts, pa.string()), zstandard.ZstdCompressor(level=3))
    assert [tuple(got[c][i] for c in COLUMNS) for i in range(len(texts))] == [brute(t) for t in texts]


def test_real_rows(real):
    texts = {r.doc_id: r.text for r in real.collect()}
    rows = quality(real).collect()
    assert len(rows) == len(texts)
    for r in rows[::7]:
        assert tuple(r[c] for c in COLUMNS) == brute(texts[r.doc_id])


def test_awkward_rows(awkward):
    rows = quality(awkward).collect()
    assert len(rows) == awkward.count() and quality(awkward.limit(0)).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[1].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[7].n_repeat_words == by[7].n_words and by[10].n_dup_lines == 39


def test_bands_reject_repetition_and_noise(make):
    rng = random.Random(5)
    syllables = "the of an in re tion ent ing er on at es ed ou st".split()
    prose = " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(900))
    noise = " ".join("".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(9)) for _ in range(300))
    half = prose + " " + " ".join(f"row {i % 3} of the list is filled;" for i in range(900))
    kept = {r.doc_id: r.kept for r in quality(make([(1, prose), (2, noise), (3, half)])).collect()}
    assert kept == {1: True, 2: False, 3: False}


@pytest.mark.parametrize("size", [100, 1_000, 100_000])
def test_hot_windows_stay_exact(size):
    text = "a b c d e f g h i " * (size // 18)
    got = judged(pa.array([text]), zstandard.ZstdCompressor(level=3))
    n = len(text.split())
    assert got["n_words"][0] == n and got["n_repeat_words"][0] == (n if n >= 17 else 0)
