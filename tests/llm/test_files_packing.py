import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from harvest.llm.packing import SEQUENCE, layout, pack, sequences
from harvest.llm.token_files import STEP, decode_ranks, encode_ranks, file_bytes, parsed, token_files

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=60))
@settings(deadline=None)
def test_ranks_round_trip(ranks):
    control, data = encode_ranks(np.array(ranks, np.uint32))
    assert decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(ranks)).tolist() == ranks


def test_long_ranks_round_trip():
    ranks = np.random.default_rng(3).integers(0, 2**20, STEP + 5).astype(np.uint32)
    control, data = encode_ranks(ranks)
    assert (decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(ranks)) == ranks).all()


def test_file_round_trip():
    ids, counts, ranks = parsed(file_bytes([None, -5, 7], np.array([2, 0, 1]), np.array([1, 70_000, 3], np.uint32)))
    assert ids == [None, -5, 7] and counts.tolist() == [2, 0, 1] and ranks.tolist() == [1, 70_000, 3]


def expected_files(rows):
    plain, at, out = Tokenizer.from_file(WORD), 0, []
    coded = [(i, plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]
    for i, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]), crc(x[1]))):
        out.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    return sorted(out, key=str)


def test_files_equal_brute_force(spark, real, awkward):
    for df in (real, awkward):
        want = expected_files([(r.doc_id, r.text) for r in df.collect()])
        got = token_files(df, WORD).collect()
        assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=str) == want
    assert token_files(real.limit(0), WORD).count() == 0


def test_packing_is_exact_and_tight(spark, real, awkward):
    plain = Tokenizer.from_file(BYTE)
    for df in (real, awkward):
        ids = defaultdict(list)
        for r in df.collect():
            ids[r.doc_id].append(plain.encode(r.text or "", add_special_tokens=False).ids + [1])
        placed, rows = pack(df, BYTE).collect(), defaultdict(list)
        assert sum(p.length for p in placed) == sum(len(x) for v in ids.values() for x in v)
        for p in placed:
            rows[p.sequence_id].append((p.offset, p.length))
            assert any(len(x) == p.doc_tokens and crc(x[p.start:p.start + p.length]) == p.ids_crc32 for x in ids[p.doc_id])
        for parts in rows.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= SEQUENCE
    assert pack(real.limit(0), BYTE).count() == 0


def test_sequences_hold_the_tokens(spark, real):
    placed = pack(real, BYTE).persist()
    plain = Tokenizer.from_file(BYTE)
    texts = {r.doc_id: plain.encode(r.text or "", add_special_tokens=False).ids + [1] for r in real.collect()}
    got = {r.sequence_id: r.ids for r in sequences(real, placed, BYTE).collect()}
    for p in placed.collect():
        assert got[p.sequence_id][p.offset:p.offset + p.length] == texts[p.doc_id][p.start:p.start + p.length]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
@settings(deadline=None)
def test_layout_places_every_piece_once(histogram):
    blocks = layout(histogram, 64)
    for length, n in histogram.items():
        ranks = sorted((r, c) for k, r, c, _, _ in blocks if k == length)
        assert [r for r, _ in ranks] == list(np.cumsum([0] + [c for _, c in ranks]))[:-1] and sum(c for _, c in ranks) == n
    filled = defaultdict(list)
    for length, _, count, first, offset in blocks:
        for s in range(first, first + count):
            filled[s].append((offset, length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(k * n for k, n in histogram.items())
    assert len(filled) <= 2 * total / 64 + 1


@pytest.mark.parametrize("share", [0.3])
def test_little_padding_at_size(share):
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(np.minimum(2048, rng.lognormal(6.3, 0.9, 50_000).astype(int) + 1), return_counts=True)
    blocks = layout(dict(zip(lengths.tolist(), counts.tolist())))
    used = 1 + max(first + count - 1 for _, _, count, first, _ in blocks)
    assert (lengths * counts).sum() > 0.98 * used * 2048 and len(blocks) < 20_000
