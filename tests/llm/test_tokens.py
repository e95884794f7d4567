import functools
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from harvest.llm.tokens import crc32, encoder, with_end

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PARTS = ["a", "B", "don't", "'s", "é", "É", "ñandú", "ß", "12", ".", ",", "!!", "  ", " ", " ", "\n", "\n\n", "\t", "\r\n", " ",
         "　", "漢字", "é", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "\x1c", "İ", "ǅ", "Σ", "ΑΣ", "_", "a.b", "'", "\U0001f600"]

library = functools.cache(Tokenizer.from_file)


@pytest.mark.parametrize("file", FILES)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PARTS), max_size=14).map("".join)), min_size=1, max_size=4))
@settings(max_examples=400, deadline=None)
def test_ids_equal_the_library(file, texts):
    path = public_tokenizers.path(file)
    plain = library(path)
    ids, starts = encoder(path).encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[starts[i]:starts[i + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("file", FILES)
def test_real_texts(file):
    import pyarrow.parquet as pq

    path = public_tokenizers.path(file)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].combine_chunks()
    ids, starts = encoder(path).encode(texts)
    plain = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts.to_pylist(), add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == plain


def test_end_and_crc():
    ids, starts = with_end(np.array([5, 6, 7], np.uint32), np.array([0, 2, 2, 3]), 9)
    assert ids.tolist() == [5, 6, 9, 9, 7, 9] and starts.tolist() == [0, 3, 4, 6]
    import zlib
    assert crc32(ids) == zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def test_offset_slices():
    path, rng = public_tokenizers.path(FILES[0]), random.Random(1)
    texts = pa.array(["".join(rng.choices(PARTS, k=6)) for _ in range(30)])
    ids, starts = encoder(path).encode(texts)
    again, at = encoder(path).encode(texts.slice(11, 7))
    assert again.tolist() == ids[starts[11]:starts[18]].tolist()
