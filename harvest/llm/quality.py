"""Quality rules: plain counts, and bands of zstandard ratios.

A text whose bytes shrink much more than prose of its length is repetitive, one that hardly shrinks
is noise. The bands depend on the length, because short texts shrink less. Long texts are also
judged in fixed chunks, so that a repeated half doesn't hide behind a varied one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from harvest.llm.common import Words, bounded_batches, byte_set, per_text, strings, text_slices

# bytes up to which a band holds, smallest and largest allowed ratio of plain to compressed bytes
BANDS = (
    (256, 0.0, 2.5),
    (1_024, 1.1, 3.0),
    (4_096, 1.25, 3.5),
    (16_384, 1.4, 4.0),
    (float("inf"), 1.5, 5.0),
)
CHUNK = 4_096           # bytes of a chunk
BAD_CHUNKS = 0.25       # largest share of chunks outside their band
LEVEL = 3
MIN_WORDS, WINDOW, REPEATED = 20, 8, 30     # base rule: words, words of a window, percent of repeated words

SCHEMA = """doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,
base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"""
_TYPES = [(n, {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t])
          for n, t in (x.split() for x in SCHEMA.split(","))]
_SYMBOL = byte_set(b"#*$%&|<>")


def in_band(size: int, ratio: float, bands=BANDS) -> bool:
    """Whether ``ratio`` is usual for a text of ``size`` bytes."""
    for most, low, high in bands:
        if size <= most:
            return low <= ratio <= high
    return False


def repeated_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """Per text: words inside windows that occur at least twice in the text, the first ones included."""
    ids, n = words.ids, len(words.ids)
    out = np.zeros(len(words.offsets) - 1, np.int64)
    if n < window:
        return out
    owner = words.owner
    at = np.flatnonzero(owner[:n - window + 1] == owner[window - 1:])
    key = owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(window):
        key = (key ^ (ids[at + k].astype(np.uint64) + np.uint64(1))) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    a, b = at[order[same]], at[order[same + 1]]
    equal = owner[a] == owner[b]
    for k in range(window):
        equal &= ids[a + k] == ids[b + k]
    if not equal.all():                                  # two different windows share a key: compare them whole
        whole = np.column_stack([owner[at], *[ids[at + k] for k in range(window)]])
        _, inverse, count = np.unique(whole, axis=0, return_inverse=True, return_counts=True)
        twice = at[count[inverse.ravel()] > 1]
    else:
        twice = np.concatenate([a, b])
    change = np.zeros(n + 1, np.int64)
    twice = np.unique(twice)
    change[twice] += 1
    change[twice + window] -= 1
    covered = np.cumsum(change[:n]) > 0
    np.add.at(out, owner[covered], 1)
    return out


def repeated_lines(words: Words) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line of the text."""
    data, offsets = words.data, words.offsets
    cuts = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets]))
    if len(cuts) < 2:
        return np.zeros(len(offsets) - 1, np.int64)
    owner = np.searchsorted(offsets, cuts[:-1], side="right") - 1
    plain = data != 10
    kept = np.concatenate([[0], np.cumsum(plain)])
    line = strings(data[plain], kept[cuts]).dictionary_encode().indices.to_numpy().astype(np.int64)
    worded = np.diff(np.searchsorted(words.at, cuts)) > 0
    key = (owner * (line.max() + 1) + line)[worded]
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    return np.bincount(owner[worded][again], minlength=len(offsets) - 1)


def _ratios(texts: list[bytes], coder: zstandard.ZstdCompressor, bands) -> tuple[list, list, list, list]:
    whole, chunks, bad, fine = [], [], [], []
    for text in texts:
        ratio = len(text) / len(coder.compress(text)) if text else 0.0
        ok, n, wrong = in_band(len(text), ratio, bands), 1, 0
        if len(text) > CHUNK:
            parts = [text[i:i + CHUNK] for i in range(0, len(text), CHUNK)]
            n = len(parts)
            wrong = sum(not in_band(len(p), len(p) / len(coder.compress(p)), bands) for p in parts)
        whole.append(ratio)
        chunks.append(n)
        bad.append(wrong)
        fine.append(ok and wrong <= BAD_CHUNKS * n)
    return whole, chunks, bad, fine


def judged(texts: pa.Array, coder: zstandard.ZstdCompressor, bands=BANDS) -> dict:
    """All columns but the id, for some texts."""
    words = Words(texts)
    n = words.counts
    letters = words.inside & ((words.data & 0xC0) != 0x80)
    repeat = repeated_words(words)
    failed = (n < MIN_WORDS) | (100 * repeat > REPEATED * n)
    data, offsets = words.data.tobytes(), words.offsets
    ratio, chunks, bad, fine = _ratios([data[a:b] for a, b in zip(offsets[:-1], offsets[1:])], coder, bands)
    return {
        "n_words": n, "word_chars": per_text(letters, offsets), "n_symbols": per_text(_SYMBOL[words.data], offsets),
        "n_dup_lines": repeated_lines(words), "n_repeat_words": repeat, "base_failed": failed,
        "kept": ~failed & np.array(fine, bool), "ratio": ratio, "n_chunks": chunks, "n_bad_chunks": bad}


def quality(docs: DataFrame, bands=BANDS) -> DataFrame:
    """One row per row of ``docs``: the counts, the ratio, and whether the text stays.

    A null or empty text has no words and fails the base rule; a null id stays null. Repeated rows are
    judged one by one. Other columns are ignored. Nothing is shuffled: each text is judged by itself.
    """
    bounded_batches(docs.sparkSession)
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in text_slices(batch):
                found = judged(part.column("text"), coder, bands) | {"doc_id": part.column("doc_id")}
                yield pa.RecordBatch.from_arrays([pa.array(found[n], t) if n != "doc_id" else found[n] for n, t in _TYPES],
                                                 names=[n for n, _ in _TYPES])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(judge, SCHEMA)
