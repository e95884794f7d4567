"""Language of texts by compression: the language whose dictionary shrinks a text most.

For each language a raw-content dictionary is made of the most frequent words of a bounded sample of
training texts, the most frequent last, where references are shortest. (Whole passages in it would
let one copied passage outweigh the language.) A text is compressed in chunks with each dictionary;
the smallest sum of bytes names the language, and the text is rejected when the runner-up comes too
close. Short texts often shrink by no byte with any dictionary; where they leave the languages tied they
are parsed again with matches of three bytes and more, and the parse is measured in bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvest.llm.common import bounded_batches, released, text_slices

SAMPLE_TEXTS = 300      # training texts of a language's dictionary at most
SAMPLE_CHARS = 1_500    # characters taken from each, from a place given by the text's hash
DICTIONARY_WORDS = 6_000
CHUNK = 2_048           # bytes compressed at once, so that the dictionary counts throughout long texts
LEVEL = 9
MARGIN = 0.005          # least gap to the runner-up, as a share of its bytes
SHORT = 160             # bytes of a text that is measured in bits if its languages are tied
LEAST_MATCH = 3         # bytes of a match in that measure
MATCH_BITS = 4          # of a match besides its distance; a byte without a match takes eight
GROUP = 64              # languages whose coders a worker holds at once; more are taken group after group
NO_LANGUAGE = "und"

_OUT = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
_NAMES = ["doc_id", "held_out", "lang_pred", "score", "rejected"]

Model = dict[str, bytes]        # language: dictionary


def held_out(modulus: int, rest: int, column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a row without id is never learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == rest, F.lit(True))


def learned(docs: DataFrame, sample: int = SAMPLE_TEXTS) -> Model:
    """Dictionaries from the rows of ``docs`` that have a text and a language.

    The sample is bounded: ``sample`` distinct texts a language, those with the smallest hashes. Rows
    are thinned by that hash before anything is gathered, by the number of distinct hashes of their
    language; copies of one text count once. Any number of languages: the model, about 50 KB for each, is
    what the driver gathers and the tasks are sent.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(
        F.col("lang").alias("_lang"), F.col("text").alias("_text"), F.xxhash64("text").alias("_hash"))
    counts = rows.groupBy("_lang").agg(F.approx_count_distinct("_hash").alias("_n"))
    thin = rows.join(F.broadcast(counts), "_lang").where(      # one number a language: far smaller than the model
        F.pmod("_hash", F.lit(1 << 20)) < F.least(F.lit(1.0), 8 * sample / F.greatest(F.lit(1), "_n")) * (1 << 20))
    place = F.pmod(F.shiftright("_hash", 20), F.greatest(F.lit(1), F.length("_text") - SAMPLE_CHARS + 1)) + 1
    pieces = thin.withColumn("_piece", F.substring("_text", place.cast("int"), F.lit(SAMPLE_CHARS)))
    distinct = pieces.groupBy("_lang", "_hash").agg(F.min("_piece").alias("_piece"))
    order = Window.partitionBy("_lang").orderBy("_hash")            # about 8 * sample rows a language
    kept = distinct.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample)
    words = kept.select("_lang", F.explode(F.array_distinct(F.split(F.lower("_piece"), r"[^\p{L}]+"))).alias("_word"))
    counts = words.where("_word <> ''").groupBy("_lang", "_word").count()
    often = Window.partitionBy("_lang").orderBy(F.desc("count"), "_word")       # words of a bounded sample
    top = counts.withColumn("_n", F.row_number().over(often)).where(F.col("_n") <= DICTIONARY_WORDS)
    model: dict[str, list[str]] = {}
    for r in top.orderBy("_lang", F.desc("_n")).collect():          # bounded by languages * DICTIONARY_WORDS
        model.setdefault(r["_lang"], []).append(r["_word"])
    return {lang: f" {' '.join(parts)} ".encode() for lang, parts in model.items()}


def parsed_bits(data: bytes, words: bytes) -> float:
    """Bits of the cheapest parse of ``data`` into single bytes and matches in ``words``; near its end they cost least."""
    cost = [0.0] * (len(data) + 1)
    for i in range(len(data) - 1, -1, -1):
        cost[i] = cost[i + 1] + 8
        for j in range(i + LEAST_MATCH, len(data) + 1):
            at = words.rfind(data[i:j])
            if at < 0:
                break
            cost[i] = min(cost[i], cost[j] + MATCH_BITS + log2(len(words) - at))
    return cost[0]


class Classifier:
    """The model on one worker."""

    def __init__(self, model: Model):
        self.model = model
        self.languages = sorted(model)
        self.groups = [self.languages[i:i + GROUP] for i in range(0, len(self.languages), GROUP)]
        self.held: tuple[int, list[zstandard.ZstdCompressor]] = (-1, [])

    def _coders(self, group: int) -> list[zstandard.ZstdCompressor]:
        if self.held[0] != group:
            self.held = (group, [])             # the group before is let go first
            for lang in self.groups[group]:
                words = zstandard.ZstdCompressionDict(self.model[lang].ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(level=LEVEL)
                self.held[1].append(zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False))
        return self.held[1]

    def sizes(self, *texts: str) -> np.ndarray:
        """Bytes of every text (rows) with the dictionary of every language (columns)."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        for group in range(len(self.groups)):
            coders = self._coders(group)
            for n, text in enumerate(texts):
                data = f" {text.lower()}".encode()
                chunks = [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)]
                out[n, group * GROUP:group * GROUP + len(coders)] = [sum(len(c.compress(x)) for x in chunks) for c in coders]
        return out

    def __call__(self, text: str | None, margin: float = MARGIN) -> tuple[str, float, bool]:
        """Language, gap to the runner-up from 0 to 1, whether it is rejected."""
        return self.every([text], margin)[0]

    def every(self, texts: list[str | None], margin: float = MARGIN) -> list[tuple[str, float, bool]]:
        """The same for many texts at once."""
        known = [n for n, t in enumerate(texts) if self.languages and t is not None and any(map(str.isalpha, t))]
        out = [(NO_LANGUAGE, 0.0, True)] * len(texts)
        for n, sizes in zip(known, self.sizes(*[texts[n] for n in known])):
            best, gap = self._least(sizes)
            data = f" {texts[n].lower()} ".encode()
            if gap < margin and len(data) <= SHORT:
                best, gap = self._least(np.array([parsed_bits(data, self.model[lang]) for lang in self.languages]))
            out[n] = (self.languages[best], gap, gap < margin)
        return out

    @staticmethod
    def _least(sizes: np.ndarray) -> tuple[int, float]:
        best = int(np.argmin(sizes))                    # ties: the first by name
        rest = np.delete(sizes, best)
        return best, float(1 - sizes[best] / rest.min()) if len(rest) else 1.0


def identified(docs: DataFrame, model: Model, margin: float = MARGIN, modulus: int = 3, rest: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row.

    ``und`` and rejected: null texts, texts without a letter, and every text if nothing was learned.
    With one language known nothing is rejected for its margin. Only the text is looked at.
    """
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(model)
        for batch in batches:
            for part in text_slices(batch):
                found = classify.every(part.column("text").to_pylist(), margin)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array([f[0] for f in found], pa.string()),
                     pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], names=_NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       held_out(modulus, rest).alias("held_out")).mapInArrow(predict, _OUT)


def accepted(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not rejected.

    Null texts, texts without a letter and, if nothing was learned, all texts are rejected; repeated rows
    are judged one by one; an empty table stays empty.
    """
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(model)
        for batch in batches:
            for part in text_slices(batch):
                fine = [not f[2] for f in classify.every(part.column("text").to_pylist(), margin)]
                yield part.filter(pa.array(fine, pa.bool_()))
            released()

    return docs.mapInArrow(keep, docs.schema)
