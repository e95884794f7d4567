"""Packing of documents into sequences by the histogram of their lengths.

Documents are tokenized and cut into pieces of at most the sequence length. Only the histogram of
piece lengths reaches the driver: one entry per possible length. Lengths are placed from the longest
down, each time into the sequences that are filled least and still have room ("shortest pack first"),
whole blocks of sequences at a time. What comes out says for each length and range of ranks where
the pieces go; the pieces find their places by their rank among those of their length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvest.llm.common import bounded_batches, text_slices
from harvest.llm.tokens import crc32, encoder, with_end
from harvest.operators.ordered import number_rows
from harvest.session import cut_lineage

SEQUENCE = 2_048        # tokens of a sequence
END = 1                 # id after each document

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """The pieces of every row: full ones from its start, then the rest. A null text is an empty one."""
    bounded_batches(docs.sparkSession)
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                ids, starts = with_end(*encoder(tokenizer).encode(part.column("text")), end)
                tokens = np.diff(starts)
                n = -(-tokens // size)
                row = np.repeat(np.arange(len(tokens)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * size
                length = np.minimum(size, tokens[row] - start)
                first = starts[:-1][row] + start
                crc = [crc32(ids[a:a + k]) for a, k in zip(first.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(crc, pa.int64()), pa.array(tokens[row], pa.int64())],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(cut, _PIECES)


def layout(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Blocks (length, first rank, count, first sequence, offset) that place every piece of the histogram.

    A block of equal packs is a range of sequence numbers; placing a length splits off at most one
    block, and new packs take as many of a length as fit, so the blocks for each length are few (at
    most the length's share of a sequence, and those split off), whatever the number of pieces.
    """
    placed, packs, sequences = [], [], 0        # packs: heap of (filled, first sequence, count)
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if packs and packs[0][0] + length <= size:
                filled, first, count = heapq.heappop(packs)
                used = min(left, count)
                if used < count:
                    heapq.heappush(packs, (filled, first + used, count - used))
                taken = 1
            else:
                filled, first, taken = 0, sequences, min(left, size // length)
                used = left // taken
                sequences += used
            for k in range(taken):
                placed.append((length, rank + k * used, used, first, filled + k * length))
            if filled + taken * length < size:
                heapq.heappush(packs, (filled + taken * length, first, used))
            rank, left = rank + taken * used, left - taken * used
    return placed


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence, at which offset.

    Pieces of one length are ranked by (doc_id, start) with a distributed running count, so one length
    may hold any share of the pieces. Null ids rank first; equal rows take ranks among themselves in
    any order, which gives the same set of rows. An empty table has no pieces.
    """
    spark = docs.sparkSession
    cut = cut_lineage(pieces(docs, tokenizer, size, end))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}     # at most ``size`` rows
    blocks = np.array(layout(histogram, size), np.int64).reshape(-1, 5)
    names = ("_length", "_rank", "_count", "_sequence", "_offset")
    places = spark.createDataFrame(pa.table({n: blocks[:, i] for i, n in enumerate(names)}))
    ranked = number_rows(cut, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], "_n")
    within = (F.col("length") == F.col("_length")) & (F.col("_n") > F.col("_rank")) & (F.col("_n") <= F.col("_rank") + F.col("_count"))
    return ranked.join(F.broadcast(places), within).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_sequence") + F.col("_n") - 1 - F.col("_rank")).alias("sequence_id"), F.col("_offset").alias("offset"))


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """The sequences themselves: (sequence_id, ids array), at most one sequence length each.

    Expects one row per ``doc_id``: ids are cut from the document that a piece names.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                ids, starts = with_end(*encoder(tokenizer).encode(part.column("text")), end)
                at = starts[:-1] + part.column("start").to_numpy()
                rows = [ids[a:a + k].astype(np.int32) for a, k in zip(at, part.column("length").to_numpy())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("sequence_id"), part.column("offset"), pa.array(rows, pa.list_(pa.int32()))],
                    names=["sequence_id", "offset", "ids"])

    joined = placed.join(docs.select("doc_id", "text"), "doc_id").select("sequence_id", "offset", "start", "length", "text")
    return joined.mapInArrow(cut, "sequence_id long, offset long, ids array<int>").groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
