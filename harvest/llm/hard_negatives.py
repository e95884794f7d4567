"""Hard negatives of anchor vectors by a secondary-sort shuffle.

Every anchor is scored against every row, a block of anchors at a time: a block is sent to the tasks,
whose rows never move. A task keeps, of each anchor, only rows that may still count: the best few of the
same label, then the best few of other labels inside each positive's window. These few are packed into
(anchor, descending score, positives first, id) keys and sorted by the shuffle; a streaming iterator
opens a window at each positive and emits negatives as they come, so that no anchor is ever gathered.

Scores are exact integers: products whose sums stay below 2^53 are added as doubles, below 2^62 as 64-bit
integers, and larger ones as unbounded integers, which count as the nearest 64-bit value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvest.llm.common import bounded_batches
from harvest.session import cut_lineage

SCALE = 256                 # components are floor(SCALE * x)
POSITIVES = 5               # of an anchor, with a window each
NEGATIVES = 3               # of each window
LOW, HIGH = 50, 95          # per cent of the positive's score
BLOCK_BYTES = 16 << 20      # anchors sent to the tasks at once
_ROWS, _ANCHORS = 4_096, 512        # compared at once: 16 MB of scores
_STATE = 1 << 19            # candidates of a task before they are cut down
_FOUND = "anchor_id long, score long, id long"
_LONG = 2**63 - 1


@dataclass
class Rules:
    """How many rows of which scores are asked for."""

    positives: int = POSITIVES
    negatives: int = NEGATIVES
    low: int = LOW
    high: int = HIGH

    def window(self, score: int) -> tuple[int, int]:
        """Least and largest score of a negative: ``low * score <= 100 * negative <= high * score``."""
        return -(-self.low * score // 100), self.high * score // 100


@dataclass
class Block:
    """Anchors in order of label, as sent to the tasks; ``low`` and ``high`` are the windows in which rows are looked for."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same_label: bool
    most: int

    def chunks(self) -> list[slice]:
        """Anchors that are compared at once; of one label where only its rows count."""
        cuts = np.flatnonzero(np.diff(self.labels)) + 1 if self.same_label else []
        ends = [0, *map(int, cuts), len(self.ids)]
        return [slice(a, min(a + _ANCHORS, end)) for begin, end in zip(ends, ends[1:]) for a in range(begin, end, _ANCHORS)]


def quantised(vectors: pa.Array, dims: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each list as a row of doubles; shorter lists end in zeros, longer ones are cut at ``dims``."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(vectors), dims))
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row = np.repeat(np.arange(len(vectors)), lengths)
    fits = column < dims
    out[row[fits], column[fits]] = np.floor(scale * flat[fits])
    return out


def _integers(values: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in values.tolist()], dtype=object).reshape(values.shape)


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products, anchors down and rows across, as 64-bit integers."""
    bound = float(np.abs(rows).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * max(1, rows.shape[1])
    if bound < 2.0**53:
        return (anchors @ rows.T).astype(np.int64)
    if bound < 2.0**62:
        return anchors.astype(np.int64) @ rows.astype(np.int64).T
    whole = _integers(anchors).dot(_integers(rows).T)
    return np.clip(whole, -_LONG, _LONG).astype(np.int64)


class Best:
    """The best rows of a task for each anchor and window: highest score, then smallest id."""

    def __init__(self, block: Block):
        self.block, self.windows, self.chunks = block, block.low.shape[1], block.chunks()
        self.floor = block.low.copy()           # no lower score can still count
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = self.seen = 0

    def add(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        b, order = self.block, np.argsort(ids, kind="stable")
        ids, labels, rows = ids[order], labels[order], rows[order]
        for own in self.chunks:
            allowed = (b.labels[own, None] == labels[None]) == b.same_label
            allowed &= b.ids[own, None] != ids[None]
            which = np.flatnonzero(allowed.any(axis=0))
            if not len(which):
                continue
            allowed, found = allowed[:, which], scores(rows[which], b.vectors[own])
            for w in range(self.windows):
                fits = allowed & (found >= self.floor[own, w, None]) & (found <= b.high[own, w, None])
                some = np.flatnonzero(fits.any(axis=1))
                if not len(some):
                    continue
                fits, part = fits[some], found[some]
                if fits.shape[1] > b.most:
                    least = np.partition(np.where(fits, part, -_LONG - 1), -b.most, axis=1)[:, -b.most, None]
                    fits &= part >= least
                    tied = np.flatnonzero(fits.sum(axis=1) > b.most)        # of equal scores the first by id
                    equal = fits[tied] & (part[tied] == least[tied])
                    fits[tied] &= ~equal | (np.cumsum(equal, axis=1) <= b.most)
                row, column = np.nonzero(fits)
                group = (some[row] + own.start) * self.windows + w
                at = which[column]
                self.parts.append((group, part[row, column], ids[at], at + self.seen))
                self.size += len(group)
            if self.size > _STATE:
                self.cut()
        self.seen += len(ids)

    def cut(self) -> tuple[np.ndarray, ...]:
        """Keep the best of each anchor and window only."""
        if not self.parts:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        group, score, ids, place = (np.concatenate(p) for p in zip(*self.parts))
        order = np.lexsort((ids, -score, group))
        group = group[order]
        first = np.searchsorted(group, group)
        rank = np.arange(len(group)) - first
        keep = rank < self.block.most
        out = tuple(x[keep] for x in (group, score[order], ids[order], place[order]))
        full = rank == self.block.most - 1
        self.floor.reshape(-1)[group[full]] = score[order][full]
        self.parts, self.size = [out], len(out[0])
        return out

    def found(self) -> pa.RecordBatch:
        """One row for each anchor and row that was kept, however many windows it is in."""
        group, score, ids, place = self.cut()
        anchor = group // self.windows
        _, once = np.unique(np.stack([anchor, place]), axis=1, return_index=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.block.ids[anchor[once]]), pa.array(score[once]), pa.array(ids[once])], names=["anchor_id", "score", "id"])


def _candidates(rows: DataFrame, block: Block) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(sent.value)
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                best.add(part.column("vec_id").to_numpy(), part.column("label").to_numpy(),
                         quantised(part.column("vector"), sent.value.vectors.shape[1]))
        yield best.found()

    return rows.mapInArrow(search, _FOUND)


def usable(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """(vec_id, label, vector) of the rows that have an id, a label and a vector of finite components only."""
    odd = F.exists(F.col("embedding"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd).select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"))


def _emitted(rules: Rules):
    """Of keys in order, the negatives of each positive; nothing but an anchor's open windows is held."""
    def emit(keys: Iterator[tuple]) -> Iterator[tuple]:
        anchor, opened, positives = None, [], 0
        for (this, descending, kind, other), _ in keys:
            if this != anchor:
                anchor, opened, positives = this, [], 0
            score = -descending
            if kind == 0:
                if positives < rules.positives:
                    positives += 1
                    opened.append([other, score, *rules.window(score), 0])
                continue
            for w in opened:
                if w[2] <= score <= w[3]:
                    w[4] += 1
                    yield this, w[0], w[4], other, w[1], score
            opened = [w for w in opened if w[4] < rules.negatives and w[2] <= score]

    return emit


_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame, anchors: DataFrame, rules: Rules = Rules(), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``usable``.

    ``anchors`` are rows of ``rows``; an id that occurs twice among them stands for its smallest label and
    vector. A row with the anchor's id is neither positive nor negative of it; other repeated rows each
    count. Vectors of unequal length are compared as if the shorter ended in zeros. An anchor without a
    positive, or a positive with an empty window, gives no row; empty tables give none.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    rows = rows.select("vec_id", "label", "vector")
    own = cut_lineage(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("_v")).select("vec_id", "_v.*"))
    n, dims = own.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], _OUT)
    blocks = -(-n * 8 * max(1, dims) // block_bytes)
    numbered = own.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    kept = []
    for k in range(blocks):
        block = numbered.where(F.col("_block") == k).orderBy("label", "vec_id").toArrow().combine_chunks()     # about block_bytes
        if block.num_rows == 0:
            continue
        ids, labels = block["vec_id"].to_numpy(), block["label"].to_numpy()
        vectors = quantised(block["vector"].combine_chunks(), max(1, dims))
        every = np.full((len(ids), 1), _LONG)
        first = _candidates(rows, Block(ids, labels, vectors, -every, every, True, rules.positives))
        ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")))
        positives = cut_lineage(ranked.where(F.col("_n") <= rules.positives))       # a task gives an anchor that many at most
        place = {int(i): k for k, i in enumerate(ids)}
        low = np.full((len(ids), rules.positives), 1)
        high = np.full((len(ids), rules.positives), 0)
        for r in positives.collect():           # of one block
            low[place[r["anchor_id"]], r["_n"] - 1], high[place[r["anchor_id"]], r["_n"] - 1] = rules.window(r["score"])
        negatives = cut_lineage(_candidates(rows, Block(ids, labels, vectors, low, high, False, rules.negatives)))
        kept += [positives.drop("_n").withColumn("_kind", F.lit(0)), negatives.withColumn("_kind", F.lit(1))]
    pairs = reduce(DataFrame.unionByName, kept)
    keyed = pairs.rdd.map(lambda r: ((r["anchor_id"], -r["score"], r["_kind"], r["id"]), None))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionAndSortWithinPartitions(parts, lambda key: hash(key[0]))
    return spark.createDataFrame(ordered.mapPartitions(_emitted(rules)), _OUT)
