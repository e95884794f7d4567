"""Near-duplicate documents: SuperMinHash signatures, bands, exact confirmation, components.

1. A document's set holds its distinct 5-word shingles. Documents with equal sets form a class; only
   its smallest document goes on, so thousands of exact copies cost one row.
2. SuperMinHash: every shingle ranks all slots of the signature by a permutation of its own, and slot
   values are rank plus a random fraction. The ranks of one shingle are correlated (each rank is used
   once), which lowers the variance; ranks are dealt out in rising order, so a document stops early,
   as soon as every slot has a value. The permutations are affine maps modulo the prime length.
3. Bands of the signature are hashed to buckets. The members of a bucket are linked to its smallest
   one, never all with all; what hangs together by such links is a cluster of candidates.
4. A cluster is dealt in blocks, and pairs of blocks compare full sets. Blocks whose sizes can't reach
   the similarity don't meet. Of the links found, a block pair returns a spanning forest.
5. Components of the confirmed links are the groups.

A pair of similarity 0.75 shares no band with probability (1 - 0.75^6)^61 < 1e-5; pairs that share one
are all compared, so larger groups are found through any of their links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvest.llm.common import Words, bounded_batches, free_name, mixed, released, text_slices
from harvest.llm.components import components
from harvest.session import cut_lineage

SHINGLE = 5
PERCENT = 75            # least similarity of linked documents
SLOTS = 367             # prime; bands use the first BANDS * ROWS slots
BANDS, ROWS = 61, 6
BLOCK = 128             # documents of a block; large clusters have blocks of a sixteenth, up to 1,024
BLOCK_SHINGLES = 1 << 20
COLUMNS = 4_096         # shingles of a dense comparison step
SLICE = 1 << 20         # bytes of text whose shingles are handled at once
MARKS = 1 << 26         # bits of the sent mark table (8 MB at any size) that spares most texts a shuffle

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SIGNED = "doc_id long, n long, hi long, lo long, bands array<long>"


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; fewer words form one shingle."""
    words = Words(texts, lower=True)
    by_word = np.fromiter(map(xxhash.xxh3_64_intdigest, words.distinct()), np.uint64)
    hashes = by_word[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
    n, first = words.counts, words.first
    whole = np.zeros(len(hashes), np.uint64)
    for k in range(min(size, len(hashes))):
        room = len(hashes) - k
        whole[:room] = mixed(whole[:room] * _GOLDEN + hashes[k:])
    sets = []
    for a, b, count in zip(first[:-1].tolist(), first[1:].tolist(), n.tolist()):
        if count >= size:
            sets.append(np.unique(whole[a:b - size + 1]))
        elif count:
            short = np.zeros(1, np.uint64)
            for k in range(a, b):
                short = mixed(short * _GOLDEN + hashes[k:k + 1])
            sets.append(mixed(short + np.uint64(count)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash values, one row per set. Rank in the upper bits, random fraction in the lower 52."""
    out = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    seed = mixed(items ^ np.uint64(0xD1B54A32D192ED03))
    place = (seed % np.uint64(slots)).astype(np.int64)
    step = ((seed >> np.uint64(32)) % np.uint64(slots - 1)).astype(np.int64) + 1
    for rank in range(slots):
        if not len(items):
            break
        value = (mixed(items + np.uint64((rank + 1) * int(_GOLDEN) & (1 << 64) - 1)) >> np.uint64(12)) | np.uint64(rank << 52)
        np.minimum.at(flat, owner * slots + place, value)
        docs = np.unique(owner)
        open_ = np.zeros(len(sets), bool)
        open_[docs] = (out[docs] == np.iinfo(np.uint64).max).any(axis=1)
        more = open_[owner]                     # the others can't change any more
        if not more.all():
            items, owner, place, step = items[more], owner[more], place[more], step[more]
        place += step
        place[place >= slots] -= slots
    return out


def band_keys(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One hash per band, different for equal values in different bands."""
    keys = np.tile(np.arange(bands, dtype=np.uint64), (len(values), 1))
    for k in range(rows):
        keys = mixed(keys * _GOLDEN + values[:, k:bands * rows:rows])
    return keys.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, hi, lo, bands): size, digest and bands of each document's set."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                sets = shingle_sets(part.column("text"))
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                keys = band_keys(signatures(sets))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]),
                     pa.array(digest[:, 1]), bands], names=["doc_id", "n", "hi", "lo", "bands"])
            released()

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(sign, _SIGNED)


def candidate_links(classes: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's smallest."""
    keys = classes.select("class_id", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("class_id").alias("a"), F.max("class_id").alias("_most")).where("a < _most")
    return keys.join(buckets.select("key", "a"), "key").where("class_id > a").select("a", F.col("class_id").alias("b")).distinct()


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Smallest row that each row hangs together with, by full comparison of all rows."""
    rows, size = len(sets), np.array([len(s) for s in sets], np.int64)
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    owner = np.repeat(np.arange(rows), size)
    both = (count > 1)[inverse]
    owner, column = owner[both], shared[inverse[both]]
    common = np.zeros((rows, rows), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int((count > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        table = np.zeros((rows, COLUMNS), np.float32)
        table[owner[a:b], column[a:b] - low] = 1
        common += table @ table.T
    common = common.astype(np.int64)
    near = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    near &= (size > 0)[:, None] & (size > 0)[None, :]
    np.fill_diagonal(near, True)
    label = np.arange(rows)
    while True:
        least = np.where(near, label[None, :], rows).min(axis=1)
        if (least == label).all():
            return label
        label = least


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each run of rows with one ``task``; rows come sorted by it, and runs are bounded."""
    def links(ids: list[int], sets: list[bytes]) -> Iterator[tuple[int, int]]:
        if len(ids) > 1:
            label = linked([np.frombuffer(s, np.uint64) for s in sets])
            yield from ((ids[i], ids[j]) for i, j in enumerate(label.tolist()) if ids[i] != ids[j])

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    task, ids, sets = None, [], []
    for batch in batches:
        found: list[tuple[int, int]] = []
        for t, i, s in zip(batch.column("task").to_pylist(), batch.column("class_id").to_pylist(), batch.column("shingles").to_pylist()):
            if t != task:
                found.extend(links(ids, sets))
                task, ids, sets = t, [], []
            ids.append(i)
            sets.append(s)
        yield out(found)
        released()
    yield out(list(links(ids, sets)))
    released()


def _tasks(clusters: DataFrame) -> DataFrame:
    """(class_id, tasks): the block pairs in which a member of ``clusters(class_id, cluster, n)`` takes part."""
    totals = clusters.groupBy("cluster").agg(F.count("*").alias("_c"), F.sum("n").alias("_t"))
    small = (F.col("_c") <= BLOCK) & (F.col("_t") <= BLOCK_SHINGLES)
    step = F.floor(F.log("n") / F.log(F.lit(100 / PERCENT)))       # linked sets are at most one step apart
    rows = clusters.join(totals, "cluster").withColumn("_s", F.when(small, F.lit(0)).otherwise(step))
    per_block = F.greatest(F.lit(BLOCK), F.least(F.lit(1_024), F.max("_c") / 16))
    blocks = rows.groupBy("cluster", "_s").agg(
        F.greatest(F.ceil(F.count("*") / per_block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("_k"))
    near = blocks
    for shift in (-1, 1):
        other = blocks.select("cluster", (F.col("_s") - shift).alias("_s"), F.col("_k").alias(f"_k{shift}"))
        near = near.join(other, ["cluster", "_s"], "left")
    own = F.pmod(F.xxhash64("class_id"), F.col("_k")).cast("int")

    def others(count: str) -> Column:
        n = F.coalesce(count, F.lit(0))
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def name(s: Column, i: Column, t: Column, j: Column) -> Column:
        return F.xxhash64("cluster", s.cast("long"), i.cast("long"), t.cast("long"), j.cast("long"))

    s = F.col("_s")
    return rows.join(near, ["cluster", "_s"]).withColumn("_i", own).select("class_id", F.concat(
        F.transform(others("_k"), lambda j: name(s, F.least("_i", j), s, F.greatest("_i", j))),
        F.transform(others("_k1"), lambda j: name(s, F.col("_i"), s + 1, j)),
        F.transform(others("_k-1"), lambda j: name(s - 1, j, s, F.col("_i")))).alias("tasks"))


def _mark(ids: np.ndarray) -> np.ndarray:
    return (ids ^ (ids >> 26)) & (MARKS - 1)


def _marks(clusters: DataFrame) -> np.ndarray:
    """Bits of the ids in ``clusters``. Ids may share a bit: the join that follows is exact."""
    bit = F.expr(f"((class_id ^ shiftright(class_id, 26)) & {MARKS - 1}) + 1")        # the functions count from one
    rows = clusters.select(bit.alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_at")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits")).collect()
    out = np.zeros(MARKS // 8, np.uint8)
    for r in rows:
        at = (r["_at"] - 1) * 4096
        out[at:at + 4096] = np.frombuffer(bytes(r["_bits"]), np.uint8)
    return out


def confirmed_links(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the links of similarity ``PERCENT`` inside each cluster."""
    marks = docs.sparkSession.sparkContext.broadcast(_marks(clusters))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                bit = _mark(part.column("class_id").to_numpy())
                part = part.filter(pa.array((marks.value[bit >> 3] >> (bit & 7) & 1).astype(bool)))
                sets = [s.tobytes() for s in shingle_sets(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("class_id"), pa.array(sets, pa.binary())], names=["class_id", "shingles"])
            released()

    texts = docs.where("doc_id IS NOT NULL").selectExpr("CAST(doc_id AS BIGINT) AS class_id", "CAST(text AS STRING) AS text")
    sets = texts.mapInArrow(read, "class_id long, shingles binary").join(_tasks(clusters), "class_id").dropDuplicates(["class_id", "shingles"])
    dealt = sets.select(F.explode("tasks").alias("task"), "class_id", "shingles")
    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(_forest, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Null and empty texts and texts without words have no shingle and are linked with nothing; a row
    without id has no component and is kept. Rows of one id count as one document. Of a group the
    smallest id is kept. An empty table gives an empty one; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    signed_rows = cut_lineage(signed(docs))
    named = signed_rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = cut_lineage(named.groupBy("hi", "lo").agg(
        F.min("doc_id").alias("class_id"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    candidates = components(candidate_links(classes))
    roots = candidates.select(F.col("root").alias("class_id"), F.col("root").alias("cluster")).distinct()
    clusters = candidates.select(F.col("node").alias("class_id"), F.col("root").alias("cluster")).unionByName(roots).join(
        classes.groupBy("class_id").agg(F.max("n").alias("n")), "class_id")
    links = confirmed_links(docs, cut_lineage(clusters))
    one_id = named.select("doc_id", "hi", "lo").join(classes.select("hi", "lo", "class_id"), ["hi", "lo"]).where("doc_id > class_id")
    repeated = named.groupBy("doc_id").agg(F.min("lo").alias("_a"), F.max("lo").alias("_b")).where("_a < _b")
    links = links.unionByName(one_id.join(repeated.select("doc_id"), "doc_id", "left_semi").selectExpr("class_id AS a", "doc_id AS b"))
    groups = components(links).select(F.col("node").alias("class_id"), "root")
    placed = classes.select("hi", "lo", "class_id").join(groups, "class_id", "left").select(
        "hi", "lo", F.coalesce("root", "class_id").alias("_group"))
    rows = signed_rows.select("doc_id", "n", "hi", "lo").join(placed, ["hi", "lo"], "left")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("_group")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"),
                       F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, but one document of each group of near copies.

    The smallest id stays. Of rows that repeat an id, one stays: the one with the smallest text. Rows
    without id stay. Only ids are shuffled: rows are dropped by an anti join with the ids to drop, and
    the few rows of repeated ids are ordered among themselves.
    """
    groups, own = cut_lineage(near_duplicates(docs)), free_name(docs.columns)
    drop = groups.where("NOT kept").select(F.col("doc_id").alias(own)).distinct()
    repeated = groups.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias(own))
    marks = docs.sparkSession.sparkContext.broadcast(_marks(drop.select(F.col(own).alias("class_id"))))

    def only(marked: bool) -> DataFrame:
        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").cast(pa.int64())
                bit = _mark(ids.fill_null(0).to_numpy(zero_copy_only=False))
                hit = (marks.value[bit >> 3] >> (bit & 7) & 1).astype(bool) & ids.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(hit == marked))
            released()

        return docs.mapInArrow(choose, docs.schema)

    doubtful = only(True)                   # rows to drop, and the few that share a mark with one
    rows = only(False).unionByName(doubtful.join(drop, doubtful["doc_id"] == drop[own], "left_anti"))
    if repeated.isEmpty():
        return rows
    once = rows.join(repeated, rows["doc_id"] == repeated[own], "left_anti")
    twice = rows.join(repeated, rows["doc_id"] == repeated[own], "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.xxhash64(*[c for c, t in docs.dtypes if "map" not in t]))
    return once.unionByName(twice.withColumn(own, F.row_number().over(first)).where(F.col(own) == 1).drop(own))
