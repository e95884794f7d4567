"""Token-id files: frequency-ranked ids, one to four bytes each, with the byte counts in a stream of their own.

File (little-endian): magic, number of documents, tokens and control bytes; for each document its id,
a flag for "no id" and its token count; then a control byte for every four tokens (two bits each:
bytes less one), then the bytes of the ranks. Rank 0 is the most frequent id of the corpus, so most
ranks take one byte. A reader finds lengths and places of all ranks by table lookup in numpy.
The file ``ranks`` beside them holds the id of each rank.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvest.llm.common import bounded_batches, text_slices
from harvest.llm.tokens import crc32, encoder, with_end
from harvest.session import cut_lineage, scratch_dir

MAGIC = b"FRQ1"
END = 2                         # id after each document
FILE_TOKENS = 8 << 20           # tokens after which a new file is begun: about 12 MB, whole documents
STEP = 1 << 20                  # ranks coded at once, a multiple of four
_HEAD = "<4sQQQ"

_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
_BYTES = _LENGTHS.sum(axis=1, dtype=np.int64)
_BEFORE = (np.cumsum(_LENGTHS, axis=1) - _LENGTHS).astype(np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and rank bytes; the last group is filled up with zeros."""
    parts = [_encoded_step(ranks[i:i + STEP]) for i in range(0, len(ranks), STEP)]
    return b"".join(p[0] for p in parts), b"".join(p[1] for p in parts)


def _encoded_step(ranks: np.ndarray) -> tuple[bytes, bytes]:
    full = np.zeros(-(-len(ranks) // 4) * 4, np.uint32)
    full[:len(ranks)] = ranks
    size = 1 + (full > 0xFF).astype(np.uint8) + (full > 0xFFFF) + (full > 0xFFFFFF)
    code = ((size - 1).reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    kept = np.arange(4) < size[:, None]
    return code.tobytes(), full.astype("<u4").view(np.uint8).reshape(-1, 4)[kept].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The ranks back, by lookup of each control byte's lengths and places."""
    out, at = [], 0
    for i in range(0, len(control), STEP // 4):
        part = control[i:i + STEP // 4]
        size = int(_BYTES[part].sum())
        out.append(_decoded_step(part, data[at:at + size]))
        at += size
    return np.concatenate(out)[:count] if out else np.zeros(0, np.uint32)


def _decoded_step(control: np.ndarray, data: np.ndarray) -> np.ndarray:
    begin = np.cumsum(_BYTES[control], dtype=np.int64) - _BYTES[control]
    at = (begin[:, None] + _BEFORE[control]).ravel()
    size = _LENGTHS[control].ravel()
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    out = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if len(more):
            out[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def file_bytes(doc_ids: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> bytes:
    """One file for documents whose ranks lie one after another."""
    control, data = encode_ranks(ranks)
    ids = np.array([0 if i is None else i for i in doc_ids], "<i8")
    none = np.array([i is None for i in doc_ids], np.uint8)
    return b"".join((struct.pack(_HEAD, MAGIC, len(ids), len(ranks), len(control)), ids.tobytes(), none.tobytes(),
                     np.asarray(counts, "<u4").tobytes(), control, data))


def parsed(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Ids of the documents, their token counts and all ranks of a file."""
    magic, docs, tokens, controls = struct.unpack_from(_HEAD, content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    view = np.frombuffer(content, np.uint8)[struct.calcsize(_HEAD):]
    ids, none = view[:8 * docs].view("<i8"), view[8 * docs:9 * docs]
    counts = view[9 * docs:13 * docs].copy().view("<u4").astype(np.int64)
    rest = view[13 * docs:]
    ranks = decode_ranks(rest[:controls], rest[controls:], tokens)
    return [None if n else int(i) for i, n in zip(ids, none)], counts, ranks


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def _put(path: str, content: bytes) -> None:
    """Write under another name first: a task that is run again replaces the same file by equal bytes."""
    store, at = _store(path)
    begun = f"{at.rpartition('/')[0]}/_begun-{uuid.uuid4().hex}"
    with store.open_output_stream(begun) as out:
        out.write(content)
    store.move(begun, at)


def encoded(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """(doc_id, n, crc, ids): ids as zstandard-compressed little-endian bytes, two per id where they fit."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in text_slices(batch):
                known = encoder(tokenizer)
                ids, starts = with_end(*known.encode(part.column("text")), end)
                small = ids.astype("<u2") if known.tokenizer.get_vocab_size() <= 1 << 16 else ids.astype("<u4")
                bounds = list(zip(starts[:-1].tolist(), starts[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(starts), pa.int64()),
                     pa.array([crc32(ids[a:b]) for a, b in bounds], pa.int64()),
                     pa.array([coder.compress(small[a:b].tobytes()) for a, b in bounds], pa.binary())],
                    names=["doc_id", "n", "crc", "ids"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(
        encode, "doc_id long, n long, crc long, ids binary")


def _ids(part: pa.RecordBatch) -> Iterator[np.ndarray]:
    plain = zstandard.ZstdDecompressor()
    for n, packed in zip(part.column("n").to_pylist(), part.column("ids").to_pylist()):
        whole = plain.decompress(packed)
        yield np.frombuffer(whole, "<u2" if len(whole) == 2 * n else "<u4")


def frequencies(coded: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs in the corpus; each task adds up its own first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in _ids(batch):
                if len(ids):
                    here = np.bincount(ids)
                    if len(here) > len(total):
                        total = np.concatenate([total, np.zeros(len(here) - len(total), np.int64)])
                    total[:len(here)] += here
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return coded.select("n", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end: int = END) -> DataFrame:
    """Write the files of all rows in ascending doc_id order; returns (part, seq, tokens), one row per file.

    Null ids come first, rows of one id by content. The vocabulary bounds what the driver holds: the id
    of each rank. Files hold ``FILE_TOKENS`` tokens, so one task never holds more than one file.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    coded = cut_lineage(encoded(docs, tokenizer, end))
    ranked = [r["id"] for r in frequencies(coded).orderBy(F.desc("n"), "id").collect()]       # at most the vocabulary
    ids_by_rank = np.array(ranked, "<u4")
    store, at = _store(folder)
    store.create_dir(at, recursive=True)
    _put(f"{folder}/ranks", ids_by_rank.tobytes())
    rank_of = np.zeros(int(ids_by_rank.max()) + 1 if len(ids_by_rank) else 1, np.uint32)
    rank_of[ids_by_rank] = np.arange(len(ids_by_rank))
    sent = spark.sparkContext.broadcast(rank_of)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, docs_here, ranks_here, held = TaskContext.get().partitionId(), 0, [], [], 0
        done: list[tuple[int, int]] = []

        def close() -> None:
            nonlocal seq, held
            content = file_bytes(docs_here, np.array([len(r) for r in ranks_here]), np.concatenate(ranks_here))
            _put(f"{folder}/part-{part:07d}-{seq:05d}.frq", content)
            done.append((seq, held))
            seq, held = seq + 1, 0
            docs_here.clear()
            ranks_here.clear()

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), _ids(batch)):
                if docs_here and held + len(ids) > FILE_TOKENS:
                    close()
                docs_here.append(doc_id)
                ranks_here.append(sent.value[ids])
                held += len(ids)
        if docs_here:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(done), pa.int64()), pa.array([s for s, _ in done], pa.int64()),
             pa.array([t for _, t in done], pa.int64())], names=["part", "seq", "tokens"])

    ordered = coded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n", "crc")
    return cut_lineage(ordered.select("doc_id", "n", "ids").mapInArrow(write, "part long, seq long, tokens long"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(part, seq, doc_id, before, n_tokens, ids_crc32): every document of the files.

    ``before``: tokens of its file before it. Files are read by Spark and decoded where they are read.
    """
    head = spark.read.format("binaryFile").load(f"{folder}/ranks").select("content").first()
    sent = spark.sparkContext.broadcast(np.frombuffer(bytes(head["content"]), "<u4"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                doc_ids, counts, ranks = parsed(content.as_py())
                ids = sent.value[ranks].astype("<u4")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[e - n:e]) for e, n in zip(ends.tolist(), counts.tolist())]
                part, seq = map(int, name.removeprefix("part-").removesuffix(".frq").split("-"))
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int64()), pa.array([seq] * n, pa.int64()), pa.array(doc_ids, pa.int64()),
                     pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "before", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.frq").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return named.mapInArrow(read, "part long, seq long, doc_id long, before long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end: int = END, folder: str | None = None) -> DataFrame:
    """Write the files and read them back: (doc_id, start, n_tokens, ids_crc32) for every row of ``docs``.

    A null text is an empty one and has the end id alone; repeated rows are written one by one; an
    empty table has no file and no row. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    files = write_token_files(docs, tokenizer, folder, end)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    earlier = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)         # one row per file of 8M tokens
    starts = files.withColumn("_first", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))).drop("tokens")
    return read_token_files(spark, folder).join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("_first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
