"""Document probability under a unigram model of subword pieces, summed over all segmentations.

The pieces are those of a public vocabulary. Its scores order the pieces; by Zipf's law they become the
first unigram probabilities, which rounds of expectation-maximisation re-estimate from the training
words. A word's probability is that of all paths through the lattice of its pieces, by a forward
recursion in log space; a character that no piece covers falls back to byte pieces. Pieces don't cross
white space, so a document's probability is the product over its words and an end.

Every distinct word of the corpus is counted, and its lattice is summed, once. The most frequent words
(a fixed number) are sent to the tasks that score; all others reach their documents by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvest.llm.common import Words, bounded_batches, mixed, text_slices
from harvest.llm.language import held_out
from harvest.session import cut_lineage

ROUNDS = 2                  # of re-estimation
FIRST_RANK = 100            # offset of the Zipf law
SMOOTHING = 0.1             # expected count added to every piece
SENT_WORDS = 200_000        # most frequent words that are sent to tasks: 8 MB
WORDS_AT_ONCE = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


@dataclass
class Pieces:
    """Vocabulary with natural-log probabilities. ``keys`` are sorted piece hashes; bytes come last."""

    keys: np.ndarray
    log_p: np.ndarray           # of the pieces by key, then 256 bytes, then the end
    longest: int

    def __post_init__(self):
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(mixed(self.keys) >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces, and their numbers."""
        at = np.flatnonzero(self.seen[(mixed(hashes) >> np.uint64(64 - _BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[place] == hashes[at]
        return at[hit], place[hit]

    @property
    def end(self) -> float:
        return float(self.log_p[-1])


def _hash(piece: str) -> int:
    value = 0
    for c in piece:
        value = (value * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
    return value


def vocabulary(path: str) -> Pieces:
    """Pieces of the sentencepiece model at ``path``; its scores rank them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and "▁" not in piece[1:]:
            plain[piece] = model.get_score(i)
    order = sorted(plain, key=lambda p: (-plain[p], p))
    rank = {p: k for k, p in enumerate(order)}
    hashed = sorted((_hash(p), rank[p]) for p in plain)
    ranks = np.array([r for _, r in hashed] + [len(plain)] * 256 + [0], np.float64)
    weight = 1 / (FIRST_RANK + ranks)
    return Pieces(np.array([h for h, _ in hashed], np.uint64), np.log(weight / weight.sum()), max(map(len, plain)))


def _groups(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, code points) of words of one length, the word mark in front."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    bounds = np.flatnonzero(np.diff(size[order])) + 1
    for run in np.split(order, bounds):
        length = int(size[run[0]]) if len(run) else 0
        step = max(1, min(WORDS_AT_ONCE, (1 << 21) // (length + 1)))
        for a in range(0, len(run), step):
            at = run[a:a + step]
            text = "".join("▁" + words[i] for i in at)
            yield at, np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(at), length + 1)


def _byte_costs(codes: np.ndarray, log_p: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Log probability of each code by its bytes, the place of each code among the distinct ones, their bytes."""
    distinct, place = np.unique(codes, return_inverse=True)
    spelled = [chr(c).encode("utf-8", "surrogatepass") for c in distinct.tolist()]
    cost = np.array([sum(log_p[first + b] for b in s) for s in spelled])
    return cost, place.reshape(codes.shape), spelled


def marginals(words: list[str], model: Pieces, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each word; with ``counts`` also the expected number of each piece."""
    out = np.zeros(len(words))
    expected = np.zeros(len(model.log_p)) if counts is not None else None
    first = len(model.keys)
    for at, codes in _groups(words):
        rows, length = codes.shape
        cost, place, spelled = _byte_costs(codes, model.log_p, first)
        alpha = np.full((length + 1, rows), -np.inf)
        alpha[0] = 0
        edges = []
        for i in range(length):
            alpha[i + 1] = np.logaddexp(alpha[i + 1], alpha[i] + cost[place[:, i]])
            value = np.zeros(rows, np.uint64)
            for j in range(i, min(length, i + model.longest)):
                value = value * _BASE + (codes[:, j].astype(np.uint64) + np.uint64(1))
                hit, piece = model.numbers(value)
                if len(hit):
                    alpha[j + 1, hit] = np.logaddexp(alpha[j + 1, hit], alpha[i, hit] + model.log_p[piece])
                    if counts is not None:
                        edges.append((i, j + 1, hit, piece))
        out[at] = alpha[length]
        if counts is None:
            continue
        beta = np.full((length + 1, rows), -np.inf)
        beta[length] = 0
        weight = np.log(np.maximum(counts[at], 1e-300)) - alpha[length]
        by_start: dict[int, list] = {}
        for e in edges:
            by_start.setdefault(e[0], []).append(e)
        spelled_counts = np.zeros(len(spelled))
        for i in range(length - 1, -1, -1):
            beta[i] = cost[place[:, i]] + beta[i + 1]
            for _, j, hit, piece in by_start.get(i, ()):
                beta[i, hit] = np.logaddexp(beta[i, hit], model.log_p[piece] + beta[j, hit])
                share = np.exp(alpha[i, hit] + model.log_p[piece] + beta[j, hit] + weight[hit])
                expected += np.bincount(piece, weights=share, minlength=len(expected))
            spelled_counts += np.bincount(place[:, i], weights=np.exp(alpha[i] + cost[place[:, i]] + beta[i + 1] + weight), minlength=len(spelled))
        for s, n in zip(spelled, spelled_counts):
            for b in s:
                expected[first + b] += n
    return out, expected


def word_counts(docs: DataFrame, modulus: int, rest: int) -> DataFrame:
    """(word, c, n): how often each distinct word occurs in the training rows and in all rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                words = Words(part.column("text"), lower=True)
                trained = ~part.column("held_out").to_numpy(zero_copy_only=False)
                size = len(words.distinct())
                every = np.bincount(words.ids, minlength=size)
                own = np.bincount(words.ids[trained[words.owner]], minlength=size)
                spelled = words.values.dictionary if words.values is not None else pa.array([], pa.binary())
                yield pa.RecordBatch.from_arrays([spelled.cast(pa.string()), pa.array(own[:size], pa.int64()), pa.array(every[:size], pa.int64())],
                                                 names=["word", "c", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text"), held_out(modulus, rest).alias("held_out"))
    return texts.mapInArrow(count, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def trained(words: DataFrame, documents: int, start: Pieces, rounds: int = ROUNDS) -> Pieces:
    """The pieces re-estimated from the training counts of ``words`` and the number of training documents."""
    spark, model = words.sparkSession, start
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((model.keys, model.log_p, model.longest))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Pieces(*sent.value)
            total = np.zeros(len(own.log_p))
            for batch in batches:
                for a in range(0, batch.num_rows, 4 * WORDS_AT_ONCE):
                    part = batch.slice(a, 4 * WORDS_AT_ONCE)
                    total += marginals(part.column("word").to_pylist(), own, part.column("c").to_numpy().astype(np.float64))[1]
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.float64())], names=["piece", "e"])

        rows = words.where("c > 0").select("word", "c").mapInArrow(expect, "piece long, e double")
        expected = np.full(len(model.log_p), SMOOTHING)
        for r in rows.groupBy("piece").agg(F.sum("e").alias("e")).collect():         # at most one row per piece
            expected[r["piece"]] += r["e"]
        expected[-1] += documents
        model = Pieces(model.keys, np.log(expected / expected.sum()), model.longest)
    return model


def _digests(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.int64).reshape(-1, 2)


def word_scores(words: DataFrame, model: Pieces) -> DataFrame:
    """(hi, lo, c, n, lp): digest, counts and natural-log probability of each word."""
    sent = words.sparkSession.sparkContext.broadcast((model.keys, model.log_p, model.longest))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces(*sent.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 4 * WORDS_AT_ONCE):
                part = batch.slice(a, 4 * WORDS_AT_ONCE)
                spelled = part.column("word").to_pylist()
                digest = _digests([w.encode() for w in spelled])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest[:, 0]), pa.array(digest[:, 1]), part.column("c"), part.column("n"),
                     pa.array(marginals(spelled, own)[0], pa.float64())], names=["hi", "lo", "c", "n", "lp"])

    return words.mapInArrow(score, "hi long, lo long, c long, n long, lp double")


_PARTS = "key_hi long, key_lo long, doc_id long, rows long, tokens long, known long, base double, lp double, hi long, lo long, times long"


def _scored(docs: DataFrame, often: dict[str, np.ndarray], bottom: float, modulus: int, rest: int) -> DataFrame:
    """One row per document with the sums over the words that were sent, and one per other distinct word of it."""
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, c, lp, hi_of = (sent.value[k] for k in ("lo", "c", "lp", "hi"))
        for batch in batches:
            for part in text_slices(batch):
                words = Words(part.column("text"), lower=True)
                n = part.num_rows
                digest = _digests(words.distinct())
                place = np.minimum(np.searchsorted(keys, digest[:, 1]), max(0, len(keys) - 1))
                sure = (keys[place] == digest[:, 1]) & (hi_of[place] == digest[:, 0]) if len(keys) else np.zeros(len(digest), bool)
                ids, owner = words.ids, words.owner
                fine = sure[ids] if len(ids) else np.zeros(0, bool)
                at = place[ids[fine]]
                add = [np.bincount(owner[fine], weights=x, minlength=n) for x in (
                    (c[at] > 0).astype(float), np.log10(c[at] + 1.0) - bottom, lp[at])]
                row, times = np.unique(owner[~fine] * max(1, len(digest)) + ids[~fine], return_counts=True)
                doc, word = row // max(1, len(digest)), row % max(1, len(digest))
                names = [xxhash.xxh3_128_digest(f"{i}\0".encode() + (t or "").encode()) for i, t in zip(
                    part.column("doc_id").to_pylist(), part.column("text").to_pylist())]
                key = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
                ones, none = np.ones(n, np.int64), pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[:, 0]), pa.array(key[:, 1]), part.column("doc_id"), pa.array(ones), pa.array(words.counts + 1),
                     pa.array(add[0].astype(np.int64)), pa.array(add[1], pa.float64()), pa.array(add[2], pa.float64()), none, none, none], names=_NAMES)
                k, zero = len(row), np.zeros(len(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[doc, 0]), pa.array(key[doc, 1]), part.column("doc_id").take(pa.array(doc)), pa.array(np.zeros(k, np.int64)),
                     pa.array(np.zeros(k, np.int64)), pa.array(np.zeros(k, np.int64)), pa.array(zero), pa.array(zero),
                     pa.array(digest[word, 0]), pa.array(digest[word, 1]), pa.array(times, pa.int64())], names=_NAMES)

    texts = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    return texts.mapInArrow(score, _PARTS)


_NAMES = [x.split()[0] for x in _PARTS.split(",")]


def score_documents(docs: DataFrame, path: str, modulus: int = 7, rest: int = 2, sent_words: int = SENT_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Training rows are those whose id leaves another remainder than ``rest``; rows without id are held
    out. A null or empty text is an end alone. Repeated rows get a row each with the same scores. With
    nothing to learn from, counts are zero and the pieces keep their first probabilities.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    words = cut_lineage(word_counts(docs, modulus, rest))
    ends = docs.where(~held_out(modulus, rest)).count()
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    tokens, distinct = total["n"] + ends, total["v"] + (ends > 0)
    bottom = float(np.log10(tokens + distinct + 1))
    model = trained(words, ends, vocabulary(path))
    scores = cut_lineage(word_scores(words, model))
    room, least = sent_words, None                                  # words that occur ``least`` times or more fit
    for r in scores.groupBy("n").count().orderBy(F.desc("n")).limit(sent_words).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["n"]
    top = (scores.where(F.col("n") >= least) if least is not None else scores.limit(0)).toArrow()      # at most ``sent_words`` rows
    order = np.argsort(top["lo"].to_numpy())
    often = {k: top[k].to_numpy()[order] for k in ("hi", "lo", "c", "lp")}
    parts = cut_lineage(_scored(docs, often, bottom, modulus, rest))
    rare = parts.where("times IS NOT NULL").select("key_hi", "key_lo", "hi", "lo", "times").join(scores.drop("n"), ["hi", "lo"])
    sums = ["key_hi", "key_lo", "doc_id", "rows", "tokens", "known", "base", "lp"]
    added = rare.select("key_hi", "key_lo", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("rows"),
                        F.lit(0).cast("long").alias("tokens"), F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("known"),
                        (F.col("times") * (F.log10(F.col("c") + 1.0) - bottom)).alias("base"), (F.col("times") * F.col("lp")).alias("lp"))
    whole = parts.where("times IS NULL").select(*sums).unionByName(added).groupBy("key_hi", "key_lo").agg(
        F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in sums[3:]])

    def each(name: str) -> Column:
        return F.col(name) / F.col("rows")                     # equal rows have equal sums

    out = whole.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.select(
        "doc_id", held_out(modulus, rest).alias("held_out"), each("tokens").cast("long").alias("n_tokens"),
        (each("known") + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (each("base") + float(np.log10(ends + 1.0) - bottom)).alias("base_score"),
        ((each("lp") + model.end) / float(np.log(10))).alias("score"))
