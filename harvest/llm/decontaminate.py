"""Benchmark items inside documents, exact or reworded, by latent retrieval and alignment.

1. Document frequencies of words are counted over all documents, by hash in a table of fixed size.
2. Passages, all of the benchmark and all of the documents, are rows of TF-IDF weights, stored once as numbers.
   A randomised SVD of them gives the latent space: rows are multiplied by a random matrix
   and projected back, the result is orthogonalised and goes round again; only sums of fixed size
   leave the tasks. The vocabulary is hashed: where there are more words than rows, the benchmark's and the most
   frequent ones have a row of their own, all others share the rest. The two kinds of passages are balanced, so neither
   the common words of the corpus nor the benchmark alone make the space. Directions are scaled towards equal variance.
3. All documents are read in overlapping windows, folded into the latent space, and compared with the
   items by cosine, with latent norms on both sides. Nothing is sampled here.
4. Candidates of a weak latent cosine must share weighted words with the item; what is left is aligned
   word by word: the longest common subsequence must reach a share of the item. Less counts if the
   item's answer, its last sentence, is there, and least if the latent cosine is strong, as a paraphrase
   keeps few words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvest.llm.common import Words, bounded_batches, byte_set, released, text_slices
from harvest.session import cut_lineage

HALF = 32               # words of half a window; windows are two halves, each half lies in two
RANK = 128              # latent dimensions at most
EXTRA = 16              # random directions beyond those
ITERATIONS = 2          # times the directions are multiplied by the passages again, which sharpens them
POWER = 0.5             # of the singular values by which directions are scaled down
PASSAGE_CHARS = 400
BALANCE = 0.3           # weight of all benchmark passages, as a share of that of all documents' (as lengths)
WORDS = 1 << 15         # rows of the vocabulary at most; with more words than that,
SHARED = 1 << 13        # of these are shared by the words that have none of their own
TOGETHER = 32           # passages multiplied at once
COSINE = 0.25           # least latent cosine of a candidate
STRONG = 0.5            # latent cosine that needs no shared words
WEIGHT = 0.15           # least cosine of TF-IDF weights below that
SHARE = 0.55            # least aligned share of the item's words
ANSWER_SHARE = 0.4      # the same if the answer is found
PARAPHRASE_SHARE = 0.2  # the same if the answer is found and the latent cosine is strong
ANSWER_WORDS = 4        # words of an answer at least and at most three times as many
PLACES = 1 << 20        # hashed document frequencies
ITEMS = 2_000           # items of a block, and
BLOCK_CHARS = 2 << 20   # their characters, about: bounds what tasks are sent
SLICE = 1 << 20         # bytes of text handled at once
STORED = 1 << 18        # bytes of text whose word counts are stored as one row
STEP = 1 << 16          # numbers of a vector that travel in one row

_WORD = byte_set(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
_PYTHON_WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
SCHEMA = "doc_id long, item_id long, start long, cosine double, lcs long, item_words long, answer boolean"


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and characters beyond ASCII."""
    return _PYTHON_WORD.findall((text or "").lower())


def answer_of(text: str | None) -> list[str]:
    """Words of the item's last sentence, within the allowed number."""
    every = words_of(text)
    last = words_of(re.split(r"[.?!\n]+", (text or "").strip().rstrip(".?!\n"))[-1])
    return every[-max(ANSWER_WORDS, min(3 * ANSWER_WORDS, len(last))):]


def hashed(words: list[str]) -> np.ndarray:
    """64-bit hashes of words; the lowest bits are the places of their document frequencies."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _doc_words(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of the texts, and the hash of each distinct one."""
    words = Words(pc.utf8_lower(texts), inside=_WORD)
    return words, hashed(words.distinct())


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(PLACES)).astype(np.int64)


def summed(rows: DataFrame, vector: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """Sum over all tasks of the vector that ``vector`` makes of a task's rows; it has the same length in all."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = vector(batches)
        for k in range(0, len(whole), STEP):
            yield pa.RecordBatch.from_arrays([pa.array([k // STEP]), pa.array([whole[k:k + STEP].tobytes()], pa.binary())], names=["at", "v"])

    kind = np.float32

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, v in zip(batch.column("at").to_pylist(), batch.column("v").to_pylist()):
                total[at] = total.get(at, 0) + np.frombuffer(v, kind).astype(np.float64)
        for at, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([v.astype(kind).tobytes()], pa.binary())], names=["at", "v"])

    schema = "at long, v binary"
    found = rows.mapInArrow(parts, schema).repartition("at").mapInArrow(add, schema).toArrow()      # of fixed size, passed on as it comes
    places, values = found.column("at").to_pylist(), [v.as_buffer() for v in found.column("v")]
    sizes = {at: v.size // np.dtype(kind).itemsize for at, v in zip(places, values)}
    whole = np.empty(sum(sizes.values()), kind)
    for at, v in zip(places, values):
        whole[at * STEP:at * STEP + sizes[at]] = np.frombuffer(v, kind)
    del found, values
    released()
    return whole


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Of each place the number of documents with a word there, and the number of documents, over all rows.

    Counts travel as parts of 65,536 and the rest, so that sums of 32-bit floats stay exact.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(PLACES + 1, np.int64)
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                words, hashes = _doc_words(part.column("text"))
                if len(words.ids):
                    pairs = np.sort(words.owner * PLACES + _places(hashes)[words.ids])
                    once = pairs[np.append(True, pairs[1:] != pairs[:-1])]
                    np.add.at(total, once % PLACES, 1)
                total[-1] += part.num_rows
            released()
        return np.concatenate([total & 0xFFFF, total >> 16]).astype(np.float32)

    got = summed(docs.select(F.col("text").cast("string").alias("text")), count)
    if not len(got):
        return np.zeros(PLACES), 0
    low, high = np.split(got, 2)
    total = low + high * np.float64(65_536)
    return total[:-1], int(total[-1])


def every_passage(docs: DataFrame) -> DataFrame:
    """All passages of the documents, ``worded`` with kind 0; equal texts count once."""
    rows = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").withColumn("_h", F.xxhash64("text"))
    return worded(rows.dropDuplicates(["_h"]).select("text", F.lit(0.0).alias("kind")), "kind", PASSAGE_CHARS)


def worded(passages: DataFrame, tag: str, chars: int | None = None) -> DataFrame:
    """Word counts of ``passages(text, tag)``, one row for about STORED bytes of texts of one tag; rows that have this form stay.

    ``hashes`` are those of the row's distinct words, ``at`` and ``counts`` say which of them a passage holds and how often,
    passage after passage, ``sizes`` how many those are. Texts are cut every ``chars`` characters, a word belongs where it starts.
    """
    if "sizes" in passages.columns:
        return passages

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = batch.column(tag).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, tags[1:] != tags[:-1])).tolist()
            for first, end in zip(cuts, [*cuts[1:], len(tags)]):
                for part in text_slices(batch.slice(first, end - first), limit=STORED):
                    words, hashes = _doc_words(part.column("text"))
                    if not len(words.ids):
                        continue
                    owner = words.owner
                    begins = np.append(True, owner[1:] != owner[:-1])
                    if chars:
                        read = np.cumsum((words.data & 0xC0) != 0x80, dtype=np.int32)       # characters, not bytes
                        piece = (read[words.at] - read[words.offsets[owner]]) // chars
                        begins[1:] |= piece[1:] != piece[:-1]
                    pairs, counts = np.unique((np.cumsum(begins) - 1) * len(hashes) + words.ids, return_counts=True)
                    parts = (hashes, (pairs % len(hashes)).astype(_index(len(hashes))), counts.astype(np.uint32),
                             np.bincount(pairs // len(hashes)).astype(np.uint32))
                    yield pa.RecordBatch.from_arrays([pa.array([float(tags[first])]), *[pa.array([p.tobytes()], pa.binary()) for p in parts]],
                                                     names=[tag, "hashes", "at", "counts", "sizes"])
            released()

    return passages.select("text", F.col(tag).cast("double").alias(tag)).mapInArrow(each, f"{tag} double, hashes binary, at binary, counts binary, sizes binary")


def _index(n: int) -> type:
    """Type of the numbers below ``n`` as stored."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def vocabulary_of(passages: DataFrame) -> np.ndarray:
    """Sorted hashes of the words of ``passages(text, kind)`` that lie in the benchmark (kind 1) or in two passages or more.

    Others can't link a passage to an item. If there are more than WORDS, those of the benchmark come first, then those of the
    most passages; they follow SHARED numbers that stand for the rows of all other words.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, hashes, at in zip(*(batch.column(c).to_pylist() for c in ("kind", "hashes", "at"))):
                found = np.frombuffer(hashes, np.int64)
                n = np.bincount(np.frombuffer(at, _index(len(found))), minlength=len(found))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n), pa.array(np.full(len(found), kind))], names=["h", "n", "kind"])

    words = worded(passages, "kind").mapInArrow(each, "h long, n long, kind double").groupBy("h").agg(F.sum("n").alias("n"), F.max("kind").alias("kind"))
    level = (F.when(F.col("kind") == 1, 1_000).otherwise(0) + F.floor(8 * F.log2("n"))).cast("int")
    words = cut_lineage(words.where("n > 1 OR kind = 1").select("h", level.alias("level")))
    sizes = sorted(((r["level"], r["count"]) for r in words.groupBy("level").count().collect()), reverse=True)
    own, shared = words, 0
    if sum(n for _, n in sizes) > WORDS:
        total = np.cumsum([n for _, n in sizes])
        kept = int(np.searchsorted(total, WORDS - SHARED, side="right"))
        own, shared = words.where(F.col("level") > sizes[kept][0]), SHARED
    found = own.select("h").toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64)
    return np.concatenate([np.arange(shared, dtype=np.uint64), np.sort(found)])


def numbers_in(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted vocabulary; if it isn't there, that of the row it shares or, without shared rows, the length."""
    if not len(vocabulary):
        return np.zeros(len(hashes), np.int64)
    at, shared = np.searchsorted(vocabulary, hashes), int(np.searchsorted(vocabulary, SHARED))
    other = (hashes % np.uint64(shared)).astype(np.int64) if shared == SHARED else len(vocabulary)
    return np.where(vocabulary[np.minimum(at, len(vocabulary) - 1)] == hashes, at, other)


def tfidf(text: str | None, vocabulary: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a passage's words in the vocabulary and their TF-IDF weights, of unit length."""
    hashes, n = np.unique(hashed(words_of(text)), return_counts=True)
    at = numbers_in(vocabulary, hashes)
    value = (n * weights[_places(hashes)])[at < len(vocabulary)]
    return at[at < len(vocabulary)], value / max(1e-12, float(np.linalg.norm(value)))


def latent_words(passages: DataFrame, vocabulary: np.ndarray, weights: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Word-by-rank matrix of the randomised SVD of ``passages(text, factor)``, and the singular values.

    As many tasks as run at once add up the products, as each hands on a whole matrix.
    """
    if not len(vocabulary):
        return np.zeros((0, 1), np.float32), np.ones(1)
    context, size, width = passages.sparkSession.sparkContext, len(vocabulary), rank + EXTRA
    sent = context.broadcast((vocabulary, weights.astype(np.float32)))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of some passages at a time and the weights of these words in each."""
        seen, place = np.zeros(size, bool), np.zeros(size, np.int64)
        for batch in batches:
            for factor, *parts in zip(*(batch.column(c).to_pylist() for c in ("factor", "hashes", "at", "counts", "sizes"))):
                hashes, counts, sizes = np.frombuffer(parts[0], np.uint64), np.frombuffer(parts[2], np.uint32), np.frombuffer(parts[3], np.uint32)
                at = np.frombuffer(parts[1], _index(len(hashes)))
                number, owner = numbers_in(sent.value[0], hashes)[at], np.repeat(np.arange(len(sizes)), sizes)
                value = counts * sent.value[1][_places(hashes)][at]
                number, owner, value = number[number < size], owner[number < size], value[number < size]
                norm = np.sqrt(np.bincount(owner, value * value, len(sizes)))
                value = value * (factor / np.maximum(1e-12, norm))[owner]
                bounds = np.searchsorted(owner, np.arange(0, len(sizes) + TOGETHER, TOGETHER)).tolist()
                for k, (low, high) in enumerate(zip(bounds[:-1], bounds[1:])):
                    own = number[low:high]
                    seen[own] = True
                    used = np.flatnonzero(seen)
                    seen[used], place[used] = False, np.arange(len(used))
                    cell = (owner[low:high] - k * TOGETHER) * len(used) + place[own]
                    if len(used):
                        yield used, np.bincount(cell, value[low:high], TOGETHER * len(used)).astype(np.float32).reshape(TOGETHER, -1)

    rows = worded(passages, "factor").select("factor", "hashes", "at", "counts", "sizes")

    def back(directions: Callable[[], np.ndarray]) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            own = directions()
            out = np.zeros_like(own)
            for used, value in projected(batches):
                out[used] += value.T @ (value @ own[used])
            return out.ravel()

        return _orthonormal(summed(rows.coalesce(max(4, context.defaultParallelism)), part).reshape(size, -1))

    basis = back(lambda: np.random.default_rng(0).standard_normal((size, width), np.float32))      # the same in every task
    for _ in range(ITERATIONS):
        held = context.broadcast(basis)
        basis = back(lambda held=held: held.value)
        held.destroy()
    held, count = context.broadcast(basis), basis.shape[1]

    def gram(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((count, count))
        for used, value in projected(batches):
            y = value @ held.value[used]
            out += y.T @ y
        return out.ravel().astype(np.float32)

    square, turn = np.linalg.eigh(summed(rows, gram).reshape(count, count).astype(np.float64))
    held.destroy()
    order = np.argsort(square)[::-1][:rank]
    order = order[square[order] >= 1e-4 * max(1e-300, float(square.max()))]
    return basis @ turn[:, order].astype(np.float32), np.sqrt(np.maximum(square[order], 1e-12))


def _orthonormal(columns: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns, by their small Gram matrix; directions that hardly occur are left out."""
    gram = np.zeros((columns.shape[1], columns.shape[1]))
    for a in range(0, len(columns), 4_096):
        part = columns[a:a + 4_096].astype(np.float64)
        gram += part.T @ part
    value, vector = np.linalg.eigh(gram)
    used = value >= 1e-9 * max(1e-300, float(value.max()))
    return columns @ (vector[:, used] / np.sqrt(np.maximum(value[used], 1e-300))).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1), 1e-9)[:, None]


class Space:
    """The latent space: ``table`` has the scaled latent row of each row of ``vocabulary`` and one of zeros, ``weights`` those of words at all places."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, latent: np.ndarray, values: np.ndarray):
        self.vocabulary, self.weights = vocabulary, weights.astype(np.float32)
        rows = latent * (values ** -POWER).astype(np.float32)
        self.table = np.vstack([rows, np.zeros((1, rows.shape[1]), np.float32)]).astype(np.float32)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        return self.table[numbers_in(self.vocabulary, hashes)] * self.weights[_places(hashes)][:, None]

    def folded(self, words: np.ndarray, weights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Weighted sum of the latent rows of each run of words, of HALF words at most; place by place, so that sums stay in the processor's cache."""
        out = np.zeros((len(starts), self.table.shape[1]), np.float32)
        words, weights = np.append(words, len(self.vocabulary)), np.append(weights, np.float32(0))[:, None]
        taken = np.empty((256, out.shape[1]), np.float32)
        for a in range(0, len(starts), 256):
            low, high, total = starts[a:a + 256], ends[a:a + 256], out[a:a + 256]
            for k in range(HALF):
                at = np.where(low + k < high, low + k, len(words) - 1)
                own = self.table.take(words[at], axis=0, out=taken[:len(at)], mode="clip")
                own *= weights[at]
                total += own
        return out


class Matcher:
    """What a task needs, besides the space, to look for a block of items (id, text)."""

    def __init__(self, items: list[tuple[int, str | None]], space: Space):
        self.ids = [i for i, _ in items]
        self.vocabulary = np.unique(np.concatenate([hashed(words_of(t)) for _, t in items]))
        self.texts = [self.numbered(words_of(t)) for _, t in items]
        self.answers = [self.numbered(answer_of(t)) for _, t in items]
        rows, square = space.rows(self.vocabulary), space.weights[_places(self.vocabulary)] ** 2
        self.items = _unit(np.stack([rows[t].sum(axis=0) for t in self.texts]))
        self.norms = np.array([max(1e-9, math.sqrt(float(square[t].sum()))) for t in self.texts], np.float32)
        member = np.zeros((len(items), len(self.vocabulary) // 8 + 1), np.uint8)
        for k, text in enumerate(self.texts):
            np.bitwise_or.at(member[k], np.array(text) >> 3, (1 << (np.array(text) & 7)).astype(np.uint8))
        self.member = member
        self.masks = []
        for text in self.texts:
            mask: dict[int, int] = {}
            for k, w in enumerate(text):
                mask[w] = mask.get(w, 0) | 1 << k
            self.masks.append(mask)

    def numbered(self, words: list[str]) -> list[int]:
        return self.numbers(hashed(words)).tolist()

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash in the vocabulary, -1 if it is no item's."""
        at = numbers_in(self.vocabulary, hashes)
        return np.where(at < len(self.vocabulary), at, -1)

    def aligned(self, item: int, context: list[int]) -> int:
        """Length of the longest common subsequence, a bit per word of the item."""
        full = (1 << len(self.texts[item])) - 1
        state, mask = full, self.masks[item]
        for own in filter(None, map(mask.get, context)):
            hit = state & own
            state = (state + hit | state - hit) & full
        return len(self.texts[item]) - state.bit_count()

    def answered(self, item: int, context: list[int]) -> bool:
        answer = self.answers[item]
        return any(context[k:k + len(answer)] == answer for k in range(len(context) - len(answer) + 1))

    def shared(self, item: np.ndarray, low: np.ndarray, high: np.ndarray, numbers: np.ndarray, square: np.ndarray) -> np.ndarray:
        """Cosine of the TF-IDF weights of items and of the words from ``low`` to ``high``."""
        at = low[:, None] + np.arange(2 * HALF)
        inside = at < high[:, None]
        at = np.minimum(at, len(numbers) - 1)
        own, weight = numbers[at], np.where(inside, square[at], 0)
        hit = (own >= 0) & (self.member[item[:, None], np.maximum(own, 0) >> 3] >> (np.maximum(own, 0) & 7).astype(np.uint8) & 1).astype(bool)
        return np.where(hit, weight, 0).sum(axis=1) / (np.sqrt(np.maximum(weight.sum(axis=1), 1e-9)) * self.norms[item])

    def found(self, texts: pa.Array, space: Space) -> list[tuple[int, int, int, float, int, bool]]:
        """(row, item, start, cosine, aligned words, answer found), the best window of each row and item."""
        words, hashes = _doc_words(texts)
        if not len(words.ids):
            return []
        numbers = self.numbers(hashes)[words.ids]
        weight = space.weights[_places(hashes)][words.ids]
        square = weight ** 2
        n = words.counts
        halves = -(-n // HALF)
        base = np.cumsum(halves) - halves
        owner = np.repeat(np.arange(len(n)), halves)
        start = words.first[owner] + (np.arange(len(owner)) - base[owner]) * HALF
        end = words.first[owner + 1]
        latent = space.folded(numbers_in(space.vocabulary, hashes)[words.ids], weight, start, end)
        nxt = np.flatnonzero(np.append(owner[1:] == owner[:-1], False))
        latent[nxt] = latent[nxt] + latent[nxt + 1]
        best: dict[tuple[int, int], tuple[int, int, float, bool]] = {}
        for a in range(0, len(owner), 1_024):
            cosine = _unit(latent[a:a + 1_024]) @ self.items.T
            at, item = np.nonzero(cosine >= COSINE)
            near = cosine[at, item]
            at += a
            fine = near >= STRONG
            for b in range(0, len(at), 4_096):
                part = slice(b, b + 4_096)
                fine[part] |= self.shared(item[part], start[at[part]], end[at[part]], numbers, square) >= WEIGHT
            for w, k, cos in zip(at[fine].tolist(), item[fine].tolist(), near[fine].tolist()):
                row, size = int(owner[w]), len(self.texts[k])
                first, last = int(words.first[row]), int(words.first[row + 1])
                context = numbers[max(first, int(start[w]) - size):min(last, int(start[w]) + 2 * HALF + size)].tolist()
                lcs = self.aligned(k, context)
                least = PARAPHRASE_SHARE if cos >= STRONG else ANSWER_SHARE
                if lcs < least * size or best.get((row, k), (0,))[0] >= lcs:
                    continue
                answer = self.answered(k, context)
                if lcs >= SHARE * size or answer:
                    best[row, k] = (lcs, int(start[w]) - first, cos, answer)
        return [(row, k, at, cos, lcs, answer) for (row, k), (lcs, at, cos, answer) in sorted(best.items())]


def fitted(docs: DataFrame, items: DataFrame) -> Space:
    """The latent space of all passages of a benchmark and of the documents; two passes over all rows, the others over stored numbers."""
    df, n = document_frequencies(docs)
    weights = np.log((2.0 + n) / (1.0 + df)).astype(np.float32)
    bench = worded(items.select("text", F.lit(1.0).alias("kind")).where(F.length("text") > 0), "kind")
    passages = cut_lineage(every_passage(docs).unionByName(bench))
    vocabulary = vocabulary_of(passages)
    of = {r["kind"]: r["n"] for r in passages.groupBy("kind").agg((F.sum(F.length("sizes")) / 4).alias("n")).collect()}
    balance = BALANCE * math.sqrt(max(1, of.get(0, 0)) / max(1, of.get(1, 0)))
    rows = passages.withColumn("factor", F.when(F.col("kind") == 1, balance).otherwise(1.0))
    return Space(vocabulary, weights, *latent_words(rows, vocabulary, weights))


def matchers(docs: DataFrame, benchmark: DataFrame) -> tuple[Broadcast | None, list[Matcher]]:
    """The space, sent to the tasks, and one matcher per block of items. Items without a word match nothing."""
    bounded_batches(docs.sparkSession)
    items = benchmark.selectExpr("CAST(item_id AS BIGINT) AS item_id", "CAST(text AS STRING) AS text").distinct()
    size = items.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    if not size["chars"]:
        return None, []
    blocks = max(math.ceil(size["n"] / ITEMS), math.ceil(size["chars"] / BLOCK_CHARS))
    space, out = fitted(docs, items), []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = [(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect() if words_of(r["text"])]
        if rows:
            out.append(Matcher(rows, space))
    return docs.sparkSession.sparkContext.broadcast(space), out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, cosine, lcs, item_words, answer): every item found in a document, at its best place.

    ``start`` counts words. Null and empty texts hold nothing; a null id stays null; repeated rows are
    reported one by one; an empty benchmark or table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    space, blocks = matchers(docs, benchmark)

    def search(matcher: Matcher) -> DataFrame:
        sent = spark.sparkContext.broadcast(matcher)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch, limit=SLICE):
                    got, m = sent.value.found(part.column("text"), space.value), sent.value
                    rows = [(m.ids[i], s, c, k, len(m.texts[i]), a) for _, i, s, c, k, a in got]
                    ids = part.column("doc_id").take(pa.array([g[0] for g in got], pa.int64()))
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]],
                                                     names=["doc_id", "item_id", "start", "cosine", "lcs", "item_words", "answer"])
                released()

        return texts.mapInArrow(find, SCHEMA)

    every = [search(m) for m in blocks]
    return reduce(DataFrame.unionByName, every) if every else spark.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item is found.

    Null and empty texts and rows without id stay; repeated rows are judged one by one; an empty
    benchmark or table leaves the rows as they are.
    """
    spark = docs.sparkSession
    space, blocks = matchers(docs, benchmark)
    for matcher in blocks:
        sent = spark.sparkContext.broadcast(matcher)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch, limit=SLICE):
                    fine = np.ones(part.num_rows, bool)
                    fine[[g[0] for g in sent.value.found(part.column("text"), space.value)]] = False
                    yield part.filter(pa.array(fine))
                released()

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
