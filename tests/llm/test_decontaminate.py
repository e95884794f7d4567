import random

import numpy as np
import pyarrow as pa

from harvest.llm import decontaminate as d


def prose(rng, n):
    common = "the of an in to is it be".split()
    rare = ["".join(rng.choices("tion ent ing er on at es ed ou st ly re".split(), k=rng.randint(2, 4))) for _ in range(n)]
    return [rng.choice(common) if rng.random() < 0.4 else w for w in rare]


def tables(spark, make, seed=1):
    rng = random.Random(seed)
    items = [" ".join(prose(rng, rng.randint(16, 58))) + "." for _ in range(30)]
    rows, leaks = [], set()
    for i in range(150):
        words = prose(rng, rng.randint(30, 400))
        if i % 5 == 0:
            k = rng.randrange(30)
            leaks.add((i, k))
            at = rng.randrange(len(words) + 1)
            words[at:at] = items[k].upper().split() if i % 10 else [w for w in items[k].split() if rng.random() > 0.12]
        rows.append((i, " ".join(words)))
    bench = spark.createDataFrame(list(enumerate(items)) + [(99, None), (98, "")], "item_id long, text string")
    return make(rows), bench, leaks, items, dict(rows)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_exact_and_reworded_items_are_found_and_nothing_else(spark, make):
    docs, bench, leaks, items, texts = tables(spark, make)
    got = d.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaks and len(got) == len(leaks)
    for r in got:
        item = d.words_of(items[r.item_id])
        whole = lcs(item, d.words_of(texts[r.doc_id]))
        assert r.item_words == len(item) and 0.8 * whole <= r.lcs <= whole
    left = d.clean(docs, bench)
    assert {r.doc_id for r in left.collect()} == set(texts) - {i for i, _ in leaks} and left.columns == docs.columns


def test_candidates_reach_the_recall_of_brute_force(spark, make):
    """Every item that aligns well with a document somewhere is proposed by the latent search."""
    docs, bench, _, items, texts = tables(spark, make, 8)
    want = {(i, k) for i, t in texts.items() for k, item in enumerate(items) if lcs(d.words_of(item), d.words_of(t)) >= 0.8 * len(d.words_of(item))}
    got = {(r.doc_id, r.item_id) for r in d.leaks(docs, bench).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_alignment_by_bits(spark, make):
    docs, bench, *_ = tables(spark, make)
    m, rng = d.matchers(docs, bench)[1][0], random.Random(3)
    for _ in range(60):
        item = rng.randrange(len(m.texts))
        context = [rng.choice([-1, *m.texts[item]]) for _ in range(rng.randrange(120))]
        assert m.aligned(item, context) == lcs(m.texts[item], context)


def test_latent_words_are_the_leading_singular_directions(spark):
    rng = random.Random(2)
    texts = [" ".join(prose(rng, 40)) for _ in range(25)]
    weights = 1.0 + np.arange(d.PLACES) % 5
    table = spark.createDataFrame([(t, 1.0 + k % 3, 1) for k, t in enumerate(texts)], "text string, factor double, kind int")
    vocabulary = d.vocabulary_of(table)
    assert vocabulary.tolist() == sorted(d.hashed(list({w for t in texts for w in d.words_of(t)})).tolist())
    rows = np.zeros((25, len(vocabulary)))
    for k, t in enumerate(texts):
        at, value = d.tfidf(t, vocabulary, weights)
        rows[k, at] = value * (1 + k % 3)
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    got, values = d.latent_words(table, vocabulary, weights, rank=25)
    assert np.abs(values - s[:len(values)]).max() < 1e-3 and len(values) == 25
    assert np.abs(got @ (got.T @ v.T) - v.T).max() < 1e-2


def test_vocabulary_holds_words_of_items_and_of_two_passages(spark):
    rows = spark.createDataFrame([("a b", 0), ("B c c", 0), ("d", 1), (None, 0)], "text string, kind int")
    assert d.vocabulary_of(rows).tolist() == sorted(d.hashed(["b", "d"]).tolist())


def test_counts_cover_all_rows(spark, make):
    docs = make([(1, "a b a"), (2, "A c"), (2, "a"), (3, None), (4, "")] + [(10 + i, "many words") for i in range(200)])
    df, n = d.document_frequencies(docs)
    at = d._places(d.hashed(["a", "b", "c", "z", "many"]))
    assert df[at].tolist() == [3, 1, 1, 0, 200] and n == 205 and df.sum() == 3 + 1 + 1 + 400


def test_awkward_rows(spark, awkward):
    bench = spark.createDataFrame([(1, "a b c d e f g h"), (1, "a b c d e f g h"), (None, "x y z q"), (2, None)], "item_id long, text string")
    got = d.leaks(awkward, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(7, 1)}
    assert d.leaks(awkward, bench.limit(0)).count() == 0 and d.leaks(awkward.limit(0), bench).count() == 0
    assert d.clean(awkward, bench.limit(0)).count() == awkward.count()
    assert d.answer_of("What is it? The answer is red blue.") == ["the", "answer", "is", "red", "blue"]


def test_recall_with_many_more_items_than_dimensions(spark, make):
    """What the latent search finds of 2,000 items is what brute-force alignment finds in the places they were put."""
    rng = random.Random(11)
    items = [" ".join(prose(rng, rng.randint(16, 40))) + "." for _ in range(2_000)]
    texts = []
    for i in range(400):
        words, item = prose(rng, 300), items[i * 4].split()
        words[i % 90 + 90:i % 90 + 90] = [w for w in item if rng.random() > (0, 0.3)[i % 2]]
        texts.append(" ".join(words))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    space, (match,) = d.matchers(make(list(enumerate(texts))), bench)
    number = {k: i for i, k in enumerate(match.ids)}
    assert space.value.table.shape[1] <= d.RANK < len(items)
    want = set()
    for i, text in enumerate(texts):
        context = match.numbered(d.words_of(text))[i % 90 + 88:i % 90 + 132]
        if match.aligned(number[i * 4], context) >= d.SHARE * len(match.texts[number[i * 4]]):
            want.add((i, i * 4))
    got = {(row, match.ids[item]) for row, item, *_ in match.found(pa.array(texts), space.value)}
    assert len(want) >= 360 and len(want & got) >= 0.95 * len(want)


def topics(rng, number, size=24):
    return [["".join(rng.choices("bcdfgkmpvz", k=6)) for _ in range(size)] for _ in range(number)]


def test_a_paraphrase_is_found_by_the_latent_search_and_not_by_the_words(spark, make):
    """Of the item's words only its short answer is kept; all others are replaced by words of the same topic."""
    rng = random.Random(7)
    fields = topics(rng, 300)
    common = ["".join(rng.choices("aeiou", k=3)) for _ in range(20)]
    texts = [" ".join(rng.choices(fields[i % 300], k=45) + rng.choices(common, k=15)) for i in range(3_000)]
    items, answers = [], []
    for k in range(20):
        answers.append(rng.choices(common, k=4) + [fields[k][0]])
        items.append(" ".join(fields[k][1:12]) + ". " + " ".join(answers[k]) + ".")
    reworded = [" ".join(fields[k][12:] * 4 + answers[k] + fields[k][12:]) for k in range(20)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = make(list(enumerate(texts + reworded)))
    space, (match,) = d.matchers(docs, bench)
    got = {(row, match.ids[item]): (cos, n) for row, item, _, cos, n, _ in match.found(pa.array(reworded), space.value)}
    assert len(got) >= 16 and all(a == b for a, b in got)
    for k, _ in got:
        assert got[k, k][1] < len(d.words_of(items[k])) / 3 and got[k, k][0] >= d.STRONG
        words = np.unique(d.hashed(d.words_of(items[k] + reworded[k])))
        plain = np.zeros((2, len(words)))
        for row, text in zip(plain, (items[k], reworded[k])):
            at, value = d.tfidf(text, words, space.value.weights)
            row[at] = value
        assert plain[0] @ plain[1] < d.WEIGHT
    left = {r.doc_id for r in d.clean(docs, bench).collect()}
    assert {i for i in range(3_000) if i % 300 >= 20} <= left and not left & {3_000 + k for k, _ in got}


def test_the_cosine_of_a_passage_does_not_fall_as_the_corpus_grows(spark, make):
    """20 times the documents leave cosines level."""
    rng = random.Random(4)
    other = ["".join(rng.choices("bcdfgkmpvz", k=6)) for _ in range(150)]
    item = " ".join(f"item{k}" for k in range(20)) + "."
    texts = [" ".join(rng.choices(other, k=150)) for _ in range(100)]
    for k in range(50):
        texts[k] += f" item{k % 20}"
    words = rng.choices(other, k=60)
    words[20:20] = item.split()[:14]
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    cosines = []
    for times in (1, 20):
        space, (match,) = d.matchers(make([(i, t) for i, t in enumerate(texts * times)]), bench)
        cosines.append(match.found(pa.array([" ".join(words)]), space.value)[0][3])
    assert abs(cosines[1] - cosines[0]) < 0.05


def test_the_space_is_fitted_on_every_passage_and_every_item(spark, make):
    """Words of two passages of one text count, wherever these lie, and so do the words of 9,000 items."""
    line = " ".join(f"word{k}" for k in range(2_000))
    items = spark.createDataFrame([(f"own{k} item",) for k in range(9_000)], "text string")
    space = d.fitted(make([(1, f"{line} {line}"), (2, "a few others"), (3, None)]), items)
    want = [f"word{k}" for k in range(2_000)] + [f"own{k}" for k in range(9_000)] + ["item"]
    assert set(space.vocabulary.tolist()) == set(d.hashed(want).tolist())


def test_passages_are_whole_and_equal_texts_count_once(spark, make):
    rng = random.Random(5)
    texts = [" ".join(prose(rng, n)) + " é漢 É漢 " * (n % 7) for n in (1, 30, 400, 2_500)]
    got = []
    for row in d.every_passage(make(list(enumerate([*texts, texts[2], None, "", texts[0]])))).collect():
        hashes, counts = np.frombuffer(row.hashes, np.uint64), np.frombuffer(row.counts, np.uint32)
        words = list(zip(hashes[np.frombuffer(row.at, np.uint16)].tolist(), counts.tolist()))
        ends = np.cumsum(np.frombuffer(row.sizes, np.uint32)).tolist()
        got += [tuple(sorted(words[a:b])) for a, b in zip([0, *ends], ends)]
    want = []
    for text in texts:
        pieces = {}
        for m in d._PYTHON_WORD.finditer(text.lower()):
            pieces.setdefault(m.start() // d.PASSAGE_CHARS, []).append(int(d.hashed([m.group()])[0]))
        want += [tuple(sorted((w, piece.count(w)) for w in set(piece))) for piece in pieces.values()]
    assert sorted(got) == sorted(want) and len(want) > 30


def test_words_beyond_the_rows_share_some_of_them(spark, make, monkeypatch):
    """Every word has a row, those of the items one of their own; what is planted is found with few rows too."""
    monkeypatch.setattr(d, "WORDS", 1_024)
    monkeypatch.setattr(d, "SHARED", 256)
    docs, bench, leaks, items, texts = tables(spark, make)
    space = d.fitted(docs, bench.select("text"))
    assert 256 < len(space.vocabulary) <= 1_024 and space.vocabulary[:256].tolist() == list(range(256))
    own = d.numbers_in(space.vocabulary, np.unique(d.hashed([w for i in items for w in d.words_of(i)])))
    assert own.min() >= 256 and len(set(own.tolist())) == len(own)
    other = d.numbers_in(space.vocabulary, d.hashed([f"unseen{k}" for k in range(5_000)]))
    assert other.max() < 256 and len(set(other.tolist())) == 256
    got = {(r.doc_id, r.item_id) for r in d.leaks(docs, bench).collect()}
    assert got <= leaks and len(got) >= 0.9 * len(leaks)


def test_a_paraphrase_is_removed_whose_topic_lies_deep_in_long_texts(spark, make):
    """The space learns from all passages of a text: 30 texts hold 300 topics, none of them in a place of its own."""
    rng = random.Random(7)
    fields = topics(rng, 300)
    common = ["".join(rng.choices("aeiou", k=3)) for _ in range(20)]
    texts = [" ".join(" ".join(rng.choices(fields[(i * 10 + k) % 300], k=450) + rng.choices(common, k=150)) for k in range(10)) for i in range(30)]
    items, reworded = [], []
    for k in range(20):
        answer = rng.choices(common, k=4) + [fields[k][0]]
        items.append(" ".join(fields[k][1:12]) + ". " + " ".join(answer) + ".")
        reworded.append(" ".join(fields[k][12:] * 4 + answer + fields[k][12:]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    left = {r.doc_id for r in d.clean(make(list(enumerate(texts + reworded))), bench).collect()}
    assert len(left & set(range(30, 50))) <= 4 and {i for i in range(30) if i % 30 >= 2} <= left
