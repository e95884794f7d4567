import random
import zlib

from harvest.llm.language import Classifier, accepted, held_out, identified, learned

SYLLABLES = {"aa": "the of an in re tion ent ing er on", "bb": "que eau ier aux les ou eux ment", "cc": "ung ein sch die und keit zu ver"}


def prose(rng, lang, words=60):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(s, k=rng.randint(1, 3))) for _ in range(words))


def rows(n=240):
    rng = random.Random(1)
    return [(i, prose(rng, lang), lang) for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]


def test_held_out_texts_are_told_apart(spark, make):
    docs = make(rows())
    model = learned(docs.where(~held_out(3, 1)))
    got = {r.doc_id: r for r in identified(docs, model).collect()}
    truth = {i: lang for i, _, lang in rows()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    out = [r.lang_pred == truth[i] for i, r in got.items() if r.held_out]
    assert len(out) > 50 and sum(out) >= 0.97 * len(out)
    assert accepted(docs, model).count() == sum(not r.rejected for r in got.values()) and accepted(docs, model).columns == docs.columns


def test_the_smallest_sum_of_chunks_wins(spark, make):
    classify = Classifier(learned(make(rows())))
    text = prose(random.Random(9), "bb", 900)
    sizes = classify.sizes(text)[0]
    lang, gap, rejected = classify(text)
    best, second = sorted(sizes)[:2]
    assert lang == classify.languages[int(sizes.argmin())] == "bb" and abs(gap - (1 - best / second)) < 1e-12 and not rejected


def test_awkward_rows(spark, make, awkward):
    model = learned(make(rows()))
    got = identified(awkward, model).collect()
    assert len(got) == awkward.count() and identified(awkward.limit(0), model).count() == 0
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].rejected for i in (1, 2, 3, 9)) and by[None].held_out
    assert learned(make([(1, None, "aa"), (2, "x", None)])) == {} and identified(awkward, {}).where("lang_pred <> 'und'").count() == 0


def test_copies_count_once_and_the_sample_is_bounded(spark, make):
    docs = make([(i, "same text again and again", "aa") for i in range(500)] + [(1_000 + i, t, lang) for i, t, lang in rows(60)])
    model = learned(docs, sample=5)
    assert set(model) == {"aa", "bb", "cc"} and all(len(v) < 6_000 for v in model.values())


def test_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = [r for r in identified(docs, learned(docs.where(~held_out(3, 1)))).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.96 * len(out) and sum(r.rejected for r in out) <= 0.03 * len(out)


def test_clean_texts_of_few_words_stay(spark):
    """Texts of 5 to 10 words, cut from held-out rows, are told apart and not rejected."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    classify = Classifier(learned(docs.where(~held_out(3, 1))))
    cut = []
    for r in docs.where(held_out(3, 1)).where("text IS NOT NULL").collect():
        words = r.text.split()
        cut += [(r.lang, " ".join(words[20:20 + n])) for n in (5, 8, 10) if len(words) > 60]
    out = [(lang, classify(text)) for lang, text in cut]
    assert len(out) > 200 and sum(x[2] for _, x in out) <= 0.01 * len(out) and sum(x[0] == lang for lang, x in out) >= 0.97 * len(out)


def test_copies_do_not_thin_the_sample(spark, make):
    """40 distinct texts among 8,000 rows: a sample of 20 is full."""
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(5)) for _ in range(40)]
    model = learned(make([(i, texts[i % 40], "aa") for i in range(8_000)]), sample=20)
    assert len(model["aa"].split()) == 20 * 5


def test_four_hundred_languages(spark, make):
    """More languages than a worker holds coders of: each is learned, and told from the others."""
    rng = random.Random(8)
    words = {f"l{k:03d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(30)] for k in range(400)}
    docs = [(i, " ".join(rng.choices(words[lang], k=60)), lang) for i, lang in enumerate(sorted(words) * 3)]
    model = learned(make(docs))
    assert set(model) == set(words)
    got = {r.doc_id: r for r in identified(make([(i, " ".join(rng.choices(words[lang], k=60))) for i, lang in enumerate(sorted(words))]), model).collect()}
    assert all(got[i].lang_pred == lang and not got[i].rejected for i, lang in enumerate(sorted(words)))
