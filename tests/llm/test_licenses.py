import random
import re

import duckdb

from harvest.llm.licenses import BASE, KINDS, rules, scan, scan_sql

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    """Base places, and labels and best score after comparing all detections with each other."""
    w = words(text)
    base = [(k, label) for phrase, label in BASE for k in range(len(w)) if w[k:k + len(phrase.split())] == phrase.split()]
    spaced = "".join(f" {x} " for x in w)
    found = []
    for r in rules():
        if r.keyword in spaced:
            for m in re.finditer(r.pattern, spaced):
                start = spaced[:m.start()].count(" ") // 2
                found.append((start, start + m.group().count(" ") // 2, r))

    def gone(x):
        s, e, r = x
        for t, f, q in found:
            if q.priority < r.priority and t < e and s < f:
                return True
            if q.priority <= r.priority and t <= s and f >= e and (t, -f, q.priority, q.number) < (s, -e, r.priority, r.number):
                return True
        return False

    kept = [r for s, e, r in found if not gone((s, e, r))]
    labels = {label for _, label in base} | {r.label for r in kept}
    score = max([r.score for r in kept] + [0.95] * bool(base) + [0.0])
    starts = [k for k, _ in base]
    return (len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)), score)


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
LINES = ["Released under the MIT License.", "Apache License, Version 2.0", "Licensed under CC BY-NC 4.0", "SPDX-License-Identifier: GPL-3.0-only",
         "This work is licensed under the GNU General Public License, version 3", "Creative Commons Attribution ShareAlike 3.0", "the new BSD licence",
         "licensed by anyone under the terms of the Mozilla Public License v2", "under the mit license", "cc by nc", "é", "word", "\n", "license"]


def test_rules_are_many_and_ordered():
    every = rules()
    assert len(every) > 200 and [r.number for r in every] == list(range(len(every)))
    assert [r.priority for r in every] == sorted(r.priority for r in every) and {r.priority for r in every} == {p for p, _ in KINDS.values()}
    for r in every:
        re.compile(r.pattern)


def test_detections_equal_brute_force(spark, make):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(LINES, k=rng.randint(0, 6))) for _ in range(300)] + [None, "", "under the mit license " * 500]
    got = {r.doc_id: r for r in scan(make(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts[:-1]):
        assert tuple(got[i][c] for c in COLUMNS) == brute(text), text
    assert (got[302].n_base, got[302].last_word, got[302].labels) == (500, 1_996, "mit")


def test_sql_gives_the_same_rows(spark, real):
    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = {r[0]: r[1:] for r in db.execute(scan_sql()).fetchall()}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in scan(real).collect()}
    assert got == {k: tuple(v) for k, v in want.items()}


def test_awkward_rows(awkward):
    got = scan(awkward).collect()
    assert len(got) == awkward.count() and scan(awkward.limit(0)).count() == 0 and all(r.labels == "" and r.score == 0 for r in got)


def test_abbreviations_and_own_wordings(spark, make):
    want = {"licensed under the GPL v3": "gpl-3", "LGPL 2.1": "lgpl-2.1", "AGPLv3": "agpl-3", "MPL 2.0": "mpl-2", "mplv1.1": "mpl-1.1",
            "GNU GPLv2": "gpl-2", "released under the EPL": "epl", "an example, simply": "", "Eupl version 1.2": "eupl-1.2",
            "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
            "Permission is hereby granted, free of charge, to any person or organization obtaining a copy": "boost",
            "Redistribution and use in source and binary forms": "bsd"}
    got = {r.doc_id: r for r in scan(make(list(enumerate(want)))).collect()}
    assert [got[i].labels for i in range(len(want))] == list(want.values())
    for i, text in enumerate(want):
        assert tuple(got[i][c] for c in COLUMNS) == brute(text), text
