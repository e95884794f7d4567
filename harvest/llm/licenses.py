"""License statements by ordered signature rules.

A rule is a regular expression over words, with a label, a priority and a keyword. Texts without any
keyword are not looked at further, and a rule runs only where its own keyword occurs. Overlapping
detections are resolved by priority and by containment. All of it is built-in column functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvest.llm.spans import matches, uncontested

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"             # of the text with A-Z folded
_ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# label, name in words, tag words, versions, keyword that every spelling of the name holds
FAMILIES = (
    ("apache", "apache(?: software)?(?: foundation)? licen[sc]e", "apache", ("1 0", "1 1", "2 0"), "apache"),
    ("mit", "(?:mit|expat|x11)(?: style)? licen[sc]e", "mit", (), "licen"),
    ("bsd-0", "(?:0|zero) clause bsd licen[sc]e", "0bsd", (), "bsd"),
    ("bsd-2", "(?:(?:2|two) clause|simplified|freebsd) bsd(?: style)? licen[sc]e", "bsd 2 clause", (), "bsd"),
    ("bsd-3", "(?:(?:3|three) clause|new|modified|revised) bsd(?: style)? licen[sc]e", "bsd 3 clause", (), "bsd"),
    ("bsd-4", "(?:(?:4|four) clause|original|old) bsd(?: style)? licen[sc]e", "bsd 4 clause", (), "bsd"),
    ("bsd", "bsd(?: style)? licen[sc]e", "bsd", (), "bsd"),
    ("gpl", "(?:gnu )?general public licen[sc]e", "gpl", ("1 0", "2 0", "3 0"), "general public"),
    ("gpl", "gnu gpl", "gnu gpl", ("1 0", "2 0", "3 0"), "gnu gpl"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[sc]e", "lgpl", ("2 0", "2 1", "3 0"), "general public"),
    ("agpl", "(?:gnu )?affero general public licen[sc]e", "agpl", ("1 0", "3 0"), "affero"),
    ("gfdl", "(?:gnu )?free documentation licen[sc]e", "gfdl", ("1 1", "1 2", "1 3"), "free documentation"),
    ("mpl", "mozilla public licen[sc]e", "mpl", ("1 0", "1 1", "2 0"), "mozilla"),
    ("epl", "eclipse public licen[sc]e", "epl", ("1 0", "2 0"), "eclipse"),
    ("edl", "eclipse distribution licen[sc]e", "edl", ("1 0",), "eclipse"),
    ("cpl", "common public licen[sc]e", "cpl", ("1 0",), "common public"),
    ("cddl", "common development and distribution licen[sc]e", "cddl", ("1 0", "1 1"), "common development"),
    ("eupl", "european union public licen[sc]e", "eupl", ("1 0", "1 1", "1 2"), "european union"),
    ("osl", "open software licen[sc]e", "osl", ("1 0", "2 0", "2 1", "3 0"), "open software"),
    ("afl", "academic free licen[sc]e", "afl", ("1 1", "1 2", "2 0", "2 1", "3 0"), "academic free"),
    ("artistic", "artistic licen[sc]e", "artistic", ("1 0", "2 0"), "artistic"),
    ("isc", "isc licen[sc]e", "isc", (), "isc licen"),
    ("zlib", "zlib(?: libpng)? licen[sc]e", "zlib", (), "zlib"),
    ("boost", "boost software licen[sc]e", "bsl", ("1 0",), "boost"),
    ("unlicense", "the unlicen[sc]e", "unlicense", (), "the unlicen"),
    ("wtfpl", "do what the fuck you want to public licen[sc]e", "wtfpl", (), "do what the"),
    ("ms-pl", "microsoft public licen[sc]e", "ms pl", (), "microsoft"),
    ("ms-rl", "microsoft reciprocal licen[sc]e", "ms rl", (), "microsoft"),
    ("odbl", "(?:open data commons )?open database licen[sc]e", "odbl", ("1 0",), "open database"),
    ("odc-by", "open data commons attribution licen[sc]e", "odc by", ("1 0",), "open data commons"),
    ("pddl", "(?:open data commons )?public domain dedication and licen[sc]e", "pddl", ("1 0",), "public domain"),
    ("psf", "python software foundation licen[sc]e", "psf", ("2 0",), "python software"),
    ("ofl", "(?:sil )?open font licen[sc]e", "ofl", ("1 0", "1 1"), "open font"),
    ("postgresql", "postgresql licen[sc]e", "postgresql", (), "postgresql"),
    ("ncsa", "university of illinois ncsa open source licen[sc]e", "ncsa", (), "illinois"),
    ("vim", "vim licen[sc]e", "vim", (), "vim licen"),
    ("ruby", "ruby licen[sc]e", "ruby", (), "ruby licen"),
    ("php", "php licen[sc]e", "php", ("3 0", "3 01"), "php licen"),
    ("openrail", "(?:creativeml )?openrail(?: m)? licen[sc]e", "openrail", (), "openrail"),
    ("cc0", "cc0", "cc0", ("1 0",), "cc0"),
    ("cc0", "creative commons zero", "cc zero", ("1 0",), "creative commons"),
) + tuple(
    family for tag, name in (
        ("by", "attribution"), ("by sa", "attribution share(?: )?alike"), ("by nd", "attribution no ?deriv(?:ative|atives|s)"),
        ("by nc", "attribution non ?commercial"), ("by nc sa", "attribution non ?commercial share ?alike"),
        ("by nc nd", "attribution non ?commercial no ?deriv(?:ative|atives|s)"))
    for family in (
        (f"cc-{tag.replace(' ', '-')}", f"cc {tag}", f"cc {tag}", ("2 0", "2 5", "3 0", "4 0"), "cc by"),
        (f"cc-{tag.replace(' ', '-')}", f"creative commons {name}", f"creative commons {tag}", ("2 0", "2 5", "3 0", "4 0"),
         "creative commons"))
)
# label and word, versions, whether the bare word is a name
ABBREVIATIONS = (
    ("gpl", ("1 0", "2 0", "3 0"), True), ("lgpl", ("2 0", "2 1", "3 0"), True), ("agpl", ("1 0", "3 0"), True),
    ("gfdl", ("1 1", "1 2", "1 3"), True), ("mpl", ("1 0", "1 1", "2 0"), False), ("epl", ("1 0", "2 0"), False),
    ("cddl", ("1 0", "1 1"), True), ("eupl", ("1 0", "1 1", "1 2"), True), ("wtfpl", (), True))
# label, kind, keyword, a licence's own wording
WORDINGS = (
    ("mit", "version", "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "name", "hereby", "permission is hereby granted free of charge"),
    ("boost", "version", "hereby", "permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy"),
    ("isc", "version", "hereby", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "version", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "name", "redistribution", "redistribution and use in source and binary forms"),
    ("unlicense", "version", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("zlib", "version", "liable", "without any express or implied warranty in no event will the authors be held liable"))
_GRANT = "(?:licen[sc]ed|released|distributed|available|published|provided|offered|redistributed)(?: \\S+){0,2}? (?:under|by|as)(?: the)?(?: terms of)?(?: the)? "
_TAG = "spdx licen[sc]e identifier "
# kind: priority, confidence
KINDS = {"tag": (1, 1.0), "grant": (2, 0.95), "version": (3, 0.85), "name": (4, 0.6)}


@dataclass(frozen=True)
class Rule:
    """``pattern`` is over double-spaced words and takes a space at either end."""

    number: int
    label: str
    priority: int
    score: float
    keyword: str
    pattern: str


def _spaced(words: str) -> str:
    """The pattern over words that have a space at either end each."""
    return words.replace(" ?", " {0,2}").replace(" ", "  ").replace("  {0,2}", " {0,2}")


def rules(families=FAMILIES) -> list[Rule]:
    """The signatures of all families: tag, grant, name with version, and plain name, by priority.

    Abbreviations (also with the version in one word) and the licences' own wordings have theirs besides.
    """
    made = list((kind, label, keyword, words) for label, kind, keyword, words in WORDINGS)
    for word, versions, named in ABBREVIATIONS:
        for version in versions:
            major, _, minor = version.partition(" ")
            own, rest = (f"{word}-{major}", "(?: 0)?") if minor == "0" else (f"{word}-{major}.{minor}", f" {minor}")
            name = f"{word}(?:(?: v| version)? v?|v?){major}{rest}"
            made += [("grant", own, word, f"{_GRANT}{name}"), ("version", own, word, name)]
        made += [("grant", word, word, f"{_GRANT}{word}"), *([("name", word, word, word)] if named else [])]
    for label, name, tag, versions, keyword in families:
        for version in (*versions, None):
            major, _, minor = (version or "").partition(" ")
            own, number = label, ""
            if version:
                number = f"(?: v| version)? v?{major}" + ("(?: 0)?" if minor == "0" else f" {minor}")
                own += f"-{major}" + ("" if minor == "0" else f".{minor}")
            made.append(("tag", own, "spdx", f"{_TAG}{tag}{number}(?: only| or later)?"))
            made.append(("grant", own, keyword, f"{_GRANT}(?:{name}){number}"))
            made.append(("version" if version else "name", own, keyword, f"(?:{name}){number}"))
    made.sort(key=lambda m: KINDS[m[0]][0])
    return [Rule(i, label, *KINDS[kind], keyword.replace(" ", "  "), f" {_spaced(pattern)} ")
            for i, (kind, label, keyword, pattern) in enumerate(made)]


GATE = r"(?i)licen[sc]|spdx|gpl|(?<![0-9a-z])(?:[me]pl|cddl|eupl|gfdl|wtfpl)|hereby|redistribution|unencumbered|liable|creative[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+commons|cc0|cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by"
_FOUND = "array<struct<start:int,back:int,priority:int,rule:int,label:string,score:double>>"


def _words_in(piece: Column) -> Column:
    """Words of a piece of the spaced text: two spaces each."""
    return F.floor((F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))) / 2).cast("int")


def surviving(spans: Column, levels: int = len(KINDS)) -> Column:
    """What remains of spans that come in order of (start, -end, priority, rule).

    A span goes if an earlier one of the same or a stricter priority contains it, or if any one of a
    stricter priority overlaps it. Takes time in proportion to the spans.
    """
    return uncontested(spans, range(1, levels + 1), contained=True)


def scan(docs: DataFrame, signatures: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for every row.

    ``spans`` are the surviving detections: first word, word behind the last, label, rule, score. Null and
    empty texts have no words and no label, score 0; a null id stays null; repeated rows are scanned one
    by one. Texts are scanned whole and nothing is shuffled, so hot sources and copies need no care.
    """
    signatures = rules() if signatures is None else signatures
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in (
        ("keyword", r.keyword), ("pattern", r.pattern), ("priority", r.priority), ("rule", r.number), ("label", r.label),
        ("score", r.score))]) for r in signatures])
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in signatures})])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text")).select(
        "doc_id", F.regexp_count("_text", F.lit(_ANY_CASE_WORD)).cast("long").alias("n_words"),
        F.when(F.col("_text").rlike(GATE), F.concat_ws("", F.transform(
            F.regexp_extract_all(F.translate("_text", _UPPER, _LOWER), F.lit(WORD), F.lit(0)), lambda w: F.concat(F.lit(" "), w, F.lit(" "))))
        ).alias("_spaced"))
    rows = rows.withColumn("_keywords", F.filter(keywords, lambda k: F.contains("_spaced", k)))

    def detections(r: Column) -> Column:
        return F.transform(matches(F.col("_spaced"), r["pattern"], _words_in), lambda m: F.struct(
            m["start"].alias("start"), (-m["end"]).alias("back"), r["priority"].alias("priority"), r["rule"].alias("rule"),
            r["label"].alias("label"), r["score"].alias("score")))

    def places(phrase: str, label: str) -> Column:
        return F.transform(matches(F.col("_spaced"), f" {_spaced(phrase)} ", _words_in),
                           lambda m: F.struct(m["start"].alias("start"), F.lit(label).alias("label")))

    base = F.concat(*[places(phrase, label) for phrase, label in BASE])
    gated = F.col("_spaced").isNotNull()
    rows = rows.withColumn("_base", F.when(gated, base)).withColumn("_found", F.when(gated & (F.size("_keywords") > 0), F.array_sort(
        F.flatten(F.transform(F.filter(table, lambda r: F.array_contains("_keywords", r["keyword"])), detections)))))
    rows = rows.withColumn("_kept", F.when(F.size("_found") > 0, surviving(F.col("_found"))).otherwise(F.array().cast(_FOUND)))
    starts = F.transform("_base", lambda b: b["start"])
    base_labels = F.coalesce(F.array_distinct(F.transform("_base", lambda b: b["label"])), F.array().cast("array<string>"))
    own = F.transform("_kept", lambda s: s["label"])
    scores = F.array_max(F.concat(F.transform("_kept", lambda s: s["score"]), F.when(F.size(base_labels) > 0, F.array(F.lit(0.95))).otherwise(
        F.array(F.lit(0.0)))))
    return rows.select(
        "doc_id", "n_words", F.coalesce(F.size(starts), F.lit(0)).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), F.array_join(F.sort_array(base_labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_labels, own)), ",").alias("labels"), scores.alias("score"),
        F.transform("_kept", lambda s: F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["label"].alias("label"),
                                                s["rule"].alias("rule"), s["score"].alias("score"))).alias("spans"))


def scan_sql(signatures: list[Rule] | None = None) -> str:
    """The same rows but ``spans`` in DuckDB's SQL, with joins and windows in place of folds over arrays."""
    def text(x) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    def table(rows) -> str:
        return ", ".join("(" + ", ".join(map(text, row)) + ")" for row in rows)

    signatures = rules() if signatures is None else signatures
    listed = table((r.keyword, r.pattern, r.priority, r.number, r.label, r.score) for r in signatures)
    phrases = table((f" {_spaced(phrase)} ", label) for phrase, label in BASE)
    near = " ".join(f"WHEN {k} THEN greatest(coalesce(e{k}, -1), -1)" for k in range(1, len(KINDS) + 1))
    stricter = " ".join(f"WHEN {k + 1} THEN coalesce(e{k}, -1)" for k in range(1, len(KINDS)))
    later = " ".join(f"WHEN {k + 1} THEN coalesce(n{k}, 2147483647)" for k in range(1, len(KINDS)))
    ends = ", ".join(f"max(CASE WHEN priority <= {k} THEN stop END) OVER before AS e{k}, min(CASE WHEN priority <= {k} THEN start END) OVER after AS n{k}"
                     for k in range(1, len(KINDS) + 1))
    return rf"""
WITH listed AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents),
spaced AS (SELECT doc_id, len(w) AS n_words, array_to_string(list_transform(w, lambda x: ' ' || x || ' '), '') AS s FROM listed),
rules(keyword, pattern, priority, rule, label, score) AS (VALUES {listed}),
phrases(pattern, label) AS (VALUES {phrases}),
hits AS (
  SELECT doc_id, pattern, priority, rule, label, score, regexp_extract_all(s, pattern) AS m, string_split_regex(s, pattern) AS gap
  FROM spaced JOIN rules ON contains(s, keyword) WHERE regexp_matches(s, pattern)
  UNION ALL
  SELECT doc_id, pattern, 0, -1, label, 0, regexp_extract_all(s, pattern), string_split_regex(s, pattern)
  FROM spaced, phrases WHERE regexp_matches(s, pattern)),
counted AS (
  SELECT doc_id, priority, rule, label, score,
         list_transform(m, lambda x: (len(x) - len(replace(x, ' ', ''))) // 2) AS size,
         list_transform(gap, lambda x: (len(x) - len(replace(x, ' ', ''))) // 2) AS free FROM hits),
found AS (
  SELECT doc_id, priority, rule, label, score, list_sum(free[1:i])::BIGINT + coalesce(list_sum(size[1:i - 1]), 0)::BIGINT AS start,
         list_sum(free[1:i])::BIGINT + list_sum(size[1:i])::BIGINT AS stop
  FROM (SELECT *, unnest(range(1, len(size) + 1)) AS i FROM counted) q),
edges AS (
  SELECT *, {ends} FROM found WHERE rule >= 0
  WINDOW before AS (PARTITION BY doc_id ORDER BY start, stop DESC, priority, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (PARTITION BY doc_id ORDER BY start, stop DESC, priority, rule ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
kept AS (
  SELECT doc_id, label, score FROM edges
  WHERE CASE priority {near} END < stop AND CASE priority {stricter} ELSE -1 END <= start
    AND CASE priority {later} ELSE 2147483647 END >= stop),
base AS (
  SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM found WHERE rule < 0 GROUP BY doc_id),
named AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM (
    SELECT doc_id, label, score FROM kept UNION ALL SELECT doc_id, label, 0.95 FROM found WHERE rule < 0) q GROUP BY doc_id)
SELECT d.doc_id, d.n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word, coalesce(b.base_labels, '') AS base_labels,
       coalesce(n.labels, '') AS labels, coalesce(n.score, 0)::DOUBLE AS score
FROM spaced d LEFT JOIN base b ON b.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id
"""
