"""Personal data by weak supervision: patterns propose spans, labelers vote, a trained classifier decides.

1. Patterns find the four base kinds, and candidates of further kinds.
2. Labelers vote yes, no or nothing on each candidate: its exact form, a gazetteer of its kind, words
   before it, what touches it, its digits, and whether its characters are mixed as in random strings.
3. Only the counts of equal (kind, votes, shape) leave the tasks. On the votes expectation-maximisation
   estimates each labeler's reliability and each kind's share, without labels.
4. A logistic classifier is fitted to those posteriors. It sees the kind, the votes and, by kind, the
   shape of the span and its context, which no labeler votes on: length, classes of characters, what
   stands before and behind. It scores every candidate as one column expression. Base kinds always stay;
   other kinds need a score of one half.

Everything on rows is a built-in column function; the driver sees one row per pattern of votes and shape,
``PATTERNS`` at most for the classifier.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvest.llm.spans import SPANS, matches, replaced, uncontested
from harvest.session import cut_lineage

# Possessive forms of the contract's patterns: the same matches in linear time on any text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# further kinds: pattern of the candidates, exact form, gazetteer of beginnings or endings
FURTHER = {
    "local_phone": (r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
                    r"^(?:\([2-9][0-9]{2}\)\x20|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[.-][0-9]{4}$", None),
    "ssn": (r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", None),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]{4}){3,7}(?:\x20?+[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
             r"^[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{11,36}$",
             "^(?:AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM)"),
    "private_key": (r"-----BEGIN\x20[A-Z0-9\x20]{0,32}PRIVATE\x20KEY-----[^-]*+(?:-----END\x20[A-Z0-9\x20]{0,32}PRIVATE\x20KEY-----)?",
                    r"-----BEGIN[^-]*-----\s*[A-Za-z0-9+/=\s]{16,}", r"-----END[^-]*-----$"),
    "jwt": (r"(?<![0-9A-Za-z_.-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++)?", r"^eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]{16,}$", "^eyJ(?:hbGci|0eXAi|raWQi)"),
    "password": (r"(?i)(?<![a-z])(?:password|passwd|passphrase|passwort|pwd)[\x22']?\x20?(?:[:=]|is:)\x20?[\x22']?[^\s\x22'<>,;]{6,64}+",
                 r"^[^:=]*[:=]\s?[\x22']?(?=\S*[0-9\W])\S{6,}$", None),
    "mac": (r"(?<![0-9A-Za-z:.-])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Za-z:.-])|(?<![0-9A-Za-z:.-])(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}(?![0-9A-Za-z:.-])",
            r"^(?!(?:00[:-]){5}|(?i:ff[:-]){5}).", None),
    "ipv6": (r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{6,39}+(?![0-9A-Za-z:])",
             r"^(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?!.*::.*::)(?=(?:[^:]*:){3,7}[^:]*$)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?)$",
             "^(?i:2[0-9a-f]{3}|f[cd][0-9a-f]{2}|fe80):"),
    "plain_phone": (r"(?<![0-9A-Za-z+./:_-])[2-9][0-9]{9}(?![0-9A-Za-z_/-]|\.[0-9])", r"^[2-9][0-9]{2}[2-9][0-9]{6}$", None),
    "birth_date": (r"(?<![0-9A-Za-z./-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9][./][0-3]?[0-9][./](?:19|20)[0-9]{2})(?![0-9A-Za-z/-])",
                   r"^(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|0?(?:[1-9]|[12][0-9]|3[01])[./]0?(?:[1-9]|[12][0-9]|3[01])[./](?:19|20)[0-9]{2})$", None),
    "address": (r"(?<![0-9A-Za-z./-])[1-9][0-9]{0,4}\x20(?:[A-Z][A-Za-z.'-]{1,24}+\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Square)(?![A-Za-z0-9])\.?",
                r"(?:Street|Avenue|Road|Boulevard|Lane|Drive|Court|(?:St|Ave|Rd|Blvd|Ln|Dr|Ct)\.?|Way|Place|Square)$", None),
    "secret": (r"(?<![0-9A-Za-z_./+-])(?=[A-Za-z_+-]*+[0-9])[A-Za-z0-9_+-]{20,200}+(?![0-9A-Za-z_./+])", r"^(?i:[0-9a-f]{32,128})$",
               r"^(?:ghp_|gho_|xox[abp]-|AKIA|ASIA|sk_live_|sk-|AIza|eyJ|(?i:[0-9a-f]{32}(?:[0-9a-f]{8}(?:[0-9a-f]{24})?)?)$)"),
}
KINDS = BASE + tuple(FURTHER)
CUES = {
    "email": "e-?mail|mail|contact|write", "ip": "\\bip\\b|address|host|server|login|from", "card": "card|visa|master|amex|credit|payment",
    "phone": "phone|tel|call|mobile|fax|cell", "local_phone": "phone|tel|call|mobile|fax|cell", "ssn": "ssn|social security",
    "iban": "iban|account|bank|konto|compte|cuenta", "private_key": "key|ssh|tls|rsa|pem", "jwt": "token|jwt|bearer|auth|cookie|session",
    "password": "login|user|account|credential|root|admin", "mac": "mac|ether|device|adapter|hardware|wifi|address",
    "ipv6": "\\bip|address|host|server|login|from|addr", "plain_phone": "phone|tel|call|mobile|fax|cell|whatsapp",
    "birth_date": "born|birth|\\bdob\\b|geboren|geburt|née? le|naci", "address": "address|live|lives|at|street|home|ship|mail|resid",
    "secret": "token|key|secret|passw|pwd|api|auth|bearer",
}
NEEDS_CUE = ("plain_phone", "birth_date")      # any number has their form: only a cue votes for them, and none against
RANDOM = ("secret", "jwt", "private_key")      # strings that look random if they are real
LABELERS = ("form", "gazetteer", "cue", "touch", "digits", "random")
SHAPE = (("length", "01234567"), ("classes", "01234567"), ("before", "-qcwpo"), ("after", "-qcwpo"))      # features and their values
PATTERNS = 20_000       # patterns of kind, votes and shape, the most frequent, that the classifier is fitted on
ROUNDS = 50
THRESHOLD = 0.5

_TOP_DOMAINS = "com|org|net|edu|gov|info|io|co|de|fr|es|uk|us|it|nl|ch|at|be|eu|ca|au|jp|cn|br|in|ru|pl|se|no|dk|fi|pt|mx|ar"
_ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35)"
_CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def _base_valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _form(kind: str, match: Column) -> Column:
    """Yes or no by the exact form of the kind."""
    if kind in BASE:
        strict = {"email": match.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*+)\.)++[A-Za-z]{2,24}+$"),
                  "ip": ~match.rlike(r"^(?:0|127|255)\.|(?:^|\.)0[0-9]"), "card": ~F.regexp_replace(match, "[^0-9]", "").startswith("0"),
                  "phone": match.rlike(r"^\+[1-9]")}[kind]
        return _base_valid(kind, match) & strict
    return match.rlike(FURTHER[kind][1])


def _gazetteer(kind: str, match: Column) -> Column:
    """Yes or nothing by a list of endings or beginnings, 0 where the kind has none."""
    pattern = {"email": rf"(?i)\.(?:{_TOP_DOMAINS})$", "card": _ISSUERS, "phone": _CALLING}.get(kind) or (FURTHER[kind][2] if kind in FURTHER else None)
    return F.when(match.rlike(pattern), F.lit("y")).otherwise(F.lit("n")) if pattern else F.lit("-")


def _looks_random(match: Column) -> Column:
    """Against: words of four or more small letters between joints, or few different characters. For: many, with digits among them."""
    parts = F.length(F.array_join(F.array_distinct(F.split(F.substring(match, 1, 64), "")), ""))
    words = match.rlike(r"(?:^|[_+-])(?:[A-Za-z]?[a-z]{3,}|[A-Z]{4,})(?:[_+-][A-Za-z0-9]*)*[_+-](?:[A-Za-z]?[a-z]{3,}|[A-Z]{4,})(?:$|[_+-])")
    return F.when(words | (parts * 4 < F.least(F.length(match), F.lit(40))), F.lit("n")).when(parts >= 10, F.lit("y")).otherwise(F.lit("-"))


def _votes(kind: str, span: Column) -> Column:
    match, before, after = span["match"], span["before"], span["after"]
    digits = F.regexp_replace(match, "[^0-9]", "")
    plain = F.lit("-")
    return F.concat(
        F.when(_form(kind, match), plain if kind in NEEDS_CUE else F.lit("y")).otherwise(plain if kind == "secret" else F.lit("n")),
        _gazetteer(kind, match),
        F.when(before.rlike(f"(?i)(?:{CUES[kind]})[^\\n]{{0,12}}$"), F.lit("y")).otherwise(F.lit("n" if kind in NEEDS_CUE else "-")),
        F.when(F.substring(before, -1, 1).rlike(r"[\p{L}0-9#$%=/\\.-]") | after.rlike(r"[\p{L}0-9%]"), F.lit("n")).otherwise(
            plain if kind in NEEDS_CUE + RANDOM else F.lit("y")),       # standing alone says little of these
        plain if kind in NEEDS_CUE + RANDOM + ("password", "mac", "ipv6", "address") else
        F.when(F.length(digits) < 6, F.lit("-")).when(digits.rlike(r"^([0-9])\1*$|(?:0123|1234|2345|3456|4567|5678)[0-9]*$"), F.lit("n"))
        .otherwise(F.lit("y")),
        _looks_random(match) if kind in RANDOM else plain)


def _shape(span: Column) -> Column:
    """One character a feature of ``SHAPE``: what no labeler votes on."""
    match = span["match"]

    def edge(c: Column) -> Column:
        return F.when(c == "", F.lit("-")).when(c.rlike("[\"'`]"), F.lit("q")).when(c.rlike("[:=(<\\[]"), F.lit("c")).when(
            c.rlike(r"[\p{L}0-9]"), F.lit("w")).when(c.rlike(r"[.,;!?)\]>]"), F.lit("p")).otherwise(F.lit("o"))

    classes = F.when(match.rlike("[A-Z]"), 1).otherwise(0) + F.when(match.rlike("[a-z]"), 2).otherwise(0) + F.when(match.rlike("[0-9]"), 4).otherwise(0)
    return F.concat(F.least(F.floor(F.log2(F.length(match) + F.lit(1))), F.lit(7)).cast("string"), classes.cast("string"),
                    edge(F.substring(span["before"], -1, 1)), edge(F.substring(span["after"], 1, 1)))


def candidates(docs: DataFrame, whole_rows: bool = False) -> DataFrame:
    """(doc_id, base, found): valid base spans, and all candidates with their votes, of every row.

    With ``whole_rows`` the columns of ``docs`` come along in the struct ``_row``.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    along = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if whole_rows else []
    rows = docs.select(*along, F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"))
    along = ["_row"] if whole_rows else []
    gates = {"email": F.contains("_text", F.lit("@")), "phone": F.contains("_text", F.lit("+")),
             "private_key": F.contains("_text", F.lit("-----BEGIN ")), "jwt": F.contains("_text", F.lit("eyJ")),
             "password": F.col("_text").rlike("(?i)passw|passphrase|pwd"), "mac": F.col("_text").rlike("[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]"),
             "ipv6": F.col("_text").rlike("[0-9A-Fa-f]::?[0-9A-Fa-f]"), "plain_phone": F.col("_text").rlike("[2-9][0-9]{9}"),
             "birth_date": F.col("_text").rlike("(?:19|20)[0-9]{2}"), "address": F.col("_text").rlike("[0-9] [A-Z][a-z]")}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE} | {k: v[0] for k, v in FURTHER.items()}
    none = F.array().cast(SPANS)
    rows = rows.withColumn("_digits", F.col("_text").rlike("[0-9]"))
    rows = rows.select(*along, "doc_id", "_text", *[
        F.when(gates.get(k, F.lit(True)) & (F.lit(True) if k in ("email", "private_key", "password") else F.col("_digits")), matches(F.col("_text"), patterns[k]))
        .otherwise(none).alias(f"_{k}") for k in KINDS])

    def valid(kind: str) -> Column:
        return F.transform(F.filter(f"_{kind}", lambda m: _base_valid(kind, m["match"])), lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))

    def voted(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda m: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
            _votes(kind, m).alias("votes"), _shape(m).alias("shape")))

    return rows.select(*along, "doc_id", F.array_sort(F.concat(*map(valid, BASE))).alias("base"), F.concat(*map(voted, KINDS)).alias("found"))


_VALUES = "-yn"
_OFFSETS = [sum(len(v) for _, v in SHAPE[:i]) for i in range(len(SHAPE) + 1)]


@dataclass
class Model:
    """Weights of the classifier: by kind, by labeler and vote, by kind and feature of shape; and what EM estimated."""

    kinds: list[float]
    votes: list[float]          # len(_VALUES) a labeler, nothing for a vote that was not given
    shape: list[float]          # _OFFSETS[-1] a kind
    reliability: dict[str, float]
    share: dict[int, float]

    def score(self, candidate: Column) -> Column:
        def weight(values: list[float], place: Column) -> Column:
            return F.get(F.array(*map(F.lit, values)), place.cast("int"))

        def nth(name: str, i: int, values: str) -> Column:
            return F.instr(F.lit(values), F.substring(candidate[name], i + 1, 1)) - 1

        total = weight(self.kinds, candidate["kind"])
        for i in range(len(LABELERS)):
            total = total + weight(self.votes, nth("votes", i, _VALUES) + len(_VALUES) * i)
        for i, (_, values) in enumerate(SHAPE):
            total = total + weight(self.shape, nth("shape", i, values) + _OFFSETS[i] + candidate["kind"] * _OFFSETS[-1])
        return 1 / (1 + F.exp(-total))


def posteriors(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By expectation-maximisation: probability of each pattern, share of each kind, accuracy of each labeler.

    ``votes`` are 1, -1 or 0 (nothing). A labeler is right with one probability on all kinds, whatever
    the truth; it starts at 0.8 and stays between 0.55 and 0.99, so that yes keeps meaning yes.
    """
    accuracy = np.full(votes.shape[1], 0.8)
    share = np.full(len(KINDS), 0.5)
    post = np.full(len(counts), 0.5)
    for _ in range(rounds):
        odds = np.log(share[kinds] / (1 - share[kinds])) + (votes * np.log(accuracy / (1 - accuracy))).sum(axis=1)
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        right = np.where(votes > 0, post[:, None], 1 - post[:, None]) * (votes != 0)
        voted = (counts[:, None] * (votes != 0)).sum(axis=0)
        accuracy = np.clip(((counts[:, None] * right).sum(axis=0) + 8) / (voted + 10), 0.55, 0.99)
        total = np.bincount(kinds, weights=counts, minlength=len(KINDS))
        share = np.clip((np.bincount(kinds, weights=counts * post, minlength=len(KINDS)) + 1) / (total + 2), 0.02, 0.98)
    return post, share, accuracy


def fitted(patterns: Iterable[tuple[int, str, str, int]]) -> Model:
    """The model from (kind, votes, shape, count) patterns."""
    rows = list(patterns)
    kinds = np.array([r[0] for r in rows], np.int64)
    votes = np.array([[{"y": 1, "n": -1, "-": 0}[v] for v in r[1]] for r in rows], float).reshape(len(rows), len(LABELERS))
    counts = np.array([r[3] for r in rows], float)
    post, share, accuracy = posteriors(kinds, votes, counts)
    first, second = len(KINDS), len(KINDS) + len(_VALUES) * len(LABELERS)
    width = len(SHAPE) + len(LABELERS) + 1
    at = np.zeros((len(rows), width), np.int64)         # places of the ones of every row
    at[:, 0] = kinds
    for n, (kind, vote, shape, _) in enumerate(rows):
        at[n, 1:len(LABELERS) + 1] = [first + len(_VALUES) * i + _VALUES.index(v) for i, v in enumerate(vote)]
        at[n, len(LABELERS) + 1:] = [second + kind * _OFFSETS[-1] + _OFFSETS[i] + SHAPE[i][1].index(v) for i, v in enumerate(shape)]
    weight = np.zeros(second + len(KINDS) * _OFFSETS[-1])
    silent = [first + len(_VALUES) * i + _VALUES.index("-") for i in range(len(LABELERS))]
    penalty = np.where(np.arange(len(weight)) < second, 0.01, 0.1)
    scale = counts / max(1.0, counts.sum()) * 1_000                  # the same strength of the penalty at every size
    for _ in range(100):                                             # Newton steps of penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(weight[at].sum(axis=1), -50, 50)))
        slope = np.bincount(at.ravel(), weights=np.repeat(scale * (post - p), width), minlength=len(weight)) - penalty * weight
        bend = np.zeros((len(weight), len(weight)))
        for i in range(width):
            np.add.at(bend, (at[:, [i]], at), (scale * p * (1 - p))[:, None])
        bend += np.diag(penalty)
        slope[silent], bend[silent], bend[:, silent] = 0, 0, 0
        bend[silent, silent] = 1
        step = np.linalg.solve(bend, slope)
        weight += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    w = weight.tolist()
    return Model(w[:first], w[first:second], w[second:], dict(zip(LABELERS, accuracy.tolist())), dict(enumerate(share.tolist())))


def trained(found: DataFrame) -> Model:
    """The model of all candidates in ``found``; EM sees every pattern that is among the ``PATTERNS`` most frequent."""
    c = F.col("c")
    each = found.select(F.explode("found").alias("c")).groupBy(
        c["kind"].alias("kind"), c["votes"].alias("votes"), c["shape"].alias("shape")).count()
    often = each.orderBy(F.desc("count"), "kind", "votes", "shape").limit(PATTERNS)
    return fitted(sorted((r["kind"], r["votes"], r["shape"], r["count"]) for r in often.collect()))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _with_added(found: DataFrame, model: Model) -> DataFrame:
    """``found`` with ``_added``: the spans of further kinds that the model accepts and no base span overlaps.

    Of overlapping additions the kind listed first stays.
    """
    accepted = F.filter("found", lambda c: (c["kind"] >= len(BASE)) & (model.score(c) >= THRESHOLD))
    more = F.transform(accepted, lambda c: F.struct(
        c["start"].alias("start"), (-c["end"]).alias("back"), c["kind"].alias("priority")))
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), (-b["end"]).alias("back"), F.lit(len(BASE) - 1).alias("priority")))
    rows = found.withColumn("_more", more).withColumn("_every", F.when(F.size("_more") > 0, F.array_sort(F.concat(base, "_more"))))
    kept = F.when(F.size("_more") > 0, uncontested(F.col("_every"), range(len(BASE) - 1, len(KINDS))))
    added = F.transform(F.filter(kept, lambda s: s["priority"] >= len(BASE)), lambda s: F.struct(
        s["start"].alias("start"), s["priority"].alias("kind"), (-s["back"]).alias("end")))
    return rows.withColumn("_added", F.coalesce(added, F.array().cast("array<struct<start:int,kind:int,end:int>>")))


def decided(found: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) from candidates and a model."""
    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long")

    return _with_added(found, model).select(
        "doc_id", *[number(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "_added"))).alias("spans"),
        F.size("_added").cast("long").alias("n_added"))


def personal_data(docs: DataFrame) -> DataFrame:
    """Personal data of every row of ``docs``; see ``decided``.

    Null and empty texts have no span (the digest of nothing); a null id stays null; repeated rows are
    searched one by one; without candidates there is nothing to train and nothing is added. Texts are
    searched whole and by themselves: no shuffle but that of the vote counts.
    """
    found = cut_lineage(candidates(docs))
    return decided(found, trained(found))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with all their columns, each span of ``text`` replaced by its kind in angle brackets.

    A null text stays null. ``n_chars``, if there, counts the new text. Spans that overlap become one.
    Rows and their candidates are written once in the shared folder, as training and replacing both read them.
    """
    found = cut_lineage(candidates(docs, whole_rows=True))
    names = F.array(*map(F.lit, KINDS))
    rows = _with_added(found, trained(found)).withColumn("_spans", F.array_sort(F.concat("base", "_added"))).withColumn(
        "_new", replaced(F.col("_row")["text"].cast("string"), F.col("_spans"), lambda s: F.concat(F.lit("<"), F.get(names, s["kind"]), F.lit(">"))))
    fresh = {"text": F.col("_new"), "n_chars": F.length("_new").cast("long")}
    return rows.select(*[fresh.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
