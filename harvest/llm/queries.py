"""The registered queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from harvest.llm.licenses import scan_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[function.__name__] = function
    return function


SHARDS = [f"shard-{i:03d}" for i in range(256)]


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    from harvest.llm.sharding import place

    return place(_documents(spark, sf_dir), SHARDS).select("doc_id", "slot", "shard")


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, compression and verdict of every document."""
    from harvest.llm.quality import quality

    return quality(_documents(spark, sf_dir))


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as written to frequency-ranked token files and read back."""
    import public_tokenizers

    from harvest.llm.token_files import token_files

    return token_files(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from two thirds of them."""
    from harvest.llm.language import held_out, identified, learned

    docs = _documents(spark, sf_dir)
    return identified(docs, learned(docs.where(~held_out(3, 1))))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence."""
    import public_tokenizers

    from harvest.llm.packing import pack

    return pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of near copies of every document."""
    from harvest.llm.near_duplicates import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


SQL["op8_near_duplicates"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, string_split_regex(trim(regexp_replace(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS w FROM documents),
named AS (SELECT doc_id, CASE WHEN w = [''] THEN [] ELSE w END AS w FROM words),
sets AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END) AS s FROM named),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s
                    AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * c >= 75 * (m.n + n.n - c)),
reached(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d JOIN roots r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document."""
    from harvest.llm.decontaminate import leaks

    return leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements of every document."""
    from harvest.llm.licenses import scan

    return scan(_documents(spark, sf_dir)).drop("spans")


SQL["op2_licenses"] = scan_sql()


@query
def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every document under subword lattices."""
    import public_tokenizers

    from harvest.llm.lattice import score_documents

    return score_documents(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    from harvest.llm.pii import personal_data

    return personal_data(_documents(spark, sf_dir))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector among all vectors."""
    from pyspark.sql import functions as F

    from harvest.llm.hard_negatives import hard_negatives, usable

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), moved)
    return hard_negatives(rows, rows.where("vec_id % 50 = 0"))


SQL["op13_hard_negatives"] = r"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, n.id AS negative_id, p.positive_score, n.score AS negative_score,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) <= 3
"""


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language."""
    from harvest.llm.collocations import collocations

    return collocations(_documents(spark, sf_dir))


SQL["op11_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
cut AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
phrases AS (
  SELECT lang, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS p
  FROM cut, (VALUES (1), (2), (3), (4)) t(m) WHERE len(w) >= m),
counts AS (SELECT lang, p, count(*) AS f FROM phrases GROUP BY ALL),
often AS (SELECT * FROM counts WHERE f >= 30),
parts AS (
  SELECT o.lang, o.p, o.f AS a, k, l.f AS l, r.f AS r,
         CAST(2000000::HUGEINT * o.f // (l.f + r.f) AS BIGINT) AS score
  FROM often o, (VALUES (1), (2), (3)) t(k) , often l, often r
  WHERE k < len(o.p) AND l.lang = o.lang AND l.p = o.p[1:k] AND r.lang = o.lang AND r.p = o.p[k + 1:]),
scored AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
held AS (
  SELECT lang, s AS p, max(f) AS longer FROM (
    SELECT lang, f, unnest(flatten(list_transform(range(2, len(p)), lambda m:
             list_transform(range(1, len(p) - m + 2), lambda i: p[i:i + m - 1])))) AS s FROM often WHERE len(p) > 2) x
  GROUP BY ALL),
ranked AS (
  SELECT s.lang, array_to_string(s.p, ' ') AS phrase, a, l, r, score
  FROM scored s LEFT JOIN held h ON h.lang = s.lang AND h.p = s.p WHERE h.longer IS NULL OR 100 * h.longer < 80 * a)
SELECT ranked.lang, row_number() OVER (PARTITION BY ranked.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM ranked JOIN (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE len(p) = 1 GROUP BY lang) t ON t.lang = ranked.lang
QUALIFY rank <= 2000
"""


@query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of two thirds of them."""
    from harvest.llm.language import held_out
    from harvest.llm.toxicity import learned, scored

    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, learned(docs.where(~held_out(3, 1)), labels.where(~held_out(3, 1))))
