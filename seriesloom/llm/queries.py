"""The numbered queries, each over its whole table, and their DuckDB statements where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm.decontam import contaminated
from seriesloom.llm.filter_audit import audit_filters
from seriesloom.llm.html_extract import extract_main_text
from seriesloom.llm.langid import identify_languages
from seriesloom.llm.line_dedup import remove_spread_lines
from seriesloom.llm.mixing import mix_sources
from seriesloom.llm.ngram_join import jaccard_components
from seriesloom.llm.periodic_runs import periodic_runs
from seriesloom.llm.sharding import shard_documents
from seriesloom.llm.simhash import simhash_components
from seriesloom.llm.topk import top_k
from seriesloom.llm.toxicity import score_toxicity
from seriesloom.llm.warc import archive_pages

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_spread_lines(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


OP3_SQL = r"""
WITH RECURSIVE
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s
  FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS o
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared WHERE 100 * o >= 75 * (nx + ny - o)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id
FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY 1) c ON s.doc_id = c.x
"""

OP4_SQL = r"""
WITH
sized AS (SELECT doc_id, source, substr(md5(coalesce(text, '')), 1, 16) AS mark, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap,
    (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS budget
  FROM sizes),
levels AS (
  SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weight_left
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
stops AS (SELECT *, cap * weight_left <= (budget - cap_before) * weight AS stopped FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN stopped THEN cap ELSE
    weight * (budget - coalesce((sum(cap) FILTER (stopped) OVER ()), 0)) / (sum(weight) FILTER (NOT stopped) OVER ())::BIGINT END AS target
  FROM stops),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM targets),
keyed AS (
  SELECT s.*, p.source_size, p.target, p.epochs, floor(p.target)::BIGINT - p.epochs * p.source_size AS rest,
    ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '') || ':' || s.mark || ':' || p.epochs), 1, 15))::BIGINT AS key
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
run AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM keyed)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM run
"""

OP8_SQL = r"""
WITH
lines AS (SELECT source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
spread AS (SELECT line FROM lines WHERE length(line) >= 20 AND source IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) >= 5),
bad AS (SELECT list(line) AS lines FROM spread),
cut AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS had,
    list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(bad.lines, []), trim(x))) AS kept
  FROM documents, bad)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
  coalesce(len(had), 0)::BIGINT AS n_lines, coalesce(len(had) - len(kept), 0)::BIGINT AS n_removed
FROM cut
"""

OP10_SHARD = r"""
WITH
keyed AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
prefixes AS (SELECT h, n_bytes, d, h >> (60 - d) AS p FROM keyed, (SELECT unnest(range(0, 61))::BIGINT AS d)),
sums AS (SELECT d, p, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs, min(h) AS lo, max(h) AS hi FROM prefixes GROUP BY 1, 2),
fits AS (SELECT * FROM sums WHERE shard_bytes <= {limit} OR lo = hi OR d = 60),
best AS (
  SELECT k.h, min(f.d) AS d FROM (SELECT DISTINCT h, d, p FROM prefixes) k JOIN fits f ON k.d = f.d AND k.p = f.p GROUP BY 1)
SELECT k.doc_id, k.n_bytes, b.d AS depth, CASE WHEN b.d = 0 THEN '' ELSE lpad(bin(f.p), b.d::INT, '0') END AS shard,
  f.shard_bytes, f.shard_docs, f.shard_bytes > {limit} AS oversize
FROM keyed k JOIN best b ON k.h = b.h JOIN fits f ON f.d = b.d AND f.p = k.h >> (60 - b.d)
"""

OP5_SQL = r"""
WITH
whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM whole a JOIN whole b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, row_number() OVER w AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""

OP6_SQL = r"""
WITH
digits AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
coded AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest
  FROM digits),
last AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_page FROM coded)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last_page THEN last_page END AS refers_to
FROM last
"""

OP13_SQL = r"""
WITH
words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
marks AS (
  SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM words),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY 1),
cells AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad
  FROM marks LEFT JOIN known USING (doc_id) GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || d.c || e.c || f.c AS filter_order FROM letter a, letter b, letter d, letter e, letter f
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders),
judged AS (
  SELECT part, filter_order, step, n, good, bad, fails[instr('ABCDE', filter_order[step])] AS own,
    list_bool_or(list_transform(range(1, step), lambda i: fails[instr('ABCDE', filter_order[i])])) AS gone,
    len(list_filter(fails, lambda x: x)) AS many
  FROM cells, steps)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (NOT own AND NOT coalesce(gone, false)), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (own AND NOT coalesce(gone, false)), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (own AND gone), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (own AND many = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (own AND NOT coalesce(gone, false)), 0)::BIGINT AS good_lost,
  coalesce(sum(bad) FILTER (own AND NOT coalesce(gone, false)), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(many, 1)) FILTER (own), 0)::BIGINT AS shapley
FROM judged GROUP BY ALL
"""

QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_source_mixing": op4_source_mixing,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_sharding": op10_sharding,
    "op11_simhash": op11_simhash,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": OP3_SQL,
    "op4_source_mixing": OP4_SQL,
    "op5_exact_top_k": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op8_line_dedup": OP8_SQL,
    "op10_sharding": OP10_SHARD.replace("{limit}", str(64 << 20)),
    "op13_filter_audit": OP13_SQL,
}
