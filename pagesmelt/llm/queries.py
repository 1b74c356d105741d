"""The operators over their whole tables, as registered queries, with comparison SQL.

SQL can state operators 1, 6, 8, 11 and 12; the others are held against brute force in
``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesmelt.llm.crf_language import identify_languages
from pagesmelt.llm.decontaminate import find_leaks
from pagesmelt.llm.divergence import audit_sources
from pagesmelt.llm.embedding_passes import near_vectors
from pagesmelt.llm.neural_lm import score_texts
from pagesmelt.llm.ngram_join import similar_documents
from pagesmelt.llm.phrases import mine_phrases
from pagesmelt.llm.secrets import scan_secrets, span_digest
from pagesmelt.llm.shards import assign_shards, even_tree, grown_tree
from pagesmelt.llm.site_quality import judge_documents
from pagesmelt.llm.token_counts import count_tokens
from pagesmelt.llm.token_files import token_documents
from pagesmelt.llm.trie_bpe import encode_decode

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return encode_decode(_table(spark, sf_dir, "documents"), path, digests=True)


def op3_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = even_tree(2, 2, 2)
    return assign_shards(_table(spark, sf_dir, "documents"), tree, grown_tree(tree))


def op5_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_documents(_table(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id")


def op7_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op8_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return count_tokens(_table(spark, sf_dir, "documents"), path)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    number = "size(filter(spans, s -> s.kind = '{0}')) AS long"
    return found.select(
        "doc_id",
        *(F.expr(f"cast({number.format(kind)})").alias(f"n_{kind}")
          for kind in ("assign", "access", "hex")),
        F.expr(f"sha2({span_digest(True)}, 256)").alias("base_sha256"),
        F.expr(span_digest(False)).alias("spans"))


def op11_setm_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(_table(spark, sf_dir, "documents"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(_table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_documents(_table(spark, sf_dir, "documents"), path)


QUERIES: dict[str, Query] = {
    query.__name__: query for query in (
        op1_projection_passes, op2_trie_bpe, op3_neural_lm, op4_hash_tree, op5_site_quality,
        op6_ngram_join, op7_crf_language, op8_suffix_automaton, op9_token_counts, op10_secret_scan,
        op11_setm_phrases, op12_source_audit, op13_token_files)}

_FOLD_AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {}

ORACLES["op8_suffix_automaton"] = rf"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all({_FOLD_AZ.format("coalesce(text, '')")},
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
item AS (
  SELECT item_id, regexp_extract_all({_FOLD_AZ.format("coalesce(text, '')")},
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS size,
    array_to_string(words[p:p + least(10, len(words)) - 1], ' ') AS run
  FROM (SELECT *, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS p
        FROM item WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM item_window),
doc_run AS (
  SELECT doc_id, size, p, array_to_string(words[p:p + size - 1], ' ') AS run
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS p
        FROM doc, sizes WHERE len(words) >= size)),
hit AS (
  SELECT doc_id, p, d.size, item_id FROM doc_run d JOIN item_window w
  ON d.run = w.run AND d.size = w.size),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + size)) AS place FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS name FROM hit) GROUP BY doc_id)
SELECT doc_id, cast(len(words) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLES["op1_projection_passes"] = """
WITH RECURSIVE valid AS (
  SELECT vec_id, label, cast(embedding AS double[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
link AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM valid a JOIN valid b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
  SELECT vec_id AS u, vec_id AS w FROM embeddings
  UNION SELECT reach.u, link.w FROM reach JOIN link ON reach.w = link.u),
least AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
degree AS (SELECT u, count(*) AS n_links FROM link GROUP BY u)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.u = e.vec_id LEFT JOIN degree ON degree.u = e.vec_id
"""

ORACLES["op6_ngram_join"] = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({_FOLD_AZ.format("coalesce(text, '')")},
    '[^\x20\x09-\x0D]+') AS words FROM documents),
gram AS (
  SELECT DISTINCT doc_id, array_to_string(words[p:p + 2], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS p
        FROM doc WHERE len(words) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS u, b.doc_id AS w FROM gram a JOIN gram b
  ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN size s ON s.doc_id = a.doc_id JOIN size t ON t.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, s.n, t.n HAVING 100 * count(*) >= 90 * (s.n + t.n - count(*))),
reach AS (
  SELECT doc_id AS u, doc_id AS w FROM documents
  UNION SELECT reach.u, link.w FROM reach JOIN link ON reach.w = link.u),
least AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d JOIN least ON least.u = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id
"""

ORACLES["op11_setm_phrases"] = rf"""
WITH piece AS (
  SELECT lang, doc, unnest(range(1, len(pieces) + 1)) AS p, unnest(pieces) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, string_split_regex(
    {_FOLD_AZ.format("coalesce(text, '')")},
    '[.,;:!?\x0A-\x0D]') AS pieces FROM documents)),
word AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS pos
  FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM piece)),
size AS (SELECT lang, count(*) AS n FROM word GROUP BY lang),
f AS (
  SELECT lang, k, words[pos:pos + k - 1] AS phrase, count(*) AS a
  FROM word, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE pos + k - 1 <= len(words)
  GROUP BY ALL HAVING count(*) >= 100),
cut AS (
  SELECT c.lang, c.phrase, c.k, c.a, s.n, j, x.a AS l, y.a AS r,
    1000::HUGEINT * c.a * s.n // (x.a::HUGEINT * y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c JOIN size s USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = c.phrase[1:j]
  JOIN f y ON y.lang = c.lang AND y.phrase = c.phrase[j + 1:]),
lowest AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_part AS (
  SELECT lang, a, phrase[b:e] AS phrase
  FROM (SELECT lang, a, k, phrase, b, unnest(range(b + 1, k + 1)) AS e
        FROM (SELECT *, unnest(range(1, k)) AS b FROM f WHERE k > 2))
  WHERE e - b + 1 < k),
left_over AS (
  SELECT * FROM lowest c ANTI JOIN inner_part i ON i.lang = c.lang AND i.phrase = c.phrase AND i.a >= c.a)
SELECT lang, row_number() OVER best AS rank, array_to_string(phrase, ' ') AS phrase, a, l, r, n,
  score::BIGINT AS score
FROM left_over
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(phrase, ' ')))
QUALIFY row_number() OVER best <= 2000
"""

ORACLES["op12_source_audit"] = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_FOLD_AZ.format("coalesce(text, '')")},
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
word AS (SELECT id, lang, source, unnest(terms) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS n FROM word GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
langs AS (SELECT lang, count(term)::HUGEINT AS v, coalesce(sum(n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang FROM doc) LEFT JOIN kept USING (lang) GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM doc),
counts AS (SELECT lang, source, term, count(*) AS n FROM word SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total
  FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (t.total + 5 * l.v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 5) // (l.total + 5 * l.v) AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang)
  LEFT JOIN counts c USING (lang, source, term)),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b USING (lang)
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  WHERE a.source <> b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""
