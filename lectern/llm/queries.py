"""Registered queries of the training-data operators: thin digests of the operators' outputs.

Every query runs its operator with production parameters over its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctw, decontaminate, hard_negatives, html_main, langid, line_dedup, sharding, simhash, substring_dedup, topk, toxicity, turn_trie
from .common import read_table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.removed_words(read_table(spark, sf_dir, "documents"), size=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.dedup_lines(docs, min_chars=10)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(read_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(read_table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_main.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), size=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), positives=5, k=3, low=50, high=95, every=50)


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.trie(read_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_sharding, op2_substring_dedup, op3_line_dedup, op4_context_tree, op5_bpe, op6_html_main, op7_decontaminate, op8_language_id, op9_top_k, op10_simhash, op11_toxicity, op12_hard_negatives, op13_turn_trie]
    return {f.__name__: f for f in ops}


SPACE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

OP2_SQL = f"""
WITH split AS (
  SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), {SPACE}, repeat(chr(32), 6)), chr(32)), lambda x: x <> '') AS w FROM documents),
place AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM split WHERE len(w) >= 13),
win AS (SELECT doc_id, p, array_to_string(w[p:p+12], chr(32)) AS s FROM place),
least AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, p + k.k AS i FROM win JOIN least USING (s), (SELECT unnest(generate_series(0, 12)) AS k) k WHERE least.d < doc_id),
lost AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
SELECT s.doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END, chr(32)), '')) AS kept_sha256
FROM split s LEFT JOIN lost USING (doc_id)
"""

OP3_SQL = f"""
WITH lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(ls) AS l, unnest(generate_series(1, len(ls))) AS i FROM lines),
keyed AS (SELECT doc_id, i, l, translate(trim(l, {SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
least AS (SELECT k, min(doc_id) AS d FROM keyed WHERE length(k) >= 10 GROUP BY k),
flagged AS (SELECT doc_id, i, l, coalesce(length(keyed.k) >= 10 AND least.d < doc_id, false) AS gone FROM keyed LEFT JOIN least ON keyed.k = least.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id AND len(q.e) = len(x.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, CAST(list_sum(list_transform(list_zip(a.e, x.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v x ON a.vec_id % 50 = 0 AND a.vec_id <> x.vec_id AND len(a.e) = len(x.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

OP13_SQL = """
WITH RECURSIVE step(i, k, v) AS (
  SELECT i::BIGINT, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
turns AS (
  SELECT conv_id::BIGINT AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
named AS (
  SELECT c, turn, upper(sha256(strlen(r) || ':' || r || x)[1:32] || printf('%08x', len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')))) AS id FROM turns),
own AS (SELECT c, list(id ORDER BY turn NULLS FIRST, id) AS ids FROM named GROUP BY c),
cut AS (
  SELECT c, ids, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 4 AS h FROM own, crc),
whole AS (
  SELECT a.c, list_concat(coalesce(b.ids, [])[1:a.h], a.ids[a.h + 1:]) AS ids FROM cut a LEFT JOIN own b ON b.c = a.c - a.c % 20),
member AS (SELECT c, d, len(ids) AS n, array_to_string(ids[1:d], '') AS k FROM (SELECT c, ids, unnest(range(len(ids) + 1)) AS d FROM whole)),
node AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d) AS ends FROM member GROUP BY k, d),
kids AS (SELECT k[1:len(k) - 40] AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
sized AS (SELECT k, d, conv_id, n_convs, ends, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * ('0x' || right(k, 8))::BIGINT END AS saved FROM node LEFT JOIN kids USING (k)),
above AS (SELECT k[1:40 * a] AS k, n_children, saved FROM (SELECT *, unnest(range(d + 1)) AS a FROM sized)),
sums AS (SELECT k, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY k)
SELECT s.conv_id, s.d::BIGINT AS depth, up.conv_id AS parent_conv_id, s.n_convs, s.n_children, n_leaves, saved_tokens, sha256(coalesce(s.ends, '')) AS ends_sha256
FROM sized s JOIN sums USING (k) LEFT JOIN node up ON s.d > 0 AND up.k = s.k[1:len(s.k) - 40]
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can state the result; the rest is tested against brute force."""
    return {"op2_substring_dedup": OP2_SQL, "op3_line_dedup": OP3_SQL, "op9_top_k": OP9_SQL, "op12_hard_negatives": OP12_SQL, "op13_turn_trie": OP13_SQL}
