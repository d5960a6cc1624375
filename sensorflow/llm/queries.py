"""Registered queries of the operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorflow.llm import mixing, near_dedup, packing, phrases, prefix_trie, quality, secret_scan, sharding, simhash, suffix_dedup, token_files, topk, url_filter
from sensorflow.llm.staging import source, work_folder

SHARD_BYTES = 32 << 20
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
END_ID = 2


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good."""
    return source(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, size = source(spark, sf_dir, "documents").select("doc_id", "text"), F.octet_length("text").cast("long")
    folder = work_folder(spark, "shards")
    dealt = sharding.shard(docs, F.col("doc_id"), size, SHARD_BYTES, store=False)
    sharding.write_shards(dealt, folder)
    files = sharding.read_shards(dealt, folder, size)
    return files.select("doc_id", F.col("row_bytes").alias("n_bytes"), "shard", "shard_bytes", "shard_rows", "shard_depth")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = source(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(pages, rules).drop("url")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, width=3, percent=85)


def op4_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.fit(docs, trusted_ids(spark, sf_dir))
    return quality.judged(docs, weights).drop("text")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(source(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(secret_scan.scan(source(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.taken_in_order(docs)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_place", "last_place")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(source(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end=END_ID)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents").select("doc_id", "text")
    folder = work_folder(spark, "tokens")
    token_files.write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end=END_ID)
    return token_files.read_documents(spark, folder)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(source(spark, sf_dir, "documents").select("lang", "text"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(source(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.with_shared_starts(turns))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(source(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_extendible_sharding": op1_extendible_sharding,
    "op2_url_filter": op2_url_filter,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_quality_ratio": op4_quality_ratio,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_secret_novelty": op6_secret_novelty,
    "op7_curriculum_mix": op7_curriculum_mix,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_certified_packing": op9_certified_packing,
    "op10_token_files": op10_token_files,
    "op11_collocations": op11_collocations,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_simhash_near_dedup": op13_simhash_near_dedup,
}

OP1_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, strlen(text)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
steps AS (
  SELECT r, 0 AS depth, 0::BIGINT AS prefix, sum(coalesce(n_bytes, 0)) OVER () AS total, count(*) OVER () AS n FROM d
  UNION ALL
  SELECT s.r, s.depth + 1, d.h >> (59 - s.depth),
         sum(coalesce(d.n_bytes, 0)) OVER (PARTITION BY d.h >> (59 - s.depth)),
         count(*) OVER (PARTITION BY d.h >> (59 - s.depth))
  FROM steps s JOIN d USING (r) WHERE s.total > {SHARD_BYTES} AND s.n > 1 AND s.depth < 60)
SELECT doc_id, n_bytes, 'b' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard,
       total::BIGINT AS shard_bytes, n::BIGINT AS shard_rows, depth::INTEGER AS shard_depth
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY depth DESC) AS last FROM steps) JOIN d USING (r) WHERE last = 1
"""

OP2_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
m AS (
  SELECT p.r, max_by(rules.host || rules.path, length(rules.host || rules.path) * 1000 + length(rules.host)) AS rule,
         max_by(rules.verdict, length(rules.host || rules.path) * 1000 + length(rules.host)) AS verdict
  FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path) GROUP BY p.r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (r)
"""

OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score, abs(score) = 9223372036854775807 AS held
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

OP11_SQL = r"""
WITH pieces AS (
  SELECT d, lang, generate_subscripts(ps, 1) AS p, unnest(ps) AS piece
  FROM (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
               regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents)),
words AS (
  SELECT d, p, lang, generate_subscripts(ws, 1) AS i, unnest(ws) AS w
  FROM (SELECT d, p, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces)),
seq AS (SELECT lang, w, lead(w, 1) OVER t AS w2, lead(w, 2) OVER t AS w3 FROM words WINDOW t AS (PARTITION BY d, p ORDER BY i)),
c AS (
  SELECT lang, w AS phrase, 1 AS s, count(*) AS f FROM seq GROUP BY ALL UNION ALL
  SELECT lang, w || ' ' || w2 AS phrase, 2 AS s, count(*) AS f FROM seq WHERE w2 IS NOT NULL GROUP BY ALL UNION ALL
  SELECT lang, w || ' ' || w2 || ' ' || w3 AS phrase, 3 AS s, count(*) AS f FROM seq WHERE w3 IS NOT NULL GROUP BY ALL),
spoken AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE s = 1 GROUP BY lang),
cand AS (SELECT lang, phrase, s, f AS a, string_split(phrase, ' ') AS ws FROM c WHERE s > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, s, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:s], ' ') AS rp FROM cand JOIN (VALUES (1), (2)) ks(k) ON k < s),
scored AS (
  SELECT x.lang, x.phrase, s, a, k, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts x JOIN (SELECT lang, phrase, f FROM c) l ON l.lang = x.lang AND l.phrase = lp JOIN (SELECT lang, phrase, f FROM c) r ON r.lang = x.lang AND r.phrase = rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
outer_ AS (
  SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS a FROM cand JOIN (VALUES (1), (2)) places(i) ON s = 3 GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN outer_ o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN spoken USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

# CRC-32 bit by bit: bits of the reflected polynomial, low bit first.
OP12_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST) AS turns FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, turns, xor(list_reduce(list_concat([4294967295::BIGINT], range(0, 8 * length(conv_id::VARCHAR))), lambda crc, i:
    CASE WHEN (xor(crc, CASE WHEN i % 8 = 0 THEN ascii(substr(conv_id::VARCHAR, i // 8 + 1, 1)) ELSE 0 END) & 1) = 1
         THEN xor(xor(crc, CASE WHEN i % 8 = 0 THEN ascii(substr(conv_id::VARCHAR, i // 8 + 1, 1)) ELSE 0 END) >> 1, 3988292384::BIGINT)
         ELSE xor(crc, CASE WHEN i % 8 = 0 THEN ascii(substr(conv_id::VARCHAR, i // 8 + 1, 1)) ELSE 0 END) >> 1 END), 4294967295::BIGINT) % 9 AS h
  FROM own),
rebuilt AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
members AS (SELECT conv_id, turns, d, turns[1:d] AS path, d = len(turns) AS last FROM rebuilt, unnest(range(0, len(turns) + 1)) AS ds(d)),
nodes AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(path[d].text) END AS saved
  FROM members GROUP BY path, d),
children AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
n AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (path, depth)),
below AS (
  SELECT a.path, a.depth, sum(b.saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM n) b JOIN n a ON a.depth = b.above AND a.path = b.path[1:b.above] GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN below USING (path, depth) LEFT JOIN n p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""

SQL = {"op12_prefix_trie": OP12_SQL, "op11_collocations": OP11_SQL, "op5_exact_top_k": OP5_SQL, "op1_extendible_sharding": OP1_SQL, "op2_url_filter": OP2_SQL}
