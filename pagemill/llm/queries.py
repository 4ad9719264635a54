"""The training-data operators as queries over the driver's tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, language_id, ngram_join, packing, quality_rules, secret_scan, source_mix, token_files, topk_search, url_filters
from ._store import shared_dir, tokenizer_path

#: Rules that are asked for.
URL_RULES = (
    url_filters.Rule("allow", "com", "/"),
    url_filters.Rule("block", "example.com", "/en/"),
    url_filters.Rule("allow", "www.example.com", "/en/"),
    url_filters.Rule("block", "net", "/es/"),
    url_filters.Rule("block", "net", "/fr/"),
)
#: A conversation whose texts hold control strings.
EXTRA_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.topk(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(_read(spark, sf_dir, "pages"), URL_RULES).drop("n_candidates")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sizes(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(EXTRA_CONVERSATION, "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digests(chat_format.format_conversations(turns)).drop("first_bad_turn")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents")).drop("host", "host_rate")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(_read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents")).select("doc_id", "lang", "confidence", "text_lang", "declared", "kept")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    token_files.write_token_files(_read(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.read_token_files(spark, path, with_ids=False)


QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_url_filters": op2_url_filters,
    "op3_source_mix": op3_source_mix,
    "op4_chat_format": op4_chat_format,
    "op5_packing": op5_packing,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_ngram_join": op8_ngram_join,
    "op9_language_id": op9_language_id,
    "op10_token_files": op10_token_files,
}

OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CASE len(q.v) WHEN 0 THEN 0 ELSE CAST(list_dot_product(q.v, c.v) AS BIGINT) END AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

OP2_SQL = r"""
WITH rules(action, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    row_number() OVER () AS n
  FROM pages),
m AS (
  SELECT p.n, max_by(struct_pack(rule := r.host || r.path, action := r.action), length(r.host || r.path)) AS best
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.n)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM p LEFT JOIN m USING (n)
"""

OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (
  SELECT *, length(regexp_replace(text, '\\|<s>|</s>|<ANS>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|\[ROLE\]|\[SAYS\]|\[/ROLE\]', '\0+', 'g')) AS escaped,
    length(regexp_replace(role, '\\|<s>|</s>|<ANS>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|\[ROLE\]|\[SAYS\]|\[/ROLE\]', '\0+', 'g')) AS escaped_role
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(escaped + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 19 + escaped_role END) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)+') AS valid
FROM e GROUP BY conv_id
"""

OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
g AS (SELECT n, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT n, words, unnest(range(1, len(words) - 3)) AS i FROM d)),
r AS (SELECT n, i FROM g QUALIFY count(*) OVER (PARTITION BY n, gram) > 1),
c AS (SELECT n, sum(least(5, i - before)) AS covered FROM (SELECT n, i, lag(i, 1, -5) OVER (PARTITION BY n ORDER BY i) AS before FROM r) GROUP BY n),
l AS (SELECT n, count(*) - count(DISTINCT line) AS dup FROM (SELECT n, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY n),
m AS (
  SELECT d.n, doc_id, source, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN c USING (n) LEFT JOIN l USING (n)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, base_failed OR 100 * n_symbols > 10 * word_chars AS rule_failed FROM m),
h AS (SELECT source, count(*) AS docs, count(*) FILTER (rule_failed) AS bad FROM f GROUP BY source),
a AS (SELECT sum(docs) AS n, sum(bad) / sum(docs) AS mean, sum(bad * bad / docs) / sum(docs) - mean * mean AS spread, mean * (1 - mean) * count(*) / sum(docs) AS noise FROM h),
s AS (SELECT mean, CASE WHEN spread > noise THEN greatest(2.0, (mean * (1 - mean) - spread) / (spread - noise)) ELSE greatest(n, 1) END AS strength FROM a),
v AS (SELECT source, (bad + mean * strength) / (docs + strength) > 0.5 AS bad_host FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad_host AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

ORACLE_SQL = {"op1_topk_search": OP1_SQL, "op2_url_filters": OP2_SQL, "op4_chat_format": OP4_SQL, "op7_quality_rules": OP7_SQL}
