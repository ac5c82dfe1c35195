"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html_extract, langid, licenses, mixing, ngram_join, packing, quality, secrets, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file."""
    from public_tokenizers import path

    return path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a document stands in a directory of its source and hundred, whose first one is its licence file."""
    hundred = F.floor(F.col("doc_id") / 100)
    name = F.when(F.col("doc_id") % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    docs = _table(spark, sf_dir, "documents")
    return licenses.scan(docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("none")), hundred.cast("string"), name).alias("path"), "text"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary())


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


# What SQL can say of an operator's result: those columns of it that hold no model's, hash's or tokenizer's work.


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def language_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_language_id(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("undetermined"))


def token_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_token_counts(spark, sf_dir).select("doc_id", "n_pretokens", "n_bytes")


def shingle_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_ngram_jaccard_join(spark, sf_dir).select("doc_id", "n_shingles")


def mixing_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_source_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each source."""
    return op6_source_mixing(spark, sf_dir).groupBy("source").agg(F.sum("taken").alias("taken"))


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    whole = (op1_quality_rules, op2_html_extraction, op3_language_id, op4_token_counts, op5_ngram_jaccard_join, op6_source_mixing, op7_license_scan, op8_best_fit_packing, op9_nearest_neighbours, op10_secret_scan)
    return {f.__name__: f for f in (*whole, quality_base, language_base, token_base, shingle_base, mixing_base, mixing_sources, secret_base)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
  lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
  windows AS (SELECT rid, pos, array_to_string(list_slice(words, pos, pos + 7), ' ') AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS pos FROM d WHERE len(words) >= 8)),
  twice AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1),
  covered AS (SELECT rid, count(DISTINCT word) AS n FROM (SELECT rid, unnest(range(pos, pos + 8)) AS word FROM twice) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
  len(words) < 20 OR 100 * coalesce(covered.n, 0) > 30 * len(words) AS base_failed
FROM d LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)"""
#: The table of the checksum by its rule, then a step for each byte of the id's digits.
_LANGUAGE = r"""
WITH RECURSIVE bits AS (SELECT 0 AS step, n, n AS v FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n) UNION ALL SELECT step + 1, n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE step < 8),
  crc AS (SELECT list(v ORDER BY n) AS t FROM bits WHERE step = 8),
  d AS (SELECT doc_id, text, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS digits FROM documents)
SELECT doc_id, coalesce(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), digits), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 3 = 1, false) AS held_out,
  NOT regexp_matches(coalesce(text, ''), '\p{L}') AS undetermined
FROM d, crc"""
_SHINGLES = r"""
SELECT doc_id, CAST(CASE WHEN len(words) = 0 THEN 0 WHEN len(words) < 4 THEN 1 ELSE list_unique(list_transform(range(1, len(words) - 2), lambda i: array_to_string(list_slice(words, i, i + 3), ' '))) END AS BIGINT) AS n_shingles
FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS words FROM documents)"""
#: Each round closes the sources whose share passes their limit, until none does.
_FILLED = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
  s AS (SELECT source, n, CAST([5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source)),
  fill AS (SELECT 0 AS round, CAST(0 AS DOUBLE) AS scale UNION ALL SELECT round + 1, (SELECT CAST(sum(n) - sum(CASE WHEN n = 0 OR w * f.scale > 3 * n THEN 3 * n ELSE 0 END) AS DOUBLE) / sum(CASE WHEN n = 0 OR w * f.scale > 3 * n THEN 0 ELSE w END) FROM s) FROM fill f WHERE round < 30),
  targets AS (SELECT source, n, CASE WHEN n = 0 OR w * scale > 3 * n THEN CAST(3 * n AS DOUBLE) ELSE w * scale END AS target FROM s, (SELECT scale FROM fill WHERE round = 30))"""
_MIXING = _FILLED + """
SELECT doc_id, size, n AS source_size, target FROM d JOIN targets ON d.source IS NOT DISTINCT FROM targets.source"""
_MIXING_SOURCES = _FILLED + """
SELECT source, CAST(least(3 * n, round_even(target, 0)) AS BIGINT) AS taken FROM targets"""


def _matches(kind: str, pattern: str, least: str) -> str:
    """Start, kind and end of a pattern's matches: they alternate with the pieces between them."""
    return f"""SELECT rid, '{kind}' AS kind, start, start + length(m) AS stop FROM (SELECT rid, m[i] AS m, own[i] AS own, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT rid, m, own, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {2 if kind == "assign" else 0}) AS own, string_split_regex(text, '{pattern}') AS p FROM d))) WHERE length(own) >= {least}"""


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
  found AS ({_matches("assign", _ASSIGN, "8")} UNION ALL {_matches("access", "AKIA[A-Z0-9]+", "16")} UNION ALL {_matches("hex", "[0-9a-f]+", "32")}),
  listed AS (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY start, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END) AS spans FROM found GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN listed USING (rid)"""


def oracle_sql() -> dict[str, str]:
    return {
        "quality_base": _QUALITY, "language_base": _LANGUAGE, "shingle_base": _SHINGLES, "mixing_base": _MIXING, "mixing_sources": _MIXING_SOURCES, "secret_base": _SECRETS,
        "token_base": f"SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_pretokens, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents",
    }
