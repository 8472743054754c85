"""The registered queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe import bpe_digests
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .html_extract import extract_pages
from .mixing import mix_sources
from .periodic import periodic_runs, planted
from .quality import score_quality
from .secrets import scan_secrets
from .sharding import shard_rows
from .simhash import near_classes
from .suffix_dedup import repeated_bytes
from .url_filter import RULES, judge_urls


def tokenizer_path() -> str:
    """The public tokenizer that the queries use; the operator takes any file of its kind."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate(F.zip_with("a", "b", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    out = repeated_bytes(_table(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("a").cast("long").alias("n_spans"), F.lower(F.hex("kept")).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "span_owners", "span_repositories", "span_live")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(_table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(_table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    exponent = F.expr("best.length * 1000 div best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        exponent.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_simhash": op5_simhash,
    "op6_url_filter": op6_url_filter,
    "op7_html_extract": op7_html_extract,
    "op8_bpe": op8_bpe,
    "op9_ann": op9_ann,
    "op10_secrets": op10_secrets,
    "op11_sharding": op11_sharding,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_periodic": op13_periodic,
}

_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"


def _case(column: int) -> str:
    fits = "\n".join(
        f"      WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, said)[column]}'"
        for said, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"CASE\n{fits}\n      ELSE NULL END"


def _parts(url: str) -> str:
    return rf"""translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path"""


ORACLE_SQL = {
    "op1_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_NORMAL}) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op4_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
g AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 100)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS s FROM d WHERE n >= 50)),
f AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
c AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS step FROM g JOIN f USING (k) WHERE doc_id > least),
u AS (SELECT doc_id, s, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM c),
r AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM u GROUP BY doc_id, run),
e AS (SELECT doc_id, a AS until, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM r
  UNION ALL SELECT d.doc_id, n, coalesce(max(b), 0) FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id, n),
q AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (until - since)), '' ORDER BY since) AS rest FROM e JOIN d USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM r GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM d JOIN q USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op6_url_filter": rf"""
WITH RECURSIVE tags AS (
  SELECT url AS a, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<(?:link|meta)\b[^<>]*>')) AS tag FROM pages),
links AS (
  SELECT a, regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS b FROM tags
  WHERE regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b')
  UNION SELECT a, regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM tags
  WHERE regexp_matches(tag, '(?i)^<meta') AND regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')),
both_ways AS (
  SELECT a, replace(b, '&amp;', '&') AS b FROM links WHERE contains(b, '://') AND a IS NOT NULL
  UNION SELECT replace(b, '&amp;', '&'), a FROM links WHERE contains(b, '://') AND a IS NOT NULL),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
judged AS (SELECT node, other, {_parts('other')} FROM reach),
passed AS (SELECT node, min({_case(1)}) AS passed FROM judged GROUP BY node),
own AS (SELECT page_id, url, {_parts('url')} FROM pages)
SELECT page_id, host, path, {_case(0)} AS rule, coalesce({_case(1)}, passed, 'allow') AS verdict
FROM own LEFT JOIN passed ON url = node""",
    "op12_hard_negatives": """
WITH w AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM w a JOIN w b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) <= 3""",
}
