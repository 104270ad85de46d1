"""The registered queries of this subpackage, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, common, htmltext, linededup, minhash, packing, quality, tokenfile, toxicity, urlfilter, vectors

Query = Callable[[SparkSession, str], DataFrame]
HOST_RULES = (
    urlfilter.HostRule("allow", "com", "/"),
    urlfilter.HostRule("block", "example.com", "/en/"),
    urlfilter.HostRule("allow", "www.example.com", "/en/"),
    urlfilter.HostRule("block", "net", "/es/"),
    urlfilter.HostRule("block", "net", "/fr/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(spark, common.narrow(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"), size=3, percent=85)


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bytebpe.decode(bytebpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), HOST_RULES)


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tokenfile.round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(spark, docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_embedding_near_dedup": embedding_near_dedup,
    "op2_html_extraction": html_extraction,
    "op3_line_dedup": line_dedup,
    "op4_minhash_near_dedup": minhash_near_dedup,
    "op5_byte_bpe": byte_bpe,
    "op6_url_filters": url_filters,
    "op7_token_id_output": token_id_output,
    "op8_best_fit_packing": best_fit_packing,
    "op9_toxicity": toxicity_scores,
    "op10_quality_rules": quality_rules,
}


def _url_sql() -> str:
    fits = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.action} {r.name}'"
        for r in sorted(HOST_RULES, key=lambda r: -len(r.name))
    )
    bad = "|".join(r.regex for r in urlfilter.PATTERNS)
    low = f"translate({{}}, '{urlfilter.UPPER}', '{urlfilter.LOWERED}')"
    return f"""
WITH cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, {low.format("coalesce(url, '')")} AS low, {low.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fitted AS (SELECT *, CASE {fits} END AS fit FROM parts)
SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule,
  CASE WHEN fit IS NOT NULL THEN split_part(fit, ' ', 1) WHEN regexp_matches(low, '{bad}') THEN 'block' ELSE 'allow' END AS verdict
FROM fitted"""


LINE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{urlfilter.UPPER}', '{urlfilter.LOWERED}') AS key FROM lines),
often AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
marked AS (SELECT keyed.*, often.key IS NOT NULL AS gone FROM keyed LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id"""

ORACLE_SQL: dict[str, str] = {"op3_line_dedup": LINE_SQL, "op6_url_filters": _url_sql()}
