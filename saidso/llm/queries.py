"""One query per operator over its whole table, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from saidso.llm import ann, decontamination, html_extraction, licenses, packing, secret_scans, sharding, simhash, spelling, topk, toxicity, url_filters, whitening
from saidso.session import scratch

# The URL rules of op4.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    """The vocabulary file of op7, where the installed package has it."""
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(F.array_join(c, ",").alias(c) for c in ("license_sentences", "licenses", "unmatched")))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "n_shingles", "n_found")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extraction.extract_text(pages).select("page_id", "url", "text", "n_chars")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge_urls(pages, url_filters.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "embeddings")
    return topk.top_k(every, every.where("vec_id % 100 = 0"), 10)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_map(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "next_shard")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = {f"n_{k}": F.size(secret_scans.of_kind(F.col("strong"), k)).cast("long") for k, _ in secret_scans.STRONG}
    base = F.sha2(secret_scans.written(F.col("strong")), 256)
    return found.select("doc_id", *(c.alias(n) for n, c in counts.items()), base.alias("base_sha256"), secret_scans.written(F.col("spans")).alias("spans"))


def op11_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "embeddings")
    return ann.nearest(every, every.where("vec_id % 20 = 0"), 20)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the pipeline's sequences; corpus_pipeline.run returns their ids too."""
    return corpus_pipeline.run(spark, sf_dir).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES = {
    "op1_license_scans": op1_license_scans,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_html_extraction": op3_html_extraction,
    "op4_url_filters": op4_url_filters,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_exact_topk": op6_exact_topk,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_secret_scans": op10_secret_scans,
    "op11_approximate_neighbours": op11_approximate_neighbours,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_spelling_variants": op13_spelling_variants,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op1_license_scans": licenses.duckdb_sql(),
    "op2_benchmark_decontamination": """
WITH items AS (
  SELECT DISTINCT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t FROM benchmark WHERE text IS NOT NULL
), sized AS (
  SELECT item_id, t, least(5, len(t)) AS run FROM items WHERE len(t) > 0
), parts AS (
  SELECT DISTINCT item_id, run, array_to_string(t[i:i + run - 1], ' ') AS shingle
  FROM (SELECT item_id, t, run, unnest(range(1, len(t) - run + 2)) AS i FROM sized)
), totals AS (
  SELECT item_id, run, count(*) AS n_shingles FROM parts GROUP BY ALL
), docs AS (
  SELECT DISTINCT doc_id, text, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t FROM documents WHERE text IS NOT NULL
), runs AS (
  SELECT DISTINCT run FROM sized
), held AS (
  SELECT DISTINCT doc_id, text, run, array_to_string(t[i:i + run - 1], ' ') AS shingle
  FROM (SELECT doc_id, text, t, run, unnest(range(1, len(t) - run + 2)) AS i FROM docs, runs)
)
SELECT doc_id, item_id, n_shingles::INT AS n_shingles, count(*)::INT AS n_found
FROM held JOIN parts USING (run, shingle) JOIN totals USING (item_id, run)
GROUP BY doc_id, text, item_id, n_shingles
HAVING count(*) * 5 >= n_shingles * 4""",
    "op4_url_filters": """
WITH split AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM split
), rules(verdict, rule, rule_host, rule_path) AS (
  VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
         ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
), judged AS (
  SELECT page_id, host, path,
         (SELECT max_by({'rule': rule, 'verdict': verdict}, length(rule)) FROM rules
          WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best
  FROM parsed
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged""",
}
