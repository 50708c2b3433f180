"""The registered queries of this subpackage, opN_<name>: thin digests of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontam, divergence, html, idfile, merkle, mixing, paragraphs, quality, secret_scan, setsketch, sharding, simhash, sql, suffix
from palimpsest.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("score")


def op2_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined("base"), 256).alias("base_sha256"), secret_scan.joined("spans").alias("spans"), F.col("tested").alias("n_tested"), F.col("random").alias("n_random"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op4_paragraph_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op6_elias_fano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.written_and_read(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extracted(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op9_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, "contaminated")


def op10_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op13_setsketch_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.classes(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_secret_battery, op3_feistel_shards, op4_paragraph_clusters, op5_source_mix, op6_elias_fano_ids, op7_suffix_dedup, op8_site_templates, op9_wu_manber, op10_simhash_links, op11_source_audit, op12_merkle_manifest, op13_setsketch_classes)}
ORACLES = {"op1_quality_rules": sql.QUALITY, "op9_wu_manber": sql.DECONTAMINATION, "op11_source_audit": sql.DIVERGENCE, "op12_merkle_manifest": sql.MANIFEST}
