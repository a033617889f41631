"""Queries over the corpus tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrovox.llm import merkle, mixing, near_dups, ngram_join, oracles, packing, prefix_forest, progressive_jpeg, secrets, sharding, subvectors, toxicity, url_filters, warc
from dendrovox.plans.durable import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = progressive_jpeg.store_media(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return progressive_jpeg.digests(stored)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.round("severity", 6).alias("severity"), F.round("p_toxic", 6).alias("p_toxic"), "grade", toxicity.rejects().alias("toxic"))


def op3_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.captures(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "capture_order")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of(*secrets.BASE_KINDS)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op8_prefix_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), url_filters.RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.shard(docs, sharding.even_tree(8), sharding.even_tree(9, laid=8))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")


def op11_subvector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subvectors.cluster(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Query]:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_progressive_jpeg, op2_toxicity, op3_minhash_near_dups, op4_mix_sources, op5_warc_index, op6_best_fit_packing, op7_secret_scans, op8_prefix_forest_neighbours, op9_url_filters, op10_hash_tree_shards, op11_subvector_clusters, op12_merkle_manifest, op13_ngram_jaccard_join)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
