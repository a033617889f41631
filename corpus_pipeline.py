"""A training corpus from ``documents``: five stages, each written as Parquet and read again.

Toxic documents go, one document of each group of near-duplicates stays, secrets are blotted out,
sources are interleaved to their target weights, and the rest is packed into training sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrovox.llm import mixing, near_dups, packing, secrets, toxicity
from dendrovox.plans.durable import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _held(docs: DataFrame, *needed: str) -> DataFrame:
    """All columns in one struct beside the ``needed`` ones, so that no operator meets a name of the table's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), *needed)


def _given(held: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` as ``_held`` took them."""
    return held.select(*[F.col(f"document.`{c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on ``labels``, does not reject.

    Every row is judged by its own text: repeated rows stay or go together, null and empty texts are
    judged by the class rate alone, null keys take no part in fitting. Columns keep their values,
    whatever their names; an empty table stays empty.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _given(toxicity.score(_held(docs, "text"), model).where(~toxicity.rejects()), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group.

    Documents without words and rows of a null key all stay; rows that repeat the least key of a
    group stay together. Columns keep their values, whatever their names; an empty table stays empty.
    """
    return near_dups.keep_one(docs)


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; spans that look like secrets are replaced and n_chars follows.

    A null text stays null, with a null n_chars; all other columns keep their values.
    """
    clean = docs.withColumn("text", secrets.redacted(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files ordered by their place in the mixture.

    A null source is a source of its own; null keys, null texts and repeated rows are all placed.
    Columns keep their values, whatever their names; an empty table stays empty.
    """
    placed = mixing.mix(_held(docs, "doc_id", "source"))
    return _given(placed.repartitionByRange("place").sortWithinPartitions("place"), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences, which follow the files' order.

    A null text is an empty document; repeated rows and null keys are packed as others are; columns
    but key and text are left out; no documents, no sequences.
    """
    import public_tokenizers

    packed = packing.pack(packing.in_file_order(docs), public_tokenizers.path("word_bpe_49k.json"), ordered=True)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("secret scans", blot_secrets),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot fit the model or run the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = scratch_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
