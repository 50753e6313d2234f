"""Cleaning, deduplicating, mixing and packing the documents: each stage takes what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.llm import linededup, minhash, mixing, packing, toxicity
from chronofact.llm.common import discard, packed_row, stage

#: What is left out is broadcast while it takes so many bytes at most (32 an entry); else it is joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def _own(docs: DataFrame) -> list:
    return [F.col("row").getField(c).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer gives less than one half."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.col("text"), packed_row(docs))
    return toxicity.score(rows, model, score_col="score").where("score < 0.5").select(*_own(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without lines that an earlier document holds; n_chars follows the text."""
    cut = linededup.apply_bitmaps(docs, linededup.losses(docs), out_col="text")
    return cut.select(*((F.char_length("text").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`")) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id. Documents without an id stay.

    Rows are judged, not ids: two texts under one id are two documents. Of equal rows the one that stands first
    in the written table stays.
    """
    # a row's key is fixed by writing it down
    keyed = stage(docs.select(F.monotonically_increasing_id().alias("key"), packed_row(docs)), "near-rows")
    named = keyed.where("row.doc_id is not null").select("key", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    judged = minhash.near_duplicates(named, id_col="key", percent=80).select(F.col("id").alias("key"), "component_id")
    judged = judged.join(named.select("key", "doc_id"), "key")
    best = judged.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("best"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("component_id", F.col("best.key").alias("stays"))
    away = stage(judged.join(best, "component_id").where("key <> stays").select("key"), "near-away", spark.sparkContext.defaultParallelism)
    away = F.broadcast(away) if away.count() * 32 <= BROADCAST_BYTES else away
    return keyed.join(away, "key", "left_anti").select(*_own(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have shares after the square root of their size, in random order."""
    return mixing.poisson_mix(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Which piece of which document goes to which bin."""
    return packing.pack(docs).drop("row_key")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("source_mix", mix_sources), ("packing", pack_bins)]

#: The scorer and the packing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
