"""Line deduplication: a line stays in the first document that holds it.

Lines become 128-bit hashes of their key, range-partitioned by (hash, document, position) and sorted
within the partition; one streaming pass finds each run's first document. Document and position are
part of the range key, so a line that a third of all documents hold spreads over many partitions: only
the run that a partition begins with can reach back, and it is settled against the first documents of
the at most two boundary runs of each partition.

A document is a (doc_id, text) pair; repeated rows get the same answer. Rows with a null id neither
drop lines nor cause drops. A null or empty text is one empty line; a document that loses nothing keeps
its text as it is, null included. Texts leave this module only in ``apply_bitmaps``, whose input may have
columns of any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofact.llm.common import BLANKS, arrow_batches, ascii_lower, discard, packed_row, stage


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _first_occurrences(batches: Iterator) -> Iterator:
    """kind 0: a line to drop; 1: a line of the partition's first run, not settled; 2: a boundary run's first document."""
    import pyarrow as pa

    schema = pa.schema([(n, pa.int64()) for n in ("h1", "h2", "doc", "th")] + [("pos", pa.int32()), ("kind", pa.int32())])
    opening = run = None  # key of the partition's first run; (key, first document) of the current one
    for batch in batches:
        h1, h2, doc, th, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        if not len(h1):
            continue
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0))
        first = doc[begin]
        if run is not None and (h1[0], h2[0]) == run[0]:
            first[begin == 0] = run[1]
        if opening is None:
            opening = (h1[0], h2[0])
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (h1[0], h2[0], doc[0])] + [pa.array([0]), pa.array([0], pa.int32()), pa.array([2], pa.int32())], schema=schema)
        unsettled = (h1 == opening[0]) & (h2 == opening[1])
        out = np.flatnonzero(unsettled | (doc > first))
        kind = unsettled[out].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(v[out]) for v in (h1, h2, doc, th)] + [pa.array(pos[out].astype(np.int32)), pa.array(kind)], schema=schema)
        run = ((h1[-1], h2[-1]), first[-1])
    if run is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*run[0], run[1])] + [pa.array([0]), pa.array([0], pa.int32()), pa.array([2], pa.int32())], schema=schema)


def _pack(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        n = batch.column(2).to_numpy()
        keep, dropped = [], []
        for i, drop in enumerate(batch.column(3)):
            bits = np.ones(int(n[i]), np.uint8)
            bits[drop.values.to_numpy()] = 0
            keep.append(zlib.compress(np.packbits(bits).tobytes(), 6))
            dropped.append(int(n[i] - bits.sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(keep, pa.binary())], ["doc_id", "text_hash", "n_lines", "n_dropped", "keep"])


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def losses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = 10) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, keep) for each (id, text) that loses lines: keep is zlib over packed bits, one a line.

    A document that isn't there keeps all its lines. The table is written: it can be read again and again.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc is not null")
    rows = docs.select("doc", _text_hash(F.col("text")).alias("th"), _lines(F.col("text")).alias("lines"))
    rows = rows.select("doc", "th", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    key = F.btrim(ascii_lower(F.col("line")), F.lit(BLANKS))
    rows = rows.select("doc", "th", "n", "pos", key.alias("key")).where(F.char_length("key") >= min_length)
    # written once: the range bounds are sampled from it, not from the texts
    rows = stage(rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "th", "pos", "n"), "line-keys")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.drop("n").repartitionByRange(parts, "h1", "h2", "doc", "pos").sortWithinPartitions("h1", "h2", "doc", "pos")
    with arrow_batches(spark, 20_000):
        seen = stage(dealt.mapInArrow(_first_occurrences, "h1 long, h2 long, doc long, th long, pos int, kind int"), "lines")

    # at most two boundary rows a partition: its size is bounded by the number of partitions
    bounds = F.broadcast(seen.where("kind = 2").groupBy("h1", "h2").agg(F.min("doc").alias("first")))
    late = seen.where("kind = 1").join(bounds, ["h1", "h2"]).where("doc > first")
    drops = seen.where("kind = 0").select("doc", "th", "pos").unionByName(late.select("doc", "th", "pos"))
    drops = drops.groupBy("doc", "th").agg(F.collect_set("pos").alias("drop"))
    sizes = rows.groupBy("doc", "th").agg(F.first("n").cast("long").alias("n"))
    out = sizes.join(drops, ["doc", "th"]).select("doc", "th", "n", "drop").mapInArrow(_pack, "doc_id long, text_hash long, n_lines long, n_dropped long, keep binary")
    out = stage(out, "line-bitmaps", max(spark.sparkContext.defaultParallelism, parts // 8))
    discard(rows, seen)
    return out


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = 10) -> DataFrame:
    """The rows of ``losses`` and one for each other (id, text): nothing dropped, keep null."""
    few = losses(docs, id_col, text_col, min_length=min_length)
    all_ = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _text_hash(F.col(f"`{text_col}`")).alias("text_hash"), F.size(_lines(F.col(f"`{text_col}`").cast("string"))).cast("long").alias("lines")).distinct()
    return all_.join(few, ["doc_id", "text_hash"], "left").select("doc_id", "text_hash", F.col("lines").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "keep")


@F.pandas_udf(T.StringType())  # a type object: importing needs no session
def _cut(text, keep):
    import pandas as pd

    def one(t, k):
        if k is None:
            return None
        lines = t.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8))[: len(lines)]
        return "\n".join(x for x, b in zip(lines, bits) if b)

    return pd.Series([one(t, k) for t, k in zip(text, keep)], dtype=object)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "kept_text", counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with out_col, the text without the lines that its bitmap drops; only texts that lose lines go to Python.

    counts names two more columns: lines before and lines dropped. Columns of docs that have one of the new
    names are replaced, all others stay as they are.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), _text_hash(F.col(f"`{text_col}`")).alias("th"), F.col(f"`{text_col}`").cast("string").alias("text"), packed_row(docs))
    marks = bitmaps.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("th"), "n_lines", "n_dropped", "keep")
    joined = rows.join(marks, ["id", "th"], "left")
    joined = joined.withColumn("cut", _cut(F.when(F.col("keep").isNotNull(), F.col("text")), F.col("keep")))
    new = {out_col: F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.col("cut"))}
    if counts:
        new[counts[0]] = F.coalesce("n_lines", F.size(_lines(F.col("text"))).cast("long"))
        new[counts[1]] = F.coalesce("n_dropped", F.lit(0).cast("long"))
    return joined.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in new), *(v.alias(k) for k, v in new.items()))
