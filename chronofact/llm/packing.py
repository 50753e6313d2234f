"""Conflict-constrained best-fit packing.

Pieces of documents are packed into bins of a fixed capacity. A bin carries a bitmap of the sources and one of
the duplicate clusters in it, and takes neither a source nor a cluster twice. Pieces come in order of falling
length; each goes into the tightest bin that has room and no conflict: bins are kept ordered by residual, and
the search goes on from the smallest residual that fits to its successors until a compatible bin is found.

A document longer than the capacity is cut into full bins of its own and a last piece; nothing is truncated.
Bins are filled within blocks of about ``block`` documents, to which a hash of the id deals the rows. A block
that got far more, because an id is repeated, is dealt again by the rows' places in the written table. So a
block fits in one task and any number of them run at once, whatever share one source, cluster or id has.

Bins are grouped by source bitmap (one ordered list each), so bins of a conflicting source are skipped as a
whole; a run of equal pieces of one cluster resumes its search where the last one ended, so many copies cost
one walk over the bins, not one each.

Length is the text's number of characters; null and empty texts have length 0 and take a place in a bin like
others. A null source is a source of its own, a null id is dealt by its text. Repeated rows are copies of one
cluster and go to different bins. Ids are 64-bit and come back as they are. An empty table gives no bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.llm.common import stage


def best_fit(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each piece; pieces longer than capacity aren't allowed. Ties in residual go to the older bin."""
    order = np.lexsort((np.arange(len(lengths)), clusters, sources, -lengths))
    place = np.full(len(lengths), -1)
    residual: list[int] = []
    holds: list[int] = []  # cluster bitmap of each bin
    ordered: dict[int, list[tuple[int, int]]] = {}  # source bitmap: (residual, bin), ordered
    last, resume = None, {}
    for i in order:
        size, source, cluster = int(lengths[i]), 1 << int(sources[i]), 1 << int(clusters[i])
        if (size, source, cluster) != last:
            last, resume = (size, source, cluster), {}
        best = None
        for bits, bins in ordered.items():
            if bits & source or not bins:
                continue
            # bins before this place were found in conflict with the same kind of piece already
            at = bisect_left(bins, resume.get(bits, (size, -1)))
            while at < len(bins) and (best is None or bins[at] < best[0]):
                if not holds[bins[at][1]] & cluster:
                    best = (bins[at], bits)
                    break
                at += 1
            if at < len(bins):
                resume[bits] = bins[at]
            else:
                resume[bits] = (capacity + 1, -1)
        if best is None:
            b = len(residual)
            residual.append(capacity - size)
            holds.append(cluster)
            bits = source
        else:
            (room, b), bits = best
            ordered[bits].pop(bisect_left(ordered[bits], (room, b)))
            residual[b] = room - size
            holds[b] |= cluster
            bits |= source
        insort(ordered.setdefault(bits, []), (residual[b], b))
        place[i] = b
    return place


def pack(docs: DataFrame, *, capacity: int = 8192, block: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None) -> DataFrame:
    """(bin_id, slot, doc_id, row_key, piece, start, length, source, cluster): where each piece of each document goes.

    bin_id is unique over all blocks; slot counts the bin's pieces from 0. cluster: any column that is equal
    for rows that must not share a bin; by default a hash of the lower-cased words of the text.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    if cluster is None:
        cluster = F.xxhash64(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "))
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("t"), F.xxhash64(text).cast("string")))
    sized = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(ident).alias("row_key"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("\x00")).alias("source"),
        F.coalesce(cluster, F.lit(0)).cast("long").alias("cluster"), F.char_length(text).cast("long").alias("total"),
    )
    sized = stage(sized.withColumn("at", F.monotonically_increasing_id()), "packing-rows")
    blocks = max(1, -(-sized.count() // block))
    dealt = sized.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "row_key"), F.lit(blocks)))
    # blocks are as many as rows / block: few numbers, and the large ones among them are fewer than half of that
    large = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * block).select("block", F.ceil(F.col("n") / block).cast("long").alias("parts"))
    dealt = dealt.join(large, "block", "left").withColumn("part", F.pmod(F.xxhash64(F.lit(4), "at"), F.coalesce("parts", F.lit(1).cast("long")))).drop("parts", "at")
    schema = "bin_id string, slot int, doc_id long, row_key long, piece int, start long, length long, source string, cluster long"

    def one(table):
        import pyarrow as pa

        table = table.sort_by([(c, "ascending") for c in ("row_key", "total", "source", "cluster", "doc_id")]).combine_chunks()
        total = table["total"].to_numpy()
        full = np.where(total > capacity, (total - 1) // capacity, 0)
        rows = np.repeat(np.arange(len(total)), full + 1)
        piece = np.arange(len(rows)) - np.repeat(np.cumsum(full + 1) - full - 1, full + 1)
        start = piece * capacity
        length = np.minimum(total[rows] - start, capacity)
        whole = piece < full[rows]
        rest = np.flatnonzero(~whole)
        sources = table["source"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)[rows[rest]]
        _, clusters = np.unique(table["cluster"].to_numpy()[rows[rest]], return_inverse=True)
        bins = np.empty(len(rows), np.int64)
        bins[rest] = best_fit(length[rest], sources, clusters, capacity)
        bins[whole] = bins[rest].max(initial=-1) + 1 + np.arange(whole.sum())
        order = np.argsort(bins, kind="stable")
        first = np.searchsorted(bins[order], bins[order])
        slot = np.empty(len(rows), np.int64)
        slot[order] = np.arange(len(rows)) - first
        name = f"{table['block'][0].as_py()}.{table['part'][0].as_py()}"
        # Arrow keeps ids as they are, null or beyond 2^53
        own = table.select(["doc_id", "row_key", "source", "cluster"]).take(pa.array(rows))
        made = {"bin_id": pa.array([f"{name}-{b}" for b in bins], pa.string()), "slot": pa.array(slot.astype(np.int32)), "doc_id": own["doc_id"], "row_key": own["row_key"], "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "source": own["source"], "cluster": own["cluster"]}
        return pa.table(made)

    return dealt.groupBy("block", "part").applyInArrow(one, schema)
