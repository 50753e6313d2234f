"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into segments; per segment its mean and deviation are kept. For segments of length L the
squared distance of q and x is at least the sum of L * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2), which is
|q|^2 + |x|^2 - 2 * bound with bound = sum of L * (mean_q * mean_x + dev_q * dev_x) plus what the coarser
statistics can't tell; so q.x is at most that bound.

A bounded sample gives each query a score that its k-th best can't be below. Candidates are dealt by the
sampled row whose statistics are nearest into blocks of bounded size; a block's envelope, the least and the
most of each statistic, bounds every score in it, and a query goes only to blocks whose envelope reaches its
score. In the block, coarse and then fine bounds leave few rows whose products are computed. Ties with the
k-th score survive, so the result is exact whatever the sample. Nothing but the sample (``SAMPLE_ROWS`` rows and
``SAMPLE_BYTES`` at most) is on the driver, and no task gets more than a block, or ``ENVELOPES`` of them.

Vectors that are null or hold null, NaN or infinite components take no part; empty ones neither. Only
vectors of equal length are compared. A repeated candidate id counts once a row. Scores are 64-bit integers;
components whose products could exceed them are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofact.llm.common import discard, stage

#: Bounds of the sample.
SAMPLE_ROWS, SAMPLE_BYTES = 4096, 16 << 20
#: Most of the sampled rows that candidates are dealt by.
MOST_CELLS = 512
#: Block envelopes that one task holds.
ENVELOPES = 16_384


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(L) * (mean, deviation) of each segment: a dot product of two rows bounds the vectors' own."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = x[:, a:b]
        out += [np.sqrt(b - a) * part.mean(1), np.sqrt(b - a) * part.std(1)]
    return np.stack(out, 1)


class _Block:
    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: tuple[int, ...]):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.wide = self.x.astype(np.float64)
        self.levels = [(s, segment_features(self.wide, s)) for s in levels]
        # what rounding may take from a bound
        self.norms = np.sqrt((self.wide**2).sum(1))

    def best(self, qid: int, q: np.ndarray, k: int, features: list[np.ndarray], floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows of the block with a score of at least floor."""
        wide = q.astype(np.float64)
        slack = 1e-9 * (np.sqrt((wide**2).sum()) * self.norms + 1)
        bound = self.levels[0][1] @ features[0] + slack
        bound[self.ids == qid] = -np.inf
        first = np.argpartition(-bound, min(4 * k, len(bound) - 1))[: 4 * k]
        scores = self.x[first] @ q
        scores = scores[np.isfinite(bound[first])]
        least = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k])) if len(scores) >= k else floor
        alive = np.flatnonzero((bound >= least) & np.isfinite(bound))
        for (_, finer), f in zip(self.levels[1:], features[1:]):
            alive = alive[finer[alive] @ f + slack[alive] >= least]
        scores = self.x[alive] @ q
        alive, scores = alive[scores >= floor], scores[scores >= floor]
        top = np.lexsort((self.ids[alive], -scores))[:k]
        return self.ids[alive][top], scores[top]


def _rows(column) -> tuple[np.ndarray, np.ndarray]:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    at = flat.offsets.to_numpy()
    return flat.values.to_numpy(zero_copy_only=False)[: at[-1]], at


def _search(k: int, levels: tuple[int, ...]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block, parts, built = None, [], {}
        for batch in batches:
            blk, kind, ids = (batch.column(i).to_numpy() for i in range(3))
            flat, at = _rows(batch.column(3))
            floor = batch.column(4).to_numpy()
            out: list[tuple] = []
            new = np.ones(len(blk), bool)
            new[1:] = (blk[1:] != blk[:-1]) | (kind[1:] != kind[:-1])
            starts = np.flatnonzero(new)
            for lo, hi in zip(starts, [*starts[1:], len(blk)]):
                if blk[lo] != block:
                    block, parts, built = blk[lo], [], {}
                sizes = np.diff(at[lo : hi + 1])
                for size in np.unique(sizes):
                    rows = lo + np.flatnonzero(sizes == size)
                    x = flat[at[rows][:, None] + np.arange(size)]
                    if kind[lo] == 0:
                        parts.append((size, ids[rows], x))
                        continue
                    if size not in built:
                        own = [p for p in parts if p[0] == size]
                        built[size] = _Block(np.concatenate([p[1] for p in own]), np.concatenate([p[2] for p in own]), levels) if own else None
                    if built[size] is None:
                        continue
                    features = [segment_features(x.astype(np.float64), s) for s in levels]
                    for i, r in enumerate(rows):
                        found, scores = built[size].best(ids[r], x[i], k, [f[i] for f in features], int(floor[r]))
                        out += [(ids[r], v, s) for v, s in zip(found, scores)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    return run


#: A floor that every score reaches.
NONE = -(1 << 63)


def _floors(sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """(id, v, floor): the k-th best score of each query among the sampled rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy()
            flat, at = _rows(batch.column(1))
            floor = np.full(len(ids), NONE)
            for size in np.unique(np.diff(at)):
                if int(size) not in sample:
                    continue
                rows = np.flatnonzero(np.diff(at) == size)
                known, x = sample[int(size)]
                for lo in range(0, len(rows), 256):
                    part = rows[lo : lo + 256]
                    scores = flat[at[part][:, None] + np.arange(size)] @ x.T
                    own = known[None, :] == ids[part][:, None]
                    scores[own] = NONE
                    if scores.shape[1] >= k:
                        floor[part] = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], ["id", "v", "floor"])

    return run


def _cells(centres: dict[int, np.ndarray], segments: int):
    """(id, v, cell): the centre of equal length whose segment statistics are nearest."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            flat, at = _rows(batch.column(1))
            cell = np.zeros(batch.num_rows, np.int64)
            for size in np.unique(np.diff(at)):
                if int(size) not in centres:
                    continue
                rows, c = np.flatnonzero(np.diff(at) == size), centres[int(size)]
                f = segment_features(flat[at[rows][:, None] + np.arange(size)].astype(np.float64), segments)
                cell[rows] = np.argmin((c * c).sum(1)[None, :] - 2 * f @ c.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["id", "v", "cell"])

    return run


def _envelopes(segments: int):
    """(blk, dims, i, lo, hi) of the rows of a batch: least and most of statistic i."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            blk = batch.column(0).to_numpy()
            flat, at = _rows(batch.column(1))
            out = [[], [], [], [], []]
            for size in np.unique(np.diff(at)):
                rows = np.flatnonzero(np.diff(at) == size)
                rows = rows[np.argsort(blk[rows], kind="stable")]
                f = segment_features(flat[at[rows][:, None] + np.arange(size)].astype(np.float64), segments)
                first = np.flatnonzero(np.append(True, blk[rows][1:] != blk[rows][:-1]))
                lo, hi = np.minimum.reduceat(f, first), np.maximum.reduceat(f, first)
                for column, v in zip(out, (np.repeat(blk[rows][first], f.shape[1]), np.full(lo.size, size), np.tile(np.arange(f.shape[1]), len(first)), lo.ravel(), hi.ravel())):
                    column.append(v)
            kinds = (np.int64, np.int64, np.int64, np.float64, np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c or [[]]).astype(k)) for c, k in zip(out, kinds)], ["blk", "dims", "i", "lo", "hi"])

    return run


def _routes(segments: int):
    """Envelopes (kind 0) and then queries (kind 1) of a group: (blk, id, v, floor) for each block that a query may find something in."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        group, held, boxes = None, [], None
        for batch in batches:
            grp, salt, kind, ids, floors = (batch.column(i).to_numpy() for i in (0, 1, 2, 3, 5))
            v, lo, hi = (_rows(batch.column(i)) for i in (4, 6, 7))
            out_blk, out_row = [], []
            for r in range(batch.num_rows):
                if (grp[r], salt[r]) != group:
                    group, held, boxes = (grp[r], salt[r]), [], None
                if kind[r] == 0:
                    held.append((int(ids[r]), int(floors[r]), lo[0][lo[1][r] : lo[1][r + 1]], hi[0][hi[1][r] : hi[1][r + 1]]))
                    continue
                if boxes is None:
                    boxes = {}
                    for size in {h[1] for h in held}:
                        own = [h for h in held if h[1] == size]
                        boxes[size] = (np.array([h[0] for h in own]), np.stack([h[2] for h in own]), np.stack([h[3] for h in own]))
                q = v[0][v[1][r] : v[1][r + 1]].astype(np.float64)
                if len(q) not in boxes:
                    continue
                blocks, least, most = boxes[len(q)]
                f = segment_features(q[None, :], segments)[0]
                bound = np.where(f >= 0, most, least) @ f
                slack = 1e-9 * (np.sqrt((q * q).sum()) * np.sqrt(np.maximum(least**2, most**2).sum(1)) + 1)
                reached = blocks[bound + slack >= floors[r]]
                out_blk.append(reached)
                out_row.append(np.full(len(reached), r))
            if out_blk:
                rows = pa.array(np.concatenate(out_row))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_blk)), batch.column(3).take(rows), batch.column(4).take(rows), batch.column(5).take(rows)], ["blk", "id", "v", "floor"])

    return run


def exact_top_k(base: DataFrame, queries: DataFrame, k: int = 5, *, levels: tuple[int, ...] = (4, 16), block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) over base(id, v) and queries(id, v), v an array of 64-bit integers.

    A query's own id is no candidate. Ranks are by score, ties by smaller vec_id.
    """
    spark = base.sparkSession
    cores, fine = spark.sparkContext.defaultParallelism, levels[-1]
    sound = "id is not null and size(v) > 0 and not exists(v, c -> c is null)"
    base, queries = (stage(d.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<bigint>").alias("v")).where(sound), "topk-rows", 4 * cores) for d in (base, queries.distinct()))
    most = F.max(F.size("v") * F.pow(F.greatest(F.array_max("v").cast("double"), -F.array_min("v").cast("double")), F.lit(2)))
    n, dims, largest = base.agg(F.count(F.lit(1)), F.max(F.size("v")), most).first()
    if (largest or 0) >= 2.0**63 or (queries.agg(most).first()[0] or 0) >= 2.0**63:
        raise ValueError("components are too large for 64-bit scores")
    sample = base.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * (dims or 1))))).collect()
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r["v"]), []).append(r)
    known = {s: (np.array([r["id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.int64)) for s, rows in by_size.items()}
    asked = queries.mapInArrow(_floors(known, k), "id long, v array<bigint>, floor long")

    blocks = max(1, -(-n // block))
    centres = {s: segment_features(x[: min(MOST_CELLS, blocks)].astype(np.float64), fine) for s, (_, x) in known.items()} if blocks > 1 else {}
    dealt = stage(base.mapInArrow(_cells(centres, fine), "id long, v array<bigint>, cell long"), "topk-cells", 4 * cores)
    cells = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).collect()  # MOST_CELLS rows at most
    parts, begin, blocks = {}, {}, 0
    for r in sorted(cells, key=lambda r: r["cell"]):
        begin[r["cell"]], parts[r["cell"]] = blocks, max(1, -(-r["rows"] // block))
        blocks += parts[r["cell"]]
    of = lambda table: F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col("cell")) if table else F.lit(1)
    blocked = dealt.select((of(begin) + F.pmod(F.xxhash64("id"), of(parts))).cast("long").alias("blk"), "id", "v")

    boxes = blocked.select("blk", "v").mapInArrow(_envelopes(fine), "blk long, dims long, i long, lo double, hi double").groupBy("blk", "dims", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    sides = [F.array_sort(F.collect_list(F.struct("i", c))).getField(c).alias(c) for c in ("lo", "hi")]  # the field of each element
    boxes = boxes.groupBy("blk", "dims").agg(*sides)
    salts = max(1, 2 * cores)
    nothing = F.array().cast("array<double>")
    held = boxes.select(F.expr(f"blk div {ENVELOPES}").alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).cast("long").alias("kind"), F.col("blk").alias("id"), F.array().cast("array<bigint>").alias("v"), F.col("dims").alias("floor"), "lo", "hi")
    groups = F.sequence(F.lit(0).cast("long"), F.lit(max(0, blocks - 1) // ENVELOPES).cast("long"))
    coming = asked.select(F.explode(groups).alias("grp"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).cast("long").alias("kind"), "id", "v", "floor", nothing.alias("lo"), nothing.alias("hi"))
    met = held.unionByName(coming).repartition(salts, "grp", "salt").sortWithinPartitions("grp", "salt", "kind")
    routed = stage(met.mapInArrow(_routes(fine), "blk long, id long, v array<bigint>, floor long"), "topk-routes", 4 * cores)

    rows = blocked.select("blk", F.lit(0).cast("long").alias("kind"), "id", "v", F.lit(0).cast("long").alias("floor"))
    both = rows.unionByName(routed.select("blk", F.lit(1).cast("long").alias("kind"), "id", "v", "floor"))
    met = both.repartition(max(2, blocks), "blk").sortWithinPartitions("blk", "kind")
    found = stage(met.mapInArrow(_search(k, tuple(levels)), "query_id long, vec_id long, score long"), "topk-found", 4 * cores)
    discard(base, queries, dealt, routed)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
