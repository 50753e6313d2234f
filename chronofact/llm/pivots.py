"""Embedding near-duplicates by a pivot-permutation index.

Reference points are taken from a bounded, hash-ordered sample, each as far from the earlier ones as possible,
so a narrow cone of vectors gets as many as a sphere of them. A vector is described by its nearest ones in
order and posted under every two of them: a posting list holds the vectors that share at least two pivots.
How many pivots there are and how many describe a vector is measured, not guessed: copies of sampled vectors
turned by exactly the angle of the threshold must meet their originals in at least ``RECALL`` of all cases.

Within a list (long ones cut into blocks, blocks meeting in pairs) cosines are computed by matrix products; a
pair counts in the list of its two smallest shared pivots only, so once. Lists hand on link counts and a
spanning forest, never pairs. Ids are posted and counted first; a vector travels to the lists that hold
another one only, in the type that its table has.

Equal vectors with an equal label are one class that is indexed once; 128 bits of hash tell classes. Vectors
that are null, zero or hold null, NaN or infinite components, and rows with a null label or id link with
nothing. A vector is divided by its largest component first, so tiny and huge finite ones link like others.
Repeated rows of an id count as one vector. Vectors of different length don't link. An empty table has an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.llm.common import components, discard, stage, unbroadcast, whole_groups
from chronofact.llm.topk import _rows

#: Most reference points, whatever the number of vectors, and most of them that describe one vector.
MOST_PIVOTS, MOST_NEAREST = 1024, 8
#: Share of sampled pairs at the threshold that the index must bring together.
RECALL = 0.995


def choose_pivots(x: np.ndarray, many: int) -> np.ndarray:
    """Up to many distinct rows of x (unit vectors): the first, then always the one farthest from those taken."""
    taken, near = [], np.full(len(x), -np.inf)
    at = 0
    while len(taken) < min(many, len(x)):
        taken.append(at)
        near = np.maximum(near, x @ x[at])
        at = int(np.argmin(near))
        if near[at] > 1 - 1e-12:
            break
    return x[taken]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :nearest]


def calibrated(x: np.ndarray, pivots: np.ndarray, least: float, nearest: int, seed: int = 5) -> tuple[np.ndarray, int]:
    """The pivots to use and how many describe a vector, so that turned copies of x's rows share two of them."""
    turn = np.random.default_rng(seed).standard_normal(x.shape)
    turn -= (turn * x).sum(1)[:, None] * x
    size = np.sqrt((turn * turn).sum(1))
    c = min(1.0, max(-1.0, least))
    y = x if x.shape[1] < 2 else c * x + np.sqrt(1 - c * c) * turn / np.where(size > 0, size, 1)[:, None]
    while len(pivots) > 2:
        for k in range(min(nearest, len(pivots)), MOST_NEAREST + 1):
            a, b = nearest_pivots(x, pivots, k), nearest_pivots(y, pivots, k)
            shared = (a[:, :, None] == b[:, None, :]).sum((1, 2))
            if (shared >= 2).mean() >= RECALL:
                return pivots, k
        pivots = pivots[: max(2, len(pivots) // 2)]
    return pivots, 2


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _unit(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    return unit_rows(flat.reshape(len(at) - 1, -1))


def _describe(index: dict[int, tuple[np.ndarray, int]]):
    """index: pivots and number of nearest ones for each length of vectors."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            flat, at = _rows(batch.column(1))
            sizes = np.diff(at)
            perms = [None] * len(sizes)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = unit_rows(flat[at[rows][:, None] + np.arange(size)])
                for r, o in zip(rows, nearest_pivots(x, *index[int(size)])):
                    perms[r] = o.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(perms, pa.list_(pa.int32()))], ["rep", "perm"])

    return run


def _forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each row to the root of its component of a symmetric boolean matrix."""
    out, free = [], hit.any(1)
    while free.any():
        root = int(np.argmax(free))
        seen = np.zeros(len(hit), bool)
        seen[root] = True
        edge = seen.copy()
        while edge.any():
            edge = hit[edge].any(0) & ~seen
            seen |= edge
        free &= ~seen
        out += [(i, root) for i in np.flatnonzero(seen) if i != root]
    return out


def _link(least: float):
    """kind 0: a row's number of linked vectors found here; kind 1: an edge."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for table, cuts in whole_groups(batches, 5):
            part_i, part_j, lo_pivot, hi_pivot, _, side, rep, weight = (c.to_numpy() for c in table.columns[:8])
            flat, at = _rows(table.column(8))
            perm, perm_at = _rows(table.column(9))
            out: list[tuple[int, int, int]] = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo < 2:
                    continue
                x = _unit(flat[at[lo] : at[hi]], at[lo : hi + 1])
                # pivots that would make an earlier pair of shared ones than this list's
                mine = perm[perm_at[lo] : perm_at[hi]]
                owner = np.repeat(np.arange(hi - lo), np.diff(perm_at[lo : hi + 1]))
                early = (mine < hi_pivot[lo]) & (mine != lo_pivot[lo])
                names, col = np.unique(mine[early], return_inverse=True)
                has = np.zeros((hi - lo, len(names)), np.float32)
                has[owner[early], col] = 1
                if part_i[lo] == part_j[lo]:
                    left = right = np.arange(hi - lo)
                else:
                    left, right = np.flatnonzero(side[lo:hi] == 0), np.flatnonzero(side[lo:hi] == 1)
                hit = (x[left] @ x[right].T) >= least
                if part_i[lo] == part_j[lo]:
                    np.fill_diagonal(hit, False)
                if not hit.any():
                    continue
                square = np.zeros((hi - lo, hi - lo), bool)
                square[np.ix_(left, right)] = hit
                square |= square.T
                out += [(1, rep[lo + a], rep[lo + b]) for a, b in _forest(square)]
                once = hit & ((has[left] @ has[right].T) == 0) if len(names) else hit
                counts = np.zeros(hi - lo, np.int64)
                counts[left] += once @ weight[lo + right]
                if part_i[lo] != part_j[lo]:
                    counts[right] += once.T @ weight[lo + left]
                out += [(0, rep[lo + a], counts[a]) for a in np.flatnonzero(counts)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], ["kind", "a", "b"])

    return run


def smallest_hashes(classes: DataFrame, total: int, most: int) -> DataFrame:
    """The rows of the ``most`` smallest hashes of rep among total ones.

    Each task of a top-k hands the driver up to ``most`` whole rows, whatever the number of tasks. So only rows
    below a hash that about twice as many ids lie under are looked at, unless those happen to be too few.
    """
    few = classes
    if total > 4 * most:
        few = classes.where(F.xxhash64("rep") < F.lit(int(-(2**63) + 2 * most / total * 2.0**64)))
        few = few if few.count() >= most else classes
    return few.orderBy(F.xxhash64("rep"), "rep").limit(most)


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, nearest: int = 5, block: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors: links of cosine >= least among equal labels.

    nearest: how many pivots describe a vector at least.
    """
    spark = vectors.sparkSession
    cores = spark.sparkContext.defaultParallelism
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast(kind).alias("v"))
    sound = "vec_id is not null and label is not null and size(v) > 0 and not exists(v, c -> c is null or isnan(c) or abs(c) = double('infinity')) and exists(v, c -> c <> 0)"
    hashed = rows.select("vec_id", "label", "v", F.coalesce(F.expr(sound), F.lit(False)).alias("ok"), F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(1), "label", "v").alias("h2"))
    named = stage(hashed.select("vec_id", "ok", *(F.when(F.col("ok"), F.col(h)).alias(h) for h in ("h1", "h2"))), "pivot-names")
    members = named.where("ok").select("h1", "h2", "vec_id").distinct().groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    each = hashed.where("ok").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("v").alias("v"))
    n_rows = named.count()
    classes = stage(unbroadcast(members, n_rows).join(each, ["h1", "h2"]).select("h1", "h2", F.xxhash64("label", F.size("v")).alias("label"), "rep", "weight", "v"), "pivot-classes", 4 * cores)

    total = classes.count()
    many = min(MOST_PIVOTS, max(16, isqrt(total)))
    # a bounded sample for the pivots; a length that it doesn't hold gets a few of its own vectors
    sample = [np.array(r[0], np.float64) for r in smallest_hashes(classes, total, 2 * many).select("v").collect()]
    index: dict[int, tuple[np.ndarray, int]] = {}
    for size in [r[0] for r in classes.select(F.size("v")).distinct().collect()] if total else []:
        own = [v for v in sample if len(v) == size] or [np.array(r[0], np.float64) for r in classes.where(F.size("v") == size).orderBy("rep").limit(16).select("v").collect()]
        x = unit_rows(np.stack(own))
        index[size] = calibrated(x, choose_pivots(x, many), least, nearest)
    described = stage(classes.select("rep", "v").mapInArrow(_describe(index), "rep long, perm array<int>"), "pivot-index", 4 * cores)

    pairs = F.expr("flatten(transform(array_sort(perm), p -> transform(filter(perm, q -> q > p), q -> struct(p as lo, q as hi))))")
    posts = described.withColumn("pair", F.explode(F.when(F.size("perm") > 1, pairs).otherwise(F.expr("array(struct(perm[0] as lo, perm[0] as hi))"))))
    posts = posts.join(unbroadcast(classes.select("rep", "label"), total), "rep").select("label", F.col("pair.lo").cast("long").alias("lo"), F.col("pair.hi").cast("long").alias("hi"), "rep")
    lists = stage(posts.groupBy("label", "lo", "hi").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / block).cast("long")).drop("n"), "pivot-lists", 4 * cores)
    # a vector is in at most MOST_NEAREST * (MOST_NEAREST - 1) / 2 lists
    met = posts.join(unbroadcast(lists, lists.count()), ["label", "lo", "hi"]).groupBy("rep").agg(F.collect_list(F.struct("lo", "hi", "parts")).alias("lists"))
    meets = F.expr("transform(sequence(0L, parts - 1), o -> struct(least(o, part) as i, greatest(o, part) as j, int(part > o) as side))")
    full = met.join(unbroadcast(classes.select("rep", "label", "weight", "v"), total), "rep").join(unbroadcast(described, total), "rep")
    full = full.select("label", "rep", "weight", "v", "perm", F.explode("lists").alias("l")).select("label", "rep", "weight", "v", "perm", "l.*").withColumn("part", F.pmod(F.xxhash64("rep"), "parts")).withColumn("m", F.explode(meets))
    key = ["i", "j", "lo", "hi", "label"]
    full = full.select(F.col("m.i").alias("i"), F.col("m.j").alias("j"), "lo", "hi", "label", F.col("m.side").cast("long").alias("side"), "rep", "weight", "v", "perm")
    found = stage(full.repartition(*key).sortWithinPartitions(*key, "side", "rep").mapInArrow(_link(least), "kind long, a long, b long"), "pivot-links", 4 * cores)

    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("linked"))
    roots = components(found.where("kind = 1").select("a", "b"), "pivots").toDF("rep", "root")
    table = classes.select("h1", "h2", "rep", "weight").join(unbroadcast(counts, total), "rep", "left").join(unbroadcast(roots, total), "rep", "left")
    table = stage(table.select("h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")), "pivot-table", 4 * cores)
    discard(classes, described, lists, found)
    out = named.join(unbroadcast(table, total), ["h1", "h2"], "left")  # a row that isn't sound has null hashes
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
