"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Each text's distinct word shingles become one class key (equal sets, equal class) and a signature
   of ``coords`` minima. Copies are folded into their class at once.
2. Every class is posted under each (coordinate, value) pair. Two sets with similarity s agree in a
   coordinate with probability s; only pairs that agree in at least ``min_matches`` count. So a class
   with fewer shared pairs than that has no partner, and any pair that counts also meets on the
   ``coords - min_matches + 1`` rarest postings of either (prefix): the long posting lists are never
   merged, only skipped and counted by comparing sketches.
3. Posting lists are cut into chunks of at most ``chunk`` rows. A chunk hands on its best spanning
   forest of agreeing pairs that aren't connected yet (at most one pair a row, never all pairs); these
   are confirmed on the full sets, components grow, and chunks are dealt anew. Last, the rows outside
   a list's largest component meet all rows of other components, so no link between components is
   missed, and pairs within a component need no look. A pair that several lists bring together is
   handed on by the first of them only.

Sets are compared by the shingles' 64-bit hashes, equal sets told by 128 bits.

``search="shingles"`` is the exact way for who can't accept that a pair at the threshold is missed with a
probability of about 1e-6: postings are then the rarest shingles of each set, of which two sets at the
threshold must share one, and no sketch rules a pair out.

Tokens that many classes share are joined by a broadcast of the few that are so frequent, all others by a
shuffle, and their lists are dealt in chunks: no task gets a token's whole list. Small tables, told by a count
of the written rows (``BROADCAST_BYTES``), are broadcast, so that postings travel once a round, to their chunk.

Rows with a null id take no part in linking. A repeated id counts once, with all its texts. Null and
empty texts and texts without words have an empty set and link with nothing. Order and number of
partitions don't matter; equal inputs give equal results. An empty table has an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.llm.common import arrow_batches, components, discard, mix64, released, stage, text_chunks, whole_groups
from chronofact.llm.shingles import shingle_sets

#: Ids are broadcast while they take so many bytes at most (32 each in a hash table); more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Tokens with more than this share of all postings are fewer than its inverse: a bounded broadcast.
HOT_SHARE = 10_000


def _multipliers(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        base = mix64(np.arange(1, 2 * k + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    return base[:k] | np.uint64(1), base[k:]


def _minima(values: np.ndarray, counts: np.ndarray, k: int, seed: int) -> np.ndarray:
    """One row of k minima per non-empty set."""
    full = counts > 0
    begin = (np.cumsum(counts) - counts)[full]
    if not len(begin):
        return np.zeros((0, k), np.uint64)
    a, b = _multipliers(k, seed)
    with np.errstate(over="ignore"):
        return np.stack([np.minimum.reduceat(values * a[i] + b[i], begin) for i in range(k)], 1)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, coords: int, seed: int) -> DataFrame:
    """(id, c1, c2, n, sig): the class key of the shingle set, its size, its signature (null if empty)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo, hi, raw, at in text_chunks(batch.column(1)):
                values, counts = shingle_sets(raw, at, width)
                full = counts > 0
                begin = (np.cumsum(counts) - counts)[full]
                c1, c2 = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
                if len(begin):
                    with np.errstate(over="ignore"):
                        c1[full] = np.add.reduceat(mix64(values), begin).view(np.int64)
                        c2[full] = np.bitwise_xor.reduceat(mix64(values + np.uint64(seed * 2 + 1)), begin).view(np.int64)
                sig = _minima(values, counts, coords, seed).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(full * coords)]).astype(np.int32)
                sig = pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(c1), pa.array(c2), pa.array(counts), sig], ["id", "c1", "c2", "n", "sig"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(released(run), "id long, c1 long, c2 long, n long, sig array<long>")


def _sets(docs: DataFrame, width: int, k: int, seed: int) -> DataFrame:
    """(rep, members, sketch): the sorted set as bytes and one byte of each of k further minima."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo, hi, raw, at in text_chunks(batch.column(1)):
                values, counts = shingle_sets(raw, at, width)
                ends = np.cumsum(counts)
                sketch = np.zeros((len(counts), k), np.uint8)
                sketch[counts > 0] = mix64(_minima(values, counts, k, seed + 1)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([values[e - c : e].tobytes() for e, c in zip(ends, counts)], pa.binary()), pa.array([x.tobytes() for x in sketch], pa.binary())], ["rep", "members", "sketch"])

    return docs.mapInArrow(released(run), "rep long, members binary, sketch binary")


def _groups(batches: Iterator) -> Iterator[tuple[list[np.ndarray], object, np.ndarray]]:
    """The integer columns, the sketches and the bounds of whole (token, part) groups."""
    for table, cuts in whole_groups(batches, 2):
        yield [c.to_numpy() for c in table.columns[:-1]], table.columns[-1], cuts


#: So many coordinates of a sketch are compared first, all of them only where these agree.
COARSE = 128


def _sketches(column, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, k)


def _agreeing(one: np.ndarray, others: np.ndarray, at: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Those of the rows ``at`` of others whose sketch agrees with one, coarse and then whole."""
    at = at[(others[at, :COARSE] == one[:COARSE]).sum(1) >= least[0]]
    return at[(others[at] == one).sum(1) >= least[1]]


def spanning(comp: np.ndarray, sketch: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Best spanning forest of a chunk: (i, j) of the strongest agreements of at least ``least`` that join components."""
    out: list[tuple[int, int]] = []
    _, comp = np.unique(comp, return_inverse=True)
    if comp.max(initial=0) == 0:
        return out
    best, via = np.full(len(comp), -1), np.full(len(comp), -1)
    free = np.ones(len(comp), bool)
    while free.any():
        i = int(np.argmax(np.where(free, best, -2)))
        if best[i] >= least:
            out.append((int(via[i]), i))
        for j in np.flatnonzero(comp == comp[i]):
            free[j] = False
            others = np.flatnonzero(free & (comp != comp[i]))
            agree = (sketch[others] == sketch[j]).sum(1)
            up = agree > best[others]
            best[others[up]], via[others[up]] = agree[up], j
        best[comp == comp[i]] = -2
    return out


def _forest(k: int, least: tuple[int, int]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for (_, _, rep, comp), sketch, cuts in _groups(batches):
            sketch = _sketches(sketch, k)
            sizes = np.diff(cuts)
            two = cuts[:-1][sizes == 2]
            two = two[comp[two] != comp[two + 1]]
            two = two[(sketch[two] == sketch[two + 1]).sum(1) >= least[1]]
            a, b = [rep[two]], [rep[two + 1]]
            for lo, hi in zip(cuts[:-1][sizes > 2], cuts[1:][sizes > 2]):
                if found := spanning(comp[lo:hi], sketch[lo:hi, :COARSE], least[0]):
                    found = np.array(found)
                    a.append(rep[lo + found[:, 0]])
                    b.append(rep[lo + found[:, 1]])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _cross(k: int, least: tuple[int, int], percent: int):
    """Movers of a list against the chunk's own rows of other components; a pair in its first common list only."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for table, cuts in whole_groups(batches, 2):
            token, _, rep, comp, mover, own, size = (c.to_numpy() for c in table.columns[:7])
            lists, sketch = table.columns[7].combine_chunks(), _sketches(table.columns[8], k)
            tokens, token_at = lists.values.to_numpy(), lists.offsets.to_numpy()
            a, b = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                here = lo + np.flatnonzero(own[lo:hi] == 1)
                for i in lo + np.flatnonzero(mover[lo:hi] == 1):
                    near = here[(comp[here] != comp[i]) & ((mover[here] == 0) | (rep[here] > rep[i]))]
                    near = near[100 * np.minimum(size[near], size[i]) >= percent * np.maximum(size[near], size[i])]
                    mine = tokens[token_at[i] : token_at[i + 1]]
                    for j in _agreeing(sketch[i], sketch, near, least):
                        if np.intersect1d(mine, tokens[token_at[j] : token_at[j + 1]])[0] == token[i]:
                            a.append(rep[i])
                            b.append(rep[j])
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _confirm(percent: int):
    """Keeps the pairs whose full sets have 100 * |A and B| >= percent * |A or B|."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(small) < percent * len(large):
                    good.append(False)
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], ["a", "b", "ok"])

    return run


def least_matches(n: int, p: float, miss: float = 1e-6) -> int:
    """The most that one may ask of n coordinates so that a pair at similarity p falls short with probability miss at most."""
    tail, k = 0.0, 0
    while k <= n:
        tail += comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail > miss:
            return k
        k += 1
    return n


def _by_token(rows: DataFrame, table: DataFrame, many: str, above: int) -> DataFrame:
    """rows joined with table (one row a token): frequent tokens by broadcast, the others by a shuffle."""
    hot = F.broadcast(table.where(F.col(many) > above))
    return rows.join(hot, "token").unionByName(rows.join(hot.select("token"), "token", "left_anti").join(table.where(F.col(many) <= above), "token"))


def _fits(table: DataFrame, row_bytes: int) -> bool:
    """Whether a written table is small enough to broadcast."""
    return table.count() * row_bytes <= BROADCAST_BYTES


def _shingles(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for rep, members in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = np.frombuffer(members.as_buffer(), np.int64)
            for lo in range(0, len(values), 100_000):
                part = values[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), rep)), pa.array(part)], ["rep", "token"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80, coords: int = 32, sketch: int = 512, rounds: int = 2, chunk: int = 1024, seed: int = 7, search: str = "coordinates") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs; see the module's text for the method.

    Linked are texts whose shingle sets have a Jaccard similarity of at least percent / 100, each link
    confirmed on the full sets. The candidate search asks for as many agreeing coordinates as a pair
    at the threshold falls short of with a probability of 1e-6 at most; search="shingles" misses none.
    """
    if search not in ("coordinates", "shingles"):
        raise ValueError(f"search is coordinates or shingles, not {search}")
    spark = docs.sparkSession
    exact = search == "shingles"
    min_matches = max(1, least_matches(coords, percent / 100))
    agree = (0, 0) if exact else (least_matches(min(COARSE, sketch), percent / 100), least_matches(sketch, percent / 100))
    with arrow_batches(spark):
        signed = stage(signatures(docs, id_col, text_col, width, coords, seed), "minhash-signatures")
    classes = stage(signed.where("n > 0 and id is not null").groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "minhash-classes")

    def sets_of(reps: DataFrame) -> DataFrame:
        wanted = F.broadcast(reps) if _fits(reps, 32) else reps
        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("rep"), F.col(f"`{text_col}`").cast("string").alias("text")).join(wanted, "rep", "left_semi")
        with arrow_batches(spark):
            return stage(_sets(rows, width, sketch, seed), "minhash-sets")

    sets = sets_of(classes.select("rep").distinct()) if exact else None
    posted = sets.select("rep", "members").mapInArrow(released(_shingles), "rep long, token long") if exact else classes.select("rep", F.posexplode("sig").alias("i", "v")).select("rep", F.xxhash64("i", "v").alias("token"))
    counted = posted.groupBy("token").agg(F.count(F.lit(1)).alias("many"))
    shared = stage(counted if exact else counted.where("many > 1"), "minhash-tokens")
    total = shared.agg(F.sum("many")).first()[0] or 0
    above = max(1000, total // HOT_SHARE)
    ranked = _by_token(posted, shared, "many", above).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("many", "token"))).alias("lists"))
    if exact:
        first = F.expr(f"filter(slice(lists, 1, cast(size(lists) - ceil(size(lists) * {percent} / 100D) + 1 as int)), x -> x.many > 1)")
    else:
        ranked, first = ranked.where(F.size("lists") >= min_matches), F.expr(f"slice(lists, 1, size(lists) - {min_matches - 1})")
    prefix = stage(ranked.select("rep", F.explode(first).alias("x")).select("rep", "x.token"), "minhash-postings")
    sets = sets or sets_of(prefix.select("rep").distinct())

    members = sets.dropDuplicates(["rep", "members"])
    tokens = prefix.groupBy("rep").agg(F.sort_array(F.collect_set("token")).alias("tokens"))  # one class has few
    about = members.select("rep", (F.octet_length("members") / 8).cast("long").alias("size"), "sketch").join(tokens, "rep")
    postings = stage(about.withColumn("token", F.explode("tokens")).withColumn("home", F.xxhash64(F.lit(seed), "rep")), "minhash-posted")
    discard(shared, prefix)

    def confirmed(pairs: DataFrame, label: str) -> DataFrame:
        pairs = stage(pairs.distinct(), "minhash-pairs", cores)

        def side(name: str, as_: str) -> DataFrame:
            # only the sets that a pair asks for travel
            asked = pairs.select(F.col(name).alias("rep")).distinct()
            near = members.join(F.broadcast(asked), "rep", "left_semi") if _fits(pairs, 32) else members
            return near.select(F.col("rep").alias(name), F.col("members").alias(as_))

        both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
        with arrow_batches(spark, 256, 8):
            out = stage(both.mapInArrow(released(_confirm(percent)), "a long, b long, ok boolean"), label, cores)
        discard(pairs)
        return out

    cores = spark.sparkContext.defaultParallelism
    # empty tables by plan: rows of the driver, even none, go through an RDD that keeps Python workers of its own
    roots = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("root"))
    done: list[DataFrame] = []
    tried = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(True).alias("ok"))
    for r in range(rounds + 1):
        known = roots.toDF("rep", "root")
        here = postings.join(F.broadcast(known) if _fits(roots, 48) else known, "rep", "left").withColumn("comp", F.coalesce("root", "rep")).drop("root")
        by = here.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("many"))
        lists = by.groupBy("token").agg(F.sum("many").alias("rows"), F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("many", "comp")).alias("main")).where("comps > 1")
        lists = stage(lists.select("token", "rows", "main", F.ceil(F.col("rows") / chunk).cast("int").alias("chunks")), "minhash-lists", cores)
        here = here.join(F.broadcast(lists), "token") if _fits(lists, 80) else _by_token(here, lists, "rows", above)
        if r < rounds:
            dealt = here.withColumn("part", F.pmod(F.xxhash64("home", F.lit(r)), "chunks")).repartition("token", "part").sortWithinPartitions("token", "part", "rep")
            pairs = dealt.select("token", "part", "rep", "comp", "sketch").mapInArrow(released(_forest(sketch, agree)), "a long, b long")
        else:
            here = here.withColumn("mover", (F.col("comp") != F.col("main")).cast("int")).withColumn("lives", F.pmod("home", "chunks"))
            every = F.when(F.col("mover") == 1, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.col("lives").cast("int")))
            dealt = here.withColumn("part", F.explode(every)).withColumn("own", (F.col("part") == F.col("lives")).cast("int")).repartition("token", "part").sortWithinPartitions("token", "part", "rep")
            pairs = dealt.select("token", "part", "rep", "comp", F.col("mover").cast("long").alias("mover"), F.col("own").cast("long").alias("own"), "size", "tokens", "sketch").mapInArrow(released(_cross(sketch, agree, percent)), "a long, b long")
        if r:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        done.append(confirmed(pairs, f"minhash-tried{r}"))
        discard(lists)
        tried = tried.unionByName(done[-1])
        roots = components(tried.where("ok").select("a", "b"), "minhash")
    discard(sets, postings, *done)

    table = classes.select("c1", "c2", "rep").join(roots.toDF("rep", "root"), "rep", "left").select("c1", "c2", F.coalesce("root", "rep").alias("root"))
    out = signed.select("id", "n", "c1", "c2").join(table, ["c1", "c2"], "left")
    component = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
