"""What the corpus operators share: durable staging, Arrow text access, connected components.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, a folder that the driver and all
executors see. A lost executor then costs a re-read, never a recomputation of what was staged.
"""

from __future__ import annotations

import contextlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.functions.staging import discard, stage

__all__ = ["arrow_batches", "ascii_lower", "components", "discard", "mix64", "packed_row", "released", "stage", "text_buffers", "text_chunks", "unbroadcast", "whole_groups"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The bytes that count as white space in every contract here: x20 and x09 to x0D.
BLANKS = " \t\n\x0b\x0c\r"

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int = 1000, mb: int = 4):
    """Smaller Arrow batches for the actions inside, the session's own again after it.

    Saves memory only. What bounds a worker's working arrays is that it cuts its batches itself, so a plan
    that runs later under the session's own limits is safe as well.
    """
    before = {k: spark.conf.get(k) for k in (ARROW_ROWS, ARROW_BYTES)}
    spark.conf.set(ARROW_ROWS, str(rows))
    spark.conf.set(ARROW_BYTES, str(mb << 20))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def give_back() -> None:
    """Returns the memory that this process has freed to the system, as far as its allocators can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def released(run):
    """run over Arrow batches, giving freed memory back at its end: a worker stays, idle, beside an executor's later stages."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def packed_row(df: DataFrame) -> Column:
    """All columns as one struct, so that an operator's own columns can't clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other letter alone."""
    return F.translate(text, UPPER, UPPER.lower())


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the n + 1 offsets of its rows; a null row is empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


#: Bytes of text that are hashed at once: working arrays are some thirty times as large.
CHUNK_BYTES = 1 << 18


def text_chunks(column, most: int = CHUNK_BYTES):
    """(first row, end row, bytes, offsets) of consecutive rows of at most ``most`` bytes; a longer text comes alone."""
    raw, at = text_buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of the published SplitMix64 generator)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def whole_groups(batches, keys: int):
    """Cuts a stream of Arrow batches, sorted by its first ``keys`` columns, where the key changes.

    Yields (table, bounds): whole groups only, bounds being their first rows and the end. What is held
    is one batch and the group that is still open.
    """
    import pyarrow as pa

    def bounds(table):
        new = np.zeros(table.num_rows, bool)
        for i in range(keys):
            c = table.column(i).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        cuts = bounds(rest)
        if len(cuts):
            yield rest.slice(0, int(cuts[-1])), np.concatenate([[0], cuts])
            rest = rest.slice(int(cuts[-1]))
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


#: Most rows that a join may broadcast of a table that compresses well.
BROADCAST_ROWS = 50_000


def unbroadcast(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most ``rows`` rows, to be joined; merged if they are many.

    Catalyst judges a written table by the bytes of its files. Small integers take a thirtieth there of what a
    broadcast of them takes in the driver, so the session's threshold alone doesn't keep the driver from harm.
    """
    return df.hint("merge") if rows > BROADCAST_ROWS else df


ROWS_A_FILE = 500_000


def components(edges: DataFrame, label: str, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, root)`` per node, root the smallest.

    Every node first points at its smallest neighbour. Pointers are halved until all are stars; then
    each root hooks onto the smallest root next to it, and so on until no edge runs between two
    roots. All state is a distributed table, written down in each step; what a step replaces is deleted.
    """

    def halved(points: DataFrame) -> DataFrame:
        onward = unbroadcast(points.select(F.col("node").alias("root"), F.col("root").alias("next")), most)
        return points.join(onward, "root", "left").select("node", F.col("root").alias("was"), F.coalesce("next", "root").alias("root"))

    def stars(points: DataFrame) -> DataFrame:
        """points, written; its input may be discarded afterwards."""
        last = None
        for _ in range(rounds):
            # two halvings a written table; without a move in the second all pointers reach their roots
            points = stage(halved(halved(points.select("node", "root")).select("node", "root")), f"{label}-roots", files)
            if last is not None:
                discard(last)
            last = points
            if points.where("was <> root").isEmpty():
                return points
        raise RuntimeError(f"pointers of {label} did not settle in {rounds} rounds")

    # no table here has more rows than twice the edges: files of a useful size, whatever the shuffle's partitions
    distinct = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = stage(distinct, f"{label}-edges", edges.sparkSession.sparkContext.defaultParallelism)
    n_edges = live.count()
    files, most = 1 + n_edges // ROWS_A_FILE, 2 * n_edges
    both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = stars(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
    for _ in range(rounds):
        pairs = unbroadcast(roots.select("node", "root"), most)
        rest = live.join(pairs.toDF("a", "ra"), "a").join(pairs.toDF("b", "rb"), "b").where("ra <> rb")
        rest = stage(rest.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{label}-live", files)
        discard(live)
        live = rest
        if live.isEmpty():
            discard(live)
            return roots.select("node", "root")
        hooks = live.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("to"))
        moved = stars(pairs.join(unbroadcast(hooks, most), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        discard(roots)
        roots = moved
    raise RuntimeError(f"components of {label} did not settle in {rounds} rounds")
