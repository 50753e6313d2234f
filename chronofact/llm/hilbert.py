"""Sharding along a Hilbert curve over quantised metadata, with DataFrame functions only.

Each dimension is cut into 2^bits cells of near-equal counts (strings keep their byte order), the
cells' curve index is the sort key, and shards are runs of the sorted rows. Neighbours on the curve are
neighbours in every dimension, so each run covers a small box and files can be pruned by any of them:
``write_shards`` writes them, ``manifest`` has the box of each file, ``files_for`` the files that a filter needs.

Ties on the curve are ordered by a hash of the text and then by id: equal texts of equal metadata stand next
to each other, though a cut between shards may fall between them, and a cell that holds a third of all rows
still splits over partitions. A null id sorts first, a null text has no bytes, a null dimension is its lowest
cell. Repeated rows each get a slot of their own. Columns of docs may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofact.llm.common import discard, packed_row, stage


def curve_states(n: int) -> tuple[list[int], list[int]]:
    """Digit and next state for each (state, cell bits) of an n-dimensional Hilbert curve.

    A state is an entry corner e and a direction d of one level's Gray-code walk through its 2^n cells;
    state number = e * n + d. Built from the Gray code's own rules, for any n.
    """
    size = 1 << n
    ones = size - 1

    def right(x: int, by: int) -> int:
        by %= n
        return ((x >> by) | (x << (n - by))) & ones

    def trailing(w: int) -> int:
        count = 0
        while w & 1:
            count, w = count + 1, w >> 1
        return count

    rank = {w ^ (w >> 1): w for w in range(size)}
    digits, following = [], []
    for e in range(size):
        for d in range(n):
            for cell in range(size):
                w = rank[right(cell ^ e, d + 1)]
                low = 2 * ((w - 1) // 2) if w else 0
                turn = 0 if w == 0 else trailing(w - 1 if w % 2 == 0 else w) % n
                entry = e ^ right(low ^ (low >> 1), n - (d + 1) % n)
                digits.append(w)
                following.append(entry * n + (d + turn + 1) % n)
    return digits, following


def curve_index(cells: list[Column], bits: int) -> Column:
    """The Hilbert index of the cell whose coordinates (0 to 2^bits - 1) are given."""
    n = len(cells)
    digits, following = curve_states(n)
    digit, after = F.array(*map(F.lit, digits)), F.array(*map(F.lit, following))

    def step(acc: Column, level: Column) -> Column:
        at = acc["state"] * (1 << n)
        for i, c in enumerate(cells):
            at = at + F.call_function("getbit", c, level).cast("int") * (1 << i)
        return F.struct((acc["h"] * (1 << n) + F.get(digit, at)).alias("h"), F.get(after, at).alias("state"))

    levels = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    return F.aggregate(levels, F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("state")), step, lambda acc: acc["h"])


def _ordinal(c: Column, kind: str) -> Column:
    """A double that keeps the column's order; strings by their first six bytes."""
    if kind == "string":
        return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double"), F.lit(-1.0))
    if kind.startswith("timestamp") or kind == "date":
        c = F.unix_micros(c.cast("timestamp"))
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(None)), F.lit(float("-inf")))


def hilbert_shards(docs: DataFrame, dims: list[str], *, shards: int = 8, bits: int = 5, law: str = "rows", id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, curve, law, shard, slot): rows in curve order, cut into runs; carry adds ``row``, all columns of docs.

    law "rows": counts differ by one at most. law "bytes": a row is in the shard that its first byte
    falls in when the bytes of all rows are laid end to end, so sizes differ by less than two rows.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"law is rows or bytes, not {law}")
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    text = F.col(f"`{text_col}`").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    flat = [
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        *((size.cast("double") if d == "size" else _ordinal(F.col(f"`{d}`"), kinds[d])).alias(f"dim{i}") for i, d in enumerate(dims)),
    ]
    rows = stage(docs.select(*flat), "curve-rows")  # the only scan of the texts, unless they are carried
    # at most (2^bits - 1) numbers a dimension come to the driver
    ends = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = rows.agg(*(F.percentile_approx(f"dim{i}", ends, 2000).alias(f"dim{i}") for i in range(len(dims)))).first()

    def cell(i: int) -> Column:
        known = sorted(set(cuts[i] or []))
        return F.size(F.filter(F.array(*map(F.lit, known)), lambda c: c <= F.col(f"dim{i}"))) if known else F.lit(0)

    own = ["doc_id", "size", "text_crc32", "text_hash", *(["row"] if carry else [])]
    celled = (docs.select(*flat, packed_row(docs)) if carry else rows).select(*own, *(cell(i).alias(f"cell{i}") for i in range(len(dims))))
    placed = celled.select(*own, curve_index([F.col(f"cell{i}") for i in range(len(dims))], bits).alias("curve"))

    key = ["curve", "text_hash", "doc_id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the partition and the place in it are fixed by writing them down once
    laid = stage(placed.repartitionByRange(parts, *key).sortWithinPartitions(*key).drop("text_hash").withColumn("at", F.monotonically_increasing_id()), "curve")
    discard(rows)
    laid = laid.withColumn("part", F.shiftright("at", 33)).withColumn("nth", F.col("at").bitwiseAND((1 << 33) - 1))
    # one row a partition
    tally = laid.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tally = tally.select("part", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}0") for c in "nb"), *(F.sum(c).over(whole).alias(f"{c}1") for c in "nb"))
    ranked = laid.join(F.broadcast(tally), "part").withColumn("rank", F.col("n0") + F.col("nth"))
    if law == "rows":
        ranked = ranked.withColumn("shard", F.expr(f"(rank * {shards}) div n1")).withColumn("slot", F.expr(f"rank - (shard * n1 + {shards - 1}) div {shards}"))
    else:
        before = F.col("b0") + F.sum("size").over(Window.partitionBy("part").orderBy("nth")) - F.col("size")
        ranked = ranked.withColumn("before", before).withColumn("shard", F.expr(f"(before * {shards}) div b1"))
        first = ranked.groupBy("shard").agg(F.min("rank").alias("rank0"))
        ranked = ranked.join(F.broadcast(first), "shard").withColumn("slot", F.col("rank") - F.col("rank0"))
    return ranked.select("doc_id", "size", "text_crc32", "curve", F.lit(law).alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), *(["row"] if carry else []))


def write_shards(docs: DataFrame, dims: list[str], path: str, **options) -> None:
    """Writes the shards as Parquet below path, a folder ``shard=N`` each; a file covers a run of the curve."""
    placed = hilbert_shards(docs, dims, carry=True, **options)
    taken = [c for c in docs.columns if c != "shard"]
    placed.select("shard", *(F.col("row").getField(c).alias(c) for c in taken)).write.partitionBy("shard").parquet(path)


def manifest(written: DataFrame, dims: list[str]) -> DataFrame:
    """(file, rows, boxes): how many rows each file of a written table has, and each dimension's least and greatest value as text order keeps it."""
    kinds = dict(written.dtypes)
    boxes = [f(_ordinal(F.col(f"`{d}`"), kinds[d])).alias(f"{n}_{d}") for d in dims for n, f in (("least", F.min), ("most", F.max))]
    return written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), *boxes)


def files_for(files: DataFrame, written: DataFrame, bounds: dict[str, tuple[object, object]]) -> DataFrame:
    """Those rows of a manifest whose file may hold a row with every dimension between its two bounds (inclusive)."""
    kinds = dict(written.dtypes)
    for d, (least, most) in bounds.items():
        lo, hi = (_ordinal(F.lit(v).cast(kinds[d]), kinds[d]) for v in (least, most))
        files = files.where((F.col(f"most_{d}") >= lo) & (F.col(f"least_{d}") <= hi))
    return files
