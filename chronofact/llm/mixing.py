"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source s with B_s bytes and target share w_s gets the mean repetition rate r_s = w_s * B / B_s, B being
the bytes of the whole mix. Each document draws u in [0, 1) from a hash of seed and id, and its number of
copies is the inverse of the Poisson distribution function with mean r_s at u: independent of order and
partitions, and the same when a task runs again. A rate above ``MOST_RATE`` is split: the sum of independent
Poisson draws is Poisson with the sum of their means, so no table of the distribution function is long.
Copies are spread by a hash of (id, copy) and sorted by it, a global shuffle in one exchange.

Without weights, the share of s is B_s^temperature, normalised. A source without a given weight gets none
of the mix. Null sources form one source; null ids draw by their text. Repeated rows draw alike. Empty
texts count one byte, so no rate is infinite. Columns of docs may have any names; ``copy_no`` and ``mix_key``
of docs are replaced. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofact.llm.common import packed_row, stage

#: The largest mean of one draw.
MOST_RATE = 64
#: A rate table of so many bytes is broadcast; a larger one is joined by a shuffle on (source, salt).
BROADCAST_BYTES = 16 << 20
SALTS = 64


def _draw(seed: int, *parts: Column) -> Column:
    """13 hex digits of an MD5 digest, 52 bits, as a number below 1."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rate_table(docs: DataFrame, size: Column, source: Column, weights: dict[str, float] | None, temperature: float, total: int | None) -> DataFrame:
    """(source, draws, below): how often a document of the source draws, and the distribution function of one draw."""
    sums = stage(docs.groupBy(source.alias("source")).agg(F.sum(size).alias("bytes")), "mix-sizes", 1)
    if weights is None:
        share = F.pow("bytes", F.lit(temperature))
    else:
        known = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
        share = F.coalesce(F.element_at(known, F.col("source")), F.lit(0.0)).cast("double")
    # two numbers come to the driver
    every, corpus = sums.agg(F.sum(share), F.sum("bytes")).first()
    rate = share / F.lit(every) * F.lit(total if total is not None else corpus) / F.col("bytes")
    rates = sums.select("source", rate.alias("whole")).where("whole > 0").withColumn("draws", F.ceil(F.col("whole") / MOST_RATE).cast("int")).withColumn("rate", F.col("whole") / F.col("draws"))
    # the distribution function of each source, as far as a double can tell it from 1
    steps = rates.select("source", "draws", "rate", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 10 * F.sqrt("rate") + 30).cast("int"))).alias("j"))
    upto = Window.partitionBy("source").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("logp", -F.col("rate") + F.col("j") * F.log("rate") - F.sum(F.log(F.greatest("j", F.lit(1)))).over(upto))
    steps = steps.withColumn("below", F.sum(F.exp("logp")).over(upto))
    return stage(steps.groupBy("source").agg(F.first("draws").alias("draws"), F.sort_array(F.collect_list("below")).alias("below")), "mix-rates", 1 if sums.count() < 100_000 else SALTS)


def poisson_mix(docs: DataFrame, *, weights: dict[str, float] | None = None, temperature: float = 0.5, total: int | None = None, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of docs, each as often as drawn, with ``copy_no`` (from 1) and ``mix_key``, in the order of mix_key within partitions.

    total: bytes of the mix, those of docs by default.
    """
    text = F.col(f"`{text_col}`").cast("string")
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("\x00"))
    size = F.greatest(F.coalesce(F.octet_length(text), F.lit(0)), F.lit(1)).cast("long")
    table = rate_table(docs, size, source, weights, temperature, total)
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit("")))))
    rows = docs.select(source.alias("source"), ident.alias("ident"), packed_row(docs))
    held = table.agg(F.sum(F.size("below") * 8 + F.octet_length("source") + 32)).first()[0] or 0
    if held <= BROADCAST_BYTES:
        drawn = rows.join(F.broadcast(table), "source")
    else:  # a source that holds a third of all rows still spreads over SALTS tasks
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(seed), "ident"), F.lit(SALTS)).cast("int")).join(salted, ["source", "salt"]).drop("salt")

    def one(i: Column) -> Column:
        u = _draw(seed, F.col("ident"), F.when(i > 0, i.cast("string")))  # the first draw has no number
        return F.size(F.filter("below", lambda c: c <= u))

    times = F.aggregate(F.sequence(F.lit(0), F.col("draws") - 1), F.lit(0), lambda acc, i: acc + one(i))
    copies = drawn.withColumn("times", times).where("times > 0").select("ident", "row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy_no"))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(str(seed + 1)), "ident", F.col("copy_no").cast("string"))))
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("copy_no", "mix_key")]
    return keyed.select(*own, "copy_no", "mix_key").repartition("mix_key").sortWithinPartitions("mix_key")
