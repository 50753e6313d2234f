"""The ordered change feed of a store as a Structured Streaming source, and consumers' checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronofact.errors import CheckpointConflict, TransactionConflict
from chronofact.sources.facts import ASSERTION_FIELDS, ASSERTIONS
from chronofact.sources.store import Assert, FactStore, Meta, Retract, TripleLive

_ROWS = ", ".join(f"{n}: {t.replace('long', 'bigint')}" for n, t in ASSERTION_FIELDS)
LOG = f"position long, tx_id string, instant long, command_id string, quiet boolean, bulk boolean, assertion_path string, assertions array<struct<{_ROWS}>>"
CHANGE = "index int, op string, entityId string, attribute string, entityType string, tripleId string"


def commits(spark: SparkSession, store: FactStore, per_batch: int | None = None) -> DataFrame:
    """A stream of log entries, each once; quiet system commits are left out."""
    reader = spark.readStream.schema(LOG).option("pathGlobFilter", "*.json")
    if per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.json(f"{store.root}/log").where("not quiet")


def changes(store: FactStore, entries: DataFrame) -> DataFrame:
    """(position, op, entity_id, attribute, entity_type, triple_id) of a batch of log entries.

    The entries hold their transactions' change records; only the folders of bulk loads among them are read.
    """
    rows = entries.select("position", F.explode("assertions").alias("a")).where("a.attribute = ':_tx/change'")
    c = F.from_json("a.value_json", CHANGE)
    made = rows.select("position", c.alias("c")).select("position", F.col("c.op").alias("op"), F.col("c.entityId").alias("entity_id"), F.col("c.attribute").alias("attribute"), F.col("c.entityType").alias("entity_type"), F.col("c.tripleId").alias("triple_id"))
    folders = [f"{store.root}/{r[0]}" for r in entries.where("bulk").select("assertion_path").collect()]  # one name a bulk load
    if not folders:
        return made
    loaded = store.spark.read.schema(ASSERTIONS).parquet(*folders)
    return made.unionByName(loaded.select(F.col("recorded_position").alias("position"), F.lit("assert").alias("op"), "entity_id", "attribute", "entity_type", "triple_id"))


def follow(store: FactStore, handle: Callable[[DataFrame, int], None], checkpoint: str, *, available_now: bool = False, every: str = "1 second", per_batch: int | None = None) -> StreamingQuery:
    """Calls handle(changes, batch) at least once for each batch of commits, resuming from the checkpoint."""
    writer = commits(store.spark, store, per_batch).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: handle(changes(store, batch), n))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


class Checkpoints:
    """Positions that consumers have worked up to, kept as facts and moved by compare-and-retract."""

    ATTRIBUTE = ":sys/consumer-position"

    def __init__(self, store: FactStore):
        self.store = store

    def _held(self, consumer: str):
        rows = self.store.match(entity=f"_sys/consumer/{consumer}", attribute=self.ATTRIBUTE).select("triple_id", "value_number").collect()
        return rows[0] if rows else None

    def get(self, consumer: str) -> int:
        held = self._held(consumer)
        return int(held["value_number"]) if held else 0

    def advance(self, consumer: str, expected: int, to: int) -> int:
        """Moves from expected to ``to``. Repeating a move is harmless; going back or beyond the newest commit isn't allowed."""
        held = self._held(consumer)
        now = int(held["value_number"]) if held else 0
        if now == to:
            return to
        if now != expected or to < expected or to > self.store.current_position():
            raise CheckpointConflict(f"{consumer} is at {now}; can't go from {expected} to {to}")
        ops = ([Retract(held["triple_id"])] if held else []) + [Assert(f"_sys/consumer/{consumer}", self.ATTRIBUTE, to)]
        try:
            self.store.transact(ops, Meta(preconditions=[TripleLive(held["triple_id"])] if held else []), system=True)
        except TransactionConflict as e:
            raise CheckpointConflict(f"{consumer} moved meanwhile") from e
        return to
