"""Entity snapshots: the state of an entity at a commit, as canonical JSON with a content hash.

Zero and negative zero have one text and one hash, unless signed_zero asks for the sign that the fact has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofact.functions.values import canonical_json, content_id
from chronofact.sources.basis import Basis, visible

VALUE = ["attribute", "value_type", "value_string", "value_number", "value_boolean", "value_datetime", "value_json"]


def _canonical(signed_zero: bool = False):
    @F.pandas_udf(T.StructType([T.StructField("state", T.StringType()), T.StructField("hash", T.StringType())]))
    def run(facts):
        import json

        import pandas as pd

        def text_of(value):
            return canonical_json(value, signed_zero)

        def one(rows):
            state: dict[str, list] = {}
            for r in rows:
                kind = r["value_type"]
                v = json.loads(r["value_json"]) if kind == "json" else r["value_number"] if kind == "number" else bool(r["value_boolean"]) if kind == "boolean" else int(r["value_datetime"]) if kind == "datetime" else r["value_string"]
                state.setdefault(r["attribute"], []).append({"type": kind, "value": v})
            text = text_of({a: sorted(vs, key=text_of) for a, vs in state.items()})
            return text, content_id("entity-snapshot", text)

        done = [one(rows) for rows in facts]
        return pd.DataFrame({"state": [d[0] for d in done], "hash": [d[1] for d in done]})

    return run


def at_commits(facts: DataFrame, commits: DataFrame, signed_zero: bool = False) -> DataFrame:
    """Snapshots of (entity_id, position, tx_id, instant) commits: the facts live right after each of them."""
    own = facts.select("entity_id", "recorded_position", "retracted_position", "valid_from", "valid_to", *VALUE)
    alive = (F.col("recorded_position") <= F.col("position")) & (F.col("retracted_position").isNull() | (F.col("retracted_position") > F.col("position")))
    valid = (F.col("valid_from") <= F.col("instant")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("instant")))
    seen = commits.join(own, "entity_id", "left").where(alive & valid | F.col("attribute").isNull())
    states = seen.groupBy("entity_id", "position", "tx_id", "instant").agg(F.collect_list(F.struct(*VALUE)).alias("facts"))
    # a commit that left nothing of an entity keeps its empty snapshot
    every = commits.join(states.select("entity_id", "position", "facts"), ["entity_id", "position"], "left").withColumn("facts", F.coalesce("facts", F.array()))
    return every.withColumn("c", _canonical(signed_zero)("facts")).select("entity_id", "position", "tx_id", "instant", F.col("c.state").alias("state"), F.col("c.hash").alias("hash"))


def commits_of(facts: DataFrame, log: DataFrame) -> DataFrame:
    """Which commits changed which entity."""
    user = facts.where(~F.col("entity_id").startswith("_"))
    touched = user.select("entity_id", F.col("recorded_position").alias("position")).unionByName(user.where("retracted_position is not null").select("entity_id", F.col("retracted_position").alias("position"))).distinct()
    return touched.join(log.select("position", "tx_id", "instant"), "position").select("entity_id", "position", "tx_id", "instant")


def materialize(facts: DataFrame, log: DataFrame, signed_zero: bool = False) -> DataFrame:
    return at_commits(facts, commits_of(facts, log), signed_zero)


def backfill(facts: DataFrame, log: DataFrame, have: DataFrame, signed_zero: bool = False) -> DataFrame:
    """Snapshots of the newest commit of entities that have none."""
    missing = commits_of(facts, log).join(have.select("entity_id").distinct(), "entity_id", "left_anti")
    return at_commits(facts, _newest(missing), signed_zero)


def _newest(rows: DataFrame, order: tuple[str, ...] = ("position", "instant", "tx_id")) -> DataFrame:
    rest = [c for c in rows.columns if c != "entity_id"]
    return rows.groupBy("entity_id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select("entity_id", "s.*")


def current(snapshots: DataFrame, entity: str | None = None) -> DataFrame:
    """The latest snapshot of one entity, or of each."""
    return _newest(snapshots if entity is None else snapshots.where(F.col("entity_id") == F.lit(entity)))


def at(snapshots: DataFrame, entity: str, tx_id: str) -> DataFrame:
    return snapshots.where((F.col("entity_id") == F.lit(entity)) & (F.col("tx_id") == F.lit(tx_id)))


def as_of(snapshots: DataFrame, instant: int, entity: str | None = None) -> DataFrame:
    """Filtered by time, but the latest by position."""
    return current(snapshots.where(F.col("instant") <= instant), entity)


def hash_at(snapshots: DataFrame, entity: str, tx_id: str) -> DataFrame:
    return at(snapshots, entity, tx_id).select("hash")


def hashes(snapshots: DataFrame, entity: str) -> DataFrame:
    return snapshots.where(F.col("entity_id") == F.lit(entity)).select("tx_id", "position", "instant", "hash").orderBy("position")


def batch_current(snapshots: DataFrame, entities: list[str]) -> DataFrame:
    return _newest(snapshots.where(F.col("entity_id").isin(*entities)))


def checkpoint(snapshots: DataFrame, instant: int) -> DataFrame:
    return as_of(snapshots, instant).select("entity_id", "hash")


def find_by_hash(snapshots: DataFrame, hash_: str) -> DataFrame:
    return current(snapshots).where(F.col("hash") == F.lit(hash_)).select("entity_id")


def find_changed(snapshots: DataFrame, log: DataFrame, since_tx: str) -> DataFrame:
    """Latest snapshots of entities changed after a transaction; of all if it isn't known."""
    since = log.where(F.col("tx_id") == F.lit(since_tx)).agg(F.coalesce(F.max("position"), F.lit(-1)).alias("since"))
    return current(snapshots).crossJoin(F.broadcast(since)).where("position > since").drop("since")


def _attributes(snapshots: DataFrame, name: str) -> DataFrame:
    state = F.from_json("state", "map<string,string>")
    return snapshots.select(F.explode(state).alias("attribute", name))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(attribute, change, old, new) between two snapshots of an entity (one row each, or none)."""
    a, b = _attributes(old, "old"), _attributes(new, "new")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return a.join(b, "attribute", "full").where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("change", change).select("attribute", "change", "old", "new")


def state_of(facts: DataFrame, basis: Basis) -> DataFrame:
    """(entity_id, state, hash) of every entity at a basis."""
    rows = facts.where(visible(basis.resolved())).groupBy("entity_id").agg(F.collect_list(F.struct(*VALUE)).alias("facts"))
    return rows.withColumn("c", _canonical()("facts")).select("entity_id", "c.*")
