"""What tools list: entity types, entities of a type, reflected columns, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.sources.store import FactStore


def entity_types(facts: DataFrame) -> DataFrame:
    """(entity_type, entities, attributes) over visible facts."""
    return facts.where("entity_type is not null").groupBy("entity_type").agg(F.count_distinct("entity_id").alias("entities"), F.sort_array(F.collect_set("attribute")).alias("attributes"))


def entity_page(facts: DataFrame, entity_type: str, after: str | None = None, limit: int = 50) -> tuple[list[str], str | None]:
    """Ids in order, and where the next page starts after."""
    ids = facts.where(F.col("entity_type") == F.lit(entity_type)).select("entity_id").distinct()
    if after is not None:
        ids = ids.where(F.col("entity_id") > F.lit(after))
    found = [r[0] for r in ids.orderBy("entity_id").limit(limit + 1).collect()]
    return found[:limit], found[limit - 1] if len(found) > limit else None


def reflected_columns(facts: DataFrame, entity_type: str, declared: dict[str, str] | None = None) -> DataFrame:
    """(attribute, value_type): the declared storage type, else the first observed one."""
    own = facts.where(F.col("entity_type") == F.lit(entity_type)).select("entity_id").distinct()
    seen = facts.join(own, "entity_id", "left_semi").groupBy("attribute").agg(F.min_by("value_type", F.struct("recorded_position", "triple_id")).alias("value_type"))
    if declared:
        known = F.create_map(*(F.lit(x) for kv in declared.items() for x in kv))
        seen = seen.withColumn("value_type", F.coalesce(F.element_at(known, F.col("attribute")), F.col("value_type")))
    return seen


def status(store: FactStore) -> dict:
    facts = store.facts().where("retracted_at is null")
    return {"position": store.current_position(), "facts": facts.count(), "entities": facts.select("entity_id").distinct().count()}
