"""What a query depends on, and which subscriptions a change may affect."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.functions.values import content_id
from chronofact.plans.ast import Apply, Not, Or, Pattern, Query, is_variable, parse


@dataclass(frozen=True)
class Dependencies:
    attributes: frozenset[str]
    entity_types: frozenset[str]
    entities: frozenset[str]
    dynamic: bool
    rules: frozenset[str]


def dependencies(query, entity_types: list[str] = ()) -> Dependencies:
    """Attributes and bound ids of all patterns, also those in not, or and rules. Dynamic: some attribute is a variable."""
    q: Query = parse(query)
    patterns: list[Pattern] = []

    def walk(c) -> None:
        if isinstance(c, Pattern):
            patterns.append(c)
        elif isinstance(c, Not):
            patterns.extend(c.patterns)
        elif isinstance(c, Or):
            for a in c.alternatives:
                walk(a)

    for c in q.where:
        walk(c)
    applied = {c.rule for c in q.of(Apply)}
    for r in q.rules:
        if r.name in applied:
            patterns.extend(r.patterns)
    attributes = {p.attribute for p in patterns if not is_variable(p.attribute)} | {a for a, _ in q.optional}
    bound = {p.entity for p in patterns if not is_variable(p.entity)}
    # bound ids narrow the dependency only if every pattern has one
    narrow = bound if patterns and all(not is_variable(p.entity) for p in patterns) and not q.optional else set()
    return Dependencies(frozenset(attributes), frozenset(entity_types), frozenset(narrow), any(is_variable(p.attribute) for p in patterns), frozenset(applied))


@dataclass
class Subscription:
    id: str
    query: dict
    depends: Dependencies
    hash: str


@dataclass
class Subscriptions:
    """Registered queries. Changes of a micro-batch are matched by one join with the dependency table."""

    held: dict[str, Subscription] = field(default_factory=dict)

    def register(self, id_: str, query: dict, entity_types: list[str] = ()) -> Subscription:
        s = Subscription(id_, query, dependencies(query, entity_types), query_hash(query))
        self.held[id_] = s
        return s

    def unregister(self, id_: str) -> bool:
        return self.held.pop(id_, None) is not None

    def get(self, id_: str) -> Subscription | None:
        return self.held.get(id_)

    def list(self) -> list[Subscription]:
        return list(self.held.values())

    def count(self) -> int:
        return len(self.held)

    def clear(self) -> None:
        self.held.clear()

    def find_by_query_hash(self, hash_: str) -> list[Subscription]:
        return [s for s in self.held.values() if s.hash == hash_]

    def table(self, spark: SparkSession) -> DataFrame:
        """(subscription, attribute, entity_type, entity): a null matches everything."""
        rows = []
        for s in self.held.values():
            for a in sorted(s.depends.attributes) if not s.depends.dynamic else [None]:
                for t in sorted(s.depends.entity_types) or [None]:
                    for e in sorted(s.depends.entities) or [None]:
                        rows.append((s.id, a, t, e))
        return spark.createDataFrame(rows, "subscription string, attribute string, type_wanted string, entity_wanted string")

    def affected(self, changes: DataFrame) -> DataFrame:
        """(subscription) that one of changes(entity_id, attribute, entity_type) may concern; untyped changes concern all types."""
        return affected(changes, self.table(changes.sparkSession))


    def boundaries(self, facts: DataFrame, valid_at: int) -> DataFrame:
        """(subscription, next_boundary): when time alone next changes what a subscription may see, null if never.

        facts: what is recorded and not retracted. One pass for all subscriptions, so a scheduler asks once a round.
        """
        ahead = facts.select("entity_id", "attribute", "entity_type", F.explode(F.array("valid_from", "valid_to")).alias("t")).where(F.col("t") > valid_at)
        # a boundary is kept once for each place, not once a fact
        soonest = ahead.groupBy("entity_id", "attribute", "entity_type").agg(F.min("t").alias("t"))
        table = self.table(facts.sparkSession)
        met = matches(soonest, table, "t").groupBy("subscription").agg(F.min("t").alias("next_boundary"))
        return table.select("subscription").distinct().join(met, "subscription", "left")

    def due(self, facts: DataFrame, since: int, valid_at: int) -> DataFrame:
        """(subscription) whose facts begin or end to hold after ``since`` and up to ``valid_at``: what a scheduler wakes up."""
        return self.boundaries(facts, since).where(F.col("next_boundary") <= valid_at).select("subscription")


def matches(rows: DataFrame, table: DataFrame, *keep: str) -> DataFrame:
    """(subscription, keep...) of the rows(entity_id, attribute, entity_type) that subscriptions are about."""
    fits = (F.col("type_wanted").isNull() | F.col("entity_type").isNull() | (F.col("type_wanted") == F.col("entity_type"))) & (F.col("entity_wanted").isNull() | (F.col("entity_wanted") == F.col("entity_id")))
    named = rows.join(table.where("attribute is not null"), "attribute").where(fits).select("subscription", *keep)
    loose = rows.join(F.broadcast(table.where("attribute is null").drop("attribute")), fits).select("subscription", *keep)  # subscriptions are the driver's own list
    return named.unionByName(loose)


def affected(changes: DataFrame, table: DataFrame) -> DataFrame:
    """Equal attributes meet by hash; subscriptions to any attribute are few and joined apart."""
    fits = (F.col("type_wanted").isNull() | F.col("entity_type").isNull() | (F.col("type_wanted") == F.col("entity_type"))) & (F.col("entity_wanted").isNull() | (F.col("entity_wanted") == F.col("entity_id")))
    named = table.where("attribute is not null").join(changes, "attribute").where(fits).select("subscription")
    loose = table.where("attribute is null").drop("attribute").join(changes, fits, "left_semi").select("subscription")
    return named.unionByName(loose).distinct()


def query_hash(query: dict) -> str:
    return content_id("query", query)
