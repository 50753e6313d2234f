"""Graph constraints over visible facts: required, cardinality, unique, reference target."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.errors import ConstraintViolated

FIELDS = "constraint string, code string, subject string, path string, value string, actual long"


@dataclass(frozen=True)
class Required:
    entity_type: str
    attribute: str


@dataclass(frozen=True)
class Cardinality:
    entity_type: str
    attribute: str
    most: int = 1


@dataclass(frozen=True)
class Unique:
    entity_type: str
    attribute: str


@dataclass(frozen=True)
class ReferenceTarget:
    entity_type: str
    attribute: str
    target_type: str


def value_key() -> Column:
    """One string for each typed value; doubles by their bits' text, which is equal for equal numbers."""
    return F.concat_ws("|", "value_type", F.coalesce("value_string", F.lit("")), F.coalesce(F.col("value_number").cast("string"), F.lit("")), F.coalesce(F.col("value_boolean").cast("string"), F.lit("")), F.coalesce(F.col("value_datetime").cast("string"), F.lit("")), F.coalesce("value_json", F.lit("")))


def violations(facts: DataFrame, constraint) -> DataFrame:
    """Violations among the given (already visible) facts, in FIELDS."""
    subjects = facts.where(F.col("entity_type") == F.lit(constraint.entity_type)).select("entity_id").distinct()
    own = facts.where(F.col("attribute") == F.lit(constraint.attribute)).join(subjects, "entity_id", "left_semi")
    name = type(constraint).__name__

    def shaped(rows: DataFrame, code: str, value: Column, actual: Column) -> DataFrame:
        return rows.select(F.lit(name).alias("constraint"), F.lit(code).alias("code"), F.col("entity_id").alias("subject"), F.lit(constraint.attribute).alias("path"), value.cast("string").alias("value"), actual.cast("long").alias("actual"))

    if isinstance(constraint, Required):
        return shaped(subjects.join(own.select("entity_id").distinct(), "entity_id", "left_anti"), "required", F.lit(None), F.lit(0))
    if isinstance(constraint, Cardinality):
        return shaped(own.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > constraint.most), "cardinality", F.lit(None), F.col("n"))
    if isinstance(constraint, Unique):
        claims = own.select("entity_id", value_key().alias("key")).distinct()
        shared = claims.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return shaped(claims.join(shared, "key"), "unique", F.col("key"), F.col("n"))
    targets = facts.where(F.col("entity_type") == F.lit(constraint.target_type)).select(F.col("entity_id").alias("target")).distinct()
    loose = own.where("value_type <> 'ref'").unionByName(own.where("value_type = 'ref'").join(targets, F.col("value_string") == F.col("target"), "left_anti"))
    return shaped(loose.select("entity_id", value_key().alias("key")).distinct(), "reference-target", F.col("key"), F.lit(1))


def evaluate(facts: DataFrame, constraints: list) -> DataFrame:
    """Violations of all constraints, ordered by type, subject, path and code."""
    return reduce(DataFrame.unionByName, (violations(facts, c) for c in constraints)).orderBy("constraint", "subject", "path", "code", "value")


def _edges(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, t): valid times at which what is visible under the keys can change."""
    return rows.select(*keys, F.explode(F.array("valid_from", "valid_to")).alias("t")).where("t is not null")


def _at(rows: DataFrame, edges: DataFrame, *keys: str) -> DataFrame:
    """rows once for each edge of their keys at which they are visible."""
    return rows.join(edges, list(keys)).where((F.col("valid_from") <= F.col("t")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("t"))))


def violations_over_time(facts: DataFrame, constraint, touched: DataFrame) -> DataFrame:
    """(side, valid_at) and FIELDS: violations that the touched entities can have part in.

    facts has a column side; the sides are judged apart, but at the edges of both. Between two edges nothing
    changes, so every valid time is covered.
    """
    own = facts.where(F.col("attribute") == F.lit(constraint.attribute)).withColumn("key", value_key())
    typed = facts.where(F.col("entity_type") == F.lit(constraint.entity_type)).select("side", "entity_id", "valid_from", "valid_to")
    name = type(constraint).__name__

    def shaped(rows: DataFrame, code: str, value: Column, actual: Column) -> DataFrame:
        return rows.select("side", F.col("t").alias("valid_at"), F.lit(name).alias("constraint"), F.lit(code).alias("code"), F.col("entity_id").alias("subject"), F.lit(constraint.attribute).alias("path"), value.cast("string").alias("value"), actual.cast("long").alias("actual"))

    if isinstance(constraint, (Required, Cardinality)):
        own, typed = own.join(touched, "entity_id", "left_semi"), typed.join(touched, "entity_id", "left_semi")
        edges = _edges(own, "entity_id").unionByName(_edges(typed, "entity_id")).distinct()
        there = _at(typed, edges, "entity_id").select("side", "entity_id", "t").distinct()
        held = _at(own, edges, "entity_id").groupBy("side", "entity_id", "t").agg(F.count(F.lit(1)).alias("n"))
        if isinstance(constraint, Required):
            return shaped(there.join(held, ["side", "entity_id", "t"], "left_anti"), "required", F.lit(None), F.lit(0))
        return shaped(there.join(held.where(F.col("n") > constraint.most), ["side", "entity_id", "t"]), "cardinality", F.lit(None), F.col("n"))
    if isinstance(constraint, Unique):
        own = own.join(own.join(touched, "entity_id", "left_semi").select("key").distinct(), "key", "left_semi")
        typed = typed.join(own.select("entity_id").distinct(), "entity_id", "left_semi")
        edges = _edges(own, "key").unionByName(_edges(own.select("key", "entity_id").distinct().join(typed, "entity_id"), "key")).distinct()
        claims = _at(own, edges, "key").select("side", "key", "entity_id", "t").distinct()
        there = _at(typed, claims.select("entity_id", "t").distinct(), "entity_id").select("side", "entity_id", "t").distinct()
        claims = claims.join(there, ["side", "entity_id", "t"])
        shared = claims.groupBy("side", "key", "t").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return shaped(claims.join(shared, ["side", "key", "t"]), "unique", F.col("key"), F.col("n"))
    points_here = own.where("value_type = 'ref'").join(touched.select(F.col("entity_id").alias("value_string")), "value_string", "left_semi")
    own = own.join(touched, "entity_id", "left_semi").unionByName(points_here.select(*own.columns)).distinct()
    typed = typed.join(own.select("entity_id").distinct(), "entity_id", "left_semi")
    targets = facts.where(F.col("entity_type") == F.lit(constraint.target_type)).select("side", F.col("entity_id").alias("value_string"), "valid_from", "valid_to")
    refs = own.where("value_type = 'ref'").select("entity_id", "key", "value_string").distinct()
    edges = _edges(own, "entity_id", "key").unionByName(_edges(own.select("entity_id", "key").distinct().join(typed, "entity_id"), "entity_id", "key")).unionByName(_edges(refs.join(targets, "value_string"), "entity_id", "key")).distinct()
    held = _at(own, edges, "entity_id", "key").select("side", "entity_id", "key", "value_type", "value_string", "t").distinct()
    there = _at(typed, edges.select("entity_id", "t").distinct(), "entity_id").select("side", "entity_id", "t").distinct()
    held = held.join(there, ["side", "entity_id", "t"])
    met = _at(targets, held.where("value_type = 'ref'").select("value_string", "t").distinct(), "value_string").select("side", "value_string", "t").distinct()
    loose = held.where("value_type <> 'ref'").unionByName(held.where("value_type = 'ref'").join(met, ["side", "value_string", "t"], "left_anti").select(*held.columns))
    return shaped(loose.select("side", "entity_id", "key", "t").distinct(), "reference-target", F.col("key"), F.lit(1))


#: Violations that an error names; it counts all.
NAMED = 1000


def enforce(live: DataFrame, asserted: DataFrame, ended: list[dict] | None, constraints: list) -> None:
    """Fails if the state after a change has violations, at any valid time, past ones too, that are new or worse.

    One plan over the facts of the constraints' attributes and types that share entities, values or targets
    with what is written.
    """
    spark = live.sparkSession
    names = {c.attribute for c in constraints}
    kinds = {c.entity_type for c in constraints} | {c.target_type for c in constraints if isinstance(c, ReferenceTarget)}
    touching = F.col("attribute").isin(*names) | F.coalesce(F.col("entity_type").isin(*kinds), F.lit(False))
    before = live.select(*asserted.columns).where(touching)
    touched = asserted.select("entity_id")
    after = before
    if ended:
        gone = spark.createDataFrame([(e["triple_id"], e["entity_id"]) for e in ended], "triple_id string, entity_id string")
        after = before.join(gone.select("triple_id"), "triple_id", "left_anti").select(*asserted.columns)
        touched = touched.unionByName(gone.select("entity_id"))
    touched = touched.distinct()
    both = before.withColumn("side", F.lit(0)).unionByName(after.unionByName(asserted.where(touching)).withColumn("side", F.lit(1)))
    found = reduce(DataFrame.unionByName, (violations_over_time(both, c, touched) for c in constraints))
    on = lambda side: F.max(F.when(F.col("side") == side, F.col("actual")))
    key = ["constraint", "subject", "path", "code", "value", "valid_at"]
    worse = found.groupBy(*key).agg(on(0).alias("was"), on(1).alias("actual")).where("actual is not null and (was is null or actual > was)")
    rows = worse.orderBy(*key).limit(NAMED).collect()
    if rows:
        more = worse.count() if len(rows) == NAMED else len(rows)
        raise ConstraintViolated([{k: r[k] for k in (*key, "actual")} for r in rows], more)
