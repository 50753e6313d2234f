"""A synthetic workload of N employees as facts, and its lookups, scans and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.plans.build import run
from chronofact.sources.basis import Basis
from chronofact.sources.facts import FACTS, FactTable, Wanted
from chronofact.sources.store import Assert, FactStore, Meta, RetractPattern

DEPARTMENTS, TITLES, PLACES = 8, 6, 5
KINDS = {":name": "txt", ":email": "txt", ":age": "num", ":salary": "num", ":department": "txt", ":title": "txt", ":active": "bool", ":hire_date": "num", ":location": "txt", ":manager": "txt"}


def employees(spark: SparkSession, n: int) -> DataFrame:
    """Nine facts an employee and a manager for every fifth, in the wide layout."""
    i = F.col("id")
    values = [
        (":name", "string", F.concat(F.lit("Employee "), i)), (":email", "string", F.concat(F.lit("e"), i, F.lit("@example.org"))), (":age", "number", 25 + i % 40), (":salary", "number", 50_000 + (i * 137) % 100_000),
        (":department", "string", F.concat(F.lit("department-"), i % DEPARTMENTS)), (":title", "string", F.concat(F.lit("title-"), i % TITLES)), (":active", "boolean", i % 10 != 0), (":hire_date", "datetime", F.lit(1_500_000_000_000) + i * 86_400),
        (":location", "string", F.concat(F.lit("place-"), i % PLACES)), (":manager", "ref", F.when((i % 5 == 0) & (i > 0), F.concat(F.lit("employee:"), F.floor(i / 5)))),
    ]
    column = {"string": "value_string", "ref": "value_string", "number": "value_number", "boolean": "value_boolean", "datetime": "value_datetime"}
    kinds = {"value_string": "string", "value_number": "double", "value_boolean": "boolean", "value_datetime": "long"}
    cells = F.array(*(F.struct(F.lit(a).alias("attribute"), F.lit(t).alias("value_type"), *((v if column[t] == c else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()), v.isNotNull().alias("there")) for a, t, v in values))
    rows = spark.range(n).select(F.concat(F.lit("employee:"), i).alias("entity_id"), F.inline(cells)).where("there")
    fixed = {"triple_id": F.upper(F.substring(F.sha2(F.concat_ws("|", "entity_id", "attribute"), 256), 1, 26)), "value_json": F.lit(None).cast("string"), "recorded_at": F.lit(0).cast("long"), "recorded_position": F.lit(1).cast("long"), "valid_from": F.lit(0).cast("long"), "valid_to": F.lit(None).cast("long"), "created_by": F.lit(None).cast("string"), "schema_version": F.lit(1), "tx_id": F.lit("_tx/1")}
    fixed |= {"entity_type": F.when(F.col("attribute") == ":name", F.lit("Employee")), "retracted_at": F.lit(None).cast("long"), "retracted_position": F.lit(None).cast("long"), "retract_tx_id": F.lit(None).cast("string")}
    return rows.withColumns(fixed).select(*FACTS.names)


def load(spark: SparkSession, n: int, root: str) -> FactStore:
    """N employees by one bulk commit, folded into a run clustered by (attribute, entity)."""
    s = FactStore(spark, root)
    s.ingest(employees(spark, n).drop("triple_id", "recorded_at", "recorded_position", "schema_version", "tx_id", "retracted_at", "retracted_position", "retract_tx_id"), Meta(actor="load"))
    s.fold()
    return s


def commit(s: FactStore, times: int) -> None:
    """So many journaled transactions of two facts."""
    for i in range(times):
        s.transact([Assert(f"visit:{i}", ":guest", {"type": "ref", "value": f"employee:{i}"}, "Visit"), Assert(f"visit:{i}", ":day", i)], Meta(actor="desk"))


def update(s: FactStore, first: int, employees: int) -> int:
    """Replaces five attributes of each of some employees in one transaction: retract by pattern, assert anew."""
    ops = []
    for i in range(first, first + employees):
        for attribute, value in ((":salary", 60_000 + i), (":age", 30 + i % 30), (":title", "title-9"), (":hire_date", {"type": "datetime", "value": 1_600_000_000_000 + i}), (":active", i % 2 == 0)):
            ops += [RetractPattern(f"employee:{i}", attribute), Assert(f"employee:{i}", attribute, value)]
    return s.transact(ops, Meta(actor="update")).retracted


def view(s: FactStore) -> FactTable:
    return s.source(Basis(valid_at=4_000_000_000_000), KINDS)


def queries(s: FactTable, n: int) -> dict:
    q = lambda find, where, **more: lambda: run(s, {"find": find, "where": where, **more})
    return {
        "q1_entity_lookup": lambda: s.matching(Wanted(entity=f"employee:{n // 2}")),
        "q2_attribute_scan": lambda: s.matching(Wanted(attribute=":name")).select("entity_id", "value_string"),
        "q3_type_filter": lambda: s.matching(Wanted(entity_type="Employee")).select("entity_id", "value_string"),
        "q4_attribute_value": lambda: s.matching(Wanted(attribute=":department", value="department-3")).select("entity_id"),
        "q5_ref_lookup": lambda: s.matching(Wanted(attribute=":manager", value=f"employee:{n // 10}", is_ref=True)).select("entity_id"),
        "q6_boolean_filter": lambda: s.matching(Wanted(attribute=":active", value=True)).select("entity_id"),
        "d1_one_pattern": q(["?e", "?n"], [["?e", ":name", "?n"]]),
        "d2_two_patterns": q(["?n", "?d"], [["?e", ":name", "?n"], ["?e", ":department", "?d"]]),
        "d3_join_predicate": q(["?n", "?s"], [["?e", ":name", "?n"], ["?e", ":salary", "?s"], [">", "?s", 100_000]]),
        "d4_bound_value": q(["?n", "?t"], [["?e", ":department", "department-3"], ["?e", ":name", "?n"], ["?e", ":title", "?t"]]),
        "d5_group_count": q(["?d", "?n"], [["?e", ":department", "?d"]], aggregate=[["count", "?e", "?n"]]),
        "d6_ref_traversal": q(["?n", "?m"], [["?e", ":manager", "?b"], ["?e", ":name", "?n"], ["?b", ":name", "?m"]]),
    }
