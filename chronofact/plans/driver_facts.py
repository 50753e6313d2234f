"""Driver queries over the wide fact layout: time, journal, constraints, derivations, snapshots, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.functions import boolexpr as B
from chronofact.functions import types
from chronofact.operators import browse, config, constraints, derivation
from chronofact.plans.build import run
from chronofact.plans.catalog import tables
from chronofact.plans.driver import QUERIES, SQL, add
from chronofact.sources.basis import Basis, visible
from chronofact.sources.facts import FactTable, Wanted
from chronofact.sources.store import Assert, dependency_state
from chronofact.streaming.subscriptions import Subscriptions

DAY = 86_400_000
T = 946_684_800_000  # 2000-01-01
NOW = Basis(valid_at=4_000_000_000_000)


def wide(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return tables(spark, sf_dir, *names).facts()


def orders_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of orders, recorded on their date; those of status F are retracted thirty days later."""
    dates = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("orders:"), F.col("o_orderkey")).alias("entity_id"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)").alias("t"), (F.col("o_orderstatus") == "F").alias("ends"))
    facts = wide(spark, sf_dir, "orders").join(dates, "entity_id")
    day = F.expr(f"t div {DAY}")
    return facts.withColumns({"recorded_at": F.col("t"), "recorded_position": day, "valid_from": F.col("t"), "retracted_at": F.when(F.col("ends"), F.col("t") + 30 * DAY), "retracted_position": F.when(F.col("ends"), day + 30)}).drop("t", "ends")


def counted(basis: Basis):
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = {"find": ["?n", "?s"], "where": [["?o", ":orders/totalprice", "?t"]], "aggregate": [["count", "?o", "?n"], ["max", "?t", "?s"]]}
        return run(FactTable(orders_over_time(spark, sf_dir), basis, {":orders/totalprice": "num"}), q, {"?n": "bigint"})

    return call


add("as_of_recorded", f"SELECT count(*) AS n, max(o_totalprice) AS s FROM orders WHERE epoch_ms(o_orderdate) <= {T} AND NOT (o_orderstatus = 'F' AND epoch_ms(o_orderdate) + {30 * DAY} <= {T})", counted(Basis(recorded_at=T, valid_at=T)))
add("as_of_position", f"SELECT count(*) AS n, max(o_totalprice) AS s FROM orders WHERE epoch_ms(o_orderdate) // {DAY} <= {T // DAY} AND NOT (o_orderstatus = 'F' AND epoch_ms(o_orderdate) // {DAY} + 30 <= {T // DAY})", counted(Basis(recorded_position=T // DAY, valid_at=4 * T)))
add("as_of_valid", f"SELECT count(*) AS n, max(o_totalprice) AS s FROM orders WHERE o_orderstatus <> 'F' AND epoch_ms(o_orderdate) <= {T}", counted(Basis(valid_at=T)))
add("facts_star_join", "SELECT DISTINCT p_name AS name, p_brand AS brand, CAST(p_size AS DOUBLE) AS size FROM part", lambda spark, sf_dir: run(FactTable(wide(spark, sf_dir, "part"), NOW, {":part/name": "txt", ":part/brand": "txt", ":part/size": "num"}), {"find": ["?name", "?brand", "?size"], "where": [["?p", ":part/name", "?name"], ["?p", ":part/brand", "?brand"], ["?p", ":part/size", "?size"]]}))
add("facts_dynamic_values", "SELECT ':part/size' AS a, count(DISTINCT p_size) AS n FROM part UNION ALL SELECT ':part/brand', count(DISTINCT p_brand) FROM part UNION ALL SELECT ':part/type', count(DISTINCT p_type) FROM part UNION ALL SELECT ':part/name', count(DISTINCT p_name) FROM part UNION ALL SELECT ':part/retailprice', count(DISTINCT p_retailprice) FROM part", lambda spark, sf_dir: run(FactTable(wide(spark, sf_dir, "part"), NOW), {"find": ["?a", "?n"], "where": [["?p", "?a", "?v"]], "aggregate": [["count", "?v", "?n"]]}, {"?n": "bigint"}))
add("optional_first_value", "SELECT 'documents:' || d.doc_id AS d, CAST(l.toxic AS DOUBLE) AS t FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", lambda spark, sf_dir: _optional(spark, sf_dir))
add("entity_types", "SELECT 'Nation' AS entity_type, count(*) AS entities FROM nation UNION ALL SELECT 'Region', count(*) FROM region", lambda spark, sf_dir: browse.entity_types(wide(spark, sf_dir, "nation", "region")).select("entity_type", "entities"))


def _optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronofact.sources.facts import TableFacts, table_spec

    docs = table_spec(spark.read.parquet(f"{sf_dir}/documents.parquet"), "documents", "doc_id", skip=("text", "source", "n_chars"))
    marks = table_spec(spark.read.parquet(f"{sf_dir}/labels.parquet"), "documents", "doc_id")
    facts = TableFacts(spark, docs, marks).facts()
    return run(FactTable(facts, NOW), {"find": ["?d", "?t"], "where": [["?d", ":documents/lang", "?l"]], "optionalProjection": {"rowBinding": "?d", "fields": [{"attribute": ":documents/toxic", "variable": "?t"}]}}, {"?t": "double"})


def _dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dependency_state(orders_over_time(spark, sf_dir), [":orders/totalprice"], Basis(recorded_at=T, valid_at=T - 365 * DAY))
    return spark.createDataFrame([(s["source_position"], s["next_boundary"])], "source_position long, next_boundary long")


add(
    "dependency_state",
    f"""WITH o AS (SELECT epoch_ms(o_orderdate) AS t, CASE WHEN o_orderstatus = 'F' THEN epoch_ms(o_orderdate) + {30 * DAY} END AS e FROM orders)
SELECT max(greatest(CASE WHEN t <= {T} THEN t // {DAY} END, CASE WHEN e <= {T} THEN t // {DAY} + 30 END)) AS source_position,
       min(CASE WHEN t <= {T} AND (e IS NULL OR e > {T}) AND t > {T - 365 * DAY} THEN t END) AS next_boundary FROM o""",
    _dependency,
)

# --- constraints -----------------------------------------------------------------------------------------


def _violations(names: str, constraint, *columns: str):
    return lambda spark, sf_dir: constraints.evaluate(wide(spark, sf_dir, *names.split()), [constraint]).select(*columns)


def _orders_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer facts with one :customer/order reference for each order."""
    orders = wide(spark, sf_dir, "orders").where("attribute = ':orders/custkey'")
    swapped = orders.withColumns({"entity_id": F.col("value_string"), "value_string": F.col("entity_id"), "attribute": F.lit(":customer/order"), "entity_type": F.lit(None).cast("string")})
    return wide(spark, sf_dir, "customer").unionByName(swapped)


add("constraint_required", "SELECT 'customer:' || c_custkey AS subject, 'required' AS code FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 10 = 0)", lambda spark, sf_dir: constraints.evaluate(_orders_of(spark, sf_dir).where("attribute <> ':customer/order' or value_string like '%0'"), [constraints.Required("Customer", ":customer/order")]).select("subject", "code"))
add("constraint_cardinality", "SELECT 'customer:' || o_custkey AS subject, count(*) AS actual FROM orders GROUP BY 1 HAVING count(*) > 3", lambda spark, sf_dir: constraints.evaluate(_orders_of(spark, sf_dir), [constraints.Cardinality("Customer", ":customer/order", 3)]).select("subject", "actual"))
add("constraint_unique", "SELECT 'part:' || p_partkey AS subject, n AS actual FROM part JOIN (SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1) USING (p_name)", _violations("part", constraints.Unique("Part", ":part/name"), "subject", "actual"))
add("constraint_reference_target", "SELECT 'labels:' || doc_id AS subject, 'reference-target' AS code FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')", lambda spark, sf_dir: constraints.evaluate(wide(spark, sf_dir, "labels").unionByName(wide(spark, sf_dir, "documents").where("attribute = ':documents/lang' and value_string = 'en'")), [constraints.ReferenceTarget("Labels", ":labels/doc_id", "Documents")]).select("subject", "code"))

# --- derivations -----------------------------------------------------------------------------------------
OPEN = {"find": ["?o", "?t"], "where": [["?o", ":orders/orderstatus", "O"], ["?o", ":orders/totalprice", "?t"], [">", "?t", 300000]]}
KINDS = {":orders/orderstatus": "txt", ":orders/totalprice": "num"}


def _open_orders(spark: SparkSession, sf_dir: str, at_least: float = 300000) -> DataFrame:
    q = {**OPEN, "where": [*OPEN["where"][:2], [">", "?t", at_least]]}
    return derivation.evaluate(FactTable(wide(spark, sf_dir, "orders"), NOW, KINDS), derivation.Derivation.make("open", q, ["?o"]))


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _open_orders(spark, sf_dir, 300000), _open_orders(spark, sf_dir, 400000)
    named = derivation.reconcile(a, b).join(a.select("candidate_id", F.col("identity.o.txt").alias("o")), "candidate_id")
    return named.select("o", F.when(F.col("change") == "removed", "removed").otherwise("kept").alias("change"))


def _what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = FactTable(wide(spark, sf_dir, "orders"), NOW, KINDS)
    made = [Assert("orders:new", ":orders/orderstatus", "O"), Assert("orders:new", ":orders/totalprice", 999999)]
    return derivation.overlay(source, derivation.Derivation.make("open", OPEN, ["?o"]), made).select(F.col("identity.o.txt").alias("o"), F.col("result.t.num").alias("t"))


add("derivation_candidates", "SELECT 'orders:' || o_orderkey AS o, o_totalprice AS t, 2::BIGINT AS sources FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 300000", lambda spark, sf_dir: _open_orders(spark, sf_dir).select(F.col("identity.o.txt").alias("o"), F.col("result.t.num").alias("t"), F.size("sources").cast("long").alias("sources")))
add("derivation_reconcile", "SELECT 'orders:' || o_orderkey AS o, CASE WHEN o_totalprice > 400000 THEN 'kept' ELSE 'removed' END AS change FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 300000", _reconciled)
add("derivation_overlay", "SELECT 'orders:' || o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 300000 UNION ALL SELECT 'orders:new', 999999", _what_if)



# --- three-valued rules ----------------------------------------------------------------------------------
CATALOG = {"vip": B.All((B.Eq(":customer/mktsegment", "BUILDING"), B.Not(B.Rule("poor")))), "poor": B.Exists(":customer/flag")}
STRICT = {**CATALOG, "poor": B.Eq(":customer/nationkey", "nation:3")}
add("rule_three_valued", "SELECT 'customer:' || c_custkey AS subject, c_mktsegment = 'BUILDING' AS vip, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE false END AS unknown FROM customer", lambda spark, sf_dir: B.decide(wide(spark, sf_dir, "customer"), {"vip": B.Rule("vip"), "unknown": B.All((B.Eq(":customer/nothing", 1), B.Eq(":customer/mktsegment", "BUILDING")))}, T, CATALOG, "Customer"))
add("rule_before", f"SELECT 'orders:' || o_orderkey AS subject, epoch_ms(o_orderdate) // {DAY} < {T // DAY} AS due FROM orders", lambda spark, sf_dir: B.decide(wide(spark, sf_dir, "orders"), {"due": B.Before(":orders/orderdate")}, T + 5, None, "Orders"))
add("deploy_impact", "SELECT 'customer:' || c_custkey AS subject, true AS old, false AS new FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3", lambda spark, sf_dir: B.deploy_impact(wide(spark, sf_dir, "customer"), "vip", CATALOG, STRICT, T, "Customer"))


def _affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = Subscriptions()
    subs.register("segments", {"find": ["?c"], "where": [["?c", ":customer/mktsegment", "BUILDING"]]})
    subs.register("orders", {"find": ["?o"], "where": [["?o", ":orders/custkey", "?c"]]})
    subs.register("one", {"find": ["?a"], "where": [["customer:1", "?a", "?v"]]})
    subs.register("other", {"find": ["?a"], "where": [["customer:none", "?a", "?v"]]})
    return subs.affected(wide(spark, sf_dir, "customer").where(visible(NOW)).select("entity_id", "attribute", "entity_type"))


def _wake_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When time alone changes what subscriptions see next; orders hold from their date on."""
    subs = Subscriptions()
    subs.register("totals", {"find": ["?o"], "where": [["?o", ":orders/totalprice", "?t"]]})
    subs.register("one", {"find": ["?a"], "where": [["orders:1", "?a", "?v"]]})
    subs.register("never", {"find": ["?p"], "where": [["?p", ":part/size", "?s"]]})
    return subs.boundaries(orders_over_time(spark, sf_dir).where("retracted_at is null"), T - 365 * DAY)


add("wake_up", f"SELECT 'totals' AS subscription, min(epoch_ms(o_orderdate)) AS next_boundary FROM orders WHERE o_orderstatus <> 'F' AND epoch_ms(o_orderdate) > {T - 365 * DAY} UNION ALL SELECT 'one', min(epoch_ms(o_orderdate)) FILTER (WHERE o_orderkey = 1 AND o_orderstatus <> 'F' AND epoch_ms(o_orderdate) > {T - 365 * DAY}) FROM orders UNION ALL SELECT 'never', NULL", _wake_up)
add("affected_subscriptions", "SELECT unnest(['segments', 'one']) AS subscription", _affected)


# --- validation and browsing ---------------------------------------------------------------


def _customer_type():
    text, number = types.Prim("text"), types.Prim("number")
    return config.EntityType("Customer", (config.Attribute(":customer/name", text, required=True), config.Attribute(":customer/acctbal", types.Constrained(number, (("min", 0),))), config.Attribute(":customer/mktsegment", types.Enum(("BUILDING", "MACHINERY", "AUTOMOBILE", "HOUSEHOLD", "FURNITURE"))), config.Attribute(":customer/nationkey", types.RefType("Nation"))))


add("entity_type_scan", "SELECT count(*) * 5 AS n FROM part", lambda spark, sf_dir: FactTable(wide(spark, sf_dir, "part", "nation"), NOW).matching(Wanted(entity_type="Part")).agg(F.count(F.lit(1)).alias("n")))
add("entity_validation", "SELECT 'customer:' || c_custkey AS subject, ':customer/acctbal' AS path, 'schema' AS source FROM customer WHERE c_acctbal < 0", lambda spark, sf_dir: config.validate(wide(spark, sf_dir, "customer"), _customer_type(), NOW).select("subject", "path", "source"))
add("reflected_columns", "SELECT unnest([':part/name', ':part/brand', ':part/type', ':part/size', ':part/retailprice']) AS attribute, unnest(['string', 'string', 'string', 'number', 'number']) AS value_type", lambda spark, sf_dir: browse.reflected_columns(wide(spark, sf_dir, "part"), "Part"))
add("rule_proofs", "SELECT 'customer:' || c_custkey AS subject, c_mktsegment = 'BUILDING' AS truth FROM customer", lambda spark, sf_dir: B.prove(wide(spark, sf_dir, "customer"), B.Rule("vip"), T, CATALOG, "Customer").select("subject", "truth"))
add("json_values", "SELECT 'events:' || event_id AS e, props FROM events", lambda spark, sf_dir: run(tables(spark, sf_dir, "events"), {"find": ["?e", "?props"], "where": [["?e", ":events/props", "?props"]]}))
add("events_valid_at", "SELECT event_type AS kind, count(DISTINCT event_id) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1", lambda spark, sf_dir: _events(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events hold from their own time on."""
    facts = wide(spark, sf_dir, "events")
    times = facts.where("attribute = ':events/ts'").select("entity_id", F.col("value_datetime").alias("from"))
    timed = facts.where("attribute = ':events/event_type'").join(times, "entity_id").withColumn("valid_from", F.col("from")).drop("from")
    at = Basis(valid_at=1_705_276_800_000)
    return run(FactTable(timed, at, {":events/event_type": "txt"}), {"find": ["?kind", "?n"], "where": [["?e", ":events/event_type", "?kind"]], "aggregate": [["count", "?e", "?n"]]}, {"?n": "bigint"})


__all__ = ["QUERIES", "SQL"]
