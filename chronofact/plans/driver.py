"""Driver queries of the query language; the SQL is what DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronofact.plans.catalog import query, tables
from chronofact.plans.page import run_page

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str, call) -> None:
    QUERIES[name], SQL[name] = call, sql


def paged(names: str, inner: dict, types: dict[str, str] | None = None, pages: int = 1, **wrapped):
    """The pages-th page of a wrapped query."""

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, cursor = tables(spark, sf_dir, *names.split()), None
        for _ in range(pages):
            page = run_page(source, {"inner": inner, **wrapped, **({"cursor": cursor} if cursor else {})}, types=types)
            cursor = page.next_cursor
        return page.frame

    return call


# --- patterns and predicates -----------------------------------------------------------------------------
add("pattern_scan", "SELECT DISTINCT n_name AS name FROM nation", query("nation", find=["?name"], where=[["?n", ":nation/name", "?name"]]))
add("pattern_const_text", "SELECT DISTINCT 'customer:' || c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'", query("customer", find=["?c"], where=[["?c", ":customer/mktsegment", "BUILDING"]]))
add("pattern_const_number", "SELECT DISTINCT 'part:' || p_partkey AS p FROM part WHERE p_size = 15", query("part", find=["?p"], where=[["?p", ":part/size", 15]]))
add("pattern_family_mismatch", "SELECT CAST(0 AS BIGINT) AS n", query("part", {"?n": "bigint"}, find=["?n"], where=[["?p", ":part/size", "15"]], aggregate=[["count", "?p", "?n"]]))
add("pattern_repeated_variable", "SELECT DISTINCT n_name AS x FROM nation", query("nation", find=["?x"], where=[["?n", ":nation/name", "?x"], ["?n", ":nation/name", "?x"]]))
add("pattern_transaction", "SELECT DISTINCT n_name AS name, '_tx/00000000000000000000000000' AS tx FROM nation", query("nation", find=["?name", "?tx"], where=[["?n", ":nation/name", "?name", "?tx"]]))
add("ref_constant", "SELECT DISTINCT n_name AS name FROM nation WHERE n_regionkey = 1", query("nation", find=["?name"], where=[["?n", ":nation/regionkey", {"type": "ref", "value": "region:1"}], ["?n", ":nation/name", "?name"]]))
add("entity_lookup", "SELECT ':customer/name' AS a, c_name AS v FROM customer WHERE c_custkey = 1 UNION ALL SELECT ':customer/mktsegment', c_mktsegment FROM customer WHERE c_custkey = 1 UNION ALL SELECT ':customer/nationkey', 'nation:' || c_nationkey FROM customer WHERE c_custkey = 1 UNION ALL SELECT ':customer/acctbal', NULL FROM customer WHERE c_custkey = 1", query("customer", {"?v": "string"}, find=["?a", "?v"], where=[["customer:1", "?a", "?v"]]))
add("attribute_variable", "SELECT unnest([':part/name', ':part/brand', ':part/type', ':part/size', ':part/retailprice']) AS a", query("part", find=["?a"], where=[["?p", "?a", "?v"]]))
add("star_join", "SELECT DISTINCT p_name AS name, p_brand AS brand, CAST(p_size AS DOUBLE) AS size FROM part", query("part", find=["?name", "?brand", "?size"], where=[["?p", ":part/name", "?name"], ["?p", ":part/brand", "?brand"], ["?p", ":part/size", "?size"]]))
add("ref_join", "SELECT DISTINCT c_name AS cust, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey", query("customer nation", find=["?cust", "?nation"], where=[["?c", ":customer/name", "?cust"], ["?c", ":customer/nationkey", "?n"], ["?n", ":nation/name", "?nation"]]))
add("multi_hop", "SELECT DISTINCT c_name AS cust, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", query("customer nation region", find=["?cust", "?region"], where=[["?c", ":customer/name", "?cust"], ["?c", ":customer/nationkey", "?n"], ["?n", ":nation/regionkey", "?r"], ["?r", ":region/name", "?region"]]))
add("value_join", "SELECT DISTINCT c_name AS cust, s_name AS supp FROM customer JOIN supplier ON c_nationkey = s_nationkey", query("customer supplier", find=["?cust", "?supp"], where=[["?c", ":customer/nationkey", "?n"], ["?s", ":supplier/nationkey", "?n"], ["?c", ":customer/name", "?cust"], ["?s", ":supplier/name", "?supp"]]))
add("number_join", "SELECT DISTINCT p_partkey AS p, o_orderkey AS o FROM (SELECT 'part:' || p_partkey AS p_partkey, p_size FROM part) JOIN (SELECT 'lineitem:' AS x, 'orders:' || l_orderkey AS o_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_discount = 0.1) ON p_size = l_quantity", query("part lineitem", find=["?p", "?o"], where=[["?p", ":part/size", "?x"], ["?l", ":lineitem/quantity", "?x"], ["?l", ":lineitem/returnflag", "R"], ["?l", ":lineitem/discount", 0.1], ["?l", ":lineitem/orderkey", "?o"]]))
add("theta_join", "SELECT DISTINCT c_name AS cust, s_name AS supp FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_acctbal > c_acctbal", query("customer supplier", find=["?cust", "?supp"], where=[["?c", ":customer/nationkey", "?n"], ["?s", ":supplier/nationkey", "?n"], ["?c", ":customer/name", "?cust"], ["?s", ":supplier/name", "?supp"], ["?c", ":customer/acctbal", "?cb"], ["?s", ":supplier/acctbal", "?sb"], [">", "?sb", "?cb"]]))
add("cross_product", "SELECT DISTINCT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b", query("region", find=["?x", "?y"], where=[["?a", ":region/name", "?x"], ["?b", ":region/name", "?y"]]))
add("pred_eq", "SELECT DISTINCT s_name AS name FROM supplier WHERE s_nationkey = 3", query("supplier", find=["?name"], where=[["?s", ":supplier/name", "?name"], ["?s", ":supplier/nationkey", "?n"], ["=", "?n", "nation:3"]]))
add("pred_neq", "SELECT DISTINCT c_name AS name FROM customer WHERE c_mktsegment <> 'BUILDING'", query("customer", find=["?name"], where=[["?c", ":customer/name", "?name"], ["?c", ":customer/mktsegment", "?s"], ["!=", "?s", "BUILDING"]]))
add("pred_neq_cross_family", "SELECT DISTINCT p_brand AS brand FROM part", query("part", find=["?brand"], where=[["?p", ":part/brand", "?brand"], ["!=", "?brand", 7]]))
add("pred_range", "SELECT DISTINCT 'part:' || p_partkey AS p, p_retailprice AS price FROM part WHERE p_retailprice >= 901 AND p_retailprice < 1500 AND p_size <= 40", query("part", find=["?p", "?price"], where=[["?p", ":part/retailprice", "?price"], ["?p", ":part/size", "?s"], [">=", "?price", 901], ["<", "?price", 1500], ["<=", "?s", 40]]))
add("pred_datetime", "SELECT DISTINCT 'orders:' || o_orderkey AS o FROM orders WHERE epoch_ms(o_orderdate) >= 946684800000", query("orders", find=["?o"], where=[["?o", ":orders/orderdate", "?d"], [">=", "?d", 946684800000]]))
add("find_constant", "SELECT DISTINCT n_name AS name, 'x' AS x FROM nation", query("nation", find=["?name", "x"], where=[["?n", ":nation/name", "?name"]]))

# --- negation and disjunction ----------------------------------------------------------------------------
add("not_exists", "SELECT DISTINCT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", query("customer orders", find=["?name"], where=[["?c", ":customer/name", "?name"], ["not", ["?o", ":orders/custkey", "?c"], ["?o", ":orders/orderstatus", "P"]]]))
add("not_single", "SELECT DISTINCT 'documents:' || doc_id AS d FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)", query("documents labels", find=["?d"], where=[["?d", ":documents/lang", "?lang"], ["not", ["?x", ":labels/doc_id", "?d"]]]))
add("not_conjunctive", "SELECT DISTINCT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000)", query("customer orders", find=["?name"], where=[["?c", ":customer/name", "?name"], ["not", ["?o", ":orders/custkey", "?c"], ["?o", ":orders/orderstatus", "F"], ["?o", ":orders/totalprice", "?t"], [">", "?t", 300000]]]))
add("not_correlated_predicate", "SELECT DISTINCT s_name AS name FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal < s_acctbal)", query("customer supplier", find=["?name"], where=[["?s", ":supplier/name", "?name"], ["?s", ":supplier/nationkey", "?n"], ["?s", ":supplier/acctbal", "?b"], ["not", ["?c", ":customer/nationkey", "?n"], ["?c", ":customer/acctbal", "?cb"], ["<", "?cb", "?b"]]]))
add("not_predicate", "SELECT DISTINCT c_name AS name FROM customer WHERE NOT (c_acctbal > 0 AND c_mktsegment = 'BUILDING')", query("customer", find=["?name"], where=[["?c", ":customer/name", "?name"], ["?c", ":customer/acctbal", "?b"], ["?c", ":customer/mktsegment", "?s"], ["not", [">", "?b", 0], ["=", "?s", "BUILDING"]]]))
add("not_global", "SELECT DISTINCT r_name AS name FROM region WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size = 1000)", query("region part", find=["?name"], where=[["?r", ":region/name", "?name"], ["not", ["?p", ":part/size", 1000]]]))
add("or_patterns", "SELECT DISTINCT c_name AS name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", query("customer", find=["?name"], where=[["?c", ":customer/name", "?name"], ["or", [["?c", ":customer/mktsegment", "BUILDING"], ["?c", ":customer/mktsegment", "MACHINERY"]]]]))
add("or_correlated_predicate", "SELECT DISTINCT s_name AS name FROM supplier WHERE s_acctbal < 0 OR NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > s_acctbal)", query("customer supplier", find=["?name"], where=[["?s", ":supplier/name", "?name"], ["?s", ":supplier/nationkey", "?n"], ["?s", ":supplier/acctbal", "?b"], ["or", [["<", "?b", 0], ["not", ["?c", ":customer/nationkey", "?n"], ["?c", ":customer/acctbal", "?cb"], [">", "?cb", "?b"]]]]]))
add("or_mixed", "SELECT DISTINCT c_name AS name FROM customer WHERE c_acctbal > 9000 OR c_mktsegment = 'BUILDING' OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", query("customer orders", find=["?name"], where=[["?c", ":customer/name", "?name"], ["?c", ":customer/acctbal", "?b"], ["or", [[">", "?b", 9000], ["?c", ":customer/mktsegment", "BUILDING"], ["not", ["?o", ":orders/custkey", "?c"], ["?o", ":orders/orderstatus", "P"]]]]]))

# --- aggregates ------------------------------------------------------------------------------------------
BIG = {"?n": "bigint", "?sizes": "bigint"}
add("agg_count_distinct", "SELECT p_brand AS brand, count(DISTINCT p_size) AS sizes FROM part GROUP BY 1", query("part", BIG, find=["?brand", "?sizes"], where=[["?p", ":part/brand", "?brand"], ["?p", ":part/size", "?size"]], aggregate=[["count", "?size", "?sizes"]]))
add("agg_sum_avg_min_max", "SELECT l_returnflag AS rf, l_linestatus AS ls, sum(l_quantity) AS s, avg(l_quantity) AS a, min(l_quantity) AS mn, max(l_quantity) AS mx FROM lineitem GROUP BY 1, 2", query("lineitem", find=["?rf", "?ls", "?s", "?a", "?mn", "?mx"], where=[["?l", ":lineitem/returnflag", "?rf"], ["?l", ":lineitem/linestatus", "?ls"], ["?l", ":lineitem/quantity", "?q"]], aggregate=[["sum", "?q", "?s"], ["avg", "?q", "?a"], ["min", "?q", "?mn"], ["max", "?q", "?mx"]]))
add("agg_global", "SELECT count(DISTINCT o_custkey) AS n, max(o_totalprice) AS mx FROM orders", query("orders", BIG, find=["?n", "?mx"], where=[["?o", ":orders/custkey", "?c"], ["?o", ":orders/totalprice", "?t"]], aggregate=[["count", "?c", "?n"], ["max", "?t", "?mx"]]))
add("agg_empty", "SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS s", query("orders", BIG, find=["?n", "?s"], where=[["?o", ":orders/nothing", "?c"]], aggregate=[["count", "?o", "?n"], ["sum", "?c", "?s"]]))
add("agg_bag_over_join", "SELECT n_name AS nation, sum(o_totalprice) AS total, count(DISTINCT c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1", query("customer nation orders", BIG, find=["?nation", "?total", "?n"], where=[["?c", ":customer/nationkey", "?k"], ["?k", ":nation/name", "?nation"], ["?o", ":orders/custkey", "?c"], ["?o", ":orders/totalprice", "?t"]], aggregate=[["sum", "?t", "?total"], ["count", "?c", "?n"]]))
add("having", "SELECT p_brand AS brand, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) >= 90", query("part", BIG, find=["?brand", "?n"], where=[["?p", ":part/brand", "?brand"]], aggregate=[["count", "?p", "?n"]], having=[[">=", "?n", 90]]))
add("having_group_key", "SELECT p_size AS size, count(*) AS n FROM (SELECT CAST(p_size AS DOUBLE) AS p_size, p_partkey FROM part) GROUP BY 1 HAVING p_size > 25 AND count(*) <> 40", query("part", BIG, find=["?size", "?n"], where=[["?p", ":part/size", "?size"]], aggregate=[["count", "?p", "?n"]], having=[[">", "?size", 25], ["!=", "?n", 40]]))

# --- order, limits, optional -----------------------------------------------------------------------------
add("order_limit_offset", "SELECT c_name AS name, c_acctbal AS bal FROM (SELECT DISTINCT c_name, c_acctbal FROM customer) ORDER BY bal DESC, name LIMIT 10 OFFSET 5", query("customer", find=["?name", "?bal"], where=[["?c", ":customer/name", "?name"], ["?c", ":customer/acctbal", "?bal"]], orderBy=[{"variable": "?bal", "direction": "desc"}, {"variable": "?name"}], limit=10, offset=5))
add("mixed_order", "SELECT * FROM (SELECT DISTINCT CAST(p_size AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS txt FROM part UNION ALL SELECT DISTINCT NULL, p_brand FROM part) ORDER BY txt IS NOT NULL, num DESC, txt DESC LIMIT 60", lambda spark, sf_dir: _mixed(spark, sf_dir))
add("optional_projection", "SELECT DISTINCT 'documents:' || d.doc_id AS d, CAST(l.toxic AS DOUBLE) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", lambda spark, sf_dir: _optional(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronofact.plans.build import run

    q = {"find": ["?v"], "where": [["?p", "?a", "?v"], ["or", [["=", "?a", ":part/size"], ["=", "?a", ":part/brand"]]]], "orderBy": [{"variable": "?v", "direction": "desc"}], "limit": 60}
    frame = run(tables(spark, sf_dir, "part"), q)
    return frame.selectExpr("v.num AS num", "v.txt AS txt")


def _optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronofact.plans.build import run
    from chronofact.sources.facts import TableFacts, table_spec

    docs = table_spec(spark.read.parquet(f"{sf_dir}/documents.parquet"), "documents", "doc_id", skip=("text",))
    marks = table_spec(spark.read.parquet(f"{sf_dir}/labels.parquet"), "documents", "doc_id", skip=("quality",))
    return run(TableFacts(spark, docs, marks), {"find": ["?d", "?toxic"], "where": [["?d", ":documents/lang", "?l"]], "optionalProjection": {"rowBinding": "?d", "fields": [{"attribute": ":documents/toxic", "variable": "?toxic"}]}})


# --- rules -----------------------------------------------------------------------------------------------
UP = [{"name": "up", "body": [["?x", ":customer/nationkey", "?y"]]}, {"name": "up", "body": [["?x", ":nation/regionkey", "?y"]]}, {"name": "up", "body": [["?x", ":customer/nationkey", "?n"], ["up", "?n", "?y"]]}]
add("rule_nonrecursive", "SELECT DISTINCT 'customer:' || c_custkey AS c, 'region:' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey", query("customer nation", find=["?c", "?r"], where=[["lives", "?c", "?r"]], rules=[{"name": "lives", "body": [["?c", ":customer/nationkey", "?n"], ["?n", ":nation/regionkey", "?r"]]}]))
add("rule_closure", "WITH e AS (SELECT 'customer:' || c_custkey AS s, 'nation:' || c_nationkey AS t FROM customer UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation), up AS (SELECT s, t FROM e UNION SELECT a.s, b.t FROM e a JOIN e b ON a.t = b.s) SELECT DISTINCT s AS x, t AS y FROM up", query("customer nation", find=["?x", "?y"], where=[["up", "?x", "?y"]], rules=UP))
add("rule_bound_first", "SELECT 'nation:' || c_nationkey AS y FROM customer WHERE c_custkey = 1 UNION SELECT 'region:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1", query("customer nation", find=["?y"], where=[["up", "customer:1", "?y"]], rules=UP))
add("rule_bound_second", "SELECT 'nation:' || n_nationkey AS x FROM nation WHERE n_regionkey = 2 UNION SELECT 'customer:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2", query("customer nation", find=["?x"], where=[["up", "?x", "region:2"]], rules=UP))

# --- wrapped queries -------------------------------------------------------------------------------------
NAMES = {"find": ["?name", "?bal"], "where": [["?c", ":customer/name", "?name"], ["?c", ":customer/acctbal", "?bal"]]}
BASE = "SELECT DISTINCT c_name AS name, c_acctbal AS bal FROM customer"
add("page_first", f"SELECT * FROM ({BASE}) ORDER BY name LIMIT 10", paged("customer", NAMES, orderBy=[{"variable": "?name"}], limit=10))
add("page_third_desc", f"SELECT * FROM ({BASE}) ORDER BY bal DESC, name LIMIT 25 OFFSET 50", paged("customer", NAMES, pages=3, orderBy=[{"variable": "?bal", "direction": "desc"}], limit=25))
add("page_count", f"SELECT count(*) AS total FROM ({BASE}) WHERE bal > 0", lambda spark, sf_dir: spark.createDataFrame([(run_page(tables(spark, sf_dir, "customer"), {"inner": NAMES, "filters": [{"column": "?bal", "op": ">", "value": 0}], "limit": 5, "includeCount": True}).total,)], "total long"))
for _name, _op, _value, _sql in (("like", "like", "%#00000001%", "LIKE '%#00000001%'"), ("ilike", "ilike", "%CUSTOMER#00000002%", "ILIKE '%CUSTOMER#00000002%'"), ("not_like", "not-like", "%1%", "NOT LIKE '%1%'"), ("not_ilike", "not-ilike", "CUST%9", "NOT ILIKE 'CUST%9'"), ("text_range", ">=", "Customer#000000900", ">= 'Customer#000000900'"), ("not_equal", "!=", "Customer#000000001", "<> 'Customer#000000001'")):
    add(f"filter_{_name}", f"SELECT * FROM ({BASE}) WHERE name {_sql}", paged("customer", NAMES, filters=[{"column": "?name", "op": _op, "value": _value}]))
for _name, _op, _value in (("equal", "=", 711.56), ("less", "<", 0), ("at_most", "<=", 711.56), ("at_least", ">=", 5000)):
    add(f"filter_number_{_name}", f"SELECT * FROM ({BASE}) WHERE bal {_op} {_value}", paged("customer", NAMES, filters=[{"column": "?bal", "op": _op, "value": _value}]))
for _name, _op, _value in (("equal", "=", "Customer#000000007"), ("less", "<", "Customer#000000100"), ("at_most", "<=", "Customer#000000100"), ("more", ">", "Customer#000000100")):
    add(f"filter_text_{_name}", f"SELECT * FROM ({BASE}) WHERE name {_op} '{_value}'", paged("customer", NAMES, filters=[{"column": "?name", "op": _op, "value": _value}]))
TOXIC = {"find": ["?d", "?q"], "where": [["?d", ":documents/lang", "?l"]], "optionalProjection": {"rowBinding": "?d", "fields": [{"attribute": ":documents/quality", "variable": "?q"}]}}


def _labelled(op: str):
    """Documents with or without a label, through a wrapped query."""

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        from chronofact.sources.facts import TableFacts, table_spec

        docs = table_spec(spark.read.parquet(f"{sf_dir}/documents.parquet"), "documents", "doc_id", skip=("text",))
        marks = table_spec(spark.read.parquet(f"{sf_dir}/labels.parquet"), "documents", "doc_id", skip=("toxic",))
        return run_page(TableFacts(spark, docs, marks), {"inner": TOXIC, "filters": [{"column": "?q", "op": op}]}).frame

    return call


LABELLED = "SELECT DISTINCT 'documents:' || d.doc_id AS d, CAST(l.quality AS DOUBLE) AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
add("filter_is_not_null", f"SELECT * FROM ({LABELLED}) WHERE q IS NOT NULL", _labelled("is-not-null"))
add("filter_absent", f"SELECT * FROM ({LABELLED}) WHERE q IS NULL", _labelled("is-null"))
add("page_count_filtered", f"SELECT count(*) AS total FROM ({BASE}) WHERE name LIKE '%1%' AND bal >= 0", lambda spark, sf_dir: spark.createDataFrame([(run_page(tables(spark, sf_dir, "customer"), {"inner": NAMES, "filters": [{"column": "?name", "op": "like", "value": "%1%"}, {"column": "?bal", "op": ">=", "value": 0}], "limit": 5, "includeCount": True}).total,)], "total long"))

# --- joins on attributes and transactions, clause order, rule details ----------------------------------------
add("join_on_attribute", "SELECT DISTINCT a AS a FROM (SELECT unnest([':customer/name', ':customer/acctbal', ':customer/mktsegment', ':customer/nationkey']) AS a) WHERE (SELECT count(*) FROM customer WHERE c_custkey IN (1, 2)) = 2", query("customer", find=["?a"], where=[["customer:1", "?a", "?v"], ["customer:2", "?a", "?w"]]))
add("join_on_attribute_and_value", "SELECT DISTINCT s_name AS name FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey)", query("supplier customer", find=["?name"], where=[["?s", ":supplier/name", "?name"], ["?s", ":supplier/nationkey", "?n"], ["?c", "?a", "?n"], ["=", "?a", ":customer/nationkey"]]))
add("join_on_transaction", "SELECT DISTINCT n_name AS x, r_name AS y FROM nation, region WHERE n_nationkey < 3", query("nation region", find=["?x", "?y"], where=[["?n", ":nation/name", "?x", "?t"], ["?r", ":region/name", "?y", "?t"], ["or", [["=", "?n", "nation:0"], ["=", "?n", "nation:1"], ["=", "?n", "nation:2"]]]]))
add("pattern_self", "SELECT CAST(0 AS BIGINT) AS n", query("customer", {"?n": "bigint"}, find=["?n"], where=[["?x", ":customer/name", "?x"]], aggregate=[["count", "?x", "?n"]]))
add("clause_order", "SELECT DISTINCT c_name AS cust, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", query("customer nation orders", find=["?cust", "?nation"], where=[["not", ["?o", ":orders/custkey", "?c"], ["?o", ":orders/orderstatus", "P"]], [">", "?b", 0], ["?n", ":nation/name", "?nation"], ["?c", ":customer/acctbal", "?b"], ["?c", ":customer/nationkey", "?n"], ["?c", ":customer/name", "?cust"]]))
DEEP = [{"name": "in", "body": [["?x", a, "?y"]], "maxDepth": 1} for a in (":orders/custkey", ":customer/nationkey", ":nation/regionkey")] + [{"name": "in", "body": [["?x", a, "?n"], ["in", "?n", "?y"]], "maxDepth": 1} for a in (":orders/custkey", ":customer/nationkey")]
add("rule_max_depth", "SELECT 'nation:' || n_nationkey AS x FROM nation WHERE n_regionkey = 1 UNION SELECT 'customer:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1", query("orders customer nation", find=["?x"], where=[["in", "?x", "region:1"]], rules=DEEP))
add("rule_deep", "SELECT 'nation:' || n_nationkey AS x FROM nation WHERE n_regionkey = 1 UNION SELECT 'customer:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION SELECT 'orders:' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1", query("orders customer nation", find=["?x"], where=[["in", "?x", "region:1"]], rules=[{k: v for k, v in r.items() if k != "maxDepth"} for r in DEEP]))
add("rule_repeated_variable", "SELECT CAST(0 AS BIGINT) AS n", query("orders customer nation", {"?n": "bigint"}, find=["?n"], where=[["in", "?x", "?x"]], rules=DEEP, aggregate=[["count", "?x", "?n"]]))
ENDS = [{"name": "has", "body": [["?x", a, "?y"]]} for a in (":customer/mktsegment", ":customer/acctbal", ":customer/nationkey")]
add("rule_text_endpoints", "SELECT DISTINCT 'customer:' || c_custkey AS c, c_mktsegment AS v FROM customer UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer", query("customer", find=["?c", "?v"], where=[["has", "?c", "?v"]], rules=ENDS))
add("filter_other_family", f"SELECT * FROM ({BASE}) WHERE false", paged("customer", NAMES, filters=[{"column": "?bal", "op": "!=", "value": "x"}]))
add("filter_is_null", "SELECT p_brand AS brand, CAST(NULL AS DOUBLE) AS s FROM part GROUP BY 1", paged("part", {"find": ["?brand", "?s"], "where": [["?p", ":part/brand", "?brand"], ["?p", ":part/name", "?n"]], "aggregate": [["sum", "?n", "?s"]]}, filters=[{"column": "?s", "op": "is-null"}]))
