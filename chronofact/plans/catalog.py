"""The driver's tables as facts, and the driver's queries over them with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofact.sources.facts import TableFacts, TableSpec, table_spec

REFS = {"nation": {"n_regionkey": "region"}, "customer": {"c_nationkey": "nation"}, "supplier": {"s_nationkey": "nation"}, "orders": {"o_custkey": "customer"}, "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, "labels": {"doc_id": "documents"}}
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id"}
STRIP = {"region": "r_", "nation": "n_", "customer": "c_", "supplier": "s_", "part": "p_", "orders": "o_", "lineitem": "l_"}


def spec(spark: SparkSession, sf_dir: str, name: str) -> TableSpec:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "lineitem":
        # no natural key: repeated (order, line) rows are numbered; unused, Catalyst prunes the window
        rest = [c for c in frame.columns if c not in ("l_orderkey", "l_linenumber")]
        frame = frame.withColumn("l_copy", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*rest)))
        key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_copy").cast("string"))
        return table_spec(frame, name, key, refs=REFS[name], skip=("l_copy",), strip="l_")
    if name == "labels":
        return table_spec(frame, name, F.col("doc_id"), refs={"doc_id": "documents"})
    return table_spec(frame, name, KEYS[name], refs=REFS.get(name), json_columns=("props",), strip=STRIP.get(name, ""))


def tables(spark: SparkSession, sf_dir: str, *names: str) -> TableFacts:
    return TableFacts(spark, *(spec(spark, sf_dir, n) for n in names))


def query(names: str, types: dict[str, str] | None = None, **q):
    """A driver query: the tables it needs and its JSON form."""
    from chronofact.plans.build import run

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(tables(spark, sf_dir, *names.split()), q, types)

    return call
