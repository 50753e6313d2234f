"""Joins that multiply rows, for answers that are sets: each side is made distinct first, pairs by themselves only where they can repeat."""

import random

import pytest

from chronofact.plans.build import run
from chronofact.sources.facts import TableFacts, table_spec
from tests.core.naive import solve

SHARED = [["?a", ":l/key", "?k"], ["?b", ":r/key", "?k"], ["?a", ":l/name", "?x"], ["?b", ":r/name", "?y"]]
VALUES = [["?a", ":l/size", "?s"], ["?b", ":r/size", "?t"]]
QUERIES = {
    "value": {"find": ["?x", "?y"], "where": SHARED},
    "theta": {"find": ["?x", "?y"], "where": [*SHARED, *VALUES, [">", "?t", "?s"]]},
    "with the key": {"find": ["?x", "?k", "?y"], "where": SHARED},
    "one size shown": {"find": ["?x", "?y", "?s"], "where": [*SHARED, *VALUES, [">", "?t", "?s"]]},
    "one side only": {"find": ["?x"], "where": [*SHARED[:1], SHARED[2], ["?b", "?r", "?k"], ["=", "?r", ":r/key"]]},
    "number": {"find": ["?a", "?y"], "where": [["?a", ":l/size", "?s"], ["?b", ":r/size", "?s"], ["?b", ":r/name", "?y"]]},
    "cross": {"find": ["?x", "?y"], "where": [["?a", ":l/name", "?x"], ["?b", ":r/name", "?y"]]},
    "three": {"find": ["?x", "?z"], "where": [*SHARED, ["?c", ":l/size", "?t"], ["?b", ":r/size", "?t"], ["?c", ":l/name", "?z"]]},
    "not": {"find": ["?x", "?y"], "where": [*SHARED, *VALUES, ["not", ["?c", ":l/size", "?t"], ["!=", "?c", "?a"]]]},
    "or": {"find": ["?x", "?y"], "where": [*SHARED, *VALUES, ["or", [["=", "?t", 1], ["?c", ":l/size", "?t"]]]]},
}


def tables(spark, seed):
    r = random.Random(seed)
    data = {p: [(i, f"{p}{r.randrange(6)}", f"k{r.randrange(3)}", float(r.randrange(4))) for i in range(14)] for p in "lr"}
    source = TableFacts(spark, *(table_spec(spark.createDataFrame(rows, "id long, name string, key string, size double"), p, "id") for p, rows in data.items()))
    facts = [(f"{p}:{i}", f":{p}/{a}", "number" if a == "size" else "string", v) for p, rows in data.items() for i, *vs in rows for a, v in zip(("name", "key", "size"), vs)]
    return source, facts


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("name", QUERIES)
def test_answers(spark, name, seed):
    source, facts = tables(spark, seed)
    rows = [tuple(r) for r in run(source, QUERIES[name]).collect()]
    unlifted = {tuple(next((x for x in (v[1], v[2], v[3]) if x is not None), None) if isinstance(v, tuple) else v for v in r) for r in rows}
    assert len(rows) == len(unlifted) and unlifted == {tuple(v for _, v in r) for r in solve(facts, QUERIES[name])}


@pytest.mark.parametrize("name", ["value", "theta", "number", "one side only"])
def test_sides_are_distinct_before_they_are_joined(spark, name):
    plan = run(tables(spark, 1)[0], QUERIES[name])._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Join Inner") :].count("Aggregate [") >= 2, plan
    # no distinct over all pairs
    assert name == "one side only" or plan.startswith("Union"), plan
