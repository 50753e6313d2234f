"""Rules: unions of base cases and linear recursion, evaluated semi-naively.

A bound argument shrinks the work: with a constant second argument only base pairs that end in it are extended;
with a constant first argument the walk goes forward from it and no pair of the closure is made that doesn't
start there. Each round is one join of the last round's new pairs with the edges and writes what is new; what
was seen is the union of the rounds' tables, which are never written again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.functions.staging import discard, stage
from chronofact.functions.values import part
from chronofact.plans.ast import Apply, Pattern, Rule, is_variable
from chronofact.plans.build import Relation, join_all, relations


def _text(r: Relation, first: str, second: str) -> DataFrame:
    """Distinct string pairs; values of other families aren't endpoints."""
    a, b = (part(r.col(v), r.kinds[v], "txt") for v in (first, second))
    return r.frame.select(a.alias("a"), b.alias("b")).where("a is not null and b is not null").distinct()


def _base(source, rules: list[Rule]) -> DataFrame:
    bodies = [r for r in rules if not r.recursive]
    return reduce(DataFrame.unionByName, (_text(join_all(relations(source, list(r.body))), r.patterns[0].entity, r.patterns[-1].value) for r in bodies)).distinct()


def _edges(source, rules: list[Rule]) -> DataFrame:
    """(a, b): a's pairs are those of b, for every recursive definition."""
    parts = []
    for r in (r for r in rules if r.recursive):
        step: Pattern = r.body[0]
        if step.entity == step.value:
            found = join_all(relations(source, [step]))
            parts.append(_text(found, step.entity, step.entity))
        else:
            parts.append(_text(join_all(relations(source, [step])), step.entity, step.value))
    return reduce(DataFrame.unionByName, parts).distinct()


def pairs(source, rules: list[Rule], first: str | None = None, second: str | None = None) -> DataFrame:
    """All (a, b) of a rule group, or those with the given ends."""
    base = _base(source, rules)
    if second is not None:
        base = base.where(F.col("b") == F.lit(second))
    if not any(r.recursive for r in rules):
        return base if first is None else base.where(F.col("a") == F.lit(first))
    depth = max(r.max_depth for r in rules)
    edges = stage(_edges(source, rules), "rule-edges")
    if first is not None:
        # forward from the constant: the nodes within reach, then their base pairs
        start = base.sparkSession.createDataFrame([(first,)], "n string")
        ahead = lambda new: edges.join(new.select("n"), edges.a == F.col("n")).select(F.col("b").alias("n"))
        reached = _rounds(start, ahead, ["n"], depth)
        return base.join(reached, base.a == reached.n).select(F.lit(first).alias("a"), "b").distinct()
    longer = lambda new: edges.toDF("x", "n").join(new, F.col("n") == F.col("a")).select(F.col("x").alias("a"), "b")
    return _rounds(stage(base, "rule-round"), longer, ["a", "b"], depth)


def _rounds(start: DataFrame, step, key: list[str], depth: int) -> DataFrame:
    """start and what ``step`` makes of each round's new rows, until nothing is new."""
    rounds = [start]
    for _ in range(depth):
        seen = reduce(DataFrame.unionByName, rounds)
        new = stage(step(rounds[-1]).distinct().join(seen, key, "left_anti"), "rule-round")
        if new.isEmpty():
            discard(new)
            break
        rounds.append(new)
    return reduce(DataFrame.unionByName, rounds)


def rule_relation(source, rules: tuple[Rule, ...], c: Apply) -> Relation:
    own = [r for r in rules if r.name == c.rule]
    found = pairs(source, own, None if is_variable(c.first) else c.first, None if is_variable(c.second) else c.second)
    if is_variable(c.first) and c.first == c.second:
        return Relation(found.where("a = b").select(F.col("a").alias(c.first)), {c.first: "txt"})
    columns = [(t, x) for t, x in ((c.first, "a"), (c.second, "b")) if is_variable(t)]
    return Relation(found.select(*(F.col(x).alias(t) for t, x in columns)), {t: "txt" for t, _ in columns})
