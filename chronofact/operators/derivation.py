"""Derivations: structural queries whose rows keep the facts that support them.

Provenance travels through the joins as one struct a pattern, so evaluation is a single plan whatever the number
of rows. Rows are grouped by identity; the supporting facts of a candidate are the union over its rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofact.errors import DerivationError
from chronofact.functions.values import content_id, lift
from chronofact.plans.ast import Not, Pattern, Predicate, Query, Ref, is_variable, parse
from chronofact.plans.build import Relation, apply_not, join_all, predicate
from chronofact.sources.basis import Basis
from chronofact.sources.facts import FactTable, Wanted, scalar
from chronofact.sources.store import Assert, FactStore, Meta, dependency_state

SOURCE = ("triple_id", "tx_id", "recorded_position", "valid_to")


@dataclass(frozen=True)
class Derivation:
    name: str
    query: Query
    identity: tuple[str, ...]
    config: str | None = None

    @staticmethod
    def make(name: str, query: dict, identity: list[str], config: str | None = None) -> Derivation:
        q = parse(query)
        if any(not isinstance(c, (Pattern, Predicate, Not)) for c in q.where) or q.aggregates or q.rules or q.optional or q.order or q.limit or q.offset:
            raise DerivationError("a derivation has patterns, predicates and negations only")
        if not identity or any(v not in q.find for v in identity):
            raise DerivationError("identity variables are part of the output")
        return Derivation(name, q, tuple(identity), config)

    @property
    def id(self) -> str:
        return content_id("derivation", {"name": self.name, "query": self.query.source, "identity": list(self.identity), "config": self.config})

    @property
    def attributes(self) -> list[str]:
        """Attributes that the result depends on, negated ones included."""
        patterns = [*self.query.of(Pattern), *(p for n in self.query.of(Not) for p in n.patterns)]
        return sorted({p.attribute for p in patterns if not is_variable(p.attribute)})

    @property
    def dynamic(self) -> bool:
        patterns = [*self.query.of(Pattern), *(p for n in self.query.of(Not) for p in n.patterns)]
        return any(is_variable(p.attribute) for p in patterns)


def _traced(source: FactTable, p: Pattern, at: int) -> Relation:
    """A pattern with the fact behind each row."""
    const = lambda t: None if t is None or is_variable(t) else t
    raw = const(p.value)
    rows = source.matching(Wanted(const(p.entity), const(p.attribute), raw["value"] if isinstance(raw, Ref) else raw, isinstance(raw, Ref), const(p.tx)))
    kind = source.kinds.get(p.attribute, "any") if not is_variable(p.attribute) else "any"
    out: dict[str, tuple[Column, str]] = {}
    for term, c, k in ((p.entity, F.col("entity_id"), "txt"), (p.attribute, F.col("attribute"), "txt"), (p.value, scalar(kind), kind), (p.tx, F.col("tx_id"), "txt")):
        if is_variable(term):
            if term in out:
                rows = rows.where(lift(out[term][0], out[term][1]) == lift(c, k))
            else:
                out[term] = (c, k)
    trace = f"source {at}"
    return Relation(rows.select(*(c.alias(v) for v, (c, _) in out.items()), F.struct(*SOURCE).alias(trace)), {v: k for v, (_, k) in out.items()} | {trace: "trace"})


@F.pandas_udf(T.StringType())  # a type object: importing needs no session
def _content_ids(domain, payload):
    import pandas as pd

    return pd.Series([content_id(d, json.loads(p)) for d, p in zip(domain, payload)])


def identifier(domain: str, *parts: Column) -> Column:
    """Content ids of the parts' JSON, one Arrow batch at a time."""
    return _content_ids(F.lit(domain), F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts))), {"ignoreNullFields": "false"}))


def evaluate(source: FactTable, d: Derivation) -> DataFrame:
    """(candidate_id, revision_id, identity, result, sources, next_boundary), one row a candidate.

    Two results for one identity are an error: the query doesn't determine what it derives.
    """
    parts = [(sum(not is_variable(t) for t in (p.entity, p.value)), _traced(source, p, i)) for i, p in enumerate(d.query.of(Pattern))]
    r = join_all(parts)
    for p in d.query.of(Predicate):
        r = Relation(r.frame.where(predicate(p, r)), r.kinds)
    for n in d.query.of(Not):
        r = apply_not(source, r, n)
    traces = [v for v, k in r.kinds.items() if k == "trace"]
    shown = d.query.result_variables
    identity = F.struct(*(lift(r.col(v), r.kinds[v]).alias(v[1:]) for v in d.identity))
    output = F.struct(*(lift(r.col(v), r.kinds[v]).alias(v[1:]) for v in shown))
    rows = r.frame.select(identity.alias("identity"), output.alias("result"), F.array(*(r.col(t) for t in traces)).alias("traces"))
    one = rows.groupBy("identity").agg(F.count_distinct("result").alias("results"), F.first("result").alias("result"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("traces")))).alias("sources"))
    one = one.withColumn("ok", F.when(F.col("results") > 1, F.raise_error(F.lit(f"{d.name}: one identity has several results"))).otherwise(F.lit(True))).where("ok")
    later = F.filter("sources", lambda s: s["valid_to"] > source.basis.valid_at)
    boundary = F.array_min(F.transform(later, lambda s: s["valid_to"]))
    named = one.withColumn("candidate_id", identifier("candidate", F.lit(d.name), F.col("identity")))
    named = named.withColumn("revision_id", identifier("candidate-revision", F.lit(d.id), F.col("candidate_id"), F.col("result"), F.transform("sources", lambda s: s["triple_id"])))
    return named.select("candidate_id", "revision_id", "identity", "result", "sources", boundary.alias("next_boundary"))


def next_boundary(source: FactTable, d: Derivation) -> int | None:
    """When time alone may change the evaluation next."""
    return dependency_state(source.facts, d.attributes, source.basis)["next_boundary"]


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """(candidate_id, change, old_revision, new_revision): added, removed, changed or unchanged."""
    a = old.select("candidate_id", F.col("revision_id").alias("old_revision"))
    b = new.select("candidate_id", F.col("revision_id").alias("new_revision"))
    change = F.when(F.col("old_revision").isNull(), "added").when(F.col("new_revision").isNull(), "removed").when(F.col("old_revision") == F.col("new_revision"), "unchanged").otherwise("changed")
    return a.join(b, "candidate_id", "full").withColumn("change", change).select("candidate_id", "change", "old_revision", "new_revision")


# --- materialised runs -----------------------------------------------------------------------------------


def materialize(store: FactStore, d: Derivation, basis: Basis | None = None) -> tuple[str, bool]:
    """Persists the candidates of a run; (run id, whether anything was written). Equal runs are written once."""
    b = (basis or Basis()).resolved()
    found = evaluate(store.source(b), d)
    state = dependency_state(store.facts(), d.attributes, b)
    # a sum of digests doesn't mind the order, and no task sees all ids
    word = lambda i: F.sum(F.conv(F.substring(F.sha2("revision_id", 256), 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    digest = list(found.agg(F.count(F.lit(1)).cast("string"), *map(word, range(4))).first())
    run_id = content_id("run", {"derivation": d.id, "position": state["source_position"], "candidates": digest})
    entity = f"_sys/run/{run_id}"
    if not store.entity(entity).isEmpty():
        return run_id, False
    payload = F.to_json(F.struct("candidate_id", "revision_id", "identity", "result", F.transform("sources", lambda s: s["triple_id"]).alias("sources"), "next_boundary"))
    facts = found.select(F.lit(entity).alias("entity_id"), F.lit(":sys/candidate").alias("attribute"), F.lit("json").alias("value_type"), payload.alias("value_json"), F.lit("sys.Run").alias("entity_type"))
    store.ingest(facts, Meta(actor="derivation"), system=True)
    head = {"derivation": d.id, "name": d.name, "source-position": state["source_position"], "valid-at": b.valid_at, "next-boundary": state["next_boundary"]}
    store.transact([Assert(entity, f":sys/run-{k}", v, "sys.Run") for k, v in head.items() if v is not None], system=True)
    return run_id, True


def runs(store: FactStore) -> DataFrame:
    """(run, derivation, name, source_position, valid_at, next_boundary, position)."""
    rows = store.facts().where("entity_type = 'sys.Run' and retracted_at is null")
    one = lambda a, c: F.max(F.when(F.col("attribute") == f":sys/run-{a}", F.col(c)))
    return rows.groupBy(F.col("entity_id").alias("run")).agg(one("derivation", "value_string").alias("derivation"), one("name", "value_string").alias("name"), one("source-position", "value_number").cast("long").alias("source_position"), one("valid-at", "value_number").cast("long").alias("valid_at"), one("next-boundary", "value_number").cast("long").alias("next_boundary"), F.max("recorded_position").alias("position")).where("derivation is not null")


def runs_query(name: str) -> dict:
    """The query that lists a derivation's runs and where they stand, for a store or a wrapped page."""
    return {"find": ["?run", "?derivation", "?source"], "where": [["?run", ":sys/run-name", name], ["?run", ":sys/run-derivation", "?derivation"], ["?run", ":sys/run-source-position", "?source"]]}


def current(store: FactStore, d: Derivation, basis: Basis | None = None) -> dict:
    """The newest run and whether it still stands: current, stale or unmaterialized."""
    b = (basis or Basis()).resolved()
    best = runs(store).where(F.col("derivation") == d.id).orderBy(F.desc("source_position"), F.desc("position")).first()
    if best is None:
        return {"freshness": "unmaterialized", "run": None}
    state = dependency_state(store.facts(), d.attributes, b)
    passed = best["next_boundary"] is not None and b.valid_at >= best["next_boundary"]
    fresh = state["source_position"] == best["source_position"] and not passed
    return {"freshness": "current" if fresh else "stale", "run": best["run"], "source_position": best["source_position"]}


# --- what if ---------------------------------------------------------------------------------------------


def overlay(source: FactTable, d: Derivation, asserts: list[Assert] = (), retracts: list[str] = ()) -> DataFrame:
    """evaluate over the visible facts with hypothetical changes; nothing is written."""
    if d.dynamic or any(p.tx is not None for p in d.query.of(Pattern)):
        raise DerivationError("an overlay needs constant attributes and no transaction terms")
    if len(set(retracts)) != len(retracts):
        raise DerivationError("a fact is retracted twice")
    seen = source.visible().where(F.col("attribute").isin(*d.attributes))
    if retracts:
        known = seen.where(F.col("triple_id").isin(*retracts)).count()
        if known != len(retracts):
            raise DerivationError("a retracted fact isn't visible")
        seen = seen.where(~F.col("triple_id").isin(*retracts))
    if asserts:
        from chronofact.sources.facts import FACTS
        from chronofact.sources.store import packed

        rows = []
        for i, a in enumerate(asserts):
            v = {"triple_id": a.triple_id or f"HYPOTHETICAL{i:014d}", "entity_id": a.entity, "attribute": a.attribute, **packed(a.value), "recorded_at": 0, "recorded_position": 0, "valid_from": a.valid_from or 0, "valid_to": a.valid_to, "entity_type": a.entity_type, "schema_version": 1, "tx_id": "_tx/hypothetical"}
            rows.append(tuple(v.get(n) for n in FACTS.names))
        seen = seen.unionByName(source.spark.createDataFrame(rows, FACTS))
    return evaluate(FactTable(seen, Basis(valid_at=source.basis.valid_at), source.kinds), d)


__all__ = ["Derivation", "current", "evaluate", "materialize", "next_boundary", "overlay", "reconcile", "runs"]
