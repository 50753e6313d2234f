"""Three-valued rules over entity attributes.

SQL's null is Kleene's unknown, so an expression becomes one boolean Column over a row of attributes and a whole
population is decided in one pass; provenance is made on request, one subject at a time, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.errors import ConfigError
from chronofact.functions.values import content_id

DAY = 86_400_000
SUBJECT = "$subject"


@dataclass(frozen=True)
class Lit:
    value: bool


@dataclass(frozen=True)
class Exists:
    attribute: str
    entity: str = SUBJECT


@dataclass(frozen=True)
class Eq:
    attribute: str
    value: object
    entity: str = SUBJECT


@dataclass(frozen=True)
class Before:
    attribute: str
    granularity: str = "day"
    entity: str = SUBJECT


@dataclass(frozen=True)
class Rule:
    key: str


@dataclass(frozen=True)
class Not:
    expr: object


@dataclass(frozen=True)
class All:
    exprs: tuple


@dataclass(frozen=True)
class Any:
    exprs: tuple


def bucket(ms: float, granularity: str) -> float:
    return ms // DAY if granularity == "day" else ms


def attributes(e, catalog: dict[str, object] | None = None, seen: frozenset = frozenset()) -> set[tuple[str, str]]:
    """(entity, attribute) pairs that an expression reads, through the catalog's rules."""
    if isinstance(e, (Exists, Eq, Before)):
        return {(e.entity, e.attribute)}
    if isinstance(e, Not):
        return attributes(e.expr, catalog, seen)
    if isinstance(e, (All, Any)):
        return set().union(*(attributes(x, catalog, seen) for x in e.exprs))
    if isinstance(e, Rule) and e.key not in seen and e.key in (catalog or {}):
        return attributes(catalog[e.key], catalog, seen | {e.key})
    return set()


def column(e, value, now: int, catalog: dict[str, object] | None = None, calling: frozenset = frozenset()) -> Column:
    """true, false or null. value(entity, attribute) gives the "any" struct of a fact, null if absent."""
    unknown = F.lit(None).cast("boolean")
    again = lambda x: column(x, value, now, catalog, calling)
    if isinstance(e, Lit):
        return F.lit(e.value)
    if isinstance(e, Exists):
        return value(e.entity, e.attribute).isNotNull()
    if isinstance(e, Eq):
        v = value(e.entity, e.attribute)
        family = "bool" if isinstance(e.value, bool) else "num" if isinstance(e.value, (int, float)) else "txt"
        same = F.coalesce(v[family] == F.lit(float(e.value) if family == "num" else e.value), F.lit(False))
        return F.when(v.isNotNull(), same)
    if isinstance(e, Before):
        number = value(e.entity, e.attribute)["num"]
        return (F.floor(number / DAY) if e.granularity == "day" else number) < F.lit(bucket(now, e.granularity))
    if isinstance(e, Rule):
        if e.key not in (catalog or {}) or e.key in calling:
            return unknown
        return column(catalog[e.key], value, now, catalog, calling | {e.key})
    if isinstance(e, Not):
        return ~again(e.expr)
    if isinstance(e, All):
        return reduce(Column.__and__, map(again, e.exprs), F.lit(True))
    if isinstance(e, Any):
        return reduce(Column.__or__, map(again, e.exprs), F.lit(False))
    raise ConfigError(f"not an expression: {e!r}")


def worlds(facts: DataFrame, wanted: set[tuple[str, str]], subject_type: str | None = None) -> DataFrame:
    """(subject, a<i>): one row a subject with the wanted attributes' values; several values of one are an error.

    Attributes of fixed entities are one row, joined to every subject.
    """
    from chronofact.sources.facts import scalar

    order = sorted(wanted)
    subjects = facts if subject_type is None else facts.where(F.col("entity_type") == F.lit(subject_type))
    own = [(i, a) for i, (e, a) in enumerate(order) if e == SUBJECT]
    fixed = [(i, e, a) for i, (e, a) in enumerate(order) if e != SUBJECT]

    def single(match: Column, name: str) -> Column:
        hits = F.collect_set(F.when(match, scalar()))
        return F.when(F.size(hits) > 1, F.raise_error(F.lit(f"{name} has several values")).cast(facts.select(scalar()).schema[0].dataType)).otherwise(F.get(hits, F.lit(0)))

    reads = facts.where(F.col("attribute").isin(*(a for _, a in own))) if own else facts.limit(0)
    per = reads.groupBy(F.col("entity_id").alias("subject")).agg(F.count(F.lit(1)).alias("n"), *(single(F.col("attribute") == F.lit(a), a).alias(f"a{i}") for i, a in own)).drop("n")
    rows = subjects.select(F.col("entity_id").alias("subject")).distinct().join(per, "subject", "left")
    if fixed:
        one = facts.agg(*(single((F.col("entity_id") == F.lit(e)) & (F.col("attribute") == F.lit(a)), f"{e}{a}").alias(f"a{i}") for i, e, a in fixed))
        rows = rows.crossJoin(F.broadcast(one))  # a single row
    return rows


def decide(facts: DataFrame, exprs: dict[str, object], now: int, catalog: dict[str, object] | None = None, subject_type: str | None = None) -> DataFrame:
    """(subject, <name>...) with true, false or null (unknown) for each expression, in one pass."""
    wanted = set().union(*(attributes(e, catalog) for e in exprs.values()))
    order = sorted(wanted)
    value = lambda entity, attribute: F.col(f"a{order.index((entity, attribute))}")
    return worlds(facts, wanted, subject_type).select("subject", *(column(e, value, now, catalog).alias(n) for n, e in exprs.items()))


def deploy_impact(facts: DataFrame, key: str, old: dict[str, object], new: dict[str, object], now: int, subject_type: str | None = None) -> DataFrame:
    """(subject, old, new) of the subjects whose answer to a rule differs between two catalogs; both are decided in one pass."""
    wanted = attributes(Rule(key), old) | attributes(Rule(key), new)
    order = sorted(wanted)
    value = lambda entity, attribute: F.col(f"a{order.index((entity, attribute))}")
    both = worlds(facts, wanted, subject_type).select("subject", column(Rule(key), value, now, old).alias("old"), column(Rule(key), value, now, new).alias("new"))
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def deploy_counts(facts: DataFrame, key: str, old: dict[str, object], new: dict[str, object], now: int, subject_type: str | None = None) -> dict:
    """How many subjects there are, how many a deployment decides anew, and how many answers flip.

    Only a subject whose old proof went through a rule that changed is decided anew.
    """
    changed = [f"rule|{k}" for k in {*old, *new} if old.get(k) != new.get(k)]
    proofs = prove(facts, Rule(key), now, old, subject_type)
    touched = F.arrays_overlap("observed", F.array(*map(F.lit, changed)).cast("array<string>")) if changed else F.lit(False)
    total, again = proofs.agg(F.count(F.lit(1)), F.coalesce(F.sum(touched.cast("int")), F.lit(0))).first()
    return {"subjects": total, "reevaluated": again, "skipped": total - again, "flipped": deploy_impact(facts, key, old, new, now, subject_type).count()}


# --- proofs ----------------------------------------------------------------------------------------------


def truth(e, world: dict, subject: str | None, now: int, catalog: dict[str, object], calling: frozenset = frozenset()) -> dict:
    """A proof: {truth, expr, observed, children, reason, id}; every branch is taken."""
    observed, children, reason = [], [], None
    if isinstance(e, (Exists, Eq, Before)):
        entity = subject if e.entity == SUBJECT else e.entity
        if entity is None:
            t, reason = None, "no subject"
        else:
            v = world.get((entity, e.attribute))
            observed.append(["fact", entity, e.attribute, v])
            if isinstance(e, Before):
                observed.append(["clock", e.granularity, bucket(now, e.granularity)])
            if isinstance(e, Exists):
                t = v is not None
            elif v is None:
                t, reason = None, f"{entity}{e.attribute} is absent"
            elif isinstance(e, Eq):
                t = type(v) is type(e.value) and v == e.value or _both_numbers(v, e.value) and v == e.value
            elif not _both_numbers(v, 0):
                t, reason = None, f"{entity}{e.attribute} is not an instant"
            else:
                t = bucket(v, e.granularity) < bucket(now, e.granularity)
    elif isinstance(e, Lit):
        t = e.value
    elif isinstance(e, Rule):
        found = catalog.get(e.key)
        observed.append(["rule", e.key, None if found is None else content_id("rule", repr(found))])
        if found is None or e.key in calling:
            t, reason = None, f"rule {e.key} is {'recursive' if found is not None else 'missing'}"
        else:
            children = [truth(found, world, subject, now, catalog, calling | {e.key})]
            t = children[0]["truth"]
    else:
        children = [truth(x, world, subject, now, catalog, calling) for x in ((e.expr,) if isinstance(e, Not) else e.exprs)]
        ts = [c["truth"] for c in children]
        if isinstance(e, Not):
            t = None if ts[0] is None else not ts[0]
        else:
            decisive = isinstance(e, Any)
            t = decisive if decisive in ts else None if None in ts else not decisive
    body = {"truth": t, "expr": repr(e), "observed": observed, "children": [c["id"] for c in children], "reason": reason}
    return {"truth": t, "expr": e, "observed": observed, "children": children, "reason": reason, "id": content_id("proof", body)}


def _both_numbers(a, b) -> bool:
    return all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (a, b))


def closure(proof: dict) -> list:
    """Everything observed anywhere in a proof, each once."""
    out = list(proof["observed"])
    for c in proof["children"]:
        out += [o for o in closure(c) if o not in out]
    return out


def verify(proof: dict) -> bool:
    """Whether a proof's ids fit its content, all the way down."""
    body = {"truth": proof["truth"], "expr": repr(proof["expr"]), "observed": proof["observed"], "children": [c["id"] for c in proof["children"]], "reason": proof["reason"]}
    return proof["id"] == content_id("proof", body) and all(map(verify, proof["children"]))


def replay(proof: dict, world: dict, subject: str | None, now: int, catalog: dict[str, object]) -> bool:
    """Whether the same question has the same proof against a world."""
    return truth(proof["expr"], world, subject, now, catalog)["id"] == proof["id"]


def prove(facts: DataFrame, e, now: int, catalog: dict[str, object] | None = None, subject_type: str | None = None) -> DataFrame:
    """(subject, truth, proof_id, reasons, observed) for every subject; observed names what the proof looked at."""
    wanted = sorted(attributes(e, catalog))
    rows = worlds(facts, set(wanted), subject_type)
    catalog = catalog or {}

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        def reasons(p):
            return [p["reason"]] * (p["reason"] is not None) + [r for c in p["children"] for r in reasons(c)]

        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                world = {}
                for i, (entity, a) in enumerate(wanted):
                    v = r.get(f"a{i}")
                    if isinstance(v, dict) and v.get("fam") is not None:
                        world[(r["subject"] if entity == SUBJECT else entity, a)] = (v["num"], v["bool"], v["txt"])[int(v["fam"])]
                p = truth(e, world, r["subject"], now, catalog)
                out.append((r["subject"], p["truth"], p["id"], reasons(p), sorted({observed_key(o) for o in closure(p)})))
            yield pd.DataFrame(out, columns=["subject", "truth", "proof_id", "reasons", "observed"])

    return rows.mapInPandas(run, "subject string, truth boolean, proof_id string, reasons array<string>, observed array<string>")


# --- expressions as JSON ------------------------------------------------------------------------------------

_LEAVES = {"exists": Exists, "eq": Eq, "before": Before}
_GROUPS = {"all": All, "any": Any}


def to_json(e) -> dict:
    """An expression as plain JSON, as configuration stores it."""
    for name, kind in _LEAVES.items():
        if isinstance(e, kind):
            return {"op": name, **{k: getattr(e, k) for k in e.__dataclass_fields__}}
    for name, kind in _GROUPS.items():
        if isinstance(e, kind):
            return {"op": name, "exprs": [to_json(x) for x in e.exprs]}
    if isinstance(e, Lit):
        return {"op": "lit", "value": e.value}
    if isinstance(e, Rule):
        return {"op": "rule", "key": e.key}
    if isinstance(e, Not):
        return {"op": "not", "expr": to_json(e.expr)}
    raise ConfigError(f"not an expression: {e!r}")


def from_json(j: dict):
    try:
        op, rest = j["op"], {k: v for k, v in j.items() if k != "op"}
        if op in _LEAVES:
            return _LEAVES[op](**rest)
        if op in _GROUPS:
            return _GROUPS[op](tuple(from_json(x) for x in rest["exprs"]))
        if op == "not":
            return Not(from_json(rest["expr"]))
        return {"lit": Lit, "rule": Rule}[op](**rest)
    except (KeyError, TypeError) as error:
        raise ConfigError(f"not an expression: {j!r}") from error


def expr_id(e) -> str:
    return content_id("expr", to_json(e))


# --- the cache -----------------------------------------------------------------------------------------------


def observed_key(o: list) -> str:
    """What an observation looked at, whatever it saw: fact|entity|attribute, rule|key or clock|granularity."""
    return f"fact|{o[1]}|{o[2]}" if o[0] == "fact" else f"{o[0]}|{o[1]}"


class EvaluationCache:
    """Proofs by what they observed. An expression's past proofs looked at few different sets of things (shapes);
    a lookup reads what a shape names from the new world and compares. Nothing that wasn't looked at matters."""

    def __init__(self):
        self.entries: dict[str, dict[tuple, dict[str, dict]]] = {}
        self.hits = self.misses = 0

    def _seen(self, o: tuple, world: dict, now: int, catalog: dict) -> list:
        if o[0] == "fact":
            return ["fact", o[1], o[2], world.get((o[1], o[2]))]
        if o[0] == "clock":
            return ["clock", o[1], bucket(now, o[1])]
        rule = catalog.get(o[1])
        return ["rule", o[1], None if rule is None else content_id("rule", repr(rule))]

    def truth(self, e, world: dict, subject: str | None, now: int, catalog: dict) -> dict:
        shapes = self.entries.setdefault(content_id("question", [to_json(e), subject]), {})
        for shape, proofs in shapes.items():
            found = proofs.get(content_id("inputs", [self._seen(o, world, now, catalog) for o in shape]))
            if found is not None:
                self.hits += 1
                return found
        self.misses += 1
        proof = truth(e, world, subject, now, catalog)
        seen = closure(proof)
        shape = tuple(tuple(o[:3]) if o[0] == "fact" else tuple(o[:2]) for o in seen)
        shapes.setdefault(shape, {})[content_id("inputs", [self._seen(o, world, now, catalog) for o in shape])] = proof
        return proof

    def shapes(self, e, subject: str | None = None) -> int:
        return len(self.entries.get(content_id("question", [to_json(e), subject]), {}))


# --- reacting to changes -----------------------------------------------------------------------------------


def observations(proofs: list[tuple[str, str, dict]]) -> list[tuple[str, str, str, str]]:
    """(question, subject, entity, attribute) rows of the facts that proofs looked at."""
    return [(q, s, o[1], o[2]) for q, s, p in proofs for o in closure(p) if o[0] == "fact"]


def react(changes: DataFrame, observed: DataFrame) -> DataFrame:
    """(question, subject) to decide again after changes(entity_id, attribute)."""
    return observed.join(changes.select(F.col("entity_id").alias("entity"), "attribute").distinct(), ["entity", "attribute"], "left_semi").select("question", "subject").distinct()
