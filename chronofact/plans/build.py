"""From a checked query to one DataFrame.

Patterns on one entity over one table become a single scan; the others are joined in an order that starts from
constants and stays connected, so no cross product arises that the query doesn't ask for. Everything else is
left to Catalyst: joins, anti joins and existence marks on shared variables, partial aggregation, top-k.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.errors import QueryError
from chronofact.functions.values import ANY, TYPE_ORDER, compare, equal, family_is, lift, literal, null_of, number_text, orderings, part, unify
from chronofact.plans.ast import ORDERED, Apply, Not, Or, Order, Pattern, Predicate, Query, Ref, is_variable, parse
from chronofact.sources.facts import Wanted

#: Tasks that the pairs of one value are split among, at the price of so many copies of one side.
SALTS = 4
CASTS = {"double": ("num", "double"), "bigint": ("num", "bigint"), "int": ("num", "int"), "string": ("txt", "string"), "boolean": ("bool", "boolean")}


def column_name(variable: str) -> str:
    return variable[1:]


@dataclass
class Relation:
    """A bag of bindings: a column for each variable, and the kind of its values.

    key is a variable that has each of its values in about one row, if one is known (only plans depend on it);
    once says that no row is there twice.
    """

    frame: DataFrame
    kinds: dict[str, str]
    key: str | None = None
    once: bool = False

    def col(self, v: str) -> Column:
        return F.col(f"`{v}`")

    def lifted(self, v: str, kind: str) -> Column:
        return lift(self.col(v), self.kinds[v]) if kind == "any" else self.col(v)

    def keep(self, variables: list[str]) -> Relation:
        return Relation(self.frame.select(*(self.col(v) for v in variables)), {v: self.kinds[v] for v in variables})


def _alike(a: Relation, b: Relation) -> tuple[Relation, Relation]:
    """Both with the variables that they share in one kind."""
    kinds = {v: unify(a.kinds[v], b.kinds[v]) for v in b.kinds if v in a.kinds}
    left, right = (replace(r, frame=r.frame.select(*(r.lifted(v, kinds.get(v, k)).alias(v) for v, k in r.kinds.items())), kinds={v: kinds.get(v, k) for v, k in r.kinds.items()}) for r in (a, b))
    return left, right


def _join(a: Relation, b: Relation) -> Relation:
    shared = [v for v in b.kinds if v in a.kinds]
    if not shared:
        return Relation(a.frame.crossJoin(b.frame), a.kinds | b.kinds)
    a, b = _alike(a, b)
    return Relation(a.frame.join(b.frame, shared), a.kinds | b.kinds, a.key if b.key in shared else b.key if a.key in shared else None)


def _split(r: Relation, hidden: list[str]) -> tuple[Relation, Relation | None]:
    """r's rows whose other variables have one combination of hidden ones, and the rows with several."""
    if not hidden:
        return replace(r, frame=r.frame.distinct()), None
    shown = [v for v in r.kinds if v not in hidden]
    both = F.struct(*(r.col(v).alias(v) for v in hidden))
    ends = r.frame.groupBy(*(r.col(v) for v in shown)).agg(F.min(both).alias("first"), F.max(both).alias("last"))
    single = ends.where("first = last").select(*(r.col(v) for v in shown), *(F.col("first")[v].alias(v) for v in hidden)).select(*(r.col(v) for v in r.kinds))
    several = r.frame.distinct().join(ends.where("first <> last").select(*(r.col(v) for v in shown)), shown, "left_semi")
    return replace(r, frame=single), replace(r, frame=several.select(*(r.col(v) for v in r.kinds)))


def _spread(a: Relation, b: Relation) -> Relation:
    """The join of two sides whose pairs are many more than their rows: a frequent value's pairs go to several tasks.

    How many tasks is fixed, for an adaptive plan would size them by the sides' bytes.
    """
    shared = [v for v in b.kinds if v in a.kinds]
    if not shared:
        return _join(a, b)
    tasks = 4 * a.frame.sparkSession.sparkContext.defaultParallelism
    left = a.frame.withColumn("salt", F.pmod(F.xxhash64(*(a.col(v) for v in a.kinds)), F.lit(SALTS)).cast("int"))
    right = b.frame.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    left, right = (f.repartition(tasks, *(F.col(f"`{v}`") for v in shared), "salt") for f in (left, right))
    return Relation(left.join(right, [*shared, "salt"]).drop("salt"), a.kinds | b.kinds)


def _pairs_once(a: Relation, b: Relation, keep: set[str], settled) -> Relation:
    """The join's bindings of keep, each once, with a distinct over those pairs only that can arise twice.

    A pair arises once if one side's row has one combination of the variables that aren't kept, and the other
    side's row one for each combination of the join's variables (it has if it hides nothing else).
    """
    a, b = _alike(a, b)
    shared = [v for v in b.kinds if v in a.kinds]
    hide_a, hide_b = ([v for v in r.kinds if v not in keep] for r in (a, b))
    shown = [v for v in dict.fromkeys([*a.kinds, *b.kinds]) if v in keep]
    joined = lambda x, y: settled(_spread(x, y)).keep(shown).frame
    one_a, more_a = _split(a, hide_a)
    one_b, more_b = _split(b, hide_b)
    every_b = replace(b, frame=b.frame.distinct())
    if all(v in shared for v in (*hide_a, *hide_b)):
        sure = [joined(one_a, every_b)] + ([joined(more_a, one_b)] if more_a else [])
        rest = [joined(more_a, more_b)] if more_a and more_b else []
    else:
        sure = [joined(one_a, one_b)]
        rest = ([joined(one_a, more_b)] if more_b else []) + ([joined(more_a, every_b)] if more_a else [])
    out = sure + ([reduce(DataFrame.unionByName, rest).distinct()] if rest else [])
    return Relation(reduce(DataFrame.unionByName, out), {v: (a.kinds | b.kinds)[v] for v in shown}, once=True)


def _aligned(outer: Relation, inner: Relation, shared: list[str]) -> tuple[Relation, DataFrame, list[str]]:
    """Both sides with the shared variables in one kind; the inner ones renamed."""
    kinds = {v: unify(outer.kinds[v], inner.kinds[v]) for v in shared}
    left = outer.frame.select(*(outer.lifted(v, kinds.get(v, k)).alias(v) for v, k in outer.kinds.items()))
    right = inner.frame.select(*(inner.lifted(v, kinds.get(v, k)).alias(f"in {v}") for v, k in inner.kinds.items()))
    return Relation(left, outer.kinds | kinds), right, shared


def _pattern(source, p: Pattern) -> Relation:
    const = lambda t: None if t is None or is_variable(t) else t
    raw = const(p.value)
    want = Wanted(const(p.entity), const(p.attribute), raw["value"] if isinstance(raw, Ref) else raw, isinstance(raw, Ref), const(p.tx))
    found = source.scan(want)
    frame, kinds, columns = found.frame, {}, {}
    for name, term, kind in (("e", p.entity, "txt"), ("a", p.attribute, "txt"), ("v", p.value, found.kind), ("tx", p.tx, "txt")):
        if not is_variable(term):
            continue
        if term in columns:  # the same variable twice: equal within the row
            first = columns[term]
            frame = frame.where(equal(F.col(first), kinds[term], F.col(name), kind))
        else:
            columns[term], kinds[term] = name, kind
    return Relation(frame.select(*(F.col(c).alias(v) for v, c in columns.items())) if columns else frame.select(F.lit(1).alias("?!")).select(), kinds, p.entity if is_variable(p.entity) and const(p.attribute) else None)


def _star(source, patterns: list[Pattern]) -> Relation | None:
    """One relation for patterns on the same entity variable with constant attributes and plain value variables."""
    entity = patterns[0].entity
    values = [p.value for p in patterns]
    if not is_variable(entity) or any(p.tx is not None or is_variable(p.attribute) for p in patterns):
        return None
    found = source.star([p.attribute for p in patterns])
    if found is None:
        return None
    frame, kinds = found
    names, taken = {entity: "e"}, {entity: "txt"}
    for i, (v, k) in enumerate(zip(values, kinds)):
        if not is_variable(v):
            lit, lk = literal(v)
            if isinstance(v, Ref) and not patterns[i].attribute:
                return None
            frame = frame.where(F.col(f"v{i}") == lit) if lk == k else frame.where(F.lit(False))
        elif v in names:
            frame = frame.where(equal(F.col(names[v]), taken[v], F.col(f"v{i}"), k))
        else:
            names[v], taken[v] = f"v{i}", k
    return Relation(frame.select(*(F.col(c).alias(v) for v, c in names.items())), taken, entity)


def relations(source, patterns: list[Pattern]) -> list[tuple[int, Relation]]:
    """(number of constants, relation) for each star or single pattern."""
    groups: dict[object, list[Pattern]] = {}
    out = []
    for p in patterns:
        groups.setdefault(p.entity if is_variable(p.entity) else id(p), []).append(p)
    for own in groups.values():
        while own:
            # typed references keep their own scan: a star compares payloads only
            mates = [p for p in own if not is_variable(p.attribute) and p.tx is None and not isinstance(p.value, Ref)]
            taken = None
            for size in range(len(mates), 1, -1):
                taken = _star(source, mates[:size])
                if taken is not None:
                    own = [p for p in own if not any(p is m for m in mates[:size])]
                    out.append((sum(not is_variable(m.value) for m in mates[:size]), taken))
                    break
            if taken is None:
                p = own.pop(0)
                out.append((sum(t is not None and not is_variable(t) for t in (p.entity, p.value, p.tx)), _pattern(source, p)))
    return out


def join_all(parts: list[tuple[int, Relation]], start: Relation | None = None, join=lambda a, b, rest: _join(a, b)) -> Relation | None:
    """Most constants first, then always a part that shares a variable if there is one; join gets the parts that are left, too."""
    left = list(range(len(parts)))
    done = start
    while left:
        linked = [i for i in left if done is not None and any(v in done.kinds for v in parts[i][1].kinds)]
        i = max(linked or left, key=lambda i: (parts[i][0], -i))
        left.remove(i)
        done = parts[i][1] if done is None else join(done, parts[i][1], [parts[j][1] for j in left])
    return done


def join_sets(parts: list[tuple[int, Relation]], predicates: list[Predicate], keep: set[str]) -> Relation:
    """join_all and the predicates, for a caller to whom a binding of keep counts once.

    Where a join multiplies rows, because no side is an entity that the other one names, both sides are made
    distinct on what is still needed first. The last one makes no pair twice if it can be helped.
    """
    pending = list(predicates)

    def due(r: Relation) -> Relation:
        nonlocal pending
        now = [p for p in pending if all(v in r.kinds for v in p.variables)]
        pending = [p for p in pending if p not in now]
        return replace(r, frame=reduce(lambda f, p: f.where(predicate(p, r)), now, r.frame))

    def join(a: Relation, b: Relation, rest: list[Relation]) -> Relation:
        a, b = due(a), due(b)
        shared = [v for v in b.kinds if v in a.kinds]
        if a.key in shared or b.key in shared:
            return due(_join(a, b))
        needed = keep | {v for r in rest for v in r.kinds} | {v for p in pending for v in p.variables}
        a, b = (r.keep([v for v in r.kinds if v in shared or v in needed]) for r in (a, b))
        if not rest and all(any(v in keep and v not in shared for v in r.kinds) for r in (a, b)):
            across, pending[:] = list(pending), []
            return _pairs_once(a, b, keep, lambda r: replace(r, frame=reduce(lambda f, p: f.where(predicate(p, r)), across, r.frame)))
        return due(_join(*(replace(r, frame=r.frame.distinct()) for r in (a, b))))

    return due(join_all(parts, join=join))


def _operand(t, r: Relation, prefix: str = "", inner: Relation | None = None) -> tuple[Column, str]:
    if is_variable(t):
        if inner is not None and t in inner.kinds and t not in r.kinds:
            return F.col(f"`in {t}`"), inner.kinds[t]
        return r.col(t), r.kinds[t]
    return literal(t)


def predicate(p: Predicate, r: Relation, inner: Relation | None = None) -> Column:
    (a, ka), (b, kb) = _operand(p.left, r, inner=inner), _operand(p.right, r, inner=inner)
    if p.op in ORDERED:
        return compare(p.op, a, ka, b, kb)
    same = equal(a, ka, b, kb)
    return same if p.op == "=" else ~same


def _negated(source, r: Relation, n: Not) -> tuple[Relation, DataFrame | None, Column]:
    """What the inner clauses of a not find, joined to r by the returned condition; no frame for predicates only."""
    if not n.patterns:
        return r, None, reduce(Column.__and__, (predicate(p, r) for p in n.predicates))
    inner = join_all(relations(source, n.patterns))
    mixed = []
    for p in n.predicates:
        if all(v in inner.kinds for v in p.variables):
            inner = Relation(inner.frame.where(predicate(p, inner)), inner.kinds)
        else:
            mixed.append(p)
    shared = [v for v in inner.kinds if v in r.kinds]
    needed = [v for v in inner.kinds if v in shared or any(v in p.variables for p in mixed)]
    r, right, _ = _aligned(r, inner.keep(needed), shared)
    condition = [F.col(f"`in {v}`").eqNullSafe(r.col(v)) if r.kinds[v] == "any" else F.col(f"`in {v}`") == r.col(v) for v in shared]
    condition += [predicate(p, r, inner) for p in mixed]
    if not condition:
        right = right.limit(1)
    return r, right if mixed else right.distinct() if condition else right, reduce(Column.__and__, condition) if condition else F.lit(True)


def apply_not(source, r: Relation, n: Not) -> Relation:
    r, right, condition = _negated(source, r, n)
    if right is None:
        return Relation(r.frame.where(~condition), r.kinds)
    return Relation(r.frame.join(right, condition, "left_anti"), r.kinds)


def apply_or(source, r: Relation, o: Or) -> Relation:
    """Keeps a row for which any alternative holds. Patterns and nots become existence marks."""
    marks: list[Column] = []
    shown = dict(r.kinds)
    for i, a in enumerate(o.alternatives):
        if isinstance(a, Predicate):
            marks.append(predicate(a, r))
            continue
        wanted = a if isinstance(a, Not) else Not((a,))
        r, right, condition = _negated(source, r, wanted)
        if right is None:
            marks.append(~condition)
            continue
        mark = f"mark {i}"
        kinds = dict(r.kinds)
        if any(p for p in wanted.predicates if not all(v in {x for q in wanted.patterns for x in q.variables} for v in p.variables)):
            # a condition across both sides: a semi join stops at a row's first match and makes no pairs; equal rows have equal marks
            met = r.frame.distinct().join(right, condition, "left_semi")
            met = met.select(*(r.col(v).alias(f"same {v}") for v in kinds), F.lit(True).alias(mark))
            same = reduce(Column.__and__, (r.col(v).eqNullSafe(F.col(f"`same {v}`")) for v in kinds))
            frame = r.frame.join(met, same, "left").drop(*(f"same {v}" for v in kinds))
        else:
            frame = r.frame.join(right.withColumn(mark, F.lit(True)), condition, "left").drop(*right.columns)
        r = Relation(frame, kinds | {mark: "bool"})  # marks travel like variables until the end
        found = F.coalesce(F.col(f"`{mark}`"), F.lit(False))
        marks.append(~found if isinstance(a, Not) else found)
    kept = r.frame.where(reduce(Column.__or__, marks))
    return Relation(kept.select(*(r.col(v) for v in shown)), {v: r.kinds[v] for v in shown})


def _variables(clause) -> set[str]:
    inner = clause.alternatives if isinstance(clause, Or) else clause.inner if isinstance(clause, Not) else None
    return set(clause.variables) if inner is None else {v for c in inner for v in _variables(c)}


def bindings(source, q: Query, start: Relation | None = None, keep: set[str] | None = None) -> Relation:
    """The bag of bindings of the where part; with keep, a bag that has the right set of bindings of those variables."""
    from chronofact.plans.rules import rule_relation

    parts = relations(source, q.of(Pattern))
    parts += [(sum(not is_variable(t) for t in (c.first, c.second)), rule_relation(source, q.rules, c)) for c in q.of(Apply)]
    if keep is None or start is not None:
        r = join_all(parts, start)
        for p in q.of(Predicate):
            r = Relation(r.frame.where(predicate(p, r)), r.kinds)
    else:
        r = join_sets(parts, q.of(Predicate), keep.union(*(_variables(c) for c in (*q.of(Not), *q.of(Or)))))
    for n in q.of(Not):
        r = apply_not(source, r, n)
    for o in q.of(Or):
        r = apply_or(source, r, o)
    return r


def _optional(source, r: Relation, q: Query) -> Relation:
    """Left joins to one value for each (entity, attribute): the first by storage type, value, transaction, id."""
    for attribute, variable in q.optional:
        if hasattr(source, "matching"):
            rows = source.matching(Wanted(attribute=attribute))
            kind = source.kinds.get(attribute, "any")
            from chronofact.sources.facts import scalar

            tag = F.element_at(F.create_map(*(F.lit(x) for kv in TYPE_ORDER.items() for x in kv)), F.col("value_type"))
            rank = F.struct(tag.alias("t"), scalar().alias("v"), F.col("tx_id"), F.col("triple_id"))
            picked = rows.groupBy(F.col("entity_id").alias("in e")).agg(F.min_by(scalar(kind), rank).alias(variable))
        else:
            found = source.scan(Wanted(attribute=attribute))
            kind = found.kind
            picked = found.frame.groupBy(F.col("e").alias("in e")).agg(F.min("v").alias(variable))
        key = r.col(q.row_binding) if r.kinds[q.row_binding] == "txt" else part(r.col(q.row_binding), r.kinds[q.row_binding], "txt")
        frame = r.frame.join(picked, key == F.col("`in e`"), "left").drop("in e")
        r = Relation(frame, r.kinds | {variable: kind})
    return r


def _aggregate(op: str, c: Column, kind: str) -> tuple[Column, str]:
    if op == "count":
        return F.count_distinct(c), "num"
    number = part(c, kind, "num")
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[op](number), "num"


def term_name(t) -> str:
    if isinstance(t, Ref):
        return t["value"]
    if isinstance(t, bool):
        return str(t).lower()
    return column_name(t) if is_variable(t) else number_text(t) if isinstance(t, (int, float)) else t


def sort_keys(order: tuple[Order, ...], r: Relation) -> list[Column]:
    return [k for o in order for k in orderings(r.col(o.variable), r.kinds[o.variable], o.descending)]


def result(source, q: Query) -> Relation:
    """Rows of find: a column a variable (named with its ?) and one a constant."""
    targets = {t: (op, s) for op, s, t in q.aggregates}
    extra = [v for _, v in q.optional]
    groups = [v for v in q.result_variables if v not in targets and v not in extra]
    # without aggregates the answer is a set of these
    r = bindings(source, q, keep=None if q.aggregates else {*groups, *([q.row_binding] if extra else [])})
    if q.row_binding and q.aggregates:
        groups = list(dict.fromkeys([*groups, *([q.row_binding] if q.row_binding in r.kinds and extra else [])]))
    if q.aggregates:
        made = [_aggregate(op, r.col(s), r.kinds[s]) for op, s, _ in q.aggregates]
        totals = [c.alias(t) for (c, _), t in zip(made, targets)]
        frame = r.frame.groupBy(*(r.col(v) for v in groups)).agg(*totals) if groups else r.frame.agg(*totals)
        r = Relation(frame, {v: r.kinds[v] for v in groups} | dict.fromkeys(targets, "num"))
        if extra:
            r = _optional(source, r, q)
    else:
        if extra:
            bound = list(dict.fromkeys([*groups, q.row_binding]))
            r = _optional(source, Relation(r.keep(bound).frame.distinct(), {v: r.kinds[v] for v in bound}), q)
        shown = [*groups, *extra]
        once = r.once and set(shown) == set(r.kinds)
        r = Relation(r.keep(shown).frame if once else r.keep(shown).frame.distinct(), {v: r.kinds[v] for v in shown}) if shown else Relation(r.frame.select(F.lit(1).alias("?!")).limit(1), {})
    for h in q.having:
        r = Relation(r.frame.where(predicate(h, r)), r.kinds)
    return r


def finished(r: Relation, q: Query, types: dict[str, str] | None = None) -> DataFrame:
    """Public columns: variables without ?, constants under their text, in the order of find."""
    out = []
    for t in q.find:
        if not is_variable(t):
            out.append(literal(t)[0].alias(term_name(t)))
            continue
        c, kind, wanted = r.col(t), r.kinds[t], (types or {}).get(t) or (types or {}).get(column_name(t))
        if wanted:
            family, cast = CASTS[wanted]
            c = part(c, kind, family).cast(cast)
        out.append(c.alias(column_name(t)))
    return r.frame.select(*out)


def ordered(r: Relation, q: Query) -> Relation:
    frame = r.frame
    if q.order:
        frame = frame.orderBy(*sort_keys(q.order, r))
    if q.offset:
        frame = frame.offset(q.offset)
    if q.limit is not None:
        frame = frame.limit(q.limit)
    return Relation(frame, r.kinds)


def run(source, query, types: dict[str, str] | None = None) -> DataFrame:
    """The answer to a query (JSON form or parsed) over a source of facts."""
    q = parse(query)
    return finished(ordered(result(source, q), q), q, types)


__all__ = ["ANY", "QueryError", "Relation", "bindings", "family_is", "finished", "null_of", "ordered", "result", "run"]
