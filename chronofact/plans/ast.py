"""Queries as data: parsing of the JSON form and all checks that come before execution."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from chronofact.errors import QueryError, UnboundVariable

ORDERED = (">", ">=", "<", "<=")
PREDICATES = (*ORDERED, "=", "!=")
AGGREGATES = ("count", "sum", "avg", "min", "max")
TEXT_FILTERS = ("like", "not-like", "ilike", "not-ilike")
FILTERS = (*PREDICATES, *TEXT_FILTERS, "is-null", "is-not-null")
_VARIABLE = re.compile(r"\?[a-zA-Z_][a-zA-Z0-9_]*")
_RULE_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_-]*")
_ATTRIBUTE = re.compile(r":[a-zA-Z_][a-zA-Z0-9_/-]*")
MOST_NEGATED = 8


def is_variable(term) -> bool:
    return isinstance(term, str) and term.startswith("?")


def is_number(term) -> bool:
    return isinstance(term, (int, float)) and not isinstance(term, bool)


@dataclass(frozen=True)
class Pattern:
    entity: object
    attribute: object
    value: object
    tx: object = None

    @property
    def terms(self) -> tuple:
        return (self.entity, self.attribute, self.value, self.tx)

    @property
    def variables(self) -> list[str]:
        return [t for t in self.terms if is_variable(t)]


@dataclass(frozen=True)
class Predicate:
    op: str
    left: object
    right: object

    @property
    def variables(self) -> list[str]:
        return [t for t in (self.left, self.right) if is_variable(t)]


@dataclass(frozen=True)
class Not:
    inner: tuple

    @property
    def patterns(self) -> list[Pattern]:
        return [c for c in self.inner if isinstance(c, Pattern)]

    @property
    def predicates(self) -> list[Predicate]:
        return [c for c in self.inner if isinstance(c, Predicate)]


@dataclass(frozen=True)
class Or:
    alternatives: tuple


@dataclass(frozen=True)
class Apply:
    rule: str
    first: object
    second: object

    @property
    def variables(self) -> list[str]:
        return [t for t in (self.first, self.second) if is_variable(t)]


@dataclass(frozen=True)
class Rule:
    name: str
    body: tuple
    max_depth: int = 100

    @property
    def patterns(self) -> list[Pattern]:
        return [c for c in self.body if isinstance(c, Pattern)]

    @property
    def recursive(self) -> bool:
        return any(isinstance(c, Apply) for c in self.body)


@dataclass(frozen=True)
class Order:
    variable: str
    descending: bool = False


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: object = None


@dataclass(frozen=True)
class Query:
    find: tuple
    where: tuple
    aggregates: tuple = ()
    having: tuple = ()
    order: tuple = ()
    limit: int | None = None
    offset: int | None = None
    rules: tuple = ()
    row_binding: str | None = None
    optional: tuple = ()  # (attribute, variable)
    source: dict = field(default_factory=dict, compare=False, hash=False)

    def of(self, kind: type) -> list:
        return [c for c in self.where if isinstance(c, kind)]

    @property
    def result_variables(self) -> list[str]:
        return [t for t in self.find if is_variable(t)]


@dataclass(frozen=True)
class Wrapped:
    inner: Query
    filters: tuple = ()
    order: tuple = ()
    limit: int | None = None
    cursor: str | None = None
    count: bool = False


# --- parsing ---------------------------------------------------------------------------------------------


def _term(t):
    if is_variable(t):
        if not _VARIABLE.fullmatch(t):
            raise QueryError(f"not a variable: {t}")
        return t
    if isinstance(t, dict):
        if t.get("type") != "ref" or not isinstance(t.get("value"), str):
            raise QueryError(f"not a typed constant: {t}")
        return {"type": "ref", "value": t["value"]} if not isinstance(t, Ref) else t
    if isinstance(t, (str, bool)) or is_number(t):
        return t
    raise QueryError(f"not a term: {t!r}")


class Ref(dict):
    """A reference constant; hashable, so clauses can be compared."""

    def __init__(self, value: str):
        super().__init__(type="ref", value=value)

    def __hash__(self):
        return hash(self["value"])


def _name(t):
    if isinstance(t, str):
        return _term(t)
    raise QueryError(f"an identity is a string or a variable, not {t!r}")


def _value(t):
    t = _term(t)
    return Ref(t["value"]) if isinstance(t, dict) else t


def is_application(c) -> bool:
    """A bare word first and no attribute second: an application of a rule, not a pattern."""
    return len(c) == 3 and isinstance(c[0], str) and c[0] not in ("not", "or") and bool(_RULE_NAME.fullmatch(c[0])) and not (isinstance(c[1], str) and c[1].startswith(":"))


def parse_clause(c, allow: tuple[type, ...] = (Pattern, Predicate, Not, Or, Apply)):
    if not isinstance(c, (list, tuple)) or not c:
        raise QueryError(f"not a clause: {c!r}")
    head = c[0]
    if head in PREDICATES and len(c) == 3 and isinstance(head, str):
        out = Predicate(head, _value(c[1]), _value(c[2]))
    elif head == "not":
        if not 2 <= len(c) <= MOST_NEGATED + 1:
            raise QueryError(f"not takes 1 to {MOST_NEGATED} clauses")
        out = Not(tuple(parse_clause(x, (Pattern, Predicate)) for x in c[1:]))
    elif head == "or":
        if len(c) < 2:
            raise QueryError("or takes alternatives")
        nested = len(c) == 2 and isinstance(c[1], (list, tuple)) and (not c[1] or isinstance(c[1][0], (list, tuple)))
        given = c[1] if nested else c[1:]
        if not given:
            raise QueryError("or needs at least one alternative")
        out = Or(tuple(parse_clause(x, (Pattern, Predicate, Not)) for x in given))
    elif is_application(c):
        out = Apply(head, _name(c[1]), _name(c[2]))
    elif len(c) in (3, 4):
        out = Pattern(_name(c[0]), _name(c[1]), _value(c[2]), _name(c[3]) if len(c) == 4 else None)
    else:
        raise QueryError(f"not a clause: {c!r}")
    if not isinstance(out, allow):
        raise QueryError(f"{type(out).__name__.lower()} isn't allowed here: {c!r}")
    return out


def _orders(given) -> tuple[Order, ...]:
    out = []
    for o in given or ():
        if not is_variable(o.get("variable")) or o.get("direction", "asc") not in ("asc", "desc"):
            raise QueryError(f"not an order: {o}")
        out.append(Order(_term(o["variable"]), o.get("direction") == "desc"))
    return tuple(out)


def _whole(value, least: int, what: str) -> int | None:
    if value is None:
        return None
    if not is_number(value) or value != int(value) or value < least:
        raise QueryError(f"{what} must be a whole number of at least {least}")
    return int(value)


def parse(q) -> Query:
    """A checked query from its JSON form."""
    if isinstance(q, Query):
        return q
    if not isinstance(q, dict) or not isinstance(q.get("find"), (list, tuple)) or not isinstance(q.get("where"), (list, tuple)):
        raise QueryError("a query has find and where")
    rules = []
    for r in q.get("rules") or ():
        if not isinstance(r.get("name"), str) or not _RULE_NAME.fullmatch(r["name"]) or r["name"] in ("not", "or"):
            raise QueryError(f"not a rule name: {r.get('name')!r}")
        rules.append(Rule(r["name"], tuple(parse_clause(c, (Pattern, Apply)) for c in r.get("body") or ()), _whole(r.get("maxDepth"), 1, "maxDepth") or 100))
    aggregates = []
    for a in q.get("aggregate") or ():
        if len(a) != 3 or a[0] not in AGGREGATES or not is_variable(a[1]) or not is_variable(a[2]):
            raise QueryError(f"not an aggregate: {a}")
        aggregates.append((a[0], _term(a[1]), _term(a[2])))
    having = tuple(parse_clause(h, (Predicate,)) for h in q.get("having") or ())
    optional = q.get("optionalProjection")
    fields = ()
    if optional:
        for f in optional["fields"]:
            if not isinstance(f.get("attribute"), str) or not _ATTRIBUTE.fullmatch(f["attribute"]) or not is_variable(f.get("variable")):
                raise QueryError(f"not an optional field: {f}")
        fields = tuple((f["attribute"], _term(f["variable"])) for f in optional["fields"])
    out = Query(
        tuple(map(_value, q["find"])), tuple(parse_clause(c) for c in q["where"]), tuple(aggregates), having, _orders(q.get("orderBy")), _whole(q.get("limit"), 1, "limit"), _whole(q.get("offset"), 0, "offset"),
        tuple(rules), _term(optional["rowBinding"]) if optional else None, fields, q,
    )
    check(out)
    return out


def parse_wrapped(w) -> Wrapped:
    if isinstance(w, Wrapped):
        return w
    inner = parse(w["inner"])
    shown, totals = set(inner.result_variables), {t for _, _, t in inner.aggregates}
    filters = []
    for f in w.get("filters") or ():
        column, op, value = f.get("column"), f.get("op"), f.get("value")
        if op not in FILTERS:
            raise QueryError(f"not a filter: {f}")
        if column not in shown:
            raise UnboundVariable(column, f)
        raw = value["value"] if isinstance(value, dict) else value
        nullness = op in ("is-null", "is-not-null")
        if nullness != ("value" not in f or value is None):
            raise QueryError(f"{op} takes {'no' if nullness else 'a'} value")
        if op in TEXT_FILTERS and not isinstance(raw, str):
            raise QueryError(f"{op} takes a string")
        if op in ORDERED and not is_number(raw) and not isinstance(raw, str):
            raise QueryError(f"{op} takes a number or a string")
        if column in totals and not nullness and not is_number(raw):
            raise QueryError(f"a filter on the aggregate {column} takes a number")
        filters.append(Filter(column, op, raw))
    order = _orders(w.get("orderBy"))
    for o in order:
        if o.variable not in shown:
            raise UnboundVariable(o.variable, o)
    return Wrapped(inner, tuple(filters), order, _whole(w.get("limit"), 1, "limit"), w.get("cursor"), bool(w.get("includeCount")))


# --- meaning ---------------------------------------------------------------------------------------------


def _check_predicate(p: Predicate, bound: set[str], numeric: set[str]) -> None:
    for v in p.variables:
        if v not in bound:
            raise UnboundVariable(v, p)
    if p.op in ORDERED:
        for t in (p.left, p.right):
            if is_variable(t) and t not in numeric:
                raise QueryError(f"{t} is compared by order but isn't bound from a value")
            if not is_variable(t) and not is_number(t):
                raise QueryError(f"{p.op} compares numbers, not {t!r}")


def _check_not(n: Not, bound: set[str], numeric: set[str]) -> None:
    inner, values = set(bound), set(numeric)
    for p in n.patterns:
        inner.update(p.variables)
        values.update(v for v in (p.value,) if is_variable(v))
    for p in n.predicates:
        _check_predicate(p, inner, values)


def _check_rules(q: Query) -> set[str]:
    names = {r.name for r in q.rules}
    for name in names:
        own = [r for r in q.rules if r.name == name]
        if all(r.recursive for r in own):
            raise QueryError(f"rule {name} has no definition without recursion")
        for r in own:
            if not r.body:
                raise QueryError(f"rule {name} has an empty body")
            if any(p.tx is not None for p in r.patterns):
                raise QueryError(f"rule {name} binds a transaction")
            if not r.patterns or not is_variable(r.patterns[0].entity) or not is_variable(r.patterns[-1].value):
                raise QueryError(f"rule {name} starts with an entity variable and ends with a value variable")
            if any(isinstance(c, Apply) and c.rule != name for c in r.body):
                raise QueryError(f"rule {name} applies another rule")
            if r.recursive:
                step, call = r.body[0], r.body[-1]
                linear = len(r.body) == 2 and isinstance(step, Pattern) and isinstance(call, Apply)
                if not linear or not is_variable(step.value) or len(call.variables) != 2 or step.value != call.first:
                    raise QueryError(f"rule {name} must recur as [head, attribute, next], [{name}, next, tail]")
    return names


def check(q: Query) -> None:
    names = _check_rules(q)
    bound: set[str] = set()
    numeric: set[str] = set()
    for c in q.of(Pattern):
        bound.update(c.variables)
        numeric.update(v for v in (c.value,) if is_variable(v))
    for c in q.of(Apply):
        if c.rule not in names:
            raise QueryError(f"rule {c.rule} isn't defined")
        bound.update(c.variables)
    if not q.of(Pattern) and not q.of(Apply):
        raise QueryError("a query needs a pattern or a rule application outside not and or")
    for c in q.where:
        alternatives = c.alternatives if isinstance(c, Or) else (c,)
        for a in alternatives:
            if isinstance(a, Predicate):
                _check_predicate(a, bound, numeric)
            elif isinstance(a, Not):
                _check_not(a, bound, numeric)
    sources, targets = set(), set()
    for op, source, target in q.aggregates:
        if source not in bound:
            raise UnboundVariable(source, (op, source, target))
        if target in targets:
            raise QueryError(f"aggregate target {target} is declared twice")
        if target in bound:
            raise QueryError(f"aggregate target {target} is bound already")
        if target not in q.find:
            raise QueryError(f"aggregate target {target} isn't in find")
        sources.add(source)
        targets.add(target)
    extra: set[str] = set()
    if q.row_binding is not None:
        if q.row_binding not in bound:
            raise UnboundVariable(q.row_binding, "optionalProjection")
        for _, v in q.optional:
            if v in extra:
                raise QueryError(f"optional target {v} is declared twice")
            if v in bound or v in targets:
                raise QueryError(f"optional target {v} is bound already")
            if v not in q.find:
                raise QueryError(f"optional target {v} isn't in find")
            extra.add(v)
    shown: set[str] = set()
    for v in q.result_variables:
        if v in shown:
            raise QueryError(f"{v} is projected twice")
        if v in sources:
            raise QueryError(f"aggregate source {v} can't be projected")
        if v not in bound | targets | extra:
            raise UnboundVariable(v, "find")
        shown.add(v)
    if q.having and not targets:
        raise QueryError("having needs an aggregate")
    numbers = {v for v in shown if v in numeric | targets}
    for h in q.having:
        if any(v in extra for v in h.variables):
            raise QueryError("having can't use an optional target")
        _check_predicate(h, shown, numbers)
        if h.op not in ORDERED and any(v in targets for v in h.variables):
            for mine, other in ((h.left, h.right), (h.right, h.left)):
                if mine in targets if isinstance(mine, str) else False:
                    if is_variable(other) and other not in numbers or not is_variable(other) and not is_number(other):
                        raise QueryError(f"an aggregate is compared with a number, not {other!r}")
    for o in q.order:
        if o.variable not in shown:
            raise UnboundVariable(o.variable, o)
