"""A plain evaluator of the query language over a list of facts: what the DataFrame builder is held against."""

from __future__ import annotations

from chronofact.plans.ast import ORDERED, Apply, Not, Or, Pattern, Predicate, Ref, is_variable, parse


def family(v):
    return "bool" if isinstance(v, bool) else "num" if isinstance(v, (int, float)) else "txt"


def same(a, b):
    return family(a) == family(b) and a == b


def _match(facts, p, env):
    for e, a, kind, v in facts:
        out = dict(env)
        ok = True
        for term, got in ((p.entity, e), (p.attribute, a), (p.value, v)):
            if isinstance(term, Ref):
                ok = kind == "ref" and v == term["value"]
            elif is_variable(term):
                if term in out:
                    ok = same(out[term], got)
                else:
                    out[term] = got
            else:
                ok = same(term, got)
            if not ok:
                break
        if ok:
            yield out


def _value(t, env):
    return env[t] if is_variable(t) else t["value"] if isinstance(t, Ref) else t


def _holds(p, env):
    a, b = _value(p.left, env), _value(p.right, env)
    if p.op in ORDERED:
        return family(a) == family(b) == "num" and {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[p.op]
    return same(a, b) == (p.op == "=")


def _exists(facts, n, env):
    envs = [env]
    for p in n.patterns:
        envs = [y for x in envs for y in _match(facts, p, x)]
    return any(all(_holds(p, x) for p in n.predicates) for x in envs)


def _pairs(facts, rules):
    pairs = set()
    for r in (r for r in rules if not r.recursive):
        envs = [{}]
        for p in r.patterns:
            envs = [y for x in envs for y in _match(facts, p, x)]
        pairs |= {(x[r.patterns[0].entity], x[r.patterns[-1].value]) for x in envs if isinstance(x[r.patterns[-1].value], str)}
    for _ in range(max(r.max_depth for r in rules)):
        more = set(pairs)
        for r in (r for r in rules if r.recursive):
            for x in _match_all(facts, r.body[0]):
                more |= {(x[r.body[0].entity], b) for a, b in pairs if a == x[r.body[0].value] and family(x[r.body[0].value]) == "txt"}
        if more == pairs:
            break
        pairs = more
    return pairs


def _match_all(facts, p):
    return list(_match(facts, p, {}))


def solve(facts, query):
    """Rows of find in the order of find; no order of rows. facts: (entity, attribute, storage type, value)."""
    q = parse(query)
    envs = [{}]
    for c in q.of(Pattern):
        envs = [y for x in envs for y in _match(facts, c, x)]
    for c in q.of(Apply):
        found = _pairs(facts, [r for r in q.rules if r.name == c.rule])
        step = []
        for x in envs:
            for a, b in found:
                y = dict(x)
                ok = True
                for t, v in ((c.first, a), (c.second, b)):
                    if is_variable(t):
                        ok = ok and same(y.setdefault(t, v), v)
                    else:
                        ok = ok and t == v
                if ok:
                    step.append(y)
        envs = step
    for c in q.of(Predicate):
        envs = [x for x in envs if _holds(c, x)]
    for c in q.of(Not):
        envs = [x for x in envs if not _exists(facts, c, x)]
    for c in q.of(Or):
        envs = [x for x in envs if any(_holds(a, x) if isinstance(a, Predicate) else not _exists(facts, a, x) if isinstance(a, Not) else _exists(facts, Not((a,)), x) for a in c.alternatives)]
    if not q.aggregates:
        return {tuple(_tag(_value(t, x)) for t in q.find) for x in envs}
    targets = {t: (op, s) for op, s, t in q.aggregates}
    keys = [t for t in q.result_variables if t not in targets]
    groups = {}
    for x in envs:
        groups.setdefault(tuple(_tag(x[k]) for k in keys), []).append(x)
    if not keys and not groups:
        groups[()] = []
    out = set()
    for k, xs in groups.items():
        row = dict(zip(keys, k))
        for t, (op, s) in targets.items():
            numbers = [float(x[s]) for x in xs if family(x[s]) == "num"]
            row[t] = ("num", float(len({_tag(x[s]) for x in xs}))) if op == "count" else ("num", {"sum": sum, "avg": lambda n: sum(n) / len(n), "min": min, "max": max}[op](numbers)) if numbers else None
        out.add(tuple(row[t] if is_variable(t) else _tag(_value(t, {})) for t in q.find))
    return out


def _tag(v):
    return (family(v), float(v) if family(v) == "num" else v)
