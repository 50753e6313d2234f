"""Wrapped queries: filters on result columns, totals, and keyset pages over a pinned snapshot."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.errors import CursorError
from chronofact.functions.staging import discard, stage
from chronofact.functions.values import FAM, canonical_json, compare, content_id, equal, family_is, lift, literal, part
from chronofact.plans.ast import ORDERED, Filter, Order, Wrapped, is_variable, parse_wrapped
from chronofact.plans.build import Relation, finished, ordered, result, sort_keys
from chronofact.sources.basis import Basis

VERSION = 1


def filter_column(f: Filter, r: Relation) -> Column:
    """True or false, never null: an absent value passes is-null only."""
    c, kind = r.col(f.column), r.kinds[f.column]
    if f.op == "is-null":
        return c.isNull()
    if f.op == "is-not-null":
        return c.isNotNull()
    value, vk = literal(f.value)
    if f.op in ORDERED:
        return compare(f.op, c, kind, value, vk, ("num", "txt"))
    same = equal(c, kind, value, vk)
    if f.op == "=":
        return same
    if f.op == "!=":
        return family_is(c, kind, vk) & ~same
    text = part(c, kind, "txt")
    pattern = f.value.replace("\\", "\\\\")  # a backslash stands for itself
    hit = F.coalesce(text.ilike(pattern) if f.op.endswith("ilike") else text.like(pattern), F.lit(False))
    return family_is(c, kind, "txt") & ~hit if f.op.startswith("not-") else hit


def complete_order(w: Wrapped) -> tuple[Order, ...]:
    """The asked order, then every other projected variable, so that no two rows tie."""
    shown = w.inner.result_variables
    for o in w.order:
        if o.variable not in shown:
            raise CursorError("invalid_ordering", o.variable)
    asked = {o.variable for o in w.order}
    return (*w.order, *(Order(v) for v in shown if v not in asked))


def encode(cursor: dict) -> str:
    return base64.urlsafe_b64encode(canonical_json(cursor).encode()).decode().rstrip("=")


def decode(text: str) -> dict:
    try:
        out = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except Exception as e:
        raise CursorError("malformed") from e
    if not isinstance(out, dict) or not isinstance(out.get("values"), list) or not isinstance(out.get("basis"), dict):
        raise CursorError("malformed")
    if out.get("version") != VERSION:
        raise CursorError("unsupported_version", str(out.get("version")))
    return out


def after(order: tuple[Order, ...], values: list, r: Relation) -> Column:
    """Rows that come after the given ones: equal up to some variable and beyond it there. An absent value comes last."""
    if len(values) != len(order):
        raise CursorError("invalid_ordering")
    beyond, same = F.lit(False), F.lit(True)
    for o, v in zip(order, values):
        c, kind = r.col(o.variable), r.kinds[o.variable]
        if v is None:
            later, equals = F.lit(False), c.isNull()
        else:
            lit, lk = literal(v)
            inside = F.lit(False)
            if kind in (lk, "any"):
                x = part(c, kind, lk)
                inside = F.coalesce(x < lit if o.descending else x > lit, F.lit(False))
            other = F.lit(False)
            if kind == "any":
                other = F.coalesce(c["fam"] > FAM[lk], F.lit(False))
            elif FAM[kind] > FAM[lk]:
                other = c.isNotNull()
            later, equals = inside | other | c.isNull(), equal(c, kind, lit, lk)
        beyond = beyond | (same & later)
        same = same & equals
    return beyond


@dataclass
class Page:
    frame: DataFrame
    next_cursor: str | None
    total: int | None
    basis: Basis


def _fingerprint(w: Wrapped, order: tuple[Order, ...]) -> str:
    return content_id("query", {"inner": w.inner.source, "filters": [[f.column, f.op, f.value] for f in w.filters], "order": [[o.variable, o.descending] for o in order]})


def run_page(source, wrapped, *, basis: Basis | None = None, position: int | None = None, scope: str = "default", types: dict[str, str] | None = None) -> Page:
    """One page. position is the store's current commit position, which the first page pins for all others."""
    w = parse_wrapped(wrapped)
    order = complete_order(w)
    print_, scope_ = _fingerprint(w, order), content_id("scope", scope)
    asked = basis or Basis()
    held = decode(w.cursor) if w.cursor else None
    if held:
        if held.get("scopeFingerprint") != scope_:
            raise CursorError("scope_mismatch")
        if held.get("queryFingerprint") != print_:
            raise CursorError("query_mismatch")
        b = held["basis"]
        basis = Basis(b.get("recordedAt"), b.get("validAt"), b.get("recordedPosition"))
        if (asked.valid_at is not None and asked.valid_at != basis.valid_at) or (asked.recorded_at is not None and asked.recorded_at != basis.recorded_at):
            raise CursorError("basis_mismatch")
    else:
        basis = asked.resolved()
        if basis.recorded_at is None and position is not None:
            basis = Basis(None, basis.valid_at, position)
    view = source.at(basis)
    r = ordered(result(view, w.inner), w.inner)
    if w.filters:
        r = Relation(r.frame.where(reduce(Column.__and__, (filter_column(f, r) for f in w.filters))), r.kinds)
    kept = None
    if w.count:  # counted and paged from one evaluation
        kept = stage(r.frame, "page-rows")
        r = Relation(kept, r.kinds)
    total = r.frame.count() if w.count else None
    if held:
        r = Relation(r.frame.where(after(order, held["values"], r)), r.kinds)
    frame = r.frame.orderBy(*sort_keys(order, r))
    if w.limit is None:
        return Page(finished(Relation(frame, r.kinds), w.inner, types), None, total, basis)
    # limit + 1 rows come to the driver, by one run; the page is made of them
    keys = [lift(r.col(o.variable), r.kinds[o.variable]).alias(f"k{i}") for i, o in enumerate(order)]
    ahead = frame.limit(w.limit + 1).select(F.struct(*(r.col(v) for v in r.frame.columns)).alias("row"), *keys).collect()
    shown = frame.sparkSession.createDataFrame([tuple(x["row"]) for x in ahead[: w.limit]], frame.schema)
    cursor = None
    if len(ahead) > w.limit:
        values = [None if x is None else (x["num"], x["bool"], x["txt"])[x["fam"]] for x in ahead[w.limit - 1][1:]]
        pinned = {"recordedAt": basis.recorded_at, "validAt": basis.valid_at, "recordedPosition": basis.recorded_position}
        cursor = encode({"version": VERSION, "queryFingerprint": print_, "scopeFingerprint": scope_, "basis": pinned, "values": values})
    if kept is not None:
        discard(kept)
    return Page(finished(Relation(shown, r.kinds), w.inner, types), cursor, total, basis)


def explain_page(source, wrapped, *, basis: Basis | None = None) -> dict:
    """``explain`` of a wrapped query's inner query, with its filters and the completed order; nothing is run."""
    w = parse_wrapped(wrapped)
    order = complete_order(w)
    out = explain(source.at((basis or Basis()).resolved()), w.inner.source)
    page = {"filters": [[f.column, f.op, f.value] for f in w.filters], "order": [[o.variable, "desc" if o.descending else "asc"] for o in order], "limit": w.limit, "count": w.count, "continues": w.cursor is not None}
    return {**out, "steps": [*out["steps"], {"label": "page", **page}]}


def explain(source, query, types: dict[str, str] | None = None) -> dict:
    """Counts taken from the query and Spark's own plan."""
    from chronofact.plans.ast import Apply, Not, Or, Pattern, Predicate, parse
    from chronofact.plans.build import run

    q = parse(query)
    frame = run(source, q, types)
    variables = {v for c in q.of(Pattern) for v in c.variables}
    metrics = {"patterns": len(q.of(Pattern)), "predicates": len(q.of(Predicate)), "negations": len(q.of(Not)), "disjunctions": len(q.of(Or)), "applications": len(q.of(Apply)), "aggregates": len(q.aggregates), "variables": len(variables), "constants": sum(t is not None and not is_variable(t) for c in q.of(Pattern) for t in c.terms)}
    return {"backend": "spark", "steps": [{"label": "query", "query": q.source}], "metrics": metrics, "plan": frame._jdf.queryExecution().toString()}
