"""Type expressions for assembled entity values: checking, normal form, and whether one type accepts another's values."""

from __future__ import annotations

import datetime
import math
import re
from dataclasses import dataclass, field

from chronofact.errors import ConfigError

PRIMITIVES = ("text", "number", "integer", "boolean", "date", "instant")
_MISSING = object()


@dataclass(frozen=True)
class AnyType:
    pass


@dataclass(frozen=True)
class Prim:
    name: str


@dataclass(frozen=True)
class Enum:
    values: tuple[str, ...]


@dataclass(frozen=True)
class RefType:
    kind: str


@dataclass(frozen=True)
class ListType:
    item: object


@dataclass(frozen=True)
class Field:
    type: object
    optional: bool = False
    fallback: object = field(default=_MISSING, hash=False)


@dataclass(frozen=True)
class Struct:
    fields: tuple[tuple[str, Field], ...]

    @property
    def by_name(self) -> dict[str, Field]:
        return dict(self.fields)


@dataclass(frozen=True)
class UnionType:
    members: tuple


@dataclass(frozen=True)
class Constrained:
    """limits: pattern, min_length, max_length, min, max; repeated numeric limits keep the tightest."""

    base: object
    limits: tuple[tuple[str, object], ...]

    @property
    def tightest(self) -> dict[str, object]:
        out: dict[str, object] = {}
        for name, v in self.limits:
            pick = max if name in ("min", "min_length") else min if name in ("max", "max_length") else None
            out[name] = pick(out[name], v) if pick and name in out else v
        return out


def _is_number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)


def _is_date(v) -> bool:
    if not isinstance(v, str) or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", v):
        return False
    try:
        datetime.date.fromisoformat(v)
    except ValueError:
        return False
    return True


_PRIM = {"text": lambda v: isinstance(v, str), "number": _is_number, "integer": lambda v: _is_number(v) and v == int(v), "boolean": lambda v: isinstance(v, bool), "date": _is_date, "instant": lambda v: _is_number(v) and v == int(v)}


def issues(t, v, path: str = "") -> list[str]:
    """Paths and reasons why v isn't of type t; none if it is."""
    at = path or "value"
    if isinstance(t, AnyType):
        return []
    if isinstance(t, Prim):
        return [] if _PRIM[t.name](v) else [f"{at}: not {t.name}"]
    if isinstance(t, Enum):
        return [] if v in t.values and isinstance(v, str) else [f"{at}: not one of {', '.join(t.values)}"]
    if isinstance(t, RefType):
        return [] if isinstance(v, str) else [f"{at}: not a reference"]
    if isinstance(t, ListType):
        return [p for i, x in enumerate(v) for p in issues(t.item, x, f"{at}[{i}]")] if isinstance(v, (list, tuple)) else [f"{at}: not a list"]
    if isinstance(t, UnionType):
        return [] if any(not issues(m, v, path) for m in t.members) else [f"{at}: fits no member"]
    if isinstance(t, Constrained):
        out = issues(t.base, v, path)
        for name, limit in t.limits if not out else ():
            wrong = {"pattern": lambda: not re.search(limit, v), "min_length": lambda: len(v) < limit, "max_length": lambda: len(v) > limit, "min": lambda: v < limit, "max": lambda: v > limit}[name]()
            out += [f"{at}: {name} {limit}"] if wrong else []
        return out
    if not isinstance(v, dict):
        return [f"{at}: not a struct"]
    known = t.by_name
    out = [f"{at}.{k}: not expected" for k in v if k not in known]
    for name, f in known.items():
        if name in v:
            out += issues(f.type, v[name], f"{at}.{name}" if path else name)
        elif not f.optional:
            out.append(f"{name if not path else f'{at}.{name}'}: missing")
    return out


def accepts(t, v) -> bool:
    return not issues(t, v)


def normalize(t, v):
    """v with fallbacks filled in; fails on values that don't fit."""
    if isinstance(t, Struct) and isinstance(v, dict):
        filled = {}
        for name, f in t.fields:
            if name in v:
                filled[name] = normalize(f.type, v[name])
            elif f.optional and f.fallback is not _MISSING:
                filled[name] = f.fallback
        v = {**{k: x for k, x in v.items() if k not in t.by_name}, **filled}
    elif isinstance(t, ListType) and isinstance(v, (list, tuple)):
        v = [normalize(t.item, x) for x in v]
    wrong = issues(t, v)
    if wrong:
        raise ConfigError("; ".join(wrong))
    return v


# --- is a change of type safe for the values that exist? -----------------------------------------------


@dataclass(frozen=True)
class Verdict:
    """identical, widens or narrows, and why."""

    kind: str
    reasons: tuple[str, ...] = ()

    @property
    def compatible(self) -> bool:
        return self.kind != "narrows"


SAME = Verdict("identical")


def _all(verdicts: list[Verdict]) -> Verdict:
    for kind in ("narrows", "widens"):
        hits = [v for v in verdicts if v.kind == kind]
        if hits:
            return Verdict(kind, tuple(r for v in hits for r in v.reasons))
    return SAME


def _limits(old: dict, new: dict, at: str) -> Verdict:
    worse = []
    for name, limit in new.items():
        had = old.get(name)
        if name == "pattern":
            if had != limit:
                worse.append(f"{at}: pattern {limit} is new or changed")
        elif had is None or (had < limit if name.startswith("min") else had > limit):
            worse.append(f"{at}: {name} {limit} is new or tighter")
    if worse:
        return Verdict("narrows", tuple(worse))
    looser = [f"{at}: {name} was dropped or loosened" for name in old if new.get(name) != old[name]]
    return Verdict("widens", tuple(looser)) if looser else SAME


def subsumes(old, new, at: str = "type") -> Verdict:
    """What values of the old type mean for the new one."""
    if old == new:
        return SAME
    if isinstance(new, AnyType):
        return Verdict("widens", (f"{at}: everything is accepted",))
    if isinstance(old, AnyType):
        return Verdict("narrows", (f"{at}: not everything is accepted any more",))
    a, la = (old.base, old.tightest) if isinstance(old, Constrained) else (old, {})
    b, lb = (new.base, new.tightest) if isinstance(new, Constrained) else (new, {})
    limits = _limits(la, lb, at)
    if not limits.compatible:
        return limits
    if isinstance(a, UnionType):
        return _all([limits, *(subsumes(m, b, f"{at}|{i}") for i, m in enumerate(a.members))])
    if isinstance(b, UnionType):
        fits = any(subsumes(a, m, at).compatible for m in b.members)
        return _all([limits, Verdict("widens", (f"{at}: became one of several",))]) if fits else Verdict("narrows", (f"{at}: fits no member",))
    return _all([limits, _shape(a, b, at)])


def _shape(a, b, at: str) -> Verdict:
    if a == b:
        return SAME
    if isinstance(a, Enum) and b == Prim("text"):
        return Verdict("widens", (f"{at}: any text is accepted",))
    if type(a) is not type(b):
        return Verdict("narrows", (f"{at}: {type(a).__name__} became {type(b).__name__}",))
    if isinstance(a, Prim):
        return Verdict("widens" if (a.name, b.name) == ("integer", "number") else "narrows", (f"{at}: {a.name} became {b.name}",))
    if isinstance(a, Enum):
        lost = [v for v in a.values if v not in b.values]
        return Verdict("narrows", (f"{at}: lost {', '.join(lost)}",)) if lost else Verdict("widens", (f"{at}: more values",))
    if isinstance(a, ListType):
        return subsumes(a.item, b.item, f"{at}[]")
    if isinstance(a, Struct):
        was, now, found = a.by_name, b.by_name, []
        for name in was.keys() | now.keys():
            here = f"{at}.{name}"
            if name not in now:
                found.append(Verdict("narrows", (f"{here}: is refused now",)))
            elif name not in was:
                found.append(Verdict("widens", (f"{here}: may be given",)) if now[name].optional else Verdict("narrows", (f"{here}: is required now",)))
            else:
                if was[name].optional != now[name].optional:
                    found.append(Verdict("narrows", (f"{here}: is required now",)) if was[name].optional else Verdict("widens", (f"{here}: is optional now",)))
                found.append(subsumes(was[name].type, now[name].type, here))
        return _all(found)
    return Verdict("narrows", (f"{at}: {a} became {b}",))
