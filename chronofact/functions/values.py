"""Values: seven storage types, three scalar families, and columns over them.

A value column is specialised to one family where the source knows it ("num", "bool", "txt": a plain double,
boolean or string column) and is otherwise of kind "any": a struct (fam, num, bool, txt) whose order is the
public mixed order number < boolean < text.
"""

from __future__ import annotations

import json
import math
from hashlib import sha256

from pyspark.sql import Column
from pyspark.sql import functions as F

#: storage type to scalar family
FAMILY = {"string": "txt", "number": "num", "boolean": "bool", "datetime": "num", "ref": "txt", "json": "txt", "blob": "txt"}
#: order of storage types among several values of one attribute
TYPE_ORDER = {"boolean": 1, "number": 2, "string": 3, "ref": 4, "datetime": 5, "json": 6, "blob": 7}
FAM = {"num": 0, "bool": 1, "txt": 2}
ANY = "struct<fam:tinyint,num:double,bool:boolean,txt:string>"


def null_of(kind: str) -> Column:
    return F.lit(None).cast({"num": "double", "bool": "boolean", "txt": "string", "any": ANY}[kind])


def lift(c: Column, kind: str) -> Column:
    """c as an "any" struct; null stays null."""
    if kind == "any":
        return c
    fields = [F.lit(FAM[kind]).cast("tinyint").alias("fam")]
    for k, t in (("num", "double"), ("bool", "boolean"), ("txt", "string")):
        fields.append((c if k == kind else F.lit(None)).cast(t).alias(k))
    return F.when(c.isNotNull(), F.struct(*fields))


def literal_kind(value) -> str:
    if isinstance(value, dict):
        return "txt"
    if isinstance(value, bool):
        return "bool"
    return "num" if isinstance(value, (int, float)) else "txt"


def literal(value) -> tuple[Column, str]:
    kind = literal_kind(value)
    raw = value["value"] if isinstance(value, dict) else value
    return F.lit(float(raw) if kind == "num" else raw), kind


def part(c: Column, kind: str, family: str) -> Column:
    """The scalar of one family, null where the value is of another."""
    if kind == family:
        return c
    return c[family] if kind == "any" else null_of(family)


def family_is(c: Column, kind: str, family: str) -> Column:
    if kind == "any":
        return F.coalesce(c["fam"] == FAM[family], F.lit(False))
    return c.isNotNull() if kind == family else F.lit(False)


def equal(a: Column, ka: str, b: Column, kb: str) -> Column:
    """Same family and same scalar; never null."""
    if ka == kb != "any":
        return F.coalesce(a == b, F.lit(False))
    if "any" not in (ka, kb):
        return F.lit(False)
    if ka == kb:
        return F.coalesce(a == b, F.lit(False))
    family = ka if kb == "any" else kb
    return F.coalesce(part(a, ka, family) == part(b, kb, family), F.lit(False))


def compare(op: str, a: Column, ka: str, b: Column, kb: str, families: tuple[str, ...] = ("num",)) -> Column:
    """An ordered comparison within the given families, false elsewhere; never null."""
    out = F.lit(False)
    for f in families:
        if ka in (f, "any") and kb in (f, "any"):
            x, y = part(a, ka, f), part(b, kb, f)
            out = out | F.coalesce({">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op], F.lit(False))
    return out


def orderings(c: Column, kind: str, descending: bool) -> list[Column]:
    """Sort keys: families always ascending, the direction inside a family, absent values last."""
    flip = (lambda x: x.desc_nulls_last()) if descending else (lambda x: x.asc_nulls_last())
    if kind != "any":
        return [flip(c)]
    return [c["fam"].asc_nulls_last(), flip(c["num"]), flip(c["bool"]), flip(c["txt"])]


def unify(ka: str, kb: str) -> str:
    return ka if ka == kb else "any"


# --- text forms that identifiers are made of -------------------------------------------------------------


def number_text(x: float, signed_zero: bool = False) -> str:
    """The shortest decimal text that reads back as x, in the notation of ECMAScript; with signed_zero, -0 for a negative zero."""
    if not math.isfinite(x):
        raise ValueError("not a finite number")
    if x == 0:
        return "-0" if signed_zero and math.copysign(1, x) < 0 else "0"
    digits = repr(abs(float(x)))
    mantissa, _, exponent = digits.partition("e")
    whole, _, fraction = mantissa.partition(".")
    fraction = "" if fraction == "0" else fraction
    figures = (whole + fraction).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + fraction) - len((whole + fraction).lstrip("0")))
    figures = figures.rstrip("0")
    n = len(figures)
    sign = "-" if x < 0 else ""
    if n <= point <= 21:
        return sign + figures + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{figures[:point]}.{figures[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{figures}"
    e = f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return sign + figures[0] + (f".{figures[1:]}" if n > 1 else "") + e


def canonical_json(value, signed_zero: bool = False) -> str:
    """JSON with keys sorted by UTF-16 units and no blanks; numbers as in ECMAScript; rejects what JSON can't say.

    A negative zero is written as 0, so that both have one text; signed_zero keeps its sign.
    """
    open_now: set[int] = set()

    def text(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return number_text(float(v), signed_zero)
        if isinstance(v, str):
            return json.dumps(v, ensure_ascii=False)
        if id(v) in open_now:
            raise ValueError("value contains itself")
        open_now.add(id(v))
        try:
            if isinstance(v, dict):
                return "{" + ",".join(f"{text(k)}:{text(v[k])}" for k in sorted(v, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
            if isinstance(v, (list, tuple)):
                return "[" + ",".join(map(text, v)) + "]"
        finally:
            open_now.discard(id(v))
        raise ValueError(f"{type(v).__name__} has no JSON form")

    return text(value)


def content_id(domain: str, payload) -> str:
    """sha256-<hex> of the length-prefixed domain and the canonical payload."""
    body = payload if isinstance(payload, str) else canonical_json(payload)
    return "sha256-" + sha256(f"{len(domain)}:{domain}:{body}".encode()).hexdigest()
