"""The query language: behaviour case by case, and random queries against a plain evaluator."""

import random

import pytest
from pyspark.sql import Row

from chronofact.errors import CursorError, QueryError, UnboundVariable
from chronofact.plans.ast import parse, parse_wrapped
from chronofact.plans.build import run
from chronofact.plans.page import decode, encode, explain, run_page
from chronofact.sources.basis import Basis
from chronofact.sources.facts import FACTS, FactTable
from chronofact.sources.store import packed
from tests.core.naive import solve

NOW = Basis(valid_at=1000)


def source(spark, facts, kinds=None, **columns):
    rows = []
    for i, (e, a, kind, v, *rest) in enumerate(facts):
        r = {"triple_id": f"{i:026d}", "entity_id": e, "attribute": a, **packed({"type": kind, "value": v}), "recorded_at": 0, "recorded_position": 1, "valid_from": 0, "schema_version": 1, "tx_id": f"_tx/{i % 3}", **columns}
        r.update(rest[0] if rest else {})
        rows.append(tuple(r.get(n) for n in FACTS.names))
    return FactTable(spark.createDataFrame(rows, FACTS), NOW, kinds)


def plain(v):
    if isinstance(v, Row):
        return (v["num"], v["bool"], v["txt"])[v["fam"]]
    return v


def answers(src, q, **kw):
    return [tuple(plain(v) for v in r) for r in run(src, q, **kw).collect()]


PEOPLE = [
    ("p1", ":name", "string", "Alice"), ("p1", ":age", "number", 30), ("p1", ":status", "string", "active"), ("p2", ":name", "string", "Bob"), ("p2", ":age", "number", 25), ("p2", ":status", "string", "inactive"),
    ("p3", ":name", "string", "Carol"), ("p3", ":age", "number", 35), ("p4", ":name", "string", "Dan"), ("m1", ":title", "string", "Film"), ("m1", ":year", "number", 1999), ("m1", ":director", "ref", "p4"),
    ("m1", ":cast", "ref", "p1"), ("m1", ":cast", "ref", "p2"), ("m2", ":title", "string", "Other"), ("m2", ":year", "number", 2005), ("m2", ":director", "ref", "p4"), ("m2", ":cast", "ref", "p2"),
]
FAMILIES = [("a", ":v", "number", 7), ("b", ":v", "datetime", 7), ("c", ":v", "string", "7"), ("d", ":v", "boolean", True), ("e", ":v", "ref", "c"), ("f", ":v", "json", {"k": 1}), ("g", ":v", "string", "c"), ("h", ":v", "boolean", False)]


def test_families_join_group_and_dedupe(spark):
    src = source(spark, FAMILIES)
    assert sorted(map(str, answers(src, {"find": ["?v"], "where": [["?e", ":v", "?v"]]}))) == sorted(map(str, [(7.0,), ("7",), (True,), (False,), ("c",), ('{"k":1}',)]))
    assert sorted(answers(src, {"find": ["?x", "?y"], "where": [["?x", ":v", "?v"], ["?y", ":v", "?v"], ["!=", "?x", "?y"]]})) == [("a", "b"), ("b", "a"), ("e", "g"), ("g", "e")]
    assert answers(src, {"find": ["?e"], "where": [["?e", ":v", {"type": "ref", "value": "c"}]]}) == [("e",)]
    assert sorted(answers(src, {"find": ["?e"], "where": [["?e", ":v", "c"]]})) == [("e",), ("g",)]
    assert sorted(answers(src, {"find": ["?e"], "where": [["?e", ":v", 7]]})) == [("a",), ("b",)]
    counts = answers(src, {"find": ["?v", "?n"], "where": [["?e", ":v", "?v"]], "aggregate": [["count", "?e", "?n"]], "having": [[">", "?n", 1]]})
    assert sorted(map(str, counts)) == ["('c', 2)", "(7.0, 2)"]


def test_predicates_across_families(spark):
    src = source(spark, FAMILIES)
    assert {e for (e,) in answers(src, {"find": ["?e"], "where": [["?e", ":v", "?v"], ["!=", "?v", 7]]})} == set("cdefgh")
    assert {e for (e,) in answers(src, {"find": ["?e"], "where": [["?e", ":v", "?v"], [">=", "?v", 0]]})} == set("ab")
    wrapped = {"inner": {"find": ["?e", "?v"], "where": [["?e", ":v", "?v"]]}}
    keep = lambda op, value=None: {r["e"] for r in run_page(src, {**wrapped, "filters": [{"column": "?v", "op": op, **({} if value is None else {"value": value})}]}).frame.collect()}
    assert keep("!=", 8) == set("ab") and keep("!=", "zz") == set("cefg") and keep("=", 7) == set("ab")
    assert keep("like", "%c%") == set("eg") and keep("not-like", "c") == set("cf") and keep("ilike", "C") == set("eg") and keep("like", "C") == set()
    assert keep(">", "7") == set("efg") and keep("<", 8) == set("ab") and keep("is-null") == set() and keep("is-not-null") == set("abcdefgh")


def test_like_takes_backslashes_literally(spark):
    src = source(spark, [("a", ":v", "string", "x\\%y"), ("b", ":v", "string", "x\\zy"), ("c", ":v", "string", "x%y")])
    q = {"inner": {"find": ["?e", "?v"], "where": [["?e", ":v", "?v"]]}, "filters": [{"column": "?v", "op": "like", "value": "x\\%y"}]}
    assert {r["e"] for r in run_page(src, q).frame.collect()} == {"a", "b"}


def test_patterns(spark):
    src = source(spark, [*PEOPLE, ("s", ":self", "ref", "s"), ("s", ":self", "string", "other")])
    assert answers(src, {"find": ["?x"], "where": [["?x", ":self", "?x"]]}) == [("s",)]
    assert sorted(answers(src, {"find": ["?a"], "where": [["p1", "?a", "?v", "?tx"]]})) == [(":age",), (":name",), (":status",)]
    assert answers(src, {"find": ["?tx"], "where": [["p1", ":age", "?v", "?tx"]]}) == [("_tx/1",)]
    assert answers(src, {"find": ["?v"], "where": [["p1", ":age", "?v", "_tx/0"]]}) == []
    assert sorted(answers(src, {"find": ["?n", "x", 1, True], "where": [["?m", ":cast", "?p"], ["?p", ":name", "?n"]]})) == [("Alice", "x", 1.0, True), ("Bob", "x", 1.0, True)]
    multi = {"find": ["?t", "?n"], "where": [["?m", ":title", "?t"], ["?m", ":cast", "?p"], ["?p", ":name", "?n"], ["?m", ":year", "?y"], [">", "?y", 2000]]}
    assert answers(src, multi) == [("Other", "Bob")]
    assert answers(src, {"find": ["x"], "where": [["p1", ":age", 30]]}) == [("x",)] and answers(src, {"find": ["x"], "where": [["p1", ":age", 31]]}) == []


def test_clause_order_does_not_matter(spark):
    src = source(spark, PEOPLE)
    where = [["?m", ":cast", "?p"], [">", "?a", 26], ["not", ["?p", ":status", "inactive"]], ["?p", ":age", "?a"], ["or", [["=", "?a", 30], ["?p", ":name", "Bob"]]]]
    for _ in range(5):
        random.Random(_).shuffle(where)
        assert answers(src, {"find": ["?p"], "where": where}) == [("p1",)]


def test_aggregates_are_bags_but_count_is_distinct(spark):
    src = source(spark, [("a", ":x", "number", 10), ("b", ":x", "number", 10), ("a", ":t", "string", "u"), ("b", ":t", "string", "u"), ("c", ":x", "string", "no"), ("c", ":t", "string", "u")])
    q = {"find": ["?t", "?s", "?n", "?m"], "where": [["?e", ":x", "?x"], ["?e", ":t", "?t"]], "aggregate": [["sum", "?x", "?s"], ["count", "?x", "?n"], ["max", "?x", "?m"]]}
    assert answers(src, q) == [("u", 20.0, 2, 10.0)]
    empty = {"find": ["?n", "?s"], "where": [["?e", ":none", "?x"]], "aggregate": [["count", "?e", "?n"], ["sum", "?x", "?s"]]}
    assert answers(src, empty) == [(0, None)]
    assert answers(src, {**empty, "find": ["?x", "?n"], "aggregate": [["count", "?e", "?n"]]}) == []
    assert answers(src, {"find": ["?s"], "where": [["?e", ":x", "?x"]], "aggregate": [["sum", "?e", "?s"]]}) == [(None,)]


MIXED = [("1", ":v", "number", 2), ("2", ":v", "number", 10), ("3", ":v", "datetime", 5), ("4", ":v", "boolean", False), ("5", ":v", "boolean", True), ("6", ":v", "string", "10"), ("7", ":v", "string", "2"), *((str(i), ":k", "string", "x") for i in range(1, 9))]
OPTIONAL = {"find": ["?e", "?v"], "where": [["?e", ":k", "x"]], "optionalProjection": {"rowBinding": "?e", "fields": [{"attribute": ":v", "variable": "?v"}]}}


@pytest.mark.parametrize("direction,want", [("asc", [2, 5, 10, False, True, "10", "2", None]), ("desc", [10, 5, 2, True, False, "2", "10", None])])
def test_mixed_order_and_pages(spark, direction, want):
    src = source(spark, MIXED)
    order = [{"variable": "?v", "direction": direction}]
    assert [v for _, v in answers(src, {**OPTIONAL, "orderBy": order})] == want
    assert [v for _, v in answers(src, {**OPTIONAL, "orderBy": order, "offset": 2, "limit": 3})] == want[2:5]
    got, cursor = [], None
    while True:
        page = run_page(src, {"inner": OPTIONAL, "orderBy": order, "limit": 3, "includeCount": True, **({"cursor": cursor} if cursor else {})})
        got += [plain(r["v"]) for r in page.frame.collect()]
        assert page.total == 8
        cursor = page.next_cursor
        if cursor is None:
            break
    assert got == want


def test_optional_takes_the_first_of_several_values(spark):
    src = source(spark, [("a", ":k", "string", "x"), ("a", ":v", "string", "z"), ("a", ":v", "number", 9), ("a", ":v", "number", 3), ("b", ":k", "string", "x")])
    assert sorted(answers(src, OPTIONAL), key=str) == [("a", 3.0), ("b", None)]
    hidden = {**OPTIONAL, "find": ["?v"]}
    assert sorted(answers(src, hidden), key=str) == [(3.0,), (None,)]


def test_cursor_errors(spark):
    src = source(spark, MIXED)
    w = {"inner": OPTIONAL, "orderBy": [{"variable": "?v"}], "limit": 2}
    cursor = run_page(src, w).next_cursor
    for change, reason in (({"cursor": "%%%"}, "malformed"), ({"cursor": encode({**decode(cursor), "version": 2})}, "unsupported_version"), ({"cursor": cursor, "orderBy": [{"variable": "?e"}]}, "query_mismatch")):
        with pytest.raises(CursorError) as e:
            run_page(src, {**w, **change})
        assert e.value.reason == reason
    with pytest.raises(CursorError, match="scope"):
        run_page(src, {**w, "cursor": cursor}, scope="elsewhere")
    with pytest.raises(CursorError, match="basis"):
        run_page(src, {**w, "cursor": cursor}, basis=Basis(valid_at=5))


CHAIN = [("a", ":p", "ref", "b"), ("b", ":p", "ref", "c"), ("c", ":p", "string", "d"), ("d", ":p", "number", 5), ("d", ":p", "boolean", True), ("x", ":p", "ref", "y"), ("y", ":p", "ref", "x")]
REACH = [{"name": "reach", "body": [["?x", ":p", "?y"]]}, {"name": "reach", "body": [["?x", ":p", "?z"], ["reach", "?z", "?y"]]}]


def test_recursion(spark):
    src = source(spark, CHAIN)
    ask = lambda a, b, rules=REACH: {r for r in answers(src, {"find": [v for v in (a, b) if v.startswith("?")], "where": [["reach", a, b]], "rules": rules})}
    closure = {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x"), ("x", "x"), ("y", "y")}
    assert ask("?a", "?b") == closure
    assert ask("a", "?b") == {("b",), ("c",), ("d",)} and ask("?a", "d") == {("a",), ("b",), ("c",)}
    assert answers(src, {"find": ["?s"], "where": [["reach", "?s", "?s"]], "rules": REACH}) and {r for r in answers(src, {"find": ["?s"], "where": [["reach", "?s", "?s"]], "rules": REACH})} == {("x",), ("y",)}
    short = [{**r, "maxDepth": 1} for r in REACH]  # the largest of a group counts
    assert ask("?a", "?b", short) == closure - {("a", "d")} and ask("a", "?b", short) == {("b",), ("c",)}


@pytest.mark.parametrize("bad", [
    {"find": ["?x"], "where": []}, {"find": ["?x"], "where": [["not", ["?x", ":a", 1]]]}, {"find": ["?y"], "where": [["?x", ":a", 1]]}, {"find": ["?x", "?x"], "where": [["?x", ":a", 1]]},
    {"find": ["?x"], "where": [["?x", ":a", "?v"], [">", "?x", 1]]}, {"find": ["?x"], "where": [["?x", ":a", "?v"], [">", "?v", "1"]]}, {"find": ["?x"], "where": [["?x", ":a", "?v"], [">", "?w", 1]]},
    {"find": ["?x"], "where": [["?x", ":a", 1], ["or", []]]}, {"find": ["?x"], "where": [["?x", ":a", 1], ["or", [["or", [["?x", ":b", 1]]]]]]}, {"find": ["?x"], "where": [["reach", "?x", "?y"]]},
    {"find": ["?x", "?n"], "where": [["?x", ":a", "?v"]], "aggregate": [["count", "?w", "?n"]]}, {"find": ["?x"], "where": [["?x", ":a", "?v"]], "aggregate": [["count", "?v", "?n"]]},
    {"find": ["?v", "?n"], "where": [["?x", ":a", "?v"]], "aggregate": [["count", "?v", "?n"]]}, {"find": ["?x"], "where": [["?x", ":a", "?v"]], "having": [[">", "?x", 1]]}, {"find": ["?x"], "where": [["?x", ":a", 1]], "orderBy": [{"variable": "?v"}]},
    {"find": ["?x"], "where": [["?x", ":a", 1]], "limit": 0}, {"find": ["?x"], "where": [["?x", ":a", 1]], "offset": -1}, {"find": ["?x"], "where": [["?x", 3, 1]]}, {"find": ["?x"], "where": [["?x", ":a", {"type": "json", "value": "x"}]]},
    {"find": ["?a", "?b"], "where": [["r", "?a", "?b"]], "rules": [{"name": "r", "body": [["?a", ":p", "?b"], ["r", "?b", "?c"]]}]}, {"find": ["?a", "?b"], "where": [["r", "?a", "?b"]], "rules": [{"name": "r", "body": []}]},
    {"find": ["?a", "?b"], "where": [["r", "?a", "?b"]], "rules": [{"name": "r", "body": [["?a", ":p", "?b"]]}, {"name": "r", "body": [["r", "?a", "?c"], ["?c", ":p", "?b"]]}]},
    {"find": ["?x"], "where": [["?x", ":a", 1], ["not", *([["?x", ":b", 1]] * 9)]]}, {"find": ["?x"], "where": [["?x", ":a", 1]], "optionalProjection": {"rowBinding": "?x", "fields": [{"attribute": ":b", "variable": "?v"}]}},
])
def test_bad_queries_fail_before_they_run(bad):
    with pytest.raises(QueryError):
        parse(bad)


@pytest.mark.parametrize("f", [{"column": "?z", "op": "=", "value": 1}, {"column": "?v", "op": "like", "value": 1}, {"column": "?v", "op": "is-null", "value": 1}, {"column": "?v", "op": "="}, {"column": "?v", "op": ">", "value": True}, {"column": "?v", "op": "about", "value": 1}])
def test_bad_filters(f):
    with pytest.raises(QueryError):
        parse_wrapped({"inner": {"find": ["?v"], "where": [["?e", ":v", "?v"]]}, "filters": [f]})
    assert issubclass(UnboundVariable, QueryError)


def test_user_text_is_never_code(spark):
    evil = "x' OR 1=1 --"
    src = source(spark, [("a", ":v", "string", evil), ("b`c", ":w\"x", "string", "`) drop")])
    assert answers(src, {"find": ["?e"], "where": [["?e", ":v", evil]]}) == [("a",)]
    assert answers(src, {"find": ["?a"], "where": [["b`c", "?a", "`) drop"]]}) == [(':w"x',)]
    assert answers(src, {"find": ["?e"], "where": [["?e", ":v", "x' OR '1'='1"]]}) == []


def test_kinds_give_raw_columns_and_equal_answers(spark):
    q = {"find": ["?n", "?a"], "where": [["?p", ":name", "?n"], ["?p", ":age", "?a"], [">", "?a", 26]]}
    assert sorted(answers(source(spark, PEOPLE), q)) == sorted(answers(source(spark, PEOPLE, {":name": "txt", ":age": "num"}), q))
    assert dict(run(source(spark, PEOPLE, {":name": "txt", ":age": "num"}), q).dtypes) == {"n": "string", "a": "double"}
    assert dict(run(source(spark, PEOPLE), q, {"?n": "string", "?a": "bigint"}).dtypes) == {"n": "string", "a": "bigint"}
    assert explain(source(spark, PEOPLE), q)["metrics"]["patterns"] == 2


def random_query(r):
    e = lambda: r.choice(["?a", "?b", "?c", "e:1", "e:2"])
    v = lambda: r.choice(["?a", "?v", "?w", "e:1", 1, 2, "t", True])
    a = lambda: r.choice([":p", ":q", ":p", ":q", "?k"])
    pattern = lambda: [e(), a(), v()]
    where = [pattern() for _ in range(r.choice([1, 2, 2, 3]))]
    bound = sorted({t for c in where for t in c if isinstance(t, str) and t.startswith("?")})
    values = sorted({c[2] for c in where if isinstance(c[2], str) and c[2].startswith("?")})
    if values and r.random() < 0.3:
        where.append([r.choice(["<", ">="]), r.choice(values), r.choice([1, 2])])
    if bound and r.random() < 0.3:
        where.append([r.choice(["=", "!="]), r.choice(bound), r.choice([*bound, 1, "e:1", True])])
    if r.random() < 0.4:
        inner = [pattern() for _ in range(r.choice([1, 2]))]
        free = sorted({t for c in inner for t in c if isinstance(t, str) and t.startswith("?")} | set(bound))
        where.append(["not", *inner, *([["!=", r.choice(free), r.choice([1, *free])]] if free and r.random() < 0.5 else [])])
    if r.random() < 0.4:
        where.append(["or", [pattern(), *([["=", r.choice(bound), 1]] if bound else []), *([["not", pattern()]] if r.random() < 0.5 else [])]])
    if not bound:
        return None
    find = r.sample(bound, r.randint(1, len(bound)))
    q = {"find": find, "where": where}
    left = [b for b in bound if b not in find]
    if left and r.random() < 0.4:
        q = {**q, "find": [*find, "?n", "?s"], "aggregate": [["count", left[0], "?n"], ["sum", left[0], "?s"]]}
    return q


@pytest.mark.parametrize("seed", range(24))
def test_random_queries_match_the_plain_evaluator(spark, seed):
    r = random.Random(seed)
    facts = sorted({(f"e:{r.randrange(4)}", r.choice([":p", ":q"]), *r.choice([("ref", f"e:{r.randrange(4)}"), ("number", r.randrange(3)), ("string", "t"), ("boolean", r.random() < 0.5), ("datetime", r.randrange(3))])) for _ in range(14)}, key=str)
    src = source(spark, facts)
    src.facts = src.facts.repartition(2).cache()
    stored = [(e, a, k, float(v) if k in ("number", "datetime") else v) for e, a, k, v in facts]
    for _ in range(3):
        q = random_query(r)
        if q is None:
            continue
        want = solve(stored, q)
        kind = lambda v: "bool" if isinstance(v, bool) else "num" if isinstance(v, (int, float)) else "txt"
        rows = answers(src, q)
        got = {tuple(None if v is None else (kind(v), float(v) if kind(v) == "num" else v) for v in row) for row in rows}
        assert got == want and len(rows) == len(got), q
    src.facts.unpersist()


def test_filters_reach_the_files(spark, tmp_path):
    source(spark, PEOPLE).facts.write.parquet(f"{tmp_path}/f")
    src = FactTable(spark.read.parquet(f"{tmp_path}/f"), NOW, {":name": "txt"})
    frame = run(src, {"find": ["?n"], "where": [["?p", ":name", "?n"]]})
    plan = frame._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(attribute,:name)" in plan and "IsNull(retracted_at)" in plan
