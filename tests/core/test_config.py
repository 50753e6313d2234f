"""Releases read back from facts, decisions under a release, standing questions, the evaluation cache, store details."""

import pytest
from pyspark.sql import functions as F

from chronofact.errors import ChronofactError, ConfigError, ConstraintViolated, ReadError, WriteError
from chronofact.functions import boolexpr as B
from chronofact.functions import types as T
from chronofact.functions.values import canonical_json
from chronofact.operators import config
from chronofact.operators.constraints import Cardinality, ReferenceTarget, Required, Unique
from chronofact.operators.reactor import Reactor, changed_keys, clock_key, fact_key, rule_key
from chronofact.operators.runtime import Runtime, catalog, rule_node, verify
from chronofact.plans.page import explain_page
from chronofact.sources.basis import Basis
from chronofact.sources.databases import Databases
from chronofact.sources.store import Assert, FactStore, Meta, Retract, RetractPattern, TripleLive, local_root

NOW = 50_000


@pytest.fixture
def store(spark, tmp_path):
    ticks = iter(range(1000, 1_000_000, 1000))
    return FactStore(spark, local_root(str(tmp_path)), clock=lambda: next(ticks))


def rules():
    return [rule_node("vip", B.All((B.Eq(":seg", "A"), B.Not(B.Rule("poor"))))), rule_node("poor", B.Exists(":debt"))]


def test_releases_are_read_back(store):
    tree = config.Node("form", "start", {"title": "x"}, (("field", config.Node("field", "name", {"type": "text"})),))
    a = config.Releases(store)
    first = a.commit([*rules(), tree])
    a.set_ref("live", first.id)
    b = config.Releases(store)
    assert b.resolve("live").nodes == first.nodes and b.snapshot(first.id).parent is None
    second = b.commit([*rules(), config.Node("form", "start", {"title": "y"}, tree.children)], parent=first.id)
    b.set_ref("live", second.id, first.id)
    assert a.resolve("live").id == second.id and a.diff(first.id, second.id)["changed"] == ["form:start"]
    assert a.diff_kinds(first.id, second.id) == {"data": ["form:start"], "refs": [], "closure": []}
    with pytest.raises(ConfigError):
        a.set_ref("live", first.id, first.id)  # it moved meanwhile
    with pytest.raises(ConfigError):
        config.Releases(store).snapshot("sha256-none")
    fresh = config.Releases(store).load()
    assert set(fresh.releases) == {first.id, second.id} and fresh.refs == {"live": second.id}
    title = T.Struct((("title", T.Field(T.Constrained(T.Prim("text"), (("min_length", 2),)), False)),))
    assert {i["part"] for i in fresh.recheck("form", title)} <= {"data"}
    assert [i["part"] for i in fresh.recheck("field", T.Struct((("type", T.Field(T.Prim("number"), False)),)))] == ["child", "child"]


def test_a_forged_node_is_found(store):
    a = config.Releases(store)
    release = a.commit(rules())
    node = next(iter(release.nodes.values()))
    held = store.match(entity=f"_sys/node/{node.id}").first()
    store.transact([Retract(held["triple_id"]), Assert(f"_sys/node/{node.id}", ":sys/body", {"type": "json", "value": {**node.body, "attrs": {"expr": {"op": "lit", "value": True}}}}, "sys.Node")], system=True)
    with pytest.raises(ConfigError):
        config.Releases(store).snapshot(release.id)


def test_decisions_under_a_release(store):
    releases = config.Releases(store)
    first = releases.commit(rules())
    releases.set_ref("live", first.id)
    r = store.transact([Assert("c:1", ":seg", "A", "C"), Assert("c:2", ":seg", "A", "C"), Assert("c:2", ":debt", 5)])
    run = Runtime(store, releases)
    at = Basis(valid_at=NOW)
    one, two = run.decide("live", "vip", "c:1", NOW, at), run.decide("live", "vip", "c:2", NOW, at)
    assert (one["proof"]["truth"], two["proof"]["truth"]) == (True, False) and verify(one) and not verify({**one, "subject": "c:2"})
    assert one["release"] == first.id and set(catalog(first)) == {"vip", "poor"}
    store.transact([Retract(r.triples[0])])
    assert run.decide("live", "vip", "c:1", NOW, at)["proof"]["truth"] is None
    assert run.decide("live", "vip", "c:1", NOW, Basis(recorded_position=r.position, valid_at=NOW))["id"] == one["id"]
    assert {x["subject"]: x["truth"] for x in run.decide_all("live", "vip", NOW, "C", at).collect()}["c:2"] is False
    store.transact([Assert("c:3", ":seg", "A"), Assert("c:3", ":seg", "B"), Assert("c:4", ":seg", {"type": "json", "value": [1]})])
    for subject in ("c:3", "c:4"):
        with pytest.raises(ConfigError):
            run.decide("live", "vip", subject, NOW, at)
    with pytest.raises(ConfigError):
        run.decide("none", "vip", "c:1", NOW, at)


def test_cache_by_what_was_observed():
    rules_, cache = {"vip": B.All((B.Eq(":seg", "A"), B.Before(":due"))), "other": B.Lit(True)}, B.EvaluationCache()
    day = 86_400_000
    world = {("c", ":seg"): "A", ("c", ":due"): 5.0 * day, ("c", ":unread"): 1}
    ask = lambda w, now, catalog=rules_: cache.truth(B.Rule("vip"), w, "c", now, catalog)["truth"]
    assert ask(world, 6 * day) is True and ask({**world, ("c", ":unread"): 2}, 6 * day + 5) is True
    assert (cache.hits, cache.misses) == (1, 1)  # another day's answer and an unread fact don't matter
    assert ask(world, 4 * day) is False and ask({**world, ("c", ":seg"): "B"}, 6 * day) is False and ask(world, 6 * day, {**rules_, "other": B.Lit(False)}) is True
    assert (cache.hits, cache.misses) == (2, 3) and cache.shapes(B.Rule("vip"), "c") == 1
    assert ask(world, 6 * day, {**rules_, "vip": B.Lit(False)}) is False and cache.misses == 4
    for e in (B.Any((B.Lit(True), B.Exists(":x", "e:1"))), B.Not(B.Before(":d", "exact")), B.Eq(":a", 1.5)):
        assert B.from_json(B.to_json(e)) == e
    with pytest.raises(ConfigError):
        B.from_json({"op": "eq", "what": 1})


def test_reactor(store):
    spark = store.spark
    store.transact([Assert(f"c:{i}", ":seg", "A" if i % 2 else "B", "C") for i in range(6)])
    facts = lambda: store.facts().where("retracted_at is null")
    r = Reactor(spark, {"poor": B.Exists(":debt")})
    r.register("vip", B.All((B.Eq(":seg", "A"), B.Not(B.Rule("poor")))), facts(), NOW, "C")
    r.register("late", B.Before(":due"), facts(), NOW, "C")
    key = lambda *ks: spark.createDataFrame([(k,) for k in ks], "key string")
    got = lambda frame: sorted(map(tuple, frame.collect()))
    assert got(r.affected(key(fact_key("c:1", ":debt")))) == [("vip", "c:1")]  # an absent fact was looked at
    assert r.affected(key(rule_key("poor"))).count() == 6 and r.affected(key(clock_key("day"))).count() == 6
    store.transact([Assert("c:1", ":debt", 1), Assert("c:9", ":seg", "A", "C")])
    flips = r.refresh(changed_keys(spark.createDataFrame([("c:1", ":debt")], "entity_id string, attribute string")), facts(), NOW)
    assert got(flips.where("question = 'vip'")) == [("vip", "c:1", True, False), ("vip", "c:9", None, True)]
    assert got(r.refresh(key(fact_key("c:0", ":seg")), facts(), NOW)) == []
    assert r.unregister("late") and not r.unregister("late") and r.answers.count() == 7


def test_order_guards_and_bulk(store):
    spark = store.spark
    r = store.transact([Assert("e", ":a", 1, triple_id="A"), RetractPattern("e", ":a"), Assert("e", ":a", 2, triple_id="B"), Assert("e", ":b", 3, triple_id="C"), Retract("C")], Meta(actor="x"))
    assert (r.retracted, [x["triple_id"] for x in store.entity("e", Basis(valid_at=NOW)).collect()]) == (2, ["B"])
    assert store.transact([Retract("A")]).retracted == 0
    with pytest.raises(WriteError):
        store.transact([RetractPattern(value="x")])  # it would hit the journal
    assert store.transactions().count() == 2
    rows = spark.createDataFrame([("e:1", ":n", "string", "x", "P"), ("e:2", ":n", "string", "x", "P")], "entity_id string, attribute string, value_type string, value_string string, entity_type string")
    with pytest.raises(ConstraintViolated):
        store.ingest(rows, Meta(constraints=[Unique("P", ":n")]))
    with pytest.raises(WriteError):
        store.ingest(rows, Meta(preconditions=[TripleLive("B")]))
    assert store.files.names(f"{store.root}/assertions") == [] and store.match(attribute=":n").count() == 0
    seen = []
    store.listeners.append(lambda receipt, ops: seen.append(receipt.position))
    store.ingest(rows, Meta(constraints=[Cardinality("P", ":n", 1)]))
    assert seen == [3]


def test_constraints_over_time(store):
    ref = lambda x: {"type": "ref", "value": x}
    rules_ = [ReferenceTarget("P", ":boss", "P"), Required("P", ":name")]
    r = store.transact([Assert("p:1", ":name", "a", "P"), Assert("p:2", ":name", "b", "P"), Assert("p:2", ":boss", ref("p:1"))], Meta(constraints=rules_))
    with pytest.raises(ConstraintViolated) as e:  # the target's type goes, and its own name with it
        store.transact([Retract(r.triples[0])], Meta(constraints=rules_))
    assert {v["constraint"] for v in e.value.violations} == {"ReferenceTarget"}
    with pytest.raises(ConstraintViolated) as e:  # for a while only, long ago
        store.transact([Assert("p:3", ":age", 5, "P", valid_from=10, valid_to=20)], Meta(constraints=rules_))
    assert [(v["subject"], v["valid_at"]) for v in e.value.violations] == [("p:3", 10)]
    store.transact([Assert("p:3", ":age", 5, "P", valid_from=10, valid_to=20), Assert("p:3", ":name", "c", valid_from=5, valid_to=20)], Meta(constraints=rules_))


def test_timeline_limits_and_pages(store):
    for i in range(5):
        store.transact([Assert("e", ":n", i)])
    first = store.timeline("e", 2)
    assert [r["position"] for r in first.transactions] == [5, 4] and (first.snapshot_position, first.next_before) == (5, 4)
    store.transact([Assert("e", ":n", 9)])
    rest = store.timeline("e", 10, first.next_before, first.snapshot_position)
    assert [r["position"] for r in rest.transactions] == [3, 2, 1] and rest.next_before is None
    for bad in ({"limit": 0}, {"limit": 1001}, {"before": -1}, {"snapshot": -1}):
        with pytest.raises(ReadError):
            store.timeline("e", **bad)


def test_databases_keep_every_change(spark, tmp_path):
    a, b = (Databases(spark, local_root(str(tmp_path))) for _ in range(2))
    a.create("one", "ann")
    a.grant("one", "bob")
    b.grant("one", "cat")
    a.revoke("one", "ann")
    assert b.access_list("one") == ["bob", "cat"] and b.update("one", note=1)["about"] == {"note": 1} and a.list("cat") == ["one"]
    with pytest.raises(ChronofactError):
        b.create("one")


def test_small_things(store):
    store.transact([Assert("e", ":n", 1)])
    plan = explain_page(store.source(), {"inner": {"find": ["?n"], "where": [["?e", ":n", "?n"]]}, "filters": [{"column": "?n", "op": ">", "value": 0}], "limit": 3})
    assert plan["steps"][-1]["order"] == [["?n", "asc"]] and plan["metrics"]["patterns"] == 1
    assert canonical_json({"\U0001f600": 1, "דּ": 2}) == '{"\U0001f600":1,"דּ":2}'  # by UTF-16 units
    name = config.Attribute(":name", T.Prim("text"))
    assert config.use(name, required=True).required and not name.required
    with pytest.raises(ConfigError):
        config.use(name, type=T.Prim("number"))
    assert store.sql("SELECT count(*) AS n FROM {facts}", Basis(valid_at=NOW)).first()["n"] == store.facts().where(F.col("retracted_at").isNull()).count()
