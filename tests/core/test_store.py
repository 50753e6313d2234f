"""Writes, time, journal, constraints, derivations, snapshots, feed and configuration."""

import json

import pytest
from pyspark.sql import functions as F

from chronofact.errors import CheckpointConflict, ChronofactError, CommandAlreadyCommitted, ConfigError, ConstraintViolated, DerivationError, TransactionConflict, WriteError
from chronofact.functions import boolexpr as B
from chronofact.functions import types as T
from chronofact.functions.values import canonical_json, content_id, number_text
from chronofact.operators import browse, config, derivation, snapshots
from chronofact.operators.constraints import Cardinality, ReferenceTarget, Required, Unique, evaluate
from chronofact.sources.basis import Basis, visible
from chronofact.sources.databases import Databases
from chronofact.sources.facts import FactTable, TableFacts, Union, Wanted, table_spec
from chronofact.sources.store import Assert, FactStore, Meta, Retract, RetractPattern, TripleLive, local_root, unpacked
from chronofact.streaming import feed, subscriptions

NAME = {"find": ["?p", "?n"], "where": [["?p", ":name", "?n"]]}


@pytest.fixture
def store(spark, tmp_path):
    ticks = iter(range(1000, 100_000, 1000))
    return FactStore(spark, local_root(str(tmp_path)), clock=lambda: next(ticks))


def names(store, **kw):
    return sorted(tuple(r) for r in store.query(NAME, types={"?n": "string"}, **kw).collect())


def test_all_value_types_round_trip(store):
    values = [{"type": "string", "value": "x"}, {"type": "number", "value": 1.5}, {"type": "boolean", "value": True}, {"type": "datetime", "value": 12}, {"type": "ref", "value": "e:1"}, {"type": "json", "value": {"b": [1, None], "a": "é"}}, {"type": "blob", "hash": "h", "mimeType": "t", "size": 3, "filename": "f"}]
    store.transact([Assert("e", f":v{i}", v) for i, v in enumerate(values)])
    got = {r["attribute"]: unpacked(r) for r in store.entity("e").collect()}
    assert [got[f":v{i}"] for i in range(len(values))] == values
    assert store.match(value={"type": "json", "value": {"a": "é", "b": [1, None]}}).count() == 1
    assert store.match(value={"type": "string", "value": "e:1"}).count() == 0 and store.match(value={"type": "ref", "value": "e:1"}).count() == 1


def test_commits_time_and_journal(store):
    first = store.transact([Assert("p:1", ":name", "Ann", "Person"), Assert("p:2", ":name", "Bob", "Person")], Meta(actor="x", command_id="c1", correlation_id="k"))
    assert (first.position, first.instant, first.retracted) == (1, 1000, 0)
    second = store.transact([Retract(first.triples[0]), Assert("p:1", ":name", "Anna", valid_from=500, valid_to=5000)])
    assert names(store, basis=Basis(valid_at=4000)) == [("p:1", "Anna"), ("p:2", "Bob")]
    assert names(store, basis=Basis(valid_at=5000)) == [("p:2", "Bob")]  # the end is exclusive
    assert names(store, basis=Basis(recorded_at=1999, valid_at=4000)) == names(store, basis=Basis(recorded_position=1, valid_at=4000)) == [("p:1", "Ann"), ("p:2", "Bob")]
    assert names(store, basis=Basis(recorded_at=2000, valid_at=600)) == [("p:1", "Anna")]
    assert [r["retracted_at"] for r in store.history("p:1").collect()] == [2000, None]
    assert store.get(first.triples[0]).count() == 0 and store.get(first.triples[0], include_retracted=True).count() == 1
    page = store.transactions(limit=1).collect()
    assert [(r["tx_id"], r["position"], r["actor"], r["command_id"], r["correlation_id"], r["entities"]) for r in page] == [(first.tx_id, 1, "x", "c1", "k", ["p:1", "p:2"])]
    assert [json.loads(c)["op"] for c in store.transaction(second.tx_id).first()["changes"]] == ["retract", "assert"]
    assert [r["position"] for r in store.transactions_for_entity("p:1").collect()] == [2, 1]
    assert store.transaction_by_command("c1").first()["tx_id"] == first.tx_id
    with pytest.raises(CommandAlreadyCommitted) as e:
        store.transact([Assert("p:3", ":name", "C")], Meta(command_id="c1"))
    assert e.value.tx_id == first.tx_id and store.current_position() == 2
    got = store.entities(["p:2", "none", "p:1"], Basis(valid_at=4000)).collect()
    assert [(r["entity_id"], len(r["facts"])) for r in got] == [("p:2", 1), ("none", 0), ("p:1", 1)]
    assert store.dependency_state([":name"], Basis(valid_at=600)) == {"source_position": 2, "next_boundary": 1000}


def test_conflicts_leave_no_trace(store):
    r = store.transact([Assert("p:1", ":name", "Ann")])
    store.transact([Retract(r.triples[0])], Meta(preconditions=[TripleLive(r.triples[0])]))
    with pytest.raises(TransactionConflict):
        store.transact([Retract(r.triples[0]), Assert("p:1", ":name", "B")], Meta(preconditions=[TripleLive(r.triples[0])]))
    with pytest.raises(WriteError):
        store.transact([Assert("x", ":a", 1)], Meta(preconditions=[TripleLive(r.triples[0])]))
    for bad in (Assert("_sys/x", ":a", 1), Assert("x", ":_tx/a", 1), Assert("x", ":a", 1, "_Transaction")):
        with pytest.raises(WriteError):
            store.transact([bad])
    with pytest.raises(WriteError):
        store.retract("0" * 26)
    assert names(store) == [] and store.current_position() == 2


def test_lost_race_is_decided_again(store):
    seen = []
    publish = store._publish

    def raced(entry):
        if not seen:  # another writer takes the position first
            seen.append(entry["position"])
            store.files.create(f"{store.root}/log/{entry['position']:020d}.json", json.dumps({"position": entry["position"], "tx_id": "_tx/other", "instant": 1, "command_id": None, "quiet": False}))
        return publish(entry)

    store._publish = raced
    r = store.transact([Assert("p:1", ":name", "Ann")])
    assert seen == [1] and r.position == 2 and names(store) == [("p:1", "Ann")]


def test_retract_pattern_and_ingest(spark, store):
    rows = spark.range(50).select(F.concat(F.lit("p:"), "id").alias("entity_id"), F.lit(":name").alias("attribute"), F.lit("string").alias("value_type"), F.col("id").cast("string").alias("value_string"))
    store.ingest(rows, Meta(actor="bulk"))
    assert store.query(NAME).count() == 50 and store.transactions().first()["actor"] == "bulk"
    assert store.retract_pattern(RetractPattern(attribute=":name", value="7")) == 1
    assert store.query(NAME).count() == 49
    assert store.compact(f"{store.root}/compacted").at(Basis(valid_at=10**9)).visible().where("attribute = ':name'").count() == 49
    from chronofact.sources.store import change_events

    seen = []
    store.listeners.append(lambda receipt, ops: seen.extend(change_events(receipt, ops)))
    r = store.transact([Assert("p:99", ":name", "x", "Person")])
    assert seen == [{"event": "asserted", "tx": r.tx_id, "position": r.position, "entity": "p:99", "attribute": ":name", "entity_type": "Person"}]


def test_constraints_abort_only_what_gets_worse(store):
    rules = [Unique("Person", ":name"), Required("Person", ":age"), Cardinality("Person", ":name", 1), ReferenceTarget("Person", ":boss", "Person")]
    store.transact([Assert("p:1", ":name", "Ann", "Person"), Assert("p:2", ":name", "Bob", "Person"), Assert("p:2", ":boss", {"type": "ref", "value": "p:9"})])
    found = {(r["constraint"], r["subject"]) for r in evaluate(store.facts().where(visible(Basis().resolved())).where("entity_type is null or entity_type = 'Person'"), rules).collect()}
    assert found == {("Required", "p:1"), ("Required", "p:2"), ("ReferenceTarget", "p:2")}
    store.transact([Assert("p:1", ":hobby", "x")], Meta(constraints=rules))  # old violations don't block
    for bad in (Assert("p:2", ":name", "Ann"), Assert("p:1", ":boss", "text"), Assert("p:1", ":name", "Second", valid_from=9_000_000)):
        with pytest.raises(ConstraintViolated):
            store.transact([bad], Meta(constraints=rules))
    store.transact([Assert("p:3", ":age", 1, "Person")], Meta(constraints=rules))
    assert store.match(entity="p:2", attribute=":name").count() == 1


TODO = {"find": ["?o", "?d"], "where": [["?o", ":status", "open"], ["?o", ":due", "?d"], ["not", ["?o", ":paused", True]]]}


def test_derivations(store):
    r = store.transact([Assert("o:1", ":status", "open"), Assert("o:1", ":due", 5), Assert("o:2", ":status", "open"), Assert("o:2", ":due", 6, valid_to=900_000), Assert("o:3", ":status", "done")])
    d = derivation.Derivation.make("todo", TODO, ["?o"])
    at = Basis(valid_at=50_000)
    found = {x["identity"]["o"]["txt"]: x for x in derivation.evaluate(store.source(at), d).collect()}
    assert set(found) == {"o:1", "o:2"} and {s["triple_id"] for s in found["o:1"]["sources"]} == set(r.triples[:2])
    assert (found["o:1"]["next_boundary"], found["o:2"]["next_boundary"]) == (None, 900_000)
    assert d.attributes == [":due", ":paused", ":status"] and derivation.next_boundary(store.source(at), d) == 900_000
    assert derivation.current(store, d, at)["freshness"] == "unmaterialized"
    run, wrote = derivation.materialize(store, d, at)
    assert wrote and derivation.materialize(store, d, at) == (run, False)
    assert derivation.current(store, d, at)["freshness"] == "current" and derivation.current(store, d, Basis(valid_at=900_000))["freshness"] == "stale"
    old = derivation.evaluate(store.source(at), d)
    pos = store.current_position()
    store.transact([Assert("o:1", ":paused", True), Retract(r.triples[3]), Assert("o:2", ":due", 7), Assert("o:4", ":status", "open"), Assert("o:4", ":due", 1)])
    old = derivation.evaluate(store.source(Basis(valid_at=50_000, recorded_position=pos)), d)
    changes = sorted(x["change"] for x in derivation.reconcile(old, derivation.evaluate(store.source(at), d)).collect())
    assert changes == ["added", "changed", "removed"]
    assert derivation.current(store, d, at)["freshness"] == "stale"
    what_if = derivation.overlay(store.source(at), d, [Assert("o:9", ":status", "open"), Assert("o:9", ":due", 2)], [r.triples[2]])
    assert {x["identity"]["o"]["txt"] for x in what_if.collect()} == {"o:4", "o:9"}
    with pytest.raises(DerivationError):
        derivation.overlay(store.source(at), d, [], ["0" * 26])
    store.transact([Assert("o:4", ":due", 2)])
    with pytest.raises(Exception, match="several results"):
        derivation.evaluate(store.source(at), d).collect()
    with pytest.raises(DerivationError):
        derivation.Derivation.make("x", {**TODO, "limit": 1}, ["?o"])


def test_snapshots(store):
    a = store.transact([Assert("e:1", ":x", 1), Assert("e:1", ":t", "a"), Assert("e:2", ":x", 1), Assert("e:2", ":t", "a")])
    b = store.transact([Retract(a.triples[0]), Assert("e:1", ":x", 2)])
    c = store.transact([Retract(a.triples[2]), Retract(a.triples[3])])
    s = snapshots.materialize(store.facts(), store.log()).cache()
    assert s.count() == 4
    assert snapshots.hash_at(s, "e:1", a.tx_id).first()[0] == snapshots.hash_at(s, "e:2", a.tx_id).first()[0]
    assert [tuple(r) for r in snapshots.diff(snapshots.at(s, "e:1", a.tx_id), snapshots.at(s, "e:1", b.tx_id)).select("attribute", "change").collect()] == [(":x", "changed")]
    assert snapshots.current(s, "e:2").first()["state"] == "{}" and snapshots.as_of(s, 2000, "e:2").first()["tx_id"] == a.tx_id
    assert [r["position"] for r in snapshots.hashes(s, "e:1").collect()] == [1, 2]
    assert {r[0] for r in snapshots.find_by_hash(s, snapshots.current(s, "e:1").first()["hash"]).collect()} == {"e:1"}
    assert {r["entity_id"] for r in snapshots.find_changed(s, store.log(), b.tx_id).collect()} == {"e:2"}
    assert snapshots.find_changed(s, store.log(), "_tx/unknown").count() == 2 and c.position == 3
    assert snapshots.checkpoint(s, 1000).count() == 2 and snapshots.batch_current(s, ["e:1", "zz"]).count() == 1
    assert {r["entity_id"] for r in snapshots.backfill(store.facts(), store.log(), s.where("entity_id = 'e:1'")).collect()} == {"e:2"}


def test_feed_checkpoints_and_subscriptions(store, tmp_path):
    subs = subscriptions.Subscriptions()
    subs.register("a", {"find": ["?o"], "where": [["?o", ":status", "open"]]})
    subs.register("b", {"find": ["?o"], "where": [["?o", ":other", "?y"]]})
    subs.register("c", {"find": ["?a"], "where": [["o:1", "?a", "?y", "?t"]]})
    subs.register("typed", {"find": ["?o"], "where": [["?o", ":status", "?s"]]}, ["Order"])
    store.transact([Assert("o:1", ":status", "open", "Task")])
    got = []
    handle = lambda c, n: got.append(sorted(r[0] for r in subs.affected(c).collect()))
    feed.follow(store, handle, f"{tmp_path}/cp", available_now=True).awaitTermination(120)
    assert got == [["a", "c"]]
    feed.Checkpoints(store)
    store.transact([Assert("o:2", ":other", 1, "Order")])
    feed.follow(store, handle, f"{tmp_path}/cp", available_now=True).awaitTermination(120)
    assert got == [["a", "c"], ["b"]]  # resumed, nothing twice
    c = feed.Checkpoints(store)
    assert (c.get("x"), c.advance("x", 0, 1), c.advance("x", 0, 1), c.advance("x", 1, 2), c.get("x")) == (0, 1, 1, 2, 2)
    for expected, to in ((0, 3), (2, 1), (2, 99)):
        with pytest.raises(CheckpointConflict):
            c.advance("x", expected, to)
    assert subs.count() == 4 and subs.unregister("a") and not subs.unregister("a") and len(subs.find_by_query_hash(subs.get("b").hash)) == 1
    deps = subscriptions.dependencies({"find": ["?x"], "where": [["r", "?x", "?y"], ["not", ["?x", ":n", 1]], ["or", [["?x", ":o", 1]]]], "rules": [{"name": "r", "body": [["?x", ":p", "?y"]]}]})
    assert deps.attributes == {":p", ":n", ":o"} and deps.rules == {"r"} and not deps.dynamic


def test_tables_and_unions_as_sources(spark):
    a = table_spec(spark.createDataFrame([(1, "x", 2.0, None)], "id long, name string, size double, boss long"), "a", "id", refs={"boss": "a"})
    b = table_spec(spark.createDataFrame([(5, "y")], "id long, name string"), "b", "id")
    t = TableFacts(spark, a, b)
    assert sorted(r["a"] for r in t.scan(Wanted(entity="a:1")).frame.collect()) == [":a/name", ":a/size"]
    assert t.scan(Wanted(attribute=":a/name", value=1)).frame.count() == 0 and t.scan(Wanted(attribute=":zz")).frame.count() == 0
    both = Union(t, FactTable(t.facts(), Basis(valid_at=5)))
    from chronofact.plans.build import run

    assert sorted(tuple(r) for r in run(both, {"find": ["?e", "?n"], "where": [["?e", ":b/name", "?n"]]}, {"?n": "string"}).collect()) == [("b:5", "y")]
    wide = t.facts()
    assert browse.entity_types(wide).count() == 2 and browse.entity_page(wide, "A") == (["a:1"], None)
    assert {tuple(r) for r in browse.reflected_columns(wide, "A", {":a/size": "integer"}).collect()} == {(":a/name", "string"), (":a/size", "integer")}


def test_databases(spark, tmp_path):
    dbs = Databases(spark, local_root(str(tmp_path)))
    dbs.create("first", "me").transact([Assert("e", ":a", 1)])
    dbs.create("second")
    for bad in ("first", "No Name", ""):
        with pytest.raises(ChronofactError):
            dbs.create(bad)
    dbs.grant("second", "you")
    assert dbs.list() == ["first", "second"] and dbs.list("you") == ["second"] and dbs.has_access("first", "me")
    assert dbs.get("first").current_position() == 1
    dbs.clear("first")
    dbs.revoke("first", "me")
    assert dbs.get("first").current_position() == 0 and dbs.access_list("first") == [] and dbs.update("first", note="x")["about"] == {"note": "x"}
    dbs.delete("first")
    assert dbs.list() == ["second"]


# --- configuration ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("x,text", [(7.0, "7"), (1e21, "1e+21"), (123456789012345680000.0, "123456789012345680000"), (1e-7, "1e-7"), (0.000001, "0.000001"), (-0.0, "0"), (1.5, "1.5"), (-1234.25, "-1234.25"), (1.7e12, "1700000000000"), (5e-324, "5e-324"), (0.1, "0.1"), (1e300, "1e+300"), (12345.678e-10, "0.0000012345678")])
def test_numbers_are_written_as_in_ecmascript(x, text):
    assert number_text(x) == text


def test_canonical_json():
    assert canonical_json({"b": [1.0, True, None], "a": "é\n"}) == '{"a":"é\\n","b":[1,true,null]}'
    loop = []
    loop.append(loop)
    for bad in (float("nan"), loop, object()):
        with pytest.raises(ValueError):
            canonical_json(bad)
    assert content_id("d", {"x": 1}) == content_id("d", '{"x":1}') != content_id("e", {"x": 1})


TEXT, INT, NUM = T.Prim("text"), T.Prim("integer"), T.Prim("number")
PERSON = T.Struct((("name", T.Field(T.Constrained(TEXT, (("min_length", 2), ("pattern", "^A"))))), ("age", T.Field(INT, True, 18)), ("tags", T.Field(T.ListType(T.Enum(("a", "b"))), True))))


def test_types():
    assert T.accepts(PERSON, {"name": "Ann"}) and T.accepts(PERSON, {"name": "Ann", "age": 3, "tags": ["a"]})
    for bad in ({}, {"name": "B!"}, {"name": "A"}, {"name": "Ann", "age": 1.5}, {"name": "Ann", "more": 1}, {"name": "Ann", "tags": ["c"]}, {"name": "Ann", "age": True}, []):
        assert not T.accepts(PERSON, bad)
    assert T.normalize(PERSON, {"name": "Ann"}) == {"name": "Ann", "age": 18}
    with pytest.raises(ConfigError):
        T.normalize(PERSON, {"name": 1})
    assert T.accepts(T.Prim("date"), "2024-02-29") and not T.accepts(T.Prim("date"), "2023-02-29") and T.accepts(T.UnionType((TEXT, INT)), 3)


@pytest.mark.parametrize("old,new,kind", [
    (INT, INT, "identical"), (INT, NUM, "widens"), (NUM, INT, "narrows"), (INT, T.AnyType(), "widens"), (T.AnyType(), INT, "narrows"), (T.Enum(("a",)), T.Enum(("a", "b")), "widens"), (T.Enum(("a", "b")), T.Enum(("a",)), "narrows"), (T.Enum(("a",)), TEXT, "widens"), (TEXT, T.Enum(("a",)), "narrows"),
    (TEXT, T.UnionType((TEXT, INT)), "widens"), (T.UnionType((TEXT, INT)), TEXT, "narrows"), (T.UnionType((INT, NUM)), NUM, "widens"), (T.Constrained(NUM, (("min", 1),)), NUM, "widens"), (NUM, T.Constrained(NUM, (("min", 1),)), "narrows"), (T.Constrained(NUM, (("min", 1), ("min", 5))), T.Constrained(NUM, (("min", 4),)), "widens"),
    (T.Constrained(TEXT, (("pattern", "a"),)), T.Constrained(TEXT, (("pattern", "b"),)), "narrows"), (T.ListType(INT), T.ListType(NUM), "widens"), (T.RefType("a"), T.RefType("b"), "narrows"), (T.Struct((("a", T.Field(INT)),)), T.Struct((("a", T.Field(NUM, True)), ("b", T.Field(INT, True)))), "widens"),
    (T.Struct((("a", T.Field(INT)),)), T.Struct((("a", T.Field(INT)), ("b", T.Field(INT)))), "narrows"), (T.Struct((("a", T.Field(INT)), ("b", T.Field(INT)))), T.Struct((("a", T.Field(INT)),)), "narrows"), (T.Struct((("a", T.Field(INT, True)),)), T.Struct((("a", T.Field(INT)),)), "narrows"),
])
def test_subsumption(old, new, kind):
    v = T.subsumes(old, new)
    assert v.kind == kind and v.compatible == (kind != "narrows") and bool(v.reasons) == (kind != "identical")


def test_three_valued_rules_agree_with_their_proofs(spark, store):
    store.transact([Assert("p:1", ":kind", "a", "P"), Assert("p:1", ":due", 5), Assert("p:2", ":kind", "b", "P"), Assert("p:3", ":other", 1, "P"), Assert("g", ":flag", True)])
    facts = store.facts().where(visible(Basis().resolved()))
    catalog = {"r": B.Eq(":kind", "a"), "loop": B.Rule("loop"), "deep": B.All((B.Rule("r"), B.Not(B.Exists(":due"))))}
    exprs = {"eq": B.Rule("r"), "ne": B.Not(B.Rule("r")), "has": B.Exists(":due"), "late": B.Before(":due"), "all": B.All((B.Exists(":kind"), B.Rule("r"))), "any": B.Any((B.Rule("r"), B.Lit(False))), "deep": B.Rule("deep"), "loop": B.Any((B.Rule("loop"), B.Exists(":kind"))), "missing": B.Rule("none"), "fixed": B.Eq(":flag", True, "g"), "empty": B.All(()), "none": B.Any(())}
    now = 10 * B.DAY
    got = {r["subject"]: r for r in B.decide(facts, exprs, now, catalog, "P").collect()}
    world = {(r["entity_id"], r["attribute"]): next(v for v in (r["value_string"], r["value_number"], r["value_boolean"]) if v is not None) for r in facts.where("not startswith(entity_id, '_tx/')").collect()}
    for subject, row in got.items():
        for name, e in exprs.items():
            p = B.truth(e, world, subject, now, catalog)
            assert p["truth"] == row[name], (subject, name)
            assert B.verify(p) and B.replay(p, world, subject, now, catalog)
    assert (got["p:3"]["ne"], got["p:3"]["has"], got["p:3"]["all"], got["p:3"]["late"]) == (None, False, False, None)
    proofs = {r["subject"]: r for r in B.prove(facts, exprs["eq"], now, catalog, "P").collect()}
    assert proofs["p:3"]["truth"] is None and proofs["p:3"]["reasons"] == ["p:3:kind is absent"] and proofs["p:1"]["proof_id"] == B.truth(exprs["eq"], world, "p:1", now, catalog)["id"]
    impact = B.deploy_impact(facts, "r", catalog, {"r": B.Eq(":kind", "b")}, now, "P").collect()
    assert {(r["subject"], r["old"], r["new"]) for r in impact} == {("p:1", True, False), ("p:2", False, True)}
    seen = B.observations([("q", s, B.truth(exprs["deep"], world, s, now, catalog)) for s in ("p:1", "p:2")])
    observed = spark.createDataFrame(seen, "question string, subject string, entity string, attribute string")
    changes = spark.createDataFrame([("p:1", ":due"), ("zz", ":due")], "entity_id string, attribute string")
    assert [tuple(r) for r in B.react(changes, observed).collect()] == [("q", "p:1")]
    store.transact([Assert("p:1", ":kind", "c")])
    with pytest.raises(Exception, match="several values"):
        B.decide(store.facts().where("retracted_at is null"), exprs, now, catalog, "P").collect()


def test_nodes_and_releases(store):
    leaf = config.Node("rule", "r", {"v": 1})
    form = config.Node("form", "f", {}, (("uses", leaf), ("uses", config.Node("rule", "s"))), (("asks", "rule:r"),))
    with pytest.raises(ConfigError):
        config.Node("form", "f", {}, (("uses", leaf), ("uses", config.Node("rule", "r", {"v": 2}))))
    swapped = config.Node("form", "f", {}, (("uses", config.Node("rule", "s")), ("uses", config.Node("rule", "r", {"v": 2})), ("uses", config.Node("rule", "t"))), (("asks", "rule:r"),))
    assert set(config.diff_nodes(form, swapped)) == {("/form:f", "reordered"), ("/form:f/rule:r", "attrs"), ("/form:f/rule:t", "added")} and config.diff_nodes(form, form) == []
    assert len(form.flatten()) == 3
    rel = config.Releases(store)
    a = rel.commit([leaf, config.Node("form", "f", refs=(("asks", "rule:r"),)), config.Node("page", "p", refs=(("shows", "form:f"),))])
    b = rel.commit([config.Node("rule", "r", {"v": 2}), a.nodes["form:f"], a.nodes["page:p"]], a.id)
    assert rel.diff(a.id, b.id) == {"added": [], "removed": [], "changed": ["rule:r"]} and rel.impact(a.id, b.id) == ["form:f", "page:p", "rule:r"]
    rel.set_ref("live", a.id)
    rel.set_ref("live", b.id, a.id)
    with pytest.raises(ConfigError):
        rel.set_ref("live", a.id, a.id)
    assert rel.resolve("live").id == b.id and rel.reverse_dependencies(a.id, "rule:r") == ["form:f", "page:p"]
    with pytest.raises(ConfigError):
        rel.commit([config.Node("x", "y", refs=(("z", "nowhere:1"),))])


def test_validation(store):
    person = config.EntityType("Person", (config.Attribute(":name", TEXT, required=True, unique=True), config.Attribute(":age", T.Constrained(INT, (("min", 0),))), config.Attribute(":tag", TEXT, many=True), config.Attribute(":boss", T.RefType("Person"), target="Person")))
    assert person.kinds() == {":name": "txt", ":age": "num", ":tag": "txt", ":boss": "txt"}
    r = store.transact([Assert("p:1", ":name", "Ann", "Person"), Assert("p:1", ":age", -1), Assert("p:1", ":tag", "x"), Assert("p:1", ":tag", "y"), Assert("p:2", ":age", 5, "Person"), Assert("p:2", ":boss", {"type": "ref", "value": "nobody"})])
    found = {(x["subject"], x["path"], x["source"]) for x in config.validate(store.facts(), person).collect()}
    assert found == {("p:1", ":age", "schema"), ("p:2", ":name", "graph"), ("p:2", ":boss", "graph")}
    v = config.Validation(store)
    assert v.freshness("live", "rel", person) == "unvalidated"
    assert {x["subject"] for x in v.revalidate("live", "rel", person).collect()} == {"p:1", "p:2"}
    assert v.freshness("live", "rel", person) == "current"
    before = store.current_position()
    v.revalidate("live", "rel", person)
    assert store.current_position() == before  # nothing changed, nothing written
    store.transact([Retract(r.triples[1])])
    assert v.freshness("live", "rel", person) == "stale" and v.last_invalid("live", person).count() == 2
    assert {x["subject"] for x in v.revalidate("live", "rel", person).collect()} == {"p:2"} and v.ever_invalid("live", person).count() == 2
