"""Typed configuration: content-addressed nodes, releases, movable refs, ontology declarations, validation."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.errors import ConfigError
from chronofact.functions import types as T
from chronofact.functions.staging import discard, stage
from chronofact.functions.values import content_id
from chronofact.operators.constraints import Cardinality, ReferenceTarget, Required, Unique, evaluate
from chronofact.sources.basis import Basis, visible
from chronofact.sources.store import Assert, FactStore, Meta, Retract, TripleLive

# --- nodes -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    """kind and key name it; attrs are JSON; children are (relation, Node); refs are (relation, key)."""

    kind: str
    key: str
    attrs: dict = field(default_factory=dict, hash=False)
    children: tuple = ()
    refs: tuple = ()

    def __post_init__(self):
        names = [(rel, c.key) for rel, c in self.children]
        if len(set(names)) != len(names):
            raise ConfigError(f"{self.kind} {self.key} has a child twice")
        object.__setattr__(self, "refs", tuple(sorted(set(self.refs))))

    @property
    def body(self) -> dict:
        return {"kind": self.kind, "key": self.key, "attrs": self.attrs, "children": [[rel, c.id] for rel, c in self.children], "refs": [list(r) for r in self.refs]}

    @property
    def id(self) -> str:
        return content_id("config-node", self.body)

    def walk(self, path: str = ""):
        here = f"{path}/{self.kind}:{self.key}"
        yield here, self
        for _, c in self.children:
            yield from c.walk(here)

    def flatten(self) -> dict[str, Node]:
        return dict(self.walk())


def diff_nodes(old: Node | None, new: Node | None, path: str = "") -> list[tuple[str, str]]:
    """(path, change): added, removed, attrs, refs or reordered. Subtrees with equal ids aren't looked at."""
    node = new or old
    if node is None:
        return []
    here = f"{path}/{node.kind}:{node.key}"
    if old is None or new is None:
        return [(p, "added" if old is None else "removed") for p, _ in node.walk(path)]
    if old.id == new.id:
        return []
    out = [(here, "attrs")] if old.attrs != new.attrs else []
    out += [(here, "refs")] if old.refs != new.refs else []
    a, b = ({(rel, c.key): c for rel, c in n.children} for n in (old, new))
    shared = [k for k in a if k in b]
    if shared != [k for k in b if k in a]:
        out.append((here, "reordered"))
    for k in dict.fromkeys([*a, *b]):
        out += diff_nodes(a.get(k), b.get(k), here)
    return out


# --- releases --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Release:
    id: str
    nodes: dict[str, Node] = field(hash=False, default_factory=dict)
    parent: str | None = None


class Releases:
    """Immutable releases and movable refs; a ref moves only from where the mover thinks it is.

    With a store everything is kept as facts: each node once under its content id, a release as its roots, a ref
    as a pointer. What another process committed is read back, and checked against its ids, when it is asked for.
    """

    def __init__(self, store: FactStore | None = None):
        self.store, self.releases, self.refs = store, {}, {}

    def commit(self, nodes: list[Node], parent: str | None = None, check=None) -> Release:
        for n in nodes:
            if check:
                check(n)
        by_key = {f"{n.kind}:{n.key}": n for n in nodes}
        for n in nodes:
            for _, target in n.refs:
                if target not in by_key:
                    raise ConfigError(f"{n.kind}:{n.key} refers to {target}, which isn't in the release")
        id_ = content_id("release", {"nodes": sorted(n.id for n in nodes), "parent": parent})
        release = self.releases.setdefault(id_, Release(id_, by_key, parent))
        if self.store is not None and self.store.match(entity=f"_sys/release/{id_}").isEmpty():
            every = {n.id: n for root in nodes for _, n in root.walk()}
            known = {r[0] for r in self.store.match(entity_type="sys.Node").select("entity_id").join(self.store.spark.createDataFrame([(f"_sys/node/{i}",) for i in every] or [("",)], "entity_id string"), "entity_id").collect()}
            ops = [Assert(f"_sys/node/{i}", ":sys/body", {"type": "json", "value": n.body}, "sys.Node") for i, n in every.items() if f"_sys/node/{i}" not in known]
            ops.append(Assert(f"_sys/release/{id_}", ":sys/roots", {"type": "json", "value": {"nodes": [n.id for n in nodes], "parent": parent}}, "sys.Release"))
            self.store.transact(ops, system=True)
        return release

    def snapshot(self, id_: str) -> Release:
        """A release by its id, rebuilt from the store if this process didn't commit it."""
        if id_ not in self.releases:
            held = self.store.match(entity=f"_sys/release/{id_}", attribute=":sys/roots").first() if self.store is not None else None
            if held is None:
                raise ConfigError(f"no release {id_}")
            record = json.loads(held["value_json"])
            bodies = self._bodies(record["nodes"])
            built: dict[str, Node] = {}

            def node(at: str, above: tuple = ()) -> Node:
                if at in above:
                    raise ConfigError(f"node {at} is its own descendant")
                if at not in built:
                    b = bodies[at]
                    built[at] = Node(b["kind"], b["key"], b["attrs"], tuple((rel, node(c, (*above, at))) for rel, c in b["children"]), tuple((r, k) for r, k in b["refs"]))
                    if built[at].id != at:
                        raise ConfigError(f"node {at} isn't what its id says")
                return built[at]

            nodes = [node(i) for i in record["nodes"]]
            if content_id("release", {"nodes": sorted(record["nodes"]), "parent": record["parent"]}) != id_:
                raise ConfigError(f"release {id_} isn't what its id says")
            self.releases[id_] = Release(id_, {f"{n.kind}:{n.key}": n for n in nodes}, record["parent"])
        return self.releases[id_]

    def _bodies(self, ids: list[str]) -> dict[str, dict]:
        """Stored bodies of nodes and all below them, a level of the tree a look."""
        out: dict[str, dict] = {}
        wanted = list(ids)
        while wanted:
            asked = self.store.spark.createDataFrame([(f"_sys/node/{i}",) for i in wanted], "entity_id string")
            rows = self.store.match(attribute=":sys/body", entity_type="sys.Node").join(asked, "entity_id").select("entity_id", "value_json").collect()
            out |= {r["entity_id"].removeprefix("_sys/node/"): json.loads(r["value_json"]) for r in rows}
            if lost := [i for i in wanted if i not in out]:
                raise ConfigError(f"node {lost[0]} is missing")
            wanted = list(dict.fromkeys(c for i in wanted for _, c in out[i]["children"] if c not in out))
        return out

    def load(self) -> Releases:
        """Every release and ref of the store."""
        for r in self.store.match(entity_type="sys.Release").select("entity_id").distinct().collect():
            self.snapshot(r[0].removeprefix("_sys/release/"))
        self.refs = {r["entity_id"].removeprefix("_sys/ref/"): r["value_string"] for r in self.store.match(entity_type="sys.Ref", attribute=":sys/target").collect()}
        return self

    def _target(self, name: str) -> str | None:
        if self.store is None:
            return self.refs.get(name)
        held = self.store.match(entity=f"_sys/ref/{name}", attribute=":sys/target").first()
        return held["value_string"] if held else None

    def set_ref(self, name: str, to: str, expected: str | None = None) -> None:
        self.snapshot(to)
        if self._target(name) != expected:
            raise ConfigError(f"ref {name} is at {self._target(name)}, not {expected}")
        if self.store is not None:
            held = self.store.match(entity=f"_sys/ref/{name}", attribute=":sys/target").first()
            ops = ([Retract(held["triple_id"])] if held else []) + [Assert(f"_sys/ref/{name}", ":sys/target", to, "sys.Ref")]
            self.store.transact(ops, Meta(preconditions=[TripleLive(held["triple_id"])] if held else []), system=True)
        self.refs[name] = to

    def resolve(self, name: str) -> Release:
        at = self._target(name)
        if at is None:
            raise ConfigError(f"no ref {name}")
        return self.snapshot(at)

    def recheck(self, kind: str, type_: object) -> list[dict]:
        """Issues of every released node of a kind under a type, newer than the one that it was committed under maybe.

        Each names the node, the releases that hold it, and what is at fault: its own data, or a child below it.
        """
        out = []
        for id_, release in sorted(self.releases.items()):
            for n in release.nodes.values():
                for path, found in n.walk():
                    if found.kind == kind:
                        issues = T.issues(type_, found.attrs)
                        out += [{"node": found.id, "release": id_, "path": path, "part": "data" if found is n else "child", "issue": i} for i in issues]
        return out

    def diff(self, old: str, new: str) -> dict[str, list[str]]:
        a, b = self.snapshot(old).nodes, self.snapshot(new).nodes
        return {"added": sorted(b.keys() - a.keys()), "removed": sorted(a.keys() - b.keys()), "changed": sorted(k for k in a.keys() & b.keys() if a[k].id != b[k].id)}

    def diff_kinds(self, old: str, new: str) -> dict[str, list[str]]:
        """What sort of change each touched node saw: its own data, its references, or only what lies below or behind it (closure)."""
        a, b = self.snapshot(old).nodes, self.snapshot(new).nodes
        out: dict[str, list[str]] = {"data": [], "refs": [], "closure": []}
        for k in sorted(a.keys() & b.keys()):
            if a[k].attrs != b[k].attrs:
                out["data"].append(k)
            if a[k].refs != b[k].refs:
                out["refs"].append(k)
        own = {*out["data"], *out["refs"]}
        out["closure"] = sorted(k for k in self.impact(old, new) if k in a and k in b and k not in own)
        return out

    def reverse_dependencies(self, release: str, key: str) -> list[str]:
        """All nodes that reach key through references."""
        nodes = self.snapshot(release).nodes
        found, edge = set(), {key}
        while edge:
            edge = {k for k, n in nodes.items() if k not in found and any(t in edge for _, t in n.refs)}
            found |= edge
        return sorted(found)

    def impact(self, old: str, new: str) -> list[str]:
        """What a deployment touches: changed nodes and all that refer to them."""
        d = self.diff(old, new)
        touched = {*d["added"], *d["changed"], *d["removed"]}
        after = {r for k in touched if k in self.snapshot(new).nodes for r in self.reverse_dependencies(new, k)}
        return sorted(touched | after)


# --- ontology --------------------------------------------------------------------------------------------

STORAGE = {"text": "string", "date": "string", "number": "number", "integer": "number", "boolean": "boolean", "instant": "datetime"}


@dataclass(frozen=True)
class Attribute:
    """A declared attribute: its type and how entities of a type use it."""

    name: str
    type: object
    required: bool = False
    many: bool = False
    unique: bool = False
    target: str | None = None

    @property
    def storage(self) -> str:
        t = self.type.base if isinstance(self.type, T.Constrained) else self.type
        return "ref" if isinstance(t, T.RefType) else "string" if isinstance(t, T.Enum) else STORAGE[t.name]

    @property
    def family(self) -> str:
        return {"string": "txt", "ref": "txt", "number": "num", "datetime": "num", "boolean": "bool"}[self.storage]


def use(attribute: Attribute, **changes) -> Attribute:
    """An attribute as one entity type uses it: what isn't said is as declared."""
    if unknown := set(changes) - {"required", "many", "unique", "target"}:
        raise ConfigError(f"a use can't change {', '.join(sorted(unknown))}")
    return replace(attribute, **changes)


@dataclass(frozen=True)
class EntityType:
    name: str
    attributes: tuple[Attribute, ...]

    def constraints(self) -> list:
        out = []
        for a in self.attributes:
            out += [Required(self.name, a.name)] if a.required else []
            out += [] if a.many else [Cardinality(self.name, a.name, 1)]
            out += [Unique(self.name, a.name)] if a.unique else []
            out += [ReferenceTarget(self.name, a.name, a.target)] if a.target else []
        return out

    @property
    def struct(self) -> T.Struct:
        return T.Struct(tuple((a.name, T.Field(T.ListType(a.type) if a.many else a.type, not a.required)) for a in self.attributes))

    def kinds(self) -> dict[str, str]:
        """Families of the attributes: what lets queries read raw columns."""
        return {a.name: a.family for a in self.attributes}


# --- validation ------------------------------------------------------------------------------------------


def entity_states(facts: DataFrame, entity_type: EntityType) -> DataFrame:
    """(subject, facts): the visible facts of each entity tagged with the type."""
    from chronofact.operators.snapshots import VALUE

    tagged = facts.where(F.col("entity_type") == F.lit(entity_type.name)).select("entity_id").distinct()
    return facts.join(tagged, "entity_id", "left_semi").groupBy(F.col("entity_id").alias("subject")).agg(F.collect_list(F.struct(*VALUE)).alias("facts"))


def assemble(rows: list[dict], entity_type: EntityType) -> dict:
    """An attribute map: scalars, or sorted lists where several values stand or the type has a list."""
    many = {a.name for a in entity_type.attributes if a.many}
    held: dict[str, list] = {}
    for r in rows:
        kind = r["value_type"]
        v = json.loads(r["value_json"]) if kind in ("json",) else r["value_number"] if kind == "number" else bool(r["value_boolean"]) if kind == "boolean" else int(r["value_datetime"]) if kind == "datetime" else r["value_string"]
        held.setdefault(r["attribute"], []).append(v)
    return {a: sorted(vs, key=lambda v: (str(type(v)), v)) if a in many or len(vs) > 1 else vs[0] for a, vs in held.items()}


def validate(facts: DataFrame, entity_type: EntityType, basis: Basis | None = None) -> DataFrame:
    """(subject, path, source, reason): schema issues, and graph issues, which hide schema issues of the same path."""
    seen = facts.where(visible((basis or Basis()).resolved())) if "retracted_at" in facts.columns else facts

    @F.pandas_udf("array<struct<path: string, reason: string>>")
    def check(states):
        import pandas as pd

        def one(rows):
            found = T.issues(entity_type.struct, assemble(list(rows), entity_type))
            pairs = [p.partition(": ") for p in found]
            return [{"path": a.removeprefix("value."), "reason": b} for a, _, b in pairs]

        return pd.Series([one(s) for s in states])

    schema = entity_states(seen, entity_type).select("subject", F.explode(check("facts")).alias("i")).select("subject", F.col("i.path").alias("path"), F.lit("schema").alias("source"), F.col("i.reason").alias("reason"))
    rules = entity_type.constraints()
    if not rules:
        return schema
    graph = evaluate(seen, rules).select("subject", "path", F.lit("graph").alias("source"), F.concat_ws(" ", "code", "value").alias("reason"))
    hidden = graph.where("reason = 'required' or reason = 'cardinality'").select("subject", "path").distinct()
    return schema.join(hidden, ["subject", "path"], "left_anti").unionByName(graph)


class Validation:
    """Persisted validation results of a release: one head a subject, one checkpoint a ref."""

    def __init__(self, store: FactStore):
        self.store = store

    def _source_position(self) -> int:
        rows = self.store.facts().where("entity_id not like '\\\\_%'")
        r = rows.agg(F.max(F.greatest("recorded_position", F.coalesce("retracted_position", F.lit(0)))).alias("p")).first()
        return r["p"] or 0

    def revalidate(self, ref: str, release: str, entity_type: EntityType) -> DataFrame:
        """Validates all entities of the type and moves heads and checkpoint; writes nothing if nothing changed."""
        found = validate(self.store.facts(), entity_type)
        scope = f"_sys/validation/{content_id('validation', [ref, entity_type.name])}"
        # keys in the order of the stored form, so that equal issues have equal text
        rows = found.groupBy("subject").agg(F.to_json(F.array_sort(F.collect_list(F.struct("path", "reason", "source")))).alias("issues"))
        held = self.store.match(entity_type="sys.Validation").where(F.col("entity_id").startswith(scope + "/")).select("triple_id", F.expr(f"substring(entity_id, {len(scope) + 2})").alias("subject"), F.col("value_json").alias("was"))
        moved = stage(rows.join(held, "subject", "full").where(~F.col("issues").eqNullSafe(F.col("was"))), "validation-moved")
        mark = {"release": release, "position": self._source_position()}
        checkpoint = self.store.match(entity=scope, attribute=":sys/validated").first()
        if not moved.isEmpty() or checkpoint is None or json.loads(checkpoint["value_json"]) != mark:
            # new issues come as one bulk commit, however many there are; then old heads and the checkpoint move together
            made = moved.where("issues is not null").select(F.concat(F.lit(f"{scope}/"), "subject").alias("entity_id"), F.lit(":sys/invalid").alias("attribute"), F.lit("json").alias("value_type"), F.col("issues").alias("value_json"), F.lit("sys.Validation").alias("entity_type"))
            if not made.isEmpty():
                self.store.ingest(made, system=True)
            ops = [Retract(checkpoint["triple_id"])] if checkpoint else []
            guards = [TripleLive(o.triple_id) for o in ops]
            ops += [Retract(r["triple_id"]) for r in moved.where("triple_id is not null").select("triple_id").toLocalIterator()]
            ops.append(Assert(scope, ":sys/validated", {"type": "json", "value": mark}))
            self.store.transact(ops, Meta(preconditions=guards), system=True)
        discard(moved)
        return self.last_invalid(ref, entity_type)

    def current_invalid(self, ref: str, release: str, entity_type: EntityType) -> DataFrame:
        """(subject, issues) of the last validation; none that isn't current may be taken for an answer."""
        if (state := self.freshness(ref, release, entity_type)) != "current":
            raise ConfigError(f"the validation of {entity_type.name} under {ref} is {state}")
        return self.last_invalid(ref, entity_type)

    def violations(self, ref: str, entity_type: EntityType, path: str | None = None) -> DataFrame:
        """(subject, path, source, reason), one row an issue of the last validation."""
        rows = self.last_invalid(ref, entity_type).select("subject", F.explode(F.from_json("issues", "array<struct<path: string, reason: string, source: string>>")).alias("i"))
        rows = rows.select("subject", "i.path", "i.source", "i.reason")
        return rows if path is None else rows.where(F.col("path") == F.lit(path))

    def last_invalid(self, ref: str, entity_type: EntityType) -> DataFrame:
        scope = f"_sys/validation/{content_id('validation', [ref, entity_type.name])}/"
        rows = self.store.match(entity_type="sys.Validation").where(F.col("entity_id").startswith(scope))
        return rows.select(F.expr(f"substring(entity_id, {len(scope) + 1})").alias("subject"), F.col("value_json").alias("issues"))

    def ever_invalid(self, ref: str, entity_type: EntityType) -> DataFrame:
        scope = f"_sys/validation/{content_id('validation', [ref, entity_type.name])}/"
        rows = self.store.facts().where((F.col("entity_type") == "sys.Validation") & F.col("entity_id").startswith(scope))
        return rows.select(F.expr(f"substring(entity_id, {len(scope) + 1})").alias("subject")).distinct()

    def freshness(self, ref: str, release: str, entity_type: EntityType) -> str:
        scope = f"_sys/validation/{content_id('validation', [ref, entity_type.name])}"
        held = self.store.match(entity=scope, attribute=":sys/validated").first()
        if held is None:
            return "unvalidated"
        return "current" if json.loads(held["value_json"]) == {"release": release, "position": self._source_position()} else "stale"
