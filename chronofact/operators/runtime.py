"""Decisions under a release: rules of one configuration ref, judged over the facts visible at a basis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.errors import ConfigError
from chronofact.functions import boolexpr as B
from chronofact.functions.values import content_id
from chronofact.operators.config import Node, Release, Releases
from chronofact.sources.basis import Basis, visible
from chronofact.sources.store import FactStore, unpacked


def rule_node(key: str, expr) -> Node:
    """A rule as a configuration node; what it calls are its references."""
    called = sorted({r for r in _calls(expr)})
    return Node("rule", key, {"expr": B.to_json(expr)}, refs=tuple(("calls", f"rule:{r}") for r in called))


def _calls(e) -> set[str]:
    if isinstance(e, B.Rule):
        return {e.key}
    parts = (e.expr,) if isinstance(e, B.Not) else e.exprs if isinstance(e, (B.All, B.Any)) else ()
    return set().union(*map(_calls, parts))


def catalog(release: Release) -> dict[str, object]:
    """The rules of a release by their key."""
    return {n.key: B.from_json(n.attrs["expr"]) for n in release.nodes.values() if n.kind == "rule"}


class Runtime:
    def __init__(self, store: FactStore, releases: Releases):
        self.store, self.releases, self.cache = store, releases, B.EvaluationCache()

    def world(self, reads: set[tuple[str, str]], basis: Basis) -> dict[tuple[str, str], object]:
        """The facts that an evaluation may observe; two for one place, or one that isn't a scalar, can't decide anything."""
        if not reads:
            return {}
        spark = self.store.spark
        asked = spark.createDataFrame(sorted(reads), "entity_id string, attribute string")
        rows = self.store.facts().where(visible(basis)).join(asked, ["entity_id", "attribute"]).collect()  # a few a decision
        out: dict[tuple[str, str], object] = {}
        for r in rows:
            at = (r["entity_id"], r["attribute"])
            if at in out:
                raise ConfigError(f"{at[0]}{at[1]} has several values")
            value = unpacked(r)
            if value["type"] == "json":
                raise ConfigError(f"{at[0]}{at[1]} is json, which no rule can judge")
            out[at] = value["hash"] if value["type"] == "blob" else value["value"]
        return out

    def decide(self, ref: str, rule: str, subject: str, now: int, basis: Basis | None = None) -> dict:
        """{id, ref, release, subject, now, proof}: the answer of a rule of the release that the ref is at, and why."""
        release = self.releases.resolve(ref)
        rules = catalog(release)
        question = B.Rule(rule)
        reads = {(subject if e == B.SUBJECT else e, a) for e, a in B.attributes(question, rules)}
        world = self.world(reads, (basis or Basis()).resolved())
        proof = self.cache.truth(question, world, subject, now, rules)
        return {"id": content_id("decision", [release.id, subject, proof["id"]]), "ref": ref, "release": release.id, "subject": subject, "now": now, "proof": proof}

    def decide_all(self, ref: str, rule: str, now: int, subject_type: str, basis: Basis | None = None) -> DataFrame:
        """(subject, truth, proof_id, reasons, observed, release) of every subject of a type, in one distributed pass."""
        release = self.releases.resolve(ref)
        facts = self.store.facts().where(visible((basis or Basis()).resolved()))
        return B.prove(facts, B.Rule(rule), now, catalog(release), subject_type).withColumn("release", F.lit(release.id))


def verify(decision: dict) -> bool:
    """Whether a decision's ids fit its content, all the way down."""
    return B.verify(decision["proof"]) and decision["id"] == content_id("decision", [decision["release"], decision["subject"], decision["proof"]["id"]])
