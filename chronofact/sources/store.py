"""A fact store on a shared folder: atomic commits, an ordered journal, runs that patterns read cheaply.

A commit is one file, ``log/<position>.json``, published by an exclusive create: whoever creates it owns the
position. It holds the commit's rows; those of a large one lie beside it in Parquet folders that the file names.
What was never published is invisible.

``fold`` writes the commits since the last fold as a run, clustered by (attribute, entity) and with the
retractions that hit the run itself folded in; ``compact`` merges all runs into one without pending retractions.
A manifest names the runs up to a position. A read is the scan of the runs and of the few commits after them,
less the retractions that are still apart; the driver holds those few commits only, and folding keeps them few.
"""

from __future__ import annotations

import json
import os
import secrets
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofact.errors import CommandAlreadyCommitted, ReadError, TransactionConflict, WriteError
from chronofact.functions.values import canonical_json
from chronofact.plans.build import run
from chronofact.plans.page import Page, run_page
from chronofact.sources.basis import Basis, now_ms, visible
from chronofact.sources.facts import ASSERTIONS, FACTS, RETRACTIONS, FactTable
from chronofact.sources.files import Files

TX_TYPE = "_Transaction"
RESERVED_ENTITIES, RESERVED_ATTRIBUTES, RESERVED_TYPES = ("_sys/", "_tx/"), (":sys/", ":_tx/"), (TX_TYPE,)
_ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid() -> str:
    n = (now_ms() << 80) | secrets.randbits(80)
    return "".join(_ALPHABET[(n >> (5 * i)) & 31] for i in reversed(range(26)))


def packed(value) -> dict:
    """Typed value columns of one value: {type, value, ...}, or a plain string, number or boolean."""
    if not isinstance(value, dict):
        value = {"type": "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string", "value": value}
    kind, v = value.get("type"), value.get("value")
    out = {"value_type": kind}
    if kind in ("string", "ref"):
        out["value_string"] = str(v)
    elif kind == "number":
        out["value_number"] = float(v)
    elif kind == "boolean":
        out["value_boolean"] = bool(v)
    elif kind == "datetime":
        out["value_datetime"] = int(v)
    elif kind == "json":
        out["value_json"] = canonical_json(v)
    elif kind == "blob":
        out["value_string"] = value.get("hash", v)
        out["value_json"] = canonical_json({k: value[k] for k in ("mimeType", "size", "filename") if k in value})
    else:
        raise WriteError(f"not a value type: {kind}")
    return out


def unpacked(r: Row) -> dict:
    kind = r["value_type"]
    if kind == "blob":
        meta = json.loads(r["value_json"] or "{}")
        return {"type": "blob", "hash": r["value_string"], "mimeType": meta.get("mimeType", "application/octet-stream"), "size": meta.get("size", 0), **({"filename": meta["filename"]} if "filename" in meta else {})}
    column = {"string": "value_string", "ref": "value_string", "number": "value_number", "boolean": "value_boolean", "datetime": "value_datetime", "json": "value_json"}[kind]
    return {"type": kind, "value": json.loads(r[column]) if kind == "json" else r[column]}


@dataclass(frozen=True)
class Assert:
    entity: str
    attribute: str
    value: object
    entity_type: str | None = None
    valid_from: int | None = None
    valid_to: int | None = None
    triple_id: str | None = None


@dataclass(frozen=True)
class Retract:
    triple_id: str


@dataclass(frozen=True)
class RetractPattern:
    entity: str | None = None
    attribute: str | None = None
    entity_type: str | None = None
    value: object = None


@dataclass(frozen=True)
class TripleLive:
    """A precondition: the fact that this transaction retracts is still live."""

    triple_id: str


@dataclass(frozen=True)
class Receipt:
    tx_id: str
    position: int
    instant: int
    triples: list[str]
    retracted: int


@dataclass
class Meta:
    actor: str | None = None
    command_id: str | None = None
    correlation_id: str | None = None
    causation_id: str | None = None
    config_snapshot: str | None = None
    preconditions: list[TripleLive] = field(default_factory=list)
    constraints: list = field(default_factory=list)


LOG = "position long, tx_id string, instant long, command_id string, quiet boolean"
#: More rows than this go to a Parquet folder beside the log.
MOST_INLINE = 2000
#: So many commits, or rows in them, are folded into a run.
FOLD_COMMITS, FOLD_ROWS = 1000, 100_000
ENDING = RETRACTIONS.names[1:]


@dataclass(frozen=True)
class Timeline:
    """A page of an entity's transactions, newest first, as of a position; the next page goes on before next_before."""

    transactions: list[Row]
    snapshot_position: int
    next_before: int | None


class FactStore:
    def __init__(self, spark: SparkSession, root: str, *, clock=now_ms, listeners: tuple = ()):
        self.spark, self.root, self.clock, self.listeners = spark, root.rstrip("/"), clock, list(listeners)
        self.files = Files(spark, self.root)
        self._tail: list[dict] = []  # commits after the manifest, each read once
        self._manifest = {"position": 0, "runs": [], "logs": []}
        self._frames: tuple | None = None

    # --- state -------------------------------------------------------------------------------------------

    def _entry(self, position: int) -> str:
        return f"{self.root}/log/{position:020d}.json"

    def _refresh(self) -> None:
        """Takes in what was committed or folded since the last look."""
        for name in sorted(self.files.names(f"{self.root}/manifests"), reverse=True):
            if name != self._manifest.get("name"):
                self._manifest = {**json.loads(self.files.read(f"{self.root}/manifests/{name}")), "name": name}
                self._tail = [e for e in self._tail if e["position"] > self._manifest["position"]]
            break
        at = self._tail[-1]["position"] if self._tail else self._manifest["position"]
        while self.files.exists(self._entry(at + 1)):
            at += 1
            self._tail.append(json.loads(self.files.read(self._entry(at))))

    def current_position(self) -> int:
        self._refresh()
        return self._tail[-1]["position"] if self._tail else self._manifest["position"]

    def log(self) -> DataFrame:
        """One row a commit: position, tx_id, instant, command_id, quiet."""
        self._refresh()
        rows = self.spark.createDataFrame([(e["position"], e["tx_id"], e["instant"], e.get("command_id"), e["quiet"]) for e in self._tail], LOG)
        return self.spark.read.schema(LOG).parquet(*self._manifest["logs"]).unionByName(rows) if self._manifest["logs"] else rows

    def _tail_rows(self) -> tuple[DataFrame | None, DataFrame | None]:
        """Assertions and retractions of the commits after the manifest, None where there are none."""
        key = (self._manifest.get("name"), len(self._tail))
        if self._frames is None or self._frames[0] != key:
            made = [tuple(r.get(n) for n in ASSERTIONS.names) for e in self._tail for r in e.get("assertions", ())]
            ended = [(t, e["instant"], e["position"], e["tx_id"]) for e in self._tail for t in e.get("retractions", ())]
            out = []
            for rows, kind, schema in ((made, "assertion_path", ASSERTIONS), (ended, "retraction_path", RETRACTIONS)):
                parts = [self.spark.createDataFrame(rows, schema)] if rows else []
                folders = [f"{self.root}/{e[kind]}" for e in self._tail if e.get(kind)]
                parts += [self.spark.read.schema(schema).parquet(*folders)] if folders else []
                out.append(reduce(DataFrame.unionByName, parts) if parts else None)
            self._frames = (key, *out)
        return self._frames[1:]

    def facts(self) -> DataFrame:
        """All committed facts with their retractions, in the wide layout."""
        self._refresh()
        made, ended = self._tail_rows()
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in RETRACTIONS.fields[1:]]
        runs = [f"{self.root}/{r['facts']}" for r in self._manifest["runs"]]
        parts = [self.spark.read.schema(FACTS).parquet(*runs)] if runs else []
        parts += [made.select("*", *nothing)] if made is not None else []
        if not parts:
            return self.spark.createDataFrame([], FACTS)
        facts = reduce(DataFrame.unionByName, parts)
        apart = [self.spark.read.schema(RETRACTIONS).parquet(*(f"{self.root}/{r['retractions']}" for r in self._manifest["runs"] if r.get("retractions")))] if any(r.get("retractions") for r in self._manifest["runs"]) else []
        apart += [ended] if ended is not None else []
        return _ended(facts, reduce(DataFrame.unionByName, apart)) if apart else facts

    def source(self, basis: Basis | None = None, kinds: dict[str, str] | None = None) -> FactTable:
        return FactTable(self.facts(), basis, kinds)

    def sql(self, query: str, basis: Basis | None = None) -> DataFrame:
        """Spark SQL over {facts}: all facts, or those visible at a basis."""
        facts = self.facts()
        return self.spark.sql(query, facts=facts if basis is None else facts.where(visible(basis.resolved())))

    # --- reads -------------------------------------------------------------------------------------------

    def get(self, triple_id: str, include_retracted: bool = False) -> DataFrame:
        found = self.facts().where(F.col("triple_id") == F.lit(triple_id))
        return found if include_retracted else found.where("retracted_at is null")

    def entity(self, entity: str, basis: Basis | None = None) -> DataFrame:
        return self.match(entity=entity, basis=basis)

    def entities(self, ids: list[str], basis: Basis | None = None) -> DataFrame:
        """(position, entity_id, facts) in the order of ids, no facts for ids that have none."""
        asked = self.spark.createDataFrame(list(enumerate(ids)), "position int, entity_id string")
        rows = self.facts().where(visible((basis or Basis()).resolved()))
        own = rows.join(asked.select("entity_id").distinct(), "entity_id", "left_semi").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("attribute", "triple_id", *(n for n in FACTS.names if n.startswith("value"))))).alias("facts"))
        return asked.join(own, "entity_id", "left").select("position", "entity_id", F.coalesce("facts", F.array()).alias("facts")).orderBy("position")

    def match(self, entity: str | None = None, attribute: str | None = None, entity_type: str | None = None, value=None, basis: Basis | None = None) -> DataFrame:
        """Visible facts; a value matches by storage type and payload."""
        rows = self.facts().where(visible((basis or Basis()).resolved()))
        return rows.where(pattern_column(entity, attribute, entity_type, value))

    def history(self, entity: str) -> DataFrame:
        return self.facts().where(F.col("entity_id") == F.lit(entity)).orderBy("recorded_at", "recorded_position", "triple_id")

    def query(self, query, basis: Basis | None = None, types: dict[str, str] | None = None, kinds: dict[str, str] | None = None) -> DataFrame:
        return run(self.source(basis, kinds), query, types)

    def query_page(self, wrapped, basis: Basis | None = None, types: dict[str, str] | None = None) -> Page:
        return run_page(self.source(), wrapped, basis=basis, position=self.current_position(), scope=self.root, types=types)

    def dependency_state(self, attributes: list[str], basis: Basis | None = None) -> dict:
        """The newest commit that touched the attributes, and when what is visible of them changes by itself next."""
        b = (basis or Basis()).resolved()
        return dependency_state(self.facts(), attributes, b)

    # --- journal -----------------------------------------------------------------------------------------

    def journal(self, where=None) -> DataFrame:
        """One row a journaled transaction: position, tx_id, instant, actor, ids, changes in the order they were made.

        where: a condition on the journal's facts that holds for all of a transaction's facts or for none.
        """
        rows = self.facts().where(F.col("entity_type") == TX_TYPE)
        return journal_of(rows if where is None else rows.where(where))

    def transactions(self, after: int = 0, limit: int = 100) -> DataFrame:
        if not 1 <= limit <= 1000:
            raise ReadError("limit is 1 to 1000")
        # a journal fact is recorded at its transaction's own position: older ones aren't read
        newer = self.facts().where((F.col("entity_type") == TX_TYPE) & (F.col("recorded_position") > after))
        first = newer.where("attribute = ':_tx/position'").select("entity_id", "recorded_position").orderBy("recorded_position").limit(limit)
        return journal_of(newer.join(first.select("entity_id"), "entity_id", "left_semi")).orderBy("position")

    def transaction(self, tx_id: str) -> DataFrame:
        return self.journal(F.col("entity_id") == F.lit(tx_id))

    def transaction_by_command(self, command_id: str) -> DataFrame:
        entry = self._command(command_id)
        return self.transaction(entry["tx_id"] if entry else "")

    def transactions_for_entity(self, entity: str, limit: int = 100, before: int | None = None, snapshot: int | None = None) -> DataFrame:
        """Newest first; snapshot: nothing after that position is seen."""
        if not 1 <= limit <= 1000:
            raise ReadError("limit is 1 to 1000")
        if any(p is not None and p < 0 for p in (before, snapshot)):
            raise ReadError("positions aren't negative")
        rows = self.facts().where(F.col("entity_type") == TX_TYPE)
        own = rows.where((F.col("attribute") == ":_tx/changed-entity") & (F.col("value_string") == F.lit(entity)))
        own = own if before is None else own.where(F.col("recorded_position") < before)
        own = own if snapshot is None else own.where(F.col("recorded_position") <= snapshot)
        ids = own.select("entity_id", "recorded_position").orderBy(F.desc("recorded_position")).limit(limit).select("entity_id")
        return journal_of(rows.join(ids, "entity_id", "left_semi")).orderBy(F.desc("position"))

    def timeline(self, entity: str, limit: int = 100, before: int | None = None, snapshot: int | None = None) -> Timeline:
        """One page; passing on its snapshot_position and next_before gives pages that later commits don't shift."""
        if not 1 <= limit <= 1000:
            raise ReadError("limit is 1 to 1000")
        at = self.current_position() if snapshot is None else snapshot
        rows = self.transactions_for_entity(entity, min(limit + 1, 1000) if limit < 1000 else limit, before, at).collect()
        more = len(rows) > limit or (limit == 1000 and len(rows) == limit and not self.transactions_for_entity(entity, 1, rows[-1]["position"], at).isEmpty())
        return Timeline(rows[:limit], at, rows[:limit][-1]["position"] if more else None)

    # --- writes ------------------------------------------------------------------------------------------

    def assert_one(self, a: Assert) -> Receipt:
        return self.transact([a])

    def assert_batch(self, batch: list[Assert]) -> Receipt:
        return self.transact(batch)

    def retract(self, triple_id: str) -> Receipt:
        if not self.get(triple_id).isEmpty():
            receipt = self.transact([Retract(triple_id)])
            if receipt.retracted:
                return receipt
        raise WriteError(f"fact {triple_id} isn't live")

    def retract_pattern(self, p: RetractPattern) -> int:
        return self.transact([p]).retracted

    def transact(self, ops: list, meta: Meta | None = None, *, system: bool = False) -> Receipt:
        """All ops or none, in order, as one commit. A lost race for the position is decided anew against the newer state."""
        meta = meta or Meta()
        if not system:
            for o in ops:
                if isinstance(o, Assert):
                    refuse_reserved(o.entity, o.attribute, o.entity_type)
        retracting = {o.triple_id for o in ops if isinstance(o, Retract)}
        for p in meta.preconditions:
            if p.triple_id not in retracting:
                raise WriteError(f"precondition on {p.triple_id} goes with its retraction")
        _check_command(meta)
        while True:
            receipt = self._attempt(ops, meta, system)
            if receipt is not None:
                for listen in self.listeners:
                    listen(receipt, ops)
                self._fold_if_long()
                return receipt

    def ingest(self, rows: DataFrame, meta: Meta | None = None, *, system: bool = False) -> Receipt:
        """Asserts a DataFrame of facts (assertion columns; missing ones are filled) as one commit, without the driver seeing rows.

        Guards are those of ``transact``. The journal has the transaction, not each of its rows.
        """
        meta = meta or Meta()
        if meta.preconditions:
            raise WriteError("preconditions go with retractions")
        _check_command(meta)
        tx, body = f"_tx/{ulid()}", None
        folder = f"assertions/{tx[4:]}"
        given = set(rows.columns)
        fill = {"triple_id": F.upper(F.substring(F.sha2(F.concat_ws("|", F.lit(tx), F.monotonically_increasing_id().cast("string")), 256), 1, 26)), "schema_version": F.lit(1), "tx_id": F.lit(tx)}
        while True:
            position, instant = self._next(meta), self.clock()
            if body != (position, instant):  # rows carry their position: a lost race writes them anew
                self.files.delete(f"{self.root}/{folder}")
                fill |= {"recorded_at": F.lit(instant), "recorded_position": F.lit(position), "valid_from": F.coalesce(F.col("valid_from"), F.lit(instant)) if "valid_from" in given else F.lit(instant)}
                shaped = rows.select(*((fill[f.name] if f.name in fill and (f.name not in given or f.name == "valid_from") else F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in ASSERTIONS.fields))
                shaped.write.parquet(f"{self.root}/{folder}")
                body = (position, instant)
            written = self.spark.read.schema(ASSERTIONS).parquet(f"{self.root}/{folder}")
            try:
                if not system and not written.where(_reserved()).isEmpty():
                    raise WriteError("reserved names can't be written")
                if meta.constraints:
                    from chronofact.operators.constraints import enforce

                    enforce(self.facts().where("retracted_at is null"), written, None, meta.constraints)
            except Exception:
                self._drop(tx)
                raise
            own = [] if system else self._journal_rows(tx, position, instant, [], meta)
            if self._publish({"position": position, "tx_id": tx, "instant": instant, "command_id": meta.command_id, "quiet": system, "bulk": True, "assertions": own, "assertion_path": folder}):
                receipt = Receipt(tx, position, instant, [], 0)
                for listen in self.listeners:
                    listen(receipt, [])
                self._fold_if_long()
                return receipt

    def fold(self) -> bool:
        """Writes the commits after the manifest as a run, so that reads are scans of clustered files. False if there are none."""
        self._refresh()
        if not self._tail:
            return False
        made, ended = self._tail_rows()
        to, name = self._tail[-1]["position"], ulid()
        run: dict = {}
        if made is not None:
            rows = made.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in RETRACTIONS.fields[1:]))
            self._write_run(_ended(rows, ended) if ended is not None else rows, f"runs/{name}/facts")
            run["facts"] = f"runs/{name}/facts"
        if ended is not None:
            older = ended.join(made.select("triple_id"), "triple_id", "left_anti") if made is not None else ended
            older.write.parquet(f"{self.root}/runs/{name}/retractions")
            run["retractions"] = f"runs/{name}/retractions"
        if "facts" not in run:
            self._write_run(self.spark.createDataFrame([], FACTS), f"runs/{name}/facts")
            run["facts"] = f"runs/{name}/facts"
        logs = f"{self.root}/runs/{name}/log"
        self.spark.createDataFrame([(e["position"], e["tx_id"], e["instant"], e.get("command_id"), e["quiet"]) for e in self._tail], LOG).coalesce(1).write.parquet(logs)
        return self._turn(to, 0, [*self._manifest["runs"], run], [*self._manifest["logs"], logs], name)

    def compact(self, to: str | None = None) -> FactTable:
        """Merges all runs into one, retractions folded in; with ``to`` it writes a copy there and leaves the store as it is."""
        if to is not None:
            self._write_run(self.facts(), to, False)
            return FactTable(self.spark.read.schema(FACTS).parquet(to))
        self.fold()
        if len(self._manifest["runs"]) > 1 or any(r.get("retractions") for r in self._manifest["runs"]):
            name, state = ulid(), self._manifest
            # commits that come meanwhile stay in the tail; they end facts there
            merged = self.facts().where(F.col("recorded_position") <= state["position"])
            late = F.col("retracted_position") > state["position"]
            self._write_run(merged.select(*ASSERTIONS.names, *(F.when(~F.coalesce(late, F.lit(False)), F.col(c)).alias(c) for c in ENDING)), f"runs/{name}/facts")
            log = f"{self.root}/runs/{name}/log"
            self.spark.read.schema(LOG).parquet(*state["logs"]).write.parquet(log)
            self._turn(state["position"], state.get("level", 0) + 1, [{"facts": f"runs/{name}/facts"}], [log], name)
        return self.source()

    def vacuum(self) -> int:
        """Deletes the runs that the newest manifest doesn't name; readers of older manifests must be done. How many."""
        self._refresh()
        named = {p.split("/")[-2] for r in self._manifest["runs"] for p in r.values()} | {p.split("/")[-2] for p in self._manifest["logs"]}
        old = [n for n in self.files.names(f"{self.root}/runs") if n not in named]
        for n in old:
            self.files.delete(f"{self.root}/runs/{n}")
        return len(old)

    def _write_run(self, facts: DataFrame, to: str, inside: bool = True) -> None:
        facts.select(*FACTS.names).repartitionByRange("attribute", "entity_id").sortWithinPartitions("attribute", "entity_id").write.parquet(f"{self.root}/{to}" if inside else to)

    def _turn(self, position: int, level: int, runs: list[dict], logs: list[str], name: str) -> bool:
        """Makes a manifest the store's, unless another folder was first."""
        text = json.dumps({"position": position, "level": level, "runs": runs, "logs": logs})
        if not self.files.create(f"{self.root}/manifests/{position:020d}.{level:06d}.json", text):
            self.files.delete(f"{self.root}/runs/{name}")
            return False
        self._frames = None
        self._refresh()
        return True

    def _fold_if_long(self) -> None:
        self._refresh()
        if len(self._tail) >= FOLD_COMMITS or sum(len(e.get("assertions", ())) for e in self._tail) >= FOLD_ROWS:
            self.fold()

    def _command(self, command_id: str) -> dict | None:
        """The commit of a command, if it was committed."""
        self._refresh()
        for e in self._tail:
            if e.get("command_id") == command_id:
                return e
        if not self._manifest["logs"]:
            return None
        found = self.spark.read.schema(LOG).parquet(*self._manifest["logs"]).where(F.col("command_id") == F.lit(command_id)).first()
        return found.asDict() if found else None

    def _next(self, meta: Meta) -> int:
        """The position to try, after a look for the command."""
        if meta.command_id is not None and (earlier := self._command(meta.command_id)):
            raise CommandAlreadyCommitted(meta.command_id, earlier["tx_id"])
        return self.current_position() + 1

    def _publish(self, entry: dict) -> bool:
        return self.files.create(self._entry(entry["position"]), json.dumps(entry) + "\n")

    def _drop(self, tx: str) -> None:
        for kind in ("assertions", "retractions"):
            self.files.delete(f"{self.root}/{kind}/{tx[4:]}")

    def _journal_rows(self, tx: str, position: int, instant: int, changes: list[dict], meta: Meta) -> list[dict]:
        out = []

        def fact(attribute: str, value) -> None:
            out.append(self._row(Assert(tx, f":_tx/{attribute}", value, TX_TYPE, instant), tx, position, instant, meta))

        fact("position", position)
        fact("instant", {"type": "datetime", "value": instant})
        for name, value in (("actor", meta.actor), ("command-id", meta.command_id), ("correlation-id", meta.correlation_id), ("causation-id", meta.causation_id), ("config-snapshot", meta.config_snapshot)):
            if value is not None:
                fact(name, value)
        for entity in dict.fromkeys(c["entityId"] for c in changes):
            fact("changed-entity", {"type": "ref", "value": entity})
        for i, c in enumerate(changes):
            fact("change", {"type": "json", "value": {"index": i, **c}})
        return out

    def _row(self, a: Assert, tx: str, position: int, instant: int, meta: Meta) -> dict:
        values = {"triple_id": a.triple_id or ulid(), "entity_id": a.entity, "attribute": a.attribute, **packed(a.value), "recorded_at": instant, "recorded_position": position, "valid_from": instant if a.valid_from is None else a.valid_from, "valid_to": a.valid_to, "created_by": meta.actor, "entity_type": a.entity_type, "schema_version": 1, "tx_id": tx}
        return {n: values[n] for n in ASSERTIONS.names if values.get(n) is not None}

    def _attempt(self, ops: list, meta: Meta, system: bool) -> Receipt | None:
        position, instant, tx = self._next(meta), self.clock(), f"_tx/{ulid()}"
        live = self.facts().where("retracted_at is null") if meta.constraints or any(not isinstance(o, Assert) for o in ops) else None
        # what the retractions may hit, in one look: bounded by what one command changes
        ids = sorted({o.triple_id for o in ops if isinstance(o, Retract)})
        patterns = [pattern_values(o.entity, o.attribute, o.entity_type, o.value) for o in ops if isinstance(o, RetractPattern)]
        found = _hit(live, [{"triple_id": i} for i in ids] + patterns) if ids or patterns else []
        known = {r["triple_id"]: {k: v for k, v in r.asDict().items() if v is not None} for r in found}
        guarded = {p.triple_id for p in meta.preconditions}
        rows, ended, changes = [], {}, []
        by_entity: dict[str, list[str]] = {}
        for r in known.values():
            by_entity.setdefault(r["entity_id"], []).append(r["triple_id"])
        for o in ops:
            if isinstance(o, Assert):
                row = self._row(o, tx, position, instant, meta)
                rows.append(row)
                known[row["triple_id"]] = row
                by_entity.setdefault(o.entity, []).append(row["triple_id"])
                changes.append(change_record("assert", row, tx, instant))
                continue
            if isinstance(o, Retract):
                hits = [known[o.triple_id]] if o.triple_id in known and o.triple_id not in ended else []
                if not hits and o.triple_id in guarded:
                    raise TransactionConflict(o.triple_id)
            else:
                like = pattern_values(o.entity, o.attribute, o.entity_type, o.value)
                near = by_entity.get(o.entity, []) if o.entity is not None else list(known)
                hits = [known[t] for t in near if t not in ended and all(known[t].get(k) == v for k, v in like.items())]
            for h in hits:
                if not system:
                    refuse_reserved(h["entity_id"], h["attribute"], h.get("entity_type"))
                ended[h["triple_id"]] = h
                changes.append(change_record("retract", h, tx, instant))
        if meta.constraints:
            from chronofact.operators.constraints import enforce

            after = [tuple(r.get(n) for n in ASSERTIONS.names) for r in rows if r["triple_id"] not in ended]
            enforce(live, self.spark.createDataFrame(after, ASSERTIONS), list(ended.values()), meta.constraints)
        own = [] if system else self._journal_rows(tx, position, instant, changes, meta)
        entry = {"position": position, "tx_id": tx, "instant": instant, "command_id": meta.command_id, "quiet": system, "assertions": own, "retractions": []}
        if len(rows) <= MOST_INLINE:
            entry["assertions"] = rows + own
        else:
            entry["assertion_path"] = f"assertions/{tx[4:]}"
            self.spark.createDataFrame([tuple(r.get(n) for n in ASSERTIONS.names) for r in rows], ASSERTIONS).write.parquet(f"{self.root}/assertions/{tx[4:]}")
        if len(ended) <= MOST_INLINE:
            entry["retractions"] = list(ended)
        else:
            entry["retraction_path"] = f"retractions/{tx[4:]}"
            self.spark.createDataFrame([(t, instant, position, tx) for t in ended], RETRACTIONS).write.parquet(f"{self.root}/retractions/{tx[4:]}")
        if not self._publish(entry):
            self._drop(tx)
            time.sleep(0.01)
            return None
        return Receipt(tx, position, instant, [r["triple_id"] for r in rows], len(ended))


def _hit(live: DataFrame, patterns: list[dict]) -> list[Row]:
    """Facts that any pattern matches, oldest first. Patterns that name the same columns are one join, however many they are."""
    kinds: dict[tuple, list[tuple]] = {}
    for p in patterns:
        kinds.setdefault(tuple(sorted(p)), []).append(tuple(p[k] for k in sorted(p)))
    parts = []
    for columns, values in kinds.items():
        if len(values) <= 8 or not columns:
            parts.append(live.where(reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.col(c) == F.lit(v) for c, v in zip(columns, row)), F.lit(True)) for row in values))))
        else:
            schema = T.StructType([ASSERTIONS[c] for c in columns])
            parts.append(live.join(live.sparkSession.createDataFrame(sorted(set(values)), schema), list(columns), "left_semi").select(*live.columns))
    return reduce(DataFrame.unionByName, parts).select(*ASSERTIONS.names).orderBy("recorded_position", "triple_id").collect()


def pattern_values(entity=None, attribute=None, entity_type=None, value=None) -> dict:
    """The columns that a pattern fixes."""
    named = {"entity_id": entity, "attribute": attribute, "entity_type": entity_type}
    return {k: v for k, v in named.items() if v is not None} | (packed(value) if value is not None else {})


def _ended(facts: DataFrame, retractions: DataFrame) -> DataFrame:
    """facts with retractions that are kept apart; a fact ends once, by the earliest."""
    first = retractions.groupBy("triple_id").agg(F.min(F.struct("retracted_position", "retracted_at", "retract_tx_id")).alias("r"))
    first = first.select("triple_id", *(F.col(f"r.{c}").alias(f"late_{c}") for c in ENDING))
    out = facts.join(first, "triple_id", "left")
    return out.select(*ASSERTIONS.names, *(F.coalesce(c, f"late_{c}").alias(c) for c in ENDING))


def journal_of(rows: DataFrame) -> DataFrame:
    """One row a transaction of journal facts, its changes by their index."""
    one = lambda a, c: F.max(F.when(F.col("attribute") == f":_tx/{a}", F.col(c)))
    index = F.get_json_object("value_json", "$.index").cast("int")
    changes = F.array_sort(F.collect_list(F.when(F.col("attribute") == ":_tx/change", F.struct(index.alias("i"), F.col("value_json").alias("c")))))
    entities = F.array_sort(F.collect_set(F.when(F.col("attribute") == ":_tx/changed-entity", F.col("value_string"))))
    return rows.groupBy(F.col("entity_id").alias("tx_id")).agg(
        one("position", "value_number").cast("long").alias("position"), one("instant", "value_datetime").alias("instant"), one("actor", "value_string").alias("actor"), one("command-id", "value_string").alias("command_id"),
        one("correlation-id", "value_string").alias("correlation_id"), one("causation-id", "value_string").alias("causation_id"), one("config-snapshot", "value_string").alias("config_snapshot"), entities.alias("entities"), F.transform(changes, lambda x: x["c"]).alias("changes"),
    )


def change_record(op: str, row: dict, tx: str, instant: int) -> dict:
    """What a consumer of the journal learns of one asserted or retracted fact."""
    out = {"op": op, "tripleId": row["triple_id"], "entityId": row["entity_id"], "attribute": row["attribute"], "value": unpacked({**dict.fromkeys(ASSERTIONS.names), **row}), "validFrom": row["valid_from"], "recordedAt": row["recorded_at"], "assertionTxId": row["tx_id"]}
    out |= {k: row[c] for k, c in (("entityType", "entity_type"), ("validTo", "valid_to")) if row.get(c) is not None}
    return out | ({"retractedAt": instant, "retractionTxId": tx} if op == "retract" else {})


def _check_command(meta: Meta) -> None:
    if meta.command_id is not None and not 1 <= len(meta.command_id) <= 1024:
        raise WriteError("a command id has 1 to 1024 characters")


def pattern_column(entity=None, attribute=None, entity_type=None, value=None):
    return reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in pattern_values(entity, attribute, entity_type, value).items()), F.lit(True))


def change_events(receipt: Receipt, ops: list) -> list[dict]:
    """What a write tells listeners: who and what changed, without values."""
    kinds = {Assert: "asserted", Retract: "retracted", RetractPattern: "retracted-pattern"}
    return [{"event": kinds[type(o)], "tx": receipt.tx_id, "position": receipt.position, **{k: v for k in ("entity", "attribute", "entity_type", "triple_id") if (v := getattr(o, k, None)) is not None}} for o in ops]


def refuse_reserved(entity: str | None, attribute: str | None, kind: str | None) -> None:
    """The store's own facts are written by the store only; asserting and retracting are both writes."""
    if (entity or "").startswith(RESERVED_ENTITIES) or (attribute or "").startswith(RESERVED_ATTRIBUTES) or kind in RESERVED_TYPES:
        raise WriteError("reserved names can't be written")


def _reserved():
    """refuse_reserved as a condition on fact rows."""
    starts = [F.col(c).startswith(p) for c, prefixes in (("entity_id", RESERVED_ENTITIES), ("attribute", RESERVED_ATTRIBUTES)) for p in prefixes]
    return reduce(lambda a, b: a | b, starts) | F.coalesce(F.col("entity_type").isin(*RESERVED_TYPES), F.lit(False))


def dependency_state(facts: DataFrame, attributes: list[str], b: Basis) -> dict:
    rows = facts.where(F.col("attribute").isin(*attributes))
    touched = F.greatest(F.col("recorded_position"), F.coalesce(F.col("retracted_position"), F.lit(0)))
    if b.recorded_position is not None:
        limit = b.recorded_position
        touched = F.greatest(F.when(F.col("recorded_position") <= limit, F.col("recorded_position")), F.when(F.col("retracted_position") <= limit, F.col("retracted_position")))
        alive = (F.col("recorded_position") <= limit) & (F.col("retracted_position").isNull() | (F.col("retracted_position") > limit))
    elif b.recorded_at is not None:
        touched = F.greatest(F.when(F.col("recorded_at") <= b.recorded_at, F.col("recorded_position")), F.when(F.col("retracted_at") <= b.recorded_at, F.col("retracted_position")))
        alive = (F.col("recorded_at") <= b.recorded_at) & (F.col("retracted_at").isNull() | (F.col("retracted_at") > b.recorded_at))
    else:
        alive = F.col("retracted_at").isNull()
    future = lambda c: F.min(F.when(alive & (F.col(c) > b.valid_at), F.col(c)))
    r = rows.agg(F.coalesce(F.max(touched), F.lit(0)).alias("p"), F.least(future("valid_from"), future("valid_to")).alias("n")).first()
    return {"source_position": r["p"], "next_boundary": r["n"]}


def local_root(path: str) -> str:
    return "file://" + os.path.abspath(path)
