"""Where patterns find their facts.

``FactTable`` reads the wide fact layout. ``TableFacts`` answers patterns straight from relational tables: an
entity is a row, an attribute a column, so several attributes of one entity are one scan of one table and no
unpivoting takes place. ``Union`` puts several sources behind one interface.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofact.functions.values import ANY, FAM, FAMILY, lift
from chronofact.sources.basis import Basis, visible

ASSERTION_FIELDS = [
    ("triple_id", "string"), ("entity_id", "string"), ("attribute", "string"), ("value_type", "string"), ("value_string", "string"), ("value_number", "double"), ("value_boolean", "boolean"),
    ("value_datetime", "long"), ("value_json", "string"), ("recorded_at", "long"), ("recorded_position", "long"), ("valid_from", "long"), ("valid_to", "long"), ("created_by", "string"),
    ("entity_type", "string"), ("schema_version", "int"), ("tx_id", "string"),
]
RETRACTION_FIELDS = [("triple_id", "string"), ("retracted_at", "long"), ("retracted_position", "long"), ("retract_tx_id", "string")]
_KIND = {"string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "long": T.LongType(), "int": T.IntegerType()}
ASSERTIONS = T.StructType([T.StructField(n, _KIND[t]) for n, t in ASSERTION_FIELDS])
RETRACTIONS = T.StructType([T.StructField(n, _KIND[t]) for n, t in RETRACTION_FIELDS])
FACTS = T.StructType([*ASSERTIONS.fields, *RETRACTIONS.fields[1:]])


def scalar(kind: str = "any") -> Column:
    """The value of a fact row, as one family's column or as the struct of all."""
    number = F.coalesce(F.col("value_number"), F.col("value_datetime").cast("double"))
    text = F.coalesce(F.col("value_string"), F.col("value_json"))
    if kind != "any":
        return {"num": number, "bool": F.col("value_boolean"), "txt": text}[kind]
    fam = F.when(F.col("value_type").isin("number", "datetime"), F.lit(FAM["num"])).when(F.col("value_type") == "boolean", F.lit(FAM["bool"])).otherwise(F.lit(FAM["txt"]))
    return F.struct(fam.cast("tinyint").alias("fam"), F.when(fam == 0, number).alias("num"), F.when(fam == 1, F.col("value_boolean")).alias("bool"), F.when(fam == 2, text).alias("txt")).cast(ANY)


@dataclass(frozen=True)
class Wanted:
    """One pattern: constants (None where a variable stands) and whether a reference is asked for."""

    entity: str | None = None
    attribute: str | None = None
    value: object = None
    is_ref: bool = False
    tx: str | None = None
    entity_type: str | None = None


@dataclass(frozen=True)
class Scan:
    """Columns e, a, v, tx of the facts found; kind is v's."""

    frame: DataFrame
    kind: str


class FactTable:
    """Facts in the wide layout of FACTS.

    kinds names the family of attributes that hold one only; their values are read from the raw column.
    """

    def __init__(self, facts: DataFrame, basis: Basis | None = None, kinds: dict[str, str] | None = None):
        self.facts, self.basis, self.kinds = facts, (basis or Basis()).resolved(), kinds or {}

    @property
    def spark(self) -> SparkSession:
        return self.facts.sparkSession

    def at(self, basis: Basis) -> FactTable:
        return FactTable(self.facts, basis, self.kinds)

    def visible(self) -> DataFrame:
        return self.facts.where(visible(self.basis))

    def matching(self, w: Wanted) -> DataFrame:
        """Whole fact rows; all filters are on raw columns, so they reach the files."""
        rows = self.visible()
        for name, value in (("entity_id", w.entity), ("attribute", w.attribute), ("tx_id", w.tx), ("entity_type", w.entity_type)):
            if value is not None:
                rows = rows.where(F.col(name) == F.lit(value))
        v = w.value
        if v is None:
            return rows
        if w.is_ref:
            return rows.where((F.col("value_type") == "ref") & (F.col("value_string") == F.lit(v)))
        if isinstance(v, bool):
            return rows.where((F.col("value_type") == "boolean") & (F.col("value_boolean") == F.lit(v)))
        if isinstance(v, (int, float)):
            return rows.where((F.col("value_number") == F.lit(float(v))) | (F.col("value_datetime").cast("double") == F.lit(float(v))))
        return rows.where(F.col("value_type").isin("string", "ref", "json", "blob") & (F.coalesce(F.col("value_string"), F.col("value_json")) == F.lit(v)))

    def scan(self, w: Wanted) -> Scan:
        kind = self.kinds.get(w.attribute, "any")
        return Scan(self.matching(w).select(F.col("entity_id").alias("e"), F.col("attribute").alias("a"), scalar(kind).alias("v"), F.col("tx_id").alias("tx")), kind)

    def star(self, attributes: list[str]) -> tuple[DataFrame, list[str]] | None:
        return None


@dataclass(frozen=True)
class TableSpec:
    """How a table's rows are entities: id is prefix:key, columns maps attributes to (expression, storage type)."""

    frame: DataFrame
    prefix: str
    entity_type: str
    key: Column
    columns: dict[str, tuple[Column, str]] = field(hash=False)

    @property
    def entity(self) -> Column:
        return F.concat(F.lit(f"{self.prefix}:"), self.key.cast("string"))


def table_spec(frame: DataFrame, prefix: str, key: str | Column, *, entity_type: str | None = None, refs: dict[str, str] | None = None, json_columns: tuple[str, ...] = (), skip: tuple[str, ...] = (), strip: str = "") -> TableSpec:
    """A spec for a whole table: attributes :prefix/column, storage types after the columns' types.

    refs maps a column to the prefix of the entities that it points to.
    """
    columns: dict[str, tuple[Column, str]] = {}
    for name, kind in frame.dtypes:
        if name in skip or (isinstance(key, str) and name == key):
            continue
        attribute = f":{prefix}/{name.removeprefix(strip)}"
        c = F.col(name)
        if refs and name in refs:
            columns[attribute] = (F.concat(F.lit(f"{refs[name]}:"), c.cast("string")), "ref")
        elif name in json_columns:
            columns[attribute] = (c.cast("string"), "json")
        elif kind == "string":
            columns[attribute] = (c, "string")
        elif kind == "boolean":
            columns[attribute] = (c, "boolean")
        elif kind.startswith("timestamp_ntz"):
            columns[attribute] = (F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)").cast("double"), "datetime")
        elif kind.startswith("timestamp"):
            columns[attribute] = (F.unix_millis(c).cast("double"), "datetime")
        elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            columns[attribute] = (c.cast("double"), "number")
    return TableSpec(frame, prefix, entity_type or prefix.capitalize(), F.col(key) if isinstance(key, str) else key, columns)


class TableFacts:
    """Facts read straight from tables. All are asserted by one transaction and valid always."""

    TX = "_tx/00000000000000000000000000"

    def __init__(self, spark: SparkSession, *specs: TableSpec):
        self.spark, self.specs = spark, specs
        self.owner = {a: s for s in specs for a in s.columns}

    def at(self, basis: Basis) -> TableFacts:
        return self

    def kind(self, attribute: str) -> str:
        spec = self.owner.get(attribute)
        return FAMILY[spec.columns[attribute][1]] if spec else "any"

    def _one(self, spec: TableSpec, attribute: str, w: Wanted) -> DataFrame:
        c, stored = spec.columns[attribute]
        rows = spec.frame.where(c.isNotNull())
        if w.entity is not None:
            prefix, _, key = w.entity.partition(":")
            rows = rows.where(spec.key.cast("string") == F.lit(key)) if prefix == spec.prefix else rows.where(F.lit(False))
        if w.value is not None:
            raw = w.value
            family = "bool" if isinstance(raw, bool) else "num" if isinstance(raw, (int, float)) else "txt"
            fits = family == FAMILY[stored] and (not w.is_ref or stored == "ref")
            rows = rows.where(c == F.lit(float(raw) if family == "num" else raw)) if fits else rows.where(F.lit(False))
        if w.tx is not None and w.tx != self.TX:
            rows = rows.where(F.lit(False))
        return rows

    def scan(self, w: Wanted) -> Scan:
        if w.attribute is not None:
            spec = self.owner.get(w.attribute)
            if spec is None or (w.entity_type is not None and w.entity_type != spec.entity_type):
                return Scan(self.spark.createDataFrame([], f"e string, a string, v {ANY}, tx string"), "any")
            c, stored = spec.columns[w.attribute]
            return Scan(self._one(spec, w.attribute, w).select(spec.entity.alias("e"), F.lit(w.attribute).alias("a"), c.alias("v"), F.lit(self.TX).alias("tx")), FAMILY[stored])
        parts = []
        for spec in self.specs:
            if (w.entity_type is not None and w.entity_type != spec.entity_type) or (w.entity is not None and not w.entity.startswith(f"{spec.prefix}:")):
                continue
            rows = spec.frame
            if w.entity is not None:
                rows = rows.where(spec.key.cast("string") == F.lit(w.entity.partition(":")[2]))
            # one pass over the table whatever the number of its columns
            cells = F.array(*(F.struct(F.lit(a).alias("a"), lift(c, FAMILY[stored]).alias("v"), F.lit(stored).alias("stored")) for a, (c, stored) in spec.columns.items()))
            cells = rows.select(spec.entity.alias("e"), F.inline(cells)).where("v is not null")
            parts.append(cells)
        if not parts:
            return Scan(self.spark.createDataFrame([], f"e string, a string, v {ANY}, tx string"), "any")
        every = reduce(DataFrame.unionByName, parts)
        if w.value is not None:
            raw = w.value
            family = "bool" if isinstance(raw, bool) else "num" if isinstance(raw, (int, float)) else "txt"
            every = every.where(F.col(f"v.{family}") == F.lit(float(raw) if family == "num" else raw))
            if w.is_ref:
                every = every.where("stored = 'ref'")
        return Scan(every.select("e", "a", "v", F.lit(self.TX).alias("tx")), "any")

    def star(self, attributes: list[str]) -> tuple[DataFrame, list[str]] | None:
        """One row an entity that has all the attributes, if one table holds them: e, v0, v1, ... and their kinds."""
        specs = {id(self.owner[a]) if a in self.owner else None for a in attributes}
        if len(specs) != 1 or None in specs:
            return None
        spec = self.owner[attributes[0]]
        rows = spec.frame
        for a in dict.fromkeys(attributes):
            rows = rows.where(spec.columns[a][0].isNotNull())
        return rows.select(spec.entity.alias("e"), *(spec.columns[a][0].alias(f"v{i}") for i, a in enumerate(attributes))), [FAMILY[spec.columns[a][1]] for a in attributes]

    def facts(self, attributes: list[str] | None = None, recorded_at: int = 0) -> DataFrame:
        """The same facts in the wide layout."""
        parts = []
        for spec in self.specs:
            cells = []
            for a, (c, stored) in spec.columns.items():
                if attributes is not None and a not in attributes:
                    continue
                cells.append(
                    F.struct(
                        F.lit(a).alias("attribute"), F.lit(stored).alias("value_type"), (c if stored in ("string", "ref", "blob") else F.lit(None)).cast("string").alias("value_string"), (c if stored == "number" else F.lit(None)).cast("double").alias("value_number"),
                        (c if stored == "boolean" else F.lit(None)).cast("boolean").alias("value_boolean"), (c if stored == "datetime" else F.lit(None)).cast("long").alias("value_datetime"), (c if stored == "json" else F.lit(None)).cast("string").alias("value_json"), c.isNotNull().alias("there"),
                    )
                )
            if cells:
                parts.append(spec.frame.select(spec.entity.alias("entity_id"), F.lit(spec.entity_type).alias("entity_type"), F.inline(F.array(*cells))).where("there"))
        rows = reduce(DataFrame.unionByName, parts)
        ident = F.upper(F.substring(F.sha2(F.concat_ws("|", "entity_id", "attribute"), 256), 1, 26))
        fixed = {"triple_id": ident, "recorded_at": F.lit(recorded_at).cast("long"), "recorded_position": F.lit(0).cast("long"), "valid_from": F.lit(0).cast("long"), "valid_to": F.lit(None).cast("long"), "created_by": F.lit(None).cast("string"), "schema_version": F.lit(1), "tx_id": F.lit(self.TX)}
        fixed |= {"retracted_at": F.lit(None).cast("long"), "retracted_position": F.lit(None).cast("long"), "retract_tx_id": F.lit(None).cast("string")}
        return rows.withColumns(fixed).select(*FACTS.names)


class Union:
    """Several sources as one."""

    def __init__(self, *sources):
        self.sources, self.spark = sources, sources[0].spark

    def at(self, basis: Basis) -> Union:
        return Union(*(s.at(basis) for s in self.sources))

    def scan(self, w: Wanted) -> Scan:
        found = [s.scan(w) for s in self.sources]
        kind = found[0].kind if len({f.kind for f in found}) == 1 else "any"
        frames = [f.frame if f.kind == kind else f.frame.withColumn("v", lift(F.col("v"), f.kind)) for f in found]
        return Scan(reduce(DataFrame.unionByName, frames), kind)

    def star(self, attributes: list[str]):
        return None

