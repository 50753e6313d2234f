"""Standing questions and their answers, found again by what they observed.

A registration is a question about every subject of a population. Its answers are a written table, a row a
subject with what the proof looked at: facts, present or absent, rules and the clock. A change is looked up in
the table's observations; only what depended on it is decided anew, and what flips is told.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.functions import boolexpr as B
from chronofact.functions.staging import discard, stage

ANSWERS = "question string, subject string, truth boolean, proof_id string, reasons array<string>, observed array<string>"


def fact_key(entity: str, attribute: str) -> str:
    return f"fact|{entity}|{attribute}"


def rule_key(key: str) -> str:
    return f"rule|{key}"


def clock_key(granularity: str) -> str:
    return f"clock|{granularity}"


def changed_keys(changes: DataFrame) -> DataFrame:
    """(key) of changes(entity_id, attribute), as the feed hands them on."""
    return changes.select(F.concat_ws("|", F.lit("fact"), "entity_id", "attribute").alias("key")).distinct()


class Reactor:
    def __init__(self, spark, catalog: dict[str, object] | None = None):
        self.spark, self.catalog, self.questions = spark, dict(catalog or {}), {}
        self.answers = spark.createDataFrame([], ANSWERS)

    def _prove(self, name: str, facts: DataFrame, now: int) -> DataFrame:
        expr, subject_type = self.questions[name]
        return B.prove(facts, expr, now, self.catalog, subject_type).select(F.lit(name).alias("question"), "subject", "truth", "proof_id", "reasons", "observed")

    def _keep(self, answers: DataFrame) -> None:
        old, self.answers = self.answers, stage(answers, "answers")
        discard(old)

    def register(self, name: str, expr, facts: DataFrame, now: int, subject_type: str | None = None) -> None:
        """A question about every subject of a type, decided once over the visible facts."""
        self.questions[name] = (expr, subject_type)
        self._keep(self.answers.where(F.col("question") != F.lit(name)).unionByName(self._prove(name, facts, now)))

    def unregister(self, name: str) -> bool:
        if self.questions.pop(name, None) is None:
            return False
        self._keep(self.answers.where(F.col("question") != F.lit(name)))
        return True

    def affected(self, keys: DataFrame) -> DataFrame:
        """(question, subject) whose answer observed any of keys(key)."""
        slots = self.answers.select("question", "subject", F.explode("observed").alias("key"))
        return slots.join(keys.select("key").distinct(), "key", "left_semi").select("question", "subject").distinct()

    def refresh(self, keys: DataFrame, facts: DataFrame, now: int, catalog: dict[str, object] | None = None) -> DataFrame:
        """Decides what depended on the keys anew; (question, subject, before, after) of the answers that flipped.

        Subjects that came into being since aren't known by their observations: they are decided as well.
        """
        if catalog is not None:
            self.catalog = dict(catalog)
        stale = stage(self.affected(keys), "stale")
        flips = []
        parts = [self.answers.join(stale, ["question", "subject"], "left_anti")]
        for name in self.questions:
            _, subject_type = self.questions[name]
            mine = stale.where(F.col("question") == F.lit(name)).select("subject")
            of_type = facts if subject_type is None else facts.where(F.col("entity_type") == F.lit(subject_type))
            fresh = of_type.select(F.col("entity_id").alias("subject")).distinct().join(self.answers.where(F.col("question") == F.lit(name)).select("subject"), "subject", "left_anti")
            again = mine.unionByName(fresh).distinct()
            # facts of the subjects to decide, and of the fixed entities that the rules name
            fixed = sorted({e for e, _ in B.attributes(self.questions[name][0], self.catalog) if e != B.SUBJECT})
            near = facts.join(again.select(F.col("subject").alias("entity_id")), "entity_id", "left_semi")
            near = near.unionByName(facts.where(F.col("entity_id").isin(*fixed)).join(again.select(F.col("subject").alias("entity_id")), "entity_id", "left_anti")) if fixed else near
            parts.append(self._prove(name, near, now).join(again, "subject", "left_semi").select(*self.answers.columns))
        before = self.answers.select("question", "subject", F.col("truth").alias("before"), F.lit(True).alias("known"))
        new = parts[0]
        for p in parts[1:]:
            new = new.unionByName(p)
        new = stage(new, "answers")
        flips = new.join(before, ["question", "subject"], "left").where("known is null or not (truth <=> before)")
        out = stage(flips.select("question", "subject", "before", F.col("truth").alias("after")), "flips")
        discard(self.answers, stale)
        self.answers = new
        return out
