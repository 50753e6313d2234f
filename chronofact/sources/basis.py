"""Bitemporal visibility."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofact.errors import ReadError


def now_ms() -> int:
    return time.time_ns() // 1_000_000


@dataclass(frozen=True)
class Basis:
    """What is known at recorded_at (or recorded_position) and true at valid_at; both default to now."""

    recorded_at: int | None = None
    valid_at: int | None = None
    recorded_position: int | None = None

    def resolved(self) -> Basis:
        for t in (self.recorded_at, self.valid_at):
            if t is not None and (not math.isfinite(t) or t < 0):
                raise ReadError(f"not an instant: {t}")
        return self if self.valid_at is not None else replace(self, valid_at=now_ms())


def visible(basis: Basis) -> Column:
    """Half-open on both axes: what ends at t isn't visible at t."""
    if basis.recorded_position is not None:
        known = (F.col("recorded_position") <= basis.recorded_position) & (F.col("retracted_position").isNull() | (F.col("retracted_position") > basis.recorded_position))
    elif basis.recorded_at is not None:
        known = (F.col("recorded_at") <= basis.recorded_at) & (F.col("retracted_at").isNull() | (F.col("retracted_at") > basis.recorded_at))
    else:
        known = F.col("retracted_at").isNull()
    return known & (F.col("valid_from") <= basis.valid_at) & (F.col("valid_to").isNull() | (F.col("valid_to") > basis.valid_at))
