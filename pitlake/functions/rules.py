"""Ordered checks as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reasons(*checks: tuple[str, Column]) -> Column:
    """The codes of all checks that hold, in their order; a check that is null doesn't hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in checks]))


def first_reason(*checks: tuple[str, Column]) -> Column:
    """The code of the first check that holds, else null: the order is the meaning."""
    out = F.lit(None).cast("string")
    for code, c in reversed(checks):
        out = F.when(c, F.lit(code)).otherwise(out)
    return out
