"""Sort keys: one direction from `lt`, `rev` and `order`, and a total order on floats.

NaN sorts last in Spark already. -0.0 ties with 0.0, so floats get their sign as a second key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = "_key", "_sign"


@dataclass(frozen=True)
class Ordering:
    by: Callable[[Column], Column] | None = None
    descending: bool = False

    def keys(self, value: Column, kind: T.DataType) -> list[Column]:
        """Named key columns, computed once for each row."""
        key = self.by(value) if self.by else value
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return [key.alias(KEYS[0]), F.when((key == 0) & key.cast("string").startswith("-"), 0).otherwise(1).alias(KEYS[1])]
        return [key.alias(KEYS[0])]

    def sort(self, names: list[str]) -> list[Column]:
        return [F.col(n).desc() if self.descending else F.col(n).asc() for n in names]


def ordering(lt="<", by=None, rev: bool | None = None, order: str = "forward") -> Ordering:
    """`lt`: "<" or ">". Reversals by `lt`, `rev` and `order` cancel each other in pairs."""
    if lt not in ("<", ">", "isless"):
        raise ValueError("lt must be '<', '>' or a function of two Columns")
    if order not in ("forward", "reverse"):
        raise ValueError("order must be 'forward' or 'reverse'")
    return Ordering(by, (lt == ">") ^ bool(rev) ^ (order == "reverse"))


def comparison(lt: Callable[[Column, Column], Column], by=None, rev: bool | None = None, order: str = "forward") -> Callable[[Column, Column], Column]:
    """A comparison of one's own, reversed or not, of what `by` gives."""
    if order not in ("forward", "reverse"):
        raise ValueError("order must be 'forward' or 'reverse'")
    key = by or (lambda c: c)
    return (lambda a, b: lt(key(b), key(a))) if bool(rev) ^ (order == "reverse") else (lambda a, b: lt(key(a), key(b)))
