"""Fail-closed checks: each raises before anything is written."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GateError(RuntimeError):
    """A precondition of an operator does not hold."""


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """``df`` itself, if it has the columns; extra columns are allowed."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise GateError(f"{what}: missing columns {missing}")
    return df


def require_empty(df: DataFrame, what: str, show: int = 5) -> None:
    """Raise, quoting a few rows, unless ``df`` has no rows."""
    if bad := df.limit(show).collect():
        raise GateError(f"{what}: {[r.asDict() for r in bad]}")


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> None:
    """Raise if a key occurs twice; null keys count as one key."""
    require_empty(df.groupBy(*keys).count().where("count > 1"), f"{what}: duplicate {list(keys)}")


def require_subset(child: DataFrame, parent: DataFrame, keys: Sequence[str], what: str) -> None:
    """Raise if a key combination of ``child`` is absent from ``parent``."""
    left = child.select(*keys).distinct()
    require_empty(left.join(parent.select(*keys).distinct(), list(keys), "left_anti"), what)


def require_same_rows(a: DataFrame, b: DataFrame, what: str) -> None:
    """Raise unless both tables hold the same multiset of rows."""
    columns = a.columns
    require_empty(a.exceptAll(b.select(*columns)).unionByName(b.select(*columns).exceptAll(a)), what)


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """SHA-256 over row count and two sums of 64-bit row hashes: independent of row order and partitions.

    Null differs from empty text. An empty table has a fingerprint of its own schema.
    """
    cols = list(columns or sorted(df.columns))
    row = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`").alias("v")), {"ignoreNullFields": "false"}) for c in cols])
    lo, hi = F.pmod(row, F.lit(1 << 31)), F.shiftrightunsigned(row, 33)
    n, a, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(lo), F.lit(0)), F.coalesce(F.sum(hi), F.lit(0))).first()
    return hashlib.sha256(f"{cols}|{n}|{a}|{b}".encode()).hexdigest()
