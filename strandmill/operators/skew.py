"""Aggregations and joins that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds at least this share of the rows; so at most 1 / HOT_SHARE keys of a field are.
HOT_SHARE = 0.01


def long_form(df: DataFrame, fields: Sequence[str], carry: Mapping[str, Column] | None = None) -> DataFrame:
    """One row for each row and field: ``field, key_value`` (text) and the carried expressions; one scan, no shuffle."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("key_value")) for f in fields])
    carried = {k: v for k, v in (carry or {}).items()}
    return df.select(pairs.alias("__pairs"), *[v.alias(k) for k, v in carried.items()]).select(F.explode("__pairs").alias("__p"), *carried).select("__p.field", "__p.key_value", *carried)


def per_key(df: DataFrame, fields: Sequence[str], measures: Mapping[str, Column] | None = None, distinct: Mapping[str, Column] | None = None) -> DataFrame:
    """Complete results per key of each field, without a task that sees all rows of a hot key.

    Every measure is an algebraic aggregate (count, sum, min, max, avg and the like): each partition folds its rows into
    a bounded hash table of partial states, spilled by sorting when it is full, and only those states are shuffled. A
    hot key so costs one state per partition. ``distinct`` measures count different values: they are aggregated first
    by (field, key, value), which spreads a hot key over all partitions, and then once more by key.

    Null keys are a group of their own; an empty table gives no groups; repeated rows count as often as they occur.
    Columns: ``field, key_value, n_rows``, then the measures, then the distinct counts (nulls are not values).
    """
    distinct = dict(distinct or {})
    measures = dict(measures or {})
    # expressions of the measures refer to the columns of df, so that df's columns are carried along under their names
    names = [c for c in df.columns if c not in ("field", "key_value")]
    base = long_form(df, fields, {c: F.col(f"`{c}`") for c in names})
    out = base.groupBy("field", "key_value").agg(F.count(F.lit(1)).alias("n_rows"), *[m.alias(k) for k, m in measures.items()])
    for name, value in distinct.items():
        states = base.select("field", "key_value", value.alias("__v")).groupBy("field", "key_value", "__v").agg(F.lit(1).alias("__one"))
        counts = states.groupBy(F.col("field").alias("__f"), F.col("key_value").alias("__k")).agg(F.count("__v").alias(name))
        out = out.join(counts, (F.col("field") == F.col("__f")) & F.col("key_value").eqNullSafe(F.col("__k")), "left").drop("__f", "__k")
    return out


def heavy_keys(df: DataFrame, fields: Sequence[str], percent: int) -> DataFrame:
    """``field, key_value, n_rows``: the non-null values holding at least ``percent`` % of all rows, nulls included in the total.

    At most 100 / percent rows per field. An empty table gives none.
    """
    counts = long_form(df, fields).groupBy("field", "key_value").agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.where(F.col("field") == fields[0]).agg(F.sum("n_rows").alias("__total"))
    return (
        counts.where(F.col("key_value").isNotNull())
        .crossJoin(F.broadcast(total))  # one row
        .where(F.col("n_rows") * 100 >= F.col("__total") * percent)
        .drop("__total")
    )


def hot_keys(df: DataFrame, key: Column, share: float = HOT_SHARE) -> list[str]:
    """The text values of ``key`` that hold at least ``share`` of the rows of ``df``: at most 1 / share of them."""
    counts = df.groupBy(key.cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    rows = counts.where("k is not null").crossJoin(F.broadcast(total)).where(F.col("n") >= F.greatest(F.col("t") * F.lit(share), F.lit(2))).select("k").collect()
    return sorted(r.k for r in rows)


def hot_fields(df: DataFrame, keys: Mapping[str, Column], share: float = HOT_SHARE) -> dict[str, list[str]]:
    """The hot values of several key expressions, counted in one pass: at most 1 / share of each."""
    pairs = F.array(*[F.struct(F.lit(k).alias("f"), v.cast("string").alias("k")) for k, v in keys.items()])
    counts = df.select(F.explode(pairs).alias("p")).groupBy("p.f", "p.k").agg(F.count(F.lit(1)).alias("n"))
    total = counts.where(F.col("f") == next(iter(keys))).agg(F.sum("n").alias("t"))
    out: dict[str, list[str]] = {k: [] for k in keys}
    for r in counts.where("k is not null").crossJoin(F.broadcast(total)).where(F.col("n") >= F.greatest(F.col("t") * F.lit(share), F.lit(2))).select("f", "k").collect():
        out[r.f].append(r.k)
    return {k: sorted(v) for k, v in out.items()}


def salted_join(left: DataFrame, right: DataFrame, on: str, how: str, spread: Column, salts: int = 16, share: float = HOT_SHARE, hot: list[str] | None = None, hint: str | None = "merge") -> DataFrame:
    """Equi-join of two tables on one text column, whose hot keys on the left are spread over ``salts`` tasks.

    Rows of a hot key get the salt ``hash(spread) % salts``; the right rows of that key are repeated once per salt. All
    other rows keep salt 0, so that nothing else is repeated. ``right`` should have few rows per key. ``hot`` may name
    the hot keys; else they are counted. Works for inner, left, left_semi and left_anti. Null keys match nothing.
    """
    if hot is None:
        hot = hot_keys(left, F.col(on), share)
    if not hot:
        return left.join(right.hint(hint) if hint else right, on, how)
    is_hot = F.col(on).isin(hot)
    a = left.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    b = right.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b.hint(hint) if hint else b, [on, "__salt"], how).drop("__salt")
