"""References to records that do not exist: missing, not yet there (late), or withdrawn (deleted)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.operators.skew import HOT_SHARE

PLACEHOLDERS = ("", "-", "NA")
FIRST, LAST = "0001-01-01 00:00:00", "9999-12-31 00:00:00"
#: Slices of time into which the rows of a hot key are cut.
SLICES = 8


def reference_key(c: Column) -> Column:
    """A reference in the form in which it is compared: no surrounding white space, the prefix before the first colon in lower case; null for null, empty and placeholder texts."""
    t = F.regexp_replace(c.cast("string"), r"(?U)^[\s\x{feff}]+|[\s\x{feff}]+$", "")
    colon = F.instr(t, ":")
    key = F.when(colon > 0, F.concat(F.lower(F.substring_index(t, ":", 1)), t.substr(colon, F.length(t)))).otherwise(t)
    return F.when(t.isin(*PLACEHOLDERS), None).otherwise(key)


def _moment(text: str) -> Column:
    return F.lit(text).cast("timestamp")


@dataclass(frozen=True)
class Source:
    """A table that refers: ``fields`` maps each referring column to the name of its target table."""

    name: str
    table: DataFrame
    row_key: str
    at: str
    fields: dict[str, str]


@dataclass(frozen=True)
class Target:
    """A table that is referred to. ``removed`` may be None where rows are never withdrawn."""

    name: str
    table: DataFrame
    key: str
    added: str
    removed: str | None = None


def references(sources: Sequence[Source]) -> DataFrame:
    """``tbl, field, row_key, at, target, key``: one row for each reference; null, empty and placeholder ones are left out."""
    parts = []
    for s in sources:
        each = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("target"), reference_key(F.col(f"`{f}`")).alias("key")) for f, t in s.fields.items()])
        rows = s.table.select(F.col(s.row_key).cast("string").alias("row_key"), F.col(s.at).cast("timestamp").alias("at"), F.explode(each).alias("r"))
        parts.append(rows.select(F.lit(s.name).alias("tbl"), "r.field", "row_key", "at", F.concat_ws("|", "r.target", "r.key").alias("target_key"), F.col("r.key").alias("key")).where(F.col("key").isNotNull()).drop("key"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def starts(targets: Sequence[Target]) -> DataFrame:
    """``target_key, t, reach``: for each time at which a key's rows begin, how far the furthest of them reaches.

    A null start is the beginning of time, a null end its end. Rows of a key that begin together are one here.
    """
    parts = []
    for t in targets:
        removed = F.col(t.removed) if t.removed else F.lit(None)
        key = reference_key(F.col(t.key))
        rows = t.table.select(key.alias("k"), F.coalesce(F.col(t.added).cast("timestamp"), _moment(FIRST)).alias("t"), F.coalesce(removed.cast("timestamp"), _moment(LAST)).alias("reach")).where(F.col("k").isNotNull())
        parts.append(rows.select(F.concat_ws("|", F.lit(t.name), "k").alias("target_key"), "t", "reach"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("target_key", "t").agg(F.max("reach").alias("reach"))


def _sliced(refs: DataFrame, spans: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    """Both streams with a ``slot``: keys that hold 1 % of either stream are cut into slices of time, and their references spread within a slice.

    A slice begins with one row that tells how far the starts before it reach; these come from one maximum per key and
    slice, so that no task sees all rows of a hot key, whether they are references or parents.
    """
    both = refs.select(F.lit(0).alias("side"), "target_key", F.col("at").alias("t")).unionByName(spans.select(F.lit(1).alias("side"), "target_key", "t"))
    counts = both.groupBy("side", "target_key").agg(F.count(F.lit(1)).alias("n"), F.min("t").cast("double").alias("lo"), F.max("t").cast("double").alias("hi"))
    total = counts.groupBy("side").agg(F.sum("n").alias("all"))
    many = counts.join(F.broadcast(total), "side").where(F.col("n") >= F.greatest(F.col("all") * HOT_SHARE, F.lit(2))).collect()  # 1 / HOT_SHARE keys of each side at most
    if not many:
        return refs.withColumn("slot", F.lit(0)), spans.withColumn("slot", F.lit(0))
    is_hot = F.col("target_key").isin(sorted({r.target_key for r in many}))
    lo, hi = min((r.lo for r in many if r.side == 0 and r.lo is not None), default=0.0), max((r.hi for r in many if r.side == 0 and r.hi is not None), default=0.0)
    cuts = [lo + (hi - lo) * i / SLICES for i in range(1, SLICES)] if hi > lo else []

    def of(t: Column) -> Column:
        """The number of cuts at or before a time; nulls come first."""
        return F.aggregate(F.array(*[F.lit(float(c)) for c in cuts]), F.lit(0), lambda n, c: n + F.coalesce(t.cast("double") >= c, F.lit(False)).cast("int")) if cuts else F.lit(0)

    spread = F.pmod(F.xxhash64("row_key"), F.lit(salts)).cast("int")
    r = refs.withColumn("slot", F.when(is_hot, of(F.col("at")) * salts + spread).otherwise(0))
    each = spans.where(is_hot).withColumn("slice", of(F.col("t")))
    most = each.groupBy("target_key", "slice").agg(F.max("reach").alias("m"))
    grid = most.groupBy("target_key").agg(F.collect_list(F.struct("slice", "m")).alias("ms")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))))  # SLICES entries at most
    carried = grid.select("target_key", _moment(FIRST).alias("t"), F.array_max(F.transform(F.filter("ms", lambda x: x["slice"] < F.col("slice")), lambda x: x["m"])).alias("reach"), "slice")
    copies = F.explode(F.sequence(F.col("slice") * salts, F.col("slice") * salts + salts - 1)).alias("slot")
    hot_spans = each.select("target_key", "t", "reach", "slice").unionByName(carried).select("target_key", "t", "reach", copies)
    return r, spans.where(~is_hot).withColumn("slot", F.lit(0)).unionByName(hot_spans)


def broken_references(sources: Sequence[Source], targets: Sequence[Target], salts: int = 16) -> DataFrame:
    """``tbl, field, row_key, ref_period, reason``: each broken reference once.

    References and the starts of parents are partitioned alike by key, sorted by time, and merged in one linear pass that
    carries how far the parent rows seen so far reach: the running maximum of their ends. A key with several rows is
    there wherever one of them is, so that a parent removed and added again leaves a gap in between.
    ``missing``: no target row has the key. ``late``: every row of it starts after the referring time. ``deleted``: some
    started before, and all of those had ended at or before that time. A null start counts as "always there", a null
    end as "still there". Without a referring time only ``missing`` can be told, and ``ref_period`` is null. Repeated
    rows give one row. Empty tables: no references means no rows, no targets means that all are missing.
    """
    refs, spans = _sliced(references(sources), starts(targets), salts)
    none = F.lit(None).cast("string")
    parents = spans.select("target_key", "slot", "t", F.lit(0).alias("kind"), "reach", none.alias("tbl"), none.alias("field"), none.alias("row_key"))
    asked = refs.select("target_key", "slot", F.col("at").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("timestamp").alias("reach"), "tbl", "field", "row_key")
    group = Window.partitionBy("target_key", "slot")
    merged = (
        parents.unionByName(asked)
        .withColumn("upto", F.max("reach").over(group.orderBy(F.col("t").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("known", F.min("kind").over(group))
        .where("kind = 1")
    )
    at = F.col("t")
    reason = F.when(F.col("known") == 1, "missing").when(at.isNotNull() & F.col("upto").isNull(), "late").when(F.col("upto") <= at, "deleted")
    out = merged.select("tbl", "field", "row_key", F.date_format("t", "yyyy-MM").alias("ref_period"), reason.alias("reason"))
    return out.where(F.col("reason").isNotNull()).distinct()


def broken_report(sources: Sequence[Source], targets: Sequence[Target]) -> DataFrame:
    """``tbl, field, ref_period, reason, n``: the broken references counted per table, field and month."""
    return broken_references(sources, targets).groupBy("tbl", "field", "ref_period", "reason").agg(F.count(F.lit(1)).alias("n"))
