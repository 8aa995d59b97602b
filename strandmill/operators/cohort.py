"""Cohort measurements on chains: presence of the microbe, gene-level potential of the metabolite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.session import settle

RANKS = ("species", "genus")


def vector_stats(value: Column) -> list[Column]:
    """Median, detection rate and number of detections of a group's values, as aggregates; six digits."""
    return [F.round(F.median(value), 6).alias("median"), F.round(F.avg((value > 0).cast("double")), 6).alias("detection_rate"), F.sum((value > 0).cast("long")).alias("detections")]


def padded_stats(totals: DataFrame, keys: Sequence[str], samples: DataFrame) -> DataFrame:
    """Median, detection rate and detections of ``totals(keys, cohort, v)`` over all samples of the cohort; samples without a row count as 0.

    The missing zeros enter as one row with their number as its frequency, and the median is an aggregate with
    mergeable states, so that no group is gathered in one task. ``samples`` has ``cohort, n_samples``.
    """
    by = [*keys, "cohort"]
    known = totals.groupBy(*by).agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(samples), "cohort")
    zeros = known.select(*by, F.lit(0.0).alias("v"), (F.col("n_samples") - F.col("m")).alias("f")).where("f > 0")
    rows = totals.select(*by, F.col("v").cast("double").alias("v"), F.lit(1).cast("long").alias("f")).unionByName(zeros)
    out = rows.groupBy(*by).agg(F.round(F.expr("percentile(v, 0.5D, f)"), 6).alias("median"), F.sum(F.when(F.col("v") > 0, F.col("f")).otherwise(0)).alias("detections"), F.sum("f").alias("n"))
    return out.select(*by, "median", F.round(F.col("detections") / F.col("n"), 6).alias("detection_rate"), "detections")


def _samples(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("cohort").agg(F.countDistinct("sample").alias("n_samples"))


def feature_stats(matrix: DataFrame) -> DataFrame:
    """``cohort, feature`` with the statistics over the cohort's samples; ``matrix`` is long: cohort, feature, sample, value. Values are summed as exact decimals."""
    totals = matrix.groupBy("cohort", "feature", "sample").agg(F.sum(F.coalesce("value", F.lit(0.0)).cast("decimal(18,4)")).alias("v"))
    return padded_stats(totals, ["feature"], _samples(matrix))


def pick_bridge(bridge: DataFrame) -> DataFrame:
    """One bridge row per (source, taxid): species before genus before others, then the smaller feature."""
    order = F.when(F.col("rank_token") == RANKS[0], 0).when(F.col("rank_token") == RANKS[1], 1).otherwise(2)
    w = Window.partitionBy("source", "taxid").orderBy(order, "feature")
    return bridge.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def microbe_presence(taxa: DataFrame, bridge: DataFrame, stats: DataFrame, cohorts: Sequence[str]) -> DataFrame:
    """``taxid, cohort, status, median, detection_rate``: present, absent, or not_bridged, for each taxon and cohort."""
    grid = taxa.select("taxid").distinct().crossJoin(F.broadcast(taxa.sparkSession.createDataFrame([(c,) for c in cohorts], "cohort string")))
    b = pick_bridge(bridge).select(F.col("source").alias("cohort"), "taxid", "feature", "rank_token")
    j = grid.join(b, ["cohort", "taxid"], "left").join(stats, ["cohort", "feature"], "left")
    status = F.when(F.col("feature").isNull() | F.col("detections").isNull(), "not_bridged").when(F.col("detections") > 0, "present").otherwise("absent")
    return j.select("taxid", "cohort", status.alias("status"), "median", "detection_rate")


def potential(entities: DataFrame, mapping: DataFrame, matrix: DataFrame, cohorts: Sequence[str]) -> DataFrame:
    """``entity, cohort, n_mapped, label, median, detection_rate``: summed abundance of an entity's mapped features per sample.

    ``entities`` has ``entity, chebi ARRAY``; ``mapping`` has ``chebi, ko``. Labels in order: no_chebi, unmapped_chebi,
    measurable (some sample above 0), ko_absent. Sums are taken over exact decimals, so their order doesn't matter. A
    sample without any mapped feature counts as 0.
    """
    grid = entities.crossJoin(F.broadcast(entities.sparkSession.createDataFrame([(c,) for c in cohorts], "cohort string")))
    kos = entities.select("entity", F.explode("chebi").alias("chebi")).join(mapping, "chebi").select("entity", "ko").distinct()
    # many entities map to the same features: sums are made once per set of features
    sets = settle(kos.groupBy("entity").agg(F.array_sort(F.collect_list("ko")).alias("kos")).withColumn("ko_set", F.array_join("kos", "|")), "sets")
    members = sets.select("ko_set", "kos").distinct().select("ko_set", F.explode("kos").alias("ko"))
    m = matrix.select("cohort", F.col("feature").alias("ko"), "sample", F.col("value").cast("decimal(18,4)").alias("v")).groupBy("cohort", "ko", "sample").agg(F.sum("v").alias("v"))
    sums = members.join(m, "ko").groupBy("ko_set", "cohort", "sample").agg(F.sum("v").alias("v"))
    stats = padded_stats(sums, ["ko_set"], _samples(matrix))
    j = grid.join(sets.select("entity", "ko_set", F.size("kos").cast("long").alias("n_mapped")), "entity", "left").join(stats, ["ko_set", "cohort"], "left")
    label = F.when(F.size("chebi") <= 0, "no_chebi").when(F.col("n_mapped").isNull(), "unmapped_chebi").when(F.col("detections") > 0, "measurable").otherwise("ko_absent")
    return j.select("entity", "cohort", F.coalesce("n_mapped", F.lit(0)).alias("n_mapped"), label.alias("label"), "median", "detection_rate")


def annotate(chains: DataFrame, presence: DataFrame, potentials: DataFrame) -> DataFrame:
    """One row per chain and cohort: presence of its microbe and potential of its metabolite. Both lookups are per entity, so a hot metabolite is computed once."""
    p = presence.select(F.col("taxid"), "cohort", F.col("status").alias("microbe_status"), F.col("detection_rate").alias("microbe_rate"))
    k = potentials.select(F.col("entity").alias("metabolite_id"), F.col("cohort"), F.col("label").alias("ko_label"), "n_mapped")
    return chains.join(p, "taxid").join(k, ["metabolite_id", "cohort"])


def measurable_in_any(annotations: DataFrame, key: str = "chain_id") -> DataFrame:
    """``key, measurable``: 1 if the potential is measurable in some cohort."""
    return annotations.groupBy(key).agg(F.max((F.col("ko_label") == "measurable").cast("int")).alias("measurable"))


def reconcile_samples(tables: dict[str, DataFrame], anchor: int | None = None) -> DataFrame:
    """``a, b, only_a, only_b``: sample ids that one table of a cohort has and another lacks, for each pair of tables; all zero when they agree."""
    names = sorted(tables)
    spark = tables[names[0]].sparkSession
    out = None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = tables[a].select("sample").distinct(), tables[b].select("sample").distinct()
            row = x.withColumn("l", F.lit(1)).join(y.withColumn("r", F.lit(1)), "sample", "full").agg(F.count_if(F.col("r").isNull()).alias("only_a"), F.count_if(F.col("l").isNull()).alias("only_b"))
            row = row.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "only_a", "only_b")
            out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame([], "a string, b string, only_a long, only_b long")
