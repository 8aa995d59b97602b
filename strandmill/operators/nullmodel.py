"""Null models: permuted columns and degree-matched random chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions import stats
from strandmill.functions.ids import hash_number
from strandmill.gates import require_same_rows
from strandmill.operators.graph import drawn
from strandmill.operators.ranking import positions
from strandmill.session import settle


def permute(df: DataFrame, key: str, columns: Sequence[str], seed: int) -> DataFrame:
    """``df`` with some columns permuted together over its rows, by a hash of seed and key.

    Row i in the order of keys gets the columns of row i in the order of hashes; both orders are range-partitioned, so
    no task sees all rows. ``key`` must be unique. The multiset of the columns is the same as before.
    """
    place = positions(df.drop(*columns), [], [F.col(key).asc()])
    donors = positions(df.select(key, *columns).withColumn("__h", hash_number(seed, F.col(key))), [], [F.col("__h").asc(), F.col(key).asc()])
    return place.join(donors.select("pos", *columns), "pos").select(*df.columns)


def conserved(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> None:
    """Refuse unless the permuted columns hold the same multiset of values."""
    require_same_rows(before.select(*columns), after.select(*columns), f"permutation changed {list(columns)}")


def random_chains(chains: DataFrame, pool: DataFrame, seed: int, slots: Sequence[str]) -> DataFrame:
    """``chain_id, slot…, skipped``: each chain with every node replaced by another one of its category and degree bin, with replacement.

    If some position of a chain has no other candidate, the whole chain is skipped (1), and its nodes are null. Null
    positions beyond a chain's depth stay null.
    """
    long = chains.select("chain_id", F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).alias("id")) for s in slots])).alias("s")).select("chain_id", "s.slot", "s.id").where("id is not null")
    d = drawn(long, pool, seed, ("chain_id", "slot"))
    bad = d.groupBy("chain_id").agg(F.max(F.col("draw").isNull().cast("int")).alias("skipped"), *[F.max(F.when(F.col("slot") == s, F.col("draw"))).alias(s) for s in slots])
    return bad.select("chain_id", *[F.when(F.col("skipped") == 0, F.col(s)).alias(s) for s in slots], "skipped")


def draw_report(draws: DataFrame, slots: Sequence[str]) -> DataFrame:
    """One row: chains, skipped ones, draws kept, different nodes drawn."""
    nodes = draws.where("skipped = 0").select(F.explode(F.array(*slots)).alias("id")).where("id is not null")
    n = nodes.agg(F.count(F.lit(1)).alias("n_draws"), F.countDistinct("id").alias("n_nodes"))
    return draws.agg(F.count(F.lit(1)).alias("n_chains"), F.sum("skipped").alias("n_skipped")).crossJoin(n).withColumn("n_duplicate_draws", F.col("n_draws") - F.col("n_nodes"))


def paired_votes(real: DataFrame, null: DataFrame, votes: Sequence[str]) -> DataFrame:
    """One row per vote: mean over the real chains, over their random copies, and the share of copies that could be made.

    ``null`` has a row for each chain whose copy exists; the real means are taken over the same chains, and over all of
    them as well, so that a selection by skipping shows.
    """
    both = real.select("chain_id", *votes).join(null.select("chain_id", *[F.col(v).alias(f"null_{v}") for v in votes], F.lit(1).alias("made")), "chain_id", "left")
    rows = F.array(*[F.struct(F.lit(v).alias("vote"), F.col(v).cast("double").alias("x"), F.col(f"null_{v}").cast("double").alias("y")) for v in votes])
    each = both.select("made", F.explode(rows).alias("r")).select("made", "r.*")
    return each.groupBy("vote").agg(F.round(F.avg("x"), 6).alias("mean_all"), F.round(F.avg(F.when(F.col("made") == 1, F.col("x"))), 6).alias("mean_kept"), F.round(F.avg("y"), 6).alias("mean_null"), F.round(F.count("made") / F.count(F.lit(1)), 6).alias("made_share"))


def arm_row(arm: str, real: DataFrame, null: DataFrame) -> DataFrame:
    """One row for an arm of ``real`` and ``null`` votes: paired statistics of the totals with computable shares, signed-rank test, overlap, how skipped chains differ from kept ones, and the discriminator."""
    n = null.select("chain_id", F.col("votes_total").alias("y"), F.col("computable").alias("cy"))
    j = settle(real.select("chain_id", F.col("votes_total").alias("x"), F.col("computable").alias("cx")).join(n, "chain_id", "left"), "arm")
    kept = j.where("y is not null").withColumn("d", F.col("x") - F.col("y"))
    skipped = j.agg(F.count_if(F.col("y").isNull()).alias("n_skipped"), F.round(F.avg(F.when(F.col("y").isNotNull(), F.col("x"))), 6).alias("kept_mean"), F.round(F.avg(F.when(F.col("y").isNull(), F.col("x"))), 6).alias("skipped_mean"))
    shared = stats.overlap_coefficient(kept.select(F.col("x").alias("v")), kept.select(F.col("y").alias("v")), "v")
    test = stats.wilcoxon(kept).select("z", "p", "r")
    row = stats.paired_stats(kept, "x", "y", ("cx", "cy")).crossJoin(test).crossJoin(shared).crossJoin(skipped)  # one row each
    verdict = stats.discriminator(F.col("mean_diff"), F.col("p"), F.col("computable_ratio"), F.col("variance_ratio"))
    return row.select(F.lit(arm).alias("arm"), *row.columns, (F.col("skipped_mean") - F.col("kept_mean")).alias("selection_delta"), verdict.alias("verdict"))
