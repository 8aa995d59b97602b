"""Removing a card's edge and ranking again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.operators.votes import RANK, looked_up, top_cards, vote_histogram

VOTES = ("vote1", "vote2", "vote3", "vote4")


def remove_edges(cards: DataFrame, top: int = 10, edge: str = "hop1_edge_id") -> DataFrame:
    """``removed_edge, chain_id, rank_before, rank_after, shift``: for each edge of a top card, every top card's rank without it.

    A removal drops all chains that use the edge. It changes the rank sum of a card by the removed chains with lower
    votes only, so that one small histogram per edge is enough and the cards are neither multiplied nor joined: one
    aggregation counts, for each removal and top card, the cards that are better in that scenario. ``rank_after`` is null
    (OUT) for a chain that was dropped. At most ``top`` squared counts are kept.
    """
    spark = cards.sparkSession
    empty = "removed_edge string, chain_id string, rank_before int, rank_after long, shift long"
    best = top_cards(cards, top).select("rank", "chain_id", edge, *VOTES, *[k for k in RANK if k != "chain_id"]).collect()
    edges = sorted({r[edge] for r in best if r[edge] is not None})
    if not edges:
        return spark.createDataFrame([], empty)
    gone = vote_histogram(cards.where(F.col(edge).isin(edges)), VOTES, edge)

    def shrunk(e: str, v: str, value: int) -> int:
        """How many removed cards have a lower vote."""
        return sum(n for (f, w, x), n in gone.items() if f == e and w == v and x < value)

    def key(get) -> Column:
        return F.struct(*[(-get(k) if how == "desc" else get(k)).alias(k) for k, how in RANK.items()])

    counts = []
    seen = vote_histogram(cards, VOTES)
    for i, e in enumerate(edges):
        less = F.lit(0).cast("long")
        for v in VOTES:
            less = less + looked_up({x: shrunk(e, v, x) for (w, x) in seen if w == v}, v)
        mine = key(lambda k, less=less: F.col("borda") - less if k == "borda" else F.col(k))
        kept = F.col(edge).isNull() | (F.col(edge) != e)
        for t in best:
            if t[edge] != e:
                after = t.borda - sum(shrunk(e, v, t[v]) for v in VOTES)
                theirs = key(lambda k, t=t, after=after: F.lit(after if k == "borda" else t[k]))
                counts.append((i, t.chain_id, kept, mine, theirs))
    better = cards.agg(*[F.count_if(kept & (mine < theirs)).alias(f"n{j}") for j, (_, _, kept, mine, theirs) in enumerate(counts)]).first() if counts else ()
    out = {(i, c): better[j] + 1 for j, (i, c, *_) in enumerate(counts)}
    table = [(e, t.chain_id, t.rank, out.get((i, t.chain_id)), out[i, t.chain_id] - t.rank if (i, t.chain_id) in out else None) for i, e in enumerate(edges) for t in best]
    return spark.createDataFrame(table, empty)


def shift_summary(shifts: DataFrame) -> DataFrame:
    """Per chain: edges tested, how often it dropped out, greatest and median absolute shift."""
    return shifts.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("rank_after").isNull()).alias("n_out"), F.max(F.abs("shift")).alias("max_shift"), F.median(F.abs("shift")).alias("median_shift"))
