"""Transparent integer votes, stepwise verification, rank sums and cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions.ids import name_key
from strandmill.functions.stats import harmonic_score
from strandmill.gates import GateError
from strandmill.operators.skew import hot_fields, salted_join
from strandmill.session import settle

Hot = dict[str, list[str]]

COUNTED = ("confirm", "extend")
RANK = {"votes_total": "desc", "evidence_score": "desc", "borda": "desc", "verified_rate": "desc", "penalty": "asc", "chain_id": "asc"}

#: The order of a delivery pack: the same without the evidence score.
PACK = {k: v for k, v in RANK.items() if k != "evidence_score"}


def pair_key(a: Column, b: Column) -> Column:
    """One text for an undirected pair; null if a side is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("|", F.least(a, b), F.greatest(a, b)))


def hot_of(chains: DataFrame) -> Hot:
    """The hot values of all keys by which chains meet a lookup, counted in one pass."""
    c = F.col
    return hot_fields(chains, {"microbe_id": c("microbe_id"), "metabolite_id": c("metabolite_id"), "gene_key": name_key(c("gene_name")), "hop1_edge_id": c("hop1_edge_id"), "pair": pair_key(c("metabolite_id"), c("gene_id")), "gp": F.when(c("pathway").isNotNull(), F.concat_ws("|", "gene_id", "pathway"))})


def external_vote(chains: DataFrame, taxa: DataFrame, names: DataFrame, genera: DataFrame, hot: Hot | None = None) -> DataFrame:
    """``chain_id, vote1``: 1 if the microbe's taxon or name is in an external list, or its name starts with a listed genus and a blank.

    The prefix rule is an equality: every prefix of the name that ends before a blank is a key, so genera of several
    words match as well. A genus node takes no species finding. The lists meet the different microbes, not the chains.
    """
    hot = hot if hot is not None else hot_of(chains)
    hit = _external_hits(chains.select("microbe_id", "microbe_name", "taxid").distinct(), taxa, names, genera).withColumn("v", F.lit(1))
    return salted_join(chains.select("chain_id", "microbe_id"), hit, "microbe_id", "left", F.col("chain_id"), hot=hot["microbe_id"]).select("chain_id", F.coalesce("v", F.lit(0)).alias("vote1"))


def _external_hits(m: DataFrame, taxa: DataFrame, names: DataFrame, genera: DataFrame) -> DataFrame:
    """``microbe_id`` of the microbes that a list knows by taxon or name, or whose name begins with a listed genus and a blank."""
    low = name_key(F.col("microbe_name"))
    words = F.split(low, " ")
    prefixes = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, 1, i), " "))).otherwise(F.array().cast("array<string>"))
    by_genus = m.select("microbe_id", F.explode(prefixes).alias("g")).join(genera.select(name_key(F.col("name")).alias("g")).distinct(), "g", "left_semi").select("microbe_id")
    by_taxon = m.join(taxa.select("taxid").distinct(), "taxid", "left_semi").select("microbe_id")
    by_name = m.withColumn("k", low).join(names.select(name_key(F.col("name")).alias("k")).distinct(), "k", "left_semi").select("microbe_id")
    return by_genus.union(by_taxon).union(by_name).distinct()


def _strain_hits(m: DataFrame, taxa: DataFrame, names: DataFrame) -> DataFrame:
    """``microbe_id`` of the microbes of which a strain is listed by taxon or name."""
    by_name = m.withColumn("k", name_key(F.col("microbe_name"))).join(names.select(name_key(F.col("name")).alias("k")).distinct(), "k", "left_semi")
    return m.join(taxa.select("taxid").distinct(), "taxid", "left_semi").select("microbe_id").union(by_name.select("microbe_id")).distinct()


def record_counts(reconciled: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """How many counted records (confirm, extend) each anchored node has, and each name of a side that found no node."""
    r = reconciled.where(F.col("bucket").isin(*COUNTED) | F.lit(False))
    sides = r.select(F.explode(F.array(F.struct(F.col("node_a").alias("node"), F.col(a).alias("name")), F.struct(F.col("node_b").alias("node"), F.col(b).alias("name")))).alias("s")).select("s.*")
    by_node = sides.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    by_name = sides.where("node is null").groupBy(name_key(F.col("name")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return by_node, by_name


def evidence_vote(chains: DataFrame, by_node: DataFrame, by_name: DataFrame, second: DataFrame, hot: Hot | None = None) -> DataFrame:
    """``chain_id, n_first, n_second, vote3, evidence_score``: counted records of the microbe, the metabolite and the gene's name; and a second source by microbe.

    The counts are small lookups per entity; entities shared by many chains are spread over tasks.
    """
    hot = hot if hot is not None else hot_of(chains)
    m = by_node.select(F.col("node").alias("microbe_id"), F.col("n").alias("nm"))
    b = by_node.select(F.col("node").alias("metabolite_id"), F.col("n").alias("nb"))
    g = by_name.where("key is not null").select(F.col("key").alias("gene_key"), F.col("n").alias("ng"))
    s = second.select("microbe_id", F.col("n").alias("ns"))
    c = chains.select("chain_id", "microbe_id", "metabolite_id", name_key(F.col("gene_name")).alias("gene_key"))
    c = salted_join(c, m.join(s, "microbe_id", "full"), "microbe_id", "left", F.col("chain_id"), hot=hot["microbe_id"])
    c = salted_join(c, b, "metabolite_id", "left", F.col("chain_id"), hot=hot["metabolite_id"])
    c = salted_join(c, g, "gene_key", "left", F.col("chain_id"), hot=hot["gene_key"])
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    n1, n2 = zero("nm") + zero("nb") + zero("ng"), zero("ns")
    return c.select("chain_id", n1.alias("n_first"), n2.alias("n_second"), ((n1 > 0) | (n2 > 0)).cast("int").alias("vote3"), harmonic_score(n1, n2).alias("evidence_score"))


def strain_available(chains: DataFrame, taxa: DataFrame, names: DataFrame, hot: Hot | None = None) -> DataFrame:
    """``chain_id, strain``: 1 if a strain is listed by the microbe's taxon or name."""
    hot = hot if hot is not None else hot_of(chains)
    hit = _strain_hits(chains.select("microbe_id", "microbe_name", "taxid").distinct(), taxa, names).withColumn("v", F.lit(1))
    return salted_join(chains.select("chain_id", "microbe_id"), hit, "microbe_id", "left", F.col("chain_id"), hot=hot["microbe_id"]).select("chain_id", F.coalesce("v", F.lit(0)).alias("strain"))


def verify_steps(chains: DataFrame, edges: DataFrame, pairs: DataFrame, snapshot: DataFrame, hot: Hot | None = None, keep: Sequence[str] = ("chain_id",)) -> DataFrame:
    """``keep``, then ``step1..3, verified, total, verified_rate, step2_support``: each hop looked up again.

    Step 1: the edge exists and has the chain's ends. Step 2: some edge links metabolite and gene in either direction,
    supported by the smallest edge id; else the curated rows alone (0). Step 3: the (gene, pathway) is in the snapshot.
    """
    hot = hot if hot is not None else hot_of(chains)
    e = edges.select(F.col("edge_id").alias("hop1_edge_id"), F.col("subject").alias("es"), F.col("object").alias("eo"))
    c = salted_join(chains, e, "hop1_edge_id", "left", F.col("chain_id"), hot=hot["hop1_edge_id"])
    p = pairs.where("subject is not null and object is not null").select(F.concat_ws("|", F.least("subject", "object"), F.greatest("subject", "object")).alias("pair"), "edge_id").groupBy("pair").agg(F.min("edge_id").alias("support"))
    c = salted_join(c.withColumn("pair", pair_key(F.col("metabolite_id"), F.col("gene_id"))), p, "pair", "left", F.col("chain_id"), hot=hot["pair"])
    s = snapshot.select(F.concat_ws("|", "gene", "pathway").alias("gp"), F.lit(1).alias("snap")).distinct()
    c = salted_join(c.withColumn("gp", F.when(F.col("pathway").isNotNull(), F.concat_ws("|", "gene_id", "pathway"))), s, "gp", "left", F.col("chain_id"), hot=hot["gp"])
    one = F.coalesce((F.col("es") == F.col("microbe_id")) & (F.col("eo") == F.col("metabolite_id")), F.lit(False)).cast("int")
    two = F.col("support").isNotNull().cast("int")
    three = F.coalesce("snap", F.lit(0))
    verified = one + two + three
    support = F.when(F.col("gene_id").isNull(), "").when(F.col("support").isNotNull(), F.concat(F.lit("subgraph_edge:"), "support")).otherwise(F.concat(F.lit("curated_only:"), F.col("refs")))
    return c.select(*keep, one.alias("step1"), two.alias("step2"), three.alias("step3"), verified.alias("verified"), F.col("depth").alias("total"), F.round(verified / F.col("depth"), 6).alias("verified_rate"), support.alias("step2_support"))


#: Different values of one vote at most; votes are small integers, and their histogram goes through the driver.
VALUES = 10_000


def vote_histogram(cards: DataFrame, votes: Sequence[str], by: str | None = None) -> dict[tuple, int]:
    """``(vote, value)`` or ``(by, vote, value)`` -> number of cards, in one aggregation; refused if a vote takes more than ``VALUES`` values."""
    keys = [by] if by else []
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("vote"), F.col(v).cast("long").alias("value")) for v in votes])).alias("x")
    rows = cards.select(*keys, each).groupBy(*keys, "x.vote", "x.value").agg(F.count(F.lit(1)).alias("n")).limit(VALUES * len(votes) + 1).collect()
    if len(rows) > VALUES * len(votes):
        raise GateError(f"votes {list(votes)} take more than {VALUES} values")
    return {tuple(r)[:-1]: r.n for r in rows}


def lower_counts(histogram: dict[tuple, int], vote: str) -> dict[int, int]:
    """For each value of a vote, how many cards have a lower one."""
    own = sorted((value, n) for (v, value), n in histogram.items() if v == vote)
    out, below = {}, 0
    for value, n in own:
        out[value], below = below, below + n
    return out


def looked_up(table: dict[int, int], column: str) -> Column:
    """The entry of a small table of the driver for a column's value; 0 for a value it lacks."""
    if not table:
        return F.lit(0).cast("long")
    pairs = [x for k, v in sorted(table.items()) for x in (F.lit(int(k)).cast("long"), F.lit(int(v)).cast("long"))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(column).cast("long")), F.lit(0).cast("long"))


def borda(cards: DataFrame, votes: Sequence[str]) -> DataFrame:
    """The cards with ``borda``: over all votes, how many cards have a strictly lower value.

    One histogram of all votes gives a small table, which is applied in place: no join and no order of the cards.
    """
    h = vote_histogram(cards, votes)
    total = F.lit(0).cast("long")
    for v in votes:
        total = total + looked_up(lower_counts(h, v), v)
    return cards.withColumn("borda", total)


def rank_order(order: dict[str, str] | None = None) -> list[Column]:
    """The total order of cards; its last key is unique."""
    return [F.desc(k) if how == "desc" else F.asc(k) for k, how in (order or RANK).items()]


def top_cards(cards: DataFrame, n: int = 10, order: dict[str, str] | None = None) -> DataFrame:
    """The n best cards with their rank."""
    best = cards.orderBy(*rank_order(order)).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order(order))))


def microbe_facts(microbes: DataFrame, taxa: DataFrame, names: DataFrame, genera: DataFrame, strain_taxa: DataFrame, strain_names: DataFrame, by_node: DataFrame, second: DataFrame) -> DataFrame:
    """``microbe_id, v1, strain, nm, ns`` of ``microbes(microbe_id, microbe_name, taxid)``: one row for each microbe with all that its chains take from it."""
    m = microbes.select("microbe_id", "microbe_name", "taxid").where("microbe_id is not null").distinct()
    v1 = _external_hits(m, taxa, names, genera).withColumn("v1", F.lit(1))
    st = _strain_hits(m, strain_taxa, strain_names).withColumn("strain", F.lit(1))
    ids = m.select("microbe_id").distinct()
    counts = by_node.select(F.col("node").alias("microbe_id"), F.col("n").alias("nm")).join(second.select("microbe_id", F.col("n").alias("ns")), "microbe_id", "full")
    return ids.join(v1, "microbe_id", "left").join(st, "microbe_id", "left").join(counts, "microbe_id", "left")


def score(chains: DataFrame, microbes: DataFrame, metabolites: DataFrame, genes: DataFrame, hot: Hot | None = None) -> DataFrame:
    """The chains with their four votes, total and evidence score, in one pass of look-ups by entity.

    ``microbes`` has ``microbe_id, v1, strain, nm, ns``, ``metabolites`` has ``metabolite_id, nb, measurable, computable``,
    ``genes`` has ``gene_key, ng``: one row per entity, so that a hot entity's rows are spread and nothing is joined by
    chain. Vote 2 is the depth; vote 4 is measurable plus strain available; ``computable`` counts votes 2 and 4.
    """
    hot = hot if hot is not None else hot_fields(chains, {"microbe_id": F.col("microbe_id"), "metabolite_id": F.col("metabolite_id"), "gene_key": name_key(F.col("gene_name"))})
    c = chains.withColumn("gene_key", name_key(F.col("gene_name")))
    c = salted_join(c, microbes, "microbe_id", "left", F.col("chain_id"), hot=hot["microbe_id"], hint=None)
    c = salted_join(c, metabolites, "metabolite_id", "left", F.col("chain_id"), hot=hot["metabolite_id"], hint=None)
    c = salted_join(c, genes, "gene_key", "left", F.col("chain_id"), hot=hot["gene_key"], hint=None)
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    n1, n2 = zero("nm") + zero("nb") + zero("ng"), zero("ns")
    c = c.withColumn("n_first", n1).withColumn("n_second", n2).withColumn("vote1", zero("v1")).withColumn("vote2", F.col("depth")).withColumn("vote3", ((n1 > 0) | (n2 > 0)).cast("int")).withColumn("evidence_score", harmonic_score(n1, n2))
    c = c.withColumn("measurable", zero("measurable")).withColumn("strain", zero("strain")).withColumn("vote4", F.col("measurable") + F.col("strain")).withColumn("computable", zero("computable") + 1)
    return c.withColumn("votes_total", F.col("vote1") + F.col("vote2") + F.col("vote3") + F.col("vote4")).drop("gene_key", "nm", "nb", "ng", "ns", "v1")


def assemble_cards(scored: DataFrame) -> DataFrame:
    """One card per scored and verified chain, with the rank sum over the four votes."""
    keep = ["chain_id", "microbe_id", "microbe_name", "taxid", "metabolite_id", "gene_id", "gene_name", "pathway", "hop1_edge_id", "depth", "penalty", "vote1", "vote2", "vote3", "vote4", "n_first", "n_second", "measurable", "strain", "computable", "evidence_score", "votes_total"]
    return borda(settle(scored.select(*keep, "step1", "step2", "step3", "verified", "total", "verified_rate"), "cards"), ("vote1", "vote2", "vote3", "vote4"))
