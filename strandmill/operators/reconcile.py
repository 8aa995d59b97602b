"""Reconciling curated records with the graph, repairing contradictions, merging increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.ids import local_id, name_key

PRODUCTION = ("produces", "biotransforms")
OPPOSED = ("consumes",)
POLES = ("aggravates", "alleviates")


def is_opposed(predicate: Column, polarity: Column) -> Column:
    """Whether an edge speaks against a link: it consumes, or its polarity is negative."""
    return F.coalesce(predicate.isin(*OPPOSED), F.lit(False)) | F.coalesce(F.lower(polarity) == "negative", F.lit(False))


def match_curated(records: DataFrame, names: DataFrame, a: str, b: str) -> DataFrame:
    """The records with ``node_a, node_b, match_status`` (both, a_side, b_side, none) by name keys; nothing is dropped."""
    left = names.select(F.col("key").alias("ka"), F.col("node_id").alias("node_a"))
    right = names.select(F.col("key").alias("kb"), F.col("node_id").alias("node_b"))
    out = records.withColumn("ka", name_key(F.col(a))).withColumn("kb", name_key(F.col(b))).join(left, "ka", "left").join(right, "kb", "left").drop("ka", "kb")
    return out.withColumn("match_status", F.when(F.col("node_a").isNotNull() & F.col("node_b").isNotNull(), "both").when(F.col("node_a").isNotNull(), "a_side").when(F.col("node_b").isNotNull(), "b_side").otherwise("none"))


def pair_evidence(edges: DataFrame) -> DataFrame:
    """One row per undirected pair: its edge ids and predicates, how many edges and how many opposed ones."""
    e = edges.where("subject is not null and object is not null").select(F.least("subject", "object").alias("p"), F.greatest("subject", "object").alias("q"), "edge_id", "predicate", is_opposed(F.col("predicate"), F.col("polarity")).alias("opposed"))
    return e.groupBy("p", "q").agg(
        F.array_join(F.array_sort(F.collect_set("edge_id")), ";").alias("edge_ids"), F.array_join(F.array_sort(F.collect_set("predicate")), ";").alias("predicates"),
        F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("opposed").cast("long")).alias("n_opposed"), F.max(F.col("predicate").isin(*PRODUCTION).cast("int")).alias("produces"))


def three_buckets(matched: DataFrame, edges: DataFrame) -> DataFrame:
    """Each matched record in the first bucket that holds: unmatched, conflict, confirm, extend; with its verdict.

    Conflict: some linking edge is opposed (``all_opposed`` or ``mixed_opposed``). Confirm: some edge links the pair, in
    either direction (``production_agree`` or ``non_directional``). Extend: both sides are nodes without a link.
    """
    joined = matched.withColumn("p", F.least("node_a", "node_b")).withColumn("q", F.greatest("node_a", "node_b")).join(pair_evidence(edges), ["p", "q"], "left")
    bucket = (
        F.when(F.col("match_status") != "both", "unmatched").when(F.col("n_opposed") > 0, "conflict").when(F.col("n_edges") > 0, "confirm").otherwise("extend")
    )
    verdict = (
        F.when(F.col("match_status") != "both", F.lit(""))
        .when(F.col("n_opposed") > 0, F.when(F.col("n_opposed") == F.col("n_edges"), "all_opposed").otherwise("mixed_opposed"))
        .when(F.col("n_edges") > 0, F.when(F.col("produces") == 1, "production_agree").otherwise("non_directional"))
        .otherwise("")
    )
    linked = F.col("match_status") == "both"
    return joined.withColumn("bucket", bucket).withColumn("verdict", verdict).withColumn("edge_ids", F.when(linked, F.coalesce("edge_ids", F.lit(""))).otherwise("")).withColumn("predicates", F.when(linked, F.coalesce("predicates", F.lit(""))).otherwise("")).drop("p", "q", "n_edges", "n_opposed", "produces")


def bucket_counts(reconciled: DataFrame) -> DataFrame:
    """``bucket, verdict, n`` in one pass over three grains (bucket; bucket and verdict; all): a null is "any"."""
    return reconciled.groupingSets([["bucket"], ["bucket", "verdict"], []], "bucket", "verdict").agg(F.count(F.lit(1)).alias("n"))


MICROBES = ("Species", "Microbe")


def disease_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edge_id, microbe_taxid, disease_mesh``: the edges between a microbe and a disease with a valid accession, in either direction.

    Both are named by what follows the first colon, so that prefixes don't part a pair.
    """
    kind = nodes.where(F.col("category").isin(*MICROBES, "Disease")).select("id", "category")
    e = edges.select("edge_id", "subject", "object").join(kind.select(F.col("id").alias("subject"), F.col("category").alias("cs")), "subject").join(kind.select(F.col("id").alias("object"), F.col("category").alias("co")), "object")
    from_subject = F.col("cs").isin(*MICROBES)
    ok = (from_subject & (F.col("co") == "Disease")) | (F.col("co").isin(*MICROBES) & (F.col("cs") == "Disease"))
    e = e.where(ok).select("edge_id", local_id(F.when(from_subject, F.col("subject")).otherwise(F.col("object"))).alias("microbe_taxid"), F.upper(local_id(F.when(from_subject, F.col("object")).otherwise(F.col("subject")))).alias("disease_mesh"))
    return e.where(F.col("disease_mesh").rlike("^[DC][0-9]{6,}$"))


def conflict_ledger(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per microbe and disease with both polar predicates: distinct numeric PubMed ids per side, winner, action, how many edges change.

    More ids win; the loser's edges become ``affects``. A tie makes both sides ``affects``.
    """
    e = edges.where(F.col("predicate").isin(*POLES)).select("edge_id", "predicate", F.explode_outer("pmids").alias("pmid")).join(disease_pairs(edges, nodes), "edge_id")
    ids = lambda p: F.countDistinct(F.when((F.col("predicate") == p) & F.col("pmid").rlike("^[0-9]+$"), F.col("pmid")))
    own = lambda p: F.countDistinct(F.when(F.col("predicate") == p, F.col("edge_id")))
    sides = e.groupBy("microbe_taxid", "disease_mesh").agg(ids(POLES[0]).alias("pmid_aggravates"), ids(POLES[1]).alias("pmid_alleviates"), own(POLES[0]).alias("ea"), own(POLES[1]).alias("el")).where("ea > 0 and el > 0")
    winner = F.when(F.col("pmid_aggravates") > F.col("pmid_alleviates"), POLES[0]).when(F.col("pmid_aggravates") < F.col("pmid_alleviates"), POLES[1]).otherwise("unresolved_tie")
    changed = F.when(winner == POLES[0], F.col("el")).when(winner == POLES[1], F.col("ea")).otherwise(F.col("ea") + F.col("el"))
    return sides.select("microbe_taxid", "disease_mesh", "pmid_aggravates", "pmid_alleviates", winner.alias("winner"), F.when(winner == "unresolved_tie", "tie_both_neutral").otherwise("loser_relabel").alias("action"), changed.alias("edges_relabeled"))


def repaired(edges: DataFrame, nodes: DataFrame, ledger: DataFrame) -> DataFrame:
    """The edges with the ledger applied: as many rows as before, losing polar predicates as ``affects``."""
    won = disease_pairs(edges, nodes).join(ledger.select("microbe_taxid", "disease_mesh", "winner"), ["microbe_taxid", "disease_mesh"]).select("edge_id", "winner").distinct()
    lost = F.col("predicate").isin(*POLES) & F.col("winner").isNotNull() & (F.col("predicate") != F.col("winner"))
    return edges.join(won, "edge_id", "left").withColumn("predicate", F.when(lost, "affects").otherwise(F.col("predicate"))).drop("winner")


def increment_triples(assertions: DataFrame) -> DataFrame:
    """Accepted new assertions by triple: united ids, support, greatest confidence, majority polarity (positive from a half on)."""
    positive = F.avg((F.col("polarity") == "positive").cast("double"))
    return assertions.where("status = 'ok'").groupBy("subject", "predicate", "object").agg(
        F.array_sort(F.collect_set("pmid")).alias("new_pmids"), F.count(F.lit(1)).alias("new_support"), F.max("confidence").alias("new_confidence"), F.when(F.coalesce(positive, F.lit(0.0)) >= 0.5, "positive").otherwise("negative").alias("new_polarity"))


def upsert(edges: DataFrame, triples: DataFrame) -> DataFrame:
    """``subject, predicate, object, pmids, support, confidence, polarity, origin``: known triples gain the new evidence, new ones are added.

    A full outer join on the triple, so that neither side loses a row; of several edges with one triple each gains it.
    """
    e = edges.select("subject", "predicate", "object", "pmids", F.coalesce("support_count", F.lit(0)).alias("support_count"), "confidence", "polarity", F.lit(1).alias("old"))
    j = e.join(triples, ["subject", "predicate", "object"], "full")
    none = F.array().cast("array<string>")
    return j.select(
        "subject", "predicate", "object", F.array_sort(F.array_union(F.coalesce("pmids", none), F.coalesce("new_pmids", none))).alias("pmids"),
        (F.coalesce("support_count", F.lit(0)) + F.coalesce("new_support", F.lit(0))).alias("support"), F.greatest("confidence", "new_confidence").alias("confidence"), F.coalesce("polarity", "new_polarity").alias("polarity"),
        F.when(F.col("old").isNull(), "tier2_increment").when(F.col("new_support").isNotNull(), "appended").otherwise("kept").alias("origin"))


def closure(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, name, category, origin``: every end of an edge as a node; one without a node row is constructed."""
    ends = edges.select(F.col("subject").alias("id")).union(edges.select("object")).where("id is not null").distinct()
    j = ends.join(nodes.select("id", "name", "category"), "id", "left")
    return j.select("id", F.coalesce("name", "id").alias("name"), "category", F.when(F.col("name").isNull() & F.col("category").isNull(), "constructed").otherwise("main").alias("origin"))


def literature_difference(found: DataFrame, library: DataFrame, key: str = "pmid") -> DataFrame:
    """``pmid, status``: ids found that the library lacks (new) or has (overlap), each once."""
    mine = found.select(key).where(F.col(key).isNotNull()).distinct()
    held = library.select(key).where(F.col(key).isNotNull()).distinct().withColumn("held", F.lit(1))
    return mine.join(held, key, "left").select(key, F.when(F.col("held").isNull(), "new").otherwise("overlap").alias("status"))
