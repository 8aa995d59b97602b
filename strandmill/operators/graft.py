"""Grafting a gene layer onto the graph, and how much of the chains a graph covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.ids import content_id, name_key
from strandmill.gates import require_empty


def gene_edges(curated: DataFrame, metabolites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, skipped): one edge per metabolite and gene of the curated rows, by exact lower-case name (no aliases); rows without a metabolite node come out apart."""
    m = metabolites.select(F.col("id").alias("subject"), name_key(F.col("name")).alias("k")).where("k is not null")
    r = curated.withColumn("k", name_key(F.col("metabolite")))
    hit = r.where("gene is not null and gene <> ''").join(m.groupBy("k").agg(F.min("subject").alias("subject")), "k")
    e = hit.groupBy("subject", "gene").agg(F.array_join(F.array_sort(F.collect_set("pmid")), ";").alias("pmids"), F.count(F.lit(1)).alias("support"))
    e = e.withColumn("object", F.concat(F.lit("GENE:"), "gene"))
    edges = e.select(content_id("GE-", F.col("subject"), F.lit("modulates_host_gene"), F.col("object"), F.col("pmids"), F.lit("graft")).alias("edge_id"), "subject", F.lit("modulates_host_gene").alias("predicate"), "object", "pmids", "support")
    return edges, r.join(m, "k", "left_anti").select("row_index", "metabolite", "gene")


def gene_layer(curated: DataFrame, metabolites: DataFrame) -> DataFrame:
    """``subject, object``: the edges between metabolites and the gene nodes that curated rows name by number, by exact lower-case name."""
    m = metabolites.select(F.col("id").alias("subject"), name_key(F.col("name")).alias("k")).where("k is not null").groupBy("k").agg(F.min("subject").alias("subject"))
    r = curated.where("gene_id is not null").select(name_key(F.col("metabolite")).alias("k"), F.concat(F.lit("NCBIGENE:"), "gene_id").alias("object"))
    return r.join(m, "k").select("subject", "object").distinct()


def graft(base: DataFrame, new: DataFrame) -> DataFrame:
    """The base edges as they are, then the new ones, with ``origin``; refused if a new edge id is already there."""
    require_empty(new.select("edge_id").join(base.select("edge_id"), "edge_id", "left_semi"), "edge ids of the graft collide with the base")
    return base.withColumn("origin", F.lit("base")).unionByName(new.withColumn("origin", F.lit("graft")), allowMissingColumns=True)


def chain_coverage(chains: DataFrame, edges: DataFrame) -> DataFrame:
    """``hop, pairs, present, share``: the different pairs of each hop that are edges of the graph in either direction."""
    hop = lambda n, a, b: F.struct(F.lit(n).alias("hop"), F.least(a, b).alias("p"), F.greatest(a, b).alias("q"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok"))
    pairs = chains.select(F.explode(F.array(hop(1, "microbe_id", "metabolite_id"), hop(2, "metabolite_id", "gene_id"), hop(3, "gene_id", "pathway"))).alias("h")).select("h.*").where("ok").drop("ok").distinct()
    known = edges.where("subject is not null and object is not null").select(F.least("subject", "object").alias("p"), F.greatest("subject", "object").alias("q")).distinct().withColumn("there", F.lit(1))
    return pairs.join(known, ["p", "q"], "left").groupBy("hop").agg(F.count(F.lit(1)).alias("pairs"), F.count("there").alias("present")).withColumn("share", F.round(F.col("present") / F.col("pairs"), 6))


def arms(first: DataFrame, second: DataFrame, nodes: DataFrame) -> DataFrame:
    """``subject, object, arm``: the different pairs of two edge sources inside a node set; ``both`` where they overlap."""
    keep = nodes.select("id").distinct()

    def inside(e: DataFrame, flag: str) -> DataFrame:
        p = e.where("subject is not null and object is not null").select(F.least("subject", "object").alias("subject"), F.greatest("subject", "object").alias("object")).distinct()
        return p.join(keep.withColumnRenamed("id", "subject"), "subject", "left_semi").join(keep.withColumnRenamed("id", "object"), "object", "left_semi").withColumn(flag, F.lit(1))

    j = inside(first, "f").join(inside(second, "s"), ["subject", "object"], "full")
    return j.select("subject", "object", F.when(F.col("f").isNotNull() & F.col("s").isNotNull(), "both").when(F.col("f").isNotNull(), "first").otherwise("second").alias("arm"))
