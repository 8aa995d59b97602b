"""Bridging feature names to a taxonomy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.ids import norm_name
from strandmill.functions.text import strip_parenthesis, unnamed_reason
from strandmill.session import settle

SYNONYM_CLASSES = ("synonym", "equivalent name", "genbank synonym")


def features_of_lineages(lines: DataFrame, lineage: str = "lineage") -> DataFrame:
    """``lineage, token, name``: the last segment of each lineage, kept if it is a species (``s__``) or genus (``g__``)."""
    last = F.element_at(F.split(lineage, r"\|"), -1)
    token = F.substring(last, 1, 3)
    return lines.select(lineage, token.alias("token"), F.substring(last, 4, 10000).alias("name")).where(F.col("token").isin("s__", "g__"))


def match_names(features: DataFrame, names: DataFrame) -> DataFrame:
    """``name, taxid, tier``: scientific name (1), scientific name without its trailing parenthesis (2), synonym (3); the first tier that matches wins.

    ``names`` has ``taxid, name, name_class``. The second tier holds only where the full scientific name is no feature.
    """
    f = features.select("name", norm_name(F.col("name")).alias("k")).distinct()
    sci = names.where("name_class = 'scientific name'").select("taxid", norm_name(F.col("name")).alias("full"), norm_name(strip_parenthesis(F.col("name"))).alias("bare"))
    syn = names.where(F.col("name_class").isin(*SYNONYM_CLASSES)).select("taxid", norm_name(F.col("name")).alias("k"))
    bare = sci.where("full <> bare").join(f.select(F.col("k").alias("full")), "full", "left_anti")
    tiers = [sci.select("taxid", F.col("full").alias("k"), F.lit(1).alias("tier")), bare.select("taxid", F.col("bare").alias("k"), F.lit(2).alias("tier")), syn.select("taxid", "k", F.lit(3).alias("tier"))]
    hits = None
    for t in tiers:
        part = f.join(t, "k").select("name", "taxid", "tier")
        hits = part if hits is None else hits.unionByName(part)
    first = hits.groupBy("name").agg(F.min("tier").alias("tier"))
    return hits.join(first, ["name", "tier"]).select("name", "taxid", "tier").distinct()


def scope(taxa: DataFrame, parents: DataFrame, include: Sequence[str], exclude: Sequence[str], root: str, most: int = 64) -> DataFrame:
    """``taxid, in_scope``: climbing from each taxon, the first listed ancestor decides; the root counts as inside, a broken link as outside.

    All taxa climb together; a taxon leaves the walk when it is decided, and each step is written.
    """
    walk = settle(taxa.select("taxid", F.col("taxid").alias("at"), F.lit(None).cast("boolean").alias("in_scope")).distinct(), "scope")
    decided = None
    for _ in range(most + 1):
        state = F.when(F.col("at").isNull(), False).when(F.col("at").isin(*include), True).when(F.col("at").isin(*exclude), False).when(F.col("at") == root, True)
        walk = settle(walk.withColumn("in_scope", state), "scope")
        done = walk.where("in_scope is not null").select("taxid", "in_scope")
        decided = done if decided is None else decided.unionByName(done)
        rest = walk.where("in_scope is null")
        if rest.isEmpty():
            return decided
        walk = rest.select("taxid", "at").join(parents.select(F.col("taxid").alias("at"), "parent"), "at", "left").select("taxid", F.col("parent").alias("at"), F.lit(None).cast("boolean").alias("in_scope"))
    return decided.unionByName(walk.select("taxid", F.lit(False).alias("in_scope")))


def adjudicate(features: DataFrame, matches: DataFrame, in_scope: DataFrame, ranks: DataFrame) -> DataFrame:
    """``name, token, status, taxid``: unnamed reasons first, then name_not_found, kingdom_scope_empty, duplicate_name, rank_mismatch, bridged."""
    f = features.select("name", "token").distinct().withColumn("unnamed", unnamed_reason(F.col("name")))
    m = matches.join(in_scope.where("in_scope"), "taxid", "left").groupBy("name").agg(F.collect_set(F.when(F.col("in_scope"), F.col("taxid"))).alias("scoped"), F.count(F.lit(1)).alias("n"))
    j = f.join(m, "name", "left").withColumn("taxid", F.when(F.size("scoped") == 1, F.get("scoped", F.lit(0)))).join(ranks.select("taxid", "rank"), "taxid", "left")
    wanted = F.when(F.col("token") == "s__", "species").otherwise("genus")
    status = (
        F.when(F.col("unnamed").isNotNull(), F.col("unnamed")).when(F.col("n").isNull(), "name_not_found").when(F.size("scoped") == 0, "kingdom_scope_empty")
        .when(F.size("scoped") > 1, "duplicate_name").when(F.coalesce("rank", F.lit("")) != wanted, "rank_mismatch").otherwise("bridged")
    )
    return j.select("name", "token", status.alias("status"), F.when(status == "bridged", F.col("taxid")).alias("taxid"))


def coverage(adjudicated: DataFrame) -> DataFrame:
    """``token, n, bridged, named, rate, named_rate``: bridged features over all, and over those that name an organism."""
    named = ~F.col("status").isin("genome_code", "unclassified", "sp_ref")
    g = adjudicated.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "bridged").alias("bridged"), F.count_if(named).alias("named"))
    return g.select("*", F.round(F.col("bridged") / F.col("n"), 6).alias("rate"), F.when(F.col("named") > 0, F.round(F.col("bridged") / F.col("named"), 6)).alias("named_rate"))
