"""Cutting a topic's sub-graph out of the evidence graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.ids import local_id
from strandmill.functions.text import ACTIONS, CAUSAL_STEMS, CORRELATION_STEMS, faithfulness, matches_stem
from strandmill.gates import require_empty
from strandmill.session import settle


def topic_family(nodes: DataFrame, ids: Sequence[str], root: str, category: str = "Disease") -> DataFrame:
    """Nodes of a category whose id (or its accession) is given, or whose name holds the root; ``via`` tells which."""
    wanted = [i.upper() for i in ids]
    by_id = F.col("id").isin(*wanted) | local_id(F.col("id")).isin(*wanted) if wanted else F.lit(False)
    by_name = F.lower("name").contains(root.lower()) if root else F.lit(False)
    via = F.concat_ws("+", F.when(by_id, "id"), F.when(F.coalesce(by_name, F.lit(False)), "name"))
    return nodes.where(F.col("category") == category).withColumn("via", via).where("via <> ''")


def adjacent(nodes: DataFrame, family: DataFrame, word: str, category: str = "Disease") -> DataFrame:
    """Nodes of the category that hold a word but are not in the family: what the cut leaves out on purpose."""
    return nodes.where((F.col("category") == category) & F.lower("name").contains(word.lower())).join(family.select("id"), "id", "left_anti")


def seed_edges(assertions: DataFrame, family: DataFrame, literature: DataFrame) -> DataFrame:
    """``edge_id, subject, object, provenance``: edges with an assertion in the literature or an end in the family.

    The reasons of an edge's assertions are united: each assertion meets three small lookups, then one aggregation by
    edge. Edges without a reason are left out.
    """
    fam = family.select(F.col("id").alias("f"), F.lit(True).alias("hit")).distinct()
    lit = literature.select("doc_id", F.lit(True).alias("in_lit")).distinct()
    a = (
        assertions.join(lit, "doc_id", "left")
        .join(fam.select(F.col("f").alias("subject"), F.col("hit").alias("s_hit")), "subject", "left")
        .join(fam.select(F.col("f").alias("object"), F.col("hit").alias("o_hit")), "object", "left")
    )
    flags = a.groupBy("edge_id", "subject", "object").agg(F.max("in_lit").alias("l"), F.max("s_hit").alias("s"), F.max("o_hit").alias("o"))
    reasons = F.concat_ws("+", F.when(F.col("o"), "object_in_family"), F.when(F.col("l"), "pmid_in_disease_lit"), F.when(F.col("s"), "subject_in_family"))
    return flags.withColumn("reasons", reasons).where("reasons <> ''").select("edge_id", "subject", "object", F.concat(F.lit("seed_assertion:"), "reasons").alias("provenance"))


def khop_nodes(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """``id, hop``: nodes within k undirected steps of the seeds, with the least number of steps; k = 0 gives the seeds.

    Level by level: only the frontier is joined with the edges, and the visited table is written after each level, so
    that the plan stays small. Ends as soon as a level is empty.
    """
    both = edges.select(F.col("subject").alias("a"), F.col("object").alias("b")).where("a is not null and b is not null")
    both = both.union(both.select("b", "a")).distinct()
    visited = seeds.select("id", F.lit(0).alias("hop")).where("id is not null").distinct()
    for hop in range(1, k + 1):
        visited = settle(visited, "khop")
        frontier = visited.where(F.col("hop") == hop - 1).select(F.col("id").alias("a"))
        new = both.join(frontier, "a").select(F.col("b").alias("id")).distinct().join(visited.select("id"), "id", "left_anti")
        if hop > 1 and frontier.isEmpty():
            break
        visited = visited.unionByName(new.withColumn("hop", F.lit(hop)))
    return visited


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with both ends among the ids."""
    keep = ids.select("id").distinct()
    return edges.join(keep.withColumnRenamed("id", "subject"), "subject", "left_semi").join(keep.withColumnRenamed("id", "object"), "object", "left_semi")


def restrict(child: DataFrame, column: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """The rows of a child table whose column is a key of the parents."""
    return child.join(parents.select(F.col(key).alias(column)).distinct(), column, "left_semi")


def modal_votes(votes: Column) -> Column:
    """How often the most frequent value of an array occurs; 0 for a null or empty array."""
    counts = F.transform(F.array_distinct(votes), lambda x: F.size(F.filter(votes, lambda y: y == x)))
    return F.when(F.size(votes) > 0, F.array_max(counts)).otherwise(0)


def edge_causality(edges: DataFrame, assertions: DataFrame, causal: str = CAUSAL_STEMS, correlation: str = CORRELATION_STEMS) -> DataFrame:
    """``edge_id, predicate, causality, basis, diag``: the causal grade of each edge from flags over its assertions.

    Rule 1: an action predicate, a dominant or supported vote, and causal words give ``causal``. Rule 2: the predicate
    ``affects`` or correlational words give ``correlated``. Else ``unclassified`` with what was missing. An edge without
    assertions has all flags 0. One aggregation by edge with partial maxima.
    """
    flag = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    said = [F.col(c) for c in ("evidence", "sentence") if c in assertions.columns]
    flags = assertions.groupBy("edge_id").agg(
        flag((modal_votes(F.col("votes")) >= 2) | (F.col("verdict") == "SUPPORTED")).alias("v"), flag(matches_stem(causal, *said)).alias("c"), flag(matches_stem(correlation, *said)).alias("r"))
    e = edges.select("edge_id", "predicate").join(flags, "edge_id", "left").withColumn("a", F.coalesce(F.col("predicate").isin(*ACTIONS), F.lit(False)).cast("int"))
    for f in ("v", "c", "r"):
        e = e.withColumn(f, F.coalesce(f, F.lit(0)))
    one = (F.col("a") == 1) & (F.col("v") == 1) & (F.col("c") == 1)
    affects = F.coalesce(F.col("predicate") == "affects", F.lit(False))
    two = affects | (F.col("r") == 1)
    missing = F.concat_ws("|", F.when(F.col("a") == 0, "action"), F.when(F.col("v") == 0, "vote"), F.when(F.col("c") == 0, "causal_ev"))
    basis = F.when(one, "rule1:action+vote+causal_ev").when(two, F.concat(F.lit("rule2:"), F.concat_ws("+", F.when(affects, "predicate_affects"), F.when(F.col("r") == 1, "corr_ev")))).otherwise(F.concat(F.lit("rule3:missing="), missing))
    diag = F.concat(F.lit("action="), "a", F.lit(",vote="), "v", F.lit(",causal_ev="), "c", F.lit(",corr_ev="), "r")
    return e.select("edge_id", "predicate", F.when(one, "causal").when(two, "correlated").otherwise("unclassified").alias("causality"), basis.alias("basis"), diag.alias("diag"))


def relink(assertions: DataFrame, votes: DataFrame, key: str = "assertion_id") -> DataFrame:
    """Assertions with their votes by recomputed content id; ``votes_missing`` counts what found none."""
    return assertions.join(votes, key, "left").withColumn("votes_missing", F.col("votes").isNull().cast("int"))


def with_marks(assertions: DataFrame, marks: DataFrame, key: str = "assertion_id") -> DataFrame:
    """Assertions with the language mark of their sentence; refused if one has none, as both tables must come from the same sentences."""
    m = marks.select(key, "mark").dropDuplicates([key])
    require_empty(assertions.select(key).join(m, key, "left_anti"), "assertions without a language mark")
    return assertions.join(m, key)


def faithfulness_metrics(audited: DataFrame) -> DataFrame:
    """One row over ``predicate, mark``: totals of causal and neutral predicates, over-reading rate with its upper bound of faithfulness, agreement among the judged, and how many have language of either kind."""
    c = audited.withColumn("cell", faithfulness(F.col("predicate"), F.col("mark")))
    n = lambda *cells: F.count_if(F.col("cell").isin(*cells))
    j = c.agg(F.count(F.lit(1)).alias("n"), n("correct").alias("correct"), n("overread").alias("over"), n("no_judgement_causal").alias("silent"), n("conservative", "consistent_conservative").alias("neutral"), n("no_judgement_neutral").alias("silent_neutral"))
    causal, judged, power = F.col("correct") + F.col("over") + F.col("silent"), F.col("correct") + F.col("over"), F.col("correct") + F.col("over") + F.col("neutral")
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    return j.select(F.col("n").alias("n_assertions"), causal.alias("causal_total"), (F.col("neutral") + F.col("silent_neutral")).alias("neutral_total"), rate(F.col("over"), causal).alias("overread_rate"), F.when(causal > 0, F.round(1 - F.col("over") / causal, 6)).alias("faithfulness_upper_bound"), rate(F.col("correct"), judged).alias("direction_agreement"), power.alias("n_with_language_power"), rate(power, F.col("n")).alias("with_language_power_rate"))
