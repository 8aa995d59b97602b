"""Open discovery over shared intermediates, time slices, and agreement with an independent library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.stats import wilson
from strandmill.operators.ranking import positions

CAP = 50


def pair_pmids(edges: DataFrame) -> DataFrame:
    """``a, b, pmids``: each undirected pair in both directions with the united PubMed ids of its edges."""
    e = edges.where("subject is not null and object is not null and subject <> object").select(F.least("subject", "object").alias("p"), F.greatest("subject", "object").alias("q"), F.explode_outer("pmids").alias("pmid"))
    u = e.groupBy("p", "q").agg(F.array_sort(F.collect_set("pmid")).alias("pmids"))
    return u.select(F.col("p").alias("a"), F.col("q").alias("b"), "pmids").union(u.select("q", "p", "pmids"))


def candidates(edges: DataFrame, nodes: DataFrame, left: Sequence[str], right: Sequence[str], via: Sequence[str], cap: int = CAP) -> DataFrame:
    """``left, right, mids, n_mids, n_pmids``: pairs without an edge of their own that share intermediates of at most ``cap`` neighbours.

    The cap is part of the method (a hub says nothing) and is applied before the self-join, so that an intermediate adds
    cap² pairs at most. Ids on both legs are united per pair.
    """
    kind = nodes.select("id", "category")
    legs = pair_pmids(edges)
    degree = legs.groupBy("b").agg(F.count(F.lit(1)).alias("degree"))
    mid = kind.where(F.col("category").isin(*via)).select(F.col("id").alias("b")).join(degree.where(F.col("degree") <= cap), "b").select("b")
    side = lambda cats, name: legs.join(mid, "b", "left_semi").join(kind.where(F.col("category").isin(*cats)).select(F.col("id").alias("a")), "a", "left_semi").select(F.col("a").alias(name), "b", F.col("pmids").alias(f"{name}_pmids"))
    paths = side(left, "left").join(side(right, "right"), "b").where(F.col("left") != F.col("right"))
    known = legs.select(F.col("a").alias("left"), F.col("b").alias("right"))
    open_ = paths.join(known, ["left", "right"], "left_anti")
    mids = open_.groupBy("left", "right").agg(F.array_sort(F.collect_set("b")).alias("mids"))
    ids = open_.select("left", "right", F.explode(F.array_union("left_pmids", "right_pmids")).alias("pmid")).groupBy("left", "right").agg(F.countDistinct("pmid").alias("n_pmids"))
    return mids.join(ids, ["left", "right"], "left").select("left", "right", "mids", F.coalesce("n_pmids", F.lit(0)).alias("n_pmids"), F.size("mids").alias("n_mids"))


def ranked(cands: DataFrame, shown: int = 8) -> DataFrame:
    """``rank, left, right, n_mids, n_pmids, shown_mids``: by intermediates, ids, then the pair; the rank is made by many tasks."""
    order = [F.desc("n_mids"), F.desc("n_pmids"), F.asc("left"), F.asc("right")]
    out = positions(cands, [], order, "rank")
    text = F.concat(F.array_join(F.slice("mids", 1, shown), ";"), F.when(F.size("mids") > shown, ";…").otherwise(""))
    return out.select("rank", "left", "right", "n_mids", "n_pmids", text.alias("shown_mids"))


def edge_years(edges: DataFrame) -> DataFrame:
    """``edge_id, subject, object, predicate, known, n_ids, last_year, first_year``: how many years of an edge's evidence are known, and their range."""
    return edges.select("edge_id", "subject", "predicate", "object", "pmids", F.size("years").alias("known"), F.size("pmids").alias("n_ids"), F.array_max("years").alias("last_year"), F.array_min("years").alias("first_year"))


def year_coverage(edges: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row: edges whose years are known in full, in part, not at all; the share that can be placed, and whether it reaches the threshold."""
    e = edge_years(edges)
    state = F.when((F.col("known") == 0), "unresolvable").when(F.col("known") >= F.col("n_ids"), "full").otherwise("partial")
    s = e.select(state.alias("s"))
    share = F.round(F.avg((F.col("s") != "unresolvable").cast("double")), 6)
    return s.agg(F.count_if(F.col("s") == "full").alias("full"), F.count_if(F.col("s") == "partial").alias("partial"), F.count_if(F.col("s") == "unresolvable").alias("unresolvable"), share.alias("share"), (share >= threshold).alias("passed"))


def at_cutoff(edges: DataFrame, cutoff: int) -> DataFrame:
    """``subject, object, n_pmids, last_year``: pairs with an edge all of whose known evidence is from the cut-off year or before; figures over those edges."""
    e = edge_years(edges).where(F.col("last_year") <= cutoff).select("subject", "object", "last_year", F.explode_outer("pmids").alias("pmid"))
    return e.groupBy("subject", "object").agg(F.countDistinct("pmid").alias("n_pmids"), F.max("last_year").alias("last_year"))


def exam(library: DataFrame, first: int) -> DataFrame:
    """Pairs of the library whose first year is ``first`` or later."""
    return library.groupBy("subject", "object").agg(F.min("year").alias("first_year")).where(F.col("first_year") >= first)


def exam_sizes(library: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    """``cutoff, n_exam``: for each cut-off year the pairs whose first year is later; one pass."""
    first = library.groupBy("subject", "object").agg(F.min("year").alias("y"))
    row = first.agg(*[F.count_if(F.col("y") > c).alias(f"n{c}") for c in cutoffs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(f"n{c}").alias("n_exam")) for c in cutoffs])).alias("r")).select("r.*")


def layer_metrics(own: DataFrame, library: DataFrame, expected: dict[str, str]) -> DataFrame:
    """One row: pairs of ``own(subject, object, predicates, pmids)`` that ``library(subject, object, alterations, lib_pmids)`` has, direction of those with one polar predicate, pairs that share a PubMed id, and pairs of which the library knows one side with any partner.

    Rates are over all pairs of ``own``. A pair with several polar predicates contradicts itself and is not comparable.
    """
    side = lambda c: library.select(c).distinct().withColumn(f"{c}_known", F.lit(1))
    j = own.join(library.withColumn("hit", F.lit(True)), ["subject", "object"], "left").join(side("subject"), "subject", "left").join(side("object"), "object", "left")
    want = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(v))])
    j = j.withColumn("hit", F.coalesce("hit", F.lit(False))).withColumn("polar", F.array_intersect("predicates", F.array(*[F.lit(k) for k in expected])))
    comparable = F.col("hit") & (F.size("polar") == 1)
    agrees = F.coalesce(F.array_contains("alterations", want[F.get("polar", F.lit(0))]), F.lit(False))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    shared = F.coalesce(F.size(F.array_intersect("pmids", "lib_pmids")) > 0, F.lit(False))
    return j.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if("hit").alias("matched"), share(F.col("hit")).alias("rate"), F.count_if(comparable).alias("comparable"), F.count_if(comparable & agrees).alias("consistent"), F.count_if(comparable & ~agrees).alias("inconsistent"),
        F.count_if(F.col("hit") & (F.size("polar") > 1)).alias("self_conflict"), F.count_if(F.col("hit") & shared).alias("shared_pmid"), F.count("subject_known").alias("subject_side"), F.count("object_known").alias("object_side"), share(F.col("subject_known").isNotNull()).alias("subject_rate"), share(F.col("object_known").isNotNull()).alias("object_rate"))


def pair_pool(*tables: DataFrame) -> DataFrame:
    """``subject, object``: the pairs of several tables, each once."""
    out = tables[0].select("subject", "object")
    for t in tables[1:]:
        out = out.union(t.select("subject", "object"))
    return out.distinct()


def time_slice(predicted: DataFrame, exam_pairs: DataFrame, bridged: DataFrame) -> DataFrame:
    """One row: size of the exam, pairs hit as they are, hit through a bridge only, and the verdict.

    ``bridged`` has ``subject, alias``: other ids under which a predicted subject may be examined.
    """
    p = predicted.select("subject", "object").distinct()
    via = p.join(bridged, "subject").select(F.col("alias").alias("subject"), "object").distinct().withColumn("b", F.lit(1))
    j = exam_pairs.select("subject", "object").distinct().join(p.withColumn("s", F.lit(1)), ["subject", "object"], "left").join(via, ["subject", "object"], "left")
    r = j.agg(F.count(F.lit(1)).alias("n_exam"), F.count("s").alias("strict"), F.count_if(F.col("s").isNull() & F.col("b").isNotNull()).alias("bridged"))
    verdict = F.when(F.col("n_exam") < 100, "INSUFFICIENT_EXAM").when(F.col("strict") >= 5, "POSITIVE_CLAIMABLE").when(F.col("strict") >= 1, "CASE_ONLY").otherwise("NEGATIVE_PREWRITTEN")
    return r.withColumn("verdict", verdict)


def ancestors(trees: DataFrame) -> DataFrame:
    """``id, ancestor, dist``: every proper prefix of an id's dotted paths that is the path of another id; the least number of levels."""
    parts = F.split("path", r"\.")
    pre = trees.withColumn("n", F.size(parts)).where("n > 1").select("id", "n", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"), parts.alias("p"))
    pre = pre.select("id", F.array_join(F.slice("p", 1, F.col("k")), ".").alias("path"), (F.col("n") - F.col("k")).alias("dist"))
    return pre.join(trees.select(F.col("id").alias("ancestor"), "path"), "path").where("id <> ancestor").groupBy("id", "ancestor").agg(F.min("dist").alias("dist"))


def nearest_ancestor(own: DataFrame, library: DataFrame, above: DataFrame) -> DataFrame:
    """``id, target, relation, dist``: exact, else the nearest ancestor in the library (then the smaller id), else a child in it, else none."""
    lib = library.select(F.col("id").alias("target")).distinct()
    exact = own.select("id").distinct().join(lib.select(F.col("target").alias("id"), F.lit(1).alias("e")), "id", "left")
    up = above.join(lib.withColumnRenamed("target", "ancestor"), "ancestor", "left_semi").groupBy("id").agg(F.min(F.struct("dist", "ancestor")).alias("up"))
    down = above.join(lib.withColumnRenamed("target", "id"), "id", "left_semi").groupBy(F.col("ancestor").alias("id")).agg(F.min(F.struct("dist", F.col("id").alias("child"))).alias("down"))
    j = exact.join(up, "id", "left").join(down, "id", "left")
    relation = F.when(F.col("e") == 1, "exact").when(F.col("up").isNotNull(), "parent_of").when(F.col("down").isNotNull(), "child_of").otherwise("none")
    return j.select("id", F.when(relation == "exact", F.col("id")).when(relation == "parent_of", F.col("up.ancestor")).when(relation == "child_of", F.col("down.child")).alias("target"), relation.alias("relation"), F.when(relation == "exact", 0).when(relation == "parent_of", F.col("up.dist")).when(relation == "child_of", F.col("down.dist")).alias("dist"))


def name_cascade(own: DataFrame, library: DataFrame, parents: DataFrame) -> DataFrame:
    """``id, target, relation``: by id (exact), by any shared lower-case name (synonym, the smallest id), by direct parent (parent_of), by a direct child (child_of, the smallest id; registered only), else none.

    ``own`` and ``library`` have ``id, name``; ``parents`` has ``id, parent``.
    """
    ids = own.select("id").distinct()
    lib = library.select(F.col("id").alias("t"), F.lower("name").alias("k")).distinct()
    known = lib.select("t").distinct()
    exact = ids.join(known.select(F.col("t").alias("id")), "id", "left_semi").withColumn("exact", F.col("id"))
    synonym = own.select("id", F.lower("name").alias("k")).join(lib.where("k is not null"), "k").groupBy("id").agg(F.min("t").alias("synonym"))
    parent = parents.join(known.select(F.col("t").alias("parent")), "parent", "left_semi").groupBy("id").agg(F.min("parent").alias("parent"))
    child = parents.where("id <> parent").join(known.select(F.col("t").alias("id")), "id", "left_semi").groupBy(F.col("parent").alias("id")).agg(F.min("id").alias("child"))
    j = ids.join(exact, "id", "left").join(synonym, "id", "left").join(parent, "id", "left").join(child, "id", "left")
    relation = F.when(F.col("exact").isNotNull(), "exact").when(F.col("synonym").isNotNull(), "synonym").when(F.col("parent").isNotNull(), "parent_of").when(F.col("child").isNotNull(), "child_of").otherwise("none")
    return j.select("id", F.coalesce("exact", "synonym", "parent", "child").alias("target"), relation.alias("relation"))


def aligned(pairs: DataFrame, library: DataFrame, subject_map: DataFrame, above: DataFrame, caps: Sequence[int] = (0, 1, 2, 3)) -> DataFrame:
    """``cap, n, hits, rate, low, high``: how many pairs the library confirms when the object may move up ``cap`` levels.

    The subject is itself where the library knows it, else by ``subject_map(id, target)``; the object is itself, else its
    nearest ancestor in the library within the cap (a distance of 0 is a distance).
    """
    lib = library.select("subject", "object").distinct()
    known_s, known_o = lib.select(F.col("subject").alias("s")).distinct().withColumn("ks", F.lit(1)), lib.select(F.col("object").alias("o")).distinct().withColumn("ko", F.lit(1))
    best = above.join(known_o.select(F.col("o").alias("ancestor")), "ancestor", "left_semi").groupBy(F.col("id").alias("object")).agg(F.min(F.struct("dist", "ancestor")).alias("up"))
    p = pairs.select("subject", "object").distinct()
    p = p.join(known_s, F.col("subject") == F.col("s"), "left").join(known_o, F.col("object") == F.col("o"), "left").join(subject_map.select(F.col("id").alias("subject"), "target"), "subject", "left").join(best, "object", "left")
    p = p.withColumn("t", F.when(F.col("ks") == 1, F.col("subject")).otherwise(F.col("target")))
    each = p.select("t", "object", "ko", "up", F.explode(F.array(*[F.lit(c) for c in caps])).alias("cap"))
    each = each.withColumn("m", F.when(F.col("ko") == 1, F.col("object")).when(F.col("up.dist") <= F.col("cap"), F.col("up.ancestor")))
    hit = each.join(lib.select(F.col("subject").alias("t"), F.col("object").alias("m"), F.lit(1).alias("hit")), ["t", "m"], "left")
    g = hit.groupBy("cap").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits")).withColumn("w", wilson(F.col("hits"), F.col("n")))
    return g.select("cap", "n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("rate"), F.col("w.low").alias("low"), F.col("w.high").alias("high"))


def direction_agreement(pairs: DataFrame, expected: dict[str, str]) -> DataFrame:
    """One row over pairs with ``predicates`` and ``alterations`` (arrays): comparable (exactly one polar predicate), consistent, self-conflicting."""
    polar = F.array_intersect("predicates", F.array(*[F.lit(k) for k in expected]))
    want = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(v))])
    p = pairs.withColumn("polar", polar)
    comparable = F.size("polar") == 1
    consistent = comparable & F.array_contains("alterations", want[F.get("polar", F.lit(0))])
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if(comparable).alias("comparable"), F.count_if(consistent).alias("consistent"), F.count_if(F.size("polar") > 1).alias("self_conflict"))


def strata(pairs: DataFrame, stratum: str, hit: str) -> DataFrame:
    """``stratum, n, hits, rate, low, high``: agreement per stratum with its interval."""
    g = pairs.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits")).withColumn("w", wilson(F.col("hits"), F.col("n")))
    return g.select("stratum", "n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("rate"), F.col("w.low").alias("low"), F.col("w.high").alias("high"))


def hit_bins(scores: DataFrame, score: str, hit: str, edges: Sequence[float] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """``bin, n, hits, rate`` over fixed bins of a score; a null score is in no bin."""
    b = F.lit(0)
    for x in edges:
        b = b + (F.col(score) >= x).cast("int")
    return scores.where(F.col(score).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), F.round(F.avg(F.col(hit).cast("double")), 6).alias("rate"))


def retrieval(scores: DataFrame, exam_keys: DataFrame, key: str, score: str, top: int = 100) -> DataFrame:
    """One row: exam size, covered, mean reciprocal rank over the exam, hits among the first ``top``. Each key counts with its greatest score; ties by key."""
    best = scores.groupBy(key).agg(F.max(score).alias("__s"))
    ranks = positions(best, [], [F.desc("__s"), F.asc(key)], "rank")
    j = exam_keys.select(key).distinct().join(ranks.select(key, "rank"), key, "left")
    return j.agg(F.count(F.lit(1)).alias("n_exam"), F.count("rank").alias("covered"), F.round(F.coalesce(F.sum(1 / F.col("rank")), F.lit(0.0)) / F.count(F.lit(1)), 6).alias("mrr"), F.count_if(F.col("rank") <= top).alias("hits_top"))


def crosswalk_filter(rows: DataFrame, known: Sequence[str] = ("exact", "synonym", "parent_of", "child_of"), most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(kept, unknown): rows of usable relations whose ``dist=`` is at most ``most`` (no distance is kept); ``child_of`` is registered but not used. Rows of unknown relations come out apart, for a gate."""
    from strandmill.functions.ids import tree_distance

    d = tree_distance(F.col("evidence"))
    kept = rows.where(F.col("relation").isin(*[k for k in known if k != "child_of"]) & (d.isNull() | (d <= most)))
    return kept, rows.where(F.col("relation").isNull() | ~F.col("relation").isin(*known))


