"""Cohort annotation, votes, verification, cards, null control, counterfactuals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.ids import local_id
from strandmill.operators import cohort as co
from strandmill.operators import counterfactual as cf
from strandmill.operators import votes as vo
from strandmill.plans import adapter as ad
from strandmill.plans import evidence_tables as et
from strandmill.plans.adapter import sql
from strandmill.operators.skew import salted_join
from strandmill.plans.registry import Registry, load
from strandmill.session import settle

REG = Registry()
Spark = SparkSession
COHORTS = ("H1", "H2")


def _matrix(spark: Spark, sf: str, feature: F.Column) -> DataFrame:
    e = load(spark, sf, "events")
    return e.select(F.when(F.dayofmonth("ts") <= 15, "H1").otherwise("H2").alias("cohort"), feature.alias("feature"), F.col("user_id").alias("sample"), "value")


def taxon_matrix(spark: Spark, sf: str) -> DataFrame:
    return _matrix(spark, sf, F.col("event_type"))


def ko_matrix(spark: Spark, sf: str) -> DataFrame:
    return _matrix(spark, sf, F.concat(F.lit("K"), F.col("event_id") % 20))


def scored_chains(spark: Spark, sf: str) -> DataFrame:
    c = ad.chains(spark, sf)
    return c.select("chain_id", "microbe_id", "microbe_name", local_id(F.col("microbe_id")).alias("taxid"), "metabolite_id", F.col("hop2_gene").alias("gene_id"), F.col("hop2_gene_name").alias("gene_name"), F.col("hop3_pathway").alias("pathway"), "hop1_edge_id", F.lit("").alias("refs"), "depth", "penalty")


@dataclass
class Base:
    """The chains written once, with their hot keys: what the votes of one run share."""

    chains: DataFrame
    hot: dict[str, list[str]]


def base(spark: Spark, sf: str) -> Base:
    c = settle(scored_chains(spark, sf), "chains")
    return Base(c, vo.hot_of(c))


def bridge(spark: Spark, sf: str) -> DataFrame:
    """A stand-in bridge: taxa are put onto the features by number; a third of them has a second, genus-level row."""
    kinds = load(spark, sf, "events").select(F.col("event_type").alias("feature")).distinct()
    ordered = kinds.agg(F.array_sort(F.collect_set("feature")).alias("fs"))  # five kinds
    t = scored_chains(spark, sf).select("taxid").distinct().withColumn("n", F.col("taxid").try_cast("bigint")).crossJoin(F.broadcast(ordered))
    one = t.select(F.explode(F.array(F.lit("H1"), F.lit("H2"))).alias("source"), "taxid", F.when(F.col("n") % 2 == 0, "species").otherwise("genus").alias("rank_token"), (F.col("n") % 8).alias("i"), "fs")
    two = t.where("n % 3 = 0").select(F.explode(F.array(F.lit("H1"), F.lit("H2"))).alias("source"), "taxid", F.lit("genus").alias("rank_token"), ((F.col("n") + 1) % 8).alias("i"), "fs")
    return one.unionByName(two).where(F.col("i") < F.size("fs")).select("source", "taxid", "rank_token", F.get("fs", F.col("i").cast("int")).alias("feature"))


_SCORED = "sc AS (SELECT chain_id, microbe_id, microbe_name, CASE WHEN contains(microbe_id, ':') THEN regexp_extract(microbe_id, '^[^:]*:(.*)$', 1) ELSE microbe_id END AS taxid, metabolite_id, hop2_gene AS gene_id, hop2_gene_name AS gene_name, hop3_pathway AS pathway, hop1_edge_id, '' AS refs, depth, penalty, metabolite_chebi FROM chs)"


def _stats_sql(name: str, matrix: str, keys: str) -> str:
    """Statistics over all samples of a cohort, from the full grid of groups and samples."""
    return f"""{name} AS (SELECT g.cohort, {', '.join('g.' + k for k in keys.split(', '))}, round(median(coalesce(v, 0))::DOUBLE, 6) AS median, round(avg((coalesce(v, 0) > 0)::INT), 6) AS detection_rate, sum((coalesce(v, 0) > 0)::INT) AS detections
  FROM (SELECT DISTINCT cohort, {keys} FROM {matrix}) g JOIN (SELECT DISTINCT cohort, sample FROM tm) s USING (cohort) LEFT JOIN (SELECT cohort, {keys}, sample, sum(v) AS v FROM {matrix} GROUP BY ALL) m ON m.cohort = g.cohort AND m.sample = s.sample AND {' AND '.join(f'm.{k} = g.{k}' for k in keys.split(', '))} GROUP BY ALL)"""


_MATRIX = (
    "tm AS (SELECT CASE WHEN day(ts) <= 15 THEN 'H1' ELSE 'H2' END AS cohort, event_type AS feature, user_id AS sample, value::DECIMAL(18,4) AS v FROM events), "
    + _stats_sql("fstat", "tm", "feature")
    + """, km AS (SELECT CASE WHEN day(ts) <= 15 THEN 'H1' ELSE 'H2' END AS cohort, 'K' || (event_id % 20) AS ko, user_id AS sample, value::DECIMAL(18,4) AS v FROM events)"""
)
_PRESENCE = (
    _SCORED
    + ", "
    + _MATRIX
    + """, fs AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS i FROM (SELECT DISTINCT event_type AS feature FROM events)),
 taxa AS (SELECT DISTINCT taxid, TRY_CAST(taxid AS BIGINT) AS n FROM sc), co AS (SELECT unnest(['H1', 'H2']) AS cohort),
 br AS (SELECT cohort, taxid, CASE WHEN n % 2 = 0 THEN 'species' ELSE 'genus' END AS rank_token, feature FROM taxa, co, fs WHERE i = n % 8 UNION ALL SELECT cohort, taxid, 'genus', feature FROM taxa, co, fs WHERE i = (n + 1) % 8 AND n % 3 = 0),
 pick AS (SELECT * FROM br QUALIFY row_number() OVER (PARTITION BY cohort, taxid ORDER BY CASE rank_token WHEN 'species' THEN 0 ELSE 1 END, feature) = 1),
 pres AS (SELECT t.taxid, co.cohort, CASE WHEN p.feature IS NULL OR s.detections IS NULL THEN 'not_bridged' WHEN s.detections > 0 THEN 'present' ELSE 'absent' END AS status, s.median, s.detection_rate FROM taxa t CROSS JOIN co LEFT JOIN pick p ON p.taxid = t.taxid AND p.cohort = co.cohort LEFT JOIN fstat s ON s.cohort = co.cohort AND s.feature = p.feature)"""
)


def _presence(spark: Spark, sf: str) -> DataFrame:
    return co.microbe_presence(scored_chains(spark, sf), bridge(spark, sf), co.feature_stats(taxon_matrix(spark, sf)), COHORTS)


@REG.query(oracle="WITH " + _MATRIX + " SELECT cohort, feature, median, detection_rate, detections::BIGINT AS detections FROM fstat")
def feature_stats(spark: Spark, sf: str) -> DataFrame:
    return co.feature_stats(taxon_matrix(spark, sf))


@REG.query(oracle=sql(_PRESENCE + " SELECT * FROM pres", "chs"))
def microbe_presence(spark: Spark, sf: str) -> DataFrame:
    return _presence(spark, sf)


def entities(spark: Spark, sf: str) -> DataFrame:
    """Each metabolite with the numbers of all its packed registry fields."""
    c = ad.chains(spark, sf).select(F.col("metabolite_id").alias("entity"), F.explode_outer(F.regexp_extract_all("metabolite_chebi", F.lit("([0-9]{4,})"))).alias("chebi")).where("entity is not null")
    return c.groupBy("entity").agg(F.array_sort(F.collect_set("chebi")).alias("chebi"))


def _potential(spark: Spark, sf: str) -> DataFrame:
    e = entities(spark, sf)
    n = F.col("chebi").try_cast("bigint")
    known = load(spark, sf, "metabolite_host_gene").select(F.explode(F.regexp_extract_all("metabolite_chebi", F.lit("([0-9]{4,})"))).alias("chebi")).distinct()
    mapping = e.select(F.explode("chebi").alias("chebi")).distinct().join(known, "chebi", "left_semi").select("chebi", F.concat(F.lit("K"), n % 23).alias("ko"))
    return co.potential(e, mapping, ko_matrix(spark, sf), COHORTS)


_POTENTIAL = (
    """ent AS (SELECT metabolite_id AS entity, coalesce(list_sort(list_distinct(flatten(list(regexp_extract_all(metabolite_chebi, '[0-9]{4,}'))))), []) AS chebi FROM sc WHERE metabolite_id IS NOT NULL GROUP BY 1),
 ek AS (SELECT DISTINCT entity, 'K' || (c::BIGINT % 23) AS ko FROM (SELECT entity, unnest(chebi) AS c FROM ent) WHERE c IN (SELECT unnest(regexp_extract_all(metabolite_chebi, '[0-9]{4,}')) FROM metabolite_host_gene)),
 ekm AS (SELECT cohort, entity, sample, v FROM ek JOIN km USING (ko)), """
    + _stats_sql("kstat", "ekm", "entity")
    + """, pot AS (SELECT e.entity, co.cohort, coalesce(n, 0) AS n_mapped, CASE WHEN len(chebi) = 0 THEN 'no_chebi' WHEN n IS NULL THEN 'unmapped_chebi' WHEN s.detections > 0 THEN 'measurable' ELSE 'ko_absent' END AS label, s.median, s.detection_rate
  FROM ent e CROSS JOIN co LEFT JOIN (SELECT entity, count(*) AS n FROM ek GROUP BY 1) m ON m.entity = e.entity LEFT JOIN kstat s ON s.entity = e.entity AND s.cohort = co.cohort)"""
)


@REG.query(oracle=sql(_PRESENCE + ", " + _POTENTIAL + " SELECT * FROM pot", "chs"))
def ko_potential(spark: Spark, sf: str) -> DataFrame:
    return _potential(spark, sf)


@REG.query(oracle=sql(_PRESENCE + ", " + _POTENTIAL + " SELECT chain_id, p.cohort, p.status AS microbe_status, k.label AS ko_label, k.n_mapped FROM sc JOIN pres p USING (taxid) JOIN pot k ON k.entity = sc.metabolite_id AND k.cohort = p.cohort", "chs"))
def chain_annotations(spark: Spark, sf: str) -> DataFrame:
    return co.annotate(scored_chains(spark, sf), _presence(spark, sf), _potential(spark, sf)).select("chain_id", "cohort", "microbe_status", "ko_label", "n_mapped")


@REG.query(oracle="WITH t AS (SELECT 'clicks' AS n, user_id AS sample FROM events WHERE event_type = 'click' UNION SELECT 'late', user_id FROM events WHERE day(ts) > 15 UNION SELECT 'views', user_id FROM events WHERE event_type = 'view') SELECT a.n AS a, b.n AS b, (SELECT count(*) FROM t x WHERE x.n = a.n AND x.sample NOT IN (SELECT sample FROM t y WHERE y.n = b.n)) AS only_a, (SELECT count(*) FROM t x WHERE x.n = b.n AND x.sample NOT IN (SELECT sample FROM t y WHERE y.n = a.n)) AS only_b FROM (SELECT DISTINCT n FROM t) a, (SELECT DISTINCT n FROM t) b WHERE a.n < b.n")
def sample_reconciliation(spark: Spark, sf: str) -> DataFrame:
    e = load(spark, sf, "events").withColumn("sample", F.col("user_id"))
    return co.reconcile_samples({"clicks": e.where("event_type = 'click'"), "views": e.where("event_type = 'view'"), "late": e.where(F.dayofmonth("ts") > 15)})


def _number(c: str) -> F.Column:
    return F.regexp_extract(c, "([0-9]+)$", 1).try_cast("bigint")


def _lists(spark: Spark, sf: str, empty: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(taxa, names, genera, strains by taxon, strains by name): external lists, of the species that three batches loaded and of the strains by layer."""
    n = ad.nodes(spark, sf).where((F.col("category") == "Species") & F.lit(not empty))
    strain = n.where("tax_rank = 'strain'")
    return (
        n.where("run_batch = 'b01'").select(local_id(F.col("id")).alias("taxid")), n.where("run_batch = 'b02'").select("name"), n.where("run_batch = 'b03'").select(F.substring_index("name", " ", 1).alias("name")),
        strain.where("knowledge_layer = 'curated'").select(local_id(F.col("id")).alias("taxid")), strain.where("knowledge_layer is null or knowledge_layer <> 'curated'").select("name"),
    )


def _vote1(spark: Spark, sf: str) -> DataFrame:
    b = base(spark, sf)
    return vo.external_vote(b.chains, *_lists(spark, sf)[:3], b.hot)


_LISTS = r"""sp AS (SELECT name, regexp_replace(id, '^[^:]*:', '') AS tax, run_batch, tax_rank, knowledge_layer FROM nodes WHERE category = 'Species')"""
_HIT1 = lambda m: f"SELECT microbe_id FROM {m} WHERE taxid IN (SELECT tax FROM sp WHERE run_batch = 'b01') OR lower(trim(microbe_name)) IN (SELECT lower(trim(name)) FROM sp WHERE run_batch = 'b02') OR (contains(trim(microbe_name), ' ') AND split_part(lower(trim(microbe_name)), ' ', 1) IN (SELECT lower(split_part(name, ' ', 1)) FROM sp WHERE run_batch = 'b03'))"
_HIT4 = lambda m: f"SELECT microbe_id FROM {m} WHERE taxid IN (SELECT tax FROM sp WHERE tax_rank = 'strain' AND knowledge_layer = 'curated') OR lower(trim(microbe_name)) IN (SELECT lower(trim(name)) FROM sp WHERE tax_rank = 'strain' AND knowledge_layer IS DISTINCT FROM 'curated')"
_V1 = _SCORED + ", " + _LISTS + ", h1 AS (" + _HIT1("sc") + "), v1 AS (SELECT chain_id, coalesce(microbe_id IN (SELECT microbe_id FROM h1 WHERE microbe_id IS NOT NULL), false)::INT AS vote1 FROM sc)"


@REG.query(oracle=sql(_V1 + " SELECT chain_id, coalesce(vote1, 0) AS vote1 FROM v1", "chs", "nodes"))
def vote1(spark: Spark, sf: str) -> DataFrame:
    return _vote1(spark, sf)


def _records(spark: Spark, sf: str, empty: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts by node, counts by name, second source by microbe) of vote 3."""
    by_node, by_name = vo.record_counts(settle(et._buckets(spark, sf).where(F.lit(not empty)), "buckets"), "metabolite", "gene")
    second = ad.edges(spark, sf).where((F.col("predicate") == "increases_abundance_in") & F.col("subject").isNotNull() & F.lit(not empty)).groupBy(F.col("subject").alias("microbe_id")).agg(F.count(F.lit(1)).alias("n"))
    return by_node, by_name, second


def _vote3(spark: Spark, sf: str) -> DataFrame:
    b = base(spark, sf)
    return vo.evidence_vote(b.chains, *_records(spark, sf), b.hot)


_V3 = """sides AS (SELECT node_a AS node, metabolite AS name FROM buckets WHERE bucket IN ('confirm', 'extend') UNION ALL SELECT node_b, gene FROM buckets WHERE bucket IN ('confirm', 'extend')),
 bn AS (SELECT node, count(*) AS n FROM sides WHERE node IS NOT NULL GROUP BY 1), bk AS (SELECT lower(name) AS key, count(*) AS n FROM sides WHERE node IS NULL AND name <> '' GROUP BY 1),
 b2 AS (SELECT subject, count(*) AS n FROM edges WHERE predicate = 'increases_abundance_in' AND subject IS NOT NULL GROUP BY 1),
 n3 AS (SELECT chain_id, coalesce(m.n, 0) + coalesce(b.n, 0) + coalesce(g.n, 0) AS n1, coalesce(s.n, 0) AS n2 FROM sc LEFT JOIN bn m ON m.node = sc.microbe_id LEFT JOIN bn b ON b.node = sc.metabolite_id LEFT JOIN bk g ON g.key = lower(trim(sc.gene_name)) LEFT JOIN b2 s ON s.subject = sc.microbe_id),
 v3 AS (SELECT chain_id, n1 AS n_first, n2 AS n_second, (n1 > 0 OR n2 > 0)::INT AS vote3, round((greatest(least(1.0, n1 / 3), least(1.0, n2 / 3)) + least(least(1.0, n1 / 3), least(1.0, n2 / 3)) / 4) / 1.644934, 6) AS evidence_score FROM n3)"""


@REG.query(oracle=sql(et._BUCKETS + ", " + _SCORED + ", " + _V3 + " SELECT * FROM v3", "names", "edges", "chs", "curated"))
def vote3(spark: Spark, sf: str) -> DataFrame:
    return _vote3(spark, sf)


def _strain(spark: Spark, sf: str) -> DataFrame:
    b = base(spark, sf)
    return vo.strain_available(b.chains, *_lists(spark, sf)[3:], b.hot)


_V4 = "h4 AS (" + _HIT4("sc") + "), st AS (SELECT chain_id, coalesce(microbe_id IN (SELECT microbe_id FROM h4 WHERE microbe_id IS NOT NULL), false)::INT AS strain FROM sc)"


@REG.query(oracle=sql(_SCORED + ", " + _LISTS + ", " + _V4 + " SELECT chain_id, coalesce(strain, 0) AS strain FROM st", "chs", "nodes"))
def strain_available(spark: Spark, sf: str) -> DataFrame:
    return _strain(spark, sf)


def _steps(spark: Spark, sf: str, c: DataFrame, hot: vo.Hot, keep: tuple[str, ...] = ("chain_id",)) -> DataFrame:
    pairs = c.where("depth = 3").select(F.col("metabolite_id").alias("subject"), F.col("gene_id").alias("object"), F.col("chain_id").alias("edge_id"))
    curated = ad.nodes(spark, sf).where("category = 'Pathway' and knowledge_layer = 'curated'").select(F.col("id").alias("pathway"))
    return vo.verify_steps(c, ad.edges(spark, sf), pairs, ad.gene_pathways(spark, sf).join(curated, "pathway", "left_semi"), hot, keep)


_STEPS = """pr AS (SELECT least(metabolite_id, gene_id) AS p, greatest(metabolite_id, gene_id) AS q, min(chain_id) AS support FROM sc WHERE depth = 3 AND metabolite_id IS NOT NULL AND gene_id IS NOT NULL GROUP BY 1, 2),
 stp AS (SELECT chain_id, coalesce(e.subject = sc.microbe_id AND e.object = sc.metabolite_id, false)::INT AS step1, (pr.support IS NOT NULL)::INT AS step2, (g.gene IS NOT NULL)::INT AS step3, depth AS total,
   CASE WHEN gene_id IS NULL THEN '' WHEN pr.support IS NOT NULL THEN 'subgraph_edge:' || pr.support ELSE 'curated_only:' || refs END AS step2_support
  FROM sc LEFT JOIN edges e ON e.edge_id = sc.hop1_edge_id LEFT JOIN pr ON pr.p = least(metabolite_id, gene_id) AND pr.q = greatest(metabolite_id, gene_id) AND gene_id IS NOT NULL AND metabolite_id IS NOT NULL LEFT JOIN (SELECT * FROM gene_pathways WHERE pathway IN (SELECT id FROM nodes WHERE category = 'Pathway' AND knowledge_layer = 'curated')) g ON g.gene = sc.gene_id AND g.pathway = sc.pathway),
 steps AS (SELECT *, step1 + step2 + step3 AS verified, round((step1 + step2 + step3) / total, 6) AS verified_rate FROM stp)"""


@REG.query(oracle=sql(_SCORED + ", " + _STEPS + " SELECT * FROM steps", "nodes", "gene_pathways", "edges"))
def stepwise_verification(spark: Spark, sf: str) -> DataFrame:
    b = base(spark, sf)
    return _steps(spark, sf, b.chains, b.hot)


def _metabolites(spark: Spark, sf: str, by_node: DataFrame, empty: bool = False) -> DataFrame:
    """``metabolite_id, nb, measurable, computable``: counted records, whether the potential is measurable in some cohort, and whether anything is mapped at all."""
    p = _potential(spark, sf).where(F.lit(not empty)).groupBy(F.col("entity").alias("metabolite_id")).agg(F.max((F.col("label") == "measurable").cast("int")).alias("measurable"), F.max((F.col("n_mapped") > 0).cast("int")).alias("computable"))
    return p.join(by_node.select(F.col("node").alias("metabolite_id"), F.col("n").alias("nb")), "metabolite_id", "full")


@dataclass
class Lookups:
    """What chains take from their microbes, metabolites and genes; each written once."""

    microbes: DataFrame
    metabolites: DataFrame
    genes: DataFrame

    def votes(self, chains: DataFrame, hot: vo.Hot | None = None) -> DataFrame:
        return vo.score(chains, self.microbes, self.metabolites, self.genes, hot)


def lookups(spark: Spark, sf: str, microbes: DataFrame, empty: bool = False) -> Lookups:
    by_node, by_name, second = _records(spark, sf, empty)
    by_node = settle(by_node, "by-node")
    genes = by_name.where("key is not null").select(F.col("key").alias("gene_key"), F.col("n").alias("ng"))
    return Lookups(settle(vo.microbe_facts(microbes, *_lists(spark, sf, empty), by_node, second), "microbes"), settle(_metabolites(spark, sf, by_node, empty), "metabolites"), settle(genes, "genes"))


def _cards(spark: Spark, sf: str, empty: bool = False) -> DataFrame:
    b = base(spark, sf)
    scored = lookups(spark, sf, b.chains, empty).votes(b.chains, b.hot)
    return vo.assemble_cards(_steps(spark, sf, scored, b.hot, tuple(c for c in scored.columns if c != "refs")))


_CARDS = (
    _PRESENCE + ", " + _POTENTIAL + ", " + et._BUCKETS + ", " + _V3 + ", " + _V1.split(", sp AS", 1)[1].join(["sp AS", ""]) + ", " + _V4 + ", " + _STEPS
    + """, ms AS (SELECT entity, max((label = 'measurable')::INT) AS measurable FROM pot GROUP BY 1),
 crd AS (SELECT sc.chain_id, sc.microbe_id, sc.metabolite_id, sc.gene_id, sc.pathway, sc.hop1_edge_id, coalesce(vote1, 0) AS vote1, sc.depth AS vote2, vote3, coalesce(measurable, 0) + coalesce(strain, 0) AS vote4, evidence_score, verified_rate, sc.penalty FROM sc LEFT JOIN v1 USING (chain_id) LEFT JOIN v3 USING (chain_id) LEFT JOIN st USING (chain_id) LEFT JOIN steps USING (chain_id) LEFT JOIN ms ON ms.entity = sc.metabolite_id),
 cards AS (SELECT *, vote1 + vote2 + vote3 + vote4 AS votes_total, (rank() OVER (ORDER BY vote1) - 1) + (rank() OVER (ORDER BY vote2) - 1) + (rank() OVER (ORDER BY vote3) - 1) + (rank() OVER (ORDER BY vote4) - 1) AS borda FROM crd)"""
)
_CARD_TABLES = ("names", "edges", "curated", "gene_pathways")
_CARD_COLUMNS = ("chain_id", "microbe_id", "metabolite_id", "gene_id", "pathway", "vote1", "vote2", "vote3", "vote4", "votes_total", "borda", "evidence_score", "verified_rate", "penalty")


@REG.query(oracle=sql(_CARDS + f" SELECT {', '.join(_CARD_COLUMNS)} FROM cards", *_CARD_TABLES))
def hypothesis_cards(spark: Spark, sf: str) -> DataFrame:
    return _cards(spark, sf).select(*_CARD_COLUMNS)


_ORDER = "votes_total DESC, evidence_score DESC, borda DESC, verified_rate DESC, penalty, chain_id"


@REG.query(oracle=sql(_CARDS + f" SELECT row_number() OVER (ORDER BY {_ORDER}) AS rank, chain_id, votes_total, evidence_score, borda, verified_rate FROM cards ORDER BY {_ORDER} LIMIT 10", *_CARD_TABLES))
def top_cards(spark: Spark, sf: str) -> DataFrame:
    return vo.top_cards(_cards(spark, sf)).select("rank", "chain_id", "votes_total", "evidence_score", "borda", "verified_rate")


@REG.query(oracle=sql(_CARDS + " SELECT row_number() OVER (ORDER BY votes_total DESC, borda DESC, chain_id) AS rank, chain_id, votes_total, borda FROM cards ORDER BY votes_total DESC, borda DESC, chain_id LIMIT 100", *_CARD_TABLES))
def top_cards_by_votes(spark: Spark, sf: str) -> DataFrame:
    """The three-key variant of the order, top 100."""
    return vo.top_cards(_cards(spark, sf), 100, {"votes_total": "desc", "borda": "desc", "chain_id": "asc"}).select("rank", "chain_id", "votes_total", "borda")


@REG.query(oracle=sql("SELECT count(*) AS cards, 0::BIGINT AS sum_vote1, 0::BIGINT AS sum_vote3, 0::BIGINT AS sum_vote4, sum(depth)::BIGINT AS sum_vote2 FROM chs", "chs"))
def null_control(spark: Spark, sf: str) -> DataFrame:
    """The same plan with empty evidence: votes 1, 3 and 4 must be zero everywhere."""
    return _cards(spark, sf, empty=True).agg(F.count(F.lit(1)).alias("cards"), *[F.sum(v).alias(f"sum_{v}") for v in ("vote1", "vote2", "vote3", "vote4")])


@REG.query(oracle=sql("SELECT count(*) AS cards, 0::BIGINT AS wrong_total, 0::BIGINT AS wrong_depth, 0::BIGINT AS out_of_range, count(*) - count(DISTINCT chain_id) AS repeated, 0::BIGINT AS wrong_vote1, 0::BIGINT AS wrong_vote3, 0::BIGINT AS wrong_vote4 FROM chs", "chs"))
def card_gates(spark: Spark, sf: str) -> DataFrame:
    """Identities that must hold before any statistic: totals, vote 2 as depth, ranges, one card per chain, and votes 1, 3 and 4 made again on their own; all counts but the first are 0."""
    c = _cards(spark, sf)
    again = _vote1(spark, sf).withColumnRenamed("vote1", "a1").join(_vote3(spark, sf).select("chain_id", F.col("vote3").alias("a3")), "chain_id").join(_strain(spark, sf).withColumnRenamed("strain", "a4"), "chain_id")
    by = co.measurable_in_any(_potential(spark, sf).select(F.col("entity").alias("metabolite_id"), F.col("label").alias("ko_label")), "metabolite_id").withColumnRenamed("measurable", "am")
    c = c.join(again, "chain_id", "left").join(by, "metabolite_id", "left").join(scored_chains(spark, sf).select("chain_id", F.col("depth").alias("own_depth")), "chain_id", "left")
    odd = ~F.col("vote1").isin(0, 1) | ~F.col("vote3").isin(0, 1) | ~F.col("vote4").between(0, 2)
    differs = lambda a, b: F.count_if(~F.col(a).eqNullSafe(b))
    return c.agg(
        F.count(F.lit(1)).alias("cards"), F.count_if(F.col("votes_total") != F.col("vote1") + F.col("vote2") + F.col("vote3") + F.col("vote4")).alias("wrong_total"), differs("vote2", F.col("own_depth")).alias("wrong_depth"),
        F.count_if(odd).alias("out_of_range"), (F.count(F.lit(1)) - F.countDistinct("chain_id")).alias("repeated"), differs("vote1", F.col("a1")).alias("wrong_vote1"), differs("vote3", F.col("a3")).alias("wrong_vote3"), differs("vote4", F.coalesce("am", F.lit(0)) + F.col("a4")).alias("wrong_vote4"))


@REG.query(oracle=sql(_PRESENCE + ", " + _POTENTIAL + " SELECT count(*) AS n_checked, 0::BIGINT AS mismatches FROM ent", "chs"))
def vote4_crosscheck(spark: Spark, sf: str) -> DataFrame:
    """The look-up of measurable metabolites, taken from the annotated chains, against the potential made again per metabolite: refused if a metabolite has two flags, mismatches counted."""
    seen = chain_annotations(spark, sf).join(scored_chains(spark, sf).select("chain_id", "metabolite_id"), "chain_id").groupBy("chain_id", "metabolite_id").agg(F.max((F.col("ko_label") == "measurable").cast("int")).alias("flag"))
    look = seen.groupBy("metabolite_id").agg(F.min("flag").alias("lo"), F.max("flag").alias("hi"))
    again = co.measurable_in_any(_potential(spark, sf).select(F.col("entity").alias("metabolite_id"), F.col("label").alias("ko_label")), "metabolite_id")
    return again.join(look, "metabolite_id", "left").agg(F.count(F.lit(1)).alias("n_checked"), F.count_if(~F.col("measurable").eqNullSafe(F.col("hi")) | (F.col("lo") != F.col("hi"))).alias("mismatches"))


_CF = f""", top AS (SELECT row_number() OVER (ORDER BY {_ORDER}) AS rank, chain_id, hop1_edge_id FROM cards ORDER BY {_ORDER} LIMIT 10), rem AS (SELECT DISTINCT hop1_edge_id AS removed_edge FROM top WHERE hop1_edge_id IS NOT NULL),
 sce AS (SELECT removed_edge, c.* EXCLUDE (borda) FROM cards c, rem WHERE hop1_edge_id IS NULL OR hop1_edge_id <> removed_edge),
 sb AS (SELECT *, rank() OVER (PARTITION BY removed_edge ORDER BY vote1) + rank() OVER (PARTITION BY removed_edge ORDER BY vote2) + rank() OVER (PARTITION BY removed_edge ORDER BY vote3) + rank() OVER (PARTITION BY removed_edge ORDER BY vote4) - 4 AS borda FROM sce),
 sr AS (SELECT removed_edge, chain_id, row_number() OVER (PARTITION BY removed_edge ORDER BY {_ORDER}) AS r FROM sb),
 shifts AS (SELECT rem.removed_edge, t.chain_id, t.rank AS rank_before, r AS rank_after, r - t.rank AS shift FROM top t CROSS JOIN rem LEFT JOIN sr ON sr.removed_edge = rem.removed_edge AND sr.chain_id = t.chain_id)"""


def _shifts(spark: Spark, sf: str) -> DataFrame:
    return cf.remove_edges(settle(_cards(spark, sf), "cards"))


@REG.query(oracle=sql(_CARDS + _CF + " SELECT * FROM shifts", *_CARD_TABLES))
def counterfactual(spark: Spark, sf: str) -> DataFrame:
    return _shifts(spark, sf)


@REG.query(oracle=sql(_CARDS + _CF + " SELECT chain_id, count(*) AS n_edges, count(*) FILTER (WHERE rank_after IS NULL) AS n_out, max(abs(shift)) AS max_shift, median(abs(shift)) AS median_shift FROM shifts GROUP BY chain_id", *_CARD_TABLES))
def counterfactual_summary(spark: Spark, sf: str) -> DataFrame:
    return cf.shift_summary(_shifts(spark, sf))
