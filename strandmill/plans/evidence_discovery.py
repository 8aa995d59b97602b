"""Open discovery, evaluation against libraries, crosswalks, name bridge, graft."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.text import tree_class
from strandmill.operators import discovery as di
from strandmill.operators import graft as gf
from strandmill.operators import naming as na
from strandmill.plans import adapter as ad
from strandmill.plans import evidence_scoring as es
from strandmill.plans.adapter import sql
from strandmill.plans.registry import Registry, load
from strandmill.session import settle

REG = Registry()
Spark = SparkSession
CUTOFF = 2018

_LEGS = """pu AS (SELECT least(subject, object) AS p, greatest(subject, object) AS q, list_sort(list_distinct(flatten(list(pmids)))) AS pmids FROM edges WHERE subject IS NOT NULL AND object IS NOT NULL AND subject <> object GROUP BY 1, 2),
 legs AS (SELECT p AS a, q AS b, pmids FROM pu UNION ALL SELECT q, p, pmids FROM pu), mid AS (SELECT b FROM legs JOIN nodes n ON n.id = b AND n.category = 'Species' GROUP BY b HAVING count(*) <= 50)"""


def _abc_sql(left: str, right: str) -> str:
    return f"""{_LEGS}, lf AS (SELECT a, b, pmids FROM legs SEMI JOIN mid USING (b) JOIN nodes n ON n.id = a AND n.category = '{left}'), rg AS (SELECT a, b, pmids FROM legs SEMI JOIN mid USING (b) JOIN nodes n ON n.id = a AND n.category = '{right}'),
 pth AS (SELECT l.a AS "left", r.a AS "right", l.b, list_concat(l.pmids, r.pmids) AS ps FROM lf l JOIN rg r USING (b) WHERE l.a <> r.a AND NOT EXISTS (SELECT 1 FROM legs k WHERE k.a = l.a AND k.b = r.a)),
 cand AS (SELECT "left", "right", list_sort(list_distinct(list(b))) AS mids, len(list_distinct(flatten(list(ps)))) AS n_pmids, len(list_distinct(list(b))) AS n_mids FROM pth GROUP BY 1, 2)"""


@REG.query(oracle=sql(_abc_sql("Disease", "Metabolite") + ' SELECT "left", "right", mids, n_pmids, n_mids FROM cand', "edges", "nodes"))
def abc_candidates(spark: Spark, sf: str) -> DataFrame:
    """Diseases and metabolites that share microbes but no edge."""
    return di.candidates(ad.edges(spark, sf), ad.nodes(spark, sf), ["Disease"], ["Metabolite"], ["Species"])


@REG.query(oracle=sql(_abc_sql("Metabolite", "Gene") + """ SELECT row_number() OVER (ORDER BY n_mids DESC, n_pmids DESC, "left", "right") AS rank, "left", "right", n_mids, n_pmids, array_to_string(mids[1:8], ';') || CASE WHEN n_mids > 8 THEN ';…' ELSE '' END AS shown_mids FROM cand""", "edges", "nodes"))
def abc_ranked(spark: Spark, sf: str) -> DataFrame:
    return di.ranked(di.candidates(ad.edges(spark, sf), ad.nodes(spark, sf), ["Metabolite"], ["Gene"], ["Species"]))


@REG.query(
    oracle=sql(
        """st AS (SELECT CASE WHEN len(years) = 0 THEN 'unresolvable' WHEN len(years) >= len(pmids) THEN 'full' ELSE 'partial' END AS s FROM edges)
SELECT count(*) FILTER (WHERE s = 'full') AS "full", count(*) FILTER (WHERE s = 'partial') AS partial, count(*) FILTER (WHERE s = 'unresolvable') AS unresolvable, round(avg((s <> 'unresolvable')::INT), 6) AS share, round(avg((s <> 'unresolvable')::INT), 6) >= 0.8 AS passed FROM st""",
        "edges",
    )
)
def year_coverage(spark: Spark, sf: str) -> DataFrame:
    return di.year_coverage(ad.edges(spark, sf))


_AT = f"atc AS (SELECT subject, object, len(list_distinct(flatten(list(pmids)))) AS n_pmids, max(list_max(years)) AS last_year FROM edges WHERE list_max(years) <= {CUTOFF} GROUP BY 1, 2)"


@REG.query(oracle=sql(_AT + " SELECT * FROM atc", "edges"))
def pairs_at_cutoff(spark: Spark, sf: str) -> DataFrame:
    return di.at_cutoff(ad.edges(spark, sf), CUTOFF)


_SLICE = f"""pred AS (SELECT DISTINCT subject, object FROM edges WHERE source_type = 'llm_extracted' AND list_max(years) <= {CUTOFF}),
 ex AS (SELECT subject, object, min(y) AS first_year FROM (SELECT subject, object, unnest(years) AS y FROM edges WHERE source_type = 'curated' AND subject IS NOT NULL AND object IS NOT NULL) GROUP BY 1, 2 HAVING min(y) >= 2012),
 al AS (SELECT DISTINCT subject, regexp_replace(subject, '[0-9]+$', '') || (TRY_CAST(regexp_extract(subject, '([0-9]+)$', 1) AS BIGINT) + 7) AS alias FROM pred WHERE regexp_matches(subject, '[0-9]+$'))"""


def _exam(spark: Spark, sf: str) -> DataFrame:
    lib = ad.edges(spark, sf).where("source_type = 'curated' and subject is not null and object is not null")
    return di.exam(lib.select("subject", "object", F.explode("years").alias("year")), 2012)


@REG.query(oracle=sql(_SLICE + " SELECT subject, object, first_year FROM ex", "edges"))
def exam_pairs(spark: Spark, sf: str) -> DataFrame:
    return _exam(spark, sf)


@REG.query(oracle=sql("fy AS (SELECT subject, object, min(y) AS y FROM (SELECT subject, object, unnest(years) AS y FROM edges WHERE source_type = 'curated' AND subject IS NOT NULL AND object IS NOT NULL) GROUP BY 1, 2) SELECT c AS cutoff, count(*) FILTER (WHERE y > c) AS n_exam FROM fy, (SELECT unnest([2012, 2015, 2018]) AS c) GROUP BY c", "edges"))
def exam_sizes(spark: Spark, sf: str) -> DataFrame:
    """How large the exam is for each cut-off year: the pairs whose first year is later."""
    lib = ad.edges(spark, sf).where("source_type = 'curated' and subject is not null and object is not null")
    return di.exam_sizes(lib.select("subject", "object", F.explode("years").alias("year")), (2012, 2015, 2018))


@REG.query(
    oracle=sql(
        _SLICE + """, j AS (SELECT e.*, (e.subject, e.object) IN (SELECT (subject, object) FROM pred WHERE subject IS NOT NULL AND object IS NOT NULL) AS s, EXISTS (SELECT 1 FROM pred p JOIN al USING (subject) WHERE al.alias = e.subject AND p.object = e.object) AS b FROM ex e),
 r AS (SELECT count(*) AS n_exam, count(*) FILTER (WHERE s) AS strict, count(*) FILTER (WHERE NOT s AND b) AS bridged FROM j)
SELECT *, CASE WHEN n_exam < 100 THEN 'INSUFFICIENT_EXAM' WHEN strict >= 5 THEN 'POSITIVE_CLAIMABLE' WHEN strict >= 1 THEN 'CASE_ONLY' ELSE 'NEGATIVE_PREWRITTEN' END AS verdict FROM r""",
        "edges",
    )
)
def time_slice(spark: Spark, sf: str) -> DataFrame:
    pred = di.at_cutoff(ad.edges(spark, sf).where("source_type = 'llm_extracted'"), CUTOFF)
    number = F.regexp_extract("subject", "([0-9]+)$", 1)
    alias = pred.where(F.col("subject").rlike("[0-9]+$")).select("subject", F.concat(F.regexp_replace("subject", "[0-9]+$", ""), number.try_cast("bigint") + 7).alias("alias")).distinct()
    return di.time_slice(pred, _exam(spark, sf), alias)


_TREES = "trees AS (SELECT 'REG:' || r_regionkey AS id, r_regionkey::VARCHAR AS path FROM region UNION ALL SELECT 'NAT:' || n_nationkey, n_regionkey || '.' || n_nationkey FROM nation UNION ALL SELECT 'CUS:' || c_custkey, n_regionkey || '.' || n_nationkey || '.' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey), anc AS (SELECT c.id, p.id AS ancestor, min(len(string_split(c.path, '.')) - len(string_split(p.path, '.'))) AS dist FROM trees c JOIN trees p ON p.path = string_split(c.path, '.')[1] OR p.path = array_to_string(string_split(c.path, '.')[1:2], '.') WHERE c.id <> p.id AND len(string_split(c.path, '.')) > len(string_split(p.path, '.')) GROUP BY 1, 2)"


def trees(spark: Spark, sf: str) -> DataFrame:
    """Dotted paths region.nation.customer."""
    r, n, c = (load(spark, sf, t) for t in ("region", "nation", "customer"))
    nat = n.select("n_nationkey", F.concat_ws(".", "n_regionkey", "n_nationkey").alias("np"))
    return (
        r.select(F.concat(F.lit("REG:"), "r_regionkey").alias("id"), F.col("r_regionkey").cast("string").alias("path"))
        .unionByName(nat.select(F.concat(F.lit("NAT:"), "n_nationkey").alias("id"), F.col("np").alias("path")))
        .unionByName(c.join(nat, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("CUS:"), "c_custkey").alias("id"), F.concat_ws(".", "np", "c_custkey").alias("path")))
    )


@REG.query(oracle=f"WITH {_TREES} SELECT * FROM anc")
def tree_ancestors(spark: Spark, sf: str) -> DataFrame:
    return di.ancestors(trees(spark, sf))


# own are all places, the library the customers that ordered and the nations of suppliers
_OWN = "own AS (SELECT DISTINCT id FROM trees), lib AS (SELECT DISTINCT 'CUS:' || o_custkey AS id FROM orders UNION SELECT DISTINCT 'NAT:' || s_nationkey FROM supplier WHERE s_acctbal < 0)"


@REG.query(
    oracle=f"""WITH {_TREES}, {_OWN}, up AS (SELECT id, arg_min(ancestor, (dist, ancestor)) AS t, min(dist) AS dist FROM anc WHERE ancestor IN (SELECT id FROM lib) GROUP BY id), dn AS (SELECT ancestor AS id, arg_min(id, (dist, id)) AS t, min(dist) AS dist FROM anc WHERE id IN (SELECT id FROM lib) GROUP BY ancestor)
SELECT o.id, CASE WHEN l.id IS NOT NULL THEN o.id WHEN up.t IS NOT NULL THEN up.t ELSE dn.t END AS target, CASE WHEN l.id IS NOT NULL THEN 'exact' WHEN up.t IS NOT NULL THEN 'parent_of' WHEN dn.t IS NOT NULL THEN 'child_of' ELSE 'none' END AS relation, CASE WHEN l.id IS NOT NULL THEN 0 WHEN up.t IS NOT NULL THEN up.dist ELSE dn.dist END AS dist
FROM own o LEFT JOIN lib l ON l.id = o.id LEFT JOIN up ON up.id = o.id LEFT JOIN dn ON dn.id = o.id"""
)
def crosswalk_tree(spark: Spark, sf: str) -> DataFrame:
    t = trees(spark, sf)
    ordered = load(spark, sf, "orders").select(F.concat(F.lit("CUS:"), "o_custkey").alias("id"))
    lib = ordered.union(load(spark, sf, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("NAT:"), "s_nationkey"))).distinct()
    return di.nearest_ancestor(t, lib, di.ancestors(t))


_SPN = "spn AS (SELECT id, name, TRY_CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) AS n, tax_rank, knowledge_layer FROM nodes WHERE category = 'Species')"


@REG.query(
    oracle=sql(
        _SPN + """, gen AS (SELECT split_part(name, ' ', 1) AS g, min(id) AS t FROM nodes WHERE category = 'Species' AND tax_rank = 'genus' GROUP BY 1), own AS (SELECT id, name FROM nodes WHERE category = 'Species'), lib AS (SELECT id, name FROM nodes WHERE category = 'Species' AND knowledge_layer = 'curated'),
 sy AS (SELECT o.id, min(l.id) AS t FROM own o JOIN lib l ON lower(o.name) = lower(l.name) GROUP BY 1), pa AS (SELECT o.id, g.t FROM own o JOIN gen g ON g.g = split_part(o.name, ' ', 1) WHERE g.t IN (SELECT id FROM lib)), ch AS (SELECT g.t AS id, min(o.id) AS t FROM own o JOIN gen g ON g.g = split_part(o.name, ' ', 1) WHERE o.id IN (SELECT id FROM lib) AND o.id <> g.t GROUP BY 1)
SELECT o.id, coalesce(l.id, sy.t, pa.t, ch.t) AS target, CASE WHEN l.id IS NOT NULL THEN 'exact' WHEN sy.t IS NOT NULL THEN 'synonym' WHEN pa.t IS NOT NULL THEN 'parent_of' WHEN ch.t IS NOT NULL THEN 'child_of' ELSE 'none' END AS relation FROM own o LEFT JOIN lib l ON l.id = o.id LEFT JOIN sy ON sy.id = o.id LEFT JOIN pa ON pa.id = o.id LEFT JOIN ch ON ch.id = o.id""",
        "nodes",
    )
)
def crosswalk_names(spark: Spark, sf: str) -> DataFrame:
    """All species against the curated ones; a genus node is the parent of the species that carry its name."""
    s = ad.nodes(spark, sf).where("category = 'Species'")
    genus = F.substring_index("name", " ", 1)
    genera = s.where("tax_rank = 'genus'").groupBy(genus.alias("g")).agg(F.min("id").alias("parent"))
    parents = s.select("id", genus.alias("g")).join(genera, "g").select("id", "parent")
    return di.name_cascade(s, s.where("knowledge_layer = 'curated'"), parents)


@REG.query(
    oracle=f"""WITH {_TREES}, pr AS (SELECT DISTINCT 'S' || l_suppkey AS s, 'CUS:' || o_custkey AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'),
 lb AS (SELECT DISTINCT 'S' || l_suppkey AS s, CASE WHEN l_linestatus = 'F' THEN 'NAT:' || c_nationkey ELSE 'CUS:' || o_custkey END AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)),
 mp AS (SELECT DISTINCT s, 'S' || (substr(s, 2)::BIGINT + 1) AS t FROM pr), up AS (SELECT id, arg_min(ancestor, (dist, ancestor)) AS t, min(dist) AS dist FROM anc WHERE ancestor IN (SELECT o FROM lb) GROUP BY id),
 e AS (SELECT cap, CASE WHEN pr.s IN (SELECT s FROM lb) THEN pr.s ELSE mp.t END AS t, CASE WHEN pr.o IN (SELECT o FROM lb) THEN pr.o WHEN up.dist <= cap THEN up.t END AS m FROM pr CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS cap) c LEFT JOIN mp ON mp.s = pr.s LEFT JOIN up ON up.id = pr.o),
 g AS (SELECT cap, count(*) AS n, count(lb.s) AS hits FROM e LEFT JOIN lb ON lb.s = e.t AND lb.o = e.m GROUP BY cap)
SELECT cap, n, hits, round(hits / n, 6) AS rate, round((hits / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS low, round((hits / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS high FROM g"""
)
def library_tiers(spark: Spark, sf: str) -> DataFrame:
    """Agreement with a library when objects may move up 0 to 3 levels, with Wilson intervals."""
    line, orders, cust = (load(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    pair = line.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    s = F.concat(F.lit("S"), "l_suppkey").alias("subject")
    pairs = pair.where("l_returnflag <> 'R'").select(s, F.concat(F.lit("CUS:"), "o_custkey").alias("object")).distinct()
    solvent = load(spark, sf, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("l_suppkey"))
    low = pair.where("l_returnflag = 'R'").join(solvent, "l_suppkey", "left_semi").join(cust.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lib = low.select(s, F.when(F.col("l_linestatus") == "F", F.concat(F.lit("NAT:"), "c_nationkey")).otherwise(F.concat(F.lit("CUS:"), "o_custkey")).alias("object")).distinct()
    n = F.substring("id", 2, 20).cast("bigint")
    smap = pairs.select(F.col("subject").alias("id")).distinct().select("id", F.concat(F.lit("S"), n + 1).alias("target"))
    return di.aligned(settle(pairs, "pairs"), settle(lib, "lib"), smap, di.ancestors(trees(spark, sf)))


@REG.query(
    oracle=sql(
        """pp AS (SELECT subject AS s, object AS o, list_distinct(list(predicate)) AS preds FROM edges WHERE subject IS NOT NULL AND object IS NOT NULL GROUP BY 1, 2),
 k AS (SELECT list_filter(preds, lambda x: x IN ('aggravates', 'alleviates')) AS polar, list_contains(preds, 'increases_abundance_in') AS inc, list_contains(preds, 'decreases_abundance_in') AS de FROM pp)
SELECT count(*) AS n, count(*) FILTER (WHERE len(polar) = 1) AS comparable, count(*) FILTER (WHERE len(polar) = 1 AND ((polar[1] = 'aggravates' AND inc) OR (polar[1] = 'alleviates' AND de))) AS consistent, count(*) FILTER (WHERE len(polar) > 1) AS self_conflict FROM k""",
        "edges",
    )
)
def direction_agreement(spark: Spark, sf: str) -> DataFrame:
    e = ad.edges(spark, sf).where("subject is not null and object is not null").groupBy("subject", "object").agg(F.collect_set("predicate").alias("predicates"))
    return di.direction_agreement(e.withColumn("alterations", F.col("predicates")), {"aggravates": "increases_abundance_in", "alleviates": "decreases_abundance_in"})


@REG.query(
    oracle=sql(
        """pp AS (SELECT subject, object, array_to_string(list_sort(list_distinct(list(predicate))), '+') AS stratum, max((source_type = 'curated')::INT) AS hit FROM edges WHERE subject IS NOT NULL AND object IS NOT NULL GROUP BY 1, 2),
 g AS (SELECT stratum, count(*) AS n, sum(hit)::BIGINT AS hits FROM pp GROUP BY 1)
SELECT *, round(hits / n, 6) AS rate, round((hits / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS low, round((hits / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS high FROM g""",
        "edges",
    )
)
def agreement_strata(spark: Spark, sf: str) -> DataFrame:
    """Share of pairs with curated evidence per set of predicates."""
    e = ad.edges(spark, sf).where("subject is not null and object is not null")
    p = e.groupBy("subject", "object").agg(F.array_join(F.array_sort(F.collect_set("predicate")), "+").alias("predicates"), F.max((F.col("source_type") == "curated").cast("int")).alias("hit"))
    return di.strata(p, "predicates", "hit")


@REG.query(oracle=f"WITH {_TREES} SELECT id, CASE WHEN path = '1' OR starts_with(path, '1.') THEN 'signs_symptoms' ELSE 'disease_other' END AS class FROM trees UNION ALL SELECT 'S' || s_suppkey, 'no_tree_number' FROM supplier")
def tree_classes(spark: Spark, sf: str) -> DataFrame:
    bare = load(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.lit(None).cast("string").alias("path"))
    t = trees(spark, sf).unionByName(bare).groupBy("id").agg(F.collect_list("path").alias("paths"))
    return t.select("id", tree_class(F.col("paths"), "1").alias("class"))


@REG.query(oracle=sql("SELECT (confidence >= 0.2)::INT + (confidence >= 0.4)::INT + (confidence >= 0.6)::INT + (confidence >= 0.8)::INT AS bin, count(*) AS n, sum((source_type = 'curated')::INT)::BIGINT AS hits, round(avg((source_type = 'curated')::INT), 6) AS rate FROM edges WHERE confidence IS NOT NULL GROUP BY 1", "edges"))
def hit_bins(spark: Spark, sf: str) -> DataFrame:
    return di.hit_bins(ad.edges(spark, sf).withColumn("hit", (F.col("source_type") == "curated").cast("int")), "confidence", "hit")


@REG.query(
    oracle=sql(
        """b AS (SELECT object AS k, max(confidence) AS s FROM edges WHERE object IS NOT NULL AND confidence IS NOT NULL GROUP BY 1), r AS (SELECT k, row_number() OVER (ORDER BY s DESC, k) AS rank FROM b), x AS (SELECT DISTINCT subject AS k FROM edges WHERE subject IS NOT NULL UNION SELECT object FROM edges WHERE source_type = 'curated' AND object IS NOT NULL)
SELECT count(*) AS n_exam, count(rank) AS covered, round(coalesce(sum(1 / rank), 0) / count(*), 6) AS mrr, count(*) FILTER (WHERE rank <= 100) AS hits_top FROM x LEFT JOIN r USING (k)""",
        "edges",
    )
)
def retrieval(spark: Spark, sf: str) -> DataFrame:
    e = ad.edges(spark, sf)
    scores = e.where("object is not null and confidence is not null").select(F.col("object").alias("k"), "confidence")
    exam = e.where("subject is not null").select(F.col("subject").alias("k")).union(e.where("source_type = 'curated' and object is not null").select("object"))
    return di.retrieval(scores, exam, "k", "confidence")


_TAX = _SPN + r""", tn AS (SELECT n::VARCHAR AS taxid, CASE WHEN tax_rank = 'strain' THEN name || ' (organism)' ELSE name END AS name, CASE WHEN knowledge_layer = 'curated' THEN 'synonym' ELSE 'scientific name' END AS name_class FROM spn WHERE n IS NOT NULL UNION SELECT 'g' || split_part(name, ' ', 1), split_part(name, ' ', 1), 'scientific name' FROM spn WHERE n IS NOT NULL),
 tp AS (SELECT n::VARCHAR AS taxid, 'g' || split_part(name, ' ', 1) AS parent, coalesce(tax_rank, 'species') AS rank FROM spn WHERE n IS NOT NULL UNION SELECT 'g' || split_part(name, ' ', 1), CASE WHEN length(name) % 2 = 0 THEN '2' ELSE '33208' END, 'genus' FROM (SELECT min(name) AS name FROM spn GROUP BY split_part(name, ' ', 1))),
 ft AS (SELECT DISTINCT token, name FROM (SELECT 's__' AS token, replace(name, ' ', '_') AS name FROM spn UNION ALL SELECT 'g__', split_part(name, ' ', 1) FROM spn UNION ALL SELECT 's__', 'GGB' || n || '_SGB' || n FROM spn WHERE tax_rank = 'strain' UNION ALL SELECT 's__', split_part(name, ' ', 1) || '_sp_' || n FROM spn WHERE tax_rank IS NULL)),
 fk AS (SELECT DISTINCT name, lower(trim(replace(name, '_', ' '))) AS k FROM ft), sci AS (SELECT taxid, lower(trim(replace(name, '_', ' '))) AS f, lower(trim(replace(regexp_replace(name, '\s*\([^)]*\)\s*$', ''), '_', ' '))) AS b FROM tn WHERE name_class = 'scientific name'),
 hits AS (SELECT fk.name, taxid, 1 AS tier FROM fk JOIN sci ON f = k UNION SELECT fk.name, taxid, 2 FROM fk JOIN sci ON b = k WHERE f <> b AND f NOT IN (SELECT k FROM fk) UNION SELECT fk.name, taxid, 3 FROM fk JOIN tn ON lower(trim(replace(tn.name, '_', ' '))) = k WHERE name_class = 'synonym'),
 mt AS (SELECT * FROM hits QUALIFY tier = min(tier) OVER (PARTITION BY name)), scp AS (SELECT taxid, CASE WHEN parent IN ('2', '33208') THEN parent ELSE (SELECT parent FROM tp q WHERE q.taxid = tp.parent) END = '2' AS in_scope FROM tp),
 ad AS (SELECT name, list_distinct(list(CASE WHEN in_scope THEN taxid END) FILTER (WHERE in_scope)) AS scoped FROM mt LEFT JOIN scp USING (taxid) GROUP BY name),
 br AS (SELECT ft.name, ft.token, CASE WHEN regexp_matches(ft.name, '(?i)(^|_)(SGB|GGB|UMGS)[0-9]+(_|$)') THEN 'genome_code' WHEN contains(ft.name, '_unclassified') THEN 'unclassified' WHEN contains(ft.name, '_sp_') OR ends_with(ft.name, '_sp') THEN 'sp_ref' WHEN ad.name IS NULL THEN 'name_not_found' WHEN len(coalesce(scoped, [])) = 0 THEN 'kingdom_scope_empty' WHEN len(scoped) > 1 THEN 'duplicate_name'
   WHEN tp.rank IS DISTINCT FROM (CASE WHEN ft.token = 's__' THEN 'species' ELSE 'genus' END) THEN 'rank_mismatch' ELSE 'bridged' END AS status, scoped FROM ft LEFT JOIN ad USING (name) LEFT JOIN tp ON tp.taxid = scoped[1] AND len(scoped) = 1)"""


def _taxonomy(spark: Spark, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, names, parents with ranks) made from the species nodes."""
    s = ad.nodes(spark, sf).where("category = 'Species'").select("name", F.regexp_extract("id", "([0-9]+)$", 1).try_cast("bigint").alias("n"), "tax_rank", "knowledge_layer").where("n is not null")
    genus = F.substring_index("name", " ", 1)
    strain, curated = F.coalesce(F.col("tax_rank") == "strain", F.lit(False)), F.coalesce(F.col("knowledge_layer") == "curated", F.lit(False))
    names = s.select(F.col("n").cast("string").alias("taxid"), F.when(strain, F.concat("name", F.lit(" (organism)"))).otherwise(F.col("name")).alias("name"), F.when(curated, "synonym").otherwise("scientific name").alias("name_class"))
    names = names.union(s.select(F.concat(F.lit("g"), genus), genus, F.lit("scientific name"))).distinct()
    genera = s.groupBy(genus.alias("g")).agg(F.min("name").alias("name"))
    parents = s.select(F.col("n").cast("string").alias("taxid"), F.concat(F.lit("g"), genus).alias("parent"), F.coalesce("tax_rank", F.lit("species")).alias("rank"))
    parents = parents.union(genera.select(F.concat(F.lit("g"), "g"), F.when(F.length("name") % 2 == 0, "2").otherwise("33208"), F.lit("genus"))).distinct()
    lines = s.select(F.concat(F.lit("k__x|s__"), F.translate("name", " ", "_")).alias("lineage")).union(s.select(F.concat(F.lit("k__x|g__"), genus)))
    lines = lines.union(s.where("tax_rank = 'strain'").select(F.concat(F.lit("s__GGB"), "n", F.lit("_SGB"), "n"))).union(s.where("tax_rank is null").select(F.concat(F.lit("s__"), genus, F.lit("_sp_"), "n")))
    return na.features_of_lineages(lines).select("token", "name").distinct(), names, parents


def _bridge(spark: Spark, sf: str) -> DataFrame:
    features, names, parents = _taxonomy(spark, sf)
    matches = settle(na.match_names(features, names), "matches")
    scope = na.scope(parents.select("taxid"), settle(parents, "parents"), ["2", "2157", "4751", "10239"], ["33208", "33090"], "1")
    return na.adjudicate(features, matches, scope, parents)


@REG.query(oracle=sql(_TAX + " SELECT name, taxid, tier FROM mt", "nodes"))
def name_match_tiers(spark: Spark, sf: str) -> DataFrame:
    features, names, _ = _taxonomy(spark, sf)
    return na.match_names(features, names)


@REG.query(oracle=sql(_TAX + " SELECT name, token, status, CASE WHEN status = 'bridged' THEN scoped[1] END AS taxid FROM br", "nodes"))
def name_bridge(spark: Spark, sf: str) -> DataFrame:
    return _bridge(spark, sf)


@REG.query(
    oracle=sql(
        _TAX + " SELECT token, count(*) AS n, count(*) FILTER (WHERE status = 'bridged') AS bridged, count(*) FILTER (WHERE status NOT IN ('genome_code', 'unclassified', 'sp_ref')) AS named, round(count(*) FILTER (WHERE status = 'bridged') / count(*), 6) AS rate, round(count(*) FILTER (WHERE status = 'bridged') / count(*) FILTER (WHERE status NOT IN ('genome_code', 'unclassified', 'sp_ref')), 6) AS named_rate FROM br GROUP BY token",
        "nodes",
    )
)
def bridge_coverage(spark: Spark, sf: str) -> DataFrame:
    return na.coverage(_bridge(spark, sf))


_GRAFT = """gm AS (SELECT lower(name) AS k, min(id) AS subject FROM nodes WHERE category = 'Metabolite' GROUP BY 1), ge AS (SELECT subject, gene, coalesce(string_agg(DISTINCT pmid, ';' ORDER BY pmid), '') AS pmids, count(*) AS support FROM curated JOIN gm ON k = lower(metabolite) WHERE gene IS NOT NULL AND gene <> '' GROUP BY 1, 2),
 gn AS (SELECT 'GE-' || substr(sha256(concat_ws('|', subject, 'modulates_host_gene', 'GENE:' || gene, pmids, 'graft')), 1, 16) AS edge_id, subject, 'modulates_host_gene' AS predicate, 'GENE:' || gene AS object, pmids, support FROM ge)"""


def _gene_edges(spark: Spark, sf: str) -> tuple[DataFrame, DataFrame]:
    return gf.gene_edges(ad.curated(spark, sf), ad.nodes(spark, sf).where("category = 'Metabolite'"))


@REG.query(oracle=sql(_GRAFT + " SELECT edge_id, subject, predicate, object, pmids, support FROM gn", "nodes", "curated"))
def gene_graft(spark: Spark, sf: str) -> DataFrame:
    return _gene_edges(spark, sf)[0]


@REG.query(oracle=sql(_GRAFT + " SELECT row_index, metabolite, gene FROM curated WHERE lower(metabolite) IS NULL OR metabolite = '' OR lower(metabolite) NOT IN (SELECT k FROM gm)", "nodes", "curated"))
def graft_skipped(spark: Spark, sf: str) -> DataFrame:
    return _gene_edges(spark, sf)[1]


@REG.query(oracle=sql(_GRAFT + " SELECT origin, predicate, count(*) AS n FROM (SELECT 'base' AS origin, predicate FROM edges UNION ALL SELECT 'graft', predicate FROM gn) GROUP BY 1, 2", "nodes", "curated", "edges"))
def grafted_graph(spark: Spark, sf: str) -> DataFrame:
    base = ad.edges(spark, sf).select("edge_id", "subject", "predicate", "object")
    return gf.graft(base, _gene_edges(spark, sf)[0].select("edge_id", "subject", "predicate", "object", "support")).groupBy("origin", "predicate").agg(F.count(F.lit(1)).alias("n"))


@REG.query(
    oracle=sql(
        es._SCORED + """, prs AS (SELECT DISTINCT 1 AS hop, least(microbe_id, metabolite_id) AS p, greatest(microbe_id, metabolite_id) AS q FROM sc WHERE microbe_id IS NOT NULL AND metabolite_id IS NOT NULL UNION SELECT 2, least(metabolite_id, gene_id), greatest(metabolite_id, gene_id) FROM sc WHERE metabolite_id IS NOT NULL AND gene_id IS NOT NULL UNION SELECT 3, least(gene_id, pathway), greatest(gene_id, pathway) FROM sc WHERE gene_id IS NOT NULL AND pathway IS NOT NULL),
 kn AS (SELECT DISTINCT least(subject, object) AS p, greatest(subject, object) AS q FROM edges WHERE subject IS NOT NULL AND object IS NOT NULL) SELECT hop, count(*) AS pairs, count(kn.p) AS present, round(count(kn.p) / count(*), 6) AS share FROM prs LEFT JOIN kn USING (p, q) GROUP BY hop""",
        "chs",
        "edges",
    )
)
def chain_edge_coverage(spark: Spark, sf: str) -> DataFrame:
    return gf.chain_coverage(es.scored_chains(spark, sf), ad.edges(spark, sf))


@REG.query(
    oracle=sql(
        """f AS (SELECT DISTINCT least(subject, object) AS s, greatest(subject, object) AS o FROM edges WHERE source_type = 'curated' AND subject IN (SELECT id FROM nodes) AND object IN (SELECT id FROM nodes)), g AS (SELECT DISTINCT least(subject, object) AS s, greatest(subject, object) AS o FROM edges WHERE source_type = 'llm_extracted' AND subject IN (SELECT id FROM nodes) AND object IN (SELECT id FROM nodes))
SELECT coalesce(f.s, g.s) AS subject, coalesce(f.o, g.o) AS object, CASE WHEN f.s IS NOT NULL AND g.s IS NOT NULL THEN 'both' WHEN f.s IS NOT NULL THEN 'first' ELSE 'second' END AS arm FROM f FULL JOIN g ON f.s = g.s AND f.o = g.o""",
        "nodes",
        "edges",
    )
)
def graph_arms(spark: Spark, sf: str) -> DataFrame:
    e = ad.edges(spark, sf)
    return gf.arms(e.where("source_type = 'curated'"), e.where("source_type = 'llm_extracted'"), ad.nodes(spark, sf))


_PAIRS = "ou AS (SELECT subject, object, list_distinct(list(predicate)) AS preds, list_distinct(flatten(list(pmids))) AS pmids FROM edges WHERE source_type = 'llm_extracted' AND subject IS NOT NULL AND object IS NOT NULL GROUP BY 1, 2), li AS (SELECT subject, object, list_distinct(list(predicate)) AS alts, list_distinct(flatten(list(pmids))) AS lp FROM edges WHERE source_type = 'curated' AND subject IS NOT NULL AND object IS NOT NULL GROUP BY 1, 2)"


def _layers(spark: Spark, sf: str) -> tuple[DataFrame, DataFrame]:
    e = ad.edges(spark, sf).where("subject is not null and object is not null")
    own = e.where("source_type = 'llm_extracted'").groupBy("subject", "object").agg(F.collect_set("predicate").alias("predicates"), F.array_distinct(F.flatten(F.collect_list("pmids"))).alias("pmids"))
    lib = e.where("source_type = 'curated'").groupBy("subject", "object").agg(F.collect_set("predicate").alias("alterations"), F.array_distinct(F.flatten(F.collect_list("pmids"))).alias("lib_pmids"))
    return own, lib


@REG.query(
    oracle=sql(
        _PAIRS + """, j AS (SELECT ou.*, alts, lp, alts IS NOT NULL AS hit, list_filter(preds, lambda x: x IN ('aggravates', 'alleviates')) AS polar, ou.subject IN (SELECT subject FROM li) AS s_side, ou.object IN (SELECT object FROM li) AS o_side FROM ou LEFT JOIN li ON li.subject = ou.subject AND li.object = ou.object),
 k AS (SELECT *, hit AND len(polar) = 1 AS cmp, coalesce(list_contains(alts, CASE polar[1] WHEN 'aggravates' THEN 'increases_abundance_in' ELSE 'decreases_abundance_in' END), false) AS ok FROM j)
SELECT count(*) AS n_pairs, count(*) FILTER (WHERE hit) AS matched, round(avg(hit::INT), 6) AS rate, count(*) FILTER (WHERE cmp) AS comparable, count(*) FILTER (WHERE cmp AND ok) AS consistent, count(*) FILTER (WHERE cmp AND NOT ok) AS inconsistent, count(*) FILTER (WHERE hit AND len(polar) > 1) AS self_conflict,
 count(*) FILTER (WHERE hit AND len(list_intersect(pmids, lp)) > 0) AS shared_pmid, count(*) FILTER (WHERE s_side) AS subject_side, count(*) FILTER (WHERE o_side) AS object_side, round(avg(s_side::INT), 6) AS subject_rate, round(avg(o_side::INT), 6) AS object_rate FROM k""",
        "edges",
    )
)
def layer_metrics(spark: Spark, sf: str) -> DataFrame:
    """Extracted pairs against curated ones: hits, direction, shared PubMed ids, and which side alone is known."""
    return di.layer_metrics(*_layers(spark, sf), {"aggravates": "increases_abundance_in", "alleviates": "decreases_abundance_in"})


@REG.query(oracle=sql(_PAIRS + " SELECT subject, object FROM ou UNION SELECT subject, object FROM li", "edges"))
def pair_pool(spark: Spark, sf: str) -> DataFrame:
    """The pairs of both layers together, each once."""
    own, lib = _layers(spark, sf)
    return di.pair_pool(own, lib)
