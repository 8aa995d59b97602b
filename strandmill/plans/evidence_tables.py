"""Tables, identifiers, sub-graph, reconciliation, repair and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import ids, text
from strandmill.operators import chains as ch
from strandmill.operators import reconcile as rc
from strandmill.operators import subgraph as sg
from strandmill.plans import adapter as ad
from strandmill.plans.adapter import sql
from strandmill.plans.registry import Registry, load

REG = Registry()
Spark = SparkSession
ROOT = "colitis"
TOPIC_IDS = ("MESH:C000100008", "C000001000")


@REG.query(oracle=sql("SELECT id, name, category, tax_rank, aliases FROM nodes", "nodes"))
def graph_nodes(spark: Spark, sf: str) -> DataFrame:
    return ad.nodes(spark, sf).select("id", "name", "category", "tax_rank", "aliases")


@REG.query(oracle=sql("SELECT edge_id, subject, predicate, object, polarity, pmids, years, support_count, confidence, added_at FROM edges", "edges"))
def graph_edges(spark: Spark, sf: str) -> DataFrame:
    return ad.edges(spark, sf).select("edge_id", "subject", "predicate", "object", "polarity", "pmids", "years", "support_count", "confidence", "added_at")


@REG.query(
    oracle=sql(
        """ends AS (SELECT 'subject' AS side, subject AS id FROM edges UNION ALL SELECT 'object', object FROM edges)
SELECT side, count(*) AS n, count(*) FILTER (WHERE e.id IS NULL) AS no_id, count(*) FILTER (WHERE e.id IS NOT NULL AND n.id IS NULL) AS dangling FROM ends e LEFT JOIN nodes n ON e.id = n.id GROUP BY side""",
        "nodes",
        "edges",
    )
)
def edge_integrity(spark: Spark, sf: str) -> DataFrame:
    """Ends of edges without an id, and with an id that is no node."""
    ends = ad.edges(spark, sf).select(F.explode(F.array(F.struct(F.lit("subject").alias("side"), F.col("subject").alias("id")), F.struct(F.lit("object").alias("side"), F.col("object").alias("id")))).alias("e")).select("e.*")
    known = ad.nodes(spark, sf).select("id", F.lit(1).alias("there"))
    return ends.join(known, "id", "left").groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id").isNull()).alias("no_id"), F.count_if(F.col("id").isNotNull() & F.col("there").isNull()).alias("dangling"))


@REG.query(
    oracle=rf"""SELECT DISTINCT raw, {ad._norm('raw')} AS norm, CASE WHEN contains(raw, ':') THEN regexp_extract(raw, '^[^:]*:(.*)$', 1) ELSE raw END AS local,
  CASE WHEN regexp_matches(regexp_extract(raw, '^[^:]*:(.*)$', 1), '(?i)^[DC][0-9]{{6,}}$') THEN upper(regexp_extract(raw, '^[^:]*:(.*)$', 1)) END AS mesh
FROM (SELECT subject AS raw FROM merged_edges UNION ALL SELECT object FROM merged_edges) WHERE raw IS NOT NULL AND NOT contains(raw, chr(9))"""
)
def id_norm(spark: Spark, sf: str) -> DataFrame:
    e = load(spark, sf, "merged_edges")
    raw = e.select(F.explode(F.array("subject", "object")).alias("raw")).where(F.col("raw").isNotNull() & ~F.col("raw").contains("\t")).distinct()
    c = F.col("raw")
    return raw.select("raw", ids.norm_id(c).alias("norm"), ids.local_id(c).alias("local"), ids.canon_mesh(c).alias("mesh"))


@REG.query(oracle=sql("SELECT key, node_id FROM names", "names"))
def name_index_first_wins(spark: Spark, sf: str) -> DataFrame:
    return ad.names_of(ad.nodes(spark, sf))


@REG.query(
    oracle=r"""SELECT edge_id, t.pmids, len(t.pmids) AS n FROM (SELECT DISTINCT edge_id, list_filter(list_transform(string_split(pmids, ';'), lambda x: trim(x)), lambda x: regexp_matches(x, '^[0-9]+$')) AS pmids FROM merged_edges WHERE pmids IS NOT NULL) t"""
)
def pmid_tokens(spark: Spark, sf: str) -> DataFrame:
    e = load(spark, sf, "merged_edges").where("pmids is not null").select("edge_id", ids.pmid_tokens(F.col("pmids")).alias("pmids")).distinct()
    return e.withColumn("n", F.size("pmids"))


@REG.query(
    oracle=r"""SELECT row_index, doid, list_distinct(list_filter(list_transform(string_split_regex(doid, '[,;]'), lambda x: upper(trim(x))), lambda x: regexp_matches(x, '^DOID:[0-9]+$'))).list_sort() AS tokens FROM metabolite_host_gene WHERE doid IS NOT NULL"""
)
def curated_topic_tokens(spark: Spark, sf: str) -> DataFrame:
    """Multi-valued topic cells as sets of valid tokens."""
    parts = F.transform(F.split("doid", "[,;]"), lambda x: F.upper(F.trim(x)))
    return load(spark, sf, "metabolite_host_gene").where("doid is not null").select("row_index", "doid", F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.rlike("^DOID:[0-9]+$")))).alias("tokens"))


@REG.query(
    oracle=r"""SELECT name, regexp_replace(name, '\s*\([^)]*\)\s*$', '') AS bare, lower(trim(replace(name, '_', ' '))) AS norm,
  CASE WHEN regexp_matches(name, '(?i)(^|_)(SGB|GGB|UMGS)[0-9]+(_|$)') THEN 'genome_code' WHEN contains(name, '_unclassified') THEN 'unclassified' WHEN contains(name, '_sp_') OR ends_with(name, '_sp') THEN 'sp_ref' END AS reason
FROM (SELECT DISTINCT metabolite AS name FROM metabolite_host_gene WHERE metabolite IS NOT NULL UNION SELECT DISTINCT replace(microbe_name, ' ', '_') || suffix FROM chains, (SELECT unnest(['', '_unclassified', '_sp_1', '_sp', '_SGB12', ' sp.']) AS suffix) WHERE microbe_name IS NOT NULL)"""
)
def name_forms(spark: Spark, sf: str) -> DataFrame:
    """Names of metabolites, and of microbes as feature names in six forms."""
    c = F.col("name")
    forms = F.explode(F.array(*[F.lit(x) for x in ("", "_unclassified", "_sp_1", "_sp", "_SGB12", " sp.")]))
    microbes = load(spark, sf, "chains").where("microbe_name is not null").select(F.translate("microbe_name", " ", "_").alias("n")).distinct().withColumn("suffix", forms)
    names = load(spark, sf, "metabolite_host_gene").select(F.col("metabolite").alias("name")).where("name is not null").union(microbes.select(F.concat("n", "suffix"))).distinct()
    return names.select("name", text.strip_parenthesis(c).alias("bare"), ids.norm_name(c).alias("norm"), text.unnamed_reason(c).alias("reason"))


# the lexicon as the oracle has it
_CAUSAL_SQL = "induces|promotes|inhibits|suppresses|increases|decreases|reduces|enhances|activates|blocks|causes|leads to|results in|drives|regulates|stimulates|produces|converts|degrades|secret|secrete|secretes|secreted|secretion|converts to|degraded"
_CORRELATIONAL_SQL = "associated with|correlated with|linked to|related to|enriched in|depleted in|abundance of|positively associated|negatively associated|co-occurred"


def _hits(words: str) -> str:
    return "list_filter([" + ", ".join(rf"CASE WHEN regexp_matches(low, '(^|[^\p{{L}}\p{{N}}_]){w}([^\p{{L}}\p{{N}}_]|$)') THEN '{w}' END" for w in words.split("|")) + "], lambda x: x IS NOT NULL)"


_MARKS = f"marks AS (SELECT doc_id, c, r, said, CASE WHEN len(c) > 0 THEN 'causal' WHEN len(r) > 0 THEN 'correlational' ELSE 'none' END AS mark FROM (SELECT doc_id, said, {_hits(_CAUSAL_SQL)} AS c, {_hits(_CORRELATIONAL_SQL)} AS r FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS said, lower(coalesce(text, '')) AS low FROM documents)))"


@REG.query(oracle="WITH " + _MARKS + " SELECT doc_id, mark, array_to_string(list_concat(c, r), ';') AS hit_words, substr(sha256(said), 1, 16) AS sentence_sha16, len(c) AS n_causal_words FROM marks")
def lexicon_marks(spark: Spark, sf: str) -> DataFrame:
    """The causal and correlational triggers of every document."""
    docs = load(spark, sf, "documents").select("doc_id", "text").distinct()
    return docs.select("doc_id", text.lexicon_marks(F.col("text")).alias("m")).select("doc_id", "m.*")


def _audited(spark: Spark, sf: str) -> DataFrame:
    """Every assertion with the language mark of its sentence; marks are a table of their own, met by id."""
    a = ad.assertions(spark, sf).withColumn("assertion_id", ids.content_id("AS-", F.col("edge_id"), F.col("pmid")))
    marks = a.select("assertion_id", text.lexicon_marks(F.col("sentence")).alias("m")).select("assertion_id", "m.mark")
    return sg.with_marks(a.select("assertion_id", "predicate"), marks)


_CELL_SQL = (
    _MARKS
    + """, marked AS (SELECT a.predicate, coalesce(m.mark, 'none') AS mark FROM (SELECT predicate, doc_id FROM assertions) a LEFT JOIN marks m USING (doc_id)), cells AS (SELECT CASE WHEN lower(trim(predicate)) IN ('produces', 'biotransforms', 'aggravates', 'alleviates') THEN CASE mark WHEN 'causal' THEN 'correct' WHEN 'correlational' THEN 'overread' ELSE 'no_judgement_causal' END
 WHEN lower(trim(predicate)) IN ('affects', 'consumes') THEN CASE mark WHEN 'causal' THEN 'conservative' WHEN 'correlational' THEN 'consistent_conservative' ELSE 'no_judgement_neutral' END ELSE 'unclassified_predicate' END AS cell, predicate FROM marked)"""
)


@REG.query(oracle=sql(_CELL_SQL + " SELECT cell, count(*) AS n, count(DISTINCT predicate) AS predicates FROM cells GROUP BY cell", "assertions"))
def faithfulness_cells(spark: Spark, sf: str) -> DataFrame:
    return _audited(spark, sf).withColumn("cell", text.faithfulness(F.col("predicate"), F.col("mark"))).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("predicate").alias("predicates"))


@REG.query(
    oracle=sql(
        _CELL_SQL
        + """, k AS (SELECT count(*) AS n, count(*) FILTER (WHERE cell = 'correct') AS correct, count(*) FILTER (WHERE cell = 'overread') AS overread, count(*) FILTER (WHERE cell = 'no_judgement_causal') AS silent, count(*) FILTER (WHERE cell IN ('conservative', 'consistent_conservative')) AS neutral, count(*) FILTER (WHERE cell = 'no_judgement_neutral') AS silent_neutral FROM cells)
SELECT n AS n_assertions, correct + overread + silent AS causal_total, neutral + silent_neutral AS neutral_total, round(overread / (correct + overread + silent), 6) AS overread_rate, round(1 - overread / (correct + overread + silent), 6) AS faithfulness_upper_bound, round(correct / (correct + overread), 6) AS direction_agreement, correct + overread + neutral AS n_with_language_power, round((correct + overread + neutral) / n, 6) AS with_language_power_rate FROM k""",
        "assertions",
    )
)
def faithfulness_audit(spark: Spark, sf: str) -> DataFrame:
    """Over-reading rate and what goes with it, over all assertions."""
    return sg.faithfulness_metrics(_audited(spark, sf))


@REG.query(
    oracle="SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS sum_k, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS max_k FROM events GROUP BY event_type"
)
def json_props(spark: Spark, sf: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return load(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


_FAMILY = f"family AS (SELECT id, name, concat_ws('+', CASE WHEN id IN ('MESH:C000100008','C000001000') OR regexp_extract(id, '^[^:]*:(.*)$', 1) IN ('MESH:C000100008','C000001000') THEN 'id' END, CASE WHEN contains(lower(name), '{ROOT}') THEN 'name' END) AS via FROM nodes WHERE category = 'Disease'), fam AS (SELECT * FROM family WHERE via <> '')"


def _family(spark: Spark, sf: str) -> DataFrame:
    return sg.topic_family(ad.nodes(spark, sf), TOPIC_IDS, ROOT)


@REG.query(oracle=sql(_FAMILY + " SELECT id, name, via FROM fam", "nodes"))
def topic_family(spark: Spark, sf: str) -> DataFrame:
    return _family(spark, sf).select("id", "name", "via")


@REG.query(oracle=sql(_FAMILY + " SELECT id, name FROM nodes WHERE category = 'Disease' AND contains(lower(name), 'itis') AND id NOT IN (SELECT id FROM fam)", "nodes"))
def topic_adjacent(spark: Spark, sf: str) -> DataFrame:
    return sg.adjacent(ad.nodes(spark, sf), _family(spark, sf), "itis").select("id", "name")


_SEEDS = (
    _FAMILY
    + """, lit AS (SELECT doc_id FROM documents WHERE lang = 'de'), flagged AS (SELECT edge_id, subject, object, bool_or(doc_id IN (SELECT doc_id FROM lit)) AS l, bool_or(coalesce(subject IN (SELECT id FROM fam), false)) AS s, bool_or(coalesce(object IN (SELECT id FROM fam), false)) AS o FROM assertions GROUP BY ALL),
 seeds AS (SELECT edge_id, subject, object, 'seed_assertion:' || concat_ws('+', CASE WHEN o THEN 'object_in_family' END, CASE WHEN l THEN 'pmid_in_disease_lit' END, CASE WHEN s THEN 'subject_in_family' END) AS provenance FROM flagged WHERE l OR s OR o)"""
)


def _seeds(spark: Spark, sf: str) -> DataFrame:
    return sg.seed_edges(ad.assertions(spark, sf), _family(spark, sf), load(spark, sf, "documents").where("lang = 'de'"))


@REG.query(oracle=sql(_SEEDS + " SELECT * FROM seeds", "nodes", "assertions"))
def seed_edges(spark: Spark, sf: str) -> DataFrame:
    return _seeds(spark, sf)


_HOPS = """, both_ways AS (SELECT subject AS a, object AS b FROM edges WHERE subject IS NOT NULL AND object IS NOT NULL UNION SELECT object, subject FROM edges WHERE subject IS NOT NULL AND object IS NOT NULL),
 h0 AS (SELECT id FROM fam), h1 AS (SELECT DISTINCT b AS id FROM both_ways WHERE a IN (SELECT id FROM h0) AND b NOT IN (SELECT id FROM h0)),
 h2 AS (SELECT DISTINCT b AS id FROM both_ways WHERE a IN (SELECT id FROM h1) AND b NOT IN (SELECT id FROM h0 UNION SELECT id FROM h1)),
 hops AS (SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2)"""


def _hops(spark: Spark, sf: str) -> DataFrame:
    return sg.khop_nodes(ad.edges(spark, sf), _family(spark, sf), 2)


@REG.query(oracle=sql(_FAMILY + _HOPS + " SELECT id, hop FROM hops", "nodes", "edges"))
def khop_nodes(spark: Spark, sf: str) -> DataFrame:
    return _hops(spark, sf)


@REG.query(oracle=sql(_FAMILY + _HOPS + " SELECT edge_id, subject, predicate, object FROM edges WHERE subject IN (SELECT id FROM hops WHERE hop < 2) AND object IN (SELECT id FROM hops WHERE hop < 2)", "nodes", "edges"))
def induced_subgraph(spark: Spark, sf: str) -> DataFrame:
    return sg.induced(ad.edges(spark, sf), _hops(spark, sf).where("hop < 2")).select("edge_id", "subject", "predicate", "object")


@REG.query(
    oracle=sql(
        f"""flags AS (SELECT edge_id, max((list_max(list_transform(votes, lambda x: len(list_filter(votes, lambda y: y = x)))) >= 2 OR verdict = 'SUPPORTED')::INT) AS v,
  max(coalesce(regexp_matches(sentence, '(?i)(induce|inhibit|prevent|attenuat|aggravat|alleviat|promot|caus(?:e|ed|ing)|reduc|improv|protect|disturb|impair|generat|produc|convert|synthes|inactivat|metaboliz)'), false)::INT) AS c, max(coalesce(regexp_matches(sentence, '(?i)(correlat|associat|enrich|deplet|increas|decreas|elevat|lower|higher|abundan|prevalen|alter|shift|chang)'), false)::INT) AS r FROM assertions GROUP BY edge_id),
 f AS (SELECT e.edge_id, predicate, coalesce(predicate IN ('aggravates','alleviates','produces','biotransforms','consumes','promotes_growth','inhibits_growth'), false)::INT AS a, coalesce(v, 0) AS v, coalesce(c, 0) AS c, coalesce(r, 0) AS r FROM edges e LEFT JOIN flags USING (edge_id))
SELECT edge_id, predicate, CASE WHEN a = 1 AND v = 1 AND c = 1 THEN 'causal' WHEN predicate = 'affects' OR r = 1 THEN 'correlated' ELSE 'unclassified' END AS causality,
 CASE WHEN a = 1 AND v = 1 AND c = 1 THEN 'rule1:action+vote+causal_ev' WHEN predicate = 'affects' OR r = 1 THEN 'rule2:' || concat_ws('+', CASE WHEN predicate = 'affects' THEN 'predicate_affects' END, CASE WHEN r = 1 THEN 'corr_ev' END)
  ELSE 'rule3:missing=' || concat_ws('|', CASE WHEN a = 0 THEN 'action' END, CASE WHEN v = 0 THEN 'vote' END, CASE WHEN c = 0 THEN 'causal_ev' END) END AS basis,
 'action=' || a || ',vote=' || v || ',causal_ev=' || c || ',corr_ev=' || r AS diag FROM f""",
        "assertions",
    )
)
def edge_causality(spark: Spark, sf: str) -> DataFrame:
    return sg.edge_causality(ad.edges(spark, sf), ad.assertions(spark, sf))


def _links(spark: Spark, sf: str) -> DataFrame:
    """Chains as links between metabolites and genes: the pairs that curated rows are held against."""
    e = ad.edges(spark, sf).select(F.col("edge_id").alias("hop1_edge_id"), "polarity")
    c = ad.chains(spark, sf).where("hop2_gene is not null")
    return c.join(e, "hop1_edge_id", "left").select(F.col("chain_id").alias("edge_id"), F.col("metabolite_id").alias("subject"), F.col("hop1_predicate").alias("predicate"), F.col("hop2_gene").alias("object"), "polarity")


_BUCKETS = r"""links AS (SELECT chain_id AS edge_id, metabolite_id AS s, hop1_predicate AS predicate, hop2_gene AS o, e.polarity FROM chs LEFT JOIN edges e ON e.edge_id = chs.hop1_edge_id WHERE hop2_gene IS NOT NULL),
 pairs AS (SELECT least(s, o) AS p, greatest(s, o) AS q, string_agg(DISTINCT edge_id, ';' ORDER BY edge_id) AS edge_ids, string_agg(DISTINCT predicate, ';' ORDER BY predicate) AS predicates, count(*) AS n, sum((coalesce(predicate = 'consumes', false) OR coalesce(lower(polarity) = 'negative', false))::INT) AS opp,
   max((predicate IN ('produces','biotransforms'))::INT) AS prod FROM links WHERE s IS NOT NULL GROUP BY 1, 2),
 matched AS (SELECT c.*, a.node_id AS node_a, b.node_id AS node_b, CASE WHEN a.node_id IS NOT NULL AND b.node_id IS NOT NULL THEN 'both' WHEN a.node_id IS NOT NULL THEN 'a_side' WHEN b.node_id IS NOT NULL THEN 'b_side' ELSE 'none' END AS match_status
   FROM curated c LEFT JOIN names a ON a.key = lower(c.metabolite) LEFT JOIN names b ON b.key = lower(c.gene)),
 buckets AS (SELECT row_index, match_status, CASE WHEN match_status <> 'both' THEN 'unmatched' WHEN opp > 0 THEN 'conflict' WHEN n > 0 THEN 'confirm' ELSE 'extend' END AS bucket,
   CASE WHEN match_status <> 'both' THEN '' WHEN opp > 0 THEN CASE WHEN opp = n THEN 'all_opposed' ELSE 'mixed_opposed' END WHEN n > 0 THEN CASE WHEN prod = 1 THEN 'production_agree' ELSE 'non_directional' END ELSE '' END AS verdict,
   CASE WHEN match_status = 'both' THEN coalesce(edge_ids, '') ELSE '' END AS edge_ids, CASE WHEN match_status = 'both' THEN coalesce(predicates, '') ELSE '' END AS predicates, node_a, node_b, metabolite, gene
   FROM matched LEFT JOIN pairs ON p = least(node_a, node_b) AND q = greatest(node_a, node_b) AND node_a IS NOT NULL AND node_b IS NOT NULL)"""


def _buckets(spark: Spark, sf: str) -> DataFrame:
    return rc.three_buckets(rc.match_curated(ad.curated(spark, sf), ad.names_of(ad.nodes(spark, sf)), "metabolite", "gene"), _links(spark, sf))


@REG.query(oracle=sql(_BUCKETS + " SELECT row_index, match_status, bucket, verdict, edge_ids, predicates FROM buckets", "names", "edges", "chs", "curated"))
def three_bucket(spark: Spark, sf: str) -> DataFrame:
    return _buckets(spark, sf).select("row_index", "match_status", "bucket", "verdict", "edge_ids", "predicates")


@REG.query(oracle=sql(_BUCKETS + " SELECT bucket, verdict, count(*) AS n FROM buckets GROUP BY GROUPING SETS ((bucket), (bucket, verdict), ())", "names", "edges", "chs", "curated"))
def bucket_counts(spark: Spark, sf: str) -> DataFrame:
    return rc.bucket_counts(_buckets(spark, sf))


_POLAR = r"""md AS (SELECT e.edge_id, predicate, pmids, CASE WHEN s.category IN ('Species', 'Microbe') THEN subject ELSE object END AS m, CASE WHEN s.category IN ('Species', 'Microbe') THEN object ELSE subject END AS d FROM edges e JOIN nodes s ON s.id = subject JOIN nodes o ON o.id = object
   WHERE (s.category IN ('Species', 'Microbe') AND o.category = 'Disease') OR (o.category IN ('Species', 'Microbe') AND s.category = 'Disease')),
 keyed AS (SELECT edge_id, predicate, pmids, regexp_replace(m, '^[^:]*:', '') AS microbe_taxid, upper(regexp_replace(d, '^[^:]*:', '')) AS disease_mesh FROM md WHERE regexp_matches(regexp_replace(d, '^[^:]*:', ''), '(?i)^[DC][0-9]{6,}$')),
 sides AS (SELECT microbe_taxid, disease_mesh, count(DISTINCT edge_id) FILTER (WHERE predicate = 'aggravates') AS ea, count(DISTINCT edge_id) FILTER (WHERE predicate = 'alleviates') AS el, len(list_distinct(flatten(list(pmids) FILTER (WHERE predicate = 'aggravates')))) AS pa, len(list_distinct(flatten(list(pmids) FILTER (WHERE predicate = 'alleviates')))) AS pl FROM keyed GROUP BY 1, 2),
 ledger AS (SELECT microbe_taxid, disease_mesh, pa AS pmid_aggravates, pl AS pmid_alleviates, CASE WHEN pa > pl THEN 'aggravates' WHEN pa < pl THEN 'alleviates' ELSE 'unresolved_tie' END AS winner, CASE WHEN pa = pl THEN 'tie_both_neutral' ELSE 'loser_relabel' END AS action,
   CASE WHEN pa > pl THEN el WHEN pa < pl THEN ea ELSE ea + el END AS edges_relabeled FROM sides WHERE ea > 0 AND el > 0)"""


@REG.query(oracle=sql(_POLAR + " SELECT * FROM ledger", "nodes", "edges"))
def conflict_ledger(spark: Spark, sf: str) -> DataFrame:
    return rc.conflict_ledger(ad.edges(spark, sf), ad.nodes(spark, sf))


@REG.query(oracle=sql(_POLAR + " SELECT e.edge_id, e.subject, e.object, CASE WHEN e.predicate IN ('aggravates', 'alleviates') AND winner IS NOT NULL AND e.predicate <> winner THEN 'affects' ELSE e.predicate END AS predicate FROM edges e LEFT JOIN keyed k USING (edge_id) LEFT JOIN ledger l ON l.microbe_taxid = k.microbe_taxid AND l.disease_mesh = k.disease_mesh", "nodes", "edges"))
def repaired_edges(spark: Spark, sf: str) -> DataFrame:
    e, n = ad.edges(spark, sf), ad.nodes(spark, sf)
    return rc.repaired(e, n, rc.conflict_ledger(e, n)).select("edge_id", "subject", "object", "predicate")


# the curated edges are the table, the assertions of all other edges the increment; disputed ones failed
_NEW = """base AS (SELECT * FROM edges WHERE source_type = 'curated'),
 inc AS (SELECT a.subject, a.predicate, a.object, pmid, e.confidence, a.polarity FROM assertions a JOIN edges e USING (edge_id) WHERE e.source_type <> 'curated' AND e.relation_status IS DISTINCT FROM 'disputed' AND a.subject IS NOT NULL AND a.object IS NOT NULL),
 tri AS (SELECT subject, predicate, object, list_sort(list_distinct(list(pmid))) AS np, count(*) AS ns, max(confidence) AS nc, CASE WHEN coalesce(avg(CASE WHEN polarity IS NULL THEN NULL ELSE (polarity = 'positive')::INT END), 0) >= 0.5 THEN 'positive' ELSE 'negative' END AS npol FROM inc GROUP BY 1, 2, 3),
 ups AS (SELECT coalesce(e.subject, t.subject) AS subject, coalesce(e.predicate, t.predicate) AS predicate, coalesce(e.object, t.object) AS object, list_sort(list_distinct(list_concat(coalesce(e.pmids, []), coalesce(np, [])))) AS pmids, coalesce(support_count, 0) + coalesce(ns, 0) AS support,
   CASE WHEN e.confidence IS NULL THEN nc WHEN nc IS NULL THEN e.confidence ELSE greatest(e.confidence, nc) END AS confidence, coalesce(e.polarity, npol) AS polarity, CASE WHEN e.edge_id IS NULL THEN 'tier2_increment' WHEN ns IS NOT NULL THEN 'appended' ELSE 'kept' END AS origin
   FROM base e FULL JOIN tri t ON e.subject = t.subject AND e.predicate = t.predicate AND e.object = t.object)"""


def _upserted(spark: Spark, sf: str) -> DataFrame:
    e = ad.edges(spark, sf)
    known = e.select("edge_id", "source_type", "relation_status", "confidence")
    a = ad.assertions(spark, sf).join(known, "edge_id").where((F.col("source_type") != "curated") & F.col("subject").isNotNull() & F.col("object").isNotNull())
    inc = a.select("subject", "predicate", "object", "pmid", "confidence", "polarity", F.when(F.col("relation_status") == "disputed", "failed").otherwise("ok").alias("status"))
    return rc.upsert(e.where("source_type = 'curated'"), rc.increment_triples(inc))


@REG.query(oracle=sql(_NEW + " SELECT subject, predicate, object, pmids, support::BIGINT AS support, round(confidence, 6) AS confidence, polarity, origin FROM ups", "assertions"))
def edge_upsert(spark: Spark, sf: str) -> DataFrame:
    return _upserted(spark, sf).withColumn("confidence", F.round("confidence", 6))


@REG.query(oracle=sql("ends AS (SELECT subject AS id FROM edges UNION SELECT object FROM edges) SELECT e.id, coalesce(n.name, e.id) AS name, n.category, CASE WHEN n.id IS NULL THEN 'constructed' ELSE 'main' END AS origin FROM ends e LEFT JOIN nodes n ON n.id = e.id WHERE e.id IS NOT NULL", "nodes", "edges"))
def node_closure(spark: Spark, sf: str) -> DataFrame:
    return rc.closure(ad.edges(spark, sf), ad.nodes(spark, sf))


@REG.query(oracle="SELECT d.pmid, CASE WHEN d.pmid IN (SELECT pmid FROM metabolite_host_gene WHERE pmid IS NOT NULL) THEN 'overlap' ELSE 'new' END AS status FROM (SELECT DISTINCT pmid FROM (SELECT pmid FROM documents UNION ALL SELECT unnest(pmids) FROM (" + sql("SELECT pmids FROM edges", "edges") + ")) WHERE pmid IS NOT NULL) d")
def pmid_difference(spark: Spark, sf: str) -> DataFrame:
    """PubMed ids of the documents and of all edges that the curated table lacks or has."""
    found = load(spark, sf, "documents").select("pmid").union(ad.edges(spark, sf).select(F.explode("pmids")))
    return rc.literature_difference(found, load(spark, sf, "metabolite_host_gene"))


@REG.query(
    oracle=sql("n AS (SELECT count(*) AS all_rows, count(DISTINCT edge_id || '|' || pmid) AS linked FROM assertions) SELECT all_rows AS n_assertions, all_rows AS n_linked, 0::BIGINT AS n_missing FROM n", "assertions")
)
def assertion_votes(spark: Spark, sf: str) -> DataFrame:
    """Assertions linked to their votes again by the recomputed content id; misses are counted."""
    a = ad.assertions(spark, sf)
    key = ids.content_id("AS-", F.col("edge_id"), F.col("subject"), F.col("predicate"), F.col("object"), F.col("pmid"))
    votes = a.select(key.alias("assertion_id"), "votes").dropDuplicates(["assertion_id"])
    linked = sg.relink(a.drop("votes").withColumn("assertion_id", key), votes)
    return linked.agg(F.count(F.lit(1)).alias("n_assertions"), F.count_if(F.col("votes_missing") == 0).alias("n_linked"), F.sum("votes_missing").cast("bigint").alias("n_missing"))


@REG.query(oracle=sql(_FAMILY + _HOPS + " SELECT predicate, count(*) AS n, count(DISTINCT a.edge_id) AS edges FROM assertions a WHERE edge_id IN (SELECT edge_id FROM edges WHERE subject IN (SELECT id FROM hops WHERE hop < 2) AND object IN (SELECT id FROM hops WHERE hop < 2)) GROUP BY predicate", "nodes", "assertions"))
def restricted_assertions(spark: Spark, sf: str) -> DataFrame:
    """The assertions of the cut sub-graph's edges, by predicate."""
    cut = sg.induced(ad.edges(spark, sf), _hops(spark, sf).where("hop < 2"))
    return sg.restrict(ad.assertions(spark, sf), "edge_id", cut, "edge_id").groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("edge_id").alias("edges"))


CHAIN_SQL = r"""h1 AS (SELECT e.edge_id, e.subject AS microbe_id, m.name AS microbe_name, e.predicate, e.object AS metabolite_id, b.name AS metabolite_name FROM edges e JOIN nodes b ON b.id = e.object AND b.category = 'Metabolite' LEFT JOIN nodes m ON m.id = e.subject WHERE e.predicate IN ('produces', 'biotransforms') AND starts_with(e.subject, 'NCBITAXON:')),
 gn AS (SELECT upper(name) AS gene, min(id) AS gene_node FROM nodes WHERE category = 'Gene' GROUP BY 1),
 h2 AS (SELECT n.node_id AS metabolite_id, coalesce(gene_node, 'SYMBOL:' || c.gene) AS gene_id, min(c.gene) AS gene_name, string_agg(DISTINCT concat_ws(':', row_index::VARCHAR, pmid), ';' ORDER BY concat_ws(':', row_index::VARCHAR, pmid)) AS refs
   FROM curated c JOIN names n ON n.key = lower(c.metabolite) JOIN nodes x ON x.id = n.node_id AND x.category = 'Metabolite' LEFT JOIN gn ON gn.gene = c.gene WHERE c.gene IS NOT NULL AND c.gene <> '' GROUP BY 1, 2),
 built AS (SELECT 'CH-' || substr(sha256(concat_ws('|', microbe_id, h1.metabolite_id, edge_id, coalesce(h2.gene_id, ''), coalesce(pathway, ''))), 1, 16) AS chain_id, microbe_id, microbe_name, h1.metabolite_id, metabolite_name, predicate AS hop1_predicate, edge_id AS hop1_edge_id, gene_id, gene_name, coalesce(refs, '') AS refs, pathway,
   1 + (gene_id IS NOT NULL)::INT + (pathway IS NOT NULL)::INT AS depth, CASE WHEN gene_id IS NULL THEN 'metabolite' WHEN pathway IS NULL THEN 'gene' ELSE 'pathway' END AS hop_terminus, (pathway IS NULL)::INT AS dead_end FROM h1 LEFT JOIN h2 USING (metabolite_id) LEFT JOIN gene_pathways g ON g.gene = h2.gene_id)"""
CHAIN_TABLES = ("names", "edges", "curated", "gene_pathways")


def _built_hops(spark: Spark, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = ad.nodes(spark, sf)
    hop1 = ch.hop1_edges(ad.edges(spark, sf, "subject", "predicate", "object"), nodes)
    return hop1, ch.hop2_knowledge(ad.curated(spark, sf), nodes, ad.names_of(nodes)), ad.gene_pathways(spark, sf)


def built_chains(spark: Spark, sf: str) -> DataFrame:
    return ch.assemble(*_built_hops(spark, sf))


@REG.query(oracle=sql(CHAIN_SQL + " SELECT * FROM built", *CHAIN_TABLES))
def chain_assembly(spark: Spark, sf: str) -> DataFrame:
    return built_chains(spark, sf).drop("penalty", "pruned")


@REG.query(oracle=sql(CHAIN_SQL + " SELECT depth, count(*) AS n, count(DISTINCT microbe_id) AS microbes, count(DISTINCT metabolite_id) AS metabolites, count(DISTINCT gene_id) AS genes FROM built GROUP BY depth", *CHAIN_TABLES))
def chain_depth_distribution(spark: Spark, sf: str) -> DataFrame:
    return ch.depth_distribution(built_chains(spark, sf))


@REG.query(oracle=sql(CHAIN_SQL + " SELECT metabolite_id, count(*) AS n, round(count(*) / (SELECT count(*) FROM built), 6) AS share FROM built GROUP BY 1 ORDER BY n DESC, metabolite_id LIMIT 4", *CHAIN_TABLES))
def metabolite_shares(spark: Spark, sf: str) -> DataFrame:
    return ch.shares_of_hops(*_built_hops(spark, sf))


@REG.query(oracle=sql("SELECT chain_id, hop1_edge_id, evidence_tier, source_id, (e.edge_id IS NULL)::INT AS edge_missing FROM chs LEFT JOIN edges e ON e.edge_id = chs.hop1_edge_id", "chs", "edges"))
def chain_edge_provenance(spark: Spark, sf: str) -> DataFrame:
    return ch.edge_provenance(ad.chains(spark, sf), ad.edges(spark, sf)).select("chain_id", "hop1_edge_id", "evidence_tier", "source_id", "edge_missing")
