"""The evidence tables in the form the operators take, and the same as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.ids import name_key, norm_id, trimmed
from strandmill.plans.registry import load

PMID = "([0-9]{5,})"
EDGE = ("subject", "predicate", "object", "polarity", "evidence_tier", "source_type", "source_id", "relation_status", "pmids", "years", "support_count", "confidence", "added_at")
CHAIN = ("microbe_id", "microbe_name", "metabolite_id", "metabolite_name", "hop1_predicate", "hop1_edge_id", "hop2_gene", "hop2_gene_name", "hop3_pathway", "metabolite_chebi", "depth", "dead_end", "penalty")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per normalised id: ``id, name, category, tax_rank, knowledge_layer, run_batch, aliases``."""
    rows = load(spark, sf, "merged_nodes").withColumn("nid", norm_id(F.col("id"))).where("nid is not null")
    return rows.groupBy(F.col("nid").alias("id")).agg(
        F.min("name").alias("name"), F.min("category").alias("category"), F.min("tax_rank").alias("tax_rank"), F.min("knowledge_layer").alias("knowledge_layer"), F.min("run_batch").alias("run_batch"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("aliases"),
    )


def edges(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """One row per edge id, the one retrieved last, with normalised ends and the PubMed ids as a sorted array.

    ``columns`` may name those that are wanted besides ``edge_id``; no other is read or shuffled.
    """
    rows = load(spark, sf, "merged_edges").where("edge_id is not null")
    own = {
        "subject": norm_id(F.col("subject")), "object": norm_id(F.col("object")),
        "pmids": F.array_sort(F.array_distinct(F.coalesce(F.regexp_extract_all("pmids", F.lit(PMID)), F.array().cast("array<string>")))),
        "years": F.coalesce(F.transform("pub_years", lambda y: y.cast("int")), F.array().cast("array<int>")),
    }
    keep = F.struct(*[own.get(c, F.col(c)).alias(c) for c in columns or EDGE])
    return rows.groupBy("edge_id").agg(F.max_by(keep, "retrieved_at").alias("e")).select("edge_id", "e.*")


def chains(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """One row per chain id, the one loaded last; ``columns`` as for ``edges``."""
    rows = load(spark, sf, "chains").where("chain_id is not null")
    own = {c: norm_id(F.col(c)) for c in ("microbe_id", "metabolite_id", "hop2_gene", "hop3_pathway")} | {c: trimmed(F.col(c)) for c in ("microbe_name", "metabolite_name", "hop1_edge_id")}
    keep = F.struct(*[own.get(c, F.col(c)).alias(c) for c in columns or CHAIN])
    return rows.groupBy("chain_id").agg(F.max_by(keep, "loaded_at").alias("c")).select("chain_id", "c.*")


def curated(spark: SparkSession, sf: str) -> DataFrame:
    """``row_index, pmid, metabolite, gene, gene_id, doid``: the curated rows with trimmed names."""
    rows = load(spark, sf, "metabolite_host_gene")
    return rows.select("row_index", "pmid", trimmed(F.col("metabolite")).alias("metabolite"), F.upper(trimmed(F.col("gene"))).alias("gene"), "gene_id", "doid").distinct()


def assertions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per edge and PubMed id, with the document on which the id falls as its sentence, and three votes."""
    docs = load(spark, sf, "documents").select("doc_id", F.col("text").alias("sentence"), "lang")
    last = docs.agg(F.max("doc_id").alias("last"))
    pairs = edges(spark, sf).select("edge_id", "subject", "predicate", "object", "polarity", "evidence_tier", F.explode("pmids").alias("pmid"))
    placed = pairs.crossJoin(F.broadcast(last)).withColumn("doc_id", F.col("pmid").cast("bigint") % F.col("last") + 1).drop("last")
    votes = F.transform(F.array(F.lit(4), F.lit(5), F.lit(6)), lambda k: F.substring("pmid", k, F.lit(1)).cast("int") % 4)
    return placed.join(docs, "doc_id", "left").withColumn("votes", votes).withColumn("verdict", F.when(F.col("evidence_tier") == "A", "SUPPORTED").otherwise("OPEN"))


def gene_pathways(spark: SparkSession, sf: str) -> DataFrame:
    """``gene, pathway``: the frozen pathway knowledge."""
    return chains(spark, sf, "hop2_gene", "hop3_pathway").where("hop2_gene is not null and hop3_pathway is not null").select(F.col("hop2_gene").alias("gene"), F.col("hop3_pathway").alias("pathway")).distinct()


def names_of(node_table: DataFrame) -> DataFrame:
    """``key, node_id``: every name key of a node, by name and alias; of several nodes the smallest id."""
    keys = node_table.select(F.col("id"), F.explode(F.concat(F.array("name"), "aliases")).alias("n")).select(name_key(F.col("n")).alias("key"), "id")
    return keys.where("key is not null").groupBy("key").agg(F.min("id").alias("node_id"))


_T = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _norm(c: str) -> str:
    t = _T.format(c)
    return f"CASE WHEN {t} IN ('', '-', 'NA', 'na') THEN NULL ELSE upper({t}) END"


CTES = {
    "nodes": f"nodes AS (SELECT {_norm('id')} AS id, min(name) AS name, min(category) AS category, min(tax_rank) AS tax_rank, min(knowledge_layer) AS knowledge_layer, min(run_batch) AS run_batch, list_sort(list_distinct(flatten(list(coalesce(aliases, []))))) AS aliases FROM merged_nodes GROUP BY 1 HAVING {_norm('id')} IS NOT NULL)",
    "edges": f"""edges AS (SELECT edge_id, {_norm('subject')} AS subject, predicate, {_norm('object')} AS object, polarity, evidence_tier, source_type, source_id, relation_status,
      coalesce(list_sort(list_distinct(regexp_extract_all(pmids, '[0-9]{{5,}}'))), []) AS pmids, coalesce(list_transform(pub_years, lambda y: y::INT), []) AS years, support_count, confidence, added_at
      FROM merged_edges WHERE edge_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY retrieved_at DESC) = 1)""",
    "chs": f"""chs AS (SELECT chain_id, {_norm('microbe_id')} AS microbe_id, {_T.format('microbe_name')} AS microbe_name, {_norm('metabolite_id')} AS metabolite_id, {_T.format('metabolite_name')} AS metabolite_name, hop1_predicate, {_T.format('hop1_edge_id')} AS hop1_edge_id,
      {_norm('hop2_gene')} AS hop2_gene, hop2_gene_name, {_norm('hop3_pathway')} AS hop3_pathway, metabolite_chebi, depth, dead_end, penalty
      FROM chains WHERE chain_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY loaded_at DESC) = 1)""",
    "curated": f"curated AS (SELECT DISTINCT row_index, pmid, {_T.format('metabolite')} AS metabolite, upper({_T.format('gene')}) AS gene, gene_id, doid FROM metabolite_host_gene)",
    "assertions": """assertions AS (SELECT p.*, d.text AS sentence, d.lang, [substr(p.pmid, 4, 1)::INT % 4, substr(p.pmid, 5, 1)::INT % 4, substr(p.pmid, 6, 1)::INT % 4] AS votes, CASE WHEN evidence_tier = 'A' THEN 'SUPPORTED' ELSE 'OPEN' END AS verdict
      FROM (SELECT edge_id, subject, predicate, object, polarity, evidence_tier, pmid, pmid::BIGINT % (SELECT max(doc_id) FROM documents) + 1 AS doc_id FROM (SELECT *, unnest(pmids) AS pmid FROM edges)) p LEFT JOIN documents d USING (doc_id))""",
    "gene_pathways": "gene_pathways AS (SELECT DISTINCT hop2_gene AS gene, hop3_pathway AS pathway FROM chs WHERE hop2_gene IS NOT NULL AND hop3_pathway IS NOT NULL)",
    "names": rf"names AS (SELECT key, min(id) AS node_id FROM (SELECT id, lower({_T.format('n')}) AS key FROM (SELECT id, unnest(list_concat([name], aliases)) AS n FROM nodes)) WHERE key IS NOT NULL AND key <> '' GROUP BY key)",
}
_NEEDS = {"assertions": ("edges",), "gene_pathways": ("chs",), "names": ("nodes",)}


def sql(body: str, *tables: str, recursive: bool = False) -> str:
    """A query over the named tables of this module; ``body`` begins with further CTEs (``x AS (…) SELECT``) or with SELECT."""
    wanted: list[str] = []
    for t in tables:
        for n in (*_NEEDS.get(t, ()), t):
            if n not in wanted:
                wanted.append(n)
    head = ",\n".join(CTES[t] for t in wanted)
    more = body.lstrip()
    joint = "\n" if more.upper().startswith("SELECT") else ",\n"
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{joint}{more}"
