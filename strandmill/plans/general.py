"""Queries of the general training-data operators: p1 (heavy keys), p2 (packed fields), p5 (broken references)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.operators.orphans import Source, Target, broken_references, broken_report
from strandmill.operators.packed import packed_fields, split_packed
from strandmill.operators.skew import heavy_keys, per_key
from strandmill.plans.registry import Registry, load

REG = Registry()
CHAIN_KEYS = ("metabolite_id", "hop2_gene")
HEAVY_PERCENT = 3

P1_FOUND = """
WITH long AS (
  SELECT 'metabolite_id' AS field, metabolite_id AS key_value FROM chains
  UNION ALL SELECT 'hop2_gene', hop2_gene FROM chains)
SELECT field, key_value FROM long WHERE key_value IS NOT NULL
GROUP BY field, key_value
HAVING count(*) * 100 >= 3 * (SELECT count(*) FROM chains)
"""


@REG.query(oracle=P1_FOUND)
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_keys(load(spark, sf, "chains"), CHAIN_KEYS, HEAVY_PERCENT).select("field", "key_value")


P1_KEY_STATS = """
WITH long AS (
  SELECT 'metabolite_id' AS field, metabolite_id AS key_value, * FROM chains
  UNION ALL SELECT 'hop2_gene', hop2_gene, * FROM chains)
SELECT field, key_value, count(*) AS n_rows, sum(depth)::BIGINT AS sum_depth, max(depth) AS max_depth,
       sum(dead_end)::BIGINT AS dead_ends, round(sum(penalty), 4) AS penalty, min(built_at) AS first_built,
       max(loaded_at) AS last_loaded, count(DISTINCT microbe_id) AS microbes, count(DISTINCT chain_id) AS chains
FROM long GROUP BY field, key_value
"""


@REG.query(oracle=P1_KEY_STATS)
def p1_key_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Complete figures of every metabolite and gene, whatever share of the rows it holds."""
    return per_key(
        load(spark, sf, "chains"),
        CHAIN_KEYS,
        {
            "sum_depth": F.sum("depth"),
            "max_depth": F.max("depth"),
            "dead_ends": F.sum("dead_end"),
            "penalty": F.round(F.sum("penalty"), 4),
            "first_built": F.min("built_at"),
            "last_loaded": F.max("loaded_at"),
        },
        {"microbes": F.col("microbe_id"), "chains": F.col("chain_id")},
    )


@REG.query()
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of the three packed fields. No SQL: the dialect of a field is chosen by code lengths learnt from all fields."""
    return split_packed(
        packed_fields(
            [
                ("merged_edges", load(spark, sf, "merged_edges"), "edge_id", ["pmids"]),
                ("chains", load(spark, sf, "chains"), "chain_id", ["hop2_gutmgene_refs", "metabolite_chebi"]),
            ]
        )
    )


def _links(spark: SparkSession, sf: str) -> tuple[list[Source], list[Target]]:
    nodes, edges, chains = (load(spark, sf, t) for t in ("merged_nodes", "merged_edges", "chains"))
    sources = [Source("merged_edges", edges, "edge_id", "added_at", {"subject": "node", "object": "node"}), Source("chains", chains, "chain_id", "built_at", {"hop1_edge_id": "edge"})]
    return sources, [Target("node", nodes, "id", "added_at", "removed_at"), Target("edge", edges, "edge_id", "added_at", "removed_at")]


_P5 = r"""
WITH refs AS (
  SELECT 'merged_edges' AS tbl, 'subject' AS field, 'node' AS target, edge_id AS row_key, added_at AS ref_at, subject AS r FROM merged_edges
  UNION ALL SELECT 'merged_edges', 'object', 'node', edge_id, added_at, object FROM merged_edges
  UNION ALL SELECT 'chains', 'hop1_edge_id', 'edge', chain_id, built_at, hop1_edge_id FROM chains),
trimmed AS (SELECT * EXCLUDE (r), regexp_replace(r, '^\s+|\s+$', '', 'g') AS r FROM refs),
keyed AS (SELECT * EXCLUDE (r), CASE WHEN contains(r, ':') THEN lower(split_part(r, ':', 1)) || substr(r, instr(r, ':')) ELSE r END AS k
          FROM trimmed WHERE r IS NOT NULL AND r NOT IN ('', '-', 'NA')),
parents AS (
  SELECT 'node' AS target, CASE WHEN contains(id, ':') THEN lower(split_part(id, ':', 1)) || substr(id, instr(id, ':')) ELSE id END AS k, added_at, removed_at FROM merged_nodes
  UNION ALL SELECT 'edge', edge_id, added_at, removed_at FROM merged_edges),
told AS (SELECT tbl, field, row_key, strftime(ref_at, '%Y-%m') AS ref_period,
           CASE WHEN count(s.k) = 0 THEN 'missing' WHEN ref_at IS NULL THEN NULL
             WHEN bool_or(coalesce(s.added_at <= ref_at, true) AND coalesce(s.removed_at > ref_at, true)) THEN NULL
             WHEN bool_or(coalesce(s.added_at <= ref_at, true)) THEN 'deleted' ELSE 'late' END AS reason
         FROM keyed r LEFT JOIN parents s ON r.k = s.k AND r.target = s.target GROUP BY tbl, field, row_key, ref_at, r.k, r.target),
found AS (SELECT DISTINCT * FROM told WHERE reason IS NOT NULL)
"""


@REG.query(oracle=_P5 + "SELECT tbl, field, row_key, ref_period, reason FROM found")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return broken_references(*_links(spark, sf))


@REG.query(oracle=_P5 + "SELECT tbl, field, ref_period, reason, count(*) AS n FROM found GROUP BY ALL")
def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Broken references per table, field and month."""
    return broken_report(*_links(spark, sf))
