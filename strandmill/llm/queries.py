"""Queries of the operators on text and matching: p3, p4, p6, p7, p8."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.encoding import TOKENIZERS, encode_texts
from strandmill.llm.leakage import leaks
from strandmill.llm.lookalike import twin_classes, twins_by_id, twins_by_name, twins_within, with_skeleton
from strandmill.llm.matching import Columns, match
from strandmill.llm.sentences import split_sentences
from strandmill.plans.registry import Registry, load

REG = Registry()

CURATED = Columns("row_index", "metabolite", "metabolite_chebi", "metabolite_kegg", "gene_id", "gene")
CHAIN = Columns("metabolite_id", "metabolite_name", "metabolite_chebi", "metabolite_kegg", "hop2_gene", "hop2_gene_name")


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    return match(load(spark, sf, "metabolite_host_gene"), load(spark, sf, "chains"), CURATED, CHAIN)


@REG.query()
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf).select(F.col("key").cast("bigint").alias("row_index"), F.col("entity").alias("metabolite_id"))


@REG.query()
def p3_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Every curated row that has a match, with the posterior of the match."""
    return _matched(spark, sf).select(F.col("key").cast("bigint").alias("row_index"), F.col("entity").alias("metabolite_id"), "confidence")


@REG.query()
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    nodes, curated, chains = (load(spark, sf, t) for t in ("merged_nodes", "metabolite_host_gene", "chains"))
    return (
        twins_within(nodes.select("id", "name")).select(F.lit("merged_nodes").alias("tbl"), "row_key", "node_id")
        .unionByName(twins_by_name(curated.select(F.col("row_index").alias("row_key"), F.col("metabolite").alias("name")), nodes.where("category = 'Metabolite'").select("id", "name")).select(F.lit("metabolite_host_gene").alias("tbl"), "row_key", "node_id"))
        .unionByName(twins_by_id(chains.select(F.col("chain_id").alias("row_key"), F.col("microbe_id").alias("id"), F.col("microbe_name").alias("name")), nodes.select("id", "name")).select(F.lit("chains").alias("tbl"), "row_key", "node_id"))
    )


@REG.query()
def p4_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every name of the three columns with its one form, and how many rows have it."""
    names = (
        load(spark, sf, "merged_nodes").select(F.lit("merged_nodes").alias("tbl"), "name")
        .unionByName(load(spark, sf, "metabolite_host_gene").select(F.lit("metabolite_host_gene").alias("tbl"), F.col("metabolite").alias("name")))
        .unionByName(load(spark, sf, "chains").select(F.lit("chains").alias("tbl"), F.col("microbe_name").alias("name")))
    )
    return with_skeleton(names.where("name is not null").groupBy("tbl", "name").agg(F.count(F.lit(1)).alias("n_rows")), "name", "form")


@REG.query()
def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every node whose name has a twin, with its class and the size of the class."""
    return twin_classes(load(spark, sf, "merged_nodes").select("id", "name"))


@REG.query()
def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_texts(load(spark, sf, "documents"), "doc_id", "text", os.path.join(os.environ.get("STRANDMILL_TOKENIZERS", TOKENIZERS), "byte_bpe_50k.tiktoken"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(load(spark, sf, "documents"), load(spark, sf, "eval_items"), "doc_id", "text", "item_id", "text", item_lang="lang")


@REG.query()
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).where("exact").select("doc_id", "item_id")


@REG.query()
def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """Each item that leaked, with the number of documents that hold a passage of it, of those that hold an edited copy only, and the best score."""
    counts = _leaks(spark, sf).groupBy("item_id").agg(F.count_if("exact").alias("n_documents"), F.count_if(~F.col("exact")).alias("n_edited"), F.max("score").alias("best_score"))
    return load(spark, sf, "eval_items").select("item_id", "lang", "split", "task").join(counts, "item_id")


@REG.query()
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_sentences(load(spark, sf, "documents"), "doc_id", "text", os.path.join(os.environ.get("STRANDMILL_TOKENIZERS", TOKENIZERS), "byte_bpe_multi_50k.tiktoken"))
