"""Readers: each gives a DataFrame with declared columns, and refuses a file that lacks them."""

from strandmill.sources.readers import (
    articles,
    csv_with_charset,
    dump_lines,
    feature_list,
    header_ids,
    lineages,
    long_matrix,
    mesh_trees,
    ncbi_names,
    ncbi_nodes,
    table_header,
    tsv,
    vote_lines,
    workbook_pairs,
)
from strandmill.sources.registry import SourceRegistry

__all__ = ["SourceRegistry", "articles", "csv_with_charset", "dump_lines", "feature_list", "header_ids", "lineages", "long_matrix", "mesh_trees", "ncbi_names", "ncbi_nodes", "table_header", "tsv", "vote_lines", "workbook_pairs"]
