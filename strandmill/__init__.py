"""Spark-first analytics over evidence graphs: tables in, tables out, every step a declared plan."""
