"""Identifiers: normal forms, parts, tokens and content hashes, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDERS = ("", "-", "NA", "na")


def trimmed(c: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def present(c: Column) -> Column:
    """The trimmed text, or null for null, empty and placeholder texts."""
    t = trimmed(c)
    return F.when(t.isin(*PLACEHOLDERS), None).otherwise(t)


def norm_id(c: Column) -> Column:
    """Identifiers compare trimmed and in upper case; placeholders are null."""
    return F.upper(present(c))


def norm_name(c: Column) -> Column:
    """Names compare with underscores as blanks, trimmed, in lower case."""
    return F.lower(F.trim(F.translate(c, "_", " ")))


def name_key(c: Column) -> Column:
    """The key under which names and aliases are looked up: trimmed and in lower case; null for an empty one."""
    k = F.lower(trimmed(c))
    return F.when(k == "", None).otherwise(k)


def local_id(c: Column) -> Column:
    """The part after the first colon, or the whole where there is none."""
    return F.when(c.contains(":"), F.regexp_extract(c, r"^[^:]*:(.*)$", 1)).otherwise(c)


def canon_mesh(c: Column) -> Column:
    """The accession of a MeSH identifier in upper case, or null if the part after the first colon isn't one."""
    part = F.regexp_extract(c, r"^[^:]*:(.*)$", 1)
    return F.when(part.rlike(r"(?i)^[DC][0-9]{6,}$"), F.upper(part))


def mesh_tokens(c: Column, strict: bool = False) -> Column:
    """The valid accessions of a cell parted by commas or semicolons, each once; ``strict``: a star anywhere voids the cell."""
    parts = F.transform(F.split(c, "[,;]"), lambda x: F.upper(F.trim(x)))
    valid = F.array_distinct(F.filter(parts, lambda x: x.rlike("^[DC][0-9]{6,}$")))
    return F.when(c.contains("*"), F.array().cast("array<string>")).otherwise(valid) if strict else valid


def pmid_tokens(c: Column) -> Column:
    """The all-digit tokens of a text parted by semicolons."""
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x.rlike("^[0-9]+$"))


def content_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` and 16 hex digits of the SHA-256 of the parts joined by bars; a null part is an empty one."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16))


def tree_distance(c: Column) -> Column:
    """The number after ``dist=`` in an evidence text, or null."""
    d = F.regexp_extract(c, r"dist=([0-9]+)", 1)
    return F.when(d != "", d.cast("int"))


def hash_number(seed: int | str, *parts: Column) -> Column:
    """A number below 2^32 from the SHA-256 of seed and parts: the same on every engine, partitioning and run."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
