"""Rules on names and sentences as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stems of causal and of correlational evidence, matched in any letter case and without word boundaries.
CAUSAL_STEMS = "induce|inhibit|prevent|attenuat|aggravat|alleviat|promot|caus(?:e|ed|ing)|reduc|improv|protect|disturb|impair|generat|produc|convert|synthes|inactivat|metaboliz"
CORRELATION_STEMS = "correlat|associat|enrich|deplet|increas|decreas|elevat|lower|higher|abundan|prevalen|alter|shift|chang"
# Predicates that state an action.
ACTIONS = ("aggravates", "alleviates", "produces", "biotransforms", "consumes", "promotes_growth", "inhibits_growth")
# The frozen lexicon of causal and correlational triggers, in its order.
CAUSAL_TRIGGERS = (
    "induces", "promotes", "inhibits", "suppresses", "increases", "decreases", "reduces", "enhances", "activates", "blocks", "causes", "leads to", "results in", "drives", "regulates", "stimulates",
    "produces", "converts", "degrades", "secret", "secrete", "secretes", "secreted", "secretion", "converts to", "degraded",
)
CORRELATIONAL_TRIGGERS = ("associated with", "correlated with", "linked to", "related to", "enriched in", "depleted in", "abundance of", "positively associated", "negatively associated", "co-occurred")
# Predicates that claim a direction and those that don't, for the audit of language against predicates.
CAUSAL_PREDICATES = ("produces", "biotransforms", "aggravates", "alleviates")
NEUTRAL_PREDICATES = ("affects", "consumes")


def strip_parenthesis(c: Column) -> Column:
    """A name without one trailing parenthesis."""
    return F.regexp_replace(c, r"\s*\([^)]*\)\s*$", "")


def unnamed_reason(c: Column) -> Column:
    """Why a feature name names no organism: genome_code, unclassified, sp_ref, or null; the first that holds. Letter case counts but in genome codes."""
    tokens = F.split(c, "_")
    return (
        F.when(F.exists(tokens, lambda x: x.rlike("(?i)^(SGB|GGB|UMGS)[0-9]+$")), "genome_code")
        .when(c.contains("_unclassified"), "unclassified")
        .when(c.contains("_sp_") | c.endswith("_sp"), "sp_ref")
    )


def matches_stem(stems: str, *texts: Column) -> Column:
    """Whether one of the stems occurs in the joined texts, in any letter case."""
    return F.concat_ws(" ", *texts).rlike(f"(?i)({stems})")


def whole_word(text: Column, word: str) -> Column:
    """Whether a word or phrase occurs between characters that are no letters, digits or underscores; the text is lower-cased first."""
    return F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}_]){word}(?![\p{{L}}\p{{N}}_])")


def lexicon_marks(text: Column, causal: Sequence[str] = CAUSAL_TRIGGERS, correlational: Sequence[str] = CORRELATIONAL_TRIGGERS) -> Column:
    """``struct(mark, hit_words, sentence_sha16, n_causal_words)``: causal before correlational before none; hits in lexicon order, causal ones first. A null text is an empty one."""
    text = F.coalesce(text, F.lit(""))

    def hits(words: Sequence[str]) -> Column:
        return F.filter(F.array(*[F.when(whole_word(text, w), F.lit(w)) for w in words]), lambda x: x.isNotNull())

    c, r = hits(causal), hits(correlational)
    mark = F.when(F.size(c) > 0, "causal").when(F.size(r) > 0, "correlational").otherwise("none")
    return F.struct(mark.alias("mark"), F.array_join(F.concat(c, r), ";").alias("hit_words"), F.substring(F.sha2(text, 256), 1, 16).alias("sentence_sha16"), F.size(c).alias("n_causal_words"))


def faithfulness(predicate: Column, mark: Column) -> Column:
    """The cell of what a predicate claims (a direction or none) against the language of its sentence (causal, correlational, none)."""
    p = F.lower(F.trim(F.coalesce(predicate, F.lit(""))))
    cell = lambda a, b, c: F.when(mark == "causal", a).when(mark == "correlational", b).otherwise(c)
    return (
        F.when(p.isin(*CAUSAL_PREDICATES), cell("correct", "overread", "no_judgement_causal"))
        .when(p.isin(*NEUTRAL_PREDICATES), cell("conservative", "consistent_conservative", "no_judgement_neutral"))
        .otherwise("unclassified_predicate")
    )


def parse_support(c: Column) -> Column:
    """``struct(edge_id, pmids)`` of a support text like ``subgraph_edge:E1|pmids:1;2``."""
    edge = F.regexp_extract(c, r"subgraph_edge:([^|]*)", 1)
    pmids = F.regexp_extract(c, r"pmids:([0-9;]*)", 1)
    return F.struct(F.when(edge != "", edge).alias("edge_id"), F.filter(F.split(pmids, ";"), lambda x: x != "").alias("pmids"))


def shown_p(p: Column) -> Column:
    """A p-value for a report; one that underflowed is shown as a bound."""
    return F.when(p.isNull(), "na").when(p == 0, "<1e-300").otherwise(F.format_string("%.6g", p))


def p_band(p: Column) -> Column:
    """significant, boundary (0.05 to 0.10, both exclusive), or not_significant; null for no p."""
    return F.when(p.isNull(), None).when(p <= 0.05, "significant").when(p < 0.10, "boundary").otherwise("not_significant")


def verdict(z: Column, p: Column) -> Column:
    """One-sided reading of a distance: na without z or p; closer or farther if significant, else boundary or not_significant."""
    return F.when(z.isNull() | p.isNull(), "na").when((p <= 0.05) & (z < 0), "closer").when(p <= 0.05, "farther").when(p < 0.10, "boundary").otherwise("not_significant")


def direction(z: Column) -> Column:
    """closer, farther or none by the sign of z; na without it."""
    return F.when(z.isNull(), "na").when(z < 0, "closer").when(z > 0, "farther").otherwise("none")


def tree_class(paths: Column, signs: str = "C23") -> Column:
    """The class of a topic by its tree numbers: signs_symptoms if one starts with ``signs``, no_tree_number without any, else disease_other."""
    under = F.exists(paths, lambda p: p.startswith(signs))
    return F.when(paths.isNull() | (F.size(paths) == 0), "no_tree_number").when(under, "signs_symptoms").otherwise("disease_other")


def snapshot_class(accession: Column, in_snapshot: Column, paths: Column, signs: str = "C23") -> Column:
    """The class of a node by its accession: malformed_id, outside_snapshot, signs_symptoms_C23 or disease_other."""
    ok = F.coalesce(accession.rlike("(?i)^[DC][0-9]{6,}$"), F.lit(False))
    under = F.exists(F.coalesce(paths, F.array().cast("array<string>")), lambda p: p.startswith(signs))
    return F.when(~ok, "malformed_id").when(~F.coalesce(in_snapshot, F.lit(False)), "outside_snapshot").when(under, F.lit(f"signs_symptoms_{signs}")).otherwise("disease_other")
