"""Reports that only transcribe results."""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.gates import require_same_rows
from strandmill.operators.votes import PACK, top_cards
from strandmill.sinks.files import checksums, empty_dir, manifest, write_tsv

DISCLOSURE = ("A ranked hypothesis, not a finding.", "Votes are counts of records; no model was fitted to outcomes.")


def markdown_report(title: str, sections: Mapping[str, Any]) -> str:
    """A report from results only: scalars as lines, rows (lists of mappings) as tables."""
    out = [f"# {title}", ""]
    for name, value in sections.items():
        out += [f"## {name}", ""]
        if isinstance(value, list) and value:
            cols = list(value[0])
            out += ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *["| " + " | ".join("na" if r[c] is None else str(r[c]) for c in cols) + " |" for r in value]]
        elif isinstance(value, Mapping):
            out += [f"- {k}: {'na' if v is None else v}" for k, v in value.items()]
        else:
            out.append("none" if value in (None, [], "") else str(value))
        out.append("")
    return "\n".join(out)


def html_report(title: str, top: DataFrame, columns: Sequence[str], limit: int = 100) -> str:
    """A table of the top cards as HTML; nothing is computed here."""
    rows = top.select(*columns).limit(limit).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    notes = "".join(f"<p>{html.escape(d)}</p>" for d in DISCLOSURE)
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{notes}<table><tr>{head}</tr>{body}</table>"


def explain_chain(card: Mapping[str, Any]) -> str:
    """One card in plain words, with the labels that must go along."""
    hops = [f"{card['microbe_id']} is reported to act on {card['metabolite_id']}"]
    if card.get("gene_id"):
        hops.append(f"which is linked to {card['gene_id']}")
    if card.get("pathway"):
        hops.append(f"a member of {card['pathway']}")
    votes = f"It has {card['votes_total']} votes; {card.get('verified_rate', 0):.0%} of its steps were verified by look-up."
    return " ".join([", ".join(hops) + ".", votes, *DISCLOSURE])


def evidence_sentences(cards: DataFrame, assertions: DataFrame, most: int = 3) -> DataFrame:
    """Up to ``most`` sentences for each first edge of the cards, by PubMed id."""
    edges = cards.select(F.col("hop1_edge_id").alias("edge_id")).where("edge_id is not null").distinct()
    a = assertions.join(edges, "edge_id", "left_semi").where("sentence is not null")
    w = Window.partitionBy("edge_id").orderBy("pmid", "sentence")
    return a.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("edge_id", "n", "pmid", "sentence")


def delivery_pack(folder: str | Path, cards: DataFrame, stored_top: DataFrame, assertions: DataFrame, n: int = 100) -> dict[str, str]:
    """A folder with the top table, the details of the ten best, a manifest and checksums.

    The order is that of the pack: by votes, rank sum, verified share, penalty and id, without the evidence score.
    Refused if the ten best of the cards are not those stored before.
    """
    d = empty_dir(folder)
    best = top_cards(cards, n, PACK)
    ten = best.where("rank <= 10")
    require_same_rows(ten.select("chain_id"), stored_top.select("chain_id"), "the ten best cards differ from the stored list")
    columns = ["rank", "chain_id", "microbe_id", "metabolite_id", "gene_id", "pathway", "votes_total", "evidence_score", "borda", "verified_rate"]
    write_tsv(best, d / "top.tsv", columns, ["rank"])
    quotes: dict[str, list] = {}
    for r in evidence_sentences(ten, assertions).collect():
        quotes.setdefault(r.edge_id, []).append({"pmid": r.pmid, "sentence": r.sentence})
    details = {r.chain_id: [{"text": explain_chain(r.asDict())}, *quotes.get(r.hop1_edge_id, [])] for r in ten.collect()}
    (d / "top10.md").write_text(markdown_report("Ten best chains", {k: [{"text": x.get("text") or f"{x['pmid']}: {x['sentence']}"} for x in v] for k, v in details.items()}), encoding="utf-8")
    (d / "README.md").write_text("\n".join(["top.tsv: the best chains", "top10.md: details of the ten best", *DISCLOSURE]) + "\n", encoding="utf-8")
    manifest(d / "manifest.json", rows=best.count(), columns=columns)
    return checksums(d)
