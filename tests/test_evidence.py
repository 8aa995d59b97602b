"""Hand-made vectors for the evidence-graph operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandmill.functions import ids, stats, text
from strandmill.gates import GateError, fingerprint, require_columns, require_subset, require_unique
from strandmill.operators import chains as ch
from strandmill.operators import cohort as co
from strandmill.operators import counterfactual as cf
from strandmill.operators import discovery as di
from strandmill.operators import graft as gf
from strandmill.operators import graph as gr
from strandmill.operators import naming as na
from strandmill.operators import nullmodel as nm
from strandmill.operators import reconcile as rc
from strandmill.operators import subgraph as sg
from strandmill.operators import votes as vo
from strandmill.operators.ranking import positions


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def one(spark, values, expr):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(expr(F.col("x"))).collect()]


def test_ids(spark):
    assert one(spark, [" MeSH:D1 ", "NA", None, "\tx"], ids.norm_id) == ["MESH:D1", None, None, "X"]
    assert one(spark, ["MESH:d006973", "MESH:D12", "D006973", "OMIM:MESH:D006973"], ids.canon_mesh) == ["D006973", None, None, None]
    assert one(spark, ["D006973; d000001,x;D006973", "*D006973"], ids.mesh_tokens) == [["D006973", "D000001"], []]
    assert one(spark, ["D006973,*D000002"], lambda c: ids.mesh_tokens(c, strict=True)) == [[]]
    assert one(spark, ["1; 20;x;3a", ""], ids.pmid_tokens) == [["1", "20"], []]
    assert one(spark, ["NCBITaxon:817", "817"], ids.local_id) == ["817", "817"]
    assert one(spark, ["a dist=2", "none"], ids.tree_distance) == [2, None]
    import hashlib

    want = "CH-" + hashlib.sha256(b"a||c").hexdigest()[:16]
    assert [r[0] for r in spark.range(1).select(ids.content_id("CH-", F.lit("a"), F.lit(None).cast("string"), F.lit("c"))).collect()] == [want]


def test_text_rules(spark):
    names = ["GGB12_SGB3", "x_unclassified", "Bact_sp_1", "Bact_sp", "Bact good", "x unclassified", "Bact_Unclassified", "Bact sp.", "unknown"]
    assert one(spark, names, text.unnamed_reason) == ["genome_code", "unclassified", "sp_ref", "sp_ref", None, None, None, None, None]
    assert one(spark, ["A b (x) ", "A (b) c"], text.strip_parenthesis) == ["A b", "A (b) c"]
    got = one(spark, ["It induces X and is linked to Y", "a secret", "LINKED TO y", "secretes and induces", None, "secretess", "enriched in soil, leads to"], text.lexicon_marks)
    assert [(g.mark, g.hit_words, g.n_causal_words) for g in got] == [("causal", "induces;linked to", 1), ("causal", "secret", 1), ("correlational", "linked to", 0), ("causal", "induces;secretes", 2), ("none", "", 0), ("none", "", 0), ("causal", "leads to;enriched in", 1)]
    import hashlib

    assert got[1].sentence_sha16 == hashlib.sha256(b"a secret").hexdigest()[:16]
    assert len(text.CAUSAL_TRIGGERS) == 26 and len(text.CORRELATIONAL_TRIGGERS) == 10
    stems = one(spark, ["was increased", "improves", "prevents it", "altered", "nothing", "CAUSING"], lambda c: F.concat_ws(",", F.when(text.matches_stem(text.CAUSAL_STEMS, c), "c"), F.when(text.matches_stem(text.CORRELATION_STEMS, c), "r")))
    assert stems == ["r", "c", "c", "r", "", "c"]
    cases = [("produces", "causal", "correct"), ("produces", "correlational", "overread"), ("alleviates", "none", "no_judgement_causal"), ("affects", "causal", "conservative"), (" Consumes ", "correlational", "consistent_conservative"), ("affects", "none", "no_judgement_neutral"), ("promotes_growth", "causal", "unclassified_predicate"), (None, "causal", "unclassified_predicate")]
    df = spark.createDataFrame(cases, "p string, m string, want string")
    assert [r[0] for r in df.select(text.faithfulness(F.col("p"), F.col("m"))).collect()] == [c[2] for c in cases]
    assert one(spark, ["subgraph_edge:E1|pmids:1;2", "x"], text.parse_support)[0].pmids == ["1", "2"]
    assert one(spark, ["0", "0.07", None], lambda c: text.p_band(c.cast("double"))) == ["significant", "boundary", None]
    assert one(spark, ["0", None], lambda c: text.shown_p(c.cast("double"))) == ["<1e-300", "na"]
    z = spark.createDataFrame([(-3.0, 0.01), (3.0, 0.01), (-1.0, 0.07), (0.0, 0.5), (None, 0.5)], "z double, p double")
    assert [tuple(r) for r in z.select(text.verdict(F.col("z"), F.col("p")), text.direction(F.col("z"))).collect()] == [("closer", "closer"), ("farther", "farther"), ("boundary", "closer"), ("not_significant", "none"), ("na", "na")]


def test_faithfulness_audit(spark):
    a = spark.createDataFrame([("1", "produces"), ("2", "produces"), ("3", "produces"), ("4", "affects")], "assertion_id string, predicate string")
    m = spark.createDataFrame([("1", "causal"), ("2", "correlational"), ("3", "none"), ("4", "causal")], "assertion_id string, mark string")
    r = sg.faithfulness_metrics(sg.with_marks(a, m)).first()
    assert (r.causal_total, r.neutral_total, r.overread_rate, r.direction_agreement, r.with_language_power_rate) == (3, 1, round(1 / 3, 6), 0.5, 0.75)
    with pytest.raises(GateError):
        sg.with_marks(a, m.limit(3))


def test_gates(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    with pytest.raises(GateError):
        require_columns(df, ["z"])
    with pytest.raises(GateError):
        require_unique(df.union(df), ["i"])
    with pytest.raises(GateError):
        require_subset(df, df.where("i = 1"), ["i"], "x")
    assert fingerprint(df) == fingerprint(df.repartition(3)) != fingerprint(df.union(df))
    assert fingerprint(df.fillna("")) != fingerprint(df)


def test_khop_and_seeds(spark):
    e = spark.createDataFrame([("E1", "A", "B"), ("E2", "B", "C"), ("E3", None, "C")], "edge_id string, subject string, object string")
    seeds = spark.createDataFrame([("A",)], "id string")
    for k, want in ((0, ["A"]), (1, ["A", "B"]), (2, ["A", "B", "C"])):
        assert sorted(r.id for r in sg.khop_nodes(e, seeds, k).collect()) == want
    assert rows(sg.induced(e, spark.createDataFrame([("A",), ("B",)], "id string")), "edge_id") == [("E1",)]
    a = spark.createDataFrame([("E1", "A", "B", 1), ("E1", "A", "B", 2), ("E2", "B", "C", 3)], "edge_id string, subject string, object string, doc_id int")
    fam = spark.createDataFrame([("B",)], "id string")
    lit = spark.createDataFrame([(2,)], "doc_id int")
    assert rows(sg.seed_edges(a, fam, lit), "edge_id", "provenance") == [("E1", "seed_assertion:object_in_family+pmid_in_disease_lit"), ("E2", "seed_assertion:subject_in_family")]


def test_edge_causality(spark):
    e = spark.createDataFrame([("E1", "produces"), ("E2", "produces"), ("E3", "produces"), ("E4", "affects"), ("E5", "produces")], "edge_id string, predicate string")
    a = spark.createDataFrame(
        [("E1", ["x", "x", "x"], "SUPPORTED", "it induces Y"), ("E2", ["x", "x", "z"], "OPEN", "was enriched"), ("E3", ["x", "y"], "OPEN", "improves"), ("E4", [], "OPEN", None)], "edge_id string, votes array<string>, verdict string, sentence string"
    )
    got = {r.edge_id: (r.causality, r.basis) for r in sg.edge_causality(e, a).collect()}
    assert got["E1"] == ("causal", "rule1:action+vote+causal_ev") and got["E2"] == ("correlated", "rule2:corr_ev")
    assert got["E3"] == ("unclassified", "rule3:missing=vote") and got["E4"] == ("correlated", "rule2:predicate_affects") and got["E5"] == ("unclassified", "rule3:missing=vote|causal_ev")


def test_three_buckets(spark):
    names = spark.createDataFrame([("m1", "M1"), ("g1", "G1"), ("m2", "M2"), ("g2", "G2"), ("m3", "M3"), ("m4", "M4")], "key string, node_id string")
    e = spark.createDataFrame(
        [("E1", "M1", "produces", "G1", None), ("E2", "G2", "consumes", "M2", None), ("E6", "M2", "affects", "G2", "positive"), ("E7", "M4", "affects", "G1", "negative")], "edge_id string, subject string, predicate string, object string, polarity string"
    )
    r = spark.createDataFrame([(1, "M1", "G1"), (2, " m2", "g2 "), (3, "m3", "g1"), (4, "nope", "g1"), (5, "m4", "g1"), (6, None, None)], "i int, a string, b string")
    got = {x.i: (x.bucket, x.verdict, x.edge_ids) for x in rc.three_buckets(rc.match_curated(r, names, "a", "b"), e).collect()}
    assert got == {1: ("confirm", "production_agree", "E1"), 2: ("conflict", "mixed_opposed", "E2;E6"), 3: ("extend", "", ""), 4: ("unmatched", "", ""), 5: ("conflict", "all_opposed", "E7"), 6: ("unmatched", "", "")}
    counts = {(x.bucket, x.verdict): x.n for x in rc.bucket_counts(rc.three_buckets(rc.match_curated(r, names, "a", "b"), e)).collect()}
    assert counts[None, None] == 6 and counts["conflict", "all_opposed"] == 1


def test_conflict_repair(spark):
    nodes = spark.createDataFrame([("NCBITAXON:1", "Species"), ("NCBITAXON:2", "Microbe"), ("NCBITAXON:3", "Species"), ("MESH:D003093", "Disease"), ("MESH:X1", "Disease"), ("M:1", "Metabolite")], "id string, category string")
    e = spark.createDataFrame(
        [("E1", "NCBITAXON:1", "aggravates", "MESH:D003093", ["1", "2"]), ("E2", "MESH:D003093", "aggravates", "NCBITAXON:1", ["2", "3"]), ("E3", "NCBITAXON:1", "alleviates", "MESH:D003093", ["4"]), ("E4", "NCBITAXON:2", "aggravates", "MESH:D003093", ["1"]), ("E5", "NCBITAXON:2", "alleviates", "MESH:D003093", ["9"]),
         ("E6", "NCBITAXON:3", "aggravates", "MESH:D003093", ["1"]), ("E7", "NCBITAXON:1", "affects", "MESH:D003093", ["7"]), ("E8", "NCBITAXON:1", "aggravates", "MESH:X1", ["1"]), ("E9", "NCBITAXON:1", "alleviates", "MESH:X1", ["1", "2"]), ("E10", "M:1", "aggravates", "MESH:D003093", ["1"]), ("E11", "M:1", "alleviates", "MESH:D003093", ["1", "2"])],
        "edge_id string, subject string, predicate string, object string, pmids array<string>",
    )
    led = {r.microbe_taxid: (r.disease_mesh, r.pmid_aggravates, r.pmid_alleviates, r.winner, r.action, r.edges_relabeled) for r in rc.conflict_ledger(e, nodes).collect()}
    assert led == {"1": ("D003093", 3, 1, "aggravates", "loser_relabel", 1), "2": ("D003093", 1, 1, "unresolved_tie", "tie_both_neutral", 2)}
    fixed = {r.edge_id: r.predicate for r in rc.repaired(e, nodes, rc.conflict_ledger(e, nodes)).collect()}
    changed = {k: v for k, v in fixed.items() if v != {r.edge_id: r.predicate for r in e.collect()}[k]}
    assert changed == {"E3": "affects", "E4": "affects", "E5": "affects"} and len(fixed) == 11


def test_upsert_and_closure(spark):
    e = spark.createDataFrame([("E1", "A", "p", "B", ["1"], 1, 0.2, "negative")], "edge_id string, subject string, predicate string, object string, pmids array<string>, support_count bigint, confidence double, polarity string")
    a = spark.createDataFrame([("A", "p", "B", "2", "positive", 0.9, "ok"), ("A", "p", "C", "3", "positive", 0.5, "ok"), ("A", "p", "C", "4", "negative", 0.7, "ok"), ("X", "p", "Y", "5", "positive", 0.1, "failed")], "subject string, predicate string, object string, pmid string, polarity string, confidence double, status string")
    got = {r.object: (r.pmids, r.support, r.confidence, r.polarity, r.origin) for r in rc.upsert(e, rc.increment_triples(a)).collect()}
    assert got == {"B": (["1", "2"], 2, 0.9, "negative", "appended"), "C": (["3", "4"], 2, 0.7, "positive", "tier2_increment")}
    nodes = spark.createDataFrame([("A", "n", "Species")], "id string, name string, category string")
    assert rows(rc.closure(rc.upsert(e, rc.increment_triples(a)), nodes), "id", "origin") == [("A", "main"), ("B", "constructed"), ("C", "constructed")]


def test_chain_assembly(spark):
    hop1 = spark.createDataFrame([("E1", "NCBITAXON:1", "mi", "produces", "M1", "me"), ("E2", "NCBITAXON:1", "mi", "produces", "M2", "me"), ("E3", "NCBITAXON:2", "mi", "produces", "M3", "me")], "edge_id string, microbe_id string, microbe_name string, predicate string, metabolite_id string, metabolite_name string")
    hop2 = spark.createDataFrame([("M1", "G1", "g", "1:2"), ("M1", "G2", "g", "3:4"), ("M2", "G2", "g", "5:6")], "metabolite_id string, gene_id string, gene_name string, refs string")
    hop3 = spark.createDataFrame([("G1", "P1"), ("G1", "P2")], "gene string, pathway string")
    c = ch.assemble(hop1, hop2, hop3)
    assert rows(c, "hop1_edge_id", "gene_id", "pathway", "depth", "hop_terminus", "dead_end") == [("E1", "G1", "P1", 3, "pathway", 0), ("E1", "G1", "P2", 3, "pathway", 0), ("E1", "G2", None, 2, "gene", 1), ("E2", "G2", None, 2, "gene", 1), ("E3", None, None, 1, "metabolite", 1)]
    assert c.select("chain_id").distinct().count() == 5
    ch.anchor_gate(c, hop3)
    with pytest.raises(GateError):
        ch.anchor_gate(c, hop3.where("pathway = 'P1'"))
    assert rows(ch.metabolite_shares(c, 1), "metabolite_id", "share") == [("M1", 0.6)]
    assert "hop1" in ch.explain_slots(c).first().context


def test_cohort_statistics(spark):
    m = spark.createDataFrame([("c", "f", "s1", 0.5), ("c", "f", "s2", 0.0), ("c", "g", "s1", 1.0), ("c", "g", "s2", None)], "cohort string, feature string, sample string, value double")
    assert rows(co.feature_stats(m), "feature", "median", "detection_rate") == [("f", 0.25, 0.5), ("g", 0.5, 0.5)]
    ents = spark.createDataFrame([("m1", ["1", "2"]), ("m2", []), ("m3", ["9"]), ("m4", ["5"])], "entity string, chebi array<string>")
    mapping = spark.createDataFrame([("1", "K1"), ("2", "K2"), ("5", "K9")], "chebi string, ko string")
    k = spark.createDataFrame([("c", "K1", "s1", 1.0), ("c", "K1", "s2", 1.0), ("c", "K2", "s2", 2.0)], "cohort string, feature string, sample string, value double")
    got = {r.entity: (r.n_mapped, r.label, r["median"]) for r in co.potential(ents, mapping, k, ["c"]).collect()}
    assert got == {"m1": (2, "measurable", 2.0), "m2": (0, "no_chebi", None), "m3": (0, "unmapped_chebi", None), "m4": (1, "ko_absent", None)}
    b = spark.createDataFrame([("c", "1", "genus", "f"), ("c", "1", "species", "g"), ("c", "2", "genus", "zz")], "source string, taxid string, rank_token string, feature string")
    taxa = spark.createDataFrame([("1",), ("2",), ("3",)], "taxid string")
    assert rows(co.microbe_presence(taxa, b, co.feature_stats(m), ["c"]), "taxid", "status") == [("1", "present"), ("2", "not_bridged"), ("3", "not_bridged")]


def chains3(spark):
    return spark.createDataFrame(
        [("C1", "NCBITAXON:1", "Genus one", "1", "M1", "G1", "gene1", "P1", "E1", "r", 3, 0.0), ("C2", "NCBITAXON:2", "Genus", "2", "M1", None, None, None, "E2", "", 1, 1.0), ("C3", "NCBITAXON:3", None, "3", "M2", "G2", "gene2", None, "E9", "x", 2, 1.0)],
        "chain_id string, microbe_id string, microbe_name string, taxid string, metabolite_id string, gene_id string, gene_name string, pathway string, hop1_edge_id string, refs string, depth int, penalty double",
    )


def test_votes_and_verification(spark):
    c = chains3(spark)
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    taxa = spark.createDataFrame([("3",)], "taxid string")
    assert rows(vo.external_vote(c, taxa, names("nobody"), names("genus"))) == [("C1", 1), ("C2", 0), ("C3", 1)]
    assert rows(vo.external_vote(c, taxa.limit(0), names("GENUS"), names("zz"))) == [("C1", 0), ("C2", 1), ("C3", 0)]
    by_node = spark.createDataFrame([("M1", 2)], "node string, n long")
    by_name = spark.createDataFrame([("gene2", 6)], "key string, n long")
    second = spark.createDataFrame([("NCBITAXON:1", 1)], "microbe_id string, n long")
    got = {r.chain_id: (r.n_first, r.n_second, r.vote3, r.evidence_score) for r in vo.evidence_vote(c, by_node, by_name, second).collect()}
    assert got["C1"] == (2, 1, 1, round((2 / 3 + 1 / 3 / 4) / 1.644934, 6)) and got["C2"][:3] == (2, 0, 1) and got["C3"] == (6, 0, 1, round(1 / 1.644934, 6))
    e = spark.createDataFrame([("E1", "NCBITAXON:1", "M1"), ("E2", "NCBITAXON:9", "M1")], "edge_id string, subject string, object string")
    pairs = spark.createDataFrame([("G1", "M1", "L2"), ("M1", "G1", "L1")], "subject string, object string, edge_id string")
    snap = spark.createDataFrame([("G1", "P1")], "gene string, pathway string")
    got = {r.chain_id: (r.step1, r.step2, r.step3, r.verified_rate, r.step2_support) for r in vo.verify_steps(c, e, pairs, snap).collect()}
    assert got == {"C1": (1, 1, 1, 1.0, "subgraph_edge:L1"), "C2": (0, 0, 0, 0.0, ""), "C3": (0, 0, 0, 0.0, "curated_only:x")}


def test_borda_and_counterfactual(spark):
    v = [("a", 1, 3, 0, 2), ("b", 1, 1, 1, 0), ("c", 0, 3, 0, 2)]
    df = spark.createDataFrame(v, "chain_id string, vote1 int, vote2 int, vote3 int, vote4 int")
    assert rows(vo.borda(df, ("vote1", "vote2", "vote3", "vote4")), "chain_id", "borda") == [("a", 3), ("b", 3), ("c", 2)]
    cards = df.selectExpr("*", "vote1 + vote2 + vote3 + vote4 as votes_total", "0.0 as evidence_score", "0.0 as verified_rate", "0.0 as penalty", "concat('E', chain_id) as hop1_edge_id")
    cards = vo.borda(cards, ("vote1", "vote2", "vote3", "vote4"))
    s = {(r.removed_edge, r.chain_id): r.rank_after for r in cf.remove_edges(cards, 3).collect()}
    assert s["Ea", "a"] is None and s["Ea", "c"] == 1 and s["Eb", "a"] == 1 and s["Eb", "c"] == 2
    assert {r.chain_id: r.n_out for r in cf.shift_summary(cf.remove_edges(cards, 3)).collect()} == {"a": 1, "b": 1, "c": 1}


def path_graph(spark):
    pairs = [("t2", "x"), ("x", "x2"), ("x2", "t1"), ("t1", "m1"), ("m1", "m2")]
    return gr.adjacency(spark.createDataFrame(pairs, "subject string, object string"))


def of_ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id string")


def comp_of(spark, adj, *more):
    return gr.components(adj.select(F.col("a").alias("id")).union(of_ids(spark, *more, "nil")).distinct(), adj)


def test_distances(spark):
    adj = path_graph(spark)
    a, b = of_ids(spark, "m1", "m2"), of_ids(spark, "t1", "t2")
    m = gr.distance_metrics(adj, a, b, comp_of(spark, adj)).first()
    assert (m.closest, m.all_pairs, m.inside_a, m.inside_b, m.separation) == (1.5, 3.0, 1.0, 3.0, -0.5)
    lone = of_ids(spark, "m1", "nowhere")
    m = gr.distance_metrics(adj, lone, b, comp_of(spark, adj, "nowhere")).first()
    assert m.closest is None and m.unreachable == 0.5 and m.inside_a is None
    assert rows(gr.nearest(adj, b)) == [("m1", 1), ("m2", 2), ("t1", 0), ("t2", 0), ("x", 1), ("x2", 1)]


def brute_distances(pairs):
    near = {}
    for x, y in pairs:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    out = {}
    for s in near:
        seen, level = {s: 0}, [s]
        while level:
            level = [v for u in level for v in near[u] if v not in seen and not seen.update({v: seen[u] + 1})]
        out[s] = seen
    return out


def test_searches_equal_brute_force(spark):
    import random

    rng = random.Random(12)
    pairs = [(f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}") for _ in range(45)]
    pairs = [(x, y) for x, y in pairs if x != y]
    want = brute_distances(pairs)
    adj = gr.adjacency(spark.createDataFrame(pairs, "subject string, object string"))
    ids = sorted(want)
    slots = [(x, k if k < 5 else k + 1100) for k, x in enumerate(ids)]  # two blocks
    bits = gr.waves(adj, spark.createDataFrame(slots, "id string, slot long"))
    got = {}
    for r in bits.collect():
        for x, k in slots:
            if k // gr.BLOCK == r.block and r.bits[k % gr.BLOCK // 64] >> (k % 64) & 1:
                assert (x, r.node) not in got
                got[x, r.node] = r.dist
    assert got == {(x, y): d for x in want for y, d in want[x].items()}
    assert {(r.src, r.node): r.dist for r in gr.distances(adj, of_ids(spark, *ids[:7])).collect()} == {(x, y): d for x in ids[:7] for y, d in want[x].items()}
    members = ids[::3]
    other = {x: min((d for y, d in want[x].items() if y in members and y != x), default=None) for x in members}
    assert {r.id: r.dist for r in gr.nearest_other(adj, of_ids(spark, *members)).collect()} == {x: d for x, d in other.items() if d is not None}
    tally = {}
    for x in ids[:9]:
        for y in members:
            d = want[x].get(y)
            tally[d] = tally.get(d, 0) + 1
    assert {r.dist: r.n for r in gr.distance_tally(adj, of_ids(spark, *ids[:9]), of_ids(spark, *members)).collect()} == tally
    asked = [(ids[k], ids[-k - 1]) for k in range(10)]
    found = {(r.a_id, r.b_id): r.dist for r in gr.pair_distances(adj, spark.createDataFrame(asked, "a_id string, b_id string")).collect()}
    assert found == {(x, y): want[x][y] for x, y in asked if y in want[x]}


def test_long_path_is_searched_to_its_end(spark):
    e = spark.createDataFrame([(f"p{i:03}", f"p{i + 1:03}") for i in range(80)], "subject string, object string")
    adj = gr.adjacency(e).cache()
    far = gr.nearest(adj, of_ids(spark, "p000"))
    assert far.count() == 81 and far.agg(F.max("dist")).first()[0] == 80
    assert {r.component for r in gr.components(adj.select(F.col("a").alias("id")).distinct(), adj).collect()} == {"p000"}


def test_chain_null_and_uniform_null(spark):
    pairs = [("a0", "b0")] + [(f"a{i}", f"b{(i * 3) % 8}") for i in range(8)] + [(f"b{i}", f"b{(i + 1) % 8}") for i in range(8)]
    want = brute_distances(pairs)
    adj = gr.adjacency(spark.createDataFrame(pairs, "subject string, object string"))
    nodes = spark.createDataFrame([(x, x[0].upper()) for x in sorted(want)], "id string, category string")
    d = gr.degrees(nodes, adj)
    pool = gr.pools(d, gr.degree_bins(d, "category"), True)
    asked = [("a1", "b5"), ("a2", "b2"), ("a1", "b5")]
    got = {(r.a_id, r.b_id): r for r in gr.chain_null(adj, spark.createDataFrame(asked, "a_id string, b_id string"), pool, 200, 7).collect()}
    assert len(got) == 2
    for (x, y), r in got.items():
        assert r.d_obs == want[x][y] and r.n_used == 200 and r.n_unreachable == 0 and 0 < r.p <= 1 and r.null_mean > 0
    u = gr.uniform_null(adj, nodes, 150, 3).first()
    assert u.n == 150 and u.tries >= 150 and u.sd > 0
    again = gr.uniform_null(adj, nodes.repartition(3), 150, 3).first()
    assert tuple(u) == tuple(again)
    p = gr.permutation_null(adj, of_ids(spark, "a1", "a2"), of_ids(spark, "b1", "b6"), pool, 100, 3).first()
    assert p.n + p.unreachable == 100 and p.observed == (min(want["a1"]["b1"], want["a1"]["b6"]) + min(want["a2"]["b1"], want["a2"]["b6"])) / 2
    with pytest.raises(GateError):
        gr.permutation_null(adj, of_ids(spark, "stranger"), of_ids(spark, "b1"), pool, 10, 3)


def test_read_modes(spark):
    adj = path_graph(spark)
    cards = spark.createDataFrame([("m1", "t1"), ("m2", "t2"), ("lone", "t2"), (None, "t1")], "m string, t string")
    got = rows(gr.read_modes(adj, cards, {"all": cards, "top": cards.where("m = 'm2'")}, "m", "t"))
    assert got == [("all", 3, 2, None, 0.333333, "not_computable"), ("top", 1, 1, 5.0, 0.0, "ok")]


def test_read_modes_hold_all_chains_first(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    got = entry.queries()["read_modes"](spark, sf).collect()
    chains = spark.read.parquet(f"{sf}/chains.parquet").agg(F.countDistinct("microbe_id"), F.countDistinct("metabolite_id")).first()
    assert [r["mode"] for r in got] == ["all", "top10", "top100"] and tuple(got[0])[1:3] == tuple(chains)
    best = entry.queries()["top_cards_by_votes"](spark, sf).join(spark.read.parquet(f"{sf}/chains.parquet"), "chain_id").agg(F.countDistinct("microbe_id"), F.countDistinct("metabolite_id")).first()
    assert tuple(got[2])[1:3] == tuple(best)


def test_null_model_uses_a_thousand_permutations(spark):
    import __spark_entry__ as entry

    r = entry.queries()["perm_null_closest"](spark, "/root/testdata/sf0.001").first()
    assert r.n + r.unreachable == 1000


def test_no_modulus_thins_a_table():
    import pathlib

    for p in (pathlib.Path(gr.__file__).parent.parent / "plans").glob("*.py"):
        for line in p.read_text().splitlines():
            assert not ("where(" in line and "% " in line and "== 0" in line), (p.name, line)


def test_components_and_bins(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(20)], "subject string, object string")
    nodes = spark.createDataFrame([(x,) for x in "abcdez"] + [(f"p{i:02}",) for i in range(21)], "id string")
    got = dict(rows(gr.components(nodes, gr.adjacency(e))))
    assert got["c"] == "a" and got["e"] == "d" and got["z"] == "z" and {got[f"p{i:02}"] for i in range(21)} == {"p00"}
    g = gr.lcc_gate(gr.components(nodes, gr.adjacency(e)), nodes.where("id = 'a'"), spark.createDataFrame([("gone",)], "id string")).first()
    assert (g.largest, g.targets_missing, g.passed) == (21, 1.0, False)
    degs = [1] * 5 + [2, 2, 3, 4] + [5] * 5 + [9]
    d = spark.createDataFrame([(f"n{i}", k) for i, k in enumerate(degs)], "id string, degree long")
    assert rows(gr.degree_bins(d)) == [(1, 0), (2, 1), (3, 1), (4, 1), (5, 1), (9, 1)]
    assert rows(gr.degree_bins(d.limit(2))) == [(1, 0)]


def test_draws_stay_in_the_pool(spark):
    d = spark.createDataFrame([(f"n{i:02}", "A" if i < 12 else "B", 1) for i in range(13)], "id string, category string, degree long")
    pool = gr.pools(d, gr.degree_bins(d), False)
    c = spark.createDataFrame([(f"c{i}", f"n{i % 12:02}", None) for i in range(60)] + [("cx", "n00", "n12"), ("cy", "n01", "unknown")], "chain_id string, microbe_id string, metabolite_id string")
    got = {r.chain_id: r for r in nm.random_chains(c, pool, 1, ["microbe_id", "metabolite_id"]).collect()}
    own = {r.chain_id: r.microbe_id for r in c.collect()}
    for k, r in got.items():
        if k in ("cx", "cy"):
            assert r.skipped == 1 and r.microbe_id is None
        else:
            assert r.skipped == 0 and r.microbe_id != own[k] and r.microbe_id < "n12" and r.metabolite_id is None
    assert len({r.microbe_id for r in got.values()}) > 5


def test_permutation_keeps_values(spark):
    df = spark.createDataFrame([(f"k{i:03}", f"v{i % 7}", i) for i in range(200)], "k string, v string, w int")
    p = nm.permute(df, "k", ["v"], 11)
    nm.conserved(df, p, ["v"])
    assert rows(p, "k", "w") == rows(df, "k", "w") and rows(p, "k", "v") != rows(df, "k", "v")
    assert rows(nm.permute(df.repartition(7), "k", ["v"], 11)) == rows(p)


def test_positions_equal_row_number(spark):
    df = spark.createDataFrame([("hot" if i % 3 else "b", i * 37 % 101, i) for i in range(300)], "g string, o int, i int")
    got = {r.i: r.pos for r in positions(df, ["g"], [F.col("o").asc(), F.col("i").asc()]).collect()}
    for g in ("hot", "b"):
        mine = sorted((r for r in df.collect() if r.g == g), key=lambda r: (r.o, r.i))
        assert [got[r.i] for r in mine] == list(range(1, len(mine) + 1))


def test_statistics(spark):
    f = lambda xs: stats.wilcoxon(spark.createDataFrame([(float(x),) for x in xs], "d double")).first()
    w = f([1, -2, 3, 4, -5, 6])
    assert (w.w_plus, w.w_minus, w.r) == (14.0, 7.0, round(1 / 3, 6))
    w = f([1, 1, -1, -2, 0, 0])
    assert (w.w_plus, w.w_minus, w.tie, w.n) == (4.0, 6.0, 24, 4)
    w = f([0, 0])
    assert (w.n, w.z, w.r) == (0, 0.0, 0.0)
    import math

    zs = [0.0, 0.3, 1.0, 1.96, 2.575, 3.4, 3.6, 5.0, 8.0, 20.0, -1.96, 37.0]
    ps = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(stats.two_sided(F.col("z"))).collect()]
    assert all(math.isclose(p, math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-8) for z, p in zip(zs, ps))
    assert math.isclose(f([1, -2, 3, 4, -5, 6]).p, math.erfc(abs(f([1, -2, 3, 4, -5, 6]).z) / math.sqrt(2)), rel_tol=1e-4)
    a, b = spark.createDataFrame([(0,), (0,), (1,), (1,)], "v int"), spark.createDataFrame([(1,), (1,), (2,), (2,)], "v int")
    assert stats.overlap_coefficient(a, b, "v").first().ovl == 0.5 and stats.overlap_coefficient(a, b.limit(0), "v").first().ovl is None
    r = spark.range(1).select(stats.wilson(F.lit(54), F.lit(534)).alias("w")).first().w
    assert round(r.low, 3) == 0.078 and round(r.high, 3) == 0.130
    zero = spark.createDataFrame([(0, 0)], "h int, n int").select(stats.wilson(F.col("h"), F.col("n")).alias("w")).first().w
    assert (zero.low, zero.high) == (None, None)


def test_labels(spark):
    cases = [(0.5, 0.01, 0.9, 0.9), (-0.5, 0.01, 0.5, 0.9), (0.1, 0.2, 0.6, 0.9), (0.1, 0.2, 0.9, 0.4), (0.1, 0.2, 0.7, 0.5), (0.1, None, 0.9, 0.9)]
    df = spark.createDataFrame(cases, "d double, p double, c double, v double")
    assert [r[0] for r in df.select(stats.discriminator(F.col("d"), F.col("p"), F.col("c"), F.col("v"))).collect()] == ["not_applicable", "not_applicable_reversed", "weak_ruler", "weak_ruler", "no_path_information", "no_path_information"]
    c = spark.createDataFrame([("D003093", True, ["C23.1"]), ("D003093", True, ["C01"]), ("D003093", False, None), ("X1", True, None), (None, True, None)], "a string, s boolean, p array<string>")
    assert [r[0] for r in c.select(text.snapshot_class(F.col("a"), F.col("s"), F.col("p"))).collect()] == ["signs_symptoms_C23", "disease_other", "outside_snapshot", "malformed_id", "malformed_id"]
    z = spark.createDataFrame([(1.0, 2.0), (1.0, -2.0), (None, 1.0), (0.0, 1.0)], "a double, b double")
    assert [r[0] for r in z.select(gr.consistent(F.col("a"), F.col("b"))).collect()] == ["consistent", "opposite", "undetermined", "undetermined"]
    t = spark.createDataFrame([(["C23.5"],), (["C2", "C01"],), ([],), (None,)], "p array<string>")
    assert [r[0] for r in t.select(text.tree_class(F.col("p"))).collect()] == ["signs_symptoms", "disease_other", "no_tree_number", "no_tree_number"]
    null = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    assert null.agg(stats.empirical_p(F.col("v"), F.lit(1.5))).first()[0] == 0.5


def test_open_discovery(spark):
    edges = [("L1", "S1", ["1", "2"]), ("S1", "R1", ["3"]), ("L1", "S2", ["5"]), ("S2", "R1", ["6", "1"]), ("L2", "S1", ["8"]), ("L2", "R1", ["9"]), ("L1", "H", ["1"]), ("H", "R2", ["1"])]
    edges += [("H", f"x{i}", ["0"]) for i in range(60)]
    e = spark.createDataFrame(edges, "subject string, object string, pmids array<string>")
    cats = {"L1": "D", "L2": "D", "R1": "M", "R2": "M", "S1": "S", "S2": "S", "H": "S"}
    n = spark.createDataFrame(list(cats.items()), "id string, category string")
    c = di.candidates(e, n, ["D"], ["M"], ["S"])
    assert [(r.left, r.right, r.mids, r.n_pmids) for r in c.collect()] == [("L1", "R1", ["S1", "S2"], 5)]
    assert di.ranked(c).first().rank == 1


def test_trees_and_crosswalk(spark):
    t = spark.createDataFrame([("A", "C1"), ("B", "C1.2"), ("C", "C1.2.3"), ("C", "D9"), ("D", "D9.1")], "id string, path string")
    anc = di.ancestors(t)
    assert rows(anc) == [("B", "A", 1), ("C", "A", 2), ("C", "B", 1), ("D", "C", 1)]
    got = {r.id: (r.target, r.relation, r.dist) for r in di.nearest_ancestor(spark.createDataFrame([(x,) for x in "ABCD"], "id string"), spark.createDataFrame([("B",)], "id string"), anc).collect()}
    assert got == {"A": ("B", "child_of", 1), "B": ("B", "exact", 0), "C": ("B", "parent_of", 1), "D": (None, "none", None)}
    kept, unknown = di.crosswalk_filter(spark.createDataFrame([("exact", ""), ("parent_of", "dist=4"), ("parent_of", "dist=2"), ("child_of", ""), ("odd", "")], "relation string, evidence string"))
    assert kept.count() == 2 and unknown.count() == 1


def test_name_bridge(spark):
    names = spark.createDataFrame([("1", "Alpha beta", "scientific name"), ("2", "Gamma (x)", "scientific name"), ("3", "Old name", "synonym"), ("4", "Twin a", "scientific name"), ("5", "Twin a", "scientific name"), ("6", "Animal x", "scientific name"), ("7", "Rank off", "scientific name")], "taxid string, name string, name_class string")
    parents = spark.createDataFrame([("1", "2000", "species"), ("2", "2000", "genus"), ("3", "2000", "species"), ("4", "2000", "species"), ("5", "2000", "species"), ("6", "33208", "species"), ("7", "2000", "genus"), ("2000", "2", "phylum"), ("8", None, "species")], "taxid string, parent string, rank string")
    f = na.features_of_lineages(spark.createDataFrame([(x,) for x in ("k|s__Alpha_beta", "g__Gamma", "s__Old_name", "s__Twin_a", "s__Animal_x", "s__Rank_off", "s__Nobody_here", "s__GGB1_SGB2", "k__skip")], "lineage string"))
    scope = na.scope(parents.select("taxid"), parents, ["2"], ["33208"], "1")
    assert dict(rows(scope))["8"] is False and dict(rows(scope))["1"] is True
    got = {r.name: r.status for r in na.adjudicate(f, na.match_names(f, names), scope, parents).collect()}
    assert got == {"Alpha_beta": "bridged", "Gamma": "bridged", "Old_name": "bridged", "Twin_a": "duplicate_name", "Animal_x": "kingdom_scope_empty", "Rank_off": "rank_mismatch", "Nobody_here": "name_not_found", "GGB1_SGB2": "genome_code"}


def test_time_slice_and_retrieval(spark):
    p = spark.createDataFrame([("a", "x"), ("b", "y")], "subject string, object string")
    exam = spark.createDataFrame([("a", "x"), ("b2", "y"), ("c", "z")], "subject string, object string")
    r = di.time_slice(p, exam, spark.createDataFrame([("b", "b2")], "subject string, alias string")).first()
    assert (r.n_exam, r.strict, r.bridged, r.verdict) == (3, 1, 1, "INSUFFICIENT_EXAM")
    s = spark.createDataFrame([("k1", 0.9), ("k2", 0.5), ("k1", 0.1), ("k3", 0.5)], "k string, s double")
    r = di.retrieval(s, spark.createDataFrame([("k2",), ("k3",), ("zz",)], "k string"), "k", "s").first()
    assert (r.n_exam, r.covered, r.mrr, r.hits_top) == (3, 2, round((1 / 2 + 1 / 3) / 3, 6), 2)


def test_graft_refuses_collisions(spark):
    b = spark.createDataFrame([("E1", "a", "b")], "edge_id string, subject string, object string")
    with pytest.raises(GateError):
        gf.graft(b, b)
    assert gf.graft(b, b.withColumn("edge_id", F.lit("E2")).withColumn("extra", F.lit(1))).count() == 2


def test_empty_tables_give_empty_results(spark):
    e = spark.createDataFrame([], "edge_id string, subject string, predicate string, object string, polarity string, pmids array<string>, years array<int>, support_count long, confidence double")
    n = spark.createDataFrame([], "id string, name string, category string")
    assert gr.components(n, gr.adjacency(e)).count() == 0
    assert rc.conflict_ledger(e, n).count() == 0 and di.candidates(e, n, ["D"], ["M"], ["S"]).count() == 0
    assert gr.distances(gr.adjacency(e), n).count() == 0 and sg.khop_nodes(e, n, 2).count() == 0
    assert stats.wilcoxon(spark.createDataFrame([], "d double")).first().n == 0
    assert di.year_coverage(e).first().full == 0


def test_dates_are_utc(spark):
    assert spark.createDataFrame([(dt.datetime(2025, 3, 31, 23, 30),)], "t timestamp").select(F.date_format("t", "yyyy-MM")).first()[0] == "2025-03"
