"""What is moved, and what stays right, when tables are large or their keys are shared by many."""

import contextlib
import math
import os
import random
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from strandmill.functions import stats
from strandmill.operators import chains as ch
from strandmill.operators import graph as gr
from strandmill.plans import adapter as ad
from strandmill.plans import evidence_tables as et
from strandmill.session import settle


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def shuffled_rows(spark, run):
    """How many rows the stages of ``run`` write for a shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext.setJobGroup(group := f"shuffled-{uuid.uuid4().hex}", "rows of shuffles")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in spark.sparkContext.statusTracker().getJobIdsForGroup(group) for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds}
    moved = 0
    for s in stages:
        with contextlib.suppress(Py4JJavaError):  # a stage that was skipped and is no longer held
            moved += store.lastStageAttempt(s).shuffleWriteRecords()
    return moved


def fanned_hops(spark, edges=300, genes=100):
    """Hops of one metabolite with ``edges`` x 2 ``genes`` chains, one with edges x 1, and one dead end of 5 edges."""
    first = [(f"E{m}{i}", f"NCBITAXON:{i % 7}", "mi", "produces", f"M{m}", "me") for m, k in ((0, edges), (1, edges), (2, 5)) for i in range(k)]
    hop1 = spark.createDataFrame(first, "edge_id string, microbe_id string, microbe_name string, predicate string, metabolite_id string, metabolite_name string")
    hop2 = spark.createDataFrame([("M0", f"G{i}", "g", "1:2") for i in range(genes)] + [("M1", "GX", "g", "")], "metabolite_id string, gene_id string, gene_name string, refs string")
    hop3 = spark.createDataFrame([(f"G{i}", f"P{i}{x}") for i in range(genes) for x in "ab"], "gene string, pathway string")
    return hop1, hop2, hop3


def test_assembly_shuffles_hops_and_not_chains(spark, monkeypatch):
    hops = fanned_hops(spark)
    out = {}
    moved = shuffled_rows(spark, lambda: out.update(c=settle(ch.assemble(*hops))))
    assert moved < 10_000 and out["c"].count() == out["c"].select("chain_id").distinct().count() == 300 * 200 + 300 + 5
    monkeypatch.setattr(ch, "BLOCK_CHAINS", 500)  # 121 blocks of the first metabolite
    cut = ch.assemble(*hops)
    assert cut.exceptAll(out["c"]).isEmpty() and out["c"].exceptAll(cut).isEmpty()
    assert rows(cut.groupBy("hop_terminus").count(), "hop_terminus", "count") == [("gene", 300), ("metabolite", 5), ("pathway", 60000)]


def test_hops_read_and_move_their_columns_only(spark):
    sf = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    first, _, third = et._built_hops(spark, sf)
    assert "predicate" in plan(first) and not any(c in plan(first) for c in ("pmids", "confidence", "pub_years"))
    assert "hop3_pathway" in plan(third) and not any(c in plan(third) for c in ("microbe_name", "metabolite_chebi", "hop1_edge_id"))
    for table, some in ((ad.edges, ["subject", "pmids"]), (ad.chains, ["metabolite_name", "depth"])):
        few = table(spark, sf, *some)
        assert few.count() == table(spark, sf).count() and few.exceptAll(table(spark, sf).select(*few.columns)).isEmpty()


def test_shares_are_counted_without_making_chains(spark):
    hops = fanned_hops(spark)
    out = {}
    assert shuffled_rows(spark, lambda: out.update(s=rows(ch.shares_of_hops(*hops, 3), "metabolite_id", "n", "share"))) < 5_000
    assert out["s"] == rows(ch.metabolite_shares(ch.assemble(*hops), 3), "metabolite_id", "n", "share")
    assert [x[:2] for x in out["s"]] == [("M0", 60000), ("M1", 300), ("M2", 5)]


def test_signed_ranks_of_millions_of_ties(spark):
    n = 3_000_000  # their cube is beyond a long integer
    d = spark.range(n).select(F.when(F.col("id") % 3 == 0, -1.0).otherwise(1.0).alias("d"))
    got = stats.wilcoxon(d).select("z", "p", "r").first()
    var, dev = n * (n + 1) * (2 * n + 1) / 24 - (n**3 - n) / 48, n * (n + 1) / 6 / 2
    assert math.isclose(got.z, (dev - 0.5) / math.sqrt(var), rel_tol=1e-6) and got.p == 0 and math.isclose(got.r, 1 / 3, rel_tol=1e-5)


def test_held_graph_searches_as_joins_do(spark, monkeypatch):
    rng = random.Random(4)
    pairs = {(f"n{rng.randint(0, 150)}", f"n{rng.randint(0, 150)}") for _ in range(130)}
    adj = settle(gr.adjacency(spark.createDataFrame(sorted(pairs), "subject string, object string")), "adj")
    ids = sorted({r.a for r in adj.collect()})
    sources = spark.createDataFrame([(x,) for x in [*ids[:90], "nowhere"]], "id string")
    asked = spark.createDataFrame([(rng.choice(ids), rng.choice(ids)) for _ in range(400)] + [("nowhere", ids[0]), ("nowhere", "nowhere"), (ids[3], ids[3])], "a_id string, b_id string")
    held = rows(gr.distances(adj, sources), "src", "node", "dist"), rows(gr.asked_distances(adj, asked), "a_id", "b_id", "dist")
    moved = shuffled_rows(spark, lambda: settle(gr.distances(adj, sources)))
    monkeypatch.setattr(gr, "HELD_EDGES", 0)
    assert held == (rows(gr.distances(adj, sources), "src", "node", "dist"), rows(gr.asked_distances(adj, asked), "a_id", "b_id", "dist"))
    assert len(held[0]) > moved  # pairs are not shuffled


def test_held_distances_take_little_space(spark):
    rng = random.Random(7)
    pairs = {(f"{c}NODE:{i:07}", f"{c}NODE:{rng.randint(0, 2999):07}") for c in "AB" for i in range(3000) for _ in range(2)}
    adj = settle(gr.adjacency(spark.createDataFrame(sorted(pairs), "subject string, object string")), "adj")
    sources = spark.createDataFrame([(f"{c}NODE:{i:07}",) for c in "AB" for i in range(100)], "id string")
    out = settle(gr.distances(adj, sources), "pairs")
    folder = out._settled_at.removeprefix("file://")
    size = sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.endswith(".parquet"))
    assert out.count() > 500_000 and size < out.count()  # some 2 bytes a pair where pairs are written by source


def test_held_search_in_small_ranges_and_over_long_paths(spark, monkeypatch):
    n = 300  # a path that is longer than a byte can say, and a pair apart
    edges = [(f"p{i:03}", f"p{i + 1:03}") for i in range(n)] + [("x", "y")]
    adj = settle(gr.adjacency(spark.createDataFrame(edges, "subject string, object string")), "adj")
    sources = [*range(0, n, 9), n]
    monkeypatch.setattr(gr, "HELD_BYTES", 4 * (n + 3))  # four sources at once
    monkeypatch.setattr(gr, "GROUPS", 2)
    monkeypatch.setattr(gr, "RANGE", 64)
    got = rows(gr.distances(adj, spark.createDataFrame([(f"p{i:03}",) for i in sources] + [("y",), ("away",)], "id string")), "src", "node", "dist")
    want = [(f"p{i:03}", f"p{j:03}", abs(i - j)) for i in sources for j in range(n + 1)] + [("y", "x", 1), ("y", "y", 0), ("away", "away", 0)]
    assert got == sorted(want, key=repr)


def test_chain_null_searches_from_drawn_ends_only(spark, monkeypatch):
    pairs = [(f"a{i}", f"b{i % 40}") for i in range(200)] + [(f"b{i}", f"b{i + 1}") for i in range(39)]
    adj = settle(gr.adjacency(spark.createDataFrame(pairs, "subject string, object string")), "adj")
    nodes = spark.createDataFrame([(x, x[0].upper()) for x in sorted({y for p in pairs for y in p})], "id string, category string")
    d = gr.degrees(nodes, adj)
    pool = gr.pools(d, gr.degree_bins(d, "category"), True)
    asked = spark.createDataFrame([("b5", "a7")], "a_id string, b_id string")
    held = rows(gr.chain_null(adj, asked, pool, 6, 7), "a_id", "b_id", "d_obs", "null_mean", "null_sd", "z", "p", "n_used")
    sources = []
    monkeypatch.setattr(gr, "HELD_EDGES", 0)
    monkeypatch.setattr(gr, "waves", lambda a, s, f=gr.waves: (sources.append(s.count()), f(a, s))[1])
    assert rows(gr.chain_null(adj, asked, pool, 6, 7), "a_id", "b_id", "d_obs", "null_mean", "null_sd", "z", "p", "n_used") == held
    assert sum(sources) <= 7  # six draws and the pair itself, not the pool of 200
