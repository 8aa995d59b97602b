"""Graph metrics and their null models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import stats
from strandmill.functions.ids import local_id
from strandmill.operators import graft as gf
from strandmill.operators import graph as gr
from strandmill.operators import nullmodel as nm
from strandmill.operators import votes as vo
from strandmill.plans import adapter as ad
from strandmill.plans import evidence_scoring as es
from strandmill.plans import evidence_tables as et
from strandmill.plans.adapter import sql
from strandmill.plans.registry import Registry
from strandmill.session import settle

REG = Registry()
Spark = SparkSession
SEED = 20261105
N_PERM = 1000

_ADJ = """adj AS (SELECT subject AS a, object AS b FROM edges WHERE subject IS NOT NULL AND object IS NOT NULL AND subject <> object UNION SELECT object, subject FROM edges WHERE subject IS NOT NULL AND object IS NOT NULL AND subject <> object),
 deg AS (SELECT n.id, category, count(b) AS degree FROM nodes n LEFT JOIN adj ON adj.a = n.id GROUP BY 1, 2)"""


def _adj(spark: Spark, sf: str) -> DataFrame:
    return settle(gr.adjacency(ad.edges(spark, sf, "subject", "object")), "adj")


def _degrees(spark: Spark, sf: str, adj: DataFrame | None = None) -> DataFrame:
    return gr.degrees(ad.nodes(spark, sf), adj if adj is not None else gr.adjacency(ad.edges(spark, sf)))


@REG.query(oracle=sql(_ADJ + " SELECT id, category, degree, round(degree / greatest((SELECT count(*) FROM nodes) - 1, 1), 6) AS centrality FROM deg", "nodes", "edges"))
def degree(spark: Spark, sf: str) -> DataFrame:
    return _degrees(spark, sf)


# the fold with its reset: one recursive step per different degree
_BINS = """, hist AS (SELECT {k} AS k, degree, count(*) AS n, row_number() OVER (PARTITION BY {k} ORDER BY degree) AS i FROM deg GROUP BY {k}, degree),
 fold AS (SELECT k, i, degree, 0 AS bin, CASE WHEN n >= 5 THEN 1 ELSE 0 END AS next, CASE WHEN n >= 5 THEN 0 ELSE n END AS cnt FROM hist WHERE i = 1
   UNION ALL SELECT h.k, h.i, h.degree, f.next, f.next + CASE WHEN f.cnt + h.n >= 5 THEN 1 ELSE 0 END, CASE WHEN f.cnt + h.n >= 5 THEN 0 ELSE f.cnt + h.n END FROM fold f JOIN hist h ON h.k = f.k AND h.i = f.i + 1),
 bins AS (SELECT k, degree, least(bin, greatest(max(next) OVER (PARTITION BY k) - 1, 0)) AS bin FROM fold)"""


@REG.query(oracle=sql(_ADJ + _BINS.format(k="category") + " SELECT k AS category, degree, bin FROM bins", "nodes", "edges", recursive=True))
def degree_bins(spark: Spark, sf: str) -> DataFrame:
    return gr.degree_bins(_degrees(spark, sf), "category")


@REG.query(oracle=sql(_ADJ + _BINS.format(k="'all'") + " SELECT b.bin, count(*) AS members, min(d.degree) AS low, max(d.degree) AS high, count(DISTINCT category) AS categories FROM deg d JOIN bins b ON b.degree = d.degree GROUP BY b.bin", "nodes", "edges", recursive=True))
def degree_bin_profile(spark: Spark, sf: str) -> DataFrame:
    """All nodes binned together, as the random chains need it."""
    d = _degrees(spark, sf)
    return d.join(gr.degree_bins(d), "degree").groupBy("bin").agg(F.count(F.lit(1)).alias("members"), F.min("degree").alias("low"), F.max("degree").alias("high"), F.countDistinct("category").alias("categories"))


# reachability by repeated squaring is too slow as plain SQL at this size; a bounded walk by labels is enough for the data's diameter
_CC = """, lab0 AS (SELECT id, id AS l FROM nodes), """ + ", ".join(f"lab{i} AS (SELECT x.id, least(x.l, coalesce(min(y.l), x.l)) AS l FROM lab{i - 1} x LEFT JOIN adj ON adj.a = x.id LEFT JOIN lab{i - 1} y ON y.id = adj.b GROUP BY x.id, x.l)" for i in range(1, 13))


def _components(spark: Spark, sf: str) -> DataFrame:
    return gr.components(ad.nodes(spark, sf), _adj(spark, sf))


@REG.query(oracle=sql(_ADJ + _CC + " SELECT id, l AS component FROM lab12", "nodes", "edges"))
def components(spark: Spark, sf: str) -> DataFrame:
    return _components(spark, sf)


# the two sets: every disease, and every metabolite of the chains, that has a neighbour
def _sets(spark: Spark, sf: str, adj: DataFrame) -> tuple[DataFrame, DataFrame]:
    linked = adj.select(F.col("a").alias("id")).distinct()
    a = ad.nodes(spark, sf).where("category = 'Disease'").select("id").join(linked, "id", "left_semi")
    b = es.scored_chains(spark, sf).where("metabolite_id is not null").select(F.col("metabolite_id").alias("id")).distinct().join(linked, "id", "left_semi")
    return settle(a, "diseases"), settle(b, "metabolites")


_SETS = ", sa AS (SELECT id FROM deg WHERE degree > 0 AND category = 'Disease'), sb AS (SELECT DISTINCT metabolite_id AS id FROM sc WHERE metabolite_id IN (SELECT a FROM adj))"
_GRAPH = ("nodes", "edges", "chs")
_GATE = """, sz AS (SELECT l, count(*) AS n FROM lab12 GROUP BY l), gate AS (SELECT count(*) AS components, max(n) AS largest, sum(n)::BIGINT AS nodes, round(max(n) / sum(n), 6) AS lcc_share, (SELECT round(avg((id NOT IN (SELECT id FROM nodes))::INT), 6) FROM {a}) AS seeds_missing, (SELECT round(avg((id NOT IN (SELECT id FROM nodes))::INT), 6) FROM {b}) AS targets_missing FROM sz)"""
_PASSED = "lcc_share >= 0.8 AND coalesce(seeds_missing, 1) <= 0.1 AND coalesce(targets_missing, 1) <= 0.1"


@REG.query(oracle=sql(es._SCORED + ", " + _ADJ + _CC + _SETS + _GATE.format(a="sa", b="sb") + f" SELECT *, {_PASSED} AS passed FROM gate", *_GRAPH))
def lcc_gate(spark: Spark, sf: str) -> DataFrame:
    adj = _adj(spark, sf)
    return gr.lcc_gate(gr.components(ad.nodes(spark, sf), adj), *_sets(spark, sf, adj))


# levels of the searches, from each member of a set, and from all of them at once
_LEVELS = lambda n, s: f", {n}0 AS (SELECT id AS src, id AS node, 0 AS dist FROM {s})" + "".join(f", {n}{i} AS (SELECT src, node, min(dist) AS dist FROM (SELECT * FROM {n}{i - 1} UNION ALL SELECT src, b, dist + 1 FROM {n}{i - 1} JOIN adj ON a = node WHERE dist = {i - 1}) GROUP BY 1, 2)" for i in range(1, 13))
_NEAREST = lambda n: f", {n}_0 AS (SELECT id AS node, 0 AS dist FROM {n}_b)" + "".join(f", {n}_{i} AS (SELECT node, min(dist) AS dist FROM (SELECT * FROM {n}_{i - 1} UNION ALL SELECT b, dist + 1 FROM {n}_{i - 1} JOIN adj ON a = node WHERE dist = {i - 1}) GROUP BY 1)" for i in range(1, 13))


@REG.query(oracle=sql(et._FAMILY + ", " + _ADJ + _LEVELS("d", "fam") + " SELECT src, node, dist FROM d12", "nodes", "edges"))
def bfs_distances(spark: Spark, sf: str) -> DataFrame:
    """Distances from every disease of the topic's family to all it reaches."""
    return gr.distances(_adj(spark, sf), et._family(spark, sf))


@REG.query(oracle=sql(es._SCORED + ", " + _ADJ + _SETS + _LEVELS("d", "sa") + ", pd AS (SELECT sa.id AS src, sb.id AS node FROM sa, sb) SELECT dist, count(*) AS n FROM pd LEFT JOIN d12 USING (src, node) GROUP BY dist", *_GRAPH))
def distance_tally(spark: Spark, sf: str) -> DataFrame:
    adj = _adj(spark, sf)
    return gr.distance_tally(adj, *_sets(spark, sf, adj))


_METRICS = """, pd AS (SELECT sa.id AS src, sb.id AS node, dist FROM sa CROSS JOIN sb LEFT JOIN d12 ON d12.src = sa.id AND d12.node = sb.id),
 pa AS (SELECT src, min(dist) AS m FROM pd GROUP BY 1), pb AS (SELECT node, min(dist) AS m FROM pd GROUP BY 1),
 ia AS (SELECT x.id AS s, dist FROM sa x JOIN sa y ON x.id <> y.id LEFT JOIN d12 ON src = x.id AND node = y.id), ib AS (SELECT x.id AS s, dist FROM sb x JOIN sb y ON x.id <> y.id LEFT JOIN e12 ON src = x.id AND node = y.id),
 mt AS (SELECT (SELECT CASE WHEN count(m) = count(*) THEN round(avg(m), 6) END FROM pa) AS closest, (SELECT CASE WHEN count(m) = count(*) THEN round(avg(m), 6) END FROM pb) AS target_mean, (SELECT CASE WHEN count(dist) = count(*) THEN round(avg(dist), 6) END FROM pd) AS all_pairs,
  (SELECT round(avg((dist IS NULL)::INT), 6) FROM pd) AS unreachable, (SELECT CASE WHEN count(dist) = count(*) THEN (SELECT round(avg(m), 6) FROM (SELECT min(dist) AS m FROM ia GROUP BY s)) END FROM ia) AS inside_a,
  (SELECT CASE WHEN count(dist) = count(*) THEN (SELECT round(avg(m), 6) FROM (SELECT min(dist) AS m FROM ib GROUP BY s)) END FROM ib) AS inside_b)"""


@REG.query(oracle=sql(es._SCORED + ", " + _ADJ + _SETS + _LEVELS("d", "sa") + _LEVELS("e", "sb") + _METRICS + " SELECT *, round(closest - (inside_a + inside_b) / 2, 6) AS separation FROM mt", *_GRAPH))
def distance_metrics(spark: Spark, sf: str) -> DataFrame:
    adj = _adj(spark, sf)
    return gr.distance_metrics(adj, *_sets(spark, sf, adj), gr.components(ad.nodes(spark, sf), adj))


def _hash(*parts: str) -> str:
    return f"('0x' || substr(sha256(concat_ws(':', '{SEED}', {', '.join(parts)})), 1, 8))::BIGINT"


_POOL = lambda k, deg="deg": f", pool AS (SELECT id, d.category, bin, row_number() OVER (PARTITION BY d.category, bin ORDER BY id) AS pos, count(*) OVER (PARTITION BY d.category, bin) AS size FROM {deg} d JOIN bins ON bins.degree = d.degree AND bins.k = {k})"
_DRAWN = lambda n, s: f", {n}h AS (SELECT s.id, perm, p.* EXCLUDE (id), {_hash('perm::VARCHAR', 's.id')} AS h FROM (SELECT id, unnest(range(1, {N_PERM + 1})) AS perm FROM {s}) s JOIN pool p ON p.id = s.id), {n}r AS (SELECT s.perm, q.id AS draw FROM (SELECT *, h % (size - 1) + 1 + (h % (size - 1) + 1 >= pos)::INT AS at_pos FROM {n}h WHERE size > 1) s JOIN pool q ON q.pos = s.at_pos AND q.category = s.category AND q.bin = s.bin)"
_WAVE = ", w0 AS (SELECT DISTINCT perm, draw AS node, 0 AS dist FROM br)" + "".join(f", w{i} AS (SELECT perm, node, min(dist) AS dist FROM (SELECT * FROM w{i - 1} UNION ALL SELECT perm, b, dist + 1 FROM w{i - 1} JOIN adj ON a = node WHERE dist = {i - 1}) GROUP BY 1, 2)" for i in range(1, 9))


@REG.query(
    oracle=sql(
        es._SCORED + ", " + _ADJ + _SETS + ", sn_b AS (SELECT id FROM sb)" + _NEAREST("sn") + _BINS.format(k="category") + _POOL("d.category") + _DRAWN("a", "sa") + _DRAWN("b", "sb") + _WAVE
        + """, per AS (SELECT ar.perm, CASE WHEN count(dist) = (SELECT count(*) FROM sa) THEN avg(dist) END AS v FROM ar LEFT JOIN w8 ON w8.perm = ar.perm AND node = draw GROUP BY 1), ob AS (SELECT CASE WHEN count(dist) = count(*) THEN avg(dist) END AS o FROM sa LEFT JOIN sn_12 ON node = id)
SELECT round(max(o), 6) AS observed, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, CASE WHEN stddev_pop(v) > 1e-12 THEN round((max(o) - avg(v)) / stddev_pop(v), 6) END AS z, round((coalesce(sum((v <= o + 1e-12)::INT), 0) + 1) / (count(v) + 1), 6) AS p, count(v) AS n, count(*) FILTER (WHERE v IS NULL) AS unreachable FROM per, ob""",
        *_GRAPH,
        recursive=True,
    )
)
def perm_null_closest(spark: Spark, sf: str) -> DataFrame:
    """Degree-matched permutation null of the closest distance: both sets are drawn anew in each of the 1000 permutations."""
    adj = _adj(spark, sf)
    return gr.permutation_null(adj, *_sets(spark, sf, adj), _pool(spark, sf, adj), N_PERM, SEED)


def _pool(spark: Spark, sf: str, adj: DataFrame) -> DataFrame:
    d = settle(_degrees(spark, sf, adj), "degrees")
    return settle(gr.pools(d, gr.degree_bins(d, "category"), True), "pool")


_UNIFORM = (
    f""", pl AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS slot FROM nodes), tr AS (SELECT k, {_hash("'seed'", 'k::VARCHAR')} % (SELECT count(*) FROM nodes) AS s, {_hash("'target'", 'k::VARCHAR')} % (SELECT count(*) FROM nodes) AS t FROM range(0, {10 * N_PERM}) r(k)),
 en AS (SELECT k, x.id AS source, y.id AS target FROM tr JOIN pl x ON x.slot = s JOIN pl y ON y.slot = t), us AS (SELECT DISTINCT source AS id FROM en)"""
    + _LEVELS("u", "us")
    + f", ac AS (SELECT k, dist FROM en JOIN u12 ON src = source AND node = target ORDER BY k LIMIT {N_PERM}), un AS (SELECT round(avg(dist), 6) AS mean, CASE WHEN count(*) > 1 AND stddev_pop(dist) > 1e-12 THEN round(stddev_pop(dist), 6) END AS sd, count(*) AS n, coalesce(max(k), -1) + 1 AS tries FROM ac)"
)


@REG.query(oracle=sql(_ADJ + _UNIFORM + " SELECT * FROM un", "nodes", "edges"))
def uniform_null(spark: Spark, sf: str) -> DataFrame:
    """Mean and deviation of the distance between any two nodes; pairs without a path are drawn again."""
    return gr.uniform_null(_adj(spark, sf), ad.nodes(spark, sf).select("id"), N_PERM, SEED)


_MODES = {"all": "SELECT microbe_id, metabolite_id FROM sc", "top10": f"SELECT microbe_id, metabolite_id FROM cards ORDER BY {es._ORDER} LIMIT 10", "top100": "SELECT microbe_id, metabolite_id FROM cards ORDER BY votes_total DESC, borda DESC, chain_id LIMIT 100"}
_VOTES_ORDER = {"votes_total": "desc", "borda": "desc", "chain_id": "asc"}


@REG.query(
    oracle=sql(
        es._CARDS + ", " + _ADJ + _CC
        + "".join(f", {m}_p AS ({q}), {m}_a AS (SELECT DISTINCT microbe_id AS id FROM {m}_p WHERE microbe_id IS NOT NULL), {m}_b AS (SELECT DISTINCT metabolite_id AS id FROM {m}_p WHERE metabolite_id IS NOT NULL)" + _NEAREST(m) for m, q in _MODES.items())
        + " SELECT mode, seeds, targets, closest, unreachable, CASE WHEN seeds * targets = 0 THEN 'empty' WHEN unreachable > 0.5 THEN 'not_applicable' WHEN closest IS NULL THEN 'not_computable' ELSE 'ok' END AS status FROM ("
        + " UNION ALL ".join(f"SELECT '{m}' AS mode, (SELECT count(*) FROM {m}_a) AS seeds, (SELECT count(*) FROM {m}_b) AS targets, (SELECT CASE WHEN count(dist) = count(*) THEN round(avg(dist), 6) END FROM {m}_a LEFT JOIN {m}_12 ON node = id) AS closest, round(1 - (SELECT coalesce(sum(x.n * y.n), 0) FROM (SELECT l, count(*) AS n FROM {m}_a JOIN lab12 USING (id) GROUP BY l) x JOIN (SELECT l, count(*) AS n FROM {m}_b JOIN lab12 USING (id) GROUP BY l) y USING (l)) / (SELECT (SELECT count(*) FROM {m}_a) * (SELECT count(*) FROM {m}_b)), 6) AS unreachable" for m in _MODES)
        + ")",
        "nodes",
        *es._CARD_TABLES,
    )
)
def read_modes(spark: Spark, sf: str) -> DataFrame:
    """Closest distance from microbes to metabolites over all chains, the ten best cards and the hundred best by votes."""
    cards = settle(es._cards(spark, sf), "ranked")
    modes = {"all": es.scored_chains(spark, sf), "top10": vo.top_cards(cards), "top100": vo.top_cards(cards, 100, _VOTES_ORDER)}
    return gr.read_modes(_adj(spark, sf), cards, modes, "microbe_id", "metabolite_id")


# the hundred cards that come first by chain id stand for the file's order
_TOP_FILE = "tops AS (SELECT chain_id, microbe_id, gene_id FROM sc ORDER BY chain_id LIMIT 100), ta AS (SELECT DISTINCT microbe_id AS id FROM tops WHERE microbe_id IS NOT NULL), tb AS (SELECT DISTINCT gene_id AS id FROM tops WHERE gene_id IS NOT NULL)"
_SIDE = lambda z: f"""SELECT chain_id, tops.microbe_id, tops.gene_id, CASE WHEN {_PASSED} THEN {z} END AS proximity_z, round(d.degree / greatest((SELECT count(*) FROM nodes) - 1, 1), 6) AS degree_centrality_disclosed, (x.l = y.l)::INT AS community_degraded, lcc_share, seeds_missing AS seed_missing_rate, targets_missing AS target_missing_rate, (NOT ({_PASSED}))::INT AS degraded_mode
 FROM tops CROSS JOIN gate LEFT JOIN deg d ON d.id = tops.gene_id LEFT JOIN lab12 x ON x.id = tops.microbe_id LEFT JOIN lab12 y ON y.id = tops.gene_id """  # noqa: E731


@REG.query(oracle=sql(es._SCORED + ", " + _ADJ + _CC + ", " + _TOP_FILE + _GATE.format(a="ta", b="tb") + _UNIFORM + _LEVELS("o", "ta") + " " + _SIDE("round((o12.dist - (SELECT mean FROM un)) / (SELECT sd FROM un), 3)") + " LEFT JOIN o12 ON o12.src = tops.microbe_id AND o12.node = tops.gene_id", *_GRAPH))
def structure_scores(spark: Spark, sf: str) -> DataFrame:
    """The side-car of the first hundred chains: z of the distance between microbe and gene against any two nodes, centrality, community, gate."""
    adj, nodes = _adj(spark, sf), ad.nodes(spark, sf)
    cards = settle(gr.first_rows(es.scored_chains(spark, sf), 100, ["chain_id"]), "first")
    ids = lambda c: cards.select(F.col(c).alias("id")).where("id is not null").distinct()
    comp = gr.components(nodes, adj)
    null = gr.uniform_null(adj, nodes.select("id"), N_PERM, SEED)
    z = gr.pair_distances(adj, cards.select(F.col("microbe_id").alias("a_id"), F.col("gene_id").alias("b_id"))).crossJoin(F.broadcast(null)).select("a_id", "b_id", F.round((F.col("dist") - F.col("mean")) / F.col("sd"), 3).alias("z"))
    return gr.side_car(cards, "microbe_id", "gene_id", z, _degrees(spark, sf, adj), comp, gr.lcc_gate(comp, ids("microbe_id"), ids("gene_id")))


# the graph with the gene layer: each curated metabolite and gene, and each gene and pathway of the chains
_GRAFTED = """gmn AS (SELECT lower(name) AS k, min(id) AS id FROM nodes WHERE category = 'Metabolite' GROUP BY 1), base_edges AS (SELECT subject, object FROM edges),
 grafted AS (SELECT * FROM base_edges UNION ALL SELECT m.id, 'NCBIGENE:' || gene_id FROM curated JOIN gmn m ON m.k = lower(metabolite) WHERE gene_id IS NOT NULL UNION ALL SELECT gene, pathway FROM gene_pathways),
 adj AS (SELECT subject AS a, object AS b FROM grafted WHERE subject IS NOT NULL AND object IS NOT NULL AND subject <> object UNION SELECT object, subject FROM grafted WHERE subject IS NOT NULL AND object IS NOT NULL AND subject <> object),
 deg AS (SELECT n.id, category, count(b) AS degree FROM nodes n LEFT JOIN adj ON adj.a = n.id GROUP BY 1, 2)"""


def _grafted(spark: Spark, sf: str) -> DataFrame:
    """The undirected edges of the base graph with the gene–metabolite and the gene–pathway layer."""
    genes = gf.gene_layer(ad.curated(spark, sf), ad.nodes(spark, sf).where("category = 'Metabolite'"))
    paths = ad.gene_pathways(spark, sf).select(F.col("gene").alias("subject"), F.col("pathway").alias("object"))
    return settle(gr.adjacency(ad.edges(spark, sf).select("subject", "object").unionByName(genes).unionByName(paths)), "grafted")


_CHAIN_Z = ", tops AS (SELECT chain_id, microbe_id, gene_id FROM cards WHERE microbe_id IS NOT NULL AND gene_id IS NOT NULL ORDER BY votes_total DESC, borda DESC, chain_id LIMIT 100), ta AS (SELECT DISTINCT microbe_id AS id FROM sc WHERE microbe_id IS NOT NULL AND gene_id IS NOT NULL), tb AS (SELECT DISTINCT gene_id AS id FROM sc WHERE microbe_id IS NOT NULL AND gene_id IS NOT NULL), prs AS (SELECT DISTINCT microbe_id AS a_id, gene_id AS b_id FROM tops)"
_DRAW_END = lambda t: f"{_hash(chr(39) + t + chr(39), 'perm::VARCHAR', 'a_id', 'b_id')} % (s{t} - 1) + 1"
_CHAIN_NULL = (
    ", ends AS (SELECT prs.*, perm, x.category AS ca, x.bin AS ba, x.pos AS pa, x.size AS sa_, y.category AS cb, y.bin AS bb, y.pos AS pb, y.size AS sb_ FROM prs JOIN pool x ON x.id = a_id JOIN pool y ON y.id = b_id, range(1, " + str(N_PERM + 1) + ") r(perm))"
    + f", placed AS (SELECT *, {_DRAW_END('a').replace('sa ', 'sa_ ')} AS da, {_DRAW_END('b').replace('sb ', 'sb_ ')} AS db FROM ends), dw AS (SELECT p.a_id, p.b_id, perm, q.id AS na, r.id AS nb FROM placed p JOIN pool q ON q.category = ca AND q.bin = ba AND q.pos = da + (da >= pa)::INT JOIN pool r ON r.category = cb AND r.bin = bb AND r.pos = db + (db >= pb)::INT), ss AS (SELECT DISTINCT na AS id FROM dw UNION SELECT a_id FROM prs)"
    + _LEVELS("g", "ss")
    + """, ob AS (SELECT a_id, b_id, dist AS d_obs FROM prs LEFT JOIN g12 ON src = a_id AND node = b_id), nl AS (SELECT dw.a_id, dw.b_id, avg(g.dist) AS mean, stddev_pop(g.dist) AS sd, count(g.dist) AS n_used, count(*) FILTER (WHERE g.dist <= d_obs) AS below FROM dw JOIN ob ON ob.a_id = dw.a_id AND ob.b_id = dw.b_id LEFT JOIN g12 g ON g.src = na AND g.node = nb GROUP BY 1, 2),
 cn AS (SELECT ob.a_id, ob.b_id, d_obs, CASE WHEN d_obs IS NOT NULL AND n_used > 1 THEN round(mean, 6) END AS null_mean, CASE WHEN d_obs IS NOT NULL AND n_used > 1 THEN round(sd, 6) END AS null_sd, CASE WHEN d_obs IS NOT NULL AND n_used > 1 AND sd > 1e-12 THEN round((d_obs - mean) / sd, 6) END AS z, CASE WHEN d_obs IS NOT NULL AND n_used > 0 THEN round((below + 1) / (n_used + 1), 6) END AS p, n_used, """
    + str(N_PERM) + """ - n_used AS n_unreachable FROM ob JOIN nl ON nl.a_id = ob.a_id AND nl.b_id = ob.b_id)"""
)
_ACTIVE = es._CARDS + ", " + _GRAFTED + _CC + _CHAIN_Z + _GATE.format(a="ta", b="tb") + _BINS.format(k="category") + _POOL("d.category") + _CHAIN_NULL


@dataclass
class _Active:
    """The grafted graph with what the activation needs."""

    adj: DataFrame
    degrees: DataFrame
    pool: DataFrame
    tops: DataFrame
    pairs: DataFrame


def _active(spark: Spark, sf: str) -> _Active:
    adj = _grafted(spark, sf)
    d = settle(_degrees(spark, sf, adj), "degrees")
    pool = settle(gr.pools(d, gr.degree_bins(d, "category"), True), "pool")
    tops = settle(vo.top_cards(es._cards(spark, sf).where("microbe_id is not null and gene_id is not null"), 100, _VOTES_ORDER), "tops")
    return _Active(adj, d, pool, tops, tops.select(F.col("microbe_id").alias("a_id"), F.col("gene_id").alias("b_id")).distinct())


@REG.query(oracle=sql(_ACTIVE + " SELECT * FROM cn", "nodes", *es._CARD_TABLES, recursive=True))
def chain_null(spark: Spark, sf: str) -> DataFrame:
    """Distance of microbe and gene of the hundred best cards against 1000 degree-matched pairs each, on the grafted graph."""
    x = _active(spark, sf)
    return gr.chain_null(x.adj, x.pairs, x.pool, N_PERM, SEED)


@REG.query(oracle=sql(_ACTIVE + " " + _SIDE("cn.z") + " LEFT JOIN cn ON cn.a_id = tops.microbe_id AND cn.b_id = tops.gene_id", "nodes", *es._CARD_TABLES, recursive=True))
def activation(spark: Spark, sf: str) -> DataFrame:
    """The side-car of the hundred best cards on the grafted graph: gate over all chains with a gene, z of each chain against its own null."""
    x = _active(spark, sf)
    comp = gr.components(ad.nodes(spark, sf), x.adj)
    all_chains = es.scored_chains(spark, sf).where("microbe_id is not null and gene_id is not null")
    ids = lambda c: all_chains.select(F.col(c).alias("id")).distinct()
    return gr.side_car(x.tops, "microbe_id", "gene_id", gr.chain_null(x.adj, x.pairs, x.pool, N_PERM, SEED), x.degrees, comp, gr.lcc_gate(comp, ids("microbe_id"), ids("gene_id")))


@REG.query(oracle=sql(es._SCORED + ", " + _GRAFTED + _CHAIN_Z.split(", prs AS")[0].split("), ta AS", 1)[1].join([", ta AS", ""]) + ", sn_b AS (SELECT id FROM tb)" + _NEAREST("sn") + " SELECT (SELECT count(*) FROM ta) AS seeds, (SELECT count(*) FROM tb) AS targets, (SELECT CASE WHEN count(dist) = count(*) THEN round(avg(dist), 6) END FROM ta LEFT JOIN sn_12 ON node = id) AS closest, (SELECT count(*) FROM ta LEFT JOIN sn_12 ON node = id WHERE dist IS NULL) AS lost", "nodes", "curated", "gene_pathways", "edges"))
def activation_population(spark: Spark, sf: str) -> DataFrame:
    """Closest distance from all microbes to all genes of the chains on the grafted graph."""
    adj = _grafted(spark, sf)
    c = es.scored_chains(spark, sf).where("microbe_id is not null and gene_id is not null")
    a, b = (settle(c.select(F.col(x).alias("id")).distinct(), "set") for x in ("microbe_id", "gene_id"))
    near = a.join(gr.nearest(adj, b).withColumnRenamed("node", "id"), "id", "left")
    return near.agg(F.count(F.lit(1)).alias("seeds"), F.when(F.count("dist") == F.count(F.lit(1)), F.round(F.avg("dist"), 6)).alias("closest"), F.count_if(F.col("dist").isNull()).alias("lost")).crossJoin(b.agg(F.count(F.lit(1)).alias("targets"))).select("seeds", "targets", "closest", "lost")


def _perm_sql(columns: tuple[str, ...], where: str) -> str:
    cols = ", ".join(f"b.{c}" for c in columns)
    return f"src AS (SELECT * FROM sc WHERE {where}), pl AS (SELECT * EXCLUDE ({', '.join(columns)}), row_number() OVER (ORDER BY chain_id) AS pos FROM src), dn AS (SELECT {', '.join(columns)}, row_number() OVER (ORDER BY {_hash('chain_id')}, chain_id) AS pos FROM src), shf AS (SELECT pl.*, {cols} FROM pl JOIN dn b USING (pos))"


@REG.query(oracle=sql(es._SCORED + ", " + _perm_sql(("gene_id", "gene_name"), "gene_id IS NOT NULL") + " SELECT chain_id, metabolite_id, gene_id, gene_name FROM shf", "chs"))
def gene_shuffle(spark: Spark, sf: str) -> DataFrame:
    """Gene id and name permuted together among the rows that have a gene."""
    c = es.scored_chains(spark, sf).where("gene_id is not null").select("chain_id", "metabolite_id", "gene_id", "gene_name")
    return nm.permute(c, "chain_id", ["gene_id", "gene_name"], SEED)


def _all_chains(spark: Spark, sf: str) -> tuple[es.Base, es.Lookups]:
    b = es.base(spark, sf)
    return b, es.lookups(spark, sf, b.chains)


def _shuffled_votes(spark: Spark, sf: str, columns: list[str], where: str) -> DataFrame:
    """``chain_id, x, y, d, same``: votes of every chain and of its copy with permuted columns; chains outside of ``where`` keep theirs. Refused if the permutation changed the columns' values."""
    b, look = _all_chains(spark, sf)
    part = b.chains.where(where)
    moved = settle(nm.permute(part, "chain_id", columns, SEED), "shuffled")
    nm.conserved(part, moved, columns)
    real = settle(look.votes(b.chains, b.hot).select("chain_id", "votes_total", "vote4", *columns), "votes")
    null = settle(look.votes(moved, b.hot).select("chain_id", F.col("votes_total").alias("after"), F.col("vote4").alias("after4"), *[F.col(c).alias(f"new_{c}") for c in columns]), "null-votes")
    j = real.join(null, "chain_id", "left")
    same = F.col(columns[0]).eqNullSafe(F.col(f"new_{columns[0]}")) & F.col("after").isNotNull()
    return settle(j.select("chain_id", F.col("votes_total").alias("x"), F.coalesce("after", "votes_total").alias("y"), (F.col("votes_total") - F.coalesce("after", "votes_total")).alias("d"), F.col("after").isNotNull().cast("int").alias("moved"), same.cast("int").alias("same"), "vote4", F.coalesce("after4", "vote4").alias("after4")), "pairs")


_LOOK = es._PRESENCE + ", " + es._POTENTIAL + ", " + et._BUCKETS + ", " + es._V3.split(" b2 AS")[0].rstrip().rstrip(",") + ", b2 AS (SELECT subject, count(*) AS n FROM edges WHERE predicate = 'increases_abundance_in' AND subject IS NOT NULL GROUP BY 1), " + es._LISTS + ", ms AS (SELECT entity, max((label = 'measurable')::INT) AS measurable, max((n_mapped > 0)::INT) AS computable FROM pot GROUP BY 1)"
_VOTED = lambda t, n: f", {n}1 AS ({es._HIT1(t)}), {n}4 AS ({es._HIT4(t)}), {n}v AS (SELECT t.chain_id, coalesce(t.microbe_id IN (SELECT microbe_id FROM {n}1 WHERE microbe_id IS NOT NULL), false)::INT AS vote1, t.depth AS vote2, (coalesce(m.n, 0) + coalesce(b.n, 0) + coalesce(g.n, 0) + coalesce(s.n, 0) > 0)::INT AS vote3, coalesce(ms.measurable, 0) + coalesce(t.microbe_id IN (SELECT microbe_id FROM {n}4 WHERE microbe_id IS NOT NULL), false)::INT AS vote4, 1 + coalesce(ms.computable, 0) AS computable FROM {t} t LEFT JOIN bn m ON m.node = t.microbe_id LEFT JOIN bn b ON b.node = t.metabolite_id LEFT JOIN bk g ON g.key = lower(trim(t.gene_name)) LEFT JOIN b2 s ON s.subject = t.microbe_id LEFT JOIN ms ON ms.entity = t.metabolite_id), {n}t AS (SELECT *, vote1 + vote2 + vote3 + vote4 AS total FROM {n}v)"
_SHUF = lambda columns, where: _LOOK + ", " + _perm_sql(columns, where) + _VOTED("sc", "r") + _VOTED("shf", "n") + ", df AS (SELECT rt.chain_id, rt.total AS x, coalesce(nt.total, rt.total) AS y, rt.total - coalesce(nt.total, rt.total) AS d FROM rt LEFT JOIN nt USING (chain_id))"
_GENES, _METABOLITES = _SHUF(("gene_id", "gene_name"), "gene_id IS NOT NULL"), _SHUF(("metabolite_id",), "true")
_TABLES = ("names", "edges", "chs", "curated")
_WILCOXON = """, h AS (SELECT abs(d) AS a, count(*) AS t, sum((d > 0)::INT) AS up FROM df WHERE d <> 0 GROUP BY 1), rk AS (SELECT *, coalesce(sum(t) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS r FROM h),
 s AS (SELECT coalesce(sum(t), 0)::BIGINT AS n, coalesce(sum(r * up), 0)::DOUBLE AS w_plus, coalesce(sum(r * (t - up)), 0)::DOUBLE AS w_minus, coalesce(sum(t * t * t - t), 0)::BIGINT AS tie FROM rk),
 wx AS (SELECT n, w_plus, w_minus, tie, round(CASE WHEN n > 0 AND n * (n + 1.0) * (2 * n + 1) / 24 - tie / 48 > 0 THEN (w_plus - n * (n + 1.0) / 4 - CASE WHEN w_plus - n * (n + 1.0) / 4 < 0 THEN -0.5 ELSE 0.5 END) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - tie / 48) ELSE 0 END, 6) AS z, round(CASE WHEN n > 0 AND n * (n + 1.0) * (2 * n + 1) / 24 - tie / 48 > 0 THEN (w_plus - w_minus) / (n * (n + 1.0) / 2) ELSE 0 END, 6) AS r FROM s)"""


@REG.query(oracle=sql(_GENES + " SELECT chain_id, x, y, d FROM df", *_TABLES))
def gene_shuffle_votes(spark: Spark, sf: str) -> DataFrame:
    """Votes before and after the genes are permuted among the rows that have one; only vote 3 can change."""
    return _shuffled_votes(spark, sf, ["gene_id", "gene_name"], "gene_id is not null").select("chain_id", "x", "y", "d")


@REG.query(oracle=sql(_METABOLITES + " SELECT chain_id, x, y, d FROM df", *_TABLES))
def metabolite_shuffle(spark: Spark, sf: str) -> DataFrame:
    """Votes before and after the metabolites are permuted over all rows; votes 3 and 4 are made again."""
    return _shuffled_votes(spark, sf, ["metabolite_id"], "true").select("chain_id", "x", "y", "d")


@REG.query(oracle=sql(_METABOLITES + " SELECT 'values' AS invariant, 0::BIGINT AS broken UNION ALL SELECT 'vote4_sum', (SELECT sum(vote4) FROM rt)::BIGINT - (SELECT sum(vote4) FROM nt)::BIGINT", *_TABLES))
def shuffle_invariants(spark: Spark, sf: str) -> DataFrame:
    """What a permutation of the metabolites must leave as it is: their multiset (refused if not) and the sum of vote 4."""
    d = _shuffled_votes(spark, sf, ["metabolite_id"], "true").agg((F.sum("vote4") - F.sum("after4")).cast("bigint").alias("v"))
    return d.select(F.explode(F.array(F.struct(F.lit("values").alias("invariant"), F.lit(0).cast("bigint").alias("broken")), F.struct(F.lit("vote4_sum").alias("invariant"), F.col("v").alias("broken")))).alias("r")).select("r.*")


@REG.query(oracle=sql(_METABOLITES + _WILCOXON + " SELECT n, w_plus, w_minus, tie, z, r FROM wx", *_TABLES))
def wilcoxon(spark: Spark, sf: str) -> DataFrame:
    """Signed-rank test of the votes of real chains against those with a permuted metabolite."""
    return stats.wilcoxon(_shuffled_votes(spark, sf, ["metabolite_id"], "true")).drop("p")


@REG.query(oracle=sql(_GENES + _WILCOXON + " SELECT n, w_plus, w_minus, tie, z, r FROM wx", *_TABLES))
def wilcoxon_genes(spark: Spark, sf: str) -> DataFrame:
    return stats.wilcoxon(_shuffled_votes(spark, sf, ["gene_id", "gene_name"], "gene_id is not null")).drop("p")


@REG.query(oracle=sql(_METABOLITES + " SELECT count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(avg(x - y), 6) AS mean_diff, round(median(x - y), 6) AS median_diff, round(CASE WHEN var_pop(x) > 0 THEN var_pop(y) / var_pop(x) ELSE 0 END, 6) AS variance_ratio FROM df", *_TABLES))
def paired_stats(spark: Spark, sf: str) -> DataFrame:
    return stats.paired_stats(_shuffled_votes(spark, sf, ["metabolite_id"], "true"), "x", "y")


@REG.query(oracle=sql(_METABOLITES + ", pa AS (SELECT x AS v, count(*) / sum(count(*)) OVER () AS p FROM df GROUP BY x), pb AS (SELECT y AS v, count(*) / sum(count(*)) OVER () AS p FROM df GROUP BY y) SELECT round(sum(least(coalesce(pa.p, 0), coalesce(pb.p, 0))), 6) AS ovl FROM pa FULL JOIN pb ON pa.v = pb.v", *_TABLES))
def overlap_coefficient(spark: Spark, sf: str) -> DataFrame:
    d = _shuffled_votes(spark, sf, ["metabolite_id"], "true")
    return stats.overlap_coefficient(d.select(F.col("x").alias("v")), d.select(F.col("y").alias("v")), "v")


_SLOTS = ("microbe_id", "metabolite_id", "gene_id", "pathway")
# random chains are made of nodes that occur in chains, binned by their degree in the graph
_RANDOM = (
    "used AS (" + " UNION ".join(f"SELECT {s} AS id FROM sc WHERE {s} IS NOT NULL" for s in _SLOTS) + "), " + _ADJ + ", dch AS (SELECT * FROM deg WHERE id IN (SELECT id FROM used))" + _BINS.format(k="'all'").replace("FROM deg", "FROM dch") + _POOL("'all'", "dch")
    + f""", sl AS (SELECT chain_id, 'microbe_id' AS slot, microbe_id AS id FROM sc UNION ALL SELECT chain_id, 'metabolite_id', metabolite_id FROM sc UNION ALL SELECT chain_id, 'gene_id', gene_id FROM sc UNION ALL SELECT chain_id, 'pathway', pathway FROM sc),
 pk AS (SELECT s.chain_id, s.slot, p.category, p.bin, CASE WHEN size > 1 THEN {_hash('chain_id', 'slot')} % (size - 1) + 1 + ({_hash('chain_id', 'slot')} % (size - 1) + 1 >= pos)::INT END AS at_pos FROM (SELECT * FROM sl WHERE id IS NOT NULL) s LEFT JOIN pool p ON p.id = s.id),
 dr AS (SELECT chain_id, slot, q.id AS draw FROM pk LEFT JOIN pool q ON q.category = pk.category AND q.bin = pk.bin AND q.pos = pk.at_pos),
 rnd AS (SELECT chain_id, max((draw IS NULL)::INT) AS skipped, """
    + ", ".join(f"max(draw) FILTER (WHERE slot = '{s}') AS {s}" for s in _SLOTS)
    + " FROM dr GROUP BY chain_id)"
)


def _random(spark: Spark, sf: str, chains: DataFrame, edges: DataFrame) -> DataFrame:
    used = chains.select(F.explode(F.array(*_SLOTS)).alias("id")).where("id is not null").distinct()
    d = settle(gr.degrees(ad.nodes(spark, sf), gr.adjacency(edges)).join(used, "id", "left_semi"), "degrees")
    pool = settle(gr.pools(d, gr.degree_bins(d), False), "pool")
    return settle(nm.random_chains(chains, pool, SEED, _SLOTS), "draws")


@REG.query(oracle=sql(es._SCORED + ", " + _RANDOM + " SELECT chain_id, skipped, " + ", ".join(f"CASE WHEN skipped = 0 THEN {s} END AS {s}" for s in _SLOTS) + " FROM rnd", "nodes", "edges", "chs", recursive=True))
def degree_matched_chains(spark: Spark, sf: str) -> DataFrame:
    return _random(spark, sf, es.scored_chains(spark, sf), ad.edges(spark, sf))


@REG.query(oracle=sql(es._SCORED + ", " + _RANDOM + ", kept AS (SELECT unnest([" + ", ".join(_SLOTS) + "]) AS id FROM rnd WHERE skipped = 0) SELECT (SELECT count(*) FROM rnd) AS n_chains, (SELECT sum(skipped)::BIGINT FROM rnd) AS n_skipped, count(id) AS n_draws, count(DISTINCT id) AS n_nodes, count(id) - count(DISTINCT id) AS n_duplicate_draws FROM kept", "nodes", "edges", "chs", recursive=True))
def degree_matched_report(spark: Spark, sf: str) -> DataFrame:
    return nm.draw_report(_random(spark, sf, es.scored_chains(spark, sf), ad.edges(spark, sf)), _SLOTS)


def _arm(spark: Spark, sf: str, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(votes of the real chains, votes of their degree-matched copies) over one set of edges."""
    b = es.base(spark, sf)
    draws = _random(spark, sf, b.chains, edges).where("skipped = 0")
    names = ad.nodes(spark, sf).select("id", "name")
    microbes = names.select(F.col("id").alias("microbe_id"), F.col("name").alias("microbe_name"), local_id(F.col("id")).alias("taxid"))
    null = draws.join(microbes, "microbe_id", "left").join(names.select(F.col("id").alias("gene_id"), F.col("name").alias("gene_name")), "gene_id", "left").join(b.chains.select("chain_id", "depth"), "chain_id")
    votes = ("chain_id", "vote1", "vote2", "vote3", "vote4", "votes_total", "computable")
    real = settle(es.lookups(spark, sf, b.chains).votes(b.chains, b.hot).select(*votes), "real")
    return real, settle(es.lookups(spark, sf, microbes).votes(settle(null, "null")).select(*votes), "null-votes")


_RANDOM_VOTES = (
    _LOOK + ", " + _RANDOM
    + ", rc AS (SELECT r.chain_id, r.microbe_id, m.name AS microbe_name, regexp_replace(r.microbe_id, '^[^:]*:', '') AS taxid, r.metabolite_id, g.name AS gene_name, s.depth FROM rnd r JOIN sc s USING (chain_id) LEFT JOIN nodes m ON m.id = r.microbe_id LEFT JOIN nodes g ON g.id = r.gene_id WHERE skipped = 0)"
    + _VOTED("sc", "r") + _VOTED("rc", "n")
    + ", bth AS (SELECT r.*, n.vote1 AS n1, n.vote2 AS n2, n.vote3 AS n3, n.vote4 AS n4, n.total AS nt, n.computable AS nc, n.chain_id IS NOT NULL AS made FROM rt r LEFT JOIN nt n USING (chain_id))"
)
_VOTE_ROW = lambda v, x, y: f"SELECT '{v}' AS vote, round(avg({x}), 6) AS mean_all, round(avg({x}) FILTER (WHERE made), 6) AS mean_kept, round(avg({y}), 6) AS mean_null, round(count(*) FILTER (WHERE made) / count(*), 6) AS made_share FROM bth"
_ALL_VOTES = {"vote1": "n1", "vote2": "n2", "vote3": "n3", "vote4": "n4", "votes_total": "nt", "computable": "nc"}


@REG.query(oracle=sql(_RANDOM_VOTES + " " + " UNION ALL ".join(_VOTE_ROW(v, "total" if v == "votes_total" else v, n) for v, n in _ALL_VOTES.items()), *_TABLES, recursive=True))
def random_chain_votes(spark: Spark, sf: str) -> DataFrame:
    """All votes of the real chains against those made anew on their degree-matched random copies."""
    return nm.paired_votes(*_arm(spark, sf, ad.edges(spark, sf)), tuple(_ALL_VOTES))


@REG.query()
def degree_matched_arms(spark: Spark, sf: str) -> DataFrame:
    """The degree-matched null over two sets of edges: paired statistics, test, overlap, selection by skipping, and what a comparison without a difference would mean. No SQL: it has no erfc."""
    e = ad.edges(spark, sf)
    out = None
    for arm in ("curated", "llm_extracted"):
        row = nm.arm_row(arm, *_arm(spark, sf, e.where(F.col("source_type") == arm)))
        out = row if out is None else out.unionByName(row)
    return out
