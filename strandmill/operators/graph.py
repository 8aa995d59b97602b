"""Distances, components, degrees and distance statistics of the undirected evidence graph."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.ids import hash_number
from strandmill.gates import require_empty
from strandmill.operators.ranking import positions
from strandmill.session import Levels, forget, settle

MIN_BIN = 5


def adjacency(edges: DataFrame) -> DataFrame:
    """``a, b``: each undirected pair of different ends in both directions, once."""
    e = edges.where("subject is not null and object is not null and subject <> object").select(F.col("subject").alias("a"), F.col("object").alias("b"))
    return e.union(e.select("b", "a")).distinct()


def degrees(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """``id, degree, centrality`` for every node: different neighbours, and their share of all other nodes; 0 without any."""
    d = adj.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    j = nodes.select("id", "category").join(d, "id", "left").crossJoin(F.broadcast(n))
    return j.select("id", "category", F.coalesce("degree", F.lit(0)).alias("degree"), F.round(F.coalesce("degree", F.lit(0)) / F.greatest(F.col("n") - 1, F.lit(1)), 6).alias("centrality"))


def degree_bins(degree_table: DataFrame, by: str | None = None, least: int = MIN_BIN) -> DataFrame:
    """``[by,] degree, bin``: exact degrees taken in ascending order until a bin has ``least`` members; a rest joins the last bin.

    The fold with its reset runs over the histogram of degrees: two numbers for each different degree of a category,
    which are at most as many as the square root of twice its edges. It emits one entry per bin, so nothing is copied
    at each step, and degrees meet their bin by range.
    """
    keys = [by] if by else []
    h = degree_table.groupBy(*keys, "degree").agg(F.count(F.lit(1)).alias("n"))
    folded = h.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("degree").cast("long").alias("degree"), "n"))).alias("h"))

    @F.pandas_udf("array<int>")
    def bins_of(histograms: pd.Series) -> pd.Series:
        out = []
        for rows in histograms:
            number, held, own = 0, 0, []
            for r in rows:
                own.append(number)
                held += r["n"]
                if held >= least:
                    number, held = number + 1, 0
            out.append([min(b, max(number - 1, 0)) for b in own])
        return pd.Series(out)

    rows = folded.select(*keys, F.explode(F.arrays_zip("h", bins_of("h").alias("b"))).alias("o"))
    return rows.select(*keys, F.col("o.h.degree").alias("degree"), F.col("o.b").alias("bin"))


def distances(adj: DataFrame, sources: DataFrame) -> DataFrame:
    """``src, node, dist``: steps from each source to each node it reaches; unreached nodes have no row.

    A graph that a task can hold is searched in memory, and its pairs go out in an order that packs well. Else all sources advance
    together, one level per round, until a level is empty. A neighbour of a node at distance k is at k - 1, k or k + 1, so
    that a round only looks at the last two levels.
    """
    if (graph := held_graph(adj)) is not None:
        return graph.distances(sources)
    levels = Levels(adj.sparkSession, "bfs")
    last = levels.write(0, sources.select(F.col("id").alias("src"), F.col("id").alias("node")).distinct())
    before, hop = last.limit(0), 0
    while not last.isEmpty():
        hop += 1
        new = last.join(adj, last["node"] == adj["a"]).select("src", F.col("b").alias("node")).distinct()
        new = new.join(before.unionByName(last), ["src", "node"], "left_anti")
        before, last = last, levels.write(hop, new)
    return levels.all()


def nearest(adj: DataFrame, targets: DataFrame) -> DataFrame:
    """``node, dist``: steps to the nearest target, by one search from all targets at once, until a level is empty."""
    levels = Levels(adj.sparkSession, "near")
    last = levels.write(0, targets.select(F.col("id").alias("node")).distinct())
    before, hop = last.limit(0), 0
    while not last.isEmpty():
        hop += 1
        new = last.join(adj, last["node"] == adj["a"]).select(F.col("b").alias("node")).distinct()
        before, last = last, levels.write(hop, new.join(before.unionByName(last), "node", "left_anti"))
    return levels.all()


def nearest_other(adj: DataFrame, members: DataFrame) -> DataFrame:
    """``id, dist``: steps from each member to the nearest other member; no row where it reaches none.

    One search from all members, in which each node remembers the two members that came first (of equally near ones the
    smaller ids): at most two rows for each node, however many members there are.
    """
    levels = Levels(adj.sparkSession, "other")
    last = levels.write(0, members.select(F.col("id").alias("node"), F.col("id").alias("src")).distinct())
    hop = 0
    while not last.isEmpty():
        hop += 1
        known = levels.all()
        new = last.join(adj, last["node"] == adj["a"]).select(F.col("b").alias("node"), "src").distinct().join(known.select("node", "src"), ["node", "src"], "left_anti")
        full = known.groupBy("node").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("node")
        new = new.join(full, "node", "left_anti")
        one = new.groupBy("node").agg(F.min("src").alias("first"))
        two = new.join(one, "node").groupBy("node", "first").agg(F.min(F.when(F.col("src") > F.col("first"), F.col("src"))).alias("second"))
        held = known.select("node").distinct().withColumn("some", F.lit(1))
        kept = two.join(held, "node", "left").select("node", F.explode(F.when(F.col("some").isNull() & F.col("second").isNotNull(), F.array("first", "second")).otherwise(F.array("first"))).alias("src"))
        last = levels.write(hop, kept)
    return levels.all().where("node <> src").groupBy(F.col("node").alias("id")).agg(F.min("dist").alias("dist")).join(members.select("id").distinct(), "id", "left_semi")


#: Sources of a wave are kept as bits of so many 64-bit words.
WORDS = 16
BLOCK = 64 * WORDS


def waves(adj: DataFrame, sources: DataFrame) -> DataFrame:
    """``block, node, bits ARRAY<BIGINT>, dist``: which slots reach a node first at which distance.

    ``sources`` has ``id, slot``: a slot is a source or a set of sources, numbered from 0; ``BLOCK`` slots share a row as
    bits. A level joins the last one to the edges and unites the bits by node, so that it has one row for each node and
    block and not one for each pair; slot s is bit s % BLOCK of block s / BLOCK.
    """
    names = [f"w{i}" for i in range(WORDS)]
    word = F.expr(f"cast(slot % {BLOCK} div 64 as int)")
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    levels = Levels(adj.sparkSession, "waves")
    start = sources.groupBy(F.expr(f"slot div {BLOCK}").alias("block"), F.col("id").alias("node")).agg(*[F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(n) for i, n in enumerate(names)])
    last = levels.write(0, start)
    before, hop = last.limit(0), 0
    while not last.isEmpty():
        hop += 1
        met = last.join(adj, last["node"] == adj["a"]).groupBy("block", F.col("b").alias("node")).agg(*[F.bit_or(n).alias(n) for n in names])
        old = before.unionByName(last).groupBy("block", "node").agg(*[F.bit_or(n).alias(f"o{n}") for n in names])
        new = met.join(old, ["block", "node"], "left").select("block", "node", *[F.col(n).bitwiseAND(F.bitwise_not(F.coalesce(f"o{n}", F.lit(0).cast("long")))).alias(n) for n in names])
        some = F.lit(False)
        for n in names:
            some = some | (F.col(n) != 0)
        before, last = last, levels.write(hop, new.where(some))
    return levels.all().select("block", "node", F.array(*names).alias("bits"), "dist")


def reached_by(slot: Column) -> Column:
    """Whether the slot's bit is among ``bits`` of its block."""
    return F.getbit(F.get("bits", (F.pmod(slot, F.lit(BLOCK)) / 64).cast("int")), F.pmod(slot, F.lit(64)).cast("int")) == 1


def slots_of(ids: DataFrame) -> DataFrame:
    """``id, slot``: the different ids, numbered from 0 in their order, by many tasks."""
    return positions(ids.select("id").where("id is not null").distinct(), [], [F.col("id").asc()], "slot").withColumn("slot", F.col("slot") - 1)


def components(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """``id, component``: the smallest id of each connected component.

    Each round takes the least label among neighbours, then the label of that label (pointer jumping); labels are
    written after each round, the older ones deleted, and the loop ends when none changes, however long that takes.
    """
    held = labels = settle(nodes.select("id", F.col("id").alias("component")).distinct(), "cc")
    while True:
        nb = adj.join(labels, adj["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        lower = labels.join(nb, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("m", F.col("component"))).alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("cc"))
        new = settle(lower.join(jump, "c", "left").select("id", F.least("c", F.coalesce("cc", F.col("c"))).alias("component"), "old"), "cc")
        changed = not new.where("component <> old").isEmpty()
        forget(held)
        held, labels = new, new.select("id", "component")
        if not changed:
            labels._settled_at = held._settled_at
            return labels


def lcc_gate(comp: DataFrame, seeds: DataFrame, targets: DataFrame, least_share: float = 0.8, most_missing: float = 0.1) -> DataFrame:
    """One row: share of the largest component, shares of seeds and targets outside the graph, and whether all pass."""
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    s = sizes.agg(F.max("n").alias("largest"), F.sum("n").alias("nodes"), F.count(F.lit(1)).alias("components"))

    def missing(ids: DataFrame, name: str) -> DataFrame:
        return ids.select("id").distinct().join(comp.select("id", F.lit(1).alias("in")), "id", "left").agg(F.round(F.avg(F.col("in").isNull().cast("double")), 6).alias(name))

    j = s.crossJoin(missing(seeds, "seeds_missing")).crossJoin(missing(targets, "targets_missing"))
    share = F.round(F.col("largest") / F.col("nodes"), 6)
    ok = (share >= least_share) & (F.coalesce("seeds_missing", F.lit(1.0)) <= most_missing) & (F.coalesce("targets_missing", F.lit(1.0)) <= most_missing)
    return j.select("components", "largest", "nodes", share.alias("lcc_share"), "seeds_missing", "targets_missing", ok.alias("passed"))


def _size(ids: DataFrame, name: str) -> DataFrame:
    return ids.agg(F.countDistinct("id").alias(name))


def _tally(adj: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``dist, n``: how many reached pairs of A and B lie how far apart; sources are the smaller set, counted as bits."""
    a, b = a.select("id").where("id is not null").distinct(), b.select("id").where("id is not null").distinct()
    small, large = (a, b) if a.count() <= b.count() else (b, a)
    ones = F.aggregate(F.transform("bits", lambda w: F.bit_count(w)), F.lit(0), lambda x, y: x + y)
    return waves(adj, slots_of(small)).join(large.withColumnRenamed("id", "node"), "node", "left_semi").groupBy("dist").agg(F.sum(ones).alias("n"))


def distance_metrics(adj: DataFrame, a: DataFrame, b: DataFrame, comp: DataFrame) -> DataFrame:
    """One row of distances between node sets A and B: closest (mean over A of the nearest B), its mirror, all pairs, inside A, inside B, separation.

    ``comp`` has the components. A statistic is null where it needs a pair that isn't connected, or a set of at least
    two that is smaller; ``unreachable`` is the share of pairs without a path. Nothing has a row for each pair: the
    nearest ones come from one search each, the mean of all pairs from counted bits, and which pairs have a path from
    the components.
    """
    a, b = (settle(x.select("id").where("id is not null").distinct(), "set") for x in (a, b))
    both = _tally(adj, a, b).agg(F.sum("n").alias("rp"), (F.sum(F.col("n") * F.col("dist")) / F.sum("n")).alias("vp"))
    near = lambda mine, theirs, tag: mine.join(nearest(adj, theirs), mine["id"] == F.col("node")).agg(F.count(F.lit(1)).alias(f"r{tag}"), F.avg("dist").alias(f"v{tag}"))

    def inside(ids: DataFrame, tag: str) -> DataFrame:
        parts = ids.join(comp, "id", "left").agg(F.countDistinct(F.coalesce("component", "id")).alias(f"c{tag}"))
        return nearest_other(adj, ids).agg(F.count(F.lit(1)).alias(f"n{tag}"), F.avg("dist").alias(f"i{tag}")).crossJoin(parts)

    j = _size(a, "na").crossJoin(_size(b, "nb")).crossJoin(near(a, b, "a")).crossJoin(near(b, a, "b")).crossJoin(both).crossJoin(inside(a, "ia")).crossJoin(inside(b, "ib"))  # one row each
    c, pairs = F.col, F.col("na") * F.col("nb")
    some, rp = pairs > 0, F.coalesce("rp", F.lit(0))
    closed = lambda n, t: F.when((c(n) > 1) & (c(f"c{t}") == 1) & (c(f"n{t}") == c(n)), F.round(c(f"i{t}"), 6))
    out = j.select(
        F.when(some & (c("ra") == c("na")), F.round("va", 6)).alias("closest"), F.when(some & (c("rb") == c("nb")), F.round("vb", 6)).alias("target_mean"), F.when(some & (rp == pairs), F.round("vp", 6)).alias("all_pairs"),
        F.when(some, F.round(1 - rp / pairs, 6)).alias("unreachable"), closed("na", "ia").alias("inside_a"), closed("nb", "ib").alias("inside_b"))
    return out.withColumn("separation", F.round(F.col("closest") - (F.col("inside_a") + F.col("inside_b")) / 2, 6))


def read_modes(adj: DataFrame, cards: DataFrame, modes: dict[str, DataFrame], a: str, b: str) -> DataFrame:
    """``mode, seeds, targets, closest, unreachable, status``: the closest distance over several populations of cards (all, the top 10, …).

    Each seed's nearest target comes from one search from all targets of the mode; which pairs have a path is told by the
    components, so that seeds and targets are never multiplied out and a mode may hold every chain. More than half of the
    pairs without a path makes a reading not applicable; a seed without any target leaves it without a value.
    """
    ids = lambda df, c: df.select(F.col(c).alias("id")).where("id is not null").distinct()
    held = adj.select(F.col("a").alias("id"))
    for part in (cards, *modes.values()):
        held = held.union(ids(part, a)).union(ids(part, b))
    comp = components(held.distinct(), adj)
    out = None
    for name, part in modes.items():
        A, B = settle(ids(part, a), "seeds"), settle(ids(part, b), "targets")
        per = A.join(nearest(adj, B), A["id"] == F.col("node")).agg(F.count(F.lit(1)).alias("ra"), F.avg("dist").alias("va"))
        inside = lambda x, n: x.join(comp, "id").groupBy("component").agg(F.count(F.lit(1)).alias(n))
        reached = inside(A, "ca").join(inside(B, "cb"), "component").agg(F.coalesce(F.sum(F.col("ca") * F.col("cb")), F.lit(0)).alias("rp"))
        j = _size(A, "seeds").crossJoin(_size(B, "targets")).crossJoin(per).crossJoin(reached)  # one row each
        pairs = F.col("seeds") * F.col("targets")
        lost = F.when(pairs > 0, F.round(1 - F.col("rp") / pairs, 6))
        value = F.when(F.col("ra") == F.col("seeds"), F.round("va", 6))
        row = settle(j.select(F.lit(name).alias("mode"), "seeds", "targets", value.alias("closest"), lost.alias("unreachable"), F.when(pairs == 0, "empty").when(lost > 0.5, "not_applicable").when(value.isNull(), "not_computable").otherwise("ok").alias("status")), "mode")
        out = row if out is None else out.unionByName(row)
    return out


def pools(degree_table: DataFrame, bins: DataFrame, by_category_bins: bool) -> DataFrame:
    """``id, category, bin, pos, size``: every node with its place among the nodes of its category and degree bin."""
    keys = ["category", "degree"] if by_category_bins else ["degree"]
    binned = degree_table.select("id", "category", "degree").join(bins, keys)
    placed = positions(binned.select("id", "category", "bin"), ["category", "bin"], [F.col("id").asc()])
    sizes = placed.groupBy("category", "bin").agg(F.count(F.lit(1)).alias("size"))
    return placed.join(sizes, ["category", "bin"])


def drawn(slots: DataFrame, pool: DataFrame, seed: int, by: tuple[str, ...]) -> DataFrame:
    """For each slot (``by`` and ``id``) a node of the same pool other than its own, drawn by a hash of seed and ``by``: ``…, draw``; null where the pool has no other.

    The draw is a place in the pool and the pool is met by equality, so no list of candidates is carried along.
    """
    own = pool.select("id", "category", "bin", F.col("pos").alias("own"), "size")
    s = slots.join(own, "id", "left")
    at = hash_number(seed, *[F.col(c) for c in by]) % (F.col("size") - 1) + 1
    s = s.withColumn("at", F.when(F.col("size") > 1, at + (at >= F.col("own")).cast("long")))
    members = pool.select("category", "bin", F.col("pos").alias("at"), F.col("id").alias("draw"))
    return s.join(members, ["category", "bin", "at"], "left").select(*slots.columns, "category", "bin", "draw")


def _null_row(per: DataFrame, observed: DataFrame) -> DataFrame:
    """One row from ``per(perm, v)`` and ``observed(observed)``: mean and population deviation of the null, z, one-sided p, how many permutations had no value."""
    s = per.crossJoin(F.broadcast(observed)).agg(F.first("observed").alias("observed"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.sum((F.col("v") <= F.col("observed") + 1e-12).cast("long")).alias("below"), F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("unreachable"))
    return s.select(F.round("observed", 6).alias("observed"), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.when((F.col("n") > 1) & (F.col("sd") > 1e-12), F.round((F.col("observed") - F.col("mean")) / F.col("sd"), 6)).alias("z"), F.round((F.coalesce("below", F.lit(0)) + 1) / (F.col("n") + 1), 6).alias("p"), "n", "unreachable")


def permutation_null(adj: DataFrame, a: DataFrame, b: DataFrame, pool: DataFrame, n_perm: int, seed: int) -> DataFrame:
    """One row: observed closest distance from A to B, mean and population deviation of the null, z, one-sided p, permutations that could not be reached.

    Each permutation replaces every member of A and of B by a degree-matched one of its category. All permutations are
    searched together, each as a bit of a wave from its own targets. Unreachable permutations are counted, not redrawn.
    A member without another one in its pool is refused.
    """
    A, B = (settle(x.select("id").distinct(), "set") for x in (a, b))
    alone = A.union(B).join(pool.where("size > 1").select("id"), "id", "left_anti")
    require_empty(alone, "members without another node of their category and degree bin")
    near = nearest(adj, B).select(F.col("node").alias("id"), "dist")
    obs = A.join(near, "id", "left").agg(F.when(F.count("dist") == F.count(F.lit(1)), F.avg("dist")).alias("observed"))
    slots = lambda ids: ids.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm))))
    targets = drawn(slots(B), pool, seed, ("perm", "id")).select(F.col("draw").alias("id"), (F.col("perm") - 1).cast("long").alias("slot"))
    wave = waves(adj, targets)
    asked = drawn(slots(A), pool, seed, ("perm", "id")).select("perm", F.col("draw").alias("node"), F.expr(f"(perm - 1L) div {BLOCK}").alias("block"))
    d = asked.join(wave, ["node", "block"]).where(reached_by(F.col("perm") - 1)).select("perm", "dist")
    size = A.agg(F.count(F.lit(1)).alias("size"))
    perms = adj.sparkSession.range(1, n_perm + 1).select(F.col("id").alias("perm"))
    per = perms.join(d.groupBy("perm").agg(F.count(F.lit(1)).alias("k"), F.avg("dist").alias("avg")), "perm", "left").crossJoin(F.broadcast(size)).select("perm", F.when(F.col("k") == F.col("size"), F.col("avg")).alias("v"))
    return _null_row(per, obs)


def uniform_null(adj: DataFrame, nodes: DataFrame, n_perm: int, seed: int) -> DataFrame:
    """One row ``mean, sd, n, tries``: distances of ``n_perm`` pairs of any two nodes, the null of a single seed and target.

    A pair without a path is rejected and drawn again, up to ten times ``n_perm`` draws in all; the first ``n_perm`` with
    a path count. Draws are searched block by block, only as many blocks as are needed. Fewer than two leave no deviation.
    """
    placed = settle(slots_of(nodes), "places")
    size = placed.count()
    held, done, tries = [], 0, 10 * n_perm
    for start in range(0, tries, BLOCK):
        if done >= n_perm or not size:
            break
        k = adj.sparkSession.range(start, min(start + BLOCK, tries)).select(F.col("id").alias("k"))
        at = lambda side: hash_number(seed, F.lit(side), F.col("k")) % size
        k = k.withColumn("s", at("seed")).withColumn("t", at("target"))
        ends = k.join(placed.select(F.col("slot").alias("s"), F.col("id").alias("source")), "s").join(placed.select(F.col("slot").alias("t"), F.col("id").alias("target")), "t")
        ends = settle(ends.select("k", "source", "target"), "draws")
        wave = waves(adj, ends.select(F.col("source").alias("id"), (F.col("k") - start).alias("slot")))
        found = settle(ends.join(wave, ends["target"] == wave["node"]).where(reached_by(F.col("k") - start)).select("k", "dist"), "found")
        done += found.count()
        held.append(found)
    out = held[0] if held else adj.sparkSession.createDataFrame([], "k long, dist int")
    for h in held[1:]:
        out = out.unionByName(h)
    first = out.orderBy("k").limit(n_perm)
    sd = F.when((F.count("dist") > 1) & (F.stddev_pop("dist") > 1e-12), F.round(F.stddev_pop("dist"), 6))
    return first.agg(F.round(F.avg("dist"), 6).alias("mean"), sd.alias("sd"), F.count("dist").alias("n"), (F.coalesce(F.max("k"), F.lit(-1)) + 1).alias("tries"))


#: A graph of so many directed edges at most is given to every task (some 12 bytes an edge); a larger one is searched by joins.
HELD_EDGES = 8_000_000
#: Bytes of a task's distances while it searches from a group of sources; groups whose sources share an array of names.
HELD_BYTES, GROUPS = 2**27, 64
#: Nodes of a range, and ranges of a file: so many names fit the dictionary of a parquet file.
RANGE, RANGES = 4096, 4


class HeldGraph:
    """A graph as neighbour lists in arrays, broadcast; 64 sources are searched together, as bits of a word for each node."""

    def __init__(self, adj: DataFrame):
        self.spark = adj.sparkSession
        self.nodes = settle(slots_of(adj.select(F.col("a").alias("id"))), "nodes")
        end = lambda c, n: self.nodes.select(F.col("id").alias(c), F.col("slot").cast("int").alias(n))
        pairs = adj.join(end("a", "x"), "a").join(end("b", "y"), "b").select("x", "y").toArrow()
        x, y = pairs["x"].to_numpy(), pairs["y"].to_numpy()
        starts = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=1 if not len(x) else 0))[:-1]]).astype(np.int64)
        self.lists = self.spark.sparkContext.broadcast((starts, y[np.argsort(x, kind="stable")].astype(np.int32)))

    def _tasks(self, groups: int) -> int:
        return max(1, min(groups, 8 * self.spark.sparkContext.defaultParallelism))

    def distances(self, sources: DataFrame) -> DataFrame:
        """``src, node, dist``, as ``distances`` says; a source outside the graph reaches itself.

        Up to 64 sources are searched together. Their distances go packed, a few bits for a pair, to the tasks that have
        a range of nodes each, and pairs are made only there: node by node, the sources always in the same order. A file
        then holds few different nodes in long runs and repeats its sources, and takes a tenth of pairs by source or less.
        """
        ids = settle(sources.select("id").distinct(), "ids")
        own = ids.select(F.col("id").alias("src"), F.col("id").alias("node"), F.lit(0).alias("dist"))
        n, lists = len(self.lists.value[0]), self.lists
        names = self.spark.sparkContext.broadcast(self.nodes.orderBy("slot").select("id").toArrow()["id"].combine_chunks())
        width, size, share = max(1, min(64, HELD_BYTES // n)), RANGE, GROUPS
        placed = settle(slots_of(ids.join(self.nodes.select("id"), "id", "left_semi")).withColumnRenamed("slot", "k").join(self.nodes, "id"), "sources")
        part = F.expr(f"cast(k div {width * share} as int)").alias("part")

        def search(batches):
            held = pa.Table.from_batches(batches) if (batches := list(batches)) else None
            if held is not None and held.num_rows:
                groups = held["g"].to_numpy()
                for g in np.unique(groups):
                    own = held.filter(pa.array(groups == g)).sort_by("k")
                    dist = _packed(*lists.value, own["slot"].to_numpy(), size)
                    for lo in range(0, n, size):
                        if (block := dist[lo : lo + size]).any():
                            yield pa.RecordBatch.from_pydict({"part": pa.array([g // share], pa.int32()), "r": pa.array([lo // size], pa.int32()), "first": pa.array([g % share * width], pa.int32()), "item": pa.array([block.itemsize], pa.int32()), "sources": pa.array([block.shape[1]], pa.int32()), "packed": pa.array([pa.compress(block.tobytes(), "zstd", asbytes=True)], pa.binary())})

        def pairs(key: tuple[int, int], rows: list[dict]) -> Iterator[pa.RecordBatch]:
            lo, label = key[1] * size, names.value
            count = min(size, n - lo)
            blocks = [np.frombuffer(pa.decompress(x["packed"], count * x["sources"] * x["item"], "zstd", asbytes=True), np.uint8 if x["item"] == 1 else np.int32).reshape(count, -1) for x in rows]
            at, dist = np.concatenate([x["first"] + np.arange(x["sources"], dtype=np.int64) for x in rows]) << 32, np.hstack(blocks)
            order = np.argsort((dist != 0).argmax(axis=1), kind="stable")  # nodes of a component together: they have the same sources
            step = max(1, 2**20 // len(at))
            for i in range(0, count, step):
                some = dist[order[i : i + step]]
                row, col = np.nonzero(some)
                if len(row):
                    node, start = np.unique(row, return_index=True)
                    v = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)), pa.int32()), pa.array(at[col] + some[row, col]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), key[0], np.int32)), label.take(pa.array(lo + order[i + node])), v], names=["part", "node", "v"])

        def meet(batches):
            key, held = None, []
            for row in (x for b in batches for x in b.to_pylist()):
                if (row["part"], row["r"]) != key:
                    if held:
                        yield from pairs(key, held)
                    key, held = (row["part"], row["r"]), []
                held.append(row)
            if held:
                yield from pairs(key, held)

        groups = math.ceil((placed.count() or 1) / width)
        found = placed.withColumn("g", F.expr(f"cast(k div {width} as int)")).select("g", "k", "slot").repartition(self._tasks(groups), "g").mapInArrow(search, "part int, r int, first int, item int, sources int, packed binary")
        files = math.ceil(math.ceil(n / size) * math.ceil(groups / share) / RANGES)  # a number that is asked for is left alone: their input is small, their output isn't
        met = found.repartition(files, "part", "r").sortWithinPartitions("part", "r", "first").mapInArrow(meet, "part int, node string, v array<bigint>")
        called = placed.groupBy(part).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("names"))
        v = met.join(F.broadcast(called), "part").select("node", "names", F.explode("v").alias("v"))
        return own.unionByName(v.select(F.expr("get(names, cast(shiftright(v, 32) as int))").alias("src"), "node", F.expr("cast(v & 4294967295L as int)").alias("dist")))

    def asked(self, pairs: DataFrame) -> DataFrame:
        """``a_id, b_id, dist`` of the different ``pairs`` that have a path; a group of sources ends when all its pairs are found."""
        p = settle(pairs.select("a_id", "b_id").where("a_id is not null and b_id is not null").distinct(), "asked")
        n = p.agg(F.countDistinct("a_id").alias("a"), F.countDistinct("b_id").alias("b")).first()
        source, target = ("a_id", "b_id") if n.a <= n.b else ("b_id", "a_id")
        far = p.where("a_id <> b_id")
        k = settle(slots_of(far.select(F.col(source).alias("id")).join(self.nodes.select("id"), "id", "left_semi")), "k")
        at = lambda c, name: self.nodes.select(F.col("id").alias(c), F.col("slot").alias(name))
        rows = far.join(k.select(F.col("id").alias(source), F.expr("slot div 64").alias("g")), source).join(at(source, "s"), source).join(at(target, "t"), target).select("a_id", "b_id", "g", "s", "t")
        lists = self.lists

        def run(batches):
            held = pa.Table.from_batches(batches) if (batches := list(batches)) else None
            if held is None or not held.num_rows:
                return
            groups = held["g"].to_numpy()
            for g in np.unique(groups):
                own = held.filter(pa.array(groups == g))
                start, bit = np.unique(own["s"].to_numpy(), return_inverse=True)
                t, dist = own["t"].to_numpy(), np.full(own.num_rows, -1, np.int32)
                for level, new in _levels(*lists.value, start):
                    dist[(new[t] >> bit.astype(np.uint64)) & np.uint64(1) == 1] = level
                    if (dist >= 0).all():
                        break
                own = own.select(["a_id", "b_id"]).append_column("dist", pa.array(dist)).filter(pa.array(dist >= 0))
                yield from own.combine_chunks().to_batches()

        groups = math.ceil((k.count() or 1) / 64)
        out = rows.repartition(self._tasks(groups), "g").mapInArrow(run, "a_id string, b_id string, dist int")
        return p.where("a_id = b_id").withColumn("dist", F.lit(0)).unionByName(out)


def _levels(starts: np.ndarray, ends: np.ndarray, sources: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Distance and, for each node, the bits of the up to 64 different ``sources`` that are so far away; from 0 until a level is empty."""
    new = np.zeros(len(starts), np.uint64)
    new[sources] = np.uint64(1) << np.arange(len(sources), dtype=np.uint64)
    seen, level = new.copy(), 0
    while new.any():
        yield level, new
        new = np.bitwise_or.reduceat(new[ends], starts) & ~seen  # every node of the graph has a neighbour
        seen |= new
        level += 1


def _packed(starts: np.ndarray, ends: np.ndarray, sources: np.ndarray, step: int) -> np.ndarray:
    """The distance of each node (rows) to each source (columns), 0 for none and for itself; a byte each, or four if any is over 255."""
    dist = np.zeros((len(starts), len(sources)), np.uint8)
    for level, new in _levels(starts, ends, sources):
        if level == 256:
            dist = dist.astype(np.int32)
        for lo in range(0, len(new), step) if level else ():
            if (some := new[lo : lo + step]).any():
                bits = np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                dist[lo : lo + step] += bits[:, : len(sources)] * dist.dtype.type(level)  # each bit is set at one level only
    return dist


def held_graph(adj: DataFrame) -> HeldGraph | None:
    """The graph in arrays, or None if it has more than ``HELD_EDGES`` directed edges."""
    return HeldGraph(adj) if 0 < adj.count() <= HELD_EDGES else None


def asked_distances(adj: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a_id, b_id, dist`` of the different pairs ``(a_id, b_id)`` that have a path, searched from their ends only."""
    graph = held_graph(adj)
    return graph.asked(pairs) if graph is not None else pair_distances(adj, pairs)


def pair_distances(adj: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a_id, b_id, dist`` of the different pairs ``(a_id, b_id)`` that have a path; the b side is searched from, as bits."""
    p = pairs.select("a_id", "b_id").where("a_id is not null and b_id is not null").distinct()
    slot = settle(slots_of(p.select(F.col("b_id").alias("id"))), "slots")
    asked = p.join(slot.withColumnRenamed("id", "b_id"), "b_id").withColumn("block", F.expr(f"slot div {BLOCK}"))
    return _looked_up(asked, waves(adj, slot))


def _looked_up(asked: DataFrame, wave: DataFrame) -> DataFrame:
    return asked.join(wave.withColumnRenamed("node", "a_id"), ["a_id", "block"]).where(reached_by(F.col("slot"))).select("a_id", "b_id", "dist")


def chain_null(adj: DataFrame, pairs: DataFrame, pool: DataFrame, n_perm: int, seed: int) -> DataFrame:
    """``a_id, b_id, d_obs, null_mean, null_sd, z, p, n_used, n_unreachable`` for each different pair: its distance against that of degree-matched pairs.

    Both ends are drawn anew ``n_perm`` times from their category and degree bin; the distances of the pairs drawn are
    searched together, from the side with fewer different ends, so that a pool's other nodes are never searched from.
    Chains with the same ends share a row. A pair that isn't connected has no z; draws without a path are counted and
    left out.
    """
    p = settle(pairs.select("a_id", "b_id").where("a_id is not null and b_id is not null").distinct(), "pairs")
    ends = pool.select("id", "category", "bin", "pos", "size")
    side = lambda c, t: ends.select(F.col("id").alias(c), F.col("category").alias(f"c{t}"), F.col("bin").alias(f"b{t}"), F.col("pos").alias(f"p{t}"), F.col("size").alias(f"s{t}"))
    j = p.join(side("a_id", "a"), "a_id").join(side("b_id", "b"), "b_id")
    require_empty(p.join(j.where("sa > 1 and sb > 1"), ["a_id", "b_id"], "left_anti"), "pairs whose ends have no other node of their category and degree bin")
    j = j.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm))))

    def draw(t: str) -> Column:
        at = hash_number(seed, F.lit(t), F.col("perm"), F.col("a_id"), F.col("b_id")) % (F.col(f"s{t}") - 1) + 1
        return at + (at >= F.col(f"p{t}")).cast("long")

    j = j.withColumn("da", draw("a")).withColumn("db", draw("b"))
    members = pool.select("category", "bin", F.col("pos"), "id")
    pick = lambda t: members.select(F.col("category").alias(f"c{t}"), F.col("bin").alias(f"b{t}"), F.col("pos").alias(f"d{t}"), F.col("id").alias(f"n{t}"))
    drawn_ = settle(j.join(pick("a"), ["ca", "ba", "da"]).join(pick("b"), ["cb", "bb", "db"]).select("a_id", "b_id", "perm", "na", "nb"), "drawn")
    found = settle(asked_distances(adj, drawn_.select(F.col("na").alias("a_id"), F.col("nb").alias("b_id")).unionByName(p)), "found")
    d = drawn_.join(found.select(F.col("a_id").alias("na"), F.col("b_id").alias("nb"), "dist"), ["na", "nb"])
    obs = p.join(found, ["a_id", "b_id"]).withColumnRenamed("dist", "d_obs")
    j = d.join(obs, ["a_id", "b_id"], "left").groupBy("a_id", "b_id").agg(F.avg("dist").alias("mean"), F.stddev_pop("dist").alias("sd"), F.count(F.lit(1)).alias("n_used"), F.sum((F.col("dist") <= F.col("d_obs")).cast("long")).alias("below"))
    out = p.join(obs, ["a_id", "b_id"], "left").join(j, ["a_id", "b_id"], "left")
    n, there = F.coalesce("n_used", F.lit(0)), F.col("d_obs").isNotNull()
    z = F.when(there & (n > 1) & (F.col("sd") > 1e-12), F.round((F.col("d_obs") - F.col("mean")) / F.col("sd"), 6))
    return out.select("a_id", "b_id", "d_obs", F.when(there & (n > 1), F.round("mean", 6)).alias("null_mean"), F.when(there & (n > 1), F.round("sd", 6)).alias("null_sd"), z.alias("z"), F.when(there & (n > 0), F.round((F.col("below") + 1) / (n + 1), 6)).alias("p"), n.alias("n_used"), (n_perm - n).alias("n_unreachable"))


def first_rows(df: DataFrame, n: int, ordinal: list[str]) -> DataFrame:
    """The first ``n`` rows in a stated order: the cap on a file's rows, for tables that have no order of their own."""
    return df.orderBy(*ordinal).limit(n)


def side_car(cards: DataFrame, a: str, b: str, z: DataFrame, degree_table: DataFrame, comp: DataFrame, gate: DataFrame) -> DataFrame:
    """The ten columns of the structure scores: the chain and its ends, z, centrality of the far end, whether both ends share a component, and the gate's figures.

    ``z`` has ``a_id, b_id, z``; it is left out (null) where the gate failed. Centrality and community are null for
    nodes that the graph lacks.
    """
    d = degree_table.select(F.col("id").alias("b_id"), "centrality")
    c = cards.select("chain_id", F.col(a).alias("a_id"), F.col(b).alias("b_id"))
    j = c.join(z.select("a_id", "b_id", "z"), ["a_id", "b_id"], "left").join(d, "b_id", "left").join(comp.select(F.col("id").alias("a_id"), F.col("component").alias("ca")), "a_id", "left").join(comp.select(F.col("id").alias("b_id"), F.col("component").alias("cb")), "b_id", "left").crossJoin(F.broadcast(gate))  # one row
    community = F.when(F.col("ca").isNotNull() & F.col("cb").isNotNull(), (F.col("ca") == F.col("cb")).cast("int"))
    return j.select("chain_id", F.col("a_id").alias(a), F.col("b_id").alias(b), F.when(F.col("passed"), F.col("z")).alias("proximity_z"), F.col("centrality").alias("degree_centrality_disclosed"), community.alias("community_degraded"), "lcc_share", F.col("seeds_missing").alias("seed_missing_rate"), F.col("targets_missing").alias("target_missing_rate"), (~F.col("passed")).cast("int").alias("degraded_mode"))


def distance_tally(adj: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``dist, n``: how many pairs of A and B lie how far apart; the last row, with a null distance, counts those without a path (left out if there are none)."""
    reached = settle(_tally(adj, a, b), "tally")
    rest = _size(a, "na").crossJoin(_size(b, "nb")).crossJoin(reached.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("r")))
    return reached.unionByName(rest.select(F.lit(None).cast("int").alias("dist"), (F.col("na") * F.col("nb") - F.col("r")).alias("n")).where("n > 0"))


def consistent(z1, z2):
    """Whether two readings point the same way: consistent, opposite, or undetermined where one is missing or zero."""
    return F.when(z1.isNull() | z2.isNull() | (z1 == 0) | (z2 == 0), "undetermined").when(F.signum(z1) == F.signum(z2), "consistent").otherwise("opposite")


