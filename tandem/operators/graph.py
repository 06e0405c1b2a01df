"""The call graph (GR1-GR9, JN11-JN14, JN18, SET4, FLT11, FLT19, ML17, ML18)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import SEED, canonical, pair_key
from .state import forget, settle

PAIR = ["func1", "func2"]


def build(calls: DataFrame) -> DataFrame:
    """GR1: (src, dst, call_line) of each edge; the first call's line is kept."""
    return calls.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("call_line").alias("call_line"))


def degrees(edges: DataFrame) -> DataFrame:
    """GR4, GR7: (node, out_degree, in_degree) of every node that has an edge."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def hops(edges: DataFrame, k: int) -> DataFrame:
    """GR3: (src, dst, depth) of every node reached in 1..k steps, the node itself left out; the least depth counts.

    Each step is one join of the frontier with the edges; pairs already reached leave the frontier by an anti join.
    """
    e = settle(edges.select("src", "dst").where("src <> dst").distinct())  # every step reads them
    reached = frontier = e.withColumn("depth", F.lit(1))
    for depth in range(2, k + 1):
        step = frontier.select("src", F.col("dst").alias("_m")).join(e.select(F.col("src").alias("_m"), "dst"), "_m").where("src <> dst").select("src", "dst").distinct()
        frontier = step.join(reached, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth))
        reached = reached.unionByName(frontier)
    return reached


def distances(edges: DataFrame, k: int) -> DataFrame:
    """GR2: (func1, func2, distance) of the pairs within k steps one way or the other; the shorter way counts."""
    return canonical(hops(edges, k).select(F.col("src").alias("func1"), F.col("dst").alias("func2"), "depth")).groupBy(*PAIR).agg(F.min("depth").alias("distance"))


def call_distance(pairs: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """GR2 for given pairs: 0 for a node and itself, -1 beyond k steps or without a way."""
    p = canonical(pairs)
    found = p.join(distances(edges, k), PAIR, "left")
    return found.withColumn("distance", F.when(F.col("func1") == F.col("func2"), 0).otherwise(F.coalesce("distance", F.lit(-1))))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): weakly connected components by alternating star contraction; root is the smallest node. Its joins are
    merge joins, as those of :func:`reachable`: a side that is small enough to broadcast would go through the driver in every round."""
    e = settle(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        last, e = e, settle(both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        forget(last)
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        low = e.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, settle(low.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        forget(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


#: Shortcuts that a walk may take, for each edge.
SHORTCUTS = 4


def shortcuts(edges: DataFrame, most: int = SHORTCUTS) -> DataFrame:
    """``edges`` (src, dst) and ways of 2, 4, 8... steps beside them, as long as there are no more than ``most`` times as many as
    edges: the same nodes are reached in a fraction of the rounds. Counted before they are made, so hubs cost nothing."""
    limit = most * edges.count()
    while True:
        into = edges.groupBy(F.col("dst").alias("m")).agg(F.count("*").alias("i"))
        out = edges.groupBy(F.col("src").alias("m")).agg(F.count("*").alias("o"))
        ways = into.join(out.hint("merge"), "m").agg(F.sum(F.col("i").cast("double") * F.col("o"))).first()[0] or 0
        if not ways or ways > 2 * limit:
            return edges
        far = edges.select("src", F.col("dst").alias("_m")).join(edges.select(F.col("src").alias("_m"), "dst").hint("merge"), "_m").where("src <> dst").select("src", "dst")
        more = settle(edges.unionByName(far).distinct())
        n = more.count()
        if n > limit or n == edges.count():
            forget(more)
            return edges
        edges = more


def reachable(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """GR9: those of ``pairs`` (func1, func2) with a way from one to the other, whichever way round.

    Pairs in different components have none. For the others only the nodes asked about are
    walked from, until no frontier is left. A round writes its frontier only; what was reached is all frontiers.
    """
    e = settle(edges.select("src", "dst").where("src <> dst").distinct())
    roots = settle(components(e))
    side = lambda k: roots.select(F.col("node").alias(f"func{k}"), F.col("root").alias(f"_r{k}")).hint("merge")
    near = settle(pairs.select(*PAIR).distinct().join(side(1), "func1").join(side(2), "func2").where("_r1 = _r2").select(*PAIR))
    starts = near.select(F.col("func1").alias("s")).unionByName(near.select(F.col("func2").alias("s"))).distinct()
    e = shortcuts(e)
    seen = frontier = settle(starts.select("s", F.col("s").alias("t")))
    while True:
        step = frontier.join(e.hint("merge"), frontier["t"] == e["src"]).select("s", F.col("dst").alias("t")).distinct()
        frontier = settle(step.join(seen.hint("merge"), ["s", "t"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    ways = seen.where("s <> t").hint("merge")
    forth = near.join(ways, (near["func1"] == ways["s"]) & (near["func2"] == ways["t"]), "left_semi")
    back = near.join(ways, (near["func2"] == ways["s"]) & (near["func1"] == ways["t"]), "left_semi")
    return forth.unionByName(back).distinct()


def pagerank(edges: DataFrame, nodes: DataFrame, iterations: int = 10, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """GR6: (node, rank) after a fixed number of iterations; the mass of nodes without calls is spread evenly."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count("*").alias("_out"))
    base = nodes.select("node").distinct().join(out.withColumnRenamed("src", "node"), "node", "left")
    base = settle(base)
    links = settle(e.join(out, "src"))
    n = base.count()
    rank = base.select("node", "_out", F.lit(1.0 / max(n, 1)).alias("rank"))
    for i in range(1, iterations + 1):
        loose = rank.where("_out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).scalar()
        given = links.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("_out")).alias("_in"))
        new = (1 - damping) / n + damping * (F.coalesce("_in", F.lit(0.0)) + loose / n)
        rank = base.join(given, "node", "left").select("node", "_out", new.alias("rank"))
        if i % cut_every == 0:
            rank = settle(rank)
    return rank.select("node", "rank")


#: Nodes of a block, of a file cut into blocks, and pairs that one task makes, in the mean.
BLOCK, PAIRS_A_TASK = 512, 4_000_000


def same_file_pairs(nodes: DataFrame, keys: list[str], block: int = BLOCK, pairs_a_task: int = PAIRS_A_TASK) -> DataFrame:
    """JN18: func1 < func2 of the same file, each once, also where both share several files.

    Their number grows with the square of a file, so a file is cut into blocks by the node's hash and every two blocks meet
    under a key of their own, in as many partitions as the pairs take. The pairs are made once, in the last step, and never dealt out.
    """
    n = nodes.select("node", *keys).distinct()
    for k in ["node", *keys]:
        n = n.where(F.col(k).isNotNull())
    n = settle(n)
    sizes = n.groupBy(*keys).agg(F.count("*").alias("_n"))
    pairs = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_n") / 2)).first()[0] or 0
    file = F.struct(*keys)
    several = n.groupBy("node").agg(F.collect_list(file).alias("_in")).where(F.size("_in") > 1)  # nodes of more than one file
    n = n.join(sizes, keys).join(several, "node", "left").withColumn("_blocks", F.ceil(F.col("_n") / block))
    n = n.withColumn("_at", F.pmod(F.xxhash64("node"), "_blocks"))
    side = lambda name, i, j: n.select(F.col("node").alias(name), *keys, F.col("_in").alias(f"_in_{name}"), i.alias("_i"), j.alias("_j"))
    into, by = max(1, math.ceil(pairs / pairs_a_task)), [*keys, "_i", "_j"]
    a = side("_a", F.col("_at"), F.explode(F.sequence("_at", F.col("_blocks") - 1))).repartition(into, *by)
    b = side("_b", F.explode(F.sequence(F.lit(0), "_at")), F.col("_at")).repartition(into, *by)
    met = a.join(b.hint("merge"), by).where((F.col("_i") < F.col("_j")) | (F.col("_a") < F.col("_b")))
    first = F.array_min(F.array_intersect("_in__a", "_in__b")) == file
    met = met.where(F.col("_in__a").isNull() | F.col("_in__b").isNull() | first)
    return met.select(F.least("_a", "_b").alias("func1"), F.greatest("_a", "_b").alias("func2"))


def candidates(nodes: DataFrame, edges: DataFrame, keys: list[str], k: int = 2) -> DataFrame:
    """SET4: pairs of one file, and pairs within k calls, each once and no node with itself. The files of those within
    k calls are looked up, so the pairs of one file, which are many more, need not be compared."""
    near = settle(canonical(hops(edges, k).select(F.col("src").alias("func1"), F.col("dst").alias("func2"))).distinct())
    n = nodes.select("node", *keys).distinct()
    inside = near.join(n.withColumnRenamed("node", "func1"), "func1").join(n.withColumnRenamed("node", "func2"), ["func2", *keys]).select(*PAIR)
    return same_file_pairs(nodes, keys).unionByName(near.join(inside, PAIR, "left_anti"))


def hard_negatives(edges: DataFrame, positives: DataFrame) -> DataFrame:
    """JN11: called but not positive; each pair once, no node with itself."""
    pairs = canonical(edges.select(F.col("src").alias("func1"), F.col("dst").alias("func2"))).where("func1 <> func2").distinct()
    return pairs.join(positives.select(*PAIR), PAIR, "left_anti")


def first_by_key(pairs: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """ST5, ST6: the first n pairs in hashed order, which are kept as they stand. Whole buckets of the hash are taken up to the one
    in which the n-th pair falls, and only that one is put in order: a top-k of this size would gather them all in one task."""
    p = settle(pairs.withColumn("_k", pair_key(F.col("func1"), F.col("func2"), seed)))
    p = p.withColumn("_b", F.substring("_k", 1, 4))
    sizes = p.groupBy("_b").agg(F.count("*").alias("_n"))  # 65,536 at most
    sizes = sizes.withColumn("_upto", F.sum("_n").over(W.orderBy("_b")))
    last = sizes.where(F.col("_upto") >= n).orderBy("_b").select("_b", F.col("_upto") - F.col("_n")).first()
    if last is None:
        return p.drop("_k", "_b")
    cut = p.where(F.col("_b") == last[0]).orderBy("_k", *PAIR).limit(n - last[1])
    return p.where(F.col("_b") < last[0]).unionByName(cut).drop("_k", "_b")


def intra_file_negatives(nodes: DataFrame, edges: DataFrame, positives: DataFrame, rounds: int, keys: list[str], seed: int = SEED) -> DataFrame:
    """JN12: pairs of one file that neither are positive nor call one another, from ``rounds`` rounds of :func:`draw_pairs`, so
    that a file of many functions is never paired with itself in full. Every file of two functions and more is drawn from."""
    offered = draw_pairs(nodes, keys, rounds, seed)
    called = canonical(edges.select(F.col("src").alias("func1"), F.col("dst").alias("func2"))).distinct()
    return offered.join(positives.select(*PAIR), PAIR, "left_anti").join(called, PAIR, "left_anti")


#: Nodes that are put in order in one task at most, in the mean.
IN_ORDER = 1_000_000


def draw_pairs(nodes: DataFrame, keys: list[str], rounds: int, seed: int = SEED, in_order: int = IN_ORDER) -> DataFrame:
    """ST11, ST12: reproducible random pairs: in each round the nodes of a group are put in hashed order
    and each is paired with the one after it. A group of n gives n - 1 pairs a round.

    Beyond ``in_order`` nodes the order is cut into buckets of the hash's first digits, as many as it takes, so no group is
    sorted in one task; the last node of a bucket goes with the first of the next, so buckets change nothing.
    """
    r = settle(nodes.select("node", *keys).distinct())
    n, width = r.count(), 0
    while n > in_order * 16**width:
        width += 1
    r = r.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    r = r.withColumn("_h", F.md5(F.concat_ws("|", F.col("node").cast("string"), F.col("_round").cast("string"), F.lit(str(seed)))))
    r = r.withColumn("_b", F.substring("_h", 1, width))
    group = [*keys, "_round"]
    r = r.withColumn("_next", F.lead("node").over(W.partitionBy(*group, "_b").orderBy("_h", "node")))
    if width:
        heads = r.groupBy(*group, "_b").agg(F.min(F.struct("_h", "node"))["node"].alias("_head"))
        heads = heads.withColumn("_head", F.lead("_head").over(W.partitionBy(*group).orderBy("_b")))
        h = heads.select(*[F.col(c).alias(f"{c}_of") for c in (*group, "_b")], "_head")
        on = F.col("_b") == F.col("_b_of")
        for c in group:
            on = on & F.col(c).eqNullSafe(F.col(f"{c}_of"))
        r = r.join(h, on).withColumn("_next", F.coalesce("_next", "_head"))
    pairs = r.where("_next is not null").select(F.col("node").alias("func1"), F.col("_next").alias("func2"))
    return canonical(pairs).where("func1 <> func2").distinct()


def unreachable_negatives(nodes: DataFrame, edges: DataFrame, rounds: int = 1, seed: int = SEED) -> DataFrame:
    """JN14: random pairs without a way between them."""
    drawn = settle(draw_pairs(nodes, [], rounds, seed))
    return drawn.join(reachable(drawn, edges).hint("merge"), PAIR, "left_anti")


def negatives(positives: DataFrame, nodes: DataFrame, edges: DataFrame, keys: list[str], ratio: float = 2.5, seed: int = SEED) -> DataFrame:
    """ML17: hard negatives up to half of the quota, the rest from the same files, in hashed order."""
    positives, edges = settle(positives.select(*PAIR)), settle(edges.select("src", "dst").distinct())  # both are read again and again
    n = positives.count()
    target = int(n * ratio)
    hard = settle(first_by_key(hard_negatives(edges, positives), target // 2, seed).withColumn("type", F.lit("hard")))
    rest = intra_file_negatives(nodes, edges, positives, max(1, int(2 * ratio)), keys, seed).join(hard.select(*PAIR), PAIR, "left_anti")
    return hard.unionByName(first_by_key(rest, target - hard.count(), seed).withColumn("type", F.lit("intra_file")))


def static_samples(nodes: DataFrame, edges: DataFrame, keys: list[str], max_distance: int = 2, ratio: float = 2.5, intra_file: bool = True, seed: int = SEED) -> DataFrame:
    """ML18: positives within ``max_distance`` calls; negatives without a way, then filled from the same files."""
    edges = settle(edges.select("src", "dst").distinct())
    pos = settle(distances(edges, max_distance).withColumn("label", F.lit(1)))
    target = int(pos.count() * ratio)
    far = unreachable_negatives(nodes, edges, max(1, int(ratio) + 1), seed).join(pos.select(*PAIR), PAIR, "left_anti")
    far = settle(first_by_key(far, target, seed).withColumn("distance", F.lit(-1)).withColumn("label", F.lit(0)))
    out = pos.unionByName(far)
    if intra_file and (left := target - far.count()) > 0:
        fill = intra_file_negatives(nodes, edges, pos, max(1, int(2 * ratio)), keys, seed).join(far.select(*PAIR), PAIR, "left_anti")
        out = out.unionByName(first_by_key(fill, left, seed).withColumn("distance", F.lit(-1)).withColumn("label", F.lit(0)))
    return out


def neighbours(edges: DataFrame, node: Column | str) -> DataFrame:
    """GR4: (src, dst) with the node on either side."""
    return edges.where((F.col("src") == node) | (F.col("dst") == node))
