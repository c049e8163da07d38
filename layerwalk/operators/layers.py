"""Standardised series, all-pairs correlation and single-layer graphs.

Measurements are long: (layer, node, t, value). A graph is a pair of frames: ``edges`` (layer, src, dst, w, sign; an
absent edge weighs 0) and ``nodes`` (layer, node), which keeps isolated nodes that statistics must count.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.names import BASIS
from ..functions.series import units
from ..plans.stages import materialize
from . import selection, simjoin


@dataclass
class Graph:
    edges: DataFrame
    nodes: DataFrame


def standardize_rows(m: DataFrame) -> DataFrame:
    """Adds ``z``: (value - mean) / sample standard deviation of its (layer, node); null for a constant series."""
    w = W.partitionBy("layer", "node")
    return m.withColumn("z", F.try_divide(F.col("value") - F.avg("value").over(w), F.nullif(F.stddev_samp("value").over(w), F.lit(0.0))))


def fill_times(m: DataFrame, value: float = 0.0) -> DataFrame:
    """Every node at every time of the table, ``value`` where nothing was measured."""
    grid = m.select("layer", "node").distinct().crossJoin(F.broadcast(m.select("t").distinct()))
    return grid.join(m, ["layer", "node", "t"], "left").select("layer", "node", "t", F.coalesce("value", F.lit(value)).alias("value"))


def pack(m: DataFrame) -> DataFrame:
    """(layer, node, z array by t, u unit vector of the centred series, spread) of every node; u is null when constant.

    ``m`` may also be series already: (layer, node, v array by t), a row a node.
    """
    s = m if "v" in m.columns else m.groupBy("layer", "node").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("v"))
    return units(s).select("layer", "node", "v", "u", F.transform("u", lambda x: x * F.sqrt(F.size("v") - 1)).alias("z"))


def basis_rows(layers: DataFrame, times: int = 5) -> DataFrame:
    """The anchor series e1..e5 of each layer, packed like :func:`pack`; z with population deviation."""
    one = F.explode(F.array(*[F.struct(F.lit(b).alias("node"), F.array(*[F.lit(float(i == j)) for j in range(times)]).alias("v")) for i, b in enumerate(BASIS[:times])]))
    s = layers.select("layer").distinct().select("layer", one.alias("b")).select("layer", "b.node", "b.v")
    mean, root = 1 / times, (1 - 1 / times) ** 0.5
    return s.select("layer", "node", "v", F.transform("v", lambda x: (x - mean) / root).alias("u"), F.transform("v", lambda x: (x - mean) / (root / times**0.5)).alias("z"))


def dot(a: Column, b: Column, n: int) -> Column:
    """Unrolled product of two arrays of n, one expression inside code generation."""
    out = a[0] * b[0]
    for i in range(1, n):
        out = out + a[i] * b[i]
    return out


def n_times(packed: DataFrame) -> int:
    return int(packed.agg(F.max(F.size("u"))).first()[0] or 0)


def pair_blocks(packed: DataFrame) -> int:
    """Blocks of nodes whose pairs give each shuffle partition of the session about one place to meet."""
    return max(1, math.ceil(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))


def correlations(packed: DataFrame, blocks: int | None = None, nan_policy: str = "drop") -> DataFrame:
    """(layer, src, dst, c) with src < dst: Pearson correlation of all pairs within a layer.

    Nodes are dealt to blocks and a pair of blocks, the smaller first, meets in one place, so a layer is not one task and
    every pair is made once. Constant series have no correlation: dropped, or 0 with ``zero_corr``.
    """
    if nan_policy not in ("drop", "zero_corr"):
        raise ValueError(f"unknown nan_policy {nan_policy!r}")
    blocks = blocks or pair_blocks(packed)
    n = n_times(packed)
    p = packed.select("layer", "node", "u", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("mine"))
    p = p.filter("u is not null") if nan_policy == "drop" else p
    left = p.select("layer", F.col("mine").alias("bi"), F.explode(F.expr(f"sequence(mine, {blocks - 1})")).alias("bj"), F.col("node").alias("m"), F.col("u").alias("x"))
    right = p.select("layer", F.explode(F.expr("sequence(0, mine)")).alias("bi"), F.col("mine").alias("bj"), F.col("node").alias("n"), F.col("u").alias("y"))
    c = dot(F.col("x"), F.col("y"), n) if n else F.lit(None).cast("double")
    met = left.join(right, ["layer", "bi", "bj"]).filter("m <> n and (bi < bj or m < n)")
    out = met.select("layer", F.least("m", "n").alias("src"), F.greatest("m", "n").alias("dst"), c.alias("c"))
    return out if nan_policy == "drop" else out.withColumn("c", F.coalesce("c", F.lit(0.0)))


#: Nodes of a layer from which on a bound on correlations is worth cells; only the cost depends on it.
PRUNE_NODES = 4096


def class_correlations(packed: DataFrame, least: float) -> DataFrame:
    """(layer, ms, ns, same, c): lists of nodes of equal series whose abs(c) is at least ``least`` (up to rounding), without making the pairs that cells rule out.

    Every pair of lists is there once; ``same``: both are one list.
    """
    rows = materialize(simjoin.classes(packed), "classes")
    n = n_times(rows)
    if not n:
        return rows.select("layer", F.col("nodes").alias("ms"), F.col("nodes").alias("ns"), F.lit(True).alias("same"), F.lit(None).cast("double").alias("c")).filter("false")
    met = simjoin.candidate_pairs(rows, least)
    met = met.select("layer", "ms", "ns", (F.col("m") == F.col("n")).alias("same"), dot(F.col("x"), F.col("y"), n).alias("c"))
    return met.filter(F.abs("c") >= least - simjoin.SLACK)


def expand(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair of nodes that rows (layer, ms, ns, same, ...) stand for, as (layer, src, dst, ...).

    A direction of a pair of lists at a time and all of a source before the next: files then hold runs of equal sources and values,
    and destinations that recur, in few bytes.
    """
    rest = [c for c in pairs.columns if c not in ("layer", "ms", "ns", "same")]
    ways = F.when(F.col("same"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    e = pairs.select("*", F.explode(ways).alias("back")).select("layer", F.expr("if(back, ns, ms)").alias("srcs"), F.expr("if(back, ms, ns)").alias("dsts"), "same", *rest)
    e = e.select("layer", F.explode("srcs").alias("src"), "dsts", "same", *rest).select("layer", "src", F.explode("dsts").alias("dst"), "same", *rest)
    return e.filter("not same or src <> dst").drop("same")


def correlations_above(packed: DataFrame, least: float) -> DataFrame:
    """The rows of :func:`correlations` with abs(c) of at least ``least`` (up to rounding), without making the pairs that cells rule out.

    Nodes of equal series are compared once; their names are only written out in pairs behind the last shuffle.
    """
    return expand(class_correlations(packed, least)).filter("src < dst")


def _bound(packed: DataFrame, kernel: str | K.Kernel, sigma: float | None, n: float | None, threshold: float, prune: bool | None) -> float | None:
    """Least abs(c) that may weigh ``threshold``, where the kernel gives one and a layer is large, or as ``prune`` says; else none."""
    least = K.inverse_threshold(kernel, threshold, sigma, n) if isinstance(kernel, str) and threshold else None
    if least is None or least <= 0 or prune is False:
        return None
    if prune is None and packed.groupBy("layer").count().filter(F.col("count") >= PRUNE_NODES).isEmpty():
        return None
    return least


def mirror(e: DataFrame) -> DataFrame:
    """Both directions of edges that are there once; ``e`` is made once."""
    rest = [c for c in e.columns if c not in ("layer", "src", "dst")]
    both = e.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    return both.select("layer", F.expr("if(back, dst, src)").alias("src"), F.expr("if(back, src, dst)").alias("dst"), *rest)


def weigh(corr: DataFrame, kernel: str | K.Kernel, sigma: float | None = None, n: float | None = None) -> DataFrame:
    """Directed edges (layer, src, dst, w, sign) of correlations."""
    return mirror(_weights(corr, kernel, sigma, n))


def _weights(corr: DataFrame, kernel: str | K.Kernel, sigma: float | None, n: float | None) -> DataFrame:
    return corr.select(*(c for c in corr.columns if c != "c"), K.apply(kernel, F.col("c"), sigma, n).alias("w"), K.sign(F.col("c")).alias("sign"))


def layer_graphs(m: DataFrame, kernel: str | K.Kernel = "exponential_abs", sigma: float | None = 0.05, n: float | None = None, threshold: float = 0.01, start: str | None = "e3", end: str | None = "e5", basis: bool = True, blocks: int | None = None, prune: bool | None = None, digits: int | None = None) -> Graph:
    """Graph of each layer with its basis nodes; weights below ``threshold`` (strictly) are no edges.

    If start or end is a basis node, the edges of every other basis node go; else all five stay connected. Kernels that
    keep the diagonal give each node a self-loop of weight 1. Where the kernel and threshold bound the correlation, layers of
    PRUNE_NODES nodes or more (``prune`` True: all, False: none) make only the pairs that may reach it. Weights that reach the
    threshold are rounded to ``digits`` places, if given: where nodes have equal series, once for all of their pairs.
    """
    packed = pack(m)
    if basis:
        packed = packed.unionByName(basis_rows(packed))
    kept = lambda e: e.filter(F.abs("w") >= threshold).withColumn("w", F.col("w") if digits is None else F.round("w", digits) + 0.0)
    least = _bound(packed, kernel, sigma, n, threshold, prune)
    edges = kept(weigh(correlations(packed, blocks), kernel, sigma, n)) if least is None else expand(kept(_weights(class_correlations(packed, least), kernel, sigma, n)))
    nodes = packed.select("layer", "node")
    if kernel in K.KEEPS_DIAGONAL:
        loops = packed.filter("u is not null").select("layer", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w"), F.lit(1).alias("sign"))
        edges = edges.unionByName(loops.filter(F.abs("w") >= threshold))
    if basis and {start, end} & set(BASIS):
        out = [b for b in BASIS if b not in (start, end)]
        edges = edges.filter(~F.col("src").isin(out) & ~F.col("dst").isin(out))
    return Graph(edges, nodes)


def negative_graphs(m: DataFrame, threshold: float = -0.3, sigma: float = 0.5) -> Graph:
    """Only correlations below ``threshold``, weighed by the absolute Gaussian kernel; no basis nodes."""
    packed = pack(m)
    return Graph(weigh(correlations(packed).filter(F.col("c") < threshold), "gaussian_abs", sigma), packed.select("layer", "node"))


def adjacency(m: DataFrame, method: str = "exponential_abs", n_power: float = 4, sigma: float = 0.2) -> Graph:
    """All pairs with missing correlations taken as 0 before the kernel, diagonal 0.

    ``power`` and ``gaussian_abs`` are used as named, every other method is the exponential of absolute correlation.
    """
    packed = pack(m)
    method = method if method in ("power", "gaussian_abs") else "exponential_abs"
    return Graph(weigh(correlations(packed, nan_policy="zero_corr"), method, sigma, n_power), packed.select("layer", "node"))


def attach_basis(g: Graph, packed: DataFrame, top_k: int = 3, weight: float = 1.0, action: str = "add") -> Graph:
    """``remove``: without basis nodes. ``add``: each basis node linked both ways to its top_k nodes by signed correlation.

    Former edges of basis nodes go first; ties of correlation are broken by name; the sign is that of the correlation,
    1 for 0.
    """
    if action not in ("add", "remove"):
        raise ValueError("action must be 'add' or 'remove'")
    rest = g.edges.filter(~F.col("src").isin(*BASIS) & ~F.col("dst").isin(*BASIS))
    plain = g.nodes.filter(~F.col("node").isin(*BASIS))
    if action == "remove":
        return Graph(rest, plain)
    own = packed.filter(~F.col("node").isin(*BASIS) & F.col("u").isNotNull())
    b = basis_rows(packed).select("layer", F.col("node").alias("src"), F.col("u").alias("bu"))
    c = own.join(F.broadcast(b), "layer").select("layer", "src", F.col("node").alias("dst"), dot(F.col("bu"), F.col("u"), n_times(packed)).alias("c"))
    w = W.partitionBy("layer", "src").orderBy(F.desc(F.round("c", 12)), "dst")
    top = c.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= top_k)
    top = top.select("layer", "src", "dst", F.lit(weight).alias("w"), F.when(F.col("c") < 0, -1).otherwise(1).alias("sign"))
    return Graph(rest.unionByName(mirror(top)), plain.unionByName(b.select("layer", F.col("src").alias("node"))))


def transition(edges: DataFrame, unweighted: bool = False) -> DataFrame:
    """Rows divided by their sums, or 1 / outdegree over positive weights; keys are all columns but w and sign."""
    key = [c for c in ("layer", "src") if c in edges.columns]
    if unweighted:
        edges = edges.filter("w > 0")
        return edges.withColumn("w", 1.0 / F.count(F.lit(1)).over(W.partitionBy(*key)))
    total = F.sum("w").over(W.partitionBy(*key))
    return edges.filter("not isnan(w)").withColumn("w", F.when(total == 0, F.col("w")).otherwise(F.try_divide(F.col("w"), total)))


def _ends(edges: DataFrame, value: Column) -> DataFrame:
    """(layer, node, value) of both ends of every edge, in one pass."""
    ends = F.explode(F.array("src", "dst"))
    return edges.select("layer", ends.alias("node"), value.alias("x"))


def strength_subgraph(g: Graph, threshold: float, max_nodes: int, forced: list[str] | None = None) -> Graph:
    """Edges of at least ``threshold`` among the max_nodes strongest nodes (in plus out) of each layer.

    Isolated nodes go, unless ``forced`` is given: then the named nodes stay, and so do isolated ones.
    """
    edges = g.edges.filter(F.col("w") >= threshold)
    s = _ends(edges, F.col("w")).groupBy("layer", "node").agg(F.sum("x").alias("x"))
    s = g.nodes.join(s, ["layer", "node"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    keep = selection.first_rows(s, ["layer"], [F.desc(F.round("x", 9)), F.col("node")], max_nodes, "node").select("layer", "node")
    if forced:
        keep = keep.union(g.nodes.filter(F.col("node").isin(*forced)).select("layer", "node")).distinct()
    edges = edges.join(keep.withColumnRenamed("node", "src"), ["layer", "src"], "left_semi").join(keep.withColumnRenamed("node", "dst"), ["layer", "dst"], "left_semi")
    edges = edges.select(*g.edges.columns)
    if forced is None:
        keep = keep.join(_ends(edges, F.lit(1)).select("layer", "node").distinct(), ["layer", "node"], "left_semi")
    return Graph(edges, keep)


def degree_subgraph(g: Graph, threshold: float, top_n: int, always: tuple[str, ...] = ()) -> Graph:
    """Subgraph of the top_n nodes of each layer by number of edges at ``threshold`` or more, and those always shown."""
    edges = g.edges.filter(F.col("w") >= threshold)
    d = g.nodes.join(edges.groupBy("layer", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("d")), ["layer", "node"], "left")
    keep = selection.first_rows(d, ["layer"], [F.desc(F.coalesce("d", F.lit(0))), F.col("node")], top_n, "node").select("layer", "node")
    if always:
        keep = keep.union(g.nodes.filter(F.col("node").isin(*always)).select("layer", "node")).distinct()
    out = edges.join(keep.withColumnRenamed("node", "src"), ["layer", "src"], "left_semi").join(keep.withColumnRenamed("node", "dst"), ["layer", "dst"], "left_semi")
    return Graph(out.select(*g.edges.columns), keep)


def strongest_undirected(edges: DataFrame) -> DataFrame:
    """(layer, a, b, w) of each unordered pair: the weight of larger size."""
    e = edges.filter("src <> dst").select("layer", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "w")
    return e.groupBy("layer", "a", "b").agg(F.max_by("w", F.struct(F.abs("w"), "w")).alias("w"))


def percentile_graph(edges: DataFrame, q: float = 0.9) -> DataFrame:
    """Edges strictly above the q-quantile (linear interpolation) of the layer's positive weights."""
    cut = selection.quantile_cuts(edges.filter("w > 0"), "layer", "w", q)
    cut = edges.sparkSession.createDataFrame(list(cut.items()), "layer string, cut double")  # a row a layer
    return edges.join(F.broadcast(cut), "layer").filter("w > cut").drop("cut")


def degree_table(g: Graph) -> DataFrame:
    """(layer, node, n_out, n_in) counts of positive weights of every node."""
    pos = g.edges.filter("w > 0")
    o = pos.groupBy("layer", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    i = pos.groupBy("layer", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    d = g.nodes.join(o, ["layer", "node"], "left").join(i, ["layer", "node"], "left")
    return d.select("layer", "node", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def degree_extremes(g: Graph) -> DataFrame:
    """Largest and smallest in and out degree of each layer with the first node, by name, that has it."""
    d = degree_table(g)
    agg = []
    for side in ("out", "in"):
        n = F.col(f"n_{side}")
        agg += [F.max(n).alias(f"max_{side}"), F.min_by("node", F.struct(-n, F.col("node"))).alias(f"max_{side}_node"), F.min(n).alias(f"min_{side}"), F.min_by("node", F.struct(n, F.col("node"))).alias(f"min_{side}_node")]
    return d.groupBy("layer").agg(*agg)


def graph_statistics(g: Graph) -> DataFrame:
    """Least, largest, mean and median entry of each layer's dense matrix, absent edges counted as zeros."""
    n = g.nodes.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    s = g.edges.groupBy("layer").agg(F.count(F.lit(1)).alias("m"), F.min("w").alias("lo"), F.max("w").alias("hi"), F.sum("w").alias("s"), F.count_if(F.col("w") < 0).alias("neg"))
    s = n.join(s, "layer", "left").na.fill(0)
    cells = F.col("n") * F.col("n")
    zeros = cells - F.col("m")
    # places of the middle cells among the sorted weights: zeros stand between negative and positive ones
    at = lambda k, r: k if k <= r.neg else None if k <= r.neg + r.n**2 - r.m else k - (r.n**2 - r.m)
    middle = {r.layer: [at((r.n**2 + 1) // 2, r), at((r.n**2 + 2) // 2, r)] for r in s.collect()}  # a row a layer
    found = selection.order_statistics(g.edges, "layer", "w", {k: sorted({x for x in v if x}) for k, v in middle.items()})
    mid = g.edges.sparkSession.createDataFrame([(k, float(sum(found[k, x] for x in v if x))) for k, v in middle.items()], "layer string, mid double")
    return s.join(mid, "layer", "left").select(
        "layer", "n", F.when(zeros > 0, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("min_w"), F.when(zeros > 0, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("max_w"),
        (F.col("s") / cells).alias("mean_w"), (F.coalesce("mid", F.lit(0.0)) / 2).alias("median_w"),
    )
