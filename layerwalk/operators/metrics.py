"""Graph quality metrics and parameter sweeps over sparse edges; absent edges and isolated nodes count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans.stages import materialize
from .layers import Graph, correlations, mirror, pack

NEAR_ZERO = 0.01


def connectivity(g: Graph, keys: tuple[str, ...] = ("layer",)) -> DataFrame:
    """(keys, node, k): strength of every node over its edges to others."""
    s = g.edges.filter("src <> dst and not isnan(w)").groupBy(*keys, F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    return g.nodes.join(s, [*keys, "node"], "left").select(*keys, "node", F.coalesce("k", F.lit(0.0)).alias("k"))


def mean_degree(g: Graph, keys: tuple[str, ...] = ("layer",)) -> DataFrame:
    return connectivity(g, keys).groupBy(*keys).agg(F.avg("k").alias("mean_degree"))


def isolated_nodes(g: Graph, keys: tuple[str, ...] = ("layer",)) -> DataFrame:
    """Nodes whose strength is within 0.01 of zero."""
    return connectivity(g, keys).groupBy(*keys).agg(F.count_if(F.abs("k") <= NEAR_ZERO).alias("isolated"))


def sparsity(g: Graph, keys: tuple[str, ...] = ("layer",)) -> DataFrame:
    """Share of off-diagonal entries of size at most 0.01; 0 for a single node."""
    n = g.nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    m = g.edges.filter((F.col("src") != F.col("dst")) & (F.abs("w") > NEAR_ZERO)).groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    cells = F.col("n") * (F.col("n") - 1)
    return n.join(m, list(keys), "left").select(*keys, F.when(cells == 0, 0.0).otherwise(1 - F.coalesce("m", F.lit(0)) / cells).alias("sparsity"))


#: Pairs of a node's later neighbours that meet in one place, in each direction.
SIDE = 512


def ordered_pairs(e: DataFrame, k: list[str]) -> DataFrame:
    """(keys, a, b, f, g, da, db, later): each pair of nodes once, the one of smaller degree (then name) as a, with the weights a to b and b to a.

    ``later`` is the number of pairs in which a comes first: at most the root of twice the number of pairs, also for a hub.
    """
    one = e.select(*k, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.when(F.col("src") < F.col("dst"), F.col("w")).alias("uv"), F.when(F.col("src") > F.col("dst"), F.col("w")).alias("vu"))
    one = one.groupBy(*k, "u", "v").agg(F.coalesce(F.max("uv"), F.lit(0.0)).alias("uv"), F.coalesce(F.max("vu"), F.lit(0.0)).alias("vu"))
    d = one.select(*k, F.explode(F.array("u", "v")).alias("node")).groupBy(*k, "node").agg(F.count(F.lit(1)).alias("d"))
    one = one.join(d.withColumnsRenamed({"node": "u", "d": "du"}), [*k, "u"]).join(d.withColumnsRenamed({"node": "v", "d": "dv"}), [*k, "v"])
    first = F.struct("du", "u") < F.struct("dv", "v")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    p = one.select(*k, pick("u", "v").alias("a"), pick("v", "u").alias("b"), pick("uv", "vu").alias("f"), pick("vu", "uv").alias("g"), pick("du", "dv").alias("da"), pick("dv", "du").alias("db"))
    later = p.groupBy(*k, "a").agg(F.count(F.lit(1)).alias("later"))
    return p.join(later, [*k, "a"])


def triangles(p: DataFrame, k: list[str]) -> DataFrame:
    """(keys, x, y, z, t) of each triangle of :func:`ordered_pairs` once: t is the product of weights around it, both ways, added up.

    Two pairs meet at their node of smallest degree. A node with many later neighbours is dealt to blocks of SIDE x SIDE of them.
    """
    blocks = F.ceil(F.col("later") / SIDE).cast("int")
    mine = F.pmod(F.xxhash64("b"), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    left = p.select(*k, F.col("a").alias("x"), mine.alias("lb"), every.alias("rb"), F.col("b").alias("y"), F.col("db").alias("dy"), F.col("f").alias("xy"), F.col("g").alias("yx"))
    right = p.select(*k, F.col("a").alias("x"), mine.alias("rb"), every.alias("lb"), F.col("b").alias("z"), F.col("db").alias("dz"), F.col("f").alias("xz"), F.col("g").alias("zx"))
    wedge = left.join(right, [*k, "x", "lb", "rb"]).filter(F.struct("dy", "y") < F.struct("dz", "z"))
    close = p.select(*k, F.col("a").alias("y"), F.col("b").alias("z"), F.col("f").alias("yz"), F.col("g").alias("zy"))
    t = F.col("xy") * F.col("yz") * F.col("zx") + F.col("xz") * F.col("zy") * F.col("yx")
    return wedge.join(close, [*k, "y", "z"]).select(*k, "x", "y", "z", t.alias("t"))


def clustering_coefficient(g: Graph, keys: tuple[str, ...] = ("layer",)) -> DataFrame:
    """Mean over all nodes of the weighted clustering coefficient, relative to the largest weight; weights need not be symmetric.

    Of node i: sum over j <> l of w_ij w_jl w_li, over sum of w_ij times sum of w_li less sum of w_ij w_ji, over the largest weight; 0 without pairs.
    """
    k = list(keys)
    e = g.edges.filter("src <> dst").groupBy(*k, "src", "dst").agg(F.sum(F.abs("w")).alias("w")).filter("w > 0")
    p = materialize(ordered_pairs(e, k), "pairs")
    num = triangles(p, k).select(*k, F.explode(F.array("x", "y", "z")).alias("node"), "t").groupBy(*k, "node").agg(F.sum("t").alias("num"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("f").alias("o"), F.col("g").alias("i")), F.struct(F.col("b").alias("node"), F.col("g").alias("o"), F.col("f").alias("i")))).alias("end")
    den = p.select(*k, ends).groupBy(*k, F.col("end.node").alias("node")).agg((F.sum("end.o") * F.sum("end.i") - F.sum(F.col("end.o") * F.col("end.i"))).alias("den"))
    top = e.groupBy(*k).agg(F.max("w").alias("top"))
    c = g.nodes.join(num, [*k, "node"], "left").join(den, [*k, "node"], "left").join(F.broadcast(top), k, "left")
    one = F.when((F.col("den") > 1e-15) & (F.col("top") > 0), F.coalesce("num", F.lit(0.0)) / F.col("den") / F.col("top")).otherwise(0.0)
    return c.groupBy(*k).agg(F.avg(one).alias("clustering"))


def scale_free_fit(g: Graph, bins: int = 10, keys: tuple[str, ...] = ("layer",)) -> DataFrame:
    """(keys, r2, slope, n_points): fit of log10 frequency on log10 mean strength over equal-width bins (Zhang and Horvath, 2005).

    Strengths that are not positive are left out; empty bins too. Under three strengths give null fits. The binning is
    our definition: the outermost bins close at the least and largest strength.
    """
    k = list(keys)
    c = connectivity(g, keys).filter("k > 0")
    lim = c.groupBy(*k).agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count(F.lit(1)).alias("n"))
    c = c.join(F.broadcast(lim), k)
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("k") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    b = c.groupBy(*k, "n", b.alias("bin")).agg(F.avg("k").alias("mean_k"), (F.count(F.lit(1)) / F.first("n")).alias("p"))
    x, y = F.log10("mean_k"), F.log10("p")
    fit = b.groupBy(*k, "n").agg(F.regr_r2(y, x).alias("r2"), F.regr_slope(y, x).alias("slope"))
    return fit.select(*k, F.when(F.col("n") >= 3, F.col("r2")).alias("r2"), F.when(F.col("n") >= 3, F.col("slope")).alias("slope"), F.col("n").alias("n_points"))


def sweep(m: DataFrame, kernel: str | K.Kernel, parameter: str, values: list[float], threshold: float = 0.01) -> DataFrame:
    """Metrics of every layer at every value of ``sigma`` or ``n``: one correlation pass, all values at once."""
    if parameter not in ("sigma", "n"):
        raise ValueError(f"unknown parameter {parameter!r}")
    packed = pack(m)
    corr = correlations(packed)
    arms = F.array(*[F.struct(F.lit(float(v)).alias("param"), K.apply(kernel, F.col("c"), **{parameter: v}).alias("w")) for v in values])
    e = corr.select("layer", "src", "dst", F.explode(arms).alias("x")).select("layer", "src", "dst", "x.param", "x.w").filter(F.col("w") >= threshold)
    nodes = packed.select("layer", "node", F.explode(F.array(*[F.lit(float(v)) for v in values])).alias("param"))
    return table(Graph(mirror(e), nodes), ("layer", "param"))


def table(g: Graph, keys: tuple[str, ...] = ("layer",)) -> DataFrame:
    """All metrics of each graph in one row."""
    g = Graph(materialize(g.edges, "graph"), materialize(g.nodes, "graph"))
    out = scale_free_fit(g, keys=keys)
    for other in (clustering_coefficient, sparsity, isolated_nodes, mean_degree):
        out = other(g, keys).join(out, list(keys), "left")
    return out.select(*keys, "mean_degree", "isolated", "sparsity", "clustering", "r2", F.signum("slope").alias("slope_sign"), "n_points")


def symmetry(edges: DataFrame, keys: tuple[str, ...] = ("layer",), atol: float = 1e-8, rtol: float = 1e-5) -> DataFrame:
    """(keys, is_symmetric, max_asymmetry) of sparse matrices."""
    k = list(keys)
    t = edges.select(*k, F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("v"))
    both = edges.select(*k, "src", "dst", "w").join(t, [*k, "src", "dst"], "full")
    w, v = F.coalesce("w", F.lit(0.0)), F.coalesce("v", F.lit(0.0))
    return both.groupBy(*k).agg(F.bool_and(F.abs(w - v) <= atol + rtol * F.abs(v)).alias("is_symmetric"), F.max(F.abs(w - v)).alias("max_asymmetry"))


def element_range(g: Graph) -> DataFrame:
    """(layer, min_w, max_w, range_w, has_nan, has_inf) of the dense matrices, absent edges counted as zeros."""
    n = g.nodes.groupBy("layer").agg((F.count(F.lit(1)) * F.count(F.lit(1))).alias("cells"))
    ok = F.when(~F.isnan("w"), F.col("w"))
    s = g.edges.groupBy("layer").agg(F.min(ok).alias("lo"), F.max(ok).alias("hi"), F.count(F.lit(1)).alias("m"), F.bool_or(F.isnan("w")).alias("has_nan"), F.bool_or(F.abs("w") == float("inf")).alias("has_inf"))
    s = n.join(s, "layer", "left")
    holes = F.coalesce("m", F.lit(0)) < F.col("cells")
    lo, hi = F.when(holes, F.least(F.coalesce("lo", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("lo")), F.when(holes, F.greatest(F.coalesce("hi", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("hi"))
    return s.select("layer", lo.alias("min_w"), hi.alias("max_w"), (hi - lo).alias("range_w"), F.coalesce("has_nan", F.lit(False)).alias("has_nan"), F.coalesce("has_inf", F.lit(False)).alias("has_inf"))
