"""Numbers behind charts; rendering is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import BASIS, is_basis


def scale_scores(scores: DataFrame, mode: str = "relative", reference: float = 1.0, source_tolerance: float = 1e-9, radius: tuple[float, float] = (4.0, 22.0), alpha: tuple[float, float] = (0.25, 1.0), basis_radius: float = 12.0) -> DataFrame:
    """(node, score, scaled, radius, alpha) of finite scores: square roots, then min-max or a share of the reference.

    Sources, whose score is within the tolerance of 1, do not take part in the scaling and get 1. Equal scores get 0.5.
    Basis nodes have a fixed radius.
    """
    if mode not in ("relative", "absolute"):
        raise ValueError("mode must be 'relative' or 'absolute'")
    if mode == "absolute" and reference <= 0:
        raise ValueError("reference must be positive")
    if source_tolerance < 0:
        raise ValueError("source_tolerance must not be negative")
    s = scores.filter(~F.isnan("score") & (F.abs("score") < float("inf")))
    s = s.withColumn("x", F.sqrt(F.greatest("score", F.lit(0.0)))).withColumn("source", F.col("score") >= 1 - source_tolerance)
    rest = F.when(~F.col("source"), F.col("x"))
    lim = F.broadcast(s.agg(F.min(rest).alias("lo"), F.max(rest).alias("hi")))
    s = s.crossJoin(lim)
    if mode == "relative":
        x = F.when(F.col("hi") - F.col("lo") > 1e-15, (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    else:
        x = F.greatest(F.least(F.col("x") / reference, F.lit(1.0)), F.lit(0.0))
    s = s.withColumn("scaled", F.when(F.col("source"), 1.0).otherwise(x))
    size = F.when(is_basis(F.col("node")), basis_radius).otherwise(radius[0] + (radius[1] - radius[0]) * F.col("scaled"))
    return s.select("node", "score", "scaled", size.alias("radius"), (alpha[0] + (alpha[1] - alpha[0]) * F.col("scaled")).alias("alpha"))


def visit_sizes(visits: DataFrame, start: str, end: str, least: float = 4.0, most: float = 30.0) -> DataFrame:
    """(node, visits, size): regular and shadow visits (node, visits) together; start and end set no scale unless basis nodes."""
    v = visits.groupBy(F.regexp_replace("node", "_neg$", "").alias("node")).agg(F.sum("visits").cast("double").alias("v"))
    counts = ~F.col("node").isin(start, end) | is_basis(F.col("node"))
    top = F.broadcast(v.agg(F.max(F.when(counts, F.col("v"))).alias("top")))
    x = F.when(F.col("v") == 0, 0.1).otherwise(F.col("v"))
    size = least + (most - least) * (x - 0.1) / (F.coalesce("top", F.lit(0.1)) - 0.1 + 1e-10)
    return v.crossJoin(top).select("node", F.col("v").cast("long").alias("visits"), size.alias("size"))


def path_segments(walks: DataFrame) -> DataFrame:
    """(simulation, segment, is_transition, first, last, nodes): stretches of a path within one space, and the steps between.

    A space is regular or shadow (``_neg``); a step from one to the other is a transition.
    """
    p = walks.select("simulation", F.posexplode("path").alias("pos", "node"))
    w = W.partitionBy("simulation").orderBy("pos")
    p = p.withColumn("neg", F.col("node").contains("_neg")).withColumn("next", F.lead("node").over(w)).withColumn("cross", F.lead("neg").over(w) != F.col("neg")).filter("next is not null")
    p = p.withColumn("segment", F.sum(F.coalesce((F.col("cross") != F.lag("cross").over(w)) | F.col("cross"), F.lit(False)).cast("int")).over(w))
    return p.groupBy("simulation", "segment").agg(F.bool_or("cross").alias("is_transition"), F.min_by("node", "pos").alias("first"), F.max_by("next", "pos").alias("last"), (F.count(F.lit(1)) + 1).alias("nodes"))


def endpoint_bias(tallies: DataFrame) -> DataFrame:
    """(node, tally_a, tally_b, side) with shadows added to their nodes; equal tallies are on side A."""
    t = tallies.groupBy(F.regexp_replace("node", "_neg$", "").alias("node")).agg(F.sum("tally_a").alias("tally_a"), F.sum("tally_b").alias("tally_b"))
    return t.withColumn("side", F.when(F.col("tally_a") >= F.col("tally_b"), "A").otherwise("B"))


def centrality_network(scores: DataFrame, undirected: DataFrame, n: int = 20, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, score, scaled, size, is_source) of the top n scores, and edges (a, b, w, width) among them."""
    top = scores.orderBy(F.desc(F.round("score", 9)), "node").limit(n).withColumn("is_source", F.col("score") >= 1 - tolerance)
    rest = F.when(~F.col("is_source"), F.col("score"))
    lim = F.broadcast(top.agg(F.min(rest).alias("lo"), F.max(rest).alias("hi")))
    x = F.when(F.col("is_source"), 1.0).when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    nodes = top.crossJoin(lim).withColumn("scaled", x).select("node", "score", "scaled", (500 + 2200 * F.col("scaled")).alias("size"), "is_source")
    e = undirected.join(top.select(F.col("node").alias("a")), "a", "left_semi").join(top.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b", F.abs("w").alias("w"))
    el = F.broadcast(e.agg(F.min("w").alias("lo"), F.max("w").alias("hi")))
    width = 0.6 + 3 * F.when(F.col("hi") > F.col("lo"), (F.col("w") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    return nodes, e.crossJoin(el).select("a", "b", "w", width.alias("width"))


def heatmap_boundaries(nodes: DataFrame) -> DataFrame:
    """(layer, first, last): places of each layer's block among all nodes in order of layer and name."""
    n = nodes.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    last = F.sum("n").over(W.orderBy("layer"))
    return n.select("layer", (last - F.col("n")).alias("first"), (last - 1).alias("last"))


def dataset_of(node: str = "node", layers: tuple[str, ...] = ("k20me3", "k27me3", "rna_ai", "k9me2")) -> F.col:
    """Layer of a composed name: basis, the longest suffix that fits, or other."""
    c = F.when(F.col(node).isin(*BASIS), "basis")
    for x in sorted(layers, key=len, reverse=True):
        c = c.when(F.col(node).endswith(f"_{x}"), x)
    return c.otherwise("other")
