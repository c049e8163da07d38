"""Roll-ups to genes: timing, trajectories, cluster comparison, endpoint normalisation, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import BASIS, base_gene, time_of_label
from .diffusion import local_neighbourhood, normalise_rows


def time_axis(labels: DataFrame) -> DataFrame:
    """(label, pos, t): the number in each label; if any label has none, places for all of them."""
    t = time_of_label(F.col("label"))
    every = F.bool_and(t.isNotNull()).over(W.partitionBy(F.lit(1)))
    return labels.select("label", "pos", F.when(every, t).otherwise(F.col("pos").cast("double")).alias("t"))


def expression_time(m: DataFrame) -> DataFrame:
    """(layer, gene, mean_time): mean over a gene's rows of the times weighed by absolute values; rows of zeros have none."""
    v = F.when(F.isnan("value") | (F.abs("value") == float("inf")), 0.0).otherwise(F.abs(F.coalesce("value", F.lit(0.0))))
    r = m.groupBy("layer", "node").agg(F.try_divide(F.sum(v * F.col("t")), F.nullif(F.sum(v), F.lit(0.0))).alias("time"))
    return r.groupBy("layer", base_gene(F.col("node")).alias("gene")).agg(F.avg("time").alias("mean_time"))


def trajectories(m: DataFrame, value: str = "value") -> DataFrame:
    """(layer, gene, t, value): mean trajectory of each gene's rows."""
    return m.groupBy("layer", base_gene(F.col("node")).alias("gene"), "t").agg(F.avg(value).alias("value"))


def stage_ranking(m: DataFrame, layer: str = "rna_ai", stages: int = 5) -> DataFrame:
    """Wide (gene, stage_rank_k, stage_rank_k_expression): a gene's times by falling value; ties by time."""
    w = W.partitionBy("gene").orderBy(F.desc("value"), "t")
    r = trajectories(m.filter(F.col("layer") == layer)).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= stages)
    cols = [c for k in range(1, stages + 1) for c in (F.max(F.when(F.col("k") == k, F.col("t").cast("string"))).alias(f"stage_rank_{k}"), F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"stage_rank_{k}_expression"))]
    return r.groupBy("gene").agg(*cols)


def endpoint_genes(ends: DataFrame, histone_nodes: DataFrame) -> DataFrame:
    """(gene_name, walk_count, percentage, histone_count, normalized_count) of walk ends (column end_node).

    The gene is the text before ``_rna``; the count is divided by the number of histone nodes (column node) that contain
    the gene's name, at least 1.
    """
    g = ends.select(F.substring_index("end_node", "_rna", 1).alias("gene_name")).groupBy("gene_name").agg(F.count(F.lit(1)).alias("walk_count"))
    total = g.agg(F.sum("walk_count").alias("total"))
    sizes = sorted(r.n for r in g.select(F.length("gene_name").alias("n")).distinct().collect())
    part = F.array_distinct(F.flatten(F.array(*[F.expr(f"if(length(node) >= {n}, transform(sequence(1, greatest(length(node) - {n} + 1, 1)), k -> substring(node, k, {n})), array())") for n in sizes or [1]])))
    h = histone_nodes.select("node").distinct().select(F.explode(part).alias("gene_name")).groupBy("gene_name").agg(F.count(F.lit(1)).alias("histone_count"))
    g = g.join(h, "gene_name", "left").crossJoin(F.broadcast(total)).withColumn("histone_count", F.coalesce("histone_count", F.lit(0)))
    return g.select("gene_name", "walk_count", (100.0 * F.col("walk_count") / F.col("total")).alias("percentage"), "histone_count", (F.col("walk_count") / F.greatest("histone_count", F.lit(1))).alias("normalized_count"))


def cluster_comparison(single: DataFrame, start: str, multi_nodes: DataFrame, m: DataFrame, layer: str, r: float = 0.7, strategy: str = "auto", steps: int = 80) -> DataFrame:
    """(gene, score, score_weighted, histone_time, rna_time, n_nodes): genes near a node of one layer, weighed by RNA expression.

    Damped diffusion over the clipped, row-normalised layer graph; basis nodes go; a gene has the mean score of its
    nodes and must be an RNA node of the multilayer graph (column node). The weight is 0.5 + 0.5 min-max of the gene's
    mean absolute RNA value, 1 where all are equal; times are joined from both layers.
    """
    s = local_neighbourhood(normalise_rows(single), start, r, strategy, steps).filter(~F.col("node").isin(*BASIS))
    s = s.select(base_gene(F.col("node")).alias("gene"), F.greatest("score", F.lit(0.0)).alias("score"))
    s = s.groupBy("gene").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_nodes"))
    have = multi_nodes.filter(F.col("node").endswith("_rna_ai")).select(base_gene(F.col("node")).alias("gene")).distinct()
    s = s.join(have, "gene", "left_semi")
    rna = m.filter(F.col("layer") == "rna_ai").groupBy("node").agg(F.avg(F.abs("value")).alias("x")).groupBy(base_gene(F.col("node")).alias("gene")).agg(F.avg("x").alias("x"))
    s = s.join(rna, "gene", "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    lim = F.broadcast(s.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    s = s.crossJoin(lim).withColumn("weight", F.when(F.col("hi") > F.col("lo"), 0.5 + 0.5 * (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0))
    t = expression_time(m)
    a = t.filter(F.col("layer") == layer).select("gene", F.col("mean_time").alias("histone_time"))
    b = t.filter(F.col("layer") == "rna_ai").select("gene", F.col("mean_time").alias("rna_time"))
    return s.join(a, "gene", "left").join(b, "gene", "left").select("gene", "score", (F.col("score") * F.col("weight")).alias("score_weighted"), "histone_time", "rna_time", "n_nodes")


def top_shared(scores: DataFrame, m: DataFrame, layers: tuple[str, str], n: int, score: str = "score") -> DataFrame:
    """(gene, layer, t, value): trajectories of the top n genes (column gene) that both layers have."""
    top = scores.orderBy(F.desc(F.round(score, 9)), "gene").limit(n).select("gene")
    t = trajectories(m.filter(F.col("layer").isin(*layers)))
    both = t.groupBy("gene").agg(F.countDistinct("layer").alias("k")).filter(F.col("k") == len(set(layers)))
    return t.join(top, "gene", "left_semi").join(both, "gene", "left_semi").select("gene", "layer", "t", "value")


def coverage(genes: DataFrame, m: DataFrame) -> DataFrame:
    """(gene, found, missing): layers that have each requested gene (column gene), and those that do not, sorted."""
    have = m.select("layer", base_gene(F.col("node")).alias("gene")).distinct()
    every = genes.select("gene").distinct().crossJoin(F.broadcast(m.select("layer").distinct()))
    c = every.join(have.withColumn("has", F.lit(True)), ["gene", "layer"], "left")
    pick = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("layer")))), ",")
    return c.groupBy("gene").agg(pick(F.col("has").isNotNull()).alias("found"), pick(F.col("has").isNull()).alias("missing"))


def scores_on_positions(scores: DataFrame, positions: DataFrame, layer: str | None = None) -> DataFrame:
    """(node, score) on the nodes of a projection; names get the layer's suffix where they lack it; of duplicates the largest."""
    node = F.col("node") if layer is None else F.when(F.col("node").endswith(f"_{layer}"), F.col("node")).otherwise(F.concat("node", F.lit(f"_{layer}")))
    s = scores.select(node.alias("node"), "score").groupBy("node").agg(F.max("score").alias("score"))
    return positions.join(s, "node").select("node", "score")
