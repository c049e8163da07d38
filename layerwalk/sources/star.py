"""Layers out of a star schema: ship years of line items as time, return flags as layers, brands as nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layers import fill_times
from ..plans.stages import materialize


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, node, t, value): summed quantity of 1995-1999 by flag and brand; with the type after ``*`` but for R.

    Written once: the graphs read it several times, and the line items only here.
    """
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_shipdate >= '1995-01-01' and l_shipdate < '2000-01-01'")  # a range of dates reaches the scan, a year does not
    item = item.select("l_partkey", "l_returnflag", "l_quantity", F.year("l_shipdate").alias("y"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_type")
    item = item.join(part, F.col("p_partkey") == F.col("l_partkey"))
    flag = F.col("l_returnflag")
    layer = F.when(flag == "R", "rna_ai").when(flag == "A", "k9me2").otherwise("k20me3")
    node = F.when(flag == "R", F.col("p_brand")).otherwise(F.concat_ws("*", "p_brand", "p_type"))
    m = item.groupBy(layer.alias("layer"), node.alias("node"), (F.col("y") - 1995).alias("t")).agg(F.sum("l_quantity").alias("value"))
    return fill_times(materialize(m, "measurements"))


def part_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, node, v array by year): summed quantity of 1995-1999 by return flag and part, 0 where there is none, so layers grow with the parts.

    One shuffle of sums by series, which are written once and filled where they are read; years without any line item are no times.
    """
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_shipdate >= '1995-01-01' and l_shipdate < '2000-01-01'").withColumn("t", F.year("l_shipdate") - 1995)
    sums = F.array(*(F.sum(F.when(F.col("t") == t, F.col("l_quantity"))) for t in range(5)))
    own = item.filter("l_returnflag is not null and l_partkey is not null").groupBy(F.col("l_returnflag").alias("layer"), "l_partkey").agg(sums.alias("own"))
    times = item.agg(F.sort_array(F.collect_set("t")).alias("times"))  # one row of at most five
    filled = materialize(own, "series").crossJoin(F.broadcast(times))
    return filled.select("layer", F.col("l_partkey").cast("string").alias("node"), F.expr("transform(times, t -> coalesce(own[t], 0D))").alias("v"))
