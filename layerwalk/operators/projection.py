"""Principal components of short series: sums over the data, an eigenproblem of T x T on the driver, columns again."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import BASIS


@dataclass
class Pca:
    mean: np.ndarray
    components: np.ndarray  # (k, T), the largest loading of each is positive
    ratio: np.ndarray  # explained share of variance


def covariance(packed: DataFrame, times: int) -> DataFrame:
    """(i, j, cov) of the columns of all z rows, i <= j, with n - 1."""
    pairs = [(i, j) for i in range(times) for j in range(i, times)]
    z = F.col("z")
    row = packed.filter("z is not null").agg(*[F.covar_samp(z[i], z[j]).alias(f"c{i}_{j}") for i, j in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("cov")) for i, j in pairs])).alias("x")).select("x.*")


def fit(packed: DataFrame, times: int, k: int = 3) -> Pca:
    cov = np.zeros((times, times))
    for r in covariance(packed, times).collect():  # times * (times + 1) / 2 rows
        cov[r.i, r.j] = cov[r.j, r.i] = r.cov
    mean = packed.filter("z is not null").agg(*[F.avg(F.col("z")[i]) for i in range(times)]).first()
    val, vec = np.linalg.eigh(cov)
    comp = vec[:, ::-1][:, :k].T
    comp = comp * np.sign(comp[np.arange(len(comp)), np.abs(comp).argmax(1)])[:, None]
    return Pca(np.array(mean, float), comp, val[::-1][:k] / val.sum())


def project(rows: DataFrame, pca: Pca, column: str = "z") -> DataFrame:
    """Adds pc1, pc2, ... of an array column, centred first."""
    out = {f"pc{c + 1}": sum(((F.col(column)[t] - float(pca.mean[t])) * float(w) for t, w in enumerate(v)), F.lit(0.0)) for c, v in enumerate(pca.components)}
    return rows.withColumns(out)


def projection_map(packed: DataFrame, times: int) -> tuple[DataFrame, Pca]:
    """(layer, node, pc1..pc3) of every series of several times, and the model."""
    pca = fit(packed, times)
    return project(packed.filter("z is not null"), pca).select("layer", "node", "pc1", "pc2", "pc3"), pca


def ideal_points(spark: SparkSession, times: int = 5, per_segment: int = 50) -> DataFrame:
    """(step, z): the way e1 to e_T in straight segments, each point standardised with population deviation.

    Only the last segment holds its end.
    """
    n = (times - 1) * per_segment
    p = spark.range(n).withColumn("seg", F.floor(F.col("id") / per_segment))
    last = F.col("seg") == times - 2
    f = (F.col("id") - F.col("seg") * per_segment) / F.when(last, float(per_segment - 1)).otherwise(float(per_segment))
    v = F.array(*[F.when(F.col("seg") == t, 1 - f).when(F.col("seg") + 1 == t, f).otherwise(0.0) for t in range(times)])
    p = p.withColumn("v", v)
    mean = 1.0 / times
    sd = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / times)
    return p.withColumn("sd", sd).select(F.col("id").alias("step"), F.transform("v", lambda x: F.when(F.col("sd") > 0, (x - mean) / F.col("sd")).otherwise(x - mean)).alias("z"))


def basis_points(spark: SparkSession, times: int = 5) -> DataFrame:
    """(node, z) of the basis series with population deviation."""
    mean, sd = 1 / times, ((1 - 1 / times) / times) ** 0.5
    return spark.createDataFrame([(BASIS[i], [(float(i == t) - mean) / sd for t in range(times)]) for i in range(times)], "node string, z array<double>")
