"""Series as arrays: one row a node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def units(s: DataFrame) -> DataFrame:
    """Adds spread, the length of the centred series v, and u, its unit vector; u is null when v is constant."""
    s = s.withColumn("d", F.expr("transform(v, x -> x - aggregate(v, 0D, (a, y) -> a + y) / size(v))"))
    s = s.withColumn("spread", F.expr("sqrt(aggregate(d, 0D, (a, x) -> a + x * x))"))
    return s.withColumn("u", F.when(F.col("spread") > 0, F.transform("d", lambda x: x / F.col("spread")))).drop("d")
