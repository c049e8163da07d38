"""Selection without sorting a group: order statistics by refined histograms, and the first rows of a group in two phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bins of a histogram; parts that a group is first ranked in.
BINS, PARTS = 1024, 64


def order_statistics(df: DataFrame, key: str, value: str, ranks: dict[object, list[int]]) -> dict[tuple[object, int], float]:
    """The ranks[k]-th smallest values (from 1 on) of each key k among the rows with a value.

    A round counts the values of each wanted range in BINS bins, with the least and largest of each bin, and goes on in the
    bin that holds the rank, between its least and largest, until these are equal. So ties take no longer, a range
    shrinks to one of its bins a round, and the driver sees at most keys x ranks x BINS rows. Ranks beyond a key's values are left out.
    """
    spark, found = df.sparkSession, {}
    rows = df.filter(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).cast("double").alias("x"))
    ends = {r.key: r for r in rows.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")).collect()}
    # (key, rank) -> range and rank in it
    open_ = {(k, r): (ends[k].lo, ends[k].hi, r) for k, rs in ranks.items() if k in ends for r in rs if 1 <= r <= ends[k].n}
    kind = df.schema[key].dataType.simpleString()
    while open_:
        for at in [a for a, (lo, hi, _) in open_.items() if lo == hi]:
            found[at] = open_.pop(at)[0]
        if not open_:
            break
        # ranks that share a range share its histogram
        shared = sorted({(k, lo, hi) for (k, _), (lo, hi, _) in open_.items()}, key=repr)
        want = spark.createDataFrame([(k, lo, hi, i) for i, (k, lo, hi) in enumerate(shared)], f"key {kind}, lo double, hi double, i int")
        x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
        # halves first, so that the width of a range never overflows
        bin_ = F.least(F.floor((x / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS), F.lit(BINS - 1)).cast("int")
        met = rows.join(F.broadcast(want), "key").filter((x >= lo) & (x <= hi)).groupBy("i", bin_.alias("bin"))
        got: dict[int, list] = {}
        for r in met.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
            got.setdefault(r.i, []).append(r)
        place = {s: i for i, s in enumerate(shared)}
        for (k, rank), (lo_, hi_, r) in list(open_.items()):
            for b in sorted(got[place[k, lo_, hi_]], key=lambda b: b.bin):
                if r <= b.n:
                    open_[k, rank] = (b.lo, b.hi, r)
                    break
                r -= b.n
    return found


def quantile_cuts(df: DataFrame, key: str, value: str, q: float) -> dict[object, float]:
    """The q-quantile of each key's values, linear between its neighbours."""
    n = {r.key: r.n for r in df.groupBy(F.col(key).alias("key")).agg(F.count(value).alias("n")).collect() if r.n}
    at = {k: (v - 1) * q for k, v in n.items()}
    found = order_statistics(df, key, value, {k: sorted({int(p) + 1, -int(-p // 1) + 1}) for k, p in at.items()})
    out = {}
    for k, p in at.items():
        low, high = int(p), -int(-p // 1)
        a, b = found[k, low + 1], found[k, high + 1]
        out[k] = a if low == high or a == b else (high - p) * a + (p - low) * b
    return out


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, by: str) -> DataFrame:
    """The first ``n`` rows of each group: of each of PARTS parts, dealt by the hash of ``by``, then of those that are left."""
    part = F.pmod(F.xxhash64(by), F.lit(PARTS))
    one = df.withColumn("_k", F.row_number().over(W.partitionBy(*keys, part).orderBy(*order))).filter(F.col("_k") <= n)
    return one.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")
