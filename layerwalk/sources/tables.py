"""Wide CSV matrices in, tables and bundles out."""

from __future__ import annotations

import io
import json
import zipfile
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import canonical_layer, is_integer_like

FILE = r"^overlap_filtered_(.+)_m_v2\.csv$"


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(layer, node, t, value) of one CSV file: its node column is named ``Unnamed: 0``, empty or holds ``gene``.

    Headers must be numbers (else ValueError); only whole-number times are kept. The layer is the file's stem.
    """
    wide = spark.read.option("header", True).csv(path)
    key = next((c for c in wide.columns if c == "Unnamed: 0" or "gene" in c.lower()), wide.columns[0])
    times = [c for c in wide.columns if c != key]
    for c in times:
        float(c)
    kept = [c for c in times if float(c) % 1 == 0]
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    long = wide.select(stem.alias("layer"), F.col(f"`{key}`").alias("node"), *[F.col(f"`{c}`").cast("double").alias(c) for c in kept])
    return long.unpivot(["layer", "node"], kept, "t", "value").withColumn("t", F.col("t").cast("double").cast("int"))


def read_layers(spark: SparkSession, folder: str, marks: str = "all", require_rna: bool = True, naming: str = "canonical") -> DataFrame:
    """All CSV files of a folder under canonical layer names; of files of one layer the last by name counts.

    ``marks`` keeps RNA and the layers whose name contains it. Missing RNA or marks raise ValueError.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = sorted(f.getPath().toString() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path) if f.getPath().getName().endswith(".csv"))
    if not files:
        raise ValueError(f"no CSV file in {folder}")
    every = read_matrix(spark, files[0]).withColumn("nth", F.lit(0))
    for i, f in enumerate(files[1:], 1):
        every = every.unionByName(read_matrix(spark, f).withColumn("nth", F.lit(i)))
    every = every.withColumn("layer", canonical_layer(F.col("layer"), naming))
    last = every.groupBy("layer").agg(F.max("nth").alias("nth"))
    every = every.join(F.broadcast(last), ["layer", "nth"], "left_semi").drop("nth")
    if marks != "all":
        every = every.filter((F.col("layer") == "rna_ai") | F.lower("layer").contains(marks.lower()))
    have = {r.layer for r in every.select("layer").distinct().collect()}
    if require_rna and "rna_ai" not in have:
        raise ValueError("no RNA layer")
    if marks != "all" and not any(marks.lower() in x.lower() for x in have):
        raise ValueError(f"no layer {marks}")
    return every


def source_labels(names: DataFrame) -> DataFrame:
    """(file_name, label) of files named overlap_filtered_<token>_m_v2.csv; colliding labels get the stem after them."""
    token = F.regexp_extract(F.lower("file_name"), FILE, 1)
    own = F.regexp_extract("file_name", "(?i)" + FILE, 1)
    s = names.filter(token != "").withColumn("label", F.when(token.contains("rna"), "RNA").otherwise(F.concat(F.upper(F.substring(own, 1, 1)), F.substring(own, F.lit(2), F.length(own)))))
    stem = F.regexp_replace("file_name", r"\.csv$", "")
    nth = F.row_number().over(W.partitionBy("label").orderBy("file_name"))
    return s.withColumn("nth", nth).select("file_name", F.when(F.col("nth") == 1, F.col("label")).otherwise(F.concat_ws("_", "label", stem)).alias("label"))


def combine_layers(m: DataFrame) -> DataFrame:
    """One layer ``combined`` whose nodes carry their former layer as suffix."""
    return m.select(F.lit("combined").alias("layer"), F.concat_ws("_", "node", "layer").alias("node"), "t", "value")


def keep_integer_times(labels: DataFrame) -> DataFrame:
    """Labels (column ``label``) that are whole numbers."""
    return labels.filter(is_integer_like(F.col("label")))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_safe(x: Any) -> Any:
    """Paths, numpy values, arrays, indexes, tuples and sets as JSON has them."""
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    if isinstance(x, list | tuple | set | frozenset):
        return [json_safe(v) for v in x]
    if hasattr(x, "tolist"):
        return json_safe(x.tolist())
    return x if isinstance(x, str | int | float | bool | type(None)) else str(x)


def bundle(parameters: dict, frames: dict[str, DataFrame], page: str | None = None, page_name: str = "plot.html") -> bytes:
    """A zip of parameters.json, an optional page and small result tables as CSV, made on the driver."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("parameters.json", json.dumps(json_safe(parameters), indent=2))
        if page is not None:
            z.writestr(page_name, page)
        for name, df in frames.items():
            z.writestr(name if name.endswith(".csv") else f"{name}.csv", df.toPandas().to_csv(index=False))
    return out.getvalue()
