"""The manifest of a plot site, and the search over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import prettify


def site_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of every .html file below a folder, relative to it."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(folder).select("path")
    at = F.instr("path", folder.rstrip("/").split("://")[-1]) + len(folder.rstrip("/").split("://")[-1]) + 1
    return f.select(F.substring("path", at, F.length("path")).alias("path"))


def manifest(paths: DataFrame) -> DataFrame:
    """(title, path, group, filename) of relative paths: title of the stem, group of the folders joined by `` / ``."""
    p = F.col("path")
    name = F.substring_index(p, "/", -1)
    folder = F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise("")
    return paths.select(prettify(F.regexp_replace(name, r"\.[^.]*$", "")).alias("title"), "path", F.replace(folder, F.lit("/"), F.lit(" / ")).alias("group"), name.alias("filename"))


def manifest_json(entries: DataFrame, generated_at: str) -> DataFrame:
    """(manifest): one JSON document with all entries by path."""
    plots = F.sort_array(F.collect_list(F.struct("path", "title", "group", "filename")))
    plots = F.transform(plots, lambda x: F.struct(x["title"].alias("title"), x["path"].alias("path"), x["group"].alias("group"), x["filename"].alias("filename")))
    return entries.agg(F.to_json(F.struct(F.lit(generated_at).alias("generated_at"), F.count(F.lit(1)).alias("total_plots"), plots.alias("plots"))).alias("manifest"))


def search(entries: DataFrame, text: str = "", group: str | None = None, by: str = "title", descending: bool = False) -> DataFrame:
    """Entries of a group whose title, path or group hold ``text`` ignoring case, sorted by title or path."""
    if by not in ("title", "path"):
        raise ValueError("by must be 'title' or 'path'")
    e = entries.filter(F.col("group") == group) if group is not None else entries
    e = e.filter(F.lower(F.concat_ws(" ", "title", "path", "group")).contains(text.strip().lower()))
    key = F.lower(by)
    return e.orderBy(key.desc() if descending else key.asc(), "path")


def group_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
