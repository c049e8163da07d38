"""Operator 13: URL filters by rules and gradient-boosted trees on lexical features. DataFrame functions only.

A rule (host, path, verdict) fits its host and all subdomains if the path of the url starts with the rule's; of the rules that
fit, the one with the longest host and path counts. Urls that a rule decides are the labelled urls: they train boosted trees, which
judge the others.

Features of a url are whole numbers below BINS on fixed grids: lengths of the url, host, path and query (in logarithms), depth,
labels, shares of digits, entropy of its characters, parameters, signs, fragment and scheme, and four suffix statistics:
how often labelled urls with the same last label, last two labels, file suffix or first directory are blocked. These are counted
in BUCKETS hashed buckets a kind, so the table that scoring broadcasts has at most BUCKETS rows whatever the input. A half of
the labelled urls, by hash, counts them, and the trees grow on the other half, so no url informs its own statistic.

Trees are symmetric: all nodes of a level share one split, and a leaf is a number of as many bits as levels. Urls with the
same features are one row with counts, so training costs what there are of different feature rows, and still counts every
labelled url. Each level is one aggregate of gradients and curvatures by node, feature and bin, from which the driver picks the
split (at most 2^DEPTH x features x BINS sums). Gradients are summed as whole numbers, so the trees do not depend on partitions.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stage, materialize, table

#: Rules: host, start of the path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Values of a feature, buckets of a suffix statistic, trees, levels of a tree.
BINS, BUCKETS, TREES, DEPTH = 64, 4096, 16, 3
#: Step of a tree, weight of an even prior in statistics and leaves, fraction bits of a summed gradient.
RATE, PRIOR, FRACTION = 0.3, 1.0, 20
KINDS = ("label", "site", "file", "directory")
FEATURES = ("length", "host_length", "path_length", "query_length", "depth", "labels", "digits", "host_digits", "entropy", "params", "signs", "fragment", "secure", *(f"{k}_rate" for k in KINDS))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Model:
    """Log odds of all labelled urls, trees (splits as (feature, bin), leaves), and block rates as bins by kind and bucket."""

    prior: float
    trees: list[tuple[list[tuple[int, int]], list[float]]]
    rates: DataFrame


def _binned(x: Column) -> Column:
    return F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(BINS - 1)).cast("int")


def _share(text: Column, pattern: str) -> Column:
    """Share of the characters of a text that are left when those of ``pattern`` go."""
    return F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def split_url(df: DataFrame, url: str) -> DataFrame:
    """``df`` with host (A-Z lower-cased), path and query of ``url``; all are empty where it is null or has no ``://``."""
    at = F.instr(F.col(url), "://")
    df = df.withColumn("rest", F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(""))
    df = df.withColumn("host", F.regexp_extract("rest", "^[^/?#]*", 0))
    df = df.withColumn("tail", F.substring(F.col("rest"), F.length("host") + 1, F.length("rest")))
    df = df.withColumn("path", F.regexp_extract("tail", "^[^?#]*", 0)).withColumn("query", F.regexp_extract("tail", r"^[^?#]*\?([^#]*)", 1))
    return df.withColumn("host", F.translate("host", _UPPER, _LOWER)).drop("rest", "tail")


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that decides (host and path as one string) and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]), len(r[1]), r)):  # the longest comes last and is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _features(df: DataFrame) -> DataFrame:
    """Plain features as columns f0, f1, ... and the buckets of the four suffixes as s0 ... s3, beside url, host, path and query."""
    url, host, path, query = (F.col(c) for c in ("url", "host", "path", "query"))
    size = lambda x: _binned(6 * F.log2(F.length(x) + 1))
    parts = lambda x, sign: F.size(F.filter(F.split(x, sign), lambda p: p != ""))
    n = F.length(url)
    often = F.transform(F.array_distinct(F.split(url, "")), lambda c: (n - F.length(F.replace(url, c, F.lit("")))).cast("double"))
    bits = F.aggregate(often, F.lit(0.0), lambda acc, c: acc + F.when(c > 0, c * F.log2(c)).otherwise(0.0))
    plain = [
        size(url), size(host), size(path), size(query), _binned(parts(path, "/")), _binned(parts(host, r"\.")), _binned(63 * _share(url, "[^0-9]")), _binned(63 * _share(host, "[^0-9]")),
        F.when(n > 0, _binned(8 * (F.log2(n.cast("double")) - bits / n))).otherwise(F.lit(0)), _binned(parts(query, "[&;]")), _binned(F.length(F.regexp_replace(url, r"[^_~%@=.\-]", ""))),
        F.contains(url, F.lit("#")).cast("int"), url.startswith("https:").cast("int"),
    ]
    last = F.substring_index(path, "/", -1)
    suffixes = (
        F.substring_index(host, ".", -1), F.substring_index(host, ".", -2),
        F.when(F.contains(last, F.lit(".")), F.substring_index(last, ".", -1)).otherwise(F.when(last == "", "/").otherwise("")), F.regexp_extract(path, "^/([^/]*)", 1),
    )
    for i, x in enumerate(plain):
        df = df.withColumn(f"f{i}", x)
    for i, x in enumerate(suffixes):
        df = df.withColumn(f"s{i}", F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))
    return df


def _with_rates(df: DataFrame, rates: DataFrame) -> DataFrame:
    """The four statistics as further features."""
    first = len(FEATURES) - len(KINDS)
    for i in range(len(KINDS)):
        df = df.join(F.broadcast(rates.select(F.col("bucket").alias(f"s{i}"), F.col(f"r{i}").alias(f"f{first + i}"))), f"s{i}", "left")
    return df


def suffix_rates(labelled: DataFrame) -> DataFrame:
    """(bucket, r0 ... r3): block rate of each bucket of each kind as a bin, from rows with s0 ... s3 and block.

    Rates are smoothed towards that of all rows, which empty buckets have.
    """
    of = labelled.agg((F.coalesce(F.sum("block"), F.lit(0)) + PRIOR).alias("b"), (F.count(F.lit(1)) + 2 * PRIOR).alias("n")).first()
    even = of.b / of.n
    each = labelled.select("block", F.posexplode(F.array(*(f"s{i}" for i in range(len(KINDS))))).alias("kind", "bucket"))
    n = each.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("b"))
    n = n.withColumn("r", _binned((BINS - 1) * (F.col("b") + PRIOR * even) / (F.col("n") + PRIOR)))
    n = n.groupBy("bucket").agg(*(F.max(F.when(F.col("kind") == i, F.col("r"))).alias(f"r{i}") for i in range(len(KINDS))))
    rate = lambda i: F.coalesce(f"r{i}", F.lit(int((BINS - 1) * even))).alias(f"r{i}")
    return labelled.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(n, "bucket", "left").select("bucket", *map(rate, range(len(KINDS))))


def leaf_of(splits: list[tuple[int, int]]) -> Column:
    """The number of the leaf: one bit a level, set where the feature is above the split."""
    return reduce(lambda a, s: a * 2 + (F.col(f"f{s[0]}") > s[1]).cast("int"), splits, F.lit(0))


def margin(prior: float, trees: list) -> Column:
    """Log odds of block."""
    return reduce(lambda a, t: a + F.element_at(F.array(*map(F.lit, t[1])), leaf_of(t[0]) + 1), trees, F.lit(prior))


def best_split(sums: dict[tuple[int, int, int], tuple[float, float]], nodes: int) -> tuple[float, tuple[int, int] | None, list[tuple[float, float]]]:
    """(score, (feature, bin), sums of the children) of the split of a whole level with the largest sum of G^2 / (H + PRIOR).

    sums: (gradient, curvature) by (node, feature, bin). Of equal splits the first feature and bin counts; a split that leaves a side
    empty in every node is none.
    """
    by: dict[int, dict[int, dict[int, tuple[float, float]]]] = defaultdict(lambda: defaultdict(dict))
    for (node, feature, bin_), gh in sums.items():
        by[feature][node][bin_] = gh
    worth = lambda g, h: g * g / (h + PRIOR)
    best: tuple = (0.0, None, [])
    for feature in sorted(by):
        whole = {k: (sum(g for g, _ in v.values()), sum(h for _, h in v.values())) for k, v in by[feature].items()}
        left = dict.fromkeys(range(nodes), (0.0, 0.0))
        values = sorted({b for v in by[feature].values() for b in v})
        for t in values[:-1]:
            for k, v in by[feature].items():
                if t in v:
                    left[k] = (left[k][0] + v[t][0], left[k][1] + v[t][1])
            kids = []
            for k in range(nodes):
                g, h = whole.get(k, (0.0, 0.0))
                kids += [left[k], (g - left[k][0], h - left[k][1])]
            score = sum(worth(g, h) for g, h in kids)
            if best[1] is None or score > best[0] * (1 + 1e-12):
                best = (score, (feature, t), kids)
    return best


def boost(rows: DataFrame, prior: float, trees: int) -> list:
    """Trees from (f0 ..., n, b): counts of all and of blocked labelled urls of each feature row. Rows of one label alone give none."""
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    grown: list = []
    unit = float(1 << FRACTION)
    if 0 < total.b < total.n:
        feature = F.posexplode(F.array(*(f"f{i}" for i in range(len(FEATURES))))).alias("feature", "bin")
        for _ in range(trees):
            splits: list[tuple[int, int]] = []
            kids: list[tuple[float, float]] = []
            p = 1 / (1 + F.exp(-margin(prior, grown)))
            for level in range(DEPTH):
                now = rows.withColumn("p", p).withColumn("node", leaf_of(splits)).withColumn("g", F.round((F.col("b") - F.col("n") * F.col("p")) * unit).cast("long"))
                now = now.withColumn("h", F.round(F.col("n") * F.col("p") * (1 - F.col("p")) * unit).cast("long")).select("node", "g", "h", feature)
                found = now.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
                _, split, kids_now = best_split({(r.node, r.feature, r.bin): (r.g / unit, r.h / unit) for r in found}, 1 << level)
                if split is None:
                    break
                splits.append(split)
                kids = kids_now
            if not splits:
                break
            grown.append((splits, [RATE * g / (h + PRIOR) for g, h in kids]))
    return grown


def train(labelled: DataFrame, trees: int = TREES) -> Model:
    """Model of (url, block int); rows with a null label are ignored. Without rows of both labels it has no trees.

    Repeated urls count as often as they are there. No rows give even odds, which allow.
    """
    whole = labelled.filter("block is not null").select(F.coalesce("url", F.lit("")).alias("url"), F.col("block").cast("long").alias("block"))
    half = F.pmod(F.xxhash64("url"), F.lit(2))
    one = _features(split_url(whole, "url")).withColumn("half", half)
    rates = materialize(suffix_rates(one.filter("half = 0")).coalesce(1), "url-rates")  # BUCKETS rows
    names = [f"f{i}" for i in range(len(FEATURES))]
    rows = _with_rates(one.filter("half = 1"), rates).groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("b"))
    rows = materialize(rows, "url-features")
    n, b = whole.agg(F.count("block"), F.coalesce(F.sum("block"), F.lit(0))).first()
    prior = log((b + PRIOR) / (n - b + PRIOR))
    grown = boost(rows, prior, trees)
    drop_stage(rows)
    return Model(prior, grown, rates)


def rule_labels(pages: DataFrame, rules=RULES) -> DataFrame:
    """(url, block): what the rules say of the urls that they decide."""
    one = split_url(pages.select(F.coalesce("url", F.lit("")).alias("url")), "url")
    verdict = rule_for(F.col("host"), F.col("path"), rules)[1]
    return one.select("url", (verdict == "block").cast("int").alias("block")).filter("block is not null")


def judge(pages: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict and margin (log odds of block by the trees), for every row.

    The verdict is the rule's; where none fits it is block if the margin is above 0. Null and empty urls, and those without ``://``, have
    an empty host and path, fit no rule and are judged by the trees. Columns of these names are replaced, others pass through;
    repeated rows are judged each; no rows give no rows.
    """
    df = pages.select(F.struct(*pages.columns).alias("row"), F.coalesce("url", F.lit("")).alias("url"))
    df = _with_rates(_features(split_url(df, "url")), model.rates)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    df = df.select("row", "host", "path", rule.alias("rule"), verdict.alias("verdict"), margin(model.prior, model.trees).alias("margin"))
    own = ("host", "path", "rule", "verdict", "margin")
    verdict = F.coalesce("verdict", F.when(F.col("margin") > 0, "block").otherwise("allow"))
    return df.select(*(F.col("row")[c].alias(c) for c in pages.columns if c not in own), "host", "path", "rule", verdict.alias("verdict"), "margin")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, train(rule_labels(pages))).select("page_id", "host", "path", "rule", "verdict", "margin")


QUERIES = {"op13_url_filter": op13_url_filter}
