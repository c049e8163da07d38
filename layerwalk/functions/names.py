"""Names of nodes: ``GENE*locus``, layer suffixes, shadows, basis nodes and time labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Canonical layer names.
LAYERS = ("k9me2", "k20me3", "k27me3", "rna_ai")
BASIS = tuple(f"e{i}" for i in range(1, 6))
SHADOW = "_neg"


def base_gene(node: Column) -> Column:
    """Without one layer suffix, the text before the first ``*``."""
    return F.substring_index(F.regexp_replace(node, f"_({'|'.join(LAYERS)})$", ""), "*", 1)


def gene_part(node: Column) -> Column:
    """The text before the first ``*``."""
    return F.substring_index(node, "*", 1)


def is_basis(node: Column) -> Column:
    return node.isin(*BASIS)


def node_type(node: Column) -> Column:
    """basis (e and one more character), RNA, a histone mark by its suffix, or other."""
    up = F.upper(node)
    return (
        F.when((F.length(node) == 2) & node.startswith("e"), "basis").when(up.contains("RNA"), "RNA")
        .when(up.rlike("_K[0-9]+ME[0-9]+$"), F.regexp_extract(up, "_(K[0-9]+ME[0-9]+)$", 1)).otherwise("other")
    )


def canonical_layer(name: Column, naming: str = "canonical") -> Column:
    """Layer of a file name: rna first (``canonical``), or case-sensitive marks first, without k27me3 (``endpoint``)."""
    if naming == "endpoint":
        return F.when(name.contains("k9me2"), "k9me2").when(name.contains("k20me3"), "k20me3").when(name.contains("rna"), "rna_ai").otherwise(name)
    if naming != "canonical":
        raise ValueError(f"unknown naming {naming!r}")
    low = F.lower(name)
    return F.when(low.contains("rna"), "rna_ai").when(low.contains("k9me2"), "k9me2").when(low.contains("k20me3"), "k20me3").when(low.contains("k27me3"), "k27me3").otherwise(name)


def is_integer_like(label: Column) -> Column:
    """Whether a label reads as a whole number; false where it does not parse."""
    return F.coalesce(F.try_mod(label.try_cast("double"), F.lit(1.0)) == 0, F.lit(False))


def time_of_label(label: Column) -> Column:
    """The number a column label stands for: itself, or the last number in it; null where there is none."""
    return F.coalesce(label.try_cast("double"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(label, F.lit(r"(-?\d+(?:\.\d+)?)"), 1)), -1).try_cast("double"))


def prettify(stem: Column) -> Column:
    """Words of a file stem: up to three letters in upper case, others capitalised; none gives a fixed title."""
    words = F.filter(F.split(stem, r"[_\-\s]+"), lambda w: w != "")
    cap = F.transform(words, lambda w: F.when(F.length(w) <= 3, F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))))
    return F.when(F.size(words) == 0, F.lit("Untitled Plot")).otherwise(F.array_join(cap, " "))


def safe_file_part(text: Column) -> Column:
    """Only letters, digits, dot, dash and underscore; runs of others become one underscore."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")
