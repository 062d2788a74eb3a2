"""Similarities of units: over counted terms in long form (one shuffle by term, norms before pairing), over node-type
histograms, and the scores composed of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY, LIGHT = (1, 2, 3, 4, 9, 60, 61, 62, 63, 64), (50, 65)
DOUBLE, HALF_MORE = (5, 10, 43, 44, 45, 76, 77), (75, 78, 79)
MACRO_TYPES = (50, 99)
STRUCTURAL = (60, 61, 62, 63, 64)


def node_weight(node_type: Column) -> Column:
    return F.when(node_type.isin(*HEAVY), 5.0).when(node_type.isin(*DOUBLE), 2.0).when(node_type.isin(*HALF_MORE), 1.5).when(node_type.isin(*LIGHT), 0.5).otherwise(1.0)


def sizes(counts: DataFrame, key: str = "unit", weight: Column | None = None) -> DataFrame:
    """Of each unit: its terms, their total, and the sum of squares (weighted)."""
    w = F.lit(1.0) if weight is None else weight
    return counts.groupBy(key).agg(F.count("*").alias("terms"), F.sum("n").alias("total"), F.sum(w * w * F.col("n") * F.col("n")).alias("square"))


def paired(pairs: DataFrame, counts: DataFrame, key: str = "unit", weight: Column | None = None) -> DataFrame:
    """pairs (a, b) with cosine, jaccard (of sets) and multiset jaccard of their counted terms.

    Two empty units have jaccards of 1 and a cosine of 0, one empty unit zeros. Dot products come from an equi-join on
    term; units without a common term never meet."""
    w = F.lit(1.0) if weight is None else weight
    size = sizes(counts, key, weight)
    left = counts.select(F.col(key).alias("a"), "term", F.col("n").alias("na"), (w * w).alias("ww"))
    right = counts.select(F.col(key).alias("b"), "term", F.col("n").alias("nb"))
    met = pairs.select("a", "b").join(left, "a").join(right, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("ww") * F.col("na") * F.col("nb")).alias("dot"), F.count("*").alias("common"), F.sum(F.least("na", "nb")).alias("overlap"))
    all_ = (
        pairs.join(met, ["a", "b"], "left")
        .join(size.select(F.col(key).alias("a"), F.col("terms").alias("ta"), F.col("total").alias("sa"), F.col("square").alias("qa")), "a", "left")
        .join(size.select(F.col(key).alias("b"), F.col("terms").alias("tb"), F.col("total").alias("sb"), F.col("square").alias("qb")), "b", "left")
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    norm = F.sqrt(z("qa")) * F.sqrt(z("qb"))
    return all_.select(
        *pairs.columns,
        F.when((z("qa") < 1e-8) | (z("qb") < 1e-8), 0.0).otherwise(z("dot") / norm).alias("cosine"),
        F.when((z("ta") == 0) & (z("tb") == 0), 1.0).otherwise(z("common").cast("double") / (z("ta") + z("tb") - z("common"))).alias("jaccard"),
        F.when((z("sa") == 0) & (z("sb") == 0), 1.0).otherwise(z("overlap").cast("double") / (z("sa") + z("sb") - z("overlap"))).alias("multiset_jaccard"),
    )


def structure(size_a: Column, size_b: Column, depth_a: Column, depth_b: Column) -> Column:
    """Half the agreement in size and half that in depth."""

    def agree(x: Column, y: Column) -> Column:
        most = F.greatest(x, y)
        return F.when(most > 0, 1.0 - F.abs(x - y) / most).otherwise(1.0)

    return 0.5 * agree(size_a, size_b) + 0.5 * agree(depth_a, depth_b)


def shape(hist: Column, struct: Column, jac: Column) -> Column:
    return 0.5 * hist + 0.3 * struct + 0.2 * jac


def with_content(id_cos: Column, id_jac: Column, hist: Column, jac: Column, struct: Column, no_ids: Column, marker: Column) -> Column:
    """Identifiers first, lifted where the shapes agree; modules of bare declarations go by their names."""
    base = 0.5 * id_cos + 0.15 * id_jac + 0.15 * hist + 0.1 * jac + 0.1 * struct
    lifts = (
        ((hist >= 0.9) & (struct >= 0.8) & (jac >= 0.6), 0.7 * hist + 0.2 * struct + 0.1 * jac),
        ((id_cos >= 0.8) & (hist >= 0.85) & (struct >= 0.75) & (jac >= 0.5), hist),
        ((id_jac >= 0.35) & (hist >= 0.85) & (struct >= 0.6) & (jac >= 0.45), 0.6 * hist + 0.25 * struct + 0.15 * jac),
    )
    lifted = F.greatest(base, *(F.when(when, score).otherwise(0.0) for when, score in lifts))
    names = 0.7 * id_cos + 0.3 * id_jac
    named = F.when(names >= 0.7, 0.85 + 0.5 * (names - 0.7)).otherwise(names)
    return F.when(no_ids, shape(hist, struct, jac)).when(marker, F.greatest(lifted, named)).otherwise(lifted)


def body_score(id_cos: Column, hist: Column, no_ids: Column) -> Column:
    return F.when(no_ids, hist).otherwise(0.7 * id_cos + 0.3 * hist)


def transliteration(cosine: Column, jaccard: Column, kgram: Column) -> Column:
    return 0.55 * cosine + 0.25 * jaccard + 0.2 * kgram


def report(cosine: Column, struct: Column, jac: Column, edit: Column) -> Column:
    return 0.3 * cosine + 0.2 * struct + 0.2 * jac + 0.3 * edit


def capped(part: Column, whole: Column) -> Column:
    """part / whole, 1 at most; 1 without a whole."""
    return F.when(whole > 0, F.least(F.lit(1.0), part.cast("double") / whole)).otherwise(1.0)


def balance(a: Column, b: Column) -> Column:
    """The smaller as a share of the larger; 1 for two zeros."""
    return F.when(F.greatest(a, b) > 0, F.least(a, b).cast("double") / F.greatest(a, b)).otherwise(1.0)


def doc_weighted(cosine: Column, src_lines: Column, tgt_lines: Column) -> Column:
    return 0.5 * cosine + 0.5 * capped(tgt_lines, src_lines)


def doc_gap(src_lines: Column, tgt_lines: Column) -> Column:
    return F.when(src_lines <= 0, 0.0).when(tgt_lines <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - tgt_lines.cast("double") / src_lines))
