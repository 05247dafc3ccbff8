"""Percentiles with bounded relative error from counts in signed logarithmic buckets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Added to the index of a magnitude, so that sign and index are one number that rises with the value.
MIDDLE = 1 << 28
LARGEST = 1.7976931348623157e308


def gamma(alpha: float) -> float:
    return (1 + alpha) / (1 - alpha)


def log_sketch(df: DataFrame, group: Sequence[str], values: Sequence[str], alpha: float = 0.01) -> DataFrame:
    """(group, measure, sgn, idx, n): counts of every value column in buckets (gamma^(idx-1), gamma^idx] by sign.

    gamma = (1 + alpha) / (1 - alpha), so a bucket's midpoint differs from any value in it by at most ``alpha`` times
    that value. Only 0 counts as zero (sgn 0, idx 0), however small a magnitude is. Null, NaN and infinite values are left
    out. Null groups are groups of their own. Buckets are bounded in number by the range of doubles, not by the rows; counts
    combine before the shuffle, in which measure and bucket are one number. Sketches of the same alpha over any split of the
    rows merge with ``merge_sketches``.
    """
    if not 1e-6 <= alpha < 1:
        raise ValueError("alpha must be from 1e-6 to below 1")
    pairs = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("m"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values)]))
    long = df.select(*group, pairs.alias("__p")).select(*group, F.col("__p.m").alias("__m"), F.col("__p.v").alias("__v"))
    long = long.where(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") < float("inf")))
    size = F.abs("__v")
    at = F.ceil(F.ln(F.when(size > 0, size).otherwise(1.0)) / F.lit(math.log(gamma(alpha)))).cast("long") + MIDDLE
    bucket = F.when(size == 0, 0).when(F.col("__v") > 0, at).otherwise(-at)
    code = F.shiftleft("__m", 32) + bucket + F.lit(1 << 31).cast("long")
    counts = long.groupBy(*group, code.alias("__code")).agg(F.count(F.lit(1)).alias("n"))
    own = F.col("__code").bitwiseAND(F.lit((1 << 32) - 1).cast("long")) - F.lit(1 << 31).cast("long")
    measure = F.element_at(F.array(*[F.lit(v) for v in values]), (F.shiftright("__code", 32) + 1).cast("int"))
    return counts.select(*group, measure.alias("measure"), F.signum(own).cast("int").alias("sgn"), F.when(own == 0, 0).otherwise(F.abs(own) - MIDDLE).cast("int").alias("idx"), "n")


def merge_sketches(sketch: DataFrame, group: Sequence[str]) -> DataFrame:
    """Add the counts of equal buckets: any finer sketch, or a union of sketches, to one per ``group``."""
    return sketch.groupBy(*group, "measure", "sgn", "idx").agg(F.sum("n").alias("n"))


def percentiles(sketch: DataFrame, group: Sequence[str], qs: Sequence[float], alpha: float = 0.01) -> DataFrame:
    """(group, measure, q, value, n): for each q the value at rank floor(q · (n − 1)), within ``alpha`` of it, relatively."""
    g = gamma(alpha)
    s = merge_sketches(sketch, group)
    w = Window.partitionBy(*group, "measure")
    key = F.col("sgn") * (F.col("idx") + F.lit(MIDDLE))
    s = s.withColumn("__cum", F.sum("n").over(w.orderBy(key).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("n").over(w))
    rank = lambda q: F.floor(q * (F.col("__all") - 1))
    hit = F.filter(F.array(*[F.lit(float(q)) for q in qs]), lambda q: (rank(q) < F.col("__cum")) & (rank(q) >= F.col("__cum") - F.col("n")))
    # the lower edge times 1 + alpha, which can overflow only beyond the bucket's values
    value = F.col("sgn") * F.least(F.pow(F.lit(g), F.col("idx") - 1) * F.lit(1 + alpha), F.lit(LARGEST))
    return s.select(*group, "measure", F.explode(hit).alias("q"), value.alias("value"), F.col("__all").alias("n"))
