"""Exact order statistics of any number of rows, from histograms."""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
#: Distinct values up to which one count per value decides.
MOST_VALUES = 65_536


def _present(df: DataFrame, value: str) -> DataFrame:
    return df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")


def _counted(x: DataFrame) -> list[tuple[float, int]] | None:
    """(value, rows) in rising order, or nothing where there are more than MOST_VALUES values."""
    rows = x.groupBy("v").agg(F.count(F.lit(1)).alias("n")).limit(MOST_VALUES + 1).collect()
    return sorted((r["v"], r["n"]) for r in rows) if len(rows) <= MOST_VALUES else None


def _pick(counts: list[tuple[float, int]], ranks: Sequence[int]) -> list[float]:
    upto = list(itertools.accumulate(n for _, n in counts))
    return [counts[bisect.bisect_right(upto, r)][0] for r in ranks]


def values_at(df: DataFrame, value: str, ranks: Sequence[int]) -> list[float]:
    """The values at 0-based ``ranks`` of the rising order of ``value``; null and NaN have no rank.

    Few distinct values are counted in one job. Else each round counts the rows of the intervals that hold the ranks in
    equal-width buckets and goes on in the bucket of each rank, until it holds one value. A round brings at most 4,096 counts
    per rank to the driver and leaves a 4,096th of the width, so that a few rounds reach any double.
    """
    x = _present(df, value)
    counts = _counted(x)
    return _pick(counts, ranks) if counts is not None else _narrowed(x, ranks)


def quantiles(df: DataFrame, value: str, qs: Sequence[float]) -> list[float | None]:
    """For each q the value at rank floor(q · (n − 1)): as a cut it divides the rows as the interpolated quantile does."""
    x = _present(df, value)
    counts = _counted(x)
    n = x.count() if counts is None else sum(k for _, k in counts)
    ranks = [math.floor(q * (n - 1) + 1e-9) for q in qs]
    if not n:
        return [None] * len(qs)
    return _pick(counts, ranks) if counts is not None else _narrowed(x, ranks)


def _narrowed(x: DataFrame, ranks: Sequence[int]) -> list[float]:
    first = x.agg(F.min("v"), F.max("v")).first()
    at = {r: (first[0], first[1], 0) for r in ranks}  # lowest and highest value, rows below
    while todo := sorted({v for v in at.values() if v[0] < v[1]}):
        part, bucket = F.lit(None).cast("int"), F.lit(None).cast("int")
        for k, (lo, hi, _) in enumerate(todo):
            inside = (F.col("v") >= lo) & (F.col("v") <= hi)
            part = F.when(inside, k).otherwise(part)
            bucket = F.when(inside, F.least(F.floor((F.col("v") - lo) / (hi - lo) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")).otherwise(bucket)
        rows = x.select("v", part.alias("part"), bucket.alias("bucket")).where("part is not null").groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        found: dict[int, list] = {}
        for r in sorted(rows):
            found.setdefault(r["part"], []).append(r)
        new = {}
        for rank, v in at.items():
            if v in todo:
                below = v[2]
                for r in found[todo.index(v)]:
                    if rank < below + r["n"]:
                        new[rank] = (r["lo"], r["hi"], below)
                        break
                    below += r["n"]
        at |= new
    return [at[r][0] for r in ranks]
