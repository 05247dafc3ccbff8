"""Aggregates over a join without joining the rows: both inputs are reduced to one row per join key first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_group: Sequence[str] = (),
    right_group: Sequence[str] = (),
    left_sums: Mapping[str, str] | None = None,
    right_sums: Mapping[str, str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """State of ``left JOIN right ON on GROUP BY on + left_group + right_group``: n_rows and sums.

    Each input is pre-aggregated by join key and its own group columns (map-side combine first, so a key
    that holds a third of all rows reaches the shuffle as one row per task), the compact states are joined,
    counts are multiplied and sums are scaled by the other side's count. Roll the result up with ``rollup_states``.

    ``left_sums``/``right_sums`` map output names to columns. Null join keys match nothing; with
    ``how='left'`` unmatched left rows stay, once each. A sum over nulls only is null. Columns that are not
    named are never read, so extra columns of equal name in both inputs don't clash; a ``right_group`` name
    must not repeat a left one. Empty inputs give an empty result.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    left_sums, right_sums = dict(left_sums or {}), dict(right_sums or {})
    both = (set(left_group) | set(left_sums)) & (set(right_group) | set(right_sums))
    if both:
        raise ValueError(f"names used on both sides: {sorted(both)}")
    lkeys = list(dict.fromkeys([*on, *left_group]))
    rkeys = list(dict.fromkeys([*on, *right_group]))
    lstate = left.groupBy(*lkeys).agg(F.count(F.lit(1)).alias("__ln"), *[F.sum(c).alias(o) for o, c in left_sums.items()])
    if how == "inner":
        lstate = lstate.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on]))
    rstate = (
        right.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on]))
        .groupBy(*rkeys)
        .agg(F.count(F.lit(1)).alias("__rn"), *[F.sum(c).alias(o) for o, c in right_sums.items()])
    )
    joined = lstate.join(rstate, list(on), how)
    rn = F.coalesce(F.col("__rn"), F.lit(1)) if how == "left" else F.col("__rn")
    keep = list(dict.fromkeys([*on, *left_group, *right_group]))
    return joined.select(
        *keep,
        (F.col("__ln") * rn).alias("n_rows"),
        *[(F.col(o) * rn).alias(o) for o in left_sums],
        *[(F.col(o) * F.col("__ln")).alias(o) for o in right_sums],
    )


def rollup_states(state: DataFrame, fields: Mapping[str, str], sums: Sequence[str]) -> DataFrame:
    """One row per (key_field, key_value) for every field of ``fields`` (label -> column): n_rows and sums.

    The compact state is rolled up once for all fields. A null key keeps its row (key_value null).
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("key_field"), F.col(c).cast("string").alias("key_value")) for n, c in fields.items()]))
    return (
        state.withColumn("__k", pairs)
        .select("__k.key_field", "__k.key_value", "n_rows", *sums)
        .groupBy("key_field", "key_value")
        .agg(F.sum("n_rows").alias("n_rows"), *[F.sum(s).alias(s) for s in sums])
    )


def heavy_keys(rolled: DataFrame, share: float) -> DataFrame:
    """Rows of ``rollup_states`` whose key holds at least ``share`` of all rows; null is no key but its rows count."""
    total = rolled.groupBy("key_field").agg(F.sum("n_rows").alias("__total"))
    return rolled.join(total, "key_field").where(F.col("key_value").isNotNull() & (F.col("n_rows") >= F.lit(share) * F.col("__total"))).drop("__total")
