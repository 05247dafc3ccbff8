"""Prefix scans over long sequences without one task per sequence.

A plain window over (entity) puts all rows of a hot entity into one task. These helpers cut each
sequence into blocks of the order column's range: first windows run inside (entity, block), second
ones over one row per block, and the two are put together. Rows must be unique per (entity, order), so a
block of width ``block`` holds at most ``block`` rows of an entity when the order column is an integer.

Block rows are taken from the output of the first windows, and the join back is on the columns those windows are
partitioned by: the rows themselves are shuffled once. Every window is linear in its rows; what looks ahead runs over
the falling order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = "__block"
KEY = "__key"
#: An entity with more rows than this is cut into blocks by ``block_of_hot``.
HOT_ROWS = 1 << 20
HOT_LISTED = 10_000


def with_block(df: DataFrame, order: str, block: int) -> DataFrame:
    """``df`` with its block of the order column; one that is there stays, and with it the partitioning."""
    return df if BLOCK in df.columns else df.withColumn(BLOCK, F.floor(F.col(order) / F.lit(block)).cast("long"))


def up_to(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def two_level(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    block: int,
    local: Callable[[WindowSpec, WindowSpec], Mapping[str, Column]],
    summary: Mapping[str, Column],
    carry: Callable[[WindowSpec, WindowSpec], Mapping[str, Column]],
    null_keys: bool = True,
    keep_block: bool = False,
) -> DataFrame:
    """``df`` with the columns of ``local`` (over rising and falling order in a block) and of ``carry`` (over the blocks of
    an entity, rising and falling, from the aggregates ``summary`` of each block).

    With ``null_keys`` keys are compared as one struct, in which null equals null; without, rows with null keys get null
    carries. With ``keep_block`` the column of blocks stays, so that a further scan needs no shuffle.
    """
    b = with_block(df, order, block)
    packed = null_keys and len(keys) > 0
    ks = [KEY] if packed else list(keys)
    if packed:
        b = b.select(F.struct(*keys).alias(KEY), *[c for c in b.columns if c not in keys])
    inside = Window.partitionBy(*ks, BLOCK)
    b = b.withColumns(dict(local(inside.orderBy(order), inside.orderBy(F.desc(order)))))
    per = b.groupBy(*ks, BLOCK).agg(*[c.alias(n) for n, c in summary.items()])
    w = Window.partitionBy(*ks)
    per = per.select(*ks, BLOCK, *[c.alias(n) for n, c in carry(w.orderBy(BLOCK), w.orderBy(F.desc(BLOCK))).items()])
    j = b.join(per, [*ks, BLOCK], "left")
    j = j if keep_block else j.drop(BLOCK)
    return j.select(*[F.col(f"{KEY}.{k}").alias(k) for k in keys], *[c for c in j.columns if c != KEY]) if packed else j


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, block: int, null_keys: bool = True) -> DataFrame:
    """``out`` = sum of ``value`` over rows of the same keys up to and including this one; nulls count as 0."""
    j = two_level(
        df, keys, order, block, lambda up, down: {out: F.coalesce(F.sum(value).over(up_to(up)), F.lit(0))}, {"__s": F.max_by(out, order)}, lambda up, down: {"__before": F.coalesce(F.sum("__s").over(before(up)), F.lit(0))}, null_keys
    )
    return j.withColumn(out, F.col(out) + F.col("__before")).drop("__before")


def running_count(df: DataFrame, keys: Sequence[str], order: str, out: str, block: int, null_keys: bool = True) -> DataFrame:
    """``out`` = 1-based row number inside keys by ``order``."""
    j = two_level(df, keys, order, block, lambda up, down: {out: F.row_number().over(up).cast("long")}, {"__s": F.max(out)}, lambda up, down: {"__before": F.coalesce(F.sum("__s").over(before(up)), F.lit(0))}, null_keys)
    return j.withColumn(out, F.col(out) + F.col("__before")).drop("__before")


def running_max_before(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, block: int, null_keys: bool = True, keep_block: bool = False) -> DataFrame:
    """``out`` = max of ``value`` over earlier rows of the same keys (null for none)."""
    j = two_level(df, keys, order, block, lambda up, down: {out: F.max(value).over(before(up))}, {"__m": F.max(value)}, lambda up, down: {"__before": F.max("__m").over(before(up))}, null_keys, keep_block)
    return j.withColumn(out, F.greatest(out, "__before")).drop("__before")


def nearest(df: DataFrame, keys: Sequence[str], order: str, value: str, prev: str, next_: str, block: int, null_keys: bool = True) -> DataFrame:
    """``prev`` and ``next_``: the nearest non-null ``value`` at earlier and at later rows of the same keys."""
    seen = F.when(F.col(value).isNotNull(), F.col(order))
    last = lambda c, w: F.last(c, ignorenulls=True).over(before(w))
    j = two_level(
        df, keys, order, block,
        lambda up, down: {prev: last(value, up), next_: last(value, down)},
        {"__last": F.max_by(value, seen), "__first": F.min_by(value, seen)},
        lambda up, down: {"__p": last("__last", up), "__n": last("__first", down)},
        null_keys,
    )
    return j.withColumn(prev, F.coalesce(prev, "__p")).withColumn(next_, F.coalesce(next_, "__n")).drop("__p", "__n")


def block_of_hot(df: DataFrame, keys: Sequence[str], rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with ``__hot``: whether the entity has more than ``rows`` rows, so that only such entities are cut.

    Entities are counted with a map-side combine. Up to 10,000 hot ones come to the driver and are broadcast back; more
    are joined.
    """
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows).drop("__n")
    found = n.limit(HOT_LISTED + 1).collect()
    if not found:
        return df.withColumn("__hot", F.lit(False))
    few = len(found) <= HOT_LISTED
    hot = df.sparkSession.createDataFrame(found, n.schema) if few else n
    hot = hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.lit(True).alias("__h"))
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(hot[f"__h_{k}"])
        cond = c if cond is None else cond & c
    j = df.join(F.broadcast(hot) if few else hot, cond, "left")  # at most HOT_LISTED rows, checked
    return j.withColumn("__hot", F.coalesce("__h", F.lit(False))).drop("__h", *[f"__h_{k}" for k in keys])
