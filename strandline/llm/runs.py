"""Runs of repeated consecutive events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.plans.scan import BLOCK, before, with_block

WIDTH = 1 << 16
COMBINE = {"min": F.min, "max": F.max, "sum": F.sum}


def collapse_runs(events: DataFrame, entity: Sequence[str], order: str, state: str, extras: Mapping[str, tuple[str, str]] | None = None, block: int = WIDTH) -> DataFrame:
    """One row per run of equal consecutive states: (entity, state, start, end, n, extras).

    ``order`` is an integer that numbers the events of an entity, so it is the row number within the entity; a
    number that is absent, or whose event has no state (null), breaks a run. Subtracting the row number within
    (entity, state) gives a value that is constant exactly on a run. ``state`` must be canonical already.

    Row numbers are counted in blocks of ``block`` order values, so a hot entity is spread over many tasks. A run that reaches
    neither edge of its block is whole; of the others, at most two per block and state, each stands for its events
    in a second subtraction over the entity, which joins those that meet.

    Repeated events (same entity and order) count once, combined before the shuffle, with the largest state where they
    disagree. Rows with null order or a null entity column are left out. ``extras`` maps output names to a function
    ('min', 'max' or 'sum') and a column; repeated events count with their largest value of it. Other columns are
    never read, whatever their names. An empty input gives an empty result.
    """
    extras = dict(extras or {})
    ok = F.col(order).isNotNull() & F.col(state).isNotNull()
    for k in entity:
        ok = ok & F.col(k).isNotNull()
    carry = list(dict.fromkeys(c for _, c in extras.values()))
    e = with_block(events.where(ok).select(*entity, order, state, *[F.col(c).alias(f"__c_{c}") for c in carry]), order, block)
    e = e.groupBy(*entity, BLOCK, order).agg(F.max(state).alias(state), *[F.max(f"__c_{c}").alias(f"__c_{c}") for c in carry])
    rank = F.row_number().over(Window.partitionBy(*entity, BLOCK, state).orderBy(order))
    part = e.withColumn("__island", F.col(order) - rank).groupBy(*entity, BLOCK, state, "__island")
    part = part.agg(F.min(order).alias("__start"), F.max(order).alias("__end"), F.count(F.lit(1)).alias("__n"), *[COMBINE[f](f"__c_{c}").alias(f"__x_{n}") for n, (f, c) in extras.items()])
    edge = (F.col("__start") == F.col(BLOCK) * block) | (F.col("__end") == F.col(BLOCK) * block + (block - 1))
    part = part.withColumn("__inner", F.when(~edge, F.col(BLOCK)))
    seen = F.coalesce(F.sum("__n").over(before(Window.partitionBy(*entity, state, "__inner").orderBy("__start"))), F.lit(0))
    runs = part.withColumn("__run", F.col("__start") - seen).groupBy(*entity, state, "__inner", "__run")
    out = runs.agg(F.min("__start").alias("start"), F.max("__end").alias("end"), F.sum("__n").alias("n"), *[COMBINE[f](f"__x_{n}").alias(n) for n, (f, _) in extras.items()])
    return out.drop("__inner", "__run")
