"""Continuous periods and gaps of overlapping intervals by a sweep over their boundaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.plans.scan import BLOCK, HOT_ROWS, before, block_of_hot, up_to

WIDTH = 1 << 20


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, block: int = WIDTH, hot: int = HOT_ROWS) -> DataFrame:
    """Rows (keys, kind 'period' | 'gap', start, end) of each entity's merged intervals.

    Every interval gives a plus event at its smaller end and a minus event at its larger one; events are
    summed per position, prefix-summed to the number of active intervals, and a period runs from where it
    leaves zero to where it returns. Intervals that touch merge, as their events meet at one position;
    an interval of length zero is a period of its own when nothing else covers it. A gap lies between two
    periods. Repeated intervals, nested ones and ends in the wrong order change nothing.

    Rows with a null key or with both ends null are left out; one null end counts as the other end. Positions are
    integers. An empty input gives an empty result; other columns are ignored.

    An entity of more than ``hot`` intervals is cut into blocks of ``block`` positions. In a block the count is known but for
    the number of intervals that reach into it, which is never negative, so it is zero only where the block's own
    count is lowest, and in all those places or in none. Blocks therefore keep just these borders, pair them inside,
    and exchange one row each: its sum, its lowest count and its first border.
    """
    lo = F.coalesce(F.least(start, end), F.col(start), F.col(end)).cast("long")
    hi = F.coalesce(F.greatest(start, end), F.col(start), F.col(end)).cast("long")
    ok = lo.isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    calls = block_of_hot(df.where(ok).select(*keys, lo.alias("__lo"), hi.alias("__hi")), keys, hot)
    ends = F.array(*[F.struct(F.col(c).alias("at"), F.lit(p).cast("long").alias("plus"), F.lit(1 - p).cast("long").alias("minus")) for c, p in (("__lo", 1), ("__hi", 0))])
    part = F.when(F.col("__hot"), F.floor(F.col("__e.at") / F.lit(block)).cast("long")).otherwise(F.lit(0).cast("long"))
    events = calls.select(*keys, "__hot", F.explode(ends).alias("__e")).groupBy(*keys, part.alias(BLOCK), F.col("__e.at").alias("__at")).agg(F.sum("__e.plus").alias("__plus"), F.sum("__e.minus").alias("__minus"))
    net = F.col("__plus") - F.col("__minus")
    own = Window.partitionBy(*keys, BLOCK)
    e = events.withColumn("__after", F.sum(net).over(up_to(own.orderBy("__at"))))
    e = e.withColumns({"__low": F.least(F.min("__after").over(own), F.lit(0)), "__sum": F.sum(net).over(own)})
    opens, closes = F.col("__after") - net == F.col("__low"), F.col("__after") == F.col("__low")
    borders = e.where(opens | closes).select(
        *keys, BLOCK, "__at", (opens & (F.col("__plus") > 0)).alias("__opens"), (closes & (F.col("__minus") > 0)).alias("__closes"), "__low", "__sum",
        F.lead("__at").over(own.orderBy("__at")).alias("__next"), F.row_number().over(own.orderBy("__at")).alias("__rn"),
    )
    w = Window.partitionBy(*keys)
    blocks = borders.where("__rn = 1").select(*keys, BLOCK, "__at", (F.coalesce(F.sum("__sum").over(before(w.orderBy(BLOCK))), F.lit(0)) + F.col("__low") == 0).alias("__live"))
    after = F.last(F.when(F.col("__live"), F.col("__at")), ignorenulls=True).over(before(w.orderBy(F.desc(BLOCK))))
    blocks = blocks.select(*keys, BLOCK, "__live", after.alias("__first_after")).where("__live").drop("__live")
    paired = borders.join(blocks, [*keys, BLOCK]).withColumn("__next", F.coalesce("__next", "__first_after"))
    # a border that opens and closes is a point; otherwise an opening border's next one closes it
    point = F.col("__opens") & F.col("__closes")
    rows = F.array(
        F.when(F.col("__opens"), F.struct(F.lit("period").alias("kind"), F.col("__at").alias("a"), F.when(point, F.col("__at")).otherwise(F.col("__next")).alias("b"))),
        F.when(F.col("__closes") & F.col("__next").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("__at").alias("a"), F.col("__next").alias("b"))),
    )
    return paired.select(*keys, F.explode(rows).alias("__r")).where("__r is not null").select(*keys, "__r.kind", F.col("__r.a").alias(start), F.col("__r.b").alias(end))
