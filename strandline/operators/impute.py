"""Filling missing values by mixed-effects prediction, with a mask of the filled cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.canon import canon_chrom, genetic_position
from strandline.plans.scan import BLOCK, before, running_max_before, two_level, with_block
from strandline.plans.tables import materialise

SITE_BLOCK = 1_000_000


BROADCAST_ROWS = 100_000


def _null_join(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """Left join on null-safe equality of ``keys``; the right side is one row per key, broadcast where it is known to have
    at most 100,000 ``rows``."""
    r = right.select(*[F.col(k).alias(f"__j_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    r = F.broadcast(r) if rows is not None and rows <= BROADCAST_ROWS else r
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__j_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, "left").drop(*[f"__j_{k}" for k in keys])


def fill_numeric(df: DataFrame, value: str, group: Sequence[str], time: Sequence[str], covariate: str | None = None, out: str = "filled", mask: str = "is_filled") -> DataFrame:
    """``df`` with ``out`` = ``value``, or its mixed-effects prediction where it is null, and ``mask`` telling which.

    Model: y = line(x) + group effect (intercept and slope) + time effect + error. Group and time effects are
    random: each is shrunk towards zero by variance / (variance + error variance / n), with variances estimated by
    moments, so small groups lean on the rest. Only sums per group and per time cell are computed (map-side
    combined), plus two single-row aggregates that fix the variances; every present row counts.

    A null covariate counts as its group's mean. NaN and infinite values must be nulled beforehand. Null group or
    time values form a group of their own. Where no value is present at all, ``out`` stays null and ``mask`` true.
    An empty table gives an empty result. Names starting with '__' are reserved; other columns pass through.
    """
    y = F.col(value).cast("double")
    x = F.col(covariate).cast("double") if covariate else F.lit(None).cast("double")
    work = df.withColumn("__y", y).withColumn("__x", x)
    both = F.col("__y").isNotNull() & F.col("__x").isNotNull()
    yb, xb = F.when(both, F.col("__y")), F.when(both, F.col("__x"))
    g = work.groupBy(*group).agg(
        F.count("__y").alias("__n"),
        F.avg("__y").alias("__my"),
        F.avg(xb).alias("__mx"),
        F.count(yb).alias("__nb"),
        F.covar_pop(xb, yb).alias("__cxy"),
        F.var_pop(xb).alias("__vx"),
        F.var_pop(yb).alias("__vy"),
    )
    g = materialise(g)
    sxx, sxy, syy = (F.col("__nb") * F.col(c) for c in ("__vx", "__cxy", "__vy"))
    t = g.agg(
        F.sum(F.col("__n") * F.col("__my")).alias("sy"),
        F.sum("__n").alias("n"),
        F.sum(F.col("__nb") * F.col("__mx")).alias("sx"),
        F.sum("__nb").alias("nb"),
        F.sum(sxx).alias("sxx"),
        F.sum(sxy).alias("sxy"),
        F.sum(syy).alias("syy"),
        F.count(F.when(F.col("__n") > 0, 1)).alias("k"),
        F.count(F.lit(1)).alias("groups"),
    ).first()
    n, k = t["n"] or 0, t["k"] or 0
    my = (t["sy"] or 0.0) / n if n else 0.0
    mx = (t["sx"] or 0.0) / t["nb"] if t["nb"] else 0.0
    slope = t["sxy"] / t["sxx"] if t["sxx"] else 0.0
    own = F.when(sxx > 0, sxy / sxx)
    # error variance inside groups around their own lines, and the spread of slopes and intercepts over groups
    s = g.agg(
        F.sum(F.when(sxx > 0, syy - sxy * sxy / sxx).otherwise(F.coalesce(syy, F.lit(0.0)))).alias("rss"),
        F.sum(F.when(sxx > 0, (own - slope) * (own - slope) * sxx)).alias("bs"),
        F.sum(F.when(sxx > 0, sxx)).alias("wsxx"),
        F.count(F.when(sxx > 0, 1)).alias("ks"),
        F.sum(F.when(F.col("__n") > 0, F.pow(F.col("__my") - my - slope * (F.coalesce("__mx", F.lit(mx)) - mx), F.lit(2)))).alias("bi"),
        F.sum(F.when(F.col("__n") > 0, 1 / F.col("__n"))).alias("inv"),
    ).first()
    err = (s["rss"] or 0.0) / max(1, n - 2 * k) if n else 0.0
    var_slope = max(0.0, ((s["bs"] or 0.0) - (s["ks"] or 0) * err) / s["wsxx"]) if s["wsxx"] else 0.0
    var_int = max(0.0, ((s["bi"] or 0.0) - err * (s["inv"] or 0.0)) / k) if k else 0.0
    w_slope = F.when(sxx > 0, F.lit(var_slope) / (F.lit(var_slope) + F.lit(err) / sxx + F.lit(1e-300)))
    w_int = F.when(F.col("__n") > 0, F.lit(var_int) / (F.lit(var_int) + F.lit(err) / F.col("__n") + F.lit(1e-300)))
    base = F.lit(my) + F.lit(slope) * (F.coalesce("__mx", F.lit(mx)) - F.lit(mx))
    g = g.select(
        *group,
        F.coalesce("__mx", F.lit(mx)).alias("__gx"),
        (F.lit(slope) + F.coalesce(w_slope * (own - slope), F.lit(0.0))).alias("__gs"),
        (base + F.coalesce(w_int * (F.col("__my") - base), F.lit(0.0))).alias("__gi"),
    )
    work = _null_join(work, g, group, t["groups"])
    fit = F.col("__gi") + F.col("__gs") * F.coalesce(F.col("__x") - F.col("__gx"), F.lit(0.0))
    work = work.withColumn("__fit", fit).withColumn("__res", F.col("__y") - F.col("__fit"))
    cells = materialise(work.groupBy(*time).agg(F.count("__res").alias("__tn"), F.avg("__res").alias("__tm"), F.var_pop("__res").alias("__tv")))
    c = cells.agg(
        F.sum(F.col("__tn") * F.col("__tv")).alias("rss"),
        F.sum("__tn").alias("n"),
        F.count(F.when(F.col("__tn") > 0, 1)).alias("k"),
        F.sum(F.col("__tm") * F.col("__tm")).alias("between"),
        F.sum(F.when(F.col("__tn") > 0, 1 / F.col("__tn"))).alias("inv"),
        F.count(F.lit(1)).alias("cells"),
    ).first()
    e2 = (c["rss"] or 0.0) / max(1, (c["n"] or 0) - (c["k"] or 0))
    var_time = max(0.0, ((c["between"] or 0.0) - e2 * (c["inv"] or 0.0)) / c["k"]) if c["k"] else 0.0
    effect = F.when(F.col("__tn") > 0, F.col("__tm") * F.lit(var_time) / (F.lit(var_time) + F.lit(e2) / F.col("__tn") + F.lit(1e-300)))
    work = _null_join(work, cells.select(*time, effect.alias("__te")), time, c["cells"])
    predicted = F.lit(None).cast("double") if not n else F.col("__fit") + F.coalesce("__te", F.lit(0.0))
    extra = [x for x in work.columns if x.startswith("__")]
    return work.withColumn(out, F.coalesce(F.col("__y"), predicted)).withColumn(mask, F.col("__y").isNull()).drop(*extra)


def fill_category(df: DataFrame, value: str, group: Sequence[str], time: Sequence[str], strength: float = 10.0, out: str = "filled", mask: str = "is_filled") -> DataFrame:
    """``df`` with ``out`` = ``value``, or the likeliest category where it is null, and ``mask`` telling which.

    Multinomial model with shrinkage: p(c | group, time) = (n(group, time, c) + strength · p(c | group)) /
    (n(group, time) + strength), and p(c | group) leans on p(c) alike. All categories compete, also those not seen in a
    cell or group: of these only the best one of the level above can win. Ties go to the smaller category. Only counts
    per cell are computed. A null group or time is a group of its own; with no value at all ``out`` stays null.
    """
    cell = list(dict.fromkeys([*group, *time]))
    counts = materialise(df.where(F.col(value).isNotNull()).groupBy(*cell, F.col(value).alias("__c")).agg(F.count(F.lit(1)).alias("__n")))
    # the first of an ascending order by (-p, category) is the likeliest and, among equals, the smallest category
    rank = lambda p, c: F.struct((-p).alias("q"), F.col(c).alias("c"))
    overall = materialise(counts.groupBy("__c").agg(F.sum("__n").alias("__n0")))
    top = overall.agg(F.sum("__n0").alias("n"), F.min(rank(F.col("__n0"), "__c")).alias("b")).first()
    kind = counts.schema["__c"].dataType
    total, c0 = top["n"] or 1, F.lit(top["b"]["c"] if top["b"] else None).cast(kind)
    p0 = F.lit(-top["b"]["q"] / total if top["b"] else 0.0)
    by_group = counts.groupBy(*group, "__c").agg(F.sum("__n").alias("__ng")).join(overall.select("__c", (F.col("__n0") / F.lit(total)).alias("__base")), "__c")
    by_group = _null_join(by_group, counts.groupBy(*group).agg(F.sum("__n").alias("__sg")), group).withColumn("__pg", (F.col("__ng") + strength * F.col("__base")) / (F.col("__sg") + strength))
    unseen = F.struct((-(strength * p0 / (F.col("__sg") + strength))).alias("q"), c0.alias("c"))
    of_group = by_group.groupBy(*group).agg(F.min(rank(F.col("__pg"), "__c")).alias("__b"), F.first("__sg").alias("__sg"))
    of_group = of_group.withColumn("__b", F.least("__b", unseen)).select(*group, F.col("__b.c").alias("__cg"), (-F.col("__b.q")).alias("__best"))
    cells = _null_join(counts, counts.groupBy(*cell).agg(F.sum("__n").alias("__sc")), cell)
    cells = _null_join(cells, by_group.select(*group, F.col("__c").alias("__gc"), "__pg"), group).where(F.col("__gc") == F.col("__c"))
    cells = cells.withColumn("__p", (F.col("__n") + strength * F.col("__pg")) / (F.col("__sc") + strength))
    of_cell = cells.groupBy(*cell).agg(F.min(rank(F.col("__p"), "__c")).alias("__b"), F.first("__sc").alias("__sc"))
    unseen = F.struct((-(strength * F.col("__best") / (F.col("__sc") + strength))).alias("q"), F.col("__cg").alias("c"))
    of_cell = _null_join(of_cell, of_group, group).select(*cell, F.least("__b", unseen)["c"].alias("__cc"))
    work = _null_join(_null_join(df, of_cell, cell), of_group.drop("__best"), group)
    return work.withColumn(mask, F.col(value).isNull()).withColumn(out, F.coalesce(F.col(value), "__cc", "__cg", c0)).drop("__cc", "__cg")


def _valid_sites(reference: DataFrame) -> DataFrame:
    """(chrom, pos, cm, block, highest valid value before) of every site."""
    s = reference.select(canon_chrom("chrom").alias("chrom"), F.col("pos").cast("long").alias("pos"), genetic_position("map").alias("__v")).where("chrom is not null and pos is not null")
    s = with_block(s, "pos", SITE_BLOCK).groupBy("chrom", BLOCK, "pos").agg(F.max("__v").alias("__v"))
    s = running_max_before(s, ["chrom"], "pos", "__v", "__m", SITE_BLOCK, null_keys=False, keep_block=True)
    return s.select("chrom", "pos", F.when(~F.coalesce(F.col("__v") < F.col("__m"), F.lit(False)), F.col("__v")).alias("cm"), BLOCK, "__m")


def sites(reference: DataFrame) -> DataFrame:
    """One row per (chrom, pos) with the valid genetic position, if any, as ``cm``.

    Repeated rows of a site agree but for spelling; the largest valid value of a site counts. A value is valid when
    it is finite, from 0 to below 400, and not below a valid one earlier on the chromosome. Null chrom or pos: left out.
    """
    return _valid_sites(reference).drop(BLOCK, "__m")


def fill_site_map(reference: DataFrame) -> DataFrame:
    """(chrom, pos, cm, cm_filled, is_filled): every site's genetic position, filled where it is missing.

    Chromosomes are the groups, 1 Mb stretches of a chromosome the times and pos the covariate; the prediction is
    then kept between the nearest valid positions before and after, so that the map never falls. Valid values never fall,
    so the one before a missing site is the highest so far.
    """
    last = lambda c, w: F.last(c, ignorenulls=True).over(before(w))
    seen = F.when(F.col("cm").isNotNull(), F.col("pos"))
    s = two_level(_valid_sites(reference), ["chrom"], "pos", SITE_BLOCK, lambda up, down: {"__hi": last("cm", down)}, {"__first": F.min_by("cm", seen)}, lambda up, down: {"__n": last("__first", down)}, null_keys=False)
    s = materialise(s.select("chrom", "pos", "cm", F.col("__m").alias("lo"), F.coalesce("__hi", "__n").alias("hi"))).withColumn("stretch", F.floor(F.col("pos") / SITE_BLOCK))
    f = fill_numeric(s, "cm", ["chrom"], ["chrom", "stretch"], "pos", "predicted", "is_filled")
    kept = F.greatest(F.least(F.col("predicted"), F.coalesce("hi", F.lit(399.999))), F.coalesce("lo", F.lit(0.0)))
    return f.withColumn("cm_filled", F.when(F.col("is_filled"), kept).otherwise(F.col("cm"))).select("chrom", "pos", "cm", "cm_filled", "is_filled")


def _limit_rows(limits: DataFrame) -> DataFrame:
    wanted = ["deCODE_min", "AA_Map_min", "deCODE_max", "AA_Map_max", "Shared_Map_max"]
    d = (
        limits.select("panel", canon_chrom("chrom").alias("chrom"), *[genetic_position(c).alias(c) for c in wanted])
        .where("panel is not null and chrom is not null")
        .groupBy("panel", "chrom")
        .agg(*[F.max(c).alias(c) for c in wanted])
    )
    falls: dict[str, Column] = {
        "AA_Map_min": F.col("AA_Map_min") > F.col("AA_Map_max"),
        "deCODE_max": (F.col("deCODE_max") == 0) | (F.col("deCODE_max") < F.col("deCODE_min")),
    }
    for c, bad in falls.items():
        d = d.withColumn(c, F.when(~F.coalesce(bad, F.lit(False)), F.col(c)))
    return d


def fill_chrom_limits(limits: DataFrame) -> DataFrame:
    """(panel, chrom, field, value, value_filled, is_filled) for AA_Map_min and deCODE_max of each panel and chromosome.

    Chromosomes are the groups and panels the times; the same limit in another map is the covariate. 0 is valid for
    AA_Map_min but not for deCODE_max, which lies at the end of a chromosome. Repeated rows count once; rows without
    panel or chrom are left out.
    """
    d = materialise(_limit_rows(limits))
    parts = []
    for field, cov in (("AA_Map_min", "deCODE_min"), ("deCODE_max", "AA_Map_max")):
        f = fill_numeric(d, field, ["chrom"], ["panel"], cov, "value_filled", "is_filled")
        lo, hi = (F.lit(0.0), F.coalesce("AA_Map_max", F.lit(399.999))) if field == "AA_Map_min" else (F.coalesce("deCODE_min", F.lit(0.0)), F.lit(399.999))
        kept = F.when(F.col("is_filled"), F.greatest(F.least("value_filled", hi), lo)).otherwise(F.col("value_filled"))
        parts.append(f.select("panel", "chrom", F.lit(field).alias("field"), F.col(field).alias("value"), kept.alias("value_filled"), "is_filled"))
    return parts[0].unionByName(parts[1])
