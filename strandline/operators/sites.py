"""Panels, read counts and genome bins: filters, polarisation, ids, priors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.canon import chrom_rank
from strandline.plans.quantiles import quantiles
from strandline.plans.scan import before, running_count, two_level

HAPLOID_ALWAYS = ("Y", "W")
POS_BLOCK = 1 << 20


def merge_states(panel: DataFrame, states: Mapping[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """Sum the ref and alt counts of the populations of each state; null counts as 0. A projection, no shuffle."""
    total = lambda pops, a: reduce(lambda x, y: x + y, [F.coalesce(F.col(f"{p}_{a}"), F.lit(0)) for p in pops])
    return panel.select(*keep, *[total(pops, a).alias(f"{s}_{a}") for s, pops in states.items() for a in ("ref", "alt")])


def with_data(panel: DataFrame, pop: str) -> DataFrame:
    """Sites at which ``pop`` has any allele (ancestral or contaminant filter)."""
    return panel.where(F.col(f"{pop}_ref") + F.col(f"{pop}_alt") > 0)


def delta_filter(panel: DataFrame, pops: Sequence[str], delta: float) -> DataFrame:
    """Sites at which some pair of populations differs by at least ``delta`` in frequency; no data counts as 0."""
    f = {p: F.coalesce(F.col(f"{p}_alt") / F.nullif(F.col(f"{p}_alt") + F.col(f"{p}_ref"), F.lit(0)), F.lit(0.0)) for p in pops}
    pairs = [F.abs(f[a] - f[b]) >= delta for i, a in enumerate(pops) for b in pops[i + 1 :]]
    return panel.where(reduce(lambda a, b: a | b, pairs))


def autosomes_only(panel: DataFrame, sex_chroms: Sequence[str] = ("X", "Y", "Z", "W")) -> DataFrame:
    return panel.where(~F.col("chrom").isin(*sex_chroms))


def coverage_filter(obs: DataFrame, high: float) -> DataFrame:
    """Rows with reads and at most the (1 − high) quantile of depth."""
    n = F.col("tref") + F.col("talt")
    top = quantiles(obs.select(n.alias("n")), "n", [1 - high])[0]
    return obs.where((n > 0) & (n <= (top if top is not None else 0)))


def greedy_thin(panel: DataFrame, by: str, distance: float) -> DataFrame:
    """Per chromosome, keep a site if it lies more than ``distance`` after the last kept one.

    The choice depends on all earlier ones, so the distinct values of ``by`` of a chromosome are one pandas group, bounded by
    the chromosome's length; no other column goes through it. Ties in ``by`` keep one site, the first by its other columns.
    Sites with a null in ``by`` or without a chromosome are left out.
    """
    at = panel.select("chrom", by).where(F.col("chrom").isNotNull() & F.col(by).isNotNull()).distinct()

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by)
        x, keep, k = pdf[by].to_numpy(), [], 0
        while k < len(x):
            keep.append(k)
            k = max(k + 1, int(x.searchsorted(x[k] + distance, side="right")))
        return pdf.iloc[keep]

    kept = at.groupBy("chrom").applyInPandas(thin, at.schema)
    one = first_per_key(panel, ["chrom", by], [c for c in panel.columns if c not in ("chrom", by)] or [by])
    return one.join(kept, ["chrom", by]).select(*panel.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def flipped(anc: str) -> Column:
    """Whether the reference allele is derived: the outgroup shows only the alternative one."""
    return (F.col(f"{anc}_ref") == 0) & (F.col(f"{anc}_alt") > 0)


def polarize(panel: DataFrame, pops: Sequence[str], anc: str) -> DataFrame:
    f = flipped(anc)
    out = panel.withColumn("flipped", f)
    for p in pops:
        out = out.withColumn(f"{p}_anc", F.when(f, F.col(f"{p}_alt")).otherwise(F.col(f"{p}_ref"))).withColumn(
            f"{p}_der", F.when(f, F.col(f"{p}_ref")).otherwise(F.col(f"{p}_alt"))
        )
    return out


def cont_freq(pop: str, a: float = 0.0, b: float = 0.0) -> Column:
    """Frequency of the alternative allele in the contaminant, with pseudo-counts."""
    return (F.col(f"{pop}_alt") + F.lit(a)) / F.nullif(F.col(f"{pop}_alt") + F.col(f"{pop}_ref") + F.lit(a + b), F.lit(0))


def guess_sex(panel: DataFrame, obs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(x_cov, a_cov, ratio, sex): coverage of chromosomes that start with X, Z or h against the rest."""
    het = F.lower(F.substring("chrom", 1, 1)).isin("x", "z", "h")
    n = panel.agg(F.count(F.when(het, 1)).alias("nx"), F.count(F.when(~het, 1)).alias("na"))
    r = obs.agg(F.sum(F.when(het, F.col("tref") + F.col("talt"))).alias("rx"), F.sum(F.when(~het, F.col("tref") + F.col("talt"))).alias("ra"))
    x = n.join(r).select((F.col("rx") / F.nullif("nx", F.lit(0))).alias("x_cov"), (F.col("ra") / F.nullif("na", F.lit(0))).alias("a_cov"))
    ratio = F.col("x_cov") / F.nullif("a_cov", F.lit(0))
    return x.withColumn("ratio", ratio).withColumn("sex", F.when(ratio < threshold, "m").otherwise("f"))


def ploidy(chrom: Column, sex: str) -> Column:
    """1 for haploid chromosomes of this sex, else 2."""
    one = chrom.isin(*HAPLOID_ALWAYS) | F.lower(chrom).startswith("hap")
    one = one | (chrom == ("X" if sex == "m" else "Z"))
    return F.when(one, 1).otherwise(2)


def genome_bins(sites: DataFrame, by: str, size: float) -> DataFrame:
    """(chrom, bin_in_chrom, start, bin): bins of each chromosome, empty ones included, numbered over all chromosomes.

    A chromosome's bins start at the multiple of ``size`` below its first site; a chromosome has at least one bin.
    Offsets come from a window over one row per chromosome.
    """
    lim = sites.groupBy("chrom").agg((F.floor(F.min(by) / size)).alias("lo"), F.ceil(F.max(by) / size).alias("hi"))
    lim = lim.withColumn("n", F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))
    w = Window.orderBy(chrom_rank("chrom"), "chrom").rowsBetween(Window.unboundedPreceding, -1)
    lim = lim.withColumn("first_bin", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return lim.select("chrom", "first_bin", "lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("bin_in_chrom")).select(
        "chrom", "bin_in_chrom", ((F.col("lo") + F.col("bin_in_chrom")) * size).alias("start"), (F.col("first_bin") + F.col("bin_in_chrom")).alias("bin")
    )


def snp_bins(sites: DataFrame, by: str, size: float) -> DataFrame:
    """``sites`` with bin_in_chrom and bin; a site at the upper edge belongs to the last bin."""
    lim = sites.groupBy("chrom").agg(F.floor(F.min(by) / size).alias("lo"), F.ceil(F.max(by) / size).alias("hi"))
    lim = lim.withColumn("n", F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))
    w = Window.orderBy(chrom_rank("chrom"), "chrom").rowsBetween(Window.unboundedPreceding, -1)
    lim = lim.withColumn("first_bin", F.coalesce(F.sum("n").over(w), F.lit(0)))
    j = sites.join(lim, "chrom")
    at = F.least(F.floor(F.col(by) / size) - F.col("lo"), F.col("n") - 1)
    return j.withColumn("bin_in_chrom", at).withColumn("bin", F.col("first_bin") + at).drop("lo", "hi", "n", "first_bin")


def snp_ids(sites: DataFrame) -> DataFrame:
    """Dense ids in genome order: a row number per chromosome, counted in blocks, plus the chromosome's offset."""
    per = sites.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(chrom_rank("chrom"), "chrom").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("chrom", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first"))
    return running_count(sites, ["chrom"], "pos", "__rn", POS_BLOCK, null_keys=False).join(per, "chrom").withColumn("snp_id", F.col("first") + F.col("__rn") - 1).drop("__rn", "first")


def block_ids(sites: DataFrame, mode: str, size: int) -> DataFrame:
    """Jackknife blocks per chromosome: 'snp' of about ``size`` sites, 'bp' of about ``size`` base pairs, or 'chrom'."""
    if mode == "chrom":
        return sites.withColumn("block", F.lit(0).cast("long"))
    lim = sites.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"), (F.max("pos") - F.min("pos") + 1).alias("span"))
    total = F.col("n") if mode == "snp" else F.col("span")
    lim = lim.withColumn("k", F.greatest(F.floor(total / F.lit(size)), F.lit(1))).withColumn("each", F.ceil(total / F.col("k")))
    numbered = running_count(sites, ["chrom"], "pos", "__rn", POS_BLOCK, null_keys=False) if mode == "snp" else sites
    at = F.col("__rn") - 1 if mode == "snp" else F.col("pos") - F.col("lo")
    return numbered.join(lim, "chrom").withColumn("block", F.floor(at / F.col("each"))).drop("__rn", "n", "lo", "span", "k", "each")


def interpolate_map(points: DataFrame, knots: DataFrame, pos: str, knot_pos: str, knot_map: str, out: str = "map", clamp: bool = True, block: int = POS_BLOCK) -> DataFrame:
    """``points`` with the genetic position interpolated linearly between the knots of its chromosome.

    An as-of join in both directions over the union of points and knots, in blocks of positions: no range join. Outside the
    knots the nearest one's value holds (``clamp``), or null.
    """
    k = knots.select("chrom", F.col(knot_pos).cast("double").alias("__at"), F.struct(F.col(knot_pos).cast("double").alias("p"), F.col(knot_map).cast("double").alias("m")).alias("__k"))
    p = points.select("chrom", F.col(pos).cast("double").alias("__at"), F.struct(*points.columns).alias("__row"))
    upto = lambda w: F.last("__k", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    last = lambda c, w: F.last(c, ignorenulls=True).over(before(w))
    seen = F.when(F.col("__k").isNotNull(), F.col("__at"))
    u = two_level(
        p.unionByName(k, allowMissingColumns=True), ["chrom"], "__at", block,
        lambda up, down: {"__lo": upto(up), "__hi": upto(down)},
        {"__last": F.max_by("__k", seen), "__first": F.min_by("__k", seen)},
        lambda up, down: {"__p": last("__last", up), "__n": last("__first", down)},
    )
    u = u.where("__row is not null").select("__row", "__at", F.coalesce("__lo", "__p").alias("__lo"), F.coalesce("__hi", "__n").alias("__hi"))
    between = F.col("__lo.m") + (F.col("__at") - F.col("__lo.p")) * (F.col("__hi.m") - F.col("__lo.m")) / F.nullif(F.col("__hi.p") - F.col("__lo.p"), F.lit(0.0))
    edge = F.coalesce("__lo.m", "__hi.m") if clamp else F.when(F.col("__lo.p") == F.col("__hi.p"), F.col("__lo.m"))
    return u.select("__row.*", F.coalesce(between, edge).alias(out))


def beta_prior(der: Column, anc: Column, known: bool = False) -> tuple[list[Column], callable]:
    """Aggregates of a beta-binomial moment estimator, and a function from their names to the (der, anc) pseudo-counts."""
    n = F.nullif(der + anc, F.lit(0))
    f = der / n
    aggs = [F.avg(f).alias("f"), F.var_pop(f).alias("v"), F.avg((f - 0.5) * (f - 0.5)).alias("v2"), F.avg(F.when(der.isNotNull() & anc.isNotNull(), der + anc)).alias("n")]

    def prior() -> tuple[Column, Column]:
        mean = F.col("f") if known else F.lit(0.5)
        h = mean * (1 - mean)
        var = F.col("v") if known else F.col("v2")  # around one half, both alleles pooled
        ab = (h - var) / F.nullif(var - h / F.nullif("n", F.lit(0.0)), F.lit(0.0))
        weak = (h == 0) | (F.col("n") < ab)
        one = lambda m: F.when(weak, 1e-6).otherwise(F.greatest(m * ab, F.lit(1e-5)))
        return one(mean), one(1 - mean)

    return aggs, prior


def empirical_prior(panel: DataFrame, pops: Sequence[str]) -> DataFrame:
    """(pop, pa, pb): symmetric empirical-Bayes pseudo-counts per population, one pass for all."""
    long = panel.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pop"), F.col(f"{p}_alt").alias("a"), F.col(f"{p}_ref").alias("b")) for p in pops])).alias("x")).select("x.*")
    aggs, prior = beta_prior(F.col("a"), F.col("b"))
    pa, pb = prior()
    return long.groupBy("pop").agg(*aggs).select("pop", pa.alias("pa"), pb.alias("pb"))


def oriented_prior(panel: DataFrame, pops: Sequence[str], anc: str) -> DataFrame:
    """(pop, p_der, p_anc) from the sites at which the outgroup tells the ancestral allele."""
    known = (F.col(f"{anc}_ref") > 0) != (F.col(f"{anc}_alt") > 0)
    p = polarize(panel.where(known), pops, anc)
    long = p.select(F.explode(F.array(*[F.struct(F.lit(x).alias("pop"), F.col(f"{x}_der").alias("a"), F.col(f"{x}_anc").alias("b")) for x in pops])).alias("x")).select("x.*")
    aggs, prior = beta_prior(F.col("a"), F.col("b"), known=True)
    pd_, pa = prior()
    return long.groupBy("pop").agg(*aggs).select("pop", pd_.alias("p_der"), pa.alias("p_anc"))


def with_priors(sites: DataFrame, pops: Sequence[str], prior: float | None, ancestral: str | None = None, ancestral_prior: float = 0.0) -> DataFrame:
    """``sites`` with the pseudo-counts {pop}_pa and {pop}_pb (alternative, reference) of every population.

    A given ``prior`` is added to both, and ``ancestral_prior`` per allele of the outgroup. Without it they are estimated from the
    panel: one symmetric pair per population, or, with an outgroup, where that tells the ancestral allele, one for the
    ancestral and the derived allele. The estimates are one row per population.
    """
    if prior is not None:
        anc = [F.coalesce(F.col(f"{ancestral}_{x}"), F.lit(0)) * ancestral_prior if ancestral else F.lit(0.0) for x in ("alt", "ref")]
        return sites.withColumns({f"{p}_{n}": x + prior for p in pops for n, x in zip(("pa", "pb"), anc)})
    even = {r["pop"]: (r["pa"], r["pb"]) for r in empirical_prior(sites, pops).collect()}
    if ancestral is None:
        return sites.withColumns({f"{p}_{n}": F.lit(x) for p in pops for n, x in zip(("pa", "pb"), even[p])})
    r, a = F.col(f"{ancestral}_ref"), F.col(f"{ancestral}_alt")
    known = {x["pop"]: (x["p_der"], x["p_anc"]) for x in oriented_prior(sites, pops, ancestral).collect()}
    out = {}
    for p in pops:
        der, anc = known.get(p, even[p])
        anc = None if anc is None else anc + ancestral_prior
        out[f"{p}_pa"] = F.when((a > 0) & (r == 0), F.lit(anc)).when((r > 0) & (a == 0), F.lit(der)).otherwise(F.lit(even[p][0]))
        out[f"{p}_pb"] = F.when((r > 0) & (a == 0), F.lit(anc)).when((a > 0) & (r == 0), F.lit(der)).otherwise(F.lit(even[p][1]))
    return sites.withColumns(out)


def site_bins(sites: DataFrame) -> DataFrame:
    """``sites`` with a bin of its own for each, numbered in genome order."""
    return snp_ids(sites).withColumn("bin", F.col("snp_id")).drop("snp_id")


def bin_positions(bins: DataFrame, sites: DataFrame, start: str = "start", by: str = "map") -> DataFrame:
    """``bins`` with ``pos``: the physical position of a bin's start on the map of the sites, interpolated and cut to an integer."""
    knots = sites.where(F.col(by).isNotNull()).groupBy("chrom", F.col(by).cast("double").alias("__m")).agg(F.min("pos").alias("__p"))
    return interpolate_map(bins, knots, start, "__m", "__p", "pos", block=64).withColumn("pos", F.col("pos").cast("long"))


def fold_chromosomes(chrom: Column, last: int = 11) -> tuple[Column, Column]:
    """(row, side) of a display in which chromosomes 12 … 22 stand beside 11 … 1; X and others have rows below."""
    n = chrom_rank(chrom)
    return F.when(n <= last, n).when(n <= 2 * last, 2 * last + 1 - n).otherwise(last + n - 2 * last), F.when((n > last) & (n <= 2 * last), "right").otherwise("left")


def orient_alleles(sites: DataFrame, bases: DataFrame) -> DataFrame:
    """``sites`` (chrom, pos, ref, alt) with ``base`` and ``kind``: 'keep' where ref is the reference base, 'swap' where alt is (ref
    and alt change places), 'mismatch' where neither is, 'missing' without a base."""
    b = bases.select("chrom", "pos", F.upper("base").alias("base")).groupBy("chrom", "pos").agg(F.min("base").alias("base"))
    j = sites.join(b, ["chrom", "pos"], "left")
    kind = F.when(F.col("base").isNull(), "missing").when(F.upper("ref") == F.col("base"), "keep").when(F.upper("alt") == F.col("base"), "swap").otherwise("mismatch")
    j = j.withColumn("kind", kind)
    swap = F.col("kind") == "swap"
    return j.withColumns({"ref": F.when(swap, F.col("alt")).otherwise(F.col("ref")), "alt": F.when(swap, F.col("ref")).otherwise(F.col("alt"))})
