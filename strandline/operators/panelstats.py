"""Summaries over many samples, and read-level counting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.plans.quantiles import quantiles


def state_means(bins: DataFrame, keys: Sequence[str], states: Sequence[str]) -> DataFrame:
    """(keys, state, mean): mean posterior per state, unpivoted."""
    g = bins.groupBy(*keys).agg(*[F.avg(F.col(f"`{s}`")).alias(s) for s in states])
    return g.unpivot(list(keys), list(states), "state", "mean")


def viterbi_shares(bins: DataFrame, keys: Sequence[str], state: str) -> DataFrame:
    n = bins.where(F.col(state).isNotNull()).groupBy(*keys, F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def marginals(bins: DataFrame, keys: Sequence[str], states: Sequence[str], state: str) -> DataFrame:
    """Posterior means and Viterbi shares side by side, null where only one exists."""
    a, b = state_means(bins, keys, states), viterbi_shares(bins, keys, state).drop("n")
    return a.join(b, [*keys, "state"], "outer")


SHARING_BLOCK = 512
SHARING_ROWS = 1 << 20


def pairwise_sharing(carriers: DataFrame, unit: Sequence[str], sample: str, block: int = SHARING_BLOCK) -> DataFrame:
    """(a, b, n): units that both samples carry, a < b. The result has a row per pair of samples that share any unit.

    The counts are a product of the carrier matrix with itself, taken in blocks of about ``block`` samples by ``block``
    samples and in parts of the units; no unit's pairs are listed. Null samples carry nothing; repeated carriers count once.
    """
    c = carriers.select(F.struct(*unit).alias("u"), F.col(sample).alias("s")).where("s is not null").distinct()
    size = c.agg(F.approx_count_distinct("s").alias("s"), F.count(F.lit(1)).alias("n")).first()
    blocks = max(1, -(-(size["s"] or 0) // block))
    parts = max(1, -(-(size["n"] or 0) * blocks // SHARING_ROWS))
    kind = carriers.schema[sample].dataType.simpleString()
    c = c.select(F.xxhash64("u").alias("h"), "u", "s", F.pmod(F.xxhash64("s"), F.lit(blocks)).cast("int").alias("k"))
    # each carrier takes part in every pair of blocks that holds its own
    pairs = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("k", o).alias("i"), F.greatest("k", o).alias("j")))
    each = c.select(F.pmod("h", F.lit(parts)).cast("int").alias("part"), "u", "s", "k", F.explode(pairs).alias("p")).select("part", "p.i", "p.j", F.col("u").cast("string").alias("u"), "s", "k")

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        units, _ = pd.factorize(pdf["u"])
        order = pdf["s"].sort_values().unique()
        who = pd.Categorical(pdf["s"], categories=order).codes.astype(np.int64)
        side = np.zeros(len(order), np.int64)
        side[who] = pdf["k"].to_numpy()
        total = np.zeros((len(order), len(order)), np.int64)
        by = np.argsort(units, kind="stable")
        for at in range(0, int(units.max()) + 1, 4096):
            lo, hi = np.searchsorted(units[by], [at, at + 4096])
            m = np.zeros((4096, len(order)), np.float32)
            m[units[by[lo:hi]] - at, who[by[lo:hi]]] = 1
            total += (m.T @ m).astype(np.int64)
        a, b = np.nonzero(np.triu(total, 1))
        if key[1] != key[2]:  # pairs inside a block are counted where it meets itself
            a, b = a[side[a] != side[b]], b[side[a] != side[b]]
        return pd.DataFrame({"a": order[a], "b": order[b], "n": total[a, b]})

    got = each.groupBy("part", "i", "j").applyInPandas(count, f"a {kind}, b {kind}, n long")
    return got.groupBy("a", "b").agg(F.sum("n").alias("n"))


def concordance(left: DataFrame, right: DataFrame, universe: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(a, b, n): 2×2 counts of the units of ``universe`` by membership in ``left`` and ``right``."""
    f = lambda d, n: d.select(*keys).distinct().withColumn(n, F.lit(True))
    j = universe.select(*keys).distinct().join(f(left, "a"), list(keys), "left").join(f(right, "b"), list(keys), "left")
    return j.groupBy(F.coalesce("a", F.lit(False)).alias("a"), F.coalesce("b", F.lit(False)).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def fisher(table: DataFrame) -> float:
    """Two-sided Fisher p-value of a ``concordance`` table (four counts reach the driver)."""
    from strandline.numeric import fisher_exact

    n = {(r["a"], r["b"]): r["n"] for r in table.collect()}
    return fisher_exact(n.get((True, True), 0), n.get((True, False), 0), n.get((False, True), 0), n.get((False, False), 0))


def map_limits(sites: DataFrame, maps: Sequence[str], chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """(chrom, pos_min, pos_max, {map}_min, {map}_max …): the ends of every chromosome on each map; missing positions count on none."""
    ends = [f(c).alias(f"{c}_{n}") for c in (pos, *maps) for n, f in (("min", F.min), ("max", F.max))]
    return sites.groupBy(chrom).agg(*ends)


def weighted_mean(value: str, weight: str) -> Column:
    """Σ value · weight / Σ weight over rows that have both."""
    w = F.when(F.col(value).isNotNull() & F.col(weight).isNotNull(), F.col(weight))
    return F.sum(F.col(value) * w) / F.nullif(F.sum(w), F.lit(0))


def allele_frequencies(panel: DataFrame, pops: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Per site: called alleles, missing populations, alternative frequency, minor allele and its frequency. A projection."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    alt, ref = sum((z(f"{p}_alt") for p in pops), F.lit(0)), sum((z(f"{p}_ref") for p in pops), F.lit(0))
    missing = sum((F.when(z(f"{p}_alt") + z(f"{p}_ref") == 0, 1).otherwise(0) for p in pops), F.lit(0))
    f = alt / F.nullif(alt + ref, F.lit(0))
    return panel.select(*keep, (alt + ref).alias("n_called"), missing.alias("n_missing"), f.alias("freq"), F.least(f, 1 - f).alias("maf"), F.when(f > 0.5, F.col("ref")).otherwise(F.col("alt")).alias("minor_allele"))


def pivot_panel(counts: DataFrame, keys: Sequence[str], pop: str, pops: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Long allele counts to one column per population and allele; listing ``pops`` saves a pass to find them."""
    return counts.groupBy(*keys).pivot(pop, list(pops)).agg(*[F.sum(v).alias(v) for v in values])


def quantile_bins(df: DataFrame, value: str, n: int, out: str = "bin") -> DataFrame:
    """``df`` with the 1-based quantile bin of ``value``: (q[i-1], q[i]], the lowest value in the first; null for null."""
    cuts = [c for c in quantiles(df, value, [i / n for i in range(1, n)]) if c is not None]
    return df.withColumn(out, F.when(F.col(value).isNotNull(), sum((F.when(F.col(value) > c, 1).otherwise(0) for c in cuts), F.lit(1))))


def stacked(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Running sum inside keys (top) and where each part begins (base)."""
    top = F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("top", top).withColumn("base", F.col("top") - F.col(value))


def bin_widths(bins: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(pos)
    return bins.withColumn("width", F.coalesce(F.lead(pos).over(w) - F.col(pos), F.lit(0)))


def damage_class(deam: Column, cutoff: int) -> Column:
    return F.when(F.coalesce(deam, F.lit(-1)) < 0, "nodeam").when(deam < cutoff, "deam").otherwise("nodeam")


def read_groups(reads: DataFrame, cutoff: int, length_bin: int) -> Column:
    """Name of a read's group: library, length class and damage class."""
    return F.concat_ws("_", "lib", F.floor(F.col("len") / length_bin).cast("string"), damage_class(F.col("deam"), cutoff))


def count_reads(reads: DataFrame, keys: Sequence[str], allele: str = "is_alt") -> DataFrame:
    """(keys, tref, talt): alleles per site and group, combined before the shuffle."""
    return reads.groupBy(*keys).agg(F.sum(1 - F.col(allele)).alias("tref"), F.sum(allele).alias("talt"))


def cap_reads(reads: DataFrame, keys: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """The first ``most`` reads per key: the cap is the feature (deep sites keep bounded counts)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return reads.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most).drop("__rn")


def read_passes(min_length: int, max_length: int, deam_only: bool = False, min_base: int | None = None, min_map: int | None = None, from_end: int = 0, names: Mapping[str, str] | None = None) -> Column:
    """Quality predicate of a read; columns len, deam, bq, mq, pos_in_read unless renamed."""
    c = lambda n: F.col((names or {}).get(n, n))
    ok = (c("len") >= min_length) & (c("len") <= max_length)
    if deam_only:
        ok = ok & (F.coalesce(c("deam"), F.lit(-1)) >= 0)
    if min_base is not None:
        ok = ok & (c("bq") >= min_base)
    if min_map is not None:
        ok = ok & (c("mq") >= min_map)
    if from_end:
        ok = ok & (c("pos_in_read") >= from_end) & (c("len") - c("pos_in_read") > from_end)
    return ok


def damage_positions(read: Column, ref: Column, reverse: Column) -> tuple[Column, Column]:
    """0-based distances of the first damaged base from the 5' and from the 3' end: C→T forward, G→A on reverse reads; -1 for none.

    ``read`` and ``ref`` are aligned strings of equal length in reference orientation.
    """
    at = lambda i, x, y: (F.substring(ref, i, F.lit(1)) == x) & (F.substring(read, i, F.lit(1)) == y)
    hits = F.filter(F.sequence(F.lit(1), F.greatest(F.length(read), F.lit(1))), lambda i: F.when(reverse, at(i, "G", "A")).otherwise(at(i, "C", "T")))
    left, right = F.coalesce(F.get(hits, F.lit(0)) - 1, F.lit(-1)), F.coalesce(F.length(read) - F.try_element_at(hits, F.lit(-1)), F.lit(-1))
    return F.when(reverse, right).otherwise(left), F.when(reverse, left).otherwise(right)


def damage_position(read: Column, ref: Column, reverse: Column) -> Column:
    """Distance of the first damaged base from the nearer end; -1 for none."""
    return F.least(*damage_positions(read, ref, reverse))


def explained_by_damage(base: Column, ref: Column, alt: Column, reverse: Column) -> Column:
    """Whether the observed base could be damage of the other allele: T of a C/T site forward, A of a G/A site reverse."""
    pair = lambda x, y: ((ref == x) & (alt == y)) | ((ref == y) & (alt == x))
    return (~reverse & pair("C", "T") & (base == "T")) | (reverse & pair("G", "A") & (base == "A"))


def md5_uniform(*key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def downsample_counts(obs: DataFrame, keys: Sequence[str], share: float, seed: int = 0) -> DataFrame:
    """Binomial thinning of read counts: each read stays when the hash of its key, allele and number is below ``share``."""
    keep = lambda allele, n: F.size(F.filter(F.sequence(F.lit(1), F.col(n).cast("int")), lambda i: md5_uniform(F.lit(seed), *[F.col(k) for k in keys], F.lit(allele), i) < share))
    z = lambda allele, n: F.when(F.col(n) > 0, keep(allele, n)).otherwise(0)
    return obs.withColumns({"tref": z("r", "tref"), "talt": z("a", "talt")}).where("tref + talt > 0")


POISSON_PART = 16.0


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The smallest k at which the Poisson distribution of ``rate`` ≤ ``POISSON_PART`` exceeds ``u``.

    ``u`` is a multiple of 2⁻³² below 1, and the chance of more than 64 at such rates is below 1e-17: the terms summed reach
    every ``u``.
    """
    start = F.struct(F.exp(-rate).alias("p"), F.lit(0.0).alias("cdf"), F.lit(0).cast("long").alias("k"))

    def step(s: Column, i: Column) -> Column:
        cdf = s["cdf"] + s["p"]
        return F.struct((s["p"] * rate / i).alias("p"), cdf.alias("cdf"), (s["k"] + F.when(cdf < u, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(65)), start, step, lambda s: s["k"])


def fake_contamination(obs: DataFrame, keys: Sequence[str], p_cont: str, share: float, seed: int = 0) -> DataFrame:
    """``obs`` with Poisson many contaminant reads of panel frequency ``p_cont``, so that they make up about ``share`` of all.

    Draws invert the Poisson distribution at hashes of the key, so they don't depend on partitions. They have no upper bound:
    a rate above ``POISSON_PART`` is the sum of draws of equal parts of it.
    """
    cov = obs.agg(F.avg(F.col("tref") + F.col("talt"))).first()[0] or 0.0
    lam = share * cov / (1 - share)

    def draw(rate: Column, tag: str) -> Column:
        u = lambda *part: md5_uniform(F.lit(seed), *[F.col(k) for k in keys], F.lit(tag), *part)
        if lam <= POISSON_PART:
            return poisson_inverse(u(), rate)
        n = F.greatest(F.ceil(rate / POISSON_PART), F.lit(1)).cast("int")
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("long"), lambda acc, i: acc + poisson_inverse(u(i), rate / n))

    alt, ref = draw(F.col(p_cont) * lam, "a"), draw((1 - F.col(p_cont)) * lam, "r")
    return obs.withColumn("__a", alt).withColumn("__r", ref).withColumns({"talt": F.col("talt") + F.col("__a"), "tref": F.col("tref") + F.col("__r")}).drop("__a", "__r")


def random_read(obs: DataFrame, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Pseudo-haploid draw: 1 if a hash-picked read shows the alternative allele."""
    n = F.col("tref") + F.col("talt")
    return obs.where(n > 0).withColumn("allele", F.when(md5_uniform(F.lit(seed), *[F.col(k) for k in keys]) * n < F.col("talt"), 1).otherwise(0))


def shuffled_intervals(intervals: DataFrame, sizes: DataFrame, on: Sequence[str], replicates: int, seed: int = 0) -> DataFrame:
    """``replicates`` copies of each interval moved by a hash-drawn offset on its chromosome of length ``size``."""
    x = intervals.join(sizes, list(on)).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    span = F.col("end") - F.col("start")
    at = F.floor(md5_uniform(F.lit(seed), F.col("rep"), *[F.col(k) for k in on], F.col("start"), F.col("end")) * F.greatest(F.col("size") - span, F.lit(1)))
    return x.withColumn("__s", at).withColumn("end", F.col("__s") + span).withColumn("start", F.col("__s")).drop("__s", "size")


def permutation_p(observed: DataFrame, null: DataFrame, keys: Sequence[str], stat: str) -> DataFrame:
    """(keys, stat, p): share of replicates whose statistic is above the observed one; ``null`` has a row per replicate."""
    n = null.select(*keys, F.col(stat).alias("__null")).join(observed.select(*keys, stat), list(keys))
    return n.groupBy(*keys, stat).agg(F.avg(F.when(F.col("__null") > F.col(stat), 1.0).otherwise(0.0)).alias("p"))
