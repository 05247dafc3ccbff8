"""Site classes, per-site tables, read classes, rates and age models."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.states import StateSpace

# Nucleotide ambiguity codes.
IUPAC = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "A": "A", "C": "C", "G": "G", "T": "T"}
COMPLEMENT = "ACGTN", "TGCAN"


def complement(base: Column) -> Column:
    return F.translate(base, *COMPLEMENT)


def alleles_of(code: Column) -> Column:
    """The bases an ambiguity code stands for, as an array; null for unknown codes."""
    return F.element_at(F.create_map(*[x for k, v in IUPAC.items() for x in (F.lit(k), F.array(*[F.lit(b) for b in v]))]), F.upper(code))


def fixed_differences(panel: DataFrame, pops: Sequence[str], base: str) -> Column:
    """Class of a site: 'none', 'fixed POP' where only that population is fixed for the allele that ``base`` lacks entirely,
    or 'multiple' where several are. Populations without data are not fixed."""
    base_ref = (F.col(f"{base}_alt") == 0) & (F.col(f"{base}_ref") > 0)
    base_alt = (F.col(f"{base}_ref") == 0) & (F.col(f"{base}_alt") > 0)
    fixed = {p: (base_ref & (F.col(f"{p}_ref") == 0) & (F.col(f"{p}_alt") > 0)) | (base_alt & (F.col(f"{p}_alt") == 0) & (F.col(f"{p}_ref") > 0)) for p in pops}
    n = sum((F.when(c, 1).otherwise(0) for c in fixed.values()), F.lit(0))
    one = F.coalesce(*[F.when(c, F.lit(f"fixed {p}")) for p, c in fixed.items()])
    return F.when(n == 0, "none").when(n > 1, "multiple").otherwise(one)


def log10_table(g: Sequence[Column]) -> list[Column]:
    """log10 of probabilities with a floor, at most 0."""
    return [F.least(F.log10(x + F.lit(1e-40)), F.lit(0.0)) for x in g]


def expand_reads(counts: DataFrame) -> DataFrame:
    """One row per read: allele 0 or 1. Models here weigh counts instead; this serves exports."""
    both = F.concat(F.array_repeat(F.lit(0), F.col("tref").cast("int")), F.array_repeat(F.lit(1), F.col("talt").cast("int")))
    return counts.withColumn("allele", F.explode(both)).drop("tref", "talt")


def length_classes(reads: DataFrame, keys: Sequence[str], value: str, size: int, most: int = 254, out: str = "cls", weight: Column | None = None) -> DataFrame:
    """``reads`` with quantile classes of ``value`` of about ``size`` reads per group; 255 where it is null or negative.

    Classes come from counts per distinct value (few), accumulated inside the group, so reads are not ranked one by one.
    """
    ok = F.col(value).isNotNull() & (F.col(value) >= 0)
    h = reads.where(ok).groupBy(*keys, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("__n"))
    w = Window.partitionBy(*keys)
    total = F.sum("__n").over(w)
    k = F.least(F.greatest(F.floor(total / F.lit(size)), F.lit(1)), F.lit(most))
    before = F.sum("__n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    h = h.withColumn(out, F.floor(before * k / total).cast("int")).drop("__n")
    return reads.join(h, [*keys, value], "left").withColumn(out, F.when(ok, F.col(out)).otherwise(255))


def bin_read_groups(counts: DataFrame, deam_size: int, len_size: int) -> tuple[DataFrame, DataFrame]:
    """Counts with lib, len, deam, tref and talt: ``counts`` with rg, named after library, damage class and length class of about so
    many reads each, and the index of groups (rg, lib, deam_cls, len_cls, n_exact)."""
    n = F.col("tref") + F.col("talt")
    x = length_classes(counts, ["lib"], "deam", deam_size, out="deam_cls", weight=n)
    x = length_classes(x, ["lib"], "len", len_size, out="len_cls", weight=n)
    x = x.withColumn("rg", F.concat_ws("_", "lib", F.col("deam_cls").cast("string"), F.col("len_cls").cast("string")))
    return x, x.groupBy("rg", "lib", "deam_cls", "len_cls").agg(F.sum(n).alias("n_exact"))


def read_level_d(reads: DataFrame, freqs: DataFrame, on: Sequence[str], by: Sequence[str], a: str, c: str, o: str) -> DataFrame:
    """(by, abba, baba, d): D(read, a; c, o) where the first population is each read's allele, per read class."""
    j = reads.join(freqs.where(F.col(a).isNotNull() & F.col(c).isNotNull() & F.col(o).isNotNull()), list(on))
    x = F.col("is_alt").cast("double")
    from strandline.operators.fstats import abba_baba

    p = abba_baba(x, F.col(a), F.col(c), F.col(o))
    g = j.groupBy(*by).agg(F.sum(p[0]).alias("abba"), F.sum(p[1]).alias("baba"))
    return g.withColumn("d", (F.col("abba") - F.col("baba")) / F.nullif(F.col("abba") + F.col("baba"), F.lit(0.0)))


def sharing_moments(carriers: DataFrame, unit: Sequence[str], sample: str, n_units: int) -> DataFrame:
    """(a, b, cov, cor, jaccard) of presence vectors over ``n_units`` units, a < b, from pair and single counts."""
    from strandline.operators.panelstats import pairwise_sharing

    one = carriers.select(*unit, sample).distinct().groupBy(sample).agg(F.count(F.lit(1)).alias("k"))
    p = pairwise_sharing(carriers, unit, sample)
    j = p.join(one.select(F.col(sample).alias("a"), F.col("k").alias("ka")), "a").join(one.select(F.col(sample).alias("b"), F.col("k").alias("kb")), "b")
    n = F.lit(float(n_units))
    cov = (F.col("n") - F.col("ka") * F.col("kb") / n) / (n - 1)
    var = lambda k: (F.col(k) - F.col(k) * F.col(k) / n) / (n - 1)
    return j.select("a", "b", cov.alias("cov"), (cov / F.nullif(F.sqrt(var("ka") * var("kb")), F.lit(0.0))).alias("cor"), (F.col("n") / (F.col("ka") + F.col("kb") - F.col("n"))).alias("jaccard"))


#: Pairs up to which a matrix of similarities may come to the driver.
MOST_PAIRS = 1_000_000


def cluster_order(names: Sequence[str], similarity: Mapping[tuple[str, str], float]) -> list[str]:
    """Display order of samples by average-linkage merging of their similarity; for matrices of a driver's size."""
    groups = {i: [n] for i, n in enumerate(names)}
    s = {(i, j): similarity.get((a, b), similarity.get((b, a), 0.0)) for (i, a), (j, b) in itertools.combinations(enumerate(names), 2)}
    while len(groups) > 1:
        i, j = max(s, key=s.get)
        a, b = len(groups[i]), len(groups[j])
        for k in groups:
            if k not in (i, j):
                ik, jk = (min(i, k), max(i, k)), (min(j, k), max(j, k))
                s[ik] = (a * s[ik] + b * s[jk]) / (a + b)
        groups[i] = groups[i] + groups.pop(j)
        s = {k: v for k, v in s.items() if j not in k}
    return next(iter(groups.values()), [])


def diploid_rates(rates: np.ndarray, space: StateSpace) -> np.ndarray:
    """Transition rates of unordered haplotype pairs from those of one haplotype: either copy may change."""
    at = {tuple(sorted(p)): k for k, p in enumerate(space.pairs) if p[1] >= 0}
    n = len(space.pairs)
    out = np.zeros((n, n))
    for (i, j), k in at.items():
        for keep, move in ((i, j), (j, i)):
            for to in range(len(space.sources)):
                target = at.get(tuple(sorted((keep, to))))
                if to != move and target is not None:
                    out[k, target] += rates[move, to]
    np.fill_diagonal(out, 0)
    np.fill_diagonal(out, -out.sum(axis=1))
    return out


def fit_ages(tracts: DataFrame, group: Sequence[str], length: str, trunc: float, grid: Sequence[float], rounds: int = 50) -> DataFrame:
    """(group, age, weight): mixture over a grid of ages (generations) of exponential lengths in cM above ``trunc``, by EM.

    Lengths are counted by value first; a group is one pandas kernel over its distinct lengths.
    """
    h = tracts.where(F.col(length) >= trunc).groupBy(*group, F.round(length, 3).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    types = ", ".join(f"{k} {tracts.schema[k].dataType.simpleString()}" for k in group)
    t = np.array(grid, float) / 100

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = pdf["x"].to_numpy(float) - trunc, pdf["n"].to_numpy(float)
        lik = t * np.exp(-np.outer(x, t))
        w = np.full(len(t), 1 / len(t))
        for _ in range(rounds):
            r = lik * w
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
            w = (n[:, None] * r).sum(axis=0) / n.sum()
        return pd.DataFrame([(*key, float(a), float(v)) for a, v in zip(grid, w)], columns=[*group, "age", "weight"])

    return h.groupBy(*group).applyInPandas(run, f"{types}, age double, weight double")


def longest_tract_null(counts: DataFrame, generations: float, reps: int, seed: int = 0) -> DataFrame:
    """(n, rep, longest): longest of n exponential tracts since admixture, by inversion of a hash-drawn uniform, for every
    number n of ``counts``."""
    from strandline.operators.panelstats import md5_uniform

    x = counts.select(F.col("n").cast("int").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    u = F.greatest(md5_uniform(F.lit(seed), F.col("n"), F.col("rep")), F.lit(1e-12))
    # P(longest <= x) = (1 - exp(-g x / 100))^n
    return x.withColumn("longest", -F.ln(1 - F.pow(u, 1 / F.col("n"))) * F.lit(100.0 / generations))


def within(points: DataFrame, bed: DataFrame) -> DataFrame:
    """Points (chrom, pos) inside half-open BED intervals: a semi join over buckets."""
    from strandline.operators.tracts import overlap_join

    p = points.select("chrom", "pos").distinct().withColumns({"start": F.col("pos"), "end": F.col("pos")})
    b = bed.select("chrom", (F.col("start") + 1).alias("r_start"), F.col("end").alias("r_end"))
    return points.join(overlap_join(p, b, ["chrom"], 1_000_000).select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")


def run_callback(sites: DataFrame, block: Sequence[str], process: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """User extension: ``process(block key, its sites)`` for every block, as a grouped pandas function."""
    return sites.groupBy(*block).applyInPandas(lambda key, pdf: process(key, pdf), schema)
