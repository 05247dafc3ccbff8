"""Diversity, f-statistics and D-statistics with jackknife errors."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_freqs(sfs: DataFrame, pops: Sequence[str]) -> DataFrame:
    """``sfs`` with the derived frequency of every population and its within-population heterozygosity (w_POP)."""
    out = sfs
    for p in pops:
        n = F.col(f"{p}_anc") + F.col(f"{p}_der")
        f = F.col(f"{p}_der") / F.nullif(n, F.lit(0))
        out = out.withColumn(p, f).withColumn(f"w_{p}", 2 * f * F.col(f"{p}_anc") / F.nullif(n - 1, F.lit(0)))
    return out


def _mean(x: Column) -> Column:
    """Mean weighted by n_snps. Terms are added as decimals, so the order of rows never changes the result (totals stay below 1e20)."""
    w = F.when(x.isNotNull(), F.col("n_snps"))
    return F.sum((x * w).cast("decimal(38,18)")).cast("double") / F.nullif(F.sum(w), F.lit(0))


def pi_table(freqs: DataFrame, pops: Sequence[str], target: str = "target", by: Sequence[str] = ("rep", "sex_chrom")) -> DataFrame:
    """(by, pop1, pop2, pi): weighted mean divergence of each pair, and diversity within (pop2 'within'). The target's own is 0."""
    both = [*pops, target]
    col = lambda p: F.col("tau") if p == target else F.col(p)
    aggs = {(a, b): _mean(col(a) * (1 - col(b)) + col(b) * (1 - col(a))) for a, b in itertools.combinations(both, 2)}
    aggs |= {(p, "within"): F.coalesce(_mean(F.col(f"w_{p}")), F.lit(0.0)) for p in pops}
    g = freqs.groupBy(*by).agg(*[x.alias(f"{a}|{b}") for (a, b), x in aggs.items()])
    rows = [F.struct(F.lit(x).alias("pop1"), F.lit(y).alias("pop2"), F.col(f"`{a}|{b}`").alias("pi")) for a, b in aggs for x, y in ([(a, b), (b, a)] if b != "within" else [(a, b)])]
    rows.append(F.struct(F.lit(target).alias("pop1"), F.lit("within").alias("pop2"), F.lit(0.0).alias("pi")))
    return g.select(*by, F.explode(F.array(*rows)).alias("x")).select(*by, "x.*")


def _wide(pi: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per ``by`` with all pi values in a map: the statistics below are then projections."""
    return pi.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "pop1", "pop2"), "pi"))).alias("m"))


def _at(a: str, b: str) -> Column:
    return F.element_at("m", f"{a}|{b}")


def _rows(pi: DataFrame, by: Sequence[str], rows: list[Column], names: Sequence[str], stat: str) -> DataFrame:
    """A row per element of ``rows`` and ``by``; with too few populations for any, an empty table of the same columns."""
    if not rows:
        return pi.where("false").select(*by, *[F.lit("").alias(n) for n in names], F.lit(0.0).alias(stat))
    return _wide(pi, by).select(*by, F.explode(F.array(*rows)).alias("x")).select(*by, "x.*")


def f2(pi: DataFrame, pops: Sequence[str], by: Sequence[str] = ("rep", "sex_chrom")) -> DataFrame:
    rows = [F.struct(F.lit(a).alias("A"), F.lit(b).alias("B"), (_at(a, b) - _at(a, "within") / 2 - _at(b, "within") / 2).alias("f2")) for a, b in itertools.combinations(pops, 2)]
    return _rows(pi, by, rows, ["A", "B"], "f2")


def f3(pi: DataFrame, pops: Sequence[str], by: Sequence[str] = ("rep", "sex_chrom")) -> DataFrame:
    rows = [
        F.struct(F.lit(x).alias("X"), F.lit(a).alias("A"), F.lit(b).alias("B"), ((_at(x, a) + _at(x, b) - _at(a, b) - _at(x, "within")) / 2).alias("f3"))
        for x in pops
        for a, b in itertools.combinations([p for p in pops if p != x], 2)
    ]
    return _rows(pi, by, rows, ["X", "A", "B"], "f3")


def f4(pi: DataFrame, pops: Sequence[str], by: Sequence[str] = ("rep", "sex_chrom")) -> DataFrame:
    """Each quartet in its three ways of pairing, once; the other arrangements follow by sign."""
    rows = []
    for q in itertools.combinations(pops, 4):
        for a, b, c, d in ((0, 1, 2, 3), (0, 2, 1, 3), (0, 3, 1, 2)):
            w, x, y, z = q[a], q[b], q[c], q[d]
            rows.append(F.struct(F.lit(w).alias("A"), F.lit(x).alias("B"), F.lit(y).alias("C"), F.lit(z).alias("D"), ((_at(w, z) + _at(x, y) - _at(w, y) - _at(x, z)) / 2).alias("f4")))
    return _rows(pi, by, rows, ["A", "B", "C", "D"], "f4")


def jackknife_summary(reps: DataFrame, keys: Sequence[str], stat: str) -> DataFrame:
    """(keys, stat, sterr): mean over replicates and sqrt((n − 1) / n · Σ (x − mean)²)."""
    n = F.count(stat)
    return reps.groupBy(*keys).agg(F.avg(stat).alias(stat), F.sqrt(F.var_pop(stat) * (n - 1)).alias("sterr"))


def leave_one_out(classes: DataFrame, unit: str, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """(rep, keys, sums): sums over all units but one, for every unit. One pass; totals minus parts, no replication of rows."""
    part = classes.groupBy(unit, *keys).agg(*[F.sum(s).alias(s) for s in sums])
    total = part.groupBy(*keys).agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    units = part.select(F.col(unit).alias("rep")).distinct()
    # units × classes, both small: every replicate needs every class, also those its unit lacks
    grid = total.withColumn("__u", F.lit(1)).join(units.withColumn("__u", F.lit(1)), "__u").drop("__u")
    j = grid.join(part.withColumnRenamed(unit, "rep"), ["rep", *keys], "left")
    return j.select("rep", *keys, *[(F.col(f"__{s}") - F.coalesce(s, F.lit(0))).alias(s) for s in sums])


def abba_baba(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column]:
    """Expected ABBA, BABA and BBAA patterns of four allele frequencies."""
    pair = lambda p, q, r, s: p * q * (1 - r) * (1 - s) + (1 - p) * (1 - q) * r * s
    return pair(b, c, a, d), pair(a, c, b, d), pair(a, b, c, d)


def d_statistic(sites: DataFrame, a: str, b: str, c: str, d: str, by: Sequence[str]) -> DataFrame:
    """(by, abba, baba, bbaa, n, d) from frequency columns; sites with a missing one are left out."""
    x = sites.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(c).isNotNull() & F.col(d).isNotNull())
    p = abba_baba(*[F.col(k) for k in (a, b, c, d)])
    g = x.groupBy(*by).agg(*[F.sum(v).alias(n) for n, v in zip(("abba", "baba", "bbaa"), p)], F.count(F.lit(1)).alias("n"))
    return g.withColumn("d", (F.col("abba") - F.col("baba")) / F.nullif(F.col("abba") + F.col("baba"), F.lit(0.0)))


def d_block_jackknife(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, d, sterr) from per-block abba and baba: leave-one-out as total minus part."""
    w = Window.partitionBy(*keys)
    out = blocks.withColumns({f"__{c}": F.sum(c).over(w) for c in ("abba", "baba")})
    ratio = lambda x, y: (x - y) / F.nullif(x + y, F.lit(0.0))
    out = out.withColumn("__all", ratio(F.col("__abba"), F.col("__baba"))).withColumn("__loo", ratio(F.col("__abba") - F.col("abba"), F.col("__baba") - F.col("baba")))
    n = F.count("__loo")
    return out.groupBy(*keys).agg(F.first("__all").alias("d"), F.sqrt(F.var_pop("__loo") * (n - 1)).alias("sterr"))


def f4_ratio(f4s: DataFrame, num: tuple[str, str, str, str], den: tuple[str, str, str, str], by: Sequence[str] = ("rep", "sex_chrom")) -> DataFrame:
    pick = lambda q: F.sum(F.when((F.col("A") == q[0]) & (F.col("B") == q[1]) & (F.col("C") == q[2]) & (F.col("D") == q[3]), F.col("f4")))
    return f4s.groupBy(*by).agg((pick(num) / F.nullif(pick(den), F.lit(0.0))).alias("ratio"))


def derived_given_het(sfs: DataFrame, pop: str) -> DataFrame:
    """Share of derived alleles of the target at sites where ``pop`` is heterozygous: Σ tau · n / Σ n over such classes."""
    het = sfs.where((F.col(f"{pop}_anc") == 1) & (F.col(f"{pop}_der") == 1))
    return het.groupBy("sex_chrom").agg((F.sum(F.col("tau") * F.col("n_snps")) / F.nullif(F.sum("n_snps"), F.lit(0))).alias("f"), F.sum("n_snps").alias("n_snps"))
