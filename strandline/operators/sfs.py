"""Conditional site-frequency-spectrum model: one aggregation job per EM step, all replicates at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import likelihood as L
from strandline.numeric import squarem_step
from strandline.operators.sfs_pass import em_sums, pack
from strandline.operators.sites import polarize
from strandline.plans.quantiles import quantiles
from strandline.plans.tables import materialise

SEX = ("X", "Y", "Z", "W")
EPS = 1e-10


def categories(sites: DataFrame, pops: Sequence[str], anc: str, order: str = "site_id") -> DataFrame:
    """``sites`` polarised by ``anc``, with sex_chrom and ``sfs``: the number of its (sex_chrom, counts) class by first appearance."""
    p = polarize(sites, pops, anc).withColumn("sex_chrom", F.when(F.col("chrom").isin(*SEX), "sex").otherwise("autosome"))
    key = ["sex_chrom", *[f"{x}_{a}" for x in pops for a in ("anc", "der")]]
    # classes are few: one row each reaches the global window
    c = p.groupBy(*key).agg(F.min(order).alias("__first")).withColumn("sfs", F.row_number().over(Window.orderBy("__first")) - 1).drop("__first")
    return p.join(c, key)


@dataclass
class SfsParams:
    """Contamination per read group, tau and F per class, error away from (e) and towards (b) the reference allele."""

    cont: dict[str, float]
    tau: dict[int, float]
    f: dict[int, float]
    e: float = 0.01
    b: float = 0.01
    ll: float = field(default=float("nan"), compare=False)
    converged: bool = field(default=False, compare=False)

    def vector(self) -> np.ndarray:
        return np.array([*self.cont.values(), *self.tau.values(), *self.f.values(), self.e, self.b])

    def replaced(self, v: np.ndarray) -> SfsParams:
        v = np.clip(v, EPS, 1 - EPS)
        n, k = len(self.cont), len(self.tau)
        return SfsParams(dict(zip(self.cont, v[:n].tolist())), dict(zip(self.tau, v[n : n + k].tolist())), dict(zip(self.f, v[n + k : n + 2 * k].tolist())), float(v[-2]), float(v[-1]))


@dataclass(frozen=True)
class SfsUpdates:
    cont: bool = True
    tau: bool = True
    f: bool = True
    error: bool = True
    bias: bool = True


def _lookup(params: Mapping[str, SfsParams], get, key: Column) -> Column:
    pairs = [(f"{r}|{k}" if k != "" else r, float(v)) for r, p in params.items() for k, v in get(p).items()]
    return F.element_at(F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.lit(v))]), key)


def with_params(data: DataFrame, params: Mapping[str, SfsParams]) -> DataFrame:
    """``data`` with c, tau, f, e, b of its replicate, read group and class, as literals: no join."""
    rep = F.col("rep")
    return (
        data.withColumn("c", _lookup(params, lambda p: p.cont, F.concat_ws("|", rep, "rg")))
        .withColumn("tau", _lookup(params, lambda p: p.tau, F.concat_ws("|", rep, "sfs")))
        .withColumn("f", _lookup(params, lambda p: p.f, F.concat_ws("|", rep, "sfs")))
        .withColumn("e", _lookup(params, lambda p: {"": p.e}, rep))
        .withColumn("b", _lookup(params, lambda p: {"": p.b}, rep))
    )


def genotype_prior() -> tuple[Column, Column, Column]:
    t = F.col("tau")
    g = L.sfs_genotype_prior(t, F.col("f"))
    return F.when(F.col("haploid"), 1 - t).otherwise(g[0]), F.when(F.col("haploid"), 0.0).otherwise(g[1]), F.when(F.col("haploid"), t).otherwise(g[2])


def _read(allele: int) -> tuple[Column, Column]:
    return L.read_given_allele(F.lit(allele), F.col("flipped"), F.col("e"), F.col("b"))


def site_posteriors(data: DataFrame, params: Mapping[str, SfsParams]) -> DataFrame:
    """(rep, snp, sfs, g0, g1, g2, ll): posterior genotypes of every site and the log of their sum.

    ``data`` has rep, snp, sfs, rg, psi, flipped, haploid and the read counts ref and alt, one row per site and read group.
    """
    d = with_params(data, params)
    prior = genotype_prior()
    logs = []
    for g in range(3):
        total = F.lit(0.0)
        for allele, n in ((0, "ref"), (1, "alt")):
            p = L.read_given_genotype(*_read(allele), F.col("psi"), F.col("c"))[g]
            total = total + F.when(F.col(n) > 0, F.col(n) * L.safe_ln(p)).otherwise(0.0)
        logs.append(F.sum(total).alias(f"l{g}"))
    s = d.groupBy("rep", "snp", "sfs").agg(*logs, *[F.first(p).alias(f"p{g}") for g, p in enumerate(prior)])
    top = F.greatest("l0", "l1", "l2")
    w = [F.exp(F.col(f"l{g}") - top) * F.col(f"p{g}") for g in range(3)]
    s = s.withColumn("__t", top).withColumns({f"w{g}": x for g, x in enumerate(w)}).withColumn("__s", F.col("w0") + F.col("w1") + F.col("w2"))
    return s.select("rep", "snp", "sfs", *[(F.col(f"w{g}") / F.nullif("__s", F.lit(0.0))).alias(f"g{g}") for g in range(3)], (L.safe_ln(F.col("__s")) + F.col("__t")).alias("ll"))


def read_posteriors(data: DataFrame, params: Mapping[str, SfsParams]) -> DataFrame:
    """One row per site, read group and allele with ``n`` reads: allele, post_c (contaminant) and post_der (derived)."""
    d = with_params(data, params)
    prior = genotype_prior()
    endo = L.derived_freq(prior)
    rows = []
    for allele, n in ((0, "ref"), (1, "alt")):
        anc, der = _read(allele)
        cont = F.col("c") * ((1 - F.col("psi")) * anc + F.col("psi") * der)
        own = (1 - F.col("c")) * ((1 - endo) * anc + endo * der)
        x = F.col("c") * F.col("psi") + (1 - F.col("c")) * endo
        both = F.nullif((1 - x) * anc + x * der, F.lit(0.0))
        rows.append(F.struct(F.lit(allele).alias("allele"), F.col(n).alias("n"), (cont / F.nullif(cont + own, F.lit(0.0))).alias("post_c"), (x * der / both).alias("post_der")))
    return d.withColumn("x", F.explode(F.array(*rows))).where("x.n > 0").select("rep", "snp", "sfs", "rg", "flipped", "x.*")


def class_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("rep", "sfs").agg(*[F.sum(f"g{g}").alias(f"g{g}") for g in range(3)], F.count(F.lit(1)).alias("n_snps"), F.sum("ll").alias("ll"))


def tau_f_update(g0: Column, g1: Column, g2: Column) -> tuple[Column, Column]:
    """Closed-form maximum of tau and F from expected genotype counts."""
    n = F.nullif(g0 + g1 + g2, F.lit(0.0))
    t = (g1 / 2 + g2) / n
    het = F.nullif(2 * t * (1 - t) * n, F.lit(0.0))
    return t, F.least(F.greatest(1 - g1 / het, F.lit(0.0)), F.lit(1.0))


def group_stats(reads: DataFrame) -> DataFrame:
    """(rep, rg, c, n): mean posterior contamination of a read group's reads."""
    return reads.groupBy("rep", "rg").agg((F.sum(F.col("n") * F.col("post_c")) / F.sum("n")).alias("c"), F.sum("n").alias("n"))


def error_stats(reads: DataFrame) -> DataFrame:
    """(rep, err, ok, bias, nobias): expected reads with and without an error from each true allele."""
    return reads.groupBy("rep").agg(*_error_sums())


def _error_sums() -> list[Column]:
    n = F.col("n")
    is_ref = F.when(F.col("flipped"), F.col("post_der")).otherwise(1 - F.col("post_der"))  # the true allele is the reference one
    alt = F.col("allele") == 1
    s = lambda c, w: F.sum(F.when(c, n * w).otherwise(0.0))
    return [s(alt, is_ref).alias("err"), s(~alt, is_ref).alias("ok"), s(~alt, 1 - is_ref).alias("bias"), s(alt, 1 - is_ref).alias("nobias")]


def read_cells(data: DataFrame) -> DataFrame:
    """``data`` summed over sites whose reads have the same posterior: all that contamination and errors need of it."""
    return data.groupBy("rep", "sfs", "rg", "psi", "flipped", "haploid").agg(F.sum("ref").alias("ref"), F.sum("alt").alias("alt")).withColumn("snp", F.lit(None).cast("long"))


def em_step(data: DataFrame, params: Mapping[str, SfsParams], on: SfsUpdates, cells: DataFrame | None = None) -> dict[str, SfsParams]:
    """New parameters of every replicate; ``ll`` is the likelihood of the old ones. Only sums reach the driver.

    ``cells`` are the ``read_cells`` of ``data``, where they are at hand.
    """
    s = class_stats(site_posteriors(data, params)).toPandas()
    x = None
    if on.cont or on.error:
        reads = read_posteriors(data if cells is None else cells, params)
        x = reads.groupBy("rep", "rg").agg(F.sum(F.col("n") * F.col("post_c")).alias("c"), F.sum("n").alias("n"), *_error_sums()).toPandas()
    return _m_step(params, on, s, x)


def _m_step(params: Mapping[str, SfsParams], on: SfsUpdates, s: pd.DataFrame, x: pd.DataFrame | None) -> dict[str, SfsParams]:
    """New parameters from sums per class (g0, g1, g2, ll) and, where needed, per read group (c, n, err, ok, bias, nobias)."""
    new = {r: SfsParams(dict(p.cont), dict(p.tau), dict(p.f), p.e, p.b) for r, p in params.items()}
    for r, p in new.items():
        own = s[s["rep"] == r]
        p.ll = float(own["ll"].sum())
        for k, g0, g1, g2 in own[["sfs", "g0", "g1", "g2"]].itertuples(index=False):
            n = g0 + g1 + g2
            if not n > 0:
                continue
            t = (g1 / 2 + g2) / n
            het = 2 * t * (1 - t) * n
            if on.tau:
                p.tau[int(k)] = float(np.clip(t, EPS, 1 - EPS))
            if on.tau and on.f and het != 0:
                p.f[int(k)] = float(np.clip(1 - g1 / het, EPS, 1 - EPS))
    if x is not None:
        if on.cont:
            for row in x[x["n"] > 0].itertuples():
                new[row.rep].cont[row.rg] = float(row.c / row.n)
        if on.error:
            for rep, row in x.groupby("rep")[["err", "ok", "bias", "nobias"]].sum().iterrows():
                p, (err, ok, bias, nobias) = new[rep], map(float, row)
                if on.bias:
                    p.e, p.b = (err / (err + ok) if err + ok > 0 else 0.0), (bias / (bias + nobias) if bias + nobias > 0 else 0.0)
                else:
                    p.e = p.b = (err + bias) / (err + ok + bias + nobias)
    return new


def call_em_step(calls: DataFrame, params: Mapping[str, SfsParams], on: SfsUpdates, random_read: bool = False) -> dict[str, SfsParams]:
    """The step in genotype mode: classes from posterior genotypes, errors from homozygous ones. Only sums reach the driver."""
    new = {r: SfsParams(dict(p.cont), dict(p.tau), dict(p.f), p.e, p.b) for r, p in params.items()}
    post = call_posteriors(calls, params, random_read)
    t, f = tau_f_update(F.col("g0"), F.col("g1"), F.col("g2"))
    s = class_stats(post).select("rep", "sfs", "ll", t.alias("t"), f.alias("f")).toPandas()
    for row in s.itertuples():
        p = new[row.rep]
        p.ll = row.ll + (0.0 if np.isnan(p.ll) else p.ll)
        if on.tau and row.t == row.t and row.t is not None:
            p.tau[int(row.sfs)] = float(np.clip(row.t, EPS, 1 - EPS))
        if on.tau and on.f and row.f == row.f and row.f is not None:
            p.f[int(row.sfs)] = float(np.clip(row.f, EPS, 1 - EPS))
    if on.error:
        for row in call_error_stats(post, random_read).toPandas().itertuples():
            p = new[row.rep]
            ratio = lambda a, b: float(a / (a + b)) if a + b > 0 else 0.0
            if on.bias:
                p.e, p.b = ratio(row.err, row.ok), ratio(row.bias, row.nobias)
            else:
                p.e = p.b = ratio(row.err + row.bias, row.ok + row.nobias)
    return new


def fit_sfs(
    data: DataFrame, params: Mapping[str, SfsParams], on: SfsUpdates = SfsUpdates(), max_iter: int = 1000, ll_tol: float = 1e-2, accelerate: bool = True, calls: bool = False, random_read: bool = False
) -> tuple[dict[str, SfsParams], list[float]]:
    """EM for all replicates in lockstep, with squared extrapolation that is kept only where the likelihood rises.

    A replicate leaves when its own log-likelihood changes by less than ``ll_tol``; ``converged`` is false for those that
    ``max_iter`` ends. ``data`` is read twice, to count and to pack it in blocks; a step is then one job of one stage over the
    blocks (``sfs_pass``). With ``calls`` it has one called genotype per site (genotype mode) and is materialised once. Returns
    parameters and the log-likelihoods of replicate '0' (or the first).
    """
    data = materialise(data) if calls else pack(data)
    first = "0" if "0" in params else next(iter(params))

    def step(p: Mapping[str, SfsParams]) -> dict[str, SfsParams]:
        if calls:
            return call_em_step(data.where(F.col("rep").isin(*p)), p, on, random_read)
        s, x = em_sums(data, p, on.cont or on.error)
        return _m_step(p, on, s, x if on.cont or on.error else None)

    cur, done, last, lls = dict(params), {}, {}, []
    for _ in range(max_iter):
        x1 = step(cur)
        if first in x1:
            lls.append(x1[first].ll)
        done |= {r: replace(cur[r], ll=p.ll, converged=True) for r, p in x1.items() if r in last and abs(p.ll - last[r]) < ll_tol}
        last = {r: p.ll for r, p in x1.items()}
        cur, x1 = ({r: p for r, p in x.items() if r not in done} for x in (cur, x1))
        if not cur:
            break
        if not accelerate:
            cur = x1
            continue
        x2 = step(x1)
        fast = {r: x1[r].replaced(squarem_step(cur[r].vector(), x1[r].vector(), x2[r].vector())) for r in cur}
        x3 = step(fast)  # also stabilises the jump
        cur = {r: x3[r] if x3[r].ll >= x2[r].ll else x2[r] for r in cur}
    fits = cur | done
    return {r: fits[r] for r in params}, lls


def jackknife(data: DataFrame, blocks: int, order: str = "snp") -> DataFrame:
    """``data`` with rep '0' (all) and '1' … 'blocks', each without one contiguous part of the sites, of about equally many rows."""
    cuts = quantiles(data, order, [i / blocks for i in range(1, blocks)]) if blocks > 1 else []
    part = sum((F.when(F.col(order) > c, 1).otherwise(0) for c in cuts if c is not None), F.lit(1))
    reps = F.transform(F.filter(F.sequence(F.lit(0), F.lit(blocks)), lambda r: r != part), lambda r: r.cast("string"))
    return data.drop("rep").withColumn("rep", F.explode(reps))


def standard_errors(fits: Mapping[str, SfsParams]) -> np.ndarray:
    """Jackknife standard error of the parameter vector, centred on the full estimate."""
    full = fits["0"].vector()
    x = np.array([p.vector() for r, p in fits.items() if r != "0"])
    n = len(x)
    return np.sqrt((n - 1) / n * ((x - full) ** 2).sum(axis=0))


def sfs_table(data: DataFrame, params: Mapping[str, SfsParams]) -> DataFrame:
    """(rep, sfs, n_snps, n_reads, n_endo, read_ratio, cont_est, tau, psi) per class."""
    d = with_params(data, params)
    n = F.col("ref") + F.col("alt")
    der = F.when(F.col("flipped"), F.col("ref")).otherwise(F.col("alt"))
    g = d.groupBy("rep", "sfs").agg(F.countDistinct("snp").alias("n_snps"), F.sum(n).alias("n_reads"), F.sum(n * (1 - F.col("c"))).alias("n_endo"), (F.sum(der) / F.nullif(F.sum(n), F.lit(0))).alias("read_ratio"), F.first("tau").alias("tau"))
    g = g.withColumn("cont_est", 1 - F.col("n_endo") / F.nullif("n_reads", F.lit(0)))
    return g.withColumn("psi", F.col("tau") + (F.col("read_ratio") - F.col("tau")) / F.nullif("cont_est", F.lit(0.0)))


def call_posteriors(calls: DataFrame, params: Mapping[str, SfsParams], random_read: bool = False) -> DataFrame:
    """Genotype mode: (rep, snp, sfs, alt, flipped, g0, g1, g2, ll) from one called genotype per site."""
    d = with_params(calls, params)
    f = L.random_call_given_genotype if random_read else L.call_given_genotype
    lik = f(F.col("alt"), F.col("flipped"), F.col("e"), F.col("b"))
    w = [a * b for a, b in zip(lik, genotype_prior())]
    total = F.nullif(w[0] + w[1] + w[2], F.lit(0.0))
    return d.select("rep", "snp", "sfs", "alt", "flipped", *[(x / total).alias(f"g{i}") for i, x in enumerate(w)], L.safe_ln(w[0] + w[1] + w[2]).alias("ll"))


def call_error_stats(post: DataFrame, random_read: bool = False) -> DataFrame:
    """(rep, err, ok, bias, nobias) in genotype mode, from the homozygous posteriors; a random read shows one allele or none."""
    flip = F.col("flipped")
    ref_hom = F.when(flip, F.col("g2")).otherwise(F.col("g0"))
    alt_hom = F.when(flip, F.col("g0")).otherwise(F.col("g2"))
    s = lambda c, w: F.sum(F.when(c, w).otherwise(0.0))
    a = F.col("alt")
    alt = a != 0 if random_read else a == 2
    return post.groupBy("rep").agg(s(a != 0, ref_hom).alias("err"), s(a == 0, ref_hom).alias("ok"), s(~alt, alt_hom).alias("bias"), s(alt, alt_hom).alias("nobias"))


def call_table(calls: DataFrame, params: Mapping[str, SfsParams], random_read: bool = False) -> DataFrame:
    """(rep, sfs, n_snps, n_anc, n_der, read_ratio, tau, f) per class in genotype mode; n_anc and n_der count alleles."""
    most = 1 if random_read else 2
    shown = F.when(F.col("alt") != 0, 1).otherwise(0) if random_read else F.col("alt")
    der = F.when(F.col("flipped"), most - shown).otherwise(shown)
    g = with_params(calls, params).groupBy("rep", "sfs").agg(F.countDistinct("snp").alias("n_snps"), F.sum(most - der).alias("n_anc"), F.sum(der).alias("n_der"), F.first("tau").alias("tau"), F.first("f").alias("f"))
    return g.withColumn("read_ratio", F.col("n_der") / F.nullif(F.col("n_anc") + F.col("n_der"), F.lit(0)))


def site_table(sites: DataFrame, data: DataFrame, post: DataFrame) -> DataFrame:
    """One row per site of replicate '0': coordinates, reads, log10 posterior genotypes, derived share, a random draw and its class.

    ``sites`` has snp, chrom, pos, ref, alt and flipped; the draw is by a hash of the site."""
    from strandline.operators.extras import log10_table
    from strandline.operators.panelstats import md5_uniform

    reads = data.where("rep = '0'").groupBy("snp").agg(F.sum("ref").alias("tref"), F.sum("alt").alias("talt"))
    p = F.col("g1") / 2 + F.col("g2")
    share_alt = F.when(F.col("flipped"), 1 - p).otherwise(p)
    own = post.where("rep = '0'").select("snp", "sfs", "g0", "g1", "g2")
    j = sites.join(reads, "snp").join(own, "snp")
    return j.select("snp", *[c for c in sites.columns if c != "snp"], "tref", "talt", *[x.alias(f"log_g{g}") for g, x in enumerate(log10_table([F.col(f"g{g}") for g in range(3)]))], p.alias("p"), F.when(md5_uniform(F.lit("site"), F.col("snp")) < share_alt, 1).otherwise(0).alias("random_read"), "sfs")


def class_table(sites: DataFrame, data: DataFrame, params: Mapping[str, SfsParams], pops: Sequence[str]) -> DataFrame:
    """(rep, sfs, sex_chrom, counts per population, n_snps, tau): what the f-statistics of every replicate need."""
    kinds = sites.select("sfs", "sex_chrom", *[f"{p}_{a}" for p in pops for a in ("anc", "der")]).distinct()
    n = data.groupBy("rep", "sfs").agg(F.countDistinct("snp").alias("n_snps"))
    tau = F.element_at(F.create_map(*[x for r, p in params.items() for k, v in p.tau.items() for x in (F.lit(f"{r}|{k}"), F.lit(v))]), F.concat_ws("|", "rep", "sfs"))
    return n.withColumn("tau", tau).join(kinds, "sfs")


def convergence_rows(params: Mapping[str, SfsParams]) -> list[tuple[str, str, float]]:
    """(parameter, name, value): one row per replicate, value 1 where its fit converged."""
    return [("converged", r, float(p.converged)) for r, p in params.items()]


def to_frame(params: Mapping[str, SfsParams]) -> pd.DataFrame:
    rows = [(r, "cont", k, v) for r, p in params.items() for k, v in p.cont.items()]
    rows += [(r, n, str(k), v) for r, p in params.items() for n in ("tau", "f") for k, v in getattr(p, n).items()]
    rows += [(r, n, "", getattr(p, n)) for r, p in params.items() for n in ("e", "b")]
    return pd.DataFrame(rows, columns=["rep", "parameter", "name", "value"])
