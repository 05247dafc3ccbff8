"""Results that must not depend on how rows are spread, and fits that run in few jobs."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import fstats as FS
from strandline.operators import hmm as H
from strandline.operators import hmm_pass as HP
from strandline.operators import sfs as M
from strandline.operators import sfs_pass as MP
from strandline.states import StateSpace


def jobs(spark, f):
    """Result of ``f`` and the number of its Spark jobs."""
    import uuid

    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    try:
        return f(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("", "")


SPACE = StateSpace(("A", "B"))


def reads(spark):
    """Two chromosomes, X with few bins, of bins without sites, sites without reads and sites of one or two libraries."""
    rng = np.random.default_rng(7)
    bins = [(c, b) for c, n in (("1", 90), ("X", 11)) for b in range(n)]
    sites = [(c, b, 100 * b + i, *map(int, rng.integers(0, 5, 4))) for c, b in bins if b % 7 for i in range(b % 3 + 1)]
    obs = [(c, b, pos, lib, int(rng.integers(0, 4)), int(rng.integers(0, 4)), float(rng.choice([0.05, 0.3, 0.8]))) for c, b, pos, *_ in sites if pos % 5 for lib in ("l", "m")[: 1 + pos % 2]]
    o = spark.createDataFrame(obs, "chrom string, bin int, pos int, lib string, tref int, talt int, p_cont double")
    s = spark.createDataFrame(sites, "chrom string, bin int, pos int, A_alt int, A_ref int, B_alt int, B_ref int")
    return o, s, spark.createDataFrame(bins, "chrom string, bin int")


@pytest.mark.parametrize("calls", [False, True])
def test_packed_pass_equals_the_expressions(spark, calls, monkeypatch):
    monkeypatch.setattr(HP, "CHUNK", 32)
    obs, snps, bins = reads(spark)
    hap, site = ("X",), ["chrom", "bin", "pos"]
    p = replace(H.HmmParams.initial(SPACE, ["l", "m"], off=0.1, f=0.2, tau=-0.5), cont={"l": 0.1, "m": 0.3}, error={"l": 0.02, "m": 0.04})
    sums, by_read, drift = HP.em_sums(HP.pack(obs, snps, bins, SPACE, ["chrom"], 0.5, calls), SPACE, p, ["chrom"], hap, calls, True, True)
    states = H.state_genotypes(SPACE, p.f, p.tau, 0.5, H.is_haploid(hap))
    lik = snps.join(H.snp_log_likelihood(obs, site, "p_cont", H._per_lib(p.cont, F.col("lib")), H._per_lib(p.error, F.col("lib")), calls), site)
    e = H.complete_bins(bins, H.bin_log_emissions(lik, ["chrom", "bin"], states), ["chrom", "bin"], SPACE.n)
    ll = {r.chrom: r.ll for r in H.sequence_ll(e, ["chrom"], "bin", p, hap).collect()}
    assert np.allclose([sums["two"][0], sums["hap"][0]], [ll["1"], ll["X"]], rtol=1e-10)
    xi = H.transition_counts(e, ["chrom"], "bin", p, hap).orderBy("i", "j").toPandas()
    for chrom, kind in (("1", "two"), ("X", "hap")):
        assert np.allclose(sums[kind][1:], xi[xi["chrom"] == chrom]["xi"], atol=1e-8)
    pg = H.posterior_genotypes(lik, H.decode(e, ["chrom"], "bin", p, SPACE.names, hap), ["chrom", "bin"], states, SPACE.names)
    want = H.drift_stats(pg, SPACE, 0.5, hap).toPandas().sort_values(["source", "a", "b"])
    assert np.allclose(drift.sort_values(["source", "a", "b"]).iloc[:, 1:].astype(float), want.iloc[:, 1:].astype(float), atol=1e-8)
    if not calls:
        want = H.contamination_stats(obs, pg, site).toPandas().sort_values(["lib", "p_cont", "g"])
        assert np.allclose(by_read.sort_values(["lib", "p_cont", "g"]).iloc[:, 1:].astype(float), want.iloc[:, 1:].astype(float), atol=1e-8)


@pytest.mark.parametrize("n", [1, 2, 3, 50, 1003])
def test_blocked_recursions_equal_the_plain_ones(n):
    rng = np.random.default_rng(n)
    e, t = rng.normal(0, 3, (n, 3)), np.array(((0.9, 0.06, 0.04), (0.1, 0.8, 0.1), (0.02, 0.03, 0.95)))
    want = H.forward_backward(e, t, np.array((0.2, 0.5, 0.3)))
    alpha, beta, norm = HP.forward_backward(H.scaled(e)[0], t, np.array((0.2, 0.5, 0.3)))
    assert np.allclose(alpha, want.alpha) and np.allclose(beta, want.beta) and np.allclose(norm, want.norm)


def test_an_iteration_of_the_hmm_is_one_job(spark):
    fit = lambda n: jobs(spark, lambda: H.fit_hmm(*reads(spark), SPACE, H.HmmParams.initial(SPACE, ["l", "m"]), max_iter=n, tol=0.0, est_error=True, est_tau=True))
    (few, n_few), (more, n_more) = fit(1), fit(5)
    assert len(more.ll) - len(few.ll) == 4 and n_more - n_few == 4
    assert few.ll == pytest.approx(more.ll[:2])


def test_f_statistics_do_not_depend_on_row_order(spark):
    rows = [("0", "autosome", 3, i % 7, 7 - i % 7, i % 3, 3 - i % 3, (i % 11) / 11.0, i * i + 1) for i in range(60)]
    pops, got = ["A", "B"], set()
    for order in (rows, rows[::-1], rows[::2] + rows[1::2], sorted(rows, key=lambda r: r[7])):
        d = spark.createDataFrame(order, "rep string, sex_chrom string, sfs int, A_anc int, A_der int, B_anc int, B_der int, tau double, n_snps long").coalesce(1)
        x = FS.f2(FS.pi_table(FS.class_freqs(d, pops), pops), [*pops, "target"])
        got.add(tuple(sorted((r["A"], r["B"], r["f2"]) for r in x.collect())))
    assert len(got) == 1


def sfs_reads(spark):
    """Two replicates of sites with one to three read groups, flipped and haploid ones, one without psi and one without reads."""
    rng = np.random.default_rng(5)
    rows = [
        (r, s, s % 3, g, None if s == 7 else float(rng.choice([0.0, 0.25, 1.0])), bool(s % 2), s % 5 == 0, *(0 if s == 8 else int(x) for x in rng.integers(0, 6, 2)))
        for r in "01"
        for s in range(60)
        if r == "0" or s % 4
        for g in ("r0", "r1", "r2")[: s % 3 + 1]
    ]
    return spark.createDataFrame(rows, "rep string, snp long, sfs int, rg string, psi double, flipped boolean, haploid boolean, ref long, alt long")


def sfs_start():
    return {r: M.SfsParams({"r0": 0.1, "r1": c, "r2": 0.4}, {0: 0.3, 1: t, 2: 0.0}, {0: 0.1, 1: 0.6, 2: 0.2}, 0.02, 0.03) for r, c, t in (("0", 0.2, 0.5), ("1", 0.3, 0.9))}


@pytest.mark.parametrize("bias", [True, False])
def test_packed_sfs_step_equals_the_expressions(spark, bias, monkeypatch):
    monkeypatch.setattr(MP, "BLOCK", 40)
    d, p, on = sfs_reads(spark), sfs_start(), M.SfsUpdates(bias=bias)
    packed = MP.pack(d)
    assert packed.count() > 2
    got, want = M._m_step(p, on, *MP.em_sums(packed, p, True)), M.em_step(d, p, on)
    for r in p:
        assert got[r].ll == pytest.approx(want[r].ll, rel=1e-10)
        assert np.allclose(got[r].vector(), want[r].vector(), atol=1e-10)
    only = MP.em_sums(packed, {"1": p["1"]}, False)
    assert set(only[0]["rep"]) == {"1"} and not len(only[1])


def test_a_step_of_the_sfs_is_one_job(spark):
    fit = lambda n: jobs(spark, lambda: M.fit_sfs(sfs_reads(spark), sfs_start(), max_iter=n, ll_tol=0.0, accelerate=False))
    (_, few), (_, more) = fit(1), fit(5)
    assert more - few == 4
