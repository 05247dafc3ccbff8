"""The whole job: fits that end at the tolerance, counts of any depth, draws without a cap."""

import inspect
import math

import numpy as np
from pyspark.sql import functions as F

from strandline.__main__ import hmm_config, parser
from strandline.functions import likelihood as L
from strandline.operators import hmm as H
from strandline.operators import sfs as M
from strandline.operators.impute import fill_category
from strandline.operators.panelstats import fake_contamination, poisson_inverse
from strandline.pipelines import HmmConfig, SfsConfig
from strandline.states import StateSpace


def test_em_defaults():
    for c in (HmmConfig(), SfsConfig()):
        assert (c.max_iter, c.ll_tol) == (1000, 0.01)
    for f, tol in ((H.fit_hmm, "tol"), (M.fit_sfs, "ll_tol")):
        p = inspect.signature(f).parameters
        assert (p["max_iter"].default, p[tol].default) == (1000, 0.01)


def test_options_keep_preset():
    base = ["hmm", "--panel", "p", "--target", "t", "--out", "o"]
    c = lambda *x: hmm_config(parser().parse_args([*base, *x]), ("AFR", "NEA", "DEN"))
    assert (c().max_iter, c().replicates, c().bin_size) == (1000, 100, 0.01)
    assert (c("--preset", "basic").max_iter, c("--preset", "basic").replicates) == (250, 200)
    assert c("--preset", "basic", "--max-iter", "7").max_iter == 7
    assert not c("--preset", "fixed").est_cont and c("--preset", "genotypes").high_cov is None
    assert (c("--pos-mode").by, c("--pos-mode").bin_size) == ("pos", 10_000)


def hmm_data(spark):
    rng = np.random.default_rng(1)
    rows = [("1", i // 2, i, "l", int(n), int(a), 0.3, int(k), 20 - int(k), 4 if i < 40 else 0, 0 if i < 40 else 4) for i, (n, a, k) in enumerate(zip(rng.integers(0, 4, 80), rng.integers(0, 4, 80), rng.integers(0, 21, 80)))]
    d = spark.createDataFrame(rows, "chrom string, bin long, pos long, lib string, tref long, talt long, p_cont double, AFR_alt int, AFR_ref int, NEA_alt int, NEA_ref int")
    return d.select("chrom", "bin", "pos", "lib", "tref", "talt", "p_cont"), d.drop("lib", "tref", "talt", "p_cont"), d.select("chrom", "bin").distinct()


def test_hmm_fit_ends_at_tolerance(spark):
    space = StateSpace(("AFR", "NEA"))
    fit = H.fit_hmm(*hmm_data(spark), space, H.HmmParams.initial(space, ["l"]))
    assert fit.converged and len(fit.ll) > 2 and abs(fit.ll[-1] - fit.ll[-2]) < 0.01
    assert fit.ll[-1] > fit.ll[0]
    cut = H.fit_hmm(*hmm_data(spark), space, H.HmmParams.initial(space, ["l"]), max_iter=1)
    assert not cut.converged and np.allclose(cut.ll, fit.ll[:2])


def test_sfs_replicates_end_each_at_tolerance(spark):
    # replicate 0 starts at its optimum, replicate 1 does not
    rows = [(r, s, s % 2, "r0", 1.0, False, False, 3 if s % 3 else 0, 1 if s % 2 else 3) for r in "01" for s in range(12)]
    d = spark.createDataFrame(rows, "rep string, snp long, sfs int, rg string, psi double, flipped boolean, haploid boolean, ref long, alt long")
    start = lambda t: M.SfsParams({"r0": 0.3}, {0: t, 1: t}, {0: 0.5, 1: 0.5})
    near = M.fit_sfs(d.where("rep = '0'"), {"0": start(0.4)})[0]["0"]
    fits, _ = M.fit_sfs(d, {"0": near, "1": start(0.9)})
    assert fits["0"].converged and fits["1"].converged
    again = M.em_step(d, fits, M.SfsUpdates())
    assert all(abs(M.em_step(d, again, M.SfsUpdates())[r].ll - fits[r].ll) < 0.02 for r in fits)
    assert not any(p.converged for p in M.fit_sfs(d, {"0": start(0.4), "1": start(0.9)}, max_iter=1)[0].values())


def test_read_cells_keep_the_step(spark):
    d = spark.createDataFrame([("0", s, s % 2, f"r{s % 3}", s % 4 / 3, s % 5 == 0, False, s % 4, s % 3) for s in range(40)], "rep string, snp long, sfs int, rg string, psi double, flipped boolean, haploid boolean, ref long, alt long")
    p = {"0": M.SfsParams({f"r{i}": 0.2 for i in range(3)}, {0: 0.3, 1: 0.6}, {0: 0.1, 1: 0.2})}
    a, b = M.em_step(d, p, M.SfsUpdates())["0"], M.em_step(d, p, M.SfsUpdates(), M.read_cells(d))["0"]
    assert np.allclose(a.vector(), b.vector())
    c = M.group_stats(M.read_posteriors(d, p)).orderBy("rg").toPandas()
    assert np.allclose(c["c"], [b.cont[k] for k in c["rg"]])


def test_fake_contamination_has_no_cap(spark):
    for depth, share in ((10, 0.1), (60, 0.6), (900, 0.5), (2000, 0.5)):
        d = spark.range(4000).select(F.col("id").alias("pos"), F.lit(0).alias("tref"), F.lit(depth).alias("talt"), F.lit(0.5).alias("p"))
        lam = share * depth / (1 - share) / 2
        x = fake_contamination(d, ["pos"], "p", share).select((F.col("talt") - depth).alias("a"), F.col("tref").alias("r"))
        for c in ("a", "r"):
            mean, var = x.agg(F.avg(c), F.var_samp(c)).first()
            assert abs(mean - lam) < 5 * (lam / 4000) ** 0.5 and abs(var / lam - 1) < 0.15, (depth, share, mean, var)


def test_poisson_inverse_is_the_quantile(spark):
    rng = np.random.default_rng(0)
    rows = [(float(u), float(r)) for u, r in zip([0.0, 1 - 2.0**-32, *rng.random(200)], [16.0, 16.0, *rng.random(200) * 16])]
    for u, r, k in spark.createDataFrame(rows, "u double, r double").select("u", "r", poisson_inverse(F.col("u"), F.col("r"))).collect():
        cdf = np.cumsum([math.exp(-r + i * math.log(r) - math.lgamma(i + 1)) for i in range(100)])
        assert abs(k - int((cdf < u).sum())) <= (1 if np.abs(cdf - u).min() < 1e-12 else 0)


def test_likelihood_of_deep_counts(spark):
    rows = [(n, k) for n in (0, 29, 255, 256, 257, 1031, 60367, 10_000_000) for k in {0, n // 3, n}]
    d = spark.createDataFrame(rows, "n long, k long")
    lg = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    for n, k, c, p in d.select("n", "k", L.log_choose(F.col("n"), F.col("k")), L.read_likelihood(1, F.col("k"), F.col("n"), F.lit(0.2), 0.0, 0.0)).collect():
        assert np.isclose(c, lg(n, k), rtol=1e-12, atol=1e-7)
        assert np.isclose(p, math.exp(lg(n, k) + n * math.log(0.5)), rtol=1e-6, atol=1e-200)
    assert d.select(L.log_choose(F.lit(None).cast("long"), F.col("k"))).first()[0] is None
    obs = spark.createDataFrame([(1, 200, 200, 0.3), (1, 2, 3, 0.3)], "pos int, tref long, talt long, p double")
    row = H.snp_log_likelihood(obs, ["pos"], "p", F.lit(0.02), F.lit(0.01)).first()
    q = (0.02 * 0.3 + 0.98 * 0.5) * 0.98 + 0.01
    assert np.isclose(row["l1"], lg(400, 200) + lg(5, 3) + 203 * math.log(q) + 202 * math.log(1 - q))


def test_registered_draws_have_all_replicates(spark, monkeypatch):
    from strandline.queries import hmm as Q

    e = spark.createDataFrame([("1", i, [0.0, -1.0, -2.0]) for i in range(4)], "chrom string, bin_in_chrom long, e array<double>")
    monkeypatch.setattr(Q, "emissions", lambda s, d: e)
    assert Q.QUERIES["posterior_runs"][0](spark, "").select("it").distinct().count() == HmmConfig().replicates == 100
    asked = []
    monkeypatch.setattr(Q.H, "posterior_runs", lambda *a: asked.append(a[-1]) or e.select(F.lit(0).alias("it"), F.lit("AFR").alias("state"), F.lit(0).alias("start"), F.lit(1).alias("len")))
    Q.state_occupancy(spark, "")
    assert asked == [100]


def test_category_fill_takes_unseen_categories(spark):
    # one rare value in the cell (a, 2); 'x' is all of group a else, and of the rest
    rows = [("a", 1, "x")] * 99 + [("a", 2, "y"), ("a", 2, None)] + [("b", 1, "z"), ("b", 1, None)]
    df = spark.createDataFrame(rows, "g string, t int, v string")
    got = lambda d, s: {(r.g, r.t): r.filled for r in fill_category(d, "v", ["g"], ["t"], strength=s).where("is_filled").collect()}
    assert got(df, 10.0) == {("a", 2): "x", ("b", 1): "x"}
    assert got(df, 0.1) == {("a", 2): "y", ("b", 1): "z"}
    # more categories than 1,000: the smaller of two equal ones, both beyond the first thousand
    many = [("g", 1, f"c{i:04d}") for i in range(1200) for _ in range(2)] + [("h", 1, "d1"), ("h", 1, "d0"), ("h", 1, None)]
    assert got(spark.createDataFrame(many, "g string, t int, v string"), 0.1) == {("h", 1): "d0"}
