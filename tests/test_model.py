"""Golden values and brute force for the likelihoods, the HMM and the SFS model."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import likelihood as L
from strandline.numeric import chi2_tail_1, expm, fisher_exact, maximise_bounded, stationary
from strandline.operators import hmm as H
from strandline.operators import sfs as M
from strandline.operators.tracts import scoring_segments
from strandline.states import StateSpace, parse_chroms, parse_states


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


@pytest.mark.parametrize("t,f", [(0.4, 0.0), (0.2, 0.1), (0.0, 1.0), (1.0, 1.0)])
def test_genotype_prior(spark, t, f):
    got = one(spark, *L.sfs_genotype_prior(t, f))
    assert np.allclose(got, (f * (1 - t) + (1 - f) * (1 - t) ** 2, 2 * (1 - f) * t * (1 - t), f * t + (1 - f) * t * t))


def test_state_genotypes_sum_to_one(spark):
    a, b = F.lit(3.5), F.lit(0.5)
    for gs in (L.genotype_homozygous(a, b, 0.3, 0.7), L.genotype_heterozygous(a, b, b, a), L.genotype_haploid(a, b)):
        got = one(spark, *gs)
        assert abs(sum(got) - 1) < 1e-12 and min(got) >= 0


def test_read_likelihood_is_binomial(spark):
    p = [one(spark, L.read_likelihood(1, F.lit(k), F.lit(4), F.lit(0.2), 0.1, 0.01))[0] for k in range(5)]
    q = 0.1 * 0.2 + 0.9 * 0.5
    q = q * 0.99 + (1 - q) * 0.01
    assert np.allclose(p, [math.comb(4, k) * q**k * (1 - q) ** (4 - k) for k in range(5)])


def test_mixture_example(spark):
    # reads (alt, flipped, cont) and P(read | ancestral genotype)
    for alt, flip, c, want in ((0, False, 0.3, 0.7), (1, False, 0.0, 0.0), (1, False, 0.3, 0.3), (0, True, 0.0, 0.0)):
        pair = L.read_given_allele(F.lit(alt), F.lit(flip), 0.0, 0.0)
        assert np.isclose(one(spark, L.read_given_genotype(*pair, F.lit(1.0), F.lit(c))[0])[0], want)
    x0 = lambda g, c: c * 0 + (1 - c) * (1 - (g[1] / 2 + g[2]))
    assert np.allclose([x0((0, 0.5, 0.5), 0.3), x0((0, 0.5, 0.5), 0.0), x0((1, 0, 0), 0.3), x0((1 / 3,) * 3, 0.0)], [14 / 80, 20 / 80, 0.7, 0.5])


def sfs_data(spark, reads, snps, rgs, flipped, sfs, psi=1.0, haploid=()):
    n = {}
    for r, s, g in zip(reads, snps, rgs):
        n.setdefault((s, g), [0, 0])[r] += 1
    rows = [("0", s, sfs[s], f"r{g}", float(psi), flipped[s], s in haploid, a, b) for (s, g), (a, b) in n.items()]
    return spark.createDataFrame(rows, "rep string, snp long, sfs int, rg string, psi double, flipped boolean, haploid boolean, ref long, alt long")


def pars(cont, tau, f, e, b):
    return {"0": M.SfsParams({f"r{i}": c for i, c in enumerate(cont)}, dict(enumerate(tau)), dict(enumerate(f)), e, b)}


def test_shared_error(spark):
    d = sfs_data(spark, [0] * 4 + [1] * 4, [0] * 8, [0] * 6 + [1] * 2, [False], [0])
    p = M.em_step(d, pars([0, 0], [0], [0], 0.01, 0.001), M.SfsUpdates(cont=False, tau=False))["0"]
    # all true alleles are reference: half of the reads are errors, no alternative allele is ever true
    assert abs(p.e - 0.5) < 1e-9
    q = M.em_step(d, pars([0, 0], [0], [0], 0.01, 0.001), M.SfsUpdates(cont=False, tau=False, bias=False))["0"]
    assert q.e == q.b and abs(q.e - 0.5) < 1e-9


def test_error_and_bias(spark):
    d = sfs_data(spark, [0, 0, 0, 1, 1, 1, 0, 1, 1, 1], [0] * 6 + [1] * 4, [0] * 10, [False, True], [0, 0])
    p = M.em_step(d, pars([0], [0], [0], 0.5, 0.55), M.SfsUpdates(cont=False, tau=False))["0"]
    assert (round(p.e, 9), round(p.b, 9)) == (0.5, 0.25)
    q = M.em_step(d, pars([0], [0], [0], 0.5, 0.55), M.SfsUpdates(cont=False, tau=False, bias=False))["0"]
    assert abs(q.e - 0.4) < 1e-9


def test_contamination(spark):
    d = sfs_data(spark, [0] * 6 + [1, 1, 0, 0, 1, 1], [0] * 12, [0] * 6 + [1] * 4 + [2] * 2, [False], [0])
    p = M.em_step(d, pars([0.8, 0.5, 0.5], [0], [0], 0, 0), M.SfsUpdates(tau=False, error=False))["0"]
    assert np.allclose(list(p.cont.values()), [0, 0.5, 1])
    d = sfs_data(spark, [0] * 7 + [1] * 5, [0] * 10 + [1] * 2, [0] * 4 + [1] * 4 + [2] * 4, [False, True], [0, 0])
    p = M.em_step(d, pars([0.8, 0.5, 0.5], [0], [0], 0, 0), M.SfsUpdates(tau=False, error=False))["0"]
    assert np.allclose(list(p.cont.values()), [0, 0.25, 0.5])


def test_haploid_tau(spark):
    d = sfs_data(spark, [0] * 4 + [0, 0, 0, 1] + [1] * 4 + [0] * 3, [0] * 4 + [1] * 4 + [2] * 4 + [3] * 3, [0] * 8 + [1] * 7, [False] * 4, [0, 1, 0, 1], haploid=(2, 3))
    p, ll = pars([0, 0], [0.4, 0.1], [0.5, 0.5], 0, 0), []
    for _ in range(4):
        p = M.em_step(d, p, M.SfsUpdates(cont=False, error=False))
        ll.append(p["0"].ll)
    assert np.allclose(list(p["0"].tau.values()), [0.5, 0.25], atol=1e-4)
    assert ll == sorted(ll)


def test_closed_form_beats_grid(spark):
    for g in ((10.0, 3.0, 5.0), (1.0, 8.0, 2.0), (30.0, 0.5, 0.1)):
        t, f = one(spark, *M.tau_f_update(*[F.lit(x) for x in g]))

        def ll(t, f):
            c = (f * (1 - t) + (1 - f) * (1 - t) ** 2, 2 * (1 - f) * t * (1 - t), f * t + (1 - f) * t * t)
            return sum(n * math.log(max(x, 1e-300)) for n, x in zip(g, c))

        best = max(ll(a / 100, b / 100) for a in range(1, 100) for b in range(100))
        assert ll(t, f) >= best - 1e-3


def brute(e, t, s):
    k, n = e.shape[1], len(e)
    paths = list(itertools.product(range(k), repeat=n))
    first = s @ t
    w = np.array([first[p[0]] * np.exp(e[0, p[0]]) * np.prod([t[p[i - 1], p[i]] * np.exp(e[i, p[i]]) for i in range(1, n)]) for p in paths])
    gamma = np.array([[w[[p[i] == j for p in paths]].sum() for j in range(k)] for i in range(n)]) / w.sum()
    xi = np.array([[sum(w[m] * sum(p[i] == a and p[i + 1] == b for i in range(n - 1)) for m, p in enumerate(paths)) for b in range(k)] for a in range(k)]) / w.sum()
    return math.log(w.sum()), gamma, xi, paths[int(w.argmax())]


def test_hmm_against_enumeration():
    rng = np.random.default_rng(4)
    for _ in range(5):
        e, t, s = rng.normal(size=(5, 3)) * 2 - 700, rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(3))
        shift = e.max()
        ll, gamma, xi, path = brute(e - shift, t, s)
        p = H.forward_backward(e, t, s)
        assert abs(p.ll - (ll + 5 * shift)) < 1e-8
        assert np.allclose(p.gamma, gamma)
        assert np.allclose(H.expected_transitions(e, t, p), xi)
        assert tuple(H.viterbi(e, t, s)) == path
        draws = np.array([H.sample_path(e, t, p, rng) for _ in range(4000)])
        assert abs((draws == 0).mean(axis=0) - gamma[:, 0]).max() < 0.05


def test_haploid_runs_cover_both_strands():
    space, rng = StateSpace(("A", "B")), np.random.default_rng(0)
    runs = H.haploid_runs(np.array([0, 0, 2, 2, 1, 1, 0]), space, rng)
    assert sum(n for *_, n in runs) == 14
    assert sorted(n for s, _, n in runs if s == 1) == sorted([n for s, _, n in runs if s == 1])
    assert all(s in (0, 1) and n > 0 for s, _, n in runs)


def test_scoring_segments():
    p = np.array([0.01, 0.9, 0.95, 0.9, 0.01, 0.01, 0.99, 0.99, 0.01])
    got = scoring_segments(p, 0.2)
    # the first element is not clamped, so a negative one costs the run after it its first bin
    assert {(a, b) for a, b, _ in got} == {(2, 3), (6, 7)}
    assert scoring_segments(np.full(5, 0.01), 0.2) == []
    assert scoring_segments(np.array([]), 0.2) == []


def test_numeric_helpers():
    q = np.array([[-0.01, 0.01], [0.2, -0.2]])
    w, v = np.linalg.eig(q)
    assert np.allclose(expm(q * 5), (v @ np.diag(np.exp(5 * w)) @ np.linalg.inv(v)).real)
    assert np.allclose(stationary(expm(q)), [0.2 / 0.21, 0.01 / 0.21])
    assert abs(chi2_tail_1(3.841459) - 0.05) < 1e-6
    assert abs(fisher_exact(3, 1, 1, 3) - 0.4857142857) < 1e-9
    assert np.allclose(maximise_bounded(lambda x: -((x[0] - 0.3) ** 2) - (x[1] - 2) ** 2, (0.5, 0.5), ((0, 1), (0, 1))), [0.3, 1.0], atol=1e-5)


def test_parsers():
    assert parse_chroms("1-3,X") == ["1", "2", "3", "X"]
    assert parse_states(["AFR", "ARC=NEA+DEN"], {"DEN": ["D3", "D4"]}) == {"AFR": ["AFR"], "ARC": ["NEA", "D3", "D4"]}
    s = StateSpace(("AFR", "NEA"), inbred=True)
    assert s.names == ("AFR", "NEA", "AFRNEA", "hAFR", "hNEA")
    assert ("AFR", "state", ["AFR", "AFRNEA", "hAFR"]) in s.run_targets()
