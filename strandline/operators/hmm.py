"""Hidden Markov model over genome bins: emissions as aggregates, recursions as grouped pandas kernels, EM on the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.likelihood import call_likelihood, genotype_haploid, genotype_heterozygous, genotype_homozygous, log_read_likelihood, safe_ln
from strandline.numeric import expm, maximise_bounded, stationary
from strandline.operators.hmm_pass import em_sums, pack
from strandline.plans.tables import materialise
from strandline.states import StateSpace


@dataclass(frozen=True)
class HmmParams:
    """Start distribution, transitions, contamination and error per library, inbreeding and log drift per source."""

    start: tuple[float, ...]
    trans: tuple[tuple[float, ...], ...]
    cont: dict[str, float]
    error: dict[str, float]
    f: tuple[float, ...]
    tau: tuple[float, ...]
    start_hap: tuple[float, ...] = ()  #: of haploid chromosomes, whose states are the homozygous ones
    trans_hap: tuple[tuple[float, ...], ...] = ()

    @staticmethod
    def initial(space: StateSpace, libs: Sequence[str], off: float = 0.02, cont: float = 0.01, error: float = 0.01, f: float = 0.01, tau: float = 0.8) -> HmmParams:
        def even(n: int) -> tuple[tuple[float, ...], tuple[tuple[float, ...], ...]]:
            t = np.full((n, n), off)
            np.fill_diagonal(t, 1 - off * (n - 1))
            return (1.0 / n,) * n, tuple(map(tuple, t.tolist()))

        k = len(space.sources)
        return HmmParams(*even(space.n), dict.fromkeys(libs, cont), dict.fromkeys(libs, error), (f,) * k, (tau,) * k, *even(space.n_homo))


    def favouring(self, space: StateSpace, states: Sequence[str], weight: float = 1.0) -> HmmParams:
        """The same with ``weight`` more on every transition into ``states``."""
        t = np.array(self.trans)
        t[:, [i for i, n in enumerate(space.names) if n in states]] += weight
        return replace(self, trans=tuple(map(tuple, (t / t.sum(axis=1, keepdims=True)).tolist())))

    def with_rates(self, space: StateSpace, rates: np.ndarray, bin_size: float) -> HmmParams:
        """Transitions over one bin from rates between the sources of a haplotype; either haplotype of a pair may change."""
        from strandline.operators.extras import diploid_rates

        rows = lambda m: tuple(map(tuple, expm(np.asarray(m, float) * bin_size).tolist()))
        return replace(self, trans=rows(diploid_rates(np.asarray(rates, float), space)), trans_hap=rows(rates))


def _per_lib(values: dict[str, float], lib: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]), lib)


def snp_log_likelihood(obs: DataFrame, keys: Sequence[str], p_cont: str, cont: Column, error: Column, calls: bool = False) -> DataFrame:
    """(keys, l0, l1, l2): log P(all reads of a site | genotype), a sum over libraries combined before the shuffle.

    With ``calls`` the counts are alleles of called genotypes, each right but for ``error``.
    """
    alt, n = F.col("talt"), F.col("tref") + F.col("talt")
    each = [F.ln(call_likelihood(g, alt, n, error)) if calls else log_read_likelihood(g, alt, n, F.col(p_cont), cont, error) for g in range(3)]
    return obs.groupBy(*keys).agg(*[F.sum(x).alias(f"l{g}") for g, x in enumerate(each)])


def pseudo_counts(source: str, prior: float | None) -> tuple[Column, Column]:
    """Panel counts (alt, ref) with pseudo-counts: ``prior``, or the columns {source}_pa and {source}_pb of ``with_priors``."""
    pa, pb = (F.col(f"{source}_pa"), F.col(f"{source}_pb")) if prior is None else (F.lit(prior), F.lit(prior))
    return F.col(f"{source}_alt") + pa, F.col(f"{source}_ref") + pb


def state_genotypes(space: StateSpace, f: Sequence[float], tau: Sequence[float], prior: float | None = 0.5, haploid: Column | bool = False) -> list[tuple[Column, Column, Column]]:
    """P(genotype | state) for every state, from panel counts plus pseudo-counts. Where ``haploid`` holds, homozygous states have
    one allele; the others do not occur there."""
    ab = [pseudo_counts(s, prior) for s in space.sources]
    out = []
    for i, j in space.pairs:
        one = genotype_haploid(*ab[i])
        if j < 0:
            out.append(one)
        elif i != j:
            out.append(genotype_heterozygous(*ab[i], *ab[j]))
        elif haploid is True:
            out.append(one)
        else:
            two = genotype_homozygous(*ab[i], f[i], float(np.exp(tau[i])))
            out.append(two if haploid is False else tuple(F.when(haploid, x).otherwise(y) for x, y in zip(one, two)))
    return out


def is_haploid(haploid: Sequence[str]) -> Column | bool:
    return F.col("chrom").isin(*haploid) if haploid else False


def additive_emissions(snps: DataFrame, keys: Sequence[str], states: list[tuple[Column, Column, Column]], weight: str) -> DataFrame:
    """(keys, e): the additive form for linked sites, Σ w · P(reads | state) − w with a weight per site."""
    top = F.greatest("l0", "l1", "l2")
    lik = [F.exp(F.col(f"l{g}") - top) for g in range(3)]
    w = F.col(weight)
    per = snps.select(*keys, *[(sum((l * p for l, p in zip(lik[1:], gs[1:])), lik[0] * gs[0]) * w - w).alias(f"__e{i}") for i, gs in enumerate(states)])
    n = len(states)
    return per.groupBy(*keys).agg(*[F.sum(f"__e{i}").alias(f"__e{i}") for i in range(n)]).select(*keys, F.array(*[F.col(f"__e{i}") for i in range(n)]).alias("e"))


def bin_log_emissions(snps: DataFrame, keys: Sequence[str], states: list[tuple[Column, Column, Column]]) -> DataFrame:
    """(keys, e): log P(reads of a bin | state) as an array over states. A site's genotypes are summed out around their
    largest likelihood, so nothing underflows."""
    top = F.greatest("l0", "l1", "l2")
    lik = [F.exp(F.col(f"l{g}") - top) for g in range(3)]
    per = [top + safe_ln(sum((l * p for l, p in zip(lik[1:], gs[1:])), lik[0] * gs[0])) for gs in states]
    named = snps.select(*keys, *[e.alias(f"__e{i}") for i, e in enumerate(per)])
    return named.groupBy(*keys).agg(*[F.sum(f"__e{i}").alias(f"__e{i}") for i in range(len(per))]).select(*keys, F.array(*[F.col(f"__e{i}") for i in range(len(per))]).alias("e"))


def complete_bins(bins: DataFrame, emissions: DataFrame, keys: Sequence[str], n_states: int) -> DataFrame:
    """Every bin; those without sites say nothing about the state."""
    return bins.join(emissions, list(keys), "left").withColumn("e", F.coalesce("e", F.array(*[F.lit(0.0)] * n_states)))


# ---------------------------------------------------------------------------------------------------------------
# kernels on one sequence: e is bins × states in log space


@dataclass
class Pass:
    alpha: np.ndarray
    beta: np.ndarray
    gamma: np.ndarray
    norm: np.ndarray
    ll: float


def scaled(e: np.ndarray) -> tuple[np.ndarray, float]:
    top = e.max(axis=1, keepdims=True)
    return np.exp(e - top), float(top.sum())


def forward_backward(e: np.ndarray, trans: np.ndarray, start: np.ndarray) -> Pass:
    """Scaled recursions; the first step applies the transitions to ``start`` as every other step does."""
    p, shift = scaled(e)
    n, k = p.shape
    alpha, beta, norm = np.empty((n, k)), np.ones((n, k)), np.empty(n)
    a = start
    for i in range(n):
        a = (a @ trans) * p[i]
        norm[i] = a.sum()
        a = a / norm[i]
        alpha[i] = a
    b = np.ones(k)
    for i in range(n - 1, 0, -1):
        b = trans @ (p[i] * b) / norm[i]
        beta[i - 1] = b
    gamma = alpha * beta
    return Pass(alpha, beta, gamma / gamma.sum(axis=1, keepdims=True), norm, float(np.log(norm).sum() + shift))


def viterbi(e: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Most likely path; ties go to the lower state."""
    with np.errstate(divide="ignore"):
        lt, v = np.log(trans), np.log(start @ trans) + e[0]
    back = np.zeros(e.shape, np.int64)
    for i in range(1, len(e)):
        m = v[:, None] + lt
        back[i] = m.argmax(axis=0)
        v = m.max(axis=0) + e[i]
    path = np.empty(len(e), np.int64)
    path[-1] = int(v.argmax())
    for i in range(len(e) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def expected_transitions(e: np.ndarray, trans: np.ndarray, p: Pass) -> np.ndarray:
    x, _ = scaled(e)
    right = x[1:] * p.beta[1:] / p.norm[1:, None]
    return trans * (p.alpha[:-1].T @ right)


def sample_path(e: np.ndarray, trans: np.ndarray, p: Pass, rng: np.random.Generator) -> np.ndarray:
    """A path from its posterior distribution, first state included."""
    x, _ = scaled(e)
    out = np.empty(len(e), np.int64)
    w = p.gamma[0]
    for i in range(len(e)):
        if i:
            w = trans[out[i - 1]] * x[i] * p.beta[i]
        c = np.cumsum(w)
        out[i] = int(np.searchsorted(c, rng.random() * c[-1], side="right").clip(0, len(w) - 1))
    return out


def haploid_runs(path: np.ndarray, space: StateSpace, rng: np.random.Generator) -> list[tuple[int, int, int]]:
    """(source, start, length) of the haplotype runs of a diploid path.

    Two strands are followed; a source that stays present keeps its strand. When a homozygous pair loses one copy, either
    strand ends with equal chance.
    """
    runs, strands = [], []
    for i, s in enumerate(path):
        a, b = space.pairs[int(s)]
        want = [a, a if b < 0 else b]
        if not strands:
            strands = [(want[0], i), (want[1], i)]
            continue
        left, kept, order = list(want), [None, None], [0, 1]
        if strands[0][0] == strands[1][0] and rng.random() < 0.5:
            order = [1, 0]
        for k in order:
            if strands[k][0] in left:
                kept[k] = strands[k]
                left.remove(strands[k][0])
        for k in (0, 1):
            if kept[k] is None:
                runs.append((strands[k][0], strands[k][1], i - strands[k][1]))
                kept[k] = (left.pop(0), i)
        strands = kept
    runs += [(s, at, len(path) - at) for s, at in strands]
    return runs


# ---------------------------------------------------------------------------------------------------------------
# grouped operators


def per_sequence(bins: DataFrame, keys: Sequence[str], order: str, fn: Callable[[tuple, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``fn(key values, order values, e)`` to every sequence; its columns follow the keys. A sequence is bounded by the
    bins of one chromosome."""
    types = ", ".join(f"{k} {bins.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out = fn(key, pdf[order].to_numpy(), np.array(pdf["e"].tolist(), float))
        for i, (k, v) in enumerate(zip(keys, key)):
            out.insert(i, k, v)
        return out

    return bins.select(*keys, order, "e").groupBy(*keys).applyInPandas(run, f"{types}, {schema}")


def _chooser(params: HmmParams, keys: Sequence[str], haploid: Sequence[str]) -> Callable[[tuple], tuple[np.ndarray, np.ndarray, int]]:
    """For a sequence's key: transitions, start and number of states, which are the homozygous ones on ``haploid`` chromosomes."""
    two, one = (np.array(params.trans), np.array(params.start)), (np.array(params.trans_hap), np.array(params.start_hap))
    at, hap = list(keys).index("chrom") if haploid else 0, frozenset(haploid)
    return lambda key: (*one, len(one[1])) if hap and key[at] in hap else (*two, len(two[1]))


def sequence_ll(bins: DataFrame, keys: Sequence[str], order: str, params: HmmParams, haploid: Sequence[str] = ()) -> DataFrame:
    choose = _chooser(params, keys, haploid)

    def fn(k: tuple, o: np.ndarray, e: np.ndarray) -> pd.DataFrame:
        t, s, n = choose(k)
        return pd.DataFrame({"ll": [forward_backward(e[:, :n], t, s).ll], "n_bins": [len(o)]})

    return per_sequence(bins, keys, order, fn, "ll double, n_bins long")


def _gamma_columns(p: Pass, names: Sequence[str]) -> dict[str, np.ndarray]:
    """A posterior column per state, 0 for states that do not occur."""
    n = p.gamma.shape[1]
    return {name: p.gamma[:, i] if i < n else np.zeros(len(p.gamma)) for i, name in enumerate(names)}


def decode(bins: DataFrame, keys: Sequence[str], order: str, params: HmmParams, names: Sequence[str], haploid: Sequence[str] = ()) -> DataFrame:
    """(keys, order, viterbi, one posterior column per state, backward array)."""
    choose = _chooser(params, keys, haploid)

    def fn(k: tuple, o: np.ndarray, e: np.ndarray) -> pd.DataFrame:
        t, s, n = choose(k)
        p = forward_backward(e[:, :n], t, s)
        return pd.DataFrame({order: o, "viterbi": np.array(names)[viterbi(e[:, :n], t, s)], **_gamma_columns(p, names), "beta": list(p.beta)})

    return per_sequence(bins, keys, order, fn, f"{order} {bins.schema[order].dataType.simpleString()}, viterbi string, " + ", ".join(f"`{n}` double" for n in names) + ", beta array<double>")


def transition_counts(bins: DataFrame, keys: Sequence[str], order: str, params: HmmParams, haploid: Sequence[str] = ()) -> DataFrame:
    """(keys, i, j, xi): expected transitions of every sequence."""
    choose = _chooser(params, keys, haploid)

    def fn(k: tuple, o: np.ndarray, e: np.ndarray) -> pd.DataFrame:
        t, s, n = choose(k)
        x = expected_transitions(e[:, :n], t, forward_backward(e[:, :n], t, s))
        return pd.DataFrame({"i": np.repeat(np.arange(n), n), "j": np.tile(np.arange(n), n), "xi": x.ravel()})

    return per_sequence(bins, keys, order, fn, "i int, j int, xi double")


def posterior_runs(bins: DataFrame, keys: Sequence[str], order: str, params: HmmParams, space: StateSpace, replicates: int, seed: int = 0, haploid: Sequence[str] = ()) -> DataFrame:
    """(keys, it, state, start, len): haplotype runs of ``replicates`` paths drawn from the posterior, seeded per sequence.
    Haploid sequences have one strand."""
    choose = _chooser(params, keys, haploid)
    hap, at = frozenset(haploid), list(keys).index("chrom") if haploid else 0

    def fn(k: tuple, o: np.ndarray, e: np.ndarray) -> pd.DataFrame:
        t, s, n = choose(k)
        rng = np.random.default_rng([seed, *[abs(int.from_bytes(str(x).encode(), "little")) % (1 << 32) for x in k]])
        p = forward_backward(e[:, :n], t, s)
        runs = (lambda z: [(space.pairs[int(z[a])][0], a, b - a) for a, b in stretches(z)]) if hap and k[at] in hap else lambda z: haploid_runs(z, space, rng)
        rows = [(it, space.sources[c], int(o[a]), n_) for it in range(replicates) for c, a, n_ in runs(sample_path(e[:, :n], t, p, rng))]
        return pd.DataFrame(rows, columns=["it", "state", "start", "len"])

    return per_sequence(bins, keys, order, fn, "it int, state string, start long, len long")


def stretches(path: np.ndarray) -> list[tuple[int, int]]:
    """(first, past the last) of the stretches of equal values."""
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return list(zip(cuts[:-1], cuts[1:]))


# ---------------------------------------------------------------------------------------------------------------
# estimation


@dataclass
class HmmFit:
    """``converged`` is false where max_iter ended the EM before a step of the log-likelihood fell below the tolerance."""

    params: HmmParams
    ll: list[float]
    bins: DataFrame
    converged: bool


def posterior_genotypes(snps: DataFrame, posteriors: DataFrame, keys: Sequence[str], states: list[tuple[Column, Column, Column]], names: Sequence[str]) -> DataFrame:
    """``snps`` with ``pg``: P(state, genotype | all reads) as an array per state."""
    j = snps.join(posteriors.select(*keys, *names), list(keys))
    top = F.greatest("l0", "l1", "l2")
    lik = [F.exp(F.col(f"l{g}") - top) for g in range(3)]
    rows = []
    for name, gs in zip(names, states):
        w = [l * p for l, p in zip(lik, gs)]
        total = F.nullif(w[0] + w[1] + w[2], F.lit(0.0))
        rows.append(F.array(*[F.coalesce(F.col(f"`{name}`") * x / total, F.lit(0.0)) for x in w]))
    return j.withColumn("pg", F.array(*rows)).drop(*names)


def contamination_stats(obs: DataFrame, posterior: DataFrame, keys: Sequence[str], p_cont: str = "p_cont") -> DataFrame:
    """(lib, p_cont, g, alt, ref): reads weighted by P(genotype), all the M-step of contamination and error needs.

    ``p_cont`` has few distinct values, so the result is small whatever the number of reads.
    """
    g = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.aggregate("pg", F.lit(0.0), lambda acc, s: acc + F.element_at(s, k + 1)))
    j = obs.join(posterior.select(*keys, g.alias("w")), list(keys)).select("lib", p_cont, "tref", "talt", F.posexplode("w").alias("g", "w"))
    return j.groupBy("lib", p_cont, "g").agg(F.sum(F.col("w") * F.col("talt")).alias("alt"), F.sum(F.col("w") * F.col("tref")).alias("ref"))


def drift_stats(posterior: DataFrame, space: StateSpace, prior: float | None = 0.5, haploid: Sequence[str] = ()) -> DataFrame:
    """(source, a, b, g0, g1, g2): summed P(homozygous state, genotype) per distinct panel counts, of diploid chromosomes."""
    rows = [
        F.struct(F.lit(s).alias("source"), *[x.alias(n) for n, x in zip("ab", pseudo_counts(s, prior))], F.element_at("pg", k + 1).alias("g"))
        for i, s in enumerate(space.sources)
        for k, p in enumerate(space.pairs)
        if p == (i, i)
    ]
    two = posterior.where(~is_haploid(haploid)) if haploid else posterior
    x = two.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return x.groupBy("source", "a", "b").agg(*[F.sum(F.element_at("g", k + 1)).alias(f"g{k}") for k in range(3)])


def update_contamination(stats: pd.DataFrame, params: HmmParams, est_error: bool, est_cont: bool = True, p_cont: str = "p_cont") -> HmmParams:
    cont, error = dict(params.cont), dict(params.error)
    for lib, s in stats.groupby("lib"):
        pc, g, alt, ref = (s[c].to_numpy(float) for c in (p_cont, "g", "alt", "ref"))

        def ll(x: np.ndarray) -> float:
            p = x[0] * pc + (1 - x[0]) * g / 2
            p = np.clip(p * (1 - x[1]) + (1 - p) * x[1], 1e-12, 1 - 1e-12)
            return float((alt * np.log(p) + ref * np.log(1 - p)).sum())

        e0 = error[lib]
        x = maximise_bounded(ll, (cont[lib], e0), ((1e-6, 0.999) if est_cont else (cont[lib],) * 2, (1e-5, 0.25) if est_error else (e0, e0)))
        cont[lib], error[lib] = float(x[0]), float(x[1])
    return replace(params, cont=cont, error=error)


def update_drift(stats: pd.DataFrame, params: HmmParams, space: StateSpace, est_f: bool, est_tau: bool) -> HmmParams:
    f, tau = list(params.f), list(params.tau)
    for i, s in enumerate(space.sources):
        x = stats[stats["source"] == s]
        if not len(x):
            continue
        a, b, g = x["a"].to_numpy(float), x["b"].to_numpy(float), x[["g0", "g1", "g2"]].to_numpy(float)

        def ll(v: np.ndarray) -> float:
            t = np.exp(v[1])
            d = (a + b) * (t * (a + b) + 1)
            p0, p2 = (b * b * t + b + a * b * v[0] * t) / d, (a * a * t + a + a * b * v[0] * t) / d
            return float((g * np.log(np.clip(np.c_[p0, 1 - p0 - p2, p2], 1e-300, 1))).sum())

        v = maximise_bounded(ll, (f[i], tau[i]), ((0.0, 1.0) if est_f else (f[i], f[i]), (-20.0, 20.0) if est_tau else (tau[i], tau[i])))
        f[i], tau[i] = float(v[0]), float(v[1])
    return replace(params, f=tuple(f), tau=tuple(tau))


def updated_transitions(xi: np.ndarray, old: Sequence[Sequence[float]]) -> tuple[tuple[float, ...], tuple[tuple[float, ...], ...]]:
    """(start, transitions) from expected counts; a state that never occurs keeps its row."""
    if not len(xi):
        return (), ()
    t = xi.reshape(len(old), len(old))
    safe = np.maximum(t, 1e-12)
    t = np.where(t.sum(axis=1, keepdims=True) > 0, safe / safe.sum(axis=1, keepdims=True), np.array(old))
    return tuple(stationary(t).tolist()), tuple(map(tuple, t.tolist()))


def fit_hmm(
    obs: DataFrame,
    snps: DataFrame,
    bins: DataFrame,
    space: StateSpace,
    params: HmmParams,
    keys: Sequence[str] = ("chrom",),
    max_iter: int = 1000,
    tol: float = 1e-2,
    est_cont: bool = True,
    est_error: bool = False,
    est_f: bool = False,
    est_tau: bool = False,
    est_trans: bool = True,
    prior: float | None = 0.5,
    haploid: Sequence[str] = (),
    calls: bool = False,
    freq_cont: int = 1,
    freq_f: int = 1,
    still: float = 1e-5,
) -> HmmFit:
    """EM. ``obs`` has keys, bin, pos, lib, tref, talt, p_cont; ``snps`` keys, bin, pos and panel counts; ``bins`` keys, bin.

    Chromosomes of ``haploid`` have the homozygous states only, with transitions of their own. With ``calls`` the counts are
    called genotypes, and contamination is not estimated. From the fourth iteration on, contamination is updated every
    ``freq_cont``th time and inbreeding and drift every ``freq_f``th; an update that moves nothing by ``still`` is the last.

    The inputs are materialised once, and packed once per sequence; each iteration is one job of one stage over the packed
    rows (``hmm_pass``) and brings back only sums per transition, per (library, p_cont) and per distinct panel count.
    """
    obs, snps, bins = materialise(obs), materialise(snps), materialise(bins)
    packed = pack(obs, snps, bins, space, keys, prior, calls)
    cont_on, f_on = (est_cont or est_error) and not calls, est_f or est_tau
    lls: list[float] = []
    while True:
        it = len(lls)
        now_cont, now_f = cont_on and (it < 3 or it % freq_cont == 0), f_on and (it < 3 or it % freq_f == 0)
        sums, reads, drift = em_sums(packed, space, params, keys, haploid, calls, now_cont, now_f)
        lls.append(float(sum(v[0] for v in sums.values())))
        converged = len(lls) > 1 and abs(lls[-1] - lls[-2]) < tol
        if converged or len(lls) > max_iter:
            site, states = [*keys, "bin", "pos"], state_genotypes(space, params.f, params.tau, prior, is_haploid(haploid))
            lik = snp_log_likelihood(obs, site, "p_cont", _per_lib(params.cont, F.col("lib")), _per_lib(params.error, F.col("lib")), calls)
            e = complete_bins(bins, bin_log_emissions(snps.join(lik, site), [*keys, "bin"], states), [*keys, "bin"], space.n)
            return HmmFit(params, lls, materialise(e), converged)
        old = params
        if now_cont:
            params = update_contamination(reads, params, est_error, est_cont)
            cont_on = max(abs(a[k] - b[k]) for a, b in ((params.cont, old.cont), (params.error, old.error)) for k in a) >= still
        if now_f:
            params = update_drift(drift, params, space, est_f, est_tau)
            f_on = max(abs(a - b) for a, b in zip((*params.f, *params.tau), (*old.f, *old.tau))) >= still
        if est_trans:
            start, trans = updated_transitions(sums["two"][1:], old.trans) if "two" in sums else (old.start, old.trans)
            start_hap, trans_hap = updated_transitions(sums["hap"][1:], old.trans_hap) if "hap" in sums else (old.start_hap, old.trans_hap)
            params = replace(params, trans=trans, start=start, trans_hap=trans_hap, start_hap=start_hap)
