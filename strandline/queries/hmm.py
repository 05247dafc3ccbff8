"""Queries of likelihoods and of the ancestry model, with recursive SQL for the recursions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import likelihood as L
from strandline.operators import hmm as H
from strandline.operators import sites as S
from strandline.pipelines import HmmConfig
from strandline.plans import fixture as X
from strandline.queries.sites import _BINS, _LIM, _SNPB, FX
from strandline.states import StateSpace

SPACE = StateSpace(("AFR", "NEA"))
CONT, ERR, INB, TAU = 0.02, 0.01, 0.1, 0.0
T = ((0.9, 0.05, 0.05), (0.05, 0.9, 0.05), (0.05, 0.05, 0.9))
LIBS = ["lib0", "lib1", "lib2"]
PARAMS = H.HmmParams((1 / 3,) * 3, T, dict.fromkeys(LIBS, CONT), dict.fromkeys(LIBS, ERR), (INB, INB), (TAU, TAU))
PC = "(AFR_alt + 0.5) / 21.0"
SNPB = _SNPB[len(_LIM) + 2 :]


def snps(spark, d):
    return S.snp_bins(X.sites(spark, d), "pos", 10000).withColumn("p_cont", S.cont_freq("AFR", 0.5, 0.5))


def observed(spark, d):
    """Read counts with their site's bin and contaminant frequency."""
    s = snps(spark, d).select("chrom", "pos", "bin", "bin_in_chrom", "p_cont")
    return X.obs(spark, d).join(s, ["chrom", "pos"])


def site_likelihoods(spark, d):
    return H.snp_log_likelihood(observed(spark, d), ["chrom", "bin_in_chrom", "pos"], "p_cont", F.lit(CONT), F.lit(ERR))


def emissions(spark, d):
    s = snps(spark, d).join(site_likelihoods(spark, d), ["chrom", "bin_in_chrom", "pos"])
    e = H.bin_log_emissions(s, ["chrom", "bin_in_chrom"], H.state_genotypes(SPACE, PARAMS.f, PARAMS.tau))
    bins = S.genome_bins(X.sites(spark, d), "pos", 10000).select("chrom", "bin_in_chrom")
    return H.complete_bins(bins, e, ["chrom", "bin_in_chrom"], SPACE.n)


def _decoded(spark, d):
    return H.decode(emissions(spark, d), ["chrom"], "bin_in_chrom", PARAMS, SPACE.names)


def r(c, n=6):
    return F.round(c, n).alias(c) if isinstance(c, str) else F.round(c, n)


_P = f"(({CONT} * pc + {1 - CONT} * g / 2.0) * {1 - ERR} + (1 - ({CONT} * pc + {1 - CONT} * g / 2.0)) * {ERR})"
_LC = "(lgamma(tref + talt + 1) - lgamma(talt + 1) - lgamma(tref + 1))"
_OB = f"ob AS (SELECT o.chrom, o.pos, o.lib, tref, talt, {PC} AS pc FROM obs o JOIN sites s ON o.chrom = s.chrom AND o.pos = s.pos), gs AS (SELECT unnest([0, 1, 2]) AS g)"
_LK = _OB + f", lk AS (SELECT chrom, pos, g, sum({_LC} + talt * ln({_P}) + tref * ln(1 - {_P})) AS l FROM ob, gs GROUP BY 1, 2, 3), lw AS (SELECT chrom, pos, max(CASE g WHEN 0 THEN l END) AS l0, max(CASE g WHEN 1 THEN l END) AS l1, max(CASE g WHEN 2 THEN l END) AS l2 FROM lk GROUP BY 1, 2)"


def _homo(p: str) -> tuple[str, str, str]:
    a, b = f"({p}_alt + 0.5)", f"({p}_ref + 0.5)"
    d = f"(({a} + {b}) * ({a} + {b} + 1))"
    g0, g2 = f"(({b} * {b} + {b} + {a} * {b} * {INB}) / {d})", f"(({a} * {a} + {a} + {a} * {b} * {INB}) / {d})"
    return g0, f"(1 - {g0} - {g2})", g2


def _het(p: str, q: str) -> tuple[str, str, str]:
    a1, b1, a2, b2 = f"({p}_alt + 0.5)", f"({p}_ref + 0.5)", f"({q}_alt + 0.5)", f"({q}_ref + 0.5)"
    d = f"(({a1} + {b1}) * ({a2} + {b2}))"
    return f"({b1} * {b2} / {d})", f"(1 - {b1} * {b2} / {d} - {a1} * {a2} / {d})", f"({a1} * {a2} / {d})"


def _hap(p: str) -> tuple[str, str, str]:
    a, b = f"({p}_alt + 0.5)", f"({p}_ref + 0.5)"
    return f"({b} / ({a} + {b}))", "0.0", f"({a} / ({a} + {b}))"


_STATES = [_homo("AFR"), _homo("NEA"), _het("AFR", "NEA")]
_TOP = "greatest(l0, l1, l2)"
_EM = ", ".join(f"sum({_TOP} + ln(" + " + ".join(f"exp(l{g} - {_TOP}) * {gs[g]}" for g in range(3)) + f")) AS e{i + 1}" for i, gs in enumerate(_STATES))
_EBIN = f"""{_BINS}, {SNPB}, {_LK}, em AS (SELECT s.chrom, s.bin_in_chrom, {_EM} FROM snpb s JOIN lw ON s.chrom = lw.chrom AND s.pos = lw.pos GROUP BY 1, 2),
eb0 AS (SELECT b.chrom, CAST(b.bin_in_chrom AS BIGINT) AS k, coalesce(e1, 0) AS e1, coalesce(e2, 0) AS e2, coalesce(e3, 0) AS e3 FROM bins0 b LEFT JOIN em ON em.chrom = b.chrom AND em.bin_in_chrom = b.bin_in_chrom),
ebin AS (SELECT *, greatest(e1, e2, e3) AS s, exp(e1 - greatest(e1, e2, e3)) AS x1, exp(e2 - greatest(e1, e2, e3)) AS x2, exp(e3 - greatest(e1, e2, e3)) AS x3 FROM eb0)"""
_STEP = lambda j: "(" + " + ".join(f"f.a{i + 1} * {T[i][j]}" for i in range(3)) + f") * b.x{j + 1}"
_FWD = f"""fwd AS (SELECT chrom, k, x1 / (x1 + x2 + x3) AS a1, x2 / (x1 + x2 + x3) AS a2, x3 / (x1 + x2 + x3) AS a3, (x1 + x2 + x3) / 3 AS n, s FROM ebin WHERE k = 0
 UNION ALL SELECT chrom, k, u1 / (u1 + u2 + u3), u2 / (u1 + u2 + u3), u3 / (u1 + u2 + u3), u1 + u2 + u3, s FROM (SELECT b.chrom, b.k, {_STEP(0)} AS u1, {_STEP(1)} AS u2, {_STEP(2)} AS u3, b.s FROM fwd f JOIN ebin b ON b.chrom = f.chrom AND b.k = f.k + 1))"""
_BACK = lambda i: "(" + " + ".join(f"{T[i][j]} * n.x{j + 1} * g.b{j + 1}" for j in range(3)) + ") / n.n"
_BWD = f"""xs AS (SELECT f.chrom, f.k, f.n, f.a1, f.a2, f.a3, e.x1, e.x2, e.x3 FROM fwd f JOIN ebin e ON e.chrom = f.chrom AND e.k = f.k),
bwd AS (SELECT chrom, max(k) AS k, 1.0::DOUBLE AS b1, 1.0::DOUBLE AS b2, 1.0::DOUBLE AS b3 FROM ebin GROUP BY 1
 UNION ALL SELECT g.chrom, g.k - 1, {_BACK(0)}, {_BACK(1)}, {_BACK(2)} FROM bwd g JOIN xs n ON n.chrom = g.chrom AND n.k = g.k WHERE g.k > 0)"""
_GAM = "gam AS (SELECT x.chrom, x.k, a1 * b1 / (a1 * b1 + a2 * b2 + a3 * b3) AS g1, a2 * b2 / (a1 * b1 + a2 * b2 + a3 * b3) AS g2, a3 * b3 / (a1 * b1 + a2 * b2 + a3 * b3) AS g3 FROM xs x JOIN bwd b ON b.chrom = x.chrom AND b.k = x.k)"
_CHAIN = FX + ", " + _EBIN + ", " + _FWD + ", " + _BWD
_ARG = lambda j: "CASE " + " ".join(f"WHEN v.v{i + 1} + ln({T[i][j]}) >= greatest(" + ", ".join(f"v.v{m + 1} + ln({T[m][j]})" for m in range(3)) + f") THEN {i + 1}" for i in range(3)) + " END"
_MAXV = lambda j: "greatest(" + ", ".join(f"v.v{m + 1} + ln({T[m][j]})" for m in range(3)) + f") + b.e{j + 1}"
_VIT = f"""vit AS (SELECT chrom, k, ln(1.0 / 3) + e1 AS v1, ln(1.0 / 3) + e2 AS v2, ln(1.0 / 3) + e3 AS v3, 0 AS p1, 0 AS p2, 0 AS p3 FROM ebin WHERE k = 0
 UNION ALL SELECT b.chrom, b.k, {_MAXV(0)}, {_MAXV(1)}, {_MAXV(2)}, {_ARG(0)}, {_ARG(1)}, {_ARG(2)} FROM vit v JOIN ebin b ON b.chrom = v.chrom AND b.k = v.k + 1),
lastk AS (SELECT chrom, max(k) AS k FROM ebin GROUP BY 1),
tr AS (SELECT v.chrom, v.k, CASE WHEN v1 >= greatest(v2, v3) THEN 1 WHEN v2 >= v3 THEN 2 ELSE 3 END AS z FROM vit v JOIN lastk USING (chrom, k)
 UNION ALL SELECT t.chrom, t.k - 1, CASE t.z WHEN 1 THEN v.p1 WHEN 2 THEN v.p2 ELSE v.p3 END FROM tr t JOIN vit v ON v.chrom = t.chrom AND v.k = t.k WHERE t.k > 0)"""
_XI = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, sum(a.a{i + 1} * {T[i][j]} * b.x{j + 1} * w.b{j + 1} / b.n) AS xi FROM xs a JOIN xs b ON b.chrom = a.chrom AND b.k = a.k + 1 JOIN bwd w ON w.chrom = b.chrom AND w.k = b.k" for i in range(3) for j in range(3))


def _gts(name, gs):
    return f"round({gs[0]}, 6) AS {name}_0, round({gs[1]}, 6) AS {name}_1, round({gs[2]}, 6) AS {name}_2"


def _gt_query(spark, d, pick):
    a = [F.col(f"{s}_alt") + 0.5 for s in ("AFR", "NEA")]
    b = [F.col(f"{s}_ref") + 0.5 for s in ("AFR", "NEA")]
    cols = pick(a, b)
    return X.sites(spark, d).select("site_id", *[F.round(c, 6).alias(f"{n}_{g}") for n, gs in cols for g, c in enumerate(gs)])


def posterior_genotype(spark, d):
    s = snps(spark, d).join(site_likelihoods(spark, d), ["chrom", "bin_in_chrom", "pos"])
    p = H.posterior_genotypes(s, _decoded(spark, d), ["chrom", "bin_in_chrom"], H.state_genotypes(SPACE, PARAMS.f, PARAMS.tau), SPACE.names)
    g = lambda k: F.aggregate("pg", F.lit(0.0), lambda acc, x: acc + F.element_at(x, k + 1))
    return p.select("chrom", "pos", *[F.round(g(k), 6).alias(f"g{k}") for k in range(3)])


def _pg(spark, d):
    s = snps(spark, d).join(site_likelihoods(spark, d), ["chrom", "bin_in_chrom", "pos"])
    return H.posterior_genotypes(s, _decoded(spark, d), ["chrom", "bin_in_chrom"], H.state_genotypes(SPACE, PARAMS.f, PARAMS.tau), SPACE.names)


def cont_suffstats(spark, d):
    o = observed(spark, d)
    st = H.contamination_stats(o, _pg(spark, d).select("chrom", "pos", "pg"), ["chrom", "pos"])
    return st.select("lib", r("p_cont"), "g", r("alt", 4), r("ref", 4))


def ftau_suffstats(spark, d):
    return H.drift_stats(_pg(spark, d), SPACE).select("source", "a", "b", r("g0", 4), r("g1", 4), r("g2", 4))


def _pgs(i: int) -> str:
    gs = _STATES[i]
    den = "nullif(" + " + ".join(f"exp(l{g} - {_TOP}) * {gs[g]}" for g in range(3)) + ", 0)"
    return ", ".join(f"g{i + 1} * exp(l{g} - {_TOP}) * {gs[g]} / {den} AS w{i}{g}" for g in range(3))


_PGSQL = _CHAIN + ", " + _GAM + f", pg AS (SELECT s.*, {_pgs(0)}, {_pgs(1)}, {_pgs(2)} FROM snpb s JOIN lw ON s.chrom = lw.chrom AND s.pos = lw.pos JOIN gam ON gam.chrom = s.chrom AND gam.k = s.bin_in_chrom)"


def hmm_em_fit(spark, d):
    s, o = snps(spark, d), observed(spark, d)
    bins = S.genome_bins(X.sites(spark, d), "pos", 10000).select("chrom", "bin")
    fit = H.fit_hmm(o.select("chrom", "bin", "pos", "lib", "tref", "talt", "p_cont"), s, bins, SPACE, H.HmmParams.initial(SPACE, LIBS), est_error=True, est_tau=True)
    rows = [("ll", str(i), float(v)) for i, v in enumerate(fit.ll)] + [("cont", k, v) for k, v in fit.params.cont.items()] + [("error", k, v) for k, v in fit.params.error.items()]
    rows += [("trans", f"{a}>{b}", fit.params.trans[i][j]) for i, a in enumerate(SPACE.names) for j, b in enumerate(SPACE.names)] + [("tau", n, fit.params.tau[i]) for i, n in enumerate(SPACE.sources)]
    rows.append(("converged", "", fit.converged))
    return spark.createDataFrame([(a, b, float(v)) for a, b, v in rows], "kind string, name string, value double")


def state_occupancy(spark, d):
    from strandline.operators.tracts import occupancy

    return occupancy(H.posterior_runs(emissions(spark, d), ["chrom"], "bin_in_chrom", PARAMS, SPACE, HmmConfig().replicates))


_C = ["AFR", "NEA", "AFRNEA"]
QUERIES = {
    "read_gt_likelihood": (
        lambda s, d: observed(s, d).select("chrom", "pos", "lib", *[F.round(L.read_likelihood(g, F.col("talt"), F.col("tref") + F.col("talt"), F.col("p_cont"), CONT, ERR), 6).alias(f"p{g}") for g in range(3)]),
        FX + f", {_OB} SELECT chrom, pos, lib, " + ", ".join("round(exp({lc}) * pow({p}, talt) * pow(1 - {p}, tref), 6) AS p{g}".format(lc=_LC, p=_P.replace(" g ", f" {g} "), g=g) for g in range(3)) + " FROM ob",
    ),
    "gtmode_likelihood": (
        lambda s, d: X.obs(s, d).select("site_id", "lib", *[F.round(L.call_likelihood(g, F.col("talt"), F.col("tref") + F.col("talt"), ERR), 6).alias(f"p{g}") for g in range(3)]),
        FX + " SELECT site_id, lib, " + ", ".join(f"CAST(CASE WHEN talt * 2 = (tref + talt) * {g} THEN {1 - 2 * ERR} ELSE {ERR} END AS DOUBLE) AS p{g}" for g in range(3)) + " FROM obs",
    ),
    "geno_given_state_homo": (
        lambda s, d: _gt_query(s, d, lambda a, b: [("AFR", L.genotype_homozygous(a[0], b[0], INB, 1.0)), ("NEA", L.genotype_homozygous(a[1], b[1], INB, 1.0))]),
        FX + f" SELECT site_id, {_gts('AFR', _homo('AFR'))}, {_gts('NEA', _homo('NEA'))} FROM sites",
    ),
    "geno_given_state_het": (lambda s, d: _gt_query(s, d, lambda a, b: [("AFRNEA", L.genotype_heterozygous(a[0], b[0], a[1], b[1]))]), FX + f" SELECT site_id, {_gts('AFRNEA', _het('AFR', 'NEA'))} FROM sites"),
    "geno_given_state_hap": (lambda s, d: _gt_query(s, d, lambda a, b: [("AFR", L.genotype_haploid(a[0], b[0]))]), FX + f" SELECT site_id, {_gts('AFR', _hap('AFR')).replace('round(0.0, 6)', 'CAST(0 AS DOUBLE)')} FROM sites"),
    "snp_likelihood_product": (lambda s, d: site_likelihoods(s, d).select("chrom", "pos", *[r(f"l{g}") for g in range(3)]), FX + f", {_LK} SELECT chrom, pos, round(l0, 6) AS l0, round(l1, 6) AS l1, round(l2, 6) AS l2 FROM lw"),
    "bin_emission_scaled": (
        lambda s, d: emissions(s, d).select("chrom", "bin_in_chrom", F.round(F.array_max("e"), 5).alias("shift"), *[F.round(F.exp(F.element_at("e", i + 1) - F.array_max("e")), 6).alias(f"x{i + 1}") for i in range(3)]),
        FX + f", {_EBIN} SELECT chrom, k AS bin_in_chrom, round(s, 5) AS shift, round(x1, 6) AS x1, round(x2, 6) AS x2, round(x3, 6) AS x3 FROM ebin",
    ),
    "hmm_forward_ll": (
        lambda s, d: H.sequence_ll(emissions(s, d), ["chrom"], "bin_in_chrom", PARAMS).select("chrom", r("ll", 4), "n_bins"),
        FX + f", {_EBIN}, {_FWD} SELECT chrom, round(sum(ln(n) + s), 4) AS ll, count(*) AS n_bins FROM fwd GROUP BY 1",
    ),
    "hmm_backward": (
        lambda s, d: _decoded(s, d).select("chrom", "bin_in_chrom", *[F.round(F.element_at("beta", i + 1), 5).alias(f"b{i + 1}") for i in range(3)]),
        _CHAIN + " SELECT chrom, k AS bin_in_chrom, round(b1, 5) AS b1, round(b2, 5) AS b2, round(b3, 5) AS b3 FROM bwd",
    ),
    "hmm_posterior": (
        lambda s, d: _decoded(s, d).select("chrom", "bin_in_chrom", *[r(n) for n in _C]),
        _CHAIN + ", " + _GAM + " SELECT chrom, k AS bin_in_chrom, round(g1, 6) AS AFR, round(g2, 6) AS NEA, round(g3, 6) AS AFRNEA FROM gam",
    ),
    "hmm_viterbi": (
        lambda s, d: _decoded(s, d).select("chrom", "bin_in_chrom", "viterbi"),
        FX + f", {_EBIN}, {_VIT} SELECT chrom, k AS bin_in_chrom, CASE z WHEN 1 THEN 'AFR' WHEN 2 THEN 'NEA' ELSE 'AFRNEA' END AS viterbi FROM tr",
    ),
    "hmm_expected_transitions": (
        lambda s, d: H.transition_counts(emissions(s, d), ["chrom"], "bin_in_chrom", PARAMS).groupBy("i", "j").agg(F.round(F.sum("xi"), 4).alias("xi")),
        _CHAIN + f" SELECT i, j, round(xi, 4) AS xi FROM ({_XI})",
    ),
    "posterior_genotype": (
        posterior_genotype,
        _PGSQL + " SELECT chrom, pos, " + ", ".join(f"round(w0{g} + w1{g} + w2{g}, 6) AS g{g}" for g in range(3)) + " FROM pg",
    ),
    "cont_suffstats": (
        cont_suffstats,
        _PGSQL + """ SELECT ob.lib, round(ob.pc, 6) AS p_cont, CAST(gs.g AS INTEGER) AS g, round(sum(w * talt), 4) AS alt, round(sum(w * tref), 4) AS ref FROM ob JOIN pg ON pg.chrom = ob.chrom AND pg.pos = ob.pos, gs, LATERAL (SELECT CASE g WHEN 0 THEN w00 + w10 + w20 WHEN 1 THEN w01 + w11 + w21 ELSE w02 + w12 + w22 END AS w) GROUP BY ob.lib, ob.pc, gs.g""",
    ),
    "ftau_suffstats": (
        ftau_suffstats,
        _PGSQL + " " + " UNION ALL ".join(f"SELECT '{p}' AS source, CAST({p}_alt + 0.5 AS DOUBLE) AS a, CAST({p}_ref + 0.5 AS DOUBLE) AS b, round(sum(w{i}0), 4) AS g0, round(sum(w{i}1), 4) AS g1, round(sum(w{i}2), 4) AS g2 FROM pg GROUP BY 2, 3" for i, p in enumerate(("AFR", "NEA"))),
    ),
    "hmm_em_fit": (hmm_em_fit, None),
    "posterior_runs": (lambda s, d: H.posterior_runs(emissions(s, d), ["chrom"], "bin_in_chrom", PARAMS, SPACE, HmmConfig().replicates), None),
    "posterior_occupancy": (state_occupancy, None),
}
