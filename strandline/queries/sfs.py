"""Queries of the conditional SFS model and of f- and D-statistics."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from strandline.functions import likelihood as L
from strandline.operators import fstats as FS
from strandline.operators import sfs as M
from strandline.operators import sites as S
from strandline.plans import fixture as X
from strandline.plans.tables import materialise
from strandline.queries.sites import _FLIP, FX

CONT, E, B, INB = {"lib0": 0.05, "lib1": 0.1, "lib2": 0.2}, 0.01, 0.02, 0.2
POPS = ["AFR", "NEA", "DEN"]


def data(spark, d):
    s = M.categories(X.sites(spark, d), ["NEA"], "PAN")
    s = s.withColumn("psi", F.when(F.col("flipped"), F.col("AFR_ref")).otherwise(F.col("AFR_alt")) / 20.0)
    o = X.obs(spark, d).select("site_id", F.col("lib").alias("rg"), F.col("tref").alias("ref_n"), F.col("talt").alias("alt_n"))
    j = o.join(s, "site_id")
    return j.select(F.lit("0").alias("rep"), F.col("site_id").alias("snp"), "sfs", "rg", "psi", "flipped", F.lit(False).alias("haploid"), F.col("ref_n").alias("ref"), F.col("alt_n").alias("alt"), "NEA_der", "sex_chrom")


def params(spark, d):
    rows = M.categories(X.sites(spark, d), ["NEA"], "PAN").select("sfs", "NEA_der").distinct().collect()  # one row per class
    return {"0": M.SfsParams(dict(CONT), {r[0]: 0.1 + 0.2 * r[1] for r in rows}, {r[0]: INB for r in rows}, E, B)}


def r(c, n=6):
    return F.round(c, n).alias(c)


def sfs_em_fit(spark, d):
    x, p0 = materialise(data(spark, d).drop("NEA_der", "sex_chrom")), params(spark, d)["0"]
    x = M.jackknife(x, 3)
    fits, lls = M.fit_sfs(x, {str(k): M.SfsParams(dict(p0.cont), dict(p0.tau), dict(p0.f), p0.e, p0.b) for k in range(4)})
    f = M.to_frame(fits)
    se = M.standard_errors(fits)
    full = f[f["rep"] == "0"].reset_index(drop=True)
    full = full.assign(se=se)[["parameter", "name", "value", "se"]]
    return spark.createDataFrame([*full.itertuples(index=False, name=None), *[(*x, None) for x in M.convergence_rows(fits)]], "parameter string, name string, value double, se double")


def chrom_classes(spark, d):
    """Per chromosome and class of (AFR, NEA, DEN) counts: sites and derived and all reads."""
    s = M.categories(X.sites(spark, d), POPS, "PAN")
    o = X.obs(spark, d).groupBy("site_id").agg(F.sum("tref").alias("tref"), F.sum("talt").alias("talt"))
    j = s.join(o, "site_id", "left")
    der = F.when(F.col("flipped"), F.col("tref")).otherwise(F.col("talt"))
    keys = ["sex_chrom", *[f"{p}_{a}" for p in POPS for a in ("anc", "der")]]
    return j.groupBy("chrom", *keys).agg(F.count(F.lit(1)).alias("n_snps"), F.coalesce(F.sum(der), F.lit(0)).alias("der"), F.coalesce(F.sum(F.col("tref") + F.col("talt")), F.lit(0)).alias("reads")), keys


def replicates(spark, d):
    c, keys = chrom_classes(spark, d)
    x = FS.leave_one_out(c, "chrom", keys, ["n_snps", "der", "reads"]).where("n_snps > 0")
    return FS.class_freqs(x.withColumn("tau", F.col("der") / F.nullif("reads", F.lit(0))), POPS)


def pi(spark, d):
    return FS.pi_table(replicates(spark, d), POPS)


def summary(fn, keys, stat, pops=None):
    def q(spark, d):
        reps = fn(pi(spark, d), pops or [*POPS, "target"]) if fn else pi(spark, d)
        return FS.jackknife_summary(reps, ["sex_chrom", *keys], stat).select("sex_chrom", *keys, r(stat), r("sterr"))

    return q


def freqs(spark, d):
    s = S.block_ids(X.sites(spark, d), "snp", 30)
    return s.select("site_id", "chrom", "block", *[(F.col(f"{p}_alt") / F.nullif(F.col(f"{p}_alt") + F.col(f"{p}_ref"), F.lit(0))).alias(p) for p in ("NEA", "DEN", "AFR", "PAN")])


def dstat_blocks(spark, d):
    return FS.d_statistic(freqs(spark, d), "NEA", "DEN", "AFR", "PAN", ["chrom", "block"])


def gt_calls(spark, d):
    """One called genotype per site from read counts: 0, 1 or 2 alternative alleles by share of reads."""
    g = data(spark, d).groupBy("rep", "snp", "sfs", "flipped", "haploid").agg(F.sum("ref").alias("r"), F.sum("alt").alias("a"))
    share = F.col("a") / F.nullif(F.col("r") + F.col("a"), F.lit(0))
    return g.withColumn("alt", F.when(share < 0.25, 0).when(share > 0.75, 2).otherwise(1)).withColumn("rg", F.lit("lib0"))


def gt_m_step(spark, d):
    p = M.call_posteriors(gt_calls(spark, d), params(spark, d))
    return M.call_error_stats(p).select(*[r(c, 4) for c in ("err", "ok", "bias", "nobias")])


def gt_class_step(spark, d):
    p = M.call_posteriors(gt_calls(spark, d), params(spark, d), random_read=True)
    s = M.class_stats(p)
    t, f = M.tau_f_update(F.col("g0"), F.col("g1"), F.col("g2"))
    return s.select("sfs", F.round(t, 6).alias("tau"), F.round(f, 6).alias("f"), r("ll", 4))


# --- SQL -------------------------------------------------------------------------------------------------------
_SX = "CASE WHEN chrom = 'X' THEN 'sex' ELSE 'autosome' END"
_CAT = f"""pol AS (SELECT site_id, chrom, {_SX} AS sex_chrom, {_FLIP} AS flipped, CASE WHEN {_FLIP} THEN NEA_alt ELSE NEA_ref END AS NEA_anc, CASE WHEN {_FLIP} THEN NEA_ref ELSE NEA_alt END AS NEA_der, CASE WHEN {_FLIP} THEN AFR_ref ELSE AFR_alt END / 20.0 AS psi FROM sites),
cls AS (SELECT sex_chrom, NEA_anc, NEA_der, row_number() OVER (ORDER BY min(site_id)) - 1 AS sfs FROM pol GROUP BY 1, 2, 3),
dat AS (SELECT p.*, c.sfs, o.lib AS rg, o.tref, o.talt, CASE o.lib WHEN 'lib0' THEN 0.05 WHEN 'lib1' THEN 0.1 ELSE 0.2 END::DOUBLE AS c, (0.1 + 0.2 * p.NEA_der)::DOUBLE AS tau FROM pol p JOIN cls c USING (sex_chrom, NEA_anc, NEA_der) JOIN obs o USING (site_id)),
prior AS (SELECT *, {INB} * (1 - tau) + {1 - INB} * (1 - tau) * (1 - tau) AS p0, 2 * {1 - INB} * tau * (1 - tau) AS p1, {INB} * tau + {1 - INB} * tau * tau AS p2,
 CASE WHEN flipped THEN {B} ELSE {1 - E} END::DOUBLE AS ra, CASE WHEN flipped THEN {1 - E} ELSE {B} END::DOUBLE AS rd, CASE WHEN flipped THEN {1 - B} ELSE {E} END::DOUBLE AS aa, CASE WHEN flipped THEN {E} ELSE {1 - B} END::DOUBLE AS ad FROM dat)"""


def _mix(a, d_, g):
    own = {0: a, 1: f"({a} + {d_}) / 2", 2: d_}[g]
    return f"(c * ((1 - psi) * {a} + psi * {d_}) + (1 - c) * {own})"


_POST = f"""sl AS (SELECT site_id, sfs, {', '.join(f'sum(tref * ln({_mix("ra", "rd", g)}) + talt * ln({_mix("aa", "ad", g)})) AS l{g}' for g in range(3))}, min(p0) AS p0, min(p1) AS p1, min(p2) AS p2 FROM prior GROUP BY 1, 2),
sw AS (SELECT *, greatest(l0, l1, l2) AS t, exp(l0 - greatest(l0, l1, l2)) * p0 AS w0, exp(l1 - greatest(l0, l1, l2)) * p1 AS w1, exp(l2 - greatest(l0, l1, l2)) * p2 AS w2 FROM sl),
post AS (SELECT site_id, sfs, w0 / (w0 + w1 + w2) AS g0, w1 / (w0 + w1 + w2) AS g1, w2 / (w0 + w1 + w2) AS g2, ln(w0 + w1 + w2) + t AS ll FROM sw)"""


def _rd(allele, a, d_, n):
    return f"SELECT site_id AS snp, sfs, rg, flipped, {allele} AS allele, {n} AS n, c * ((1 - psi) * {a} + psi * {d_}) / (c * ((1 - psi) * {a} + psi * {d_}) + (1 - c) * ((1 - en) * {a} + en * {d_})) AS post_c, (c * psi + (1 - c) * en) * {d_} / ((1 - c * psi - (1 - c) * en) * {a} + (c * psi + (1 - c) * en) * {d_}) AS post_der FROM en WHERE {n} > 0"


_READS = f"en AS (SELECT *, p1 / 2 + p2 AS en FROM prior), rp AS ({_rd(0, 'ra', 'rd', 'tref')} UNION ALL {_rd(1, 'aa', 'ad', 'talt')})"
_B = FX + ", " + _CAT
_TF = "(g1 / 2 + g2) / (g0 + g1 + g2)"
_ISREF = "CASE WHEN flipped THEN post_der ELSE 1 - post_der END"

_PD = ", ".join(f"CASE WHEN {_FLIP} THEN {p}_alt ELSE {p}_ref END AS {p}_anc, CASE WHEN {_FLIP} THEN {p}_ref ELSE {p}_alt END AS {p}_der" for p in POPS)
_KEYS = "sex_chrom, " + ", ".join(f"{p}_{a}" for p in POPS for a in ("anc", "der"))
_COL = lambda p: "tau" if p == "target" else p


def _wavg(x):
    return f"sum(({x}) * n_snps) / nullif(sum(CASE WHEN ({x}) IS NOT NULL THEN n_snps END), 0)"


_PAIRS = list(itertools.combinations([*POPS, "target"], 2))
_PI = f"""{FX}, po AS (SELECT site_id, chrom, {_SX} AS sex_chrom, {_FLIP} AS flipped, {_PD} FROM sites), so AS (SELECT site_id, sum(tref) AS tref, sum(talt) AS talt FROM obs GROUP BY 1),
cc AS (SELECT chrom, {_KEYS}, count(*) AS n_snps, coalesce(sum(CASE WHEN flipped THEN tref ELSE talt END), 0) AS der, coalesce(sum(tref + talt), 0) AS reads FROM po LEFT JOIN so USING (site_id) GROUP BY ALL),
tt AS (SELECT {_KEYS}, sum(n_snps) AS n, sum(der) AS d, sum(reads) AS r FROM cc GROUP BY ALL), un AS (SELECT DISTINCT chrom AS rep FROM cc),
loo AS (SELECT rep, {', '.join('tt.' + k for k in _KEYS.split(', '))}, n - coalesce(n_snps, 0) AS n_snps, CAST(d - coalesce(der, 0) AS DOUBLE) / nullif(r - coalesce(reads, 0), 0) AS tau FROM tt CROSS JOIN un LEFT JOIN cc ON cc.chrom = un.rep AND {' AND '.join(f'cc.{k} = tt.{k}' for k in _KEYS.split(', '))}),
fr AS (SELECT rep, sex_chrom, n_snps, tau, {', '.join(f'CAST({p}_der AS DOUBLE) / nullif({p}_anc + {p}_der, 0) AS {p}, 2.0 * {p}_der / nullif({p}_anc + {p}_der, 0) * {p}_anc / nullif({p}_anc + {p}_der - 1, 0) AS w_{p}' for p in POPS)} FROM loo WHERE n_snps > 0),
pw AS (SELECT rep, sex_chrom, {', '.join(f'{_wavg(f"{_COL(a)} * (1 - {_COL(b)}) + {_COL(b)} * (1 - {_COL(a)})")} AS "{a}|{b}"' for a, b in _PAIRS)}, {', '.join(f'coalesce({_wavg(f"w_{p}")}, 0) AS "{p}|within"' for p in POPS)}, 0.0::DOUBLE AS "target|within" FROM fr GROUP BY 1, 2)"""


def _q(a, b):
    return f'"{a}|{b}"' if b == "within" or (a, b) in _PAIRS else f'"{b}|{a}"'


def _sum(rows, keys, stat):
    u = " UNION ALL ".join(f"SELECT sex_chrom, rep, {', '.join(f"'{v}' AS {k}" for k, v in zip(keys, vals))}, {expr} AS {stat} FROM pw" for vals, expr in rows)
    ks = ", ".join(keys)
    return _PI + f", u AS ({u}) SELECT sex_chrom, {ks}, round(avg({stat}), 6) AS {stat}, round(sqrt(var_pop({stat}) * (count({stat}) - 1)), 6) AS sterr FROM u GROUP BY sex_chrom, {ks}"


_ALL = [*POPS, "target"]
_F2 = [((a, b), f"{_q(a, b)} - {_q(a, 'within')} / 2 - {_q(b, 'within')} / 2") for a, b in itertools.combinations(_ALL, 2)]
_F3 = [((x, a, b), f"({_q(x, a)} + {_q(x, b)} - {_q(a, b)} - {_q(x, 'within')}) / 2") for x in _ALL for a, b in itertools.combinations([p for p in _ALL if p != x], 2)]
_F4 = [((_ALL[a], _ALL[b], _ALL[c], _ALL[e]), f"({_q(_ALL[a], _ALL[e])} + {_q(_ALL[b], _ALL[c])} - {_q(_ALL[a], _ALL[c])} - {_q(_ALL[b], _ALL[e])}) / 2") for a, b, c, e in ((0, 1, 2, 3), (0, 2, 1, 3), (0, 3, 1, 2))]
_PIR = [((a, b), _q(a, b)) for x, y in _PAIRS for a, b in ((x, y), (y, x))] + [((p, "within"), _q(p, "within")) for p in _ALL]

_BLK = """lim AS (SELECT chrom, count(*) AS n FROM sites GROUP BY 1), k AS (SELECT *, ceil(n / greatest(floor(n / 30.0), 1)) AS each FROM lim),
bs AS (SELECT s.*, CAST(floor((row_number() OVER (PARTITION BY s.chrom ORDER BY s.pos) - 1) / each) AS BIGINT) AS block FROM sites s JOIN k USING (chrom)),
fq AS (SELECT chrom, block, """ + ", ".join(f"CAST({p}_alt AS DOUBLE) / nullif({p}_alt + {p}_ref, 0) AS {c}" for c, p in zip("abcd", ("NEA", "DEN", "AFR", "PAN"))) + """ FROM bs),
db AS (SELECT chrom, block, sum(b * c * (1 - a) * (1 - d) + (1 - b) * (1 - c) * a * d) AS abba, sum(a * c * (1 - b) * (1 - d) + (1 - a) * (1 - c) * b * d) AS baba, sum(a * b * (1 - c) * (1 - d) + (1 - a) * (1 - b) * c * d) AS bbaa, count(*) AS n FROM fq WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL GROUP BY 1, 2)"""
_GT = f"""{_B}, ga AS (SELECT site_id, sfs, flipped, min(p0) AS p0, min(p1) AS p1, min(p2) AS p2, sum(talt) * 1.0 / sum(tref + talt) AS sh FROM prior GROUP BY 1, 2, 3), gc AS (SELECT *, CASE WHEN sh < 0.25 THEN 0 WHEN sh > 0.75 THEN 2 ELSE 1 END AS a FROM ga)"""
_RH, _HT, _AH = f"CASE WHEN a = 0 THEN {1 - 2 * E} ELSE {E} END", f"CASE a WHEN 0 THEN {B} WHEN 1 THEN {1 - B - E} ELSE {E} END", f"CASE WHEN a = 2 THEN {1 - 2 * B} ELSE {B} END"
_RR, _RA = f"CASE WHEN a = 0 THEN {1 - E} ELSE {E} END", f"CASE WHEN a = 0 THEN {B} ELSE {1 - B} END"


def _gp(rh, ht, ah):
    return f"gw AS (SELECT *, (CASE WHEN flipped THEN {ah} ELSE {rh} END) * p0 AS w0, ({ht}) * p1 AS w1, (CASE WHEN flipped THEN {rh} ELSE {ah} END) * p2 AS w2 FROM gc), gpo AS (SELECT sfs, flipped, a, w0 / (w0 + w1 + w2) AS g0, w1 / (w0 + w1 + w2) AS g1, w2 / (w0 + w1 + w2) AS g2, ln(w0 + w1 + w2) AS ll FROM gw)"


QUERIES = {
    "sfs_categories": (
        lambda s, d: M.categories(X.sites(s, d), ["NEA"], "PAN").groupBy("sfs", "sex_chrom", "NEA_anc", "NEA_der").agg(F.count(F.lit(1)).alias("n_snps")),
        _B + " SELECT c.sfs, sex_chrom, NEA_anc, NEA_der, count(*) AS n_snps FROM pol JOIN cls c USING (sex_chrom, NEA_anc, NEA_der) GROUP BY ALL",
    ),
    "sfs_table": (
        lambda s, d: M.sfs_table(data(s, d), params(s, d)).select("sfs", "n_snps", "n_reads", r("n_endo", 4), r("read_ratio"), r("cont_est"), r("tau"), r("psi", 4)),
        _B + """, g AS (SELECT sfs, count(DISTINCT site_id) AS n_snps, CAST(sum(tref + talt) AS BIGINT) AS n_reads, sum((tref + talt) * (1 - c)) AS n_endo, CAST(sum(CASE WHEN flipped THEN tref ELSE talt END) AS DOUBLE) / sum(tref + talt) AS read_ratio, min(tau) AS tau FROM dat GROUP BY 1)
SELECT sfs, n_snps, n_reads, round(n_endo, 4) AS n_endo, round(read_ratio, 6) AS read_ratio, round(1 - n_endo / n_reads, 6) AS cont_est, round(tau, 6) AS tau, round(tau + (read_ratio - tau) / nullif(1 - n_endo / n_reads, 0), 4) AS psi FROM g""",
    ),
    "sfs_genotype_prior": (
        lambda s, d: M.with_params(data(s, d), params(s, d)).select("sfs", *[F.round(p, 6).alias(f"p{g}") for g, p in enumerate(M.genotype_prior())]).distinct(),
        _B + " SELECT DISTINCT sfs, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM prior",
    ),
    "read_given_allele": (
        lambda s, d: X.sites(s, d).select("site_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("allele"), S.flipped("PAN").alias("fl")).select("site_id", "allele", *[F.round(p, 6).alias(n) for n, p in zip(("anc", "der"), L.read_given_allele(F.col("allele"), F.col("fl"), E, B))]),
        _B + f" SELECT site_id, 0 AS allele, CASE WHEN flipped THEN {B} ELSE {1 - E} END::DOUBLE AS anc, CASE WHEN flipped THEN {1 - E} ELSE {B} END::DOUBLE AS der FROM pol UNION ALL SELECT site_id, 1, CASE WHEN flipped THEN {1 - B} ELSE {E} END::DOUBLE, CASE WHEN flipped THEN {E} ELSE {1 - B} END::DOUBLE FROM pol",
    ),
    "sfs_e_step": (
        lambda s, d: M.class_stats(M.site_posteriors(data(s, d), params(s, d))).select("sfs", r("g0", 4), r("g1", 4), r("g2", 4), "n_snps", r("ll", 3)),
        _B + f", {_POST} SELECT sfs, round(sum(g0), 4) AS g0, round(sum(g1), 4) AS g1, round(sum(g2), 4) AS g2, count(*) AS n_snps, round(sum(ll), 3) AS ll FROM post GROUP BY 1",
    ),
    "sfs_posterior_g": (
        lambda s, d: M.site_posteriors(data(s, d), params(s, d)).select("snp", r("g0"), r("g1"), r("g2")),
        _B + f", {_POST} SELECT site_id AS snp, round(g0, 6) AS g0, round(g1, 6) AS g1, round(g2, 6) AS g2 FROM post",
    ),
    "sfs_posterior_c": (
        lambda s, d: M.read_posteriors(data(s, d), params(s, d)).select("snp", "rg", "allele", "n", r("post_c"), r("post_der")),
        _B + f", {_READS} SELECT snp, rg, allele, n, round(post_c, 6) AS post_c, round(post_der, 6) AS post_der FROM rp",
    ),
    "sfs_m_step_tau_f": (
        lambda s, d: M.class_stats(M.site_posteriors(data(s, d), params(s, d))).select("sfs", *[F.round(x, 6).alias(n) for n, x in zip(("tau", "f"), M.tau_f_update(F.col("g0"), F.col("g1"), F.col("g2")))]),
        _B + f", {_POST}, z AS (SELECT sfs, sum(g0) AS g0, sum(g1) AS g1, sum(g2) AS g2 FROM post GROUP BY 1) SELECT sfs, round({_TF}, 6) AS tau, round(least(greatest(1 - g1 / (2 * {_TF} * (1 - {_TF}) * (g0 + g1 + g2)), 0), 1), 6) AS f FROM z",
    ),
    "sfs_m_step_c": (
        lambda s, d: M.group_stats(M.read_posteriors(data(s, d), params(s, d))).select("rg", r("c"), "n"),
        _B + f", {_READS} SELECT rg, round(sum(n * post_c) / sum(n), 6) AS c, CAST(sum(n) AS BIGINT) AS n FROM rp GROUP BY 1",
    ),
    "sfs_m_step_eb": (
        lambda s, d: M.error_stats(M.read_posteriors(data(s, d), params(s, d))).select(*[r(c, 3) for c in ("err", "ok", "bias", "nobias")]),
        _B + f", {_READS}, ir AS (SELECT *, {_ISREF} AS q FROM rp) SELECT round(sum(CASE WHEN allele = 1 THEN n * q END), 3) AS err, round(sum(CASE WHEN allele = 0 THEN n * q END), 3) AS ok, round(sum(CASE WHEN allele = 0 THEN n * (1 - q) END), 3) AS bias, round(sum(CASE WHEN allele = 1 THEN n * (1 - q) END), 3) AS nobias FROM ir",
    ),
    "gt_m_step": (
        gt_m_step,
        _GT + ", " + _gp(_RH, _HT, _AH) + """ SELECT round(sum(CASE WHEN a <> 0 THEN CASE WHEN flipped THEN g2 ELSE g0 END ELSE 0 END), 4) AS err, round(sum(CASE WHEN a = 0 THEN CASE WHEN flipped THEN g2 ELSE g0 END ELSE 0 END), 4) AS ok,
round(sum(CASE WHEN a <> 2 THEN CASE WHEN flipped THEN g0 ELSE g2 END ELSE 0 END), 4) AS bias, round(sum(CASE WHEN a = 2 THEN CASE WHEN flipped THEN g0 ELSE g2 END ELSE 0 END), 4) AS nobias FROM gpo""",
    ),
    "gt_random_read_step": (
        gt_class_step,
        _GT + ", " + _gp(_RR, "0.5", _RA) + f", z AS (SELECT sfs, sum(g0) AS g0, sum(g1) AS g1, sum(g2) AS g2, sum(ll) AS ll FROM gpo GROUP BY 1) SELECT sfs, round({_TF}, 6) AS tau, round(least(greatest(1 - g1 / nullif(2 * {_TF} * (1 - {_TF}) * (g0 + g1 + g2), 0), 0), 1), 6) AS f, round(ll, 4) AS ll FROM z",
    ),
    "sfs_em_fit": (sfs_em_fit, None),
    "pi_matrix": (summary(None, ["pop1", "pop2"], "pi"), _sum(_PIR, ["pop1", "pop2"], "pi")),
    "f2": (summary(FS.f2, ["A", "B"], "f2"), _sum(_F2, ["A", "B"], "f2")),
    "f3": (summary(FS.f3, ["X", "A", "B"], "f3"), _sum(_F3, ["X", "A", "B"], "f3")),
    "f4": (summary(FS.f4, ["A", "B", "C", "D"], "f4"), _sum(_F4, ["A", "B", "C", "D"], "f4")),
    "f_replicates": (
        lambda s, d: FS.f2(pi(s, d), [*POPS, "target"]).select("rep", "sex_chrom", "A", "B", r("f2")),
        _PI + " " + " UNION ALL ".join(f"SELECT rep, sex_chrom, '{a}' AS A, '{b}' AS B, round({x}, 6) AS f2 FROM pw" for (a, b), x in _F2),
    ),
    "dstat_patterns": (
        lambda s, d: dstat_blocks(s, d).select("chrom", "block", r("abba"), r("baba"), r("bbaa"), "n", r("d")),
        FX + f", {_BLK} SELECT chrom, block, round(abba, 6) AS abba, round(baba, 6) AS baba, round(bbaa, 6) AS bbaa, n, round((abba - baba) / nullif(abba + baba, 0), 6) AS d FROM db",
    ),
    "dstat_block_jackknife": (
        lambda s, d: FS.d_block_jackknife(dstat_blocks(s, d), ["chrom"]).select("chrom", r("d"), r("sterr")),
        FX + f""", {_BLK}, l AS (SELECT chrom, (sum(abba) OVER w - sum(baba) OVER w) / (sum(abba) OVER w + sum(baba) OVER w) AS d, (sum(abba) OVER w - abba - sum(baba) OVER w + baba) / nullif(sum(abba) OVER w - abba + sum(baba) OVER w - baba, 0) AS lo FROM db WINDOW w AS (PARTITION BY chrom))
SELECT chrom, round(min(d), 6) AS d, round(sqrt(var_pop(lo) * (count(lo) - 1)), 6) AS sterr FROM l GROUP BY 1""",
    ),
}
