"""Queries over the parts of runs: haploid and called data, priors, tables of a fit, read-level and display operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strandline.functions import likelihood as L
from strandline.numeric import expm
from strandline.operators import extras as E
from strandline.operators import fstats as FS
from strandline.operators import hmm as H
from strandline.operators import panelstats as P
from strandline.operators import sfs as M
from strandline.operators import sites as S
from strandline.operators import tracts as TR
from strandline.pipelines import cont_by_group
from strandline.plans import fixture as X
from strandline.plans.tables import table
from strandline.queries import extras as XQ
from strandline.queries import hmm as HQ
from strandline.queries import panel as PQ
from strandline.queries import sfs as SQ
from strandline.queries.sites import _BINS, _LIM, _SNPB, FX, RANK
from strandline.sources import binary as B
from strandline.sources import text as T
from strandline.sources.sinks import vcf_lines
from strandline.states import StateSpace

HAP = ((0.8, 0.2), (0.1, 0.9))
PARAMS = H.replace(HQ.PARAMS, start_hap=(0.5, 0.5), trans_hap=HAP)


def r(c, n=6):
    return F.round(c, n).alias(c)


# --- HMM variants ----------------------------------------------------------------------------------------------


def _emissions(spark, d, calls=False, prior=0.5, haploid=(), ancestral=None):
    s = S.with_priors(HQ.snps(spark, d), ["AFR", "NEA"], prior, ancestral)
    o = HQ.observed(spark, d)
    if calls:
        o = o.groupBy("chrom", "bin_in_chrom", "pos", "p_cont").agg(F.lit("lib0").alias("lib"), F.sum("tref").alias("tref"), F.sum("talt").alias("talt"))
    lik = H.snp_log_likelihood(o, ["chrom", "bin_in_chrom", "pos"], "p_cont", F.lit(HQ.CONT), F.lit(HQ.ERR), calls)
    states = H.state_genotypes(HQ.SPACE, PARAMS.f, PARAMS.tau, None, H.is_haploid(haploid))
    e = H.bin_log_emissions(s.join(lik, ["chrom", "bin_in_chrom", "pos"]), ["chrom", "bin_in_chrom"], states)
    return H.complete_bins(S.genome_bins(X.sites(spark, d), "pos", 10000).select("chrom", "bin_in_chrom"), e, ["chrom", "bin_in_chrom"], HQ.SPACE.n)


def _ll(haploid=(), **options):
    return lambda s, d: H.sequence_ll(_emissions(s, d, haploid=haploid, **options), ["chrom"], "bin_in_chrom", PARAMS, haploid).select("chrom", r("ll", 4), "n_bins")


def _em(states, lk=None, join=""):
    """Emission CTEs of the bins from genotype probabilities per state, as the module of HMM queries has them."""
    top = HQ._TOP
    em = ", ".join(f"sum({top} + ln(" + " + ".join(f"exp(l{g} - {top}) * {gs[g]}" for g in range(3)) + f")) AS e{i + 1}" for i, gs in enumerate(states))
    n = range(1, len(states) + 1)
    big = "greatest(" + ", ".join(f"e{i}" for i in n) + ")"
    return f"""{_BINS}, {HQ.SNPB}, {lk or HQ._LK}, em AS (SELECT s.chrom, s.bin_in_chrom, {em} FROM snpb s JOIN lw ON s.chrom = lw.chrom AND s.pos = lw.pos {join} GROUP BY 1, 2),
eb0 AS (SELECT b.chrom, CAST(b.bin_in_chrom AS BIGINT) AS k, {', '.join(f'coalesce(e{i}, 0) AS e{i}' for i in n)} FROM bins0 b LEFT JOIN em ON em.chrom = b.chrom AND em.bin_in_chrom = b.bin_in_chrom),
ebin AS (SELECT *, {big} AS s, {', '.join(f'exp(e{i} - {big}) AS x{i}' for i in n)} FROM eb0)"""


_CALL = f"""gs AS (SELECT unnest([0, 1, 2]) AS g), oc AS (SELECT chrom, pos, sum(tref) AS tref, sum(talt) AS talt FROM obs GROUP BY 1, 2),
lk AS (SELECT chrom, pos, g, ln(CASE WHEN talt * 2 = (tref + talt) * g THEN {1 - 2 * HQ.ERR} ELSE {HQ.ERR} END) AS l FROM oc, gs), lw AS (SELECT chrom, pos, max(CASE g WHEN 0 THEN l END) AS l0, max(CASE g WHEN 1 THEN l END) AS l1, max(CASE g WHEN 2 THEN l END) AS l2 FROM lk GROUP BY 1, 2)"""
_HAPX = [HQ._hap("AFR"), HQ._hap("NEA")]
_ONX = [tuple(f"(CASE WHEN s.chrom = 'X' THEN {a} ELSE {b} END)" for a, b in zip(h, g)) for h, g in zip(_HAPX, HQ._STATES)] + [HQ._STATES[2]]
_U = lambda j: f"(f.a1 * {HAP[0][j]} + f.a2 * {HAP[1][j]}) * b.x{j + 1}"
_FWDX = f"""hb AS (SELECT chrom, k, greatest(e1, e2) AS s, exp(e1 - greatest(e1, e2)) AS x1, exp(e2 - greatest(e1, e2)) AS x2 FROM ebin WHERE chrom = 'X'),
fx AS (SELECT chrom, k, {0.5 * HAP[0][0] + 0.5 * HAP[1][0]} * x1 / ({0.5 * HAP[0][0] + 0.5 * HAP[1][0]} * x1 + {0.5 * HAP[0][1] + 0.5 * HAP[1][1]} * x2) AS a1, {0.5 * HAP[0][1] + 0.5 * HAP[1][1]} * x2 / ({0.5 * HAP[0][0] + 0.5 * HAP[1][0]} * x1 + {0.5 * HAP[0][1] + 0.5 * HAP[1][1]} * x2) AS a2, {0.5 * HAP[0][0] + 0.5 * HAP[1][0]} * x1 + {0.5 * HAP[0][1] + 0.5 * HAP[1][1]} * x2 AS n, s FROM hb WHERE k = 0
 UNION ALL SELECT chrom, k, u1 / (u1 + u2), u2 / (u1 + u2), u1 + u2, s FROM (SELECT b.chrom, b.k, {_U(0)} AS u1, {_U(1)} AS u2, b.s FROM fx f JOIN hb b ON b.chrom = f.chrom AND b.k = f.k + 1))"""
_LLX = " SELECT chrom, round(sum(ln(n) + s), 4) AS ll, count(*) AS n_bins FROM fwd WHERE chrom <> 'X' GROUP BY 1 UNION ALL SELECT chrom, round(sum(ln(n) + s), 4), count(*) FROM fx GROUP BY 1"
_LLS = " SELECT chrom, round(sum(ln(n) + s), 4) AS ll, count(*) AS n_bins FROM fwd GROUP BY 1"


def _moments(pop, cond="true", a=None, b=None, mean="0.5", var=None):
    """pa and pb of a beta-binomial moment estimator as scalar SQL."""
    a, b = a or f"{pop}_alt", b or f"{pop}_ref"
    var = var or f"avg(pow(CAST({a} AS DOUBLE) / nullif({a} + {b}, 0) - 0.5, 2))"
    return f"(SELECT {mean} AS f, {var} AS v, avg({a} + {b}) AS n FROM sites WHERE {cond})"


def _pseudo(m):
    h, ab = "(f * (1 - f))", "((f * (1 - f) - v) / nullif(v - f * (1 - f) / n, 0))"
    return f"SELECT CASE WHEN {h} = 0 OR n < {ab} THEN 1e-6 ELSE greatest(f * {ab}, 1e-5) END AS pa, CASE WHEN {h} = 0 OR n < {ab} THEN 1e-6 ELSE greatest((1 - f) * {ab}, 1e-5) END AS pb FROM {m}"


def _with(gs, p, pa, pb):
    return tuple(x.replace(f"({p}_alt + 0.5)", f"({p}_alt + {pa})").replace(f"({p}_ref + 0.5)", f"({p}_ref + {pb})") for x in gs)


_EBP = ", ".join(f"eb{p} AS ({_pseudo(_moments(p))})" for p in ("AFR", "NEA"))
_EBS = [_with(_with(g, "AFR", "eA.pa", "eA.pb"), "NEA", "eN.pa", "eN.pb") for g in HQ._STATES]


def with_priors(spark, d):
    s = S.with_priors(X.sites(spark, d), ["AFR", "NEA"], None, "PAN", 0.25)
    return s.select("site_id", *[r(f"{p}_{x}") for p in ("AFR", "NEA") for x in ("pa", "pb")])


def _oriented(p):
    known, flip = "(PAN_ref > 0) <> (PAN_alt > 0)", "(PAN_ref = 0 AND PAN_alt > 0)"
    der, anc = f"(CASE WHEN {flip} THEN {p}_ref ELSE {p}_alt END)", f"(CASE WHEN {flip} THEN {p}_alt ELSE {p}_ref END)"
    f = f"CAST({der} AS DOUBLE) / nullif({der} + {anc}, 0)"
    return f"od{p} AS ({_pseudo(_moments(p, known, der, anc, f'avg({f})', f'var_pop({f})'))}), ev{p} AS ({_pseudo(_moments(p))})"


def _prior_cols(p):
    a, b = "(PAN_alt > 0 AND PAN_ref = 0)", "(PAN_ref > 0 AND PAN_alt = 0)"
    anc, der = f"(SELECT pb + 0.25 FROM od{p})", f"(SELECT pa FROM od{p})"
    return f"round(CASE WHEN {a} THEN {anc} WHEN {b} THEN {der} ELSE (SELECT pa FROM ev{p}) END, 6) AS {p}_pa, round(CASE WHEN {b} THEN {anc} WHEN {a} THEN {der} ELSE (SELECT pb FROM ev{p}) END, 6) AS {p}_pb"


def additive(spark, d):
    s = HQ.snps(spark, d).join(HQ.site_likelihoods(spark, d), ["chrom", "bin_in_chrom", "pos"]).withColumn("w", 1 / (1 + F.col("site_id") % 3))
    e = H.additive_emissions(s, ["chrom", "bin_in_chrom"], H.state_genotypes(HQ.SPACE, PARAMS.f, PARAMS.tau), "w")
    return e.select("chrom", "bin_in_chrom", *[F.round(F.element_at("e", i + 1), 5).alias(f"e{i + 1}") for i in range(3)])


_ADD = ", ".join("round(sum((" + " + ".join(f"exp(l{g} - {HQ._TOP}) * {gs[g]}" for g in range(3)) + f") / (1 + site_id % 3) - 1.0 / (1 + site_id % 3)), 5) AS e{i + 1}" for i, gs in enumerate(HQ._STATES))


def transition_matrix(spark, d):
    """Transitions over 5 units of a diploid pair from haplotype rates, as expected transitions start."""
    space = StateSpace(("AFR", "NEA"))
    rates = np.array([[-0.01, 0.01], [0.2, -0.2]])
    t = expm(E.diploid_rates(rates, space) * 5)
    return spark.createDataFrame([(a, b, round(float(t[i, j]), 6)) for i, a in enumerate(space.names) for j, b in enumerate(space.names)], "a string, b string, p double")


_E5 = "exp(-0.21 * 5)"
_TM = f"""WITH q AS (SELECT (0.2 + 0.01 * {_E5}) / 0.21 AS aa, (0.01 - 0.01 * {_E5}) / 0.21 AS an, (0.2 - 0.2 * {_E5}) / 0.21 AS na, (0.01 + 0.2 * {_E5}) / 0.21 AS nn)
SELECT a, b, round(p, 6) AS p FROM (SELECT 'AFR' AS a, 'AFR' AS b, aa * aa AS p FROM q UNION ALL SELECT 'AFR', 'AFRNEA', 2 * aa * an FROM q UNION ALL SELECT 'AFR', 'NEA', an * an FROM q UNION ALL SELECT 'NEA', 'NEA', nn * nn FROM q UNION ALL SELECT 'NEA', 'AFRNEA', 2 * nn * na FROM q
UNION ALL SELECT 'NEA', 'AFR', na * na FROM q UNION ALL SELECT 'AFRNEA', 'AFR', aa * na FROM q UNION ALL SELECT 'AFRNEA', 'NEA', an * nn FROM q UNION ALL SELECT 'AFRNEA', 'AFRNEA', aa * nn + an * na FROM q)"""


# --- runs --------------------------------------------------------------------------------------------------------


def viterbi_runs(spark, d):
    b = PQ.bins(spark, d).where("state is not null")
    return TR.state_runs(b, ["sample", "chrom"], "id", "state")


def best_score_run(spark, d):
    """The run of highest total of every sample, chromosome and target."""
    t = TR.target_posteriors(PQ.bins(spark, d), PQ.SPACE, ["sample", "chrom", "id"]).where("p is not null")
    best = TR.call_runs(t, ["sample", "chrom", "target", "type"], "id").where("rank = 1")
    return best.select("sample", "chrom", "target", "type", "start", "end", r("score", 5))


_BEST = f"""WITH {PQ._BIN}, x AS ({PQ._TGT.replace('SELECT sample,', 'SELECT sample, chrom, id,')}), v AS (SELECT *, ln(p + 0.2) AS v, row_number() OVER w AS i FROM x WHERE p IS NOT NULL WINDOW w AS (PARTITION BY sample, chrom, target, type ORDER BY id)),
y AS (SELECT *, first_value(v) OVER w AS v1, CASE WHEN i = 1 AND v < 0 THEN 0 WHEN i = 2 AND first_value(v) OVER w < 0 THEN v + first_value(v) OVER w ELSE v END AS y FROM v WINDOW w AS (PARTITION BY sample, chrom, target, type ORDER BY id)),
c AS (SELECT *, sum(y) OVER w AS c FROM y WINDOW w AS (PARTITION BY sample, chrom, target, type ORDER BY id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, least(min(c) OVER w, 0) AS m FROM c WINDOW w AS (PARTITION BY sample, chrom, target, type ORDER BY id ROWS UNBOUNDED PRECEDING)), k AS (SELECT *, c - m AS run FROM m),
h AS (SELECT sample, chrom, target, type, arg_max(i, run) AS hi, max(run) AS top, arg_max(id, run) AS id_hi FROM k GROUP BY ALL HAVING max(run) > 0),
z AS (SELECT k.sample, k.chrom, k.target, k.type, h.hi, h.id_hi, h.top, coalesce(max(CASE WHEN run = 0 AND i < h.hi THEN i END), 0) + 1 AS lo FROM k JOIN h USING (sample, chrom, target, type) GROUP BY ALL),
e AS (SELECT z.*, CASE WHEN lo = 2 AND y.v1 < 0 THEN 1 ELSE lo END AS st, y.v1 FROM z JOIN y USING (sample, chrom, target, type) WHERE y.i = 1)
SELECT e.sample, e.chrom, e.target, e.type, y.id AS start, e.id_hi AS "end", round(e.top - CASE WHEN e.st = 1 THEN e.v1 ELSE y.y END, 5) AS score FROM e JOIN y ON y.sample = e.sample AND y.chrom = e.chrom AND y.target = e.target AND y.type = e.type AND y.i = e.st WHERE e.st < e.hi"""


def recalled_runs(spark, d):
    """Runs called anew from the bin table: how many per sample and target, and their total length."""
    b = PQ.bins(spark, d).withColumn("map", F.col("pos") * 1e-6).where(" and ".join(f"{s} is not null" for s in PQ.SPACE.names))
    x = TR.recall_runs(b, PQ.SPACE.names, ["sample", "chrom"], "id")
    return x.groupBy("sample", "target", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("len"))


# --- SFS tables --------------------------------------------------------------------------------------------------


def sfs_site_table(spark, d):
    x, p = SQ.data(spark, d), SQ.params(spark, d)
    s = M.categories(X.sites(spark, d), ["NEA"], "PAN").select(F.col("site_id").alias("snp"), "chrom", "pos", "ref", "alt", "flipped")
    t = M.site_table(s, x, M.site_posteriors(x, p))
    return t.select("snp", "chrom", "pos", "ref", "alt", "tref", "talt", *[r(f"log_g{g}", 3) for g in range(3)], r("p"), "sfs")


def sfs_call_table(spark, d, random_read=False):
    c = SQ.gt_calls(spark, d)
    return M.call_table(c, SQ.params(spark, d), random_read).select("sfs", "n_snps", "n_anc", "n_der", r("read_ratio"), r("tau"), r("f"))


def sfs_vcf(spark, d):
    x, p = SQ.data(spark, d), SQ.params(spark, d)
    s = X.sites(spark, d).select(F.col("site_id").alias("snp"), "chrom", "pos", "ref", "alt", S.flipped("PAN").alias("flipped"))
    reads = x.groupBy("snp").agg(F.sum(F.col("ref") + F.col("alt")).alias("depth"))
    g = M.site_posteriors(x, p).join(s, "snp").join(reads, "snp")
    # two decimals of the posteriors, so that the text does not hang on the last bit
    cols = {f"g{k}": F.round(F.when(F.col("flipped"), F.col(f"g{2 - k}")).otherwise(F.col(f"g{k}")), 2) for k in range(3)}
    g = g.select("chrom", "pos", "ref", "alt", F.when(F.col("flipped"), F.col("alt")).otherwise(F.col("ref")).alias("aa"), "depth", *[c.alias(n) for n, c in cols.items()])
    return vcf_lines(g.withColumns({f"l{k}": F.when(F.col(f"g{k}") > 0.5, 0.0).otherwise(-1.5) for k in range(3)})).select("value")


_V = lambda c: f"rtrim(rtrim(printf('%.2f', {c}), '0'), '.')"
_VCF = f"""{SQ._B}, {SQ._POST}, n AS (SELECT site_id, sum(tref + talt) AS depth FROM dat GROUP BY 1), v AS (SELECT s.chrom, s.pos, s.ref, s.alt, p.flipped, n.depth, round(CASE WHEN p.flipped THEN q.g2 ELSE q.g0 END, 2) AS h0, round(q.g1, 2) AS h1, round(CASE WHEN p.flipped THEN q.g0 ELSE q.g2 END, 2) AS h2 FROM post q JOIN sites s USING (site_id) JOIN pol p USING (site_id) JOIN n USING (site_id))
SELECT chrom || chr(9) || pos || chr(9) || '.' || chr(9) || ref || chr(9) || alt || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || 'AA=' || CASE WHEN flipped THEN alt ELSE ref END || chr(9) || 'GT:GL:GP:DP' || chr(9) || CASE WHEN h0 >= h1 AND h0 >= h2 THEN '0/0' WHEN h1 >= h2 THEN '0/1' ELSE '1/1' END || ':'
 || {" || ',' || ".join(f"CASE WHEN h{k} > 0.5 THEN '0' ELSE '-1.5' END" for k in range(3))} || ':' || {" || ',' || ".join(_V(f'h{k}') for k in range(3))} || ':' || depth AS value FROM v"""


def jackknife_slices(spark, d):
    return M.jackknife(SQ.data(spark, d), 4).groupBy("rep").agg(F.countDistinct("snp").alias("n_snps"), F.min("snp").alias("first"), F.max("snp").alias("last"), F.count(F.lit(1)).alias("n"))


_JK = SQ._B + """, q AS (SELECT quantile_disc(site_id, 0.25) AS a, quantile_cont(site_id, 0.25) AS q1, quantile_cont(site_id, 0.5) AS q2, quantile_cont(site_id, 0.75) AS q3 FROM dat),
p AS (SELECT site_id, 1 + CASE WHEN site_id > q1 THEN 1 ELSE 0 END + CASE WHEN site_id > q2 THEN 1 ELSE 0 END + CASE WHEN site_id > q3 THEN 1 ELSE 0 END AS part FROM dat, q), r AS (SELECT unnest(range(0, 5)) AS rep)
SELECT CAST(rep AS VARCHAR) AS rep, count(DISTINCT site_id) AS n_snps, min(site_id) AS first, max(site_id) AS last, count(*) AS n FROM p, r WHERE rep <> part GROUP BY 1"""


def cont_by_lib(spark, d):
    est = table(spark, d, "cont").where("cont is not null").select("lib", "cont", F.coalesce("error", F.lit(0.0)).alias("error"))
    t = table(spark, d, "target_file")
    x = cont_by_group(est, t, 7)
    return x.select("rg", "lib", "len_bin", "deam", r("cont"), r("error"), "n_reads", "n_snps")


# --- sites and files ---------------------------------------------------------------------------------------------


def bin_positions(spark, d):
    s = X.sites(spark, d).withColumn("map", F.col("pos") * 1e-6)
    return S.bin_positions(S.genome_bins(s, "map", 0.01).select("chrom", "bin", F.round("start", 9).alias("start")), s).select("chrom", "bin", "pos")


_BP = f"""{FX}, lm AS (SELECT chrom, CAST(floor(min(pos * 1e-6) / 0.01) AS BIGINT) AS lo, greatest(CAST(ceil(max(pos * 1e-6) / 0.01) AS BIGINT) - CAST(floor(min(pos * 1e-6) / 0.01) AS BIGINT), 1) AS n FROM sites GROUP BY chrom),
ofs AS (SELECT *, coalesce(sum(n) OVER (ORDER BY {RANK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM lm), b AS (SELECT chrom, CAST(f + k AS BIGINT) AS bin, round((lo + k) * CAST(0.01 AS DOUBLE), 9) AS m FROM (SELECT chrom, lo, f, unnest(range(n)) AS k FROM ofs)),
kn AS (SELECT chrom, CAST(pos AS DOUBLE) * CAST(1e-6 AS DOUBLE) AS m, min(pos) AS p FROM sites GROUP BY 1, 2), l AS (SELECT b.chrom, b.bin, b.m, k.m AS m0, k.p AS p0 FROM b ASOF LEFT JOIN kn k ON k.chrom = b.chrom AND b.m >= k.m), u AS (SELECT l.*, k.m AS m1, k.p AS p1 FROM l ASOF LEFT JOIN kn k ON k.chrom = l.chrom AND l.m <= k.m)
SELECT chrom, bin, CAST(trunc(coalesce(p0 + (m - m0) * (p1 - p0) / nullif(m1 - m0, 0), p0, p1)) AS BIGINT) AS pos FROM u"""


def two_panels(spark, d):
    s = X.sites(spark, d).withColumn("map", F.when(F.col("site_id") % 11 > 0, F.col("pos") * 1e-6))
    one = s.select("chrom", "pos", "ref", "alt", "map", "AFR_ref", "AFR_alt")
    two = s.where("site_id % 3 > 0").select("chrom", "pos", "ref", "alt", "map", F.lit(9).alias("AFR_ref"), F.lit(9).alias("AFR_alt"), "NEA_ref", "NEA_alt")
    return T.join_panels([one.unionByName(one), two], {"AFR": ["AFR"], "ARC": ["NEA", "VIN"]}, autosomes=True).select("chrom", "pos", r("map"), "AFR_ref", "AFR_alt", "ARC_ref", "ARC_alt")


def side_by_side(spark, d):
    s = X.sites(spark, d)
    f = lambda p, c: s.where(c).select("chrom", "pos", F.col(f"{p}_ref").alias("n_ref"), F.col(f"{p}_alt").alias("n_alt"))
    return T.join_genotypes({"a": f("AFR", "site_id % 2 = 0"), "b": f("NEA", "site_id % 3 = 0")})


def tagged(spark, d):
    b = PQ.bins(spark, d)
    return T.tagged_union({"one": b.where("chrom = '1'").select("chrom", "state"), "x": b.where("chrom = 'X'").select("chrom", "state", "pos")}).groupBy("sample", "chrom").agg(F.count(F.lit(1)).alias("n"), F.count("pos").alias("n_pos"))


def subset(spark, d):
    s = X.sites(spark, d)
    long = lambda n, c: s.select("chrom", "pos", F.lit(n).alias("sample"), F.col(c).cast("string").alias("gt"))
    v = long("a", "AFR_alt").unionByName(long("b", "NEA_alt")).unionByName(long("c", "DEN_alt"))
    return T.subset_samples(v, ["a", "c"], ["1", "2"]).unionByName(T.subset_samples(v, ["a", "c"], ["X"]))


def oriented(spark, d):
    s = X.sites(spark, d).select("site_id", "chrom", "pos", "ref", "alt")
    base = s.where("site_id % 7 > 0").select("chrom", "pos", F.when(F.col("site_id") % 3 == 0, F.col("alt")).when(F.col("site_id") % 3 == 1, F.col("ref")).otherwise("N").alias("base"))
    return S.orient_alleles(s, base).select("site_id", "ref", "alt", "kind")


def folded(spark, d):
    n = spark.range(1, 25).select(F.when(F.col("id") == 23, "X").when(F.col("id") == 24, "Y").otherwise(F.col("id").cast("string")).alias("chrom"))
    row, side = S.fold_chromosomes(F.col("chrom"))
    return n.select("chrom", row.alias("row"), side.alias("side"))


def group_keys(spark, d):
    """Sites with the statistics of their read groups, by a derived key of library and damage."""
    rd = X.reads(spark, d).select("site_id", F.concat_ws("_", "lib", P.damage_class(F.col("deam"), 3)).alias("key"), "is_alt")
    stats = rd.groupBy("key").agg(F.count(F.lit(1)).alias("n_key"), F.sum("is_alt").alias("alt_key"))
    return rd.groupBy("site_id", "key").agg(F.count(F.lit(1)).alias("n")).join(stats, "key").select("site_id", "key", "n", "n_key", "alt_key")


def site_bins(spark, d):
    return S.site_bins(X.sites(spark, d)).select("site_id", "bin")


def bed_limit(spark, d):
    s = X.sites(spark, d).groupBy("chrom", F.floor(F.col("pos") / 100000).alias("k")).agg(F.min("pos").alias("start"), (F.min("pos") + 40).alias("end"))
    return T.bed_positions(s.select("chrom", "start", "end"), "3", 100_000, 900_000, 100)


def alleles(spark, d):
    s = X.sites(spark, d)
    code = F.when(F.col("alt") == "C", "M").when(F.col("alt") == "G", "s").otherwise("T")
    return s.select("site_id", E.complement(F.col("ref")).alias("ref_c"), F.array_join(E.alleles_of(code), "").alias("bases"))


# --- reads -------------------------------------------------------------------------------------------------------
_REFSEQ = "substr('ACGTCCGGATTGCACGTACGGCATC', CAST(site_id % 10 AS INT) + 1, 12)"
_SEQ = f"CASE CAST(site_id % 3 AS INT) WHEN 0 THEN translate({_REFSEQ}, 'CG', 'TA') WHEN 1 THEN concat(substr({_REFSEQ}, 1, 5), translate(substr({_REFSEQ}, 6, 7), 'C', 'T')) ELSE {_REFSEQ} END"


def aligned(spark, d):
    return X.sites(spark, d).select("site_id", F.expr(_REFSEQ).alias("ref_seq"), F.expr(_SEQ).alias("seq"), (F.col("site_id") % 2 == 1).alias("reverse"))


def damage_ends(spark, d):
    five, three = P.damage_positions(F.col("seq"), F.col("ref_seq"), F.col("reverse"))
    return aligned(spark, d).select("site_id", five.alias("five"), three.alias("three"), P.damage_position(F.col("seq"), F.col("ref_seq"), F.col("reverse")).alias("nearer"))


_DMG = f"""{FX}, a AS (SELECT site_id, {_REFSEQ} AS r, {_SEQ} AS s, site_id % 2 = 1 AS rev FROM sites), h AS (SELECT *, [i FOR i IN range(1, 13) IF (NOT rev AND substr(r, i, 1) = 'C' AND substr(s, i, 1) = 'T') OR (rev AND substr(r, i, 1) = 'G' AND substr(s, i, 1) = 'A')] AS l FROM a),
e AS (SELECT site_id, CASE WHEN len(l) = 0 THEN -1 WHEN rev THEN 12 - list_max(l) ELSE list_min(l) - 1 END AS five, CASE WHEN len(l) = 0 THEN -1 WHEN rev THEN list_min(l) - 1 ELSE 12 - list_max(l) END AS three FROM h)"""


def piles(spark, d, keep_sites=False):
    """Reads of 12 bases that begin 3 bases before every site, over the sites."""
    s = X.sites(spark, d)
    rd = aligned(spark, d).join(s.select("site_id", "chrom", "pos"), "site_id").where("site_id % 5 > 0")
    rd = rd.select("chrom", (F.col("pos") - 3).alias("start"), (F.col("pos") + 8).alias("end"), "reverse", F.lit(30).alias("mapq"), F.when(F.col("site_id") % 13 == 0, "6M6S").otherwise("12M").alias("cigar"), "seq", F.array_repeat(F.lit(40), 12).alias("qual"), F.concat(F.lit("lib"), F.col("site_id") % 2, F.lit("-x")).alias("rg"), "ref_seq")
    return B.pileup(rd, s.select("chrom", "pos", "ref", "alt"), keep_sites=keep_sites)


def exact_counts(spark, d):
    return B.pileup_counts_exact(piles(spark, d))


def pileup_sites(spark, d):
    return piles(spark, d, True).groupBy("chrom", "pos").agg(F.count("base").alias("n"), F.max("base").alias("base"))


_PILE = f"""{_DMG}, rd AS (SELECT s.site_id, chrom, pos, ref, alt, a.s AS seq, a.rev, CASE WHEN five < three THEN five ELSE three END AS deam FROM sites s JOIN a USING (site_id) JOIN e USING (site_id) WHERE s.site_id % 5 > 0 AND s.site_id % 13 > 0),
pl AS (SELECT t.chrom, t.pos, t.ref, t.alt, 'lib' || rd.site_id % 2 AS lib, substr(rd.seq, CAST(t.pos - rd.pos + 4 AS INT), 1) AS base, rev, deam FROM rd JOIN sites t ON t.chrom = rd.chrom AND t.pos BETWEEN rd.pos - 3 AND rd.pos + 8)"""
_EXACT = (
    _PILE
    + """, dm AS (SELECT *, CASE WHEN (NOT rev AND base = 'T' AND ((ref = 'C' AND alt = 'T') OR (ref = 'T' AND alt = 'C'))) OR (rev AND base = 'A' AND ((ref = 'G' AND alt = 'A') OR (ref = 'A' AND alt = 'G'))) THEN 1 ELSE 0 END AS dmgsite FROM pl WHERE base = ref OR base = alt)
SELECT chrom, pos, count(*) FILTER (base = ref) AS tref, count(*) FILTER (base = alt) AS talt, lib, 12 AS len, CAST(deam AS INTEGER) AS deam, dmgsite FROM dm GROUP BY chrom, pos, lib, deam, dmgsite"""
)


def damage_sites(spark, d):
    rd = X.reads(spark, d).join(X.sites(spark, d).select("site_id", "ref", "alt"), "site_id")
    hit = P.explained_by_damage(F.when(F.col("is_alt") == 1, F.col("alt")).otherwise(F.col("ref")), F.translate("ref", "A", "T"), F.col("alt"), F.col("half") == 1)
    return rd.groupBy("lib").agg(F.count(F.when(hit, 1)).alias("hits"), F.count(F.lit(1)).alias("n"))


# --- tests and displays ------------------------------------------------------------------------------------------


def concordance_fisher(spark, d):
    return spark.createDataFrame([(round(P.fisher(PQ.concordance(spark, d)), 6),)], "p double")


_LC = lambda m, j: f"(lgamma({m} + 1) - lgamma({j} + 1) - lgamma({m} - {j} + 1))"
_FISHER = f"""WITH {PQ._BIN}, u AS (SELECT chrom, pos, bool_or(state LIKE '%NEA%') AS a, bool_or(state LIKE '%DEN%') AS b FROM b WHERE state IS NOT NULL GROUP BY 1, 2), t AS (SELECT CAST(count(*) FILTER (a AND b) AS DOUBLE) AS o, CAST(count(*) FILTER (a) AS DOUBLE) AS r1, CAST(count(*) FILTER (NOT a) AS DOUBLE) AS r2, CAST(count(*) FILTER (b) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM u),
x AS (SELECT t.*, CAST(unnest(range(CAST(greatest(0, k - r2) AS BIGINT), CAST(least(k, r1) AS BIGINT) + 1)) AS DOUBLE) AS x FROM t), l AS (SELECT x, o, {_LC('r1', 'x')} + {_LC('r2', '(k - x)')} - {_LC('n', 'k')} AS lp FROM x) SELECT round(least(1, sum(exp(lp))), 6) AS p FROM l WHERE lp <= (SELECT lp FROM l WHERE x = o) + 1e-7"""


def sizes(spark, d):
    return PQ.genes(spark, d).groupBy("chrom").agg(F.max("r_end").alias("size"))


def shuffled(spark, d):
    t = PQ.tracts(spark, d).where("type = 'state'").select("chrom", "start", "end").distinct()
    return P.shuffled_intervals(t, sizes(spark, d), ["chrom"], 3)


_SHUF = f"""WITH {PQ._TR}, iv AS (SELECT DISTINCT chrom, s, e FROM t WHERE type = 'state'), sz AS (SELECT chrom, max(re) AS size FROM ({PQ._GENE.replace('g AS (', '', 1)[:-1]}) GROUP BY 1), rp AS (SELECT unnest([1, 2, 3]) AS rep),
m AS (SELECT chrom, s, e, rep, CAST(floor(CAST('0x' || substr(md5('0|' || rep || '|' || chrom || '|' || s || '|' || e), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * greatest(size - (e - s), 1)) AS BIGINT) AS a FROM iv JOIN sz USING (chrom), rp)"""


def permutation(spark, d):
    """Length of state tracts that begin in the first 50 Mb of a chromosome, against shuffled copies."""
    stat = lambda df, *k: df.groupBy(*k).agg(F.sum(F.when(F.col("start") < 50_000_000, 1).otherwise(0)).alias("n"))
    t = PQ.tracts(spark, d).where("type = 'state'").select("chrom", "start", "end").distinct()
    return P.permutation_p(stat(t, "chrom"), stat(shuffled(spark, d), "chrom", "rep"), ["chrom"], "n").select("chrom", "n", r("p"))


def length_densities(spark, d):
    x = F.col("len")
    t = PQ.with_len(spark, d).select("sample", "chrom", "target", "type", "start", "end", "len")
    return t.select("sample", "chrom", "target", "type", "start", "end", F.round(L.truncated_exponential(x, 0.4, 1.0), 6).alias("exp"), F.round(L.truncated_lomax(x, 2.0, 1.5, 1.0), 6).alias("lomax"))


def cluster_order(spark, d):
    """Samples in display order; the matrix of sharing has a row per pair of samples, which reach the driver up to a bound."""
    m = E.sharing_moments(PQ.bins(spark, d).where(F.col("state").contains("NEA")).select("sample", "chrom", "pos"), ["chrom", "pos"], "sample", 3000).select("a", "b", "jaccard")
    rows = m.limit(E.MOST_PAIRS + 1).collect()
    names = sorted({r_[c] for r_ in rows for c in ("a", "b")})
    order = E.cluster_order(names, {(r_["a"], r_["b"]): r_["jaccard"] for r_ in rows}) if len(rows) <= E.MOST_PAIRS else names
    return spark.createDataFrame(pd.DataFrame({"place": range(len(order)), "sample": order}), "place int, sample string")


# --- estimation, step by step --------------------------------------------------------------------------------------


def hmm_em_step(spark, d):
    """One iteration of the EM: log-likelihood at the start and the transitions after it."""
    o = HQ.observed(spark, d).select("chrom", "bin", "pos", "lib", "tref", "talt", "p_cont")
    bins = S.genome_bins(X.sites(spark, d), "pos", 10000).select("chrom", "bin")
    fit = H.fit_hmm(o, HQ.snps(spark, d), bins, HQ.SPACE, HQ.PARAMS, max_iter=1, est_cont=False)
    n = HQ.SPACE.names
    return spark.createDataFrame([("ll", "", round(fit.ll[0], 3))] + [("trans", f"{a}>{b}", round(fit.params.trans[i][j], 5)) for i, a in enumerate(n) for j, b in enumerate(n)], "kind string, name string, value double")


_STEP = HQ._CHAIN + f", xi AS ({HQ._XI}), nm AS (SELECT unnest([0, 1, 2]) AS i, unnest(['AFR', 'NEA', 'AFRNEA']) AS n) SELECT 'll' AS kind, '' AS name, round(sum(ln(n) + s), 3) AS value FROM fwd UNION ALL SELECT 'trans', a.n || '>' || b.n, round(xi / sum(xi) OVER (PARTITION BY xi.i), 5) FROM xi JOIN nm a ON a.i = xi.i JOIN nm b ON b.i = xi.j"


def sfs_em_step(spark, d):
    """One EM step of the SFS model: every parameter and the log-likelihood before it."""
    p = M.em_step(SQ.data(spark, d), SQ.params(spark, d), M.SfsUpdates())
    f = M.to_frame(p)
    rows = [(a, b, round(float(v), 6)) for a, b, v in f[["parameter", "name", "value"]].itertuples(index=False, name=None)] + [("ll", "", round(p["0"].ll, 3))]
    return spark.createDataFrame(rows, "parameter string, name string, value double")


_CLIP = lambda x: f"least(greatest({x}, 1e-10), 1 - 1e-10)"
_SFS_STEP = f"""{SQ._B}, {SQ._POST}, {SQ._READS}, z AS (SELECT sfs, sum(g0) AS g0, sum(g1) AS g1, sum(g2) AS g2 FROM post GROUP BY 1), ir AS (SELECT *, {SQ._ISREF} AS q FROM rp),
e AS (SELECT sum(CASE WHEN allele = 1 THEN n * q END) AS err, sum(CASE WHEN allele = 0 THEN n * q END) AS ok, sum(CASE WHEN allele = 0 THEN n * (1 - q) END) AS bias, sum(CASE WHEN allele = 1 THEN n * (1 - q) END) AS nobias FROM ir)
SELECT 'tau' AS parameter, CAST(sfs AS VARCHAR) AS name, round({_CLIP(SQ._TF)}, 6) AS value FROM z UNION ALL SELECT 'f', CAST(sfs AS VARCHAR), round({_CLIP(f'least(greatest(1 - g1 / (2 * {SQ._TF} * (1 - {SQ._TF}) * (g0 + g1 + g2)), 0), 1)')}, 6) FROM z
UNION ALL SELECT 'cont', rg, round(sum(n * post_c) / sum(n), 6) FROM rp GROUP BY 2 UNION ALL SELECT 'e', '', round(err / (err + ok), 6) FROM e UNION ALL SELECT 'b', '', round(bias / (bias + nobias), 6) FROM e UNION ALL SELECT 'll', '', round(sum(ll), 3) FROM post"""


def runs_check(spark, d):
    """Simulated runs per chromosome: replicates, and the least and largest total length of one."""
    x = HQ.QUERIES["posterior_runs"][0](spark, d).groupBy("chrom", "it").agg(F.sum("len").alias("n"))
    return x.groupBy("chrom").agg(F.count(F.lit(1)).alias("replicates"), F.min("n").alias("least"), F.max("n").alias("most"))


def length_fit_check(spark, d):
    x = TR.fit_lengths(PQ.with_len(spark, d), ["target"], "len", PQ.TRUNC)
    return x.select("target", "n", r("rate", 4), r("ll_exp", 2), ((F.col("ll_lomax") >= F.col("ll_exp") - 1e-9) & F.col("p").between(0, 0.5)).alias("nested"))


_AGES = [5, 20, 50, 100, 200, 500]
_LIK = [f"({a / 100} * exp(-(x - 1.0) * {a / 100}))" for a in _AGES]
_DEN = "(" + " + ".join(f"{l} * w{k}" for k, l in enumerate(_LIK)) + ")"
_AGE = f"""{('WITH RECURSIVE ' + PQ._TR)}, h AS (SELECT target, round(len, 3) AS x, CAST(count(*) AS DOUBLE) AS n FROM t WHERE len >= 1 GROUP BY 1, 2),
em AS (SELECT target, 0 AS it, {', '.join(f'1 / 6.0::DOUBLE AS w{k}' for k in range(6))} FROM h GROUP BY 1 UNION ALL SELECT target, it + 1, {', '.join(f'sum(n * {l} * w{k} / greatest({_DEN}, 1e-300)) / sum(n)' for k, l in enumerate(_LIK))} FROM em JOIN h USING (target) WHERE it < 50 GROUP BY target, it)
""" + " UNION ALL ".join(f"SELECT target, CAST({a} AS DOUBLE) AS age, round(w{k}, 6) AS weight FROM em WHERE it = 50" for k, a in enumerate(_AGES))



def grouped_reads(spark, d):
    """Reads per site and read group, with the group's exact count."""
    c = P.count_reads(X.reads(spark, d), ["chrom", "pos", "lib", "len", "deam"])
    x, index = E.bin_read_groups(c, 3000, 2000)
    g = x.groupBy("chrom", "pos", "rg").agg(F.sum("tref").alias("tref"), F.sum("talt").alias("talt"))
    return g.join(index, "rg").select("chrom", "pos", "rg", "tref", "talt", "deam_cls", "len_cls", "n_exact")


def _cls(v, size, name):
    return f"{name}h AS (SELECT lib, {v}, count(*) AS n FROM reads WHERE {v} >= 0 GROUP BY 1, 2), {name}c AS (SELECT *, sum(n) OVER (PARTITION BY lib) AS t, sum(n) OVER (PARTITION BY lib ORDER BY {v} ROWS UNBOUNDED PRECEDING) - n AS b FROM {name}h), {name}k AS (SELECT lib, {v}, CAST(floor(b * least(greatest(floor(t / {size}.0), 1), 254) / t) AS INTEGER) AS {name} FROM {name}c)"


_GROUPED = f"""{FX}, {_cls('deam', 3000, 'deam_cls')}, {_cls('len', 2000, 'len_cls')}, x AS (SELECT r.chrom, r.pos, r.is_alt, r.lib, coalesce(deam_cls, 255) AS deam_cls, len_cls FROM reads r LEFT JOIN deam_clsk d ON d.lib = r.lib AND d.deam = r.deam JOIN len_clsk l ON l.lib = r.lib AND l.len = r.len),
y AS (SELECT *, lib || '_' || deam_cls || '_' || len_cls AS rg FROM x), n AS (SELECT rg, count(*) AS n_exact FROM y GROUP BY 1)
SELECT chrom, pos, rg, CAST(sum(1 - is_alt) AS BIGINT) AS tref, CAST(sum(is_alt) AS BIGINT) AS talt, deam_cls, len_cls, n_exact FROM y JOIN n USING (rg) GROUP BY ALL"""


def drift_genotypes(spark, d):
    return HQ._gt_query(spark, d, lambda a, b: [("AFR", L.genotype_homozygous(a[0], b[0], 0.25, 0.7)), ("NEA", L.genotype_homozygous(a[1], b[1], 0.0, 2.5))])


def _drift(p, f, tau):
    a, b = f"({p}_alt + 0.5)", f"({p}_ref + 0.5)"
    d = f"(({a} + {b}) * ({tau} * ({a} + {b}) + 1))"
    g0, g2 = f"(({b} * {b} * {tau} + {b} + {a} * {b} * {f} * {tau}) / {d})", f"(({a} * {a} * {tau} + {a} + {a} * {b} * {f} * {tau}) / {d})"
    return g0, f"(1 - {g0} - {g2})", g2


def sfs_tau_step(spark, d):
    """The step that moves tau alone: inbreeding, contamination and errors stay."""
    p = M.em_step(SQ.data(spark, d), SQ.params(spark, d), M.SfsUpdates(cont=False, f=False, error=False))["0"]
    return spark.createDataFrame([(int(k), round(v, 6), round(p.f[k], 6)) for k, v in p.tau.items()], "sfs int, tau double, f double")


def stationary_states(spark, d):
    from strandline.numeric import stationary

    t = np.array([[0.97, 0.03], [0.2, 0.8]])
    return spark.createDataFrame([(n, round(float(v), 6)) for n, v in zip(("AFR", "NEA"), stationary(t))], "state string, p double")


def parsed_states(spark, d):
    from strandline.states import parse_chroms, parse_states

    rows = [("state", k, p) for k, v in parse_states(["AFR", "ARC=NEA+DEN", "ARC=VIN"], {"DEN": ["D3", "D4"]}).items() for p in v] + [("chrom", c, "") for c in parse_chroms("20-22,X")]
    return spark.createDataFrame(rows, "kind string, name string, pop string")




def selected_tracts(spark, d):
    t = TR.select_tracts(PQ.with_len(spark, d), "2", 10_000_000, 120_000_000, min_length=2.0, targets=["NEA", "DEN"], types=["state", "homo"])
    return t.groupBy("sample", "target", "type").agg(F.count(F.lit(1)).alias("n"), r_sum("len"))


def r_sum(c, n=4):
    return F.round(F.sum(c), n).alias(c)


def run_occupancy(spark, d):
    """Shares of covered bins per target, over samples as replicates."""
    t = PQ.tracts(spark, d).where("type = 'state'").select(F.col("sample").alias("it"), F.col("target").alias("state"), (F.col("id_end") - F.col("id") + 1).alias("len")).where("len is not null")
    return TR.occupancy(t).select("state", *[r(c) for c in ("mean", "sd", "lower", "upper")])


_OCC = f"""WITH {PQ._TR}, u AS (SELECT sample AS it, target AS state, id_end - id + 1 AS len FROM t WHERE type = 'state' AND id_end - id IS NOT NULL), a AS (SELECT it, CAST(sum(len) AS DOUBLE) AS tot FROM u GROUP BY 1), p AS (SELECT it, state, sum(len) / min(tot) AS p FROM u JOIN a USING (it) GROUP BY 1, 2), k AS (SELECT count(DISTINCT it) AS k FROM u),
g AS (SELECT state, sum(p) AS s, sum(p * p) AS q, min(k) AS k FROM p, k GROUP BY 1), m AS (SELECT state, s / k AS mean, sqrt(greatest((q - k * (s / k) * (s / k)) / nullif(k - 1, 0), 0)) AS sd FROM g) SELECT state, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean - 1.96 * sd, 6) AS lower, round(mean + 1.96 * sd, 6) AS upper FROM m"""


def extrapolated(spark, d):
    """A squared extrapolation of two EM steps."""
    from strandline.numeric import squarem_step

    x = squarem_step(np.array([0.1, 0.5]), np.array([0.2, 0.46]), np.array([0.25, 0.44]))
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(x)], "i int, x double")


_SQ = "WITH v AS (SELECT unnest([0, 1]) AS i, unnest([0.1, 0.5])::DOUBLE AS a, unnest([0.2, 0.46])::DOUBLE AS b, unnest([0.25, 0.44])::DOUBLE AS c), s AS (SELECT least(-sqrt(sum((b - a) * (b - a)) / sum((c - 2 * b + a) * (c - 2 * b + a))), -1) AS al FROM v) SELECT CAST(i AS INTEGER) AS i, round(a - 2 * al * (b - a) + al * al * (c - 2 * b + a), 6) AS x FROM v, s"

QUERIES = {
    "selected_tracts": (selected_tracts, f"WITH {PQ._TR} SELECT sample, target, type, count(*) AS n, round(sum(len), 4) AS len FROM t WHERE chrom = '2' AND e >= 10000000 AND s <= 120000000 AND len >= 2 AND target IN ('NEA', 'DEN') AND type IN ('state', 'homo') GROUP BY 1, 2, 3"),
    "run_occupancy": (run_occupancy, _OCC),
    "squared_extrapolation": (extrapolated, _SQ),
    "grouped_reads": (grouped_reads, _GROUPED),
    "geno_given_state_drift": (drift_genotypes, FX + f" SELECT site_id, {HQ._gts('AFR', _drift('AFR', 0.25, 0.7))}, {HQ._gts('NEA', _drift('NEA', 0.0, 2.5))} FROM sites"),
    "sfs_m_step_tau": (sfs_tau_step, SQ._B + f", {SQ._POST}, z AS (SELECT sfs, sum(g0) AS g0, sum(g1) AS g1, sum(g2) AS g2 FROM post GROUP BY 1) SELECT CAST(sfs AS INTEGER) AS sfs, round({_CLIP(SQ._TF)}, 6) AS tau, CAST({SQ.INB} AS DOUBLE) AS f FROM z"),
    "stationary_states": (stationary_states, "SELECT 'AFR' AS state, round(CAST(0.2 AS DOUBLE) / 0.23, 6) AS p UNION ALL SELECT 'NEA', round(CAST(0.03 AS DOUBLE) / 0.23, 6)"),
    "parsed_states": (parsed_states, "SELECT * FROM (VALUES ('state', 'AFR', 'AFR'), ('state', 'ARC', 'NEA'), ('state', 'ARC', 'D3'), ('state', 'ARC', 'D4'), ('state', 'ARC', 'VIN'), ('chrom', '20', ''), ('chrom', '21', ''), ('chrom', '22', ''), ('chrom', 'X', '')) v(kind, name, pop)"),
    "age_mixture": (XQ.age_mixture, _AGE),
    "hmm_em_step": (hmm_em_step, _STEP),
    "sfs_em_step": (sfs_em_step, _SFS_STEP),
    "posterior_runs_check": (runs_check, FX + f", {_BINS} SELECT chrom, CAST(100 AS BIGINT) AS replicates, 2 * count(*) AS least, 2 * count(*) AS most FROM bins0 GROUP BY 1"),
    "length_fit_check": (
        length_fit_check,
        f"WITH {PQ._TR}, h AS (SELECT target, round(len, 4) - 1.0 AS x FROM t WHERE len >= 1), g AS (SELECT target, count(*) AS n, greatest(avg(x), 1e-12) AS m FROM h GROUP BY 1) SELECT target, n, round(1 / m, 4) AS rate, round(-n * ln(m) - n, 2) AS ll_exp, true AS nested FROM g",
    ),
    "hmm_forward_ll_haploid": (_ll(haploid=("X",)), FX + f", {_em(_ONX)}, {HQ._FWD}, {_FWDX}{_LLX}"),
    "hmm_forward_ll_gt": (_ll(calls=True), FX + f", {_em(HQ._STATES, _CALL)}, {HQ._FWD}{_LLS}"),
    "hmm_forward_ll_eb": (_ll(prior=None), FX + f", {_EBP}, {_em(_EBS, None, ', ebAFR eA, ebNEA eN')}, {HQ._FWD}{_LLS}"),
    "prior_columns": (with_priors, FX + f", {_oriented('AFR')}, {_oriented('NEA')} SELECT site_id, {_prior_cols('AFR')}, {_prior_cols('NEA')} FROM sites"),
    "additive_emissions": (additive, FX + f", {_BINS}, {_SNPB[len(_LIM) + 2 :]}, {HQ._LK} SELECT s.chrom, s.bin_in_chrom, {_ADD} FROM snpb s JOIN lw ON s.chrom = lw.chrom AND s.pos = lw.pos GROUP BY 1, 2"),
    "transition_matrix": (transition_matrix, _TM),
    "viterbi_runs": (viterbi_runs, f'WITH {PQ._BIN}, i AS (SELECT *, id - row_number() OVER (PARTITION BY sample, chrom, state ORDER BY id) AS k FROM b WHERE state IS NOT NULL) SELECT sample, chrom, state, min(id) AS start, max(id) AS "end", count(*) AS n FROM i GROUP BY sample, chrom, state, k'),
    "best_score_run": (best_score_run, _BEST),
    "recalled_runs": (recalled_runs, None),
    "sfs_site_table": (
        sfs_site_table,
        f"{SQ._B}, {SQ._POST}, n AS (SELECT site_id, CAST(sum(tref) AS BIGINT) AS tref, CAST(sum(talt) AS BIGINT) AS talt FROM obs GROUP BY 1) SELECT q.site_id AS snp, s.chrom, s.pos, ref, alt, tref, talt, " + ", ".join(f"round(least(log10(g{g} + 1e-40), 0), 3) AS log_g{g}" for g in range(3)) + ", round(g1 / 2 + g2, 6) AS p, q.sfs FROM post q JOIN sites s USING (site_id) JOIN n USING (site_id)",
    ),
    "sfs_call_table": (
        sfs_call_table,
        SQ._GT + f", z AS (SELECT g.*, p.NEA_der FROM gc g JOIN pol p USING (site_id)) SELECT sfs, count(*) AS n_snps, CAST(sum(CASE WHEN flipped THEN a ELSE 2 - a END) AS BIGINT) AS n_anc, CAST(sum(CASE WHEN flipped THEN 2 - a ELSE a END) AS BIGINT) AS n_der, round(sum(CASE WHEN flipped THEN 2 - a ELSE a END) / (2.0 * count(*)), 6) AS read_ratio, round(min(0.1 + 0.2 * NEA_der)::DOUBLE, 6) AS tau, CAST({SQ.INB} AS DOUBLE) AS f FROM z GROUP BY 1",
    ),
    "sfs_random_call_table": (
        lambda s, d: sfs_call_table(s, d, True).drop("tau", "f"),
        SQ._GT + " SELECT sfs, count(*) AS n_snps, CAST(sum(CASE WHEN flipped THEN least(a, 1) ELSE 1 - least(a, 1) END) AS BIGINT) AS n_anc, CAST(sum(CASE WHEN flipped THEN 1 - least(a, 1) ELSE least(a, 1) END) AS BIGINT) AS n_der, round(sum(CASE WHEN flipped THEN 1 - least(a, 1) ELSE least(a, 1) END) / CAST(count(*) AS DOUBLE), 6) AS read_ratio FROM gc GROUP BY 1",
    ),
    "sfs_vcf": (sfs_vcf, _VCF),
    "jackknife_slices": (jackknife_slices, _JK),
    "cont_by_group": (
        cont_by_lib,
        "WITH n AS (SELECT lib, CAST(sum(tref + talt) AS BIGINT) AS n_reads FROM target_file GROUP BY 1), x AS (SELECT *, string_split(lib, '_') AS p FROM cont WHERE cont IS NOT NULL) SELECT x.lib AS rg, CASE WHEN len(p) = 3 THEN p[1] ELSE x.lib END AS lib, CASE WHEN len(p) = 3 THEN p[2] ELSE '0' END AS len_bin, CASE WHEN len(p) = 3 THEN p[3] ELSE 'NA' END AS deam, round(cont, 6) AS cont, round(coalesce(error, 0), 6) AS error, n_reads, 7 AS n_snps FROM x LEFT JOIN n ON n.lib = x.lib",
    ),
    "bin_positions": (bin_positions, _BP),
    "panel_files": (
        two_panels,
        FX + " SELECT chrom, pos, round(pos * 1e-6, 6) AS map, AFR_ref, AFR_alt, CASE WHEN site_id % 3 > 0 THEN NEA_ref ELSE 0 END AS ARC_ref, CASE WHEN site_id % 3 > 0 THEN NEA_alt ELSE 0 END AS ARC_alt FROM sites WHERE site_id % 11 > 0 AND chrom <> 'X'",
    ),
    "genotypes_side_by_side": (
        side_by_side,
        FX + " SELECT chrom, pos, CASE WHEN site_id % 2 = 0 THEN AFR_ref ELSE 0 END AS a_ref, CASE WHEN site_id % 2 = 0 THEN AFR_alt ELSE 0 END AS a_alt, CASE WHEN site_id % 3 = 0 THEN NEA_ref ELSE 0 END AS b_ref, CASE WHEN site_id % 3 = 0 THEN NEA_alt ELSE 0 END AS b_alt FROM sites WHERE site_id % 2 = 0 OR site_id % 3 = 0",
    ),
    "tagged_union": (tagged, f"WITH {PQ._BIN} SELECT CASE chrom WHEN '1' THEN 'one' ELSE 'x' END AS sample, chrom, count(*) AS n, count(CASE WHEN chrom = 'X' THEN pos END) AS n_pos FROM b WHERE chrom IN ('1', 'X') GROUP BY 1, 2"),
    "vcf_subset": (subset, FX + " SELECT chrom, pos, 'a' AS sample, CAST(AFR_alt AS VARCHAR) AS gt FROM sites WHERE chrom IN ('1', '2', 'X') UNION ALL SELECT chrom, pos, 'c', CAST(DEN_alt AS VARCHAR) FROM sites WHERE chrom IN ('1', '2', 'X')"),
    "oriented_alleles": (
        oriented,
        FX + " SELECT site_id, CASE WHEN site_id % 7 > 0 AND site_id % 3 = 0 THEN alt ELSE ref END AS ref, CASE WHEN site_id % 7 > 0 AND site_id % 3 = 0 THEN ref ELSE alt END AS alt, CASE WHEN site_id % 7 = 0 THEN 'missing' WHEN site_id % 3 = 0 THEN 'swap' WHEN site_id % 3 = 1 THEN 'keep' ELSE 'mismatch' END AS kind FROM sites",
    ),
    "folded_chromosomes": (folded, "SELECT CASE id WHEN 23 THEN 'X' WHEN 24 THEN 'Y' ELSE CAST(id AS VARCHAR) END AS chrom, CAST(CASE WHEN id <= 11 THEN id WHEN id <= 22 THEN 23 - id ELSE id - 11 END AS INTEGER) AS row, CASE WHEN id BETWEEN 12 AND 22 THEN 'right' ELSE 'left' END AS side FROM (SELECT unnest(range(1, 25)) AS id)"),
    "site_group_stats": (
        group_keys,
        FX + ", k AS (SELECT site_id, lib || '_' || CASE WHEN deam >= 0 AND deam < 3 THEN 'deam' ELSE 'nodeam' END AS key, is_alt FROM reads), s AS (SELECT key, count(*) AS n_key, CAST(sum(is_alt) AS BIGINT) AS alt_key FROM k GROUP BY 1) SELECT site_id, key, count(*) AS n, n_key, alt_key FROM k JOIN s USING (key) GROUP BY ALL",
    ),
    "site_bins": (site_bins, FX + f" SELECT site_id, row_number() OVER (ORDER BY {RANK}, pos) - 1 AS bin FROM sites"),
    "bed_positions_limit": (
        bed_limit,
        FX + ", b AS (SELECT chrom, CAST(floor(pos / 100000.0) AS BIGINT) AS k, min(pos) AS p FROM sites WHERE chrom = '3' GROUP BY 1, 2) SELECT chrom, pos FROM (SELECT DISTINCT chrom, unnest(range(greatest(p, 99999) + 1, least(p + 40, 900000) + 1)) AS pos FROM b) ORDER BY pos LIMIT 100",
    ),
    "allele_codes": (alleles, FX + " SELECT site_id, translate(ref, 'ACGT', 'TGCA') AS ref_c, CASE alt WHEN 'C' THEN 'AC' WHEN 'G' THEN 'CG' ELSE 'T' END AS bases FROM sites"),
    "damage_ends": (damage_ends, _DMG + " SELECT site_id, CAST(five AS INTEGER) AS five, CAST(three AS INTEGER) AS three, CAST(least(five, three) AS INTEGER) AS nearer FROM e"),
    "pileup_exact_counts": (exact_counts, _EXACT),
    "pileup_all_sites": (pileup_sites, _PILE + " SELECT s.chrom, s.pos, count(base) AS n, max(base) AS base FROM sites s LEFT JOIN pl ON pl.chrom = s.chrom AND pl.pos = s.pos GROUP BY 1, 2"),
    "damage_sites": (
        damage_sites,
        FX + ", x AS (SELECT lib, half, CASE WHEN is_alt = 1 THEN alt ELSE ref END AS b, translate(ref, 'A', 'T') AS r, alt AS a FROM reads JOIN sites USING (site_id)) SELECT lib, count(*) FILTER ((half = 0 AND b = 'T' AND ((r = 'C' AND a = 'T') OR (r = 'T' AND a = 'C'))) OR (half = 1 AND b = 'A' AND ((r = 'G' AND a = 'A') OR (r = 'A' AND a = 'G')))) AS hits, count(*) AS n FROM x GROUP BY 1",
    ),
    "concordance_fisher": (concordance_fisher, _FISHER),
    "shuffled_intervals": (shuffled, _SHUF + ' SELECT chrom, rep, a AS start, a + e - s AS "end" FROM m'),
    "permutation_test": (
        permutation,
        _SHUF + ", ob AS (SELECT chrom, CAST(sum(CASE WHEN s < 50000000 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM iv GROUP BY 1), nu AS (SELECT chrom, rep, sum(CASE WHEN a < 50000000 THEN 1 ELSE 0 END) AS n FROM m GROUP BY 1, 2) SELECT ob.chrom, ob.n, round(avg(CASE WHEN nu.n > ob.n THEN 1.0 ELSE 0.0 END), 6) AS p FROM ob JOIN nu USING (chrom) GROUP BY 1, 2",
    ),
    "length_densities": (
        length_densities,
        f'WITH {PQ._TR} SELECT sample, chrom, target, type, s AS start, e AS "end", CASE WHEN len >= 1 THEN round(ln(0.4) - 0.4 * (len - 1), 6) END AS exp, CASE WHEN len >= 1 THEN round(ln(1.5 / 2.0) - 2.5 * ln(1 + len / 2.0) + 1.5 * ln(1.5), 6) END AS lomax FROM t',
    ),
    "cluster_order": (cluster_order, None),
    "f_jackknife": (SQ.summary(FS.f2, ["A", "B"], "f2"), SQ._sum(SQ._F2, ["A", "B"], "f2")),
}
