"""Queries over panels, read counts and bins of the fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import sites as S
from strandline.plans import fixture as X

FX = X.FIXTURE_SQL
POPS = ["AFR", "NEA", "DEN"]
RANK = "CASE WHEN chrom = 'X' THEN 23 ELSE CAST(chrom AS INTEGER) END"
R = 6


def _freq(p: str) -> str:
    return f"coalesce(CAST({p}_alt AS DOUBLE) / nullif({p}_alt + {p}_ref, 0), 0)"


def _pick(*cols):
    return lambda df: df.select(*cols)


_LIM = f"""lim AS (SELECT chrom, CAST(floor(min(pos) / 10000.0) AS BIGINT) AS lo, greatest(CAST(ceil(max(pos) / 10000.0) AS BIGINT) - CAST(floor(min(pos) / 10000.0) AS BIGINT), 1) AS n FROM sites GROUP BY chrom),
off AS (SELECT *, coalesce(sum(n) OVER (ORDER BY {RANK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_bin FROM lim)"""
_BINS = f"""{_LIM}, bins0 AS (SELECT chrom, b AS bin_in_chrom, (lo + b) * 10000 AS start, CAST(first_bin + b AS BIGINT) AS bin FROM (SELECT chrom, lo, first_bin, unnest(range(n)) AS b FROM off))"""
_SNPB = f"""{_LIM}, snpb AS (SELECT s.*, least(CAST(floor(pos / 10000.0) AS BIGINT) - lo, n - 1) AS bin_in_chrom, CAST(first_bin + least(CAST(floor(pos / 10000.0) AS BIGINT) - lo, n - 1) AS BIGINT) AS bin FROM sites s JOIN off USING (chrom))"""


def bin_snp_counts(spark, d):
    s = S.snp_bins(X.sites(spark, d), "pos", 10000)
    b = S.genome_bins(X.sites(spark, d), "pos", 10000)
    n = s.groupBy("chrom", "bin").agg(F.count(F.lit(1)).alias("n_snps"))
    return b.join(n, ["chrom", "bin"], "left").select("chrom", "bin", "start", F.coalesce("n_snps", F.lit(0)).alias("n_snps"))


def map_interpolate(spark, d):
    s = X.sites(spark, d)
    knots = s.groupBy("chrom", F.floor(F.col("pos") / 30000)).agg(F.min("pos").alias("pos")).select("chrom", "pos", (F.col("pos") * 1e-6).alias("m"))
    return S.interpolate_map(s.select("chrom", "pos"), knots, "pos", "pos", "m").select("chrom", "pos", F.round("map", R).alias("map"))


def _blocks(mode, size):
    return lambda spark, d: S.block_ids(X.sites(spark, d), mode, size).groupBy("chrom", "block").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def _blocks_sql(mode, size):
    total, at = ("n", "rn") if mode == "snp" else ("span", "pos - lo")
    return FX + f""", lim AS (SELECT chrom, count(*) AS n, min(pos) AS lo, max(pos) - min(pos) + 1 AS span FROM sites GROUP BY 1),
k AS (SELECT *, ceil({total} / greatest(floor({total} / {size}.0), 1)) AS each FROM lim),
j AS (SELECT s.chrom, s.pos, row_number() OVER (PARTITION BY s.chrom ORDER BY s.pos) - 1 AS rn, k.each, k.lo FROM sites s JOIN k USING (chrom))
SELECT chrom, CAST(floor(({at}) / each) AS BIGINT) AS block, count(*) AS n, min(pos) AS first, max(pos) AS last FROM j GROUP BY 1, 2"""


_FLIP = "(PAN_ref = 0 AND PAN_alt > 0)"


def eb_prior(spark, d):
    return S.empirical_prior(X.sites(spark, d), POPS).select("pop", F.round("pa", R).alias("pa"), F.round("pb", R).alias("pb"))


def eb_prior_ancestral(spark, d):
    return S.oriented_prior(X.sites(spark, d), POPS, "PAN").select("pop", F.round("p_der", R).alias("p_der"), F.round("p_anc", R).alias("p_anc"))


_LONG = " UNION ALL ".join(f"SELECT '{p}' AS pop, CAST({p}_alt AS DOUBLE) AS a, CAST({p}_ref AS DOUBLE) AS b FROM sites" for p in POPS)
_PRIOR = """ms AS (SELECT pop, {mean} AS f, {var} AS v, avg(a + b) AS n FROM long GROUP BY 1),
ab AS (SELECT *, f * (1 - f) AS h, (f * (1 - f) - v) / nullif(v - f * (1 - f) / n, 0) AS ab FROM ms)"""

QUERIES = {
    "panel_target_join": (
        lambda s, d: X.obs(s, d).select("chrom", "pos", "lib", "tref", "talt").join(X.sites(s, d), ["chrom", "pos"]).select("chrom", "pos", "lib", "tref", "talt", "ref", "alt", "AFR_alt", "NEA_alt"),
        FX + " SELECT o.chrom, o.pos, lib, tref, talt, ref, alt, AFR_alt, NEA_alt FROM obs o JOIN sites s ON o.chrom = s.chrom AND o.pos = s.pos",
    ),
    "state_merge": (
        lambda s, d: S.merge_states(X.sites(s, d), {"AFR": ["AFR"], "ARC": ["NEA", "DEN"]}, ["chrom", "pos"]),
        FX + " SELECT chrom, pos, AFR_ref, AFR_alt, NEA_ref + DEN_ref AS ARC_ref, NEA_alt + DEN_alt AS ARC_alt FROM sites",
    ),
    "ancestral_filter": (lambda s, d: S.with_data(X.sites(s, d), "PAN").select("site_id"), FX + " SELECT site_id FROM sites WHERE PAN_ref + PAN_alt > 0"),
    "cont_filter": (lambda s, d: S.with_data(X.sites(s, d), "DEN").select("site_id"), FX + " SELECT site_id FROM sites WHERE DEN_ref + DEN_alt > 0"),
    "delta_filter": (
        lambda s, d: S.delta_filter(X.sites(s, d), POPS, 0.55).select("site_id"),
        FX + f" SELECT site_id FROM sites WHERE abs({_freq('AFR')} - {_freq('NEA')}) >= 0.55 OR abs({_freq('AFR')} - {_freq('DEN')}) >= 0.55 OR abs({_freq('NEA')} - {_freq('DEN')}) >= 0.55",
    ),
    "coverage_filter": (
        lambda s, d: S.coverage_filter(X.obs(s, d), 0.05).select("site_id", "lib", "tref", "talt"),
        FX + ", q AS (SELECT quantile_cont(tref + talt, 0.95) AS top FROM obs) SELECT site_id, lib, tref, talt FROM obs, q WHERE tref + talt > 0 AND tref + talt <= top",
    ),
    "autosomes_only": (lambda s, d: S.autosomes_only(X.sites(s, d)).groupBy("chrom").agg(F.count(F.lit(1)).alias("n")), FX + " SELECT chrom, count(*) AS n FROM sites WHERE chrom NOT IN ('X', 'Y', 'Z', 'W') GROUP BY 1"),
    "position_mode": (lambda s, d: X.sites(s, d).select("site_id", F.col("pos").cast("double").alias("map")), FX + " SELECT site_id, CAST(pos AS DOUBLE) AS map FROM sites"),
    "first_site_per_bin": (
        lambda s, d: S.first_per_key(S.snp_bins(X.sites(s, d), "pos", 10000), ["bin"], ["pos"]).select("bin", "site_id", "pos"),
        FX + f", {_SNPB} SELECT bin, arg_min(site_id, pos) AS site_id, min(pos) AS pos FROM snpb GROUP BY bin",
    ),
    "greedy_thin_pos": (
        lambda s, d: S.greedy_thin(X.sites(s, d).select("chrom", "pos"), "pos", 12000),
        FX + ", kept AS (SELECT chrom, min(pos) AS pos FROM sites GROUP BY 1 UNION ALL SELECT chrom, pos FROM (SELECT k.chrom, min(s.pos) AS pos FROM kept k JOIN sites s ON s.chrom = k.chrom AND s.pos > k.pos + 12000 GROUP BY k.chrom)) SELECT chrom, pos FROM kept",
    ),
    "polarize_sites": (
        lambda s, d: S.polarize(X.sites(s, d), ["AFR", "NEA"], "PAN").select("site_id", "flipped", "AFR_anc", "AFR_der", "NEA_anc", "NEA_der"),
        FX + f" SELECT site_id, {_FLIP} AS flipped, " + ", ".join(f"CASE WHEN {_FLIP} THEN {p}_alt ELSE {p}_ref END AS {p}_anc, CASE WHEN {_FLIP} THEN {p}_ref ELSE {p}_alt END AS {p}_der" for p in ("AFR", "NEA")) + " FROM sites",
    ),
    "cont_freq": (
        lambda s, d: X.sites(s, d).select("site_id", F.round(S.cont_freq("AFR", 0.5, 0.5), R).alias("p_cont"), F.round(S.cont_freq("PAN"), R).alias("psi")),
        FX + " SELECT site_id, round((AFR_alt + 0.5) / (AFR_alt + AFR_ref + 1.0), 6) AS p_cont, round(CAST(PAN_alt AS DOUBLE) / nullif(PAN_alt + PAN_ref, 0), 6) AS psi FROM sites",
    ),
    "sex_ratio": (
        lambda s, d: S.guess_sex(X.sites(s, d), X.obs(s, d)).select(*[F.round(c, R).alias(c) for c in ("x_cov", "a_cov", "ratio")], "sex"),
        FX + """, n AS (SELECT count(*) FILTER (chrom = 'X') AS nx, count(*) FILTER (chrom <> 'X') AS na FROM sites), r AS (SELECT sum(tref + talt) FILTER (chrom = 'X') AS rx, sum(tref + talt) FILTER (chrom <> 'X') AS ra FROM obs),
c AS (SELECT CAST(rx AS DOUBLE) / nx AS x_cov, CAST(ra AS DOUBLE) / na AS a_cov FROM n, r) SELECT round(x_cov, 6) AS x_cov, round(a_cov, 6) AS a_cov, round(x_cov / a_cov, 6) AS ratio, CASE WHEN x_cov / a_cov < 0.75 THEN 'm' ELSE 'f' END AS sex FROM c""",
    ),
    "ploidy_class": (
        lambda s, d: X.sites(s, d).select("chrom").distinct().select("chrom", S.ploidy(F.col("chrom"), "m").alias("male"), S.ploidy(F.col("chrom"), "f").alias("female")),
        FX + " SELECT DISTINCT chrom, CASE WHEN chrom IN ('Y', 'W', 'X') THEN 1 ELSE 2 END AS male, CASE WHEN chrom IN ('Y', 'W', 'Z') THEN 1 ELSE 2 END AS female FROM sites",
    ),
    "genome_bins": (lambda s, d: S.genome_bins(X.sites(s, d), "pos", 10000), FX + f", {_BINS} SELECT * FROM bins0"),
    "snp_to_bin": (lambda s, d: S.snp_bins(X.sites(s, d), "pos", 10000).select("site_id", "bin_in_chrom", "bin"), FX + f", {_SNPB} SELECT site_id, bin_in_chrom, bin FROM snpb"),
    "bin_snp_counts": (bin_snp_counts, FX + f", {_BINS}, {_SNPB[len(_LIM) + 2 :]} SELECT b.chrom, b.bin, b.start, count(s.site_id) AS n_snps FROM bins0 b LEFT JOIN snpb s ON s.bin = b.bin GROUP BY 1, 2, 3"),
    "snp_ids": (lambda s, d: S.snp_ids(X.sites(s, d)).select("site_id", "snp_id"), FX + f" SELECT site_id, row_number() OVER (ORDER BY {RANK}, pos) - 1 AS snp_id FROM sites"),
    "map_interpolate": (
        map_interpolate,
        FX + """, knots AS (SELECT chrom, CAST(min(pos) AS DOUBLE) AS p, min(pos) * 1e-6 AS m FROM sites GROUP BY chrom, floor(pos / 30000.0)), pts AS (SELECT chrom, pos FROM sites),
a AS (SELECT p.chrom, p.pos, k.p AS p0, k.m AS m0 FROM pts p ASOF LEFT JOIN knots k ON p.chrom = k.chrom AND p.pos >= k.p), b AS (SELECT a.*, k.p AS p1, k.m AS m1 FROM a ASOF LEFT JOIN knots k ON a.chrom = k.chrom AND a.pos <= k.p)
SELECT chrom, pos, round(coalesce(m0 + (pos - p0) * (m1 - m0) / nullif(p1 - p0, 0), m0, m1), 6) AS map FROM b""",
    ),
    "block_ids_snp": (_blocks("snp", 30), _blocks_sql("snp", 30)),
    "block_ids_bp": (_blocks("bp", 120000), _blocks_sql("bp", 120000)),
    "block_ids_chrom": (_blocks("chrom", 0), FX + " SELECT chrom, CAST(0 AS BIGINT) AS block, count(*) AS n, min(pos) AS first, max(pos) AS last FROM sites GROUP BY 1"),
    "eb_prior": (
        eb_prior,
        FX + f", long AS ({_LONG}), " + _PRIOR.format(mean="0.5", var="avg(pow(a / (a + b) - 0.5, 2))") + " SELECT pop, round(CASE WHEN h = 0 OR n < ab THEN 1e-6 ELSE greatest(f * ab, 1e-5) END, 6) AS pa, round(CASE WHEN h = 0 OR n < ab THEN 1e-6 ELSE greatest((1 - f) * ab, 1e-5) END, 6) AS pb FROM ab",
    ),
    "eb_prior_ancestral": (
        eb_prior_ancestral,
        FX + ", long AS (" + " UNION ALL ".join(f"SELECT '{p}' AS pop, CAST(CASE WHEN {_FLIP} THEN {p}_ref ELSE {p}_alt END AS DOUBLE) AS a, CAST(CASE WHEN {_FLIP} THEN {p}_alt ELSE {p}_ref END AS DOUBLE) AS b FROM sites WHERE (PAN_ref > 0) <> (PAN_alt > 0)" for p in POPS) + "), "
        + _PRIOR.format(mean="avg(a / (a + b))", var="var_pop(a / (a + b))") + " SELECT pop, round(CASE WHEN h = 0 OR n < ab THEN 1e-6 ELSE greatest(f * ab, 1e-5) END, 6) AS p_der, round(CASE WHEN h = 0 OR n < ab THEN 1e-6 ELSE greatest((1 - f) * ab, 1e-5) END, 6) AS p_anc FROM ab",
    ),
}
