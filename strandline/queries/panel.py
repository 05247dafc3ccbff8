"""Queries over bins, tracts and read groups of many samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.canon import SOURCES, canon_chrom, canon_name, canon_sources
from strandline.functions.likelihood import admixture_generations
from strandline.operators import panelstats as P
from strandline.operators import sites as S
from strandline.operators import tracts as TR
from strandline.plans import fixture as X
from strandline.plans.tables import table
from strandline.queries.general import WS, chrom_sql
from strandline.queries.sites import FX
from strandline.states import StateSpace

SPACE = StateSpace(("AFR", "NEA", "DEN"))
POPS = ["AFR", "NEA", "DEN", "PAN"]
GENE = 1_000_000
TRUNC = 1.0


def r(c, n=6):
    return F.round(c, n).alias(c)


def bins(spark, d):
    """One row per (sample, id): canonical chromosome and state, posteriors."""
    b = table(spark, d, "bins").select(F.trim("sample").alias("sample"), canon_chrom("chrom").alias("chrom"), "id", canon_sources("viterbi").alias("state"), F.col("pos").cast("long").alias("pos"), *SPACE.names)
    return b.groupBy("sample", "chrom", "id").agg(F.max("state").alias("state"), F.max("pos").alias("pos"), *[F.max(s).alias(s) for s in SPACE.names])


def tracts(spark, d):
    """Distinct calls with a sample: canonical names, ends in order, lengths in cM."""
    end = F.coalesce(F.col("pos_end").cast("long"), F.round(F.col("map_end") * 1e6).cast("long"))
    f = table(spark, d, "frags").select(canon_name("sample").alias("sample"), canon_chrom("chrom").alias("chrom"), "target", "type", F.col("pos").cast("long").alias("p"), end.alias("e"), "id", "id_end").where("sample is not null")
    return f.select("sample", "chrom", "target", "type", F.least("p", "e").alias("start"), F.greatest("p", "e").alias("end"), F.least("id", "id_end").alias("id"), F.greatest("id", "id_end").alias("id_end")).distinct()


def with_len(spark, d):
    return tracts(spark, d).withColumn("len", (F.col("end") - F.col("start")) / 1e6)


def genes(spark, d):
    """A stand-in for a gene list: from the first to the last panel site of every Mb, with the mean African frequency."""
    r_ = table(spark, d, "reference_file").select(canon_chrom("chrom").alias("chrom"), F.col("pos").cast("long").alias("pos"), "AFR_alt", "AFR_ref")
    g = r_.groupBy("chrom", F.floor(F.col("pos") / GENE).alias("mb")).agg(F.min("pos").alias("r_start"), F.max("pos").alias("r_end"), F.count(F.lit(1)).alias("n"), (F.sum("AFR_alt") / F.nullif(F.sum(F.col("AFR_alt") + F.col("AFR_ref")), F.lit(0))).alias("score"))
    return g.withColumn("gene", F.concat_ws("-", "chrom", F.col("mb").cast("string"))).drop("mb")


def run_targets(spark, d):
    t = TR.target_posteriors(bins(spark, d), SPACE, ["sample", "chrom", "id"])
    return t.groupBy("sample", "target", "type").agg(F.round(F.sum("p"), 3).alias("p"), F.count(F.lit(1)).alias("n"))


def max_score_runs(spark, d):
    t = TR.target_posteriors(bins(spark, d), SPACE, ["sample", "chrom", "id"]).where("type = 'state'")
    runs = TR.call_runs(t, ["sample", "chrom", "target"], "id")
    b = bins(spark, d).select("sample", "chrom", "id", (F.col("pos") * 1e-6).alias("map"), "pos")
    return TR.run_coordinates(runs, b, ["sample", "chrom"], "id")


def run_coords(spark, d):
    t = tracts(spark, d).select("sample", "chrom", "target", "type", F.col("id").alias("start"), F.col("id_end").alias("end"), F.lit(1.0).alias("score")).distinct()
    b = bins(spark, d).select(F.lower("sample").alias("sample"), "chrom", "id", (F.col("pos") * 1e-6).alias("map"), "pos")
    c = TR.run_coordinates(t, b, ["sample", "chrom"], "id")
    return c.select("sample", "chrom", "target", "type", "start", "end", "pos", "pos_end", "len", r("map_len"), "pos_len", r("nscore"))


def fragment_islands(spark, d):
    # positions on the genome grid: bins are 1 Mb wide
    x = TR.explode_bins(tracts(spark, d).where("type = 'state'").select("chrom", "sample", F.floor(F.col("start") / GENE).alias("start"), F.floor(F.col("end") / GENE).alias("end")))
    per = x.groupBy("chrom", "bin").agg(F.countDistinct("sample").alias("n_samples"))
    isl = TR.fragment_islands(per, ["chrom"], "bin", 1)
    return isl.groupBy("chrom", "island").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.max("n_samples").alias("most"))


def bool_rle_smooth(spark, d):
    b = bins(spark, d).withColumn("hit", F.coalesce(F.col("state").contains("NEA"), F.lit(False)))
    return TR.smooth_runs(b, ["sample", "chrom"], "id", "hit", 2)


def cov_types(spark, d):
    """Sharing of NEA bins between samples: pair counts."""
    b = bins(spark, d).where(F.col("state").contains("NEA"))
    return P.pairwise_sharing(b.select("sample", "chrom", "pos"), ["chrom", "pos"], "sample")


def concordance(spark, d):
    b = bins(spark, d).where("state is not null").select("chrom", "pos", "state")
    return P.concordance(b.where(F.col("state").contains("NEA")), b.where(F.col("state").contains("DEN")), b, ["chrom", "pos"])


def _samples(spark, d):
    s = table(spark, d, "samples").where("sample is not null")
    sex = F.lower(F.substring(F.trim("sex"), 1, 1))
    return s.groupBy(canon_name("sample").alias("sample")).agg(F.max("age").alias("age"), F.max("pop").alias("pop"), F.max(F.when(sex.isin("m", "f"), sex)).alias("sex"))


def age_carriers(spark, d):
    s = _samples(spark, d).withColumn("era", F.when(F.col("age").isNull(), "unknown").when(F.col("age") < 10000, "recent").when(F.col("age") < 30000, "middle").otherwise("old"))
    size = s.groupBy("era").agg(F.count(F.lit(1)).alias("n_era"))
    b = bins(spark, d).where(F.col("state").contains("NEA")).select(F.lower("sample").alias("sample"), "chrom", "pos")
    n = b.join(s, "sample").groupBy("era", "chrom", "pos").agg(F.countDistinct("sample").alias("n"))
    return n.join(size, "era").select("era", "chrom", "pos", "n", F.round(F.col("n") / F.col("n_era"), 6).alias("share"))


def chrom_limits(spark, d):
    from strandline.functions.canon import genetic_position

    x = table(spark, d, "reference_file").select(canon_chrom("chrom").alias("chrom"), "pos", genetic_position("map").alias("m"))
    x = x.select("chrom", "pos", F.col("m").alias("map"), F.when(F.col("m").isNotNull(), F.col("pos") * 1e-6).alias("even"))
    return P.map_limits(x, ["map", "even"])


def allele_join(spark, d):
    """Panel sites against the same sites with swapped alleles: flip detection."""
    s = X.sites(spark, d).select("chrom", "pos", "ref", "alt", "NEA_alt")
    o = X.obs(spark, d).groupBy("chrom", "pos", "site_id").agg(F.sum("talt").alias("talt"))
    o = o.withColumn("swap", F.col("talt") > 10).select("chrom", "pos", "swap")
    g = o.join(s, ["chrom", "pos"]).select("chrom", "pos", F.when(F.col("swap"), F.col("alt")).otherwise(F.col("ref")).alias("g_ref"), F.when(F.col("swap"), F.col("ref")).otherwise(F.col("alt")).alias("g_alt"))
    j = s.join(g, ["chrom", "pos"], "left")
    kind = F.when((F.col("ref") == F.col("g_ref")) & (F.col("alt") == F.col("g_alt")), "same").when((F.col("ref") == F.col("g_alt")) & (F.col("alt") == F.col("g_ref")), "flipped").otherwise("mismatch")
    return j.select("chrom", "pos", kind.alias("kind"), F.when(kind == "flipped", 4 - F.col("NEA_alt")).otherwise(F.col("NEA_alt")).alias("nea"))


def quantile_bins(spark, d):
    x = P.quantile_bins(genes(spark, d), "n", 5, "bin")
    return x.groupBy("bin").agg(F.count(F.lit(1)).alias("genes"), F.min("n").alias("lo"), F.max("n").alias("hi"))


_BIN = f"""b AS (SELECT trim(sample) AS sample, {chrom_sql()} AS chrom, id, max(nullif({' || '.join(f"CASE WHEN upper(viterbi) LIKE '%{s}%' THEN '{s}' ELSE '' END" for s in SOURCES)}, '')) AS state, max(CAST(pos AS BIGINT)) AS pos, {', '.join(f'max({s}) AS {s}' for s in SPACE.names)} FROM bins GROUP BY 1, 2, 3)"""
_TR = f"""t0 AS (SELECT lower(trim(sample, {WS})) AS sample, {chrom_sql()} AS chrom, target, type, CAST(pos AS BIGINT) AS p, coalesce(CAST(pos_end AS BIGINT), CAST(round(map_end * 1e6) AS BIGINT)) AS e, id, id_end FROM frags),
t AS (SELECT DISTINCT sample, chrom, target, type, least(p, e) AS s, greatest(p, e) AS e, least(id, id_end) AS id, greatest(id, id_end) AS id_end, (greatest(p, e) - least(p, e)) / 1e6 AS len FROM t0 WHERE sample <> '')"""
_GENE = f"""g AS (SELECT {chrom_sql()} AS chrom, CAST(floor(pos / 1000000.0) AS BIGINT) AS mb, min(CAST(pos AS BIGINT)) AS rs, max(CAST(pos AS BIGINT)) AS re, count(*) AS n, CAST(sum(AFR_alt) AS DOUBLE) / nullif(sum(AFR_alt + AFR_ref), 0) AS score FROM reference_file GROUP BY 1, 2)"""
_TGT = " UNION ALL ".join(f"SELECT sample, '{n}' AS target, '{t}' AS type, {' + '.join(cols)} AS p FROM b" for n, t, cols in SPACE.run_targets())
_SMP = f"sm AS (SELECT lower(trim(sample)) AS sample, max(age) AS age FROM samples WHERE sample IS NOT NULL GROUP BY 1)"

QUERIES = {
    "run_targets": (run_targets, f"WITH {_BIN}, x AS ({_TGT}) SELECT sample, target, type, round(sum(p), 3) AS p, count(*) AS n FROM x GROUP BY 1, 2, 3"),
    "max_score_runs": (max_score_runs, None),
    "run_coords": (
        run_coords,
        f"""WITH {_BIN}, {_TR}, u AS (SELECT DISTINCT sample, chrom, target, type, id, id_end FROM t) SELECT u.sample, u.chrom, u.target, u.type, u.id AS start, u.id_end AS "end", a.pos, z.pos AS pos_end, u.id_end - u.id AS len, round(z.pos * 1e-6 - a.pos * 1e-6, 6) AS map_len, z.pos - a.pos AS pos_len, round(1.0 / nullif(u.id_end - u.id, 0), 6) AS nscore
FROM u LEFT JOIN b a ON lower(a.sample) = u.sample AND a.chrom = u.chrom AND a.id = u.id LEFT JOIN b z ON lower(z.sample) = u.sample AND z.chrom = u.chrom AND z.id = u.id_end""",
    ),
    "run_length_hist": (lambda s, d: tracts(s, d).groupBy("target", "type", (F.col("id_end") - F.col("id")).alias("len")).agg(F.count(F.lit(1)).alias("n")), f"WITH {_TR} SELECT target, type, id_end - id AS len, count(*) AS n FROM t GROUP BY 1, 2, 3"),
    "fragment_islands": (
        fragment_islands,
        f"""WITH {_TR}, x AS (SELECT chrom, sample, unnest(range(CAST(floor(s / 1000000.0) AS BIGINT), CAST(floor(e / 1000000.0) AS BIGINT) + 1)) AS bin FROM t WHERE type = 'state'), p AS (SELECT chrom, bin, count(DISTINCT sample) AS n FROM x GROUP BY 1, 2),
i AS (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY chrom ORDER BY bin) > 1 THEN 1 ELSE 0 END AS nw FROM p), k AS (SELECT *, sum(nw) OVER (PARTITION BY chrom ORDER BY bin ROWS UNBOUNDED PRECEDING) AS island FROM i) SELECT chrom, CAST(island AS BIGINT) AS island, min(bin) AS first, max(bin) AS last, max(n) AS most FROM k GROUP BY 1, 2""",
    ),
    "bool_rle_smooth": (
        bool_rle_smooth,
        f"""WITH {_BIN}, h AS (SELECT sample, chrom, id FROM b WHERE state LIKE '%NEA%'), i AS (SELECT *, CASE WHEN id - lag(id) OVER (PARTITION BY sample, chrom ORDER BY id) > 3 THEN 1 ELSE 0 END AS nw FROM h), k AS (SELECT *, sum(nw) OVER (PARTITION BY sample, chrom ORDER BY id ROWS UNBOUNDED PRECEDING) AS g FROM i)
SELECT sample, chrom, min(id) AS start, max(id) AS "end", max(id) - min(id) + 1 AS n FROM k GROUP BY sample, chrom, g""",
    ),
    "interval_overlap_genes": (
        lambda s, d: TR.annotate(tracts(s, d), genes(s, d).select("chrom", "r_start", "r_end", "gene"), ["chrom"], ["sample", "chrom", "target", "type", "start", "end", "id", "id_end"], "gene", 5 * GENE).select("sample", "chrom", "target", "type", "start", "end", "id", "id_end", "labels"),
        f"""WITH {_TR}, {_GENE} SELECT t.sample, t.chrom, target, type, s AS start, e AS "end", id, id_end, string_agg(t.chrom || '-' || mb, ':' ORDER BY t.chrom || '-' || mb) FILTER (mb IS NOT NULL) AS labels FROM t LEFT JOIN g ON g.chrom = t.chrom AND t.s <= g.re AND g.rs <= t.e GROUP BY ALL""",
    ),
    "overlap_weighted_mean": (
        lambda s, d: TR.overlap_weighted_mean(tracts(s, d), genes(s, d).drop("n", "gene"), ["chrom"], ["sample", "chrom", "target", "type", "start", "end"], "score", 5 * GENE).withColumn("mean", F.round("mean", 6)),
        f"""WITH {_TR}, {_GENE} SELECT t.sample, t.chrom, target, type, s AS start, e AS "end", round(sum((least(e, re) - greatest(s, rs)) * score) / nullif(sum(least(e, re) - greatest(s, rs)), 0), 6) AS mean FROM t JOIN g ON g.chrom = t.chrom AND t.s <= g.re AND g.rs <= t.e GROUP BY ALL""",
    ),
    "desert_overlap": (
        lambda s, d: TR.overlaps_any(tracts(s, d), genes(s, d).where("n < 4").select("chrom", "r_start", "r_end"), ["chrom"], ["sample", "chrom", "target", "type", "start", "end", "id", "id_end"], 5 * GENE).groupBy("chrom", "overlaps").agg(F.count(F.lit(1)).alias("n")),
        f"""WITH {_TR}, {_GENE}, o AS (SELECT t.chrom, EXISTS (SELECT 1 FROM g WHERE g.n < 4 AND g.chrom = t.chrom AND t.s <= g.re AND g.rs <= t.e) AS "overlaps" FROM t) SELECT chrom, "overlaps", count(*) AS n FROM o GROUP BY 1, 2""",
    ),
    "tract_summary": (
        lambda s, d: TR.tract_summary(with_len(s, d), ["target", "type"], "sample", "len").select("target", "type", "n_samples", "n_tracts", r("mean_len"), r("total", 4), r("longest"), r("per_sample")),
        f"WITH {_TR} SELECT target, type, count(DISTINCT sample) AS n_samples, count(*) AS n_tracts, round(avg(len), 6) AS mean_len, round(sum(len), 4) AS total, round(max(len), 6) AS longest, round(count(*) * 1.0 / count(DISTINCT sample), 6) AS per_sample FROM t GROUP BY 1, 2",
    ),
    "tract_ecdf": (
        lambda s, d: with_len(s, d).groupBy("target", F.round("len", 1).alias("len")).agg(F.count(F.lit(1)).alias("n")).withColumn("cum", F.expr("sum(n) over (partition by target order by len) / sum(n) over (partition by target)")).select("target", "len", "n", r("cum")),
        f"WITH {_TR}, h AS (SELECT target, round(len, 1) AS len, count(*) AS n FROM t GROUP BY 1, 2) SELECT target, len, n, round(CAST(sum(n) OVER (PARTITION BY target ORDER BY len) AS DOUBLE) / sum(n) OVER (PARTITION BY target), 6) AS cum FROM h",
    ),
    "exp_length_mle": (
        lambda s, d: with_len(s, d).groupBy("target").agg(F.round(TR.exponential_rate(F.col("len"), TRUNC), 6).alias("rate")),
        f"WITH {_TR} SELECT target, round(1 / nullif(avg(len) FILTER (len >= {TRUNC}) - {TRUNC}, 0), 6) AS rate FROM t GROUP BY 1",
    ),
    "length_fits": (lambda s, d: TR.fit_lengths(with_len(s, d), ["target"], "len", TRUNC), None),
    "admixture_time": (
        lambda s, d: with_len(s, d).groupBy("sample").agg(F.round(admixture_generations(F.avg("len"), 0.025), 4).alias("generations")),
        f"WITH {_TR} SELECT sample, round(100 / nullif(avg(len), 0) / (1 - 0.025), 4) AS generations FROM t GROUP BY 1",
    ),
    "mean_of_means": (
        lambda s, d: with_len(s, d).groupBy("target", "sample").agg(F.avg("len").alias("m")).groupBy("target").agg(F.round(F.avg("m"), 6).alias("mean")),
        f"WITH {_TR}, m AS (SELECT target, sample, avg(len) AS m FROM t GROUP BY 1, 2) SELECT target, round(avg(m), 6) AS mean FROM m GROUP BY 1",
    ),
    "longest_tract": (
        lambda s, d: with_len(s, d).groupBy("sample").agg(F.max(F.struct("len", F.col("chrom").alias("c"), F.col("start").alias("s"))).alias("m")).select("sample", F.round("m.len", 6).alias("len")),
        f"WITH {_TR} SELECT sample, round(max(len), 6) AS len FROM t GROUP BY 1",
    ),
    "panel_marginals": (
        lambda s, d: P.marginals(bins(s, d), ["sample"], SPACE.names, "state").select("sample", "state", r("mean"), r("share")),
        f"""WITH {_BIN}, m AS (SELECT sample, state, mean FROM (SELECT sample, {', '.join(f'avg({s}) AS {s}' for s in SPACE.names)} FROM b GROUP BY 1) UNPIVOT INCLUDE NULLS (mean FOR state IN ({', '.join(SPACE.names)}))),
v AS (SELECT sample, state, count(*) AS n FROM b WHERE state IS NOT NULL GROUP BY 1, 2), w AS (SELECT sample, state, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY sample) AS share FROM v) SELECT coalesce(m.sample, w.sample) AS sample, coalesce(m.state, w.state) AS state, round(mean, 6) AS mean, round(share, 6) AS share FROM m FULL JOIN w ON m.sample = w.sample AND m.state = w.state""",
    ),
    "pairwise_sharing": (cov_types, f"WITH {_BIN}, c AS (SELECT DISTINCT sample, chrom, pos FROM b WHERE state LIKE '%NEA%') SELECT x.sample AS a, y.sample AS b, count(*) AS n FROM c x JOIN c y ON x.chrom = y.chrom AND x.pos = y.pos AND x.sample < y.sample GROUP BY 1, 2"),
    "concordance_2x2": (concordance, f"WITH {_BIN}, u AS (SELECT chrom, pos, bool_or(state LIKE '%NEA%') AS a, bool_or(state LIKE '%DEN%') AS b FROM b WHERE state IS NOT NULL GROUP BY 1, 2) SELECT a, b, count(*) AS n FROM u GROUP BY 1, 2"),
    "age_carriers": (
        age_carriers,
        f"""WITH {_BIN}, {_SMP}, e AS (SELECT sample, CASE WHEN age IS NULL THEN 'unknown' WHEN age < 10000 THEN 'recent' WHEN age < 30000 THEN 'middle' ELSE 'old' END AS era FROM sm), z AS (SELECT era, count(*) AS k FROM e GROUP BY 1),
c AS (SELECT era, chrom, pos, count(DISTINCT b.sample) AS n FROM b JOIN e ON e.sample = lower(b.sample) WHERE state LIKE '%NEA%' GROUP BY 1, 2, 3) SELECT era, chrom, pos, n, round(n * 1.0 / k, 6) AS share FROM c JOIN z USING (era)""",
    ),
    "bin_widths": (
        lambda s, d: P.bin_widths(bins(s, d), ["sample", "chrom"], "pos").select("sample", "chrom", "pos", "width"),
        f"WITH {_BIN} SELECT sample, chrom, pos, coalesce(lead(pos) OVER (PARTITION BY sample, chrom ORDER BY pos) - pos, 0) AS width FROM b",
    ),
    "stacked_posteriors": (
        lambda s, d: P.stacked(bins(s, d).unpivot(["sample", "chrom", "id"], list(SPACE.names), "state", "p").groupBy("chrom", "state").agg(F.avg("p").alias("p")), ["chrom"], "state", "p").select("chrom", "state", r("base", 5), r("top", 5)),
        f"WITH {_BIN}, m AS (SELECT chrom, state, avg(p) AS p FROM (SELECT chrom, {', '.join(SPACE.names)} FROM b) UNPIVOT (p FOR state IN ({', '.join(SPACE.names)})) GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER (PARTITION BY chrom ORDER BY state ROWS UNBOUNDED PRECEDING) AS t FROM m) SELECT chrom, state, round(t - p, 5) AS base, round(t, 5) AS top FROM c",
    ),
    "cont_weighted": (
        lambda s, d: table(s, d, "cont").groupBy("deam", "len_bin").agg(F.round(P.weighted_mean("cont", "n_snps"), 6).alias("cont"), F.round(P.weighted_mean("error", "n_snps"), 6).alias("error"), F.sum("n_snps").alias("n_snps")),
        "SELECT deam, len_bin, round(sum(cont * n_snps) / nullif(sum(CASE WHEN cont IS NOT NULL THEN n_snps END), 0), 6) AS cont, round(sum(error * n_snps) / nullif(sum(CASE WHEN error IS NOT NULL THEN n_snps END), 0), 6) AS error, CAST(sum(n_snps) AS BIGINT) AS n_snps FROM cont GROUP BY 1, 2",
    ),
    "cont_table": (
        lambda s, d: table(s, d, "cont").withColumn("parts", F.split("lib", "_")).select("lib", F.element_at("parts", 1).alias("rg_name"), F.element_at("parts", 2).alias("len_name"), F.element_at("parts", 3).alias("deam_name"), r("cont"), r("error")).join(table(s, d, "target_file").groupBy("lib").agg(F.sum(F.col("tref") + F.col("talt")).alias("n_reads")), "lib"),
        "SELECT lib, split_part(lib, '_', 1) AS rg_name, split_part(lib, '_', 2) AS len_name, split_part(lib, '_', 3) AS deam_name, round(cont, 6) AS cont, round(error, 6) AS error, n_reads FROM cont JOIN (SELECT lib, CAST(sum(tref + talt) AS BIGINT) AS n_reads FROM target_file GROUP BY 1) USING (lib)",
    ),
    "allele_freq_maf": (
        lambda s, d: P.allele_frequencies(X.sites(s, d), POPS, ["site_id"]).select("site_id", "n_called", "n_missing", r("freq"), r("maf"), "minor_allele"),
        FX + ", n AS (SELECT *, AFR_alt + NEA_alt + DEN_alt + PAN_alt AS a, AFR_ref + NEA_ref + DEN_ref + PAN_ref AS b FROM sites), f AS (SELECT *, CAST(a AS DOUBLE) / nullif(a + b, 0) AS f FROM n) SELECT site_id, a + b AS n_called, CASE WHEN PAN_alt + PAN_ref = 0 THEN 1 ELSE 0 END AS n_missing, round(f, 6) AS freq, round(least(f, 1 - f), 6) AS maf, CASE WHEN f > 0.5 THEN ref ELSE alt END AS minor_allele FROM f",
    ),
    "panel_pivot": (
        lambda s, d: P.pivot_panel(X.obs(s, d).select("chrom", "pos", "lib", "tref", "talt"), ["chrom", "pos"], "lib", ["lib0", "lib1", "lib2"], ["tref", "talt"]),
        FX + " SELECT chrom, pos, " + ", ".join(f"CAST(sum({v}) FILTER (lib = '{p}') AS BIGINT) AS {p}_{v}" for p in ("lib0", "lib1", "lib2") for v in ("tref", "talt")) + " FROM obs GROUP BY 1, 2",
    ),
    "map_limits": (chrom_limits, f"WITH m AS (SELECT {chrom_sql()} AS chrom, pos, CASE WHEN map IS NULL OR isnan(map) OR map < 0 OR map >= 400 THEN NULL ELSE map END AS m FROM reference_file) SELECT chrom, min(pos) AS pos_min, max(pos) AS pos_max, min(m) AS map_min, max(m) AS map_max, min(CASE WHEN m IS NOT NULL THEN pos * CAST(1e-6 AS DOUBLE) END) AS even_min, max(CASE WHEN m IS NOT NULL THEN pos * CAST(1e-6 AS DOUBLE) END) AS even_max FROM m GROUP BY 1"),
    "quantile_bins": (
        quantile_bins,
        f"WITH {_GENE}, c AS (SELECT quantile_cont(n, 0.2) AS q1, quantile_cont(n, 0.4) AS q2, quantile_cont(n, 0.6) AS q3, quantile_cont(n, 0.8) AS q4 FROM g), k AS (SELECT n, 1 + CASE WHEN n > q1 THEN 1 ELSE 0 END + CASE WHEN n > q2 THEN 1 ELSE 0 END + CASE WHEN n > q3 THEN 1 ELSE 0 END + CASE WHEN n > q4 THEN 1 ELSE 0 END AS bin FROM g, c) SELECT bin, count(*) AS genes, min(n) AS lo, max(n) AS hi FROM k GROUP BY 1",
    ),
    "sample_sex": (
        lambda s, d: _samples(s, d).groupBy("sex").agg(F.count(F.lit(1)).alias("n")),
        "WITH x AS (SELECT lower(trim(sample)) AS sample, max(CASE WHEN lower(substr(trim(sex), 1, 1)) IN ('m', 'f') THEN lower(substr(trim(sex), 1, 1)) END) AS sex FROM samples WHERE sample IS NOT NULL GROUP BY 1) SELECT sex, count(*) AS n FROM x GROUP BY 1",
    ),
    "allele_flip_join": (
        allele_join,
        FX + ", o AS (SELECT chrom, pos, sum(talt) > 10 AS swap FROM obs GROUP BY 1, 2) SELECT s.chrom, s.pos, CASE WHEN swap IS NULL THEN 'mismatch' WHEN swap THEN 'flipped' ELSE 'same' END AS kind, CASE WHEN swap THEN 4 - NEA_alt ELSE NEA_alt END AS nea FROM sites s LEFT JOIN o ON s.chrom = o.chrom AND s.pos = o.pos",
    ),
    "deam_bins_binary": (
        lambda s, d: X.reads(s, d).withColumn("rg", P.read_groups(None, 2, 25)).groupBy("rg").agg(F.count(F.lit(1)).alias("n"), F.sum("is_alt").alias("alt")),
        FX + " SELECT lib || '_' || CAST(floor(len / 25.0) AS BIGINT) || '_' || CASE WHEN deam >= 0 AND deam < 2 THEN 'deam' ELSE 'nodeam' END AS rg, count(*) AS n, CAST(sum(is_alt) AS BIGINT) AS alt FROM reads GROUP BY 1",
    ),
    "read_group_exact_counts": (
        lambda s, d: X.reads(s, d).groupBy("lib", "deam", "len").agg(F.count(F.lit(1)).alias("n_exact")),
        FX + " SELECT lib, deam, len, count(*) AS n_exact FROM reads GROUP BY 1, 2, 3",
    ),
    "damage_classes": (
        lambda s, d: P.count_reads(X.reads(s, d).withColumn("damage", P.damage_class(F.col("deam"), 3)), ["chrom", "pos", "lib", "damage"]),
        FX + " SELECT chrom, pos, lib, CASE WHEN deam >= 0 AND deam < 3 THEN 'deam' ELSE 'nodeam' END AS damage, CAST(sum(1 - is_alt) AS BIGINT) AS tref, CAST(sum(is_alt) AS BIGINT) AS talt FROM reads GROUP BY 1, 2, 3, 4",
    ),
    "read_qc": (
        lambda s, d: P.count_reads(X.reads(s, d).where(P.read_passes(40, 75, deam_only=True)), ["chrom", "lib"]),
        FX + " SELECT chrom, lib, CAST(sum(1 - is_alt) AS BIGINT) AS tref, CAST(sum(is_alt) AS BIGINT) AS talt FROM reads WHERE len >= 40 AND len <= 75 AND deam >= 0 GROUP BY 1, 2",
    ),
    "read_cap": (
        lambda s, d: P.count_reads(P.cap_reads(X.reads(s, d), ["site_id"], ["lib", "len", "deam", "is_alt"], 12), ["site_id"]),
        FX + ", k AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY lib, len, deam, is_alt) AS rn FROM reads) SELECT site_id, CAST(sum(1 - is_alt) AS BIGINT) AS tref, CAST(sum(is_alt) AS BIGINT) AS talt FROM k WHERE rn <= 12 GROUP BY 1",
    ),
    "md5_downsample": (
        lambda s, d: P.downsample_counts(X.obs(s, d).select("site_id", "lib", "tref", "talt"), ["site_id", "lib"], 0.3),
        FX + """, e AS (SELECT site_id, lib, 'r' AS a, unnest(range(1, tref + 1)) AS i FROM obs UNION ALL SELECT site_id, lib, 'a', unnest(range(1, talt + 1)) FROM obs),
k AS (SELECT *, CAST('0x' || substr(md5('0|' || site_id || '|' || lib || '|' || a || '|' || i), 1, 8) AS BIGINT) / 4294967296.0 < 0.3 AS keep FROM e) SELECT site_id, lib, CAST(count(*) FILTER (a = 'r') AS INTEGER) AS tref, CAST(count(*) FILTER (a = 'a') AS INTEGER) AS talt FROM k WHERE keep GROUP BY 1, 2""",
    ),
    "fake_contamination": (
        lambda s, d: P.fake_contamination(X.obs(s, d).join(X.sites(s, d).select("site_id", S.cont_freq("AFR", 0.5, 0.5).alias("p")), "site_id"), ["site_id", "lib"], "p", 0.1).select("site_id", "lib", "tref", "talt"),
        FX + f""", lm AS (SELECT 0.1 * avg(tref + talt) / 0.9 AS lam FROM obs), o AS (SELECT site_id, lib, tref, talt, lam, (AFR_alt + 0.5) / 21.0 AS p FROM obs JOIN sites USING (site_id), lm),
u AS (SELECT o.*, a, CASE a WHEN 'a' THEN p ELSE 1 - p END * lam AS rate, CAST('0x' || substr(md5('0|' || site_id || '|' || lib || '|' || a), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM o, (SELECT unnest(['a', 'r']) AS a)),
k AS (SELECT site_id, lib, a, u, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY site_id, lib, a ORDER BY k ROWS UNBOUNDED PRECEDING) AS cdf FROM u, (SELECT unnest(range(0, 40)) AS k)),
n AS (SELECT site_id, lib, count(*) FILTER (a = 'a' AND cdf < u) AS na, count(*) FILTER (a = 'r' AND cdf < u) AS nr FROM k GROUP BY 1, 2) SELECT site_id, lib, CAST(tref + nr AS BIGINT) AS tref, CAST(talt + na AS BIGINT) AS talt FROM obs JOIN n USING (site_id, lib)""",
    ),
    "random_read": (lambda s, d: P.random_read(X.obs(s, d), ["site_id", "lib"]).select("site_id", "lib", "allele"), FX + " SELECT site_id, lib, CASE WHEN CAST('0x' || substr(md5('0|' || site_id || '|' || lib), 1, 8) AS BIGINT) / 4294967296.0 * (tref + talt) < talt THEN 1 ELSE 0 END AS allele FROM obs"),
}
