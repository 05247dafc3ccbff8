"""Queries over text and genotype formats, with lines made from the fixture's sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.plans import fixture as X
from strandline.queries.sites import FX
from strandline.sources import binary as B
from strandline.sources import text as T
from strandline.sources.sinks import interval


def _gt(col: str):
    c = F.col(col) % 4
    return F.when(c == 0, "0/0").when(c == 1, "0/1").when(c == 2, "1/1").otherwise("./.")


def vcf_counts(spark, d):
    s = X.sites(spark, d)
    alts = F.when(F.col("site_id") % 13 == 0, F.concat_ws(",", "alt", "ref")).otherwise(F.col("alt"))
    lines = s.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", alts, F.lit("."), F.lit("."), F.lit("."), F.lit("GT:DP"), F.concat(_gt("AFR_alt"), F.lit(":3")), _gt("NEA_alt"), _gt("DEN_alt")).alias("value"))
    return T.genotype_counts(T.parse_vcf(lines, ["a", "b", "c"]), pseudo_haploid=["c"])


def vcf_panel(spark, d):
    return T.vcf_panel(vcf_counts(spark, d), {"P": ["a", "b"], "Q": ["c"]})


def vcf_target(spark, d):
    return T.vcf_target(vcf_counts(spark, d), X.sites(spark, d).where("PAN_ref + PAN_alt > 0"), "a")


def geno_counts(spark, d):
    s = X.sites(spark, d)
    who = F.array(*[F.struct(F.lit(n).alias("sample"), F.lit(x).alias("sex"), F.lit(p).alias("pop"), F.col(c).cast("int").alias("g")) for n, x, p, c in (("s1", "M", "P", "AFR_alt"), ("s2", "F", "P", "NEA_alt"), ("s3", "F", "Q", "DEN_alt"))])
    g = s.select("chrom", "pos", "ref", "alt", (F.col("pos") * 1e-6).alias("map"), F.explode(who).alias("w")).select("chrom", "pos", "ref", "alt", "map", "w.sample", "w.sex", "w.pop", (F.col("w.g") % 4).alias("g"))
    g = g.withColumn("n_ref", F.when(F.col("g") < 3, F.col("g"))).drop("g")
    return B.population_counts(g).select("chrom", "pos", "pop", "n_ref", "n_alt")


def bed_positions(spark, d):
    s = X.sites(spark, d).groupBy("chrom", F.floor(F.col("pos") / 100000).alias("k")).agg(F.min("pos").alias("start"), (F.min("pos") + 40).alias("end"))
    return T.bed_positions(s.select("chrom", "start", "end"))


def cont_interval(spark, d):
    o = X.obs(spark, d).groupBy("lib").agg((F.sum("talt") / F.sum(F.col("tref") + F.col("talt"))).alias("c"), F.sum(F.col("tref") + F.col("talt")).alias("n_reads"))
    o = o.withColumn("se", F.sqrt(F.col("c") * (1 - F.col("c")) / F.col("n_reads")))
    lo, hi = interval(F.col("c"), F.col("se"))
    return o.select("lib", "n_reads", F.round("c", 6).alias("c"), F.round(lo, 6).alias("l_c"), F.round(hi, 6).alias("h_c"))


_GT = "CASE {c} % 4 WHEN 0 THEN {z} WHEN 1 THEN {o} WHEN 2 THEN {t} ELSE {m} END"
_R = lambda c: _GT.format(c=c, z=2, o=1, t=0, m=0)
_A = lambda c: _GT.format(c=c, z=0, o=1, t=2, m=0)
_ANY = "(AFR_alt % 4 IN (1, 2) OR NEA_alt % 4 IN (1, 2) OR DEN_alt % 4 IN (1, 2))"
_CR = _GT.format(c="DEN_alt", z=1, o=1, t=0, m=0)
_CA = _GT.format(c="DEN_alt", z=0, o=0, t=1, m=0)
# allele counts of sample g: n copies by sex and chromosome; a genotype is the number of reference alleles
_CP = "gg AS (SELECT chrom, pos, 's1' AS s, 'M' AS sex, 'P' AS pop, AFR_alt % 4 AS g FROM sites UNION ALL SELECT chrom, pos, 's2', 'F', 'P', NEA_alt % 4 FROM sites UNION ALL SELECT chrom, pos, 's3', 'F', 'Q', DEN_alt % 4 FROM sites), pl AS (SELECT s, CASE WHEN max(CASE WHEN g < 3 THEN g END) > 1 THEN 2 ELSE 1 END AS ploidy FROM gg GROUP BY 1), cp AS (SELECT chrom, pos, pop, g, CASE WHEN g = 3 THEN 0 WHEN chrom = 'X' AND sex = 'M' THEN 1 ELSE ploidy END AS n FROM gg JOIN pl USING (s)), rr AS (SELECT *, least(CASE WHEN n = 1 AND g = 2 THEN 1 WHEN g = 3 THEN 0 ELSE g END, n) AS r FROM cp)"

QUERIES = {
    "vcf_panel": (vcf_panel, FX + f" SELECT chrom, pos, ref, alt, CAST({_R('AFR_alt')} + {_R('NEA_alt')} AS BIGINT) AS P_ref, CAST({_A('AFR_alt')} + {_A('NEA_alt')} AS BIGINT) AS P_alt, CAST({_CR} AS BIGINT) AS Q_ref, CAST({_CA} AS BIGINT) AS Q_alt FROM sites WHERE {_ANY}"),
    "vcf_target": (vcf_target, FX + f" SELECT chrom, pos, {_R('AFR_alt')} AS tref, {_A('AFR_alt')} AS talt FROM sites WHERE {_ANY} AND PAN_ref + PAN_alt > 0"),
    "geno_population_counts": (geno_counts, FX + f", {_CP} SELECT chrom, pos, pop, CAST(sum(r) AS BIGINT) AS n_ref, CAST(sum(n - r) AS BIGINT) AS n_alt FROM rr GROUP BY 1, 2, 3"),
    "bed_positions": (bed_positions, FX + ", b AS (SELECT chrom, CAST(floor(pos / 100000.0) AS BIGINT) AS k, min(pos) AS p FROM sites GROUP BY 1, 2) SELECT DISTINCT chrom, unnest(range(p + 1, p + 41)) AS pos FROM b"),
    "cont_interval": (
        cont_interval,
        FX + ", x AS (SELECT lib, CAST(sum(tref + talt) AS BIGINT) AS n, CAST(sum(talt) AS DOUBLE) / sum(tref + talt) AS c FROM obs GROUP BY 1), y AS (SELECT *, sqrt(c * (1 - c) / n) AS se FROM x) SELECT lib, n AS n_reads, round(c, 6) AS c, round(greatest(c - 1.96 * se, 0), 6) AS l_c, round(least(c + 1.96 * se, 1), 6) AS h_c FROM y",
    ),
}
