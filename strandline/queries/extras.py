"""Queries over site classes, per-site tables and read classes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandline.operators import extras as E
from strandline.operators import fstats as FS
from strandline.operators import sites as S
from strandline.plans import fixture as X
from strandline.queries import hmm as HQ
from strandline.queries import panel as PQ
from strandline.queries import sfs as SQ
from strandline.queries.sites import FX


def fixed_sites(spark, d):
    return X.sites(spark, d).select("site_id", E.fixed_differences(None, ["NEA", "DEN"], "PAN").alias("kind"))


_FX = {p: f"((PAN_alt = 0 AND PAN_ref > 0 AND {p}_ref = 0 AND {p}_alt > 0) OR (PAN_ref = 0 AND PAN_alt > 0 AND {p}_alt = 0 AND {p}_ref > 0))" for p in ("NEA", "DEN")}


def snp_table(spark, d):
    reads = X.obs(spark, d).groupBy("chrom", "pos").agg(F.sum("tref").alias("tref"), F.sum("talt").alias("talt"))
    g = HQ.posterior_genotype(spark, d)
    lg = E.log10_table([F.col(f"g{k}") for k in range(3)])
    return g.join(reads, ["chrom", "pos"]).select("chrom", "pos", "tref", "talt", *[F.round(c, 3).alias(f"log_g{k}") for k, c in enumerate(lg)], F.round(F.col("g1") + 2 * F.col("g2"), 6).alias("n_alt"))


def length_classes(spark, d):
    x = E.length_classes(X.reads(spark, d), ["lib"], "len", 2000)
    return x.groupBy("lib", "cls").agg(F.count(F.lit(1)).alias("n"), F.min("len").alias("lo"), F.max("len").alias("hi"))


def dstat_reads(spark, d):
    f = SQ.freqs(spark, d).select("site_id", "NEA", "AFR", "PAN")
    r = X.reads(spark, d).select("site_id", "is_alt", F.floor(F.col("len") / 10).alias("len_bin"), (F.col("deam") >= 0).alias("damaged"))
    return E.read_level_d(r, f, ["site_id"], ["len_bin", "damaged"], "NEA", "AFR", "PAN").select("len_bin", "damaged", *[F.round(c, 4).alias(c) for c in ("abba", "baba", "d")])


def pairwise_moments(spark, d):
    b = PQ.bins(spark, d).select("sample", "chrom", "pos", "state")
    n = b.select("chrom", "pos").distinct().count()
    m = E.sharing_moments(b.where(F.col("state").contains("NEA")), ["chrom", "pos"], "sample", n)
    return m.select("a", "b", *[F.round(c, 6).alias(c) for c in ("cov", "cor", "jaccard")])


def derived_het(spark, d):
    r = SQ.replicates(spark, d)
    return FS.derived_given_het(r, "DEN").select("sex_chrom", F.round("f", 6).alias("f"), "n_snps")


def f4_ratios(spark, d):
    q = FS.f4(SQ.pi(spark, d), [*SQ.POPS, "target"])
    return FS.f4_ratio(q, ("AFR", "NEA", "DEN", "target"), ("AFR", "DEN", "NEA", "target")).select("rep", "sex_chrom", F.round("ratio", 5).alias("ratio"))


def expanded(spark, d):
    return E.expand_reads(X.obs(spark, d)).groupBy("chrom", "allele").agg(F.count(F.lit(1)).alias("n"))


def in_intervals(spark, d):
    s = X.sites(spark, d)
    bed = s.groupBy("chrom", F.floor(F.col("pos") / 100000).alias("k")).agg(F.min("pos").alias("start"), (F.min("pos") + 30000).alias("end"))
    return E.within(s.select("chrom", "pos"), bed).select("chrom", "pos")


def block_callback(spark, d):
    s = S.block_ids(X.sites(spark, d), "snp", 30).select("chrom", "block", "pos", "AFR_alt")
    import pandas as pd

    return E.run_callback(s, ["chrom", "block"], lambda k, p: pd.DataFrame([(k[0], int(k[1]), len(p), float(np.median(p["AFR_alt"])))], columns=["chrom", "block", "n", "median"]), "chrom string, block long, n long, median double")


def age_mixture(spark, d):
    return E.fit_ages(PQ.with_len(spark, d), ["target"], "len", 1.0, [5, 20, 50, 100, 200, 500]).withColumn("weight", F.round("weight", 6))


def geneflow_null(spark, d):
    n = PQ.with_len(spark, d).groupBy("target").agg(F.count(F.lit(1)).alias("n")).select("n").distinct()
    return E.longest_tract_null(n, 30, 100).withColumn("longest", F.round("longest", 6))


_L = "CAST(floor(len / 10.0) AS BIGINT)"

QUERIES = {
    "fixed_sites": (fixed_sites, FX + f" SELECT site_id, CASE WHEN {_FX['NEA']} AND {_FX['DEN']} THEN 'multiple' WHEN {_FX['NEA']} THEN 'fixed NEA' WHEN {_FX['DEN']} THEN 'fixed DEN' ELSE 'none' END AS kind FROM sites"),
    "snp_table": (
        snp_table,
        HQ._PGSQL + ", g AS (SELECT chrom, pos, " + ", ".join(f"round(w0{k} + w1{k} + w2{k}, 6) AS g{k}" for k in range(3)) + " FROM pg), o AS (SELECT chrom, pos, CAST(sum(tref) AS BIGINT) AS tref, CAST(sum(talt) AS BIGINT) AS talt FROM obs GROUP BY 1, 2) SELECT g.chrom, g.pos, tref, talt, "
        + ", ".join(f"round(least(log10(g{k} + 1e-40), 0), 3) AS log_g{k}" for k in range(3)) + ", round(g1 + 2 * g2, 6) AS n_alt FROM g JOIN o ON o.chrom = g.chrom AND o.pos = g.pos",
    ),
    "length_classes": (
        length_classes,
        FX + """, h AS (SELECT lib, len, count(*) AS n FROM reads GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY lib) AS t, sum(n) OVER (PARTITION BY lib ORDER BY len ROWS UNBOUNDED PRECEDING) - n AS b FROM h),
k AS (SELECT *, CAST(floor(b * least(greatest(floor(t / 2000.0), 1), 254) / t) AS INTEGER) AS cls FROM c) SELECT lib, cls, CAST(sum(n) AS BIGINT) AS n, min(len) AS lo, max(len) AS hi FROM k GROUP BY 1, 2""",
    ),
    "dstat_reads": (
        dstat_reads,
        FX + f""", q AS (SELECT site_id, NEA_alt / 4.0 AS a, AFR_alt / 20.0 AS c, CAST(PAN_alt AS DOUBLE) / nullif(PAN_alt + PAN_ref, 0) AS o FROM sites), p AS (SELECT {_L} AS len_bin, deam >= 0 AS damaged, is_alt AS x, a, c, o FROM reads JOIN q USING (site_id) WHERE o IS NOT NULL),
s AS (SELECT len_bin, damaged, sum(a * c * (1 - x) * (1 - o) + (1 - a) * (1 - c) * x * o) AS abba, sum(x * c * (1 - a) * (1 - o) + (1 - x) * (1 - c) * a * o) AS baba FROM p GROUP BY 1, 2) SELECT len_bin, damaged, round(abba, 4) AS abba, round(baba, 4) AS baba, round((abba - baba) / nullif(abba + baba, 0), 4) AS d FROM s""",
    ),
    "pairwise_moments": (
        pairwise_moments,
        f"""WITH {PQ._BIN}, u AS (SELECT count(*) AS n FROM (SELECT DISTINCT chrom, pos FROM b)), c AS (SELECT DISTINCT sample, chrom, pos FROM b WHERE state LIKE '%NEA%'), k AS (SELECT sample, count(*) AS k FROM c GROUP BY 1),
p AS (SELECT x.sample AS a, y.sample AS b, count(*) AS m FROM c x JOIN c y ON x.chrom = y.chrom AND x.pos = y.pos AND x.sample < y.sample GROUP BY 1, 2),
z AS (SELECT p.a, p.b, m, ka.k AS ka, kb.k AS kb, CAST(u.n AS DOUBLE) AS n FROM p JOIN k ka ON ka.sample = p.a JOIN k kb ON kb.sample = p.b, u), v AS (SELECT *, (m - ka * kb / n) / (n - 1) AS cov FROM z)
SELECT a, b, round(cov, 6) AS cov, round(cov / nullif(sqrt((ka - ka * ka / n) / (n - 1) * (kb - kb * kb / n) / (n - 1)), 0), 6) AS cor, round(CAST(m AS DOUBLE) / (ka + kb - m), 6) AS jaccard FROM v""",
    ),
    "derived_given_het": (derived_het, SQ._PI + " SELECT sex_chrom, round(sum(tau * n_snps) / nullif(sum(n_snps), 0), 6) AS f, CAST(sum(n_snps) AS BIGINT) AS n_snps FROM loo WHERE n_snps > 0 AND DEN_anc = 1 AND DEN_der = 1 GROUP BY 1"),
    "f4_ratio": (
        f4_ratios,
        SQ._PI + f" SELECT rep, sex_chrom, round(({SQ._F4[0][1]}) / nullif({SQ._F4[1][1]}, 0), 5) AS ratio FROM pw",
    ),
    "expanded_reads": (expanded, FX + " SELECT chrom, 0 AS allele, CAST(sum(tref) AS BIGINT) AS n FROM obs GROUP BY 1 HAVING sum(tref) > 0 UNION ALL SELECT chrom, 1, CAST(sum(talt) AS BIGINT) FROM obs GROUP BY 1 HAVING sum(talt) > 0"),
    "sites_in_intervals": (in_intervals, FX + ", b AS (SELECT chrom, CAST(floor(pos / 100000.0) AS BIGINT) AS k, min(pos) AS s FROM sites GROUP BY 1, 2) SELECT chrom, pos FROM sites t WHERE EXISTS (SELECT 1 FROM b WHERE b.chrom = t.chrom AND t.pos > b.s AND t.pos <= b.s + 30000)"),
    "block_callback": (block_callback, FX + ", " + SQ._BLK.split(",\nfq AS")[0] + " SELECT chrom, block, count(*) AS n, CAST(median(AFR_alt) AS DOUBLE) AS median FROM bs GROUP BY 1, 2"),
    "geneflow_null": (
        geneflow_null,
        f"WITH {PQ._TR}, n AS (SELECT DISTINCT CAST(n AS INTEGER) AS n FROM (SELECT count(*) AS n FROM t GROUP BY target)), r AS (SELECT n, CAST(unnest(range(1, 101)) AS INTEGER) AS rep FROM n) SELECT n, rep, round(-ln(1 - pow(greatest(CAST('0x' || substr(md5('0|' || n || '|' || rep), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE, 1e-12), 1.0 / n)) * (100.0 / 30), 6) AS longest FROM r",
    ),
}
