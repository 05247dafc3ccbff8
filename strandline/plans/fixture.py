"""Portable fixture: sites, reads and read counts derived from the driver's part and lineitem tables.

The statements are in the SQL subset that Spark and DuckDB share; ``FIXTURE_SQL`` prefixes oracle statements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.plans.tables import table

SITES = """
SELECT p_partkey AS site_id,
 CASE WHEN p_partkey % 10 = 9 THEN 'X' ELSE CAST(p_partkey % 10 + 1 AS VARCHAR(2)) END AS chrom,
 CAST(floor(p_partkey / 10.0) AS BIGINT) * 5000 + p_size * 10 + 1 AS pos,
 substr('ACGT', CAST(p_partkey % 4 AS INT) + 1, 1) AS ref,
 substr('CGTA', CAST(p_partkey % 4 AS INT) + 1, 1) AS alt,
 (p_partkey * 7) % 21 AS AFR_alt, 20 - (p_partkey * 7) % 21 AS AFR_ref,
 (p_partkey * 3 + p_size) % 5 AS NEA_alt, 4 - (p_partkey * 3 + p_size) % 5 AS NEA_ref,
 p_size % 3 AS DEN_alt, 2 - p_size % 3 AS DEN_ref,
 CASE WHEN p_size % 17 = 0 THEN 0 ELSE (p_partkey + p_size) % 2 END AS PAN_alt,
 CASE WHEN p_size % 17 = 0 THEN 0 ELSE 1 - (p_partkey + p_size) % 2 END AS PAN_ref
FROM {part}
"""
READS = """
SELECT s.site_id, s.chrom, s.pos, concat('lib', CAST(l.l_suppkey % 3 AS VARCHAR(2))) AS lib, l.l_suppkey % 2 AS half,
 CASE WHEN l.l_linenumber <= 3 THEN l.l_linenumber - 1 ELSE -1 END AS deam,
 35 + CAST(l.l_quantity AS INT) AS len,
 CASE WHEN CAST(round(l.l_discount * 100) AS INT) * s.n_src < 11 * s.k_src THEN 1 ELSE 0 END AS is_alt
FROM {lineitem} l JOIN (
 SELECT site_id, chrom, pos,
  CASE WHEN CAST(floor(pos / 100000.0) AS INT) % 3 = 0 THEN NEA_alt ELSE AFR_alt END AS k_src,
  CASE WHEN CAST(floor(pos / 100000.0) AS INT) % 3 = 0 THEN 4 ELSE 20 END AS n_src
 FROM {sites}) s ON l.l_partkey = s.site_id
"""
OBS = """
SELECT site_id, chrom, pos, lib, CAST(sum(1 - is_alt) AS BIGINT) AS tref, CAST(sum(is_alt) AS BIGINT) AS talt
FROM {reads} GROUP BY site_id, chrom, pos, lib
"""

FIXTURE_SQL = (
    "WITH RECURSIVE sites AS ("
    + SITES.format(part="part")
    + "), reads AS ("
    + READS.format(lineitem="lineitem", sites="sites")
    + "), obs AS ("
    + OBS.format(reads="reads")
    + ")"
)


def sites(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(SITES, part=table(spark, d, "part"))


def reads(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(READS, lineitem=table(spark, d, "lineitem"), sites=sites(spark, d))


def obs(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(OBS, reads=reads(spark, d))
