"""Queries of the training-data operators, with DuckDB SQL where SQL can say them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.canon import SOURCES, canon_chrom
from strandline.llm.logsketch import gamma, log_sketch, percentiles
from strandline.llm.mixing import document_sizes, mix, mix_shares
from strandline.llm.packing import pack
from strandline.llm.residue import host_validation, score_residue, train
from strandline.llm.runs import collapse_runs
from strandline.llm.sizes import byte_tokens
from strandline.plans.tables import table
from strandline.queries.general import WS, chrom_sql

BIN_WIDTH = 1_000_000
ALPHA = 0.01
QS = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run of bins: first and last id, number of bins, first and last position and length in base pairs."""
    up = F.upper("viterbi")
    bits = [F.when(up.contains(s), 1 << i).otherwise(0) for i, s in enumerate(SOURCES)]
    b = table(spark, d, "bins").select(F.trim("sample").alias("sample"), canon_chrom("chrom").alias("chrom"), "id", F.nullif(sum(bits[1:], bits[0]), F.lit(0)).alias("state"), F.col("pos").cast("long").alias("pos"))
    r = collapse_runs(b, ["sample", "chrom"], "id", "state", {"first": ("min", "pos"), "last": ("max", "pos")})
    names = F.concat_ws("", *[F.when(F.col("state").bitwiseAND(1 << i) > 0, s) for i, s in enumerate(SOURCES)])
    return r.select("sample", "chrom", names.alias("state"), F.col("start").alias("id"), F.col("end").alias("id_end"), F.col("n").alias("n_bins"), F.col("first").alias("pos"), (F.col("last") + BIN_WIDTH - F.col("first")).alias("length"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_runs(spark, d).where("n_bins >= 2").select("sample", "chrom", "id", "id_end")


def p4_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Mergeable bucket counts of tref and talt per lib (null is one) and run_date."""
    return log_sketch(table(spark, d, "target_file"), ["lib", "run_date"], ["tref", "talt"], ALPHA).withColumn("run_date", F.col("run_date").cast("string"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per lib, from the merged sketches of its run_dates."""
    return percentiles(p4_sketch(spark, d), ["lib"], QS, ALPHA).withColumn("value", F.round("value", 6))


def p4_daily_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(p4_sketch(spark, d), ["lib", "run_date"], QS, ALPHA).withColumn("value", F.round("value", 6))


def p4_bound(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per lib beside the exact ones (from counts per value), and whether they keep the stated bound."""
    t = table(spark, d, "target_file")
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in ("tref", "talt")]))
    h = t.select("lib", pairs.alias("p")).select("lib", "p.*").where("v is not null").groupBy("lib", "measure", "v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("lib", "measure")
    h = h.withColumn("cum", F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("c").over(w))
    rank = lambda q: F.floor(q * (F.col("total") - 1))
    hit = F.filter(F.array(*[F.lit(q) for q in QS]), lambda q: (rank(q) < F.col("cum")) & (rank(q) >= F.col("cum") - F.col("c")))
    exact = h.select("lib", "measure", F.explode(hit).alias("q"), F.col("v").alias("exact"))
    s = percentiles(p4_sketch(spark, d), ["lib"], QS, ALPHA)
    j = exact.join(s.select(F.col("lib").alias("l"), F.col("measure").alias("m"), F.col("q").alias("p"), "value"), F.col("lib").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m")) & (F.col("q") == F.col("p")), "left")
    return j.select("lib", "measure", "q", "exact", F.coalesce(F.abs(F.col("value") - F.col("exact")) <= F.abs("exact") * (ALPHA + 1e-9), F.lit(False)).alias("within"))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    """Container of every document, or part of one that exceeds the capacity, in every pack."""
    return pack(table(spark, d, "documents").select("doc_id", byte_tokens("text").alias("size")), table(spark, d, "pack_spec"), "doc_id", "size")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packing put into more than one container."""
    p = p6_pack(spark, d).where("n_parts > 1").groupBy("pack_name", "doc_id").agg(F.countDistinct("container").alias("n"))
    return p.where("n > 1").select("pack_name", "doc_id")


def p6_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts and tokens of every document in every pack, as packed."""
    return p6_pack(spark, d).groupBy("pack_name", "doc_id").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("tokens").alias("tokens"), F.max(F.col("first_token") + F.col("tokens")).alias("last"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and share of room used per pack."""
    return _fill(p6_pack(spark, d), table(spark, d, "pack_spec"))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """Per pack: tokens packed, containers over their capacity, and whether at most 1 % more containers are used than the tokens fill."""
    p, k = p6_pack(spark, d), F.col("capacity_tokens")
    each = p.groupBy("pack_name", "container").agg(F.sum("tokens").alias("used")).join(table(spark, d, "pack_spec"), "pack_name")
    g = each.groupBy("pack_name", k).agg(F.sum("used").alias("tokens"), F.count(F.when(F.col("used") > k, 1)).alias("over"), F.count(F.lit(1)).alias("n"), (F.max("container") + 1).alias("top"))
    return g.select("pack_name", "tokens", "over", (F.col("n") == F.col("top")).alias("dense"), (F.col("n") <= F.ceil(F.col("tokens") / k) * 1.01 + 1).alias("tight"))


def _fill(packed: DataFrame, spec: DataFrame) -> DataFrame:
    each = packed.groupBy("pack_name", "container").agg(F.sum("tokens").alias("used"))
    p = each.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return p.join(spec, "pack_name").select("pack_name", "capacity_tokens", "n_containers", "tokens", "fullest", (F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return document_sizes(table(spark, d, "documents"), "doc_id", byte_tokens("text"), "source")


def p7_mix(spark: SparkSession, d: str, calibrated: bool = False) -> DataFrame:
    return mix(_sizes(spark, d), table(spark, d, "mix_targets"), calibrated=calibrated)


def p7_shares(spark: SparkSession, d: str, calibrated: bool = False) -> DataFrame:
    s, t = _sizes(spark, d), table(spark, d, "mix_targets")
    r = mix_shares(mix(s, t, calibrated=calibrated), s, t)
    return r.select("mix_name", "source", "target_share", F.round("rate", 6).alias("rate"), "n_docs", "tokens", F.round("actual_share", 6).alias("actual_share"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return score_residue(docs, train(docs))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where("is_residue").select("doc_id")


_BITS = " + ".join(f"CASE WHEN upper(viterbi) LIKE '%{s}%' THEN {1 << i} ELSE 0 END" for i, s in enumerate(SOURCES))
_NAMES = " || ".join(f"CASE WHEN state & {1 << i} > 0 THEN '{s}' ELSE '' END" for i, s in enumerate(SOURCES))
_RUNS = f"""
WITH b AS (SELECT trim(sample) AS sample, {chrom_sql()} AS chrom, id, max(nullif({_BITS}, 0)) AS state, max(CAST(pos AS BIGINT)) AS pos FROM bins GROUP BY 1, 2, 3),
n AS (SELECT *, id - row_number() OVER (PARTITION BY sample, chrom, state ORDER BY id) AS island FROM b WHERE state IS NOT NULL),
runs AS (SELECT sample, chrom, {_NAMES} AS state, min(id) AS id, max(id) AS id_end, count(*) AS n_bins, min(pos) AS pos, max(pos) + {BIN_WIDTH} - min(pos) AS length FROM n GROUP BY sample, chrom, n.state, island)
"""
_SKETCH = f"""
WITH long AS (SELECT lib, CAST(run_date AS VARCHAR) AS run_date, 'tref' AS measure, CAST(tref AS DOUBLE) AS v FROM target_file WHERE tref IS NOT NULL
 UNION ALL SELECT lib, CAST(run_date AS VARCHAR), 'talt', CAST(talt AS DOUBLE) FROM target_file WHERE talt IS NOT NULL),
sketch AS (SELECT lib, run_date, measure, CAST(sign(v) AS INTEGER) AS sgn,
 CAST(CASE WHEN v = 0 THEN 0 ELSE ceil(ln(CASE WHEN v = 0 THEN 1 ELSE abs(v) END) / {math.log(gamma(ALPHA))!r}) END AS INTEGER) AS idx, count(*) AS n FROM long GROUP BY 1, 2, 3, 4, 5)
"""


def _quantiles(keys: str) -> str:
    return (
        _SKETCH
        + f""", m AS (SELECT {keys}, measure, sgn, idx, sum(n) AS n FROM sketch GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY {keys}, measure ORDER BY sgn * 1000000 + sgn * idx ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY {keys}, measure) AS total FROM m),
q AS (SELECT unnest([{', '.join(map(str, QS))}]) AS q)
SELECT {keys}, measure, CAST(q.q AS DOUBLE) AS q, round(sgn * pow(CAST({gamma(ALPHA)!r} AS DOUBLE), idx - 1) * {1 + ALPHA!r}, 6) AS value, CAST(total AS BIGINT) AS n
FROM c, q WHERE floor(CAST(q.q AS DOUBLE) * (total - 1)) < cum AND floor(CAST(q.q AS DOUBLE) * (total - 1)) >= cum - n"""
    )


_SOURCE = f"replace(lower(trim(source, {WS})), '-', '_')"
_MIX = f"""
WITH sizes AS (SELECT doc_id, {_SOURCE} AS source, CAST(strlen(text) + 1 AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND doc_id IS NOT NULL),
have AS (SELECT source, sum(tokens) AS have FROM sizes GROUP BY 1),
t AS (SELECT mix_name, {_SOURCE} AS source, target_share, max_repeats FROM mix_targets),
tot AS (SELECT mix_name, min(max_repeats * have / target_share) AS total FROM t JOIN have USING (source) GROUP BY 1),
plan AS (SELECT t.mix_name, t.source, t.target_share, coalesce(least(CAST(t.max_repeats AS DOUBLE), t.target_share * tot.total / h.have), 0) AS rate FROM t JOIN tot USING (mix_name) LEFT JOIN have h ON h.source = t.source),
each AS (SELECT p.mix_name, s.doc_id, s.source, s.tokens, CAST(floor(p.rate) AS INTEGER) AS whole, p.rate - floor(p.rate) AS fraction, (p.rate - floor(p.rate)) * h.have AS goal,
  CAST('0x' || substr(md5('0|' || p.mix_name || '|' || CAST(s.doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
 FROM sizes s JOIN plan p ON p.source = s.source JOIN have h ON h.source = s.source),
"""
_PLAIN = "drawn AS (SELECT *, whole + CASE WHEN u < fraction THEN 1 ELSE 0 END AS n FROM each),"
_CALIBRATED = """units AS (SELECT *, CAST(floor(u * 65536) AS INTEGER) AS unit FROM each), sums AS (SELECT mix_name, source, unit, sum(tokens) AS t, min(goal) AS goal FROM units GROUP BY 1, 2, 3),
offs AS (SELECT *, abs(sum(t) OVER (PARTITION BY mix_name, source ORDER BY unit ROWS UNBOUNDED PRECEDING) - goal) AS off FROM sums),
cuts AS (SELECT mix_name, source, CASE WHEN min(off) < min(goal) THEN arg_min(unit, off) ELSE -1 END AS cut FROM offs GROUP BY 1, 2),
drawn AS (SELECT e.mix_name, e.doc_id, e.source, e.tokens, whole + CASE WHEN unit <= cut THEN 1 ELSE 0 END AS n FROM units e JOIN cuts USING (mix_name, source)),"""
_MIXED = " mixed AS (SELECT mix_name, doc_id, source, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy, tokens FROM drawn WHERE n > 0) "
_SHARES = """, got AS (SELECT mix_name, source, count(*) AS n_docs, sum(tokens) AS tokens FROM mixed GROUP BY 1, 2), al AS (SELECT mix_name, sum(tokens) AS a FROM got GROUP BY 1)
SELECT p.mix_name, p.source, p.target_share, round(p.rate, 6) AS rate, coalesce(n_docs, 0) AS n_docs, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, round(coalesce(tokens / a, 0), 6) AS actual_share
FROM plan p LEFT JOIN got USING (mix_name, source) LEFT JOIN al USING (mix_name)"""
_BOUND = f"""
WITH long AS (SELECT lib, 'tref' AS measure, CAST(tref AS DOUBLE) AS v FROM target_file WHERE tref IS NOT NULL UNION ALL SELECT lib, 'talt', CAST(talt AS DOUBLE) FROM target_file WHERE talt IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY lib, measure ORDER BY v) - 1 AS rank, count(*) OVER (PARTITION BY lib, measure) AS n FROM long), q AS (SELECT CAST(unnest([{', '.join(map(str, QS))}]) AS DOUBLE) AS q)
SELECT lib, measure, q, v AS exact, true AS within FROM r, q WHERE rank = floor(q * (n - 1))"""
_PARTS = "SELECT pack_name, doc_id, CAST(ceil((strlen(text) + 1) / CAST(capacity_tokens AS DOUBLE)) AS BIGINT) AS n_parts, CAST(strlen(text) + 1 AS BIGINT) AS tokens, CAST(strlen(text) + 1 AS BIGINT) AS last FROM documents, pack_spec WHERE text IS NOT NULL"

QUERIES = {
    "p1_found": (p1_found, _RUNS + "SELECT sample, chrom, id, id_end FROM runs WHERE n_bins >= 2"),
    "p1_runs": (p1_runs, _RUNS + "SELECT * FROM runs"),
    "p4_sketch": (p4_sketch, _SKETCH + "SELECT * FROM sketch"),
    "p4_percentiles": (p4_percentiles, _quantiles("lib")),
    "p4_bound": (p4_bound, _BOUND),
    "p4_daily_percentiles": (p4_daily_percentiles, _quantiles("lib, run_date")),
    "p6_found": (p6_found, "SELECT pack_name, doc_id FROM documents, pack_spec WHERE text IS NOT NULL AND strlen(text) + 1 > capacity_tokens"),
    "p6_pack": (p6_pack, None),
    "p6_parts": (p6_parts, _PARTS),
    "p6_fill": (p6_fill, None),
    "p6_check": (p6_check, "SELECT pack_name, CAST(sum(strlen(text) + 1) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS over, true AS dense, true AS tight FROM documents, pack_spec WHERE text IS NOT NULL GROUP BY 1"),
    "p7_mix": (p7_mix, _MIX + _PLAIN + _MIXED + "SELECT * FROM mixed"),
    "p7_shares": (p7_shares, _MIX + _PLAIN + _MIXED + _SHARES),
    "p7_mix_calibrated": (lambda s, d: p7_mix(s, d, True), _MIX + _CALIBRATED + _MIXED + "SELECT * FROM mixed"),
    "p7_shares_calibrated": (lambda s, d: p7_shares(s, d, True), _MIX + _CALIBRATED + _MIXED + _SHARES),
    "p8_found": (p8_found, None),
    "p8_scores": (p8_scores, None),
    "p8_unseen_hosts": (lambda s, d: host_validation(table(s, d, "documents")), None),
}
