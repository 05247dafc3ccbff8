"""Queries of the general operators: hot keys, intervals, missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.canon import canon_chrom, canon_name
from strandline.operators.eager import eager_join_aggregate, heavy_keys, rollup_states
from strandline.operators.impute import fill_category, fill_chrom_limits, fill_site_map
from strandline.operators.intervals import periods_and_gaps
from strandline.plans.tables import table

WS = "' ' || chr(9) || chr(10) || chr(13)"


def chrom_sql(c: str = "chrom") -> str:
    bare = f"regexp_replace(upper(trim({c}, {WS})), '^(CHR)?0*', '')"
    return f"CASE WHEN {bare} = '' THEN NULL WHEN {bare} = '23' THEN 'X' ELSE {bare} END"


def key_totals(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums per lib and per chrom over target_file ⋈ cont; sum_snps counts a library's sites once per row."""
    target = table(spark, d, "target_file").select(canon_chrom("chrom").alias("chrom"), "lib", "tref", "talt")
    state = eager_join_aggregate(
        target, table(spark, d, "cont").select("lib", "n_snps"), ["lib"], left_group=["chrom"], left_sums={"sum_tref": "tref", "sum_talt": "talt"}, right_sums={"sum_snps": "n_snps"}, how="left"
    )
    return rollup_states(state, {"lib": "lib", "chrom": "chrom"}, ["sum_tref", "sum_talt", "sum_snps"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(key_totals(spark, d), 0.05).select("key_field", "key_value")


def p2_key_totals(spark: SparkSession, d: str) -> DataFrame:
    return key_totals(spark, d).where("key_value is not null")


def p2_site_totals(spark: SparkSession, d: str) -> DataFrame:
    """target_file ⋈ reference_file on (chrom, pos), rolled up per chrom: rows, reads, and panel alleles met by reads."""
    t = table(spark, d, "target_file").select(canon_chrom("chrom").alias("chrom"), "pos", "tref", "talt")
    r = table(spark, d, "reference_file").select(canon_chrom("chrom").alias("chrom"), "pos", "AFR_alt")
    s = eager_join_aggregate(t, r, ["chrom", "pos"], left_sums={"sum_tref": "tref", "sum_talt": "talt"}, right_sums={"sum_afr_alt": "AFR_alt"})
    return s.groupBy("chrom").agg(*[F.sum(c).alias(c) for c in ("n_rows", "sum_tref", "sum_talt", "sum_afr_alt")])


def call_periods(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "frags").select(
        canon_name("sample").alias("name"),
        canon_chrom("chrom").alias("chrom"),
        F.col("pos").cast("long").alias("pos"),
        F.coalesce(F.col("pos_end").cast("long"), F.round(F.col("map_end") * 1e6).cast("long")).alias("pos_end"),
    )
    p = periods_and_gaps(f, ["name", "chrom"], "pos", "pos_end")
    names = table(spark, d, "samples").select(F.trim("sample").alias("sample")).where("sample is not null").groupBy(F.lower("sample").alias("name")).agg(F.min("sample").alias("sample"))
    # a call whose sample isn't in samples keeps its canonical name
    return p.join(names, "name", "left").select(F.coalesce("sample", "name").alias("sample"), "chrom", "kind", "pos", "pos_end")


def p3_cover(spark: SparkSession, d: str) -> DataFrame:
    """Covered and uncovered length per sample and chromosome."""
    n = F.col("pos_end") - F.col("pos")
    per, gap = F.col("kind") == "period", F.col("kind") == "gap"
    return call_periods(spark, d).groupBy("sample", "chrom").agg(
        F.count(F.when(per, 1)).alias("n_periods"), F.count(F.when(gap, 1)).alias("n_gaps"), F.sum(F.when(per, n)).alias("covered"), F.coalesce(F.sum(F.when(gap, n)), F.lit(0)).alias("uncovered")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The cells that the operator filled, each with a value that can be a genetic position (or none, if no value is known at all)."""
    done = lambda c: F.col("is_filled") & (F.col(c).isNull() | ((F.col(c) >= 0) & (F.col(c) < 400)))
    m = fill_site_map(table(spark, d, "reference_file")).where(done("cm_filled"))
    c = fill_chrom_limits(table(spark, d, "chrom_limits")).where(done("value_filled"))
    return m.select(F.lit("reference_file").alias("table_name"), F.lit("map").alias("field"), F.lit("").alias("panel"), "chrom", "pos").unionByName(
        c.select(F.lit("chrom_limits").alias("table_name"), "field", "panel", "chrom", F.lit(0).cast("long").alias("pos"))
    )


def p5_map_filled(spark: SparkSession, d: str) -> DataFrame:
    return fill_site_map(table(spark, d, "reference_file")).select("chrom", "pos", F.round("cm_filled", 6).alias("cm_filled"), "is_filled")


def p5_limits_filled(spark: SparkSession, d: str) -> DataFrame:
    return fill_chrom_limits(table(spark, d, "chrom_limits")).select("panel", "chrom", "field", F.round("value_filled", 6).alias("value_filled"), "is_filled")


def p5_alt_filled(spark: SparkSession, d: str) -> DataFrame:
    """Missing alternative alleles from sites of the same reference allele and chromosome."""
    r = (
        table(spark, d, "reference_file")
        .select(canon_chrom("chrom").alias("chrom"), "pos", "ref", "alt")
        .groupBy("chrom", "pos")
        .agg(F.min("ref").alias("ref"), F.min("alt").alias("alt"))
    )
    return fill_category(r, "alt", ["ref"], ["chrom"], out="alt_filled").select("chrom", "pos", "ref", "alt_filled", "is_filled")


_TOTALS = f"""
WITH state AS (SELECT t.lib, {chrom_sql('t.chrom')} AS chrom, t.tref, t.talt, c.n_snps FROM target_file t LEFT JOIN cont c ON t.lib = c.lib),
keyed AS (SELECT 'lib' AS key_field, lib AS key_value, tref, talt, n_snps FROM state
 UNION ALL SELECT 'chrom', chrom, tref, talt, n_snps FROM state),
totals AS (SELECT key_field, key_value, count(*) AS n_rows, CAST(sum(tref) AS BIGINT) AS sum_tref, CAST(sum(talt) AS BIGINT) AS sum_talt, CAST(sum(n_snps) AS BIGINT) AS sum_snps
 FROM keyed GROUP BY 1, 2)
"""

_PERIODS = f"""
WITH f AS (SELECT lower(trim(sample, {WS})) AS name, {chrom_sql()} AS chrom, CAST(pos AS BIGINT) AS a,
  coalesce(CAST(pos_end AS BIGINT), CAST(round(map_end * 1e6) AS BIGINT)) AS b FROM frags WHERE sample IS NOT NULL),
i AS (SELECT name, chrom, least(a, b) AS a, greatest(a, b) AS b FROM f WHERE name <> ''),
m AS (SELECT *, max(b) OVER (PARTITION BY name, chrom ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY name, chrom ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM m),
per AS (SELECT name, chrom, grp, min(a) AS pos, max(b) AS pos_end FROM g GROUP BY 1, 2, 3),
both_kinds AS (SELECT name, chrom, 'period' AS kind, pos, pos_end FROM per UNION ALL
 SELECT * FROM (SELECT name, chrom, 'gap' AS kind, pos_end AS pos, lead(pos) OVER (PARTITION BY name, chrom ORDER BY pos) AS pos_end FROM per) WHERE pos_end IS NOT NULL),
names AS (SELECT lower(trim(sample)) AS name, min(trim(sample)) AS sample FROM samples WHERE sample IS NOT NULL GROUP BY 1),
out AS (SELECT coalesce(n.sample, p.name) AS sample, p.chrom, p.kind, p.pos, p.pos_end FROM both_kinds p LEFT JOIN names n ON n.name = p.name)
"""

_BAD = "({c} IS NULL OR isnan({c}) OR {c} < 0 OR {c} >= 400)"

_P5 = f"""
WITH s AS (SELECT {chrom_sql()} AS chrom, CAST(pos AS BIGINT) AS pos, max(CASE WHEN {_BAD.format(c='map')} THEN NULL ELSE map END) AS v FROM reference_file GROUP BY 1, 2),
w AS (SELECT *, max(v) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s),
l AS (SELECT panel, {chrom_sql()} AS chrom, max(CASE WHEN {_BAD.format(c='AA_Map_min')} THEN NULL ELSE AA_Map_min END) AS aa,
 max(CASE WHEN {_BAD.format(c='deCODE_max')} OR deCODE_max = 0 THEN NULL ELSE deCODE_max END) AS de FROM chrom_limits GROUP BY 1, 2)
SELECT 'reference_file' AS table_name, 'map' AS field, '' AS panel, chrom, pos FROM w WHERE v IS NULL OR v < m
UNION ALL SELECT 'chrom_limits', 'AA_Map_min', panel, chrom, CAST(0 AS BIGINT) FROM l WHERE aa IS NULL
UNION ALL SELECT 'chrom_limits', 'deCODE_max', panel, chrom, CAST(0 AS BIGINT) FROM l WHERE de IS NULL
"""



def _mixed_sql(src: str, y: str, x: str, group: str, time: str, tag: str) -> str:
    """CTEs that end in {tag}_w: the rows of ``src`` with ``fit``, the mixed-effects prediction; step by step as in the docstring of fill_numeric."""
    both = f"CASE WHEN {y} IS NOT NULL AND {x} IS NOT NULL THEN {{}} END"
    xb, yb = both.format(x), both.format(y)
    same = lambda a, b, ks: " AND ".join(f"{a}.{k.strip()} IS NOT DISTINCT FROM {b}.{k.strip()}" for k in ks.split(","))
    return f"""{tag}_g AS (SELECT {group}, count({y}) AS n, avg({y}) AS my, avg({xb}) AS mx, count({yb}) AS nb, count({yb}) * covar_pop({yb}, {xb}) AS sxy, count({yb}) * var_pop({xb}) AS sxx, count({yb}) * var_pop({yb}) AS syy FROM {src} GROUP BY ALL),
{tag}_t AS (SELECT sum(n * my) / sum(n) AS my, sum(nb * mx) / sum(nb) AS mx, sum(sxy) / nullif(sum(sxx), 0) AS slope0, sum(n) AS n, count(*) FILTER (n > 0) AS k FROM {tag}_g), {tag}_t2 AS (SELECT *, coalesce(slope0, 0) AS slope FROM {tag}_t),
{tag}_s AS (SELECT sum(CASE WHEN sxx > 0 THEN syy - sxy * sxy / sxx ELSE coalesce(syy, 0) END) AS rss, sum(CASE WHEN sxx > 0 THEN pow(sxy / sxx - slope, 2) * sxx END) AS bs, sum(CASE WHEN sxx > 0 THEN sxx END) AS ws, count(*) FILTER (sxx > 0) AS ks,
 sum(CASE WHEN g.n > 0 THEN pow(g.my - t.my - slope * (coalesce(g.mx, t.mx) - t.mx), 2) END) AS bi, sum(CASE WHEN g.n > 0 THEN 1.0 / g.n END) AS inv FROM {tag}_g g, {tag}_t2 t),
{tag}_v AS (SELECT t.*, rss / greatest(1, t.n - 2 * t.k) AS err, greatest(0, (bs - ks * (rss / greatest(1, t.n - 2 * t.k))) / ws) AS vs, greatest(0, (bi - (rss / greatest(1, t.n - 2 * t.k)) * inv) / t.k) AS vi FROM {tag}_s, {tag}_t2 t),
{tag}_b AS (SELECT g.* EXCLUDE (n, my, mx), coalesce(g.mx, v.mx) AS gx, slope + coalesce(CASE WHEN sxx > 0 THEN vs / (vs + err / sxx + 1e-300) * (sxy / sxx - slope) END, 0) AS gs, v.my + slope * (coalesce(g.mx, v.mx) - v.mx) AS base, g.n, g.my AS own, vi, err FROM {tag}_g g, {tag}_v v),
{tag}_e AS (SELECT *, base + coalesce(CASE WHEN n > 0 THEN vi / (vi + err / n + 1e-300) * (own - base) END, 0) AS gi FROM {tag}_b),
{tag}_f AS (SELECT s.*, gi + gs * coalesce({x} - gx, 0) AS line FROM {src} s LEFT JOIN {tag}_e e ON {same('s', 'e', group)}),
{tag}_c AS (SELECT {time}, count({y} - line) AS tn, avg({y} - line) AS tm, var_pop({y} - line) AS tv FROM {tag}_f GROUP BY ALL),
{tag}_q AS (SELECT sum(tn * tv) / greatest(1, sum(tn) - count(*) FILTER (tn > 0)) AS e2, greatest(0, (sum(tm * tm) - sum(tn * tv) / greatest(1, sum(tn) - count(*) FILTER (tn > 0)) * sum(CASE WHEN tn > 0 THEN 1.0 / tn END)) / count(*) FILTER (tn > 0)) AS vt FROM {tag}_c),
{tag}_w AS (SELECT f.*, line + coalesce(CASE WHEN tn > 0 THEN tm * vt / (vt + e2 / tn + 1e-300) END, 0) AS fit FROM {tag}_f f LEFT JOIN {tag}_c c ON {same('f', 'c', time)}, {tag}_q)"""


_MAP_FILLED = f"""
WITH s AS (SELECT {chrom_sql()} AS chrom, CAST(pos AS BIGINT) AS pos, max(CASE WHEN {_BAD.format(c='map')} THEN NULL ELSE map END) AS v FROM reference_file GROUP BY 1, 2),
m AS (SELECT *, max(v) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s),
d AS (SELECT chrom, pos, CAST(pos AS DOUBLE) AS x, CASE WHEN v < m THEN NULL ELSE v END AS cm, CAST(floor(pos / 1000000.0) AS BIGINT) AS stretch FROM m), {_mixed_sql('d', 'cm', 'x', 'chrom', 'chrom, stretch', 'mm')},
k AS (SELECT *, max(cm) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo, min(cm) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM mm_w)
SELECT chrom, pos, round(coalesce(cm, greatest(least(fit, coalesce(hi, 399.999)), coalesce(lo, 0))), 6) AS cm_filled, cm IS NULL AS is_filled FROM k"""
_OK = lambda c: f"max(CASE WHEN {_BAD.format(c=c)} THEN NULL ELSE {c} END) AS {c}"
_LIMITS_FILLED = f"""
WITH r AS (SELECT panel, {chrom_sql()} AS chrom, {', '.join(_OK(c) for c in ('deCODE_min', 'AA_Map_min', 'deCODE_max', 'AA_Map_max'))} FROM chrom_limits WHERE panel IS NOT NULL GROUP BY 1, 2),
d AS (SELECT panel, chrom, deCODE_min, AA_Map_max, CASE WHEN AA_Map_min > AA_Map_max THEN NULL ELSE AA_Map_min END AS aa, CASE WHEN deCODE_max = 0 OR deCODE_max < deCODE_min THEN NULL ELSE deCODE_max END AS de FROM r WHERE chrom IS NOT NULL),
{_mixed_sql('d', 'aa', 'deCODE_min', 'chrom', 'panel', 'a')}, {_mixed_sql('d', 'de', 'AA_Map_max', 'chrom', 'panel', 'z')}
SELECT panel, chrom, 'AA_Map_min' AS field, round(coalesce(aa, greatest(least(fit, coalesce(AA_Map_max, 399.999)), 0)), 6) AS value_filled, aa IS NULL AS is_filled FROM a_w
UNION ALL SELECT panel, chrom, 'deCODE_max', round(coalesce(de, greatest(least(fit, 399.999), coalesce(deCODE_min, 0))), 6), de IS NULL FROM z_w"""
_ALT_FILLED = f"""
WITH r AS (SELECT {chrom_sql()} AS chrom, pos, min(ref) AS ref, min(alt) AS alt FROM reference_file GROUP BY 1, 2), n AS (SELECT ref, chrom, alt AS c, CAST(count(*) AS DOUBLE) AS n FROM r WHERE alt IS NOT NULL GROUP BY 1, 2, 3),
o AS (SELECT c, sum(n) / sum(sum(n)) OVER () AS p FROM n GROUP BY 1), g0 AS (SELECT ref, c, sum(n) AS n FROM n GROUP BY 1, 2), refs AS (SELECT ref, sum(n) AS s FROM n GROUP BY 1),
pg AS (SELECT refs.ref, o.c, (coalesce(g0.n, 0) + 10 * o.p) / (refs.s + 10) AS p FROM refs CROSS JOIN o LEFT JOIN g0 ON g0.ref IS NOT DISTINCT FROM refs.ref AND g0.c = o.c),
cells AS (SELECT ref, chrom, sum(n) AS s FROM n GROUP BY 1, 2), pc AS (SELECT cells.ref, cells.chrom, pg.c, (coalesce(n.n, 0) + 10 * pg.p) / (cells.s + 10) AS p FROM cells JOIN pg ON pg.ref IS NOT DISTINCT FROM cells.ref LEFT JOIN n ON n.ref IS NOT DISTINCT FROM cells.ref AND n.chrom IS NOT DISTINCT FROM cells.chrom AND n.c = pg.c),
bc AS (SELECT ref, chrom, first(c ORDER BY p DESC, c) AS c FROM pc GROUP BY 1, 2), bg AS (SELECT ref, first(c ORDER BY p DESC, c) AS c FROM pg GROUP BY 1), bo AS (SELECT first(c ORDER BY p DESC, c) AS c FROM o)
SELECT r.chrom, r.pos, r.ref, coalesce(r.alt, bc.c, bg.c, bo.c) AS alt_filled, r.alt IS NULL AS is_filled FROM r LEFT JOIN bc ON bc.ref IS NOT DISTINCT FROM r.ref AND bc.chrom IS NOT DISTINCT FROM r.chrom LEFT JOIN bg ON bg.ref IS NOT DISTINCT FROM r.ref, bo"""

QUERIES = {
    "p2_found": (
        p2_found,
        _TOTALS + "SELECT key_field, key_value FROM (SELECT *, sum(n_rows) OVER (PARTITION BY key_field) AS total FROM totals) WHERE key_value IS NOT NULL AND n_rows >= 0.05 * total",
    ),
    "p2_key_totals": (p2_key_totals, _TOTALS + "SELECT * FROM totals WHERE key_value IS NOT NULL"),
    "p2_site_totals": (
        p2_site_totals,
        f"""WITH t AS (SELECT {chrom_sql()} AS chrom, pos, tref, talt FROM target_file), r AS (SELECT {chrom_sql()} AS chrom, pos, AFR_alt FROM reference_file)
SELECT t.chrom, count(*) AS n_rows, CAST(sum(tref) AS BIGINT) AS sum_tref, CAST(sum(talt) AS BIGINT) AS sum_talt, CAST(sum(AFR_alt) AS BIGINT) AS sum_afr_alt
FROM t JOIN r ON t.chrom = r.chrom AND t.pos = r.pos GROUP BY 1""",
    ),
    "p3_found": (call_periods, _PERIODS + "SELECT * FROM out"),
    "p3_cover": (
        p3_cover,
        _PERIODS
        + """SELECT sample, chrom, count(CASE WHEN kind = 'period' THEN 1 END) AS n_periods, count(CASE WHEN kind = 'gap' THEN 1 END) AS n_gaps,
CAST(sum(CASE WHEN kind = 'period' THEN pos_end - pos END) AS BIGINT) AS covered, CAST(coalesce(sum(CASE WHEN kind = 'gap' THEN pos_end - pos END), 0) AS BIGINT) AS uncovered FROM out GROUP BY 1, 2""",
    ),
    "p5_found": (p5_found, _P5),
    "p5_map_filled": (p5_map_filled, _MAP_FILLED),
    "p5_limits_filled": (p5_limits_filled, _LIMITS_FILLED),
    "p5_alt_filled": (p5_alt_filled, _ALT_FILLED),
}
