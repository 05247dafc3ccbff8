"""Scans, eager aggregation, interval sweep and imputation against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions.canon import canon_chrom, canon_name, canon_sources
from strandline.operators.eager import eager_join_aggregate, heavy_keys, rollup_states
from strandline.operators.impute import fill_category, fill_chrom_limits, fill_numeric, fill_site_map
from strandline.operators.intervals import periods_and_gaps
from strandline.plans.scan import nearest, running_max_before, running_sum


def test_canonical_spellings(spark):
    rows = [("chr01", "1"), (" 1", "1"), ("CHR22 ", "22"), ("23", "X"), ("x", "X"), ("chrX", "X"), ("", None), (None, None), ("10", "10")]
    got = spark.createDataFrame([(a,) for a, _ in rows], "c string").select(canon_chrom("c")).collect()
    assert [r[0] for r in got] == [b for _, b in rows]
    rows = [("AFR/AFR", "AFR"), ("NEA-AFR", "AFRNEA"), ("\tDEN", "DEN"), ("NaN", None), (".", None), ("", None), (None, None), ("Den_nea", "NEADEN")]
    got = spark.createDataFrame([(a,) for a, _ in rows], "c string").select(canon_sources("c"), canon_name("c")).collect()
    assert [r[0] for r in got] == [b for _, b in rows]


def test_blocked_scans_match_plain_ones(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, rng.randint(-5, 5)])) for k in (None, "a", "b") for i in rng.sample(range(200), 60)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    s = {(r.k, r.o): r.s for r in running_sum(df, ["k"], "o", "v", "s", 16).collect()}
    m = {(r.k, r.o): r.m for r in running_max_before(df, ["k"], "o", "v", "m", 16).collect()}
    n = {(r.k, r.o): (r.p, r.n) for r in nearest(df, ["k"], "o", "v", "p", "n", 16).collect()}
    for k in (None, "a", "b"):
        own = sorted((o, v) for kk, o, v in rows if kk == k)
        for i, (o, _) in enumerate(own):
            before, after = [v for _, v in own[:i] if v is not None], [v for _, v in own[i + 1 :] if v is not None]
            upto = [v for _, v in own[: i + 1] if v is not None]
            assert (s[k, o] or 0) == sum(upto)
            assert m[k, o] == max(before, default=None)
            assert n[k, o] == (before[-1] if before else None, after[0] if after else None)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_eager_aggregate_equals_plain_join(spark, how):
    rng = random.Random(2)
    a = spark.createDataFrame([(rng.choice(["x", "x", "x", "y", None]), rng.choice("pq"), rng.choice([None, 1, 2])) for _ in range(80)], "k string, g string, v long")
    b = spark.createDataFrame([(rng.choice(["x", "z", None]), rng.choice([None, 5, 7])) for _ in range(20)], "k string, w long")
    b = b.withColumn("g", F.lit("clash")).withColumn("v", F.lit(9))  # extra columns of the same names
    got = eager_join_aggregate(a, b, ["k"], ["g"], left_sums={"sv": "v"}, right_sums={"sw": "w"}, how=how)
    want = a.join(b.select("k", "w"), "k", how).groupBy("k", "g").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("v").alias("sv"), F.sum("w").alias("sw"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    r = rollup_states(got, {"k": "k", "g": "g"}, ["sv"])
    assert r.where("key_field = 'g'").agg(F.sum("n_rows")).first()[0] == want.agg(F.sum("n_rows")).first()[0]


def test_heavy_keys_count_null_rows_and_empty(spark):
    df = spark.createDataFrame([("a", 95), (None, 900), ("b", 5)], "k string, n_rows long")
    rolled = df.select(F.lit("k").alias("key_field"), F.col("k").alias("key_value"), "n_rows")
    assert [r.key_value for r in heavy_keys(rolled, 0.05).collect()] == ["a"]
    assert heavy_keys(rolled.limit(0), 0.05).count() == 0


def brute_periods(intervals):
    out, cur = [], None
    for a, b in sorted((min(x), max(x)) for x in intervals):
        if cur and a <= cur[1]:
            cur[1] = max(cur[1], b)
        else:
            cur = [a, b]
            out.append(cur)
    return [("period", a, b) for a, b in out] + [("gap", out[i][1], out[i + 1][0]) for i in range(len(out) - 1)]


def test_periods_against_brute_force(spark):
    rng = random.Random(3)
    data = {k: [(s := rng.randint(0, 300), s + rng.choice([0, 0, 1, 5, 40, -7])) for _ in range(rng.randint(1, 25))] for k in "abcdefgh"}
    rows = [(k, a, b) for k, v in data.items() for a, b in v] * 2 + [(None, 1, 2), ("a", None, None)]
    df = spark.createDataFrame(rows, "k string, s long, e long").withColumn("kind", F.lit("clash"))
    for hot in (0, 20, 1000):
        got = sorted((r.k, r.kind, r.s, r.e) for r in periods_and_gaps(df, ["k"], "s", "e", block=32, hot=hot).collect())
        assert got == sorted((k, *x) for k, v in data.items() for x in brute_periods(v))
    assert periods_and_gaps(df.limit(0), ["k"], "s", "e").count() == 0


def test_one_null_end_is_a_point(spark):
    df = spark.createDataFrame([("a", 5, None), ("a", None, 9), ("a", 9, 12)], "k string, s long, e long")
    got = sorted((r.kind, r.s, r.e) for r in periods_and_gaps(df, ["k"], "s", "e").collect())
    assert got == [("gap", 5, 9), ("period", 5, 5), ("period", 9, 12)]


def test_numeric_fill_recovers_lines_and_marks(spark):
    rows = [(g, t, float(x), 2.0 * x + off + 0.1 * t if (x + t) % 7 else None) for g, off in (("a", 0), ("b", 50)) for t in range(3) for x in range(20)]
    df = spark.createDataFrame([*rows, (None, None, None, None)], "g string, t int, x double, y double")
    out = fill_numeric(df, "y", ["g"], ["t"], "x").collect()
    for r in out:
        assert r.is_filled == (r.y is None)
        if r.g is not None and r.is_filled:
            assert abs(r.filled - (2 * r.x + (50 if r.g == "b" else 0) + 0.1 * r.t)) < 0.5
    assert len(out) == len(rows) + 1
    assert fill_numeric(df.limit(0), "y", ["g"], ["t"], "x").count() == 0
    none = fill_numeric(df.withColumn("y", F.lit(None).cast("double")), "y", ["g"], ["t"], "x").collect()
    assert all(r.filled is None and r.is_filled for r in none)


def test_small_groups_shrink_towards_the_rest(spark):
    rows = [(f"g{i}", 0, 10.0 + (j % 3)) for i in range(8) for j in range(30)] + [("tiny", 0, 40.0), ("tiny", 0, None)]
    out = fill_numeric(spark.createDataFrame(rows, "g string, t int, y double"), "y", ["g"], ["t"])
    v = out.where("is_filled").first().filled
    assert 10.0 < v <= 40.0


def test_category_fill(spark):
    rows = [("a", 1, "x")] * 5 + [("a", 1, None), ("a", 2, "y"), ("a", 2, None), ("b", 1, "z"), ("c", 9, None), (None, None, None)]
    df = spark.createDataFrame(rows, "g string, t int, v string")
    got = {(r.g, r.t): r.filled for r in fill_category(df, "v", ["g"], ["t"], strength=0.5).where("is_filled").collect()}
    assert got == {("a", 1): "x", ("a", 2): "y", ("c", 9): "x", (None, None): "x"}
    assert fill_category(df.limit(0), "v", ["g"], ["t"]).count() == 0


def test_site_map_missing_cells(spark):
    nan, inf = float("nan"), float("inf")
    cells = [(100, 0.0, False), (200, 0.0, False), (300, 1.0, False), (400, 0.0, True), (500, nan, True), (600, 2.0, False), (700, -9.0, True), (800, 400.0, True), (900, inf, True), (1000, None, True), (1100, 3.0, False)]
    rows = [(c, p, v) for c in ("chr1", "X ") for p, v, _ in cells] + [("01", 400, nan), (None, 5, 1.0), ("1", None, 1.0)]
    df = spark.createDataFrame(rows, "chrom string, pos int, map double").withColumn("cm", F.lit("clash"))
    out = fill_site_map(df).collect()
    assert len(out) == 2 * len(cells)
    for c in ("1", "X"):
        own = sorted((r for r in out if r.chrom == c), key=lambda r: r.pos)
        assert [r.is_filled for r in own] == [m for *_, m in cells]
        filled = [r.cm_filled for r in own]
        assert filled == sorted(filled)
    assert fill_site_map(df.limit(0)).count() == 0


def test_chrom_limits_missing_cells(spark):
    schema = "panel string, chrom string, deCODE_min double, AA_Map_min double, deCODE_max double, AA_Map_max double, Shared_Map_max double"
    rows = [(f"p{i}", c, 0.1 * k, 0.12 * k, 100.0 * k, 105.0 * k, 101.0 * k) for i in range(6) for k, c in ((1, "1"), (2, "2"), (3, "chr3"))]
    rows += [("p7", "1", 0.1, None, 0.0, 105.0, 101.0), ("p7", "02", 0.0, 0.0, 9999.0, 210.0, 202.0), ("p7", "2", 0.0, 0.0, -1.0, 210.0, 202.0)]
    got = {(r.panel, r.chrom, r.field): r for r in fill_chrom_limits(spark.createDataFrame(rows, schema)).collect()}
    assert {k for k, r in got.items() if r.is_filled} == {("p7", "1", "AA_Map_min"), ("p7", "1", "deCODE_max"), ("p7", "2", "deCODE_max")}
    assert abs(got["p7", "2", "deCODE_max"].value_filled - 200) < 20
    assert got["p7", "2", "AA_Map_min"].value_filled == 0.0
