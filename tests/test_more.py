"""Exact quantiles, blocked products and scans, segments, priors and both ends of damage, against plain versions."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import hmm as H
from strandline.operators import panelstats as P
from strandline.operators import sites as S
from strandline.operators.extras import diploid_rates
from strandline.operators.tracts import ranked_segments, recall_runs, scoring_segments
from strandline.plans.quantiles import quantiles, values_at
from strandline.plans.scan import block_of_hot, running_sum
from strandline.states import StateSpace


@pytest.mark.parametrize("most", [0, 65_536])
def test_quantiles_are_exact(spark, monkeypatch, most):
    monkeypatch.setattr("strandline.plans.quantiles.MOST_VALUES", most)
    rng = random.Random(1)
    vals = [rng.choice([0.0, 1e-300, -5.0, rng.lognormvariate(0, 40), float(rng.randint(0, 9))]) for _ in range(3000)] + [7.5] * 1000
    df = spark.createDataFrame([(v,) for v in vals] + [(None,), (float("nan"),)], "v double")
    ranks = [0, 1, 17, 1500, 2999, 3999]
    assert values_at(df, "v", ranks) == [sorted(vals)[r] for r in ranks]
    clean = df.where("not isnan(v)")
    assert quantiles(clean, "v", [0.0, 0.5, 1.0]) == [min(vals), sorted(vals)[math.floor(0.5 * (len(vals) - 1))], max(vals)]
    assert quantiles(df.limit(0), "v", [0.5]) == [None]
    x = P.quantile_bins(spark.createDataFrame([(i,) for i in range(10)] + [(None,)], "v int"), "v", 5)
    assert [r.bin for r in x.orderBy(F.col("v").asc_nulls_last()).collect()] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, None]
    assert P.quantile_bins(x.drop("bin").limit(0), "v", 5).count() == 0


@pytest.mark.parametrize("block", [2, 5, 512])
def test_sharing_in_blocks(spark, block):
    rng = random.Random(2)
    rows = [(rng.choice(["1", "2", None]), rng.randrange(12), rng.choice([None, *"abcdefghij"])) for _ in range(300)]
    got = {(r.a, r.b): r.n for r in P.pairwise_sharing(spark.createDataFrame(rows, "c string, p int, s string").withColumn("n", F.lit("clash")), ["c", "p"], "s", block).collect()}
    units = {}
    for c, p, s in rows:
        if s is not None:
            units.setdefault((c, p), set()).add(s)
    want = {}
    for u in units.values():
        for a in u:
            for b in u:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert got == want
    assert P.pairwise_sharing(spark.createDataFrame([], "c string, p int, s string"), ["c", "p"], "s").count() == 0


def plain_segments(p, penalty):
    """By the definition: the highest total of any stretch, then the same left and right of it."""
    x = np.log(np.asarray(p) + penalty)
    if len(x) > 1 and x[0] < 0:
        x = np.r_[0.0, x[0] + x[1], x[2:]]
    out = []

    def split(lo, hi):
        best = (0.0, None)
        for a in range(lo, hi):
            for b in range(a, hi):
                t = x[a : b + 1].sum()
                if t > best[0] + 1e-12:
                    best = (t, (a, b))
        if best[1]:
            out.append(best[1])
            split(lo, best[1][0])
            split(best[1][1] + 1, hi)

    split(0, len(x))
    first = math.log(p[0] + penalty) < 0
    return sorted((0 if a == 1 and first else a, b) for a, b in out)


def test_segments_are_the_recursive_maxima():
    rng = np.random.default_rng(3)
    for _ in range(150):
        p = np.clip(rng.beta(0.5, 0.5, rng.integers(2, 16)), 0, 1)
        assert sorted((a, b) for a, b, _ in ranked_segments(p, 0.2)) == plain_segments(p, 0.2)
        for a, b, s in scoring_segments(p, 0.2):
            assert a < b and s == pytest.approx(np.log(p[a + 1 : b + 1] + 0.2).sum())
    assert len(scoring_segments(np.tile([0.9, 0.9, 0.01], 50_000), 0.2)) > 1000


def test_runs_are_called_anew(spark):
    rows = [("a", "1", i, 0.1 * i, i * 100, *((0.05, 0.9, 0.05) if 5 <= i <= 9 else (0.9, 0.05, 0.05))) for i in range(15)]
    b = spark.createDataFrame(rows, "sample string, chrom string, id long, map double, pos long, AFR double, NEA double, AFRNEA double")
    got = {(r.target, r.type): (r.start, r.end, r.pos, r.pos_end) for r in recall_runs(b, ["AFR", "NEA", "AFRNEA"], ["sample", "chrom"], "id").where("rank = 1").collect()}
    assert got["NEA", "homo"] == (5, 9, 500, 900)


def test_hot_entities_are_found(spark):
    df = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 1), (None, 2), *[(None, i) for i in range(9)]], "k string, v int")
    assert {(r.k, r["__hot"]) for r in block_of_hot(df, ["k"], 8).collect()} == {("a", True), ("b", False), (None, True)}
    assert {r["__hot"] for r in block_of_hot(df, ["k"], 100).collect()} == {False}


def test_running_sum_over_a_whole_table(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "o long, v long")
    got = {r.o: r.s for r in running_sum(df, [], "o", "v", "s", 7, null_keys=False).collect()}
    assert got == {i: sum(k % 3 for k in range(i + 1)) for i in range(50)}


def test_interpolation_is_linear_in_time_and_blocked(spark):
    knots = spark.createDataFrame([("1", 10, 1.0), ("1", 30, 2.0), ("1", 5000, 9.0)], "chrom string, p int, m double")
    pts = [("1", x) for x in (1, 10, 20, 30, 40, 2000, 5000, 9000, 20)] + [("2", 5)]
    for block in (16, 1 << 20):
        got = sorted((r.chrom, r.x, r.map) for r in S.interpolate_map(spark.createDataFrame(pts, "chrom string, x int"), knots, "x", "p", "m", block=block).collect())
        want = sorted((c, x, float(np.interp(x, [10, 30, 5000], [1.0, 2.0, 9.0])) if c == "1" else None) for c, x in pts)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all((a[2] is None and b[2] is None) or a[2] == pytest.approx(b[2]) for a, b in zip(got, want))


def test_damage_from_both_ends(spark):
    rows = [("TCAT", "CCAC", False, 0, 0, 0), ("ATAC", "ACAC", False, 1, 2, 1), ("AACC", "GACC", True, 3, 0, 0), ("ACGT", "ACGT", False, -1, -1, -1), ("", "", True, -1, -1, -1)]
    df = spark.createDataFrame([(a, b, c) for a, b, c, *_ in rows], "s string, r string, rev boolean")
    five, three = P.damage_positions(F.col("s"), F.col("r"), F.col("rev"))
    got = df.select(five.alias("f"), three.alias("t"), P.damage_position(F.col("s"), F.col("r"), F.col("rev")).alias("n")).collect()
    assert [tuple(r) for r in got] == [r[3:] for r in rows]


def test_priors(spark):
    s = spark.createDataFrame([(1, 3, 1, 1, 0), (2, 0, 4, 0, 1), (3, 2, 2, 0, 0), (4, 4, 0, 1, 0)], "i int, A_ref int, A_alt int, O_ref int, O_alt int")
    fixed = S.with_priors(s, ["A"], 0.5, "O", 2.0).orderBy("i").collect()
    assert [(r.A_pa, r.A_pb) for r in fixed] == [(0.5, 2.5), (2.5, 0.5), (0.5, 0.5), (0.5, 2.5)]
    even = S.with_priors(s, ["A"], None).select("A_pa", "A_pb").distinct().collect()
    assert len(even) == 1 and even[0].A_pa == pytest.approx(even[0].A_pb) and even[0].A_pa > 0
    known = S.with_priors(s, ["A"], None, "O", 1.0).orderBy("i").collect()
    assert known[0].A_pb == known[3].A_pb == known[1].A_pa > 1 and known[2].A_pa == pytest.approx(even[0].A_pa)


def test_haploid_sequences_use_their_own_states(spark):
    space = StateSpace(("A", "B"))
    p = H.HmmParams.initial(space, ["l"])
    e = spark.createDataFrame([(c, i, [0.0, -2.0 * (i % 2), 5.0]) for c in ("1", "X") for i in range(6)], "chrom string, bin long, e array<double>")
    got = {r.chrom: r.ll for r in H.sequence_ll(e, ["chrom"], "bin", p, ["X"]).collect()}
    m = np.array([[0.0, -2.0 * (i % 2)] for i in range(6)])
    assert got["X"] == pytest.approx(H.forward_backward(m, np.array(p.trans_hap), np.array(p.start_hap)).ll)
    assert got["1"] > got["X"] + 20
    d = H.decode(e, ["chrom"], "bin", p, space.names, ["X"]).where("chrom = 'X'")
    assert d.agg(F.max("AB"), F.min(F.col("A") + F.col("B"))).first()[0] == 0 and d.where("viterbi = 'AB'").count() == 0
    runs = H.posterior_runs(e, ["chrom"], "bin", p, space, 3, haploid=["X"]).groupBy("chrom", "it").agg(F.sum("len").alias("n")).collect()
    assert {(r.chrom, r.n) for r in runs} == {("1", 12), ("X", 6)}


def test_start_values():
    space = StateSpace(("A", "B", "C"))
    p = H.HmmParams.initial(space, ["l"]).favouring(space, ["AB"])
    t = np.array(p.trans)
    assert np.allclose(t.sum(axis=1), 1) and t[0].argmax() == space.names.index("AB")
    rates = np.array([[-0.3, 0.2, 0.1], [0.05, -0.1, 0.05], [0.0, 0.4, -0.4]])
    q = diploid_rates(rates, space)
    assert np.allclose(q.sum(axis=1), 0) and q[space.names.index("AB"), space.names.index("B")] == pytest.approx(0.2)
    r = p.with_rates(space, rates, 2.0)
    assert np.allclose(np.array(r.trans).sum(axis=1), 1) and np.array(r.trans_hap).shape == (3, 3)


def test_permutation_share(spark):
    obs = spark.createDataFrame([("1", 5), ("2", 0)], "c string, n int")
    null = spark.createDataFrame([("1", r, r) for r in range(10)] + [("2", r, 0) for r in range(10)], "c string, rep int, n int")
    assert {r.c: r.p for r in P.permutation_p(obs, null, ["c"], "n").collect()} == {"1": 0.4, "2": 0.0}


def test_alleles_are_oriented(spark):
    s = spark.createDataFrame([("1", 1, "A", "C"), ("1", 2, "A", "C"), ("1", 3, "A", "C"), ("1", 4, "A", "C"), (None, 5, "A", "C")], "chrom string, pos int, ref string, alt string")
    b = spark.createDataFrame([("1", 1, "a"), ("1", 2, "C"), ("1", 2, "C"), ("1", 3, "G")], "chrom string, pos int, base string")
    got = {r.pos: (r.ref, r.alt, r.kind) for r in S.orient_alleles(s, b).collect()}
    assert got == {1: ("A", "C", "keep"), 2: ("C", "A", "swap"), 3: ("A", "C", "mismatch"), 4: ("A", "C", "missing"), 5: ("A", "C", "missing")}


def test_thinning_keeps_one_of_ties(spark):
    s = spark.createDataFrame([("1", 5, "b"), ("1", 5, "a"), ("1", 9, "c"), ("1", 16, "d"), (None, 3, "e"), ("2", None, "f")], "chrom string, pos int, x string")
    assert sorted((r.pos, r.x) for r in S.greedy_thin(s, "pos", 10).collect()) == [(5, "a"), (16, "d")]
    assert S.greedy_thin(s.limit(0), "pos", 10).count() == 0


def test_sequences_in_pieces(spark, tmp_path, monkeypatch):
    from strandline.sources import text as T

    monkeypatch.setattr(T, "FASTA_PIECE", 7)
    rng = random.Random(4)
    seqs = {f"c{k}": "".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 60))) for k in range(5)}
    wrapped = "".join(f">{k} note\n" + "".join(s[i : i + 11] + "\n" for i in range(0, len(s), 11)) for k, s in seqs.items())
    (tmp_path / "x.fa").write_text(wrapped + ">long\r\n" + "acgt" * 9 + "\r\n\n")
    got = T.read_fasta(spark, str(tmp_path / "x.fa"), block=64).toPandas().sort_values(["chrom", "pos"])
    assert {c: "".join(g.base) for c, g in got.groupby("chrom")} == {**seqs, "long": "ACGT" * 9}
    assert all(g.pos.tolist() == list(range(1, len(g) + 1)) for _, g in got.groupby("chrom"))
    assert isinstance(got, pd.DataFrame)
