"""Ancestry tracts: calling, coordinates, overlaps, islands and summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.states import StateSpace


def target_posteriors(bins: DataFrame, space: StateSpace, keep: Sequence[str]) -> DataFrame:
    """(keep, target, type, p): for every run target the sum of the posteriors of its states. Narrow, no shuffle."""
    rows = [F.struct(F.lit(n).alias("target"), F.lit(t).alias("type"), sum((F.col(f"`{s}`") for s in cols[1:]), F.col(f"`{cols[0]}`")).alias("p")) for n, t, cols in space.run_targets() if cols]
    return bins.select(*keep, F.explode(F.array(*rows)).alias("x")).select(*keep, "x.*")


def scoring_segments(p: np.ndarray, penalty: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of log(p + penalty) of more than one element, highest total first, each (first, last, score)."""
    return [(a, b, score) for a, b, score in ranked_segments(p, penalty) if a < b]


def ranked_segments(p: np.ndarray, penalty: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments, those of one element too, highest total first.

    One pass over cumulative totals keeps candidate segments on a stack, each with its totals before and after and a link to
    the nearest earlier candidate that starts lower; a candidate that ends higher than that one swallows all between. Every
    candidate is pushed and popped once.

    Conventions: a sequence that starts with a negative value is entered with that debt, and a segment that pays it off begins
    at the first element. A segment's score leaves out its first element. Segments of one element are not reported as runs.
    """
    x = np.log(np.asarray(p, float) + penalty).tolist()
    if not x:
        return []
    debt = min(x[0], 0.0)
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, total before, total after, link
    total = 0.0
    for i, v in enumerate(x):
        if i == 0 and debt < 0:
            continue
        v += debt if i == 1 else 0.0
        if v > 0:
            first, low, high = i, total, total + v
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][2] >= low:
                    j = stack[j][4]
                if j < 0 or stack[j][3] >= high:
                    stack.append((first, i, low, high, j))
                    break
                first, low = stack[j][0], stack[j][2]
                del stack[j:]
        total += v
    out = []
    for first, last, low, high, _ in stack:
        if first == 1 and debt < 0:
            out.append((0, last, high - low - debt, high - low))
        else:
            out.append((first, last, high - low - x[first], high - low))
    return [(a, b, score) for a, b, score, _ in sorted(out, key=lambda r: (-r[3], r[0]))]


def call_runs(targets: DataFrame, keys: Sequence[str], order: str, penalty: float = 0.2) -> DataFrame:
    """(keys, start, end, score, rank) of the scoring segments of every (keys) sequence; start and end are values of ``order``,
    rank 1 has the highest total; segments of one element have a rank but no row."""
    types = ", ".join(f"`{k}` {targets.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        o = pdf[order].to_numpy()
        rows = [(*key, int(o[a]), int(o[b]), s, n + 1) for n, (a, b, s) in enumerate(ranked_segments(pdf["p"].to_numpy(float), penalty)) if a < b]
        return pd.DataFrame(rows, columns=[*keys, "start", "end", "score", "rank"])

    return targets.select(*keys, order, "p").groupBy(*keys).applyInPandas(run, f"{types}, start long, end long, score double, rank int")


def recall_runs(bins: DataFrame, states: Sequence[str], keys: Sequence[str], order: str, penalty: float = 0.2) -> DataFrame:
    """Runs called anew from a table of decoded bins: sources are the states whose name is part of another's, or the only ones."""
    homo = tuple(s for s in states if sum(s in x for x in states) > 1) or tuple(states)
    pairs = {"".join((a, b)): (a, b) for a in homo for b in homo if a != b}
    space = StateSpace(homo, homo, tuple(pairs[s] for s in states if s in pairs))
    coords = bins.select(*keys, order, "map", "pos")
    runs = call_runs(target_posteriors(bins, space, [*keys, order]), [*keys, "target", "type"], order, penalty)
    return run_coordinates(runs, coords, keys, order)


def run_coordinates(runs: DataFrame, bins: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Runs with map and pos of their first and last bin, lengths and the score per bin."""
    b = bins.select(*keys, F.col(order).alias("__o"), "map", "pos")
    a = b.withColumnsRenamed({"__o": "start"})
    z = b.select(*keys, F.col("__o").alias("end"), F.col("map").alias("map_end"), F.col("pos").alias("pos_end"))
    r = runs.join(a, [*keys, "start"], "left").join(z, [*keys, "end"], "left")
    r = r.withColumn("len", F.col("end") - F.col("start"))
    return r.withColumn("map_len", F.col("map_end") - F.col("map")).withColumn("pos_len", F.col("pos_end") - F.col("pos")).withColumn("nscore", F.col("score") / F.nullif("len", F.lit(0)))


def state_runs(bins: DataFrame, keys: Sequence[str], order: str, state: str) -> DataFrame:
    """(keys, state, start, end, n): stretches of equal state over consecutive ``order``; bins of a sequence are bounded."""
    by = Window.partitionBy(*keys, state).orderBy(order)
    x = bins.select(*keys, order, state).withColumn("__i", F.col(order) - F.row_number().over(by))
    return x.groupBy(*keys, state, "__i").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("n")).drop("__i")


def fragment_islands(rows: DataFrame, keys: Sequence[str], order: str, gap: int = 1) -> DataFrame:
    """``rows`` with ``island``: a new one starts where ``order`` rises by more than ``gap``. Order values must be unique per keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce(F.col(order) - F.lag(order).over(w) > gap, F.lit(False)).cast("int")
    return rows.withColumn("__new", new).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def smooth_runs(bins: DataFrame, keys: Sequence[str], order: str, flag: str, longest_gap: int) -> DataFrame:
    """(keys, start, end, n): runs of true ``flag`` after false runs of up to ``longest_gap`` bins between true ones count as true.

    Only true rows matter: two of them join when at most ``longest_gap`` bins lie between them.
    """
    hit = bins.where(F.col(flag)).select(*keys, order)
    x = fragment_islands(hit, keys, order, longest_gap + 1)
    return x.groupBy(*keys, "island").agg(F.min(order).alias("start"), F.max(order).alias("end")).withColumn("n", F.col("end") - F.col("start") + 1).drop("island")


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], bucket: int, lo: str = "start", hi: str = "end", rlo: str = "r_start", rhi: str = "r_end") -> DataFrame:
    """Pairs whose closed intervals overlap, as an equi-join on fixed-width buckets.

    Each interval is listed in every bucket it meets; a pair is kept only in the bucket that holds the later of the two
    starts, so that no pair comes out twice. Columns of the two sides must differ but for ``on``. Rows with null ends match nothing.
    """
    cut = lambda c: F.floor(F.col(c) / bucket)
    spread = lambda df, a, b: df.where(F.col(a) <= F.col(b)).withColumn("__b", F.explode(F.sequence(cut(a), cut(b))))
    j = spread(left, lo, hi).join(spread(right, rlo, rhi), [*on, "__b"])
    return j.where((F.col(lo) <= F.col(rhi)) & (F.col(rlo) <= F.col(hi)) & (F.col("__b") == F.floor(F.greatest(lo, rlo) / bucket))).drop("__b")


def annotate(left: DataFrame, right: DataFrame, on: Sequence[str], ids: Sequence[str], label: str, bucket: int, **names: str) -> DataFrame:
    """``left`` with the sorted labels of all overlapping rows of ``right``, ':'-joined; null for none."""
    j = overlap_join(left, right, on, bucket, **names).groupBy(*ids).agg(F.array_join(F.array_sort(F.collect_set(label)), ":").alias("labels"))
    return left.join(j, list(ids), "left")


def overlap_weighted_mean(left: DataFrame, right: DataFrame, on: Sequence[str], ids: Sequence[str], value: str, bucket: int) -> DataFrame:
    """(ids, mean): mean of ``value`` over overlapping rows of ``right`` weighted by the overlap's length."""
    j = overlap_join(left, right, on, bucket)
    w = F.least("end", "r_end") - F.greatest("start", "r_start")
    return j.withColumn("__w", w).groupBy(*ids).agg((F.sum(F.col("__w") * F.col(value)) / F.nullif(F.sum("__w"), F.lit(0))).alias("mean"))


def overlaps_any(left: DataFrame, right: DataFrame, on: Sequence[str], ids: Sequence[str], bucket: int) -> DataFrame:
    """``left`` with a flag telling whether any row of ``right`` overlaps."""
    hit = overlap_join(left, right, on, bucket).select(*ids).distinct().withColumn("__hit", F.lit(True))
    return left.join(hit, list(ids), "left").withColumn("overlaps", F.coalesce("__hit", F.lit(False))).drop("__hit")


def select_tracts(tracts: DataFrame, chrom: str | None = None, start: int | None = None, end: int | None = None, length: str = "len", min_length: float | None = None, targets: Sequence[str] | None = None, types: Sequence[str] | None = None) -> DataFrame:
    """Tracts that meet a region (closed), of at least a length, of some targets and types; a null fails every condition asked."""
    out = tracts
    for ok in (
        None if chrom is None else F.col("chrom") == chrom, None if start is None else F.col("end") >= start, None if end is None else F.col("start") <= end, None if min_length is None else F.col(length) >= min_length,
        None if targets is None else F.col("target").isin(*targets), None if types is None else F.col("type").isin(*types),
    ):
        out = out if ok is None else out.where(ok)
    return out


def explode_bins(runs: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per bin of every run."""
    return runs.withColumn("bin", F.explode(F.sequence(F.col(start), F.col(end))))


def occupancy(runs: DataFrame) -> DataFrame:
    """(state, mean, sd, lower, upper): share of the genome per state over replicates; absent (state, replicate) pairs count 0."""
    per = runs.groupBy("it", "state").agg(F.sum("len").alias("n"))
    total = runs.groupBy("it").agg(F.sum("len").alias("all"))
    k = F.col("k")
    s = per.join(total, "it").withColumn("p", F.col("n") / F.col("all"))
    its = runs.agg(F.countDistinct("it").alias("k"))
    g = s.groupBy("state").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")).join(F.broadcast(its))  # its is one row
    mean = F.col("s") / k
    g = g.withColumn("mean", mean).withColumn("sd", F.sqrt(F.greatest((F.col("q") - k * mean * mean) / F.nullif(k - 1, F.lit(0)), F.lit(0.0))))
    return g.select("state", "mean", "sd", (F.col("mean") - 1.96 * F.col("sd")).alias("lower"), (F.col("mean") + 1.96 * F.col("sd")).alias("upper"))


def length_histogram(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return runs.groupBy(*keys, "len").agg(F.count(F.lit(1)).alias("n"))


def tract_summary(runs: DataFrame, by: Sequence[str], sample: str, length: str) -> DataFrame:
    return runs.groupBy(*by).agg(
        F.countDistinct(sample).alias("n_samples"), F.count(F.lit(1)).alias("n_tracts"), F.avg(length).alias("mean_len"), F.sum(length).alias("total"), F.max(length).alias("longest"), (F.count(F.lit(1)) / F.nullif(F.countDistinct(sample), F.lit(0))).alias("per_sample")
    )


def exponential_rate(length: Column, trunc: float) -> Column:
    """Maximum-likelihood rate of exponential lengths above ``trunc``, as an aggregate."""
    return 1 / F.nullif(F.avg(F.when(length >= trunc, length)) - trunc, F.lit(0.0))


def fit_lengths(runs: DataFrame, keys: Sequence[str], length: str, trunc: float) -> DataFrame:
    """(keys, n, rate, ll_exp, scale, shape, ll_lomax, p): exponential against Lomax lengths above ``trunc``, from the length histogram.

    Lengths are first counted by value, so a group is as large as its distinct lengths.
    """
    from strandline.numeric import chi2_tail_1, maximise_1d

    h = runs.where(F.col(length) >= trunc).groupBy(*keys, F.round(length, 4).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    types = ", ".join(f"{k} {runs.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = pdf["x"].to_numpy(float) - trunc, pdf["n"].to_numpy(float)
        total = n.sum()
        mean = max((n * x).sum() / total, 1e-12)
        ll_exp = -total * np.log(mean) - total

        # density above trunc: k / s (1 + x / s)^-(k + 1) with s > 0; k has a closed form given s
        def shape(s: float) -> float:
            return total / max((n * np.log1p(x / s)).sum(), 1e-300)

        def ll(log_s: float) -> float:
            s = np.exp(log_s)
            k = shape(s)
            return float(total * np.log(k / s) - (k + 1) * (n * np.log1p(x / s)).sum())

        ls = maximise_1d(ll, np.log(mean) - 5, np.log(mean) + 12)
        s = float(np.exp(ls))
        best = max(ll(ls), ll_exp)
        return pd.DataFrame([(*key, int(total), 1 / mean, ll_exp, s - trunc, shape(s), best, 0.5 * chi2_tail_1(2 * (best - ll_exp)))], columns=[*keys, "n", "rate", "ll_exp", "scale", "shape", "ll_lomax", "p"])

    return h.groupBy(*keys).applyInPandas(run, f"{types}, n long, rate double, ll_exp double, scale double, shape double, ll_lomax double, p double")
