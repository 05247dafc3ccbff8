"""One EM pass of the HMM per sequence in numpy: reads and sites of a sequence are packed once, an iteration is one job of one stage."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.likelihood import FLOOR, LOG_FACTORIAL
from strandline.plans.tables import materialise
from strandline.states import StateSpace

if TYPE_CHECKING:
    from strandline.operators.hmm import HmmParams

CHUNK = 1 << 16  # sites whose reads are worked on at once


def log_factorials(n: np.ndarray) -> np.ndarray:
    x = np.maximum(n, len(LOG_FACTORIAL) - 1).astype(float)
    series = (x + 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < len(LOG_FACTORIAL), np.array(LOG_FACTORIAL)[np.minimum(n, len(LOG_FACTORIAL) - 1)], series)


def _packed(t: pa.Table, sources: Sequence[str], calls: bool) -> bytes:
    """Arrays of a sequence: bins in order; per site its bin, kind of panel counts and first read count; per read count its kind
    (library and contaminant frequency) and alleles."""
    is_site = t["o"].is_valid().to_numpy(zero_copy_only=False)
    bins = np.unique(t["bin"].to_numpy()[~is_site])
    s = t.filter(pa.array(is_site))
    at = np.searchsorted(bins, s["bin"].to_numpy())
    known = np.zeros(len(at), bool)
    known[at < len(bins)] = bins[at[at < len(bins)]] == s["bin"].to_numpy()[at < len(bins)]
    s, at = s.filter(pa.array(known)), at[known]
    counts = np.column_stack([s[f"{p}_{x}"].to_numpy().astype(float) for p in sources for x in "ab"])
    kinds, kind = np.unique(counts, axis=0, return_inverse=True)
    o = s["o"].combine_chunks()
    o = pa.concat_arrays(o.chunks) if isinstance(o, pa.ChunkedArray) else o
    first, x = np.concatenate([[0], np.cumsum(o.value_lengths().to_numpy())]).astype(np.int64), o.flatten()
    libs = x.field("lib").dictionary_encode()
    lib, pc = libs.indices.to_numpy(), x.field("p_cont").to_numpy()
    ref, alt = x.field("tref").to_numpy(), x.field("talt").to_numpy()
    groups, u = np.unique(np.column_stack([lib.astype(float), pc]), axis=0, return_inverse=True)
    const = 0.0 if calls else float((log_factorials(ref + alt) - log_factorials(ref) - log_factorials(alt)).sum())
    names = libs.dictionary.to_pylist()
    data = {"n": len(bins), "at": at.astype(np.int32), "kinds": kinds, "kind": kind.ravel().astype(np.int32), "first": first, "u": u.ravel().astype(np.int32), "ref": ref.astype(np.int32), "alt": alt.astype(np.int32)}
    return pickle.dumps(data | {"libs": [names[int(k)] for k in groups[:, 0]], "pc": groups[:, 1], "const": const}, protocol=5)


def pack(obs: DataFrame, snps: DataFrame, bins: DataFrame, space: StateSpace, keys: Sequence[str], prior: float | None, calls: bool) -> DataFrame:
    """(keys, x): the reads, sites and bins of every sequence, one row each, in the checkpoint folder."""
    from strandline.operators.hmm import pseudo_counts

    site, spark = [*keys, "bin", "pos"], bins.sparkSession
    pc = F.lit(0.0) if calls else F.col("p_cont").cast("double")
    o = obs.select(*site, "lib", pc.alias("p_cont"), F.col("tref").cast("long").alias("tref"), F.col("talt").cast("long").alias("talt")).dropna(subset=["lib", "p_cont", "tref", "talt"])
    o = o.groupBy(*site).agg(F.collect_list(F.struct("lib", "p_cont", "tref", "talt")).alias("o"))
    ab = [c.cast("double").alias(f"{s}_{x}") for s in space.sources for x, c in zip("ab", pseudo_counts(s, prior))]
    rows = bins.select(*keys, F.col("bin").cast("long").alias("bin")).unionByName(snps.join(o, site).select(*keys, F.col("bin").cast("long").alias("bin"), *ab, "o"), allowMissingColumns=True)
    parts = max(1, min(bins.select(*keys).distinct().count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    types, sources = {k: bins.schema[k].dataType.simpleString() for k in keys}, space.sources

    def run(t: pa.Table) -> pa.Table:
        return t.select(list(keys)).slice(0, 1).append_column("x", pa.array([_packed(t, sources, calls)], pa.binary()))

    packed = rows.repartition(parts, *keys).groupBy(*keys).applyInArrow(run, ", ".join(f"{k} {v}" for k, v in types.items()) + ", x binary")
    return materialise(packed.repartition(parts))


def _genotypes(kinds: np.ndarray, space: StateSpace, params: HmmParams, haploid: bool) -> np.ndarray:
    """(kinds, states, 3): P(genotype | state), as ``hmm.state_genotypes``."""
    a, b = kinds[:, ::2].T, kinds[:, 1::2].T
    out = np.empty((len(kinds), space.n, 3))
    for k, (i, j) in enumerate(space.pairs):
        if j < 0 or (i == j and haploid):
            g0, g2 = b[i] / (a[i] + b[i]), a[i] / (a[i] + b[i])
        elif i != j:
            d = (a[i] + b[i]) * (a[j] + b[j])
            g0, g2 = b[i] * b[j] / d, a[i] * a[j] / d
        else:
            t, n, x = np.exp(params.tau[i]), a[i] + b[i], a[i] * b[i] * params.f[i] * np.exp(params.tau[i])
            d = n * (t * n + 1)
            g0, g2 = (b[i] * b[i] * t + b[i] + x) / d, (a[i] * a[i] * t + a[i] + x) / d
        out[:, k] = np.stack([g0, np.zeros(len(g0)) if j < 0 or (i == j and haploid) else 1 - g0 - g2, g2], axis=1)
    return out


def _reads(d: dict, lo: int, hi: int) -> tuple[slice, np.ndarray]:
    return slice(d["first"][lo], d["first"][hi]), d["first"][lo:hi] - d["first"][lo]


def _site_likelihoods(d: dict, params: HmmParams, calls: bool) -> np.ndarray:
    """(sites, 3): log P(all reads of a site | genotype), without the binomial coefficients."""
    g = np.arange(3) / 2
    c, e = (np.array([v[x] for x in d["libs"]], float)[:, None] for v in (params.cont, params.error))
    p = c * d["pc"][:, None] + (1 - c) * g
    p = p * (1 - e) + (1 - p) * e
    alt_ln, ref_ln = np.log(np.maximum(p, FLOOR)), np.log(np.maximum(1 - p, FLOOR))
    right, wrong = (np.log(np.where(x > 0, x, 1.0)) for x in (1 - 2 * e, e))
    out = np.empty((len(d["at"]), 3))
    for lo in range(0, len(out), CHUNK):
        hi = min(lo + CHUNK, len(out))
        r, first = _reads(d, lo, hi)
        u, alt, ref = d["u"][r], d["alt"][r, None], d["ref"][r, None]
        x = np.where(alt * 2 == (alt + ref) * np.arange(3), right[u], wrong[u]) if calls else alt * alt_ln[u] + ref * ref_ln[u]
        out[lo:hi] = np.add.reduceat(x, first, axis=0)
    return out


def forward_backward(p: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(alpha, beta, norm) as ``hmm.forward_backward`` on scaled emissions. The recursions run over √n blocks side by side:
    products of transitions inside blocks, then over blocks, then inside blocks from their known borders."""
    n, k = p.shape
    size = max(1, math.isqrt(n))
    blocks = n // size
    m = blocks * size
    alpha, beta, norm = np.empty((n, k)), np.ones((n, k)), np.empty(n)
    x, al, be, no = p[:m].reshape(blocks, size, k), alpha[:m].reshape(blocks, size, k), beta[:m].reshape(blocks, size, k), norm[:m].reshape(blocks, size)
    prod = np.broadcast_to(np.eye(k), (blocks, k, k))
    for i in range(size):
        prod = (prod @ trans) * x[:, i, None, :]
        prod = prod / prod.max(axis=(1, 2), keepdims=True)
    border = np.empty((blocks, k))
    a = np.asarray(start, float)
    for c in range(blocks):
        border[c] = a
        a = a @ prod[c]
        a = a / a.sum()
    a = border
    for i in range(size):
        a = (a @ trans) * x[:, i]
        no[:, i] = a.sum(axis=1)
        a = a / no[:, i, None]
        al[:, i] = a
    a = alpha[m - 1]
    for i in range(m, n):
        a = (a @ trans) * p[i]
        norm[i] = a.sum()
        a = a / norm[i]
        alpha[i] = a
    b = np.ones(k)
    for i in range(n - 1, m - 1, -1):
        b = trans @ (p[i] * b) / norm[i]
        beta[i - 1] = b
    ends = np.empty((blocks, k))
    for c in range(blocks - 1, -1, -1):
        ends[c] = b
        if c:
            b = prod[c] @ b
            b = b / (border[c] @ b)
    b = ends
    for i in range(size - 1, -1, -1):
        be[:, i] = b
        b = ((x[:, i] * b) @ trans.T) / no[:, i, None]
    return alpha, beta, norm


def _sequence(d: dict, space: StateSpace, params: HmmParams, haploid: bool, calls: bool, reads: bool, drift: bool) -> Iterator[tuple[str, str, float, float, list[float]]]:
    """Rows (kind, name, x, y, sums) of a sequence: log-likelihood and expected transitions; reads weighted by P(genotype) per library
    and contaminant frequency; P(homozygous state, genotype) per source and panel counts."""
    trans, start = (np.array(x, float) for x in ((params.trans_hap, params.start_hap) if haploid else (params.trans, params.start)))
    n, k, at, kind = d["n"], len(start), d["at"], d["kind"]
    gs, lik = _genotypes(d["kinds"], space, params, haploid)[:, :k], _site_likelihoods(d, params, calls)
    top = lik.max(axis=1, keepdims=True)
    lik = np.exp(lik - top)
    e = np.zeros((n, k))
    chunks = [slice(lo, lo + CHUNK) for lo in range(0, len(at), CHUNK)]
    for c in chunks:
        x = top[c] + np.log(np.fmax(np.einsum("sg,skg->sk", lik[c], gs[kind[c]]), FLOOR))
        for j in range(k):
            e[:, j] += np.bincount(at[c], x[:, j], n)
    shift = e.max(axis=1, keepdims=True)
    p = np.exp(e - shift)
    alpha, beta, norm = forward_backward(p, trans, start)
    xi = trans * (alpha[:-1].T @ (p[1:] * beta[1:] / norm[1:, None]))
    yield "hap" if haploid else "two", "", 0.0, 0.0, [float(np.log(norm).sum() + shift.sum()) + d["const"], *xi.ravel().tolist()]
    if not (reads or drift):
        return
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    by_read, by_kind = np.zeros((len(d["pc"]), 3, 2)), np.zeros((len(d["kinds"]), k, 3))
    for i, c in enumerate(chunks):
        w = lik[c, None, :] * gs[kind[c]]
        total = w.sum(axis=2, keepdims=True)
        pg = np.nan_to_num(gamma[at[c], :, None] * np.divide(w, total, out=np.zeros_like(w), where=total > 0))
        if drift:
            for s in range(k):
                for g in range(3):
                    by_kind[:, s, g] += np.bincount(kind[c], pg[:, s, g], len(by_kind))
        if reads:
            r, first = _reads(d, c.start, min(c.stop, len(at)))
            g3 = np.repeat(pg.sum(axis=1), np.diff(np.append(first, r.stop - r.start)), axis=0)
            for g in range(3):
                for z, count in enumerate((d["alt"], d["ref"])):
                    by_read[:, g, z] += np.bincount(d["u"][r], g3[:, g] * count[r], len(by_read))
    if reads:
        yield from (("reads", lib, float(pc), 0.0, v.ravel().tolist()) for lib, pc, v in zip(d["libs"], d["pc"], by_read))
    if drift and not haploid:
        for s, name in enumerate(space.sources):
            for j, pair in enumerate(space.pairs):
                if pair == (s, s):
                    ab, inv = np.unique(d["kinds"][:, 2 * s : 2 * s + 2], axis=0, return_inverse=True)
                    sums = np.zeros((len(ab), 3))
                    np.add.at(sums, inv.ravel(), by_kind[:, j])
                    yield from (("drift", name, float(a), float(b), v.tolist()) for (a, b), v in zip(ab, sums))


def em_sums(packed: DataFrame, space: StateSpace, params: HmmParams, keys: Sequence[str], haploid: Sequence[str], calls: bool, reads: bool, drift: bool) -> tuple[dict[str, np.ndarray], pd.DataFrame, pd.DataFrame]:
    """Sums over all sequences: {two, hap: (ll, expected transitions)}, and the frames that ``update_contamination`` and
    ``update_drift`` take. A task brings back its sums only."""
    hap = frozenset(haploid)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            chroms = batch["chrom"] if hap else [None] * len(batch)
            for chrom, x in zip(chroms, batch["x"]):
                for *key, v in _sequence(pickle.loads(x), space, params, chrom in hap, calls, reads, drift):
                    sums[tuple(key)] = sums.get(tuple(key), 0.0) + np.array(v)
        yield pd.DataFrame([(*key, v.tolist()) for key, v in sums.items()], columns=["kind", "name", "x", "y", "v"])

    rows = packed.mapInPandas(run, "kind string, name string, x double, y double, v array<double>").collect()
    sums: dict[tuple, np.ndarray] = {}
    for *key, v in rows:
        sums[tuple(key)] = sums.get(tuple(key), 0.0) + np.array(v)
    of = lambda kind: sorted((key[1:], v) for key, v in sums.items() if key[0] == kind)
    read_rows = [(lib, pc, g, v[2 * g], v[2 * g + 1]) for (lib, pc, _), v in of("reads") for g in range(3)]
    return (
        {key[0]: v for key, v in sums.items() if key[0] in ("two", "hap")},
        pd.DataFrame(read_rows, columns=["lib", "p_cont", "g", "alt", "ref"]),
        pd.DataFrame([(*key, *v) for key, v in of("drift")], columns=["source", "a", "b", "g0", "g1", "g2"]),
    )
