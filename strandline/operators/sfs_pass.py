"""The E-step of the SFS model in numpy: sites are packed in blocks once, a step is one job of one stage."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Mapping
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.likelihood import FLOOR
from strandline.plans.tables import materialise

if TYPE_CHECKING:
    from strandline.operators.sfs import SfsParams

BLOCK = 1 << 17  # rows of a block, on average
CLASS, GROUP = ["g0", "g1", "g2", "n", "ll"], ["c", "n", "err", "ok", "bias", "nobias"]


def _packed(t: pa.Table) -> bytes:
    """Arrays of a block: per kind of row (class, read group, psi, orientation, ploidy) its sums of reads; per row its kind and
    reads; per site its first row."""
    t = t.sort_by([("snp", "ascending"), ("sfs", "ascending")]).combine_chunks()
    rg = t["rg"].chunk(0).dictionary_encode()
    cols = [t["sfs"].to_numpy(), rg.indices.to_numpy(), t["psi"].to_numpy(), t["flipped"].to_numpy(), t["haploid"].to_numpy()]
    kinds, u = np.unique(np.column_stack([c.astype(float) for c in cols]), axis=0, return_inverse=True)
    u, ref, alt, names = u.ravel(), t["ref"].to_numpy(), t["alt"].to_numpy(), rg.dictionary.to_pylist()
    snp, sfs = t["snp"].to_numpy(), cols[0]
    first = np.flatnonzero(np.concatenate([[True], (snp[1:] != snp[:-1]) | (sfs[1:] != sfs[:-1])]))
    d = {"sfs": kinds[:, 0].astype(np.int64), "rg": [names[int(k)] for k in kinds[:, 1]], "psi": kinds[:, 2], "flipped": kinds[:, 3] > 0, "haploid": kinds[:, 4] > 0}
    d |= {"all_ref": np.bincount(u, ref, len(kinds)), "all_alt": np.bincount(u, alt, len(kinds))}
    return pickle.dumps(d | {"first": first, "u": u.astype(np.int32), "ref": ref.astype(np.int32), "alt": alt.astype(np.int32)}, protocol=5)


def pack(data: DataFrame) -> DataFrame:
    """(rep, x): the sites and reads of every replicate in blocks, in the checkpoint folder. A site lies in one block."""
    spark = data.sparkSession
    parts = max(1, -(-data.count() // BLOCK))
    to = {"rep": "string", "sfs": "long", "rg": "string", "psi": "double"}
    cols = [F.col(c).cast(k).alias(c) for c, k in to.items()] + [F.coalesce(c, F.lit(v)).cast(k).alias(c) for c, v, k in (("flipped", False, "boolean"), ("haploid", False, "boolean"), ("ref", 0, "long"), ("alt", 0, "long"))]
    rows = data.select("snp", *cols).withColumn("block", F.pmod(F.hash("rep", "snp", "sfs"), F.lit(parts)))

    def run(t: pa.Table) -> pa.Table:
        return t.select(["rep"]).slice(0, 1).append_column("x", pa.array([_packed(t)], pa.binary()))

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts)
    packed = rows.repartition(tasks, "rep", "block").groupBy("rep", "block").applyInArrow(run, "rep string, x binary")
    # few tasks a step, each of at most 16 blocks on average
    return materialise(packed.repartition(max(2 * spark.sparkContext.defaultParallelism, -(-parts // 16))))


def _params(d: dict, p: SfsParams) -> tuple[np.ndarray, ...]:
    """Per kind: contamination, P(genotype), and P(read | ancestral), P(read | derived) for a reference and an alternative read."""
    t, f = (np.array([v[k] for k in d["sfs"].tolist()], float) for v in (p.tau, p.f))
    c, hap = np.array([p.cont[g] for g in d["rg"]], float), d["haploid"]
    prior = np.stack([np.where(hap, 1 - t, f * (1 - t) + (1 - f) * (1 - t) ** 2), np.where(hap, 0.0, 2 * (1 - f) * t * (1 - t)), np.where(hap, t, f * t + (1 - f) * t * t)], axis=1)
    reads = []
    for from_ref, from_alt in ((1 - p.e, p.b), (p.e, 1 - p.b)):
        reads.append((np.where(d["flipped"], from_alt, from_ref), np.where(d["flipped"], from_ref, from_alt)))
    return c, prior, reads


def _class_sums(d: dict, p: SfsParams) -> Iterator[tuple[str, np.ndarray]]:
    c, prior, reads = _params(d, p)
    psi, logs = d["psi"], []
    for anc, der in reads:
        cont = c * ((1 - psi) * anc + psi * der)
        own = (anc, (anc + der) / 2, der)
        logs.append(np.log(np.fmax(np.stack([cont + (1 - c) * x for x in own], axis=1), FLOOR)))
    u, first = d["u"], d["first"]
    lik = np.add.reduceat(d["ref"][:, None] * logs[0][u] + d["alt"][:, None] * logs[1][u], first, axis=0)
    top = lik.max(axis=1, keepdims=True)
    w = np.exp(lik - top) * prior[u[first]]
    total = w.sum(axis=1)
    g = np.divide(w, total[:, None], out=np.zeros_like(w), where=total[:, None] > 0)
    ll = np.log(np.maximum(total, FLOOR)) + top[:, 0]
    classes, k = np.unique(d["sfs"][u[first]], return_inverse=True)
    sums = np.stack([np.bincount(k.ravel(), x, len(classes)) for x in (*g.T, np.ones(len(ll)), ll)], axis=1)
    yield from ((str(s), v) for s, v in zip(classes.tolist(), sums))


def _group_sums(d: dict, p: SfsParams) -> Iterator[tuple[str, np.ndarray]]:
    c, prior, reads = _params(d, p)
    psi, endo, flip = d["psi"], prior[:, 1] / 2 + prior[:, 2], d["flipped"]
    x = c * psi + (1 - c) * endo
    out, ratio = np.zeros((len(psi), len(GROUP))), lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=(b != 0) & (b == b))
    for alt, (anc, der) in enumerate(reads):
        n, zero = d["all_alt" if alt else "all_ref"], np.zeros(len(psi))
        cont, own = c * ((1 - psi) * anc + psi * der), (1 - c) * ((1 - endo) * anc + endo * der)
        both = (1 - x) * anc + x * der
        known = (both != 0) & (both == both)
        post = ratio(x * der, both)
        is_ref = np.where(flip, post, 1 - post) * known
        is_alt = (1 - is_ref) * known
        out += n[:, None] * np.stack([ratio(cont, cont + own), np.ones(len(n)), *((is_ref, zero, zero, is_alt) if alt else (zero, is_ref, is_alt, zero))], axis=1)
    at = {rg: i for i, rg in enumerate(dict.fromkeys(d["rg"]))}
    sums = np.zeros((len(at), len(GROUP)))
    np.add.at(sums, [at[rg] for rg in d["rg"]], out)
    yield from zip(at, sums)


def em_sums(packed: DataFrame, params: Mapping[str, SfsParams], reads: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Sums over all blocks of the replicates of ``params``: (rep, sfs, g0, g1, g2, n, ll), and (rep, rg, c, n, err, ok, bias, nobias)
    where ``reads``. A task brings back its sums only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for rep, x in zip(batch["rep"], batch["x"]):
                d = pickle.loads(x)
                for kind, f in (("class", _class_sums), ("group", _group_sums))[: 1 + reads]:
                    for key, v in f(d, params[rep]):
                        k = (rep, kind, key)
                        sums[k] = sums[k] + v if k in sums else v
        yield pd.DataFrame([(*k, v.tolist()) for k, v in sums.items()], columns=["rep", "kind", "key", "v"])

    parts: dict[tuple, list] = {}
    for rep, kind, key, v in packed.where(F.col("rep").isin(*params)).mapInPandas(run, "rep string, kind string, key string, v array<double>").collect():
        parts.setdefault((kind, rep, key), []).append(v)
    total = [(*k, *map(math.fsum, zip(*v))) for k, v in sorted(parts.items())]
    return (
        pd.DataFrame([(rep, int(key), *v) for kind, rep, key, *v in total if kind == "class"], columns=["rep", "sfs", *CLASS]),
        pd.DataFrame([(rep, key, *v) for kind, rep, key, *v in total if kind == "group"], columns=["rep", "rg", *GROUP]),
    )
