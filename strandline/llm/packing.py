"""Packing items of varying length into containers of fixed capacity."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.plans.tables import materialise

CLASSES = 96
DEPTH = 3
#: Ranks of one length are counted in at least so many parts, and in more from SALT_ROWS rows a part on.
SALTS = 64
SALT_ROWS = 1 << 18
#: A capacity is planned in at most so many units; lengths are rounded up to whole ones.
UNITS = 1 << 20
#: Weight of a class in the least squares: its share of the capacity, but at least this.
LEAST_WEIGHT = 0.02
#: Shares of the solution that are carried out, the rest of the items being packed greedily; tried in this order.
SHARES = (1.0, 0.5, 0.2, 0.05, 0.02)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """min ||a x − b|| with x ≥ 0, by active sets on the normal equations."""
    ata, atb = a.T @ a, a.T @ b
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(atb).max(initial=0.0)))
    for _ in range(rounds):
        grad = atb - ata @ x
        grad[free] = -np.inf
        j = int(np.argmax(grad))
        if grad[j] <= tol:
            break
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            s = np.linalg.lstsq(ata[np.ix_(at, at)], atb[at], rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            gone = at[(x[at] <= 1e-12)]
            x[gone], free[gone] = 0, False
            if not free.any():
                break
    return x


def strategies(classes: int, depth: int) -> list[tuple[int, ...]]:
    """Combinations of up to ``depth`` classes, in falling order, that fill a window of ``classes`` units exactly."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < depth:
            for k in range(min(left, head[-1] if head else classes), 0, -1):
                if k * (depth - len(head)) >= left:
                    grow((*head, k), left - k)

    grow((), classes)
    return out


class Pool:
    """Open containers, grouped by pattern: groups[room left] = [(pattern, number of containers)]."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.rooms, self.groups = capacity, [], {}

    def add(self, room: int, pattern: tuple, count: int) -> None:
        if room not in self.groups:
            self.groups[room] = []
            insort(self.rooms, room)
        self.groups[room].append((pattern, count))

    def containers(self) -> int:
        return sum(m for g in self.groups.values() for _, m in g)

    def pop(self, at: int) -> tuple[int, tuple, int]:
        room = self.rooms[at]
        pattern, count = self.groups[room].pop()
        if not self.groups[room]:
            del self.groups[room], self.rooms[at]
        return room, pattern, count

    def place(self, length: int, count: int) -> None:
        """Best fit of ``count`` items of one length, whole groups of equal containers at a time."""
        while count:
            at = bisect_left(self.rooms, length)
            room, pattern, m = self.pop(at) if at < len(self.rooms) else (self.capacity, None, -(-count // (self.capacity // length)))
            q = room // length
            full = min(m, count // q)
            if full:
                self.add(room - q * length, (pattern, length, q), full)
                m, count = m - full, count - full * q
            if m and 0 < count < q:
                self.add(room - count * length, (pattern, length, count), 1)
                m, count = m - 1, 0
            if m and pattern is not None:
                self.add(room, pattern, m)


def _fill(queue: dict[int, list[int]], hist: dict[int, int], left: list[int], combo: tuple[int, ...], capacity: int) -> dict[int, int]:
    """Length -> items to take for one container of ``combo``; empty if a class runs out.

    The longest of each class go first; the last member is the longest length that still fits, which makes up for the
    rounding of the classes.
    """
    mult: dict[int, int] = {}
    for k, need in Counter(combo[:-1]).items():
        for n in reversed(queue[k]):
            take = min(need, hist[n])
            if take:
                mult[n], need = take, need - take
            if not need:
                break
        if need:
            return {}
    room = capacity - sum(n * q for n, q in mult.items())
    for at in range(bisect_right(left, room) - 1, -1, -1):
        n = left[at]
        if hist[n] > mult.get(n, 0):
            mult[n] = mult.get(n, 0) + 1
            return mult
    return {}


def plan_packing(lengths: np.ndarray, counts: np.ndarray, capacity: int, classes: int = CLASSES, depth: int = DEPTH) -> tuple[np.ndarray, int]:
    """Slots (length, first rank, first container, items per container), sorted, and the number of containers.

    Lengths (1 … capacity) are classed in ``classes`` units, rounded up, so that a combination that fills the window
    in units fits it in tokens. Non-negative least squares gives the repeats of the combinations that best explain
    the class histogram; they are rounded and carried out on real lengths, longest first, as long as their classes last.
    What is left, and the room left in those containers, goes to best fit. Short items weigh less in the least squares, as
    they fill any rest. Where the greedy part lacks short items for its rest, carrying out less of the solution leaves it
    more of them: a few shares (``SHARES``) are tried, and the plan of fewest containers counts.
    """
    hist: dict[int, int] = {}
    for n, c in zip(np.asarray(lengths).tolist(), np.asarray(counts).tolist()):
        if c:
            hist[n] = hist.get(n, 0) + c
    classes = min(classes, capacity)
    unit = -(-capacity // classes)
    classes = capacity // unit
    own, x = _solve(hist, unit, classes, strategies(classes, depth))
    best = None
    for share in SHARES if own else SHARES[:1]:
        pool = _carry_out(dict(hist), capacity, unit, own, np.floor(x * share + 0.5).astype(np.int64))
        if best is None or pool.containers() < best.containers():
            best = pool
    return _slots(best)


def _solve(hist: dict[int, int], unit: int, classes: int, combos: list[tuple[int, ...]]) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """The combinations of classes that occur, and the repeats of each."""
    b = np.zeros(classes + 1)
    for n, c in hist.items():
        if -(-n // unit) <= classes:
            b[-(-n // unit)] += c
    own = [c for c in combos if all(b[k] > 0 for k in c)]
    a = np.zeros((classes + 1, len(own)))
    for j, c in enumerate(own):
        for k in c:
            a[k, j] += 1
    weight = np.maximum(np.arange(classes + 1) / classes, LEAST_WEIGHT)
    return own, nnls(a * weight[:, None], b * weight) if own else np.zeros(0)


def _carry_out(hist: dict[int, int], capacity: int, unit: int, combos: list[tuple[int, ...]], repeats: np.ndarray) -> Pool:
    pool = Pool(capacity)
    left = sorted(hist)
    queue: dict[int, list[int]] = {}
    for n in left:  # rising, so the longest of a class is popped first
        queue.setdefault(-(-n // unit), []).append(n)
    for j in np.argsort(-repeats, kind="stable"):
        need = int(repeats[j])
        while need and (mult := _fill(queue, hist, left, combos[j], capacity)):
            times = min([need, *(hist[n] // q for n, q in mult.items())])
            pattern = None
            for n, q in mult.items():
                pattern = (pattern, n, q)
                hist[n] -= q * times
                if not hist[n]:
                    del left[bisect_left(left, n)]
                    queue[-(-n // unit)].remove(n)
            pool.add(capacity - sum(n * q for n, q in mult.items()), pattern, times)
            need -= times
    for n in reversed(left):
        pool.place(n, hist[n])
    return pool


def _slots(pool: Pool) -> tuple[np.ndarray, int]:
    rows, base = [], 0
    for room in pool.rooms:
        for pattern, m in pool.groups[room]:
            p = pattern
            while p is not None:
                p, n, q = p
                rows.append((n, q, base, m))
            base += m
    slots = np.array(rows, np.int64).reshape(-1, 4)
    slots = slots[np.lexsort((slots[:, 2], slots[:, 0]))]
    size = slots[:, 1] * slots[:, 3]
    end = np.cumsum(size)
    first = end - size
    starts_length = np.r_[True, slots[1:, 0] != slots[:-1, 0]] if len(slots) else np.zeros(0, bool)
    first -= np.maximum.accumulate(np.where(starts_length, first, 0)) if len(slots) else 0
    return np.column_stack([slots[:, 0], first, slots[:, 2], slots[:, 1]]), base


def pack(items: DataFrame, spec: DataFrame, item_id: str, tokens: str, name: str = "pack_name", capacity: str = "capacity_tokens", salts: int | None = None) -> DataFrame:
    """(pack name, item id, part, n_parts, first_token, tokens, container): every item in every pack of ``spec``.

    An item longer than the capacity is cut into full containers and a rest; no other is split. Items with null or
    non-positive size are left out; equal ids are items of their own. ``spec`` is read on the driver (it lists
    tasks, at most 1,000); a row of it with a null name or capacity is left out, a capacity below 1 or a repeated name is an
    error.

    Only the histogram of lengths reaches the driver. A capacity above 1,048,576 tokens is planned in that many units, lengths
    rounded up, so the plan is bounded whatever the capacities and items. Ranks of items of one length are counted in parts
    whose number grows with the rows, so a length that a third of all items share is spread over tasks. An empty table gives
    an empty result.
    """
    rows = spec.select(F.col(name).cast("string"), F.col(capacity).cast("long")).distinct().limit(1001).collect()
    caps = sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None)
    if any(c < 1 for _, c in caps):
        raise ValueError("capacities must be at least 1")
    if len(rows) > 1000 or len({n for n, _ in caps}) < len(caps):
        raise ValueError("pack names must be unique and at most 1,000")
    schema = f"{name} string, {item_id} {items.schema[item_id].dataType.simpleString()}, part int, n_parts int, first_token long, tokens long, container long"
    if not caps:
        return items.sparkSession.createDataFrame([], schema)
    step = {n: -(-c // UNITS) for n, c in caps}
    tasks = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c).cast("long").alias("c"), F.lit(step[n]).cast("long").alias("s")) for n, c in caps])
    sized = items.select(F.col(item_id).alias("id"), F.col(tokens).cast("long").alias("size")).where("size > 0")
    each = sized.select("id", "size", F.explode(tasks).alias("t")).select("id", "size", F.col("t.n").alias("pack"), F.col("t.c").alias("cap"), F.col("t.s").alias("step"))
    each = each.withColumn("n_parts", F.expr("cast((size + cap - 1) div cap as int)"))
    parts = each.select("*", F.explode(F.sequence(F.lit(1), F.col("n_parts"))).alias("part")).select(
        "pack", "id", "part", "n_parts", ((F.col("part") - 1) * F.col("cap")).alias("first_token"), F.least("cap", F.col("size") - (F.col("part") - 1) * F.col("cap")).alias("tokens"), "step", "cap"
    )
    # in units of the plan; what is longer than the last whole one fills a container alone
    parts = materialise(parts.withColumn("units", F.expr("least((tokens + step - 1) div step, cap div step)")).drop("step", "cap"))
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("id", "part"), F.lit(salts or max(SALTS, parts.count() // SALT_ROWS))).cast("int"))
    spark = items.sparkSession
    counts = materialise(parts.groupBy("pack", "units", "salt").agg(F.count(F.lit(1)).alias("n")))
    hist = counts.groupBy("pack", "units").agg(F.sum("n").alias("n")).toPandas()
    plans = {}
    for n, c in caps:
        h = hist[hist["pack"] == n]
        slots, _ = plan_packing(h["units"].to_numpy(np.int64), h["n"].to_numpy(np.int64), c // step[n])
        plans[n] = (slots[:, 0] << 40 | slots[:, 1], slots[:, 1], slots[:, 2], slots[:, 3])
    shared = spark.sparkContext.broadcast(plans)  # bounded by UNITS lengths a pack and their patterns
    before = Window.partitionBy("pack", "units").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pack", "units", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("pack", "units", "salt").orderBy("id", "part")
    ranked = parts.withColumn("rn", F.row_number().over(own)).join(offsets, ["pack", "units", "salt"]).withColumn("rank", F.col("offset") + F.col("rn") - 1)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.empty(len(b), np.int64)
            for n, at in b.groupby("pack", sort=False).indices.items():
                keys, first, base, q = shared.value[n]
                rank = b["rank"].to_numpy()[at]
                slot = np.searchsorted(keys, b["units"].to_numpy()[at] << 40 | rank, side="right") - 1
                out[at] = base[slot] + (rank - first[slot]) // q[slot]
            yield b.assign(container=out)[["pack", "id", "part", "n_parts", "first_token", "tokens", "container"]].rename(columns={"pack": name, "id": item_id})

    return ranked.select("pack", "id", "part", "n_parts", "first_token", "tokens", "units", "rank").mapInPandas(assign, schema)
