"""Mixing documents of several sources to target shares of the total size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.sizes import canon_source_name
from strandline.plans.tables import materialise

MAX_TARGETS = 10_000
HASH_CLASSES = 65_536


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone, equal in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_plan(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> list[tuple[str, str, float, int, int, float]]:
    """(mix, source, target share, max repeats, source tokens, rate) for every usable row of ``targets``.

    Rate is share · total / source tokens. Without ``total_tokens`` the total of a mix is the largest at which no
    source would exceed its cap, so that shares can be met; with it, rates stop at the caps. Sources without tokens
    get rate 0 and don't bound the total. ``targets`` is read on the driver, at most 10,000 rows; rows with a null, a share
    of 0 or less or a cap below 1 are left out. A source that a mix names twice, in whatever spelling, is an error.
    """
    rows = targets.select("mix_name", canon_source_name("source").alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap")).limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    rows = [r for r in rows if None not in tuple(r) and r["share"] > 0 and r["cap"] >= 1]
    if len({(r["mix_name"], r["source"]) for r in rows}) < len(rows):
        raise ValueError("a mix names a source twice")
    named = sorted({r["source"] for r in rows})
    have = {r[0]: r[1] for r in sizes.where(F.col("source").isin(named)).groupBy("source").agg(F.sum("tokens")).collect()} if named else {}
    plan = []
    for mix in sorted({r["mix_name"] for r in rows}):
        own = sorted((r for r in rows if r["mix_name"] == mix), key=lambda r: r["source"])
        total = total_tokens if total_tokens is not None else min((r["cap"] * have[r["source"]] / r["share"] for r in own if have.get(r["source"])), default=0.0)
        for r in own:
            n = have.get(r["source"], 0)
            plan.append((mix, r["source"], r["share"], r["cap"], n, min(float(r["cap"]), r["share"] * total / n) if n else 0.0))
    return plan


def document_sizes(documents: DataFrame, doc_id: str, tokens: Column, source: str) -> DataFrame:
    """(doc_id, source, tokens), lineage cut: the texts are read once. Null source or size: left out."""
    d = documents.select(F.col(doc_id).alias("doc_id"), canon_source_name(source).alias("source"), tokens.alias("tokens"))
    return materialise(d.where("doc_id is not null and source is not null and tokens is not null"))


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 0, total_tokens: float | None = None, calibrated: bool = False) -> DataFrame:
    """(mix_name, doc_id, source, copy, tokens): each document floor(rate) times, and once more with the fraction as probability.

    The extra copy is a Bernoulli draw: a hash of seed, mix and document is below the rate's fraction, so the result does
    not depend on partitions or retries. Each source's expected tokens are exactly its share; ``mix_shares`` reports the
    tokens it came to. Few or uneven documents may leave a source far from its share: ``calibrated`` then compares the same
    hash with a threshold at which the tokens drawn come closest to fraction · source tokens, found from token sums in
    65,536 hash classes per mix and source, never from a list of documents.

    The rate never exceeds max_repeats, nor do the copies. Rows of equal doc_id get the same draw. Empty
    documents or targets give an empty result. ``sizes`` comes from ``document_sizes``.
    """
    plan = mix_plan(sizes, targets, total_tokens)
    spark = sizes.sparkSession
    # at most MAX_TARGETS rows, checked in mix_plan
    rows = [(m, s, int(r), r - int(r), (r - int(r)) * n) for m, s, _, _, n, r in plan if r > 0]
    rates = F.broadcast(spark.createDataFrame(rows, "mix_name string, source string, whole int, fraction double, goal double"))
    each = sizes.join(rates, "source").withColumn("u", hash_uniform(F.lit(seed), F.col("mix_name"), F.col("doc_id")))
    drawn = F.col("u") < F.col("fraction")
    if calibrated:
        unit = F.floor(F.col("u") * HASH_CLASSES).cast("int")
        sums = each.groupBy("mix_name", "source", unit.alias("unit")).agg(F.sum("tokens").alias("t"), F.first("goal").alias("goal"))
        upto = F.sum("t").over(Window.partitionBy("mix_name", "source").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0))
        off = sums.withColumn("off", F.abs(upto - F.col("goal")))
        best = off.groupBy("mix_name", "source").agg(F.min(F.struct("off", "unit")).alias("b"), F.first("goal").alias("goal"))
        cut = best.select("mix_name", "source", F.when(F.col("b.off") < F.col("goal"), F.col("b.unit")).otherwise(-1).alias("cut"))
        each = each.join(F.broadcast(cut), ["mix_name", "source"])  # one row per plan row, so bounded as the plan is
        drawn = unit <= F.col("cut")
    each = each.withColumn("n", F.col("whole") + F.when(drawn, 1).otherwise(0)).where("n > 0")
    return each.select("mix_name", "doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "tokens")


def mix_shares(mixed: DataFrame, sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """(mix_name, source, target_share, rate, n_docs, tokens, actual_share) of a mix as it came out; 0 for sources without documents."""
    plan = mix_plan(sizes, targets, total_tokens)
    wanted = sizes.sparkSession.createDataFrame([(m, s, t, r) for m, s, t, _, _, r in plan], "mix_name string, source string, target_share double, rate double")
    got = mixed.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("tokens"))
    total = got.groupBy("mix_name").agg(F.sum("tokens").alias("all"))
    r = wanted.join(got, ["mix_name", "source"], "left").join(total, "mix_name", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return r.select("mix_name", "source", "target_share", "rate", zero("n_docs"), zero("tokens"), F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"))
