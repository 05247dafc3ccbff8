"""Panels, read counts, maps, BED, FASTA and VCF as DataFrames."""

from __future__ import annotations

import io
import lzma
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.sites import first_per_key, merge_states
from strandline.plans.scan import running_sum

COUNTS = "chrom string, pos int, lib string, tref int, talt int, tdeam int, tother int"
COUNTS_V2 = "chrom string, pos int, tref int, talt int, lib string, len int, deam int, dmgsite int"
GENOTYPES = "chrom string, pos int, tref int, talt int"


def panel_schema(pops: Sequence[str]) -> str:
    return "chrom string, pos int, ref string, alt string, map double, " + ", ".join(f"{p}_{a} int" for p in pops for a in ("ref", "alt"))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A delimited table with header, columns matched by name: parquet, (compressed) csv, or csv.xz."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".xz"):
        return read_xz(spark, path, schema)
    names = [c.split()[0] for c in schema.split(",")]
    head = spark.read.option("header", True).csv(path)
    types = dict(c.split() for c in schema.split(","))
    return head.select(*[(F.col(n).cast(types[n]) if n in head.columns else F.lit(None).cast(types[n])).alias(n) for n in names])


def read_xz(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """csv.xz, which Spark has no codec for: one task per file, decompressed and parsed in chunks."""
    types = dict(c.split() for c in schema.split(","))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for blob in b["content"]:
                with lzma.open(io.BytesIO(blob)) as f:
                    for part in pd.read_csv(f, dtype={n: str for n, t in types.items() if t == "string"}, chunksize=100_000):
                        out = pd.DataFrame({n: part[n] if n in part else pd.Series([None] * len(part)) for n in types})
                        for n, t in types.items():
                            if t != "string":
                                out[n] = out[n].astype("float64" if t == "double" else "Int64")
                        yield out

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, schema)


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, value): lines of one text file with a number that rises along the file; parts of the file are read by many tasks.

    A line's number is the offset of its part plus its place in the task, which is below the part's length."""
    t = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return t.select((F.col("b") + F.col("i").bitwiseAND(F.lit((1 << 33) - 1))).alias("at"), "value")


def load_panel(spark: SparkSession, paths: Sequence[str], states: Mapping[str, Sequence[str]], autosomes: bool = False) -> DataFrame:
    """Panel files joined by site, see ``join_panels``."""
    pops = list(dict.fromkeys(p for v in states.values() for p in v))
    return join_panels([spark.read.parquet(p) if p.endswith(".parquet") else read_table(spark, p, panel_schema(pops)) for p in paths], states, autosomes)


def join_panels(panels: Sequence[DataFrame], states: Mapping[str, Sequence[str]], autosomes: bool = False) -> DataFrame:
    """Panels joined by site, the first one leading; the first one that has a population gives its counts. Populations
    are summed to states, missing counts are 0, sites without a map position are left out and each site counts once."""
    pops = list(dict.fromkeys(p for v in states.values() for p in v))
    key = ["chrom", "pos", "ref", "alt"]
    out, have = None, set()
    for head in panels:
        own = [p for p in pops if p not in have and f"{p}_ref" in head.columns]
        cols = [f"{p}_{a}" for p in own for a in ("ref", "alt")]
        part = first_per_key(head.select(*key, "map", *cols), key, ["map", *cols])
        have |= set(own)
        out = part.where(F.col("map").isNotNull()) if out is None else out.join(part.drop("map"), key, "left")
    for p in pops:
        if p not in have:
            out = out.withColumns({f"{p}_ref": F.lit(0), f"{p}_alt": F.lit(0)})
    out = merge_states(out, states, [*key, "map"])
    return out.where(~F.col("chrom").isin("X", "Y", "Z", "W")) if autosomes else out


def join_genotypes(streams: Mapping[str, DataFrame], keep: str = "outer") -> DataFrame:
    """(chrom, pos, {name}_ref, {name}_alt …): the counts of several files side by side, 0 where a file lacks a site; with
    keep='left' only sites of the first."""
    out = None
    for name, df in streams.items():
        one = df.groupBy("chrom", "pos").agg(F.sum("n_ref").alias(f"{name}_ref"), F.sum("n_alt").alias(f"{name}_alt"))
        out = one if out is None else out.join(one, ["chrom", "pos"], keep)
    return out.fillna(0, [c for c in out.columns if c not in ("chrom", "pos")]) if out is not None else out


def tagged_union(tables: Mapping[str, DataFrame], tag: str = "sample") -> DataFrame:
    """Tables of several samples below each other with their name, columns matched by name, absent ones null."""
    out = None
    for name, df in tables.items():
        one = df.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def subset_samples(vcf: DataFrame, samples: Sequence[str], chroms: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``parse_vcf`` of some samples, and chromosomes."""
    out = vcf.where(F.col("sample").isin(*samples))
    return out.where(F.col("chrom").isin(*chroms)) if chroms is not None else out


def panel_from_vcf(spark: SparkSession, path: str, pops: Mapping[str, Sequence[str]], chroms: Sequence[str] | None = None, pseudo_haploid: Sequence[str] = (), rec_file: str | None = None, map_id: str = "AA_Map", rate: float = 1e-8) -> DataFrame:
    """A panel (chrom, pos, ref, alt, map, counts per population) from VCF text; {CHROM} in a path stands for each chromosome.

    ``map`` is in cM: interpolated in the recombination maps ``rec_file``, or pos · rate · 100."""
    from strandline.operators.sites import interpolate_map

    named = [(c, path.replace("{CHROM}", c)) for c in chroms or []] if "{CHROM}" in path else [(None, path)]
    out = None
    for c, one in named:
        v = parse_vcf(spark.read.text(one), vcf_samples(spark, one))
        v = v.where(F.col("chrom").isin(*chroms)) if chroms else v
        p = vcf_panel(genotype_counts(v, pseudo_haploid), pops)
        out = p if out is None else out.unionByName(p)
    if rec_file is None:
        out = out.withColumn("map", F.col("pos") * rate * 100)
    else:
        knots = None
        for c in chroms or [""]:
            m = read_recombination_map(spark, rec_file.replace("{CHROM}", c), c, map_id)
            knots = m if knots is None else knots.unionByName(m)
        out = interpolate_map(out, knots, "pos", "pos", "map")
    return out.select("chrom", "pos", "ref", "alt", "map", *[f"{p}_{a}" for p in pops for a in ("ref", "alt")])


def load_counts(counts: DataFrame, split_lib: bool = True) -> DataFrame:
    """Read counts with a library (default 'lib0'), incomplete rows left out, summed over libraries unless ``split_lib``."""
    c = counts if "lib" in counts.columns else counts.withColumn("lib", F.lit("lib0"))
    c = c.where(F.col("chrom").isNotNull() & F.col("pos").isNotNull() & F.col("tref").isNotNull() & F.col("talt").isNotNull())
    c = c.withColumn("lib", F.coalesce("lib", F.lit("lib0")) if split_lib else F.lit("lib0"))
    return c.groupBy("chrom", "pos", "lib").agg(F.sum("tref").alias("tref"), F.sum("talt").alias("talt")).where("tref + talt > 0")


def read_recombination_map(spark: SparkSession, path: str, chrom: str, column: str) -> DataFrame:
    m = spark.read.option("header", True).option("sep", " ").option("inferSchema", False).csv(path)
    return m.select(F.lit(chrom).alias("chrom"), F.col("Physical_Pos").cast("int").alias("pos"), F.col(column).cast("double").alias("map"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    b = spark.read.option("sep", "\t").option("comment", "#").csv(path)
    return b.select(F.col("_c0").alias("chrom"), F.col("_c1").cast("int").alias("start"), F.col("_c2").cast("int").alias("end"))


def bed_positions(bed: DataFrame, chrom: str | None = None, start: int | None = None, end: int | None = None, max_snps: int | None = None) -> DataFrame:
    """Every 1-based position of half-open BED intervals, once, in genome order when limited (the limit is the feature)."""
    lo = F.greatest("start", F.lit(start - 1)) if start is not None else F.col("start")
    hi = F.least("end", F.lit(end)) if end is not None else F.col("end")
    b = (bed.where(F.col("chrom") == chrom) if chrom else bed).select("chrom", lo.alias("lo"), hi.alias("hi")).where("lo < hi")
    p = b.select("chrom", F.explode(F.sequence(F.col("lo") + 1, F.col("hi"))).alias("pos")).distinct()
    return p.orderBy("chrom", "pos").limit(max_snps) if max_snps is not None else p


FASTA_PIECE = 10_000


def read_fasta(spark: SparkSession, path: str, block: int = 1 << 20) -> DataFrame:
    """(chrom, pos, base) of every sequence. Lines get their sequence and place from blocked running sums, so a sequence may be of
    any length; lines that are long themselves are cut into pieces."""
    t = ordered_lines(spark, path).withColumn("value", F.regexp_replace("value", r"[\s]+$", ""))
    head = F.col("value").startswith(">")
    t = t.withColumns({"head": head.cast("int"), "n": F.when(head, 0).otherwise(F.length("value"))})
    t = running_sum(t, [], "at", "head", "seq", block, null_keys=False)
    names = t.where("head = 1").select("seq", F.regexp_extract("value", r"^>\s*(\S+)", 1).alias("chrom"))
    t = running_sum(t.where("head = 0 and n > 0"), ["seq"], "at", "n", "upto", block, null_keys=False)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / FASTA_PIECE)), lambda k: F.struct((k * FASTA_PIECE).alias("off"), F.substring("value", (k * FASTA_PIECE + 1).cast("int"), F.lit(FASTA_PIECE)).alias("s")))
    t = t.join(names, "seq").select("chrom", (F.col("upto") - F.col("n")).alias("before"), F.explode(pieces).alias("p"))
    return t.select("chrom", "before", "p.off", F.posexplode(F.split(F.upper("p.s"), "")).alias("i", "base")).where("base <> ''").select("chrom", (F.col("before") + F.col("off") + F.col("i") + 1).cast("int").alias("pos"), "base")


def parse_vcf(lines: DataFrame, samples: Sequence[str]) -> DataFrame:
    """(chrom, pos, ref, alt, alts, sample, gt): VCF text lines (column value) to one row per site and sample."""
    f = F.split("value", "\t")
    s = lines.where(~F.col("value").startswith("#")).select(f[0].alias("chrom"), f[1].cast("int").alias("pos"), F.upper(f[3]).alias("ref"), F.split(F.upper(f[4]), ",").alias("alts"), F.slice(f, 10, len(samples)).alias("g"))
    names = F.array(*[F.lit(x) for x in samples])
    e = s.select("chrom", "pos", "ref", "alts", F.explode(F.arrays_zip(names.alias("sample"), F.col("g").alias("field"))).alias("z"))
    return e.select("chrom", "pos", "ref", "alts", F.col("z.sample").alias("sample"), F.split(F.col("z.field"), ":")[0].alias("gt"))


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """Sample names of the header line."""
    r = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    return r[0].split("\t")[9:] if r else []


def _alleles(gt: Column) -> Column:
    return F.transform(F.filter(F.split(gt, r"[/|]"), lambda a: a != "."), lambda a: a.cast("int"))


def genotype_counts(vcf: DataFrame, pseudo_haploid: Sequence[str] = ()) -> DataFrame:
    """(chrom, pos, ref, alt, sample, n_ref, n_alt): single-base sites with one alternative allele seen.

    A site with several alternative alleles counts when only one of them occurs in any genotype. Samples of
    ``pseudo_haploid`` count one allele.
    """
    base = F.array(*[F.lit(b) for b in "ACGT"])
    v = vcf.where(F.array_contains(base, F.col("ref"))).withColumn("a", _alleles(F.col("gt")))
    seen = v.groupBy("chrom", "pos", "ref", "alts").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter("a", lambda x: x > 0))))).alias("seen"))
    one = seen.where(F.size("seen") == 1).withColumn("k", F.col("seen")[0]).withColumn("alt", F.element_at("alts", F.col("k")))
    one = one.where(F.array_contains(base, F.col("alt"))).select("chrom", "pos", "ref", "alts", "k", "alt")
    j = v.join(one, ["chrom", "pos", "ref", "alts"])
    a = F.when(F.col("sample").isin(list(pseudo_haploid)), F.slice("a", 1, 1)).otherwise(F.col("a")) if pseudo_haploid else F.col("a")
    return j.withColumn("a", a).select("chrom", "pos", "ref", "alt", "sample", F.size(F.filter("a", lambda x: x == 0)).alias("n_ref"), F.size(F.filter("a", lambda x: x > 0)).alias("n_alt"))


def vcf_panel(counts: DataFrame, pops: Mapping[str, Sequence[str]]) -> DataFrame:
    """Sample genotype counts to panel columns, one pass; a sample may belong to several populations."""
    aggs = [F.coalesce(F.sum(F.when(F.col("sample").isin(list(m)), F.col(f"n_{a}"))), F.lit(0)).alias(f"{p}_{a}") for p, m in pops.items() for a in ("ref", "alt")]
    return counts.groupBy("chrom", "pos", "ref", "alt").agg(*aggs)


def vcf_target(counts: DataFrame, sites: DataFrame, sample: str) -> DataFrame:
    """Genotype counts of one sample at panel sites: a semi join."""
    c = counts.where(F.col("sample") == sample).select("chrom", "pos", F.col("n_ref").alias("tref"), F.col("n_alt").alias("talt"))
    return c.join(sites.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")
