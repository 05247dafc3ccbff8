"""Packed genotypes and BAM files through the Python data source API."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandline.plans.scan import running_count
from strandline.sources.text import ordered_lines

# Chromosome codes of the .snp file, base codes and operations of BAM.
CODES = {"23": "X", "24": "Y", "90": "mt"}
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"


def record_length(n_ind: int) -> int:
    return max(48, math.ceil(n_ind / 4))


class _Rows(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class GenoReader(DataSourceReader):
    """Splits the matrix by rows; each task reads its own range of records."""

    def __init__(self, options: dict) -> None:
        self.path, self.n_ind, self.n_snp = options["path"], int(options["n_ind"]), int(options["n_snp"])
        self.each = int(options.get("rows_per_task", "50000"))

    def partitions(self) -> list[InputPartition]:
        return [_Rows(a, min(self.n_snp, a + self.each)) for a in range(0, self.n_snp, self.each)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        size = record_length(self.n_ind)
        step = max(1, 200_000 // self.n_ind)
        with open(self.path, "rb") as f:
            for a in range(partition.first, partition.last, step):
                b = min(partition.last, a + step)
                f.seek(size * (a + 1))  # the header takes one record
                m = np.frombuffer(f.read(size * (b - a)), np.uint8).reshape(b - a, size)
                g = (m[:, :, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3  # first individual in the highest bits
                g = g.reshape(b - a, -1)[:, : self.n_ind]
                flat = g.ravel().astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(a, b, dtype=np.int64), self.n_ind)), pa.array(np.tile(np.arange(self.n_ind, dtype=np.int32), b - a)), pa.array(flat, mask=flat == 3)], names=["row", "ind", "n_ref"]
                )


class GenoSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandline_geno"

    def schema(self) -> str:
        return "row long, ind int, n_ref int"

    def reader(self, schema) -> DataSourceReader:
        return GenoReader(self.options)


def read_eigenstrat(spark: SparkSession, prefix: str) -> DataFrame:
    """(chrom, pos, ref, alt, map, sample, sex, pop, n_ref): packed genotypes with their sites and individuals; map in cM, missing genotypes null."""
    spark.dataSource.register(GenoSource)
    with open(f"{prefix}.geno", "rb") as f:
        kind, n_ind, n_snp = f.read(48).split(b"\0")[0].split()[:3]
    if kind != b"GENO":
        raise ValueError("not a packed genotype file")
    g = spark.read.format("strandline_geno").options(path=f"{prefix}.geno", n_ind=int(n_ind), n_snp=int(n_snp)).load()
    # a list of individuals is a row of the matrix long; the sites are numbered by a blocked count of their lines
    with open(f"{prefix}.ind") as f:
        ind = [(i, *x.split()[:3]) for i, x in enumerate(f) if x.strip()]
    inds = spark.createDataFrame(ind, "ind int, sample string, sex string, pop string")
    lines = running_count(ordered_lines(spark, f"{prefix}.snp").where(F.trim("value") != ""), [], "at", "n", 1 << 20, null_keys=False)
    x = F.split(F.trim("value"), r"\s+")
    code = F.create_map(*[F.lit(v) for kv in CODES.items() for v in kv])
    snps = lines.select((F.col("n") - 1).alias("row"), F.coalesce(F.element_at(code, x[1]), x[1]).alias("chrom"), x[3].cast("int").alias("pos"), x[4].alias("ref"), x[5].alias("alt"), (x[2].cast("double") * 100).alias("map"))
    return g.join(snps, "row").join(inds, "ind").drop("row", "ind")


def population_counts(gt: DataFrame) -> DataFrame:
    """(chrom, pos, ref, alt, map, pop, n_ref, n_alt): allele counts per population.

    A sample whose genotypes never exceed 1 is pseudo-haploid and counts one allele. Males count one X and one Y allele,
    females no Y; mt counts one.
    """
    ploidy = gt.groupBy("sample").agg(F.when(F.max("n_ref") > 1, 2).otherwise(1).alias("ploidy"))
    male = F.upper("sex") == "M"
    copies = F.when(F.col("chrom") == "mt", 1).when(F.col("chrom") == "Y", F.when(male, 1).otherwise(0)).when((F.col("chrom") == "X") & male, 1).otherwise(F.col("ploidy"))
    x = gt.join(ploidy, "sample").withColumn("n", F.when(F.col("n_ref").isNull(), 0).otherwise(copies))
    r = F.least(F.when((F.col("n") == 1) & (F.col("n_ref") == 2), 1).otherwise(F.coalesce("n_ref", F.lit(0))), F.col("n"))
    return x.withColumn("r", r).groupBy("chrom", "pos", "ref", "alt", "map", "pop").agg(F.sum("r").alias("n_ref"), F.sum(F.col("n") - F.col("r")).alias("n_alt"))


# ---------------------------------------------------------------------------------------------------------------


def bgzf(path: str) -> Iterator[bytes]:
    """Decompressed blocks of a BGZF file."""
    with open(path, "rb") as f:
        while head := f.read(18):
            extra = struct.unpack("<H", head[10:12])[0]
            field = head[12:] + f.read(extra - 6)
            size = next(struct.unpack("<H", field[i + 4 : i + 6])[0] for i in range(0, extra - 5) if field[i : i + 2] == b"BC")
            body = f.read(size - extra - 19)
            f.read(8)
            yield zlib.decompress(body, -15)


class _Stream:
    def __init__(self, path: str) -> None:
        self.blocks, self.buf = bgzf(path), b""

    def take(self, n: int) -> bytes:
        while len(self.buf) < n:
            part = next(self.blocks, None)
            if part is None:
                return b""
            self.buf += part
        out, self.buf = self.buf[:n], self.buf[n:]
        return out


def reference_from_md(seq: str, md: str) -> str:
    """Reference bases under a read of matches and mismatches only."""
    out, i = [], 0
    for n, base in re.findall(r"(\d+)|([A-Z])", md):
        if n:
            out.append(seq[i : i + int(n)])
            i += int(n)
        else:
            out.append(base)
            i += 1
    return "".join(out)


def bam_reads(path: str) -> Iterator[tuple]:
    """(chrom, start, end, reverse, mapq, cigar, seq, qual, rg, ref_seq) of the mapped reads; positions 1-based, closed."""
    s = _Stream(path)
    if s.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    s.take(struct.unpack("<i", s.take(4))[0])
    names = []
    for _ in range(struct.unpack("<i", s.take(4))[0]):
        n = struct.unpack("<i", s.take(4))[0]
        names.append(s.take(n)[:-1].decode())
        s.take(4)
    while size := s.take(4):
        r = s.take(struct.unpack("<i", size)[0])
        ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack("<iiBBHHHi", r[:20])
        at = 32 + l_name
        cigar = [(c >> 4, OPS[c & 15]) for c in struct.unpack(f"<{n_cigar}I", r[at : at + 4 * n_cigar])]
        at += 4 * n_cigar
        packed = r[at : at + (l_seq + 1) // 2]
        seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq]
        at += (l_seq + 1) // 2
        qual = [*r[at : at + l_seq]]
        tags, at = {}, at + l_seq
        while at < len(r):
            tag, kind = r[at : at + 2].decode(), chr(r[at + 2])
            at += 3
            if kind in "ZH":
                end = r.index(0, at)
                tags[tag], at = r[at:end].decode(), end + 1
            elif kind == "B":
                at += 5 + struct.unpack("<i", r[at + 1 : at + 5])[0] * {"c": 1, "C": 1, "s": 2, "S": 2}.get(chr(r[at]), 4)
            else:
                at += {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2}.get(kind, 4)
        if ref < 0 or flag & 4:
            continue
        span = sum(n for n, o in cigar if o in "MDN=X")
        plain = all(o in "M=X" for _, o in cigar)
        yield names[ref], pos + 1, pos + span, bool(flag & 16), mapq, "".join(f"{n}{o}" for n, o in cigar), seq, qual, tags.get("RG"), reference_from_md(seq, tags["MD"]) if plain and "MD" in tags else None


class BamReader(DataSourceReader):
    """One task per file: a BGZF stream without index can't be entered in the middle."""

    def __init__(self, options: dict) -> None:
        self.paths = options["path"].split(",")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return bam_reads(partition.value)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandline_bam"

    def schema(self) -> str:
        return "chrom string, start int, end int, reverse boolean, mapq int, cigar string, seq string, qual array<int>, rg string, ref_seq string"

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options)


def read_bam(spark: SparkSession, *paths: str) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("strandline_bam").option("path", ",".join(paths)).load()


def pileup(reads: DataFrame, sites: DataFrame, bucket: int = 500, drop_prefix: str = "Phi", keep_sites: bool = False) -> DataFrame:
    """(chrom, pos, ref, alt, rg, base, bq, mq, len, pos_in_read, reverse, deam): plain reads over sites, by a bucketed range join.

    Reads with insertions, deletions, gaps or clipping and bases other than ACGT are left out; read groups lose what follows
    a '-', and groups named with ``drop_prefix`` are dropped. ``deam`` is the distance of the first damaged base from the
    nearer end, or -1. With ``keep_sites`` a site without reads keeps a row.
    """
    from strandline.operators.panelstats import damage_position
    from strandline.operators.tracts import overlap_join

    rg = F.split(F.coalesce("rg", F.lit("NONE")), "-")[0]
    five = damage_position(F.col("seq"), F.coalesce("ref_seq", F.col("seq")), F.col("reverse"))
    plain = reads.where(~F.col("cigar").rlike("[IDNSHP]")).withColumn("rg", rg).where(~F.col("rg").startswith(drop_prefix)).withColumn("deam", five)
    s = sites.select("chrom", F.col("pos").alias("r_start"), F.col("pos").alias("r_end"), "ref", "alt")
    j = overlap_join(plain, s, ["chrom"], bucket)
    off = (F.col("r_start") - F.col("start") + 1).cast("int")
    out = j.select("chrom", F.col("r_start").alias("pos"), "ref", "alt", "rg", F.substring("seq", off, F.lit(1)).alias("base"), F.element_at("qual", off).alias("bq"), F.col("mapq").alias("mq"), F.length("seq").alias("len"), (off - 1).alias("pos_in_read"), "reverse", "deam")
    out = out.where(F.col("base").isin("A", "C", "G", "T"))
    return sites.select("chrom", "pos", "ref", "alt").join(out, ["chrom", "pos", "ref", "alt"], "left") if keep_sites else out


def pileup_counts(piles: DataFrame, cutoff: int = 3, length_bin: int | None = None) -> DataFrame:
    """Read counts per site and group: tref, talt, tdeam (explained by damage) and tother."""
    from strandline.operators.panelstats import damage_class, explained_by_damage

    lib = [F.col("rg")] + ([F.floor(F.col("len") / length_bin).cast("string")] if length_bin else []) + [damage_class(F.col("deam"), cutoff)]
    dmg = explained_by_damage(F.col("base"), F.col("ref"), F.col("alt"), F.col("reverse"))
    n = lambda c: F.count(F.when(c, 1))
    is_ref, is_alt = F.col("base") == F.col("ref"), F.col("base") == F.col("alt")
    return piles.groupBy("chrom", "pos", F.concat_ws("_", *lib).alias("lib")).agg(n(is_ref).alias("tref"), n(is_alt).alias("talt"), n(dmg).alias("tdeam"), n(~is_ref & ~is_alt).alias("tother"))


def pileup_counts_exact(piles: DataFrame) -> DataFrame:
    """Read counts per site, group, length, damage position (-1 for none) and damage site: chrom, pos, tref, talt, lib, len, deam, dmgsite."""
    from strandline.operators.panelstats import explained_by_damage

    is_ref, is_alt = F.col("base") == F.col("ref"), F.col("base") == F.col("alt")
    dmg = explained_by_damage(F.col("base"), F.col("ref"), F.col("alt"), F.col("reverse")).cast("int")
    n = lambda c: F.count(F.when(c, 1))
    g = piles.where(is_ref | is_alt).groupBy("chrom", "pos", F.col("rg").alias("lib"), "len", "deam", dmg.alias("dmgsite"))
    return g.agg(n(is_ref).alias("tref"), n(is_alt).alias("talt")).select("chrom", "pos", "tref", "talt", "lib", "len", "deam", "dmgsite")
