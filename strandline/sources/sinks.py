"""Tables and VCF text from results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.canon import chrom_rank


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """One directory of gzip csv with header, or parquet."""
    w = df.write.mode("overwrite")
    w.parquet(path) if fmt == "parquet" else w.option("header", True).option("compression", "gzip").csv(path)


def vcf_header(samples: Sequence[str], chroms: Sequence[str] = ()) -> list[str]:
    lines = ["##fileformat=VCFv4.2", '##INFO=<ID=AA,Number=1,Type=String,Description="Ancestral allele">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=GL,Number=G,Type=Float,Description="log10 likelihoods">', '##FORMAT=<ID=GP,Number=G,Type=Float,Description="posterior probabilities">', '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Reads">']
    lines += [f"##contig=<ID={c}>" for c in chroms]
    return [*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def genotype_text(g: Sequence[Column]) -> Column:
    """Most likely genotype as 0/0, 0/1 or 1/1; ties go to fewer alternative alleles."""
    return F.when((g[0] >= g[1]) & (g[0] >= g[2]), "0/0").when(g[1] >= g[2], "0/1").otherwise("1/1")


def vcf_lines(df: DataFrame) -> DataFrame:
    """One VCF line (column value) per site from chrom, pos, ref, alt, aa, l0…l2 (log10), g0…g2 and depth; rank and at order them."""
    g = [F.col(f"g{i}") for i in range(3)]
    four = lambda *c: F.concat_ws(",", *[F.call_function("format_number", x, F.lit("0.####")) for x in c])
    sample = F.concat_ws(":", genotype_text(g), four(*[F.col(f"l{i}") for i in range(3)]), four(*g), F.col("depth").cast("string"))
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), F.concat(F.lit("AA="), F.coalesce("aa", F.lit("."))), F.lit("GT:GL:GP:DP"), sample)
    return df.select(line.alias("value"), F.coalesce(chrom_rank("chrom"), F.lit(99)).alias("rank"), F.col("pos").cast("long").alias("at"))


def write_vcf(df: DataFrame, path: str, samples: Sequence[str], chroms: Sequence[str] = ()) -> None:
    """Text parts that make up one VCF in the order of their names: header, then lines by chromosome and position.

    The order is a range partitioning, so no task gets all lines.
    """
    head = df.sparkSession.createDataFrame([(x, -1, i) for i, x in enumerate(vcf_header(samples, chroms))], "value string, rank int, at long")
    head.unionByName(vcf_lines(df)).orderBy("rank", "at", "value").select("value").write.mode("overwrite").text(path)


def params_yaml(params: dict) -> str:
    import yaml

    return yaml.safe_dump(params, sort_keys=False)


def interval(estimate: Column, se: Column) -> tuple[Column, Column]:
    """95 % interval clipped to [0, 1]."""
    return F.greatest(estimate - 1.96 * se, F.lit(0.0)), F.least(estimate + 1.96 * se, F.lit(1.0))
