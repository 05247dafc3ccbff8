"""Canonical spellings, as Column expressions that stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source populations whose names make up a state label.
SOURCES = ("AFR", "NEA", "DEN")

WHITE = " \t\r\n"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def canon_chrom(col: Column | str) -> Column:
    """'chr01', ' 1', 'CHR1 ' -> '1'; '23', 'x', 'chrX' -> 'X'. Null and blank give null."""
    up = F.upper(F.trim(_c(col), F.lit(WHITE)))
    bare = F.ltrim(F.when(up.startswith("CHR"), F.substring(up, 4, 1 << 30)).otherwise(up), F.lit("0"))
    return F.when(bare == "", None).when(bare == "23", "X").otherwise(bare)


def chrom_rank(col: Column | str) -> Column:
    """Rank of a canonical chromosome in the order 1 … 22, X, Y, mt; null sorts last."""
    c = _c(col)
    return F.when(c == "X", 23).when(c == "Y", 24).when(F.lower(c).isin("mt", "m"), 25).otherwise(c.try_cast("int"))


def canon_sources(col: Column | str) -> Column:
    """The set of sources a state label names, as one string ('AFRNEA'); null where it names none."""
    up = F.upper(_c(col))
    named = F.concat_ws("", *[F.when(up.contains(s), s) for s in SOURCES])
    return F.when(named == "", None).otherwise(named)


def canon_name(col: Column | str) -> Column:
    """Lower case without outer blanks; blank gives null. For case-insensitive names."""
    t = F.lower(F.trim(_c(col), F.lit(WHITE)))
    return F.when(t == "", None).otherwise(t)


def genetic_position(col: Column | str) -> Column:
    """The value where it can be a genetic position (finite, from 0 to below 400 cM), else null."""
    v = _c(col)
    return F.when(~F.isnan(v) & (v >= 0) & (v < 400), v)
