"""Sizes of documents in tokens and spelling of their sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.canon import canon_name


def byte_tokens(text: Column | str) -> Column:
    """Tokens of the byte-level tokenizer ByT5: one per UTF-8 byte and one end token; null for null."""
    return (F.octet_length(text) + F.lit(1)).cast("long")


def canon_source_name(col: Column | str) -> Column:
    """Document sources: case, outer blanks and '-' against '_' do not matter."""
    return F.translate(canon_name(col), "-", "_")
