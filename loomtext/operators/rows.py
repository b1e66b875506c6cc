"""Rows from matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def explode_matches(df: DataFrame, text: str, pattern, flags=0, lists=None, *, ordinal: str = "ordinal", match: str = "match", **how) -> DataFrame:
    """One row for each match, in the order of the scan, with the columns of `df`, `ordinal` (from 0) and `match`."""
    return df.select(*df.columns, F.posexplode(C.matches(text, pattern, flags, lists, **how)).alias(ordinal, match))


def explode_splits(df: DataFrame, text: str, pattern, flags=0, lists=None, *, ordinal: str = "ordinal", piece: str = "piece", most: int = -1) -> DataFrame:
    """One row for each piece of split()."""
    return df.select(*df.columns, F.posexplode_outer(C.split(text, pattern, flags, lists, most=most)).alias(ordinal, piece))


def next_match(exploded: DataFrame, key: list[str], *, ordinal: str = "ordinal", match: str = "match", out: str = "next") -> DataFrame:
    """Beside each match of explode_matches() the one that follows in the same text."""
    return exploded.withColumn(out, F.lead(match).over(Window.partitionBy(*key).orderBy(ordinal)))
