"""Deterministic draws: the same on any partitioning and in any SQL engine with md5."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*keys: Column | str | int) -> Column:
    """A whole number in [0, 2^32) from keys; text and numbers are literals if
    given as such, names of columns must be Columns."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
