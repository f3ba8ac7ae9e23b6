"""Random choices from hashes: the same on every engine, machine and rerun."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash48(*parts: Column | int | str) -> Column:
    """48 bits of the md5 of the parts joined by |, as a long."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(c.cast("string") for c in cols)).cast("binary")), 1, 12), 16, 10).cast("long")


def unit(*parts: Column | int | str) -> Column:
    """A number in [0, 1)."""
    return hash48(*parts) / F.lit(float(1 << 48))


#: The same in DuckDB; {} stands for the text of the parts.
SQL_HASH48 = "CAST('0x' || substr(md5({}), 1, 12) AS BIGINT)"
