"""Bit-packed columns: how many bits a bin code takes, and codes packed into 64-bit words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layout(largest: int) -> tuple[int, int]:
    """Bits for a code up to `largest`, and codes in a word."""
    bits = max(1, int(largest).bit_length())
    return bits, 64 // bits


def pack(df: DataFrame, index: str, code: str, largest: int) -> DataFrame:
    """A row (word_id, word) for each 64-bit word; the code of index 0 stands in the lowest bits."""
    bits, each = layout(largest)
    return df.groupBy(F.floor(F.col(index) / each).cast("long").alias("word_id")).agg(F.expr(f"bit_or(shiftleft(cast(`{code}` as bigint), cast(`{index}` % {each} as int) * {bits}))").alias("word"))


def unpack(words: DataFrame, largest: int, n: int) -> DataFrame:
    """The codes back again: (index, code) for index < n."""
    bits, each = layout(largest)
    spots = words.select("word_id", "word", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("at"))
    return spots.select(
        (F.col("word_id") * each + F.col("at")).alias("index"),
        F.expr(f"shiftrightunsigned(word, at * {bits}) & {(1 << bits) - 1 if bits < 64 else -1}").cast("int").alias("code"),
    ).where(F.col("index") < n)


def get(words: DataFrame, index: int, largest: int) -> DataFrame:
    """The code of one index."""
    bits, each = layout(largest)
    return words.where(F.col("word_id") == index // each).select(F.expr(f"shiftrightunsigned(word, {index % each * bits}) & {(1 << bits) - 1 if bits < 64 else -1}").cast("int").alias("code"))
