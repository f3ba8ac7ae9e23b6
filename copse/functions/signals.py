"""Four test signals on [0, 1], and noisy samples of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import numbered

#: Where the bumps and blocks stand, how high they are, and how wide the bumps.
PLACES = [0.1, 0.13, 0.15, 0.23, 0.25, 0.40, 0.44, 0.65, 0.76, 0.78, 0.81]
BUMPS = [4.0, 5.0, 3.0, 4.0, 5.0, 4.2, 2.1, 4.3, 3.1, 5.1, 4.2]
WIDTHS = [0.005, 0.005, 0.006, 0.01, 0.01, 0.03, 0.01, 0.01, 0.005, 0.008, 0.005]
BLOCKS = [4.0, -5.0, 3.0, -4.0, 5.0, -4.2, 2.1, 4.3, -3.1, 2.1, -4.2]


def heavisine(x: Column) -> Column:
    return 4 * F.sin(4 * math.pi * x) - F.signum(x - 0.3) - F.signum(0.72 - x)


def bumps(x: Column) -> Column:
    return sum((h * F.pow(1 + F.abs((x - t) / w), F.lit(-4.0)) for t, h, w in zip(PLACES, BUMPS, WIDTHS, strict=True)), F.lit(0.0))


def blocks(x: Column) -> Column:
    return sum((h * (1 + F.signum(x - t)) / 2 for t, h in zip(PLACES, BLOCKS, strict=True)), F.lit(0.0))


def doppler(x: Column) -> Column:
    return F.sqrt(x * (1 - x)) * F.sin(2.1 * math.pi / (x + 0.05))


SIGNALS = {"heavisine": heavisine, "bumps": bumps, "blocks": blocks, "doppler": doppler}


def rescaled(df: DataFrame, column: str, to: str) -> DataFrame:
    """column brought to [0, 1] by its least and largest values; 0 for a constant."""
    ends = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    span = F.col("_high") - F.col("_low")
    return df.crossJoin(F.broadcast(ends)).withColumn(to, F.when(span > 0, (F.col(column) - F.col("_low")) / span).otherwise(0.0)).drop("_low", "_high")


def make_regression(spark: SparkSession, n: int, signal: str = "heavisine", noise: float = 0.1, seed: int = 0) -> DataFrame:
    """(row_id, x, y): x even at random and ascending by row_id, y the rescaled signal with Gaussian noise."""
    df = spark.range(n).select(F.rand(seed).alias("x"), F.randn(seed + 1).alias("e"))
    got = rescaled(df.withColumn("s", SIGNALS[signal](F.col("x"))), "s", "s")
    return numbered(got, ["x"]).select("row_id", "x", (F.col("s") + noise * F.col("e")).alias("y"))
