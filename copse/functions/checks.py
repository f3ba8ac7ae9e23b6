"""Checks of arguments and of column types."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = (T.StringType, T.BooleanType)
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def whole(name: str, value: object, least: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} should be an integer of at least {least}; got {value!r}")
    return value


def real(name: str, value: object, least: float, strict: bool = False) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or math.isnan(value) or value < least or strict and value == least:
        raise ValueError(f"{name} should be a number {'over' if strict else 'of at least'} {least}; got {value!r}")
    return float(value)


def choice(name: str, value: object, among: Sequence[object]) -> object:
    if value not in among:
        raise ValueError(f"{name} should be one of {list(among)}; got {value!r}")
    return value


def features_of(df: DataFrame, names: Sequence[str] | None = None) -> list[str]:
    """The feature columns, all of which have a type that can be used."""
    names = list(df.columns if names is None else names)
    for c in names:
        if c not in df.columns:
            raise ValueError(f"There is no column {c!r}")
        if not isinstance(df.schema[c].dataType, NAMES + NUMBERS):
            raise ValueError(f"Column {c!r} has type {df.schema[c].dataType.simpleString()}, which can't be a feature")
    if not names:
        raise ValueError("At least one feature is needed")
    return names


def categorical_mask(given: Sequence[object] | None, names: Sequence[str]) -> list[bool] | None:
    """A flag for each feature, from flags, positions or names; None or nothing: to be inferred."""
    if given is None or not len(given):
        return None
    if all(isinstance(x, bool) for x in given):
        if len(given) != len(names):
            raise ValueError(f"is_categorical has {len(given)} flags for {len(names)} features")
        return list(given)
    if all(isinstance(x, str) for x in given):
        if missing := set(given) - set(names):
            raise ValueError(f"There is no feature {sorted(missing)}")
        return [n in given for n in names]
    if all(isinstance(x, int) for x in given):
        if not all(0 <= x < len(names) for x in given):
            raise ValueError("is_categorical has positions that are no feature")
        return [i in given for i in range(len(names))]
    raise ValueError("is_categorical should hold flags, positions or names")


def category_limit(cat_min_categories: int | str, n: int) -> int:
    """Up to how many distinct values make a numeric column categorical."""
    if cat_min_categories == "log":
        return max(2, int(math.log(n))) if n > 0 else 2
    if cat_min_categories == "sqrt":
        return max(2, int(math.sqrt(n)))
    return whole("cat_min_categories", cat_min_categories, 4)




def value_of(df: DataFrame, name: str) -> Column:
    """The column as a double (numbers) or a string (names), null where it is missing."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, NUMBERS):
        c = c.cast("double")
        return F.when(~F.isnan(c), c)
    return c.cast("string")


def roles(df: DataFrame, names: Sequence[str], hint: Sequence[bool] | None = None, cat_min_categories: int | str = "log", verbose: bool = False) -> list[bool]:
    """Which features are categorical: names always; numbers by the hint, else if they have few distinct values.

    Missing values don't count. Distinct values are first estimated, in one pass over all columns; only those of columns
    with few by that estimate are then counted exactly. verbose: a warning tells of each column that isn't as declared, or
    was not declared.
    """
    numbers = [c for c in names if isinstance(df.schema[c].dataType, NUMBERS)]
    tell = warnings.warn if verbose else lambda _: None
    if hint is not None:
        for h, c in zip(hint, names, strict=True):
            if not h and c not in numbers:
                tell(f"Column {c} is categorical, as it holds no numbers, though it was declared as numeric")
        return [h or c not in numbers for h, c in zip(hint, names, strict=True)]
    few: set[str] = set()
    if numbers:
        got = df.agg(F.count(F.lit(1)).alias("n"), *(F.approx_count_distinct(value_of(df, c)).alias(f"d{i}") for i, c in enumerate(numbers))).first()
        limit = category_limit(cat_min_categories, got["n"])
        near = [c for i, c in enumerate(numbers) if got[f"d{i}"] <= 2 * limit + 8]
        exact = df.agg(*(F.count_distinct(value_of(df, c)).alias(f"d{i}") for i, c in enumerate(near))).first() if near else {}
        few = {c for i, c in enumerate(near) if exact[f"d{i}"] <= limit}
    out = [c not in numbers or c in few for c in names]
    for k, c in zip(out, names, strict=True):
        tell(f"Column {c} is taken as {'categorical' if k else 'numeric'}")
    return out


def array_roles(df: DataFrame, names: Sequence[str], hint: Sequence[bool] | None = None, cat_min_categories: int | str = "log") -> list[bool]:
    """The same for columns of one array, whose type tells little: text may be numbers.

    Without a hint a column with few distinct values is categorical (missing counts as one); one with many is numeric if
    all its text can be read as numbers. Declared as numeric, it has to be.
    """
    text = [F.col(f"`{c}`").cast("string") for c in names]
    unread = [F.count_if(t.isNotNull() & t.try_cast("double").isNull()) for t in text]
    got = df.agg(F.count(F.lit(1)).alias("n"), *(u.alias(f"u{i}") for i, u in enumerate(unread)), *(F.count_distinct(F.coalesce(t, F.lit(""))).alias(f"d{i}") for i, t in enumerate(text))).first()
    limit = category_limit(cat_min_categories, got["n"])
    if hint is None:
        return [got[f"d{i}"] <= limit or got[f"u{i}"] > 0 for i in range(len(names))]
    for i, (h, c) in enumerate(zip(hint, names, strict=True)):
        if not h and got[f"u{i}"]:
            raise ValueError(f"Column {c} is declared as numeric, but holds text that is no number")
    return list(hint)
