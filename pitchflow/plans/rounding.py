"""Rounding that both engines do alike: a hair above the value, so that an exact half never depends on the last bit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hair(digits: int) -> float:
    return 3.3 * 10.0 ** (-digits - 4)


def pick(df: DataFrame, keys, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(F.col(c) + _hair(digits), digits).alias(c) for c in columns])


def rounded(digits: int, *columns: str) -> str:
    return ", ".join(f"round({c} + {_hair(digits):.2e}, {digits}) AS {c}" for c in columns)
