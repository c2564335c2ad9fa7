"""Numbers as Python rounds and writes them: on the exact binary value, half to even."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def py_round(value: Column, digits: int = 0) -> Column:
    """round(value, digits); null stays null."""

    @F.pandas_udf(T.DoubleType())
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if pd.isna(x) else float(round(x, digits)))

    return of(value.cast("double"))


def py_format(value: Column, spec: str, missing: str = "—") -> Column:
    """format(value, spec), as ".0%" or ".1f"; null is written as missing."""

    @F.pandas_udf(T.StringType())
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda x: missing if pd.isna(x) else format(x, spec)).astype(object)

    return of(value.cast("double"))
