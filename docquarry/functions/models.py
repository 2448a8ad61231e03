"""Callables that stand for models, as column functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


def model(of: Callable[..., pd.Series], kind: str):
    """A column function from one that maps pandas Series; it is never run twice for a row by a rewritten plan, since answers may differ."""

    def one(x: pd.Series) -> pd.Series:
        return of(x)

    return F.pandas_udf(one, kind).asNondeterministic()


def model_of_two(of: Callable[..., pd.Series], kind: str):
    """As model(), of two columns."""

    def two(x: pd.Series, y: pd.Series) -> pd.Series:
        return of(x, y)

    return F.pandas_udf(two, kind).asNondeterministic()


def listed(of: Callable[[list], list], kind: str):
    """As model(), from one that maps lists: nested values become Arrow arrays at once, which takes longer by way of pandas."""
    to = to_arrow_type(DataType.fromDDL(kind))

    def one(x: pa.Array) -> pa.Array:
        return pa.array(of(x.to_pylist()), to)

    return F.arrow_udf(one, kind).asNondeterministic()
