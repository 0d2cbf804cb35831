"""Surfaces for user code, for what expressions cannot say.  All of them move Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param.shared import HasInputCols, HasOutputCols, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F


def row_function(fn: Callable[..., pd.Series], returns: str):
    """Function of whole columns of a batch (never of single rows)."""
    return F.pandas_udf(fn, returns)


def grouped_map(df: DataFrame, by: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows_limit: int | None = None) -> DataFrame:
    """``fn`` per group.  A group must fit one task: with ``rows_limit`` a larger one is an error up front."""
    if rows_limit is not None:
        from tabloom.operators.order import hot_key

        if hot_key(df, by, rows_limit):
            raise ValueError(f"a group exceeds {rows_limit} rows; use a windowed or sliced operator")
    return df.groupBy(*by).applyInPandas(fn, schema)


def aggregate_function(fn: Callable[..., float], returns: str = "double"):
    """Custom aggregate for what no expression covers; metrics are plain aggregate columns instead."""

    def call(*cols: str) -> Column:
        def inner(*series: pd.Series) -> float:
            return fn(*series)

        inner.__annotations__ = {}
        return F.pandas_udf(inner, returns, F.PandasUDFType.GROUPED_AGG)(*cols)

    return call


def generate(df: DataFrame, keep: Sequence[str], rows: Column) -> DataFrame:
    """One row to many through an array of structs."""
    return df.select(*keep, F.inline(rows))


def table_function(returns: str):
    """Decorator for a Python table function (class with ``eval``)."""
    return F.udtf(returnType=returns)


class CentreModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Subtracts stored medians; the state is a parameter, so it is saved with the model."""

    medians = Param(Params._dummy(), "medians", "one median per input column", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.medians))
        return df.withColumns({o: F.coalesce(F.col(i), F.lit(m)) - F.lit(m) for i, o, m in cols})


class MedianCentre(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fit / transform pair: imputes the median and centres on it."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> CentreModel:
        from tabloom.operators.order import quantile_list

        m = CentreModel()
        m._set(inputCols=self.getInputCols(), outputCols=self.getOutputCols(), medians=[quantile_list(df, c, [0.5])[0] for c in self.getInputCols()])
        return m
