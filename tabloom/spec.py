"""Series description and schema checks.  Nothing here scans data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T


@dataclass(frozen=True)
class SeriesSpec:
    """Names of the series id, date and target columns of a long multi-series table."""

    series_id: str = "series_id"
    date_col: str = "date"
    target: str = "target"

    def check(self, df: DataFrame) -> None:
        require(df, [self.series_id, self.date_col, self.target])
        if not isinstance(df.schema[self.date_col].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            raise TypeError(f"{self.date_col} must be a date or timestamp column")
        if not isinstance(df.schema[self.target].dataType, T.NumericType):
            raise TypeError(f"{self.target} must be numeric")


def require(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is the only missing value in the pandas world; Spark keeps NULL and NaN apart."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in float_columns(df)})


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column so that results do not depend on summation order."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in float_columns(df)})
