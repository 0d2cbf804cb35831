"""tabloom: Spark-native operators for tabular, time-series and model-evaluation analytics."""

from tabloom.spec import SeriesSpec

__all__ = ["SeriesSpec"]
