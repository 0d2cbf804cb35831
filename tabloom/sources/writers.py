"""Sinks.  Tasks write in parallel; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F


def write_table(df: DataFrame, name: str, mode: str = "overwrite", path: str | None = None) -> int:
    """Replace a table and return the number of rows written, counted during the write."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return seen.get["n"]


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, compression: str | None = None, sep: str = ",", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').option(
        "compression", compression or "none"
    ).csv(path)


def write_split(df: DataFrame, path: str, max_records: int, mode: str = "overwrite") -> None:
    """Parts of at most ``max_records`` rows each."""
    df.write.mode(mode).option("maxRecordsPerFile", max_records).parquet(path)


def column_chunks(columns: Sequence[str], keys: Sequence[str], k: int) -> list[list[str]]:
    rest = [c for c in columns if c not in keys]
    return [[*keys, *rest[i::k]] for i in range(k)]


def write_column_chunks(df: DataFrame, path: str, keys: Sequence[str], k: int) -> list[str]:
    """Vertical split: chunk i has the keys and every k-th other column starting at i."""
    out = []
    for i, cols in enumerate(column_chunks(df.columns, keys, k)):
        out.append(f"{path}/chunk={i}")
        df.select(*cols).write.mode("overwrite").parquet(out[-1])
    return out


def formatted_line(label: Column, text: Column, namespace: str = "t") -> Column:
    """``label |ns text`` with the characters that carry meaning in that format blanked out."""
    clean = F.replace(F.translate(text, ":|\n", "  \t"), F.lit("\\n"), F.lit("\t"))
    return F.concat(label.cast("string"), F.lit(f" |{namespace} "), clean)


def write_formatted_text(df: DataFrame, path: str, label: str, text: str, namespace: str = "t") -> None:
    df.select(formatted_line(F.col(label), F.col(text), namespace).alias("value")).write.mode("overwrite").text(path)
