"""Readers.  Each returns a lazy DataFrame and leaves pruning and pushdown to the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Spellings of a missing value, compared after trimming and in lower case.
NULL_TOKENS = (
    "", "?", ".", "na", "n/a", "#na", "#n/a", "#n/a n/a", "null", "none", "nan", "-nan",
    "1.#ind", "-1.#ind", "1.#qnan", "-1.#qnan",
)


def read_csv(
    spark: SparkSession,
    path,
    schema: str | None = None,
    select: Sequence[str] | None = None,
    sep: str = ",",
    header: bool = True,
    limit: int | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with optional declared schema, column list and row cap; the codec follows the file name.

    ``multi_line`` allows line breaks in quoted cells, at the price that a file is read by one task.
    """
    reader = spark.read.option("header", header).option("sep", sep).option("escape", '"').option("multiLine", multi_line)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    df = df.select(*select) if select else df
    return df.limit(limit) if limit is not None else df


def read_jsonl(spark: SparkSession, path, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_text_lines(spark: SparkSession, path, clean_regex: str | None = None) -> DataFrame:
    """Lines with a regex removed, trimmed, blank lines dropped."""
    line = F.regexp_replace("value", clean_regex, "") if clean_regex else F.col("value")
    return spark.read.text(path).select(F.trim(line).alias("line")).filter("line <> ''")


def read_xml_rows(spark: SparkSession, path, row_tag: str, schema: str) -> DataFrame:
    """One row per ``row_tag`` element; attributes arrive with the ``_`` prefix."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def explode_children(df: DataFrame, child: str, keep: Sequence[str], attributes: Sequence[str], default: str = "") -> DataFrame:
    """Rows of a nested element with ``default`` for attributes that are absent."""
    return df.select(*keep, F.explode_outer(child).alias("_c")).select(
        *keep, *[F.coalesce(F.col(f"_c._{a}").cast("string"), F.lit(default)).alias(a) for a in attributes]
    )


def read_warehouse(spark: SparkSession, sql: str, views: Mapping[str, DataFrame] | None = None, **args) -> DataFrame:
    """SQL text with named parameter markers (``:name``), never string substitution."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args)


def read_union(frames: Mapping[str, DataFrame], source_col: str = "source") -> DataFrame:
    """Union of tables by the columns all of them have, tagged with the source id."""
    common = [c for c in next(iter(frames.values())).columns if all(c in f.columns for f in frames.values())]
    return reduce(
        DataFrame.unionByName, [f.select(F.lit(tag).alias(source_col), *common) for tag, f in frames.items()]
    )


def read_tagged_files(spark: SparkSession, paths: Sequence[str], source_col: str = "source") -> DataFrame:
    """One multi-path parquet read; the folder each row came from becomes its tag."""
    file = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]*$", 1)
    return spark.read.option("mergeSchema", True).parquet(*paths).withColumn(source_col, file)


def inline_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def nullify(col: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """NULL for every spelling of a missing value."""
    return F.when(~F.trim(F.lower(col)).isin(list(tokens)), col)


def to_number(col: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Number of a text cell: missing spellings and other text -> NULL, the inf family -> +-infinity."""
    c = F.trim(F.lower(col))
    return (
        F.when(c.isin("inf", "+inf"), F.lit(float("inf")))
        .when(c == "-inf", F.lit(float("-inf")))
        .when(~c.isin(list(tokens)), c.try_cast("double"))
    )


def nullify_tokens(df: DataFrame, cols: Sequence[str], tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    return df.withColumns({c: nullify(F.col(c), tokens) for c in cols})
