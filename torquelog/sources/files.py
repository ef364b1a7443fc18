"""CSV, JSON-lines, dictionary and Parquet sources and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torquelog.runtime import scratch_path


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with a header. ``multi_line`` is needed for quoted cells with line breaks.

    Without a schema every column is a string. A multi-line file is read by one task, so convert a
    large one to Parquet once.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_error_list(spark: SparkSession, path: str) -> DataFrame:
    """Error list: quoted multi-line cells, header names trimmed."""
    df = read_csv(spark, path, multi_line=True)
    return df.toDF(*[c.strip().lstrip("﻿") for c in df.columns])


def read_or_empty(
    spark: SparkSession, path: str, schema: T.StructType | str, missing_ok: bool = False, **options
) -> DataFrame:
    """CSV of a given schema; a missing file raises, or is an empty table when allowed."""
    try:
        return read_csv(spark, path, schema, **options)
    except AnalysisException as error:
        if missing_ok and error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON object per line; array fields become array columns."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of strings as (key, expansion) rows, without the empty key."""
    parsed = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", "map<string,string>")).alias("key", "expansion")
    )
    return parsed.where("key <> ''")


def _flat(df: DataFrame) -> DataFrame:
    """CSV has no nested types: arrays, structs and maps are written as JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def write_csv(
    df: DataFrame, path: str, columns: list[str] | None = None, quote_all: bool = False,
    mode: str = "error",
) -> None:
    """CSV folder with a header, one file per partition."""
    chosen = df.select(*columns) if columns else df
    writer = _flat(chosen).write.mode(mode).option("header", True).option("escape", '"')
    writer.option("quoteAll", quote_all).csv(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Hand a stage's result over as a Parquet table in the shared checkpoint folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_if_any(df: DataFrame, path: str, **options) -> bool:
    """Write only when there are rows; tells whether it did."""
    if df.isEmpty():
        return False
    write_csv(df, path, **options)
    return True
