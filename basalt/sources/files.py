"""CSV and JSON in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def import_csv(spark: SparkSession, path: str, header: bool = True, comma: str = ",", null: str = "") -> DataFrame:
    """All columns as text; without a header they are column1, column2, ..."""
    df = spark.read.csv(path, header=header, sep=comma, nullValue=null, inferSchema=False, multiLine=True, escape='"')
    return df if header else df.toDF(*[f"column{i + 1}" for i in range(len(df.columns))])


def export_csv(df: DataFrame, path: str, header: bool = True, comma: str = ",", null: str = "") -> None:
    df.write.mode("overwrite").csv(path, header=header, sep=comma, nullValue=null, emptyValue='""', escape='"')


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; NULLs are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def import_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
