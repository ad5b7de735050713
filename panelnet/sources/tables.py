"""Tables by the suffix of their path: Parquet, XLSX where openpyxl is there, else delimited text with a sniffed delimiter."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = ",;\t|"


def sniff(spark: SparkSession, path: str) -> str:
    """The delimiter of a text file's first line, which alone is read."""
    line = spark.read.text(path).limit(1).collect()
    if not line or not line[0][0]:
        return ","
    try:
        return csv.Sniffer().sniff(line[0][0], DELIMITERS).delimiter
    except csv.Error:
        return max(DELIMITERS, key=line[0][0].count)


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table of any of the formats. Without a schema, types of delimited text are inferred; give one for large inputs."""
    lower = path.lower()
    if lower.endswith(".parquet"):
        return spark.read.parquet(path)
    if lower.endswith((".xlsx", ".xls")):
        return load_sheet(spark, path, schema)
    reader = spark.read.option("header", True).option("sep", sniff(spark, path)).option("encoding", "UTF-8")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def load_sheet(spark: SparkSession, path: str, schema: T.StructType | str | None = None, text: Sequence[str] = ()) -> DataFrame:
    """The first sheet of a workbook; columns in ``text`` stay strings. Workbooks are small; this reads on the driver and needs openpyxl."""
    import pandas as pd

    try:
        frame = pd.read_excel(path, dtype=dict.fromkeys(text, str))
    except ImportError as e:
        raise ImportError("reading workbooks needs openpyxl; convert the sheet to CSV or Parquet instead") from e
    return spark.createDataFrame(frame, schema=schema)


def load_indicator(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a ``;`` file, all strings, with value as a number and year as an integer; rows whose value is no number go."""
    from panelnet.operators.external import read_values

    return read_values(spark.read.option("header", True).option("sep", ";").option("inferSchema", False).csv(path))


def require(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    """``df`` if it has the columns; else an error that names them and those there are."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {missing}; it has {df.columns}")
    return df


def without_nan(df: DataFrame) -> DataFrame:
    """NaN in floating-point columns becomes null: both mean missing."""
    kinds = (T.DoubleType, T.FloatType)
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, kinds)}) if any(isinstance(f.dataType, kinds) for f in df.schema) else df
