"""Tables in files of any format that Spark reads, and the sinks of the index (S17, S18); formats beyond Parquet are an extension."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read_table(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A table of one of ``FORMATS``. Formats that do not carry a schema should be given one, as inference reads the data twice."""
    if form not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    reader = spark.read.format(form).options(**({"header": "true"} if form == "csv" else {}) | options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_table(df: DataFrame, path: str, form: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(form).options(**({"header": "true"} if form == "csv" else {}))
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_text(text: str, path: str) -> None:
    """A packet or a report as one file."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, "utf-8")


def to_json_lines(df: DataFrame) -> DataFrame:
    """Each row as a JSON object."""
    return df.selectExpr("to_json(struct(*)) as value")
