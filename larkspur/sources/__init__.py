"""Reading JSON documents, and cutting texts into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row (path, text BINARY) for each file; text keeps its bytes, well-formed or not."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row (text) for each line, as in JSON-lines files."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def split_chunks(df: DataFrame, id_: str, text: str, size: int) -> DataFrame:
    """Rows (id, seq, chunk BINARY, is_last): the text's bytes in chunks of the given size; at least one chunk."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    n = F.greatest(F.ceil(F.octet_length(data) / size), F.lit(1)).cast("int")
    each = df.select(F.col(id_).alias("id"), data.alias("d"), n.alias("n")).withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return each.select("id", "seq", F.substring("d", F.col("seq") * size + 1, F.lit(size)).alias("chunk"), (F.col("seq") == F.col("n") - 1).alias("is_last"))


def write_documents(df: DataFrame, text: str, path: str) -> None:
    """One line for each text; texts must not hold line breaks (json_text() writes none)."""
    df.select(text).write.text(path)
