"""Helpers of this subpackage: written tables, bounded broadcasts, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.storage import fresh_path

#: A table of at most so many bytes in memory may be broadcast; beyond it a shuffle join is used.
BROADCAST_BYTES = 8 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again: what was made of them has been written in its turn."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value in a row, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(16) + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind), F.lit(16))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)):
            each = F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + _width(x, kind.elementType))
        else:
            each = 8 * F.size(value)
        return F.lit(24) + F.coalesce(F.greatest(each, F.lit(0)), F.lit(0))
    return F.lit(8)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a written table for broadcast if its rows, measured in bytes, are within the bound; else leaves it to shuffle."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16))
    total = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links ``(a, b)``: rows ``(id, component)`` of every linked id, component being its smallest id.

    Alternates two steps that keep connectivity: every larger neighbour, then every smaller one, is linked to the
    smallest neighbour. Hot ids are pre-aggregated (a minimum) and their rows are joined back, which adaptive execution
    can split. Each round is a written table.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small_ = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        now = written(
            small_.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
            "links",
        )
    pairs = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("id"), "component").distinct())
