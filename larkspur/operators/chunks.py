"""Documents that arrive in pieces, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_assemble(df: DataFrame, id_: str, seq: str, chunk: str) -> DataFrame:
    """Rows (id, text, chunks, whole): the bytes of a document's chunks in order; whole: seq runs from 0 without a gap.

    Chunks may end inside a character. One shuffle, by id; a group is one document.
    """
    per = df.groupBy(F.col(id_).alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(chunk).cast("binary").alias("c")))).alias("p"))
    text = F.concat(F.lit(b""), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["c"])))
    whole = (F.element_at("p", 1)["s"] == 0) & (F.element_at("p", -1)["s"] == F.size("p") - 1)
    return per.select("id", text.alias("text"), F.size("p").alias("chunks"), whole.alias("whole"))
