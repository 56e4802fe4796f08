"""The event stream as SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from larkspur.operators.events import EVENTS, event_lists
from larkspur.policy import Policy


def register_json_events(spark: SparkSession, name: str = "json_events", policy: Policy | None = None) -> None:
    """Registers the table function name(text), for ``SELECT d.id, e.* FROM d, LATERAL json_events(d.text) e``, and the
    array of events as name_array(text). Rows as json_events() gives them; texts cross to Python in Arrow batches.
    """
    build = event_lists(policy or Policy())
    spark.udf.register(f"{name}_array", F.arrow_udf(lambda batch: build(batch.to_pylist()), EVENTS))
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING)
        RETURNS TABLE (seq INT, event STRING, depth INT, key STRING, str STRING, i BIGINT, f DOUBLE, b BOOLEAN)
        RETURN SELECT pos, col.event, col.depth, col.key, col.str, col.i, col.f, col.b FROM posexplode({name}_array(text))""")
