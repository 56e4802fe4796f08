"""The event stream of JSON texts as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from larkspur.checker import Handler, Recorder, parse
from larkspur.functions.checks import _RESULT_PA, RESULT, decoded, mapped, result_row
from larkspur.functions.native import flat, flat_events
from larkspur.policy import Policy

_FIELDS = {"event": pa.string(), "depth": pa.int32(), "key": pa.string(), "str": pa.string(), "i": pa.int64(), "f": pa.float64(), "b": pa.bool_()}
_KINDS = {"event": T.StringType(), "depth": T.IntegerType(), "key": T.StringType(), "str": T.StringType(), "i": T.LongType(), "f": T.DoubleType(), "b": T.BooleanType()}
EVENTS = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in _KINDS.items()]))


def event_row(name: str, got: object, depth: int) -> tuple:
    """An event as (event, depth, key, str, i, f, b); integers beyond 64 bits come as digits in str."""
    big = name == "integer" and not -(1 << 63) <= got < 1 << 63
    text = str(got) if big else got if name == "string" else None
    number = got if name == "integer" and not big else None
    return name, depth, got if name == "key" else None, text, number, got if name == "float" else None, got if name == "boolean" else None


def event_lists(policy: Policy) -> Callable[[list], pa.Array]:
    """Of a list of texts the array of their lists of events; none for null."""

    def read(values: list) -> pa.Array:
        rows, ends = [], [0]
        for value in values:
            if value is not None:
                seen = Recorder()
                parse(decoded(value)[0], policy, seen)
                rows += [event_row(*e) for e in seen.events]
            ends.append(len(rows))
        columns = zip(*rows, strict=True) if rows else [()] * len(_FIELDS)
        each = [pa.array(c, t) for c, t in zip(columns, _FIELDS.values(), strict=True)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(each, names=list(_FIELDS)))

    return read


def json_events(df: DataFrame, id_: str, text: str, policy: Policy | None = None) -> DataFrame:
    """Rows (id, seq, event, depth, key, str, i, f, b), in the order of seq within a text.

    Events before an error are given; integers beyond 64 bits come as digits in str. Null texts give no rows; malformed
    UTF-8 is replaced (json_check() tells). Plain texts of one level are cut up by expressions, others by the reader.
    """
    policy = policy or Policy()
    body = F.col(text)
    plain = flat(body, policy)
    rest = mapped(F.when(~plain, body), EVENTS, event_lists(policy))
    events = F.when(plain, flat_events(body, policy)).otherwise(rest)
    each = df.select(F.col(id_).alias("id"), events.alias("e")).select("id", F.posexplode("e").alias("seq", "e"))
    return each.select("id", "seq", "e.*")


def token() -> Column:
    """An event row as the token a printer would write."""
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    marks = {"begin_array": "[", "end_array": "]", "begin_object": "{", "end_object": "}", "null": "null"}
    out = F.when(F.col("event") == "string", quoted("str")).when(F.col("event") == "key", quoted("key")).when(F.col("event") == "integer", F.coalesce(F.col("i").cast("string"), "str"))
    out = out.when(F.col("event") == "float", F.col("f").cast("string")).when(F.col("event") == "boolean", F.col("b").cast("string"))
    for name, mark in marks.items():
        out = out.when(F.col("event") == name, mark)
    return out


def json_render(events: DataFrame) -> DataFrame:
    """Rows (id, tokens): a text's events printed in order, separated by blanks."""
    per = events.select("id", F.struct("seq", token().alias("t")).alias("e")).groupBy("id").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return per.select("id", F.array_join("e.t", " ").alias("tokens"))


def json_tokens(text: Column | str) -> Column:
    """Lexical tokens of a text without white space, or null if something in it is no token. A Catalyst expression."""
    text = F.col(text) if isinstance(text, str) else text
    pattern = r'"(?:[^"\\\x00-\x1F]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|[\[\]{}:,]|[ \t\n\r]+'
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.array_join(every, "") == text, F.filter(every, lambda t: F.trim(F.translate(t, "\t\n\r", "   ")) != ""))


def accumulate(df: DataFrame, id_: str, text: str, handler: Callable[[], Handler], schema: str, policy: Policy | None = None) -> DataFrame:
    """Rows (id, ok, err, pos, input_pos, utf8_ok, result): a user's handler over each text; its result() per text.

    An event method of the handler that returns a string ends the parse with that as the error's name.
    """
    policy = policy or Policy()
    kind = df.schema[id_].dataType.simpleString()
    spark_type = T._parse_datatype_string(schema)
    arrow = to_arrow_type(spark_type)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            results, values = [], []
            for value in b.column(1).to_pylist():
                if value is None:
                    results.append({f.name: None for f in _RESULT_PA})
                    values.append(None)
                    continue
                body, utf8_ok = decoded(value)
                out = parse(body, policy, handler())
                results.append(result_row(body, out, utf8_ok, policy.positions))
                values.append(out.value)
            cols = [pa.array([r[f.name] for r in results], f.type) for f in _RESULT_PA]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(values, arrow)], names=["id", *(f.name for f in _RESULT_PA), "result"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RESULT)
    return df.select(F.col(id_).alias("id"), text).mapInArrow(read, f"id {kind}, {fields}, result {spark_type.simpleString()}")
