"""Strict checks of JSON text: by an expression where that tells enough, else by Arrow functions over whole batches."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.checker import Document, Handler, Outcome, parse, position
from larkspur.errors import describe
from larkspur.functions.native import end_position, surely_valid
from larkspur.policy import Policy

_COORD = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType())])
_ERROR = T.StructType([T.StructField(n, T.IntegerType() if n == "code" else T.StringType()) for n in ("category", "code", "name", "message")])
_KINDS = {"ok": T.BooleanType(), "err": _ERROR, "pos": _COORD, "input_pos": _COORD, "utf8_ok": T.BooleanType()}
RESULT = T.StructType([T.StructField(n, k) for n, k in _KINDS.items()])
_COORD_PA = pa.struct([("line", pa.int32()), ("column", pa.int32())])
_ERROR_PA = pa.struct([(n, pa.int32() if n == "code" else pa.string()) for n in ("category", "code", "name", "message")])
_RESULT_PA = pa.struct([("ok", pa.bool_()), ("err", _ERROR_PA), ("pos", _COORD_PA), ("input_pos", _COORD_PA), ("utf8_ok", pa.bool_())])


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def decoded(value: str | bytes) -> tuple[str, bool]:
    """Text of a string or of UTF-8 bytes; malformed bytes are replaced, and told."""
    if isinstance(value, str):
        return value, True
    try:
        return value.decode(), True
    except UnicodeDecodeError:
        return value.decode(errors="replace"), False


def mapped(text: Column, kind: T.DataType, build: Callable[[list], pa.Array]) -> Column:
    """An Arrow function of the texts' bytes, a list of them with None for null."""
    return F.arrow_udf(lambda batch: build(batch.to_pylist()), kind)(text.cast("binary"))


def result_row(text: str, out: Outcome, utf8_ok: bool, positions: bool = True) -> dict:
    """The result as a row. Once input has ended, the token's position is the input's."""
    coord = dict(zip(("line", "column"), position(text, out.at), strict=True)) if positions else None
    return {"ok": out.ok, "err": None if out.ok else describe(out.error), "pos": coord, "input_pos": coord, "utf8_ok": utf8_ok}


def json_check(text: Column | str, policy: Policy | None = None, values: bool = False) -> Column:
    """Struct (ok, err, pos, input_pos, utf8_ok) of a STRING or BINARY column; null for null.

    values=True also holds arrays and objects to the policy's sizes, as building the document would.
    """
    text, policy = column(text), policy or Policy()

    def one(value: bytes) -> dict:
        body, utf8_ok = decoded(value)
        return result_row(body, parse(body, policy, Document(policy) if values else None), utf8_ok, policy.positions)

    sure = surely_valid(text, policy, values)
    rest = mapped(F.when(~sure, text), RESULT, lambda got: pa.array([None if v is None else one(v) for v in got], _RESULT_PA))
    coord = end_position(text) if policy.positions else F.lit(None).cast(_COORD)
    parts = {"ok": F.lit(True), "err": F.lit(None).cast(_ERROR), "pos": coord, "input_pos": coord, "utf8_ok": F.lit(True)}
    return F.when(sure, F.struct(*(v.alias(n) for n, v in parts.items()))).otherwise(rest)


def json_valid(text: Column | str, policy: Policy | None = None, values: bool = False, strict_utf8: bool = False) -> Column:
    """Whether the text is strict JSON under the policy; null for null.

    Malformed UTF-8 is replaced before it is read, as json_check() tells in ``utf8_ok``; with strict_utf8 it is not valid.
    """
    text, policy = column(text), policy or Policy()

    def one(value: bytes) -> bool:
        body, utf8_ok = decoded(value)
        return (utf8_ok or not strict_utf8) and parse(body, policy, Document(policy) if values else Handler()).ok

    sure = surely_valid(text, policy, values)
    rest = mapped(F.when(~sure, text), T.BooleanType(), lambda got: pa.array([None if v is None else one(v) for v in got], pa.bool_()))
    return F.when(sure, True).otherwise(rest)


def json_text(text: Column | str, policy: Policy | None = None) -> Column:
    """Canonical text of a valid document, else null: members in the order of their last keys' first occurrence, the
    last of equal keys, whole floats as integers; built by the strict reader, so it holds under the policy's sizes too.
    """
    text, policy = column(text), policy or Policy()

    def one(value: bytes) -> str | None:
        got = parse(decoded(value)[0], policy, Document(policy))
        return json.dumps(got.value[0], ensure_ascii=False, separators=(",", ":")) if got.ok else None

    return mapped(text, T.StringType(), lambda got: pa.array([None if v is None else one(v) for v in got], pa.string()))
