"""Document values (VARIANT) with strictly typed lookup; Catalyst expressions but for what the strict reader must see."""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.checker import Document, parse
from larkspur.functions.checks import column as _col
from larkspur.functions.checks import decoded, json_text, json_valid, mapped
from larkspur.functions.native import is_whole, surely_valid, truncated
from larkspur.policy import Policy

KINDS = ("integer", "float", "number", "string", "boolean", "null", "array", "object", "any")


def allow_duplicate_keys(spark: SparkSession) -> None:
    """Lets json_parse() keep the last of equal keys; without it they make the value null."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def json_parse(text: Column | str, policy: Policy | None = None, partial: bool = False) -> Column:
    """VARIANT of a valid document, else null. Integers of more than 38 digits do not fit a VARIANT; they become doubles.

    partial=True gives the innermost open array or object as read so far where the text is not valid.
    """
    text, policy = _col(text), policy or Policy()
    if not partial:
        return F.when(json_valid(text, policy, values=True), F.try_parse_json(text.cast("string")))

    def one(value: bytes) -> str | None:
        got = parse(decoded(value)[0], policy, Document(policy)).value
        return None if got is None else json.dumps(got[0], ensure_ascii=False)

    so_far = mapped(text, T.StringType(), lambda got: pa.array([None if v is None else one(v) for v in got], pa.string()))
    return F.try_parse_json(so_far)


def _double(v: Column, policy: Policy) -> Column:
    """A number as the policy's float type holds it."""
    number = F.try_variant_get(v, "$", "double")
    return number.cast("float").cast("double") if policy.float == "float" else number


def json_typeof(v: Column | str, policy: Policy | None = None) -> Column:
    """null, boolean, integer, float, string, array or object; SQL null for SQL null.

    Floats without a fraction that the policy's integers can hold are integers, as for the reader. policy: the one that
    the value was parsed with.
    """
    v, policy = _col(v), policy or Policy()
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None).when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "BIGINT", "integer")
        .when(is_whole(_double(v, policy), policy), "integer").otherwise("float")
    )


def _integer(v: Column, policy: Policy) -> Column:
    """A value of the type integer as BIGINT, or as DECIMAL(38, 0) where the policy has 128 bits."""
    kind, number = F.schema_of_variant(v), truncated(_double(v, policy))
    if policy.int_bits <= 64:
        return F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint")).otherwise(number.try_cast("bigint"))
    # whole decimals beyond a long are integers as written; those within one were written with a fraction of zeros
    beyond = kind.rlike(r"^DECIMAL\(\d+,0\)$") & F.try_variant_get(v, "$", "bigint").isNull()
    exact = F.when((kind == "BIGINT") | beyond, F.try_variant_get(v, "$", "decimal(38,0)"))
    # a double in two parts that longs hold
    part = lambda x: x.try_cast("bigint").cast("decimal(20,0)")
    high = truncated(number / 2.0**62)
    rest = part(number - high * 2.0**62)
    split = (part(high) * F.lit(2**62).cast("decimal(19,0)")).try_cast("decimal(38,0)") + rest
    return F.coalesce(exact, split.try_cast("decimal(38,0)"))


def typed(member: Column, kind: str, policy: Policy) -> Column:
    """A VARIANT as a value of a kind, null if it is of another."""
    if kind not in KINDS:
        raise ValueError(f"no such type: {kind}")
    if kind == "any":
        return member
    if kind == "number":
        name, value = json_typeof(member, policy), _double(member, policy)
        return F.when(name == "float", value).when(name == "integer", truncated(value))
    is_kind = json_typeof(member, policy) == kind
    if kind == "null":
        return F.when(is_kind, F.lit(True))
    if kind in ("array", "object"):
        return F.when(is_kind, member)
    if kind == "integer":
        return F.when(is_kind, _integer(member, policy))
    if kind == "float":
        return F.when(is_kind, _double(member, policy))
    return F.when(is_kind, F.try_variant_get(member, "$", kind))


def _member(v: Column, key: str | int) -> Column:
    if isinstance(key, int):
        return F.try_variant_get(v, f"$[{key}]", "variant")
    if "'" in key and '"' in key:  # a path has no escapes
        return F.try_element_at(F.from_json(v.cast("string"), "map<string,variant>"), F.lit(key))
    quote = '"' if "'" in key else "'"
    return F.try_variant_get(v, f"$[{quote}{key}{quote}]", "variant")


def json_get(v: Column | str, key: str | int | None, kind: str, policy: Policy | None = None) -> Column:
    """Member of an object (or array, by index; None: the value itself) if its type is kind, else null; nothing is coerced.

    kind: integer, float, number, string, boolean, null, array, object, or any. integer gives BIGINT (DECIMAL(38, 0) where the
    policy's integers have 128 bits), float DOUBLE, number (integer or float) DOUBLE, null TRUE, array, object and any
    VARIANT. policy: the one that the
    value was parsed with; it says which floats are integers.
    """
    v = _col(v)
    return typed(v if key is None else _member(v, key), kind, policy or Policy())


def json_members(text: Column | str, kinds: dict[str, str], policy: Policy | None = None) -> Column:
    """Struct of some members of the objects in a text column, typed as json_get() does; null unless strictly valid.

    The text is checked once and parsed once, whatever the number of members, and no other members are built.
    """
    text, policy = _col(text), policy or Policy()
    schema = T.StructType([T.StructField(k, T.VariantType()) for k in kinds])
    got = F.from_json(text.cast("string"), schema)
    out = F.struct(*(typed(got.getField(k), kind, policy).alias(k) for k, kind in kinds.items()))
    return F.when(json_valid(text, policy, values=True), out)


def json_make(kind: str, value: Column | None = None) -> Column:
    """A VARIANT of a type: of a column's value, or, without one, the type's empty value (0, "", false, [], {}); null is
    the JSON null."""
    empty = {"null": "null", "boolean": "false", "integer": "0", "float": "cast(0 as double)", "string": '""', "array": "[]", "object": "{}"}
    if kind not in empty:
        raise ValueError(f"no such type: {kind}")
    if kind == "null" or value is None:
        return F.lit(0.0).cast("variant") if kind == "float" else F.parse_json(F.lit(empty[kind]))
    if kind in ("array", "object"):
        return F.to_variant_object(value)
    return value.cast({"integer": "bigint", "float": "double"}.get(kind, kind)).cast("variant")


def json_size(v: Column | str) -> Column:
    """Members of an array or object; null for others."""
    v = _col(v)
    text = v.cast("string")
    return F.when(json_typeof(v) == "array", F.json_array_length(text)).when(json_typeof(v) == "object", F.size(F.json_object_keys(text)))


def json_keys(v: Column | str) -> Column:
    """Sorted keys of an object; null for others."""
    v = _col(v)
    return F.when(json_typeof(v) == "object", F.sort_array(F.json_object_keys(v.cast("string"))))


def json_each(df, column: str, pos: str = "pos", key: str = "key", value: str = "value"):
    """A row for each member of the array or object in a VARIANT column of df."""
    name = "_each_" + column
    view = df.withColumn(name, F.col(column))
    members = view.lateralJoin(view.sparkSession.tvf.variant_explode(F.col(name).outer()))
    return members.drop(name).withColumnsRenamed({"pos": pos, "key": key, "value": value})


def json_set(v: Column | str, key: str, value: Column) -> Column:
    """The object with a member put in or replaced; null if it is not an object. value: any column, taken as its JSON."""
    v = _col(v)
    members = F.from_json(v.cast("string"), "map<string,variant>")
    rest = F.map_filter(members, lambda k, _: k != key)
    return F.when(json_typeof(v) == "object", F.parse_json(F.to_json(F.map_concat(rest, F.create_map(F.lit(key), value.cast("variant"))))))


def json_is_close(a: Column, b: Column) -> Column:
    """Equality of floats: exact, or nearer than the larger of the smallest normal number and 16 epsilons of their sum."""
    return (a == b) | (F.abs(a - b) < F.greatest(F.lit(2.0**-1022), F.lit(16 * 2.0**-52) * (F.abs(a) + F.abs(b))))


def _equal(a, b) -> bool:
    if type(a) is not type(b):
        return False
    if isinstance(a, float):
        return a == b or abs(a - b) < max(2.0**-1022, 16 * 2.0**-52 * (abs(a) + abs(b))) and math.isfinite(a) and math.isfinite(b)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(_equal, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(_equal(x, b[k]) for k, x in a.items())
    return a == b


def json_equal(a: Column | str, b: Column | str, policy: Policy | None = None, tolerant: bool = True) -> Column:
    """Deep equality of two JSON texts: types must match, objects are unordered; null where one is null or not valid.

    tolerant=False compares canonical texts instead (floats exactly). Only texts that differ as values of one canonical
    form, or are not plain, are read by the strict reader.
    """
    a, b, policy = _col(a), _col(b), policy or Policy()
    if not tolerant:
        return F.to_json(F.try_parse_json(json_text(a, policy))) == F.to_json(F.try_parse_json(json_text(b, policy)))

    def equal(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True):
            if p is None or q is None:
                out.append(None)
                continue
            p, q = (parse(decoded(t)[0], policy, Document(policy)) for t in (p, q))
            out.append(_equal(p.value[0], q.value[0]) if p.ok and q.ok else None)
        return pa.array(out, pa.bool_())

    value = lambda t: F.to_json(F.try_parse_json(t.cast("string")))
    same = surely_valid(a, policy, True) & surely_valid(b, policy, True) & (value(a) == value(b))
    same = F.coalesce(same, F.lit(False))
    rest = F.arrow_udf(equal, T.BooleanType())(*(F.when(~same, t.cast("binary")) for t in (a, b)))
    return F.when(same, True).otherwise(rest)
