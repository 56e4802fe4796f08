"""Queries over the tables, by name, each with SQL that computes the same from the relational columns.

JSON is made inside the queries (``events.props`` is JSON already). Where no relational derivation exists, the SQL
restates expectations as literal rows; these are marked GOLDEN.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import (
    allow_duplicate_keys,
    json_check,
    json_each,
    json_equal,
    json_is_close,
    json_keys,
    json_members,
    json_parse,
    json_set,
    json_size,
    json_valid,
)
from larkspur.functions import json_get as get_under
from larkspur.functions import json_typeof as typeof_under
from larkspur.operators import json_assemble, json_events, json_render
from larkspur.policy import Policy
from larkspur.sources import split_chunks
from larkspur.streaming import check_stream, finished

WIDE = Policy.relaxed()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def json_get(v: Column | str, key: str | int | None, kind: str) -> Column:
    return get_under(v, key, kind, WIDE)


def json_typeof(v: Column | str) -> Column:
    return typeof_under(v, WIDE)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def parsed(df: DataFrame, text: Column | str, policy: Policy = WIDE) -> DataFrame:
    """df with ``v``: its JSON parsed once, however many members are read."""
    allow_duplicate_keys(df.sparkSession)
    return df.withColumn("v", json_parse(text, policy))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (NOT json_valid(props)) AS malformed,
  CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k FROM events GROUP BY 1""")
def flagship_props_by_type(spark, sf):
    """Per event type: events, malformed props, and the sum of props.k."""
    df = table(spark, sf, "events").select("event_type", json_members("props", {"k": "integer"}, WIDE).alias("m"))
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("m").isNull()).alias("malformed"), F.sum("m.k").alias("sum_k"))


@query("SELECT count(*) AS n, count(*) FILTER (json_valid(props)) AS valid FROM events")
def valid_count(spark, sf):
    return table(spark, sf, "events").select(json_valid("props").alias("ok")).agg(F.count("*").alias("n"), F.count_if("ok").alias("valid"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def get_typed_int(spark, sf):
    return parsed(table(spark, sf, "events"), "props").select("event_id", json_get("v", "k", "integer").alias("k"))


@query("SELECT event_id, CAST(NULL AS VARCHAR) AS k FROM events")
def get_wrong_type_is_null(spark, sf):
    return parsed(table(spark, sf, "events"), "props").select("event_id", json_get("v", "k", "string").alias("k"))


@query("SELECT event_id, CAST(NULL AS BIGINT) AS zz FROM events")
def get_missing_is_null(spark, sf):
    return parsed(table(spark, sf, "events"), "props").select("event_id", json_get("v", "zz", "integer").alias("zz"))


def as_json(df: DataFrame, *cols: str) -> Column:
    return F.to_json(F.struct(*(cols or df.columns)), {"ignoreNullFields": "false"})


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")
def roundtrip_customer(spark, sf):
    df = table(spark, sf, "customer")
    kinds = {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "number", "c_mktsegment": "string"}
    return df.select(json_members(as_json(df), kinds, WIDE).alias("m")).select("m.*").withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def roundtrip_text_unicode(spark, sf):
    df = table(spark, sf, "documents")
    df = df.select("doc_id", json_members(as_json(df, "text"), {"text": "string"}, WIDE).alias("m"))
    return df.select("doc_id", F.md5(F.col("m.text").cast("binary")).alias("md5"))


@query("SELECT doc_id, octet_length(encode(text)) <= 64 AS ok, CASE WHEN octet_length(encode(text)) > 64 THEN 'string_too_long' END AS error FROM documents")
def string_too_long_docs(spark, sf):
    df = table(spark, sf, "documents")
    out = df.select("doc_id", json_check(as_json(df, "text")).alias("r"))
    return out.select("doc_id", "r.ok", F.col("r.err.name").alias("error"))


@query("""SELECT 'begin_object' AS event, count(*) AS n FROM orders UNION ALL SELECT 'end_object', count(*)
  FROM orders UNION ALL SELECT 'key', 6 * count(*) FROM orders
  UNION ALL SELECT 'string', 3 * count(*) FROM orders
  UNION ALL SELECT 'integer', 2 * count(*) + count(*) FILTER (abs(o_totalprice - trunc(o_totalprice)) < 2.842170943040401e-14) FROM orders
  UNION ALL SELECT 'float', count(*) FILTER (abs(o_totalprice - trunc(o_totalprice)) >= 2.842170943040401e-14) FROM orders""")
def events_histogram(spark, sf):
    df = table(spark, sf, "orders")
    df = df.select("o_orderkey", as_json(df).alias("j"))
    got = json_events(df, "o_orderkey", "j", WIDE).groupBy("event").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(x,) for x in ("begin_object", "end_object", "key", "string", "integer", "float")], "event string")
    return every.join(got, "event", "left").select("event", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH e(seq, event, key) AS (VALUES (0, 'begin_object', NULL), (1, 'key', 'n_nationkey'), (2, 'integer', NULL), (3, 'key', 'n_name'), (4, 'string', NULL), (5, 'key', 'n_regionkey'), (6, 'integer', NULL), (7, 'end_object', NULL))
  SELECT n_nationkey, seq, event, key, CASE seq WHEN 4 THEN n_name END AS str, CASE seq WHEN 2 THEN
  CAST(n_nationkey AS BIGINT) WHEN 6 THEN CAST(n_regionkey AS BIGINT) ELSE -1 END AS i, CASE WHEN seq IN (0, 7) THEN 0 ELSE 1 END AS depth
  FROM nation, e""")
def event_sequence(spark, sf):
    df = table(spark, sf, "nation")
    got = json_events(df.select("n_nationkey", as_json(df).alias("j")), "n_nationkey", "j", WIDE)
    return got.select(F.col("id").alias("n_nationkey"), "seq", "event", "key", "str", F.coalesce("i", F.lit(-1).cast("long")).alias("i"), "depth")


@query("SELECT event_id, CASE WHEN abs(value - trunc(value)) < 2.842170943040401e-14 THEN 'integer' ELSE 'float' END AS kind FROM events")
def integral_collapse(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.to_json(F.struct("value")).alias("j"))
    return parsed(df, "j").select("event_id", json_typeof(F.try_variant_get("v", "$.value", "variant")).alias("kind"))


def _range(bits: int, digits: int):
    top = (1 << (bits - 1)) - 1

    def run(spark, sf):
        number = (F.col("o_orderkey").cast("decimal(19,0)") * F.lit(10**digits).cast("decimal(18,0)")).cast("string")
        out = table(spark, sf, "orders").select("o_orderkey", json_check(number, Policy(int_bits=bits)).alias("r"))
        return out.select("o_orderkey", "r.ok", F.coalesce("r.err.code", F.lit(0)).alias("code"))

    query(f"SELECT o_orderkey, fits AS ok, CASE WHEN fits THEN 0 ELSE 12 END AS code FROM (SELECT o_orderkey, CAST(o_orderkey AS HUGEINT) * {10**digits} <= {top} AS fits FROM orders)", f"int_range_{bits}")(run)


_range(16, 1)
_range(32, 6)
_range(64, 15)


@query("SELECT event_id, false AS ok, 'number_out_of_range' AS error FROM events")
def no_float_policy(spark, sf):
    text = F.concat(F.format_string("%.1f", F.col("value")), F.lit("5"))
    out = table(spark, sf, "events").select("event_id", json_check(text, Policy(float=None)).alias("r"))
    return out.select("event_id", "r.ok", F.col("r.err.name").alias("error"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, round(l_extendedprice, 2) AS price FROM lineitem")
def array_pack_unpack(spark, sf):
    """Lines packed into an array per order, and unpacked again."""
    df = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice"))).alias("j"))
    each = json_each(parsed(df, "j").drop("j"), "v", value="m").drop("v")
    got = {k: json_get("m", n, kind) for k, n, kind in (("l_linenumber", "l_linenumber", "integer"), ("l_partkey", "l_partkey", "integer"), ("price", "l_extendedprice", "number"))}
    return each.select("l_orderkey", *(v.alias(k) for k, v in got.items())).withColumn("price", F.round("price", 2))


def _lines(spark, sf) -> DataFrame:
    df = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return df.groupBy("o_custkey").agg(F.to_json(F.collect_list("l_linenumber")).alias("j"))


@query("SELECT o_custkey, CAST(count(*) AS INTEGER) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def array_length(spark, sf):
    return parsed(_lines(spark, sf), "j").select("o_custkey", json_size("v").alias("n"))


@query("SELECT o_custkey, CASE WHEN count(*) > 40 THEN 'dom' END AS category, CASE WHEN count(*) > 40 THEN 1 ELSE 0 END AS code FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def array_cap(spark, sf):
    out = _lines(spark, sf).select("o_custkey", json_check("j", WIDE.but(max_array_size=40), values=True).alias("r"))
    return out.select("o_custkey", "r.err.category", F.coalesce("r.err.code", F.lit(0)).alias("code"))


def _wide_object() -> Column:
    return F.to_json(F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda x: F.concat(F.lit("k"), x.cast("string"))), F.sequence(F.lit(1), F.col("p_size"))))


@query("SELECT p_partkey, p_size <= 20 AS ok, CASE WHEN p_size > 20 THEN 'too_many_object_members' END AS error FROM part")
def object_cap(spark, sf):
    out = table(spark, sf, "part").select("p_partkey", json_check(_wide_object(), WIDE.but(max_object_size=20), values=True).alias("r"))
    return out.select("p_partkey", "r.ok", F.col("r.err.name").alias("error"))


@query("SELECT n_nationkey, 'n_name,n_nationkey,n_regionkey' AS keys, 3 AS n FROM nation")
def object_keys(spark, sf):
    df = table(spark, sf, "nation")
    df = parsed(df.select("n_nationkey", as_json(df).alias("j")), "j")
    return df.select("n_nationkey", F.array_join(json_keys("v"), ",").alias("keys"), json_size("v").alias("n"))


@query("SELECT o_orderkey, o_custkey AS a FROM orders")
def dup_key_last_wins(spark, sf):
    text = F.format_string('{"a":%d,"a":%d}', "o_orderkey", "o_custkey")
    return parsed(table(spark, sf, "orders").select("o_orderkey", text.alias("j")), "j").select("o_orderkey", json_get("v", "a", "integer").alias("a"))


@query("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def nested_lookup(spark, sf):
    region = table(spark, sf, "region").select("r_regionkey", F.struct("r_name").alias("region"))
    df = table(spark, sf, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    df = parsed(df.select("n_nationkey", F.to_json(F.struct("region")).alias("j")), "j")
    return df.select("n_nationkey", json_get(json_get("v", "region", "object"), "r_name", "string").alias("r_name"))


@query("""SELECT n_nationkey, k.* FROM nation, (VALUES ('a', 'null'), ('b', 'boolean'), ('c', 'integer'), ('d', 'float'), ('e', 'string'), ('f', 'array'), ('g', 'object'), ('h', 'integer')) AS k(key, kind)""")
def typeof_each(spark, sf):
    text = F.concat(F.lit('{"a":null,"b":true,"c":'), F.col("n_nationkey").cast("string"), F.lit(',"d":1.5,"e":"x","f":[],"g":{},"h":1e2}'))
    df = parsed(table(spark, sf, "nation").select("n_nationkey", text.alias("j")), "j")
    return json_each(df.drop("j"), "v", value="m").select("n_nationkey", "key", json_typeof("m").alias("kind"))


@query("SELECT c_custkey, true AS equal, true AS same_text, false AS other FROM customer")
def deep_equal_key_order(spark, sf):
    x, y = F.lit("x"), F.col("c_name")
    a = F.to_json(F.struct("c_custkey", F.array(x, y).alias("l")))
    b = F.to_json(F.struct(F.array(x, y).alias("l"), "c_custkey"))
    c = F.to_json(F.struct("c_custkey", F.array(y, x).alias("l")))
    return table(spark, sf, "customer").select("c_custkey", json_equal(a, b, WIDE).alias("equal"), json_equal(a, b, WIDE, tolerant=False).alias("same_text"), json_equal(a, c, WIDE).alias("other"))


@query("""WITH p AS (SELECT event_id, value AS a, value * (1 + (event_id % 3) * 2e-15) AS b FROM events)
SELECT event_id, a = b OR abs(a - b) < greatest(2.2250738585072014e-308, 16 * 2.220446049250313e-16 * (abs(a) + abs(b))) AS near FROM p""")
def float_tolerant_equal(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.col("value").alias("a"), (F.col("value") * (1 + (F.col("event_id") % 3) * 2e-15)).alias("b"))
    return df.select("event_id", json_is_close(F.col("a"), F.col("b")).alias("near"))


@query("SELECT event_id, event_id AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS old FROM events")
def set_member(spark, sf):
    df = parsed(table(spark, sf, "events"), "props")
    return df.select("event_id", json_get(json_set("v", "k", F.col("event_id")), "k", "integer").alias("k"), json_get(json_set("v", "x", F.col("event_id")), "k", "integer").alias("old"))


#: Per error: what is appended to props (with its last brace cut off, or whole), the policy, and how far behind the
#: start of what was appended the error lies.
_EDITS = {
    "bad_unicode_code_point": (True, ',"x":"\\ud834"}', WIDE, 12),
    "expected_array_member": (True, ',"x":[1 2]}', WIDE, 8),
    "expected_close_quote": (True, ',"x":"y', WIDE, 7),
    "expected_colon": (True, ',"x" 1}', WIDE, 5),
    "expected_digits": (True, ',"x":-', WIDE, 6),
    "expected_object_key": (True, ",}", WIDE, 1),
    "expected_object_member": (True, " 1}", WIDE, 1),
    "expected_token": (True, ',"x":?}', WIDE, 5),
    "invalid_escape_char": (True, ',"x":"\\q"}', WIDE, 7),
    "invalid_hex_char": (True, ',"x":"\\u00xf"}', WIDE, 10),
    "nesting_too_deep": (True, ',"x":' + "[" * 20 + "}", Policy(int_bits=64), 11),
    "number_out_of_range": (True, ',"x":1e400}', WIDE, 10),
    "unexpected_extra_input": (False, "x", WIDE, 0),
    "unrecognized_token": (True, ',"x":nul}', WIDE, 8),
    "string_too_long": (True, ',"x":"0123456789a"}', WIDE.but(max_length=10), 16),
    "too_many_array_members": (True, ',"x":[1,2,3]}', WIDE.but(max_array_size=2), 11),
    "too_many_object_members": (True, ',"x":1,"y":2}', WIDE.but(max_object_size=2), 12),
}


def _error(name: str, cut: bool, edit: str, policy: Policy, at: int, code: int) -> None:
    def run(spark, sf):
        base = F.expr("left(props, length(props) - 1)") if cut else F.col("props")
        out = table(spark, sf, "events").select("event_id", json_check(F.concat(base, F.lit(edit)), policy, values=True).alias("r"))
        return out.select("event_id", F.col("r.err.name").alias("error"), F.col("r.err.code").alias("code"), "r.pos.line", "r.pos.column")

    query(f"SELECT event_id, '{name}' AS error, {code} AS code, 1 AS line, CAST(length(props) - {int(cut)} + {at + 1} AS INTEGER) AS \"column\" FROM events", f"err_{name}")(run)


def _register_errors() -> None:
    from larkspur.errors import DOM, PARSER

    for name, (cut, edit, policy, at) in _EDITS.items():
        _error(name, cut, edit, policy, at, (PARSER | DOM)[name][0])


_register_errors()


@query("""SELECT event_id, false AS ok, 3 AS line, CAST(event_id % 3 + 1 AS INTEGER) AS "column" FROM events""")
def pos_multiline(spark, sf):
    line = F.element_at(F.array(F.lit("\n"), F.lit("\r"), F.lit("\r\n")), (F.col("event_id") % 3 + 1).cast("int"))
    text = F.concat(F.lit("["), line, F.lit("1,"), line, F.repeat(F.lit(" "), (F.col("event_id") % 3).cast("int")), F.lit("?]"))
    out = table(spark, sf, "events").select("event_id", json_check(text).alias("r"))
    return out.select("event_id", "r.ok", "r.pos.line", "r.pos.column")


@query("""SELECT CAST(n AS INTEGER) AS n, n <= 7 AS empty_ok, n <= 6 AS scalar_ok, n <= 6 AS space_ok FROM range(1, 11) AS t(n)""")
def depth_boundary(spark, sf):
    df = spark.range(1, 11).select(F.col("id").cast("int").alias("n"))
    nest = lambda inner: F.concat(F.repeat(F.lit("["), F.col("n")), F.lit(inner), F.repeat(F.lit("]"), F.col("n")))
    return df.select("n", json_valid(nest("")).alias("empty_ok"), json_valid(nest("1")).alias("scalar_ok"), json_valid(nest(" 1")).alias("space_ok"))


@query("SELECT n_nationkey, true AS equal FROM nation")
def whitespace_variants(spark, sf):
    compact = F.format_string('{"a":[%d,true],"b":"x"}', "n_nationkey")
    airy = F.format_string(' {\r\n"a"\t: [ %d ,\n\ttrue ] , "b" :"x" }\r', "n_nationkey")
    return table(spark, sf, "nation").select("n_nationkey", json_equal(compact, airy, WIDE).alias("equal"))


#: GOLDEN: (text, policy, error or None, tokens). The SQL restates these rows.
GOLDEN = {
    "number_cases": [
        ("0", Policy(), None, "0"), ("-0", Policy(), None, "0"), (" 1 ", Policy(), None, "1"), ("1234567890", Policy(), None, "1234567890"),
        ("01", Policy(), "unexpected_extra_input", "0"),
        ("-01", Policy(), "unexpected_extra_input", "0"), ("+1", Policy(), "expected_token", ""), (".1234", Policy(), "expected_token", ""),
        ("-", Policy(), "expected_digits", ""), ("--", Policy(), "unrecognized_token", ""),
        ("1Ex", Policy(), "unrecognized_token", ""), ("1..", Policy(), "unrecognized_token", ""), ("1.E", Policy(), "unrecognized_token", ""),
        ("3.1415", Policy(), None, "3.1415"), ("-0.45", Policy(), None, "-0.45"),
        ("0e2", Policy(), None, "0"), ("1e2", Policy(), None, "100"), ("1e+2", Policy(), None, "100"), ("1E-02", Policy(), None, "0.01"),
        ("123123e100000", Policy(), "number_out_of_range", ""),
        ("9999E999", Policy(), "number_out_of_range", ""), ("123e-10000000", Policy(), "number_out_of_range", ""),
        ("9223372036854775807", Policy(int_bits=64), None, "9223372036854775807"),
        ("-9223372036854775808", Policy(int_bits=64), None, "-9223372036854775808"),
        ("9223372036854775808", Policy(int_bits=64), "number_out_of_range", ""), ("2147483648", Policy(), "number_out_of_range", ""),
        ("-2147483648", Policy(), None, "-2147483648"), ("32768", Policy(int_bits=16), "number_out_of_range", ""),
        ("-32768", Policy(int_bits=16), None, "-32768"),
        ("123456789012345678901234567890", Policy(int_bits=128), None, "123456789012345678901234567890"),
        ("1.2", Policy(float=None), "number_out_of_range", ""), ("1e30", Policy(float=None), "number_out_of_range", ""),
    ],
    "escape_cases": [
        (r'"a\n"', Policy(), None, '"a\n"'), (r'"a\qb"', Policy(), "invalid_escape_char", ""), (r'"\u002F"', Policy(), None, '"/"'),
        (r'"\/"', Policy(), None, '"/"'), (r'"\u00af"', Policy(), None, '"\u00af"'),
        (r'"\u0009"', Policy(), None, '"\t"'), ('"\t"', Policy(), "bad_unicode_code_point", ""), (r'"\u00xf"', Policy(), "invalid_hex_char", ""),
        (r'"\u00', Policy(), "expected_close_quote", ""), (r'"\0"', Policy(), "invalid_escape_char", ""),
        ('"0123456789"', Policy(max_length=10), None, '"0123456789"'), ('"01234567890"', Policy(max_length=10), "string_too_long", ""),
        (r'"0123456789\u0030"', Policy(max_length=10), "string_too_long", ""),
        (r'"0123456789\n"', Policy(max_length=10), "string_too_long", ""),
    ],
    "surrogate_cases": [
        (r'"\uD834\uDD1E"', Policy(), None, '"\U0001d11e"'), (r'"\u214B\u30A1"', Policy(), None, '"\u214b\u30a1"'), (r'"\uFFFF"', Policy(), None, '"\uffff"'), (r'"\uD834\u30A1"', Policy(), "bad_unicode_code_point", ""),
        (r'"\uD834!"', Policy(), "bad_unicode_code_point", ""), (r'"\uDD1E\u30A1"', Policy(), "bad_unicode_code_point", ""),
        (r'"\uD800\uD800"', Policy(), "bad_unicode_code_point", ""), (r'"\uD834"', Policy(), "bad_unicode_code_point", ""),
        (r'"0123456789\uD834\uDD1E"', Policy(max_length=10), "string_too_long", ""),
    ],
}


def _golden(name: str, cases: list) -> None:
    def run(spark, sf):
        parts = []
        for policy in dict.fromkeys(c[1] for c in cases):
            rows = [(i, c[0]) for i, c in enumerate(cases) if c[1] == policy]
            df = spark.createDataFrame(rows, "case_id int, j string")
            tokens = json_render(json_events(df, "case_id", "j", policy)).withColumnRenamed("id", "case_id")
            out = df.select("case_id", json_check("j", policy).alias("r")).join(tokens, "case_id", "left")
            parts.append(out.select("case_id", F.col("r.err.name").alias("error"), F.coalesce("tokens", F.lit("")).alias("tokens")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    text = lambda s: "NULL" if s is None else "'" + "' || chr(10) || '".join("' || chr(9) || '".join(x.replace("'", "''") for x in line.split("\t")) for line in s.split("\n")) + "'"
    rows = ", ".join(f"({i}, {text(c[2])}, {text(c[3])})" for i, c in enumerate(cases))
    query(f"SELECT * FROM (VALUES {rows}) AS t(case_id, error, tokens)", name)(run)


for _name, _cases in GOLDEN.items():
    _golden(_name, _cases)


@query("SELECT doc_id, true AS whole, true AS ok, md5(text) AS md5 FROM documents")
def chunk_assembly(spark, sf):
    """Documents cut every 1000 bytes, inside characters or not, dealt out, put together and checked."""
    df = table(spark, sf, "documents")
    pieces = split_chunks(df.select("doc_id", as_json(df, "text").alias("j")), "doc_id", "j", 1000)
    got = json_assemble(pieces, "id", "seq", "chunk")
    got = got.select("id", "whole", F.col("text").cast("string").alias("j"))
    return parsed(got, "j").select(F.col("id").alias("doc_id"), "whole", F.col("v").isNotNull().alias("ok"), F.md5(json_get("v", "text", "string").cast("binary")).alias("md5"))


@query("""SELECT user_id AS id, event_id % 4 <> 1 AS ok, CASE WHEN event_id % 4 = 1 THEN 'expected_object_member' END AS error,
  CAST(length(props) - CAST(event_id % 4 = 1 AS INTEGER) + 1 AS INTEGER) AS "column",
  CAST(ceil((length(props) - CAST(event_id % 4 = 1 AS INTEGER)) / 4.0) AS INTEGER) AS chunks
  FROM (SELECT event_id, event_id AS user_id, props FROM events)""")
def stream_check(spark, sf):
    """A stream of documents in chunks of 4 bytes; every fourth lacks its last brace."""
    events = spark.readStream.schema("event_id long, props string").parquet(f"{sf}/events*.parquet")
    text = F.when(F.col("event_id") % 4 == 1, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    pieces = split_chunks(events.withColumn("j", text), "event_id", "j", 4)
    out = finished(check_stream(pieces, WIDE))
    return out.select("id", "ok", "error", "column", "chunks")


@query("""SELECT n_nationkey, '{ "n_nationkey" ' || n_nationkey || ' "n_name" "' || n_name || '" "n_regionkey" ' || n_regionkey || ' }' AS tokens
  FROM nation""")
def render_tokens(spark, sf):
    df = table(spark, sf, "nation")
    out = json_render(json_events(df.select("n_nationkey", as_json(df).alias("j")), "n_nationkey", "j", WIDE))
    return out.select(F.col("id").alias("n_nationkey"), "tokens")


@query("SELECT 'OBJECT<k: BIGINT>' AS schema")
def variant_agg_schema(spark, sf):
    return parsed(table(spark, sf, "events"), "props").agg(F.schema_of_variant_agg("v").alias("schema"))


# relational operators over extracted members


def _orders(spark, sf) -> DataFrame:
    """Orders as documents, with the members that the queries below read."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    text = as_json(df, "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    kinds = {"o_orderkey": "integer", "o_custkey": "integer", "o_totalprice": "number", "o_orderpriority": "string"}
    m = df.select("o_orderdate", json_members(text, kinds, WIDE).alias("m"))
    out = {"okey": F.col("m.o_orderkey"), "ckey": F.col("m.o_custkey"), "price": F.round("m.o_totalprice", 2), "priority": F.col("m.o_orderpriority")}
    return m.select("o_orderdate", *(c.alias(k) for k, c in out.items()))


def _events(spark, sf) -> DataFrame:
    """Events with the member k of their properties."""
    df = table(spark, sf, "events")
    return df.select("event_id", "ts", "user_id", "event_type", "value", json_members("props", {"k": "integer"}, WIDE)["k"].alias("k"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(round(o_totalprice, 2)), 1) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_json_keys(spark, sf):
    df = _orders(spark, sf).join(table(spark, sf, "customer"), F.col("ckey") == F.col("c_custkey"))
    return df.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("price"), 1).alias("total"))


@query("SELECT o_orderkey AS okey, round(o_totalprice, 2) AS price FROM orders ORDER BY 2 DESC, 1 LIMIT 25")
def topk_json(spark, sf):
    return _orders(spark, sf).select("okey", "price").orderBy(F.desc("price"), "okey").limit(25)


@query("SELECT o_orderkey AS okey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, 2) DESC, o_orderkey) AS INTEGER) AS place FROM orders")
def window_json(spark, sf):
    order = Window.partitionBy("ckey").orderBy(F.desc("price"), "okey")
    return _orders(spark, sf).select("okey", F.row_number().over(order).alias("place"))


@query("SELECT o_orderpriority AS priority, CAST(year(o_orderdate) AS VARCHAR) AS y, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, year(o_orderdate))")
def rollup_json(spark, sf):
    return _orders(spark, sf).withColumn("y", F.year("o_orderdate").cast("string")).rollup("priority", "y").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS ckey FROM customer EXCEPT SELECT o_custkey FROM orders")
def setop_json(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("ckey")).exceptAll(_orders(spark, sf).select("ckey").distinct())


@query("SELECT date_trunc('hour', ts) AS start, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k FROM events GROUP BY 1")
def tumbling_json(spark, sf):
    df = _events(spark, sf)
    return df.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("k").alias("sum_k")).select(F.col("w.start").alias("start"), "n", "sum_k")


@query("""WITH e AS (SELECT user_id, ts, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM b)
SELECT user_id, min(ts) AS start, count(*) AS n, CAST(sum(k) AS BIGINT) AS sum_k FROM s GROUP BY user_id, s""")
def session_json(spark, sf):
    df = _events(spark, sf)
    sums = df.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"))
    return sums.select("user_id", F.col("w.start").alias("start"), "n", "sum_k")
