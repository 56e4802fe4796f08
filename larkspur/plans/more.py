"""Further queries: policies and types, handlers, pieces, SQL, and the relational operators over extracted members."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.checker import Handler
from larkspur.functions import json_check, json_each, json_equal, json_get, json_make, json_number, json_parse, json_typeof, json_valid
from larkspur.operators import accumulate, asof_join, json_events, json_tokens, range_join, register_json_events
from larkspur.plans.catalogue import WIDE, _events, _orders, as_json, parsed, query, table
from larkspur.policy import Policy
from larkspur.sources import read_documents, read_lines, split_chunks, write_documents
from larkspur.storage import fresh_path
from larkspur.streaming import finished, stream_accumulate, stream_events, stream_progress

# types and policies


@query("""WITH t AS (SELECT event_id, CAST(event_id % 50 AS VARCHAR) || s AS j FROM events, (VALUES ('.99999999999999'), ('.00000000000001'), ('.0000000000001'), ('.5')) AS v(s))
SELECT event_id, j, CASE WHEN abs(CAST(j AS DOUBLE) - trunc(CAST(j AS DOUBLE))) < 2.842170943040401e-14 THEN 'integer' ELSE 'float' END AS kind
  FROM t""")
def typeof_near_whole(spark, sf):
    """Floats next to a whole number: only the fraction towards zero counts."""
    ends = F.explode(F.array(*map(F.lit, (".99999999999999", ".00000000000001", ".0000000000001", ".5"))))
    df = table(spark, sf, "events").select("event_id", ends.alias("s"))
    df = df.select("event_id", F.concat((F.col("event_id") % 50).cast("string"), "s").alias("j"))
    return df.select("event_id", "j", json_typeof(json_parse("j", WIDE), WIDE).alias("kind"))


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 40000 * 100000 + 1 AS v FROM orders)
SELECT o_orderkey, CASE WHEN v <= 32767 THEN v END AS i16, CASE WHEN v <= 2147483647 THEN v END AS i32, v AS i64,
  CAST(v AS VARCHAR) AS i128, CAST(CAST(v AS FLOAT) AS BIGINT) AS whole_float,
  CASE WHEN v > 2147483647 THEN CAST(v AS DOUBLE) END AS f32, CAST(CAST(v AS HUGEINT) * 100000000000000000000 AS VARCHAR) AS big FROM t""")
def get_under_policies(spark, sf):
    """A whole float under integers of each width, and under single precision; integers of 128 bits."""
    value = F.col("o_orderkey") % 40_000 * 100_000 + 1  # digits before the point that overflow 32 bits would be an error
    df = table(spark, sf, "orders").select("o_orderkey", F.concat(value.cast("string"), F.lit(".0")).alias("j"), F.concat(value.cast("string"), F.lit("0" * 20)).alias("n"))
    under = lambda p, kind="integer", c="j": json_get(json_parse(c, p), None, kind, p)
    i16, i32, i64, i128 = (Policy(int_bits=b) for b in (16, 32, 64, 128))
    return df.select(
        "o_orderkey", under(i16).alias("i16"), under(i32).alias("i32"), under(i64).alias("i64"), under(i128).cast("string").alias("i128"),
        under(Policy(int_bits=64, float="float")).alias("whole_float"), under(i32, "float").alias("f32"), under(i128, "integer", "n").cast("string").alias("big"),
    )


@query("""SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS integer, 'float' AS float_kind, n_name AS string, 'true' AS boolean, 'null' AS "null", '[' || n_nationkey || ',1]' AS "array",
  '{"n":"' || n_name || '"}' AS object, '[] {} "" 0 false' AS empty FROM nation""")
def make_values(spark, sf):
    """Values made from columns, and the empty ones."""
    text = lambda v: F.to_json(v)
    n, name = F.col("n_nationkey"), F.col("n_name")
    empty = F.concat_ws(" ", *(text(json_make(k)) for k in ("array", "object", "string", "integer", "boolean")))
    made = {"array": F.array(n, F.lit(1)), "object": F.struct(name.alias("n")), "integer": n, "boolean": n >= 0}
    out = {k: text(json_make(k, v)) for k, v in made.items()}
    return table(spark, sf, "nation").select(
        "n_nationkey", *(v.alias(k) for k, v in out.items()), json_get(json_make("string", name), None, "string").alias("string"),
        json_typeof(json_make("float", n + 0.5)).alias("float_kind"), text(json_make("null")).alias("null"), empty.alias("empty"),
    )


@query("SELECT event_id, true AS ok, event_id % 2 = 0 AS utf8_ok, event_id % 2 = 0 AS strict, true AS lax FROM events")
def malformed_utf8(spark, sf):
    """Every other text has a byte in a string that is no UTF-8: replaced and told, or refused."""
    byte = F.when(F.col("event_id") % 2 == 1, F.lit(b"\xff")).otherwise(F.lit(b"\xc3\xa9"))
    text = F.concat(F.lit(b'{"a":"'), byte, F.lit(b'"}'))
    df = table(spark, sf, "events").select("event_id", text.alias("j"))
    out = df.select("event_id", json_check("j").alias("r"), json_valid("j", strict_utf8=True).alias("strict"), json_valid("j").alias("lax"))
    return out.select("event_id", "r.ok", "r.utf8_ok", "strict", "lax")


@query("SELECT n_nationkey, false AS ok, 'too_many_object_members' AS error, n_nationkey % 2 = 0 AS below FROM nation")
def duplicate_key_at_cap(spark, sf):
    """A key that is there already counts against the cap all the same: it is looked at before the member is put in."""
    text = F.format_string('{"a":1,"b":2,"a":%d}', "n_nationkey")
    one = F.when(F.col("n_nationkey") % 2 == 0, F.lit('{"a":1,"a":2}')).otherwise(F.lit('{"a":1,"b":1,"c":2}'))
    cap = WIDE.but(max_object_size=2)
    df = table(spark, sf, "nation").select("n_nationkey", json_check(text, cap, values=True).alias("r"), json_valid(one, cap, values=True).alias("below"))
    return df.select("n_nationkey", "r.ok", F.col("r.err.name").alias("error"), "below")


@query("SELECT n_nationkey, '{\"a\":' || n_nationkey || '}' AS inner_, '[1,2]' AS flat, n_nationkey AS whole FROM nation")
def parse_partial(spark, sf):
    """What was read of the innermost open array or object when a text breaks off."""
    broken = F.format_string('[0,{"a":%d,"b":', "n_nationkey")
    df = table(spark, sf, "nation").select("n_nationkey", broken.alias("j"), F.col("n_nationkey").cast("string").alias("s"))
    part = lambda c: json_parse(c, WIDE, partial=True)
    return df.select("n_nationkey", F.to_json(part("j")).alias("inner_"), F.to_json(part(F.lit("[1,2,?"))).alias("flat"), json_get(part("s"), None, "integer").cast("int").alias("whole"))


@query("SELECT n_nationkey, true AS nulls, true AS null_member, false AS null_or_zero, CAST(NULL AS BOOLEAN) AS broken FROM nation")
def null_equality(spark, sf):
    null, n = F.lit("null"), F.col("n_nationkey").cast("string")
    member = F.concat(F.lit('{"a":null,"n":'), n, F.lit("}"))
    other = F.concat(F.lit('{"n":'), n, F.lit(',"a":null}'))
    cases = {"nulls": (null, F.lit(" null ")), "null_member": (member, other), "null_or_zero": (null, F.lit("0")), "broken": (null, F.lit("nul"))}
    return table(spark, sf, "nation").select("n_nationkey", *(json_equal(a, b, WIDE).alias(k) for k, (a, b) in cases.items()))


@query("""SELECT n_nationkey, '[|' || n_nationkey || '|,|-1.5e3|,|"a b"|,|true|]' AS tokens, CAST(NULL AS VARCHAR) AS broken FROM nation""")
def lexical_tokens(spark, sf):
    text = F.format_string('[ %d, -1.5e3,\n"a b" ,true]', "n_nationkey")
    broken = F.format_string("[%d, 1.]", "n_nationkey")
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(json_tokens(text), "|").alias("tokens"), F.array_join(json_tokens(broken), "|").alias("broken"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'float' WHEN 2 THEN 'integer' END AS kind,
  CASE event_id % 4 WHEN 0 THEN event_id WHEN 2 THEN event_id * 100 END AS i,
  CASE event_id % 4 WHEN 1 THEN event_id + 0.5 END AS f, CASE event_id % 4 WHEN 3 THEN 'number_out_of_range' END AS error FROM events""")
def number_tokens(spark, sf):
    """Number tokens read by an expression: integers, floats, whole floats, and what is out of range."""
    n = F.col("event_id").cast("string")
    kind = F.col("event_id") % 4
    token = F.when(kind == 0, n).when(kind == 1, F.concat(n, F.lit(".5"))).when(kind == 2, F.concat(n, F.lit("e2"))).otherwise(F.concat(n, F.lit("e400")))
    out = table(spark, sf, "events").select("event_id", json_number(token, WIDE).alias("r"))
    return out.select("event_id", "r.*")


@query("""WITH e(seq, event, depth) AS (VALUES (0, 'begin_array', 0), (1, 'boolean', 1), (2, 'null', 1), (3, 'begin_object', 1), (4, 'key', 2), (5, 'begin_array', 2), (6, 'integer', 3), (7, 'end_array', 2), (8, 'end_object', 1), (9, 'boolean', 1), (10, 'end_array', 0))
SELECT n_nationkey, seq, event, depth, CASE seq WHEN 1 THEN true WHEN 9 THEN false END AS b,
  CASE seq WHEN 6 THEN CAST(n_nationkey AS BIGINT) END AS i FROM nation, e""")
def event_kinds(spark, sf):
    df = table(spark, sf, "nation").select("n_nationkey", F.format_string('[true,null,{"n":[%d]},false]', "n_nationkey").alias("j"))
    return json_events(df, "n_nationkey", "j", WIDE).select(F.col("id").alias("n_nationkey"), "seq", "event", "depth", "b", "i")


class _Sum(Handler):
    """Adds up integers; one segment is not welcome."""

    def __init__(self):
        self.total = 0

    def integer(self, value):
        self.total += value

    def string(self, value):
        return "unwelcome" if value == "BUILDING" else None

    def result(self):
        return self.total


@query("""SELECT c_custkey, c_mktsegment <> 'BUILDING' AS ok, CASE WHEN c_mktsegment = 'BUILDING' THEN 'user' END AS category,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'unwelcome' END AS error,
  c_custkey + CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_nationkey END AS result FROM customer""")
def accumulate_user_error(spark, sf):
    """A user's handler, with an error of its own, over each text."""
    df = table(spark, sf, "customer")
    df = df.select("c_custkey", as_json(df, "c_custkey", "c_mktsegment", "c_nationkey").alias("j"))
    out = accumulate(df, "c_custkey", "j", _Sum, "long", WIDE)
    return out.select(F.col("id").alias("c_custkey"), "ok", F.col("err.category").alias("category"), F.col("err.name").alias("error"), "result")


@query("SELECT event_id, true AS before_, event_id % 3 = 0 AS same FROM events")
def position_order(spark, sf):
    """Positions compare by line, then column."""
    lines = F.repeat(F.lit("\n"), (F.col("event_id") % 3).cast("int"))
    first, second = json_check(F.lit("[1 2]"))["pos"], json_check(F.concat(F.lit("["), lines, F.lit("1 2 ]")))["pos"]
    both = table(spark, sf, "events").select("event_id", first.alias("a"), second.alias("b"))
    return both.select("event_id", (F.col("a") <= F.col("b")).alias("before_"), (F.col("a") == F.col("b")).alias("same"))


# pieces and streams


def _pieces(spark, sf, name: str, schema: str, id_: str, text, size: int) -> DataFrame:
    rows = spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")
    return split_chunks(rows.withColumn("j", text), id_, "j", size)


@query("""WITH e(seq, event) AS (VALUES (0, 'begin_object'), (1, 'key'), (2, 'integer'), (3, 'end_object'))
SELECT event_id AS id, seq, event, CASE seq WHEN 1 THEN 'k' END AS key, CASE seq WHEN 2 THEN
  CAST(json_extract(props, '$.k') AS BIGINT) END AS i, CAST(seq IN (1, 2) AS INTEGER) AS depth
  FROM events, e""", name="stream_events")
def _stream_events(spark, sf):
    """Events of documents that arrive in chunks of three bytes."""
    pieces = _pieces(spark, sf, "events", "event_id long, props string", "event_id", F.col("props"), 3)
    return finished(stream_events(pieces, WIDE)).select("id", "seq", "event", "key", "i", "depth")


@query("""SELECT c_custkey AS id, c_mktsegment <> 'BUILDING' AS ok, CASE WHEN c_mktsegment = 'BUILDING' THEN 'unwelcome' END AS error,
  c_custkey + CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_nationkey END AS result FROM customer""", name="stream_accumulate")
def _stream_accumulate(spark, sf):
    """The user's handler, fed chunk by chunk and kept in the state between chunks."""
    schema = "c_custkey long, c_nationkey int, c_mktsegment string"
    text = F.to_json(F.struct("c_custkey", "c_mktsegment", "c_nationkey"))
    out = finished(stream_accumulate(_pieces(spark, sf, "customer", schema, "c_custkey", text, 10), _Sum, T.LongType(), WIDE))
    return out.select("id", "ok", "error", "result")


@query("""SELECT event_id AS id, false AS ended, 2 AS token_line, 2 AS token_column, 2 AS line,
  CAST(2 + length(CAST(event_id AS VARCHAR)) AS INTEGER) AS "column",
  CAST(ceil((3 + length(CAST(event_id AS VARCHAR))) / 2.0) AS INTEGER) AS chunks FROM events""", name="stream_progress")
def _stream_progress(spark, sf):
    """Where the token begins that is being read, and where input has come to, while more may follow."""
    pieces = _pieces(spark, sf, "events", "event_id long", "event_id", F.concat(F.lit("[\n "), F.col("event_id").cast("string")), 2)
    out = finished(stream_progress(pieces.withColumn("is_last", F.lit(False)), WIDE))
    return out.select("id", "ended", "token_line", "token_column", "line", "column", "chunks")


@query("""WITH e AS (SELECT ts, event_id % 10 = 0 AS late, event_id % 10 > 1 AS early, date_trunc('hour', ts) + INTERVAL 1 HOUR AS end_
  FROM events),
w AS (SELECT date_trunc('milliseconds', max(ts) FILTER (early)) - INTERVAL 10 MINUTE AS first,
  date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS last FROM e)
SELECT end_ - INTERVAL 1 HOUR AS start, count(*) AS n FROM e, w WHERE end_ <= last AND (NOT late OR end_ > first) GROUP BY 1""")
def late_data(spark, sf):
    """Windows under a watermark: the last of three batches comes when the first one's watermark has passed most of it."""
    folder = fresh_path(spark, "late")
    df = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    for batch in (">", "=", "<"):  # three files, each newer than the one before
        df.where(f"event_id % 10 {batch} 1").coalesce(1).write.mode("append").parquet(folder)
    rows = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = rows.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return finished(out).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT o_orderkey, md5('{\"o_orderkey\":' || o_orderkey || '}') AS md5, (SELECT count(*) FROM orders) AS n_lines, true AS whole FROM orders")
def files_roundtrip(spark, sf):
    """Texts written as lines, read again by line, and as whole files."""
    path = fresh_path(spark, "lines")
    write_documents(table(spark, sf, "orders").select(F.to_json(F.struct("o_orderkey")).alias("j")), "j", path)
    lines = read_lines(spark, path)
    whole = read_documents(spark, path + "/part-*")
    n = whole.select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("l")).where("l <> ''").count()
    out = lines.select(json_get(json_parse("text", WIDE), "o_orderkey", "integer", WIDE).alias("o_orderkey"), F.md5("text").alias("md5"))
    return out.select("o_orderkey", "md5", F.lit(n).cast("long").alias("n_lines"), F.lit(n == lines.count()).alias("whole"))


# SQL


@query("""SELECT r_name, 3 * count(*) AS n_keys, sum(CAST(n_nationkey AS BIGINT)) AS sum_key
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey IN (SELECT min(r_regionkey)
  FROM region UNION SELECT max(r_regionkey) FROM region) GROUP BY 1""")
def sql_views(spark, sf):
    """Views, a table function with LATERAL, a common table expression and subqueries, in SQL."""
    register_json_events(spark, "larkspur_events", WIDE)
    df = table(spark, sf, "nation")
    df.select("n_regionkey", as_json(df).alias("j")).createOrReplaceTempView("larkspur_nation")
    table(spark, sf, "region").createOrReplaceTempView("larkspur_region")
    return spark.sql("""
        WITH e AS (SELECT n.n_regionkey, e.* FROM larkspur_nation n, LATERAL larkspur_events(n.j) e),
        k AS (SELECT n_regionkey, key, lead(i) OVER (PARTITION BY n_regionkey, j ORDER BY seq) AS i, event
              FROM (SELECT n.n_regionkey, n.j, e.* FROM larkspur_nation n, LATERAL larkspur_events(n.j) e))
        SELECT r.r_name, (SELECT count(*) FROM e WHERE e.n_regionkey = r.r_regionkey AND e.event = 'key') AS n_keys,
          (SELECT sum(i) FROM k WHERE k.n_regionkey = r.r_regionkey AND k.key = 'n_nationkey') AS sum_key
        FROM larkspur_region r
        WHERE r.r_regionkey IN (SELECT min(r_regionkey) FROM larkspur_region UNION SELECT max(r_regionkey) FROM larkspur_region)""")


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50 AND event_type = 'view'")
def filter_member(spark, sf):
    return _events(spark, sf).where("k > 50 AND event_type = 'view'").select("event_id")


# joins


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join_json(spark, sf):
    dear = _orders(spark, sf).where("price > 300000").select(F.col("ckey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(dear, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_json(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(_orders(spark, sf).select(F.col("ckey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT c_custkey, count(o_orderkey) AS n, round(max(o_totalprice), 2) AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def outer_join_json(spark, sf):
    orders = _orders(spark, sf).groupBy(F.col("ckey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("price").alias("top"))
    return table(spark, sf, "customer").select("c_custkey").join(orders, "c_custkey", "left").fillna(0, ["n"])


@query("""SELECT p.event_id, v.event_id AS view_id, CAST(json_extract(v.props, '$.k') AS BIGINT) AS k
  FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_join_json(spark, sf):
    """For each purchase the user's last view before it."""
    events = _events(spark, sf)
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), "k")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return asof_join(bought, views, "ts", ["user_id"], ["view_id", "k"]).select("event_id", "view_id", "k")


@query("""SELECT low, count(*) AS n FROM events JOIN (SELECT range * 25 AS low, range * 25 + 30 AS high
  FROM range(4)) ON CAST(json_extract(props, '$.k') AS BIGINT) >= low AND CAST(json_extract(props, '$.k') AS BIGINT) < high
  GROUP BY 1""")
def range_join_json(spark, sf):
    """Members within overlapping ranges."""
    bands = spark.range(4).select((F.col("id") * 25).alias("low"), (F.col("id") * 25 + 30).alias("high"))
    return range_join(_events(spark, sf).select("k"), bands, "k", "low", "high", 25).groupBy("low").agg(F.count("*").alias("n"))


# aggregation, windows, sets


@query("SELECT o_orderpriority AS priority, CAST(year(o_orderdate) AS VARCHAR) AS y, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, year(o_orderdate))")
def cube_json(spark, sf):
    return _orders(spark, sf).withColumn("y", F.year("o_orderdate").cast("string")).cube("priority", "y").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS priority, CAST(year(o_orderdate) AS VARCHAR) AS y, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (year(o_orderdate)))")
def grouping_sets_json(spark, sf):
    df = _orders(spark, sf).withColumn("y", F.year("o_orderdate").cast("string"))
    return df.groupingSets([["priority"], ["y"]], "priority", "y").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) AS n_k FROM events GROUP BY 1")
def distinct_json(spark, sf):
    return _events(spark, sf).groupBy("event_type").agg(F.countDistinct("k").alias("n_k"))


@query("SELECT count(*) > 0 AS n_ok, true AS distinct_ok, true AS median_ok FROM events")
def approximate_json(spark, sf):
    """Approximate aggregates within their stated errors of the exact ones."""
    df = _events(spark, sf).select("k", (F.col("user_id") * 1000 + F.col("k")).alias("pair"))
    exact = [F.count("*").alias("n"), F.countDistinct("pair").alias("d"), F.median("k").alias("m")]
    near = [F.approx_count_distinct("pair", 0.02).alias("ad"), F.percentile_approx("k", 0.5, 1000).alias("am")]
    got = df.agg(*exact, *near)
    ok = {"n_ok": F.col("n") > 0, "distinct_ok": F.abs(F.col("ad") - F.col("d")) <= 0.08 * F.col("d"), "median_ok": F.abs(F.col("am") - F.col("m")) <= 1}
    return got.select(*(c.alias(k) for k, c in ok.items()))


@query("""WITH e AS (SELECT event_id, user_id, ts, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CAST(sum(k) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS three,
  CAST(sum(k) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS hour,
  lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_, CAST(ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS quarter
  FROM e""")
def window_frames(spark, sf):
    by = Window.partitionBy("user_id")
    line, clock = by.orderBy("ts", "event_id"), by.orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    sums = {"three": F.sum("k").over(line.rowsBetween(-2, 0)), "hour": F.sum("k").over(clock)}
    places = {"before_": F.lag("k").over(line), "quarter": F.ntile(4).over(line)}
    return _events(spark, sf).select("event_id", *(c.alias(k) for k, c in (sums | places).items()))


@query("SELECT DISTINCT start, n FROM (SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1)")
def sliding_json(spark, sf):
    return _events(spark, sf).groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("k").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("""SELECT o_custkey AS ckey FROM orders WHERE o_totalprice > 250000 INTERSECT SELECT o_custkey
  FROM orders WHERE o_totalprice < 100000""")
def intersect_json(spark, sf):
    orders = _orders(spark, sf)
    return orders.where("price > 250000").select("ckey").intersect(orders.where("price < 100000").select("ckey"))


@query("SELECT c_custkey AS ckey, 'customer' AS side FROM customer UNION SELECT o_custkey, 'order' FROM orders")
def union_json(spark, sf):
    side = partial(lambda df, name: df.withColumn("side", F.lit(name)))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("ckey"))
    return side(customers, "customer").union(side(_orders(spark, sf).select("ckey"), "order")).distinct()


@query("SELECT event_id, k FROM (SELECT event_id, unnest([1, 2, CAST(json_extract(props, '$.k') AS BIGINT)]) AS k FROM events)")
def explode_members(spark, sf):
    """Array members of a nested document as rows."""
    text = F.concat(F.lit("[1,2,"), F.get_json_object("props", "$.k"), F.lit("]"))
    df = parsed(table(spark, sf, "events").select("event_id", text.alias("j")), "j")
    return json_each(df.drop("j"), "v", value="m").select("event_id", json_get("m", None, "integer", WIDE).alias("k"))
