"""Columns, operators, sources and streaming on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from larkspur.checker import Document, Handler, Recorder, number_value, parse, position
from larkspur.functions import (
    allow_duplicate_keys,
    format_position,
    json_check,
    json_equal,
    json_get,
    json_keys,
    json_make,
    json_members,
    json_number,
    json_parse,
    json_set,
    json_size,
    json_text,
    json_typeof,
    json_valid,
)
from larkspur.functions.native import flat, surely_valid
from larkspur.operators import accumulate, asof_join, json_assemble, json_events, json_render, json_tokens, range_join, register_json_events
from larkspur.pieces import Reader
from larkspur.policy import Policy
from larkspur.sources import read_documents, read_lines, split_chunks, write_documents
from larkspur.storage import cleanup, fresh_path
from larkspur.streaming import check_stream, stream_accumulate, stream_events, stream_progress

WIDE = Policy.relaxed()


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, j string")


def test_check_and_valid(spark):
    df = frame(spark, '{"a":1}', "[1,]", None, "")
    got = df.select("id", json_check("j").alias("r"), json_valid("j").alias("v")).orderBy("id").collect()
    assert [None if r.r is None else r.r.ok for r in got] == [r.v for r in got] == [True, False, None, False]
    assert got[1].r.err.asDict() == {"category": "parser", "code": 8, "name": "expected_token", "message": "expected token"}
    assert (got[1].r.pos.line, got[1].r.pos.column) == (1, 4)
    bad = df.select(json_check(F.lit(b'"\xff"')).alias("r")).first().r
    assert bad.utf8_ok is False
    assert df.select(json_check("j", Policy(positions=False)).alias("r")).first().r.pos is None


def test_values(spark):
    allow_duplicate_keys(spark)
    df = frame(spark, '{"a":1,"a":2.0,"b":"7","c":[1,2],"d":null,"it\'s":1.5,"e":true}', '{"a":1}x', "[3]", "5").withColumn("v", json_parse("j", WIDE))
    r = df.select(
        json_get("v", "a", "integer").alias("a"), json_get("v", "b", "integer").alias("b"), json_get("v", "b", "string").alias("bs"), json_get("v", "d", "null").alias("d"),
        json_get("v", "it's", "float").alias("q"), json_get("v", "e", "boolean").alias("e"), json_size(json_get("v", "c", "array")).alias("c"), json_keys("v").alias("k"), json_typeof("v").alias("t"),
        json_get("v", 0, "integer").alias("zero"), json_get(json_set("v", "a", F.lit("new")), "a", "string").alias("put"),
    ).collect()
    assert (r[0].a, r[0].b, r[0].bs, r[0].d, r[0].q, r[0].e, r[0].c) == (2, None, "7", True, 1.5, True, 2)
    assert r[0].k == ["a", "b", "c", "d", "e", "it's"] and r[0].put == "new"
    assert [x.t for x in r] == ["object", None, "array", "integer"] and r[2].zero == 3
    part = frame(spark, '{"a":1,"b":2)').select(json_parse("j", WIDE, partial=True).cast("string").alias("p")).first()
    assert json.loads(part.p) == {"a": 1, "b": 2}


def test_equal_and_text(spark):
    df = spark.createDataFrame([('{"a":[1,2],"b":1.0}', '{"b":1,"a":[1,2]}'), ("[1,2]", "[2,1]"), ("1", '"1"'), ("0.1", "0.10000000000000002"), ("[", "[]")], "x string, y string")
    got = df.select(json_equal("x", "y", WIDE).alias("e"), json_text("x", WIDE).alias("t")).collect()
    assert [r.e for r in got] == [True, False, False, True, None]
    assert got[0].t == '{"a":[1,2],"b":1}' and got[4].t is None


def test_events_render_tokens_accumulate(spark):
    df = frame(spark, ' {"size" :17,\n"tags":["red",null] ,"old": true} ', "[1 , ]", None)
    events = json_events(df, "id", "j")
    assert [r.event for r in events.where("id = 1").orderBy("seq").collect()] == ["begin_array", "integer"]
    assert events.where("id = 0").agg(F.max("depth")).first()[0] == 2
    assert json_render(events).where("id = 0").first().tokens == '{ "size" 17 "tags" [ "red" null ] "old" true }'
    assert df.select(json_tokens("j").alias("t")).first().t == ["{", '"size"', ":", "17", ",", '"tags"', ":", "[", '"red"', ",", "null", "]", ",", '"old"', ":", "true", "}"]

    class Sum(Handler):
        total = 0

        def integer(self, value):
            self.total += value

        def result(self):
            return self.total

    got = {r.id: (r.ok, r.result) for r in accumulate(df, "id", "j", Sum, "long").collect()}
    assert got == {0: (True, 17), 1: (False, 1), 2: (None, None)}


def test_table_function(spark):
    register_json_events(spark)
    frame(spark, '{"a":[1,2.5]}', None, "[1,").createOrReplaceTempView("texts")
    got = spark.sql("SELECT t.id, e.* FROM texts t, LATERAL json_events(t.j) e ORDER BY 1, 2").collect()
    want = json_events(spark.table("texts"), "id", "j").orderBy("id", "seq").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(got) == 9


@pytest.mark.parametrize("policy", [Policy(), Policy(int_bits=64), Policy(int_bits=16), Policy(float=None), Policy(float="float")])
def test_number_expression(spark, policy):
    tokens = ["0", "-0", "1", "-1", "32768", "-32768", "2147483648", "9223372036854775807", "9223372036854775808", "1" * 50, "1.0", "1e2", "1e-20", "1.5", "-2.25", "1e10", "1e39", "1e308", "1e309", "1e-309", "123e99999999", "0e5", "12E+1"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", json_number("t", policy).alias("n"))
    for r in df.collect():
        want = number_value(r.t, policy)
        got = r.n.i if r.n.kind == "integer" else r.n.f
        assert (r.n.error is None) == (want is not None) and got == want and (want is None or (r.n.kind == "integer") == isinstance(want, int)), r.t
    bad = spark.createDataFrame([("01",), ("+1",), ("1.",), (None,)], "t string").select(json_number("t", policy).alias("n")).collect()
    assert [r.n.error for r in bad] == ["unrecognized_token"] * 3 + [None]


def test_format_position(spark):
    assert frame(spark, "[\n1,]").select(format_position(json_check("j")["pos"]).alias("p")).first().p == "(2:3)"


def test_chunks(spark):
    df = frame(spark, '["é\U0001d11e"]', "")
    for size in (1, 2, 3, 100):
        got = json_assemble(split_chunks(df, "id", "j", size), "id", "seq", "chunk").orderBy("id").collect()
        assert [bytes(r.text).decode() for r in got] == ['["é\U0001d11e"]', ""] and all(r.whole for r in got)


def test_stream(spark, tmp_path):
    docs = {0: '["é\U0001d11e", 1]', 1: "[1,]", 2: "nul", 3: '{"a": 1e5}'}
    rows = [(i, s, t.encode()[s * 2 : s * 2 + 2], (s + 1) * 2 >= len(t.encode())) for i, t in docs.items() for s in range((len(t.encode()) + 1) // 2)]
    rows.sort(key=lambda r: (-r[1], r[0]))  # last chunks first
    schema = "id long, seq int, chunk binary, is_last boolean"
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = check_stream(stream).writeStream.format("memory").queryName("checked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    got = {r.id: (r.ok, r.error, r.column) for r in spark.table("checked").collect()}
    assert got == {0: (True, None, 10), 1: (False, "expected_token", 4), 2: (False, "unrecognized_token", 4), 3: (True, None, 11)}


# the native lane against the reader

PIECES = ['"', "\\", "u", "D8", "34", "n", "q", "{", "}", "[", "]", ":", ",", "1", "-", "0", ".", "e", "E", "+", "true", "nul", "null", "false", " ", "\n", "\r", "\t", "é", "\U0001d11e", "a", '"a"', '"key":', "99999999999", "\x01"]
WHOLE = ['{"a":1,"b":[true,null,1.5e3,"x\\u00e9\\ud834\\udd1e"],"c":{}}', '[1,2,[3,[4]],{"a":"b"}]', " [ 1 ,\r\n 2.0 ] ", '"é\U0001d11ex"', "12.50e-3", '{"k": 2.99999999999999, "l": -0.0 }', '[{"a":[]},{"b":"' + "z" * 20 + '"}]']
POLICIES = [Policy(), WIDE, Policy(float=None), Policy(float="float", int_bits=16, max_length=9, max_stack_depth=4), Policy(max_stack_depth=2, max_array_size=1, max_object_size=1), Policy(int_bits=128), Policy(float="float", int_bits=64)]


def mixed_texts(seed: int, n: int) -> list[str]:
    import random

    r = random.Random(seed)
    out = list(WHOLE)
    while len(out) < n:
        t = "".join(r.choice(PIECES) for _ in range(r.randint(0, 10))) if r.random() < 0.4 else r.choice(WHOLE)
        for _ in range(r.randint(0, 3)):
            k = r.randint(0, len(t))
            t = t[:k] + r.choice(PIECES) + t[k + r.randint(0, 2) :]
        out.append(t)
    return out


@pytest.mark.parametrize("policy", POLICIES)
def test_columns_are_the_readers(spark, policy):
    texts = mixed_texts(policy.int_bits, 1500)
    df = frame(spark, *texts).repartition(4)
    sure, level = surely_valid(F.col("j"), policy, True), flat(F.col("j"), policy)
    rows = df.select("id", json_check("j", policy, values=True).alias("r"), json_valid("j", policy).alias("v"), sure.alias("sure"), level.alias("flat")).collect()
    events: dict = {}
    for e in json_events(df, "id", "j", policy).orderBy("id", "seq").collect():
        value = e.key if e.event == "key" else e.str if e.str is not None else e.f if e.event == "float" else e.b if e.event == "boolean" else e.i
        events.setdefault(e.id, []).append((e.event, value, e.depth))
    sures = 0
    for r in rows:
        t, seen = texts[r.id], Recorder()
        whole, plain = parse(t, policy, Document(policy)), parse(t, policy, seen)
        line, column = position(t, whole.at)
        assert (r.r.ok, r.r.err and r.r.err.name, r.r.pos.line, r.r.pos.column, r.v) == (whole.ok, whole.error, line, column, plain.ok), t
        assert whole.ok or not r.sure and not (r.flat and not plain.ok), t
        want = [(n, str(v) if n == "integer" and abs(v) >= 1 << 63 else v, d) for n, v, d in seen.events]
        assert events.get(r.id, []) == want, t
        sures += r.sure
    assert sures > 20 or policy.max_stack_depth < 4


@pytest.mark.parametrize("policy", POLICIES)
def test_types_are_the_readers(spark, policy):
    """json_typeof() and json_get() give what the reader's event gives, near-whole floats and all widths included."""
    tokens = ["0", "-0", "1", "-1", "2.99999999999999", "3.00000000000001", "2.9999999999999999", "-2.99999999999999", "0.00000000000001", "0.0000000000001", "1.0", "1e2", "1.5", "-2.25", "3000000000.0", "1e18", "1e19", "-1e30", "1e37", "32767.0", "32768.0", "-32768.0", "2147483647.0", "2147483648.0", "9223372036854775807", "9223372036854775807.0", "16777217.0", "0.1", "33.0000001", "1e-300", "12345678901234567890123456789012345678", '"x"', "true", "null", "[]", "{}"]
    df = frame(spark, *tokens).withColumn("v", json_parse("j", policy))
    kinds = ("integer", "float", "number", "string", "boolean", "null")
    rows = df.select("j", json_typeof("v", policy).alias("kind"), *(json_get("v", None, k, policy).alias(k) for k in kinds)).collect()
    for r in rows:
        seen = Recorder()
        out = parse(r.j, policy, seen)
        name, value, _ = seen.events[0] if out.ok else (None, None, 0)
        assert r.kind == {"begin_array": "array", "begin_object": "object"}.get(name, name), r.j
        for k in kinds[:2] + kinds[3:5]:
            assert r[k] == (value if name == k else None), (r.j, k)
        assert r.number == (float(value) if name in ("integer", "float") else None), r.j
        assert r["null"] == (True if name == "null" else None)


def test_members(spark):
    df = frame(spark, '{"a":1,"b":"x","a":2.0,"c":{"z":[1]}}', '{"a":"1","b":null}', "[1]", "{", None, '{"it\'s \\"k\\"":3}')
    rows = df.select(json_members("j", {"a": "integer", "b": "string", "c": "object", "it's \"k\"": "number"}, WIDE).alias("m")).collect()
    assert [None if r.m is None else tuple(r.m)[:2] for r in rows] == [(2, "x"), (None, None), (None, None), None, None, (None, None)]
    assert rows[0].m.c is not None and rows[5].m[3] == 3.0
    v = df.select(json_get(json_parse("j", WIDE), "it's \"k\"", "integer").alias("q")).collect()
    assert v[5].q == 3 and v[0].q is None
    plan = df.select(json_members("j", {"a": "integer", "b": "string"}, WIDE).alias("m")).select("m.*").where("a > 1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parse_json") == 0


def test_made_values(spark):
    df = spark.createDataFrame([(7, "x", None)], "n int, s string, z int")
    got = df.select(*(F.to_json(json_make(k, v)).alias(k) for k, v in (("integer", F.col("n")), ("float", F.col("n")), ("string", F.col("s")), ("boolean", F.col("n") > 1), ("array", F.array("n")), ("object", F.struct("s")), ("null", None)))).first()
    assert tuple(got) == ("7", "7.0", '"x"', "true", "[7]", '{"s":"x"}', "null")
    assert df.select(json_make("integer", F.col("z")).alias("v")).first().v is None
    with pytest.raises(ValueError):
        json_make("int")


# pieces


def test_reader_of_pieces_is_the_reader():
    import random

    r = random.Random(5)
    for k, t in enumerate(mixed_texts(9, 6000)):
        policy, data, at, seen, whole = POLICIES[k % len(POLICIES)], t.encode(), 0, Recorder(), Recorder()
        reader = Reader(policy, seen)
        while at < len(data):
            n = r.randint(1, 4)
            reader.feed(data[at : at + n])
            at += n
            if r.random() < 0.3:  # stored, and taken up again
                reader = Reader(policy, seen).load(reader.dump())
        reader.end()
        out = parse(t, policy, whole)
        assert (reader.error, reader.input_pos, seen.events) == (out.error, position(t, out.at), whole.events), (t, policy)


def test_pieces_fed_at_once_are_pieces_fed_one_by_one():
    import random

    r = random.Random(6)
    for k, t in enumerate(mixed_texts(10, 4000)):
        policy, data = POLICIES[k % len(POLICIES)], t.encode()
        if r.random() < 0.2:  # malformed somewhere
            at = r.randint(0, len(data))
            data = data[:at] + b"\xff" + data[at:]
        cuts = sorted(r.randint(0, len(data)) for _ in range(r.randint(0, 5)))
        pieces = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
        for last in (False, True):
            first = r.randint(0, len(pieces)) if r.random() < 0.5 else 0
            one, all_ = Reader(policy, Recorder()), Reader(policy, Recorder())
            for p in pieces:
                one.feed(p)
            for p in pieces[:first]:
                all_.feed(p)
            all_.feed_all(pieces[first:], last)
            if last:
                one.end()
            told = [(x.error, x.pos, x.input_pos, x.utf8_ok, x.ended, x.handler.events) for x in (one, all_)]
            assert told[0] == told[1], (data, pieces, policy)
            if not last and one.ok:
                assert one.dump() == all_.dump()


def test_reader_keeps_little(spark):
    reader = Reader(WIDE)
    reader.feed("[" + "1 , " * 5000 + '"begun')
    assert len(reader.dump()) < 200 and reader.pos == (1, 20_002) and reader.input_pos == (1, 20_008)
    assert Reader(WIDE).feed(b'"\xff').feed(b'"').end().utf8_ok is False


SCHEMA = "id long, seq int, chunk binary, is_last boolean"


def run(spark, stream, path, name, **trigger):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(path)).trigger(**trigger).start()
    assert q.awaitTermination(100)
    return spark.table(name).collect()


def put(spark, folder, *rows):
    spark.createDataFrame([(i, s, bytearray(c), e) for i, s, c, e in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def test_stream_of_chunks_delivered_again_and_lost(spark, tmp_path):
    folder = tmp_path / "in"
    put(spark, folder, (1, 0, b"[1", False), (1, 0, b"[9", False), (2, 0, b'{"a"', False), (3, 1, b"]", True))
    put(spark, folder, (1, 1, b"]", True), (1, 0, b"[1", False), (2, 0, b'{"a"', False))
    put(spark, folder, (1, 0, b"[1", False), (1, 1, b"]", True), (2, 1, b":2", False), (3, 0, b"[", False))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = run(spark, check_stream(stream), tmp_path / "c1", "again", availableNow=True)
    assert sorted((r.id, r.ok, r.chunks, r.bytes) for r in got) == [(1, True, 2, 3), (3, True, 2, 2)]
    events = run(spark, stream_events(stream), tmp_path / "c2", "again_events", availableNow=True)
    assert sorted((r.id, r.seq, r.event) for r in events) == [(1, 0, "begin_array"), (1, 1, "integer"), (1, 2, "end_array"), (2, 0, "begin_object"), (2, 1, "key"), (3, 0, "begin_array"), (3, 1, "end_array")]
    progress = run(spark, stream_progress(stream), tmp_path / "c3", "again_progress", availableNow=True)
    assert sorted((r.id, r.chunks, r.token_column, r.column) for r in progress if r.id == 2) == [(2, 1, 5, 5), (2, 2, 6, 7)]


def state_rows(spark, stream, path) -> int:
    q = stream.writeStream.format("noop").option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    return next(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["numInputRows"])


def test_stream_check_handles_many_documents_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("larkspur.streaming._GROUPS", 7, raising=False)
    spark.range(2000).coalesce(1).write.parquet(str(tmp_path / "in"))
    pieces = split_chunks(spark.readStream.schema("id long").parquet(str(tmp_path / "in")).withColumn("j", F.col("id").cast("string")), "id", "j", 2)
    assert state_rows(spark, check_stream(pieces), tmp_path / "cp") <= 7  # each a call to Python


def test_stream_events_handles_many_documents_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("larkspur.streaming._GROUPS", 3, raising=False)
    monkeypatch.setattr("larkspur.streaming._ROWS", 50, raising=False)
    texts = [t for t in mixed_texts(11, 600) if t]
    frame(spark, *texts).coalesce(1).write.parquet(str(tmp_path / "in"))
    pieces = split_chunks(spark.readStream.schema("id int, j string").parquet(str(tmp_path / "in")), "id", "j", 3)
    got = run(spark, stream_events(pieces, WIDE), tmp_path / "c1", "many_events", availableNow=True)
    assert sorted(map(tuple, got)) == sorted(map(tuple, json_events(frame(spark, *texts), "id", "j", WIDE).collect()))
    assert state_rows(spark, stream_events(pieces, WIDE), tmp_path / "c2") <= 3


def test_stream_progress_handles_many_documents_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("larkspur.streaming._GROUPS", 3, raising=False)
    folder, ids = tmp_path / "in", range(500)
    cut = {i: f'[{i},\n"{i}é" '.encode() for i in ids}  # three batches, the last of which comes first for odd ones
    for k in range(3):
        put(spark, folder, *((i, (k, 2 - k)[i % 2], cut[i][5 * (k, 2 - k)[i % 2] :][: None if (k, 2 - k)[i % 2] == 2 else 5], False) for i in ids))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = run(spark, stream_progress(stream), tmp_path / "c1", "many_progress", availableNow=True)
    want = []
    for i in ids:
        reader = Reader(Policy())
        for n, piece in enumerate((cut[i][:5], cut[i][5:10], cut[i][10:]), 1):
            reader.feed(piece)
            if n == 3 or i % 2 == 0:
                want.append((i, False, reader.error, *reader.pos, *reader.input_pos, n))
    assert sorted(map(tuple, got)) == sorted(want)
    assert state_rows(spark, stream_progress(stream), tmp_path / "c2") <= 3


@pytest.mark.parametrize("kind", ["long", "string", "date", "decimal(20,2)", "double"])
def test_stream_of_any_ids_in_common_groups(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr("larkspur.streaming._GROUPS", 1, raising=False)
    ids = {n: F.lit(n).cast("string") for n in ("1", "2", "3")} | {None: F.lit(None).cast("string")}
    if kind == "long":
        ids["2"] = F.lit(str((1 << 60) + 1))
    folder = tmp_path / "in"
    for rows in ([("1", 0, b"[1", False), ("2", 1, b"]", True), ("1", 0, b"[9", False), (None, 0, b"[", False)], [("1", 1, b"]", True), ("3", 0, b"", True), ("1", 0, b"x", True)], [("2", 0, b"[2", False), ("1", 1, b"]", True), (None, 1, b"7]", True)]):
        parts = [spark.range(1).select((F.to_date(F.concat(F.lit("2024-01-0"), ids[i])) if kind == "date" else ids[i].cast(kind)).alias("id"), F.lit(s).alias("seq"), F.lit(bytearray(c)).alias("chunk"), F.lit(e).alias("is_last")) for i, s, c, e in rows]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.union(p)
        whole.coalesce(1).write.mode("append").parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = run(spark, check_stream(stream), tmp_path / "cp", f"ids_{kind[:3]}", availableNow=True)
    names = {spark.range(1).select((F.to_date(F.concat(F.lit("2024-01-0"), v)) if kind == "date" else v.cast(kind)).alias("v")).first().v: k for k, v in ids.items()}
    told = sorted(((names[r.id], r.ok, r.error, r.chunks, r.bytes) for r in got), key=str)
    assert told == sorted([("1", True, None, 2, 3), ("2", True, None, 2, 3), ("3", False, "expected_token", 1, 0), (None, True, None, 2, 3)], key=str)


def test_stream_gives_up_documents_of_one_group_each_in_its_time(spark, tmp_path, monkeypatch):
    import time

    monkeypatch.setattr("larkspur.streaming._GROUPS", 1, raising=False)
    folder = tmp_path / "in"
    put(spark, folder, (1, 0, b"[1", False), (2, 0, b"[]", True), (4, 0, b"[4", False))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = check_stream(stream, timeout="3 second").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    for rows, pause in ([(4, 1, b",", False)], 3.5), ([(4, 2, b"4]", True), (2, 0, b"[]", True)], 0):
        assert out.trigger(once=True).start().awaitTermination(100)
        time.sleep(pause)
        put(spark, folder, *rows)
    assert out.trigger(once=True).start().awaitTermination(100)
    got = sorted((r.id, r.ok, r.error, r.chunks) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # 1 is given up; 4 goes on, since its chunk is there when its time is over; 2 ends again once forgotten
    assert got == [(1, False, "chunks_missing", 1), (2, True, None, 1), (2, True, None, 1), (4, True, None, 3)]


def test_stream_gives_up_lost_documents(spark, tmp_path):
    import time

    folder = tmp_path / "in"
    put(spark, folder, (1, 0, b"[1", False), (2, 0, b"[]", True))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = check_stream(stream, timeout="1 second").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    for _ in range(2):
        assert out.trigger(once=True).start().awaitTermination(100)
        time.sleep(1.5)
        put(spark, folder, (3, 0, b"[", False))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.id, r.ok, r.error) for r in got) == [(1, False, "chunks_missing"), (2, True, None)]
    with pytest.raises(ValueError):
        check_stream(stream, timeout="soon")


def test_stream_of_a_users_handler(spark, tmp_path):
    class Ints(Handler):
        def __init__(self):
            self.seen = []

        def integer(self, value):
            self.seen.append(value)
            return "too_large" if value > 99 else None

        def result(self):
            return self.seen

    folder = tmp_path / "in"
    put(spark, folder, (1, 0, b"[1, 2", False), (2, 0, b"[5,100,", False))
    put(spark, folder, (1, 1, b"3]", True), (2, 1, b"7]", True))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    from pyspark.sql import types as T

    got = run(spark, stream_accumulate(stream, Ints, T.ArrayType(T.LongType())), tmp_path / "cp", "ints", availableNow=True)
    assert sorted((r.id, r.ok, r.error, r.result) for r in got) == [(1, True, None, [1, 23]), (2, False, "too_large", [5, 100])]


# sources, joins


def test_files(spark):
    path = fresh_path(spark, "files")
    write_documents(frame(spark, '{"a":"é"}', "[1]").coalesce(1), "j", path)
    assert sorted(r.text for r in read_lines(spark, path).collect()) == ["[1]", '{"a":"é"}']
    whole = read_documents(spark, path + "/part-*").collect()
    assert len(whole) == 1 and bytes(whole[0].text).decode() == '{"a":"é"}\n[1]\n'
    cleanup(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_lines(spark, path).count()


def test_joins(spark):
    left = spark.createDataFrame([(1, 5, "l"), (1, 1, "l"), (2, 9, "l"), (None, 5, "l")], "k int, t int, side string")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 5, "a"), (1, 6, "c"), (None, 1, "n")], "k int, t int, r string")
    got = asof_join(left, right, "t", ["k"], ["r"])
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 1, "l", None), (1, 5, "l", "b"), (2, 9, "l", None), (None, 5, "l", "n")]
    assert asof_join(left.limit(0), right, "t", ["k"], ["r"]).count() == 0
    points = spark.createDataFrame([(0.0,), (2.5,), (7.0,), (None,)], "p double")
    bands = spark.createDataFrame([("a", 0.0, 3.0), ("b", 2.5, 7.0), ("c", 4.0, 4.0), ("d", None, 9.0)], "n string, low double, high double")
    assert sorted((r.p, r.n) for r in range_join(points, bands, "p", "low", "high", 2.0).collect()) == [(0.0, "a"), (2.5, "a"), (2.5, "b")]
