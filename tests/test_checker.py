"""Golden cases of the grammar, without Spark."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.checker import Document, Handler, Recorder, number_value, parse, position
from larkspur.errors import DOM, PARSER, describe
from larkspur.policy import Policy

P = Policy()
B = chr(92)
SHORT = {"begin_array": "[", "end_array": "]", "begin_object": "{", "end_object": "}", "null": "N"}


def shown(text, policy=P):
    r = Recorder()
    out = parse(text, policy, r)
    events = [SHORT.get(n) or ("TF"[not v] if n == "boolean" else f"{n[0].upper()}({v})") for n, v, _ in r.events]
    return " ".join(events), out.error, position(text, out.at)


@pytest.mark.parametrize(
    ("text", "events", "error"),
    [
        ("0", "I(0)", None), ("-0", "I(0)", None), (" 1 ", "I(1)", None), ("10", "I(10)", None), ("-1", "I(-1)", None),
        ("01", "I(0)", "unexpected_extra_input"), ("-01", "I(0)", "unexpected_extra_input"), ("+1", "", "expected_token"),
        (".1234", "", "expected_token"), ("-", "", "expected_digits"), ("--", "", "unrecognized_token"), ("1Ex", "", "unrecognized_token"),
        ("1..", "", "unrecognized_token"), ("1.E", "", "unrecognized_token"), ("3.1415", "F(3.1415)", None), ("-0.45", "F(-0.45)", None),
        ("0e2", "I(0)", None), ("1e2", "I(100)", None), ("1E-02", "F(0.01)", None), ("123123e100000", "", "number_out_of_range"),
        ("123e-10000000", "", "number_out_of_range"), ("1.0", "I(1)", None), ("1e-20", "I(0)", None), ("1e-309", "", "number_out_of_range"),
        ("1e10", "F(10000000000.0)", None), ("10000000000", "", "number_out_of_range"), ("6000000000", "", "number_out_of_range"),
        ("[0e+1]", "[ I(0) ]", None), ("[1.234]", "[ F(1.234) ]", None), ("[1 , ]", "[ I(1)", "expected_token"), ("[01]", "[ I(0)", "expected_array_member"),
        ("[[null], [1]]", "[ [ N ] [ I(1) ] ]", None), ("[" * 200, "[ [ [ [ [ [ [", "nesting_too_deep"), ("[[no", "[ [", "unrecognized_token"),
        ('{"a":1, "a":true}', "{ K(a) I(1) K(a) T }", None), ('{"a": [1,2]}', "{ K(a) [ I(1) I(2) ] }", None), ('{"a":nu}', "{ K(a)", "unrecognized_token"),
        ("[1,", "[ I(1)", "expected_array_member"), ("[1, ", "[ I(1)", "expected_token"), ('{"a":', "{ K(a)", "expected_object_member"), ('{"a": ', "{ K(a)", "expected_token"),
        ("[[[[[[1,2]]]]]]", "[ [ [ [ [ [ I(1) I(2) ] ] ] ] ] ]", None), ("[[[[[[1, 2]]]]]]", "[ [ [ [ [ [ I(1)", "nesting_too_deep"),
        (' {"size" :17,\n"tags":["red",null] ,"old": true} ', "{ K(size) I(17) K(tags) [ S(red) N ] K(old) T }", None), ("nu", "", "unrecognized_token"), ("bad", "", "expected_token"), ("falsehood", "F", "unexpected_extra_input"),
    ],
)
def test_events_and_errors(text, events, error):
    got, code, _ = shown(text)
    assert (got, code) == (events, error)


@pytest.mark.parametrize(
    ("text", "error", "place"),
    [
        ('""', None, (1, 3)), ('"hello"', None, (1, 8)), ('"hello', "expected_close_quote", (1, 7)), (f'"a{B}qb"', "invalid_escape_char", (1, 4)), (f'"{B}ÿ"', "invalid_escape_char", (1, 3)),
        (f'"a{B}"', "expected_close_quote", (1, 5)), (f'"a{B}', "expected_close_quote", (1, 4)), ('"\U0001d11e"', None, (1, 4)), (f'"{B}u002F"', None, (1, 9)),
        (f'"{B}uD834{B}uDD1E"', None, (1, 15)), (f'"{B}uD834{B}u30A1"', "bad_unicode_code_point", (1, 13)), (f'"{B}uD834!"', "bad_unicode_code_point", (1, 8)),
        (f'"{B}uDD1E{B}u30A1"', "bad_unicode_code_point", (1, 7)), (f'"{B}uD800{B}uD800"', "bad_unicode_code_point", (1, 13)), (f'"{B}uD834"', "bad_unicode_code_point", (1, 8)),
        (f'"{B}uD834{B}n{B}uDD1E"', "bad_unicode_code_point", (1, 9)), ('"\t"', "bad_unicode_code_point", (1, 2)), (f'"{B}u00xf"', "invalid_hex_char", (1, 6)), (f'"{B}u00', "expected_close_quote", (1, 6)),
        ("[\n]\n", None, (3, 1)), ("[ 1 ]", None, (1, 6)), ("[,]", "expected_token", (1, 2)), ("[1,]", "expected_token", (1, 4)), ('{"a":1,}', "expected_object_key", (1, 8)),
        ('{"a":1 "b":1}', "expected_object_member", (1, 8)), ('{"a":1,,"b":1}', "expected_object_key", (1, 8)), ('{"a" 1', "expected_colon", (1, 6)), ("{{}:{}}", "expected_object_key", (1, 2)),
        ("", "expected_token", (1, 1)), ("null", None, (1, 5)), ("\r\r null", None, (3, 6)), ("\r\n\r\nnull", None, (3, 5)), ("\n\r\n\rnull", None, (4, 5)), ("\n\n\r\n\rx", "expected_token", (5, 1)),
    ],
)
def test_positions(text, error, place):
    assert shown(text)[1:] == (error, place)


@pytest.mark.parametrize(("bits", "low", "high"), [(16, -32768, 32767), (32, -2147483648, 2147483647), (64, -(2**63), 2**63 - 1), (128, -(2**127), 2**127 - 1)])
def test_integer_widths(bits, low, high):
    p = Policy(int_bits=bits)
    assert shown(str(low), p)[0] == f"I({low})"
    assert shown(str(high), p)[0] == f"I({high})"
    assert shown(str(low - 1), p)[1] == shown(str(high + 1), p)[1] == "number_out_of_range"


@pytest.mark.parametrize("text", ["1.2", "1e30", "0.5", "0e1"])
def test_no_floats(text):
    assert shown(text, Policy(float=None))[1] == "number_out_of_range"


def test_string_limit_counts_bytes():
    p = Policy(max_length=10)
    assert shown('"0123456789"', p)[1] is None
    for text in ('"01234567890"', f'"0123456789{B}u0030"', f'"0123456789{B}uD834{B}uDD1E"', f'"0123456789{B}n"', '"' + "\U0001f60e" * 3 + '"', '{"01234567890":1}'):
        assert shown(text, p)[1] == "string_too_long"


def test_documents_and_sizes():
    read = lambda t, p=P: parse(t, p, Document(p))
    assert read('{"a":"b","a":"c"}').value == ({"a": "c"},)
    assert read("3.14").value == (3.14,)
    assert read('{"a":1,"b":2)').value == ({"a": 1, "b": 2},)
    p = Policy(max_array_size=10, max_object_size=5)
    assert read("[" + ",".join("1" * 10) + "]", p).ok
    assert read("[" + ",".join("1" * 11) + "]", p).error == "too_many_array_members"
    five = ",".join(f'"{c}":1' for c in "abcde")
    assert read("{" + five + "}", p).ok
    assert read("{" + five + ',"f":6}', p).error == "too_many_object_members"
    assert read("{" + five + ',"a":6}', p).error == "too_many_object_members"


def test_depth_five():
    p = Policy(max_stack_depth=5)
    assert parse('{"a":{"b":{"c":1}}}', p).ok
    assert parse('{"a":{"b":{"c":{"d":1}}}}', p).error == "nesting_too_deep"


def test_handlers_may_stop():
    class Stops(Handler):
        def begin_array(self):
            return "mine"

        def end_object(self):
            return "mine"

    out = parse("[\n]\n", P, Stops())
    assert (out.error, position("[\n]\n", out.at)) == ("mine", (1, 2))
    text = '{\n"a" : 1\n}'
    out = parse(text, P, Stops())
    assert (out.error, position(text, out.at)) == ("mine", (3, 1))
    assert describe("mine")["category"] == "user"


def test_catalogue():
    assert sorted(c for c, _ in PARSER.values()) == list(range(16))
    assert describe("too_many_array_members") == {"category": "dom", "code": 1, "name": "too_many_array_members", "message": DOM["too_many_array_members"][1]}


def test_number_value():
    assert number_value("1e2", P) == 100 and isinstance(number_value("1e2", P), int)
    assert number_value("1e39", Policy(float="float")) is None
    assert number_value("2147483648.0", P) == 2147483648.0


values = st.recursive(st.none() | st.booleans() | st.integers(-(2**31), 2**31 - 1) | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8)
WIDE = Policy.relaxed()


@settings(max_examples=200, deadline=None)
@given(values, st.booleans())
def test_round_trip(value, ascii_):
    try:
        text = json.dumps(value, ensure_ascii=ascii_, indent=1)
        text.encode()
    except UnicodeEncodeError:
        return
    assert parse(text, WIDE, Document(WIDE)).value == (value,)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}[]:,"' + B + "u0afntrsel.-eE+ \t\n", max_size=12))
def test_never_raises_and_agrees_on_validity(text):
    out = parse(text, WIDE, Document(WIDE))
    try:
        json.loads(text, parse_constant=lambda _: 1 / 0)
        valid = True
    except (ValueError, ZeroDivisionError):
        valid = False
    if out.ok:
        assert valid
    elif valid:
        assert out.error in ("number_out_of_range", "bad_unicode_code_point")


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet='{}[]:,"' + B + "u0a1ftrue.-e ", max_size=10), st.integers(0, 10))
def test_an_error_of_a_prefix_is_that_of_the_whole(text, cut):
    part = parse(text[:cut], WIDE, ended=False)
    if part.error:
        whole = parse(text, WIDE)
        assert (whole.error, whole.at) == (part.error, part.at)
