"""What Catalyst can decide alone: texts that are surely valid, and the events of flat ones.

The strict reader runs in Python. Most texts need it not: a regular expression, whose repetitions never give back what
they took, tells that a text of little depth with plain numbers is valid under a policy. It errs on one side only: a text
that it does not accept goes to the reader.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.policy import Policy

#: Brackets within brackets that the expression follows.
DEPTH = 3
_SPACE = r"[ \t\n\r]*+"
_PLAIN = r'[^"\\\x00-\x1F]'
_ESCAPE = r'\\(?:["\\/bfnrt]|u(?:[0-9a-cA-CefEF][0-9a-fA-F]{3}|[dD][0-7][0-9a-fA-F]{2}))'
#: Decimal digits that always fit an integer type.
_DIGITS = {16: 4, 32: 9, 64: 18, 128: 38}
#: Nearer to a whole number than this a float counts as whole (128 epsilons).
WHOLE = {"double": 2.0**-52 * 128, "float": 2.0**-23 * 128}


def _string(limit: int | None, escapes: bool) -> str:
    """limit: None, or the characters that surely fit."""
    if limit is not None:
        one = f"(?:{_PLAIN}|{_ESCAPE})" if escapes else _PLAIN
        return f'"{one}{{0,{limit}}}+"'
    return f'"{_PLAIN}*+(?:{_ESCAPE}{_PLAIN}*+)*+"' if escapes else f'"{_PLAIN}*+"'


def _pattern(policy: Policy, depth: int, limit: int | None, escapes: bool) -> str:
    whole = rf"-?+(?:0|[1-9][0-9]{{0,{_DIGITS[policy.int_bits] - 1}}}+)"
    fraction = r"(?:\.[0-9]++)?+" if policy.float else ""
    exponent = r"(?:[eE][+-]?+[0-9]{1,2}+)?+" if policy.float == "double" and escapes else ""
    string = _string(limit, escapes)
    scalar = value = f"{string}|{whole}{fraction}{exponent}|true|false|null"
    for _ in range(depth):
        array = rf"\[{_SPACE}(?:(?:{value}){_SPACE}(?:,{_SPACE}(?!\])|(?=\])))*+\]"
        member = f"{string}{_SPACE}:{_SPACE}(?:{value}){_SPACE}"
        object_ = rf"\{{{_SPACE}(?:{member}(?:,{_SPACE}(?!\}})|(?=\}})))*+\}}"
        value = f"{scalar}|{array}|{object_}"
    return rf"\A{_SPACE}(?:{value}){_SPACE}\z"


def _matches(text: Column, policy: Policy, depth: int, escapes: bool) -> Column:
    # the stack holds the end of input, the brackets, a value and white space
    depth = min(depth, policy.max_stack_depth - 3)
    if depth < 0:
        return F.lit(False)
    any_length = F.octet_length(text) <= policy.max_length
    free = text.rlike(_pattern(policy, depth, None, escapes))
    if policy.max_length >= 1 << 20:
        return any_length & free
    return F.when(any_length, free).otherwise(text.rlike(_pattern(policy, depth, policy.max_length // 4, escapes)))


def surely_valid(text: Column, policy: Policy, values: bool = False) -> Column:
    """True only if the text is valid under the policy; false may mean anything. Null for null."""
    body = text.cast("string")
    out = _matches(body, policy, DEPTH, True) & F.is_valid_utf8(body)
    if values:  # a member takes two characters, but for the last one
        out = out & (F.length(body) <= 2 * min(policy.max_array_size, policy.max_object_size))
    return out


def end_position(text: Column) -> Column:
    """Struct (line, column) of the end of a text."""
    body = text.cast("string")
    line = F.regexp_count(body, F.lit("\r\n|\r|\n")) + 1
    column = F.length(F.substring_index(F.translate(body, "\r", "\n"), "\n", -1)) + 1
    return F.struct(line.cast("int").alias("line"), column.cast("int").alias("column"))


def truncated(value: Column) -> Column:
    """The number without its fraction, as a double; floor() and ceil() of a double give longs, too small for some."""
    whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("double")
    return F.when(F.abs(value) < 2.0**52, whole).otherwise(value)


def is_whole(value: Column, policy: Policy) -> Column:
    """Whether a float counts as an integer under the policy."""
    t = truncated(value)
    eps = WHOLE[policy.float or "double"]
    return (F.abs(value - t) < eps) & (t >= float(policy.int_min)) & (t < 2.0 ** (policy.int_bits - 1))


def flat(text: Column, policy: Policy) -> Column:
    """True only if the text is valid, of at most one level of brackets, with strings without escapes and plain numbers."""
    body = text.cast("string")
    if policy.int_bits > 64:
        policy = policy.but(int_bits=64)  # fewer digits than allowed
    return _matches(body, policy, 1, False) & F.is_valid_utf8(body)


_TOKEN = r'"[^"]*+"[ \t\n\r]*+:?+|[\[\]{}]|[^ \t\n\r\[\]{}:,"]++'


def flat_events(text: Column, policy: Policy) -> Column:
    """Array of (event, depth, key, str, i, f, b) of a text that flat() accepts."""
    tokens = F.regexp_extract_all(text.cast("string"), F.lit(_TOKEN), F.lit(0))

    def event(t: Column) -> Column:
        c = F.substring(t, 1, 1)
        quoted, key = c == '"', t.endswith(":")
        number = F.expr("cast(null as double)")
        floating = F.lit(False)
        if policy.float:
            number = t.try_cast("double")
            number = number.cast("float").cast("double") if policy.float == "float" else number
            floating = t.contains(".") & ~is_whole(number, policy)
        digit = ~c.isin('"', "{", "}", "[", "]", "t", "f", "n")
        marks = {"{": "begin_object", "}": "end_object", "[": "begin_array", "]": "end_array", "t": "boolean", "f": "boolean", "n": "null"}
        name = F.when(quoted, F.when(key, "key").otherwise("string"))
        for mark, what in marks.items():
            name = name.when(c == mark, what)
        name = name.otherwise(F.when(floating, "float").otherwise("integer"))
        body = F.split_part(t, F.lit('"'), F.lit(2))
        # the text is looked at again for each token; the tokens would be cut up again
        inside = text.cast("string").rlike(r"\A[ \t\n\r]*+[\[{]") & ~c.isin("{", "}", "[", "]")
        whole = F.when(t.contains("."), truncated(number).try_cast("bigint")).otherwise(t.try_cast("bigint"))
        return F.struct(
            name.alias("event"),
            inside.cast("int").alias("depth"),
            F.when(quoted & key, body).alias("key"),
            F.when(quoted & ~key, body).alias("str"),
            F.when(digit & ~floating, whole).alias("i"),
            F.when(digit & floating, number).alias("f"),
            F.when(c == "t", True).when(c == "f", False).alias("b"),
        )

    return F.transform(tokens, event)
