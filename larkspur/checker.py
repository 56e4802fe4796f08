"""Strict JSON reading of one text: events, the first error and its place. No Spark here.

Works on tokens: white space, strings, numbers and words are taken whole by regular expressions; a list of open
brackets says what may follow. What is said of the stack below is counted from that list: one entry for the end of
input, one for each open bracket, one for a value that is due or being read, one for white space being skipped.

Deviations from a literal reading of the grammar's limits, all deliberate: integers beyond the type are always out of
range (they never wrap), exponents never wrap, and a simple escape between two halves of a surrogate pair is an error.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass
from typing import Any

from larkspur.policy import Policy

_SPACE = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r'[^"\\\x00-\x1f]*')
_DIGITS = re.compile(r"[0-9]*")
_NEWLINE = re.compile(r"\r\n|\r|\n")
_SHORT = re.compile(r'"([^"\\\x00-\x1f]*)"')
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}
_ESCAPES = {'"': '"', "/": "/", "\\": "\\", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_HEX = frozenset("0123456789abcdefABCDEF")
_EPSILON = {"double": 2.0**-52 * 128, "float": 2.0**-23 * 128}
_TEN = {"double": 308, "float": 38}  # largest power of ten


class Stop(Exception):  # noqa: N818
    """Ends a parse: the error's name, and the offset of the code point it is found at."""

    def __init__(self, name: str, at: int):
        self.name, self.at = name, at


class Handler:
    """Takes events; an event may return an error's name to end the parse. Override what is of interest."""

    def string(self, value: str): ...
    def integer(self, value: int): ...
    def floating(self, value: float): ...
    def boolean(self, value: bool): ...
    def null(self): ...
    def begin_array(self): ...
    def end_array(self): ...
    def begin_object(self): ...
    def key(self, value: str): ...
    def end_object(self): ...

    def result(self) -> Any:
        return None


class Recorder(Handler):
    """Lists the events as (name, value, depth)."""

    def __init__(self):
        self.events: list[tuple[str, Any, int]] = []
        self.depth = 0

    def _add(self, name: str, value: Any = None):
        self.events.append((name, value, self.depth))

    def string(self, value):
        self._add("string", value)

    def integer(self, value):
        self._add("integer", value)

    def floating(self, value):
        self._add("float", value)

    def boolean(self, value):
        self._add("boolean", value)

    def null(self):
        self._add("null")

    def begin_array(self):
        self._add("begin_array")
        self.depth += 1

    def end_array(self):
        self.depth -= 1
        self._add("end_array")

    def begin_object(self):
        self._add("begin_object")
        self.depth += 1

    def key(self, value):
        self._add("key", value)

    def end_object(self):
        self.depth -= 1
        self._add("end_object")

    def result(self):
        return self.events


_NOTHING = object()


class Document(Handler):
    """Builds the value, within the policy's sizes; result() is a (value,) tuple, partial after an error, or None."""

    def __init__(self, policy: Policy):
        self.policy, self.open, self.keys, self.value = policy, [], [], _NOTHING

    def _record(self, value: Any):
        if not self.open:
            self.value = value
            return None
        top = self.open[-1]
        if isinstance(top, list):
            if len(top) >= self.policy.max_array_size:
                return "too_many_array_members"
            top.append(value)
        else:
            if len(top) >= self.policy.max_object_size:
                return "too_many_object_members"
            top[self.keys.pop()] = value
        return None

    string = integer = floating = boolean = _record

    def null(self):
        return self._record(None)

    def begin_array(self):
        self.open.append([])

    def begin_object(self):
        self.open.append({})

    def key(self, value):
        self.keys.append(value)

    def end_array(self):
        return self._record(self.open.pop())

    end_object = end_array

    def result(self):
        if self.open:
            return (self.open[-1],)
        return None if self.value is _NOTHING else (self.value,)


@dataclass
class Outcome:
    """error: a name of the catalogue, or None; at: the offset where reading ended; value: the handler's result."""

    error: str | None
    at: int
    value: Any = None

    @property
    def ok(self) -> bool:
        return self.error is None


def position(text: str, at: int) -> tuple[int, int]:
    """Line and column, from 1, of an offset. LF, CR and CR LF each end a line; columns count code points."""
    line, start = 1, 0
    if "\n" in text[:at] or "\r" in text[:at]:
        for m in _NEWLINE.finditer(text, 0, at):
            line, start = line + 1, m.end()
    return line, at - start + 1


def _string(text: str, i: int, limit: int) -> tuple[str, int]:
    """The string whose opening quote is at i: its value and the offset after the closing quote."""
    m = _SHORT.match(text, i)
    if m and (4 * (m.end() - i) <= limit or len(m[1].encode("utf-8", "surrogatepass")) <= limit):
        return m[1], m.end()
    i, n, parts, used, high = i + 1, len(text), [], 0, 0
    while True:
        m = _PLAIN.match(text, i)
        piece = m[0]
        if piece:
            if high:
                raise Stop("bad_unicode_code_point", i)
            size = len(piece.encode("utf-8", "surrogatepass"))
            if used + size > limit:
                for k, c in enumerate(piece):
                    used += len(c.encode("utf-8", "surrogatepass"))
                    if used > limit:
                        raise Stop("string_too_long", i + k)
            used += size
            parts.append(piece)
            i = m.end()
        if i == n:
            raise Stop("expected_close_quote", n)
        c = text[i]
        if c == '"':
            if high:
                raise Stop("bad_unicode_code_point", i)
            return "".join(parts), i + 1
        if c != "\\":
            raise Stop("bad_unicode_code_point", i)
        if i + 1 == n:
            raise Stop("expected_close_quote", n)
        c, at = text[i + 1], i + 1
        if c == "u":
            for k in range(i + 2, i + 6):
                if k >= n:
                    raise Stop("expected_close_quote", n)
                if text[k] not in _HEX:
                    raise Stop("invalid_hex_char", k)
            at, unit = i + 5, int(text[i + 2 : i + 6], 16)
            if 0xD800 <= unit < 0xDC00:
                if high:
                    raise Stop("bad_unicode_code_point", at)
                high, i = unit, at + 1
                continue
            if (0xDC00 <= unit < 0xE000) != bool(high):
                raise Stop("bad_unicode_code_point", at)
            c = chr(0x10000 + ((high - 0xD800) << 10) + (unit - 0xDC00)) if high else chr(unit)
            high = 0
        else:
            if c not in _ESCAPES:
                raise Stop("invalid_escape_char", at)
            if high:
                raise Stop("bad_unicode_code_point", at)
            c = _ESCAPES[c]
        used += len(c.encode())
        if used > limit:
            raise Stop("string_too_long", at)
        parts.append(c)
        i = at + 1


def _wraps(digits: str, bits: int) -> int | None:
    """Place of the first digit at which an unsigned sum of that width gets smaller, or None."""
    total, mask = 0, (1 << bits) - 1
    for k, c in enumerate(digits):
        more = (total * 10 + int(c)) & mask
        if more < total:
            return k
        total = more
    return None


def number_value(token: str, policy: Policy) -> int | float | None:
    """Value of a well-formed number; None: out of range. Whole floats within the integer type are integers."""
    mantissa, _, exponent = token.replace("E", "e").partition("e")
    if "." not in mantissa and not exponent:
        digits = mantissa.lstrip("-")
        if len(digits) > 40:
            return None
        value = int(mantissa)
        return value if policy.int_min <= value <= policy.int_max else None
    if policy.float is None:
        return None
    size = exponent.lstrip("+-").lstrip("0")
    if size and (len(size) > 6 or int(size) > _TEN[policy.float]):
        return None
    value = float(token)
    if policy.float == "float":
        try:
            value = struct.unpack("f", struct.pack("f", value))[0]
        except OverflowError:
            value = math.copysign(math.inf, value)
    if math.isfinite(value) and abs(math.modf(value)[0]) < _EPSILON[policy.float] and policy.int_min <= int(value) <= policy.int_max:
        return int(value)
    return value


def _number(text: str, i: int, policy: Policy) -> tuple[int | float, int]:
    n, start = len(text), i

    def due(k: int) -> None:
        if k == n:
            raise Stop("expected_digits", n)
        if not "0" <= text[k] <= "9":
            raise Stop("unrecognized_token", k)

    if text[i] == "-":
        i += 1
    due(i)
    zero = text[i] == "0"
    end = i + 1 if zero else _DIGITS.match(text, i).end()
    if end - i > 4:
        k = _wraps(text[i:end], policy.int_bits) if end - i >= len(str(policy.int_max)) else None
        if k is not None:
            raise Stop("number_out_of_range", i + k)
    if end < n and text[end] in ".eE":
        if policy.float is None:
            if not zero:
                raise Stop("number_out_of_range", end)
            raise Stop("expected_digits", n) if end + 1 == n else Stop("number_out_of_range", end + 1)
        if text[end] == ".":
            due(end + 1)
            end = _DIGITS.match(text, end + 1).end()
        if end < n and text[end] in "eE":
            end += 1
            if end < n and text[end] in "+-":
                end += 1
            due(end)
            end = _DIGITS.match(text, end).end()
    value = number_value(text[start:end], policy)
    if value is None:
        raise Stop("number_out_of_range", end)
    return value, end


def parse(text: str, policy: Policy, handler: Handler | None = None, ended: bool = True) -> Outcome:
    """Reads a text. ended=False: more may follow, so what is missing at its end is no error."""
    handler = handler or Handler()
    error, at = scan(text, policy, handler, ended)
    return Outcome(error, at, handler.result())


def scan(text: str, policy: Policy, handler: Handler, ended: bool = True) -> tuple[str | None, int]:
    """The same, but for the handler's result: the error, and where reading ended."""
    most, limit, n = policy.max_stack_depth, policy.max_length, len(text)
    open_: list[str] = []
    i = 0

    def tell(error: str | None, at: int) -> None:
        if error:
            raise Stop(error, at)

    def missing(name: str) -> None:
        raise Stop(name, n) if ended else Stop("", n)

    def room(entries: int, at: int) -> None:
        """The stack holds the end of input, the open brackets, and these entries."""
        if 1 + len(open_) + entries > most:
            raise Stop("nesting_too_deep", at)

    def skip(i: int, due: int = 0) -> int:
        if i < n and text[i] in " \t\n\r":
            room(due + 1, i)
            return _SPACE.match(text, i).end()
        return i

    def value(i: int) -> tuple[int, bool]:
        """Reads a value, or opens a composite (True)."""
        if open_:
            if i == n:
                missing("expected_array_member" if open_[-1] == "[" else "expected_object_member")
            room(1, i)
        i = skip(i, 1)
        if i == n:
            missing("expected_token")
        c = text[i]
        if c == '"':
            got, end = _string(text, i, limit)
            tell(handler.string(got), end - 1)
        elif c in _WORDS:
            word, got = _WORDS[c]
            if not text.startswith(word, i):
                k = next((k for k in range(1, len(word)) if text[i + k : i + k + 1] != word[k]), 0)
                if i + k >= n and not ended:
                    raise Stop("", n)
                raise Stop("unrecognized_token", min(i + k, n))
            end = i + len(word)
            tell(handler.null() if got is None else handler.boolean(got), end - 1)
        elif c in "[{":
            open_.append(c)
            if i + 1 == n:  # it begins with what follows it
                missing("expected_array_member" if c == "[" else "expected_object_member")
            tell(handler.begin_array() if c == "[" else handler.begin_object(), i + 1)
            return i + 1, True
        elif c == "-" or "0" <= c <= "9":
            got, end = _number(text, i, policy)
            if end == n and not ended:
                raise Stop("", n)
            tell(handler.integer(got) if isinstance(got, int) else handler.floating(got), end)
        else:
            raise Stop("expected_token", i)
        return end, False

    def key(i: int) -> int:
        if i == n:
            missing("expected_object_member")
        if text[i] != '"':
            raise Stop("expected_object_key", i)
        room(1, i)
        got, i = _string(text, i, limit)
        tell(handler.key(got), i - 1)
        i = skip(i)
        if i == n:
            missing("expected_object_member")
        if text[i] != ":":
            raise Stop("expected_colon", i)
        return i + 1

    def close(i: int) -> int:
        tell(handler.end_array() if open_[-1] == "[" else handler.end_object(), i)
        open_.pop()
        return i + 1

    try:
        i, opened = value(i)
        while open_:
            array = open_[-1] == "["
            i = skip(i)
            if i == n:
                missing("expected_array_member" if array else "expected_object_member")
            c = text[i]
            if c == ("]" if array else "}"):
                i, opened = close(i), False
                continue
            if not opened:
                if c != ",":
                    raise Stop("expected_array_member" if array else "expected_object_member", i)
                i = i + 1 if array else skip(i + 1)
            if not array:
                i = key(i)
            i, opened = value(i)
        i = skip(i)
        if i < n:
            raise Stop("unexpected_extra_input", i)
    except Stop as s:
        if not ended and s.name in ("expected_close_quote", "expected_digits"):
            return None, n
        return s.name or None, s.at
    return None, n
