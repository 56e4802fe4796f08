"""Strict reading of one text that arrives in pieces: the same events, errors and places as reading it whole.

Between pieces a Reader keeps the open brackets, what is due next, the place reached, and the bytes of a token (or a
character) that is not complete yet. It can be stored as text (``dump``) and taken up again elsewhere (``load``), and does
not see again what it has read, but for a token cut across pieces, which is read anew with each.
"""

from __future__ import annotations

import codecs
import json

from larkspur.checker import _SPACE, _WORDS, Handler, Stop, _number, _string, position, scan
from larkspur.policy import Policy

_MORE = ""  # the name of a Stop that waits for more input


class Reader:
    """due: value, first (a bracket was opened), next (a member was read), key (after a comma), colon, or end."""

    def __init__(self, policy: Policy, handler: Handler | None = None):
        self.policy, self.handler = policy, handler or Handler()
        self.open, self.due, self.spaced = "", "value", False
        self.line, self.column = 1, 1
        self.tail, self.rest = "", b""  # text, and bytes of a character, not read yet
        self.error: str | None = None
        self.utf8_ok = True
        self.ended = False

    # state

    def state(self) -> tuple:
        """The state but for policy and handler."""
        return self.open, self.due, self.spaced, self.line, self.column, self.tail, self.error, self.utf8_ok, self.ended, self.rest

    def take_up(self, state: tuple) -> Reader:
        self.open, self.due, self.spaced, self.line, self.column, self.tail, self.error, self.utf8_ok, self.ended, self.rest = state
        return self

    def dump(self) -> str:
        """The state as text."""
        *plain, rest = self.state()
        return json.dumps([*plain, rest.hex()])

    def load(self, state: str) -> Reader:
        *plain, rest = json.loads(state)
        return self.take_up((*plain, bytes.fromhex(rest)))

    # input

    def feed(self, piece: bytes | str) -> Reader:
        """Takes in the next piece; after an error input is ignored."""
        if self.error is None and not self.ended:
            self._run(self._decode(piece, False), False)
        return self

    def feed_all(self, pieces: list[bytes], last: bool) -> Reader:
        """The same as to feed() one after the other, and to end() if they are the last; in one go where that can be."""
        if self.error is None and not self.ended:
            data = self.rest + b"".join(pieces)
            try:
                text, used = codecs.utf_8_decode(data, "strict", last)
            except UnicodeDecodeError:  # where it is malformed matters: after an error it is not told
                for piece in pieces:
                    self.feed(piece)
                return self.end() if last else self
            self.rest = data[used:]
            if last and self.due == "value" and not self.open and not self.spaced:  # nothing was read before
                text = self.tail + text
                self.error, at = scan(text, self.policy, self.handler)
                self.tail, (self.line, self.column) = "", self._place(text, at)
            else:
                self._run(text, last)
        self.ended = self.ended or last
        return self

    def end(self) -> Reader:
        """No more input follows."""
        if self.error is None and not self.ended:
            self._run(self._decode(b"", True), True)
        self.ended = True
        return self

    @property
    def ok(self) -> bool:
        return self.error is None

    @property
    def input_pos(self) -> tuple[int, int]:
        """Line and column of the input's end so far, or of the error."""
        if self.error is not None or not self.tail:
            return self.line, self.column
        return self._place(self.tail, len(self.tail))

    @property
    def pos(self) -> tuple[int, int]:
        """Line and column where the token begins that is due or being read, or of the error; once ended, the input's."""
        return self.line, self.column

    def _decode(self, piece: bytes | str, last: bool) -> str:
        data = self.rest + (piece.encode("utf-8", "surrogatepass") if isinstance(piece, str) else piece)
        if not data:
            return ""
        try:
            text, used = codecs.utf_8_decode(data, "strict", last)
        except UnicodeDecodeError:
            self.utf8_ok = False
            text, used = codecs.utf_8_decode(data, "replace", last)
        self.rest = data[used:]
        return text

    def _place(self, text: str, at: int) -> tuple[int, int]:
        line, column = position(text, at)
        return (self.line, self.column + column - 1) if line == 1 else (self.line + line - 1, column)

    def _run(self, piece: str, last: bool) -> None:
        text, at = self.tail + piece, 0
        try:
            while True:
                at = self._step(text, at, last)
        except Stop as s:
            if s.name == _MORE:
                if at and text[at - 1] == "\r" and at == len(text) and not last:
                    at -= 1  # a line feed may follow; to be counted as one
                self.line, self.column = self._place(text, at)
                self.tail = "" if last else text[at:]
            else:
                self.error = s.name
                self.line, self.column = self._place(text, s.at)
                self.tail = ""

    # one step: reads a unit from at on and returns where it ends

    def _room(self, entries: int, at: int) -> None:
        if 1 + len(self.open) + entries > self.policy.max_stack_depth:
            raise Stop("nesting_too_deep", at)

    def _tell(self, error: str | None, at: int) -> None:
        if error:
            raise Stop(error, at)

    def _missing(self, name: str, n: int, last: bool) -> None:
        raise Stop(name if last else _MORE, n)

    def _space(self, text: str, at: int, entries: int) -> int:
        if at < len(text) and text[at] in " \t\n\r":
            self._room(entries, at)
            return _SPACE.match(text, at).end()
        return at

    def _step(self, text: str, at: int, last: bool) -> int:
        n, array = len(text), self.open.endswith("[")
        member = "expected_array_member" if array else "expected_object_member"
        if self.due == "value":
            return self._value(text, at, last, member)
        end = self._space(text, at, 1)
        if end > at:  # white space is a step of its own, so none of it is kept
            return end
        if self.due == "end":
            if at == n:
                raise Stop(_MORE, n)
            raise Stop("unexpected_extra_input", at)
        if at == n:
            self._missing(member, n, last)
        c = text[at]
        if self.due == "key":
            return self._key(text, at, last)
        if self.due == "colon":
            if c != ":":
                raise Stop("expected_colon", at)
            self.due, self.spaced = "value", False
            return at + 1
        if c == ("]" if array else "}"):
            self._tell(self.handler.end_array() if array else self.handler.end_object(), at)
            self.open = self.open[:-1]
            self._read()
            return at + 1
        if self.due == "first":
            self.due = "value" if array else "key"
            self.spaced = False
            return at
        if c != ",":
            raise Stop(member, at)
        self.due, self.spaced = "value" if array else "key", False
        return at + 1

    def _read(self) -> None:
        """A value has been read."""
        self.due = "next" if self.open else "end"

    def _key(self, text: str, at: int, last: bool) -> int:
        if text[at] != '"':
            raise Stop("expected_object_key", at)
        self._room(1, at)
        got, end = self._quoted(text, at, last)
        self._tell(self.handler.key(got), end - 1)
        self.due = "colon"
        return end

    def _quoted(self, text: str, at: int, last: bool) -> tuple[str, int]:
        try:
            return _string(text, at, self.policy.max_length)
        except Stop as s:
            if s.name == "expected_close_quote" and not last:
                raise Stop(_MORE, s.at) from None
            raise

    def _value(self, text: str, at: int, last: bool, member: str) -> int:
        n, h = len(text), self.handler
        if self.open and not self.spaced:
            if at == n:
                self._missing(member, n, last)
            self._room(1, at)
        end = self._space(text, at, 2)
        if end > at:
            self.spaced = True
            return end
        if at == n:
            self._missing("expected_token", n, last)
        c = text[at]
        if c == '"':
            got, end = self._quoted(text, at, last)
            self._read()
            self._tell(h.string(got), end - 1)
        elif c in _WORDS:
            word, got = _WORDS[c]
            if not text.startswith(word, at):
                k = next((k for k in range(1, len(word)) if text[at + k : at + k + 1] != word[k]), 0)
                if at + k >= n and not last:
                    raise Stop(_MORE, n)
                raise Stop("unrecognized_token", min(at + k, n))
            end = at + len(word)
            self._read()
            self._tell(h.null() if got is None else h.boolean(got), end - 1)
        elif c in "[{":
            if at + 1 == n:  # it begins with what follows it
                self._missing("expected_array_member" if c == "[" else "expected_object_member", n, last)
            self.open += c
            self.due = "first"
            self._tell(h.begin_array() if c == "[" else h.begin_object(), at + 1)
            return at + 1
        elif c == "-" or "0" <= c <= "9":
            try:
                got, end = _number(text, at, self.policy)
            except Stop as s:
                if s.at >= n and not last:  # told of a number whose end has not come
                    raise Stop(_MORE, n) from None
                raise
            if end == n and not last:
                raise Stop(_MORE, n)
            self._read()
            self._tell(h.integer(got) if isinstance(got, int) else h.floating(got), end)
        else:
            raise Stop("expected_token", at)
        return end
