"""Documents that arrive in pieces on a stream.

Chunks are rows (id, seq INT, chunk BINARY, is_last BOOLEAN). Per document the state store keeps a Reader's state (open
brackets, place, the token being read), the handler, and the chunks that came ahead of their turn; what has been read is
not kept and not read again. Documents are handled many to a group, since the cost of a group is that of reading many
small ones; a group's state is one value, a short mark for each document that has ended and what is said above for the
others. Ids other than integers and strings make a group each.

Rules, the same for all operators here:

* A chunk whose predecessor is missing is held until that one comes. Of two chunks with one seq the first counts.
* Errors are sticky: after one, chunks are counted and not read.
* When a document has ended, a mark of it stays for ``timeout`` of processing time; chunks delivered again meanwhile are
  dropped.
* A document of which no chunk came for ``timeout`` is given up: it ends with the error ``chunks_missing``, and its state
  is removed. Chunks that come later still are those of a new document.
* Without a timeout (the default) marks and unfinished documents stay. That is for streams that end: a query with a
  timeout, such as "1 hour", looks for documents to give up for ever, and so does not end under the trigger availableNow.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.checker import Handler, Recorder
from larkspur.operators.events import EVENTS, event_row
from larkspur.pieces import Reader
from larkspur.policy import Policy
from larkspur.storage import fresh_path

MISSING = "chunks_missing"
_STATE = "docs binary"
#: Documents are dealt to so many groups by their ids; a batch writes anew the states of the groups it has chunks for.
_GROUPS = 1 << 12
#: Rows after which a group's output is handed on.
_ROWS = 10_000
_UNITS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def _milliseconds(duration: str) -> int:
    m = re.fullmatch(r"(\d+) (\w+?)s?", duration)
    if not m or m[2] not in _UNITS:
        raise ValueError(f"not a duration: {duration}")
    return int(m[1]) * _UNITS[m[2]]


class Part:
    """A document after a batch. seq: events given so far; ended: whether it is over; lost: whether it was given up."""

    __slots__ = ("key", "reader", "handler", "chunks", "size", "seq", "ended", "lost")

    def __init__(self, key: Any, reader: Reader, handler: Handler, chunks: int, size: int, seq: int, ended: bool, lost: bool):
        self.key, self.reader, self.handler = key, reader, handler
        self.chunks, self.size, self.seq, self.ended, self.lost = chunks, size, seq, ended, lost


class _Doc:
    """A document that has not ended. due: chunks in order, to be read at the end of a frame; fresh: read in this batch."""

    __slots__ = ("expected", "size", "reader", "seq", "waiting", "due", "fresh")

    def __init__(self, expected: int, size: int, reader: Reader, seq: int, waiting: dict[int, tuple[bytes, bool]]):
        self.expected, self.size, self.reader, self.seq, self.waiting = expected, size, reader, seq, waiting
        self.due, self.fresh = [], False

    def take(self, seq: int, chunk: bytes, last: bool) -> bool:
        """Takes a chunk, and those it was awaited by; whether the document is complete."""
        if seq != self.expected:
            self.waiting.setdefault(seq, (chunk, last))
            return False
        while True:
            self.due.append(chunk)
            self.expected += 1
            if last or self.expected not in self.waiting:
                return last
            chunk, last = self.waiting.pop(self.expected)

    def read(self, last: bool) -> None:
        if self.due:
            self.size, self.fresh = self.size + sum(map(len, self.due)), True
            self.reader.feed_all(self.due, last)
            self.due = []


def _many_to_a_group(kind: T.DataType) -> bool:
    """Whether ids are equal in Python if and only if they are in Spark, and come and go unchanged."""
    return isinstance(kind, T.IntegralType) or type(kind) is T.StringType and kind == T.StringType()


def _each(chunks: DataFrame, schema: T.StructType, emit: Callable[[Part], list[tuple]], handler: Callable[[], Handler], policy: Policy | None, timeout: str | None) -> DataFrame:
    policy, wait = policy or Policy(), _milliseconds(timeout) if timeout else None
    mode = GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout
    kind = chunks.schema["id"].dataType
    output, many = T.StructType([T.StructField("id", kind), *schema.fields]), _many_to_a_group(kind)

    def frame(keys: list, rows: list[tuple]) -> pd.DataFrame:
        columns = [keys, *zip(*rows, strict=True)]
        return pd.DataFrame({f.name: pd.Series(c, dtype="object") for f, c in zip(output, columns, strict=True)})

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        until = None if wait is None else now + wait
        # of ended documents until when the mark stays; of others (until, expected, size, reader, handler, seq, ahead)
        over, kept = cloudpickle.loads(bytes(state.get[0])) if state.exists else ({}, {})
        one = not many or key[0] < 0  # the ids of this group are one: the key, or null
        keys: list[Any] = []
        rows: list[tuple] = []
        docs: dict[Any, _Doc] = {}

        def taken_up(i: Any) -> _Doc:
            if i not in kept:
                return _Doc(0, 0, Reader(policy, handler()), 0, {})
            _, expected, size, stored, held, seq, ahead = kept.pop(i)
            return _Doc(expected, size, Reader(policy, held).take_up(stored), seq, ahead)

        def tell(i: Any, doc: _Doc, ended: bool, lost: bool) -> None:
            part = Part(None if many and one else key[0] if one else i, doc.reader, doc.reader.handler, doc.expected, doc.size, doc.seq, ended, lost)
            got = emit(part)
            keys.extend([part.key] * len(got))
            rows.extend(got)
            doc.seq = part.seq

        for f in () if state.hasTimedOut else frames:
            ended = []
            ids = [None] * len(f) if one else f["id"].tolist()
            for i, s, c, e in zip(ids, f["seq"].tolist(), f["chunk"].tolist(), f["is_last"].tolist(), strict=True):
                if i in over:
                    over[i] = until
                    continue
                doc = docs.get(i)
                if doc is None:
                    doc = docs[i] = taken_up(i)
                s = int(s)
                if s >= doc.expected and doc.take(s, bytes(c), bool(e)):
                    over[i] = until
                    ended.append((i, docs.pop(i)))
            for i, doc in ended:
                doc.read(True)
                tell(i, doc, True, False)
                if len(rows) >= _ROWS:
                    yield frame(keys, rows)
                    keys, rows = [], []
            for doc in docs.values():
                doc.read(False)
        for i, doc in docs.items():
            if doc.fresh:
                tell(i, doc, False, False)
            kept[i] = (until, doc.expected, doc.size, doc.reader.state(), doc.reader.handler, doc.seq, doc.waiting)
            if len(rows) >= _ROWS:
                yield frame(keys, rows)
                keys, rows = [], []
        if wait is not None:
            for i in [i for i, k in kept.items() if k[0] < now]:
                tell(i, taken_up(i), True, True)
            over = {i: t for i, t in over.items() if t >= now}
        if rows:
            yield frame(keys, rows)
        if not over and not kept:
            state.remove()
            return
        state.update((cloudpickle.dumps((over, kept)),))
        if wait is not None:
            state.setTimeoutDuration(max(min(chain(over.values(), (k[0] for k in kept.values()))) - now, 1))

    if many:
        group = F.when(F.col("id").isNull(), -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(_GROUPS)).cast("int"))
    else:
        group = F.col("id")
    rows = chunks.select(group.alias("group"), "id", "seq", "chunk", "is_last")
    return rows.groupBy("group").applyInPandasWithState(step, output, _STATE, "append", mode)


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


_INT, _LONG, _TEXT, _BOOL = T.IntegerType(), T.LongType(), T.StringType(), T.BooleanType()


def _error(part: Part) -> str | None:
    return part.reader.error or (MISSING if part.lost else None)


def check_stream(chunks: DataFrame, policy: Policy | None = None, timeout: str | None = None) -> DataFrame:
    """Rows (id, ok, error, line, column, chunks, bytes, utf8_ok), one when a document ends."""

    def emit(part: Part) -> list[tuple]:
        error = _error(part)
        return [(error is None, error, *part.reader.input_pos, part.chunks, part.size, part.reader.utf8_ok)] if part.ended else []

    schema = _fields(ok=_BOOL, error=_TEXT, line=_INT, column=_INT, chunks=_INT, bytes=_LONG, utf8_ok=_BOOL)
    return _each(chunks, schema, emit, Handler, policy, timeout)


def stream_progress(chunks: DataFrame, policy: Policy | None = None, timeout: str | None = None) -> DataFrame:
    """Rows (id, ended, error, token_line, token_column, line, column, chunks): a row whenever a document was read on.

    The token's place is where that begins which is due or being read, the other one where input has come to.
    """

    def emit(part: Part) -> list[tuple]:
        return [(part.ended, _error(part), *part.reader.pos, *part.reader.input_pos, part.chunks)]

    schema = _fields(ended=_BOOL, error=_TEXT, token_line=_INT, token_column=_INT, line=_INT, column=_INT, chunks=_INT)
    return _each(chunks, schema, emit, Handler, policy, timeout)


class _Rows(Recorder):
    """Lists the events as rows (event, depth, key, str, i, f, b)."""

    def _add(self, name: str, value: Any = None):
        self.events.append(event_row(name, value, self.depth))

    def key(self, value: str):
        self.events.append(("key", self.depth, value, None, None, None, None))

    def string(self, value: str):
        self.events.append(("string", self.depth, None, value, None, None, None))


def stream_events(chunks: DataFrame, policy: Policy | None = None, timeout: str | None = None) -> DataFrame:
    """Rows (id, seq, event, depth, key, str, i, f, b): a document's events, as soon as its chunks have brought them."""

    def emit(part: Part) -> list[tuple]:
        new, part.handler.events = part.handler.events, []
        first, part.seq = part.seq, part.seq + len(new)
        return [(first + k, *e) for k, e in enumerate(new)]

    schema = T.StructType([T.StructField("seq", _INT), *EVENTS.elementType.fields])
    return _each(chunks, schema, emit, _Rows, policy, timeout)


def stream_accumulate(chunks: DataFrame, handler: Callable[[], Handler], schema: T.DataType, policy: Policy | None = None, timeout: str | None = None) -> DataFrame:
    """Rows (id, ok, error, line, column, result), one when a document ends: a user's handler over each, fed chunk by chunk.

    The handler is kept in the state between chunks, so it must be picklable; schema is the type of its result(). An
    event method that returns a string ends the parse with that as the error's name.
    """

    def emit(part: Part) -> list[tuple]:
        error = _error(part)
        return [(error is None, error, *part.reader.input_pos, part.handler.result())] if part.ended else []

    fields = _fields(ok=_BOOL, error=_TEXT, line=_INT, column=_INT, result=schema)
    return _each(chunks, fields, emit, handler, policy, timeout)


def finished(stream: DataFrame) -> DataFrame:
    """Runs a stream over all that is there now, into a Parquet folder that executors share, and reads the folder.

    The folder goes with ``larkspur.storage.cleanup()``.
    """
    path = fresh_path(stream.sparkSession, "stream")
    writer = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
