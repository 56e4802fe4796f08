"""Benchmark decontamination: which words of a document lie inside a window of a benchmark item.

A prefix-filtered set join. Every window is a set of short shingles. To contain the window a document must contain all
of them, so one necessary shingle, the rarest over all documents, is enough to join on (the prefix for a containment of
1 has length 1). A joined shingle gives the window's place in the document (positional bound), which must lie inside
the document (length bound); there the words are compared one by one, by their hashes and then by their bytes.

The items are a stated query set. They are held by every task in blocks of at most ``BLOCK_WORDS`` words; more items
take more passes over the documents, then written with row numbers, by which the findings are united.

Edge cases: a null or empty text has no words and no hits; items without words occur nowhere; repeated items all count,
once for each id (null ids are left out); item ids may be of any plain type; rows with equal or null ids are judged
separately, by the stage too; other columns are ignored, and the stage returns them as they are whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from larkspur.llm._shared import written
from larkspur.llm._text import ALNUM, U, Words, equal_ranges, grams, padded, texts

#: Words of items held by a task at once; about 100 bytes each.
BLOCK_WORDS = 400_000
SHINGLE = 5
_BITS = 20


class _Keys:
    """Sorted hashes with a table of their leading bits in front, so that most lookups end there."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.head = np.zeros(1 << _BITS, dtype=bool)
        self.head[(self.keys >> U(64 - _BITS)).astype(np.int64)] = True

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in g, places in keys) of what is there."""
        at = np.flatnonzero(self.head[(g >> U(64 - _BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        same = self.keys[k] == g[at]
        return at[same], k[same]


class Windows:
    """The windows of some items: ``size`` words from ``base`` on in ``hash``, of the item ``ids[item]``.

    ``start`` and ``end`` are the words' places in ``pad``, which holds the items' texts in lower case.
    """

    def __init__(self, items: list[tuple[object, str]], window: int):
        column = pa.array([t or "" for _, t in items], pa.large_string())
        self.ids = sorted({i for i, _ in items})
        place = {i: k for k, i in enumerate(self.ids)}
        of = np.array([place[i] for i, _ in items], np.int64)
        hashes, base, size, item, at = [], [], [], [], 0
        start, end, pads, bytes_ = [], [], [], 0
        for row, buf, off in texts(column):
            w = Words(buf, off, ALNUM)
            hashes.append(w.hash)
            start.append(w.start + bytes_)
            end.append(w.end + bytes_)
            pads.append(w.pad[: len(buf)])
            bytes_ += len(buf)
            for d, n in enumerate(w.count):
                if n:
                    k = max(1, n - window + 1)
                    base.append(at + w.first[d] + np.arange(k))
                    size.append(np.full(k, min(n, window)))
                    item.append(np.full(k, of[row + d]))
            at += len(w.hash)
        cat = lambda xs, t=np.int64: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
        self.hash, self.base, self.size, self.item = cat(hashes, U), cat(base), cat(size), cat(item)
        self.start, self.end, self.pad = cat(start), cat(end), padded(cat(pads, np.uint8))

    def shingles(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By shingle length: (hash, window, offset in the window) of every shingle."""
        out = {}
        length = np.minimum(self.size, SHINGLE)
        for s in np.unique(length):
            g = grams(self.hash, int(s))
            own = np.flatnonzero(length == s)
            k = self.size[own] - s + 1
            window = np.repeat(own, k)
            offset = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            out[int(s)] = (g[self.base[window] + offset], window, offset)
        return out


class Prefixes:
    """Per shingle length: every window's rarest shingle, as keys that lead to (window, offset)."""

    def __init__(self, windows: Windows, seen: dict[int, dict[int, int]]):
        self.windows, self.by = windows, {}
        for s, (g, window, offset) in windows.shingles().items():
            keys = np.unique(g)
            count = np.zeros(len(keys), dtype=np.int64)
            for k, n in seen.get(s, {}).items():
                count[k] = n
            rank = count[np.searchsorted(keys, g)]
            order = np.lexsort((offset, g, rank, window))
            first = order[np.concatenate([[True], window[order][1:] != window[order][:-1]])] if len(order) else order
            first = first[np.argsort(g[first], kind="stable")]
            index = _Keys(g[first])
            self.by[s] = (index, np.searchsorted(g[first], index.keys, "left"), np.searchsorted(g[first], index.keys, "right"), window[first], offset[first])

    def match(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Verified (first word, window) pairs."""
        starts, windows, W = [], [], self.windows
        for s, (index, left, right, window, offset) in self.by.items():
            at, k = index.find(w.grams(s))
            n = right[k] - left[k]
            row = np.repeat(left[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start, win = np.repeat(at, n) - offset[row], window[row]
            if not len(start):
                continue
            doc = np.searchsorted(w.first, np.repeat(at, n), "right") - 1
            inside = (start >= w.first[doc]) & (start + W.size[win] <= w.first[doc + 1])
            start, win = start[inside], win[inside]
            for j in range(int(W.size[win].max()) if len(win) else 0):
                live = W.size[win] > j
                same = np.ones(len(win), dtype=bool)
                mine, theirs = start[live] + j, W.base[win[live]] + j
                size = w.end[mine] - w.start[mine]
                ok = (w.hash[mine] == W.hash[theirs]) & (size == W.end[theirs] - W.start[theirs])
                ok[ok] = equal_ranges(w.pad, w.start[mine[ok]], W.pad, W.start[theirs[ok]], size[ok])
                same[live] = ok
                start, win = start[same], win[same]
            starts.append(start)
            windows.append(win)
        cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        return cat(starts), cat(windows)


def _count(docs: DataFrame, text: str, windows: Windows) -> dict[int, dict[int, int]]:
    """How often each shingle of the windows occurs in all documents: {length: {place among the keys: count}}."""
    keys = docs.sparkSession.sparkContext.broadcast({s: _Keys(g) for s, (g, _, _) in windows.shingles().items()})

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {s: np.zeros(len(k.keys), dtype=np.int64) for s, k in keys.value.items()}
        for b in batches:
            for _, buf, off in texts(b.column(0)):
                w = Words(buf, off, ALNUM)
                for s, k in keys.value.items():
                    at, key = k.find(w.grams(s))
                    key = key[w.whole(s)[at]]
                    sums[s] += np.bincount(key, minlength=len(k.keys))
        for s, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s)), pa.array(at), pa.array(n[at])], names=["s", "key", "n"])

    rows = docs.select(text).mapInArrow(tally, "s long, key long, n long").groupBy("s", "key").agg(F.sum("n").alias("n"))
    out: dict[int, dict[int, int]] = {}
    for r in rows.collect():  # at most one row for each shingle of the block
        out.setdefault(r.s, {})[r.key] = r.n
    keys.destroy()
    return out


def _schema(docs: DataFrame, id_: str, benchmark: DataFrame, item_id: str) -> T.StructType:
    longs = T.ArrayType(T.LongType())
    items = T.ArrayType(benchmark.schema[item_id].dataType)
    kinds = {"n_words": T.LongType(), "starts": longs, "sizes": longs, "items": items, "longest": T.LongType()}
    fields = [T.StructField("id", docs.schema[id_].dataType)]
    return T.StructType(fields + [T.StructField(n, k) for n, k in kinds.items()])


def _hits(docs: DataFrame, id_: str, text: str, prefixes: Prefixes, schema: T.StructType) -> DataFrame:
    """Per document its words and, merged, the spans of words inside windows, the items found and the longest window."""
    held = docs.sparkSession.sparkContext.broadcast(prefixes)
    item_type = to_arrow_type(schema["items"].dataType.elementType)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        ids = pa.array(p.windows.ids, item_type)
        for b in batches:
            for row, buf, off in texts(b.column(1)):
                w = Words(buf, off, ALNUM)
                start, win = p.match(w)
                m, n, size_of = len(w.count), len(w.hash), p.windows.size[win]
                edge = np.zeros(n + 1, dtype=np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + size_of, -1)
                hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
                begin, cut = hit[1:-1] & ~hit[:-2], hit[1:-1] & ~hit[2:]
                inner = w.first[1:-1]
                inner = inner[(inner > 0) & (inner < n)]
                begin[inner] |= hit[1:-1][inner]
                cut[inner - 1] |= hit[inner]
                begin, size = np.flatnonzero(begin), np.flatnonzero(cut) + 1
                size -= begin
                doc = np.searchsorted(w.first, begin, "right") - 1
                spans = np.searchsorted(doc, np.arange(m + 1)).astype(np.int32)
                of = np.searchsorted(w.first, start, "right") - 1
                longest = np.zeros(m, dtype=np.int64)
                np.maximum.at(longest, of, size_of)
                found = np.unique(np.stack([of, p.windows.item[win]], 1), axis=0)
                items = np.searchsorted(found[:, 0], np.arange(m + 1)).astype(np.int32)
                lists = lambda o, v: pa.ListArray.from_arrays(pa.array(o), v)
                columns = [
                    b.column(0).slice(row, m),
                    pa.array(w.count.astype(np.int64)),
                    lists(spans, pa.array(begin - w.first[doc])),
                    lists(spans, pa.array(size)),
                    lists(items, ids.take(pa.array(found[:, 1]))),
                    pa.array(longest),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(id_, text).mapInArrow(find, schema)


def _unite(parts: list[DataFrame]) -> DataFrame:
    """One row per key from the blocks' rows; overlapping spans are merged."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    spans = F.flatten(F.collect_list(F.arrays_zip("starts", "sizes")))
    every = every.groupBy("id").agg(
        F.max("n_words").alias("n_words"),
        spans.alias("s"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.max("longest").alias("longest"),
    )

    def merge(done, span):
        last, end = F.element_at(done, -1), span["starts"] + span["sizes"]
        joined = F.struct(last["a"].alias("a"), F.greatest(last["b"], end).alias("b"))
        touches = (F.size(done) > 0) & (last["b"] >= span["starts"])
        fresh = F.concat(done, F.array(F.struct(span["starts"].alias("a"), end.alias("b"))))
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(fresh)

    none = F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")
    every = every.withColumn("m", F.aggregate(F.array_sort("s"), none, merge))
    sizes = F.transform("m", lambda x: x["b"] - x["a"])
    return every.select("id", "n_words", F.col("m.a").alias("starts"), sizes.alias("sizes"), "items", "longest")


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Rows ``(id, n_words, starts, sizes, items, longest)``, one for each row of docs.

    starts and sizes are the spans of words inside windows of items, items the ids of these items, longest the words of
    the longest window found (0: none).
    """

    def blocks() -> Iterator[list]:
        block, words = [], 0
        rows = benchmark.where(F.col(item_id).isNotNull()).select(item_id, item_text).orderBy(item_id, item_text)
        for r in rows.toLocalIterator():
            n = len(r[1] or "") // 2 + 1
            if block and words + n > block_words:
                yield block
                block, words = [], 0
            block.append((r[0], r[1]))
            words += n
        yield block

    def hits(rows: DataFrame, key: str, column: str, block: list) -> DataFrame:
        windows = Windows(block, window)
        seen = _count(rows, column, windows) if block else {}
        return _hits(rows, key, column, Prefixes(windows, seen), _schema(rows, key, benchmark, item_id))

    every = blocks()
    first, second = next(every), next(every, None)
    if second is None:
        return hits(docs, id_, text, first)
    own = F.monotonically_increasing_id().alias("row")
    rows = written(docs.select(own, F.col(id_).alias("id"), F.col(text).alias("text")), "rows")
    found = _unite([hits(rows, "row", "text", b) for b in chain([first, second], every)])
    return rows.select("row", "id").join(found.withColumnRenamed("id", "row"), "row").drop("row")


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20, **names) -> DataFrame:
    """benchmark_hits() with ``n_hit``, ``n_items`` and ``contaminated``: hit, and at least one word in ``share`` is."""
    hits = benchmark_hits(docs, benchmark, **names)
    hits = hits.withColumn("n_hit", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))
    much = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return hits.withColumns({"n_items": F.size("items").cast("long"), "contaminated": much})


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = contamination(docs, bench)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    items = F.sha2(names, 256).alias("items_sha256")
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", items, "contaminated")


#: Words of a window that make a document contaminated for the stage, however long the document is.
STAGE_WINDOW = 13


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents go that hold a whole window of ``STAGE_WINDOW`` words, or are contaminated by their share.

    Windows of shorter items are plain phrases that clean documents hold too, so these count by their share alone. Rows
    are judged one by one, and pass through whole.
    """
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.withColumn("body", F.col("row.text"))
    found = contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_="row", text="body")
    return found.where(~F.col("contaminated") & (F.col("longest") < STAGE_WINDOW)).select("id.*")


OP8_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), dg AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win))
), m AS (SELECT dg.doc_id, dg.i, dg.k, win.item_id FROM dg JOIN win USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
