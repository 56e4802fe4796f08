"""Line dedup: of lines that are equal or within one edit of each other, the earliest stays.

Order: document id, the text's hash (for rows with one id), line number. A line goes if an equal line, or one within an
edit distance of 1 (a character put in, left out or replaced), comes earlier, whether or not that one stays. Lines of
fewer than ``min_chars`` characters (the shorter of two) must be equal, as one edit is much of a short line: "1." and "2."
are no copies. With 0 all lines are compared. Empty lines always stay.

Deletion-neighbourhood join, with hashed keys:

1. One pass gives each line's hash (128 bits of BLAKE2, which stand for the line), another coarse keys: the line with
   one of ``COARSE`` blocks left out. One edit lies in one block, so two lines within the bound share the coarse key of
   that block (a line counts as its own length and as one less, so that lines of neighbouring lengths cut alike). Lines
   that share no key with another are done; for the others the same is asked with ``FINE`` blocks.
2. Only where fine keys are met by different lines are all variants emitted: the line with each single character of
   that block left out, and the line itself, as the partner of one that is longer by a character. A variant with the
   place of the left-out character stands for replacements there; without it, for insertions.
3. Equal variants are joined by taking the earliest line of each key, not by pairs. Keys are few lines wide by nature:
   their lines differ in one character at one place.
4. The pairs found are verified by their edit distance on the texts.

Counts of equal lines are summed before they are shuffled, so a line that a third of the documents share is no burden.
Which lines and keys a later pass is to look at is told by Bloom filters of bounded size (``FILTER_BITS``), so texts need
not be shuffled for it, at any size: where a filter is too small for the corpus more lines pass than need to, never fewer.
Texts are shuffled once, to their removed lines at the end.

Hashes of parts of lines are polynomials modulo two primes. They only find candidates, which are verified.

Edge cases: a null or empty text is one empty line; documents without an id keep all their lines and take none from
others; rows with one id and different texts are told apart; rows equal in id and text are one document, whose lines all
of them keep or lose; very long lines are handled whole; other columns are kept, whatever their names, but columns
``n_lines`` and ``n_kept`` are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm._shared import discard, written
from larkspur.llm._text import CHUNK, U, mix, texts

MIN_CHARS = 20
COARSE, FINE = 4, 16

#: Bits of the largest filter; smaller tables take 16 bits a key.
FILTER_BITS = 26
_SLICES = 16

# polynomials modulo two primes

_PRIMES = np.array([4294967291, 4294967279], dtype=U)
_BASES = (0x6C8E9CF5, 0x9E3779B1)
#: So many bytes can be summed up before a number is too large.
_SAFE = 1 << 22


def _run(base: int, prime: int, n: int) -> np.ndarray:
    """The powers 0, 1, ... of base."""
    out = np.ones(1, dtype=U)
    while len(out) < n:
        out = np.concatenate([out, out * U(pow(base, len(out), prime)) % U(prime)])
    return out[:n]


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the bases and of their inverses, a row for each prime."""
    if not _powers or _powers[0].shape[1] < n:
        size, primes = max(n, CHUNK + 1), [int(p) for p in _PRIMES]
        both = [(b, pow(b, -1, p), p) for b, p in zip(_BASES, primes, strict=True)]
        _powers[:] = [np.stack([_run(x[k], x[2], size) for x in both]) for k in (0, 1)]
    return _powers[0][:, :n], _powers[1][:, :n]


def _totals(buf: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * power up to each place, modulo each prime or not yet."""
    out = np.zeros((2, len(buf) + 1), dtype=U)
    byte = buf.astype(U) + U(1)
    for k in (0, 1):
        each = byte * up[k]
        if len(buf) > _SAFE:
            each %= _PRIMES[k]
        np.cumsum(each, out=out[k, 1:])
    return out


def _one(x: np.ndarray) -> np.ndarray:
    return (x[0] << U(32)) | x[1]


class Lines:
    """Lines of some texts; ``first[d]:first[d+1]`` are those of text d. Offsets are bytes into ``buf``."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, n = buf, len(buf)
        breaks = np.flatnonzero(buf == 10)
        # a text's lines begin at its start and after each break
        self.start = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
        self.end = np.sort(np.concatenate([off[1:], breaks]), kind="stable")
        per = np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1]) + 1
        self.first = np.concatenate([[0], np.cumsum(per)])
        self._total = self._down = None
        self.chars = np.flatnonzero((buf & 0xC0) != 0x80)
        self.base = np.searchsorted(self.chars, self.start)
        self.count = np.searchsorted(self.chars, self.end) - self.base

    def rough(self, lines: np.ndarray) -> np.ndarray:
        """64 bits of each of some lines."""
        return mix(_one(self.part(self.start[lines], self.end[lines])))

    def hashes(self, lines: np.ndarray) -> np.ndarray:
        """128 bits of each of some lines, as two numbers."""
        data, digest = self.buf.tobytes(), hashlib.blake2b
        cut = zip(self.start[lines].tolist(), self.end[lines].tolist(), strict=True)
        return np.frombuffer(b"".join([digest(data[a:b], digest_size=16).digest() for a, b in cut]), np.int64).reshape(-1, 2)

    def part(self, a, b, to=None) -> np.ndarray:
        """Polynomials of the bytes a..b, as if they began at 0, or at a - to."""
        if self._total is None:
            up, self._down = _power(len(self.buf) + 1)
            self._total = _totals(self.buf, up[:, :-1])
        p = _PRIMES[:, None]
        return (self._total[:, b] - self._total[:, a]) % p * self._down[:, a if to is None else to] % p

    def at(self, line, k) -> np.ndarray:
        """Byte offset of a line's character k; its end for the last and one more."""
        i = self.base[line] + k
        inside = np.minimum(i, len(self.chars) - 1)
        return np.where(k < self.count[line], self.chars[inside], self.end[line])

    def coarse(self, line: np.ndarray, length: np.ndarray, block: int, blocks: int) -> np.ndarray:
        """Key of lines without one of some blocks, cut as for the given length."""
        a, b = block * length // blocks, (block + 1) * length // blocks
        left = _one(self.part(self.start[line], self.at(line, a)))
        right = _one(self.part(self.at(line, self.count[line] - (length - b)), self.end[line]))
        with np.errstate(over="ignore"):
            return mix(mix(left) * U(3) + mix(right ^ U(0x5555)) * U(5) + (length.astype(U) * U(blocks) + U(block)) * U(0x9E3779B97F4A7C15))

    def variants(self, line: np.ndarray, less: int, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, string's key, place) of lines without a character, for the edits inside one of FINE blocks of each."""
        length = self.count[line] - less
        low = block * length // FINE
        n = (block + 1) * length // FINE + less - low
        entry = np.repeat(np.arange(len(line)), n)
        k = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + low[entry]
        of = line[entry]
        a, b = self.at(of, k), self.at(of, k + 1)
        left = self.part(self.start[of], a)
        right = self.part(b, self.end[of], self.start[of] + (b - a))
        return entry, mix(_one((left + right) % _PRIMES[:, None])), k


# filters


class Filter:
    """A Bloom filter with two bits a key."""

    def __init__(self, bits: int):
        self.bits, self.table = bits, np.zeros(1 << (bits - 3), np.uint8)

    def places(self, keys: np.ndarray) -> np.ndarray:
        h, mask = mix(keys.view(U)), U((1 << self.bits) - 1)
        return np.stack([h & mask, (h >> U(32)) & mask]).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys)
        return ((self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)


def _filter(rows: DataFrame, keys) -> Filter:
    """A filter of keys(batch) of the rows of a written table; bits are joined in executors, slice by slice."""
    n = rows.count()
    out = Filter(min(FILTER_BITS, max(10, (16 * n).bit_length())))
    width = len(out.table) * 8 // _SLICES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(out.places(keys(b)))
            for k, own in enumerate(np.split(at, np.searchsorted(at, width * np.arange(1, _SLICES)))):
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([(own - k * width).astype(np.uint32).tobytes()])], names=["slice", "at"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for b in batches:
            for k, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tables.setdefault(k, np.zeros(width, bool))[np.frombuffer(at, np.uint32)] = True
        for k, t in tables.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(t, bitorder="little").tobytes()])], names=["slice", "at"])

    schema = "slice long, at binary"
    for r in rows.mapInArrow(mark, schema).repartition(_SLICES, "slice").mapInArrow(join, schema).collect():
        out.table[r.slice * (width >> 3) : (r.slice + 1) * (width >> 3)] = np.frombuffer(r.at, np.uint8)
    return out


def _document(id_: np.ndarray, version: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(id_.view(U) * U(0x9E3779B97F4A7C15) + mix(version.view(U) + U(0x632BE59BD9B4E019)))


def _place(document: np.ndarray, no: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(document + (no + 1).astype(U) * U(0xD1B54A32D192ED03))


def _places(rows: DataFrame) -> Filter:
    """A filter of the lines, and the documents, that rows (id, version, no) name."""

    def keys(b: pa.RecordBatch) -> np.ndarray:
        document = _document(b.column(0).to_numpy(), b.column(1).to_numpy())
        return np.concatenate([document, _place(document, b.column(2).to_numpy())])

    return _filter(rows, keys)


def _numbers(rows: DataFrame) -> Filter:
    return _filter(rows, lambda b: b.column(0).to_numpy())


_KEY = ["id", "version"]


def _rows(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, version, body): version tells rows with one id and different texts apart."""
    rows = docs.select(F.col(id_).cast("long").alias("id"), F.xxhash64(text).alias("version"), F.col(text).alias("body"))
    return rows.where("id IS NOT NULL")


def _index(rows: DataFrame) -> DataFrame:
    """Rows (id, version, no, h, g): every line that is not empty, h and g being its hash."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, buf, off in texts(b.column(2)):
                x = Lines(buf, off)
                doc = np.repeat(np.arange(len(off) - 1), np.diff(x.first))
                no = np.arange(len(doc)) - x.first[doc]
                some = np.flatnonzero(x.end > x.start)
                h, of = x.hashes(some), pa.array(row + doc[some])
                columns = [*(b.column(k).take(of) for k in (0, 1)), pa.array(no[some].astype(np.int64)), pa.array(h[:, 0]), pa.array(h[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "version", "no", "h", "g"])

    return rows.mapInArrow(read, "id long, version long, no long, h long, g long")


def _chosen(batch: pa.RecordBatch, places: Filter | None, min_chars: int) -> Iterator[tuple[Lines, np.ndarray]]:
    """Lines of runs of texts, and which of them are long enough and among the places."""
    if places is not None:
        document = _document(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        batch = batch.filter(pa.array(places.has(document)))
    if not batch.num_rows:
        return
    document = _document(batch.column(0).to_numpy(), batch.column(1).to_numpy())
    for row, buf, off in texts(batch.column(2)):
        x = Lines(buf, off)
        some = np.flatnonzero((x.count >= max(1, min_chars)) & (x.end > x.start))
        if places is not None:
            doc = np.searchsorted(x.first, some, "right") - 1
            some = some[places.has(_place(document[row + doc], some - x.first[doc]))]
        yield x, some


def _keys(rows: DataFrame, blocks: int, min_chars: int, held: list, places: Filter | None = None, met: Filter | None = None) -> DataFrame:
    """Rows (key, h): keys of the lines (of some places; those that a filter has), with one of some blocks left out.

    h is rough unless there are places or keys to look for. held gets the broadcast, to be destroyed after use.
    """
    sent = rows.sparkSession.sparkContext.broadcast((places, met))
    held.append(sent)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, met = sent.value
        for b in batches:
            for x, some in _chosen(b, places, min_chars):
                keys, lines = [], []
                for less in (0, 1):
                    line = some[x.count[some] >= max(1, min_chars) + less]
                    for block in range(blocks):
                        keys.append(x.coarse(line, x.count[line] - less, block, blocks))
                        lines.append(line)
                keys, lines = np.concatenate(keys), np.concatenate(lines)
                if met is not None:
                    own = met.has(keys)
                    keys, lines = keys[own], lines[own]
                if places is None and met is None:
                    h = x.rough(lines).view(np.int64)
                else:
                    each, of = np.unique(lines, return_inverse=True)
                    h = x.hashes(each)[:, 0][of]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(h)], names=["key", "h"])

    return rows.mapInArrow(read, "key long, h long")


def _met(keys: DataFrame) -> DataFrame:
    """The keys that different lines have."""
    return keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a < b").select("key")


def _emit(rows: DataFrame, places: Filter, met: Filter, min_chars: int, held: list) -> DataFrame:
    """Rows (h, g, line, v, kind) of the lines at some places: variants in the blocks whose fine keys are met."""
    sent = rows.sparkSession.sparkContext.broadcast((places, met))
    held.append(sent)

    def variants(x: Lines, some: np.ndarray, met: Filter) -> np.ndarray:
        """Rows (line, key, kind) in order: 0 a replacement at a place, 1 the longer line of an insertion, 2 the shorter."""
        out = [np.zeros((0, 3), np.int64)]
        for less in (0, 1):
            line = some[x.count[some] - less >= max(1, min_chars)]
            own = np.stack([met.has(x.coarse(line, x.count[line] - less, k, FINE)) for k in range(FINE)], 1)
            at, block = np.nonzero(own)
            entry, v, k = x.variants(line[at], less, block)
            with np.errstate(over="ignore"):
                replaced = mix(v + (k + 2).astype(U) * U(0xD1B54A32D192ED03))
            parts = [(line[at][entry], replaced, 0), (line[at][entry], v, 1)]
            if not less:
                whole = line[own.any(1)]
                parts.append((whole, x.rough(whole), 2))
            out += [np.stack([i, key.view(np.int64), np.full(len(i), kind)], 1) for i, key, kind in parts]
        every = np.concatenate(out)
        every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
        return every[np.concatenate([[True], (every[1:] != every[:-1]).any(1)])] if len(every) else every

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, met = sent.value
        for b in batches:
            for x, some in _chosen(b, places, min_chars):
                every = variants(x, some, met)
                line, first = np.unique(every[:, 0], return_index=True)
                h = x.hashes(line)
                where = pa.array(np.append(first, len(every)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(where, pa.array(np.ascontiguousarray(every[:, k]))) for k in (1, 2)]
                cut = zip(x.start[line].tolist(), x.end[line].tolist(), strict=True)
                text = pa.array([x.buf[a:b].tobytes().decode() for a, b in cut], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), text, *lists], names=["h", "g", "line", "v", "kind"])

    return rows.mapInArrow(read, "h long, g long, line string, v array<long>, kind array<long>")


def removed_lines(docs: DataFrame, id_: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (id, version, no): the lines that go; version is xxhash64 of the text."""
    rows, line, held = _rows(docs, id_, text), ["h", "g"], []
    index = written(_index(rows), "lines")
    # per distinct line its earliest place
    lines = index.groupBy(*line).agg(F.min(F.struct(*_KEY, "no", *line)).alias("at"), F.count("*").alias("n"))
    lines = written(lines, "distinct")
    met = written(_met(_keys(rows, COARSE, min_chars, held)), "met")
    found = _keys(rows, COARSE, min_chars, held, met=_numbers(met)).join(met, "key").select("h").distinct()
    some = written(lines.join(found, "h", "left_semi").select("at.*", "at"), "places")
    fine = written(_keys(rows, FINE, min_chars, held, _places(some.select(*_KEY, "no"))), "fine")
    met = written(_met(fine), "met")
    near = written(some.join(fine.join(met, "key").select("h").distinct(), "h", "left_semi").select(*_KEY, "no"), "near")
    emitted = _emit(rows, _places(near), _numbers(met), min_chars, held)
    emitted = written(emitted.dropDuplicates(line), "variants")
    discard(fine, near)
    for sent in held:
        sent.destroy()
    each = emitted.select(*line, F.explode(F.arrays_zip("v", "kind")).alias("x")).select(*line, "x.v", "x.kind")
    each = each.join(some.select(*line, "at"), line)
    group = Window.partitionBy("v", F.expr("kind > 0"))
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("at"))).over(group)
    by = F.when(F.col("kind") == 0, first(0)).when(F.col("kind") == 1, first(2)).otherwise(first(1))
    pairs = each.withColumn("by", by).where("by < at").select(*line, F.col("by.h").alias("h2"), F.col("by.g").alias("g2")).distinct()
    words = emitted.select(*line, "line")
    pairs = pairs.join(words, line).join(words.toDF("h2", "g2", "other"), ["h2", "g2"])
    close = written(pairs.where(F.levenshtein("line", "other", 1).between(0, 1)).select(*line).distinct(), "close")
    again = lines.where("n > 1").select(*line, "at").join(close.withColumn("all", F.lit(True)), line, "full")
    again = written(again.select(*line, F.when(F.col("all").isNull(), F.col("at")).alias("keep")), "again")
    gone = index.join(again, line)
    other = "keep IS NULL OR id <> keep.id OR version <> keep.version OR no <> keep.no"
    return gone.where(other).select(*_KEY, "no")


def dedup_lines(docs: DataFrame, id_: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with its text's removed lines left out, and ``n_lines`` and ``n_kept``."""
    gone = removed_lines(docs, id_, text, min_chars).groupBy(*_KEY).agg(F.collect_set("no").alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_).cast("long").alias("id"), F.xxhash64(text).alias("version"))
    rows = rows.join(written(gone, "removed"), _KEY, "left")
    rows = rows.withColumn("lines", F.split(F.coalesce(f"row.`{text}`", F.lit("")), "\n"))
    stays = F.filter("lines", lambda _, i: ~F.array_contains("gone", i.cast("long")))
    rows = rows.withColumn("kept", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(stays))
    added = {"n_lines": F.size("lines").cast("long"), "n_kept": F.size("kept").cast("long")}
    columns = [F.array_join("kept", "\n").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c not in added]
    return rows.select(*columns, *(v.alias(c) for c, v in added.items()))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_kept", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = """
WITH l AS MATERIALIZED (SELECT doc_id, i AS no, t[i] AS line FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents))),
d AS MATERIALIZED (SELECT line, min((doc_id, no)) AS pl FROM l WHERE line <> '' GROUP BY 1),
k AS MATERIALIZED (SELECT line, pl, n, len(line) AS m FROM (SELECT line, pl, unnest([len(line), len(line) - 1]) AS n FROM d) WHERE n >= 20),
p AS (SELECT a.line AS line, b.line AS other FROM k a JOIN k b ON a.n = b.n AND left(a.line, CAST(a.n // 2 AS BIGINT)) = left(b.line, CAST(b.n // 2 AS BIGINT)) AND b.pl < a.pl
  UNION SELECT a.line, b.line FROM k a JOIN k b ON a.n = b.n AND right(a.line, CAST(a.n // 2 AS BIGINT)) = right(b.line, CAST(b.n // 2 AS BIGINT)) AND b.pl < a.pl),
close AS (SELECT DISTINCT line FROM p WHERE abs(len(line) - len(other)) <= 1 AND (levenshtein(line, other) <= 1 OR (
  len(line) = len(other) AND list_sum([CASE WHEN line[i] <> other[i] THEN 1 ELSE 0 END FOR i IN range(1, len(line) + 1)]) <= 1) OR (
  len(line) <> len(other) AND levenshtein(line, other) <= 4 AND len(list_filter(range(0, greatest(len(line), len(other))), lambda i: (CASE WHEN len(line) > len(other) THEN line[:i] || line[i + 2:] ELSE other[:i] || other[i + 2:] END) = (CASE WHEN len(line) > len(other) THEN other ELSE line END))) > 0))),
f AS (SELECT doc_id, no, l.line, l.line = '' OR (close.line IS NULL AND (doc_id, no) = d.pl) AS keep FROM l LEFT JOIN d ON l.line = d.line LEFT JOIN close ON l.line = close.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keep) AS n_kept, sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (keep), '')) AS kept_sha256 FROM f GROUP BY 1
"""
