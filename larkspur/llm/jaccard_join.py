"""N-gram Jaccard join: texts whose sets of word shingles overlap enough are linked; linked texts form components.

T-occurrence search. A text's partners are those that occur at least T times in the inverted lists of its shingles. The
lists of each search are split (DivideSkip): short lists are merged, which leaves candidates that occur often enough in
them, and the long lists are only probed, by binary search, for these candidates.

How the work is dealt out, all of it without loss:

1. One pass counts shingles over all documents in a table of fixed size, by hash. It only orders shingles, rarest first.
2. A second pass keeps of each document the size and a hash of its set, and the rarest shingles: so many that two
   linked documents must share ``need`` of them. Equal sets become one class, which has a number of its own and knows
   its smallest id.
3. Classes with fewer than ``need`` of these shingles in common with any others link with nothing. The rest are looked
   at by layers of size, so wide that linked sets share a layer; each set is in two. There the same is asked again, twice.
4. The sets of what remains are computed again. Each is held against one other, the pivot (the first class) of most of
   its lists; what links so gets a common label, which takes most groups of near copies out of the way: lists all of
   whose entries have one label are done.
5. The rest is tied to the first class of each shared list (one row per list entry, no pairs), and so falls into
   candidate components. These are dealt out in groups of bounded size: small ones share groups; large ones are dealt list
   by list, or, if that has more entries, cut into blocks, each pair of blocks being one group. In a group the search
   above finds links between classes not yet connected there.
6. The links' connected components are the result.

No list, group of copies or component is ever held by one task as a whole. The work of step 5 grows with the square of
a list's, or a large component's, size divided by the block size, for what is left of them after step 4.

Edge cases: a null or empty text has an empty set and links with nothing; a text of fewer words has its whole sequence
as its only shingle; each of several rows with one id is judged by its own text, so these may have different components
(or, not linked, both the one named by their id); a row without an id has no component; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm._shared import components, discard, small, written
from larkspur.llm._text import SPACED, U, Words, mix, shingles, texts

SKETCH_BITS = 20
_SLICES = 16
#: Shingles held by a group at once (twice as many for a pair of blocks).
BLOCK = 400_000
#: Sets that are held against one pivot in one go.
PORTION = 1000
#: Weight of a long list's length in the choice of how many lists are long.
MU = 0.01


def _counts(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """Documents per bucket of shingles, over all documents; the table's size is fixed."""
    width = (1 << SKETCH_BITS) // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for b in batches:
            for _, buf, off in texts(b.column(0)):
                g, _ = shingles(Words(buf, off, SPACED), words)
                table += np.bincount((g >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(table))
        if table.any():
            slices = pa.array([x.astype(np.uint32).tobytes() for x in table.reshape(_SLICES, width)])
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES)), slices], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(x, np.uint32).astype(np.int64)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([x.tobytes()])], names=["slice", "counts"])

    schema = "slice long, counts binary"
    rows = docs.select(text).mapInArrow(count, schema).repartition(_SLICES, "slice").mapInArrow(add, schema).collect()
    table = np.zeros((_SLICES, width), dtype=np.int64)
    for r in rows:
        table[r.slice] += np.frombuffer(r.counts, np.int64)
    return table.reshape(-1)


class Bound:
    """Links hold from a similarity of ``top / base`` on."""

    def __init__(self, percent: int):
        self.percent = percent

    def least(self, n):
        """Size of the smallest partner, and of the smallest overlap with any."""
        return -(-n * self.percent // 100)

    def overlap(self, n, m):
        """percent * (n + m - o) <= 100 * o"""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def shared(self, n):
        """Length by which the prefix exceeds what one common shingle would take, plus 1; grows with n."""
        return np.maximum(1, n // 20)

    def prefix(self, n):
        return np.minimum(n, n - self.least(n) + self.shared(n))

    def level(self, n: Column) -> Column:
        """Linked sets have the same level or neighbouring ones."""
        return F.floor(F.log(n.cast("double")) / F.lit(math.log(100 / self.percent) + 1e-9)).cast("int")

    def need(self, n: Column) -> Column:
        """Shingles that two linked documents' prefixes share at least: shared() of the smallest partner."""
        return F.greatest(F.lit(1), F.floor(F.ceil(n * F.lit(self.percent) / 100) / 20))


_SIGNATURE = "n long, k1 long, k2 long, prefix array<long>"


def _set_keys(g: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each text's set of shingles."""
    with np.errstate(over="ignore"):
        keys = []
        for salt in (U(0x243F6A8885A308D3), U(0x13198A2E03707344)):
            total = np.concatenate([np.zeros(1, U), np.cumsum(mix(g ^ salt))])
            keys.append(mix(total[first[1:]] - total[first[:-1]]).view(np.int64))
    return keys


def _rows(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, version, text): version tells rows with one id and different texts apart."""
    return docs.select(F.col(id_).cast("long").alias("id"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))


def _signatures(docs: DataFrame, id_: str, text: str, words: int, bound: Bound, counts: np.ndarray) -> DataFrame:
    """A written table."""
    held = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 24) - 1).astype(U))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = held.value
        for b in batches:
            for row, buf, off in texts(b.column(2)):
                g, first = shingles(Words(buf, off, SPACED), words)
                n = np.diff(first)
                d = np.repeat(np.arange(len(n)), n)
                # (count, hash) in one number; equal ones keep the order of their hashes
                order = np.lexsort(((rarity[(g >> U(64 - SKETCH_BITS)).astype(np.int64)] << U(40)) | (g >> U(24)), d))
                p = bound.prefix(n)
                rank = np.arange(len(g)) - np.repeat(first[:-1], n)
                prefix = g[order][rank < np.repeat(p, n)]
                where = np.concatenate([[0], np.cumsum(p)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(where), pa.array(prefix.view(np.int64)))
                own = [b.column(k).slice(row, len(n)) for k in (0, 1)]
                keys = [pa.array(k) for k in _set_keys(g, first)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n.astype(np.int64)), *keys, lists], names=["id", "version", "n", "k1", "k2", "prefix"])

    out = written(_rows(docs, id_, text).mapInArrow(sign, f"id long, version long, {_SIGNATURE}"), "signatures")
    held.destroy()
    return out


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """(k1, k2, tokens) of rows (id, version, text)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, buf, off in texts(b.column(0)):
                g, first = shingles(Words(buf, off, SPACED), words)
                tokens = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(g.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*map(pa.array, _set_keys(g, first)), tokens], names=["k1", "k2", "tokens"])

    return rows.select("text").mapInArrow(compute, "k1 long, k2 long, tokens array<long>")


class Search:
    """T-occurrence search among some sets; sets are ordered by size, and each looks for partners before it."""

    def __init__(self, sets: list[np.ndarray], bound: Bound):
        self.bound = bound
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.n = len(sets)
        token = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(self.n), self.sizes)
        order = np.argsort(token, kind="stable")
        new = np.concatenate([[True], token[order][1:] != token[order][:-1]]) if len(token) else np.zeros(0, bool)
        of = np.cumsum(new) - 1
        self.left = np.concatenate([np.flatnonzero(new), [len(token)]])
        self.entries = doc[order]  # list after list, each ascending
        self.probe = of * self.n + self.entries  # ascending: what binary search looks into
        self.lists = np.empty(len(token), dtype=np.int64)
        self.lists[order] = of
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])

    def _count(self, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Merges lists: (set, occurrences)."""
        total = sum(map(len, lists))
        if total > 64:
            return np.unique(np.concatenate(lists), return_counts=True)
        ids, counts = [], []
        for x in heapq.merge(*(y.tolist() for y in lists)):
            if ids and ids[-1] == x:
                counts[-1] += 1
            else:
                ids.append(x)
                counts.append(1)
        return np.array(ids, dtype=np.int64), np.array(counts, dtype=np.int64)

    def links(self, side: np.ndarray, label: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that connect all that is linked, but for what has one label already; only sets of different sides are
        compared, unless all sides are equal."""
        label = np.arange(self.n) if label is None else label.copy()
        out, one = [], self.n == 0 or bool((side == side[0]).all())
        for q in range(self.n):
            n = int(self.sizes[q])
            low = int(np.searchsorted(self.sizes, self.bound.least(n)))
            if low >= q or not n:
                continue
            lists = self.lists[self.first[q] : self.first[q + 1]]
            a, b = np.searchsorted(self.probe, lists * self.n + low), np.searchsorted(self.probe, lists * self.n + q)
            length = b - a
            t = int(self.bound.least(n))
            if np.count_nonzero(length) < t:
                continue
            order = np.argsort(length, kind="stable")
            long = min(t - 1, int(t / (MU * math.log2(max(2, int(length.max()))) + 1)))
            short, rest = order[: len(order) - long], order[len(order) - long :]
            ids, counts = self._count([self.entries[a[i] : b[i]] for i in short if length[i]])
            if not one and len(ids):
                keep = side[ids] != side[q]
                ids, counts = ids[keep], counts[keep]
            keep = (counts >= t - long) & (label[ids] != label[q]) if len(ids) else counts.astype(bool)
            ids, counts = ids[keep], counts[keep]
            if not len(ids):
                continue
            if len(ids) * len(rest) * 4 > int(length[rest].sum()):
                extra = np.zeros(self.n, dtype=np.int64)
                for i in rest:
                    extra[self.entries[a[i] : b[i]]] += 1
                counts = counts + extra[ids]
                good = counts >= self.bound.overlap(n, self.sizes[ids])
                ids = ids[good]
                verified = True
            else:
                order = np.argsort(-counts, kind="stable")
                ids, counts, verified = ids[order], counts[order], False
            for c, k in zip(ids.tolist(), counts.tolist() if not verified else [0] * len(ids), strict=True):
                if label[c] == label[q]:
                    continue
                if not verified:
                    want = lists[rest] * self.n + c
                    at = np.minimum(np.searchsorted(self.probe, want), len(self.probe) - 1)
                    if k + int((self.probe[at] == want).sum()) < int(self.bound.overlap(n, int(self.sizes[c]))):
                        continue
                out.append((q, c))
                label[label == label[c]] = label[q]
        return out


def _find(bound: Bound):
    def find(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, side = table["id"].to_numpy(), table["side"].to_numpy()
        tokens = table["tokens"].chunk(0) if table["tokens"].num_chunks else pa.array([], pa.list_(pa.int64()))
        off, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy()
        order = np.lexsort((ids, np.diff(off)))
        _, label = np.unique(table["label"].to_numpy(), return_inverse=True)
        links = Search([flat[off[i] : off[i + 1]] for i in order], bound).links(side[order], label[order])
        a = ids[order][[x for x, _ in links]] if links else np.zeros(0, np.int64)
        b = ids[order][[y for _, y in links]] if links else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return find


def _stars(posts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets and the pivot that each shares most lists with.

    A pivot of many sets is joined with them in portions of ``PORTION``.
    """
    per = posts.where("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("c"))
    best = written(per.groupBy("id").agg(F.max(F.struct("c", F.negative("pivot").alias("p"))).alias("m")).select("id", F.negative("m.p").alias("pivot")), "pivots")
    load = best.groupBy("pivot").agg(F.ceil(F.count("*") / PORTION).cast("int").alias("portions"))
    mine = best.join(load, "pivot").select("id", "pivot", F.pmod(F.xxhash64("id"), F.col("portions")).cast("int").alias("portion"))
    theirs = sets.withColumnsRenamed({"id": "pivot", "tokens": "other"}).join(load, "pivot")
    theirs = theirs.withColumn("portion", F.explode(F.sequence(F.lit(0), F.col("portions") - 1))).drop("portions")
    pairs = mine.join(theirs, ["pivot", "portion"]).join(sets, "id")
    both = F.size(F.array_intersect("tokens", "other"))
    return pairs.where((100 + percent) * both >= percent * (F.size("tokens") + F.size("other"))).select(F.col("id").alias("a"), F.col("pivot").alias("b"))


def _dealt(posts: DataFrame, block: int) -> DataFrame:
    """Rows (id, label, side, bucket, x, y): the groups in which each set is compared.

    A unit is a candidate component, or, where that is large and its lists have fewer entries in all than its blocks would
    make, each list of its own. Small units share buckets; large ones are cut into blocks, a group being a pair of these.
    """
    node = lambda c: F.xxhash64(c, "layer")  # noqa: E731  one that stands for two merges their components, which does no harm
    near = components(posts.select(node("id").alias("a"), node("pivot").alias("b"))).withColumnRenamed("id", "node")
    each = posts.groupBy("id", "layer").agg(F.min("n").alias("n"), F.count("*").alias("lists"), F.min("label").alias("label"))
    near = written(near.join(each.withColumn("node", node("id")), "node"), "near")
    blocks = F.ceil(F.sum("n") / block)
    by_list = (blocks > 1) & (F.sum(F.col("lists") * F.col("n")) < blocks * F.sum("n"))
    kind = near.groupBy("component").agg(blocks.cast("int").alias("blocks"), by_list.alias("by_list"))
    near = written(near.join(kind, "component").select("id", "layer", "n", "label", "component", "blocks", "by_list"), "candidates")
    whole = near.where("NOT by_list").select("id", "n", "label", F.col("component").alias("unit"), "blocks")
    parts = posts.join(near.where("by_list").select("id", "layer"), ["id", "layer"], "left_semi")
    parts = parts.select("id", "n", "label", F.xxhash64("token", "layer").alias("unit"))
    large = parts.groupBy("unit").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    units = whole.unionByName(parts.join(large, "unit").select("id", "n", "label", "unit", "blocks"))
    total = units.agg(F.sum("n")).first()[0] or 0
    single = F.col("blocks") == 1
    units = units.withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bucket = F.when(single, F.pmod(F.xxhash64("unit"), F.lit(int(total // block) + 1))).otherwise(F.col("unit"))
    x, y = F.when(single, -1).otherwise(F.least("side", "other")), F.greatest("side", "other")
    return units.select("id", "label", "side", bucket.alias("bucket"), x.alias("x"), y.alias("y")).distinct()


def jaccard_components(docs: DataFrame, id_: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """Rows ``(id, version, n_shingles, group, component)``, one for each row of docs; ids are integers.

    version is the text's hash, group a number of the component, component its smallest id.
    """
    bound = Bound(percent)
    wide = _signatures(docs, id_, text, words, bound, _counts(docs, text, words))
    sets = wide.where("n > 0 AND id IS NOT NULL")
    # one row for each set; copies are summed up before they are shuffled
    classes = sets.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    prefixes = written(classes.withColumn("class", F.monotonically_increasing_id()), "prefixes")
    classes = written(prefixes.drop("n", "prefix"), "classes")
    signs = written(wide.drop("prefix"), "signatures")
    discard(wide)
    posts = prefixes.select(F.col("class").alias("id"), "n", F.explode("prefix").alias("token"))
    shared = posts.groupBy("token").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").select("token")
    hits = written(posts.join(shared, "token"), "hits")
    discard(prefixes)
    enough = F.count("*") >= bound.need(F.min("n"))
    alive = hits.groupBy("id").agg(enough.alias("ok")).where("ok").select("id")
    level = bound.level(F.col("n"))
    posts, last = hits.join(alive, "id", "left_semi").withColumn("layer", F.explode(F.array(level, level + 1))), hits
    for _ in range(2):
        shared = posts.groupBy("token", "layer").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").drop("last")
        hits = posts.drop("pivot").join(shared, ["token", "layer"])
        alive = hits.groupBy("id", "layer").agg(enough.alias("ok")).where("ok").select("id", "layer")
        posts = written(hits.join(alive, ["id", "layer"], "left_semi"), "hits")
        discard(last)
        last = posts
    chosen = classes.select("id", "k1", "k2", "class").join(posts.select(F.col("id").alias("class")).distinct(), "class", "left_semi")
    chosen = written(chosen, "chosen")
    # of several rows with one id all come along; two rows of one class do no harm
    held = _sets(_rows(docs, id_, text).join(small(chosen.select("id").distinct()), "id", "left_semi"), words)
    held = written(held.join(chosen.select("k1", "k2", F.col("class").alias("id")), ["k1", "k2"]).select("id", "tokens"), "sets")
    stars = written(_stars(posts, held, percent), "stars")
    # the pivot's pivot, or the pivot: one label does tell that sets are connected, which is all it is used for
    labels = stars.join(stars.toDF("b", "c"), "b", "left").select(F.col("a").alias("id"), F.coalesce("c", "b").alias("label"))
    posts = posts.drop("pivot").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    shared = posts.groupBy("token", "layer").agg(F.min("id").alias("pivot"), F.min("label").alias("a"), F.max("label").alias("b")).where("a < b")
    posts = posts.join(shared.drop("a", "b"), ["token", "layer"])
    alive = posts.groupBy("id", "layer").agg(enough.alias("ok")).where("ok").select("id", "layer")
    posts = written(posts.join(alive, ["id", "layer"], "left_semi"), "hits")
    discard(last)
    dealt = written(_dealt(posts, block), "dealt").join(held, "id")
    links = dealt.select("id", "label", "tokens", "side", "bucket", "x", "y").groupBy("bucket", "x", "y").applyInArrow(_find(bound), "a long, b long")
    links = written(links.unionByName(stars), "links")
    discard(held, posts)
    found = components(links).withColumnRenamed("id", "class").join(classes.select("class", "id"), "class")
    first = found.groupBy("component").agg(F.min("id").alias("first"))
    found = written(found.join(first, "component").select("class", "component", "first"), "components")
    named = classes.join(small(found), "class", "left")
    named = named.select("k1", "k2", F.coalesce("component", "class").alias("group"), F.coalesce("first", "id").alias("named"))
    out = signs.join(named, ["k1", "k2"], "left")
    some = F.col("n") > 0
    name = F.when(F.col("id").isNotNull(), F.when(some, F.col("named")).otherwise(F.col("id")))
    return out.select("id", "version", F.col("n").alias("n_shingles"), F.when(some, F.col("group")).alias("group"), name.alias("component"))


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    out = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=90)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates (five words, 80 percent) the text with the smallest id stays.

    Rows are told apart by id and text: of rows with one id those with different texts that are not near duplicates all
    stay, of near duplicates under one id the one whose text has the smaller hash, and of rows equal in both one. Rows
    without an id stay.
    """
    found = written(jaccard_components(docs), "found").where("id IS NOT NULL")
    key = ["id", "version"]
    first = found.where("id = component")
    several = first.groupBy("id").agg(F.min("version").alias("a"), F.max("version").alias("b")).where("a < b").select("id")
    mine = written(first.join(several, "id", "left_semi").where("group IS NOT NULL").select(*key, "group").distinct(), "several")
    later = mine.join(mine.groupBy("id", "group").agg(F.min("version").alias("first")), ["id", "group"]).where("version <> first")
    rest = found.where("id <> component").select(*key).unionByName(later.select(*key))
    rest = written(rest.distinct(), "rest")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("version"))
    kept = rows.join(small(rest), key, "left_anti")
    again = written(found.groupBy(*key).count().where("count > 1").select(*key), "again")
    if not again.isEmpty():
        once = kept.join(again, key, "left_semi").dropDuplicates(key)
        kept = kept.join(again, key, "left_anti").unionByName(once)
    return kept.select("row.*")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) END AS s FROM w
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
post AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
rare AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY c, g) AS r
  FROM post JOIN (SELECT g, count(*) AS c FROM post GROUP BY 1) USING (g) JOIN n USING (doc_id)),
pre AS MATERIALIZED (SELECT * FROM rare WHERE r <= n - ((9 * n + 9) // 10) + 1),
cand AS MATERIALIZED (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)),
link AS MATERIALIZED (SELECT x, y FROM (SELECT x, y, nx, ny, count(*) AS o FROM cand JOIN post p ON p.doc_id = x JOIN post q ON q.doc_id = y AND q.g = p.g GROUP BY ALL) WHERE 100 * o >= 90 * (nx + ny - o)),
both_ AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x AS doc_id, x AS y FROM both_ UNION SELECT reach.doc_id, both_.y FROM reach JOIN both_ ON reach.y = both_.x)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c, n.doc_id) AS component_id
FROM n LEFT JOIN (SELECT doc_id, min(y) AS c FROM reach GROUP BY 1) USING (doc_id)
"""
