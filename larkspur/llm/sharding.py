"""Sharding: size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder in any file system that Spark writes to:

    data/<commit>/...parquet     immutable shards
    manifest/v<number>-<commit>/ the manifest of that version: a Parquet table (path, rows, bytes, tier, folder, peers)
    manifest/v<number>.commit    names that table; this file's appearance is the commit

append() writes arrivals as they come, one small shard a task, and commits the old manifest and the new shards.
compact() looks at the sizes: tier t holds shards of up to ``base * fanout**t`` bytes. Wherever a tier has at least
``fanout`` shards (or ``finish`` is set: wherever more than one shard is below the target), they are merged into shards
of about the target size, by tasks that each read some shards and write one: nothing is shuffled. This repeats until
no tier is full. Shards of the target size stay as they are.

The commit file is written under another name and renamed without overwriting, so it is whole whenever it is seen. Of two
writers that work from the same version one fails and changes nothing. That holds where the file system renames
atomically and refuses an existing name (HDFS and its like); local disks look first and rename then, and plain object
stores need a file system client with conditional writes. Readers follow the newest commit file that can be read; what a
failed writer left behind is never read, and a file broken by other means is passed over.

vacuum() deletes what the newest version does not name and is older than a retention time, so that shards another writer
has not committed yet, and versions that somebody still reads, stay. A commit that names files which are gone fails.

What reaches the driver: the tiers' totals, and the shards' folders; single paths only for folders whose shards do not all
go together (read() and compact() hand whole folders to Spark, which lists them itself). Manifests are written in parts.

Edge cases: an empty arrival commits a version without new shards; an empty store reads as no rows in the schema of the
arrivals; nulls, repeated rows and any columns are kept as they are; a row larger than the target makes a larger shard.
The pipeline's stage adds columns ``shard``, ``shard_bytes`` and ``manifest_version``, and replaces such as are there.
"""

from __future__ import annotations

import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.storage import fresh_path

TARGET_BYTES = 128 << 20
BASE_BYTES = 1 << 20
FANOUT = 4
#: Seconds for which vacuum() leaves alone what no manifest names.
RETAIN = 86_400.0
_ENTRY = "path string, rows long, bytes long, tier int, folder string, peers long"


class Conflict(RuntimeError):
    """Another writer committed first."""


class Lost(RuntimeError):
    """Shards that a commit was to name are gone."""


class Store:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET_BYTES, base: int = BASE_BYTES, fanout: int = FANOUT):
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.base, self.fanout = target, base, fanout
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop(self.path).getFileSystem(self._conf)

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    # versions

    def _numbers(self) -> list[int]:
        """Numbers of the commit files, the newest first."""
        folder = self._hadoop(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted((int(n[1:-7]) for n in names if n.startswith("v") and n.endswith(".commit")), reverse=True)

    def _table(self, version: int) -> str | None:
        """The manifest's folder; None where the commit file cannot be read."""
        try:
            stream = self._fs.open(self._hadoop(f"{self.path}/manifest/v{version:08d}.commit"))
            try:
                return stream.readUTF()
            finally:
                stream.close()
        except Py4JJavaError as e:
            if any(x in str(e.java_exception) for x in ("EOFException", "UTFDataFormatException", "ChecksumException")):
                return None
            raise

    def version(self) -> int:
        """The newest committed version; 0: none."""
        return next((n for n in self._numbers() if self._table(n)), 0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _ENTRY)
        table = self._table(version)
        if table is None:
            raise ValueError(f"the commit file of version {version} cannot be read")
        return self.spark.read.schema(_ENTRY).parquet(f"{self.path}/manifest/{table}")

    def _next(self) -> int:
        """The number of the next commit; to be asked before the version that is built upon."""
        return max([0, *self._numbers()]) + 1

    def _commit(self, entries: DataFrame, version: int) -> int:
        """Commits entries as a version; version is what _next() said before the work began."""
        table = f"v{version:08d}-{uuid.uuid4().hex}"
        written = f"{self.path}/manifest/{table}"
        entries.select(*(f.split()[0] for f in _ENTRY.split(", "))).hint("rebalance").write.parquet(written)
        gone = [p for p in self._paths(self.spark.read.schema(_ENTRY).parquet(written)) if not self._fs.exists(self._hadoop(p))]
        if gone:
            raise Lost(f"{len(gone)} files or folders are gone, {gone[0]} among them")
        draft = self._hadoop(f"{self.path}/manifest/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.writeUTF(table)
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._hadoop(self.path).toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._hadoop(f"{self.path}/manifest/v{version:08d}.commit"), none)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise Conflict(f"version {version} was committed by another writer") from e
            raise
        return version

    # shards

    def _tier(self, size):
        return F.greatest(F.lit(0), F.ceil(F.log(size / F.lit(float(self.base))) / math.log(self.fanout))).cast("int")

    def _write(self, df: DataFrame) -> DataFrame:
        """Writes one shard a task; their entries."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        # counts come from the files' footers; a shard without rows is not listed
        found = self.spark.read.schema(df.schema).parquet(folder)
        file = [F.col(f"_metadata.file_{k}").alias(a) for k, a in (("path", "path"), ("size", "bytes"))]
        entries = found.groupBy(*file).agg(F.count("*").alias("rows"))
        more = {"tier": self._tier(F.col("bytes")), "folder": F.lit(folder), "peers": F.lit(entries.count())}
        return entries.withColumns(more)

    def append(self, df: DataFrame) -> int:
        number, now = self._next(), self.manifest()
        return self._commit(now.unionByName(self._write(df)), number)

    def _paths(self, entries: DataFrame) -> list[str]:
        """What to read for some shards: folders all of whose shards are among them, and the others' single paths."""
        per = entries.groupBy("folder", "peers").agg(F.count("*").alias("n"))
        whole = [r.folder for r in per.where("n = peers").select("folder").toLocalIterator()]
        parts = entries.join(per.where("n < peers").select("folder"), "folder", "left_semi").select("path")
        return sorted([*whole, *(r.path for r in parts.toLocalIterator())])

    def compact(self, schema=None, finish: bool = False) -> int:
        """Merges until no tier is full; returns the version reached."""
        while True:
            number, before = self._next(), self.version()
            now = self.manifest(before)
            open_ = now.where(F.col("bytes") < self.target * 3 // 4)
            tiers = open_.groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("size")).orderBy("tier").collect()
            full = [t for t in tiers if t.n >= self.fanout and math.ceil(t.size / self.target) < t.n]
            if not full and finish and sum(t.n for t in tiers) > math.ceil(sum(t.size for t in tiers) / self.target):
                full = tiers
            if not full:
                return before
            chosen = (F.col("bytes") < self.target * 3 // 4) & F.col("tier").isin([t.tier for t in full])
            reader = self.spark.read if schema is None else self.spark.read.schema(schema)
            # tasks of whole neighbouring shards, similar in size; no shuffle
            tasks = max(1, round(sum(t.size for t in full) / self.target))
            merged = self._write(reader.parquet(*self._paths(now.where(chosen))).coalesce(tasks))
            self._commit(now.where(~chosen).unionByName(merged), number)

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version's shards."""
        paths = self._paths(self.manifest(version))
        if not paths:
            paths = [f"{self.path}/empty"]
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(paths[0])
        return self.spark.read.schema(schema).parquet(*paths)

    def vacuum(self, retain: float = RETAIN) -> int:
        """Deletes shards and manifests that the newest version does not name and that have been there for ``retain``
        seconds; returns how many folders and files went. 0 only where nobody else uses the store."""
        until = (time.time() - retain) * 1000 if retain else float("inf")
        version = self.version()
        live = {self._hadoop(p).toUri().getPath() for p in self._paths(self.manifest(version))}
        gone = 0
        data, manifests = (self._hadoop(f"{self.path}/{k}") for k in ("data", "manifest"))
        for folder in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if folder.getPath().toUri().getPath() in live:
                continue
            files = [f for f in self._fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            dead = [f for f in files if f.getPath().toUri().getPath() not in live]
            if any(f.getModificationTime() > until for f in (*dead, folder)):
                continue
            if len(dead) == len(files):
                gone += self._fs.delete(folder.getPath(), True)
            else:
                gone += sum(self._fs.delete(f.getPath(), False) for f in dead)
        for entry in self._fs.listStatus(manifests) if self._fs.exists(manifests) else []:
            if not entry.getPath().getName().startswith(f"v{version:08d}") and entry.getModificationTime() <= until:
                gone += self._fs.delete(entry.getPath(), True)
        return gone


def shard(df: DataFrame, path: str, finish: bool = True, retain: float = RETAIN, **sizes) -> Store:
    """Appends df to the store at path, compacts it and removes what was merged away ``retain`` seconds ago."""
    store = Store(df.sparkSession, path, **sizes)
    store.append(df)
    store.compact(df.schema, finish)
    store.vacuum(retain)
    return store


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = shard(docs, fresh_path(spark, "shards"), retain=0)  # a store of its own
    text = F.coalesce("text", F.lit("")).cast("binary")
    size, sha = F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256")
    # that no more can be merged, and what the manifest counts, is part of the result
    open_ = F.when(F.col("bytes") < store.target * 3 // 4, F.col("bytes"))
    said = store.manifest().agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count(open_).alias("n"), F.coalesce(F.sum(open_), F.lit(0)).alias("size")).first()
    done = said.n <= math.ceil(said["size"] / store.target)
    more = [F.lit(done).alias("compacted"), F.lit(said["rows"]).alias("manifest_rows")]
    return store.read(docs.schema).select("doc_id", "lang", "source", "n_chars", size, sha, *more)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents as read from their shards, with the name, size and version of the shard each is in."""
    store = shard(docs, fresh_path(spark, "shards"), retain=0)
    name = F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0)
    added = {"shard": name, "shard_bytes": F.col("_metadata.file_size"), "manifest_version": F.lit(store.version())}
    return store.read(docs.schema).withColumns(added)


OP2_SQL = """
SELECT doc_id, lang, source, n_chars, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
  sha256(coalesce(text, '')) AS text_sha256, true AS compacted, (SELECT count(*) FROM documents) AS manifest_rows FROM documents
"""
