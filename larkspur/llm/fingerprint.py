"""Document fingerprints by consistent weighted sampling.

A text is a set of terms (its words) weighted by their counts. For each of ``SAMPLES`` samples every term draws, from
its hash, r and c from Gamma(2, 1) and b uniformly; with weight S

    t = floor(ln S / r + b),   ln a = ln c - r * (t - b + 1)

and the sample is the (term, t) with the smallest ln a. Two texts agree in a sample with a probability equal to their
generalised Jaccard similarity (sum of the lesser weights over sum of the greater). Gamma draws are looked up among
``QUANTILES`` quantiles.

All of it is DataFrame expressions. The text that follows each text (in descending order of ids) is found by a window
over ranges of ids. The ranges begin at rows picked by their hash, about one in ``RANGE_ROWS`` (fewer where that gives
more than ``RANGES``), so ids may lie as they like, and no range is empty: the text after a range's last one is the head
of the range below. Only the ranges' bounds, two numbers each, come to the driver.

Edge cases: a null or empty text has one reserved term, so it is like its like and nothing else; ids are integers; rows
with one id follow each other in the order of their texts' hashes, so any number of them is split as well, only rows
equal in id and text are one range; rows without an id come last, like the least id; a single text follows itself; equal
texts have equal fingerprints whatever else differs; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm._shared import written

SAMPLES = 48
_PER_ROW = 4
QUANTILES = 4096
RANGE_ROWS, RANGES = 1024, 1 << 16


def _gamma_quantile(p: float) -> float:
    """x with 1 - (1 + x) * exp(-x) = p."""
    low, high = 0.0, 60.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - (1 + mid) * math.exp(-mid) < p else (low, mid)
    return (low + high) / 2


def _numbers(values) -> Column:
    """An array constant; folded into one literal before the plan runs."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def terms(text: Column) -> Column:
    """Array of (h, s): hash of each distinct word, and the log of its count; without words (0, 0)."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    hashes = F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))

    def runs(h: Column) -> Column:
        places = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))
        ends = lambda s: F.concat(F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), F.array(F.size(h)))
        return let(starts, lambda s: F.when(F.size(s) > 0, F.zip_with(s, ends(s), lambda a, b: F.struct(h[a].alias("h"), F.coalesce(F.log((b - a).cast("double")), F.lit(0.0)).alias("s")))).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("h"), F.lit(0.0).alias("s")))))

    return let(hashes, runs)


def _drawer():
    """packed(h, s, j): ln a of a term in sample j, in the upper bits, over 32 bits that stand for (term, t)."""
    grid = [_gamma_quantile((i + 0.5) / QUANTILES) for i in range(QUANTILES)]
    gamma, log_gamma = _numbers(grid), _numbers([math.log(x) for x in grid])
    low = F.lit(QUANTILES - 1).cast("long")

    def packed(h: Column, s: Column, j: int | Column) -> Column:
        u = F.xxhash64(h, F.lit(j) if isinstance(j, int) else j)
        r = gamma[u.bitwiseAND(low).cast("int")]
        log_c = log_gamma[F.shiftright(u, 12).bitwiseAND(low).cast("int")]
        b = F.shiftright(u, 24).bitwiseAND(F.lit((1 << 20) - 1).cast("long")) * F.lit(1.0 / (1 << 20))
        t = F.floor(s / r + b)
        log_a = log_c - r * (t - b + 1.0)  # between -40 and 3
        name = h.bitwiseXOR(t * F.lit(2654435761)).bitwiseAND(F.lit(_NAME))
        return F.shiftleft(((log_a + 64.0) * float(1 << 24)).cast("long"), 32).bitwiseOR(name)

    return packed


_NAME = 0xFFFFFFFF


def signature(text: Column, samples: int = SAMPLES) -> Column:
    """Array of one long a sample. One expression: slow, for few rows; see signatures()."""
    packed = _drawer()
    js = F.sequence(F.lit(0), F.lit(samples - 1))

    def every(t: Column) -> Column:
        return F.transform(js, lambda j: F.array_min(F.transform(t, lambda x: packed(x["h"], x["s"], j))).bitwiseAND(F.lit(_NAME)))

    return let(terms(text), every)


def signatures(df: DataFrame, keys: list[str], texts: list[Column], samples: int = SAMPLES) -> DataFrame:
    """Rows (keys, which, sig), a row for each row of df and each of the texts; keys are unique to a row of df.

    A term is a row only on its way into an aggregation of generated code; if df is dealt out by one of the keys, nothing
    is shuffled.
    """
    packed = _drawer()
    each = df.select(*keys, F.posexplode(F.array(*map(terms, texts))).alias("which", "_t")).select(*keys, "which", F.inline("_t"))
    # a few samples a row: larger generated methods run several times slower
    each = each.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // _PER_ROW))))
    least = each.groupBy(*keys, "which", "_block").agg(*(F.min(packed(F.col("h"), F.col("s"), F.col("_block") * _PER_ROW + k)).alias(f"_{k}") for k in range(_PER_ROW)))
    part = F.struct("_block", F.array(*(F.col(f"_{k}").bitwiseAND(F.lit(_NAME)) for k in range(_PER_ROW))).alias("sig"))
    whole = least.groupBy(*keys, "which").agg(F.sort_array(F.collect_list(part)).alias("_parts"))
    return whole.select(*keys, "which", F.slice(F.flatten("_parts.sig"), 1, samples).alias("sig"))


def as_string(sig: Column) -> Column:
    """Eight hexadecimal digits a sample."""
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of the samples in which two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(samples))


_LEAST = -(1 << 63)


def _bounds(keys: DataFrame, every: int) -> list[tuple[int, int]]:
    """The least key, and about one in so many others, in order; at most about RANGES of them."""
    picked = keys.where(F.pmod(F.xxhash64("key", "version", F.lit(7)), F.lit(every)) == 0).distinct()
    least = keys.agg(F.min(F.struct("key", "version")).alias("k")).where("k IS NOT NULL").select("k.*")
    return sorted({(r.key, r.version) for r in picked.unionByName(least).collect()})


def _range_of(key: Column, version: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many bounds are at or below (key, version), less 1: a binary search in two constant arrays."""
    longs = lambda k: F.split(F.lit(",".join(str(b[k]) for b in bounds)), ",").cast("array<bigint>")
    keys, versions, n = longs(0), longs(1), len(bounds)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))

    def halve(at: Column, step: Column) -> Column:
        to = at + step
        k, v = F.get(keys, to), F.get(versions, to)
        return F.when((to < n) & ((k < key) | ((k == key) & (v <= version))), to).otherwise(at)

    return F.aggregate(steps, F.lit(0), halve)


def edited_fingerprints(docs: DataFrame, id_: str = "doc_id", text: str = "text", samples: int = SAMPLES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows ``(id, n_chars, edited_sha256, sig, edited_sig, next_sig)``.

    The edited text has its last half replaced by the first characters of the next text in descending order of ids.
    Texts are shuffled once, by ranges of ids.
    """
    rows = docs.select(F.col(id_).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumns({"key": F.coalesce("id", F.lit(_LEAST)), "version": F.xxhash64("t")})
    keys = written(rows.select("key", "version"), "keys")
    bounds = _bounds(keys, max(range_rows, keys.count() // RANGES, 1)) or [(_LEAST, _LEAST)]
    range_ = _range_of(F.col("key"), F.col("version"), bounds)
    rows = rows.withColumn("range", range_)
    # the first text of each range, for the range above: no more of them than bounds
    top = keys.groupBy(range_.alias("range")).agg(F.max(F.struct("key", "version")).alias("top")).select("top.*")
    heads = rows.join(F.broadcast(top), ["key", "version"]).dropDuplicates(["range"])
    above = F.when(F.col("range") == len(bounds) - 1, 0).otherwise(F.col("range") + 1)
    heads = written(heads.select(above.alias("range"), F.col("t").alias("head")), "heads")
    order = Window.partitionBy("range").orderBy(F.desc("key"), F.desc("version"), F.desc("t"))
    both = rows.withColumn("following", F.lead("t").over(order)).join(heads, "range")
    both = both.withColumn("following", F.coalesce("following", "head"))
    n = F.length("t")
    half = F.shiftright(n, 1)
    edited = F.concat(F.substring("t", F.lit(1), n - half), F.substring("following", F.lit(1), half))
    both = both.withColumn("edited", edited)
    sha = F.unhex(F.sha2(F.col("edited").cast("binary"), 256))
    own = [F.monotonically_increasing_id().alias("row"), "id", n.cast("long").alias("n_chars"), sha.alias("sha")]
    found = signatures(both.select("range", *own, "t", "edited"), ["range", "row", "id", "n_chars", "sha"], [F.col("t"), F.col("edited")], samples)
    line = Window.partitionBy("range").orderBy("row", "which")
    found = found.withColumns({"edited_sig": F.lead("sig", 1).over(line), "next_sig": F.lead("sig", 2).over(line)}).where("which = 0")
    found = found.join(heads.select("range", signature(F.col("head"), samples).alias("head_sig")), "range")
    digest = F.lower(F.hex("sha")).alias("edited_sha256")
    return found.select("id", "n_chars", digest, "sig", "edited_sig", F.coalesce("next_sig", "head_sig").alias("next_sig"))


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    out = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", as_string(F.col("sig")).alias("fingerprint"), as_string(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
