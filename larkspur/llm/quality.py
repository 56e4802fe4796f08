"""Quality classifier from trusted positives and unlabelled texts (positive-unlabelled learning).

A linear model on byte, byte-pair and repetition features minimises the non-negative unbiased risk

    prior * loss(positives as positive) + max(0, loss(unlabelled as negative) - prior * loss(positives as negative))

with the logistic loss. The class prior is estimated from positives and unlabelled texts alone: a classifier tells the
two apart on one half of the texts; on the other half, the smallest ratio of unlabelled to positive texts above a
threshold bounds the share of positives (the best-bin estimate).

The unlabelled texts are all documents; only the trusted positives are bounded, to the ``POSITIVES`` ids with the
smallest hashes. Features are computed once and written; each step of the fits (L-BFGS, preconditioned by the features'
mean squares) is a pass over them that tries several step lengths and returns sums, which executors add up. No features
come to the driver. Every text is scored, whole.

Edge cases: a null or empty text is scored from empty features; without positives or texts to learn from, every score
is 0.5; repeated rows are scored alike; null labels teach nothing; a row with a null id is unlabelled; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._shared import written
from larkspur.llm._text import SPACED, U, Words, mix, texts

POSITIVES = 4000
#: Passes of the two fits, and the step lengths tried in each pass.
PRIOR_STEPS, STEPS = 7, 14
LENGTHS = (2.0, 1.0, 0.4, 0.1)
#: Bins of the score histograms, over scores of -60 to 60.
BINS = 1 << 14
THRESHOLD = 0.3
_PAIRS = 1024
#: Bucket of each byte pair.
_PAIR = (mix(np.arange(1 << 16, dtype=U) + U(1)) >> U(54)).astype(np.int64)
FEATURES = 256 + _PAIRS + 6


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row per text: roots of the shares of bytes and byte pairs, and how much of it repeats."""
    n, size = len(off) - 1, np.diff(off)
    doc = np.repeat(np.arange(n), size)
    share = lambda counts, of: np.sqrt(counts / np.maximum(of, 1)[:, None])
    one = np.bincount(doc * 256 + buf, minlength=n * 256).reshape(n, 256)
    if len(buf) > 1:
        inner = doc[1:] == doc[:-1]
        pair = _PAIR[buf[:-1].astype(np.int64) * 256 + buf[1:]]
        two = np.bincount((doc[1:] * _PAIRS + pair)[inner], minlength=n * _PAIRS).reshape(n, _PAIRS)
    else:
        two = np.zeros((n, _PAIRS))
    w = Words(buf, off, SPACED)
    count = np.maximum(w.count, 1)
    of = w.doc()
    again = np.bincount(of[1:][(w.hash[1:] == w.hash[:-1]) & (of[1:] == of[:-1])], minlength=n) / count
    order = np.lexsort((w.hash, of))
    h, d = w.hash[order], of[order]
    same = np.bincount(d[1:][(h[1:] == h[:-1]) & (d[1:] == d[:-1])], minlength=n) / count
    upper = one[:, 0x41:0x5B].sum(1) / np.maximum(size, 1)
    length = np.bincount(of, (w.end - w.start), minlength=n) / count
    extra = np.stack([again, np.sqrt(again), same, upper, np.minimum(length, 40) / 40, np.log1p(size) / 16], 1)
    return np.concatenate([share(one, size), share(two, size - 1), extra], 1).astype(np.float32)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid((x @ self.weights).astype(np.float64) + self.bias)


_SLICES = 16


def _sums(rows: DataFrame, of, width: int) -> np.ndarray:
    """Sum of of(x, p, half) over all batches of written features; added up in executors, slice by slice."""
    size = -(-width // _SLICES)

    def compute(batches):
        total = np.zeros(size * _SLICES)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                data = part.column(2)
                x = np.frombuffer(data.buffers()[2], np.float16)[data.offset * FEATURES :][: len(data) * FEATURES]
                x = x.reshape(len(data), FEATURES).astype(np.float32)
                total[:width] += of(x, part.column(0).to_numpy() == 1, part.column(1).to_numpy() == 1)
        sums = pa.array([v.tobytes() for v in total.reshape(_SLICES, size)])
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES)), sums], names=["slice", "sums"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(v)
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([v.tobytes()])], names=["slice", "sums"])

    schema = "slice long, sums binary"
    out = np.zeros((_SLICES, size))
    for r in rows.mapInArrow(compute, schema).repartition(_SLICES, "slice").mapInArrow(add, schema).collect():
        out[r.slice] += np.frombuffer(r.sums)
    return out.reshape(-1)[:width]


def _risks(rows: DataFrame, points: np.ndarray, half: int | None) -> np.ndarray:
    """For each point (weights, bias) the sums over unlabelled texts of the loss as negative and its gradient, and over
    positives of the losses as negative and as positive and the gradient as negative. half: 0 for that half only."""
    k, d = points.shape
    w, bias = points[:, :-1].T.astype(np.float32), points[:, -1].astype(np.float32)

    def of(x, p, odd):
        if half is not None:
            x, p = x[odd == half], p[odd == half]
        z = (x @ w + bias).astype(np.float64)
        s, loss = _sigmoid(z), np.logaddexp(0, z)
        g = [np.concatenate([(x.T @ v.astype(np.float32)).T, v.sum(0)[:, None]], 1) for v in (s, s * p[:, None])]
        return np.concatenate([loss.sum(0)[:, None], loss[p].sum(0)[:, None], (loss - z)[p].sum(0)[:, None], *g], 1).reshape(-1)

    return _sums(rows, of, k * (3 + 2 * d)).reshape(k, 3 + 2 * d)


def _minimise(risk, start: np.ndarray, scale: np.ndarray, steps: int) -> np.ndarray:
    """L-BFGS; risk(points) gives each point's (value, gradient), a value of infinity where it must not go."""
    x = start
    value, g = (v[0] for v in risk(x[None]))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    shrink = 1.0
    for _ in range(steps):
        q, back = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            back.append(a)
        q *= scale
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ (scale * y))
        for (s, y), a in zip(pairs, reversed(back), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        points = np.stack([x - shrink * t * q for t in LENGTHS])
        values, gradients = risk(points)
        k = int(np.argmin(values))
        if not values[k] < value:
            shrink *= 0.1
            if shrink < 1e-3:
                break
            continue
        s, y = points[k] - x, gradients[k] - g
        if s @ y > 0:
            pairs = [*pairs[-9:], (s, y)]
        done = value - values[k] < 1e-6 * max(1, abs(value))
        x, value, g, shrink = points[k], values[k], gradients[k], 1.0
        if done:
            break
    return x


def _best_bin(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among the unlabelled, from the histograms of their scores."""
    n, m = p.sum(), u.sum()
    if not n or not m:
        return 0.5
    qp, qu = np.cumsum(p[::-1])[::-1] / n, np.cumsum(u[::-1])[::-1] / m
    at = np.flatnonzero(p)
    slack = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(m) + 1 / np.sqrt(n))
    k = at[int(np.argmin((qu[at] + slack) / qp[at]))]
    return float(np.clip(qu[k] / qp[k], 0.05, 0.98))


def _train(rows: DataFrame, ridge: float = 0.1, slack: float = 2.0) -> Model:
    """The model of written features: rows (p, half, x), p marking positives, which are among the unlabelled as well."""
    d = FEATURES + 1

    def first(x, p, odd):
        x = x.astype(np.float64)
        return np.concatenate([[len(x), p.sum(), (~odd).sum(), (p & ~odd).sum()], x[p].sum(0), x[p & ~odd].sum(0), (x * x).sum(0)])

    got = _sums(rows, first, 4 + 3 * FEATURES)
    n, np_, n0, np0 = got[:4]
    if not np_:
        return Model(np.zeros(FEATURES, np.float32), 0.0, 0.5)
    ridge = ridge / np_ * (np.arange(d) < FEATURES)
    mean, mean0, square = got[4:].reshape(3, FEATURES)
    scale = 4 / np.append(square / n + 1e-4, 1.0)

    def apart(points: np.ndarray):
        """Balanced logistic loss of positives against unlabelled texts, on one half."""
        v = _risks(rows, points, 0)
        value = 0.5 * v[:, 0] / n0 + 0.5 * v[:, 2] / np0
        g = 0.5 * v[:, 3 : 3 + d] / n0 + 0.5 * (v[:, 3 + d :] - np.append(mean0, np0)) / np0
        return value + (ridge * points * points).sum(1) / 2, g + ridge * points

    start, prior = np.zeros(d), 0.5
    if np0:
        start = _minimise(apart, start, scale, PRIOR_STEPS)
        w, bias = start[:-1].astype(np.float32), np.float32(start[-1])

        def histogram(x, p, odd):
            x, p = x[odd], p[odd]
            k = ((np.clip(x @ w + bias, -60, 60).astype(np.float64) + 60) * ((BINS - 1) / 120)).astype(np.int64)
            return np.concatenate([np.bincount(k[p], minlength=BINS), np.bincount(k, minlength=BINS)])

        prior = _best_bin(*_sums(rows, histogram, 2 * BINS).reshape(2, BINS))

    def unbiased(points: np.ndarray):
        """The risk; infinite where the negatives' part is below 0 by more than the positives' sampling error explains."""
        v = _risks(rows, points, None)
        negative = v[:, 0] / n - prior * v[:, 1] / np_
        value = np.where(negative < -slack * prior * v[:, 1] / np_**1.5, np.inf, prior * v[:, 2] / np_ + negative)
        g = v[:, 3 : 3 + d] / n - prior * np.append(mean, np_) / np_
        return value + (ridge * points * points).sum(1) / 2, g + ridge * points

    x = _minimise(unbiased, np.zeros(d), scale, STEPS)
    return Model(x[:-1].astype(np.float32), float(x[-1]), prior)


def fit(docs: DataFrame, trusted: DataFrame, id_: str = "doc_id", text: str = "text", positives: int = POSITIVES) -> Model:
    """trusted: the ids of positive texts, in a column named like id_; at most ``positives`` of them are used."""
    ids = trusted.where(F.col(id_).isNotNull()).select(F.col(id_).alias("_id")).distinct()
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(positives)

    def compute(batches):
        for b in batches:
            for row, buf, off in texts(b.column(2)):
                x = features(buf, off).astype(np.float16)
                own = [b.column(k).slice(row, len(x)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([r.tobytes() for r in x], pa.binary())], names=["p", "half", "x"])

    half = F.pmod(F.xxhash64(text, F.lit(1)), F.lit(2)).cast("int").alias("half")
    every = docs.select(F.col(id_).alias("_id"), half, F.col(text).alias("_t"))
    every = every.join(F.broadcast(ids.withColumn("p", F.lit(1))), "_id", "left")
    rows = every.select(F.coalesce("p", F.lit(0)).alias("p"), "half", "_t")
    return _train(written(rows.mapInArrow(compute, "p int, half int, x binary"), "features"))


def scorer(docs: DataFrame, model: Model):
    """An Arrow function of the text column."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        out = [held.value.score(features(buf, off)) for _, buf, off in texts(column)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return score


def _trusted(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.where((F.col("quality") == 1) & ~held_out()).select("doc_id").distinct()


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    score = scorer(docs, fit(docs, _trusted(spark, sf_dir)))
    out = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score under the threshold go."""
    score = scorer(docs, fit(docs, _trusted(spark, sf_dir)))
    return docs.where(score("text") >= THRESHOLD)
