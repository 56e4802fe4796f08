"""Mixing to target weights: document rates whose expected domain token totals match targets.

Soft membership: a classifier learned from a labelled table (naive Bayes on hashed words, at most ``LABELLED`` rows)
gives each text the posteriors of the domains. Projected-gradient least squares then fits the rates r >= least in

    minimise  sum over domains d of (sum over documents i of r_i * tokens_i * p_id - target_d)^2 / tokens_d

by steps of length 1 in the metric of the documents' tokens; with tokens_d, the domain's expected tokens at rates of 1,
as weights no curvature is above 1, and it is 1 in all directions where posteriors are certain. A step needs only the
domains' totals, which one aggregation gives; a document's rate follows from its posteriors and the steps so far, so no
rates are stored between the steps. The steps end on target, or where the projected gradient is gone (targets that no
rates reach), or after ``STEPS``.

All of it is DataFrame expressions; the model (``BUCKETS`` numbers a domain) and the steps are small arrays in the plan.

Edge cases: a null or empty text has no tokens, the labelled table's shares as posteriors, and a rate all the same; rows
are rated one by one, so repeated rows and null ids do no harm; without labelled rows posteriors are equal; without
tokens rates stay 1 (or the least); a domain with a target of 0 gets a tiny one; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm._shared import written

BUCKETS = 4096
LABELLED = 5000
#: Log-likelihoods are averaged over a text's words and multiplied by this: the softness of the posteriors.
SHARPNESS = 3.0
STEPS, TOLERANCE = 60, 1e-5
TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


def _numbers(values) -> Column:
    """An array constant; folded into one literal before the plan runs."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


@dataclass
class Classifier:
    domains: list[str]
    logs: dict[str, list[float]]
    shares: dict[str, float]

    def posteriors(self, buckets: Column) -> Column:
        """Array of the domains' posteriors, in their order."""
        import math

        n = F.greatest(F.size(buckets), F.lit(1)).cast("double")

        def fit_of(d: str) -> Column:
            table = _numbers(self.logs[d])
            return F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(table, b)) / n * SHARPNESS + math.log(self.shares[d])

        z = [fit_of(d) for d in self.domains]
        # two projections: the sums are computed once
        top = lambda a: F.array_max(a)
        e = F.transform(F.array(F.array(*z)), lambda a: F.transform(a, lambda x: F.exp(x - top(a))))[0]
        return F.transform(F.array(e), lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y)))[0]


def classifier(labelled: DataFrame, text: str, domain: str, domains: list[str], smooth: float = 0.1) -> Classifier:
    """labelled: at most a few thousand rows; use labelled_sample() to bound a larger table."""
    rows = labelled.where(F.col(domain).isin(domains)).select(F.col(domain).alias("d"), F.explode(words(F.col(text))).alias("w"))
    got = rows.groupBy("d", _bucket(F.col("w")).alias("b")).count().collect()  # at most BUCKETS rows a domain
    counts = {d: [0] * BUCKETS for d in domains}
    for r in got:
        counts[r.d][r.b] = r["count"]
    n = {r.d: r["count"] for r in labelled.where(F.col(domain).isin(domains)).groupBy(F.col(domain).alias("d")).count().collect()}
    import math

    logs = {d: [math.log((x + smooth) / (sum(c) + smooth * BUCKETS)) for x in c] for d, c in counts.items()}
    total = sum(n.values())
    return Classifier(list(domains), logs, {d: (n.get(d, 0) + 1) / (total + len(domains)) for d in domains})


def labelled_sample(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", rows: int = LABELLED) -> DataFrame:
    """The documents of the labelled table's ids with the smallest hashes; at most ``rows`` ids, so they may be broadcast."""
    ids = labels.where(F.col(id_).isNotNull()).select(id_).distinct().orderBy(F.xxhash64(id_), id_).limit(rows)
    return docs.join(F.broadcast(ids), id_, "left_semi")


@dataclass
class Mix:
    classifier: Classifier
    steps: list[list[float]]
    least: float

    def rate(self, posteriors: Column) -> Column:
        """A document's rate after the steps taken."""
        start = F.lit(max(1.0, self.least))
        if not self.steps:
            return start
        k = len(self.classifier.domains)
        flat = _numbers([x for s in self.steps for x in s])

        def step(r: Column, t: Column) -> Column:
            moved = r
            for d in range(k):
                moved = moved - F.get(posteriors, F.lit(d)) * F.get(flat, t * k + d)
            return F.greatest(F.lit(float(self.least)), moved)

        return F.aggregate(F.sequence(F.lit(0), F.lit(len(self.steps) - 1)), start, step)


def fit(
    members: DataFrame,
    model: Classifier,
    targets: dict[str, float],
    least: float = 0.0,
    total: float | str | None = None,
    steps: int = STEPS,
    tolerance: float = TOLERANCE,
) -> Mix:
    """members: rows (tokens, p). total: tokens wanted in all; None: as many as there are, or as rates of at least
    ``least`` allow; "all": so many that no domain need give up any."""
    mix, domains = Mix(model, [], least), model.domains
    weight = {d: max(targets[d], 1e-9) for d in domains}
    weight = {d: w / sum(weight.values()) for d, w in weight.items()}
    each = range(len(domains))

    def totals(rate: Column, before: Column) -> tuple[list[float], float]:
        """The domains' expected tokens, and the tokens that rates have moved by since: the projected gradient's size."""
        rows = members.select("tokens", "p", rate.alias("r"), F.abs(rate - before).alias("moved"))
        sums = [F.sum(F.col("r") * F.col("tokens") * F.get("p", F.lit(i))) for i in each]
        row = rows.agg(*sums, F.sum(F.col("tokens") * F.col("moved"))).first()
        return [float(x or 0) for x in row[:-1]], float(row[-1] or 0)

    now, _ = totals(F.lit(1.0), F.lit(1.0))
    if not sum(now):
        return mix
    floor = 1.0 if total == "all" else least
    if total is None or total == "all":
        total = max([sum(now), *(floor * x / weight[d] for d, x in zip(domains, now, strict=True))])
    goal = [total * weight[d] for d in domains]
    mass = [max(x, 1e-9 * sum(now)) for x in now]
    if least > 1:
        now, _ = totals(mix.rate(F.col("p")), F.lit(1.0))
    for _ in range(steps):
        if max(abs(x - g) / g for x, g in zip(now, goal, strict=True)) < tolerance:
            break
        before = mix.rate(F.col("p"))
        mix.steps.append([(x - g) / m for x, g, m in zip(now, goal, mass, strict=True)])
        now, moved = totals(mix.rate(F.col("p")), before)
        if moved < tolerance * total:
            break
    return mix


def memberships(docs: DataFrame, text: str, model: Classifier) -> DataFrame:
    """docs with ``tokens`` and ``p`` (posteriors in the order of the domains)."""
    out = docs.withColumn("_b", F.transform(words(F.col(text)), _bucket))
    return out.withColumn("tokens", F.size("_b").cast("long")).withColumn("p", model.posteriors(F.col("_b"))).drop("_b")


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_: str = "doc_id", text: str = "text", domain: str = "lang", **how) -> tuple[DataFrame, Mix]:
    """Rows ``(id, tokens, p, rate)``, and the fitted mix."""
    model = classifier(labelled, text, domain, sorted(targets))
    members = written(memberships(docs.select(F.col(id_).alias("id"), F.col(text).alias("_t")), "_t", model).drop("_t"), "memberships")
    mix = fit(members, model, targets, **how)
    return members.withColumn("rate", mix.rate(F.col("p"))), mix


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out, mix = rates(docs, labelled_sample(docs, labels), TARGETS)
    p = [F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(mix.classifier.domains)]
    return out.select(F.col("id").alias("doc_id"), F.col("tokens").alias("n_tokens"), *p, "rate")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents are repeated by their rates: the whole part, and one more by hash for the rest.

    The rates are those of op10's targets for as many tokens as let no domain shrink, so texts are repeated rather than
    dropped; one whose rate ends below 1 (a mixture of domains) is kept once all the same.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    model = classifier(labelled_sample(docs, labels), "text", "lang", sorted(TARGETS))
    members = memberships(rows, "body", model)
    mix = fit(written(members.select("tokens", "p"), "memberships"), model, TARGETS, total="all")
    chance = F.pmod(F.xxhash64("id", "body"), F.lit(1 << 20)) / float(1 << 20)
    rated = members.withColumn("rate", mix.rate(F.col("p")))
    more = F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    times = F.greatest(F.lit(1), F.floor("rate") + more).cast("int")
    return rated.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select("row.*")
