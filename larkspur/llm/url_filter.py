"""URL filter: rules by host and path, and for the rest a logistic regression on hashed character n-grams.

All of it is DataFrame expressions. The regression is fitted on a small labelled URL table (at most ``LABELLED_ROWS``
rows, those with the smallest hashes) by full-batch gradient descent in one row of arrays; scoring is a narrow
projection of the URL column that reads the model through a scalar subquery.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits no rule, and gets the score of no
n-grams (the bias); an empty labelled table gives a score of 0.5, which allows; of two rules of equal length that fit,
that with the longer host wins, then the first in the alphabet; repeated rows are judged alike; long URLs are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
LABELLED_ROWS = 2000
STEPS, RATE, RIDGE = 300, 1.0, 1e-3

#: Fixed rules of op1: (verdict, host and path).
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]

#: The labelled URL table: fixed values, made up for this purpose. 1 is to be blocked.
LABELLED = [
    (1, "http://www.casino-win.example.org/en/14"),
    (1, "https://casino-bonus.example.com/play/22?ref=x"),
    (1, "https://royal-casino.example.net/slots"),
    (1, "http://cheap-pills.example.com/en/450"),
    (1, "https://www.cheap-meds.example.org/buy/9"),
    (1, "https://pills-online.example.net/order"),
    (1, "http://discount-pharmacy.example.com/de/3"),
    (1, "https://spam-farm.example.org/en/728"),
    (1, "https://www.link-farm.example.net/fr/5.html"),
    (1, "http://content-farm.example.com/en/81"),
    (1, "https://spam-links.example.com/es/12"),
    (1, "https://ads-track.example.org/en/584"),
    (1, "http://ads-server.example.com/click/77"),
    (1, "https://track-clicks.example.net/pixel"),
    (1, "https://adserver.example.org/banner/1"),
    (1, "https://popup-ads.example.com/en/6"),
    (1, "http://free-prizes.example.net/win/99"),
    (1, "https://win-prizes.example.com/lottery"),
    (1, "https://lottery-win.example.org/de/40"),
    (1, "http://bet-now.example.com/en/777"),
    (1, "https://poker-bonus.example.net/fr/8"),
    (1, "https://quick-loans.example.org/apply"),
    (1, "http://payday-loans.example.com/en/31"),
    (1, "https://xxx-cams.example.net/live"),
    (1, "https://hot-dates.example.com/join"),
    (1, "http://crack-keygen.example.org/download"),
    (1, "https://warez-files.example.net/free"),
    (1, "https://replica-watches.example.com/sale"),
    (0, "http://ththre.example.com/fr/825?page=2"),
    (0, "https://m.ththth.example.net/en/25#top"),
    (0, "https://thther.example.org/en/685"),
    (0, "http://therha.example.com/en/676"),
    (0, "https://blog.tiontion.example.com/en/853/"),
    (0, "http://blog.ththan.example.net/en/960"),
    (0, "https://m.therou.example.com/en/474.html"),
    (0, "https://www.ththen.example.com/en/148.html"),
    (0, "https://blog.thertion.example.org/es/978"),
    (0, "https://www.therti.example.org/en/334/"),
    (0, "http://therat.example.net/de/231"),
    (0, "https://blog.theres.example.com/es/519"),
    (0, "https://www.ththwh.example.org/de/471"),
    (0, "https://news.example.org/en/2020/05/11"),
    (0, "https://www.daily-news.example.com/en/18"),
    (0, "http://library.example.edu/catalog/14"),
    (0, "https://docs.example.org/guide/intro.html"),
    (0, "https://wiki.example.net/en/Water"),
    (0, "https://university.example.edu/physics/"),
    (0, "http://www.museum.example.org/fr/77"),
    (0, "https://recipes.example.com/en/soup/12"),
    (0, "https://weather.example.net/de/9"),
    (0, "https://city-council.example.org/en/3"),
    (0, "http://www.school.example.com/es/61"),
    (0, "https://garden.example.net/en/roses"),
    (0, "https://travel.example.org/fr/paris/4"),
    (0, "https://forum.example.com/en/thread/95"),
    (0, "http://history.example.net/de/1848.html"),
    (0, "https://health-institute.example.org/en/8"),
    (0, "https://www.bookshop.example.com/en/40"),
    (0, "https://science.example.net/en/528"),
    (0, "https://music.example.org/es/33?page=2"),
    (0, "http://archive.example.com/en/1999/"),
    (0, "https://m.sport.example.net/fr/285.html"),
    (0, "https://open-source.example.org/en/12"),
    (0, "https://blog.painter.example.com/de/19"),
]


def _lower(text: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return _lower(host), path


def _grams(text: Column, kind: str, sizes: tuple[int, ...]) -> Column:
    """Buckets of all character n-grams of the text; the kind keeps those of hosts and paths apart."""
    text = F.concat(F.lit("^"), text, F.lit("$"))

    def of(n: int) -> Column:
        places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    return F.concat(*map(of, sizes))


def buckets(host: Column, path: Column) -> Column:
    some = F.concat(_grams(host, "host", (3, 4, 5)), _grams(path, "path", (2, 3)))
    return F.when((host == "") & (path == ""), F.array().cast("array<int>")).otherwise(F.array_distinct(some))


def _logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _linear(f: Column, w: Column, b: Column) -> Column:
    """Bias and mean weight of the buckets times the root of their number (unit-length features)."""
    total = F.aggregate(f, F.lit(0.0), lambda a, x: a + F.get(w, x))
    return b + total / F.sqrt(F.greatest(F.size(f), F.lit(1)).cast("double"))


def fit(labelled: DataFrame, url: str = "url", label: str = "label", rows: int = LABELLED_ROWS) -> DataFrame:
    """One row ``(model struct<w array<double>, b double>)`` from labels 1 (block) and 0 (allow)."""
    host, path = host_and_path(F.col(url))
    some = labelled.where(F.col(label).isin(0, 1)).orderBy(F.xxhash64(url, label), url).limit(rows)
    some = some.select(buckets(host, path).alias("f"), F.col(label).cast("double").alias("y"))
    # one row: the samples, numbered, and the numbers of the samples that have each bucket
    row = some.agg(F.array_sort(F.collect_list(F.struct("f", "y"))).alias("samples"))
    entries = row.select(F.posexplode("samples").alias("i", "s")).select("i", F.explode("s.f").alias("bucket"))
    have = entries.groupBy("bucket").agg(F.array_sort(F.collect_list("i")).alias("have"))
    have = labelled.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(have, "bucket", "left")
    have = have.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("have", F.array().cast("array<int>")).alias("have")))), lambda x: x["have"]).alias("lists"))
    row = row.withColumn("lists", have.scalar())
    n = F.greatest(F.size("samples"), F.lit(1)).cast("double")

    def step(m: Column, _) -> Column:
        residuals = F.transform("samples", lambda s: (s["y"] - _logistic(_linear(s["f"], m["w"], m["b"]))) / n)
        # element of a one-element array: computes the residuals once
        return F.element_at(
            F.transform(
                F.array(residuals),
                lambda r: F.struct(
                    F.zip_with(m["w"], "lists", lambda w, p: w * (1 - RATE * RIDGE) + RATE * F.aggregate(p, F.lit(0.0), lambda a, i: a + F.get(r, i) / F.sqrt(F.size(F.get(F.col("samples"), i)["f"]).cast("double")))).alias("w"),
                    (m["b"] + RATE * F.aggregate(r, F.lit(0.0), lambda a, x: a + x)).alias("b"),
                ),
            ),
            1,
        )

    zero = F.struct(F.array_repeat(F.lit(0.0), BUCKETS).alias("w"), F.lit(0.0).alias("b"))
    return row.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zero, step).alias("model"))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. The rules are a short list held in the plan."""
    known = []
    for verdict, rule in rules:
        name, _, rest = rule.partition("/")
        known.append(F.struct(F.lit(-len(rule)).alias("length"), F.lit(-len(name)).alias("h"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(name).alias("host"), F.lit(f"/{rest}" if "/" in rule else "").alias("path")))
    if not known:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    fits = F.filter(F.array(*known), lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    return F.array_min(fits)


def filter_urls(df: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], url: str = "url", threshold: float = 0.5) -> DataFrame:
    """df with ``host``, ``path``, ``rule``, ``score`` (of blocking) and ``verdict`` (allow or block); columns of these names are replaced."""
    host, path = host_and_path(F.col(url))
    out = df.withColumns({"host": host, "path": path, "_model": fit(labelled).scalar()})
    score = _logistic(_linear(buckets(F.col("host"), F.col("path")), F.col("_model.w"), F.col("_model.b")))
    found = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(found["verdict"], F.when(score > threshold, "block").otherwise("allow"))
    return out.withColumns({"rule": found["rule"], "score": score, "verdict": verdict}).drop("_model")


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(LABELLED, "label int, url string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, labelled, RULES).select("page_id", "host", "path", "rule", "verdict", "score")
