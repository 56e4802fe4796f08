"""The operators of the llm subpackage against brute force on small tables, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL, rows_of
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, fingerprint, jaccard_join, licenses, line_dedup, mixing, quality, sharding, url_filter, warc
from larkspur.llm._shared import components, small, written
from larkspur.llm._text import ALNUM, SPACED, Words, shingles, texts
from larkspur.llm.queries import ORACLES, QUERIES
from larkspur.storage import cleanup, fresh_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, p string, tokens int, h int, range int, shard string"


def docs_of(spark, *rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), 7, "x", 1, 2, 3, "y") for i, t in rows], DOCS).repartition(3)


def prose(seed: int, n: int) -> str:
    r = np.random.RandomState(seed)
    return " ".join(f"w{x}" for x in r.randint(0, 5000, n))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, oracle, name):
    assert rows_of(QUERIES[name](spark, SMALL).toPandas()) == rows_of(oracle.execute(ORACLES[name]).df())


def doubled(n: int) -> tuple[str, str]:
    """A word of n letters a and b, and the one with the letters exchanged: sums over powers of two confuse these."""
    other, w = str.maketrans("ab", "ba"), "a"
    while len(w) < n:
        w += w.translate(other)
    return w, w.translate(other)


PAIRS = [doubled(n) for n in (8, 64, 1024, 2048)]

# text helpers


def test_words():
    body = ["Ab  c\n\x0b", "", None, "é_ü 9Z", "a" * 70_000 + " b", *map(" ".join, PAIRS), "x" * 64, "x" * 65, "abcdefgh abcdefghi abcdefgh\x7f"]
    for lut, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
        want = [re.findall(pattern, lower(t)) for t in body]
        got, seen = [], {}
        for _, buf, off in texts(pa.array(body).slice(0)):
            w = Words(buf, off, lut)
            for d in range(len(off) - 1):
                got.append([bytes(buf[a:b]).decode() for a, b in zip(w.start[w.first[d] : w.first[d + 1]], w.end[w.first[d] : w.first[d + 1]], strict=True)])
                for x, h in zip(got[-1], w.hash[w.first[d] : w.first[d + 1]], strict=True):
                    assert seen.setdefault(lower(x), h) == h
        assert [[lower(x) for x in g] for g in got] == want
        assert len(set(seen.values())) == len(seen)
    _, buf, off = next(texts(pa.array(["a b c a b c", "a b", ""])))
    g, first = shingles(Words(buf, off, SPACED), 3)
    assert np.diff(first).tolist() == [3, 1, 0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20, 40)] + [(3, 9), (9, 5), (5, 5), (100, 1)] + [(50, k) for k in range(60, 90)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 20 for i in range(20, 41)} | {3: 3, 9: 3, 5: 3, 100: 1, 1: 1} | {i: 50 for i in [50, *range(60, 90)]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_written_tables(spark):
    df = written(spark.range(10).selectExpr("id", "array(id) a", "array(struct('x' y)) s", "repeat('x', 1000) t"), "ten")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == 10 and "ResolvedHint" not in plan(df.join(small(df, 9_000), "id"))
    assert "strategy=broadcast" in plan(df.join(small(df, 20_000), "id")) and "strategy=broadcast" not in plan(df.join(small(df, 9_000), "id"))
    folder = df.inputFiles()[0].removeprefix("file://").split("/ten/")[0]
    import os

    assert os.path.isdir(folder)
    cleanup(spark)
    assert not os.path.isdir(folder)


# 1


def test_url_filter(spark):
    urls = [
        "https://A.Example.com/en/7?x#y", "http://example.com/en/71", "http://notexample.com/en/7", "http://x.example.net/de/8", "http://example.net/de/9", "ftp://a.org/es/", "http://a.org/es", "no scheme", None, "://", "http://h#/p", "http://cheap-pills.example.io/xx/1", "http://thering.example.io/xx/3",
    ]
    df = spark.createDataFrame([(i, u, "keep", 1) for i, u in enumerate(urls)], "page_id int, url string, rule string, b int")
    labelled = spark.createDataFrame(url_filter.LABELLED, "label int, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, labelled, url_filter.RULES).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1].rule == "example.com/en/7" and got[2].rule == "com/en/" and got[2].verdict == "block"
    assert (got[3].rule, got[3].verdict, got[4].rule, got[4].verdict) == ("example.net/de/8", "block", "net/de/", "allow")
    assert got[5].verdict == "block" and got[6].rule is None
    for k in (7, 8, 9):
        assert (got[k].host, got[k].path, got[k].rule) == ("", "", None)
    assert (got[10].host, got[10].path) == ("h", "")
    assert (got[11].rule, got[11].verdict) == (None, "block") and got[12].verdict == "allow"
    assert url_filter.filter_urls(df.limit(0), labelled.limit(0), []).count() == 0
    assert {r.score for r in url_filter.filter_urls(df, labelled.limit(0), []).collect()} == {0.5}


def test_url_model_fits_like_plain_gradient_descent(spark):
    """The fitted scores against the same descent in numpy."""
    labelled = spark.createDataFrame(url_filter.LABELLED, "label int, url string")
    host, path = url_filter.host_and_path(F.col("url"))
    rows = labelled.select("label", url_filter.buckets(host, path).alias("f")).collect()
    x = np.zeros((len(rows), url_filter.BUCKETS))
    for i, r in enumerate(rows):
        x[i, r.f] = 1 / np.sqrt(len(r.f))
    y, w, b = np.array([r.label for r in rows], float), np.zeros(url_filter.BUCKETS), 0.0
    for _ in range(url_filter.STEPS):
        e = (y - 1 / (1 + np.exp(-(x @ w + b)))) / len(rows)
        w, b = w * (1 - url_filter.RATE * url_filter.RIDGE) + url_filter.RATE * x.T @ e, b + url_filter.RATE * e.sum()
    m = url_filter.fit(labelled).first().model
    assert np.allclose(m.w, w, atol=1e-9) and abs(m.b - b) < 1e-9
    assert ((x @ w + b > 0) == (y == 1)).mean() > 0.95


def test_url_query_by_hand(spark):
    """Every page again in Python: host, path, rule, n-grams (hashed by another library), fit and verdict."""
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    seed = {k: xxhash.xxh64_intdigest(k.encode(), 42) for k in ("host", "path")}

    def cut(url):
        rest = url.partition("://")[2] if url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]

    def grams(host, path):
        if not host and not path:
            return set()
        every = ((k, f"^{t}$"[i : i + n]) for k, t, ns in (("host", host, (3, 4, 5)), ("path", path, (2, 3))) for n in ns for i in range(len(t) + 3 - n))
        return {signed(xxhash.xxh64_intdigest(g.encode(), seed[k])) % url_filter.BUCKETS for k, g in every}

    def row(url):
        x, f = np.zeros(url_filter.BUCKETS), sorted(grams(*cut(url)))
        x[f] = 1 / np.sqrt(max(1, len(f)))
        return x

    x, y = np.stack([row(u) for _, u in url_filter.LABELLED]), np.array([v for v, _ in url_filter.LABELLED], float)
    w, b = np.zeros(url_filter.BUCKETS), 0.0
    for _ in range(url_filter.STEPS):
        e = (y - 1 / (1 + np.exp(-(x @ w + b)))) / len(y)
        w, b = w * (1 - url_filter.RATE * url_filter.RIDGE) + url_filter.RATE * x.T @ e, b + url_filter.RATE * e.sum()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect()}
    got = QUERIES["op1_url_filters"](spark, SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path = cut(pages[r.page_id])
        fit = [(len(rule), rule, v) for v, rule in url_filter.RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[rule.index("/") :])]
        score = 1 / (1 + np.exp(-(row(pages[r.page_id]) @ w + b)))
        _, rule, verdict = max(fit, default=(0, None, "block" if score > 0.5 else "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict) and abs(r.score - score) < 1e-9


# 2


def test_sharding(spark):
    path = fresh_path(spark, "test-store")
    store = sharding.Store(spark, path, target=40_000, base=500, fanout=3)
    parts = [docs_of(spark, *((100 * k + i, prose(i, 60)) for i in range(20))) for k in range(4)]
    parts.append(docs_of(spark, (None, None), (1, ""), (1, ""), (2, prose(9, 9000))))
    schema = parts[0].schema
    assert store.version() == 0 and store.read(schema).count() == 0
    for p in parts:
        store.append(p)
    before = store.manifest().toPandas()
    assert store.version() == 5 and before["rows"].sum() == 84
    version = store.compact(schema)
    after = store.manifest().toPandas()
    assert version > 5 and len(after) < len(before) and after["rows"].sum() == 84
    assert store.manifest(5).count() == len(before)  # older versions stay readable
    open_ = after[after["bytes"] < 30_000]
    assert open_.groupby("tier").size().max() < 3 or len(open_) == 0
    want = sorted(map(repr, (r for p in parts for r in p.collect())))
    assert sorted(map(repr, store.read(schema).collect())) == want
    assert store.vacuum() == 0  # all of it is too young
    assert store.vacuum(0) > 0
    assert sorted(map(repr, store.read(schema).collect())) == want
    with pytest.raises(sharding.Conflict):
        store._commit(store.manifest(), store.version())
    assert sorted(map(repr, store.read(schema).collect())) == want
    assert not [n for n in names(store, "manifest") if n.startswith("draft")]


def names(store, folder):
    return [s.getPath().getName() for s in store._fs.listStatus(store._hadoop(f"{store.path}/{folder}"))]


def test_sharding_after_a_crash_in_a_commit(spark):
    store = sharding.Store(spark, fresh_path(spark, "crashed-store"))
    docs = docs_of(spark, (1, "a"), (2, "b"))
    store.append(docs)
    store._fs.create(store._hadoop(f"{store.path}/manifest/v00000002.commit"), False).close()  # empty: a writer died
    store._fs.create(store._hadoop(f"{store.path}/manifest/draft-x"), False).close()
    assert store.version() == 1 and store.read(docs.schema).count() == 2
    assert store.append(docs) == 3 and store.read(docs.schema).count() == 4
    store.compact(docs.schema, finish=True)
    store.vacuum(0)
    assert store.read(docs.schema).count() == 4


def test_sharding_with_two_writers_and_a_vacuum(spark):
    one, two = (sharding.Store(spark, path) for path in [fresh_path(spark, "shared-store")] * 2)
    docs = docs_of(spark, (1, "a"), (2, "b"))
    one.append(docs)
    number, now, mine = two._next(), two.manifest(), two._write(docs)
    one.vacuum()  # keeps what is not committed yet
    assert two._commit(now.unionByName(mine), number) == 2 and one.read(docs.schema).count() == 4
    number, now, mine = two._next(), two.manifest(), written(two._write(docs), "entries")
    one.vacuum(0)  # takes it
    with pytest.raises(sharding.Lost):
        two._commit(now.unionByName(mine), number)
    assert one.version() == 2 and one.read(docs.schema).count() == 4
    number, now, mine = two._next(), two.manifest(), two._write(docs)
    one.append(docs)
    with pytest.raises(sharding.Conflict):
        two._commit(now.unionByName(mine), number)
    assert one.read(docs.schema).count() == 6


def test_sharding_reads_folders_whole(spark):
    store = sharding.Store(spark, fresh_path(spark, "folders"))
    docs = docs_of(spark, *((i, prose(i, 30)) for i in range(40)))
    store.append(docs)
    store.append(docs)
    now = store.manifest()
    assert len(store._paths(now)) == 2
    part = now.where(F.col("path") != now.first().path)
    assert len(store._paths(part)) == 1 + now.first().peers - 1


def test_sharding_stage(spark):
    docs = docs_of(spark, (1, "a"), (1, "a"), (None, None))
    got = sharding.stage(spark, docs, SMALL).collect()
    assert len(got) == 3 and {r.manifest_version for r in got} == {2} and len({r.shard for r in got}) == 1
    assert all(r.shard.endswith(".parquet") and r.shard_bytes > 0 for r in got)
    assert sharding.stage(spark, docs.limit(0), SMALL).count() == 0


# 3


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT-permission"]
    changed = mit.replace("deal", "trade").replace("limitation", "limits")
    rows = [(1, None), (2, ""), (3, "Released under the MIT License."), (4, prose(1, 500) + " " + mit.upper() + " " + prose(2, 300)), (5, prose(3, 100) + changed), (6, prose(4, 50) + "This work is licensed under the GNU General Public License, version 3. " * 50), (None, "released UNDER the mit, license"), (7, "Released under the BSD License.")]
    got = {(r.doc_id, r.text): sorted({m.name for m in r.matches}) for r in licenses.scan_licenses(docs_of(spark, *rows)).collect()}
    assert [got[r] for r in rows] == [[], [], ["MIT"], ["MIT-permission"], ["MIT-permission"] if _contained(mit, changed) else [], ["GPL-3.0"], ["MIT"], []]
    with pytest.raises(ValueError):
        licenses.prepare(spark, {"short": "too few words"})
    docs = docs_of(spark, (1, rows[6][1]), (1, rows[6][1]), (None, None)).withColumn("matches", F.lit("mine"))
    out = licenses.scan_licenses(docs)
    assert out.columns == docs.columns and Counter(len(r.matches) > 0 for r in out.collect()) == {True: 2, False: 1}
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def _contained(a: str, b: str) -> bool:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    x, y = grams(words(a)), grams(words(b))
    return len(x & y) >= 0.8 * len(x)


# 4


def brute_components(rows, words=3, percent=90):
    lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
    split = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for _, t in rows]
    sets = [{tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set() for w in split]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    first = {}
    for (i, _), x in zip(rows, label, strict=True):
        first[x] = min(first.get(x, i), i)
    return {(i, len(s), first[x]) for (i, _), s, x in zip(rows, sets, label, strict=True)}


@pytest.mark.parametrize("block", [1500, 400_000])
def test_jaccard(spark, block):
    rows, r = [], np.random.RandomState(0)
    for g in range(6):
        base = prose(g, [60, 60, 200, 12, 9, 10][g]).split()
        for _ in range(12):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randint(len(w))] = f"e{r.randint(1000)}"
            rows.append((1000 - len(rows), " ".join(w[: len(w) - r.randint(0, 2)])))
    hot = prose(77, 60)
    rows += [(2000 + i, prose(500 + i, 40) + " " + hot) for i in range(20)] + [(3000, None), (3001, ""), (3002, "one two"), (3003, "One  TWO"), (3004, "one"), (3005, " \n")]
    for x, y in PAIRS:
        rows += [(4000 + len(rows), f"{w} x y z") for w in (x, y)]
    got = jaccard_join.jaccard_components(docs_of(spark, *rows), words=3, percent=90, block=block)
    assert {(x.id, x.n_shingles, x.component) for x in got.collect()} == brute_components(rows)


def test_jaccard_stage_takes_five_words_and_80_percent(spark):
    rows = []
    for g in range(12):
        w = prose(300 + g, 120)
        rows += [(10 * g, w), *((10 * g + k, w + " " + prose(1000 + 10 * g + k, 10 * k)) for k in (1, 2, 4))]
    want = {c for _, _, c in brute_components(rows, 5, 80)}
    assert want != {c for _, _, c in brute_components(rows)}
    assert {x.doc_id for x in jaccard_join.stage(spark, docs_of(spark, *rows), SMALL).collect()} == want
    got = jaccard_join.jaccard_components(docs_of(spark, *rows), words=5, percent=80, block=1500)
    assert {(x.id, x.n_shingles, x.component) for x in got.collect()} == brute_components(rows, 5, 80)


def test_jaccard_search_alone():
    r = np.random.RandomState(3)
    pool = [np.unique(r.randint(0, 400, r.randint(5, 60))) for _ in range(40)]
    sets = sorted((np.unique(np.concatenate([s[r.rand(len(s)) > 0.03], r.randint(400, 900, r.randint(0, 2))])) for s in pool for _ in range(4)), key=len)
    links = jaccard_join.Search(sets, jaccard_join.Bound(90)).links(np.zeros(len(sets), int))
    true = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))}
    assert set(links) <= true

    def groups(edges):
        label = list(range(len(sets)))
        for i, j in edges:
            label = [label[j] if x == label[i] else x for x in label]
        return {tuple(k for k, x in enumerate(label) if x == y) for y in label}

    assert groups(links) == groups(true)


def test_jaccard_stage(spark):
    text, other = prose(5, 80), prose(6, 50)
    rows = [(5, text), (3, text + " end"), (9, other), (9, other), (None, text), (None, None), (7, None), (7, ""), (7, ""), (7, None)]
    # rows with one id: of one group, of two groups, and in a group with a smaller id
    rows += [(20, prose(20, 90)), (20, prose(20, 90) + " end"), (20, prose(21, 90)), (20, text), (30, prose(22, 40)), (30, prose(23, 40))]
    got = jaccard_join.stage(spark, docs_of(spark, *rows), SMALL)
    assert got.columns == docs_of(spark, *rows).columns and {r.tokens for r in got.collect()} == {1}
    want = [(3, text + " end"), (9, other), (None, text), (None, None), (7, None), (7, ""), (20, prose(21, 90)), (30, prose(22, 40)), (30, prose(23, 40))]
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    either = [x for x in kept if x[0] == 20 and x[1].startswith(prose(20, 90))]
    assert len(either) == 1 and kept == Counter([*want, *either])
    assert jaccard_join.stage(spark, docs_of(spark, (1, "a")).limit(0), SMALL).count() == 0


def test_jaccard_of_rows_with_one_id(spark):
    """Sets of one id that are not linked do not tie their partners together."""
    a, b = prose(1, 60), prose(2, 60)
    rows = [(9, a), (9, b), (10, a + " end"), (3, b + " end"), (9, a)]
    got = Counter((r.id, r.n_shingles, r.component) for r in jaccard_join.jaccard_components(docs_of(spark, *rows)).collect())
    assert got == Counter([(9, 56, 9), (9, 56, 9), (9, 56, 3), (10, 57, 9), (3, 57, 3)])


# 5


def brute_lines(rows, least=line_dedup.MIN_CHARS):
    """Kept texts by (id, text), rows with one id in the order that the operator sees them in."""

    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < max(1, least) or abs(len(a) - len(b)) > 1:
            return False
        return any(a[:i] + a[i + (len(a) >= len(b)) :] == b[:i] + b[i + (len(b) >= len(a)) :] for i in range(max(len(a), len(b))))

    seen, out = [], {}
    for i, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            if not line or not any(near(line, x) for x in seen):
                kept.append(line)
            seen.append(line)
        out[i, t] = "\n".join(kept)
    return out


@pytest.mark.parametrize(("least", "bits"), [(line_dedup.MIN_CHARS, 26), (0, 26), (3, 10)])
def test_line_dedup(spark, monkeypatch, least, bits):
    monkeypatch.setattr(line_dedup, "FILTER_BITS", bits)
    a, r, rows = "a line of some length, é ü", np.random.RandomState(1), []
    edits = [a, a[:5] + a[6:], a[:5] + "X" + a[5:], a[:5] + "X" + a[6:], a[:5] + "Xy" + a[6:], a.replace("é", "e"), a + "!", a[1:], a[:-1], "short", "shorx", "", a * 30, a * 30 + "?", a * 29 + a[:-1], "1", "2", "12", "ab", "é"]
    for i in range(40):
        rows.append((i, "\n".join(edits[k] for k in r.randint(0, len(edits), r.randint(1, 6)))))
    rows += [(90, None), (91, ""), (92, "\n\n"), (93, "x" * 19 + "\n" + "x" * 20 + "\n" + "x" * 21 + "\n" + "x" * 23)]
    rows += [(100 + i, "\n".join(p)) for i, p in enumerate(PAIRS)]
    out = line_dedup.dedup_lines(docs_of(spark, *rows, (None, a)), min_chars=least)
    got = {(x.doc_id, x.tokens): x.text for x in out.collect()}
    assert got.pop((None, 1)) == a
    assert {i: t for (i, _), t in got.items()} == {i: t for (i, _), t in brute_lines(rows, least).items()}


def test_line_dedup_of_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "dup line here, long enough"), (5, "dup line here, long enough"), (5, "only here, unique and long"), (5, "only here, unique and long"), (None, "dup line here, long enough"), (None, None)]
    docs = docs_of(spark, *rows).selectExpr("*", "'a' AS `_gone`", "'b' AS gone", "'c' AS n_lines", "'d' AS lines", "'e' AS row", "'f' AS version")
    out = line_dedup.dedup_lines(docs)
    assert set(out.columns) == {*docs.columns, "n_kept"} and {(r.gone, r._gone, r.lines, r.row, r.version) for r in out.collect()} == {("b", "a", "d", "e", "f")}
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_kept) for r in out.collect())
    assert got == Counter([(1, rows[0][1], 1, 1), (5, "", 1, 0), (5, rows[2][1], 1, 1), (5, rows[2][1], 1, 1), (None, rows[0][1], 1, 1), (None, "", 1, 1)])
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_prime_arithmetic():
    up, down = line_dedup._power(300)
    data = np.random.RandomState(0).randint(0, 256, 299).astype(np.uint8)
    total = line_dedup._totals(data, up[:, :-1])
    for k, (base, p) in enumerate(zip(line_dedup._BASES, line_dedup._PRIMES.tolist(), strict=True)):
        sums = [0]
        for j, x in enumerate(data.tolist()):
            sums.append((sums[-1] + (x + 1) * pow(base, j, p)) % p)
        assert (total[k] % np.uint64(p)).tolist() == sums and set((up[k] * down[k] % np.uint64(p)).tolist()) == {1}
        assert all(p % q for q in range(2, 65536))
    line = line_dedup.Lines(data, np.array([0, 299]))
    big = line_dedup._SAFE
    try:
        line_dedup._SAFE = 10
        same = line_dedup.Lines(data, np.array([0, 299]))
        assert (line.part(np.array([5]), np.array([200])) == same.part(np.array([5]), np.array([200]))).all()
    finally:
        line_dedup._SAFE = big


def test_filters(spark):
    r = np.random.RandomState(0)
    keys = r.randint(-(1 << 63), (1 << 63) - 1, 20_000, dtype=np.int64)
    for n in (0, 1, 5000):
        f = line_dedup._numbers(spark.createDataFrame([(int(k),) for k in keys[:n]], "k long").repartition(3))
        assert f.has(keys[:n]).all() and f.has(keys[5000:]).mean() < 0.03
    bits = line_dedup.FILTER_BITS
    try:
        line_dedup.FILTER_BITS = 10  # far too small: everything passes, nothing is lost
        assert line_dedup._numbers(spark.createDataFrame([(int(k),) for k in keys[:5000]], "k long")).has(keys).all()
    finally:
        line_dedup.FILTER_BITS = bits


# 6


def test_fingerprints(spark):
    rows = [(i, prose(i, 5 * i % 90)) for i in range(600, 8, -2)] + [(7, None), (5, ""), (10**12, "Ünï " * 9), (3, prose(8, 40)), (4, prose(8, 40))]
    got = {r.doc_id: r for r in fingerprint.op6_fingerprints(_Reader(spark, docs_of(spark, *rows)), "").collect()}
    text, order = dict(rows), sorted(dict(rows), reverse=True)

    def alike(x, y):
        x, y = Counter(x.split()), Counter(y.split())
        return sum((x & y).values()) / max(1, sum((x | y).values()))

    off = []
    for i, k in zip(order, order[1:] + order[:1], strict=True):
        t, n = text[i] or "", text[k] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        if t:
            off.append(got[i].near_edited - alike(t, edited))
    assert len(got) == len(rows) and abs(np.mean(off)) < 0.02 and np.std(off) < 0.09
    assert got[3].fingerprint == got[4].fingerprint and got[4].near_next == 1.0 and got[5].fingerprint == got[7].fingerprint
    assert got[5].near_edited == 1.0
    one = fingerprint.op6_fingerprints(_Reader(spark, docs_of(spark, (1, "a b c d"))), "").first()
    assert one.near_next == 1.0
    assert fingerprint.op6_fingerprints(_Reader(spark, docs_of(spark, (1, "a")).limit(0)), "").count() == 0
    assert fingerprint.op6_fingerprints(_Reader(spark, docs_of(spark, (None, "a"), (None, None), (1, "b"), (1, "b"))), "").count() == 4


def test_fingerprints_of_any_ids(spark):
    """Ids spread over all 64 bits, many rows with one id or none: the order is whole, no window holds all rows."""
    r = np.random.RandomState(4)
    rows = [(int(x), f"text {k} of many") for k, x in enumerate(r.randint(-(1 << 63), (1 << 63) - 1, 300, dtype=np.int64))]
    rows += [(77, f"same id {k} here") for k in range(60)] + [(None, f"no id {k} here") for k in range(60)] + [(-5, "equal rows")] * 4
    out = fingerprint.edited_fingerprints(docs_of(spark, *rows), range_rows=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan
    got = sorted((x.id is None, -(x.id or 0), x.edited_sha256) for x in out.collect())
    version = {t: h for t, h in docs_of(spark, *rows).select("text", F.xxhash64("text")).collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), -version[x[1]]))
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want.append((i is None, -(i or 0), hashlib.sha256(edited.encode()).hexdigest()))
    assert got == sorted(want)


class _Reader:
    """Stands for a session whose tables are these."""

    def __init__(self, spark, df):
        self.spark, self.df = spark, df
        self.read = self

    def parquet(self, _):
        return self.df


def test_expression_and_aggregation_agree(spark):
    df = spark.createDataFrame([(1, "a b a c " * 9), (2, ""), (3, prose(1, 200))], "id int, t string")
    one = {r.id: r.s for r in df.select("id", fingerprint.signature(F.col("t")).alias("s")).collect()}
    many = {r.id: r.sig for r in fingerprint.signatures(df, ["id"], [F.col("t")]).collect()}
    assert one == many


# 7


def test_warc(spark):
    big, rows = "é<p>" * 9000, []
    rows += [(1, "http://a/\r\nX: y", "x" * 999), (2, None, "x" * 999), (3, "http://b/", "y" * 1000), (9, "http://c/", "y" * 1000), (4, "u", big), (5, "u", big), (6, "u", None), (7, "u", ""), (8, "u", "WARC/1.1\r\n" * 3000 + "\r\n\r\nWARC"), (10, "u", "\r\n0\r\n\r\n" * 400)]
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = {r.page_id: r for r in warc.op7_warc(_Writer(spark, pages), "").collect()}
    for i, _, h in rows:
        data = (h or "").encode()
        same = [k for k, _, x in rows if x == h and len(data) >= 1000]
        keeper = max(same, default=i)
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if keeper == i else ("revisit", keeper))
    path = fresh_path(spark, "warc-test")
    warc.write(pages, path, "page_id", "url", "html")
    kinds = Counter(r.type for r in warc.scan(spark, path).collect())
    assert kinds["response"] == 8 and kinds["revisit"] == 2 and kinds["continuation"] >= 3
    back = {r.name: r for r in warc.read(spark, path).collect()}
    five = next(r for n, r in back.items() if n.startswith("<urn:record:5."))
    assert bytes(five.payload).decode() == big and not any(r.error for r in back.values())
    assert warc.op7_warc(_Writer(spark, pages.limit(0)), "").count() == 0


def test_warc_of_repeated_ids(spark):
    big, other = "z" * 40_000, "y" * 2000
    rows = [(9, big), (9, big), (3, big), (5, other), (5, other), (2, other), (7, "small"), (7, "small"), (None, other), (None, None), (9, "q" * 1500)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").repartition(3)
    pages = written(pages, "pages")
    got = Counter(tuple(r) for r in warc.op7_warc(_Writer(spark, pages), "").collect())
    want, told = Counter(), set()
    for i, h in sorted(rows, key=lambda r: -(r[0] or -1)):
        data = (h or "").encode()
        first = max(k for k, x in rows if x == h and k is not None) if len(data) >= 1000 else None
        again = first is not None and h in told
        told.add(h)
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert got == want


class _Writer(_Reader):
    def __getattr__(self, name):
        return getattr(self.spark, name)

    def __init__(self, spark, df):
        self.spark = spark
        real = spark.read

        class Read:
            def __getattr__(self, name):
                return getattr(real, name)

            def parquet(self, path):
                return df

            def schema(self, s):
                return spark.read.schema(s)

        self.read = Read()


def test_warc_framing_and_broken_records(spark, tmp_path):
    r = np.random.RandomState(0)
    for n in (0, 1, 4095, 4096, 4097, 20_000):
        data = bytes(r.choice(list(b"WARC/1.\r\n0"), n))
        assert warc.unframe(warc.frame(data)) == data and warc.VERSION not in warc.frame(data + warc.VERSION * 3)
    for broken in (b"", b"5\r\nab", b"zz\r\n", b"1\r\nab\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unframe(broken)
    parts = list(warc.records("<urn:record:1>", None, b"z" * 40_000, "d", None, 16_384))
    (tmp_path / "a.warc").write_bytes(b"\r\n".join([*parts[:1], *parts[2:]]) + b"\r\n")
    assert warc.read(spark, str(tmp_path)).first().error == "segments are missing"


# 8


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        for k in range(max(1, len(v) - 12)) if v else ():
            win = v[k : k + 13]
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(i)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [60, 400_000])
def test_decontamination(spark, block):
    items = [(1, prose(1, 40)), (2, "short item"), (3, prose(1, 40)), (4, None), (5, "..."), (6, prose(2, 13)), (7, prose(3, 14)), (None, prose(4, 20)), (8, "one two three four five six")]
    a, b = prose(1, 40).split(), prose(3, 14)
    rows = [(1, None), (2, ""), (3, " ".join(a[5:30]).upper() + " x " + " ".join(a[0:20])), (4, prose(9, 300) + ", Short-ITEM. " + b), (5, prose(2, 13) * 2), (6, "short, item short item"), (7, prose(4, 20)), (8, prose(50, 2000)), (9, " ".join(a[:12]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(docs_of(spark, *rows), bench, block_words=block)
    got = {r.id: (r.n_words, r.n_hit, sorted(r["items"])) for r in out.collect()}
    assert got == {i: brute_hits(t, [x for x in items if x[0] is not None]) for i, t in rows}
    assert decontaminate.contamination(docs_of(spark, *rows), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs_of(spark, *rows).limit(0), bench).count() == 0


@pytest.mark.parametrize("block", [60, 400_000])
def test_decontamination_of_repeated_rows_and_items(spark, block):
    items = [(3, prose(1, 40)), (3, prose(1, 40)), (4, prose(2, 40)), (5, prose(3, 40))]
    rows = [(1, prose(1, 40)), (1, prose(2, 40) + " " + prose(8, 30)), (1, prose(9, 50)), (None, prose(3, 40)), (None, prose(9, 60)), (None, prose(9, 60)), (2, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(docs_of(spark, *rows), bench, block_words=block)
    got = Counter((r.id, r.n_words, r.n_hit, r.n_items, tuple(sorted(r["items"])), r.contaminated) for r in out.collect())
    want = [(i, *brute_hits(t, items)) for i, t in rows]
    assert got == Counter((i, n, hit, len(found), tuple(found), hit > 0 and 20 * hit >= n) for i, n, hit, found in want)


@pytest.mark.parametrize("block", [60, 400_000])
def test_decontamination_with_text_ids_and_words_alike(spark, block):
    items = [(f"item {i}", f"{x} one two") for i, (x, _) in enumerate(PAIRS)] + [("z", prose(5, 30))]
    rows = [(i, f"{w} one two") for i, pair in enumerate(PAIRS) for w in pair]
    out = decontaminate.contamination(docs_of(spark, *rows), spark.createDataFrame(items, "item_id string, text string"), block_words=block)
    got = Counter((r.id, r.n_hit, tuple(r["items"]), r.longest) for r in out.collect())
    assert got == Counter(x for i in range(len(PAIRS)) for x in ((i, 3, (f"item {i}",), 3), (i, 0, (), 0)))


@pytest.mark.parametrize("block", [60, 400_000])
def test_decontamination_stage(spark, tmp_path, monkeypatch, block):
    items = [(1, prose(1, 40)), (2, "in short")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    whole, part = prose(1, 40).split(), prose(7, 600)
    clean = [(2, " ".join(whole[:12]) + " " + part), (3, part + " in short " + prose(8, 300)), (None, None), (4, ""), (None, part), (5, part), (5, part)]
    dirty = [(1, part + " " + " ".join(whole[3:16]) + " " + part), (5, "in short"), (None, " ".join(whole)), (6, "In, SHORT")]
    real = decontaminate.benchmark_hits
    monkeypatch.setattr(decontaminate, "benchmark_hits", lambda *a, **k: real(*a, block_words=block, **k))
    docs = docs_of(spark, *clean, *dirty)
    got = decontaminate.stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and Counter((r.doc_id, r.text) for r in got.collect()) == Counter(clean)
    for r in got.collect():
        _, hit, _ = brute_hits(r.text, items[:1])
        assert not hit  # nothing kept holds a window
    assert decontaminate.stage(spark, docs.limit(0), str(tmp_path)).count() == 0


# 9


def test_quality_learns_from_all_documents(spark):
    r = np.random.RandomState(0)
    docs = spark.createDataFrame([(i,) for i in range(6500)], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas().doc_id.tolist()
    rows = [(i, prose(i, 25) if k < 5000 else "#=%d " % r.randint(10) * 30) for k, i in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = quality.fit(df, spark.createDataFrame([(i,) for i in docs[:1000]], "doc_id long"))
    assert abs(model.prior - 5000 / 6500) < 0.1
    kept = df.where(quality.scorer(df, model)("text") >= quality.THRESHOLD).select("doc_id").toPandas().doc_id
    assert not set(kept) - set(docs[:5000]) and len(kept) > 4750


def test_quality(spark):
    rows = QUERIES["op9_quality_classifier"](spark, SMALL).toPandas().set_index("doc_id")
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in rows.held_out.items())
    assert ((rows.score >= 0.3) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas().set_index("doc_id").quality
    both = rows.join(labels, how="inner")
    test = both[both.held_out]
    assert (test.predicted == test.quality).mean() > 0.8


def test_quality_edges(spark):
    docs = docs_of(spark, (1, None), (2, ""), (3, prose(1, 20)), (3, prose(1, 20)), (None, "x"))
    none = quality.fit(docs, docs.select("doc_id").limit(0))
    assert {r.s for r in docs.select(quality.scorer(docs, none)("text").alias("s")).collect()} == {0.5}
    some = quality.fit(docs, docs.select("doc_id"))
    got = [r.s for r in docs.select("doc_id", quality.scorer(docs, some)("text").alias("s")).where("doc_id = 3").collect()]
    assert got[0] == got[1]
    empty = docs.limit(0)
    assert empty.select(quality.scorer(empty, quality.fit(empty, empty.select("doc_id")))("text")).count() == 0


def test_quality_against_the_risk_by_hand(spark):
    """Features, prior, risk and scores computed again in numpy from the definitions, and the fit held against them."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    trusted = quality._trusted(spark, SMALL)
    model = quality.fit(docs, trusted)
    good, rows = {r.doc_id for r in trusted.collect()}, docs.select("doc_id", "text").orderBy("doc_id").collect()
    x = np.stack([brute_features(r.text).astype(np.float16).astype(float) for r in rows])
    p = np.array([r.doc_id in good for r in rows])
    got = {r.doc_id: r.score for r in QUERIES["op9_quality_classifier"](spark, SMALL).collect()}
    z = np.stack([brute_features(r.text) for r in rows]) @ model.weights.astype(float) + model.bias
    assert np.allclose([got[r.doc_id] for r in rows], 1 / (1 + np.exp(-z)), atol=1e-3)
    # the sums that executors add up are those of the risk
    points = np.stack([np.append(model.weights, model.bias), np.zeros(x.shape[1] + 1), np.r_[np.full(x.shape[1], 0.01), -0.3]])
    table = spark.createDataFrame([(int(a), k % 2, bytearray(np.asarray(v, np.float16).tobytes())) for k, (a, v) in enumerate(zip(p, x, strict=True))], "p int, half int, x binary").repartition(3)
    for half in (None, 0):
        use = np.ones(len(p), bool) if half is None else np.arange(len(p)) % 2 == half
        for v, w in zip(quality._risks(table, points, half), points, strict=True):
            z = x @ w[:-1] + w[-1]
            loss, s = np.log1p(np.exp(z)), 1 / (1 + np.exp(-z))
            one = np.c_[x, np.ones(len(x))]
            want = [loss[use].sum(), loss[use & p].sum(), np.log1p(np.exp(-z))[use & p].sum()]
            assert np.allclose(v[:3], want, rtol=1e-3)
            assert np.allclose(v[3 : 3 + one.shape[1]], one[use].T @ s[use], rtol=1e-2, atol=1e-1)
            assert np.allclose(v[3 + one.shape[1] :], one[use & p].T @ s[use & p], rtol=1e-2, atol=1e-1)

    def risk(w):
        z, n = x @ w[:-1] + w[-1], p.sum()
        negative = np.logaddexp(0, z).mean() - model.prior * np.logaddexp(0, z[p]).mean()
        return model.prior * np.logaddexp(0, -z[p]).mean() + negative, negative + 2 * model.prior * np.logaddexp(0, z[p]).sum() / n**1.5

    value, slack = risk(np.append(model.weights, model.bias).astype(float))
    assert slack >= -1e-3 and value < 0.6 * risk(np.zeros(x.shape[1] + 1))[0]


def brute_features(text):
    """The features of one text, from their definitions."""
    data = (text or "").encode()
    one, two = np.zeros(256), np.zeros(quality._PAIRS)
    for b in data:
        one[b] += 1
    for a, b in zip(data, data[1:]):
        two[quality._PAIR[a * 256 + b]] += 1
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", data)]
    n = max(1, len(words))
    again = sum(a == b for a, b in zip(words, words[1:])) / n
    upper = sum(0x41 <= b <= 0x5A for b in data) / max(1, len(data))
    length = min(40, sum(map(len, words)) / n) / 40
    extra = [again, np.sqrt(again), (len(words) - len(set(words))) / n, upper, length, np.log1p(len(data)) / 16]
    return np.concatenate([np.sqrt(one / max(1, len(data))), np.sqrt(two / max(1, len(data) - 1)), extra])


def test_quality_stage_edges(spark, tmp_path):
    docs = docs_of(spark, (1, prose(1, 50)), (2, None), (3, ""), (None, prose(2, 50)), (1, prose(3, 50)), (1, prose(3, 50)), (4, "x" * 300_000))
    docs = docs.withColumn("_t", F.lit(1)).withColumn("score", F.lit("s"))
    for labels in ([], [(1, 1), (1, 1), (None, 1), (2, None), (4, 0)]):
        path = str(tmp_path / str(len(labels)))
        spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
        got = quality.stage(spark, docs, path)
        assert got.columns == docs.columns and got.count() == (7 if not labels else got.count())
        assert quality.stage(spark, docs.limit(0), path).count() == 0


def test_class_prior(spark):
    """Made-up features with a known share of positives among the unlabelled."""
    r = np.random.RandomState(0)
    good, bad = r.randn(2400, 5) + 1, r.randn(600, 5) - 2
    every = np.concatenate([good, bad]) / 4
    x = np.pad(every, ((0, 0), (0, quality.FEATURES - 5))).astype(np.float16)
    rows = [(int(k < 900), int(r.randint(2)), bytearray(v.tobytes())) for k, v in enumerate(x)]
    m = quality._train(spark.createDataFrame(rows, "p int, half int, x binary").repartition(4))
    assert abs(m.prior - len(good) / len(every)) < 0.08
    score = m.score(x.astype(np.float32))
    assert (score[: len(good)] > 0.5).mean() > 0.95 and (score[len(good) :] < 0.5).mean() > 0.9
    q = np.zeros((2, 100))
    q[0, 60:80], q[1, 60:80], q[1, 10:20] = 50, 70, 60
    assert abs(quality._best_bin(*q) - 1400 / 2000) < 1e-9 and quality._best_bin(q[0] * 0, q[1]) == 0.5


# 10


def test_mixing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out, mix = mixing.rates(docs, docs, mixing.TARGETS)
    rows = out.collect()
    p, n, rate = np.array([r.p for r in rows]), np.array([r.tokens for r in rows], float), np.array([r.rate for r in rows])
    assert np.allclose(p.sum(1), 1) and rate.min() >= 0
    total = (p * (n * rate)[:, None]).sum(0)
    assert np.allclose(total / total.sum(), [mixing.TARGETS[d] for d in mix.classifier.domains], atol=1e-3)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.tokens == len([w for w in re.split(r"[ \t\n\x0b\f\r]+", text[r.id]) if w]) for r in rows)
    # the same descent in numpy
    goal = n.sum() * np.array([mixing.TARGETS[d] for d in mix.classifier.domains])
    mass, r = (p * n[:, None]).sum(0), np.ones(len(n))
    for _ in mix.steps:
        r = np.maximum(0, r - p @ (((p * (n * r)[:, None]).sum(0) - goal) / mass))
    assert np.allclose(r, rate, atol=1e-6)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([mix.classifier.domains[int(np.argmax(r.p))] == lang[r.id] for r in rows if r.tokens > 20]) > 0.95


def test_mixing_edges(spark):
    docs = docs_of(spark, (1, None), (2, ""), (3, "the and of"), (3, "the and of"), (None, "the"))
    out, _ = mixing.rates(docs, docs.limit(0), mixing.TARGETS)
    assert out.count() == 5 and all(abs(sum(r.p) - 1) < 1e-9 and r.rate >= 0 for r in out.collect())
    assert mixing.rates(docs.limit(0), docs.limit(0), mixing.TARGETS)[0].count() == 0
    kept = mixing.stage(spark, docs, SMALL)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, None} and kept.first().tokens == 1
    assert mixing.stage(spark, docs.limit(0), SMALL).count() == 0


def test_mixing_stops_where_targets_are_out_of_reach(spark):
    """Certain members with rates held at 1 at least: the step's projection is 0 once nothing moves."""
    model = mixing.Classifier(["a", "b"], {"a": [0.0], "b": [0.0]}, {"a": 0.5, "b": 0.5})
    members = spark.createDataFrame([(100, [1.0, 0.0]), (50, [0.0, 1.0])], "tokens long, p array<double>")
    mix = mixing.fit(members, model, {"a": 0.1, "b": 0.9}, least=1.0, total=150.0)
    assert len(mix.steps) <= 3
    assert [round(r.r, 4) for r in members.select(mix.rate(F.col("p")).alias("r")).collect()] == [1.0, 2.7]
    soft = spark.createDataFrame([(100, [0.6, 0.4]), (50, [0.45, 0.55])], "tokens long, p array<double>")
    mix = mixing.fit(soft, model, {"a": 0.52, "b": 0.48})
    r = [x.r for x in soft.select(mix.rate(F.col("p")).alias("r")).collect()]
    totals = [60 * r[0] + 22.5 * r[1], 40 * r[0] + 27.5 * r[1]]
    assert np.allclose(totals, [78, 72], rtol=2e-2)


def test_mixing_posteriors_by_hand(spark):
    """Naive Bayes again, word by word: the same hash from another library."""
    import xxhash

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    labelled = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id % 3 = 0")
    out, _ = mixing.rates(docs, labelled, mixing.TARGETS)
    split = lambda t: [w for w in re.split(r"[ \t\n\x0b\f\r]+", t or "") if w]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    bucket = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42)) % mixing.BUCKETS
    domains = sorted(mixing.TARGETS)
    counts, n = {d: Counter() for d in domains}, Counter()
    for r in labelled.collect():
        if r.lang in counts:
            counts[r.lang].update(map(bucket, split(r.text)))
            n[r.lang] += 1
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        w, z = [bucket(x) for x in split(text[r.id])], []
        for d in domains:
            total = sum(counts[d].values()) + 0.1 * mixing.BUCKETS
            likely = sum(np.log((counts[d][b] + 0.1) / total) for b in w) / max(1, len(w))
            z.append(likely * mixing.SHARPNESS + np.log((n[d] + 1) / (sum(n.values()) + len(domains))))
        e = np.exp(np.array(z) - max(z))
        assert np.allclose(r.p, e / e.sum(), atol=1e-9)


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = corpus_pipeline.run(spark, SMALL)
    assert set(docs.columns) < set(out.columns)
    score = {r.doc_id: r.predicted for r in QUERIES["op9_quality_classifier"](spark, SMALL).collect()}
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if score[r.doc_id]]
    firsts = {c for _, _, c in brute_components(rows, 5, 80)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    full = [x for x in items if len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x[1] or "")) >= 13]
    clean = set()
    for i, t in rows:
        if i in firsts:
            w, hit, _ = brute_hits(t, items)
            if not (hit and 20 * hit >= w) and not brute_hits(t, full)[1]:
                clean.add(i)
    times = Counter(r.doc_id for r in out.collect())
    assert set(times) == clean
    # copies by the rates of op10's targets
    left = docs.where(F.col("doc_id").isin(list(clean)))
    rated, mix = mixing.rates(left, mixing.labelled_sample(left, spark.read.parquet(f"{SMALL}/labels.parquet")), mixing.TARGETS, total="all")
    tokens, share = Counter(), {d: k for k, d in enumerate(mix.classifier.domains)}
    for r in rated.collect():
        assert times[r.id] in {max(1, int(r.rate)), int(r.rate) + 1}
        for d, k in share.items():
            tokens[d] += times[r.id] * r.tokens * r.p[k]
    assert all(abs(tokens[d] / sum(tokens.values()) - t) < 0.03 for d, t in mixing.TARGETS.items())


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
