"""Top-k search, URL filters, mixing and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from txgauge.llm import knn_join, mixing, queries, url_reputation

SMALL = "/root/testdata/sf0.001"


def slow_top_k(rows, k):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, (q, v) in enumerate(fine):
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, x, strict=False)), i) for other, (i, x) in enumerate(fine) if other != own)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "k"), [(5, 10), (700, 10), (700, 3)])
def test_top_k(spark, n, k):
    rnd = random.Random(n)
    rows = [(i, [round(rnd.gauss(rnd.choice([0, 3]), 1), 2) for _ in range(6)]) for i in range(n)]
    rows += [(10_000 + i, rows[0][1]) for i in range(60)] + [(20_000, None), (20_001, []), (20_002, [None] * 6), (20_003, [math.nan] * 6), (20_100, [math.inf] * 6), (None, rows[1][1]), rows[0], rows[0], (20_200, [0.0] * 6), (20_300, [1.0, 2.0]), (20_301, [4.0] * 9)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    import numpy as np

    exact = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in knn_join.top_k(d, F.col("vec_id") % 100 == 0, k, pivots=8).collect())
    assert got == slow_top_k(exact, k)


def test_top_k_empty(spark):
    d = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert knn_join.top_k(d, F.col("vec_id") % 100 == 0).collect() == []
    one = spark.createDataFrame([(100, [1.0])], d.schema)
    assert knn_join.top_k(one, F.col("vec_id") % 100 == 0).collect() == []


@pytest.mark.parametrize("hot", [False, True])
def test_top_k_prunes(spark, hot):
    """On clustered vectors less than half of all pairs are scored; a vector that a third of the rows share is whole."""
    import numpy as np

    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 24))
    x = np.floor(1024 * (centres[rng.integers(0, 60, 6000)] + 0.15 * rng.normal(size=(6000, 24))))
    if hot:
        x[1::3] = x[1]
    d = spark.createDataFrame([(i, (v / 1024).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(7)
    scored = spark.sparkContext.accumulator(0)
    got = knn_join.top_k(d, F.col("vec_id") % 20 == 0, evaluated=scored).collect()
    s = x[::20] @ x.T
    s[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    want = [(20 * q, n, int(i), int(s[q, i])) for q in range(300) for n, i in enumerate(np.lexsort((np.arange(6000), -s[q]))[:10], 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    assert 0 < scored.value < (1 if hot else 0.5) * 300 * 6000


def test_site(spark):
    hosts = {"a.b.example.com": ("com", "example.com"), "x.com:8080": ("com", "x.com"), "u:p@www.x.co.uk:80": ("co.uk", "x.co.uk"), "1.2.3.4": ("ip", "1.2.3.4"), "1.2.3.4:80": ("ip", "1.2.3.4"), "com": ("com", "com"), "": ("", ""), "x.com.": ("com", "x.com"), "co.uk": ("co.uk", "co.uk"), "a.b.c.city.jp": ("city.jp", "c.city.jp")}
    d = spark.createDataFrame([(h,) for h in hosts], "h string")
    more = (*url_reputation.SECOND_LEVEL, "city.jp")
    site = url_reputation.site_of(F.col("h"))
    got = {r.h: (r.s, r.d) for r in d.select("h", url_reputation.suffix_of(site, more).alias("s"), url_reputation.domain_of(site, more).alias("d")).collect()}
    assert got == hosts


def test_rules(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/de/x", "http://example.com/DE/", "http://a.example.com/de/", "https://example.net/en/?q", "https://example.net/fr/", "http://notexample.net/en/", "http://x.org/fr/a#b", "http://x.org/en/", "http://org/fr/", "ftp://u:p@x.org:80/fr/", "http://a.com?x=://b.net/", "http://a.com#://b.net/", "://net", "http://net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge_urls(pages, labels, queries.RULES).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.com", "/de/x", "example.com/de/", "block")
    assert got[4][2] is None and got[5][2] == "example.com/de/"
    assert got[6] == ("example.net", "/en/", "example.net/en/", "allow") and got[7][2:] == ("net/", "block") and got[8][2:] == ("net/", "block")
    assert got[9] == ("x.org", "/fr/a", "org/fr/", "allow") and got[10][2] is None and got[11][2] == "org/fr/"
    assert got[12][0] == "u:p@x.org:80" and got[13][:2] == ("a.com", "") and got[14][:2] == ("a.com", "")
    assert got[15] == ("net", "", None, "allow") and got[16][2:] == ("net/", "block")


def test_reputation(spark):
    """Hosts with many bad pages are blocked, also a host without labels of a domain full of bad ones; others are not."""
    rows, said = [], []
    for h, n, bad in (("bad.spam.com", 200, 190), ("worse.spam.com", 100, 98), ("good.com", 300, 3), ("mixed.com", 100, 30), ("one.fine.com", 1, 1)):
        for i in range(n):
            rows.append((len(rows), f"http://{h}/{i}"))
            said.append((rows[-1][0], 1, 1 if i < bad else 0))
    rows.append((9_000, "http://new.spam.com/"))
    rows.append((None, "http://good.com/"))
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit("clash"))
    labels = spark.createDataFrame([*said, (0, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.host: r.verdict for r in url_reputation.judge_urls(pages, labels, queries.RULES).collect()}
    assert got["bad.spam.com"] == got["worse.spam.com"] == "block" and got["good.com"] == got["mixed.com"] == got["one.fine.com"] == "allow"
    assert url_reputation.judge_urls(pages.limit(0), labels, queries.RULES).collect() == []


def slow_targets(sizes, weights, share, most):
    total, left, out = share * sum(sizes.values()), dict(sizes), {}
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    while left:
        rest = total - sum(out.values())
        goal = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if goal[s] > most * sizes[s]]
        if not over:
            return out | goal
        for s in over:
            out[s] = most * sizes[s]
            del left[s]
    return out


def test_mixing(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join("w" * rnd.randrange(1, 9) for _ in range(rnd.randrange(0, 40))), rnd.choice(["b", "b", "b", "b", "a", "c", "Ω", None]) if i % 50 else "tiny") for i in range(3000)]
    rows += [(9_000, None, "a"), (9_001, "", "only empty"), rows[5], (None, "x y", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("clash")).repartition(5)
    got = mixing.mixed(d).collect()
    assert sorted((r.doc_id, r.taken) for r in got if r.doc_id) == sorted((r.doc_id, r.taken) for r in mixing.mixed(d.repartition(2)).collect() if r.doc_id)
    assert len(got) == len(rows) and all(r["size"] == len((r.text or "").split()) for r in got)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = slow_targets(sizes, (5, 2, 1), 1.0, 3)
    for s, z in sizes.items():
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == z and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(r["size"] for r in mine)
        assert all(r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in mine)
        epochs = {r.taken // r["size"] for r in mine if r["size"]}
        assert not epochs or max(epochs) - min(epochs) <= 1
    assert mixing.emit_mix(d.drop("taken")).count() == sum(r.taken // r["size"] for r in got if r["size"])
    assert mixing.mixed(d.limit(0)).collect() == []


@pytest.mark.parametrize("bucket_rows", [1, 2048])
def test_mixing_takes_smallest_keys(spark, bucket_rows):
    """Of each source, those with the smallest keys, up to the one that ends nearest to the budget; weights count."""
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(("word", "other", "third")) for _ in range(rnd.randrange(1, 60))), rnd.choice("aabbc"), 1.0 if i % 2 else 0.05) for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    got = {r.doc_id: r for r in mixing.mixed(d, weight_col="w", bucket_rows=bucket_rows).collect()}
    keys = {i: -math.log((int(hashlib.md5(f"{i}:{t}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w for i, t, _, w in rows}
    for s in "abc":
        mine = sorted((i for i, _, x, _ in rows if x == s), key=keys.get)
        whole = min(3, int(got[mine[0]].target // got[mine[0]].source_size))
        rest, total, best = got[mine[0]].target - whole * got[mine[0]].source_size, 0, (None, 0)
        best = (rest, 0)
        for n, i in enumerate(mine, 1):
            total += got[i]["size"]
            best = min(best, (abs(total - rest), n))
        extra = set(mine[: best[1]])
        assert all(got[i].taken == got[i]["size"] * (whole + (i in extra)) for i in mine)
    assert sum(got[i].taken for i in got if i % 2) > 1.5 * sum(got[i].taken for i in got if not i % 2)


def test_quality_weight(spark):
    texts = ["plain prose of some words that has nothing odd about it and goes on for a while so that it is long enough", "%%% ### 12 34 $$$ *** 99 || -- ++ == 11 22 33 44 55 66 77 88 99 00 12", "short one", "", None]
    w = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.quality_weight(F.col("t"), F.regexp_count(F.coalesce("t", F.lit("")), F.lit(r"\S+")))).collect()]
    assert w[0] == 1.0 and all(0 < x < 0.6 for x in w[1:])


def test_mixing_long_texts(spark):
    d = spark.createDataFrame([(i, "word " * 200_000, "ab"[i % 2]) for i in range(4)], "doc_id long, text string, source string")
    assert [r["size"] for r in mixing.mixed(d).collect()] == [200_000] * 4


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, want))
