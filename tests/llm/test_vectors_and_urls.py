"""Nearest neighbours and URL verdicts against brute force."""

import re

import numpy as np
import pytest

from quittance.llm import ann, url_filter


def brute(ids, vectors, k=20, every=20):
    out = {}
    for i, x in zip(ids, vectors, strict=True):
        if i % every == 0:
            scores = [(-float((v * x).sum()), j) for j, v in zip(ids, vectors, strict=True) if j != i]
            out[i] = [(j, -s) for s, j in sorted(scores)[:k]]
    return out


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = rows.toPandas()
    want = brute(data.vec_id.tolist(), np.array(data.embedding.tolist(), float))
    got = {}
    for r in ann.nearest_neighbours(rows).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    hits = []
    for i, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and i not in {f[1] for f in found}
        assert all((a[2], -a[1]) > (b[2], -b[1]) for a, b in zip(found, found[1:], strict=False))
        hits.append(len({f[1] for f in found} & {j for j, _ in want[i]}) / 20)
    assert np.mean(hits) >= 0.95


def test_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=4) * (1 + k % 3)], k, "x") for k in range(120)]
    rows += [(k, rows[5][1], 0, "x") for k in range(200, 300)]
    rows += [(300, [0.0] * 4, 0, "x"), (320, None, 0, "x"), (340, [1.0, None, 0.0, 0.0], 0, "x"), (360, [float("nan")] * 4, 0, "x"), (380, [float("inf"), 0.0, 0.0, 0.0], 0, "x"), (400, [1.0], 0, "x"), (None, [1.0] * 4, 0, "x"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score string")
    valid = {r[0]: r[1] for r in rows if r[0] is not None and r[0] < 300}
    want = brute(list(valid), [np.array(v) for v in valid.values()])
    got = {}
    for r in ann.nearest_neighbours(df).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    for i in want:
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]] and np.allclose([s for _, s in got[i]], [s for _, s in want[i]])
    assert ann.nearest_neighbours(df.where("false")).count() == 0
    assert ann.nearest_neighbours(df.where("vec_id in (0, 3)")).count() == 1
    assert ann.nearest_neighbours(df.where("vec_id = 0")).count() == 0


def test_near_copies_are_all_scored():
    order = np.tile(np.arange(64, dtype=np.int16), (500, 1))
    assert len(ann.InvertedFiles(order).nearest(order[0], 10)) == 500


URLS = [
    None, "", "no scheme", "http://net/", "http://a.net", "https://a.net/x", "https://WWW.Example.NET/en/1?x=1#y", "https://example.net/de/", "http://notexample.net/en/", "https://example.com/de/5", "https://example.com/fr/5", "https://x.example.com/de",
    "https://example.org/fr/", "https://example.org?fr/", "https://org/fr/a", "ftp://a.b.org/fr/?q", "http://user@net/", "http://a.net:80/", "x://y://z.net/", "HTTP://ÄÖ.NET/", "https://example.com.net/de/#", "http://myorg/fr/",
]


def brute_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best and best[2]


def test_rules(spark):
    df = spark.createDataFrame([(k, u, "x", 1) for k, u in enumerate(URLS)], "page_id long, url string, host string, y int")
    got = {r["page_id"]: r for r in url_filter.filter_urls(df, url_filter.RULES).collect()}
    assert len(got) == len(URLS)
    for k, u in enumerate(URLS):
        host, path, rule, verdict = brute_verdict(u)
        r = got[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block"))
    assert url_filter.filter_urls(df.where("false"), url_filter.RULES).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(df.where("page_id < 2"), url_filter.RULES).collect()} == {"block"}


def test_learned(spark):
    rows = [(f"https://cheap-pills-{k}.spam.biz/p{k * 7919}?a=1&b=2&c=3", 1) for k in range(150)] + [(f"https://news.example.org/en/story-{'x' * (k % 9)}", 0) for k in range(150)]
    labelled = spark.createDataFrame(rows, "url string, y int")
    pages = spark.createDataFrame([(0, "https://cheap-pills-999.other.biz/p123?a=1&b=2&c=3"), (1, "https://daily.example.org/en/story-yy")], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, [], labelled=labelled).collect()}
    assert got[0]["verdict"] == "block" and got[1]["verdict"] == "allow" and got[0]["block_score"] > 0.8 > 0.2 > got[1]["block_score"]


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_match_a_plain_fit(spark, seed):
    """The first split is the best one over all features and bins."""
    rng = np.random.default_rng(seed)
    n, width = 400, len(url_filter.FEATURES)
    bins = rng.integers(0, 5, (n, width))
    y = (bins[:, 3] > 2).astype(int) ^ (rng.random(n) < 0.1)
    df = spark.createDataFrame([([int(b) for b in row], int(v), 1) for row, v in zip(bins, y, strict=True)], "bins array<int>, y long, n long")
    trees = url_filter.fit_trees(df, [[0.0, 1.0, 2.0, 3.0]] * width)
    assert trees[0][:2] == (url_filter.FEATURES[3], 2.0)
