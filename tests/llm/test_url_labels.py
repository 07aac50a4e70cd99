"""Labelled URLs beyond the trees' sample."""

from pyspark.sql import functions as F

from quittance.llm import url_filter


def scores(spark, pages, labelled):
    pages = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    labelled = spark.createDataFrame(labelled, "url string, y int")
    return {r["page_id"]: r["block_score"] for r in url_filter.filter_urls(pages, [], labelled=labelled).collect()}


def test_copies_of_a_hot_url_take_one_place(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SAMPLE", 60)
    urls = [(f"https://s{k}.aa/" + ("x" * 40 if k % 2 else "y"), k % 2) for k in range(50)]
    least = spark.createDataFrame(urls, "u string, y int").orderBy(F.xxhash64("u")).first()
    got = scores(spark, [u for u, _ in urls], urls + [tuple(least)] * 3000)
    assert len(set(got.values())) > 1


def test_rates_are_of_all_labelled_urls(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SAMPLE", 40)
    urls = [(f"https://s{k:03d}.aa/p{j}", k % 2) for k in range(100) for j in range(4)]
    got = scores(spark, [u for u, _ in urls], urls)
    assert min(got[i] for i, (_, y) in enumerate(urls) if y) > max(got[i] for i, (_, y) in enumerate(urls) if not y)


def test_held_out_sites_are_judged_by_what_their_urls_look_like(spark):
    """Each URL has a site of its own, so a rate that held the URL's own label would tell the trees all and new sites nothing."""
    wrong = lambda k: (k * 2654435761) % 10 == 0

    def url(k):
        return f"https://s{k}.aa/" + ("long/path/" * 3 if k % 2 else "p") + str(k)

    known = [(url(k), (k % 2) ^ wrong(k)) for k in range(1000, 1400)]
    got = scores(spark, [url(k) for k in range(2000, 2200)], known)
    assert sum((got[i] >= 0.5) == bool(i % 2) for i in range(200)) >= 190


def test_a_rate_leaves_out_its_own_fold(spark):
    rows = [(f"https://a{k}.b.cc/{j}", f"a{k}.b.cc", (j + k) % 2, 1 + j % 3) for k in range(7) for j in range(9)]
    counted = spark.createDataFrame(rows, "u string, host string, y long, n long").withColumn("fold", url_filter._fold(F.col("u")))
    kept = {r["u"]: r["fold"] for r in counted.collect()}
    assert set(kept.values()) <= set(range(url_filter.FOLDS)) and len(set(kept.values())) > 1
    met = counted.withColumn("s3", url_filter._suffix(F.col("host"), 3)).join(url_filter._suffix_counts(counted, 3), "s3")
    for u, host, whole, without in met.select("u", "host", url_filter._rate(3, 0.25, None), url_filter._rate(3, 0.25, F.col("fold"))).collect():
        for got, others in ((whole, [r for r in rows if r[1] == host]), (without, [r for r in rows if r[1] == host and kept[r[0]] != kept[u]])):
            assert abs(got - (sum(r[2] * r[3] for r in others) + 0.25) / (sum(r[3] for r in others) + 1)) < 1e-12
