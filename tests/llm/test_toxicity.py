"""Toxicity scores against plain cosines over all examples; calibration on held-out rows; awkward tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quittance.llm import toxicity
from quittance.llm.labelled import training_rows

SF = "/root/testdata/sf0.01"


def bags(vectors):
    return [(np.array(sorted(v), np.int64), np.array([v[t] for t in sorted(v)])) for v in vectors]


@pytest.mark.parametrize("many", [2, 32, 10_000])
def test_block_max_search_is_exact(monkeypatch, many):
    monkeypatch.setattr(toxicity, "MANY", many)
    r = random.Random(2)
    vectors = []
    for k in range(700):
        v = {t: r.random() for t in r.sample(range(60 if k % 3 else 12), r.randrange(0, 9))}
        norm = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / norm for t, x in v.items()} if v else {})
    vectors += vectors[:40]
    index = toxicity.BlockMaxIndex.build(bags(vectors), 61)
    kept = [dict(zip(ids.tolist(), w.tolist(), strict=True)) for ids, w in index.vectors]
    for (ids, w), query in zip(bags(vectors[:90]), vectors[:90], strict=True):
        if query:
            scores = [(sum(x * v.get(t, 0) for t, x in query.items()), k) for k, v in enumerate(kept)]
            want = sorted(((round(s, 12), k) for s, k in scores if s > 0), key=lambda x: (-x[0], x[1]))[:25]
            got = index.nearest(ids, w, 25)
            assert [k for _, k in got] == [k for _, k in want] and np.allclose([s for s, _ in got], [s for s, _ in want], atol=1e-11)


def plain_scores(examples, texts):
    """Every formula again, over dictionaries and all examples: {text: vote}, without calibration."""
    count = lambda t: Counter(re.findall(r"[^\W\d_]+", (t or "").lower()))
    found = [(count(t), y) for _, t, y in examples]
    n, n1 = len(found), sum(y for _, y in found)
    df, df1 = Counter(), Counter()
    for c, y in found:
        for t in c:
            df[t] += 1
            df1[t] += y

    def side(k, m, p):
        return (k * math.log(k / m / p) if k else 0) + ((m - k) * math.log((m - k) / m / (1 - p)) if k < m else 0)

    weight = {}
    for t in df:
        ratio = max(0, 2 * (side(df1[t], n1, df[t] / n) + side(df[t] - df1[t], n - n1, df[t] / n))) if 0 < n1 < n else 0
        weight[t] = math.log((n + 1) / (df[t] + 0.5)) * (0.001 + 0.999 * (ratio / (ratio + 25)) ** 2)

    def unit(c):
        v = {t: (1 + math.log(k)) * weight[t] for t, k in c.items() if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    vectors, out = [unit(c) for c, _ in found], {}
    share = (n1 + 0.5) / (n + 1)
    for text in texts:
        q = unit(count(text))
        near = sorted(((-round(sum(x * v.get(t, 0) for t, x in q.items()), 9), k) for k, v in enumerate(vectors)))[:25]
        near = [(-s, k) for s, k in near if s < 0]
        votes = [1 / (1.05 - s) for s, _ in near]
        out[text] = None if not q else (sum(w * found[k][1] for w, (_, k) in zip(votes, near, strict=True)) + share) / (sum(votes) + 1)
    return out, share


def test_scores_equal_plain_cosines(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    examples = list(training_rows(docs, labels, "toxic", toxicity.SAMPLE))
    model = toxicity.fit(examples)
    texts = [r["text"] for r in docs.where("doc_id % 6 = 0").collect()] + ["", "zzzzqq 123"]
    want, share = plain_scores(examples, texts)
    for t in texts:
        expected = share if want[t] is None else 1 / (1 + math.exp(-(model.slope * math.log(want[t] / (1 - want[t])) + model.offset)))
        assert abs(model.score(t)[0] - expected) < 1e-4


def test_calibration_makes_probabilities():
    r = np.random.default_rng(3)
    truth = r.uniform(-4, 4, 20_000)
    y = (r.random(20_000) < 1 / (1 + np.exp(-truth))).astype(float)
    raw = 1 / (1 + np.exp(-(truth - 1) / 2))  # log odds halved and shifted
    slope, offset = toxicity._calibration(raw, y)
    assert abs(slope - 2) < 0.1 and abs(offset - 1) < 0.1
    assert toxicity._calibration(raw, np.zeros(20_000)) == (1.0, 0.0)
    assert toxicity._calibration(raw, 1 - y) == (1.0, 0.0)


def test_held_out_scores_are_calibrated(spark):
    """On sf0.1: hits, few false alarms, and in bins of the score about as many toxic rows as it says."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(training_rows(docs, labels, "toxic", toxicity.SAMPLE))
    rows = [r for r in docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    p, y = np.array([model.score(r["text"])[0] for r in rows]), np.array([r["toxic"] for r in rows])
    hit = p >= 0.5
    assert (hit == y).mean() > 0.985 and hit[y == 1].mean() > 0.92 and (hit & (y == 0)).sum() <= 2
    low, mid, high = p < 0.1, (p >= 0.1) & (p < 0.7), p >= 0.7
    assert abs(p[low].mean() - y[low].mean()) < 0.02 and abs(p[high].mean() - y[high].mean()) < 0.05 and abs(p[mid].mean() - y[mid].mean()) < 0.3


def awkward(spark):
    words = ["good", "plain", "idiot", "stupid", "tree", "river", "Straße", "日本"]
    r = random.Random(4)
    rows = [(k, " ".join([r.choice(words[:2] + words[4:]) for _ in range(8)] + (["idiot", "stupid"] if k % 4 == 0 else []))) for k in range(120)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "12 !"), (504, "unknownword " * 60_000), (505, "idiot stupid " * 40_000), (None, rows[0][1]), (None, None), rows[3], rows[3]]
    names = ["score", "evidence", "held_out", "predicted", "_id", "_text", "_y", "toxic"]
    docs = spark.createDataFrame([(*x, *names) for x in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(120)] + [(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    return docs.repartition(3), labels


def test_awkward_tables(spark):
    docs, labels = awkward(spark)
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[505]["predicted"] == 1 and len({by[k]["score"] for k in (500, 501, 502, 503)}) == 1 and by[500]["evidence"] == []
    assert by[504]["score"] == by[501]["score"] and by[501]["predicted"] == 0
    assert {e["label"] for e in by[505]["evidence"]} == {1} and all(set(e["terms"]) <= {"idiot", "stupid"} for e in by[505]["evidence"])
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    same = lambda rows: sorted((tuple(r) for r in rows), key=str)
    toxic = {r["doc_id"] for r in got if r["predicted"]} - {None}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    bad = {text[i] for i in toxic}
    assert same(kept.collect()) == same(r for r in docs.collect() if r["text"] not in bad)
    for empty in (docs.where("false"),):
        assert toxicity.score_toxicity(empty, labels).count() == 0 and toxicity.drop_toxic(empty, labels).count() == 0
    assert toxicity.drop_toxic(docs, labels.where("toxic = 0")).count() == docs.count()
    again = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs.repartition(5), labels).collect()}
    assert all(again[k] == by[k]["score"] for k in by if k is not None)


def test_evidence_names_examples_and_terms(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.score_toxicity(docs, labels).where("predicted = 1").collect()
    assert rows
    for r in rows:
        assert 1 <= len(r["evidence"]) <= toxicity.SHOWN
        for e in r["evidence"]:
            assert known[e["doc_id"]] == e["label"] and zlib.crc32(str(e["doc_id"]).encode()) % 5 and 0 < e["cosine"] <= 1.000001 and 0 < len(e["terms"]) <= toxicity.SHOWN_TERMS
    assert {r["doc_id"] for r in toxicity.drop_toxic(docs, labels).collect()} == {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in rows}
    assert toxicity.score_toxicity(docs, labels.where(F.lit(False))).where("score <> 0.5").count() == 0
