"""A quality score is a function of the text alone; a plain scorer that reads one text at a time gives the same."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quittance.llm import quality
from quittance.llm.wordhash import _BYTES, BASE, chunks

MASK = (1 << 64) - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def hashed(data: bytes) -> int:
    return sum(int(_BYTES[b]) * pow(BASE, k, 1 << 64) for k, b in enumerate(data)) & MASK


def plain_score(model, text):
    words = [mixed(hashed(w.encode()) + len(w.encode()) & MASK) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    found = [mixed(w ^ 1) for w in words]
    for k, w in enumerate(words):
        back = next((b for b in (1, 2, 3) if k >= b and words[k - b] == w), 4)
        found.append(mixed((back - 1) ^ 77))
    for size in quality.GRAMS:
        found += [mixed(hashed(text[k : k + size].encode()) ^ size) for k in range(len(text) - size + 1)]
    total = sum(int(model.table[x >> (64 - quality.BITS)]) for x in found)
    return 1 / (1 + math.exp(-(model.bias + total / quality.UNIT / max(len(found), 1))))


@pytest.fixture(scope="module")
def model():
    table = np.random.default_rng(5).integers(-3 << 24, 3 << 24, 1 << quality.BITS)
    return quality.Model(table, -0.7)


def texts():
    r = random.Random(2)
    words = ["alpha", "beta", "ß", "日本語", "é", "\U0001f600", "a", "gamma", "zulu", "a"]
    out = ["alpha beta gamma", "zulu", "alpha beta gamma", "gamma beta", "alpha beta gamma", "", " ", "\n\t ", "a", "ab", "日", "日本", "a a a a", "a"]
    return out + [r.choice([" ", "  ", "\n"]).join(r.choice(words) for _ in range(r.randrange(12))) for _ in range(200)] + ["x" * 50_000, "word " * 20_000]


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_scores_equal_a_plain_scorer(model, size):
    found = texts()
    got = np.concatenate([model.score(c) for c in chunks(pa.array(found), size)])
    assert got.tolist()[:-2] == [plain_score(model, t) for t in found[:-2]]
    alone = [model.score(c)[0] for t in found for c in chunks(pa.array([t]))]
    assert got.tolist() == alone


def test_scores_do_not_depend_on_batches(spark):
    r = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(r.choice(words[: 30 if k % 2 else 60]) for _ in range(r.randrange(1, 40)))) for k in range(200)]
    rows += [(1000 + k, rows[k][1]) for k in range(50)] + [(None, rows[3][1]), (2007, None), (2008, ""), rows[0], rows[0]]
    docs = spark.createDataFrame([(*x, "x", "y") for x in rows], "doc_id long, text string, score string, held_out string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    text = {i: t or "" for i, t in rows}
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, seen = spark.conf.get(setting), []
    for batch in (1, 3, 10_000):
        spark.conf.set(setting, batch)
        got = quality.score_quality(docs.repartition(3), labels).collect()
        spark.conf.set(setting, was)
        by = {}
        for x in got:
            by.setdefault(text[x["doc_id"]], set()).add(x["score"])
        assert len(got) == len(rows) and all(len(v) == 1 for v in by.values())
        seen.append(by)
    assert seen[0] == seen[1] == seen[2] and len({s for v in seen[0].values() for s in v}) > 100
