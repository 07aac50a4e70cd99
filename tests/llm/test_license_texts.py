"""License texts in windows of whole texts, against brute force over all windows."""

import random
import re

from quittance.llm import license_scan, license_texts


def brute(text, known, threshold):
    w = re.sub("[^a-z0-9]+", " ", (text or "").translate({i: i + 32 for i in range(65, 91)})).split()
    pairs = list(zip(w, w[1:], strict=False))
    best = {}
    for name, template in known:
        t = {tuple(g.split()) for g in license_scan.bigrams(template)}
        for i in range(len(pairs)):
            seen, shared = set(), 0
            for p in pairs[i:]:
                if p not in seen:
                    seen.add(p)
                    shared += p in t
                dice = 2 * shared / (len(seen) + len(t))
                if dice >= threshold:
                    best[name] = max(best.get(name, 0), dice)
    top = min(best, key=lambda n: (-best[n], n), default=None)
    return top, best.get(top), ",".join(sorted(best))


def scanned(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: (r["license"], r["dice"], r["licenses"]) for r in license_texts.scan_license_texts(df, **kw).collect()}


def test_notices_in_longer_lines_and_over_lines(spark):
    n = license_scan.NOTICES
    texts = [
        "Released under the MIT License. See the LICENSE file.", "Copyright (c) 2020 Jane Doe. Released under the MIT License.",
        n["GPL-3.0"].replace("General ", "General\n * "), n["BSD-3-Clause"].replace("with or", "with\nor"), "see: " + n["Apache-2.0"] + " You may not use this file except in compliance with it.",
    ]
    got = scanned(spark, texts)
    assert [got[k][:2] for k in range(len(texts))] == [("MIT", 1.0), ("MIT", 1.0), ("GPL-3.0", 1.0), ("BSD-3-Clause", 1.0), ("Apache-2.0", 1.0)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert license_scan.scan_licenses(df).where("license is null").count() > 0  # lines alone miss them


def test_full_texts(spark):
    full = [(name, text) for name, text in license_texts.templates() if len(text) > 600]
    assert {name for name, _ in full} >= {"MIT", "ISC", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0"}
    got = scanned(spark, [f"some words first\n{text}\nand some words after it" for _, text in full] + [None, "", "one", "no license here"])
    for k, (name, _) in enumerate(full):
        assert got[k][0] == name and got[k][1] == 1.0, (name, got[k])
    assert all(got[len(full) + k] == (None, None, "") for k in range(4))


def test_windows_by_brute_force(spark):
    r = random.Random(5)
    known = [("A", "a b c d e f g h a b"), ("B", "b c d e"), ("C", "x y"), ("D", "d e f a b c a"), ("none", "x")]
    texts = ["".join(r.choice("abcdefghxy")+r.choice(["  ", "\n", ". "]) for _ in range(r.randrange(0, 40))) for _ in range(60)]
    for _ in range(150):
        parts = r.choice(known)[1].split() + r.choice(known)[1].split()
        for _ in range(r.randrange(0, 4)):
            parts.insert(r.randrange(len(parts) + 1), r.choice("abcdefgh"))
        texts.append(" ".join(r.choice("abcxyz") for _ in range(r.randrange(5))) + "\n" + r.choice([" ", "\n"]).join(parts).upper())
    for threshold in (0.8, 0.5):
        got = scanned(spark, texts, known=known, threshold=threshold)
        for k, text in enumerate(texts):
            want = brute(text, known, threshold)
            assert (got[k][0], got[k][2]) == (want[0], want[2]) and (want[1] is None or abs(got[k][1] - want[1]) < 1e-9), (text, got[k], want)
