"""Operators on documents against brute force, on generated tables that hold every awkward case."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quittance.llm import fingerprints, license_scan, mixing, near_dup, packing, quality, substring_dedup, toxicity

EXTRA = "size long, node string, score string, range string, name string, key string, target string, component string, h string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def texts():
    r = random.Random(11)
    words = [f"w{k}" for k in range(400)] + ["Wörter", "WORD", "the", "the", "the"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    out = [None, "", " \t\n", "one", "One two", "a b c d e", "A b c D e", "a b c d e f", "x " * 3000, "lone " * 120, prose(5000), "日本語 テキスト 空白 なし です", "\x00 nul ​ zero"]
    for _ in range(12):
        base = prose(r.randrange(60, 300)).split()
        out.append(" ".join(base))
        out.append("\n".join(base))
        for _ in range(4):
            near = list(base)
            for _ in range(r.randrange(1, 6)):
                near[r.randrange(len(near))] = "edit" + str(r.randrange(50))
            out.append(" ".join(near))
    passage = prose(70)
    out += [f"{prose(r.randrange(0, 90))} {passage} {prose(r.randrange(0, 90))}" for _ in range(25)]
    out += [passage, passage, f"{passage}.", "lone " * 60, "x " * 200 + passage]
    return out


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(3)
    found = texts()
    rows = [(k * 7 % 1009, t, r.choice([None, "en"]), r.choice(["s1", "s1", "s1", "", None, "ß", "z"]), len(t or ""), 1, *["x"] * 8) for k, t in enumerate(found)]
    rows += [rows[20], rows[20], rows[0]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def collected(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: str(r))


def shingles(text):
    words = (text or "").translate({k: k + 32 for k in range(65, 91)}).encode().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    up = {k: k for k in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    return {k: (len(sets[k]), top(k)) for k in sets}


def test_near_duplicates(table):
    want = brute_components(table.collect())
    got = collected(near_dup.near_duplicates(table))
    assert len(got) == table.count()
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert {r["doc_id"] for r in near_dup.drop_near_duplicates(table).collect()} == {k for k, (_, c) in want.items() if c == k}
    assert near_dup.drop_near_duplicates(table).columns == table.columns


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """With every bucket large, the prefix way finds all links that the stars leave open."""
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", 1)
    r = random.Random(8)
    base = [f"b{k}" for k in range(80)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(r.randrange(0, 4)):
            at = r.randrange(len(words))
            words[at] = f"e{r.randrange(30)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(df.collect())
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df).collect()} == want
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in fingerprints.similar_groups(df).collect()} == want


def test_near_duplicates_without_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (2, "a b c"), (None, None)], "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_dup.near_duplicates(df).collect())
    assert found == [(0, 0, True), (0, 0, True), (1, 1, True), (2, 1, False)]
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df).collect()} == {None: None, 1: 1, 2: 1}
    assert near_dup.near_duplicates(df.where("false")).count() == 0
    assert near_dup.drop_near_duplicates(df).count() == 3


def brute_removed(rows, window=50):
    first = {}
    for r in rows:
        w = (r["text"] or "").encode().split()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
    out = {}
    for r in rows:
        w = (r["text"] or "").encode().split()
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < r["doc_id"]:
                gone[k : k + window] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[r["doc_id"]] = (len(w), int(gone.sum()), kept)
    return out


@pytest.mark.parametrize("shard_words", [60, 3000, 150_000])
def test_substrings(table, monkeypatch, shard_words):
    """At 60 words a shard, names are dealt over several shards by windows and by segments."""
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard_words)
    rows = table.collect()
    want = brute_removed(rows)
    got = substring_dedup.substring_duplicates(table).collect()
    assert len(got) == len(rows)
    for r in got:
        n, gone, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(kept).hexdigest())
    cleaned = substring_dedup.drop_repeated_passages(table)
    assert cleaned.columns == table.columns
    for r in cleaned.collect():
        n, gone, kept = want[r["doc_id"]]
        assert gone == 0 or r["text"].encode() == kept
    assert substring_dedup.substring_duplicates(table.where("false")).count() == 0


def test_fm_index():
    r = random.Random(4)
    for _ in range(40):
        window = r.choice([1, 2, 3, 5, 9])
        found = [[r.choice("abc") for _ in range(r.randrange(1, 30))] for _ in range(r.randrange(1, 8))]
        owners = np.array([r.randrange(20) for _ in found])
        asked = found + [[r.choice("abcx") for _ in range(r.randrange(0, 30))] for _ in range(10)]
        for text, got in zip(asked, substring_dedup.FMIndex(found, owners, window).search(asked), strict=True):
            want = [min((owners[j] for j, u in enumerate(found) for k in range(len(u) - window + 1) if u[k : k + window] == text[i : i + window]), default=None) for i in range(len(text) - window + 1)]
            assert list(got) == want


def test_substrings_under_one_name(spark):
    """Thousands of texts around one passage share names; every text is there twice with other words around it, so that many
    distinct windows of one name repeat."""
    r = random.Random(12)
    passage = [f"p{k}" for k in range(45)]
    rows = []
    for k in range(700):
        inner = [f"a{r.randrange(4000)}" for _ in range(12)] + passage + [f"b{r.randrange(4000)}" for _ in range(12)]
        for j in range(2):
            rows.append((k * 2 + j, " ".join([f"x{r.randrange(9000)}" for _ in range(5)] + inner + [f"y{r.randrange(9000)}" for _ in range(5)])))
    r.shuffle(rows)
    want = brute_removed([{"doc_id": i, "text": t} for i, t in rows])
    got = substring_dedup.substring_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_removed"] for r in got) > 20_000
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (*want[r["doc_id"]][:2], hashlib.sha256(want[r["doc_id"]][2]).hexdigest())


def test_wavelet_ranks():
    symbols = np.random.default_rng(1).integers(0, 37, 500)
    wavelet = substring_dedup.Wavelet(symbols, 37)
    at, s = np.random.default_rng(2).integers(0, 501, 300), np.random.default_rng(3).integers(0, 37, 300)
    assert list(wavelet.rank(s, at)) == [int((symbols[:a] == x).sum()) for a, x in zip(at, s, strict=True)]


def test_packing(table):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = {(r["doc_id"], r["text"]) for r in table.collect()}
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    copies = {}
    for r in table.collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    got = packing.pack_documents(table, with_ids=True).collect()
    sequences = {}
    seen = {i: np.zeros(len(x), int) for i, x in ids.items()}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and zlib.crc32(part.tobytes()) == r["ids_crc32"] and list(part) == r["ids"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]][r["start"] : r["start"] + r["length"]] += 1
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all((seen[i] == copies[i]).all() for i in ids)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= sum(len(ids[i]) * n for i, n in copies.items()) / 2048 * 1.02 + 1
    assert packing.pack_documents(table.where("false")).count() == 0
    again = packing.pack_documents(table, with_ids=True).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_first_fit_decreasing():
    r = random.Random(6)
    for _ in range(30):
        sizes = [r.randrange(1, 101) for _ in range(r.randrange(1, 80))]
        room, want = [], [0] * len(sizes)
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            at = next((b for b, x in enumerate(room) if x >= sizes[k]), len(room))
            room += [100] * (at == len(room))
            room[at] -= sizes[k]
            want[k] = at
        assert packing.first_fit_decreasing(sizes, 100) == want


def test_encoder_equals_tokenizers():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer, encode, r = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.encoder("byte_bpe_50k"), random.Random(1)
    pieces = ["a", "B", " ", "  ", "\n", "é", "ß", "\U0001f600", "　", "9", "12", "!", "<|endoftext|>", "'s", "ñ", "́", "\x00", "‍", "中", "\r", "\t", "٣", "Ⅷ"]
    for _ in range(1500):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(30)))
        assert list(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_fingerprints(table):
    rows = sorted({(r["doc_id"], r["text"] or "") for r in table.collect()}, reverse=True)
    distinct = table.dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(distinct).collect()}
    assert len(got) == len(rows)
    by_text, worst = {}, 0
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(text) // 3
        changed = text[: len(text) - n] + following[:n]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        for other, near in ((changed, r["near_edited"]), (following, r["near_next"])):
            a, b = shingles(text), shingles(other)
            worst = max(worst, abs(near - (len(a & b) / len(a | b) if a | b else 1)))
    assert worst < 0.2
    assert fingerprints.fingerprint_edits(table).count() == table.count()
    assert fingerprints.fingerprint_edits(table.where("false")).count() == 0


def test_fingerprints_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 40)
    df = spark.createDataFrame([(k * 3, f"text number {k} of many") for k in range(60)] + [(None, "no id")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(df).collect()}
    order = [(k * 3, f"text number {k} of many") for k in reversed(range(60))] + [(None, "no id")]
    for k, (i, text) in enumerate(order):
        assert got[i]["edited_sha256"] == hashlib.sha256(fingerprints.edited(text, order[(k + 1) % len(order)][1]).encode()).hexdigest()


def compared(df, sql, name):
    db = duckdb.connect()
    documents = df.toPandas()  # noqa: F841
    db.execute("create view documents as select * from documents")
    return db.sql(sql)


@pytest.mark.parametrize("which", ["mix", "license"])
def test_against_sql(table, which):
    sql = mixing.ORACLE if which == "mix" else license_scan.oracle()
    lines = ["Released under the MIT License.", "x", "licensed under cc by-nc 4.0", "This work is licensed under the GNU General Public License, version 3. Really.", "Released under the MIT License. " * 4]
    df = table.select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, F.concat_ws("\n", "text", F.element_at(F.array(*map(F.lit, lines)), (F.col("doc_id") % len(lines) + 1).cast("int")))).otherwise(F.col("text")).alias("text"), "size")
    got = mixing.mix_sources(df) if which == "mix" else license_scan.scan_licenses(df)
    db = duckdb.connect()
    db.register("documents", df.toPandas().astype({"text": object, "source": object}).where(lambda x: x.notna(), None))
    found = db.sql(sql)
    at = [found.columns.index(c) for c in got.columns]
    fix = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert fix(map(tuple, got.collect())) == fix(tuple(r[k] for k in at) for r in found.fetchall())
    assert (mixing.mix_sources if which == "mix" else license_scan.scan_licenses)(df.where("false")).count() == 0
    if which == "license":
        assert {r["license"] for r in got.collect()} >= {None, "MIT", "CC-BY-NC-4.0", "GPL-3.0"}


def test_mixing(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(k, "w " * r.randrange(1, 30), r.choice("aabcdddddddddd"), "x") for k in range(2000)], "doc_id long, text string, source string, size string")
    got = mixing.mix_sources(df).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.taken - by.target).max() <= 30 and abs(by.target.sum() - 1.5 * got["size"].sum()) < 1
    copies = mixing.take_mix(df).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert ((got.set_index("doc_id").taken / got.set_index("doc_id")["size"]).loc[copies.index] == copies).all() and copies.sum() == (got.taken / got["size"]).sum()
    one = mixing.mix_sources(spark.createDataFrame([(1, None, None), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in one] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("score,label,least", [(toxicity.score_toxicity, "toxic", 0.9), (quality.score_quality, "quality", 0.97)])
def test_classifiers(spark, score, label, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = score(docs.withColumn("score", F.lit("x")).withColumn("_id", F.lit(1)), labels).toPandas().set_index("doc_id")
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]
    assert (got.held_out == held).all() and got.score.between(0, 1).all()
    known = labels.toPandas().set_index("doc_id")[label]
    test = got[got.held_out].join(known, how="inner")
    assert (test.predicted == test[label]).mean() >= least
    # labels of held-out rows change nothing
    flipped = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col(label)).otherwise(F.col(label)))
    assert (score(docs, flipped).toPandas().set_index("doc_id").score.sort_index() == got.score.sort_index()).all()


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_classifiers_edges(spark, table, score):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(300)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = score(table, labels).collect()
    assert len(got) == table.count() and all(0 <= r["score"] <= 1 for r in got)
    assert score(table.where("false"), labels).count() == 0
    assert all(r["score"] == 0.5 for r in score(table, labels.where("false")).collect())


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "mix", "pack"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, spark.createDataFrame(stage(spark, docs, sf).toPandas(), stage(spark, docs, sf).schema)
        if k < 4:
            assert docs.columns == before.columns and {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before.collect()}
    assert corpus_pipeline.run(spark, sf).count() == docs.count() > 0


def test_words_are_cut_as_the_pattern_says():
    import pyarrow as pa

    from quittance.llm import wordhash

    found = [t or "" for t in texts()] + [" nbsp em\x85nel x\x1cy"]
    pattern = re.compile(r"[^\x20\x09-\x0D]+")
    for chunk in wordhash.chunks(pa.array(found), 2000):
        for row in range(chunk.first, chunk.last):
            a, b = chunk.row_word[row - chunk.first : row - chunk.first + 2]
            got = [bytes(chunk.data[x:y]).decode() for x, y in zip(chunk.starts[a:b], chunk.ends[a:b], strict=True)]
            assert got == pattern.findall(found[row])
