"""The pipeline's stages against plain Python, one after another, on a table with every awkward row and clashing column names."""

import random

import duckdb
import pytest
from test_documents import brute_components, brute_removed

import corpus_pipeline
from quittance.llm import common, mixing, toxicity
from quittance.llm.labelled import training_rows
from quittance.llm.quality import score_quality
from quittance.session import shared_folder

NAMES = ["cut", "whole", "edge", "_copies", "_copy", "_plan_source", "_ranges", "_kept", "_kept_id", "_r", "c0", "c1", "node", "h", "size", "tk", "group", "score", "_n"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(21)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = prose(120), prose(60)
    texts = [None, "", " \n", base, base, base.replace(" ", "\n", 3) + " tail", passage, f"{prose(40)} {passage} {prose(30)}", "long " + prose(30_000)]
    texts += [prose(r.randrange(1, 200)) for _ in range(60)] + [prose(20) + " idiot stupid" for _ in range(8)]
    rows = [(k, t, r.choice([None, "en"]), r.choice(["a", "a", "a", "b", None, ""]), r.choice([None, 1]), *[r.choice([None, "x"]) for _ in NAMES]) for k, t in enumerate(texts)]
    rows += [rows[3], rows[10], rows[10], (10, prose(50), None, "b", 2, *["y"] * len(NAMES)), (None, base, None, "a", 3, *["z"] * len(NAMES)), (None, None, None, None, None, *[None] * len(NAMES))]
    folder = str(tmp_path_factory.mktemp("stages"))
    labels = [(k, int("idiot" in (t or ""))) for k, t in enumerate(texts)] + [(None, 1), (3, None)]
    spark.createDataFrame([(i, 0, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder, spark.read.parquet(f"{folder}/documents.parquet")


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_stages(spark, tables):
    folder, docs = tables
    stages = dict(corpus_pipeline.STAGES)
    now = docs.collect()

    model = toxicity.fit(training_rows(docs, spark.read.parquet(f"{folder}/labels.parquet"), "toxic", toxicity.SAMPLE))
    want = [r for r in now if model.score(r["text"])[0] < 0.5]
    assert 0 < len(now) - len(want) <= 8
    docs = corpus(spark, stages["toxicity"](spark, docs, folder), want)

    named = {}
    for r in want:
        if r["doc_id"] is not None:
            named.setdefault(r["doc_id"], []).append(r)
    # rows of one id link what any of them links: here an id's rows are alone in their groups, or equal
    top = brute_components([v[0] for v in named.values()])
    first = lambda rows: min(rows, key=lambda r: [(x is not None, x) for x in (r["text"], *r)])
    want = [first(v) for i, v in named.items() if top[i][1] == i] + [r for r in want if r["doc_id"] is None]
    docs = corpus(spark, stages["near_duplicates"](spark, docs, folder), want)

    kept = brute_removed([r for r in want if r["doc_id"] is not None])
    want = [tuple(kept[r["doc_id"]][2].decode() if k == 1 and r["doc_id"] is not None and kept[r["doc_id"]][1] else x for k, x in enumerate(r)) for r in want]
    docs = corpus(spark, stages["repeated_passages"](spark, docs, folder), want)

    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    db.executemany("insert into documents values (?, ?, ?)", [(r[0], r[1], r[3]) for r in want])
    times = {i: taken // size for i, size, taken in db.sql(f"select doc_id, size, taken from ({mixing.ORACLE})").fetchall() if size}
    got = stages["mix"](spark, docs, folder)
    assert got.columns == docs.columns
    mixed = got.collect()
    for r in want:
        if r[0] is not None and (r[1] or "").split():
            assert sum(tuple(m) == r for m in mixed) == times[r[0]]
    assert {tuple(m) for m in mixed} <= set(want)

    docs = spark.createDataFrame(mixed, docs.schema)
    pieces = stages["pack"](spark, docs, folder).collect()
    tokens = {}
    for p in pieces:
        tokens.setdefault(p["doc_id"], []).append(p)
    for i, found in tokens.items():
        copies = sum(m["doc_id"] == i for m in mixed)
        if i is not None and len({m["text"] for m in mixed if m["doc_id"] == i}) == 1:
            assert sum(p["length"] for p in found) == copies * found[0]["doc_tokens"]
    assert set(tokens) == {m["doc_id"] for m in mixed}
    assert corpus_pipeline.run(spark, folder).count() == len(pieces)


def corpus(spark, got, want):
    assert plain(got.collect()) == plain(want)
    return spark.createDataFrame([tuple(r) for r in want], got.schema)


def test_stages_on_empty_tables(spark, tables):
    folder, docs = tables
    none = docs.where("false")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, none, folder)
        assert got.count() == 0 and (k == 4 or got.columns == none.columns)


def test_quality_of_a_very_long_text(spark, tables):
    folder, _ = tables
    text = "wab " * 2_500_000
    docs = spark.createDataFrame([(1, text), (2, text), (3, "wab")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in score_quality(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert got[1] == got[2] and len(got) == 3


def test_scratch_goes(spark, tables):
    _, docs = tables
    with common.scratch_until_written(spark):
        scratch = common.Scratch(spark)
        scratch.write(spark.range(3), "x")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch.root)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        assert system.exists(path) and scratch.root.startswith(shared_folder(spark))
    assert not system.exists(path)
