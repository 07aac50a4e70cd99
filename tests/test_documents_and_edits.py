"""File names, fallbacks, layout, recognition, edits and snapshots."""

import random

import pytest
from pyspark.sql import functions as F

from quittance.operators import documents as d
from quittance.operators.edits import Snapshots, apply_events


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_names(spark):
    files = spark.createDataFrame([("in/a b.jpg", "0123456789"), ("in2/a b.jpg", "0123456789"), ("in/..", "ff")], "source_path string, sha256 string")
    got = [r["filename"] for r in d.output_names(files, F.lit("2026-07-14 10:11:12").cast("timestamp"), "{stem}_{hash8}_{date}").orderBy("source_path").collect()]
    assert got == ["receipt_ff_2026-07-14.png", "a_b_01234567_2026-07-14.png", "a_b_01234567_2026-07-14-1.png"]
    assert one(spark, d.archive_name(F.lit("x/Pic One.JPG"), F.lit("abcdefghij"))) == "Pic_One_abcdefgh.jpg"
    assert one(spark, d.report_name(F.lit("a"), F.lit("b"))) == "receipts_a_to_b.csv" and one(spark, d.report_name(F.lit("a"), F.lit("b"), True)) == "receipts_a_to_b_attachments.pdf"


def test_fallbacks(spark):
    assert one(spark, d.fallback_date(F.lit("2026-01-02 03:04:05"), F.lit("2026-02-02"))) == "2026-01-02"
    assert one(spark, d.fallback_date(F.lit(None).cast("string"), F.lit("2026-02-02"))) == "2026-02-02"
    assert one(spark, d.fallback_date(F.lit(""), F.lit(""))) == ""
    assert [one(spark, d.merchant(F.lit(a), F.lit(b), F.lit(r))) for a, b, r in [("p", "m", False), ("p", "m", True), ("", "m", False), ("p", "", True)]] == ["p", "m", "m", "p"]


def test_layout(spark):
    assert one(spark, d.header_lines(F.lit("Hi  \U0001f600"), F.lit(""), F.lit("2026-07-14 10:11:00").cast("timestamp"))) == ["Hi", "Date: 14/07/2026 10:11"]
    text = "aa bbb c dddddddddd ee f"
    assert one(spark, d.wrap(F.lit(text), 6)) == ["aa bbb", "c", "dddddddddd", "ee f"]
    assert one(spark, d.fit(F.lit("abcdef"), 4)) == "abc…" and one(spark, d.fit(F.lit("abcd"), 4)) == "abcd"
    assert len(one(spark, d.placeholder(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda x: x.cast("string"))))) == 41


def test_images(spark):
    rows = spark.createDataFrame([(1, b"s", None, b"o"), (2, None, b"r", None), (3, None, None, None)], "id long, scan binary, redrawn binary, original binary")
    assert [(r["origin"], r["image"]) for r in d.resolve_image(rows).orderBy("id").collect()] == [("scan", b"s"), ("redrawn", b"r"), ("none", None)]

    def engine():
        def read(content):
            if content == b"bad":
                raise ValueError("no picture")
            return content.decode(), [90, -1, 60.5]

        return read

    pictures = spark.createDataFrame([(1, b"text"), (2, b"bad")], "id long, content binary")
    assert [tuple(r) for r in d.recognise(pictures, engine).orderBy("id").collect()] == [(1, "text", 75.25, 3, None), (2, "", 0.0, 0, "no picture")]


def test_compare(spark):
    a = spark.createDataFrame([("x", "1", None), ("y", "2", "b")], "k string, p string, q string")
    b = spark.createDataFrame([("x", "1", "c"), ("z", "3", "d")], "k string, p string, q string")
    assert sorted(map(tuple, d.compare_fields(a, b, "k", ["p", "q"]).collect()), key=str) == sorted([("x", "q", None, "c"), ("y", "p", "2", None), ("y", "q", "b", None), ("z", "p", None, "3"), ("z", "q", None, "d")], key=str)


def brute(old, events):
    entries, top = [dict(r) for r in old], max((r["id"] for r in old), default=0)
    key = lambda r: (r["name"].lower(), r["amount"], r["entry_date"]) if r["name"] else None
    fields = ("name", "amount", "entry_date", "currency", "notes")
    for e in sorted(events, key=lambda e: e["seq"]):
        values = {c: e[c] for c in fields}
        match = next((r for r in entries if key(r) is not None and key(r) == key(e)), None)
        target = next((r for r in entries if r["id"] == e["record_id"] and e["record_id"] is not None), None)
        if match is not None and match is not target:
            if target is not None:
                entries.remove(target)
            target = match
            if not (values["notes"] or "").strip():
                values["notes"] = match["notes"]
        if target is not None:
            target.update(values, updated_at=e["at"])
        else:
            top += 1
            entries.append(values | {"id": top, "created_at": e["at"], "updated_at": e["at"]})
    return entries


@pytest.mark.parametrize("seed", [1, 2])
def test_edits(spark, seed):
    r = random.Random(seed)
    old = [{"id": k + 1, "created_at": "t", "updated_at": "t", "name": n, "amount": 1.0, "entry_date": "d", "currency": "IDR", "notes": f"old{k}"} for k, n in enumerate(["a", "b", "c", "", "e"])]
    events = [{"seq": k, "record_id": r.choice([None, None, 1, 2, 3, 4, 5, 99]), "at": f"e{k}", "name": r.choice("aAbcdef") if r.random() < 0.9 else "", "amount": 1.0, "entry_date": "d", "currency": "IDR", "notes": r.choice([None, " ", f"n{k}"])} for k in range(12)]
    schema = "name string, amount double, entry_date string, currency string, notes string"
    got = apply_events(spark.createDataFrame([tuple(x.values()) for x in old], "id long, created_at string, updated_at string, " + schema), spark.createDataFrame([tuple(x.values()) for x in events], "seq long, record_id long, at string, " + schema))
    fields = ["id", "name", "amount", "entry_date", "currency", "notes", "created_at", "updated_at"]
    assert sorted([tuple(x[c] for c in fields) for x in got.collect()], key=str) == sorted([tuple(x[c] for c in fields) for x in brute(old, events)], key=str)
    assert len({x["id"] for x in got.collect()}) == got.count()


def test_snapshots(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    assert store.read() is None
    assert store.write(spark.range(3)) == 1 and store.write(store.read().where("id > 0")) == 2
    assert store.read().count() == 2 and spark.read.parquet(str(tmp_path / "s/v1")).count() == 3
    with pytest.raises(Exception):
        store.write(spark.range(3).select(F.raise_error(F.lit("x"))))
    assert store.read().count() == 2 and store.versions() == [1, 2]
