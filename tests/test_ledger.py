"""Ledger, report, words, mail and queue operators on small tables."""

import random

from pyspark.sql import functions as F

from quittance.operators import ledger, mail, report, words
from quittance.sources.settings import deep_merge
from quittance.streaming import queue

COLUMNS = "id long, name string, amount double, entry_date string, currency string, notes string"


def rows(spark, data):
    return spark.createDataFrame(data, COLUMNS)


def test_keys(spark):
    df = rows(spark, [(1, " Grab  Ride", 44000.0, "2026-07-14", "idr", None), (2, "", 1.0, "2026-07-14", "", None), (3, "x", None, "2026-07-14", "", None), (4, "x", 1.0, "", "", None), (5, 'q"\\', 0.1 + 0.2, "2026-01-01", None, None)])
    got = {r["id"]: r["k"] for r in df.select("id", ledger.key_text(ledger.key_parts()).alias("k")).collect()}
    assert got == {1: '["grab ride",4400000,"IDR","2026-07-14"]', 2: None, 3: None, 4: None, 5: '["q\\"\\\\",30,"","2026-01-01"]'}
    wide = rows(spark, [(1, "Ｇｒａｂ", 1.0, "d", "", None), (2, "grab", 1.0, "d", "", None)])
    assert wide.select(ledger.key_parts().alias("k")).distinct().count() == 1


def test_ranges_and_lookups(spark):
    df = rows(spark, [(k, "n", float(k), d, "IDR", None) for k, d in enumerate(["2026-06-30", "2026-07-01", "2026-07-15", "2026-07-31", "2026-08-01", "", None])])
    assert [r["id"] for r in ledger.entries_between(df, "2026-07-31", "2026-07-01").collect()] == [1, 2, 3]
    assert tuple(ledger.date_bounds(df).first()) == ("2026-06-30", "2026-08-01")
    assert tuple(ledger.date_bounds(df.where("false")).first()) == (None, None)
    assert [r["id"] for r in ledger.recent(df, 2).collect()] == [6, 5]
    assert ledger.latest_by(df, "entry_date", spark.createDataFrame([("2026-07-01",), ("",), ("x",)], "entry_date string")).where("id is not null").count() == 1


def test_collapse(spark):
    df = rows(spark, [(1, "a", 1.0, "2026-01-01", "", " "), (2, "A ", 1.0, "2026-01-01", "", "second"), (3, "a", 1.0, "2026-01-01", "", "third"), (4, "a", 2.0, "2026-01-01", "", None), (5, None, 1.0, "2026-01-01", "", None), (6, None, 1.0, "2026-01-01", "", None)])
    got = {r["id"]: r["notes"] for r in ledger.collapse_duplicates(df).collect()}
    assert got == {1: "second", 4: None, 5: None, 6: None}
    assert ledger.unique_violations(df).count() == 1
    assert ledger.unique_violations(ledger.collapse_duplicates(df)).count() == 0
    assert ledger.collapse_duplicates(df.where("false")).count() == 0


def brute_upsert(old, events):
    out, top = [dict(r) for r in old], max([r["id"] for r in old], default=0)
    key = lambda r: (r["name"].lower().strip(), r["amount"], r["entry_date"]) if r["name"] and r["entry_date"] else None
    for e in sorted(events, key=lambda e: e["seq"]):
        match = next((r for r in out if key(r) is not None and key(r) == key(e)), None)
        if match:
            notes = e["notes"] if (e["notes"] or "").strip() else match["notes"]
            match.update({k: e[k] for k in ("name", "amount", "entry_date")}, notes=notes, updated_at=e["at"])
        else:
            top += 1
            out.append({k: e[k] for k in ("name", "amount", "entry_date", "notes")} | {"id": top, "created_at": e["at"], "updated_at": e["at"]})
    return out


def test_upsert(spark):
    r = random.Random(5)
    old = [{"id": 7, "name": "a", "amount": 1.0, "entry_date": "d1", "notes": "kept", "created_at": "t", "updated_at": "t"}, {"id": 9, "name": "", "amount": 1.0, "entry_date": "d1", "notes": None, "created_at": "t", "updated_at": "t"}]
    events = [{"seq": k * 40000, "at": f"e{k}", "name": r.choice(["a", "A", "b", ""]), "amount": float(r.randrange(2)), "entry_date": r.choice(["d1", "d2"]), "notes": r.choice([None, " ", f"n{k}"])} for k in range(40)]
    ledger_df = spark.createDataFrame([tuple(x.values()) for x in old], "id long, name string, amount double, entry_date string, notes string, created_at string, updated_at string").withColumn("currency", F.lit("IDR"))
    events_df = spark.createDataFrame([tuple(x.values()) for x in events], "seq long, at string, name string, amount double, entry_date string, notes string").withColumn("currency", F.lit("IDR"))
    fields = ["id", "name", "amount", "entry_date", "notes", "created_at", "updated_at"]
    got = sorted(tuple(x[c] for c in fields) for x in ledger.upsert(ledger_df, events_df).collect())
    assert got == sorted(tuple(x[c] for c in fields) for x in brute_upsert(old, events))


def test_upgrade(spark):
    old = spark.createDataFrame([(1, "a", 1.0, "2026-01-01"), (2, "a", 1.0, "2026-01-01")], "id long, name string, amount double, entry_date string")
    got = ledger.upgrade(old).collect()
    assert len(got) == 1 and got[0]["source_kind"] == "image" and got[0]["ocr_text"] is None and got[0]["dedupe_key"] == '["a",100,"","2026-01-01"]'


def report_rows(spark, amounts):
    return spark.createDataFrame([(k, "2026-07-01", "c", 'x, "y"\nz' if k == 0 else None, a, [None, "USD", ""][k % 3]) for k, a in enumerate(amounts)], "id int, entry_date string, category string, name string, amount string, currency string")


def test_report(spark, tmp_path):
    df = report_rows(spark, [None, "", "abc", "1500", "1234567.891", "n/a"])
    got = {r["currency"]: (r["entries"], r["total"], r["all_entries"]) for r in report.summarize(df, "IDR").collect()}
    assert got == {"IDR": (2, 1500.0, 6), "USD": (2, 1234567.89, 6)}
    assert report.format_totals(report.summarize(df, "IDR")).first()[0] == "IDR 1,500 · USD 1,234,567.89"
    assert report.write_csv(df.orderBy("id"), str(tmp_path / "r.csv"), "IDR") == 6
    raw = (tmp_path / "r.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfDate,Category,Expense Detail,Amount,Currency\r\n") and b'"x, ""y""\nz",0.00,IDR\r\n' in raw and b",1234567.89,USD\r\n" in raw
    assert report.write_csv(df.where("false"), str(tmp_path / "e.csv")) == 0 and (tmp_path / "e.csv").read_bytes().count(b"\r\n") == 1
    assert {r["id"]: r["amount"] for r in report.index_entries(df, "IDR").collect()} == {0: "", 1: "", 2: "", 3: "IDR 1,500", 4: "USD 1,234,567.89", 5: ""}


def brute_pages(w, h):
    ws, fs = min(1, 1494 / w), min(1, 1989 / h)
    if fs >= 0.6 * ws:
        return 1
    tall = h if ws == 1 else max(1, round(h * ws))
    pages, at, limit = 1, min(tall, 1989), 1989
    at = 1989 - 40
    if tall <= 1989:
        return 1
    while True:
        pages += 1
        if tall - at <= 2089:
            return pages
        at += 2089 - 40


def test_pages(spark):
    r = random.Random(2)
    sizes = [(r.randrange(50, 3000), r.randrange(50, 40000)) for _ in range(400)]
    df = spark.createDataFrame([(1, k, w, h) for k, (w, h) in enumerate(sizes)], "report int, k int, width long, height long")
    got = report.page_numbers(df, ["report"], ["k"]).orderBy("k").collect()
    assert [x["pages"] for x in got] == [brute_pages(*s) for s in sizes]
    page = 1 + -(-400 // 38)
    for x in got:
        assert (x["number"], x["page"], x["index_page"]) == (x["k"] + 1, page, x["k"] // 38 + 1)
        page += x["pages"]


def test_repeats_origin_lookup(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a"), (1, 5, None), (1, 6, None)], "g int, k int, v string")
    assert [r["k"] for r in report.drop_repeats(df, ["g"], ["k"], "v").orderBy("k").collect()] == [1, 3, 4, 5]
    entries = spark.createDataFrame([(1, "s1", "p1", None), (2, "gone", "b.mbox", "<m>"), (3, None, "b.mbox", ""), (4, None, "p1", None), (5, None, "gone", None)], "id int, scanned_path string, source_path string, email_message_id string")
    files = spark.createDataFrame([("s1",), ("p1",), ("b.mbox",)], "path string")
    assert {r["id"]: r["origin"] for r in report.expected_origin(entries, files).collect()} == {1: "scan", 2: "redrawn", 3: "none", 4: "original", 5: "none"}
    box = spark.createDataFrame([("b.mbox", " <m> ", 4), ("b.mbox", "<m>", 2)], "mbox_path string, message_id string, index int")
    assert {r["id"]: r["message_index"] for r in report.message_lookup(entries, box).collect()}[2] == 2


def test_words(spark):
    boxes = [("d", t, c, 1, b, 1, line, w) for b, line, w, t, c in [(1, 2, 1, "world", "90"), (1, 1, 2, "there", "70.5"), (1, 1, 1, "hello", "0"), (0, 9, 1, "top", "-1"), (1, 3, 1, " ", "-1"), (1, 3, 2, "", "95")]]
    df = spark.createDataFrame([*boxes, ("e", "", "-1", 1, 1, 1, 1, 1)], "doc string, text string, conf string, page_num int, block_num int, par_num int, line_num int, word_num int")
    got = {r["doc"]: tuple(r)[1:] for r in words.rebuild_text(df).collect()}
    assert got == {"d": ("top\nhello there\nworld", 53.5, 4), "e": ("", 0.0, 0)}


def test_mail(spark):
    df = spark.createDataFrame([(0, ["a", "b"], "", "x"), (1, [], "<p>", ""), (2, [], " ", "\n"), (3, None, "", "t")], "index int, images array<string>, body_html string, body_text string")
    got = sorted((r["index"], r["route"], r["image"]) for r in mail.work_items(df).collect())
    assert [g[:2] for g in got] == [(0, "images"), (0, "images"), (1, "message"), (3, "message")]
    forms = spark.createDataFrame([(1, "14/07/2026", "44.000", " n ", "", " usd ", " "), (2, "", "1", "", "", "", ""), (3, "x", "1", "", "", "", ""), (4, "2026-01-01", "", "", "", "", ""), (5, "2026-01-01", "free", "", "", None, None)], "id int, raw_date string, raw_amount string, name string, category string, currency string, notes string")
    out = {r["id"]: r for r in mail.validated(forms).collect()}
    assert out[1]["error"] is None and out[1]["amount"] == 44000.0 and out[1]["currency"] == "USD" and out[1]["notes"] is None and out[1]["category"] == "Lainnya"
    assert [out[k]["error"] for k in (2, 3, 4, 5)] == ["date required", "invalid date", "amount required", "invalid amount"]


def test_queue(spark, tmp_path):
    data = [(1, 1, "queued"), (1, 2, "begin"), (1, 3, "done"), (2, 1, "queued"), (2, 4, "failed"), (3, 1, "queued"), (0, 1, "begin"), (0, 2, "done"), (0, 9, "saved"), (0, 10, "other")]
    df = spark.createDataFrame(data, "item long, seq long, event string")
    states = queue.queue_state(df)
    assert {r["item"]: r["state"] for r in states.collect()} == {0: "Saved", 1: "Needs review", 2: "Failed", 3: "Queued"}
    assert tuple(queue.queue_counts(states).first()) == (4, 1, 1, 1)
    assert {r["item"] for r in queue.startable(states).collect()} == {2, 3}
    assert queue.next_review(states, 1).first()[0] == 1 and queue.next_review(states, 0).first()[0] == 1
    df.repartition(2).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = queue.stream_queue_state(stream).writeStream.outputMode("update").foreachBatch(lambda b, k: b.write.parquet(str(tmp_path / f"out/{k}"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = queue.latest(spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")))
    assert sorted(map(tuple, got.select("item", "state").collect())) == sorted(map(tuple, states.select("item", "state").collect()))


def test_settings():
    assert deep_merge({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "b": {"z": 1}}) == {"a": {"x": 1, "y": 3}, "b": {"z": 1}}
