"""Messages of whole conversations, against plain Python."""

import re

import duckdb

from quittance import queries
from quittance.functions import fixed
from quittance.plans import bridge


def guess(body, sender):
    for line in body.splitlines():
        for start in fixed.MERCHANT_STARTS:
            if line.lower().strip().startswith(start):
                value = " ".join((line.split(":", 1)[-1] if ":" in line else line[len(start) :]).split()).strip(" -–—:")
                found = re.search(fixed.ADDRESS, value)
                value = " ".join((value[: found.start()] if found else value).split(",")[0].split()).strip(" -–—,:")[:70]
                if len(value) >= 3:
                    return value
    return sender


def test_merchants_of_whole_turns(spark, tmp_path):
    rows = [(5, 0, "user", "hi"), (5, 1, "assistant", "word " * 14 + "end of it\nToko: next"), (6, 0, "assistant", "a\n" + "Toko Sinar " * 9), (7, 0, "assistant", "Rumah Makan Padang Sederhana Bintaro Sektor Sembilan dekat Stasiun Jl. Mangga")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["id"]: r["merchant"] for r in queries.merchant_guess(spark, str(tmp_path)).collect()}
    assert got == {5: ("word " * 14)[:70], 6: ("Sinar " + "Toko Sinar " * 9)[:70].strip(), 7: "Rumah Makan Padang Sederhana Bintaro Sektor Sembilan dekat Stasiun"}


def test_whole_turns_by_brute_force(spark, sf):
    found = duckdb.sql(f"select conv_id, turn, role, text from '{sf}/conversations.parquet'").fetchall()
    bodies = {}
    for conv, _, role, text in sorted(found):
        bodies.setdefault(conv, []).append("Toko: " + text if role == "assistant" else text)
    bodies = {k: "\n".join(v) for k, v in bodies.items()}
    assert {r["id"]: r["body"] for r in bridge.mails(spark, sf).collect()} == bodies
    assert {r["id"]: r["merchant"] for r in queries.merchant_guess(spark, sf).collect()} == {k: guess(v, f"Sender {k % 9}") for k, v in bodies.items()}
