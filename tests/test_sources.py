"""Mailboxes, markup and image files."""

import mailbox
import struct
import zlib
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from quittance.sources import images, mbox
from quittance.sources.html import html_rows, html_to_text, rows_to_text, structured_rows
from quittance.sources.settings import ConfigError, load_settings


def message(subject, sender, plain=None, html=None, pictures=(), date="Tue, 14 Jul 2026 23:30:00 +0700", mid="<1@x>"):
    m = EmailMessage()
    m["Subject"], m["From"], m["Message-ID"] = subject, sender, mid
    if date:
        m["Date"] = date
    m.set_content(plain or "")
    if html:
        m.add_alternative(html, subtype="html")
    for name, data in pictures:
        m.add_attachment(data, maintype="image", subtype="png", filename=name)
    return m


def test_mbox(spark, tmp_path):
    box = mailbox.mbox(str(tmp_path / "a.mbox"))
    box.add(message("Pesanan  é", '"Toko A" <a@b.id>', "Total 5.000\n", pictures=[("my pic?.png", b"x" * 8192), ("logo.png", b"x" * 8191)]))
    box.add(message("", "c@d.id", None, "<table><tr><td>A</td><td>1</td></tr><tr><td>B</td><td>2</td></tr><tr><td>C</td><td>3</td></tr></table>", date="nonsense", mid=""))
    box.close()
    mbox.register(spark)
    rows = spark.read.format("mbox").load(str(tmp_path)).orderBy("index").collect()
    assert [r["index"] for r in rows] == [0, 1]
    first, second = rows
    assert (first["subject"], first["sender_name"], first["sender_email"], first["message_id"], first["entry_date"]) == ("Pesanan é", "Toko A", "a@b.id", "<1@x>", "2026-07-14")
    assert first["body_text"] == "Total 5.000" and [i["name"] for i in first["images"]] == ["msg0000_01_my_pic.png"]
    assert second["date"] is None and second["body_text"] == "A   1\nB   2\nC   3" and second["images"] == []
    assert spark.read.format("mbox").option("least", 1).load(str(tmp_path / "a.mbox")).where("index = 0").select(F.size("images")).first()[0] == 2
    with pytest.raises(Exception, match="no mailbox"):
        spark.read.format("mbox").load(str(tmp_path / "none.mbox")).count()


def test_senders(tmp_path):
    raw = ["From: =?utf-8?q?Toko=2C_Jaya?= <a@b.id>", "From: c@d.id", "From: ", "From: A <x@y>, B <z@y>", "Subject: =?nope?q?x?="]
    with open(tmp_path / "s.mbox", "w") as f:
        for k, line in enumerate(raw):
            f.write(f"From x Thu Jan  1 00:00:00 2026\n{line}\nMessage-ID: <{k}@x>\nContent-Type: text/plain; charset=nope\n\nhi\n\n")
    rows = list(mbox.read_mbox(str(tmp_path / "s.mbox")))
    assert [r[3:5] for r in rows] == [("Toko, Jaya", "a@b.id"), ("c@d.id", "c@d.id"), ("", ""), ("A", "x@y"), ("", "")]
    assert [r[5] for r in rows] == [f"<{k}@x>" for k in range(5)] and all(r[8] == "hi" for r in rows)


@pytest.mark.parametrize("html,want", [
    ("<table><tr><td>Fare</td><td>44.000</td></tr><tr><td>Fee&nbsp;</td><td> 1 </td></tr><tr><th>Total</th><td>45.000</td></tr></table>", [["Fare", "44.000"], ["Fee", "1"], ["Total", "45.000"]]),
    ("<table><tr><td><table><tr><td>a</td></tr><tr><td>b</td><td></td></tr><tr><td>c</td></tr></table></td></tr></table>", [["a"], ["b"], ["c"]]),
    ("<head><title>t</title></head><style>p{}</style><script>x</script><p>one<br>two</p><div>three</div>", [["one"], ["two"], ["three"]]),
    ("<table><tr><td>a</td></tr><tr><td>b</td></tr></table>", [["a"], ["b"]]), ("", []), (None, []), ("<p> </p>", []),
])
def test_structured_rows(html, want):
    assert structured_rows(html) == want


def test_html_in_spark(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("html", html_rows("html").alias("rows"))
    assert all(r["text"] == html_to_text(r["html"]) for r in pages.select("html", rows_to_text(F.col("rows")).alias("text")).collect())


def test_images(spark, tmp_path):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    (tmp_path / "a.PNG").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 5, 8, 0, 0, 0, 0)))
    (tmp_path / "b.jpg").write_bytes(b"not an image")
    (tmp_path / "c.txt").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: (r["width"], r["height"], r["bytes"]) for r in images.load_images(spark, str(tmp_path)).collect()}
    assert got == {"a.PNG": (3, 5, 33), "b.jpg": (None, None, 12)}


def test_settings(tmp_path):
    (tmp_path / "u.json").write_text('{"currency": "sgd", "output": {"archive": false}}')
    got = load_settings(user=tmp_path / "u.json")
    assert got["currency"] == "SGD" and got["currencies"] == ["SGD", "IDR", "USD"] and got["output"] == {"template": "{stem}_{hash8}", "archive": False}
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ConfigError):
        load_settings(user=tmp_path / "bad.json")
