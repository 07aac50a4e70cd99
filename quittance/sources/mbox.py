"""A data source for mailboxes: spark.read.format("mbox").option("least", 8192).load(path).

One row per message, numbered from 0 in the file's order; one partition per file. A message that can't be read gives a row that
says so. Files are opened where the reader runs, so a folder that all executors share is needed.
"""

from __future__ import annotations

import codecs
import contextlib
import glob
import mailbox
import os
import re
from collections.abc import Iterator
from email import policy
from email.parser import BytesParser
from pathlib import PurePosixPath

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.fixed import MIN_ATTACHMENT_BYTES
from .html import html_to_text

SCHEMA = (
    "index int, mbox_path string, subject string, sender_name string, sender_email string, message_id string, date string, entry_date string, "
    "body_text string, body_html string, images array<struct<name:string,bytes:binary>>"
)


def _squeezed(value) -> str:
    return " ".join(str(value or "").split())


def _written(part) -> str:
    """The text of a leaf; unknown character sets are read as UTF-8, bytes that don't fit are replaced."""
    data = part.get_payload(decode=True) or b""
    charset = part.get_content_charset("utf-8")
    try:
        codecs.lookup(charset)
    except LookupError:
        charset = "utf-8"
    return data.decode(charset, "replace")


def _picture_name(part, index: int, number: int) -> str:
    """msg, the message's number, the picture's number, a safe form of its file name, the suffix in lower case."""
    given = PurePosixPath(part.get_filename() or f"image{number}")
    suffix = given.suffix or "." + (part.get_content_subtype().partition("+")[0] or "jpg")
    safe = re.sub("[^A-Za-z0-9._-]+", "_", given.stem).strip("._")
    return f"msg{index:04d}_{number:02d}_{safe[:60] or 'attachment'}{suffix.lower()}"


def _contents(message, index: int, least: int) -> dict:
    """body_text, body_html and images of a message; leaves of other kinds don't count."""
    leaves = [p for p in message.walk() if not p.is_multipart()]
    said = {kind: "\n".join(t for p in leaves if p.get_content_type() == kind and (t := _written(p)).strip()).strip() for kind in ("text/plain", "text/html")}
    pictures = [(p, d) for p in leaves if p.get_content_maintype() == "image" and (d := p.get_payload(decode=True)) and len(d) >= least]
    return {
        "body_text": said["text/plain"] or html_to_text(said["text/html"]), "body_html": said["text/html"],
        "images": [(_picture_name(p, index, k), d) for k, (p, d) in enumerate(pictures, 1)],
    }


def _sender(message) -> tuple[str, str]:
    """Name and address of the first sender; a bare address is also the name."""
    known = message["From"]
    first = next(iter(known.addresses), None) if known is not None and hasattr(known, "addresses") else None
    if first is None:
        return _squeezed(known), ""
    return _squeezed(first.display_name) or first.addr_spec, first.addr_spec


def _when(message) -> tuple[str | None, str]:
    """ISO with the header's own offset, and the calendar day there."""
    try:
        at = message["Date"].datetime
    except (AttributeError, TypeError, ValueError, IndexError):
        return None, ""
    return (at.isoformat(), at.date().isoformat()) if at else (None, "")


def _tried(read, fallback):
    """What a header says, or the fallback if the library can't make sense of it."""
    try:
        return read()
    except Exception:  # a broken header must not end the scan
        return fallback


def read_mbox(path: str, least: int = MIN_ATTACHMENT_BYTES) -> Iterator[tuple]:
    """Rows of SCHEMA. Addresses are split before their words are decoded, so an encoded comma doesn't cut a name."""
    parser = BytesParser(policy=policy.default)
    with contextlib.closing(mailbox.mbox(path, factory=parser.parse, create=False)) as box:
        for index, message in enumerate(box):
            try:
                found = _contents(message, index, least)
            except Exception as e:  # a broken message must not end the scan
                found = {"body_text": f"[could not read message: {e}]", "body_html": "", "images": []}
            subject, ident = (_tried(lambda h=h: _squeezed(message[h]), "") for h in ("Subject", "Message-ID"))
            yield index, path, subject, *_tried(lambda: _sender(message), ("", "")), ident, *_tried(lambda: _when(message), (None, "")), *found.values()


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        path = options["path"].removeprefix("file://")
        self.paths = sorted(p for p in glob.glob(os.path.join(path, "*.mbox") if os.path.isdir(path) else path))
        self.least = int(options.get("least", MIN_ATTACHMENT_BYTES))
        if not self.paths:
            raise FileNotFoundError(f"no mailbox at {path}")

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        yield from read_mbox(partition.value, self.least)


class MboxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MboxSource)
