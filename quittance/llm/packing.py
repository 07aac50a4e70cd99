"""Packing documents into sequences: first-fit decreasing over a tournament tree of bin capacities, in random groups.

Documents go to groups at random; the number of groups follows the bytes of all texts, so that a group is a few
megabytes at any size of the corpus. A group is tokenised and packed in one task: its ids never leave it. A document longer
than a sequence is cut into full sequences and a rest; rests are packed by first-fit decreasing. Gaps that are left are then
filled from the least full sequences, whose pieces are cut for it.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import memory_back, text_bytes

#: Tokens of a sequence, the id that ends a document, text bytes of a group, least tokens worth a cut.
LENGTH, END, GROUP_BYTES, LEAST_CUT = 2048, 1, 4 << 20, 32
VOCABULARY = "byte_bpe_50k"
#: Groups of a task; tasks, beyond which each gets more groups.
GROUPS_A_TASK, MOST_TASKS = 16, 50_000


@functools.lru_cache(2)
def encoder(name: str):
    """text -> ids, as tokenizers' encode(text, add_special_tokens=False) gives them.

    The ranks file holds the same vocabulary and is read several times faster; a text with the name of a special token, which
    becomes one id there, goes to tokenizers itself.
    """
    import base64
    import json

    import public_tokenizers as known
    import tiktoken

    with open(known.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(known.path(f"{name}.json"), encoding="utf-8") as f:
        special = [x["content"] for x in json.load(f)["added_tokens"]]
    fast = tiktoken.Encoding(name, pat_str=known.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def ids(text: str) -> np.ndarray:
        if any(x in text for x in special):
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(known.path(f"{name}.json")))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return ids


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, by falling size (earlier first on ties), each in the first bin with room. The tree's inner nodes
    hold the most room below them, so the first fitting bin is found on one way down."""
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    out = [0] * len(sizes)
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size, at = sizes[item], 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        out[item] = at - leaves
        room[at] -= size
        while at > 1:
            at //= 2
            best = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == best:
                break
            room[at] = best
    return out


def pack_lengths(lengths: list[int], capacity: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; sequences count from 0 and have no gaps inside."""
    bins: list[list[tuple[int, int, int]]] = []
    rests = []
    for k, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            bins.append([(k, start, capacity)])
        if n % capacity:
            rests.append((k, n - n % capacity, n % capacity))
    full = len(bins)
    for piece, at in zip(rests, first_fit_decreasing([x[2] for x in rests], capacity), strict=True):
        while len(bins) <= full + at:
            bins.append([])
        bins[full + at].append(piece)
    order = sorted(range(full, len(bins)), key=lambda b: (-sum(x[2] for x in bins[b]), b))
    left, right = 0, len(order) - 1
    while left < right:
        gap = capacity - sum(x[2] for x in bins[order[left]])
        if gap < LEAST_CUT:
            left += 1
            continue
        donor = bins[order[right]]
        if not donor:
            right -= 1
            continue
        k, start, n = donor.pop()
        take = min(n, gap)
        bins[order[left]].append((k, start, take))
        if n > take:
            donor.append((k, start + take, n - take))
    out = []
    for sequence, pieces in enumerate(b for b in bins if b):
        offset = 0
        for k, start, n in pieces:
            out.append((k, start, n, sequence, offset))
            offset += n
    return out


def _pack(name: str, length: int, with_ids: bool):
    def packed(key, table):
        encode = encoder(name)
        order = sorted(range(table.num_rows), key=lambda k: ((i := table["doc_id"][k].as_py()) is None, i or 0, table["text"][k].as_py() or ""))
        table = table.take(pa.array(order, pa.int64()))
        ids = [np.append(encode(t.as_py() or ""), np.uint32(END)).astype("<u4") for t in table["text"]]
        pieces = pack_lengths([len(x) for x in ids], length)
        doc, start, size, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        columns = {
            "doc_id": table["doc_id"].combine_chunks().take(pa.array(doc)), "start": pa.array(start), "length": pa.array(size),
            "ids_crc32": pa.array([zlib.crc32(ids[k][a : a + n].tobytes()) for k, a, n in zip(doc, start, size, strict=True)], pa.int64()),
            "doc_tokens": pa.array([len(ids[k]) for k in doc], pa.int64()), "sequence_id": pa.array((key[0].as_py() << 32) + sequence), "offset": pa.array(offset),
        }
        if with_ids:
            columns["ids"] = pa.array([ids[k][a : a + n].astype(np.int32) for k, a, n in zip(doc, start, size, strict=True)], pa.list_(pa.int32()))
        return pa.table(columns)

    def run(key, table):
        found = packed(key, table)
        memory_back()
        return found

    return run


def pack_documents(docs: DataFrame, *, length: int = LENGTH, vocabulary: str = VOCABULARY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds ids array<int>.

    A null or empty text is one id, the document's end; very long texts are cut into as many sequences as they need. Repeated rows
    and rows without doc_id are packed each; rows of a group that tie are ordered by doc_id and text. No rows give no rows; other
    columns are ignored, whatever their names. Rows go to groups at random, so that no key of many rows makes a large group; the
    seed is fixed, so a rerun over the same files gives the same pieces and sequences.
    """
    groups = max(1, -(-text_bytes(docs, text_col) // GROUP_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("group", F.floor(F.rand(17) * groups))
    spread = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-groups // GROUPS_A_TASK), MOST_TASKS))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return rows.select("group", "doc_id", "text").repartition(spread, "group").groupBy("group").applyInArrow(_pack(vocabulary, length, with_ids), schema)
