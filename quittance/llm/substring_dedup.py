"""Removal of passages that an earlier document holds: windows of 50 words, found by an FM-index per shard.

1. The least hash of the 8-word grams of a window names it: equal windows have equal names, and windows in a row mostly share
   one. A segment is up to 64 windows in a row of one name. Equal segments (by name and a hash of all their words, 128 bits) are
   one class, so copies cost one row: all but the least document lose it.
2. The windows of the distinct segments of a name are counted by their hash. Of windows that several documents hold, the place
   in the least of them goes into an index; a window without a second document needs none.
3. Shards are made of names, by their words; a name of many words is dealt over several shards, its index by window hash, its
   segments at random, so no shard grows with a name. A shard indexes its first places: suffix array, Burrows-Wheeler transform,
   a wavelet matrix of packed bits. All segments of its names are streamed through by backward search, which keeps the suffix
   interval of the last 50 words: the words decide, not their hashes, and the least document of the interval counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, giving_back, unnamed
from .wordhash import BASE, INVERSE, Chunk, chunks, grams, mix, powers

#: Words of a window, of a gram; windows of a segment; words that a shard indexes or streams, about.
WINDOW, GRAM, RUN, SHARD_WORDS = 50, 8, 64, 150_000


def window_names(words: np.ndarray) -> np.ndarray:
    """For each place, the least hash of the 8-word grams of the window that starts there; meaningless past the last one."""
    least = grams(words, GRAM)
    span, want = 1, WINDOW - GRAM + 1
    while span < want:
        step = min(span, want - span)
        least = np.concatenate((np.minimum(least[:-step], least[step:]), least[-step:])) if len(least) > step else least
        span += step
    return least


def range_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, all in one pass."""
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words ^ np.uint64(5)) * powers(BASE, len(words)), out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * powers(INVERSE, len(words))[start] + (end - start).astype(np.uint64))


def segments(chunk: Chunk) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, name, hash) of every segment of a chunk; windows count from 0 in their row."""
    words = chunk.hashes()
    counts = np.maximum(np.diff(chunk.row_word) - WINDOW + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    if not len(rows):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    start = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = start + chunk.row_word[:-1][rows]
    name = window_names(words)[at]
    fresh = np.concatenate(([True], (name[1:] != name[:-1]) | (start[1:] == 0)))
    run = np.flatnonzero(fresh)
    since = np.arange(len(rows)) - run[np.cumsum(fresh) - 1]
    first = np.flatnonzero(since % RUN == 0)
    size = np.diff(np.append(first, len(rows)))
    return rows[first], start[first], size, name[first].view(np.int64), range_hashes(words, at[first], at[first] + size + WINDOW - 1).view(np.int64)


@giving_back
def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column(2)):
            rows, start, size, name, h = segments(chunk)
            at = pa.array(rows + chunk.first)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(name), pa.array(h)], ["doc_id", "tk", "start", "size", "name", "h"])


class Wavelet:
    """Ranks of symbols in a sequence: a wavelet matrix of packed bits with a count every 64."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        now = symbols
        for k in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (now >> k & 1).astype(bool)
            packed = np.packbits(np.concatenate((bit, np.zeros(-len(bit) % 64 + 64, bool))), bitorder="little").view(np.uint64)
            count = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            zeros = int(len(now) - bit.sum())
            self.levels.append((k, packed, count, zeros))
            now = np.concatenate((now[~bit], now[bit]))
        self.first = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, packed, count, zeros in self.levels:
            word = at >> 6
            ones = count[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> k & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbol, at) - self.first[symbol]


class FMIndex:
    """Of texts as lists of words: suffix array (kept only as the interval of each window), BWT in a wavelet matrix."""

    def __init__(self, texts: list[list], owners: np.ndarray, window: int = WINDOW):
        ends = len(texts)
        self.codes: dict = {}
        coded = [np.array([self.codes.setdefault(w, ends + len(self.codes)) for w in t], np.int64) for t in texts]
        text = np.concatenate([x for k, t in enumerate(coded) for x in (t, np.array([k]))])
        owner = np.repeat(owners, [len(t) + 1 for t in texts])
        self.sigma, self.window, n = ends + len(self.codes), window, len(text)
        # prefix doubling; ranks by the first 2**k words are kept as long as the window needs them
        rank, span, kept = text, 1, None
        while True:
            key = rank * (n + self.sigma + 1) + np.concatenate((rank[span:] + 1, np.zeros(min(span, n), np.int64)))[:n]
            suffix = np.argsort(key, kind="stable")
            if 2 * span > window and kept is None:
                kept = (rank, span)
            inside = key[suffix]
            fresh = np.concatenate(([True], inside[1:] != inside[:-1]))
            rank = np.empty(n, np.int64)
            rank[suffix] = np.cumsum(fresh) - 1
            span *= 2
            if fresh.all() and kept is not None:
                break
        short, span = kept
        tail = np.minimum(suffix + window - span, n - 1)
        same = (short[suffix][1:] == short[suffix][:-1]) & (short[tail][1:] == short[tail][:-1])
        group = np.concatenate(([True], ~same))
        self.low = np.flatnonzero(group)
        self.group = np.cumsum(group) - 1
        self.high = np.append(self.low[1:], n)
        self.least_owner = np.minimum.reduceat(owner[suffix], self.low)
        self.wavelet = Wavelet(text[suffix - 1], self.sigma)
        self.before = np.searchsorted(np.sort(text), np.arange(self.sigma))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of a symbol and what stood there."""
        both = self.wavelet.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high))) + np.tile(self.before[symbol], 2)
        return both[: len(symbol)], both[len(symbol) :]

    def search(self, texts: list[list]) -> list[list]:
        """For each text, the least owner of each of its windows, None for a window that isn't there. All texts advance together,
        from their ends; where one meets words that don't stand so in a row, it starts again with the next window."""
        window = self.window
        coded = [np.array([self.codes.get(w, -1) for w in t], np.int64) for t in texts]
        out = [[None] * max(0, len(t) - window + 1) for t in coded]
        now = [(k, len(t)) for k, t in enumerate(coded) if len(t) >= window]
        while now:
            sizes = np.array([n for _, n in now], np.int64)
            padded = np.full((len(now), sizes.max()), -1, np.int64)
            for row, (k, n) in enumerate(now):
                padded[row, :n] = coded[k][:n][::-1]
            low, high = np.zeros(len(now), np.int64), np.full(len(now), len(self.group))
            owners, done = np.zeros(padded.shape, np.int64), np.zeros(len(now), np.int64)
            live = np.arange(len(now))
            for step in range(padded.shape[1]):
                live = live[(sizes[live] > step) & (padded[live, step] >= 0)]
                if not len(live):
                    break
                a, b = self.extend(padded[live, step], low[live], high[live])
                live, a, b = live[a < b], a[a < b], b[a < b]
                if step + 1 >= window:
                    # the first 50 of the words matched so far: all suffixes that begin with them
                    at = self.group[a]
                    a, b = self.low[at], self.high[at]
                    owners[live, step] = self.least_owner[at]
                low[live], high[live], done[live] = a, b, step + 1
            after = []
            for row, ((k, n), matched) in enumerate(zip(now, done.tolist(), strict=True)):
                if matched >= window:
                    out[k][n - matched : n - window + 1] = owners[row, window - 1 : matched][::-1].tolist()
                rest = n - matched + window - 1 if matched >= window else n - 1
                if matched < n and rest >= window:
                    after.append((k, rest))
            now = after
        return out


def spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges that a row of window hits covers."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [(int(a), int(b) + WINDOW - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


_RANGES = pa.schema([("name", pa.int64()), ("h", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _shard(key, table):
    """Rows with places are of the index: windows of a segment, by their number in it. The others are segments to stream; their
    windows that the index can hold, by hash, are searched for."""
    table = table.sort_by([("doc_id", "ascending"), ("name", "ascending"), ("h", "ascending")])
    docs, names, hs, words, places = (table[c].to_pylist() for c in ("doc_id", "name", "h", "words", "places"))
    hashes = table["hashes"].combine_chunks()
    at, hashes = hashes.offsets.to_numpy(), hashes.values.to_numpy()
    texts, owners, held = [], [], []
    for row, found in enumerate(places):
        if found is not None:
            mark = np.zeros(at[row + 1] - at[row], bool)
            mark[found] = True
            held.append(hashes[at[row] : at[row + 1]][mark])
            split = words[row].split()
            for a, b in spans(mark):
                texts.append(split[a:b])
                owners.append(docs[row])
    rows: list = []
    if texts:
        known = np.unique(np.concatenate(held))
        some = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
        until = np.concatenate(([0], np.cumsum(some)))[at]
        asked: dict = {}
        wanted = []
        for row in np.flatnonzero(until[1:] > until[:-1]).tolist():
            if places[row] is None:
                split = words[row].split()
                wanted += [(row, a, asked.setdefault(b" ".join(split[a:b]), len(asked))) for a, b in spans(some[at[row] : at[row + 1]])]
        found = FMIndex(texts, np.array(owners)).search([t.split(b" ") for t in asked])
        for row, a, k in wanted:
            hit = np.array([x is not None and x < docs[row] for x in found[k]])
            if hit.any():
                rows += [(names[row], hs[row], a + x, a + y) for x, y in spans(hit)]
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, _RANGES, strict=True)], schema=_RANGES)


@giving_back
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tk, text, wanted) to the words of each wanted segment, as they stand in the text, and the hashes of its windows.
    Rows of equal id and text come one after another; one of them is cut."""
    last = None
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            raw, words = chunk.data.tobytes(), chunk.hashes()
            docs, found, first = [], [], []
            for row in range(chunk.first, chunk.last):
                last, before = (batch.column("doc_id")[row].as_py(), batch.column("tk")[row].as_py()), last
                for x in batch.column("wanted")[row].as_py() if last != before else ():
                    docs.append(last[0])
                    found.append(x)
                    first.append(chunk.row_word[row - chunk.first] + x["start"])
            first, size = np.array(first, np.int64), np.array([x["size"] for x in found], np.int64)
            end = first + size + WINDOW - 1
            at = np.cumsum(np.append(0, size))
            place = np.arange(at[-1]) + np.repeat(first - at[:-1], size)
            hashes = range_hashes(words, place, place + WINDOW).view(np.int64) if len(place) else np.zeros(0, np.int64)
            cut = [raw[chunk.starts[a] : chunk.ends[b - 1]] for a, b in zip(first.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(docs, pa.int64()), pa.array([x["name"] for x in found], pa.int64()), pa.array([x["h"] for x in found], pa.int64()),
                pa.array((end - first).astype(np.int32)), pa.array(cut, pa.binary()), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes)),
            ], ["doc_id", "name", "h", "n", "words", "hashes"])


def _found_by_index(cut: DataFrame, scratch: Scratch) -> DataFrame:
    """cut: distinct segments (doc_id, name, h, n, words, hashes). Returns (name, h, a, b): the words a to b of a segment that
    windows cover which another segment of a smaller doc_id holds."""
    windows = cut.select("name", "h", "doc_id", F.posexplode("hashes").alias("k", "w"))
    place = [F.min_by(c, "doc_id").alias(c) for c in ("h", "k")]
    first = windows.groupBy("name", "w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), *place)
    first = scratch.write(first.where("first < last").select("name", "w", "h", "k"), "first")
    # a name's index and segments are dealt over so many shards; names that need one only share shards
    sizes = cut.groupBy("name").agg(F.sum(F.col("n").cast("long")).alias("words")).join(first.groupBy("name").agg(F.count("*").alias("held")), "name")
    sizes = sizes.withColumn("parts", F.ceil(F.col("held") * WINDOW / SHARD_WORDS))
    sizes = scratch.write(sizes.withColumn("salts", F.ceil(F.col("words") * F.least("parts", F.lit(RUN)) / F.col("parts") / SHARD_WORDS)), "sizes")
    one = "parts = 1 and salts = 1"
    total = sizes.where(one).agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    shard = F.when(F.expr(one), F.pmod(F.xxhash64("name"), F.lit(max(1, -(-int(total) // SHARD_WORDS))))).otherwise(F.xxhash64("name", "part", "salt")).alias("shard")
    plan = sizes.select("name", "parts", "salts").hint("merge")
    part = lambda w: F.pmod(w, F.col("parts"))
    indexed = first.join(plan, "name").groupBy("name", "h", part(F.col("w")).alias("part"), "parts", "salts").agg(F.collect_list("k").alias("places"))
    indexed = indexed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).join(cut.hint("merge"), ["name", "h"])
    streamed = cut.join(plan, "name").withColumn("part", F.explode(F.array_distinct(F.transform("hashes", part)))).withColumn("salt", F.pmod(F.xxhash64("h"), F.col("salts")))
    columns = [shard, "doc_id", "name", "h", "words", "hashes"]
    every = indexed.select(*columns, "places").union(streamed.select(*columns, F.lit(None).cast("array<int>").alias("places")))
    return every.groupBy("shard").applyInArrow(_shard, "name long, h long, a int, b int")


def repeated_ranges(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs: (doc_id, tk, text), tk a hash of the text. Returns (doc_id, tk, ranges array<struct<a,b>>): the word ranges of
    each document that windows cover which start in a document with a smaller doc_id."""
    anchors = scratch.write(docs.where("doc_id is not null").mapInArrow(_anchors, "doc_id long, tk long, start int, size int, name long, h long"), "anchors")
    held = scratch.write(anchors.groupBy("name", "h").agg(F.min(F.struct("doc_id", "tk", "start", "size")).alias("at"), F.max("doc_id").alias("last")), "held")
    names = held.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    wanted = held.join(names.hint("merge"), "name").select("at.doc_id", "at.tk", F.struct("name", "h", "at.start", "at.size").alias("w"))
    wanted = wanted.groupBy("doc_id", "tk").agg(F.collect_list("w").alias("wanted"))
    cut = docs.join(wanted.hint("merge"), ["doc_id", "tk"]).select("doc_id", "tk", "text", "wanted").mapInArrow(_cut, "doc_id long, name long, h long, n int, words binary, hashes array<long>")
    cut = scratch.write(cut, "cut")
    parts = _found_by_index(cut, scratch).groupBy("name", "h").agg(F.collect_set(F.struct("a", "b")).alias("parts"))
    # the first document of a segment loses the parts that an earlier one holds, wherever it has the segment; later ones lose it
    lost = held.join(parts, ["name", "h"], "left").where("at.doc_id < last or parts is not null").select("name", "h", F.col("at.doc_id").alias("first"), "parts")
    start, whole = F.col("start"), F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("size") + WINDOW - 1).alias("b")))
    some = F.transform("parts", lambda x: F.struct((start + x["a"]).alias("a"), (start + x["b"]).alias("b")))
    out = anchors.join(lost.hint("merge"), ["name", "h"]).select("doc_id", "tk", F.when(F.col("doc_id") > F.col("first"), whole).otherwise(some).alias("r")).where("r is not null")
    out = out.groupBy("doc_id", "tk").agg(F.flatten(F.collect_list("r")).alias("ranges"))
    out = scratch.write(out, "ranges")
    scratch.drop("anchors", "held", "cut", "first", "sizes")
    return out


def _kept_words(text: str | None, ranges: list | None) -> tuple[list[bytes], int]:
    """(words that stay, words removed)."""
    words = (text or "").encode().split()
    if not ranges:
        return words, 0
    keep = np.ones(len(words), bool)
    for r in ranges:
        keep[r["a"] : r["b"]] = False
    return [w for w, k in zip(words, keep, strict=True) if k], int(len(words) - keep.sum())


@giving_back
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list = [[], [], []]
        for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
            words, gone = _kept_words(text.as_py(), ranges.as_py())
            for o, v in zip(out, (len(words) + gone, gone, hashlib.sha256(b" ".join(words)).hexdigest()), strict=True):
                o.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tk"), F.col(text_col).alias("text"))


def substring_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    A null or blank text has no words; texts under 50 words lose nothing. Rows that share a doc_id don't take words from each
    other, rows without doc_id take and lose nothing. Very long texts are read whole. Repeated rows give repeated results, no
    rows none; other columns are ignored, whatever their names.
    """
    keyed = _keyed(docs, id_col, text_col)
    ranges = repeated_ranges(keyed, Scratch(docs.sparkSession))
    return keyed.join(ranges.hint("merge"), ["doc_id", "tk"], "left").select("doc_id", "text", "ranges").mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def drop_repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the kept words, joined by one space, as the text of documents that lose words; all else stays as it was, whatever
    the names of other columns.

    A document that loses all its words keeps an empty text. Null texts stay null; texts under 50 words, rows without doc_id and
    blank texts lose nothing; rows that share a doc_id take no words from each other, and equal ones lose the same. Very long
    texts are read whole. No rows give no rows.
    """
    rows, (i, text) = unnamed(docs, id_col, text_col)
    ranges = repeated_ranges(_keyed(rows, i, text), Scratch(docs.sparkSession)).select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), F.col("ranges").alias("_ranges"))
    width, k = len(rows.columns), rows.columns.index(text)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [t.as_py() if not r.is_valid else b" ".join(_kept_words(t.as_py(), r.as_py())[0]).decode() for t, r in zip(batch.column(k), batch.column(width), strict=True)]
            columns = [pa.array(kept, batch.schema.field(k).type) if j == k else batch.column(j) for j in range(width)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:width])

    met = rows.join(ranges.hint("merge"), (F.col(i).cast("long") == F.col("_id")) & (F.xxhash64(text) == F.col("_tk")), "left")
    return met.select(*rows.columns, "_ranges").mapInArrow(run, rows.schema).toDF(*docs.columns)
