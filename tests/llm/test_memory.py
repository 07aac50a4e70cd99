"""What Python workers hold once a task is over."""

import ctypes
import re
import weakref
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from quittance.llm import common, near_dup, packing, substring_dedup, toxicity


def held():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="not on glibc")
def test_freed_memory_goes_back():
    before = held()
    blocks = [np.ones(60_000, np.uint8) for _ in range(3_000)]
    last = blocks[-1]  # the allocator gives back only what lies behind it
    del blocks
    assert held() - before > 100
    common.memory_back()
    assert held() - before < 60 and last.sum() == 60_000


def test_tasks_give_back_at_their_end(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "memory_back", lambda: calls.append(1))
    for each in (toxicity, packing):
        monkeypatch.setattr(each, "memory_back", lambda: calls.append(1))
    text = " ".join(f"w{k}" for k in range(90))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "tk": [5, 6], "text": [text, None]})
    two = batch.select(["doc_id", "text"])
    assert sum(b.num_rows for b in substring_dedup._anchors(iter([batch, batch]))) > 0 and len(calls) == 1
    assert [b["n_shingles"].to_pylist() for b in near_dup._signatures(5, near_dup.band_keys)(iter([two]))] == [[86, 0]] and len(calls) == 2
    assert [len(x) for b in near_dup._sets(5)(iter([two])) for x in b["shingles"]] == [86, 0] and len(calls) == 3
    toxicity._forget()
    assert len(calls) == 4
    found = packing._pack(packing.VOCABULARY, 16, False)((pa.scalar(0),), pa.Table.from_batches([two]))
    assert sum(x.as_py() for x in found["length"]) == len(packing.encoder(packing.VOCABULARY)(text)) + 2 and len(calls) == 5


def test_nothing_of_a_task_is_held_when_it_gives_back(monkeypatch):
    class Block:
        pass

    gone = []
    monkeypatch.setattr(common, "memory_back", lambda: gone.append(seen() is None))

    @common.giving_back
    def run(batches):
        nonlocal seen
        for x in batches:
            block = Block()
            seen = weakref.ref(block)
            yield x + 1

    seen = None
    assert list(run(iter([1, 2]))) == [2, 3] and gone == [True]
