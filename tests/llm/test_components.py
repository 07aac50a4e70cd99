"""Connected components against plain Python, and the rounds they take."""

import random
import re
from pathlib import Path

import pytest

from quittance.llm.common import Scratch
from quittance.llm.components import connected_components
from quittance.session import give_back


class Recorded(Scratch):
    def __init__(self, spark):
        super().__init__(spark)
        self.names = []

    def write(self, df, name):
        self.names.append(name)
        return super().write(df, name)


def plain(edges):
    least = {}
    for x in {x for e in edges if e[0] != e[1] for x in e}:
        least[x] = x
    while True:
        before = dict(least)
        for u, v in edges:
            if u != v:
                least[u] = least[v] = min(least[u], least[v])
        if least == before:
            return least


def taken(spark, edges):
    scratch = Recorded(spark)
    found = connected_components(spark.createDataFrame(edges, "u long, v long"), scratch, "c").collect()
    assert len(found) == len({r["node"] for r in found})
    return {r["node"]: r["component"] for r in found}, scratch.names


def test_components_match_plain_python(spark):
    r = random.Random(4)
    path = [(k, k + 1) for k in range(0, 40)]
    r.shuffle(path)
    some = [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(45)]
    edges = path + some + [(7, 7), (500, 500), (3, 2), (3, 2), (-5, 900), (901, -5)]
    assert taken(spark, edges)[0] == plain(edges)


@pytest.mark.parametrize("edges", [[], [(9, 9)], [(2, 1), (1, 3), (1, 4), (8, 7), (2, 1)]])
def test_stars_take_no_round(spark, edges):
    found, names = taken(spark, edges)
    assert found == plain(edges) and names == ["c-0"]


def test_two_centres_take_rounds(spark):
    edges = [(5, 1), (5, 2), (6, 2)]
    found, names = taken(spark, edges)
    assert found == plain(edges) == {1: 1, 2: 1, 5: 1, 6: 1} and len(names) > 1


def test_freed_memory_goes_back(spark):
    """After much compiling the driver's JVM holds less once it has given back; what it holds stays usable."""
    pid = spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: int(re.search(r"Rss:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1])
    spark.range(9).selectExpr(*[f"id % {k + 2} as c{k}" for k in range(150)]).distinct().collect()
    before = held()
    assert give_back(spark) and held() < before + 8_000
    assert spark.range(9).count() == 9


def test_scratch_tables_have_no_marker(spark):
    scratch = Scratch(spark)
    assert scratch.write(spark.range(5), "five").count() == 5
    found = [p.name for p in Path(scratch.root.removeprefix("file://"), "five").iterdir()]
    assert found and not [n for n in found if "_SUCCESS" in n]
