"""Work items and their states, from an event log in batch or as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a work item; the events that lead to them.
QUEUED, PROCESSING, REVIEW, SAVED, FAILED = "Queued", "Processing", "Needs review", "Saved", "Failed"
STATE_AFTER = {"queued": QUEUED, "begin": PROCESSING, "stage": PROCESSING, "done": REVIEW, "saved": SAVED, "failed": FAILED, "cancelled": QUEUED}


def state_after(event: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STATE_AFTER.items() for x in kv]), event)


def queue_state(events: DataFrame) -> DataFrame:
    """events: item, seq, event. The state after each item's last known event, and how many it had."""
    known = events.withColumn("state", state_after(F.col("event"))).where("state is not null")
    return known.groupBy("item").agg(F.max_by("state", "seq").alias("state"), F.count("*").alias("events"))


def queue_counts(states: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("state") == s)
    return states.agg(F.count("*").alias("total"), of(SAVED).alias("saved"), of(REVIEW).alias("to_review"), of(FAILED).alias("failed"))


def startable(states: DataFrame) -> DataFrame:
    """Items that a start picks up: queued ones, and failed ones again."""
    return states.where(F.col("state").isin(QUEUED, FAILED))


def next_review(states: DataFrame, after: int) -> DataFrame:
    """The next item in circular order behind ``after`` that needs review; states: item (0 to n-1), state. Null without any."""
    n = states.agg(F.count("*").alias("n"))
    ahead = states.crossJoin(F.broadcast(n)).withColumn("d", F.pmod(F.col("item") - after - 1, F.col("n")))
    return ahead.agg(F.min_by("item", F.when(F.col("state") == REVIEW, F.col("d"))).alias("item"))


def stream_queue_state(events: DataFrame) -> DataFrame:
    """queue_state of a stream: an update per item and batch. State is the last sequence number, its state and the count."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, name, n = state.get if state.exists else (-1, None, 0)
        for batch in batches:
            for s, e in zip(batch["seq"], batch["event"], strict=True):
                if e in STATE_AFTER:
                    n += 1
                    if s >= seq:
                        seq, name = int(s), STATE_AFTER[e]
        state.update((seq, name, n))
        if name is not None:
            yield pd.DataFrame({"item": [key[0]], "state": [name], "events": [n]})

    return events.groupBy("item").applyInPandasWithState(step, "item long, state string, events long", "seq long, state string, n long", "update", GroupStateTimeout.NoTimeout)


def latest(updates: DataFrame) -> DataFrame:
    """The last update of each item of a log of updates."""
    w = Window.partitionBy("item").orderBy(F.desc("events"))
    return updates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
