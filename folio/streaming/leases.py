"""Lease states of work units as a stateful stream: claims, heartbeats, completions and failures with quarantine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What an event does to its unit.
ACTIONS = {"signup": "claim", "view": "heartbeat", "click": "heartbeat", "purchase": "finish", "error": "fail"}
QUARANTINE = 3
OUTPUT = "unit long, state string, failures int, updated double, wait double"
STATE = "failures int, updated double, event long"


def _advance(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Apply a batch of events in time order; events not after the last one applied are late and ignored."""
    failures, updated, last = state.get if state.exists else (0, float("-inf"), -1)
    name = None
    events = pd.concat(list(frames)).sort_values(["at", "event_id"])
    for at, event, action in zip(events["at"], events["event_id"], events["action"], strict=True):
        if (at, event) <= (updated, last):
            continue
        updated, last = float(at), int(event)
        if action == "fail":
            failures += 1
        elif action == "finish":
            failures = 0
        name = "complete" if action == "finish" else "quarantined" if failures >= QUARANTINE else "retryable" if action == "fail" else "claimed"
    state.update((int(failures), updated, last))
    if name is not None:
        wait = float(min(300, 2 ** min(failures, 8))) if name == "retryable" else 0.0
        yield pd.DataFrame({"unit": [key[0]], "state": [name], "failures": [int(failures)], "updated": [updated], "wait": [wait]})


def lease_updates(events: DataFrame) -> DataFrame:
    """(unit, state, failures, updated, wait) whenever a unit's state moves on; one small state a unit."""
    action = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[F.col("event_type")]
    rows = events.select(F.col("user_id").alias("unit"), (F.unix_micros("ts") / 1e6).alias("at"), "event_id", action.alias("action")).where("action is not null")
    return rows.groupBy("unit").applyInPandasWithState(_advance, OUTPUT, STATE, "update", "NoTimeout")


def current(updates: DataFrame) -> DataFrame:
    """The last update of each unit."""
    return updates.groupBy("unit").agg(F.max_by(F.struct("state", "failures", "wait"), "updated").alias("s")).select("unit", "s.*")
