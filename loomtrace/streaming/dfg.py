"""Directly-follows pairs of a stream of events, per case, in event-time order.

A case's events wait until the watermark has passed them, so late events within the delay still
fall into place; the last released activity is the state. A case that has been idle for long enough
leaves its state by a timer in event time, so that state does not grow with the cases ever seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "case_id string, source string, target string, ts timestamp"
STATE = "last string, seen long, waiting array<struct<us:long,pos:long,activity:string>>"


def _advance(idle_us: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen, waiting = state.get if state.exists else (None, None, [])
        rows = [tuple(w) for w in waiting]
        if not state.hasTimedOut:
            for pdf in batches:
                rows += list(zip(pdf["us"].tolist(), pdf["pos"].tolist(), pdf["activity"], strict=True))
        mark = state.getCurrentWatermarkMs() * 1000
        rows.sort(key=lambda r: r[:2])
        ready = [r for r in rows if r[0] <= mark]
        rest = rows[len(ready):]
        out = []
        for us, _, activity in ready:
            if last is not None and us - seen <= idle_us:
                out.append((key[0], last, activity, pd.Timestamp(us, unit="us", tz="UTC")))
            last, seen = activity, us
        if rest or mark < seen + idle_us:
            state.update((last, seen, rest))
            state.setTimeoutTimestamp((rest[0][0] if rest else seen + idle_us) // 1000 + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["case_id", "source", "target", "ts"])

    return run


def follow(events: DataFrame, delay: str = "10 minutes", idle: str = "30 days") -> DataFrame:
    """Pairs (case_id, source, target, ts) of a streaming case log, in append mode.

    delay: how late events may be. idle: a case without an event for longer has ended, and leaves the state when the
    watermark has passed that; what comes for it later begins a case of its own, however events fall into batches."""
    marked = events.select("case_id", "activity", "ts", "pos", F.unix_micros("ts").alias("us")).withWatermark("ts", delay)
    wait = int(pd.Timedelta(idle).total_seconds() * 1_000_000)
    return marked.groupBy("case_id").applyInPandasWithState(_advance(wait), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
