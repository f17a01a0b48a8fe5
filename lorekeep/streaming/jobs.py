"""Job states as a stream: events wait until the watermark has passed them, then move the job in order; leases that end
and retries that fall due are event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from lorekeep.operators.jobs import LOG, Job, Rules, advance, step, wake

STATE = "status string, attempts int, due long, lease long, fence long"
NAMES = [c.split(" ")[0] for c in LOG.split(", ")]


class _Jobs(StatefulProcessor):
    def __init__(self, rules: Rules) -> None:
        self.rules = rules

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)
        self.waiting = handle.getListState("waiting", "t long, seq long, kind string, token long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        for frame in rows:
            part = [tuple(None if pd.isna(x) else x for x in r) for r in frame[["t", "seq", "kind", "token"]].astype(object).itertuples(index=False)]
            part = [(int(t), None if s is None else int(s), k, None if f is None else int(f)) for t, s, k, f in part]
            self.waiting.appendList(part)
            for t in {r[0] for r in part}:
                self.handle.registerTimer(t)
        yield pd.DataFrame(columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = timerValues.getCurrentWatermarkInMs()
        job = Job(*self.job.get()) if self.job.exists() else Job()
        all_ = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((tuple(r) for r in all_ if r[0] <= now), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        out = []
        for t, seq, kind, token in due:
            job, rows = step(job, t, seq, kind, token, self.rules)
            out += rows
        moved, did = advance(job, now, self.rules)
        out += [(at, None, what, True, moved.status, moved.attempts, moved.due, moved.lease, moved.fence) for at, what in did]
        if due:
            later = [tuple(r) for r in all_ if r[0] > now]
            self.waiting.put(later) if later else self.waiting.clear()
        if out:
            self.job.update((moved.status, moved.attempts, moved.due, moved.lease, moved.fence))
            if (at := wake(moved)) is not None:
                self.handle.registerTimer(at)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=NAMES)

    def close(self) -> None:
        pass


def job_transitions(events: DataFrame, rules: Rules = Rules(), late: str = "1 hour") -> DataFrame:
    """job_log's rows (without `last`) of a stream events(job, ts, t, seq, kind, token), each once the watermark has passed it.

    t is ts in milliseconds. Events may come in any order within `late`; later ones are dropped. State is one row a job,
    and the events that still wait. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    return events.withWatermark("ts", late).groupBy("job").transformWithStateInPandas(_Jobs(rules), LOG, "Update", "EventTime")
