"""The life of jobs: claims with leases and fences, backoff, recovery, as a fold over each job's events in order.

The machine is one small function; the batch fold runs it over events that Spark has dealt and sorted by job, holding one
job's state at a time, and streaming/jobs.py runs the same one under event-time timers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = frozenset({"complete", "cancelled", "blocked", "failed"})
LOG = "job long, t long, seq long, kind string, accepted boolean, status string, attempts int, due_ms long, lease_ms long, fence long"


@dataclass(frozen=True)
class Rules:
    most: int = 3
    backoff_ms: tuple[int, ...] = (5_000, 30_000)
    lease_ms: int = 120_000


@dataclass(frozen=True)
class Job:
    status: str = "queued"
    attempts: int = 0
    due: int | None = None
    lease: int | None = None
    fence: int = 0


def wake(job: Job) -> int | None:
    """When the job changes by itself: its lease ends, or its retry falls due."""
    return job.lease if job.status == "running" else job.due if job.status == "retry_wait" else None


def advance(job: Job, now: int, rules: Rules) -> tuple[Job, list[tuple[int, str]]]:
    """The job at `now` if nothing else happens, and (time, kind) of what it did by itself.

    A lease that has ended sends the job back to the queue, or fails it if its attempts are used up. A retry that is due
    has no time to wait for any more.
    """
    at = wake(job)
    if at is None or at > now:
        return job, []
    if job.status == "running":
        return replace(job, status="failed" if job.attempts >= rules.most else "queued", lease=None), [(at, "expire")]
    return replace(job, due=None), [(at, "due")]


def apply(job: Job, t: int, kind: str | None, token: int | None, rules: Rules) -> tuple[Job, bool]:
    """The job after an event, and whether that was accepted; advance() to t comes first.

    A token that isn't null must be the fence of the claim that runs. Claims are accepted from the queue and from retries
    that are due while attempts are left; completion and heartbeats under a live lease only.
    """
    mine = job.status == "running" and token in (None, job.fence)
    if kind == "claim" and job.attempts < rules.most and (job.status == "queued" or (job.status == "retry_wait" and job.due is None)):
        return Job("running", job.attempts + 1, None, t + rules.lease_ms, job.fence + 1), True
    if kind == "heartbeat" and mine:
        return replace(job, lease=t + rules.lease_ms), True
    if kind == "complete" and mine:
        return replace(job, status="complete", lease=None), True
    if kind == "error" and mine:
        return replace(job, status="blocked", lease=None), True
    if kind == "fail" and mine:
        if job.attempts >= rules.most:
            return replace(job, status="failed", lease=None), True
        wait = rules.backoff_ms[min(max(job.attempts, 1), len(rules.backoff_ms)) - 1]
        return replace(job, status="retry_wait", lease=None, due=t + wait), True
    if kind == "cancel" and job.status not in TERMINAL and (mine or job.status != "running"):
        return replace(job, status="cancelled", due=None, lease=None, fence=job.fence + 1), True
    if kind == "retry" and job.status == "failed":
        return replace(job, status="queued", attempts=0), True
    return job, False


def step(job: Job, t: int, seq: int | None, kind: str | None, token: int | None, rules: Rules) -> tuple[Job, list[tuple]]:
    """One event: the rows (t, seq, kind, accepted, status, attempts, due, lease, fence) that it and the time before it give."""
    rows = []
    moved, did = advance(job, t, rules)
    rows += [(at, None, what, True, moved.status, moved.attempts, moved.due, moved.lease, moved.fence) for at, what in did]
    after, ok = apply(moved, t, kind, token, rules)
    return after, [*rows, (t, seq, kind, ok, after.status, after.attempts, after.due, after.lease, after.fence)]


def _fold(rules: Rules, now: int | None):
    names = [*[c.split(" ")[0] for c in LOG.split(", ")], "last"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, held, begun = None, Job(), None, False
        out: list[tuple] = []

        def close() -> None:
            nonlocal held
            if held is None:
                return
            if now is not None:
                moved, did = advance(state, now, rules)
                for at, what in did:
                    out.append((*held, False))
                    held = (key, at, None, what, True, moved.status, moved.attempts, moved.due, moved.lease, moved.fence)
            out.append((*held, True))
            held = None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            out.clear()
            return made

        for b in batches:
            for job, t, seq, kind, token in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if not begun or job != key:
                    close()
                    key, state, begun = job, Job(), True
                state, rows = step(state, t, seq, kind, token, rules)
                for r in rows:
                    if held is not None:
                        out.append((*held, False))
                    held = (key, *r)
            yield batch()
        close()
        yield batch()

    return run


def job_log(events: DataFrame, rules: Rules = Rules(), now: int | None = None) -> DataFrame:
    """Every transition of events(job, t, seq, kind and, if there, token): LOG and last, true for a job's last row.

    Kinds: claim, heartbeat, complete, fail (to be tried again), error (not to be), cancel, retry (by hand, of a failed
    job). What a job does by itself is a row with kind expire or due and no seq, at its own time. Events are taken by
    (t, seq); those without a time are left out; refused and unknown ones change nothing and are rows with accepted false.
    now: also what jobs do by themselves after their last event up to then. A null job is a job.
    """
    token = F.col("token").cast("long") if "token" in events.columns else F.lit(None).cast("long")
    rows = events.where("t IS NOT NULL").select(F.col("job").cast("long"), F.col("t").cast("long"), F.col("seq").cast("long"), "kind", token.alias("token"))
    dealt = rows.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), "job").sortWithinPartitions("job", "t", "seq")
    return dealt.mapInArrow(_fold(rules, now), LOG + ", last boolean")


def fold_jobs(events: DataFrame, most: int = 3, backoff_ms: tuple[int, ...] = (5_000, 30_000), lease_ms: int = 120_000, now: int | None = None) -> DataFrame:
    """(job, status, attempts, due_ms): the state of each job after its last event, or at `now`."""
    last = job_log(events, Rules(most, tuple(backoff_ms), lease_ms), now).where("last")
    return last.select("job", "status", F.col("attempts").cast("long").alias("attempts"), "due_ms")
