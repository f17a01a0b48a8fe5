"""Revision history, row sequences, sampling, identity components, jobs and ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.graph import connected_components as components  # noqa: F401
from lorekeep.operators.jobs import fold_jobs  # noqa: F401


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by order (which ends in a unique column); an aggregate, so copies of a key meet early."""
    rest = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*key).agg(best.alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def chain_faults(rows: DataFrame, key: Sequence[str], number: str) -> DataFrame:
    """Rows whose number isn't one more than the one before (or 1 for the first)."""
    w = Window.partitionBy(*key).orderBy(number)
    before = F.coalesce(F.lag(number).over(w), F.lit(0))
    return rows.withColumn("expected", (before + 1).cast("long")).where(F.col(number) != F.col("expected"))


def top_per_group(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def transitions(rows: DataFrame, by: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Rows whose label differs from the one before, with that label."""
    before = F.lag(label).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("previous", before).where(F.col("previous") != F.col(label))


def run_lengths(rows: DataFrame, by: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """(by, run, label, n): maximal runs of equal labels."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = (~F.lag(label).over(w).eqNullSafe(F.col(label))).cast("int")
    runs = rows.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(new))
    runs = runs.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "run", label).agg(F.count("*").alias("n"))


def even_spread(rows: DataFrame, by: Sequence[str], order: Sequence[str], count: int) -> DataFrame:
    """count rows of each group at positions (2i + 1) n div 2 count; all rows of a group that has no more."""
    w = Window.partitionBy(*by)
    pos = F.row_number().over(w.orderBy(*order)) - 1
    placed = rows.withColumn("pos", pos.cast("long")).withColumn("n", F.count("*").over(w))
    chosen = (F.col("n") <= count) | F.expr(f"exists(sequence(0, {count - 1}), i -> (2 * i + 1) * n div {2 * count} = pos)")
    return placed.where(chosen).drop("n")


def quotas(groups: DataFrame, key: str, total: int) -> DataFrame:
    """total split evenly over the sorted groups; the first total % n get one more."""
    rows = groups.select(key).distinct().withColumn("i", F.row_number().over(Window.orderBy(key)) - 1)
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("n", n).select(key, (F.floor(F.lit(total) / F.col("n")) + (F.col("i") < F.lit(total) % F.col("n")).cast("long")).cast("long").alias("quota"))


def page_of(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn("page", F.floor(at / size).cast("long"))


def running_exposure(rows: DataFrame, by: Sequence[str], order: Sequence[str], amount: Column, cap: int) -> DataFrame:
    """rows with the running exposure and whether it is within the cap."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("exposure", F.sum(amount).over(w))
    return rows.withColumn("within", F.col("exposure") <= cap)


def eligible(status: str = "status", attempts: str = "attempts", due: str = "due_ms", lease: str = "lease_ms", now: int = 0, most: int = 3) -> Column:
    """Whether a job may be claimed now: attempts left, and queued, or a retry that is due or has no time, or a lease that
    ends now or has ended (a running job without a lease is never free)."""
    retry = (F.col(status) == "retry_wait") & (F.col(due).isNull() | (F.col(due) <= now))
    expired = (F.col(status) == "running") & F.coalesce(F.col(lease) <= now, F.lit(False))
    return (F.col(attempts) < most) & ((F.col(status) == "queued") | retry | expired)


def contradictions(components_: DataFrame, different: DataFrame) -> DataFrame:
    """Edges of `different` whose ends are in one component."""
    l, r = (components_.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}")) for k in ("a", "b"))
    return different.join(l, "a").join(r, "b").where("c_a = c_b").select("a", "b", F.col("c_a").alias("component"))


def insert_identical(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): a known key with the same content is left out, with another content a conflict.

    Within new, rows that are equal are one; a key with several contents is a conflict with each of them, and none of
    them is appended. Null keys are keys.
    """
    rest = [c for c in new.columns if c not in key]
    mark = F.sha2(F.to_json(F.struct(*[F.col(c) for c in rest]), {"ignoreNullFields": "false"}), 256)
    old = existing.select(*[F.col(c).alias(f"_old_{c}") for c in key], mark.alias("_old"))
    once = new.withColumn("_new", mark).dropDuplicates([*key, "_new"])
    once = once.withColumn("_several", F.count("*").over(Window.partitionBy(*key)) > 1)
    same = [F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in key]
    joined = once.join(old, same, "left")
    differs = (F.col("_old").isNotNull() & (F.col("_old") != F.col("_new"))) | (F.col("_old").isNull() & F.col("_several"))
    return joined.where("_old IS NULL AND NOT _several").select(new.columns), joined.where(differs).select(new.columns)


def undo_decisions(decisions: DataFrame, undone: DataFrame) -> DataFrame:
    """decisions(decision_id, a, b, decision, state, revision) with those of undone(decision_id, expected) superseded, a
    revision on. A decision that is missing, not active or of another revision raises."""
    rows = undone.join(decisions.select("decision_id", "state", "revision"), "decision_id", "left")
    fits = F.coalesce((F.col("state") == "active") & (F.col("revision") == F.col("expected")), F.lit(False))
    marks = rows.select(F.when(fits, F.col("decision_id")).otherwise(F.raise_error(F.concat(F.lit("decision is missing or stale: "), F.col("decision_id").cast("string")))).alias("decision_id"), F.lit(True).alias("_undone"))
    gone = F.coalesce("_undone", F.lit(False))
    joined = decisions.join(marks, "decision_id", "left")
    joined = joined.withColumn("state", F.when(gone, "superseded").otherwise(F.col("state"))).withColumn("revision", F.col("revision") + gone.cast("int"))
    return joined.select(decisions.columns)


def split_members(decisions: DataFrame, separate: DataFrame) -> DataFrame:
    """decisions with every active same_person link between separate(node) and the rest superseded, a revision on."""
    ends = separate.select(F.col("node")).distinct()
    inside = lambda d, c: d.join(ends.select(F.col("node").alias(c), F.lit(True).alias(f"_{c}")), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", F.lit(False)))
    rows = inside(inside(decisions, "a"), "b")
    crossing = (F.col("decision") == "same_person") & (F.col("state") == "active") & (F.col("_a") != F.col("_b"))
    rows = rows.withColumn("_cross", F.coalesce(crossing, F.lit(False)))
    return rows.withColumn("revision", F.col("revision") + F.col("_cross").cast("int")).withColumn("state", F.when(F.col("_cross"), "superseded").otherwise(F.col("state"))).select(decisions.columns)


def memberships(decisions: DataFrame) -> DataFrame:
    """(node, component) of the active same_person decisions."""
    return components(decisions.where("decision = 'same_person' AND state = 'active'").select("a", "b"))


def mapping_states(rows: DataFrame, key: Sequence[str], artifact: str, order: Sequence[str]) -> DataFrame:
    """rows with mapping_state: current for those of the artifact that was registered last for the key, others stale."""
    last = rows.groupBy(*key).agg(F.max_by(artifact, F.struct(*order)).alias("_last"))
    return rows.join(last, list(key)).withColumn("mapping_state", F.when(F.col(artifact) == F.col("_last"), "current").otherwise("stale")).drop("_last")


def accepted_revisions(events: DataFrame, key: str, order: Sequence[str], expected: str) -> DataFrame:
    """(key, order, expected, revision, accepted): writes that name the revision they expect, folded in order.

    A write is accepted if it expects the revision in force (0 at first), and makes the next one.
    """
    logs = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(expected).cast("long").alias("_e")))).alias("log"))
    first = F.struct(F.lit(0).cast("long").alias("rev"), F.array().cast("array<boolean>").alias("ok"))
    step = lambda s, e: F.struct((s["rev"] + (e["_e"] == s["rev"]).cast("long")).alias("rev"), F.concat(s["ok"], F.array(e["_e"] == s["rev"])).alias("ok"))
    rows = logs.select(key, "log", F.aggregate("log", first, step)["ok"].alias("ok")).select(key, F.explode(F.arrays_zip("log", "ok")).alias("x")).select(key, *[F.col(f"x.log.{c}").alias(c) for c in order], F.col("x.log._e").alias(expected), F.col("x.ok").alias("accepted"))
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("revision", F.sum(F.col("accepted").cast("long")).over(w))
