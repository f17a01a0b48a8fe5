"""Identity groups kept in folders, and corrected in the groups that requests name and nowhere else.

The kept table has three kinds of rows: members (node), links (the decisions) and groups (state, revision). All rows of a
group lie in one folder, whose name is the beginning of the group's id; groups that come of a split inherit it. So a
correction reads and replaces only the folders of the groups it names, and one commit moves members and links together.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.work import materialize
from lorekeep.operators.graph import connected_components

#: Hex digits of a group's id that name its folder.
DIGITS = 2
PREFIX = "global-"


class Corrected(NamedTuple):
    """rows: what the touched folders hold afterwards; changes(node, before, after): members of touched groups, after null
    if the node stands alone; audit(decision_id, revision, action, reviewer, group_id): a row per superseded decision."""

    rows: DataFrame
    changes: DataFrame
    audit: DataFrame


def _bucket(group: str = "group_id") -> Column:
    return F.when(F.col(group) == "", "bnone").otherwise(F.concat(F.lit("b"), F.substring(group, len(PREFIX) + 1, DIGITS)))


def _write(rows: DataFrame, path: str, **options: str) -> None:
    """Small folders share a task and large ones are dealt over several, by size."""
    rows.hint("rebalance", "bucket").write.mode("overwrite").options(**options).partitionBy("bucket").parquet(path)


def _alive(links: DataFrame) -> DataFrame:
    return links.where("decision = 'same_person' AND state = 'active'").select("a", "b")


def publish_identity(decisions: DataFrame, path: str) -> None:
    """Write decisions(decision_id, a, b, decision, state, revision) and the groups they make as a kept table.

    A group's id comes from its smallest node. Decisions are filed under the group of a, those without one under none.
    """
    parts = connected_components(_alive(decisions), "identity")
    name = F.concat(F.lit(PREFIX), F.substring(F.sha2(F.col("component").cast("string"), 256), 1, 32))
    members = materialize(parts.select("node", name.alias("group_id")), "members")
    links = decisions.select("decision_id", "a", "b", "decision", "state", F.col("revision").cast("long").alias("revision"))
    links = links.join(members.withColumnRenamed("node", "a"), "a", "left").withColumn("group_id", F.coalesce("group_id", F.lit("")))
    groups = members.select("group_id").distinct().select("group_id", F.lit("active").alias("state"), F.lit(1).cast("long").alias("revision"))
    rows = members.withColumn("kind", F.lit("member"))
    for kind, more in (("link", links), ("group", groups)):
        rows = rows.unionByName(more.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    _write(rows.withColumn("bucket", _bucket()), path)


def read_identity(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The members (node, group_id), links, or groups of a kept table."""
    names = {"member": ["node", "group_id"], "link": ["decision_id", "a", "b", "decision", "state", "revision", "group_id"], "group": ["group_id", "state", "revision"]}[kind]
    return spark.read.parquet(path).where(F.col("kind") == kind).select(names)


def _faults(undo: DataFrame, apart: DataFrame, keep: DataFrame, members: DataFrame, marked: DataFrame) -> DataFrame:
    """(group_id, fault) of requests that don't fit what is kept."""
    found = marked.where("_undone").select("decision_id", "state", F.col("revision").alias("_at"))
    stale = undo.join(found, "decision_id", "left").where("state IS NULL OR state <> 'active' OR NOT (_at <=> expected)")
    faults = stale.select("group_id", F.concat(F.lit("decision is missing or stale: "), F.col("decision_id").cast("string")).alias("fault"))
    known = members.withColumn("_in", F.lit(True))
    outside = apart.join(known, ["group_id", "node"], "left").where("_in IS NULL")
    faults = faults.unionByName(outside.select("group_id", F.lit("a node to separate is not in the group").alias("fault")))
    left = keep.where("group_id <> ''").join(known.withColumnRenamed("node", "retain"), ["group_id", "retain"], "left")
    left = left.join(apart.select("group_id", F.col("node").alias("retain"), F.lit(True).alias("_apart")), ["group_id", "retain"], "left")
    left = left.where("_kept > 1 OR _in IS NULL OR _apart IS NOT NULL")
    faults = faults.unionByName(left.select("group_id", F.lit("a group needs one node to retain, of its own and not separated").alias("fault")))
    crossing = marked.where("_cross").select("group_id").distinct()
    idle = apart.select("group_id").distinct().join(crossing, "group_id", "left_anti")
    return faults.unionByName(idle.select("group_id", F.lit("a split has no active link to cross").alias("fault")))


def correct_identity(spark: SparkSession, path: str, requests: DataFrame) -> Corrected:
    """What requests(group_id, decision_id, expected, node, retain, reviewer) make of the groups that they name.

    A row with a decision_id undoes it, if it is active and of revision `expected`; one with a node separates it from its
    group: every active same_person link between separated nodes and the others is superseded. What is left of a group is
    rebuilt from its own links; the part with `retain` keeps the group's id, other parts of two or more get new ones, and
    nodes without a link have none. A group's requests are applied together and name the same `retain`. Decisions filed
    under no group have group_id null. Repeated requests count once; ones that don't fit raise ValueError, and nothing is
    changed. Nothing is written to path: see apply_identity.
    """
    whole = spark.read.parquet(path)
    types = {f.name: f.dataType for f in whole.schema}
    reads = {"group_id": "string", "decision_id": types["decision_id"], "expected": "long", "node": types["node"], "retain": types["node"], "reviewer": "string"}
    req = requests.select(*[F.col(n).cast(t).alias(n) for n, t in reads.items()]).withColumn("group_id", F.coalesce("group_id", F.lit("")))
    req = materialize(req, "requests")
    folders = [r[0] for r in req.select(_bucket().alias("b")).distinct().collect()]  # at most 16 ** DIGITS + 1
    kept = whole.where(F.col("bucket").isin(folders))
    named = req.select("group_id").distinct()
    rows = materialize(kept.join(named, "group_id", "left_semi"), "touched")
    others = kept.join(named, "group_id", "left_anti")

    members = rows.where("kind = 'member'").select("group_id", "node")
    undo = req.where("decision_id IS NOT NULL").groupBy("group_id", "decision_id").agg(F.min("expected").alias("expected"), F.min("reviewer").alias("_who"))
    apart = req.where("node IS NOT NULL").groupBy("group_id", "node").agg(F.min("reviewer").alias("_who"))
    keep = req.groupBy("group_id").agg(F.max("retain").alias("retain"), F.count_distinct("retain").alias("_kept"))

    links = rows.where("kind = 'link'").select("group_id", "decision_id", "a", "b", "decision", "state", "revision")
    marked = links.join(undo.select("group_id", "decision_id", F.lit(True).alias("_undone"), "_who"), ["group_id", "decision_id"], "left")
    for end in ("a", "b"):
        side = apart.select("group_id", F.col("node").alias(end), F.lit(True).alias(f"_{end}"), F.col("_who").alias(f"_who_{end}"))
        marked = marked.join(side, ["group_id", end], "left")
    alone = lambda c: F.coalesce(c, F.lit(False))
    cross = (F.col("decision") == "same_person") & (F.col("state") == "active") & (alone("_a") != alone("_b"))
    marked = materialize(marked.withColumn("_undone", alone("_undone")).withColumn("_cross", alone(cross)), "marked")
    if wrong := _faults(undo, apart, keep, members, marked).orderBy("group_id", "fault").first():
        raise ValueError(f"{wrong.group_id}: {wrong.fault}")

    gone = F.col("_undone") | F.col("_cross")
    who = F.coalesce("_who", "_who_a", "_who_b")
    changed = marked.withColumn("revision", F.col("revision") + gone.cast("long")).withColumn("state", F.when(gone, "superseded").otherwise(F.col("state")))
    audit = changed.where(gone).select("decision_id", "revision", F.when(F.col("_undone"), "undo").otherwise("split").alias("action"), who.alias("reviewer"), "group_id")
    parts = connected_components(_alive(changed), "identity")
    stays = keep.select("group_id", F.col("retain").alias("node")).join(parts, "node").select("group_id", F.col("component").alias("_stays"))
    was = rows.where("kind = 'group'").select("group_id", "revision")
    new = F.sha2(F.concat_ws(":", "group_id", F.col("revision").cast("string"), F.col("component").cast("string")), 256)
    new = F.concat(F.substring("group_id", 1, len(PREFIX) + DIGITS), F.substring(new, 1, 32 - DIGITS))
    after = F.when(F.col("component").isNull(), None).when(F.col("component") == F.col("_stays"), F.col("group_id")).otherwise(new)
    moved = members.join(parts, "node", "left").join(stays, "group_id", "left").join(was, "group_id")
    changes = materialize(moved.select("node", F.col("group_id").alias("before"), after.alias("after")), "changes")

    now = changes.where("after IS NOT NULL").select("node", F.col("after").alias("group_id"))
    names = now.select("group_id").distinct()
    filed = changed.select("decision_id", "a", "b", "decision", "state", "revision", F.col("group_id").alias("_before"))
    filed = filed.join(now.withColumnRenamed("node", "a"), "a", "left").withColumn("group_id", F.coalesce("group_id", "_before")).drop("_before")
    groups = was.withColumn("_was", F.col("revision")).drop("revision").join(names.withColumn("_is", F.lit(True)), "group_id", "full")
    groups = groups.select("group_id", F.when(F.col("_is"), "active").otherwise("superseded").alias("state"), (F.coalesce("_was", F.lit(0)) + 1).cast("long").alias("revision"))
    out = now.withColumn("kind", F.lit("member"))
    for kind, more in (("link", filed), ("group", groups)):
        out = out.unionByName(more.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    return Corrected(out.withColumn("bucket", _bucket()).unionByName(others), changes, audit)


def apply_identity(done: Corrected, path: str) -> None:
    """Replace the touched folders of the kept table. One writer at a time; readers see a folder before or after."""
    _write(materialize(done.rows, "corrected"), path, partitionOverwriteMode="dynamic")
