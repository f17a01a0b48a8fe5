"""Greedy batches under a byte cap over an ordered stream, made in parallel within one stream."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorekeep.functions.work import materialize

#: Caps' worth of bytes in a block, which one task walks.
SPAN = 64


def _placed(rows: DataFrame, by: str, order: Sequence[str], size: str, cap: int) -> DataFrame:
    """(g, order, seq, start, end): each row's number and bytes before and after it in its stream; sums in two levels."""
    ok = F.col(size).between(1, cap)
    checked = F.when(ok, F.col(size).cast("long")).otherwise(F.raise_error(F.lit(f"an item is empty or larger than {cap} bytes")).cast("long"))
    cut = rows.select(F.col(by).alias("g"), *order, checked.alias("bytes")).repartitionByRange("g", *order).withColumn("part", F.spark_partition_id())
    cut = materialize(cut, "batch-items")
    parts = cut.groupBy("g", "part").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("g", "part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    within = Window.partitionBy("g", "part").orderBy(*order)
    cut = cut.withColumn("i", F.row_number().over(within)).withColumn("s", F.sum("bytes").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    joined = cut.alias("c").join(parts.alias("p"), F.col("c.g").eqNullSafe(F.col("p.g")) & (F.col("c.part") == F.col("p.part")))
    end = F.col("p.b") + F.col("c.s")
    return joined.select("c.g", *[f"c.{o}" for o in order], (F.col("p.n") + F.col("c.i")).alias("seq"), (end - F.col("c.bytes")).alias("start"), end.alias("end"))


def _spread(placed: DataFrame, length: int, cap: int) -> DataFrame:
    """placed, each row in its block (begin: where that begins), and those that begin within a cap after it once more in the block before.

    So a block has each row at which a batch begun in it may end: a start is at most a cap beyond the block then.
    """
    block = F.floor(F.col("start") / length).cast("long")
    both = F.when((block > 0) & (F.col("start") < block * length + cap), F.array(block, block - 1)).otherwise(F.array(block))
    return placed.withColumn("block", F.explode(both)).withColumn("begin", F.col("block") * length)


def _sorted(rows: pa.Table, length: int, cap: int) -> tuple[pa.Table, int, list[int]]:
    """A block's rows by seq, how many are its own, and for each of these the first row that a batch begun at it can't hold."""
    rows = rows.take(np.argsort(rows["seq"].to_numpy()))
    start = rows["start"].to_numpy()
    own = int(np.searchsorted(start, rows["begin"][0].as_py() + length))
    return rows, own, np.searchsorted(rows["end"].to_numpy(), start[:own] + cap, side="right").tolist()


def _exits(length: int, cap: int):
    def run(rows: pa.Table) -> pa.Table:
        """For each row at which a batch may be the first to begin in the block, where the first batch beyond it begins; null beyond the stream."""
        rows, own, exits = _sorted(rows, length, cap)
        for i in range(own - 1, -1, -1):
            if exits[i] < own:
                exits[i] = exits[exits[i]]
        entries = int(np.searchsorted(rows["start"].to_numpy()[:own], rows["begin"][0].as_py() + cap))
        seq = rows["seq"].to_pylist()
        leaves = pa.array([seq[i] if i < len(seq) else None for i in exits[:entries]], pa.int64())
        return rows.select(["g", "block", "seq"]).slice(0, entries).rename_columns(["g", "block", "entry"]).append_column("leaves", leaves)

    return run


def _walk(length: int, cap: int):
    def run(rows: pa.Table) -> pa.Table:
        """local: the number of batches that have begun in the block, up to each row, from the block's real entry on, if it has one."""
        rows, own, following = _sorted(rows, length, cap)
        entry = rows["entry"][0].as_py()
        begins, at = np.zeros(own, np.int64), own if entry is None else entry - rows["seq"][0].as_py()
        while at < own:
            begins[at], at = 1, following[at]
        return rows.slice(0, own).drop_columns(["seq", "start", "end", "begin", "entry"]).append_column("local", pa.array(np.cumsum(begins)))

    return run


def pack_batches(rows: DataFrame, by: str, order: Sequence[str], size: str, cap: int, span: int = SPAN) -> DataFrame:
    """(by, order, batch): rows of each stream in batches from 0, in order, each as long as its bytes don't exceed cap.

    That is the sequential rule, without one task for a stream: a block of span caps, with the rows of a cap after it, tells
    at which row a batch begun at any of its rows ends; that gives a map from the rows at which it may be entered to those
    of the next block; the maps are chained by doubling; then each block is walked from its real entry. order must be unique within a stream; a
    null stream is one. Sizes that are null, below 1 or above cap raise. Rows of one order within a stream would be numbered in any order.
    """
    if span < 2:
        raise ValueError("a block has two caps at least, so that no batch spans one")
    key = dict(rows.dtypes)[by]
    placed = materialize(_placed(rows, by, order, size, cap), "batch-placed")
    length = cap * span
    blocks = _spread(placed, length, cap)
    ends = blocks.select("g", "seq", "start", "end", "block", "begin").groupBy("g", "block")
    jumps = materialize(ends.applyInArrow(_exits(length, cap), f"g {key}, block long, entry long, leaves long"), "batch-exits")
    reached, known = jumps.where("entry = 1").select("g", "block", "entry"), -1
    entries = jumps.select("g", "block", "entry")
    same = lambda a, b: F.col(f"{a}.g").eqNullSafe(F.col(f"{b}.g"))
    jumps = jumps.select("g", "entry", "leaves").where("leaves IS NOT NULL")
    while (n := reached.count()) != known:  # rounds grow with the logarithm of a stream's blocks
        known = n
        more = reached.alias("r").join(jumps.alias("j"), same("r", "j") & (F.col("r.entry") == F.col("j.entry"))).select("r.g", F.col("j.leaves").alias("entry"))
        more = more.alias("m").join(entries.alias("e"), same("m", "e") & (F.col("m.entry") == F.col("e.entry"))).select("e.*")
        reached = materialize(reached.unionByName(more).distinct(), "batch-reached")
        twice = jumps.alias("a").join(jumps.alias("b"), same("a", "b") & (F.col("a.leaves") == F.col("b.entry")))
        jumps = materialize(twice.select("a.g", "a.entry", "b.leaves"), "batch-jumps")
    real = blocks.alias("l").join(reached.alias("r"), same("l", "r") & (F.col("l.block") == F.col("r.block")), "left").select("l.*", "r.entry")
    columns = StructType([f for f in placed.schema if f.name not in ("seq", "start", "end")]).add("block", "long").add("local", "long")
    walked = materialize(real.groupBy("g", "block").applyInArrow(_walk(length, cap), columns), "batch-walked")
    begun = Window.partitionBy("g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = walked.groupBy("g", "block").agg(F.max("local").alias("m")).select("g", "block", F.coalesce(F.sum("m").over(begun), F.lit(0)).alias("before"))
    found = walked.alias("w").join(offsets.alias("o"), same("w", "o") & (F.col("w.block") == F.col("o.block")))
    return found.select(F.col("w.g").alias(by), *[f"w.{o}" for o in order], (F.col("o.before") + F.col("w.local") - 1).alias("batch"))
