"""Half-open interval algebra in integer milliseconds.

Intervals carry start_ms and end_ms; operators work within the groups named by `by`. Range joins file both sides under
time buckets, so an equality on (group, bucket) carries the join and the exact predicate runs within a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two half-open intervals share a point; touching ones don't."""
    return (a_start < b_end) & (a_end > b_start)


def intersection_ms(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def midpoint_in(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Whether the exact midpoint lies in [low, high): compared doubled, without a division."""
    return (2 * low <= start + end) & (start + end < 2 * high)


def floor_midpoint_in(start: Column, end: Column, low: Column, high: Column) -> Column:
    mid = F.floor((start + end) / 2)
    return (low <= mid) & (mid < high)


def clip(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Intervals cut to [low, high); empty ones go."""
    return rows.withColumn("start_ms", F.greatest("start_ms", low)).withColumn("end_ms", F.least("end_ms", high)).where("start_ms < end_ms")


def range_join(left: DataFrame, right: DataFrame, by: Sequence[str], bucket_ms: int) -> DataFrame:
    """Overlapping pairs of left(start_ms, end_ms) and right(r_start, r_end) with equal `by`; right's `by` is dropped.

    A pair that shares several buckets is kept in the one of its common start.
    """

    def filed(df: DataFrame, s: str, e: str, bucket: str) -> DataFrame:
        first, last = F.expr(f"floor({s} / {bucket_ms})"), F.expr(f"floor(({e} - 1) / {bucket_ms})")
        return df.withColumn(bucket, F.explode(F.sequence(first, F.greatest(first, last))))

    r = filed(right, "r_start", "r_end", "_bucket")
    for c in by:
        r = r.withColumnRenamed(c, f"_r_{c}")
    keys = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by]
    one = F.floor(F.greatest("start_ms", "r_start") / bucket_ms) == F.col("_bucket")
    same = [F.col("_left_bucket") == F.col("_bucket"), *keys, F.col("start_ms") < F.col("r_end"), F.col("end_ms") > F.col("r_start"), one]
    return filed(left, "start_ms", "end_ms", "_left_bucket").join(r, same).drop("_left_bucket", "_bucket", *(f"_r_{c}" for c in by))


def islands(rows: DataFrame, by: Sequence[str], new: Column, order: Sequence) -> DataFrame:
    """rows with `island`, a number that grows in its group wherever `new` holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_ranges(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The union of each group's intervals; touching ones join."""
    w = Window.partitionBy(*by).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select(*by, "start_ms", "end_ms").withColumn("_reach", reach)
    found = islands(rows, by, F.col("_reach").isNull() | (F.col("start_ms") > F.col("_reach")), ["start_ms", "end_ms"])
    return found.groupBy(*by, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def subtract_ranges(rows: DataFrame, holes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each group's union of intervals without the union of its holes.

    A sweep over the edges of both: what lies between two edges stays if an interval is open there and no hole is.
    """
    edges = None
    for df, kind in ((merge_ranges(rows, by), 1), (merge_ranges(holes, by), 0)):
        part = df.select(*by, F.explode(F.array(F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("d")))).alias("x"))
        part = part.select(*by, "x.t", (F.col("x.d") * kind).alias("a"), (F.col("x.d") * (1 - kind)).alias("b"))
        edges = part if edges is None else edges.unionByName(part)
    edges = edges.groupBy(*by, "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy(*by).orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    parts = edges.select(*by, F.col("t").alias("start_ms"), F.lead("t").over(w).alias("end_ms"), F.sum("a").over(run).alias("a"), F.sum("b").over(run).alias("b"))
    return merge_ranges(parts.where("a > 0 AND b = 0 AND end_ms IS NOT NULL"), by)


def collar_ranges(rows: DataFrame, regions: DataFrame, by: Sequence[str], collar_ms: int) -> DataFrame:
    """Regions without the collar around every edge of rows."""
    edges = rows.select(*by, F.explode(F.array("start_ms", "end_ms")).alias("t")).distinct()
    return subtract_ranges(regions, edges.select(*by, (F.col("t") - collar_ms).alias("start_ms"), (F.col("t") + collar_ms).alias("end_ms")), by)


def activity(rows: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """(by, start_ms, end_ms, n): stretches from one change of the set of active labels to the next, with the number of
    labels (null isn't one, but is active). Gaps are left out.

    A sweep: each label's union of intervals adds one at its start and takes it at its end. As touching intervals of a
    label are one, every edge changes the set, so what is sorted are the edges; the sets themselves aren't made.
    """
    return _cells(_unions(rows, by, label), by)


def _unions(rows: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    return merge_ranges(rows.where("start_ms < end_ms").select(*by, F.col(label).alias("_label"), "start_ms", "end_ms"), [*by, "_label"])


def _cells(unions: DataFrame, by: Sequence[str]) -> DataFrame:
    sides = F.array(F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("d")))
    edges = unions.select(*by, "_label", F.explode(sides).alias("x")).groupBy(*by, F.col("x.t").alias("start_ms")).agg(
        F.count("_label").alias("_named"), F.sum(F.when(F.col("_label").isNotNull(), F.col("x.d")).otherwise(0)).alias("_d"), F.sum("x.d").alias("_all")
    )
    w = Window.partitionBy(*by).orderBy("start_ms")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    cells = edges.withColumn("n", F.sum("_d").over(run)).withColumn("_open", F.sum("_all").over(run))
    cells = cells.where("_named > 0 OR n = 0")  # a null label changes no set that has others
    return cells.withColumn("end_ms", F.lead("start_ms").over(w)).where("_open > 0").select(*by, "start_ms", "end_ms", "n")


def overlap_spans(rows: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """(by, start_ms, end_ms): the union of what overlap_intervals() gives, without its sets."""
    return merge_ranges(activity(rows, by, label).where("n >= 2"), by)


#: Labels in an Arrow batch of segments, about.
SET_LABELS = 1 << 19


def _with_sets(cells: DataFrame, unions: DataFrame, by: Sequence[str], bucket_ms: int) -> DataFrame:
    """cells with `active`, the sorted labels of the unions that are active there.

    Cells lie in the bucket of their start, unions in all that they touch, so both move once and a set is never moved: it
    is written out where a bucket's edges are passed through. A task holds a bucket's edges and a batch of sets.
    """
    kinds = unions.schema
    bucket = lambda e: F.expr(f"floor({e} / {bucket_ms})")
    files = F.explode(F.sequence(bucket("start_ms"), bucket("(end_ms - 1)"))).alias("_bucket")
    none = F.lit(None).cast(kinds["_label"].dataType).alias("_label")
    both = cells.select(*by, bucket("start_ms").alias("_bucket"), "start_ms", "end_ms", none, F.lit(True).alias("_cell")).unionByName(
        unions.where("_label IS NOT NULL").select(*by, files, "start_ms", "end_ms", "_label", F.lit(False).alias("_cell"))
    )
    keys = list(by)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = pa.Table.from_batches(list(batches)).combine_chunks()
        cell, start, end = (g[c].to_numpy() for c in ("_cell", "start_ms", "end_ms"))
        at = np.flatnonzero(cell)
        at = at[np.argsort(start[at], kind="stable")]
        own = np.flatnonzero(~cell)
        labels = g["_label"].take(own)
        names = labels.unique()
        names = names.take(pc.sort_indices(names))
        codes = pc.index_in(labels, value_set=names).to_numpy()
        first, last = np.argsort(start[own], kind="stable"), np.argsort(end[own], kind="stable")
        on, off = np.searchsorted(start[own][first], start[at], "right"), np.searchsorted(end[own][last], start[at], "right")
        first, last = codes[first], codes[last]
        active = np.zeros(len(names), np.int32)
        i = j = done = size = 0
        sets: list[np.ndarray] = []
        for k in range(len(at)):
            np.add.at(active, first[i : on[k]], 1)
            np.subtract.at(active, last[j : off[k]], 1)
            i, j = on[k], off[k]
            sets.append(np.flatnonzero(active))
            size += len(sets[-1])
            if size >= SET_LABELS or k == len(at) - 1:
                part = at[done : k + 1]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(np.concatenate(sets))))
                columns = [*(g[c].take(part).combine_chunks() for c in keys), made, pa.array(start[part]), pa.array(end[part])]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "active", "start_ms", "end_ms"])
                done, size, sets = k + 1, 0, []

    types = [StructField(c, kinds[c].dataType) for c in keys]
    schema = StructType([*types, StructField("active", ArrayType(kinds["_label"].dataType)), StructField("start_ms", LongType()), StructField("end_ms", LongType())])
    return both.groupBy(*by, "_bucket").applyInArrow(fill, schema)


def segments(rows: DataFrame, by: Sequence[str], label: str, bucket_ms: int) -> DataFrame:
    """Elementary segments with the sorted set of active labels; neighbours with equal sets are one. Gaps are left out."""
    unions = _unions(rows, by, label)
    return _with_sets(_cells(unions, by), unions, by, bucket_ms)


def overlap_intervals(rows: DataFrame, by: Sequence[str], label: str, bucket_ms: int) -> DataFrame:
    unions = _unions(rows, by, label)
    return _with_sets(_cells(unions, by).where("n >= 2"), unions, by, bucket_ms)


def union_intersection(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """(a_ms, b_ms, both_ms) of each group."""
    span = F.sum(F.col("end_ms") - F.col("start_ms"))
    left, right = (merge_ranges(x, by).groupBy(*by).agg(span.alias(n)) for x, n in ((a, "a_ms"), (b, "b_ms")))
    only = subtract_ranges(a, b, by).groupBy(*by).agg(span.alias("only_ms"))
    rows = left.join(right, list(by), "full").join(only, list(by), "left").na.fill(0, ["a_ms", "b_ms", "only_ms"])
    return rows.withColumn("both_ms", F.col("a_ms") - F.col("only_ms")).drop("only_ms")


def condition(speech: Column, overlap: Column, labels: Column, heavy: float = 0.5) -> Column:
    """single_speaker, multi_speaker_no_overlap, partial_overlap or heavy_overlap; uncertain without speech or labels."""
    some = F.coalesce((labels > 0) & (speech > 0), F.lit(False))
    return (
        F.when(~some, "uncertain").when((overlap == 0) & (labels == 1), "single_speaker").when(overlap == 0, "multi_speaker_no_overlap")
        .when(overlap >= heavy * speech, "heavy_overlap").otherwise("partial_overlap")
    )


def speaker_condition(rows: DataFrame, by: Sequence[str], label: str, bucket_ms: int, heavy: float = 0.5) -> DataFrame:
    """Speech and overlap milliseconds, their quotient, most simultaneous labels, their number, and the class of each group."""
    s = activity(rows, by, label).withColumn("ms", F.col("end_ms") - F.col("start_ms"))
    g = s.groupBy(*by).agg(F.sum("ms").alias("speech_ms"), F.sum(F.when(F.col("n") > 1, F.col("ms")).otherwise(0)).alias("overlap_ms"), F.max("n").cast("long").alias("most"))
    g = rows.groupBy(*by).agg(F.count_distinct(label).alias("labels")).join(g, list(by), "left").na.fill(0, ["speech_ms", "overlap_ms", "most"])
    share = F.round(F.try_divide(F.col("overlap_ms").cast("double"), F.col("speech_ms").cast("double")), 6)
    return g.withColumn("overlap_fraction", share).withColumn("kind", condition(F.col("speech_ms"), F.col("overlap_ms"), F.col("labels"), heavy))


def tiles(rows: DataFrame, size_ms: int, context_ms: int = 0) -> DataFrame:
    """Fixed windows over [0, duration_ms), the last one cut, with a context on either side that stays inside."""
    at = F.explode(F.expr(f"sequence(0L, greatest(duration_ms - 1, 0L), {size_ms}L)")).alias("start_ms")
    cut = rows.where("duration_ms > 0").select("*", at)
    return cut.withColumn("end_ms", F.least(F.col("start_ms") + size_ms, F.col("duration_ms"))).withColumn("decode_start_ms", F.greatest(F.lit(0).cast("long"), F.col("start_ms") - context_ms)).withColumn(
        "decode_end_ms", F.least(F.col("end_ms") + context_ms, F.col("duration_ms"))
    )


def owned(rows: DataFrame, size_ms: int) -> DataFrame:
    """rows with the number of the window that owns each interval's exact midpoint."""
    return rows.withColumn("window", F.expr(f"(start_ms + end_ms) div {2 * size_ms}"))


def split_blocks(rows: DataFrame, parts: int = 5) -> DataFrame:
    """Contiguous blocks [i * d div parts, (i + 1) * d div parts); the last is held out."""
    cut = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("block"))
    return cut.withColumn("start_ms", F.expr(f"block * duration_ms div {parts}")).withColumn("end_ms", F.expr(f"(block + 1) * duration_ms div {parts}")).withColumn("held_out", F.col("block") == parts - 1)


def coverage_faults(rows: DataFrame, by: Sequence[str], most_ms: int) -> DataFrame:
    """Intervals that leave a gap, overlap the one before, are empty or longer than most_ms."""
    w = Window.partitionBy(*by).orderBy("start_ms", "end_ms")
    before = F.lag("end_ms").over(w)
    fault = F.when(F.col("end_ms") <= F.col("start_ms"), "empty").when(before < F.col("start_ms"), "gap").when(before > F.col("start_ms"), "overlap").when(F.col("end_ms") - F.col("start_ms") > most_ms, "long")
    return rows.withColumn("fault", fault).where("fault IS NOT NULL")
