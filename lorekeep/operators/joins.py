"""Joins by time and by key: attribution, nearest, pairs, expected against observed, and dispatch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.intervals import intersection_ms, midpoint_in, range_join


def attribute_words(words: DataFrame, turns: DataFrame, by: Sequence[str], bucket_ms: int) -> DataFrame:
    """words with attributed: the label of the turn with the greatest intersection; of equals one that holds the word's
    midpoint, then the smallest label; null where no turn overlaps."""
    right = turns.select(*by, F.col("speaker").alias("turn_speaker"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    pairs = range_join(words.select(*by, "word_id", "start_ms", "end_ms"), right, by, bucket_ms)
    isect = intersection_ms(F.col("start_ms"), F.col("end_ms"), F.col("r_start"), F.col("r_end"))
    mid = midpoint_in(F.col("start_ms"), F.col("end_ms"), F.col("r_start"), F.col("r_end"))
    best = pairs.groupBy(*by, "word_id").agg(F.min(F.struct((-isect).alias("i"), (~mid).alias("m"), "turn_speaker"))["turn_speaker"].alias("attributed"))
    return words.join(best, [*by, "word_id"], "left")


def flag_overlap(words: DataFrame, spans: DataFrame, by: Sequence[str], bucket_ms: int) -> DataFrame:
    """words with in_overlap: whether any span touches the word."""
    right = spans.select(*by, F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    hit = range_join(words.select(*by, "word_id", "start_ms", "end_ms"), right, by, bucket_ms).select(*by, "word_id").distinct()
    return words.join(hit.withColumn("_hit", F.lit(True)), [*by, "word_id"], "left").withColumn("in_overlap", F.coalesce("_hit", F.lit(False))).drop("_hit")


def near_pairs(turns: DataFrame, by: Sequence[str], within_ms: int) -> DataFrame:
    """Pairs (a, b) of different labels where b starts at most within_ms from a's end: a band join on buckets of the band."""
    size = 2 * within_ms + 1
    a = turns.select(*by, F.col("event_id").alias("a_id"), F.col("speaker").alias("a_speaker"), F.col("end_ms").alias("t"))
    a = a.withColumn("bucket", F.explode(F.sequence(F.expr(f"floor((t - {within_ms}) / {size})"), F.expr(f"floor((t + {within_ms}) / {size})"))))
    b = turns.select(*by, F.col("event_id").alias("b_id"), F.col("speaker").alias("b_speaker"), F.col("start_ms").alias("u")).withColumn("bucket", F.expr(f"floor(u / {size})"))
    pairs = a.join(b, [*by, "bucket"]).where((F.col("a_speaker") != F.col("b_speaker")) & (F.abs(F.col("u") - F.col("t")) <= within_ms))
    return pairs.select(*by, "a_id", "b_id", (F.col("u") - F.col("t")).alias("gap_ms"))


def nearest_within(points: DataFrame, marks: DataFrame, by: Sequence[str], within_ms: int) -> DataFrame:
    """points(t) with the nearest mark(m) at most within_ms away, the earlier of equals; null if none.

    Both sides lie in one sorted stream: the mark before and the mark after each point are running values, so the work
    is a sort and not a product.
    """
    both = points.select(*by, "point_id", "t", F.lit(None).cast("long").alias("m")).unionByName(marks.select(*by, F.lit(None).cast("long").alias("point_id"), F.col("m").alias("t"), "m"))
    w = Window.partitionBy(*by).orderBy("t", F.col("m").asc_nulls_last())
    both = both.withColumn("before", F.last("m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # the mark after is the last one of the stream read backwards: a frame that ends with the group is read anew at each row
    back = Window.partitionBy(*by).orderBy(F.desc("t"), F.col("m").desc_nulls_first())
    both = both.withColumn("after", F.last("m", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))).where("point_id IS NOT NULL")
    near = F.when(F.col("after").isNull() | (F.col("t") - F.col("before") <= F.col("after") - F.col("t")), F.col("before")).otherwise(F.col("after"))
    both = both.withColumn("nearest", F.coalesce(near, "after"))
    return both.select(*by, "point_id", "t", F.when(F.abs(F.col("nearest") - F.col("t")) <= within_ms, F.col("nearest")).alias("nearest"))


def edge_label(turns: DataFrame, gaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """gaps with the label that ends where the gap starts (greatest id) and that starts where it ends (smallest id)."""
    ends = turns.groupBy(*by, F.col("end_ms").alias("start_ms")).agg(F.max_by("speaker", "event_id").alias("label_before"))
    starts = turns.groupBy(*by, F.col("start_ms").alias("end_ms")).agg(F.min_by("speaker", "event_id").alias("label_after"))
    return gaps.join(ends, [*by, "start_ms"], "left").join(starts, [*by, "end_ms"], "left")


def missing(wanted: DataFrame, have: DataFrame, key: Sequence[str]) -> DataFrame:
    return wanted.join(have, list(key), "left_anti")


def mismatches(expected: DataFrame, observed: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, faults): the names of columns that differ, or 'missing'; rows without a fault are left out."""
    o = observed.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    rows = expected.join(o, F.col(key) == F.col("_key"), "left")
    faults = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_o_{c}")), F.lit(c)) for c in columns]))
    faults = F.when(F.col("_key").isNull(), F.array(F.lit("missing"))).otherwise(faults)
    return rows.select(key, F.array_join(faults, ",").alias("faults")).where("faults <> ''")


def dispatch_matrix(items: DataFrame, key: str, adapters: Sequence[str], done: DataFrame) -> DataFrame:
    """Every (item, adapter) that isn't done: adapters are a short list, so each item is exploded, not joined."""
    jobs = items.select(key, F.explode(F.array(*[F.lit(a) for a in adapters])).alias("adapter"))
    return jobs.join(done, [key, "adapter"], "left_anti")
