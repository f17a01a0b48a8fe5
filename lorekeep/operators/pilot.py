"""A pilot: a fixed number of chunks from each partition of a corpus, part of them the hardest, part evenly spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tags of difficulty, the hardest first: fixed values.
DIFFICULTY = (
    "human_boundary_bad", "human_boundary_awkward", "chunk_condition_degraded", "chunk_condition_music", "chunk_condition_rapid_turn", "chunk_condition_overlap",
    "review_queue_music", "review_queue_overlap", "boundary_overlap_conflict", "hard_maximum", "no_difficulty_tag",
)
UNTAGGED = DIFFICULTY[-1]


def severity(tag: Column | str) -> Column:
    """The tag's place in DIFFICULTY from 0; null for a tag that isn't there."""
    place = F.array_position(F.array(*map(F.lit, DIFFICULTY)), F.col(tag) if isinstance(tag, str) else tag)
    return F.when(place > 0, place - 1)


def is_spread(pos: Column, n: Column, count: Column) -> Column:
    """Whether pos is one of the places (2i + 1) n div 2 count, i from 0 to count - 1, of n rows.

    In closed form: the only i whose place can be pos is the least one with (2i + 1) n >= 2 count pos.
    """
    i = F.greatest(F.lit(0), F.ceil((2 * count * pos - n) / (2 * n)))
    return F.coalesce((i < count) & (F.floor((2 * i + 1) * n / (2 * F.greatest(count, F.lit(1)))) == pos), F.lit(False))


def episode_quotas(split: DataFrame, total: int, hard: int) -> DataFrame:
    """split(episode, partition) with quota and hard_quota: both totals dealt evenly over each partition's episodes, what is
    left over to the first ones by name."""
    i = F.row_number().over(Window.partitionBy("partition").orderBy("episode")) - 1
    n = F.count("*").over(Window.partitionBy("partition"))
    dealt = lambda t: (F.floor(F.lit(t) / n) + (i < F.lit(t) % n).cast("int")).cast("long")
    return split.select("episode", "partition", dealt(total).alias("quota"), dealt(hard).alias("hard_quota"))


def pilot_faults(chunks: DataFrame, split: DataFrame, total: int = 40, hard: int = 10) -> DataFrame:
    """(subject, fault): why no pilot can be frozen from chunks(episode, chunk_id, start_ms, difficulty) and split(episode,
    partition): an episode in several partitions, a partition of one episode, episodes without a partition or without
    chunks, unknown tags, and episodes with fewer chunks than their quota. A null subject is named 'null'."""
    counted = chunks.groupBy("episode").agg(F.count("*").alias("have"), F.count_if(severity("difficulty").isNull()).alias("unknown"))
    named = lambda d, c, why: d.select(F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("subject"), F.lit(why).alias("fault"))
    quotas = episode_quotas(split.distinct(), total, hard)
    found = named(split.groupBy("episode").agg(F.count_distinct("partition").alias("p")).where("p <> 1"), "episode", "partitions overlap")
    found = found.unionByName(named(split.distinct().groupBy("partition").agg(F.count("*").alias("n")).where("n < 2"), "partition", "fewer than two episodes"))
    found = found.unionByName(named(counted.join(split, "episode", "left_anti"), "episode", "not in the split"))
    found = found.unionByName(named(split.join(counted, "episode", "left_anti"), "episode", "no chunks"))
    found = found.unionByName(named(counted.where("unknown > 0"), "episode", "unknown tag"))
    return found.unionByName(named(quotas.join(counted, "episode").where("have < quota"), "episode", "too few chunks"))


def freeze_pilot(chunks: DataFrame, split: DataFrame, total: int = 40, hard: int = 10) -> DataFrame:
    """(partition, episode, chunk_id, start_ms, category, reason): total chunks of each partition, hard of them difficult.

    Each episode gives its quota: first its hardest chunks (by tag, start and chunk_id), then representatives that lie evenly
    over its untagged rest or, where that is too small for them, over the whole rest. The two can't meet. The first fault of
    pilot_faults raises ValueError. Further columns of chunks aren't read.
    """
    fault = pilot_faults(chunks, split, total, hard).orderBy("subject", "fault").first()
    if fault:
        raise ValueError(f"{fault.subject}: {fault.fault}")
    rows = chunks.select("episode", "chunk_id", "start_ms", "difficulty", severity("difficulty").alias("severity"))
    rows = rows.join(episode_quotas(split.distinct(), total, hard), "episode")
    hardest = Window.partitionBy("episode").orderBy("severity", "start_ms", "chunk_id")
    rows = rows.withColumn("difficult", F.row_number().over(hardest) <= F.col("hard_quota")).withColumn("more", F.col("quota") - F.col("hard_quota"))
    untagged = ~F.col("difficult") & (F.col("difficulty") == UNTAGGED)
    of_episode = Window.partitionBy("episode")
    rows = rows.withColumn("enough", F.count_if(untagged).over(of_episode) >= F.col("more"))
    rows = rows.withColumn("candidate", F.when(F.col("enough"), untagged).otherwise(~F.col("difficult")))
    in_time = Window.partitionBy("episode", "candidate").orderBy("start_ms", "chunk_id")
    rows = rows.withColumn("pos", F.row_number().over(in_time) - 1).withColumn("n", F.count("*").over(Window.partitionBy("episode", "candidate")))
    spread = F.col("candidate") & is_spread(F.col("pos"), F.col("n"), F.col("more"))
    category = F.when(F.col("difficult"), "difficult").when(spread, "representative")
    chosen = rows.withColumn("category", category).where("category IS NOT NULL")
    reason = F.when(F.col("difficult"), F.col("difficulty")).otherwise("temporal_spread")
    return chosen.select("partition", "episode", "chunk_id", "start_ms", "category", reason.alias("reason"))


def pilot_coverage(pilot: DataFrame, chunks: DataFrame, split: DataFrame, tags: Sequence[str]) -> DataFrame:
    """One row a partition: episodes, chunks, difficult, representative, untagged_difficult, tagged_representative, and for each
    boolean column of chunks in tags how many chosen chunks have it (tag) and how many there are to choose from (tag_available)."""
    marks = chunks.select("episode", "chunk_id", "difficulty", *[F.coalesce(t, F.lit(False)).alias(t) for t in tags])
    there = marks.join(split.distinct(), "episode").groupBy("partition").agg(F.count_distinct("episode").alias("episodes"), *[F.count_if(t).alias(f"{t}_available") for t in tags])
    hard = F.col("category") == "difficult"
    got = pilot.join(marks, ["episode", "chunk_id"]).groupBy("partition").agg(
        F.count("*").alias("chunks"), F.count_if(hard).alias("difficult"), F.count_if(~hard).alias("representative"),
        F.count_if(hard & (F.col("difficulty") == UNTAGGED)).alias("untagged_difficult"), F.count_if(~hard & (F.col("difficulty") != UNTAGGED)).alias("tagged_representative"),
        *[F.count_if(t).alias(t) for t in tags],
    )
    return there.join(got, "partition")
