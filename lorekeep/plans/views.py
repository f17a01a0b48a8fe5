"""Domain views over the driver's tables: words, turns, chunks and the like, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode, word_id, speaker, text, start_ms, end_ms: a word every 300 ms, 250 ms long."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    parts = c.select("conv_id", "turn", "role", F.posexplode(F.expr("filter(split(text, '\\\\s+'), x -> x <> '')")).alias("pos", "word"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "pos", "role", "word")) - 1
    return parts.select(
        F.col("conv_id").alias("episode"), n.cast("long").alias("word_id"), F.col("role").alias("speaker"), F.col("word").alias("text"), "turn"
    ).withColumn("start_ms", F.col("word_id") * 300).withColumn("end_ms", F.col("start_ms") + 250)


def speaker_turns(words_: DataFrame) -> DataFrame:
    """episode, speaker, start_ms, end_ms: each conversation turn, moved so that its edges cut through words."""
    g = words_.groupBy("episode", "turn", "speaker").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"))
    return g.select("episode", "speaker", (F.col("s") - 100).alias("start_ms"), (F.col("e") + F.col("turn") % 3 * 100 - 120).alias("end_ms")).where("start_ms < end_ms")


def turns(spark: SparkSession, sf_dir: str, scale: int = 1000) -> DataFrame:
    """event_id, episode, speaker, kind, start_ms, end_ms from events: milliseconds of the day, at least scale long."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    start = F.expr("CAST((us div 1000) % 86400000 AS BIGINT)")
    return e.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("episode"), F.col("user_id").alias("speaker"), F.col("event_type").alias("kind"), start.alias("start_ms"),
        (start + scale * F.greatest(F.lit(1), F.ceil("value")).cast("long")).alias("end_ms"),
    )


WORDS = """words AS (
  SELECT conv_id AS episode, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos, role, word) - 1 AS BIGINT) AS word_id, role AS speaker, word AS text, turn
  FROM (SELECT conv_id, turn, role, unnest(l) AS word, unnest(range(len(l))) AS pos
        FROM (SELECT conv_id, turn, role, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS l FROM conversations WHERE text IS NOT NULL))),
timed AS (SELECT *, word_id * 300 AS start_ms, word_id * 300 + 250 AS end_ms FROM words),
sturns AS (
  SELECT * FROM (SELECT episode, speaker, min(start_ms) - 100 AS start_ms, max(end_ms) + turn % 3 * 100 - 120 AS end_ms FROM timed GROUP BY episode, turn, speaker)
  WHERE start_ms < end_ms)"""


def turns_sql(scale: int = 1000) -> str:
    return f"""turns AS (
  SELECT event_id, strftime(ts, '%Y-%m-%d') AS episode, user_id AS speaker, event_type AS kind, CAST(epoch_us(ts) // 1000 % 86400000 AS BIGINT) AS start_ms,
    CAST(epoch_us(ts) // 1000 % 86400000 + {scale} * greatest(1, CAST(ceil(value) AS BIGINT)) AS BIGINT) AS end_ms FROM events)"""
