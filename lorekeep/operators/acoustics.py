"""Acoustic conditions of chunks from class scores of their windows and from signal measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.aggregates import class_means, degraded, level

# Words that a label holds, and the least probability of an activity and of speech.
MUSIC = ("music", "musical instrument", "singing", "song")
SPEECH = ("speech", "conversation", "narration", "monologue", "babbling", "speech synthesizer")
ACTIVITY = ("applause", "breathing", "cough", "crowd", "crying", "engine", "laughter", "noise", "rain", "singing", "vehicle", "wind")
ACTIVITY_LEAST, SPEECH_LEAST = 0.25, 0.565918


def label_holds(label: str, words: Sequence[str]) -> Column:
    """Whether the lower-cased label contains one of words."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.lower(label), F.lit(w))
    return found


def acoustic_conditions(chunks: DataFrame, scores: DataFrame, signals: DataFrame, by: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """by, status, music_score, speech_score, music_level, has_music, has_speech, activity, quality: a row per chunk.

    chunks(by, start_ms, end_ms), scores(by, window_start, window_end, class_id, label, p) of windows, signals(by,
    clipping, rms_dbfs, silence). A class's score is its mean over the chunk's windows that have it; the music score is the
    best of the labels that mean music, or 0. activity has the labels of other sounds, sorted. A chunk without windows
    is unknown, with level and quality uncertain; one with windows and no signal counts as silent. A window beyond its
    chunk, or a class with two labels, raises; windows of other chunks are left out.
    """
    by = list(by)
    inside = scores.join(chunks.select(*by, "start_ms", "end_ms"), by)
    beyond = (F.col("window_start") < F.col("start_ms")) | (F.col("window_end") > F.col("end_ms"))
    p = F.when(beyond, F.raise_error(F.lit("a window exceeds its chunk")).cast("double")).otherwise(F.col("p"))
    means = class_means(inside.select(*by, "class_id", "label", p.alias("p")), by)
    best = lambda words: F.coalesce(F.max(F.when(label_holds("label", words), F.col("p"))), F.lit(0.0))
    heard = F.when((F.col("p") >= ACTIVITY_LEAST) & label_holds("label", ACTIVITY), F.col("label"))
    found = means.groupBy(*by).agg(best(MUSIC).alias("music_score"), best(SPEECH).alias("speech_score"), F.array_sort(F.collect_list(heard)).alias("activity"))
    rows = chunks.select(*by).join(found, by, "left").join(signals.select(*by, "clipping", "rms_dbfs", "silence"), by, "left")
    known = F.col("music_score").isNotNull()
    state = F.when(known, level(F.col("music_score"), F.col("speech_score"))).otherwise("uncertain")
    quality = degraded(F.coalesce("clipping", F.lit(0.0)), F.coalesce("rms_dbfs", F.lit(-120.0)), F.coalesce("silence", F.lit(1.0)))
    return rows.select(
        *by, F.when(known, "derived").otherwise("unknown").alias("status"), "music_score", "speech_score", state.alias("music_level"), state.isin("background", "dominant").alias("has_music"),
        F.coalesce(F.col("speech_score") >= SPEECH_LEAST, F.lit(False)).alias("has_speech"), F.coalesce("activity", F.array().cast("array<string>")).alias("activity"), F.when(known, quality).otherwise("uncertain").alias("quality"),
    )
