"""Acoustic conditions: known answers, chunks without windows, and faults."""

import pytest

from lorekeep.operators.acoustics import acoustic_conditions

CHUNK, SCORE, SIGNAL = "chunk_id long, start_ms long, end_ms long", "chunk_id long, window_start long, window_end long, class_id long, label string, p double", "chunk_id long, clipping double, rms_dbfs double, silence double"


def run(spark, scores, signals=((1, 0.0, -20.0, 0.1),), chunks=((1, 0, 20_000),)):
    rows = acoustic_conditions(spark.createDataFrame(list(chunks), CHUNK), spark.createDataFrame(list(scores), SCORE), spark.createDataFrame(list(signals), SIGNAL))
    return {r.chunk_id: (r.status, r.music_score, r.speech_score, r.music_level, r.has_music, r.has_speech, r.activity, r.quality) for r in rows.collect()}


def test_known_answers(spark):
    at = lambda c, k, label, *ps: [(c, i * 10_000, i * 10_000 + 10_000, k, label, p) for i, p in enumerate(ps)]
    scores = at(1, 0, "Speech", 0.5, 1.0) + at(1, 1, "Pop Music", 0.25, 0.5) + at(1, 2, "Singing", 0.25, 0.25) + at(1, 3, "Engine", 0.0, 0.375)
    scores += at(2, 1, "Music", 1.0, 0.75) + at(3, 1, "Music", 0.5) + at(3, 0, "Speech", 0.5) + at(4, 9, "Dog", 0.5) + at(9, 0, "Speech", 1.0)
    chunks = [(i, 0, 20_000) for i in range(1, 6)]
    signals = [(1, 0.0, -20.0, 0.1), (2, 0.02, -20.0, 0.1), (3, 0.0, -46.0, 0.1)]
    assert run(spark, scores, signals, chunks) == {
        1: ("derived", 0.375, 0.75, "background", True, True, ["Singing"], "clean"), 2: ("derived", 0.875, 0.0, "dominant", True, False, [], "degraded"),
        3: ("derived", 0.5, 0.5, "uncertain", False, False, [], "degraded"), 4: ("derived", 0.0, 0.0, "none", False, False, [], "degraded"),
        5: ("unknown", None, None, "uncertain", False, False, [], "uncertain"),
    }


@pytest.mark.parametrize("scores", [[(1, 0, 20_001, 0, "Speech", 0.5)], [(1, 0, 10, 0, "Speech", 0.5), (1, 10, 20, 0, "Song", 0.5)]])
def test_faults(spark, scores):
    with pytest.raises(Exception, match="exceeds its chunk|labels drift"):
        run(spark, scores)
