"""RTTM and SRT as data sources: round trips, ranges, equality with the exports, lost and failing tasks."""

import os

import pytest
from pyspark.sql import functions as F

from lorekeep.plans import q_scoring as q
from lorekeep.plans.views import turns
from lorekeep.sources.transcripts import LISTED, register


@pytest.fixture
def sources(spark):
    register(spark)
    return spark


def folder(tmp_path, form):
    return sorted(f for f in os.listdir(tmp_path / "x") if f.endswith(form))


@pytest.mark.parametrize("size", [64, 1000, 1 << 25])
def test_rttm(sources, sf, tmp_path, size):
    rows = turns(sources, sf).select("episode", F.col("speaker").cast("string").alias("speaker"), "start_ms", "end_ms").repartition(3)
    path = f"file://{tmp_path}/x"
    rows.write.format("rttm").mode("append").save(path)
    back = sources.read.format("rttm").option("range", size).load(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    lines = [line for f in folder(tmp_path, ".rttm") for line in (tmp_path / "x" / f).read_text().splitlines()]
    want = {r.line for r in q.b9_export_rttm(sources, sf).collect()}
    assert len(lines) == rows.count() and set(lines) == want  # the same lines as the export of B9


@pytest.mark.parametrize("size", [7, 200, 1 << 25])
def test_srt(sources, sf, tmp_path, size):
    cues = q.b8_export_srt(sources, sf).where("episode < 3")
    parts = F.split("line", "\n")
    ms = lambda c: sum((F.substring(c, a, n).cast("long") * f for a, n, f in ((1, 2, 3_600_000), (4, 2, 60_000), (7, 2, 1_000), (10, 3, 1))), F.lit(0))
    times = F.element_at(parts, 2)
    rows = cues.select("n", ms(times).alias("start_ms"), ms(F.substring(times, 18, 12)).alias("end_ms"), F.element_at(parts, 3).alias("text")).repartition(2)
    rows.write.format("srt").mode("append").save(f"{tmp_path}/x")
    back = sources.read.format("srt").option("range", size).load(f"{tmp_path}/x")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    text = "\n".join((tmp_path / "x" / f).read_text() for f in folder(tmp_path, ".srt"))
    assert all(r.line in text for r in cues.limit(50).collect())  # as the export of B8 writes them


def test_append_overwrite_and_what_is_not_listed(sources, tmp_path):
    rows = sources.createDataFrame([("e", "a", 0, 10), ("e", "é", 5, 1_234_567)], "episode string, speaker string, start_ms long, end_ms long")
    path = f"{tmp_path}/x"
    save = lambda d, mode: d.write.format("rttm").mode(mode).save(path)
    save(rows, "append")
    save(rows, "append")
    (tmp_path / "x" / "part-of-a-lost-task.rttm").write_text("SPEAKER")
    assert sources.read.format("rttm").load(path).count() == 4
    save(rows.limit(1), "overwrite")
    assert sources.read.format("rttm").load(path).count() == 1
    save(rows.where("false"), "overwrite")
    assert sources.read.format("rttm").load(path).count() == 0


def test_a_failing_task_leaves_nothing(sources, tmp_path):
    good = sources.range(200).selectExpr("'e' AS episode", "'a' AS speaker", "id AS start_ms", "id + 1 AS end_ms")
    bad = good.unionByName(sources.sql("SELECT 'e f' AS episode, 'a' AS speaker, 0L AS start_ms, 1L AS end_ms"))
    good.write.format("rttm").mode("append").save(f"{tmp_path}/x")
    with pytest.raises(Exception, match="white space"):
        bad.write.format("rttm").mode("append").save(f"{tmp_path}/x")
    assert sources.read.format("rttm").load(f"{tmp_path}/x").count() == 200
    assert not [f for f in os.listdir(tmp_path / "x") if f.startswith("_") and f != LISTED]


def test_files_of_others(sources, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\nuno\ndue\n\n2\n01:00:00.000 --> 01:00:00.001\nè")
    got = sorted(map(tuple, sources.read.format("srt").load(f"{tmp_path}/x").collect()))
    assert got == [(1, 1_000, 2_500, "uno\ndue"), (2, 3_600_000, 3_600_001, "è")]
    (tmp_path / "x" / "b.srt").write_text("no cue\n\n")
    with pytest.raises(Exception, match="not a cue"):
        sources.read.format("srt").load(f"{tmp_path}/x").collect()
