"""Faults of documents and artifacts, on small files."""

import json

import pytest
from pyspark.sql import functions as F

from lorekeep.sources import io


def test_artifacts_and_locks(spark):
    a, b = "a" * 64, "b" * 64
    manifests = spark.createDataFrame([("x", {"one": a, "two": a, "three": a})], "artifact_id string, file_checksums map<string,string>")
    files = spark.createDataFrame([("x", "one", a), ("x", "two", b), ("x", "four", a), ("x", "manifest.json", b)], "artifact_id string, name string, sha256 string")
    assert sorted((r.name, r.fault) for r in io.artifact_faults(manifests, files).collect()) == [("four", "unlisted"), ("three", "missing"), ("two", "corrupt")]
    locks = spark.createDataFrame([("m", "r", "c" * 40, {"f": a}), ("n", " ", "main", {}), ("o", "r", "d" * 40, {"f": "x", "g": a})], "name string, repository string, revision string, files map<string,string>")
    have = spark.createDataFrame([("m", "f", b), ("o", "f", "x")], "name string, file string, sha256 string")
    got = sorted((r.name, r.fault) for r in io.model_lock_faults(locks, have).collect())
    assert got == [("m", "changed f"), ("n", "no files"), ("n", "repository"), ("n", "revision"), ("o", "checksum"), ("o", "missing g")]


def test_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"source_sha256": "s", "turns": [{"speaker_id": "A", "start_ms": 0, "end_ms": 70}], "overlaps": []}))
    r = io.read_diarization(spark, f"file://{tmp_path}/d.json").first()
    assert (r.duration_ms, r.has_turns, r.has_overlaps, r.turns[0].end_ms) == (70, True, True, 70)
    (tmp_path / "e.json").write_text(json.dumps({"source_sha256": "s", "duration_ms": 9}))
    r = io.read_diarization(spark, f"file://{tmp_path}/e.json").first()
    assert (r.duration_ms, r.has_turns, r.has_overlaps) == (9, False, False)
    (tmp_path / "f.json").write_text(json.dumps({"source_sha256": "s"}))
    with pytest.raises(Exception, match="duration is needed"):
        io.read_diarization(spark, f"file://{tmp_path}/f.json").collect()
    words = [{"word_id": "1", "text": "x", "start_ms": 0, "end_ms": 5}, {"word_id": "1", "text": "y", "start_ms": 5, "end_ms": 5}]
    (tmp_path / "g.json").write_text(json.dumps({"source_sha256": "s", "duration_ms": 9, "time_origin_ms": 3, "words": words, "turns": [{"speaker_id": "A", "start_ms": 0, "end_ms": 10}], "overlap_intervals": [{"speaker_ids": ["A", "A"], "start_ms": 0, "end_ms": 5}]}))
    docs = spark.read.schema(io.EVALUATION).json(f"file://{tmp_path}/g.json", multiLine=True)
    got = sorted((r.kind, r.fault) for r in io.evaluation_faults(docs).collect())
    assert got == [("document", "time origin"), ("overlap_intervals", "fewer than two speakers"), ("turns", "beyond the duration"), ("words", "empty interval"), ("words", "repeated id")]
    (tmp_path / "v.json").write_text(json.dumps({"request_id": "q", "item_ids": ["a", "b"], "vectors": [[1, 2], [3, 4]]}))
    assert [(r.item_id, r.vector) for r in io.read_embeddings(spark, f"file://{tmp_path}/v.json", 2).collect()] == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    with pytest.raises(Exception, match="match"):
        io.read_embeddings(spark, f"file://{tmp_path}/v.json", 3).collect()
    io.write_report(spark.range(3), spark.range(1).select(F.lit(3).alias("n")), f"file://{tmp_path}/report", ["text"])
    assert spark.read.json(f"file://{tmp_path}/report/details").count() == 3
    with pytest.raises(ValueError):
        io.write_report(spark.range(3), spark.range(1).select(F.lit("x").alias("text")), f"file://{tmp_path}/report", ["text"])


def test_references(spark):
    words = [(str(i), i * 10, i * 10 + 10) for i in range(10)]
    kind = "episode_id string, source_sha256 string, duration_ms long, status string, actor_type string, reviewer string, reviewed_at string, words array<struct<word_id:string,start_ms:long,end_ms:long>>, reviewed_word_ids array<string>, manual_timing_word_ids array<string>"
    ids = [w[0] for w in words]
    refs = spark.createDataFrame([("e", "s", 100, "reviewed", "human", "Ada", "2026-01-01", words, ids, ids), ("f", "s", 90, "draft", "human", "machine", None, words, ids[1:], ["0", "q"])], kind)
    golden = spark.createDataFrame([("e", "s", 100), ("f", "t", 100)], "episode_id string, sha256 string, duration_ms long")
    got = sorted(r.fault for r in io.reference_faults(refs, golden, least=10).collect() if r.episode_id == "f")
    assert not [r for r in io.reference_faults(refs, golden, least=10).collect() if r.episode_id == "e"]
    assert got == ["a block without timed words", "duration differs", "not human-reviewed", "reviewed_at", "reviewer", "source differs", "too few timed words", "unknown timed word", "words not reviewed"]
