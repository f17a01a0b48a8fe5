"""Publication in two phases: whole or not at all, once, and told from what is incomplete or corrupt."""

import hashlib
import json
import os

import pytest

from lorekeep.sources import artifacts


def _states(spark, root, **options):
    return {r.artifact_id: (r.state, r.files) for r in artifacts.artifact_states(spark, root, **options).collect()}


def test_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    at = artifacts.publish_artifact(spark.range(3), root, "x/y")
    assert artifacts.publish_artifact(spark.range(9), root, "x/y") == at and spark.read.parquet(at).count() == 3
    listed = json.loads((tmp_path / "x/y/manifest.json").read_text())["files"]
    found = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / "x/y/data").glob("part-*")}
    assert {k: v["sha256"] for k, v in listed.items()} == found
    assert not os.listdir(tmp_path / ".staging")
    with pytest.raises(ValueError):
        artifacts.publish_artifact(spark.range(3), root, "../y")


def test_crash_between_the_phases(spark, tmp_path, monkeypatch):
    root, rename = f"file://{tmp_path}", artifacts._rename

    def crash(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(artifacts, "_rename", crash)
    with pytest.raises(RuntimeError):
        artifacts.publish_artifact(spark.range(3), root, "a")
    assert not (tmp_path / "a").exists() and _states(spark, root) == {}  # what was staged is no artifact
    monkeypatch.setattr(artifacts, "_rename", rename)
    assert spark.read.parquet(artifacts.publish_artifact(spark.range(4), root, "a")).count() == 4
    assert _states(spark, root)["a"][0] == "complete"


def test_race(spark, tmp_path, monkeypatch):
    root, scan = f"file://{tmp_path}", artifacts.scan_binary
    inner = []

    def other_wins(*a):
        if not inner:
            inner.append(1)
            artifacts.publish_artifact(spark.range(7), root, "r")
        return scan(*a)

    monkeypatch.setattr(artifacts, "scan_binary", other_wins)
    assert spark.read.parquet(artifacts.publish_artifact(spark.range(3), root, "r")).count() == 7
    assert {n for n in os.listdir(tmp_path / "r") if not n.startswith(".")} == {"data", "manifest.json"}


def test_states_and_reconciliation(spark, tmp_path):
    root = f"file://{tmp_path}"
    for key in ("good", "known", "cut", "changed"):
        artifacts.publish_artifact(spark.range(50).coalesce(2), root, key)
    spark.range(5).write.parquet(f"{root}/bare/data")
    part = next((tmp_path / "cut/data").glob("part-*"))
    part.write_bytes(part.read_bytes()[:-1])
    part = next((tmp_path / "changed/data").glob("part-*"))
    part.write_bytes(part.read_bytes()[:-1] + b"?")
    assert {k: s for k, (s, _) in _states(spark, root).items()} == {"good": "complete", "known": "complete", "changed": "complete", "cut": "corrupt", "bare": "incomplete"}
    assert _states(spark, root, verify=True)["changed"][0] == "corrupt"
    left = artifacts.unregistered(spark, root, spark.createDataFrame([("known",), ("changed",)], "artifact_id string"))
    assert [r.artifact_id for r in left.collect()] == ["good"]
    # debris without a manifest is put aside, and the artifact takes its place
    assert spark.read.parquet(artifacts.publish_artifact(spark.range(8), root, "bare")).count() == 8
    assert _states(spark, root)["bare"][0] == "complete"
