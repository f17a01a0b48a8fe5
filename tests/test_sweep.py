"""Sweeps over many turns at once: the sets and counts against brute force, and what moves grows with the turns, not their pairs."""

import random

import pyarrow as pa
import pytest
from lorekeep.operators import alignment as al
from lorekeep.operators import evaluation as ev
from lorekeep.operators import intervals as iv
from lorekeep.operators import joins
from lorekeep.operators import segmentation as sg

SCHEMA = "episode string, speaker string, start_ms long, end_ms long"


def shuffled(spark, rows) -> int:
    """Records that the stages of rows write to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def total() -> int:
        sc.listenerBus().waitUntilEmpty()
        gateway = spark.sparkContext._gateway
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    rows.write.format("noop").mode("overwrite").save()
    return total() - before


def brute(turns):
    """Segments of one episode, millisecond by millisecond."""
    found = []
    for t in range(min(s for _, s, _ in turns), max(e for _, _, e in turns)):
        on = {x for x, s, e in turns if s <= t < e}
        active = sorted(x for x in on if x is not None)
        if not on:
            continue
        if found and found[-1][1] == t and found[-1][2] == active:
            found[-1][1] = t + 1
        else:
            found.append([t, t + 1, active])
    return [tuple(x) for x in found]


@pytest.mark.parametrize("bucket", [7, 1000])
def test_segments_are_those_of_brute_force(spark, bucket):
    rng = random.Random(bucket)
    rows = []
    for k in range(6):
        for _ in range(25):
            s = rng.randrange(120)
            rows.append((f"e{k}", rng.choice(["a", "b", "c", "é", None]), s, s + rng.randrange(0, 20 if k % 2 else 6)))
    frame = spark.createDataFrame(rows, SCHEMA)
    got, counted, both = ({}, {}, {})
    for r in iv.segments(frame, ["episode"], "speaker", bucket).collect():
        got.setdefault(r.episode, []).append((r.start_ms, r.end_ms, list(r.active)))
    for r in iv.activity(frame, ["episode"], "speaker").collect():
        counted.setdefault(r.episode, []).append((r.start_ms, r.end_ms, r.n))
    for r in iv.overlap_intervals(frame, ["episode"], "speaker", bucket).collect():
        both.setdefault(r.episode, []).append((r.start_ms, r.end_ms, list(r.active)))
    for k in range(6):
        want = brute([(x, s, e) for name, x, s, e in rows if name == f"e{k}"])
        assert sorted(got[f"e{k}"]) == want
        assert sorted(counted[f"e{k}"]) == [(s, e, len(a)) for s, e, a in want]
        assert sorted(both.get(f"e{k}", [])) == [x for x in want if len(x[2]) > 1]


@pytest.fixture(scope="module")
def crowd(spark):
    """400 speakers, all of whom speak during the same ten minutes."""
    return spark.createDataFrame([("e", f"s{i:03}", i * 10, 600_000 + i * 10) for i in range(400)], SCHEMA).cache()


def test_crowds_move_as_edges(spark, crowd):
    """Pairs of segments and turns would be over 80,000 records."""
    by = ["episode"]
    lengths = crowd.groupBy("episode").agg({"end_ms": "max"}).toDF("episode", "duration_ms")
    for rows in (
        iv.segments(crowd, by, "speaker", 60_000), iv.speaker_condition(crowd, by, "speaker", 60_000), sg.community_boundaries(crowd, lengths, by, 60_000),
        sg.native_segments(crowd, crowd, by, 60_000), sg.exemplars(crowd, 60_000), al.duration_events(crowd, crowd, by, "speaker", 60_000),
    ):
        assert shuffled(spark, rows) < 25_000
    most = iv.speaker_condition(crowd, by, "speaker", 60_000).first()
    assert (most.speech_ms, most.overlap_ms, most.most, most.labels) == (603_990, 603_970, 400, 400)


def test_nearest_marks_without_a_frame_to_the_end(spark):
    """A frame up to the group's end is read anew at each row, so its time grows with the square of the group."""
    rng = random.Random(5)
    points = [("e", i, rng.randrange(3_000)) for i in range(300)]
    marks = sorted({rng.randrange(3_000) for _ in range(60)})
    found = joins.nearest_within(spark.createDataFrame(points, "episode string, point_id long, t long"), spark.createDataFrame([("e", m) for m in marks], "episode string, m long"), ["episode"], 40)
    assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString().lower()
    got = {r.point_id: r.nearest for r in found.collect()}
    for _, i, t in points:
        near = min(marks, key=lambda m: (abs(t - m), m))
        assert got[i] == (near if abs(t - near) <= 40 else None)


def test_scores_of_slices_move_as_edges(spark, crowd):
    """Turns against slices and free stretches would be over 500,000 records."""
    turns = crowd.selectExpr("episode AS source", "concat('s', CAST(substring(speaker, 2) AS INT) % 3) AS speaker", "start_ms", "end_ms")
    lengths = turns.groupBy("source").agg({"end_ms": "max"}).toDF("source", "duration_ms")
    found = ev.score_diarization(turns, turns, ev.slice_ranges(lengths), 60_000, 2)
    assert shuffled(spark, found) < 60_000
    whole = found.where("slice = 'all'").first()
    assert (whole.der, whole.jer, whole.ref_speakers) == (0.0, 0.0, 3)


def test_few_rows_are_python_objects_at_a_time():
    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    parts = list(al.sliced(batch))
    assert max(x.num_rows for x in parts) <= 32 and [v for x in parts for v in x.column(0).to_pylist()] == list(range(1000))
    assert list(al.sliced(batch.slice(0, 0))) == []


def test_exclusions_meet_only_what_they_name(spark, monkeypatch):
    """Overlaps of a crowd are joined in buckets that are short beside the turns, and are those of the plain product."""
    rows = [("e", f"s{k % 13}", 700 * k, 700 * k + 4_000 + 37 * (k % 5)) for k in range(300)]
    t = spark.createDataFrame(rows, "episode string, speaker string, start_ms long, end_ms long")
    sizes, join = [], sg.range_join
    monkeypatch.setattr(sg, "range_join", lambda a, b, by, ms: sizes.append(ms) or join(a, b, by, ms))
    got = sorted(tuple(r) for r in sg.exemplar_exclusions(t, 600_000).where("reason = 'overlap'").select("speaker", "start_ms", "end_ms").collect())
    assert min(sizes) <= 1_100
    own = [tuple(r) for r in iv.merge_ranges(t, ["speaker"]).collect()]
    both = [(max(0, r.start_ms - 250), r.end_ms + 250) for r in iv.activity(t, ["episode"], "speaker").where("n >= 2").collect()]
    assert got == sorted((s, max(a, c), min(b, d)) for s, a, b in own for c, d in both if a < d and c < b)


def test_maps_of_many_groups_are_made_in_batches(spark):
    from lorekeep.operators import scoring

    rows = [(k, 100 + k, ["a", "b"], ["x"]) for k in range(40)] + [(k, 90, ["b"], ["y", "x"]) for k in range(0, 40, 2)]
    events = spark.createDataFrame(rows, "source long, ms long, ref array<string>, hyp array<string>")
    maps = scoring.maps_of(events, ["source"], {"source": "long"})
    assert "InPandas" not in maps._jdf.queryExecution().executedPlan().toString()
    want = {(k, h, r) for k in range(40) for h, r in al.speaker_map({("x", "a"): 100 + k, ("x", "b"): 100 + k + (0 if k % 2 else 90)} | ({} if k % 2 else {("y", "b"): 90})).items() if r}
    assert {tuple(r) for r in maps.collect()} == want
