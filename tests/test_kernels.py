"""Known answers of the sequential kernels, sources, sinks and streams."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.operators import aggregates as ag
from lorekeep.operators import alignment as al
from lorekeep.operators import history as hi
from lorekeep.operators import intervals as iv
from lorekeep.operators import joins, search
from lorekeep.operators import segmentation as sg
from lorekeep.operators import stages
from lorekeep.operators.vectors import greedy_pairs
from lorekeep.plans.views import speaker_turns, words
from lorekeep.sources import artifacts, io
from lorekeep.streaming import incremental as inc


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_edit_counts():
    assert al.edit_counts("uno due".split(), "uno tre".split()) == (1, 0, 0)
    assert al.edit_counts("uno due".split(), ["uno"]) == (0, 1, 0)
    assert al.edit_counts(["uno"], "uno due".split()) == (0, 0, 1)
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        ops = al.align(a, b)
        assert sum(o != "equal" for o, _, _ in ops) == lev(a, b) == sum(al.edit_counts(a, b))
    long = [str(i) for i in range(10_000)]
    assert al.edit_counts(long, [*long[:5000], "x", *long[5001:]]) == (1, 0, 0)


def test_orc_and_cpwer():
    assert al.orc_errors([["a", "b"], ["c"]], ["a", "c", "b"])[0] == 0
    assert al.orc_errors([["a", "b"], ["c"]], ["b", "a", "c"])[0] == 2
    assert al.cpwer({"A": ["uno"], "B": ["due"]}, {"X": ["due"], "Y": ["due"]})["value"] == 0.5
    assert al.cpwer({"A": ["uno"], "B": ["due"]}, {"X": ["uno"], "Y": ["tre"]})["value"] == 0.5
    got = al.cpwer({"A": ["uno"], "B": ["due"]}, {"X": ["due"], "Y": ["uno"]})
    assert got["errors"] == 0 and got["mapping"] == {"X": "B", "Y": "A"}
    got = al.cpwer({"A": ["uno", "due"], "B": ["tre", "quattro"]}, {"X": ["uno", "due"], "Y": ["tre"]})
    assert (got["value"], got["deletions"]) == (0.25, 1)
    assert al.cpwer({}, {"X": ["a"]})["value"] is None


def test_assignment_and_speaker_map():
    rng = np.random.default_rng(2)
    for n in range(1, 6):
        cost = rng.integers(0, 4, (n, n)).astype(float)
        total, chosen = al.best_assignment(cost)
        options = {p: sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(n))}
        least = min(options.values())
        assert total == least == al._solve(cost) and tuple(chosen) == min(p for p, v in options.items() if v == least)
    assert al.speaker_map({("X", "A"): 5, ("X", "B"): 9, ("Y", "B"): 8}) == {"X": "A", "Y": "B"}
    assert al.speaker_map({("X", "A"): 0}) == {"X": None}
    assert al.speaker_map({("X", "A"): 3, ("X", "B"): 3}) == {"X": "B"}
    many = {(f"h{i:02}", f"r{i:02}"): 1000 for i in range(23)}
    assert al.speaker_map(many) == {h: r for h, r in many}


def turns_frame(spark, rows):
    return spark.createDataFrame([("e", *r) for r in rows], "episode string, speaker string, start_ms long, end_ms long")


def der(spark, ref, hyp):
    r, h = turns_frame(spark, ref), turns_frame(spark, hyp)
    row = al.diarization_sums(al.duration_events(r, h, ["episode"], "speaker", 60_000), ["episode"]).first()
    return (row.missed_ms + row.false_ms + row.confused_ms) / row.ref_ms


def test_der(spark):
    assert der(spark, [("A", 0, 1000), ("B", 0, 1000)], [("A", 0, 1000)]) == 0.5
    assert der(spark, [("A", 0, 1000), ("B", 1000, 2000)], [("A", 0, 2000)]) == 0.5


def test_attribution(spark):
    w = spark.createDataFrame([("e", i, s, t) for i, (s, t) in enumerate([(0, 200), (150, 350), (100, 200), (400, 450), (500, 700)])], "episode string, word_id long, start_ms long, end_ms long")
    t = turns_frame(spark, [("B", 0, 100), ("A", 100, 250), ("C", 250, 400), ("D", 50, 150), ("A", 500, 600), ("B", 600, 700)])
    got = {r.word_id: r.attributed for r in joins.attribute_words(w, t, ["episode"], 100).collect()}
    assert got == {0: "A", 1: "C", 2: "A", 3: None, 4: "B"}
    tie = joins.attribute_words(w.where("word_id = 2"), turns_frame(spark, [("Z", 90, 140), ("A", 160, 210)]), ["episode"], 1000).first()
    assert tie.attributed == "A"


def test_text_chunks(spark):
    rows = [(1, i, "A", f"w{i}", i * 100, i * 100 + 100) for i in range(201)] + [(1, 201, None, "x", 60_000, 60_100), (1, 202, None, "y", 121_000, 121_100)]
    frame = spark.createDataFrame(rows, "episode long, word_id long, speaker string, text string, start_ms long, end_ms long")
    got = sg.text_chunks(frame).orderBy("start_ms").collect()
    assert [(r.n, r.speaker) for r in got] == [(200, "A"), (1, "A"), (1, None), (1, None)]
    assert len({r.chunk_id for r in got}) == 4


def test_exemplars(spark):
    t = turns_frame(spark, [("A", 0, 20_000), ("B", 9_000, 11_000), ("C", 22_000, 24_000)])
    got = [(r.speaker, r.start_ms, r.end_ms) for r in sg.exemplars(t, 60_000).orderBy("start_ms").collect()]
    assert got == [("A", 250, 8_750), ("A", 11_250, 19_750)]
    cut = [(r.start_ms, r.end_ms, r.rank) for r in sg.exemplars(turns_frame(spark, [("A", 0, 40_500)]), 60_000).orderBy("rank").collect()]
    assert cut == [(26_916, 40_250, 1), (250, 13_583, 2), (13_583, 26_916, 3)]


def test_segmentation():
    assert sg.segment_native(0, 40_000, [])[0] == (30_000, "hard_maximum")
    assert sg.segment_native(0, 40_000, [(11_400, "speaker_change")])[0] == (11_400, "speaker_change")
    assert sg.segment_native(0, 12_000, [(9_000, "strong_pause")]) == [(12_000, "end")]
    assert sg.segment_community(0, 50_000, [(11_000, 2, True), (14_000, 1, True), (29_000, 1, True)])[0] == (14_000, "preferred")
    assert sg.segment_community(0, 33_000, [(27_000, 1, True)]) == [(27_000, "extension"), (33_000, "end")]
    assert sg.segment_community(0, 31_000, [(12_000, 3, False), (29_000, 1, True)]) == [(29_000, "extension"), (31_000, "end")]
    assert sg.segment_legacy(0, 35_000, [(12_500, "turn", 0.5), (17_000, "silence", 0.5)])[0] == (17_000, "silence")
    assert sg.segment_legacy(0, 35_000, [])[0] == (27_000, "hard_maximum")
    near = [(11_000, "strong_pause"), (11_200, "speaker_change")]
    assert sg.segment_native(0, 40_000, near)[0] == (11_000, "strong_pause")
    assert sg.segment_native(0, 40_000, [(7_900, "short_pause"), (8_100, "speaker_change")])[0] == (8_100, "speaker_change")  # the pause is out of reach
    cuts = sg.segment_native(0, 200_000, [(t, "short_pause") for t in range(5_000, 200_000, 7_000)], [(10_000, 14_000)])
    assert all(b - a <= 30_000 for (a, _), (b, _) in itertools.pairwise([(0, ""), *cuts]))


def test_native_candidates(spark):
    """Turns A 0-10 s and B 12-20 s: the change at 12 s is a second from the pause's midpoint."""
    t = turns_frame(spark, [("A", 0, 10_000), ("B", 12_000, 20_000)])
    got = [(r.t, r.kind) for r in sg.native_candidates(t, t, ["episode"], 60_000).orderBy("t").collect()]
    assert got == [(11_000, "strong_pause"), (12_000, "speaker_change")]
    t = turns_frame(spark, [("A", 0, 10_000), ("B", 10_300, 20_000)])
    got = [(r.t, r.kind) for r in sg.native_candidates(t, t, ["episode"], 60_000).orderBy("t").collect()]
    assert got == [(10_150, "short_pause_and_speaker_change")]
    assert [sg.overlap_cost(t, [(10_000, 11_000)]) for t in (9_750, 9_751, 10_000, 10_999, 11_000, 11_249, 11_250)] == [0, 0.75, 1.5, 1.5, 0.75, 0.75, 0]


def test_speaker_conditions(spark):
    """Known answers for partial, heavy and no overlap."""
    one = lambda rows: iv.speaker_condition(turns_frame(spark, rows), ["episode"], "speaker", 60_000).first()
    r = one([("A", 3_000, 8_000), ("B", 4_000, 5_000)])
    assert (r.kind, r.speech_ms, r.overlap_ms, r.overlap_fraction, r.most, r.labels) == ("partial_overlap", 5_000, 1_000, 0.2, 2, 2)
    r = one([("A", 0, 8_000), ("B", 2_000, 6_000), ("C", 3_000, 5_000)])
    assert (r.kind, r.most, r.overlap_ms, r.overlap_fraction) == ("heavy_overlap", 3, 4_000, 0.5)
    assert one([("A", 0, 10), ("B", 10, 20)]).kind == "multi_speaker_no_overlap" and one([("A", 0, 10), ("A", 5, 20)]).kind == "single_speaker"
    assert one([("A", 5, 5)]).kind == "uncertain"


def test_signal(spark):
    """Silence has the floor of -240 dB, an empty signal -120; a sample that isn't finite fails."""
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, []), (3, [1.0, -1.0])], "i int, s array<double>")
    got = {r.i: tuple(r)[1:] for r in rows.select("i", *ag.signal_stats(None, "s")).collect()}
    assert got == {1: (0.0, -240.0, -240.0, 1.0), 2: (0.0, -120.0, -120.0, 1.0), 3: (1.0, 0.0, 0.0, 0.0)}
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="finite"):
            spark.createDataFrame([([0.1, bad],)], "s array<double>").select(*ag.signal_stats(None, "s")).collect()


def test_alignment_is_least_and_whole(monkeypatch):
    rng = random.Random(4)
    for cells in (4_096, 6):
        monkeypatch.setattr(al, "BLOCK_CELLS", cells)
        for _ in range(200):
            ref, hyp = (rng.choices("abc", k=rng.randrange(14)) for _ in range(2))
            ops = al.align(ref, hyp)
            assert sum(o != "equal" for o, _, _ in ops) == lev(ref, hyp)
            assert [i for o, i, _ in ops if o != "insert"] == list(range(len(ref))) and [j for o, _, j in ops if o != "delete"] == list(range(len(hyp)))
            assert all((ref[i] == hyp[j]) == (o == "equal") for o, i, j in ops if o in ("equal", "substitute"))
    monkeypatch.setattr(al, "BLOCK_CELLS", 4_096)
    words = [str(i % 977) for i in range(10_000)]
    assert al.edit_counts(words, [*words[:5_000], "x", *words[5_001:]]) == (1, 0, 0)
    s, d, i = al.edit_counts(words[:6_000], words[300:6_100:2] + words[:100])
    assert s + d + i >= 2_900 and d - i == 6_000 - 2_900 - 100


def test_assignment_of_many_rows():
    """Of equal totals the lowest columns in order of rows, as for few rows."""
    rng = random.Random(2)
    for n in (3, 5):
        cost = np.array([[rng.randrange(3) for _ in range(n)] for _ in range(n)], float)
        least = min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(n)))
        want = next(list(p) for p in itertools.permutations(range(n)) if sum(cost[i, c] for i, c in enumerate(p)) == least)
        assert al.best_assignment(cost) == (least, want) and al._first_columns(cost, least) == want
    assert al.best_assignment(1.0 - np.eye(24))[1] == list(range(24))
    assert al.cpwer({f"s{i:02}": ["w", str(i)] for i in range(23)}, {f"h{i:02}": ["w", str(i)] for i in range(23)})["errors"] == 0


def test_stages_and_greedy():
    assert stages.downstream(["diarization"]) >= {"attribution", "exemplars", "chunks", "text_index", "voice_indexes", "candidates"}
    assert stages.reusable(["asr", "chunks", "decode"], ["asr"]) == {"decode"}
    with pytest.raises(ValueError):
        stages.downstream(["nothing"])
    assert greedy_pairs(np.array([[1.0, 0.0], [1.0, 0.0]]), ["q0", "q1"], ["c0", "c1"]) == [("q0", "c0", 1.0), ("q1", "c1", 0.0)]


def test_search(spark):
    docs = spark.createDataFrame([("c2", "Mario Rossi parla"), ("c1", "Mario Rossi parla"), ("c3", "Mario Bianchi parla")], "doc_id string, text string")
    for q in ('"Mario Rossi"', "Mario-Rossi"):
        assert sorted(r.doc_id for r in search.search(docs, q).collect()) == ["c1", "c2"]
    assert [r.doc_id for r in search.search(docs, "Mario", where=F.col("doc_id") == "c1").collect()] == ["c1"]
    for q in ("Mario*", '"Mario', '""', "", "x" * 300):
        with pytest.raises(ValueError):
            search.parse_query(q)


def test_text_functions(spark):
    assert tx.normalize_exact("Città, STRASSEß  l'é") == "città strassess l é"
    row = spark.sql("SELECT 3723004L AS ms, '1.0005' AS s, '2026-02-30' AS d").select(tx.timestamp("ms"), tx.rttm_seconds("ms"), tx.seconds_to_ms("s"), tx.valid_iso_date("d")).first()
    assert tuple(row) == ("01:02:03,004", "3723.004", 1001, False)
    assert tx.canonical_json({"b": 1, "a": ["é"]}) == '{"a":["é"],"b":1}' and len(tx.fingerprint({})) == 64


def test_sources_and_sinks(spark, tmp_path, sf):
    for bad in ("/etc", "a/../b", "a\\b", "", "a//b"):
        with pytest.raises(ValueError):
            io.safe_relative(bad)
    import json

    (tmp_path / "m.json").write_text(json.dumps({"schema_version": 1, "episodes": [{"relative_filename": f"{i}.mp3", "episode_date": "2026-01-02", "duration_ms": i + 1, "size_bytes": 5, "sha256": "ab" * 32} for i in range(20)]}))
    assert io.read_manifest(spark, f"file://{tmp_path}/m.json").count() == 20
    scanned = artifacts.scan_binary(spark, f"file://{tmp_path}", "*.json").first()
    import hashlib

    assert scanned.sha256 == hashlib.sha256((tmp_path / "m.json").read_bytes()).hexdigest() and scanned.name == "m.json"
    w = words(spark, sf).withColumn("overlap", F.lit(False))
    first = io.export_lines(w, "srt").where("n = 1").first().line
    assert first.startswith("1\n00:00:00,000 --> 00:00:00,250\n[")
    io.write_export(io.export_lines(w, "vtt"), f"file://{tmp_path}/vtt")
    assert spark.read.text(f"file://{tmp_path}/vtt").count() > 0
    assert io.export_rttm(speaker_turns(w)).first().line.startswith("SPEAKER ")
    a = artifacts.publish_artifact(spark.range(3), f"file://{tmp_path}", "x/y")
    artifacts.publish_artifact(spark.range(9), f"file://{tmp_path}", "x/y")
    assert spark.read.parquet(a).count() == 3
    io.publish_generation(spark.range(4), f"file://{tmp_path}/g", "voice", "g1", 4)
    assert [tuple(r) for r in io.publish_generation(spark.range(5), f"file://{tmp_path}/g", "voice", "g2", 5).collect()] == [("voice", "g2")]
    with pytest.raises(ValueError):
        io.publish_generation(spark.range(4), f"file://{tmp_path}/g", "voice", "g3", 9)
    doc = {"source_sha256": "a", "duration_ms": 9, "words": [{"word_id": "1", "text": "x", "start_ms": 0, "end_ms": 5}], "turns": [{"speaker_id": "A", "start_ms": 0, "end_ms": 5}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    assert [d.count() for d in io.read_evaluation(spark, f"file://{tmp_path}/d.json")] == [1, 1, 0]
    sub = spark.createDataFrame([("e", i, t, i * 10, i * 10 + 10) for i, t in enumerate([" he", "llo", " wor", "ld", " gone"])], "episode string, i long, text string, start_ms long, end_ms long")
    assert [r.text for r in io.assemble_words(sub, 40).orderBy("word").collect()] == ["hello", "world"]


def run_stream(spark, df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"file://{tmp_path}/ev")
    stream = inc.read_stream(spark, f"file://{tmp_path}/ev")
    got = run_stream(spark, inc.windowed_counts(stream), "complete", "wc")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, inc.windowed_counts(events).collect()))
    got = run_stream(spark, inc.latest_revisions(stream), "update", "lr")
    top = got.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "n"), "n").alias("x")).select("user_id", "x.*")
    want = hi.latest(events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).join(events.groupBy("user_id").count(), "user_id")
    assert sorted(map(tuple, top.collect())) == sorted((r.user_id, r.event_id, r.event_type, r["count"]) for r in want.collect())
    assert inc.sessions(events).count() > 0 and inc.unique_events(events).count() == events.count()
