"""Scores by slice against known answers."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import alignment as al
from lorekeep.operators import evaluation as ev


def words(spark, rows, source="e"):
    return spark.createDataFrame([(source, i, *r) for i, r in enumerate(rows)], "source string, word_id long, speaker string, text string, start_ms long, end_ms long")


def turns(spark, rows):
    return spark.createDataFrame([("e", *r) for r in rows], "source string, speaker string, start_ms long, end_ms long")


def spans(spark, rows, kind="slice string"):
    return spark.createDataFrame([("e", *r) for r in rows], f"source string, {kind}, start_ms long, end_ms long" if kind else "source string, start_ms long, end_ms long")


def scored(spark, ref, hyp, **more):
    return ev.score_diarization(turns(spark, ref), turns(spark, hyp), spans(spark, [("all", 0, 2_000)]), 60_000, **more).first()


def test_diarization_known_answers(spark):
    both = [("A", 0, 1_000), ("B", 0, 1_000)]
    none, ab = spans(spark, [], ""), spans(spark, [(0, 1_000)], "")
    r = scored(spark, both, [("A", 0, 1_000)], ref_overlaps=ab, hyp_overlaps=none)
    assert (r.der, r.jer, r.signed, r.absolute, r.precision, r.recall, r.f1, r.overlap_status) == (0.5, 0.5, -1, 1, None, 0.0, None, "scored")
    r = scored(spark, [("A", 0, 1_000), ("B", 1_000, 2_000)], [("X", 0, 2_000)], ref_overlaps=none, hyp_overlaps=none)
    assert (r.der, r.jer, r.signed, r.overlap_status, r.status) == (0.5, 0.75, -1, "insufficient_evidence", "scored")
    r = scored(spark, both, [("X", 500, 1_500), ("Y", 500, 1_500)], ref_overlaps=ab, hyp_overlaps=spans(spark, [(500, 1_500)], ""))
    assert (r.precision, r.recall, r.f1) == (0.5, 0.5, 0.5)
    r = scored(spark, both, both, ref_overlaps=ab, hyp_overlaps=ab, truth=spark.createDataFrame([], "source string"))
    assert (r.overlap_status, r.precision, r.f1, r.der) == ("not_available", None, None, 0.0)
    r = scored(spark, both, [], unscorable=spark.createDataFrame([("e",)], "source string"))
    assert (r.status, r.der, r.signed) == ("unscorable", None, None)
    assert scored(spark, [("A", 0, 1_000)], [("A", 100, 1_100)], collar_ms=250).der == 0.0 and scored(spark, [], [("A", 0, 10)]).status == "insufficient_evidence"


def test_text_and_timing_by_slice(spark):
    ref = words(spark, [("A", "Città,", 0, 100), ("A", "uno", 100, 200), ("B", "mumble", 200, 300), ("B", "tre", 900, 1_000)])
    hyp = words(spark, [("X", "città", 10, 120), ("X", "uno", 100, 230), ("Y", "sbagliato", 200, 300), ("Y", "quattro", 900, 1_000)])
    slices = spans(spark, [("all", 0, 1_000), ("head", 0, 150), ("tail", 850, 1_000), ("head", 120, 160)])
    masks = spans(spark, [(240, 250)], "")
    rt, ht = turns(spark, [("A", 0, 200), ("B", 200, 1_000)]), turns(spark, [("X", 0, 200), ("Y", 200, 1_000)])
    got = {r.slice: r for r in ev.evaluate_slices(ref, hyp, rt, ht, slices, 60_000, masks).collect()}
    r = got["all"]
    assert (r.raw_wer_total, r.raw_wer_errors, r.wer_errors, r.wer, r.cer_total) == (3, 2, 1, round(1 / 3, 6), len("città uno tre"))
    assert (r.matched, r.timed, r.coverage, r.start_median_ms, r.end_median_ms, r.all_median_ms) == (2, 3, round(2 / 3, 6), 5.0, 25.0, 15.0)
    assert (r.der, r.der_250, r.jer, r.signed, r.sa_errors, r.unassigned_rate) == (0.0, 0.0, 0.0, 0, 1, 0.0)
    assert (got["head"].wer_total, got["head"].wer, got["head"].matched) == (2, 0.5, 1) and (got["tail"].wer, got["tail"].coverage) == (1.0, 0.0)


def test_slices_and_names(spark):
    rows = spark.createDataFrame([("e", 10)], "source string, duration_ms long")
    got = ev.slice_ranges(rows, spans(spark, [("mine", 1, 2), ("all", 3, 4)]), spans(spark, [(5, 6), (7, 8)], ""), spans(spark, [(8, 9)], "")).collect()
    found = {}
    for r in got:
        found.setdefault(r.slice, []).append((r.start_ms, r.end_ms))
    assert found["all"] == [(0, 10)] and found["mine"] == [(1, 2)] and sorted(found["overlap"]) == [(5, 6), (7, 8)] and found["unintelligible"] == [(8, 9)] and len(found) == 11


def test_chunks_and_manifest(spark):
    chunks = spark.createDataFrame([(i, "all") for i in range(6)], "chunk_id long, slice string")
    refs = [(0, 1, "human_truth", "old text", None), (0, 2, "human_truth", "uno due", None), (1, 1, "human_truth", "ciao [mumble] mondo", [1]), (2, 1, "machine", "a b", None), (3, 1, "human_truth", "a b", [0]), (4, 1, "human_truth", "a b", [2]), (5, 1, "human_truth", "unused", None)]
    refs = spark.createDataFrame(refs, "chunk_id long, revision int, review_status string, ref_text string, ref_mask array<int>")
    hyps = [(0, "m", "uno tre", None), (1, "m", "ciao sbagliato mondo", [1]), (2, "m", "a b", None), (3, "m", "a b", None), (4, "m", "a b", [1])]
    hyps = spark.createDataFrame(hyps, "chunk_id long, model string, hyp_text string, hyp_mask array<int>")
    got = ev.score_manifest(chunks, refs, hyps)
    by = {r.chunk_id: r for r in got.collect()}
    assert (by[0].substitutions, by[0].wer, by[0].status) == (1, 0.5, "scored") and (by[1].wer, by[1].raw_wer, by[1].raw_wer_total) == (0.0, 0.0, 2)
    assert [by[i].status for i in (2, 3, 4)] == ["insufficient_evidence", "unscorable", "unscorable"] and by[3].wer is None
    r = ev.micro_average(got, ["model", "slice"], "wer_errors", "wer_total").first()
    assert (r.n, r.n_unscorable, r.n_insufficient, r.errors, r.total, r.rate, r.status) == (5, 2, 1, 1, 4, 0.25, "partial")
    status = lambda where: ev.micro_average(got.where(where), ["model"], "wer_errors", "wer_total").first().status
    assert (status("chunk_id = 2"), status("chunk_id IN (2, 3)"), status("chunk_id < 2")) == ("insufficient_evidence", "unscorable", "scored")
    with pytest.raises(Exception, match="no chunk or reference"):
        ev.score_manifest(chunks.where("chunk_id <> 1"), refs, hyps).collect()


def test_integrated(spark):
    ref = words(spark, [("A", "uno", 0, 1), ("B", "due", 1, 2)]).unionByName(words(spark, [("A", "x", 0, 1)], "f"))
    hyp = words(spark, [("X", "due", 0, 1), ("Y", "uno", 1, 2)]).unionByName(words(spark, [("X", "y", 0, 1)], "f"))
    got = {r.source: (r.cp_errors, r.cp_total, r.cpwer, r.status) for r in ev.score_integrated(ref, hyp).collect()}
    assert got == {"e": (0, 2, 0.0, "scored"), "f": (1, 1, 1.0, "scored"), None: (1, 3, round(1 / 3, 6), "scored")}
    ok = spark.createDataFrame([("e", True), ("f", False)], "source string, ok boolean")
    got = {r.source: (r.cp_errors, r.status) for r in ev.score_integrated(ref, hyp, ok).collect()}
    assert got == {"e": (0, "scored"), "f": (None, "unscorable"), None: (0, "partial")}
    assert F is not None


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def test_errors_of_texts_with_parts_left_out(spark):
    rng = random.Random(9)
    rows = []
    for k in range(120):
        ref = [rng.choice(["a", "ab", "ba", "è", "𝄞x"]) for _ in range(rng.randrange(14))]
        hyp = [w for w in ref if rng.random() < 0.7] if k % 3 else [rng.choice(["a", "ab", "è"]) for _ in range(rng.randrange(14))]
        rows.append((k, *((hyp, ref) if k % 2 else (ref, hyp))))
    frame = spark.createDataFrame(rows, "k long, r array<string>, h array<string>")
    for x in al.with_edit_counts(frame, {"n": ("r", "h")}, {"c": ("r", "h")}).collect():
        ops = [o for o, _, _ in al.align(x.r, x.h)]
        assert tuple(x.n) == tuple(ops.count(o) for o in ("substitute", "delete", "insert")) and sum(x.n) == brute_distance(x.r, x.h)
        assert x.c == brute_distance(" ".join(x.r), " ".join(x.h))


def test_character_errors_of_long_texts_are_not_counted_cell_by_cell(spark):
    rng = random.Random(10)
    ref = [f"{rng.randrange(10**6)}" for _ in range(20_000)]
    hyp = [w if i % 9 else w[::-1] for i, w in enumerate(ref)]
    start = time.perf_counter()
    r = ev.text_rates(spark.createDataFrame([(ref, hyp, ref, hyp)], "raw_r array<string>, raw_h array<string>, norm_r array<string>, norm_h array<string>")).first()
    assert 0 < r.cer_errors < r.cer_total and r.cer_total > 130_000 and time.perf_counter() - start < 45  # 2 * 10 ** 10 cells


def test_what_scores_of_slices_share_is_made_once(spark, monkeypatch):
    made = []
    for f in (al.duration_events, ev.scored_words):
        monkeypatch.setattr(al if f is al.duration_events else ev, f.__name__, lambda *a, f=f: made.append(f.__name__) or f(*a))
    w, t, s = words(spark, [("A", "uno", 0, 100)]), turns(spark, [("A", 0, 200)]), spans(spark, [("all", 0, 1_000), ("head", 0, 50)])
    assert ev.evaluate_slices(w, w, t, t, s, 60_000).where("wer = 0 AND der = 0 AND der_250 IS NULL").count() == 1
    assert sorted(made) == ["duration_events", "scored_words", "scored_words"]
