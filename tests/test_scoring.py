"""Document scores on small documents with known answers."""

from lorekeep.operators import scoring


def frames(spark, rows, kind):
    if kind == "words":
        return spark.createDataFrame([("e", i, s, t, a, b) for i, (s, t, a, b) in enumerate(rows)], "source string, word_id long, speaker string, text string, start_ms long, end_ms long")
    return spark.createDataFrame([("e", *r) for r in rows], "source string, speaker string, start_ms long, end_ms long")


def test_evaluate(spark):
    ref = frames(spark, [("A", "Uno,", 0, 100), ("A", "due", 100, 200), ("B", "tre", 200, 300), ("B", "quattro", 300, 400)], "words")
    hyp = frames(spark, [("X", "uno", 0, 100), ("X", "due", 100, 200), ("X", "tre", 200, 300), ("Y", "cinque", 300, 400)], "words")
    rt = frames(spark, [("A", 0, 200), ("B", 200, 400)], "turns")
    ht = frames(spark, [("X", 0, 300), ("Y", 300, 400)], "turns")
    r = scoring.evaluate(ref, hyp, rt, ht, spark.createDataFrame([("e", 4)], "source string, timings long"), 1000).first()
    assert (r.substitutions, r.deletions, r.insertions, r.ref_words, r.wer) == (1, 0, 0, 4, 0.25)
    assert (r.ref_ms, r.missed_ms, r.false_ms, r.confused_ms, r.der, r.speaker_count_error) == (400, 0, 0, 100, 0.25, 0)
    assert (r.sa_errors, r.sa_wer, r.unassigned_rate) == (3, 0.75, 0.0)  # tre is inserted for A; of B's two one is lost, one is wrong
    assert (r.cp_errors, r.cp_total) == (3, 4)
    assert r.verdict == "insufficient_evidence"
    gated = lambda n, g: scoring.evaluate(ref, hyp, rt, ht, spark.createDataFrame([("e", n, g)], "source string, timings long, gates boolean"), 1000).first().verdict
    assert (gated(200, True), gated(200, None), gated(199, True)) == ("pass", "insufficient_evidence", "insufficient_evidence")


def test_unmapped_words_and_missing_hypothesis(spark):
    ref = frames(spark, [("A", "uno", 0, 100)], "words")
    hyp = frames(spark, [("X", "uno", 0, 100), ("Z", "altro", 500, 600)], "words")
    maps = spark.createDataFrame([("e", "X", "A")], "source string, hyp_label string, ref_label string")
    r = scoring.speaker_word_scores(ref, hyp, maps).first()
    assert (r.sa_errors, r.unassigned_rate) == (1, 0.5)
    assert scoring.word_scores(ref, hyp.limit(0)).first().wer == 1.0
    silent = spark.createDataFrame([("e", "X", "A"), ("e", "Z", "Q")], "source string, hyp_label string, ref_label string")
    assert scoring.speaker_word_scores(ref, hyp, silent).first().unassigned_rate == 0.5  # Q says nothing


def test_slices(spark):
    got = {r.slice: (r.start_ms, r.end_ms) for r in scoring.slice_catalog(spark.createDataFrame([("e", 11)], "source string, duration_ms long")).collect()}
    assert got == {"all": (0, 11), "block-0": (0, 2), "block-1": (2, 4), "block-2": (4, 6), "block-3": (6, 8), "block-4": (8, 11), "development": (0, 8), "held_out": (8, 11)}
