"""Optimal interleaving of reference streams against all interleavings, edit operations as a table function, and chunk
scores that are aggregated."""

import random
import sys
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import alignment as al
from lorekeep.operators import evaluation as ev
from lorekeep.plans import q_scoring as q


def interleavings(streams):
    turns = [k for k, s in enumerate(streams) for _ in s]
    for order in set(permutations(turns)):
        at = [0] * len(streams)
        out = []
        for k in order:
            out.append(streams[k][at[k]])
            at[k] += 1
        yield out


def plain(ref, hyp):
    """Least (errors, S, D, I) of two lists, by the whole table."""
    row = [(j, 0, 0, j) for j in range(len(hyp) + 1)]
    for i, a in enumerate(ref):
        new = [(i + 1, 0, i + 1, 0)]
        for j, b in enumerate(hyp):
            e, s, d, n = row[j]
            x = a != b
            options = [(e + x, s + x, d, n)]
            e, s, d, n = row[j + 1]
            options.append((e + 1, s, d + 1, n))
            e, s, d, n = new[j]
            options.append((e + 1, s, d, n + 1))
            new.append(min(options))
        row = new
    return row[-1]


def test_equals_all_interleavings():
    rng = random.Random(2)
    for _ in range(400):
        streams = [[rng.choice("abcd") for _ in range(rng.randrange(4))] for _ in range(rng.randrange(1, 4))]
        hyp = [rng.choice("abcde") for _ in range(rng.randrange(9))]
        want = min((plain(r, hyp) for r in interleavings(streams)), default=plain([], hyp))
        assert al.orc_errors(streams, hyp) == want, (streams, hyp)


def test_long_streams():
    rng = random.Random(5)
    a, b = ([f"w{rng.randrange(300)}" for _ in range(n)] for n in (260, 220))
    mixed, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if j == len(b) or (i < len(a) and rng.random() < 0.5):
            mixed.append(a[i])
            i += 1
        else:
            mixed.append(b[j])
            j += 1
    assert al.orc_errors([a, b], mixed) == (0, 0, 0, 0)
    heard = [w for k, w in enumerate(mixed) if k % 40] + ["extra"]
    assert al.orc_errors([a, b], heard)[0] == 13
    one = al.orc_errors([a], b)
    assert one == plain(a, b)


def test_too_large_is_said(spark):
    rows = spark.createDataFrame([(1, [["a"] * 60, ["b"] * 60], ["c"] * 100), (2, [["a"], None], ["a"]), (3, None, ["a"]), (4, [[]], None), (5, [["a"]], None)], "id int, s array<array<string>>, h array<string>")
    got = {r.id: (r.orc.status, r.orc.errors, r.orc.total) for r in al.with_orc(rows, "s", "h", cells=10_000).collect()}
    assert got == {1: ("too_large", None, 120), 2: ("scored", 0, 1), 3: ("not_applicable", None, None), 4: ("not_applicable", None, None), 5: ("scored", 1, 1)}


def test_edit_ops_in_sql(spark, sf):
    q._pairs(spark, sf).createOrReplaceTempView("pairs")
    al.register_edit_ops(spark)
    ops = spark.sql("SELECT conv_id, turn, op, count(*) AS n FROM pairs, LATERAL edit_ops(ref, hyp) GROUP BY ALL").collect()
    got: dict = {}
    for r in ops:
        got.setdefault((r.conv_id, r.turn), Counter())[r.op] = r.n
    want = {(r.conv_id, r.turn): (r.substitutions, r.deletions, r.insertions, r.ref_words) for r in q.j1_word_errors(spark, sf).collect()}
    assert got and all((c["substitute"], c["delete"], c["insert"], c["equal"] + c["substitute"] + c["delete"]) == want[k] for k, c in got.items())
    assert set(want) - set(got) == {k for k, v in want.items() if not any(v)}


@pytest.mark.parametrize("path", [None, "parquet"])
def test_chunk_scores_are_aggregated(spark, sf, tmp_path, path):
    chunks, refs, hyps = q._manifest(spark, sf)
    rows = ev.score_manifest(chunks, refs, hyps)
    if path:
        rows.write.parquet(f"file://{tmp_path}/scores")
        rows = spark.read.parquet(f"file://{tmp_path}/scores")
    total = ev.micro_average(rows, ["model", "role"], "wer_errors", "wer_total")
    lists = rows.where("status = 'scored'").groupBy("model", "role").agg(F.sum("wer_errors").alias("e")).collect()
    assert {(r.model, r.role): r.errors for r in total.collect() if r.errors is not None} == {(r.model, r.role): r.e for r in lists}


def test_chunks_with_streams(spark):
    s = lambda *t: [(x, None) for x in t]
    rows = [
        (1, "human_truth", "a b c d", "a c b d", None, None, s("a b", "c d"), None), (2, "human_truth", "a b", "x", None, None, None, None), (3, "machine", "a", "a", None, None, s("a"), None),
        (4, "human_truth", "a b", "a", None, None, [("a b", [1])], [("a", None)]), (5, "human_truth", "a b", "a z", None, None, [("a b", [1])], [("a z", [1])]),
        (6, "human_truth", "a b", "zz", None, None, s("A, b"), s("a", "c")), (7, "human_truth", "a", "a", None, None, [("a", [3])], [("a", [0])]), (8, "human_truth", "a", "a", None, None, s("..."), None),
    ]
    stream = "array<struct<text:string,mask:array<int>>>"
    frame = spark.createDataFrame(rows, f"chunk_id long, review_status string, ref_text string, hyp_text string, ref_mask array<int>, hyp_mask array<int>, ref_streams {stream}, hyp_streams {stream}")
    got = {r.chunk_id: (r.orc_status, r.orc_errors, r.orc_total) for r in ev.score_chunks(frame).collect()}
    none = (None, None)
    assert got == {1: ("scored", 0, 4), 2: ("not_applicable", *none), 3: ("insufficient_evidence", *none), 4: ("unscorable", *none), 5: ("scored", 0, 1), 6: ("scored", 1, 2), 7: ("unscorable", *none), 8: ("not_applicable", *none)}


def test_overlapped_conversations(spark, sf):
    """Interleaving forgives order, so it never has more errors than the text; what was lost stays lost."""
    rows = q.j4_orc_wer(spark, sf).collect()
    scored = [r for r in rows if r.orc_status == "scored"]
    assert scored and {r.orc_status for r in rows} <= {"scored", "insufficient_evidence"}
    assert all(r.orc_errors <= r.wer_errors and r.orc_errors == r.orc_deletions and r.orc_total == r.wer_total for r in scored)


def test_places_are_walked_in_layers(spark, sf):
    """The work in Python grows with the words, not with the places; of a chunk's scores only those asked for are made."""
    rng = random.Random(3)
    a, b = ([rng.choice("abcdefgh") for _ in range(n)] for n in (90, 40))
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        got = al.orc_errors([a, b], a + b)
    finally:
        sys.setprofile(None)
    assert got == (0, 0, 0, 0) and calls.total() < 60 * 131
    assert "levenshtein" not in q.j4_orc_wer(spark, sf)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_counts_of_few_pairs():
    """Channels are compared by distance; operations are counted for the pairs that are chosen."""
    rng = random.Random(4)
    side = lambda names: {x: [rng.choice("abcdef") for _ in range(30)] for x in names}
    ref, hyp, made = side("ABC"), side("xyz"), []
    count = al.edit_counts
    al.edit_counts = lambda r, h: made.append(1) or count(r, h)
    try:
        got = al.cpwer(ref, hyp)
    finally:
        al.edit_counts = count
    best = min(permutations("xyz"), key=lambda p: sum(sum(count(ref[a], hyp[b])) for a, b in zip("ABC", p, strict=True)))
    assert got["errors"] == sum(sum(count(ref[a], hyp[b])) for a, b in zip("ABC", best, strict=True)) and len(made) == 3
