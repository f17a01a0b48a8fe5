"""The pipeline, stage by stage, against plain Python over each stage's own input."""

import re
from collections import Counter

import corpus_pipeline
from corpus_pipeline import STAGES, dedup, mixing, pii, quality
from lorekeep.llm.common import materialize
from lorekeep.llm.mixing import mix_totals
from lorekeep.llm.quality import classify
from test_pii import brute
from test_simhash import brute_components, brute_mark
from test_tokens import check_pieces, plain


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def masked(text, spans):
    out, at = [], 0
    merged = []
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    for s, e, k in merged:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = materialize(quality(spark, docs, sf), "t1")
    good = {r.doc_id for r in classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    assert rows_of(kept) == rows_of(docs.where(docs.doc_id.isin(list(good)))) and kept.columns == docs.columns

    single = materialize(dedup(spark, kept, sf), "t2")
    groups = brute_components([(r.doc_id, brute_mark(r.text)) for r in kept.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(groups.values())) and single.columns == docs.columns

    clean = materialize(pii(spark, single, sf), "t3")
    texts = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        assert r.n_chars == len(r.text) and not [x for x in brute(r.text) if x[0] != "phone"]
        want = masked(texts[r.doc_id], brute(texts[r.doc_id]))
        assert r.text == want or len(re.findall(r"\[(?:EMAIL|IP|CARD|PHONE|SECRET)\]", r.text)) > want.count("[")
    assert clean.count() == single.count()

    mixed = materialize(mixing(spark, clean, sf), "t4")
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    for r in mix_totals(clean).collect():
        assert abs(times[r.doc_id] - r.taken / max(1, r.size)) < 1.01
    words = sum(len(r.text.split()) for r in clean.collect())
    assert abs(sum(len(r.text.split()) for r in mixed.collect()) - words) < 0.05 * words

    last = STAGES[-1][1](spark, mixed, sf).collect()
    assert sum(r.length for r in last if r.start == 0 and r.length == r.doc_tokens) > 0
    assert {r.doc_id for r in last} == set(times)
    total = sum(len(x) + 1 for x in plain([r.text for r in mixed.collect()]))
    assert sum(r.length for r in last) == total and all(len(r.ids) == 4 * r.length for r in last)
    assert check_pieces is not None


def test_run_and_odd_rows(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and [n for n, _ in STAGES][0] == "quality classifier"
    rows = [(1, None, None, None, 1, "x"), (2, "", "en", "s", 0, "x"), (3, "same text of some words", "en", "s", 23, "x"), (3, "same text of some words", "en", "s", 23, "x"), (4, "same text of some words", "en", "t", 23, "x"),
            (None, "mail a@b.co now", "en", "s", 15, "x"), (None, "mail a@b.co now", "en", "s", 15, "x"), (9, "w " * 9000, "en", "s", 18000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _mark string")
    out = materialize(dedup(spark, docs, sf), "o1")
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 0, 1, 3, 9]
    out = materialize(pii(spark, out, sf), "o2")
    assert [r.text for r in out.where("doc_id IS NULL").collect()] == ["mail [EMAIL] now"] * 2 and out.columns == docs.columns
    out = mixing(spark, out, sf)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= {None, 1, 3, 9}
    for _, stage in STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_packing_leaves_no_tokenizer_behind():
    """Workers live on into other stages: after a task they hold neither the tokenizer nor its pieces."""
    from unittest import mock

    import pyarrow as pa
    from lorekeep.llm import packing, tokens

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one two one two.", None])], names=["doc_id", "text"])
    with mock.patch.object(packing, "TaskContext") as task:
        task.get.return_value.partitionId.return_value = 0
        tokens.encoder.cache_clear()
        path = tokens.default_tokenizer()
        kept, gone = ([b.to_pydict() for b in packing._packer(path, 1024, 0, True, *more)(iter([batch]))] for more in ((), (True,)))
    assert kept == gone and tokens.encoder.cache_info().currsize == 0 == packing._sentence_ends.cache_info().currsize


def test_batches_that_go_to_python_are_short(spark):
    import pyarrow as pa

    before = spark.conf.get(corpus_pipeline._BATCH)
    try:
        spark.conf.set(corpus_pipeline._BATCH, 10_000)
        docs = spark.createDataFrame([(1, "a b c", "s", "en")], "doc_id long, text string, source string, lang string")
        assert corpus_pipeline.packing(spark, docs, "").count() == 1
        rows = spark.range(0, 2_500, 1, 1).mapInArrow(lambda it: (b.slice(0, 1).set_column(0, "id", pa.array([b.num_rows])) for b in it), "id long")
        assert [r.id for r in rows.collect()] == [1_000, 1_000, 500]
    finally:
        spark.conf.set(corpus_pipeline._BATCH, before)
