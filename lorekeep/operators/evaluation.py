"""Evaluation by slices: text, speakers, overlaps and timing of a hypothesis against a reference, for many sources at once.

words(source, word_id, speaker, text, start_ms, end_ms), turns(source, speaker, start_ms, end_ms), slices(source, slice,
start_ms, end_ms) with any number of ranges each, masks(source, start_ms, end_ms). Results have a row for each slice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import normalize, tokens
from lorekeep.functions.work import materialize
from lorekeep.operators import alignment as al
from lorekeep.operators.intervals import collar_ranges, merge_ranges, range_join, union_intersection
from lorekeep.operators.scoring import cpwer_scores, maps_of, plain_of, speaker_word_scores, tokens_of, with_tokens

BY = ["source", "slice"]


def rate(a: str, b: str) -> Column:
    return F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6)


def slice_ranges(rows: DataFrame, custom: DataFrame | None = None, overlaps: DataFrame | None = None, masks: DataFrame | None = None, parts: int = 5) -> DataFrame:
    """(source, slice, start_ms, end_ms) from rows(source, duration_ms): all, each block, development (all blocks but the
    last), held_out, then custom(source, slice, start_ms, end_ms), overlap and unintelligible. The first of a name wins."""
    from lorekeep.operators.scoring import slice_catalog

    found = slice_catalog(rows, parts).withColumn("order", F.lit(0))
    for order, (name, more) in enumerate((("custom", custom), ("overlap", overlaps), ("unintelligible", masks)), 1):
        if more is not None:
            label = F.col("slice") if name == "custom" else F.lit(name)
            found = found.unionByName(more.select("source", label.alias("slice"), "start_ms", "end_ms", F.lit(order).alias("order")))
    first = F.min("order").over(Window.partitionBy("source", "slice"))
    return found.withColumn("first", first).where("order = first").select("source", "slice", "start_ms", "end_ms")


def scored_words(words: DataFrame, slices: DataFrame, masks: DataFrame | None, bucket_ms: int) -> DataFrame:
    """words with the slices in whose ranges their floor midpoints lie, without those that a mask touches."""
    if masks is not None:
        m = masks.select("source", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
        hit = range_join(words.select("source", "word_id", "start_ms", "end_ms"), m, ["source"], bucket_ms).select("source", "word_id").distinct()
        words = words.join(hit, ["source", "word_id"], "left_anti")
    mid = F.expr("(start_ms + end_ms) div 2")
    at = words.select("source", "word_id", mid.alias("start_ms"), (mid + 1).alias("end_ms"))
    s = slices.select(*BY, F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    named = range_join(at, s, ["source"], bucket_ms).select(*BY, "word_id").distinct()
    return named.join(words, ["source", "word_id"])


def clip_to(turns: DataFrame, slices: DataFrame, bucket_ms: int) -> DataFrame:
    """turns cut to the ranges of the slices they lie in."""
    s = slices.select(*BY, F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    both = range_join(turns, s, ["source"], bucket_ms)
    return both.withColumn("start_ms", F.greatest("start_ms", "r_start")).withColumn("end_ms", F.least("end_ms", "r_end")).drop("r_start", "r_end")


def events_in(events: DataFrame, regions: DataFrame, bucket_ms: int) -> DataFrame:
    """(source, slice, start_ms, end_ms, ms, ref, hyp): a source's duration events cut to regions, which are disjoint within a
    slice. Both sides of the join are disjoint, so it has no more rows than the two together for each slice."""
    cut = clip_to(events.drop("ms"), regions, bucket_ms)
    return cut.select(*BY, "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("ms"), "ref", "hyp")


def _lists(words: DataFrame, by: Sequence[str], side: str) -> DataFrame:
    w = F.struct("start_ms", "end_ms", "word_id", "text", tokens_of(words).alias("t"))
    g = words.groupBy(*by).agg(F.array_sort(F.collect_list(w)).alias("w"))
    return g.select(*by, F.transform("w", lambda x: x["text"]).alias(f"raw_{side}"), F.flatten(F.transform("w", lambda x: x["t"])).alias(f"norm_{side}"))


def text_rates(rows: DataFrame) -> DataFrame:
    """rows with raw and normalized word errors and character errors of raw_r, raw_h, norm_r, norm_h (token lists).

    Characters are code points of the normalized tokens joined by spaces. A rate over nothing is null.
    """
    rows = al.with_edit_counts(rows, {"_raw": ("raw_r", "raw_h"), "_norm": ("norm_r", "norm_h")}, {"_chars": ("norm_r", "norm_h")})
    for kind, name in (("raw", "raw_wer"), ("norm", "wer")):
        rows = rows.withColumn(f"{name}_errors", F.expr(f"_{kind}.substitutions + _{kind}.deletions + _{kind}.insertions")).withColumn(f"{name}_total", F.size(f"{kind}_r").cast("long"))
    rows = rows.withColumns({c: F.col(f"_norm.{c}") for c in ("substitutions", "deletions", "insertions")})
    rows = rows.withColumn("cer_errors", F.col("_chars")).withColumn("cer_total", F.length(F.array_join("norm_r", " ")).cast("long"))
    return rows.withColumns({n: rate(f"{n}_errors", f"{n}_total") for n in ("raw_wer", "wer", "cer")}).drop("_raw", "_norm", "_chars", "raw_r", "raw_h", "norm_r", "norm_h")


def text_scores(ref: DataFrame, hyp: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    none = F.array().cast("array<string>")
    both = _lists(ref, by, "r").join(_lists(hyp, by, "h"), list(by), "full")
    return text_rates(both.select(*by, *[F.coalesce(c, none).alias(c) for c in ("raw_r", "raw_h", "norm_r", "norm_h")]))


def jaccard_errors(events: DataFrame, maps: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(by, jer, jer_speakers): the mean over reference labels of one minus intersection over union, under the map."""
    m = maps.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("hyp_label", "ref_label"))).alias("_map"))
    named = events.join(m, list(by), "left").withColumn("hyp", F.array_compact(F.transform("hyp", lambda x: F.element_at("_map", x))))
    rows = named.select(*by, "ms", "ref", "hyp", F.explode(F.array_union("ref", "hyp")).alias("label"))
    r, h = (F.array_contains(F.col(c), F.col("label")).cast("long") for c in ("ref", "hyp"))
    one = rows.groupBy(*by, "label").agg(F.sum(r * h * F.col("ms")).alias("i"), F.sum("ms").alias("u"), F.sum(r * F.col("ms")).alias("t")).where("t > 0")
    return one.groupBy(*by).agg(F.round(F.avg(1 - F.col("i") / F.col("u")), 6).alias("jer"), F.count("*").alias("jer_speakers"))


def speaker_counts(ref: DataFrame, hyp: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(by, ref_speakers, hyp_speakers, signed, absolute): null where the reference has no speaker."""
    side = lambda d, n: d.groupBy(*by).agg(F.count_distinct("speaker").alias(n))
    both = side(ref, "ref_speakers").join(side(hyp, "hyp_speakers"), list(by), "full").na.fill(0, ["ref_speakers", "hyp_speakers"])
    signed = F.when(F.col("ref_speakers") > 0, F.col("hyp_speakers") - F.col("ref_speakers"))
    return both.withColumn("signed", signed).withColumn("absolute", F.abs("signed"))


def overlap_rates(ref: DataFrame, hyp: DataFrame, keys: DataFrame, truth: DataFrame | None = None, by: Sequence[str] = BY) -> DataFrame:
    """(by, overlap_ref_ms, overlap_hyp_ms, overlap_both_ms, precision, recall, f1, overlap_status) for each of keys.

    ref and hyp are explicit overlap intervals; a source that isn't in truth(source) has no such reference: not_available.
    """
    found = union_intersection(ref, hyp, by).select(*by, F.col("a_ms").alias("overlap_ref_ms"), F.col("b_ms").alias("overlap_hyp_ms"), F.col("both_ms").alias("overlap_both_ms"))
    rows = keys.select(*by).distinct().join(found, list(by), "left").na.fill(0, ["overlap_ref_ms", "overlap_hyp_ms", "overlap_both_ms"])
    known = F.lit(True)
    if truth is not None:
        rows = rows.join(truth.select("source", F.lit(True).alias("_known")).distinct(), "source", "left")
        known = F.coalesce("_known", F.lit(False))
    p, r = (F.when(known, F.try_divide(F.col("overlap_both_ms").cast("double"), F.col(c).cast("double"))) for c in ("overlap_hyp_ms", "overlap_ref_ms"))
    rows = rows.withColumn("_p", p).withColumn("_r", r)
    status = F.when(~known, "not_available").when(F.col("overlap_ref_ms") > 0, "scored").otherwise("insufficient_evidence")
    f1 = F.when(F.col("_p") + F.col("_r") > 0, 2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r")))
    rows = rows.withColumns({"precision": F.round("_p", 6), "recall": F.round("_r", 6), "f1": F.round(f1, 6), "overlap_status": status})
    return rows.select(*by, "overlap_ref_ms", "overlap_hyp_ms", "overlap_both_ms", "precision", "recall", "f1", "overlap_status")


def _word_lists(column: pa.ListArray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Edges of each row's words, and of all of them texts, starts and ends; a null row has none."""
    words = column.flatten()
    edges = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    return edges, words.field("text").to_pylist(), *(words.field(c).to_numpy(zero_copy_only=False) for c in ("start_ms", "end_ms"))


def timing_scores(ref: DataFrame, hyp: DataFrame, manual: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(by, matched, timed, coverage, and median and 95th percentile of start, end and all errors in milliseconds) over the
    words of equal text that were timed by hand, manual(source, word_id); words that are lost count in the coverage."""
    side = lambda w, n: w.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "word_id", plain_of(w).alias("text")))).alias(n))
    timed = ref.join(manual, ["source", "word_id"], "left_semi")
    r, h = side(timed, "r"), side(hyp, "h")
    kinds = dict(ref.dtypes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (x for b in batches for x in al.sliced(b)):
            sides = [_word_lists(x.column(len(by) + i)) for i in range(2)]
            pairs: list[list[int]] = [[], [], []]  # row of the slice, place in either side's words
            for k in range(x.num_rows):
                (a, z), (c, y) = (edges[k : k + 2].tolist() for edges, *_ in sides)
                equal = [(k, a + i, c + j) for op, i, j in al.align(sides[0][1][a:z], sides[1][1][c:y]) if op == "equal"]
                for places, found in zip(pairs, zip(*equal, strict=True)):
                    places += found
            row, i, j = (np.array(p, np.int64) for p in pairs)
            errors = [pa.array(np.abs(r[i] - h[j])) for r, h in zip(sides[0][2:], sides[1][2:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(x.column(n).take(pa.array(row)) for n in range(len(by))), *errors], names=[*by, "s", "e"])

    found = r.join(h, list(by), "left").select(*by, "r", "h").mapInArrow(score, ", ".join(f"{c} {kinds[c]}" for c in by) + ", s long, e long")
    found = materialize(found, "timing-errors")
    at = lambda c, p: F.percentile(c, F.lit(p))
    one = found.groupBy(*by).agg(F.count("*").alias("matched"), at("s", 0.5).alias("start_median_ms"), at("s", 0.95).alias("start_p95_ms"), at("e", 0.5).alias("end_median_ms"), at("e", 0.95).alias("end_p95_ms"))
    both = found.select(*by, F.explode(F.array("s", "e")).alias("x")).groupBy(*by).agg(at("x", 0.5).alias("all_median_ms"), at("x", 0.95).alias("all_p95_ms"))
    rows = timed.groupBy(*by).agg(F.count("*").alias("timed")).join(one, list(by), "left").join(both, list(by), "left").na.fill(0, ["matched"])
    return rows.withColumn("coverage", rate("matched", "timed"))


def score_diarization(ref: DataFrame, hyp: DataFrame, slices: DataFrame, bucket_ms: int, collar_ms: int = 0, ref_overlaps: DataFrame | None = None, hyp_overlaps: DataFrame | None = None,
                      truth: DataFrame | None = None, unscorable: DataFrame | None = None) -> DataFrame:
    """Interval scores of each slice, without a look at words: error components and DER, JER under its map, speaker counts,
    overlaps, status. Sources in unscorable(source) lack the intervals of one side: all their figures are null."""
    whole = merge_ranges(slices, BY)
    active = al.duration_events(ref, hyp, ["source"], "speaker", bucket_ms)
    plain = events = events_in(active, whole, bucket_ms)
    if collar_ms:
        events = events_in(active, collared(ref, slices, whole, bucket_ms, collar_ms), bucket_ms)
    maps = maps_of(events, BY, {c: dict(slices.dtypes)[c] for c in BY})
    return _interval_scores(ref, hyp, slices, whole, plain, events, maps, bucket_ms, ref_overlaps, hyp_overlaps, truth, unscorable)


def collared(ref: DataFrame, slices: DataFrame, whole: DataFrame, bucket_ms: int, collar_ms: int) -> DataFrame:
    """whole, the slices' union, without the collar around every edge of ref."""
    spans = slices.groupBy("source").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return clip_to(collar_ranges(ref, spans, ["source"], collar_ms), whole, bucket_ms)


def error_rates(slices: DataFrame, events: DataFrame, maps: DataFrame) -> DataFrame:
    """(source, slice, ref_ms, missed_ms, false_ms, confused_ms, der) of each slice."""
    keys = slices.select(*BY).distinct()
    rows = keys.join(al.diarization_sums(events, BY, maps), BY, "left").na.fill(0, ["ref_ms", "missed_ms", "false_ms", "confused_ms"])
    return rows.withColumn("der", F.round(F.try_divide((F.col("missed_ms") + F.col("false_ms") + F.col("confused_ms")).cast("double"), F.col("ref_ms").cast("double")), 6))


def _interval_scores(ref: DataFrame, hyp: DataFrame, slices: DataFrame, whole: DataFrame, plain: DataFrame, events: DataFrame, maps: DataFrame, bucket_ms: int, ref_overlaps: DataFrame | None = None,
                     hyp_overlaps: DataFrame | None = None, truth: DataFrame | None = None, unscorable: DataFrame | None = None) -> DataFrame:
    """score_diarization() over events, plain without and events with the collar, under the maps of the latter."""
    rows = error_rates(slices, events, maps)
    whole_r, whole_h = (clip_to(merge_ranges(x, ["source", "speaker"]), whole, bucket_ms) for x in (ref, hyp))
    rows = rows.join(jaccard_errors(plain, maps), BY, "left").join(speaker_counts(whole_r, whole_h), BY, "left")
    if ref_overlaps is not None:
        o = [clip_to(x, slices, bucket_ms) for x in (ref_overlaps, hyp_overlaps)]
        rows = rows.join(overlap_rates(*o, slices, truth), BY, "left")
    status = F.when(F.col("ref_ms") > 0, "scored").otherwise("insufficient_evidence")
    if unscorable is not None:
        rows = rows.join(unscorable.select("source", F.lit(True).alias("_none")).distinct(), "source", "left")
        gone = F.coalesce("_none", F.lit(False))
        rows = rows.select(*BY, *[F.when(~gone, F.col(c)).alias(c) for c in rows.columns if c not in (*BY, "_none")], F.when(gone, "unscorable").otherwise(status).alias("status"))
        return rows
    return rows.withColumn("status", status)


def evaluate_slices(ref_words: DataFrame, hyp_words: DataFrame, ref_turns: DataFrame, hyp_turns: DataFrame, slices: DataFrame, bucket_ms: int, masks: DataFrame | None = None,
                    manual: DataFrame | None = None) -> DataFrame:
    """All scores of each slice: text rates, DER without and with a collar of 250 ms, JER, speaker counts, words by speaker,
    timing of the words in manual (all words where that is None).

    What several scores need is made once: words with their tokens by slice, duration events, those of slices, and maps.
    """
    kinds = {c: dict(slices.dtypes)[c] for c in BY}
    slices = materialize(slices, "slices")
    whole = materialize(merge_ranges(slices, BY), "slice-ranges")
    r, h = (materialize(scored_words(with_tokens(w), slices, masks, bucket_ms), "scored-words") for w in (ref_words, hyp_words))
    active = materialize(al.duration_events(ref_turns, hyp_turns, ["source"], "speaker", bucket_ms), "duration-events")
    events, apart = (materialize(events_in(active, x, bucket_ms), "slice-events") for x in (whole, collared(ref_turns, slices, whole, bucket_ms, 250)))
    maps, apart_maps = (materialize(maps_of(x, BY, kinds), "slice-maps") for x in (events, apart))
    found = _interval_scores(ref_turns, hyp_turns, slices, whole, events, events, maps, bucket_ms)
    collar = error_rates(slices, apart, apart_maps).select(*BY, F.col("der").alias("der_250"))
    keyed = F.struct(*BY)
    one = lambda d: d.withColumn("source", keyed).drop("slice")
    speakers = speaker_word_scores(one(r), one(h), one(maps)).select("source.source", "source.slice", "sa_errors", "sa_wer", "unassigned_rate")
    timing = timing_scores(r, h, manual if manual is not None else ref_words.select("source", "word_id"))
    rows = found.drop("status").join(text_scores(r, h), BY, "left").join(collar, BY, "left").join(speakers, BY, "left")
    return rows.join(timing, BY, "left")


def score_chunks(rows: DataFrame) -> DataFrame:
    """(chunk_id, model, status, rates) of rows(chunk_id, model, review_status, ref_text, hyp_text, ref_mask, hyp_mask).

    Masks are indices of white-space tokens, removed from every metric. A reference that no human confirmed is
    insufficient_evidence; a mask on one side only, or beyond the tokens, is unscorable. Rates of those are null.

    With columns ref_streams and hyp_streams (lists of struct(text, mask), null where there are none) also orc_status,
    orc_errors, orc_substitutions, orc_deletions, orc_insertions, orc_total and orc_wer: the hypothesis' streams one after
    another (or its text) against the best interleaving of the reference's, speakers left aside. not_applicable without
    reference streams or tokens in them; too_large if the search would pass its limit of cells.
    """
    none = F.array().cast("array<int>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("ref_mask", "hyp_mask")})
    if "ref_streams" in rows.columns:  # streams first: what follows them is made only if it is asked for
        found = score_chunks(_chunk_streams(rows.withColumnsRenamed({"ref_streams": "_refs", "hyp_streams": "_hyps"})))
        last = [f"orc_{c}" for c in (*al.ORC.names, "wer")]
        return found.select(*[c for c in found.columns if c not in last], *last)
    for side, text, mask in (("r", "ref_text", "ref_mask"), ("h", "hyp_text", "hyp_mask")):
        rows = rows.withColumn(f"raw_{side}", F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")))
        parts = F.transform(f"raw_{side}", lambda t, i: F.transform(tokens(normalize(t)), lambda x: F.struct(x.alias("t"), i.alias("i"))))
        rows = rows.withColumn("_n", F.flatten(parts)).withColumn("_beyond", F.coalesce(F.array_max(mask) >= F.size(f"raw_{side}"), F.lit(False)))
        rows = rows.withColumn(f"norm_{side}", F.transform(F.expr(f"filter(_n, x -> NOT array_contains({mask}, x.i))"), lambda x: x["t"]))
        rows = rows.withColumn(f"raw_{side}", F.expr(f"transform(filter(transform(raw_{side}, (t, i) -> struct(t AS t, i AS i)), x -> NOT array_contains({mask}, x.i)), x -> x.t)"))
        rows = rows.withColumn(f"_beyond_{side}", F.col("_beyond")).drop("_n", "_beyond")
    one_sided = (F.size("ref_mask") > 0) != (F.size("hyp_mask") > 0)
    status = (
        F.when(~F.coalesce(F.col("review_status") == "human_truth", F.lit(False)), "insufficient_evidence")
        .when(one_sided | F.col("_beyond_r") | F.col("_beyond_h"), "unscorable").when(F.size("norm_r") == 0, "insufficient_evidence").otherwise("scored")
    )
    rows = text_rates(rows.withColumn("status", status).drop("_beyond_r", "_beyond_h"))
    numbers = ["substitutions", "deletions", "insertions", *[f"{n}{x}" for n in ("raw_wer", "wer", "cer") for x in ("_errors", "_total", "")]]
    rest = [c for c in rows.columns if c not in numbers]
    return rows.select(*rest, *[F.when(F.col("status") == "scored", F.col(c)).alias(c) for c in numbers])


def _chunk_streams(rows: DataFrame) -> DataFrame:
    """rows of score_chunks, masks not null, with _refs and _hyps scored by interleaving."""
    none = F.array().cast("array<int>")

    def kept(stream):
        parts = F.transform(tokens(stream["text"]), lambda t, i: F.transform(tokens(normalize(t)), lambda x: F.struct(x.alias("t"), i.alias("i"))))
        return F.transform(F.filter(F.flatten(parts), lambda x: ~F.array_contains(F.coalesce(stream["mask"], none), x["i"])), lambda x: x["t"])

    any_mask = lambda c: F.coalesce(F.exists(c, lambda s: F.size(F.coalesce(s["mask"], none)) > 0), F.lit(False))
    beyond = lambda c: F.coalesce(F.exists(c, lambda s: F.coalesce(F.array_max(s["mask"]) >= F.size(tokens(s["text"])), F.lit(False))), F.lit(False))
    text = kept(F.struct(F.coalesce("hyp_text", F.lit("")).alias("text"), F.col("hyp_mask").alias("mask")))
    told = F.transform("_refs", kept)
    heard = F.when(F.coalesce(F.size("_hyps") > 0, F.lit(False)), F.flatten(F.transform("_hyps", kept))).otherwise(text)
    bad = (any_mask("_refs") != any_mask("_hyps")) | ((F.size("ref_mask") > 0) != (F.size("hyp_mask") > 0)) | beyond("_refs") | beyond("_hyps")
    rows = rows.withColumn("_human", F.coalesce(F.col("review_status") == "human_truth", F.lit(False))).withColumn("_bad", bad)
    wanted = F.col("_human") & ~F.col("_bad")
    rows = al.with_orc(rows.withColumn("_told", F.when(wanted, told)).withColumn("_heard", F.when(wanted, heard)), "_told", "_heard", "_orc")
    without = F.coalesce(F.size("_refs") == 0, F.lit(True))
    status = F.when(~F.col("_human"), "insufficient_evidence").when(without, "not_applicable").when(F.col("_bad"), "unscorable").otherwise(F.col("_orc.status"))
    scored = status == "scored"
    rows = rows.withColumns({"orc_status": status} | {f"orc_{c}": F.when(scored, F.col(f"_orc.{c}")) for c in al.ORC.names[1:]})
    return rows.withColumn("orc_wer", rate("orc_errors", "orc_total")).drop("_refs", "_hyps", "_human", "_bad", "_told", "_heard", "_orc")


def score_manifest(chunks: DataFrame, references: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """score_chunks over hypotheses(chunk_id, model, hyp_text, hyp_mask) with each chunk's reference of highest revision.

    references(chunk_id, revision, review_status, ref_text, ref_mask). A hypothesis without a chunk or a reference raises;
    a reference without a hypothesis gives no row. The chunk's other columns go along.
    """
    rest = [c for c in references.columns if c != "chunk_id"]
    last = references.groupBy("chunk_id").agg(F.max_by(F.struct(*rest), "revision").alias("_r")).select("chunk_id", F.lit(True).alias("_known"), "_r.*")
    rows = hypotheses.join(chunks.withColumn("_chunk", F.lit(True)), "chunk_id", "left").join(last, "chunk_id", "left")
    whole = F.col("_known").isNotNull() & F.col("_chunk").isNotNull()
    rows = rows.withColumn("chunk_id", F.when(whole, F.col("chunk_id")).otherwise(F.raise_error(F.concat(F.lit("no chunk or reference for hypothesis of "), F.col("chunk_id").cast("string")))))
    return score_chunks(rows.drop("_known", "_chunk"))


def micro_average(rows: DataFrame, by: Sequence[str], errors: str, total: str, status: str = "status") -> DataFrame:
    """(by, n, n_unscorable, n_insufficient, errors, total, rate, status): sums over the scored rows.

    scored, or partial if some row is unscorable; without a scored row unscorable, else insufficient_evidence, else
    not_applicable.
    """
    scored = F.col(status) == "scored"
    g = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(scored).alias("n_scored"), F.count_if(F.col(status) == "unscorable").alias("n_unscorable"), F.count_if(F.col(status) == "insufficient_evidence").alias("n_insufficient"),
        F.sum(F.when(scored, F.col(errors))).alias("errors"), F.coalesce(F.sum(F.when(scored, F.col(total))), F.lit(0)).alias("total"),
    )
    kind = (
        F.when((F.col("n_scored") > 0) & (F.col("n_unscorable") > 0), "partial").when(F.col("n_scored") > 0, "scored").when(F.col("n_unscorable") > 0, "unscorable")
        .when(F.col("n_insufficient") > 0, "insufficient_evidence").otherwise("not_applicable")
    )
    return g.withColumn("rate", rate("errors", "total")).withColumn("status", kind).drop("n_scored")


def score_integrated(ref: DataFrame, hyp: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """cpWER of each source, and one row for all (source null) with its status; words need both texts and speakers.

    provenance(source, ok) says whether a source's intervals belong to its words; where not, it is unscorable.
    """
    rows = cpwer_scores(ref, hyp)
    ok = F.lit(True)
    if provenance is not None:
        rows = rows.join(provenance, "source", "left")
        ok = F.coalesce("ok", F.lit(False))
    status = F.when(~ok, "unscorable").when(F.col("cp_total") > 0, "scored").otherwise("insufficient_evidence")
    rows = rows.withColumn("status", status).select("source", *[F.when(ok, F.col(c)).alias(c) for c in ("cp_errors", "cp_total", "cpwer")], "status")
    total = micro_average(rows, [], "cp_errors", "cp_total").select(F.lit(None).cast(dict(rows.dtypes)["source"]).alias("source"), F.col("errors").alias("cp_errors"), F.col("total").alias("cp_total"), F.col("rate").alias("cpwer"), "status")
    return rows.unionByName(total)
