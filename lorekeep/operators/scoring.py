"""Scoring of whole documents: words, speakers and timing of a hypothesis against a reference, for many sources at once.

words(source, word_id, speaker, text, start_ms, end_ms) and turns(source, speaker, start_ms, end_ms) on either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import normalize, tokens
from lorekeep.functions.work import materialize
from lorekeep.operators import alignment as al
from lorekeep.operators.aggregates import verdict

UNASSIGNED = "__unassigned__"


def with_tokens(words: DataFrame) -> DataFrame:
    """words with their normalized text and its tokens, for scores that would each make them."""
    return words.withColumn("_plain", normalize("text")).withColumn("_tokens", tokens("_plain"))


def plain_of(words: DataFrame) -> Column:
    return F.col("_plain") if "_plain" in words.columns else normalize("text")


def tokens_of(words: DataFrame) -> Column:
    return F.col("_tokens") if "_tokens" in words.columns else tokens(normalize("text"))


def token_lists(words: DataFrame, by: list[str]) -> DataFrame:
    """(by, tokens): normalized tokens in order of time; a word may give several."""
    w = words.select(*by, F.struct("start_ms", "end_ms", "word_id", tokens_of(words).alias("t")).alias("w"))
    g = w.groupBy(*by).agg(F.array_sort(F.collect_list("w")).alias("w"))
    return g.select(*by, F.flatten(F.transform("w", lambda x: x["t"])).alias("tokens"))


def maps_of(events: DataFrame, by: list[str], kinds: dict[str, str]) -> DataFrame:
    """(by, hyp_label, ref_label) from duration events: the one-to-one map of greatest common time; unmapped labels are left out."""
    w = events.select(*by, "ms", F.explode("ref").alias("r"), "hyp").select(*by, "ms", "r", F.explode("hyp").alias("h")).groupBy(*by, "r", "h").agg(F.sum("ms").alias("ms"))

    # a row for each group, and groups dealt out by number: they are many and small, and a pass over one costs more than its bytes
    rows = w.groupBy(*by).agg(F.collect_list(F.struct("h", "r", "ms")).alias("pairs")).repartition(int(w.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, hyps, refs = [], [], []
            for k, pairs in enumerate(b.column(len(by)).to_pylist()):
                for h, r in al.speaker_map({(x["h"], x["r"]): x["ms"] for x in pairs}).items():
                    if r is not None:
                        at.append(k)
                        hyps.append(h)
                        refs.append(r)
            keys = [b.column(k).take(pa.array(at, pa.int64())) for k in range(len(by))]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(hyps, pa.string()), pa.array(refs, pa.string())], names=[*by, "hyp_label", "ref_label"])

    return rows.select(*by, "pairs").mapInArrow(choose, ", ".join(f"{c} {kinds[c]}" for c in by) + ", hyp_label string, ref_label string")


def speaker_maps(ref: DataFrame, hyp: DataFrame, bucket_ms: int) -> DataFrame:
    """(source, hyp_label, ref_label) of all common time."""
    events = al.duration_events(ref, hyp, ["source"], "speaker", bucket_ms)
    return maps_of(events, ["source"], {"source": dict(ref.dtypes)["source"]})


def diarization_scores(ref: DataFrame, hyp: DataFrame, maps: DataFrame, bucket_ms: int, events: DataFrame | None = None) -> DataFrame:
    """(source, ref_ms, missed_ms, false_ms, confused_ms, der, speaker_count_error); events are their duration events, if
    they are made already."""
    sums = al.diarization_sums(events or al.duration_events(ref, hyp, ["source"], "speaker", bucket_ms), ["source"], maps)
    sums = sums.withColumn("der", F.round(F.try_divide((F.col("missed_ms") + F.col("false_ms") + F.col("confused_ms")).cast("double"), F.col("ref_ms").cast("double")), 6))
    count = lambda d, n: d.groupBy("source").agg(F.count_distinct("speaker").alias(n))
    return sums.join(count(ref, "n_ref"), "source", "left").join(count(hyp, "n_hyp"), "source", "left").withColumn(
        "speaker_count_error", F.coalesce("n_hyp", F.lit(0)) - F.coalesce("n_ref", F.lit(0))
    ).drop("n_ref", "n_hyp")


def word_scores(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """(source, substitutions, deletions, insertions, ref_words, wer)."""
    both = token_lists(ref, ["source"]).withColumnRenamed("tokens", "r").join(token_lists(hyp, ["source"]).withColumnRenamed("tokens", "h"), "source", "left")
    rows = al.word_errors(both.withColumn("h", F.coalesce("h", F.array().cast("array<string>"))), "r", "h")
    e = F.col("errors")
    return rows.select("source", "errors.*", "ref_words", al.error_rate(e["substitutions"], e["deletions"], e["insertions"], F.col("ref_words")).alias("wer"))


def speaker_word_scores(ref: DataFrame, hyp: DataFrame, maps: DataFrame) -> DataFrame:
    """(source, sa_errors, sa_wer, unassigned_rate): each speaker's words apart, after the map; in a bucket of their own those
    that are unmapped, or mapped to a reference speaker without words."""
    speaking = ref.where("speaker IS NOT NULL").select("source", F.col("speaker").cast("string").alias("ref_label")).distinct()
    m = maps.join(speaking, ["source", "ref_label"], "left_semi").select("source", F.col("hyp_label").alias("speaker"), "ref_label")
    named = hyp.withColumn("speaker", F.col("speaker").cast("string")).join(m, ["source", "speaker"], "left").withColumn("bucket", F.coalesce("ref_label", F.lit(UNASSIGNED)))
    r = token_lists(ref.withColumn("bucket", F.coalesce(F.col("speaker").cast("string"), F.lit(UNASSIGNED))), ["source", "bucket"]).withColumnRenamed("tokens", "r")
    h = token_lists(named, ["source", "bucket"]).withColumnRenamed("tokens", "h")
    none = F.array().cast("array<string>")
    both = r.join(h, ["source", "bucket"], "full").select("source", "bucket", F.coalesce("r", none).alias("r"), F.coalesce("h", none).alias("h"))
    e = al.word_errors(both, "r", "h").withColumn("n", F.col("errors.substitutions") + F.col("errors.deletions") + F.col("errors.insertions")).withColumn("hyp_words", F.size("h"))
    g = e.groupBy("source").agg(F.sum("n").alias("sa_errors"), F.sum("ref_words").alias("t"), F.sum("hyp_words").alias("hw"), F.sum(F.when(F.col("bucket") == UNASSIGNED, F.col("hyp_words")).otherwise(0)).alias("u"))
    rate = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6)
    return g.select("source", "sa_errors", rate("sa_errors", "t").alias("sa_wer"), rate("u", "hw").alias("unassigned_rate"))


def cpwer_scores(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """(source, cp_errors, cp_total, cpwer): channels paired at least cost."""
    lists = lambda d, n: token_lists(d.withColumn("speaker", F.col("speaker").cast("string")), ["source", "speaker"]).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("speaker", "tokens"))).alias(n))
    both = lists(ref.where("speaker IS NOT NULL"), "r").join(lists(hyp.where("speaker IS NOT NULL"), "h"), "source", "left")
    kind = dict(ref.dtypes)["source"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            rows = []
            for source, r, h in g[["source", "r", "h"]].itertuples(index=False):
                side = lambda m: {k: list(v) for k, v in (m.items() if hasattr(m, "items") else m or [])}
                got = al.cpwer(side(r), side(h))
                rows.append((source, got["errors"], got["total"], got["value"]))
            yield pd.DataFrame(rows, columns=["source", "cp_errors", "cp_total", "cpwer"])

    return both.mapInPandas(score, f"source {kind}, cp_errors long, cp_total long, cpwer double")


def evaluate(ref_words: DataFrame, hyp_words: DataFrame, ref_turns: DataFrame, hyp_turns: DataFrame, timings: DataFrame, bucket_ms: int) -> DataFrame:
    """All scores of each source, with the verdict; timings(source, timings) counts manually timed words, and may have a
    column gates, whether the reference's split, review and fingerprints hold (verdict)."""
    events = materialize(al.duration_events(ref_turns, hyp_turns, ["source"], "speaker", bucket_ms), "duration-events")
    maps = materialize(maps_of(events, ["source"], {"source": dict(ref_turns.dtypes)["source"]}), "speaker-maps")
    rows = word_scores(ref_words, hyp_words).join(diarization_scores(ref_turns, hyp_turns, maps, bucket_ms, events), "source", "left")
    rows = rows.join(speaker_word_scores(ref_words, hyp_words, maps), "source", "left").join(cpwer_scores(ref_words, hyp_words), "source", "left").join(timings, "source", "left")
    gates = [F.col("gates")] if "gates" in timings.columns else []
    return rows.withColumn("verdict", verdict(F.col("wer"), F.col("der"), F.coalesce("timings", F.lit(0)), *gates)).drop("gates")


def slice_catalog(rows: DataFrame, parts: int = 5) -> DataFrame:
    """(source, slice, start_ms, end_ms) from rows(source, duration_ms): all, each block, development, held_out."""
    block = lambda i: F.expr(f"duration_ms * {i} div {parts}")
    spans = [("all", F.lit(0).cast("long"), F.col("duration_ms"))] + [(f"block-{i}", block(i), block(i + 1)) for i in range(parts)]
    spans += [("development", F.lit(0).cast("long"), block(parts - 1)), ("held_out", block(parts - 1), F.col("duration_ms"))]
    return rows.select("source", F.explode(F.array(*[F.struct(F.lit(n).alias("slice"), s.cast("long").alias("start_ms"), e.cast("long").alias("end_ms")) for n, s, e in spans])).alias("x")).select("source", "x.*")
