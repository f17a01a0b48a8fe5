"""Queries of text functions, alignment, diarization scoring and segmentation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.functions.work import materialize
from lorekeep.operators import aggregates as ag
from lorekeep.operators import alignment as al
from lorekeep.operators import evaluation as ev
from lorekeep.operators import intervals as iv
from lorekeep.operators import segmentation as sg
from lorekeep.plans.q_intervals import merged_sql, segments_sql, subtracted_sql
from lorekeep.plans.views import WORDS, speaker_turns, table, turns, turns_sql, words
from lorekeep.sources import io

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("k1_normalize", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '\p{P}', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents")
def k1_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normalize("text")).alias("digest"))


@query("k1_normalize_exact", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(replace(nfc_normalize(text), 'ß', 'ss')), '\p{P}', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents")
def k1_normalize_exact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normalize_udf("text")).alias("digest"))


@query("k2_tokens", r"SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n, md5(array_to_string(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), '|')) AS digest FROM conversations")
def k2_tokens(spark, sf_dir):
    t = tx.tokens("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, "|")).alias("digest"))


@query(
    "k3_timestamps",
    """SELECT event_id, lpad(CAST(m // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(m % 1000 AS VARCHAR), 3, '0') AS srt,
  CAST(m // 1000 AS VARCHAR) || '.' || lpad(CAST(m % 1000 AS VARCHAR), 3, '0') AS rttm FROM (SELECT event_id, epoch_us(ts) // 1000 % 86400000 AS m FROM events)""",
)
def k3_timestamps(spark, sf_dir):
    m = F.expr("(unix_micros(CAST(ts AS TIMESTAMP)) div 1000) % 86400000")
    return table(spark, sf_dir, "events").select("event_id", m.alias("m")).select("event_id", tx.timestamp("m").alias("srt"), tx.rttm_seconds("m").alias("rttm"))


@query("k5_seconds_to_ms", "SELECT event_id, CAST(round(CAST(value AS DECIMAL(18, 6)) * 1000, 0) AS BIGINT) AS ms FROM events")
def k5_seconds_to_ms(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.seconds_to_ms("value").alias("ms"))


@query("k6_digests", "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes FROM documents")
def k6_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@query("k10_captions", f"WITH {WORDS} SELECT episode, word_id, '[' || coalesce(nullif(speaker, 'system'), 'UNASSIGNED') || '] ' || CASE WHEN word_id % 9 = 0 THEN '[OVERLAP] ' ELSE '' END || text AS caption FROM timed")
def k10_captions(spark, sf_dir):
    w = words(spark, sf_dir)
    return w.select("episode", "word_id", tx.caption(F.when(F.col("speaker") != "system", F.col("speaker")), F.col("word_id") % 9 == 0, F.col("text")).alias("caption"))


@query("i14_transcript_counts", f"WITH {WORDS} SELECT episode, count(*) AS n, count(*) FILTER (speaker = 'system') AS unassigned, count(*) FILTER (word_id % 9 = 0) AS overlapped FROM timed GROUP BY 1")
def i14_transcript_counts(spark, sf_dir):
    return words(spark, sf_dir).groupBy("episode").agg(F.count("*").alias("n"), F.count_if(F.col("speaker") == "system").alias("unassigned"), F.count_if(F.col("word_id") % 9 == 0).alias("overlapped"))


@query(
    "d5_speaker_runs",
    f"""WITH {WORDS}, f AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY episode ORDER BY word_id) IS DISTINCT FROM speaker OR word_id = 0 THEN 1 ELSE 0 END AS new FROM timed),
r AS (SELECT *, sum(new) OVER (PARTITION BY episode ORDER BY word_id) AS run FROM f)
SELECT episode, CAST(run AS BIGINT) AS run, any_value(speaker) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM r GROUP BY episode, run""",
)
def d5_speaker_runs(spark, sf_dir):
    w = words(spark, sf_dir)
    new = F.coalesce(~F.lag("speaker").over(Window.partitionBy("episode").orderBy("word_id")).eqNullSafe(F.col("speaker")), F.lit(True)) | (F.col("word_id") == 0)
    r = iv.islands(w, ["episode"], new, ["word_id"])
    return r.groupBy("episode", F.col("island").cast("long").alias("run")).agg(F.first("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))


def _pairs(spark, sf_dir):
    """Consecutive turns of a conversation as reference and hypothesis."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    rows = c.select("conv_id", "turn", "text", F.lead("text").over(w).alias("next")).where("next IS NOT NULL")
    return rows.select("conv_id", "turn", tx.tokens(tx.normalize("text")).alias("ref"), tx.tokens(tx.normalize("next")).alias("hyp"))


@query("j1_word_errors")
def j1_word_errors(spark, sf_dir):
    r = al.word_errors(_pairs(spark, sf_dir), "ref", "hyp")
    return r.select("conv_id", "turn", "errors.*", "ref_words", al.error_rate(F.col("errors.substitutions"), F.col("errors.deletions"), F.col("errors.insertions"), F.col("ref_words")).alias("wer"))


#: levenshtein of the SQL engine counts bytes; normalized texts have no capitals, which stand for the letters of two bytes.
_POINTS = r"translate(trim(regexp_replace(regexp_replace(lower(replace(nfc_normalize(text), 'ß', 'ss')), '\p{P}', ' ', 'g'), '\s+', ' ', 'g')), 'äçèéêíñóöü', 'ABCDEFGHIJ')"


@query(
    "j3_cer",
    f"""SELECT item_id, levenshtein(a, d) AS errors, length(a) AS chars FROM (SELECT item_id, {_POINTS} AS a, lead({_POINTS}) OVER (PARTITION BY item_id // 2 ORDER BY item_id) AS d FROM benchmark) WHERE d IS NOT NULL""",
)
def j3_cer(spark, sf_dir):
    """Character errors, by code points of normalized texts, of each benchmark text of even id against the next."""
    b = table(spark, sf_dir, "benchmark").select("item_id", tx.normalize_udf("text").alias("a"))
    b = b.withColumn("d", F.lead("a").over(Window.partitionBy(F.expr("item_id div 2")).orderBy("item_id"))).where("d IS NOT NULL")
    return b.select("item_id", F.levenshtein("a", "d").cast("long").alias("errors"), F.length("a").cast("long").alias("chars"))


@query(
    "j3_cer_turns",
    f"""SELECT conv_id, turn, levenshtein(a, d) AS errors, length(a) AS chars FROM (SELECT conv_id, turn, {_POINTS} AS a, lead({_POINTS}) OVER (PARTITION BY conv_id ORDER BY turn, role) AS d FROM conversations) WHERE d IS NOT NULL""",
)
def j3_cer_turns(spark, sf_dir):
    """Character errors of each turn against the next, by code points of whole normalized texts."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", tx.normalize_udf("text").alias("ref"))
    rows = c.withColumn("hyp", F.lead("ref").over(Window.partitionBy("conv_id").orderBy("turn", "role"))).where("hyp IS NOT NULL")
    return rows.select("conv_id", "turn", F.levenshtein("ref", "hyp").cast("long").alias("errors"), F.length("ref").cast("long").alias("chars"))


def _two_sides(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("label", F.col("speaker") % 6)
    return t.where("event_id % 2 = 0"), t.where("event_id % 2 = 1")


def _side_sql() -> str:
    return f"""{turns_sql()}, l AS (SELECT episode, CAST(speaker % 6 AS VARCHAR) AS label, event_id % 2 AS side, start_ms, end_ms FROM turns),
edges AS (SELECT episode, start_ms AS t FROM l UNION SELECT episode, end_ms FROM l),
cells AS (SELECT * FROM (SELECT episode, t AS s, lead(t) OVER (PARTITION BY episode ORDER BY t) AS e FROM edges) WHERE e IS NOT NULL),
x AS (SELECT DISTINCT c.episode, s, e, label, side FROM cells c JOIN l ON l.episode = c.episode AND l.start_ms < c.e AND l.end_ms > c.s),
v AS (SELECT episode, s, e, label, max(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS r, max(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS h FROM x GROUP BY ALL),
ev2 AS (SELECT episode, e - s AS ms, sum(r) AS r, sum(h) AS h, sum(r * h) AS c FROM v GROUP BY episode, s, e)"""


@query(
    "j7_der_sums",
    f"""WITH {_side_sql()} SELECT episode, CAST(sum(r * ms) AS BIGINT) AS ref_ms, CAST(sum(greatest(0, r - h) * ms) AS BIGINT) AS missed_ms, CAST(sum(greatest(0, h - r) * ms) AS BIGINT) AS false_ms,
  CAST(sum((least(r, h) - c) * ms) AS BIGINT) AS confused_ms FROM ev2 GROUP BY 1""",
)
def j7_der_sums(spark, sf_dir):
    """Under the identity map: both sides carry the same labels."""
    ref, hyp = _two_sides(spark, sf_dir)
    return al.diarization_sums(al.duration_events(ref, hyp, ["episode"], "label", 600_000), ["episode"])


@query(
    "j8_jer",
    f"""WITH {_side_sql()}, j AS (SELECT episode, label, sum(r * h * (e - s)) AS i, sum(greatest(r, h) * (e - s)) AS u, sum(r * (e - s)) AS t FROM v GROUP BY ALL)
SELECT episode, round(avg(1 - i / u), 6) AS jer, count(*) AS n FROM j WHERE t > 0 GROUP BY 1""",
)
def j8_jer(spark, sf_dir):
    ref, hyp = _two_sides(spark, sf_dir)
    e = al.duration_events(ref, hyp, ["episode"], "label", 600_000)
    by = e.select("episode", "ms", "ref", "hyp", F.explode(F.array_union("ref", "hyp")).alias("label"))
    r, h = (F.array_contains(F.col(c), F.col("label")).cast("long") for c in ("ref", "hyp"))
    j = by.groupBy("episode", "label").agg(F.sum(r * h * F.col("ms")).alias("i"), F.sum(F.col("ms")).alias("u"), F.sum(r * F.col("ms")).alias("t")).where("t > 0")
    return j.groupBy("episode").agg(F.round(F.avg(1 - F.col("i") / F.col("u")), 6).alias("jer"), F.count("*").alias("n"))


def _sides_of(t):
    one = lambda k: t.where(f"event_id % 2 = {k}").select(F.col("episode").alias("source"), "speaker", "start_ms", "end_ms")
    return one(0), one(1)


@query(
    "j9_speaker_count_error",
    f"""WITH {turns_sql()}, c AS (SELECT episode AS source, count(DISTINCT CASE WHEN event_id % 2 = 0 THEN speaker END) AS ref_speakers, count(DISTINCT CASE WHEN event_id % 2 = 1 THEN speaker END) AS hyp_speakers FROM turns GROUP BY 1)
SELECT *, CASE WHEN ref_speakers > 0 THEN hyp_speakers - ref_speakers END AS signed, CASE WHEN ref_speakers > 0 THEN abs(hyp_speakers - ref_speakers) END AS absolute FROM c""",
)
def j9_speaker_count_error(spark, sf_dir):
    return ev.speaker_counts(*_sides_of(turns(spark, sf_dir)), ["source"])


@query(
    "j10_overlap_prf",
    f"""WITH {turns_sql()}, a AS (SELECT episode AS source, start_ms, end_ms FROM turns WHERE kind = 'click'), b AS (SELECT episode AS source, start_ms, end_ms FROM turns WHERE kind = 'view'), {subtracted_sql('d', 'a', 'b', 'source')},
la AS (SELECT source, sum(end_ms - start_ms) AS r FROM d_a GROUP BY 1), lb AS (SELECT source, sum(end_ms - start_ms) AS h FROM d_b GROUP BY 1), lo AS (SELECT source, sum(end_ms - start_ms) AS o FROM d GROUP BY 1),
k AS (SELECT DISTINCT episode AS source, CAST(right(episode, 2) AS INTEGER) % 4 > 0 AS known FROM turns),
x AS (SELECT k.source, known, CAST(coalesce(r, 0) AS BIGINT) AS r, CAST(coalesce(h, 0) AS BIGINT) AS h, CAST(coalesce(r, 0) - coalesce(o, 0) AS BIGINT) AS i FROM k LEFT JOIN la USING (source) LEFT JOIN lb USING (source) LEFT JOIN lo USING (source)),
y AS (SELECT *, CASE WHEN known AND h > 0 THEN i / CAST(h AS DOUBLE) END AS p, CASE WHEN known AND r > 0 THEN i / CAST(r AS DOUBLE) END AS q FROM x)
SELECT source, r AS overlap_ref_ms, h AS overlap_hyp_ms, i AS overlap_both_ms, round(p, 6) AS precision, round(q, 6) AS recall, CASE WHEN p + q > 0 THEN round(2 * p * q / (p + q), 6) END AS f1,
  CASE WHEN NOT known THEN 'not_available' WHEN r > 0 THEN 'scored' ELSE 'insufficient_evidence' END AS overlap_status FROM y""",
)
def j10_overlap_prf(spark, sf_dir):
    """Clicks stand for the reference's overlaps, views for the hypothesis'; every fourth day has no explicit truth."""
    t = turns(spark, sf_dir)
    side = lambda k: t.where(F.col("kind") == k).select(F.col("episode").alias("source"), "start_ms", "end_ms")
    keys = t.select(F.col("episode").alias("source")).distinct()
    return ev.overlap_rates(side("click"), side("view"), keys, keys.where("CAST(right(source, 2) AS INT) % 4 > 0"), ["source"])


@query(
    "j14_verdict",
    """SELECT doc_id, CASE WHEN doc_id % 13 = 0 OR doc_id % 7 = 0 OR doc_id % 17 = 0 OR n_chars < 200 THEN 'insufficient_evidence' WHEN w IS NULL OR d IS NULL THEN 'blocked' WHEN w <= 0.25 AND d <= 0.25 THEN 'pass' ELSE 'blocked' END AS verdict
FROM (SELECT doc_id, n_chars, CASE WHEN doc_id % 11 > 0 THEN (doc_id % 40) / 100.0 END AS w, (doc_id % 30) / 100.0 AS d FROM documents)""",
)
def j14_verdict(spark, sf_dir):
    """Gates by number: a declared split, a human review, fingerprints (null where doc_id divides by 17)."""
    i = F.col("doc_id")
    wer = F.when(i % 11 > 0, (i % 40) / 100.0)
    gates = (i % 13 > 0, i % 7 > 0, F.when(i % 17 > 0, True))
    return table(spark, sf_dir, "documents").select("doc_id", ag.verdict(wer, (i % 30) / 100.0, F.col("n_chars"), *gates).alias("verdict"))


@query("d5_text_chunks")
def d5_text_chunks(spark, sf_dir):
    return sg.text_chunks(words(spark, sf_dir), most_words=40)


@query("e9_exemplars")
def e9_exemplars(spark, sf_dir):
    """Ten excerpts a speaker at most: the operator's own limit."""
    return sg.exemplars(turns(spark, sf_dir), 600_000)


def _exclusive(t):
    w = Window.partitionBy("episode").orderBy("start_ms", "event_id")
    return t.withColumn("next", F.lead("start_ms").over(w)).withColumn("end_ms", F.least("end_ms", F.coalesce("next", "end_ms"))).where("start_ms < end_ms")


@query("l1_native_candidates")
def l1_native_candidates(spark, sf_dir):
    t = turns(spark, sf_dir)
    return sg.native_candidates(t, _exclusive(t), ["episode"], 600_000)


@query("l5_native_segments")
def l5_native_segments(spark, sf_dir):
    t = turns(spark, sf_dir)
    return sg.native_segments(t, _exclusive(t), ["episode"], 600_000)


@query("j5_cpwer")
def j5_cpwer(spark, sf_dir):
    """Per pair of consecutive turns: streams by role against the same words dealt out by halves."""
    schema = "conv_id long, turn long, errors long, total long, value double"

    def score(batches):
        import pandas as pd

        for g in batches:
            rows = []
            for r in g.itertuples(index=False):
                ref, hyp = list(r.ref), list(r.hyp)
                got = al.cpwer({"a": ref, "b": hyp}, {"x": hyp[: len(hyp) // 2], "y": ref + hyp[len(hyp) // 2 :]})
                rows.append((r.conv_id, r.turn, got["errors"], got["total"], got["value"]))
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "errors", "total", "value"])

    return _pairs(spark, sf_dir).mapInPandas(score, schema)


@query("j6_speaker_map")
def j6_speaker_map(spark, sf_dir):
    """Per episode the one-to-one map of greatest common time between two sides of the turns."""
    import pandas as pd

    ref, hyp = _two_sides(spark, sf_dir)
    e = al.duration_events(ref, hyp, ["episode"], "label", 600_000)
    w = e.select("episode", "ms", F.explode("ref").alias("r"), "hyp").select("episode", "ms", "r", F.explode("hyp").alias("h")).groupBy("episode", "r", "h").agg(F.sum("ms").alias("ms"))

    def choose(key: tuple, g: pd.DataFrame) -> pd.DataFrame:  # one row for each pair of labels of an episode
        found = al.speaker_map({(h, r): int(ms) for h, r, ms in g[["h", "r", "ms"]].itertuples(index=False)})
        return pd.DataFrame([(key[0], h, r) for h, r in found.items()], columns=["episode", "hyp_label", "ref_label"])

    return w.groupBy("episode").applyInPandas(choose, "episode string, hyp_label string, ref_label string")


@query("j12_timing_errors")
def j12_timing_errors(spark, sf_dir):
    """Median and 95th percentile of start errors of equal words, each conversation turn against the next."""
    w = words(spark, sf_dir).groupBy("episode", "turn").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "text"))).alias("w"))
    nxt = w.select("episode", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))

    def score(batches):
        import pyarrow as pa

        for g in (x for b in batches for x in al.sliced(b)):
            rows = []
            for episode, *sides in zip(*(c.to_pylist() for c in g.columns), strict=True):
                a, b = ([{"text": x["text"], "start_ms": x["start_ms"] - y[0]["start_ms"], "end_ms": x["end_ms"] - y[0]["start_ms"]} for x in y] for y in sides)
                rows += [(episode, s, e) for s, e in al.timing_errors(a, b)]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["episode", "s", "e"])

    found = w.join(nxt, ["episode", "turn"]).select("episode", "w", "v").mapInArrow(score, "episode long, s long, e long")
    return found.groupBy("episode").agg(F.count("*").alias("n"), F.percentile("s", 0.5).alias("median_start"), F.percentile("s", 0.95).alias("p95_start"))


_CUE = "lpad(CAST({0} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0')"


@query(
    "b8_export_srt",
    f"""WITH {WORDS}, n AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY start_ms, end_ms, word_id) AS n FROM timed)
SELECT episode, n, CAST(n AS VARCHAR) || chr(10) || {_CUE.format("start_ms")} || ' --> ' || {_CUE.format("end_ms")} || chr(10) || '[' || speaker || '] ' || text || chr(10) AS line FROM n""",
)
def b8_export_srt(spark, sf_dir):
    return io.export_lines(words(spark, sf_dir).withColumn("overlap", F.lit(False)), "srt")


@query(
    "b9_export_rttm",
    f"""WITH {turns_sql()}, n AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY start_ms, end_ms, speaker) AS n FROM turns)
SELECT episode, n, 'SPEAKER ' || episode || ' 1 ' || CAST(start_ms // 1000 AS VARCHAR) || '.' || lpad(CAST(start_ms % 1000 AS VARCHAR), 3, '0') || ' ' || CAST((end_ms - start_ms) // 1000 AS VARCHAR) || '.' || lpad(CAST((end_ms - start_ms) % 1000 AS VARCHAR), 3, '0')
  || ' <NA> <NA> ' || CAST(speaker AS VARCHAR) || ' <NA> <NA>' AS line FROM n""",
)
def b9_export_rttm(spark, sf_dir):
    return io.export_rttm(turns(spark, sf_dir))


@query(
    "c11_validate_rows",
    f"""WITH {turns_sql()} SELECT event_id, array_to_string(list_filter([CASE WHEN end_ms <= start_ms THEN 'empty' END, CASE WHEN end_ms > 86400000 THEN 'beyond' END, CASE WHEN start_ms < 0 THEN 'negative' END], lambda x: x IS NOT NULL), ',') AS faults
FROM turns WHERE end_ms <= start_ms OR end_ms > 86400000 OR start_ms < 0""",
)
def c11_validate_rows(spark, sf_dir):
    checks = {"empty": "end_ms <= start_ms", "beyond": "end_ms > 86400000", "negative": "start_ms < 0"}
    faults = F.array_join(F.array_compact(F.array(*[F.when(F.expr(c), n) for n, c in checks.items()])), ",")
    return turns(spark, sf_dir).select("event_id", faults.alias("faults")).where("faults <> ''")


@query(
    "c6_mask_words",
    f"WITH {WORDS} SELECT episode, word_id FROM timed w WHERE text NOT LIKE '%a' AND NOT EXISTS (SELECT 1 FROM sturns s WHERE s.episode = w.episode AND s.speaker = 'system' AND s.start_ms < w.end_ms AND s.end_ms > w.start_ms)",
)
def c6_mask_words(spark, sf_dir):
    w = words(spark, sf_dir)
    masks = speaker_turns(w).where("speaker = 'system'").select("episode", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    hit = iv.range_join(w.select("episode", "word_id", "start_ms", "end_ms"), masks, ["episode"], 10_000).select("episode", "word_id").distinct()
    return w.where("text NOT LIKE '%a'").select("episode", "word_id").join(hit, ["episode", "word_id"], "left_anti")


@query(
    "c14_label_keywords",
    "SELECT doc_id, contains(lower(text), 'scum') OR contains(lower(text), 'trash') OR contains(lower(text), 'license') AS hit FROM documents",
)
def c14_label_keywords(spark, sf_dir):
    words_ = F.array(F.lit("scum"), F.lit("trash"), F.lit("license"))
    return table(spark, sf_dir, "documents").select("doc_id", F.exists(words_, lambda k: F.contains(F.lower("text"), k)).alias("hit"))


@query("j15_evaluate_documents")
def j15_evaluate_documents(spark, sf_dir):
    """Conversations against themselves with every seventh word lost and the roles renamed."""
    from lorekeep.operators import scoring

    said = materialize(words(spark, sf_dir), "words")
    w = said.withColumnRenamed("episode", "source")
    t = materialize(speaker_turns(said).withColumnRenamed("episode", "source"), "speaker-turns")
    other = F.when(F.col("speaker") == "user", "s1").when(F.col("speaker") == "assistant", "s2").otherwise("s3")
    counts = w.groupBy("source").agg(F.count("*").alias("timings"))
    return scoring.evaluate(w, w.where("word_id % 7 <> 3").withColumn("speaker", other), t, t.withColumn("speaker", other), counts, 60_000)


@query(
    "j13_slice_catalog",
    """SELECT doc_id AS source, x.slice, x.s AS start_ms, x.e AS end_ms FROM (SELECT doc_id, unnest([{'slice': 'all', 's': 0, 'e': n_chars}, {'slice': 'block-0', 's': 0, 'e': n_chars // 5}, {'slice': 'block-1', 's': n_chars // 5, 'e': n_chars * 2 // 5},
  {'slice': 'block-2', 's': n_chars * 2 // 5, 'e': n_chars * 3 // 5}, {'slice': 'block-3', 's': n_chars * 3 // 5, 'e': n_chars * 4 // 5}, {'slice': 'block-4', 's': n_chars * 4 // 5, 'e': n_chars},
  {'slice': 'development', 's': 0, 'e': n_chars * 4 // 5}, {'slice': 'held_out', 's': n_chars * 4 // 5, 'e': n_chars}]) AS x FROM documents)""",
)
def j13_slice_catalog(spark, sf_dir):
    from lorekeep.operators import scoring

    return scoring.slice_catalog(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.col("n_chars").alias("duration_ms")))


@query(
    "j13_slice_ranges",
    """WITH b AS (SELECT doc_id AS source, n_chars AS d FROM documents), x AS (
  SELECT source, 0 AS o, unnest([{'n': 'all', 's': 0, 'e': d}, {'n': 'block-0', 's': 0, 'e': d // 5}, {'n': 'block-1', 's': d // 5, 'e': d * 2 // 5}, {'n': 'block-2', 's': d * 2 // 5, 'e': d * 3 // 5}, {'n': 'block-3', 's': d * 3 // 5, 'e': d * 4 // 5},
    {'n': 'block-4', 's': d * 4 // 5, 'e': d}, {'n': 'development', 's': 0, 'e': d * 4 // 5}, {'n': 'held_out', 's': d * 4 // 5, 'e': d}]) AS v FROM b
  UNION ALL SELECT source, 1, {'n': CASE WHEN source % 3 = 0 THEN 'block-1' ELSE 'custom' END, 's': 1, 'e': d} FROM b WHERE source % 2 = 0
  UNION ALL SELECT source, 2, {'n': 'overlap', 's': d // 3, 'e': d // 2} FROM b WHERE source % 5 = 0 UNION ALL SELECT source, 3, {'n': 'unintelligible', 's': 2, 'e': 7} FROM b WHERE source % 7 = 0)
SELECT source, v.n AS slice, v.s AS start_ms, v.e AS end_ms FROM x QUALIFY o = min(o) OVER (PARTITION BY source, v.n)""",
)
def j13_slice_ranges(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.col("n_chars").alias("duration_ms"))
    name = F.when(F.col("source") % 3 == 0, "block-1").otherwise("custom")
    part = lambda where, s, e: rows.where(where).select("source", F.expr(s).cast("long").alias("start_ms"), F.expr(e).cast("long").alias("end_ms"))
    custom = part("source % 2 = 0", "1", "duration_ms").withColumn("slice", name)
    return ev.slice_ranges(rows, custom, part("source % 5 = 0", "duration_ms div 3", "duration_ms div 2"), part("source % 7 = 0", "2", "7"))


def _slices_of(w):
    spans = w.groupBy("source").agg(F.max("end_ms").alias("duration_ms"))
    return ev.slice_ranges(spans)


@query("j15_evaluate_slices")
def j15_evaluate_slices(spark, sf_dir):
    """Conversations against themselves with every seventh word lost and the roles renamed, by slice; every fiftieth word masked."""
    said = materialize(words(spark, sf_dir), "words")
    w = said.withColumnRenamed("episode", "source")
    t = materialize(speaker_turns(said).withColumnRenamed("episode", "source"), "speaker-turns")
    other = F.when(F.col("speaker") == "user", "s1").when(F.col("speaker") == "assistant", "s2").otherwise("s3")
    masks = w.where("word_id % 50 = 7").select("source", "start_ms", "end_ms")
    return ev.evaluate_slices(w, w.where("word_id % 7 <> 3").withColumn("speaker", other), t, t.withColumn("speaker", other), _slices_of(w), 60_000, masks, w.where("word_id % 3 = 0").select("source", "word_id"))


@query("j16_score_diarization")
def j16_score_diarization(spark, sf_dir):
    """Even against odd events of a day, by blocks of it, with a collar; the first of a month lacks a hypothesis."""
    ref, hyp = _sides_of(turns(spark, sf_dir).withColumn("speaker", (F.col("speaker") % 6).cast("string")))
    spans = ref.groupBy("source").agg(F.max("end_ms").alias("duration_ms"))
    return ev.score_diarization(ref, hyp, ev.slice_ranges(spans), 600_000, 250, unscorable=spans.where("source LIKE '%-01'").select("source"))


def _manifest(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.expr("conv_id * 1000 + turn").alias("chunk_id"), "conv_id", "turn", "role", "text").dropDuplicates(["chunk_id"])
    w = Window.partitionBy("conv_id").orderBy("turn")
    none = F.lit(None).cast("array<int>")
    one = F.array(F.lit(0))
    rows = c.withColumn("hyp_text", F.lead("text").over(w))
    chunks = rows.select("chunk_id", "role")
    status = F.when(F.col("turn") % 5 == 4, "machine").otherwise("human_truth")
    refs = rows.select("chunk_id", F.lit(2).alias("revision"), status.alias("review_status"), F.col("text").alias("ref_text"), F.when(F.col("turn") % 3 == 0, one).otherwise(none).alias("ref_mask"))
    refs = refs.unionByName(rows.select("chunk_id", F.lit(1).alias("revision"), F.lit("human_truth").alias("review_status"), F.lit("old").alias("ref_text"), none.alias("ref_mask")))
    hyps = rows.where("hyp_text IS NOT NULL").select("chunk_id", F.lit("m").alias("model"), "hyp_text", F.when(F.col("turn") % 6 == 0, one).otherwise(none).alias("hyp_mask"))
    return chunks, refs, hyps


@query("j1_edit_operations")
def j1_edit_operations(spark, sf_dir):
    """Operations of each pair of neighbouring turns by kind, from the table function edit_ops in SQL."""
    al.register_edit_ops(spark)
    _pairs(spark, sf_dir).createOrReplaceTempView("lorekeep_pairs")
    return spark.sql("SELECT conv_id, turn, op, count(*) AS n FROM lorekeep_pairs, LATERAL edit_ops(ref, hyp) GROUP BY conv_id, turn, op")


def _overlapped(spark, sf_dir):
    """Pairs of turns as overlapped speech: a stream for each role, heard word by word in turn, every ninth word lost."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", F.expr("turn div 2").alias("part"), "turn", "role", "text")
    none = F.lit(None).cast("array<int>")
    streams = c.groupBy("conv_id", "part", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    refs = streams.groupBy("conv_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("role", "text"))), lambda x: F.struct(x["text"].alias("text"), none.alias("mask"))).alias("ref_streams"))
    words_ = F.flatten(F.transform("ref_streams", lambda s, k: F.transform(tx.tokens(s["text"]), lambda w, i: F.struct(i.alias("i"), k.alias("k"), w.alias("w")))))
    heard = F.transform(F.filter(F.array_sort(words_), lambda x: (x["i"] + x["k"]) % 9 != 8), lambda x: x["w"])
    rows = refs.withColumn("hyp_text", F.array_join(heard, " ")).withColumn("ref_text", F.array_join(F.transform("ref_streams", lambda s: s["text"]), " "))
    return rows.select(
        F.expr("conv_id * 1000 + part").alias("chunk_id"), F.lit("m").alias("model"), F.when(F.col("part") % 7 == 6, "machine").otherwise("human_truth").alias("review_status"), "ref_text", "hyp_text",
        none.alias("ref_mask"), none.alias("hyp_mask"), "ref_streams", F.lit(None).cast("array<struct<text:string,mask:array<int>>>").alias("hyp_streams"),
    )


@query("j4_orc_wer")
def j4_orc_wer(spark, sf_dir):
    """Chunks of overlapped speech, scored against the best interleaving of their speakers' streams."""
    return ev.score_chunks(_overlapped(spark, sf_dir)).select("chunk_id", "model", "status", "wer_errors", "wer_total", *[f"orc_{c}" for c in ("status", "errors", "substitutions", "deletions", "insertions", "total", "wer")])


@query("i11_chunk_rates")
def i11_chunk_rates(spark, sf_dir):
    """Scores of chunks summed by model and role."""
    return ev.micro_average(ev.score_manifest(*_manifest(spark, sf_dir)), ["model", "role"], "wer_errors", "wer_total")


@query("j17_score_chunks")
def j17_score_chunks(spark, sf_dir):
    """Each conversation turn against the next, as chunks of a manifest with two revisions of every reference."""
    return ev.score_manifest(*_manifest(spark, sf_dir)).drop("ref_text", "hyp_text", "ref_mask", "hyp_mask")


@query(
    "i11_micro_average",
    """SELECT lang, count(*) AS n, count(*) FILTER (s = 'unscorable') AS n_unscorable, count(*) FILTER (s = 'insufficient_evidence') AS n_insufficient, CAST(sum(e) FILTER (s = 'scored') AS BIGINT) AS errors, CAST(coalesce(sum(t) FILTER (s = 'scored'), 0) AS BIGINT) AS total,
  round(sum(e) FILTER (s = 'scored') / CAST(nullif(sum(t) FILTER (s = 'scored'), 0) AS DOUBLE), 6) AS rate,
  CASE WHEN bool_or(s = 'scored') AND bool_or(s = 'unscorable') THEN 'partial' WHEN bool_or(s = 'scored') THEN 'scored' WHEN bool_or(s = 'unscorable') THEN 'unscorable' WHEN bool_or(s = 'insufficient_evidence') THEN 'insufficient_evidence' ELSE 'not_applicable' END AS status
FROM (SELECT lang || ':' || source AS lang, n_chars % 17 AS e, n_chars AS t, CASE doc_id % 6 WHEN 0 THEN 'scored' WHEN 1 THEN 'insufficient_evidence' WHEN 2 THEN 'unscorable' WHEN 3 THEN 'scored' ELSE 'not_applicable' END AS s FROM documents) GROUP BY 1""",
)
def i11_micro_average(spark, sf_dir):
    i = F.col("doc_id") % 6
    status = F.when(i.isin(0, 3), "scored").when(i == 1, "insufficient_evidence").when(i == 2, "unscorable").otherwise("not_applicable")
    rows = table(spark, sf_dir, "documents").select(F.concat_ws(":", "lang", "source").alias("lang"), (F.col("n_chars") % 17).alias("e"), F.col("n_chars").alias("t"), status.alias("status"))
    return ev.micro_average(rows, ["lang"], "e", "t")


@query(
    "c7_masked_tokens",
    r"SELECT conv_id, turn, role, len(k) AS n, md5(array_to_string(k, '|')) AS digest FROM (SELECT conv_id, turn, role, list_filter(t, lambda x, i: i <> 1 AND i <> 3) AS k FROM (SELECT *, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS t FROM conversations) WHERE len(t) > 2)",
)
def c7_masked_tokens(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(F.size(tx.tokens("text")) > 2)
    k = tx.masked_tokens(F.col("text"), F.array(F.lit(0), F.lit(2)))
    return c.select("conv_id", "turn", "role", k.alias("k")).select("conv_id", "turn", "role", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", "|")).alias("digest"))


@query(
    "d6_chunk_faults",
    f"""WITH {WORDS}, x AS (SELECT episode, word_id AS i, CASE WHEN word_id % 41 = 40 THEN word_id - 1 ELSE word_id END AS word_id, CASE WHEN word_id % 29 = 28 THEN start_ms - 700 ELSE start_ms END AS start_ms, CASE WHEN word_id % 37 = 36 THEN end_ms + 61000 ELSE end_ms END AS end_ms FROM timed),
y AS (SELECT *, row_number() OVER (PARTITION BY episode, word_id ORDER BY i) AS r, lag(start_ms) OVER (PARTITION BY episode ORDER BY i) AS p, max(i * 300 + 250) OVER (PARTITION BY episode) AS d FROM x)
SELECT episode, i, CASE WHEN r > 1 THEN 'repeated_id' WHEN end_ms > d THEN 'beyond_duration' WHEN start_ms < p THEN 'out_of_order' WHEN end_ms - start_ms > 60000 THEN 'too_long' END AS fault FROM y
WHERE r > 1 OR end_ms > d OR start_ms < p OR end_ms - start_ms > 60000""",
)
def d6_chunk_faults(spark, sf_dir):
    w = words(spark, sf_dir).withColumn("i", F.col("word_id"))
    w = w.withColumn("duration_ms", F.max("end_ms").over(Window.partitionBy("episode")))
    i = F.col("i")
    w = w.withColumns({"word_id": F.when(i % 41 == 40, i - 1).otherwise(i), "start_ms": F.when(i % 29 == 28, F.col("start_ms") - 700).otherwise(F.col("start_ms")), "end_ms": F.when(i % 37 == 36, F.col("end_ms") + 61_000).otherwise(F.col("end_ms"))})
    return sg.chunk_faults(w, "duration_ms").select("episode", "i", "fault")


def _durations(t):
    return t.groupBy("episode").agg(F.max("end_ms").alias("duration_ms"))


_COMMUNITY = f"""{turns_sql()}, {merged_sql('busy', 'turns', 'episode')}, dur AS (SELECT episode, max(end_ms) AS d FROM turns GROUP BY 1),
gaps AS (SELECT * FROM (SELECT episode, end_ms AS s, coalesce(lead(start_ms) OVER (PARTITION BY episode ORDER BY start_ms), d) AS e FROM busy JOIN dur USING (episode) UNION ALL SELECT episode, 0, min(start_ms) FROM busy GROUP BY 1) WHERE e - s >= 250),
o AS (SELECT episode, end_ms AS s, arg_max(speaker, (start_ms, end_ms, speaker)) AS sp FROM turns GROUP BY ALL), i AS (SELECT episode, start_ms AS e, arg_min(speaker, (end_ms, start_ms, speaker)) AS sp FROM turns GROUP BY ALL),
g AS (SELECT episode, (s + e) // 2 AS t, CASE WHEN e - s >= 600 THEN 'strong_gap' ELSE 'short_gap' END || CASE WHEN o.sp <> i.sp THEN '_and_speaker_change' ELSE '' END AS kind, e - s AS gap_ms FROM gaps LEFT JOIN o USING (episode, s) LEFT JOIN i USING (episode, e)),
p AS (SELECT DISTINCT a.episode, (a.end_ms + b.start_ms) // 2 AS t FROM turns a JOIN turns b ON a.episode = b.episode AND a.speaker <> b.speaker AND abs(b.start_ms - a.end_ms) <= 250),
q AS (SELECT p.episode, t, count(DISTINCT speaker) FILTER (start_ms < t AND t <= end_ms) AS nb, min(speaker) FILTER (start_ms < t AND t <= end_ms) AS b, count(DISTINCT speaker) FILTER (start_ms <= t AND t < end_ms) AS na, min(speaker) FILTER (start_ms <= t AND t < end_ms) AS a
  FROM p JOIN turns r ON r.episode = p.episode AND start_ms <= t AND end_ms >= t GROUP BY ALL),
u AS (SELECT * FROM g UNION ALL SELECT episode, t, 'speaker_change', NULL FROM q WHERE nb = 1 AND na = 1 AND a <> b)"""


def _community_sql(segments_sql: str) -> str:
    return f"""WITH {_COMMUNITY}, {segments_sql}, v AS (SELECT u.*, EXISTS (SELECT 1 FROM segs x WHERE x.n > 1 AND x.episode = u.episode AND x.start_ms - 250 <= t AND t <= x.end_ms + 250) AS conflict FROM u),
k AS (SELECT *, CASE kind WHEN 'strong_gap_and_speaker_change' THEN 1 WHEN 'strong_gap' THEN 2 WHEN 'speaker_change' THEN 3 WHEN 'short_gap_and_speaker_change' THEN 4 ELSE 5 END AS rank FROM v WHERE kind <> 'speaker_change' OR NOT conflict)
SELECT episode, t, kind, gap_ms, conflict FROM (SELECT *, row_number() OVER (PARTITION BY episode, t ORDER BY rank, kind, gap_ms NULLS FIRST) AS r FROM k) WHERE r = 1"""


@query("l1_community_boundaries", _community_sql(segments_sql("turns")))
def l1_community_boundaries(spark, sf_dir):
    t = turns(spark, sf_dir)
    return sg.community_boundaries(t, _durations(t), ["episode"], 600_000)


@query("l3_community_segments")
def l3_community_segments(spark, sf_dir):
    t = turns(spark, sf_dir)
    return sg.community_segments(t, _durations(t), ["episode"], 600_000)


@query("l2_legacy_segments")
def l2_legacy_segments(spark, sf_dir):
    """Ends of clicks stand for silences, of views for turns, of others for acoustic changes."""
    t = turns(spark, sf_dir)
    kind = F.when(F.col("kind") == "click", "silence").when(F.col("kind") == "view", "turn").otherwise("acoustic")
    return sg.legacy_segments(t.select("episode", F.col("end_ms").alias("t"), kind.alias("kind"), ((F.col("event_id") % 10) / 10).alias("confidence")), _durations(t), ["episode"])


_CHUNKS = "c AS (SELECT source, 0 AS start_ms, 3000 + n_chars * 37 % 27001 AS end_ms, CASE WHEN n_chars * 37 % 27001 = 27000 THEN 'hard_maximum' WHEN doc_id % 9 = 0 THEN 'episode_end' ELSE lang END AS reason, doc_id % 4 = 0 AS conflict, CASE WHEN doc_id % 3 > 0 THEN 'phase' || doc_id % 3 END AS phase FROM documents)"


def _chunks(spark, sf_dir):
    ms = F.col("n_chars") * 37 % 27_001
    reason = F.when(ms == 27_000, "hard_maximum").when(F.col("doc_id") % 9 == 0, "episode_end").otherwise(F.col("lang"))
    phase = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("phase"), (F.col("doc_id") % 3).cast("string")))
    return table(spark, sf_dir, "documents").select("source", F.lit(0).cast("long").alias("start_ms"), (ms + 3_000).alias("end_ms"), reason.alias("reason"), (F.col("doc_id") % 4 == 0).alias("conflict"), phase.alias("phase"))


@query(
    "i5_chunk_distribution",
    f"""WITH {_CHUNKS}, m AS (SELECT *, end_ms - start_ms AS ms FROM c), l AS (SELECT source, list(ms ORDER BY ms) AS v FROM m GROUP BY 1)
SELECT source, count(*) AS n, round(avg(ms), 6) AS mean, any_value(v[len(v) // 2 + 1]) AS upper_median, any_value(v[CAST(ceil(len(v) * 90 / 100.0) AS BIGINT)]) AS p90, any_value(v[CAST(ceil(len(v) * 95 / 100.0) AS BIGINT)]) AS p95,
  count(*) FILTER (ms >= 8000 AND ms < 10000) AS bin_8_10, count(*) FILTER (ms >= 10000 AND ms < 12000) AS bin_10_12, count(*) FILTER (ms >= 12000 AND ms < 14000) AS bin_12_14, count(*) FILTER (ms >= 14000 AND ms < 16000) AS bin_14_16,
  count(*) FILTER (ms >= 16000 AND ms < 18000) AS bin_16_18, count(*) FILTER (ms >= 18000 AND ms < 20000) AS bin_18_20, count(*) FILTER (ms >= 20000 AND ms < 25000) AS bin_20_25, count(*) FILTER (ms >= 25000 AND ms < 30000) AS bin_25_30, count(*) FILTER (ms = 30000) AS bin_30,
  count(*) FILTER (reason = 'hard_maximum') AS n_hard, count(*) FILTER (conflict) AS n_conflict, count(*) FILTER (reason = 'episode_end' AND ms < 4000) AS n_short_end,
  round(100 * count(*) FILTER (ms BETWEEN 8000 AND 16000) / count(*), 6) AS share_8_16, round(100 * count(*) FILTER (ms > 16000) / count(*), 6) AS share_over_16, round(100 * count(*) FILTER (ms = 30000) / count(*), 6) AS share_30
FROM m JOIN l USING (source) GROUP BY 1""",
)
def i5_chunk_distribution(spark, sf_dir):
    return ag.chunk_distribution(_chunks(spark, sf_dir), ["source"])


@query("l6_reason_counts", f"WITH {_CHUNKS} SELECT source, 'reason' AS what, reason AS value, count(*) AS n FROM c WHERE reason IS NOT NULL GROUP BY ALL UNION ALL SELECT source, 'phase', phase, count(*) FROM c WHERE phase IS NOT NULL GROUP BY ALL")
def l6_reason_counts(spark, sf_dir):
    return ag.reason_counts(_chunks(spark, sf_dir), ["source"], "reason", "phase")


_HOURS = """h AS (SELECT DISTINCT episode, start_ms // 3600000 AS chunk FROM turns), std AS (SELECT h.episode AS day, chunk, h.episode || '/' || chunk AS episode, speaker, greatest(start_ms, chunk * 3600000) AS start_ms, least(end_ms, (chunk + 1) * 3600000) AS end_ms
  FROM h JOIN turns t ON t.episode = h.episode AND start_ms < (chunk + 1) * 3600000 AND end_ms > chunk * 3600000)"""


@query(
    "f9_chunk_speakers",
    f"""WITH {turns_sql()}, {_HOURS}, {segments_sql('std')}, k AS (SELECT episode, count(DISTINCT speaker) AS labels FROM std GROUP BY 1),
g AS (SELECT episode, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms, CAST(sum(CASE WHEN n > 1 THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS overlap_ms, CAST(max(n) AS BIGINT) AS most FROM segs GROUP BY 1),
x AS (SELECT h.episode, chunk, CAST(right(h.episode, 2) AS INTEGER) % 5 > 0 AS known, speech_ms, overlap_ms, most, labels FROM h JOIN g ON g.episode = h.episode || '/' || chunk JOIN k ON k.episode = g.episode)
SELECT episode, chunk, CASE WHEN known THEN speech_ms ELSE 0 END AS speech_ms, CASE WHEN known THEN overlap_ms ELSE 0 END AS overlap_ms, CASE WHEN known THEN most ELSE 0 END AS most, CASE WHEN known THEN labels ELSE 0 END AS labels, CASE WHEN known THEN labels END AS n_streams,
  CASE WHEN known THEN round(overlap_ms / CAST(speech_ms AS DOUBLE), 6) END AS overlap_fraction, CASE WHEN known THEN 'derived' ELSE 'unknown' END AS status,
  CASE WHEN NOT known OR speech_ms = 0 THEN 'uncertain' WHEN overlap_ms = 0 THEN CASE WHEN labels = 1 THEN 'single_speaker' ELSE 'multi_speaker_no_overlap' END WHEN overlap_ms >= 0.5 * speech_ms THEN 'heavy_overlap' ELSE 'partial_overlap' END AS kind FROM x""",
)
def f9_chunk_speakers(spark, sf_dir):
    """Hours of a day that have a turn's start; every fifth day has no diarization."""
    t = turns(spark, sf_dir)
    hours = t.select("episode", F.expr("start_ms div 3600000").alias("chunk")).distinct()
    hours = hours.withColumn("start_ms", F.col("chunk") * 3_600_000).withColumn("end_ms", F.col("start_ms") + 3_600_000)
    known = t.select("episode").distinct().where("CAST(right(episode, 2) AS INT) % 5 > 0")
    rows = sg.chunk_speaker_metadata(hours, t, _exclusive(t), known, ["episode"], 600_000)
    return rows.select("episode", "chunk", "speech_ms", "overlap_ms", "most", "labels", F.size("streams").cast("long").alias("n_streams"), "overlap_fraction", "status", "kind")


@query("e9_exclusions")
def e9_exclusions(spark, sf_dir):
    return sg.exemplar_exclusions(turns(spark, sf_dir), 600_000)


@query(
    "e11_quality_order",
    """WITH v AS (SELECT vec_id, label, vec_id * 10 AS start_ms, vec_id * 10 + vec_id % 7 AS end_ms, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS a FROM embeddings),
q AS (SELECT vec_id, label, start_ms, end_ms, len(list_filter(a, lambda x: x >= 0.999)) / len(a) AS c, len(list_filter(a, lambda x: x < 1e-4)) / len(a) AS s FROM v)
SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY c, s, end_ms - start_ms DESC, start_ms) AS "order" FROM q""",
)
def e11_quality_order(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("start_ms", F.col("vec_id") * 10).withColumn("end_ms", F.col("start_ms") + F.col("vec_id") % 7)
    return sg.quality_order(e, "embedding", ["label"]).select("vec_id", "label", "order")


@query(
    "k7_stage_fingerprint",
    """SELECT doc_id, sha256('{"configuration":{"lang":"' || lang || '"},"model_fingerprint_sha256":' || CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE '"' || sha256(lang) || '"' END || ',"pipeline_version":"dev","source_sha256":"' || sha256(text) || '","stage":"' || source
  || '","upstream_artifact_hashes":["' || sha256(source) || '","' || sha256(lang) || '"]}') AS key FROM documents""",
)
def k7_stage_fingerprint(spark, sf_dir):
    sha = lambda c: F.sha2(F.col(c), 256)
    key = tx.stage_fingerprint(F.col("source"), sha("text"), F.array(sha("source"), sha("lang")), F.when(F.col("doc_id") % 2 == 1, sha("lang")), F.concat(F.lit('{"lang":"'), "lang", F.lit('"}')), F.lit("dev"))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("key"))


@query(
    "k8_point_ids",
    """SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('exemplar:' || source || ':' || doc_id)) AS h FROM documents)""",
)
def k8_point_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.point_id(F.concat_ws(":", F.lit("exemplar"), "source", F.col("doc_id").cast("string"))).alias("id"))


@query("k14_instants", "SELECT event_id, strftime(ts + to_seconds(event_id % 1000), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS due FROM events")
def k14_instants(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("t"))
    return e.select("event_id", tx.instant(F.col("t"), (F.col("event_id") % 1000).cast("int")).alias("due"))


@query(
    "k13_difficulty",
    """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'human_boundary_bad' WHEN event_id % 13 = 0 THEN 'human_boundary_awkward' WHEN event_id % 7 = 0 THEN 'chunk_condition_degraded' WHEN event_type = 'click' THEN 'chunk_condition_music' WHEN event_id % 5 = 0 THEN 'chunk_condition_rapid_turn'
  WHEN value > 400 THEN 'chunk_condition_overlap' WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'review_queue_music' WHEN event_type = 'view' THEN 'review_queue_overlap' WHEN event_id % 3 = 0 THEN 'boundary_overlap_conflict' WHEN event_type = 'signup' THEN 'hard_maximum' ELSE 'no_difficulty_tag' END AS tag FROM events""",
)
def k13_difficulty(spark, sf_dir):
    i, kind = F.col("event_id"), F.col("event_type")
    review = F.when(i % 11 == 0, "bad").when(i % 13 == 0, "awkward").when(i % 17 == 0, "good")
    categories = F.when(kind == "view", F.array(F.when(i % 2 == 0, "music_containing").otherwise("overlap_containing"), F.lit("overlap_containing")))
    tag = tx.difficulty(review, i % 7 == 0, kind == "click", i % 5 == 0, F.col("value") > 400, categories, i % 3 == 0, F.when(kind == "signup", "hard_maximum"))
    return table(spark, sf_dir, "events").select("event_id", tag.alias("tag"))
