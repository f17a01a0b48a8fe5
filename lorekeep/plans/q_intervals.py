"""Queries of interval algebra and of joins by time."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import intervals as iv
from lorekeep.operators import joins
from lorekeep.plans.views import WORDS, speaker_turns, table, turns, turns_sql, words

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
BUCKET = 600_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def merged_sql(name: str, source: str, by: str) -> str:
    return f"""{name} AS (SELECT {by}, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (
  SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT {by}, start_ms, end_ms, max(end_ms) OVER (PARTITION BY {by} ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}))
  GROUP BY {by}, island)"""


def subtracted_sql(name: str, a: str, b: str, by: str) -> str:
    return (
        merged_sql(f"{name}_a", a, by) + ", " + merged_sql(f"{name}_b", b, by)
        + f""", {name}_e AS (SELECT {by}, t, sum(a) AS a, sum(b) AS b FROM (
  SELECT {by}, start_ms AS t, 1 AS a, 0 AS b FROM {name}_a UNION ALL SELECT {by}, end_ms, -1, 0 FROM {name}_a
  UNION ALL SELECT {by}, start_ms, 0, 1 FROM {name}_b UNION ALL SELECT {by}, end_ms, 0, -1 FROM {name}_b) GROUP BY {by}, t),
{name}_p AS (SELECT {by}, t AS start_ms, lead(t) OVER (PARTITION BY {by} ORDER BY t) AS end_ms, sum(a) OVER (PARTITION BY {by} ORDER BY t) AS a, sum(b) OVER (PARTITION BY {by} ORDER BY t) AS b FROM {name}_e),
{name}_k AS (SELECT {by}, start_ms, end_ms FROM {name}_p WHERE a > 0 AND b = 0 AND end_ms IS NOT NULL), """
        + merged_sql(name, f"{name}_k", by)
    )


def _t(spark, sf_dir):
    return turns(spark, sf_dir)


@query("f3_merge_ranges", f"WITH {turns_sql()}, {merged_sql('m', 'turns', 'episode')} SELECT * FROM m")
def f3_merge_ranges(spark, sf_dir):
    return iv.merge_ranges(_t(spark, sf_dir), ["episode"])


_KINDS = "a AS (SELECT * FROM turns WHERE kind IN ('click', 'view')), b AS (SELECT * FROM turns WHERE kind = 'error')"


def _ab(spark, sf_dir):
    t = _t(spark, sf_dir)
    return t.where("kind IN ('click', 'view')"), t.where("kind = 'error'")


@query("f4_subtract_ranges", f"WITH {turns_sql()}, {_KINDS}, {subtracted_sql('d', 'a', 'b', 'episode')} SELECT * FROM d")
def f4_subtract_ranges(spark, sf_dir):
    return iv.subtract_ranges(*_ab(spark, sf_dir), ["episode"])


@query(
    "f5_collar_ranges",
    f"""WITH {turns_sql()}, r AS (SELECT DISTINCT episode, 0 AS start_ms, 90000000 AS end_ms FROM turns),
c AS (SELECT DISTINCT episode, t - 250 AS start_ms, t + 250 AS end_ms FROM (SELECT episode, start_ms AS t FROM turns WHERE kind = 'signup' UNION SELECT episode, end_ms FROM turns WHERE kind = 'signup')),
{subtracted_sql('d', 'r', 'c', 'episode')} SELECT * FROM d""",
)
def f5_collar_ranges(spark, sf_dir):
    t = _t(spark, sf_dir)
    regions = t.select("episode").distinct().withColumn("start_ms", F.lit(0).cast("long")).withColumn("end_ms", F.lit(90_000_000).cast("long"))
    return iv.collar_ranges(t.where("kind = 'signup'"), regions, ["episode"], 250)


def segments_sql(source: str) -> str:
    return f"""edges AS (SELECT DISTINCT episode, start_ms AS t FROM {source} UNION SELECT episode, end_ms FROM {source}),
cells AS (SELECT * FROM (SELECT episode, t AS s, lead(t) OVER (PARTITION BY episode ORDER BY t) AS e FROM edges) WHERE e IS NOT NULL),
sets AS (SELECT c.episode, s, e, string_agg(DISTINCT CAST(speaker AS VARCHAR), ',' ORDER BY CAST(speaker AS VARCHAR)) AS active, count(DISTINCT speaker) AS n
  FROM cells c JOIN {source} t ON t.episode = c.episode AND t.start_ms < c.e AND t.end_ms > c.s GROUP BY ALL),
isl AS (SELECT *, sum(CASE WHEN pa = active AND pe = s THEN 0 ELSE 1 END) OVER (PARTITION BY episode ORDER BY s) AS island FROM (
  SELECT *, lag(active) OVER (PARTITION BY episode ORDER BY s) AS pa, lag(e) OVER (PARTITION BY episode ORDER BY s) AS pe FROM sets)),
segs AS (SELECT episode, min(s) AS start_ms, max(e) AS end_ms, any_value(active) AS active, any_value(n) AS n FROM isl GROUP BY episode, island)"""


def _named(spark, sf_dir):
    return _t(spark, sf_dir).withColumn("speaker", F.col("speaker").cast("string"))


def _shown(df):
    return df.select("episode", "start_ms", "end_ms", F.array_join("active", ",").alias("active"))


@query("f1_active_segments", f"WITH {turns_sql()}, {segments_sql('turns')} SELECT episode, start_ms, end_ms, active FROM segs")
def f1_active_segments(spark, sf_dir):
    return _shown(iv.segments(_named(spark, sf_dir), ["episode"], "speaker", BUCKET))


@query("f2_overlaps", f"WITH {turns_sql()}, {segments_sql('turns')} SELECT episode, start_ms, end_ms, active FROM segs WHERE n > 1")
def f2_overlaps(spark, sf_dir):
    return _shown(iv.overlap_intervals(_named(spark, sf_dir), ["episode"], "speaker", BUCKET))


@query(
    "f7_union_intersection",
    f"""WITH {turns_sql()}, {_KINDS}, {subtracted_sql('d', 'a', 'b', 'episode')},
la AS (SELECT episode, sum(end_ms - start_ms) AS a_ms FROM d_a GROUP BY 1), lb AS (SELECT episode, sum(end_ms - start_ms) AS b_ms FROM d_b GROUP BY 1), lo AS (SELECT episode, sum(end_ms - start_ms) AS o FROM d GROUP BY 1)
SELECT coalesce(la.episode, lb.episode) AS episode, CAST(coalesce(a_ms, 0) AS BIGINT) AS a_ms, CAST(coalesce(b_ms, 0) AS BIGINT) AS b_ms, CAST(coalesce(a_ms, 0) - coalesce(o, 0) AS BIGINT) AS both_ms
FROM la FULL JOIN lb USING (episode) LEFT JOIN lo ON lo.episode = coalesce(la.episode, lb.episode)""",
)
def f7_union_intersection(spark, sf_dir):
    return iv.union_intersection(*_ab(spark, sf_dir), ["episode"])


@query(
    "f8_speaker_condition",
    f"""WITH {turns_sql()}, {segments_sql('turns')},
k AS (SELECT episode, count(DISTINCT speaker) AS labels FROM turns GROUP BY 1),
g AS (SELECT episode, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms, CAST(sum(CASE WHEN n > 1 THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS overlap_ms, CAST(max(n) AS BIGINT) AS most FROM segs GROUP BY 1)
SELECT episode, speech_ms, overlap_ms, most, labels, round(overlap_ms / CAST(speech_ms AS DOUBLE), 6) AS overlap_fraction,
  CASE WHEN speech_ms = 0 THEN 'uncertain' WHEN overlap_ms = 0 THEN CASE WHEN labels = 1 THEN 'single_speaker' ELSE 'multi_speaker_no_overlap' END WHEN overlap_ms >= 0.5 * speech_ms THEN 'heavy_overlap' ELSE 'partial_overlap' END AS kind
FROM g JOIN k USING (episode)""",
)
def f8_speaker_condition(spark, sf_dir):
    return iv.speaker_condition(_t(spark, sf_dir), ["episode"], "speaker", BUCKET)


@query(
    "f10_tiles",
    """SELECT doc_id, s AS start_ms, least(s + 10000, n_chars * 40) AS end_ms FROM (SELECT doc_id, n_chars, unnest(range(0, n_chars * 40, 10000)) AS s FROM documents WHERE n_chars > 0)""",
)
def f10_tiles(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 40).alias("duration_ms"))
    return iv.tiles(rows, 10_000).select("doc_id", "start_ms", "end_ms")


@query(
    "f11_context_windows",
    """SELECT doc_id, s AS start_ms, least(s + 300000, d) AS end_ms, greatest(0, s - 5000) AS decode_start_ms, least(least(s + 300000, d) + 5000, d) AS decode_end_ms
FROM (SELECT doc_id, n_chars * 400 AS d, unnest(range(0, n_chars * 400, 300000)) AS s FROM documents WHERE n_chars > 0)""",
)
def f11_context_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 400).alias("duration_ms"))
    return iv.tiles(rows, 300_000, 5_000).drop("duration_ms")


@query("f12_owned_words", f"WITH {WORDS} SELECT episode, word_id, (start_ms + end_ms) // 20000 AS \"window\" FROM timed")
def f12_owned_words(spark, sf_dir):
    return iv.owned(words(spark, sf_dir), 10_000).select("episode", "word_id", "window")


@query(
    "f13_split_blocks",
    "SELECT doc_id, CAST(i AS INTEGER) AS block, i * n_chars // 5 AS start_ms, (i + 1) * n_chars // 5 AS end_ms, i = 4 AS held_out FROM documents CROSS JOIN range(5) r(i)",
)
def f13_split_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("duration_ms"))
    return iv.split_blocks(rows).drop("duration_ms")


@query(
    "f14_coverage_faults",
    f"""WITH {turns_sql()} SELECT event_id, CASE WHEN end_ms <= start_ms THEN 'empty' WHEN b < start_ms THEN 'gap' WHEN b > start_ms THEN 'overlap' WHEN end_ms - start_ms > 300000 THEN 'long' END AS fault
FROM (SELECT *, lag(end_ms) OVER (PARTITION BY episode, speaker ORDER BY start_ms, end_ms) AS b FROM turns) WHERE fault IS NOT NULL""",
)
def f14_coverage_faults(spark, sf_dir):
    return iv.coverage_faults(_t(spark, sf_dir), ["episode", "speaker"], 300_000).select("event_id", "fault")


@query(
    "g1_attribute_words",
    f"""WITH {WORDS}, p AS (SELECT w.episode, word_id, t.speaker AS s, least(w.end_ms, t.end_ms) - greatest(w.start_ms, t.start_ms) AS i,
  2 * t.start_ms <= w.start_ms + w.end_ms AND w.start_ms + w.end_ms < 2 * t.end_ms AS m
  FROM timed w JOIN sturns t ON t.episode = w.episode AND t.start_ms < w.end_ms AND t.end_ms > w.start_ms),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode, word_id ORDER BY i DESC, m DESC, s) AS r FROM p) WHERE r = 1)
SELECT w.episode, w.word_id, w.speaker, b.s AS attributed FROM timed w LEFT JOIN b USING (episode, word_id)""",
)
def g1_attribute_words(spark, sf_dir):
    w = words(spark, sf_dir)
    return joins.attribute_words(w, speaker_turns(w), ["episode"], 10_000).select("episode", "word_id", "speaker", "attributed")


@query(
    "g2_overlap_flag",
    f"""WITH {WORDS}, o AS (SELECT a.episode, greatest(a.start_ms, b.start_ms) AS s, least(a.end_ms, b.end_ms) AS e FROM sturns a JOIN sturns b
  ON a.episode = b.episode AND a.start_ms < b.end_ms AND a.end_ms > b.start_ms AND a.speaker < b.speaker)
SELECT episode, word_id, EXISTS (SELECT 1 FROM o WHERE o.episode = w.episode AND o.s < w.end_ms AND o.e > w.start_ms) AS in_overlap FROM timed w""",
)
def g2_overlap_flag(spark, sf_dir):
    w = words(spark, sf_dir)
    both = iv.overlap_intervals(speaker_turns(w), ["episode"], "speaker", 60_000)
    return joins.flag_overlap(w, both, ["episode"], 10_000).select("episode", "word_id", "in_overlap")


@query(
    "g10_near_pairs",
    f"""WITH {turns_sql()} SELECT a.episode, a.event_id AS a_id, b.event_id AS b_id, b.start_ms - a.end_ms AS gap_ms FROM turns a JOIN turns b
ON a.episode = b.episode AND a.speaker <> b.speaker AND b.start_ms BETWEEN a.end_ms - 250 AND a.end_ms + 250""",
)
def g10_near_pairs(spark, sf_dir):
    return joins.near_pairs(_t(spark, sf_dir), ["episode"], 250)


@query(
    "g11_nearest_within",
    f"""WITH {turns_sql()}, p AS (SELECT episode, event_id AS point_id, start_ms AS t FROM turns WHERE kind = 'purchase'), m AS (SELECT DISTINCT episode, end_ms AS m FROM turns WHERE kind = 'view'),
c AS (SELECT p.episode, point_id, m, row_number() OVER (PARTITION BY p.episode, point_id ORDER BY abs(t - m), m) AS r FROM p JOIN m ON p.episode = m.episode AND abs(t - m) <= 60000)
SELECT p.episode, p.point_id, p.t, coalesce(c.m, -1) AS nearest FROM p LEFT JOIN c ON c.episode = p.episode AND c.point_id = p.point_id AND r = 1""",
)
def g11_nearest_within(spark, sf_dir):
    t = _t(spark, sf_dir)
    points = t.where("kind = 'purchase'").select("episode", F.col("event_id").alias("point_id"), F.col("start_ms").alias("t"))
    marks = t.where("kind = 'view'").select("episode", F.col("end_ms").alias("m")).distinct()
    return joins.nearest_within(points, marks, ["episode"], 60_000).na.fill(-1, ["nearest"])


@query(
    "g12_edge_labels",
    f"""WITH {WORDS}, g AS (SELECT * FROM (SELECT episode, end_ms AS start_ms, lead(start_ms) OVER (PARTITION BY episode ORDER BY start_ms, end_ms, speaker) AS end_ms FROM sturns) WHERE end_ms > start_ms),
e AS (SELECT *, row_number() OVER (ORDER BY episode, start_ms, end_ms, speaker) AS event_id FROM sturns)
SELECT DISTINCT episode, start_ms, end_ms, (SELECT max_by(speaker, start_ms) FROM sturns s WHERE s.episode = g.episode AND s.end_ms = g.start_ms) AS label_before,
  (SELECT min_by(speaker, end_ms) FROM sturns s WHERE s.episode = g.episode AND s.start_ms = g.end_ms) AS label_after FROM g""",
)
def g12_edge_labels(spark, sf_dir):
    from pyspark.sql import Window

    t = speaker_turns(words(spark, sf_dir))
    w = Window.partitionBy("episode").orderBy("start_ms", "end_ms", "speaker")
    gaps = t.select("episode", F.col("end_ms").alias("start_ms"), F.lead("start_ms").over(w).alias("end_ms")).where("end_ms > start_ms").distinct()
    before = t.withColumn("event_id", F.col("start_ms"))
    return joins.edge_label(before, gaps, ["episode"]).select("episode", "start_ms", "end_ms", "label_before", "label_after")
