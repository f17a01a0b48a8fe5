"""Queries of relational pages, history, row sequences, aggregates, sampling, jobs and identity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.functions import variant
from lorekeep.functions.work import new_path
from lorekeep.operators import acoustics
from lorekeep.operators import aggregates as ag
from lorekeep.operators import batches
from lorekeep.operators import history as hi
from lorekeep.operators import identity, joins
from lorekeep.operators import pilot as pilots
from lorekeep.operators.jobs import Rules, job_log
from lorekeep.plans.views import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_EVENTS = "ev AS (SELECT event_id, user_id, event_type, value, CAST(epoch_us(ts) // 1000 AS BIGINT) AS t FROM events)"


def _events(spark, sf_dir):
    t = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 1000")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", t.alias("t"))


@query("g4_text_join", "SELECT d.doc_id, l.quality, l.toxic, d.n_chars FROM documents d JOIN labels l USING (doc_id)")
def g4_text_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "toxic", "n_chars")


@query(
    "g5_speakers_page",
    """SELECT c_custkey, c_name, n_name, r_name, coalesce(n, 0) AS n_orders, n IS NOT NULL AS has_orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey""",
)
def g5_speakers_page(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer")
    rows = c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    rows = rows.join(n, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("c_custkey", "c_name", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("n_orders"), F.col("n").isNotNull().alias("has_orders"))


@query("g6_latest_revision", f"WITH {_EVENTS} SELECT user_id, event_type, event_id, value, t FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t DESC, event_id DESC) AS r FROM ev) WHERE r = 1")
def g6_latest_revision(spark, sf_dir):
    return hi.latest(_events(spark, sf_dir), ["user_id", "event_type"], ["t", "event_id"]).select("user_id", "event_type", "event_id", "value", "t")


@query(
    "g7_pointer_join",
    f"""WITH {_EVENTS}, p AS (SELECT user_id, max(event_id) AS event_id FROM ev WHERE event_type = 'purchase' GROUP BY 1) SELECT p.user_id, e.event_id, e.value FROM p JOIN ev e ON e.event_id = p.event_id""",
)
def g7_pointer_join(spark, sf_dir):
    e = _events(spark, sf_dir)
    p = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return p.join(e.select("event_id", "value"), "event_id").select("user_id", "event_id", "value")


@query(
    "g8_review_queue",
    """SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS n_open,
  coalesce((SELECT o_orderstatus FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderkey DESC LIMIT 1), 'none') AS last_status FROM customer""",
)
def g8_review_queue(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.max_by("o_orderstatus", "o_orderkey").alias("last_status"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n_open", F.lit(0)).alias("n_open"), F.coalesce("last_status", F.lit("none")).alias("last_status"))


@query("g9_exists_flags", "SELECT doc_id, source, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS labelled, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS toxic FROM documents d")
def g9_exists_flags(spark, sf_dir):
    flags = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.col("toxic") == 1).alias("toxic"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(flags.withColumn("hit", F.lit(True)), "doc_id", "left")
    return rows.select("doc_id", "source", F.coalesce("hit", F.lit(False)).alias("labelled"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


@query("g15_missing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def g15_missing(spark, sf_dir):
    return joins.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])


@query(
    "g16_expected_observed",
    """SELECT doc_id, CASE WHEN o.id IS NULL THEN 'missing' ELSE 'n_chars' END AS faults FROM (SELECT doc_id, n_chars FROM documents) d
LEFT JOIN (SELECT doc_id AS id, length(text) - length(text) % 7 AS n FROM documents WHERE doc_id % 10 <> 3) o ON id = doc_id WHERE o.id IS NULL OR n IS DISTINCT FROM n_chars""",
)
def g16_expected_observed(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    seen = d.where("doc_id % 10 <> 3").select("doc_id", F.expr("CAST(length(text) - length(text) % 7 AS BIGINT)").alias("n_chars"))
    return joins.mismatches(d.select("doc_id", "n_chars"), seen, "doc_id", ["n_chars"])


@query("h1_topk_per_group", "SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 10")
def h1_topk_per_group(spark, sf_dir):
    """Ten per supplier: the limit is the operator's."""
    rows = table(spark, sf_dir, "lineitem")
    found = hi.top_per_group(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 10)
    return found.select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query("h2_transitions", f"WITH {_EVENTS} SELECT * FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS previous FROM ev) WHERE previous <> event_type")
def h2_transitions(spark, sf_dir):
    return hi.transitions(_events(spark, sf_dir), ["user_id"], ["t", "event_id"], "event_type").select("event_id", "event_type", "previous")


@query(
    "h4_run_length",
    f"""WITH {_EVENTS}, f AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n FROM r GROUP BY ALL""",
)
def h4_run_length(spark, sf_dir):
    return hi.run_lengths(_events(spark, sf_dir), ["user_id"], ["t", "event_id"], "event_type").select("user_id", F.col("run").cast("long").alias("run"), "event_type", "n")


@query(
    "h5_even_spread",
    """WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, pos FROM p WHERE n <= 7 OR list_contains([(2 * i + 1) * n // 14 FOR i IN [0, 1, 2, 3, 4, 5, 6]], pos)""",
)
def h5_even_spread(spark, sf_dir):
    """Seven per source, evenly placed: sampling is the operator."""
    return hi.even_spread(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 7)


@query("h6_quota", "SELECT source, 1000 // n + CASE WHEN i < 1000 % n THEN 1 ELSE 0 END AS quota FROM (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))")
def h6_quota(spark, sf_dir):
    return hi.quotas(table(spark, sf_dir, "documents"), "source", 1000)


@query("h7_page_of_offset", "SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1) // 100 AS page FROM documents")
def h7_page_of_offset(spark, sf_dir):
    return hi.page_of(table(spark, sf_dir, "documents"), ["source"], ["n_chars", "doc_id"], 100).select("doc_id", "source", "page")


@query("h8_revision_chain", "SELECT * FROM (SELECT l_orderkey, l_linenumber, CAST(coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 0) + 1 AS BIGINT) AS expected FROM lineitem) WHERE l_linenumber <> expected")
def h8_revision_chain(spark, sf_dir):
    return hi.chain_faults(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "expected")


@query("i1_job_rollup", "SELECT o_orderpriority AS stage, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def i1_job_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("i2_distinct_speakers", "SELECT DISTINCT conv_id, role FROM conversations")
def i2_distinct_speakers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "role").distinct()


@query(
    "i3_budget_exposure",
    "SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus IN ('O', 'P') THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS exposed, sum(CASE WHEN o_orderstatus IN ('O', 'P') THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) > 100000000 AS over FROM orders GROUP BY 1",
)
def i3_budget_exposure(spark, sf_dir):
    cents = F.when(F.col("o_orderstatus").isin("O", "P"), F.round(F.col("o_totalprice") * 100).cast("long")).otherwise(0)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(cents).alias("exposed")).withColumn("over", F.col("exposed") > 100_000_000)


@query("i4_max_revision", "SELECT c_custkey, CAST(coalesce(max(o_orderkey), 0) AS BIGINT) AS revision FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def i4_max_revision(spark, sf_dir):
    top = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("m"))
    return table(spark, sf_dir, "customer").join(top, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("m", F.lit(0)).alias("revision"))


@query(
    "i5_distribution",
    """WITH s AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, n, round(CAST(sum(n_chars) AS DOUBLE) / n, 6) AS mean, max(CASE WHEN r = n // 2 + 1 THEN n_chars END) AS upper_median, max(CASE WHEN r = CAST(ceil(n * 90 / 100) AS BIGINT) THEN n_chars END) AS p90,
  max(CASE WHEN r = CAST(ceil(n * 95 / 100) AS BIGINT) THEN n_chars END) AS p95 FROM s GROUP BY lang, n""",
)
def i5_distribution(spark, sf_dir):
    return ag.order_statistics(table(spark, sf_dir, "documents"), ["lang"], "n_chars")


@query("i6_quantiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95 FROM events GROUP BY 1")
def i6_quantiles(spark, sf_dir):
    return ag.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", (0.5, 0.95))


@query("i7_class_means", "SELECT label AS class_id, CAST(label AS VARCHAR) AS label, round(avg((embedding[1] + 1.0) / 2), 6) AS p FROM embeddings GROUP BY ALL")
def i7_class_means(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.lit(1).alias("g"), F.col("label").alias("class_id"), F.col("label").cast("string").alias("label"), ((F.col("embedding")[0].cast("double") + 1.0) / 2).alias("p"))
    return ag.class_means(e, ["g"]).select("class_id", "label", "p")


@query(
    "i8_signal_stats",
    """WITH a AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS v FROM embeddings)
SELECT vec_id, len(list_filter(v, lambda x: x >= 0.999)) / len(v) AS clipping, round(20 * log10(greatest(list_max(v), 1e-12)), 6) AS peak_dbfs,
  round(20 * log10(greatest(sqrt(list_dot_product(v, v) / len(v)), 1e-12)), 6) AS rms_dbfs, len(list_filter(v, lambda x: x < 1e-4)) / len(v) AS silence FROM a""",
)
def i8_signal_stats(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", *ag.signal_stats(None, "embedding"))


@query(
    "i9_level_ladder",
    """SELECT event_id, CASE WHEN s < 0.339844 THEN 'none' WHEN s >= 0.80 THEN 'dominant' WHEN p >= 0.565918 THEN 'background' ELSE 'uncertain' END AS level,
  CASE WHEN c > 0.01 OR r < -45 OR q > 0.85 THEN 'degraded' ELSE 'clean' END AS quality FROM (SELECT event_id, value / 490.0 AS s, (event_id % 100) / 100.0 AS p, (event_id % 37) / 1000.0 AS c, -CAST(event_id % 60 AS DOUBLE) AS r, (event_id % 9) / 10.0 AS q FROM events)""",
)
def i9_level_ladder(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select("event_id", ag.level(F.col("value") / 490.0, (i % 100) / 100.0).alias("level"), ag.degraded((i % 37) / 1000.0, -(i % 60).cast("double"), (i % 9) / 10.0).alias("quality"))


_LABELS = ("Speech", "Pop Music", "Singing", "Engine", "Rain on Roof", "Dog")


@query(
    "i9_conditions",
    f"""WITH s AS (SELECT user_id, event_id % 6 AS k, (event_id * 37 % 1024) / 1024.0 AS p, event_id FROM events WHERE user_id % 9 > 0),
m AS (SELECT user_id, ['{"', '".join(_LABELS)}'][k + 1] AS label, k, round(avg(p), 6) AS p FROM s GROUP BY ALL),
c AS (SELECT user_id, coalesce(max(p) FILTER (k IN (1, 2)), 0) AS music, coalesce(max(p) FILTER (k = 0), 0) AS speech, coalesce(string_agg(label, '|' ORDER BY label) FILTER (p >= 0.25 AND k IN (2, 3, 4)), '') AS activity FROM m GROUP BY 1),
u AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id, CASE WHEN c.user_id IS NULL THEN 'unknown' ELSE 'derived' END AS status, music AS music_score, speech AS speech_score,
  CASE WHEN c.user_id IS NULL THEN 'uncertain' WHEN music < 0.339844 THEN 'none' WHEN music >= 0.80 THEN 'dominant' WHEN speech >= 0.565918 THEN 'background' ELSE 'uncertain' END AS music_level,
  coalesce(music >= 0.80 OR (music >= 0.339844 AND speech >= 0.565918), FALSE) AS has_music, coalesce(speech >= 0.565918, FALSE) AS has_speech, coalesce(activity, '') AS activity,
  CASE WHEN c.user_id IS NULL THEN 'uncertain' WHEN u.user_id % 3 = 0 OR u.user_id % 50 > 45 THEN 'degraded' ELSE 'clean' END AS quality
FROM u LEFT JOIN c USING (user_id)""",
)
def i9_conditions(spark, sf_dir):
    """Users as chunks and their events as windows; every third has no signal, every ninth no window."""
    e = table(spark, sf_dir, "events")
    i, names = F.col("event_id"), F.array(*[F.lit(x) for x in _LABELS])
    chunks = e.select("user_id").distinct().select("user_id", F.lit(0).alias("start_ms"), F.lit(10_000).alias("end_ms"))
    scores = e.where("user_id % 9 > 0").select("user_id", F.lit(0).alias("window_start"), F.lit(10_000).alias("window_end"), (i % 6).alias("class_id"), F.get(names, (i % 6).cast("int")).alias("label"), ((i * 37 % 1024) / 1024.0).alias("p"))
    signals = chunks.where("user_id % 3 > 0").select("user_id", F.lit(0.0).alias("clipping"), (-(F.col("user_id") % 50).cast("double")).alias("rms_dbfs"), F.lit(0.25).alias("silence"))
    return acoustics.acoustic_conditions(chunks, scores, signals, ["user_id"]).withColumn("activity", F.array_join("activity", "|"))


@query("i10_confusion", "SELECT a AS actual, p AS predicted, count(l.doc_id) AS n FROM (VALUES (0), (1)) x(a) CROSS JOIN (VALUES (0), (1)) y(p) LEFT JOIN labels l ON quality = a AND toxic = p GROUP BY ALL")
def i10_confusion(spark, sf_dir):
    return ag.confusion(table(spark, sf_dir, "labels"), "quality", "toxic", (0, 1))


@query(
    "i12_slice_rollup",
    """WITH s AS (SELECT l_suppkey, unnest(list_filter(['all', 'flag:' || l_returnflag, 'status:' || l_linestatus, CASE WHEN l_discount > 0.05 THEN 'discounted' END], lambda x: x IS NOT NULL)) AS slice, l_linenumber AS e, CAST(l_quantity AS BIGINT) % 5 AS t FROM lineitem)
SELECT l_suppkey, slice, count(*) AS n, count(*) FILTER (t > 0) AS n_scored, CAST(coalesce(sum(e) FILTER (t > 0), 0) AS BIGINT) AS errors, CAST(coalesce(sum(t) FILTER (t > 0), 0) AS BIGINT) AS total,
  round(CAST(coalesce(sum(e) FILTER (t > 0), 0) AS DOUBLE) / nullif(coalesce(sum(t) FILTER (t > 0), 0), 0), 6) AS rate,
  CASE WHEN count(*) FILTER (t > 0) = 0 THEN 'unscorable' WHEN count(*) FILTER (t > 0) < count(*) THEN 'partial' ELSE 'scored' END AS status FROM s GROUP BY ALL""",
)
def i12_slice_rollup(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").withColumn("e", F.col("l_linenumber").cast("long")).withColumn("t", F.col("l_quantity").cast("long") % 5)
    slices = F.array_compact(F.array(F.lit("all"), F.concat(F.lit("flag:"), "l_returnflag"), F.concat(F.lit("status:"), "l_linestatus"), F.when(F.col("l_discount") > 0.05, "discounted")))
    return ag.slice_rollup(r, ["l_suppkey"], slices, "e", "t")


@query("i13_coverage_counts", "SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (n_chars > 2000) AS n_long FROM documents GROUP BY 1")
def i13_coverage_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"), F.count_if(F.col("n_chars") > 2000).alias("n_long"))


@query(
    "i17_block_counts",
    f"""WITH {_EVENTS}, b AS (SELECT i AS block, i * 2678400 // 5 AS s, (i + 1) * 2678400 // 5 AS e FROM range(5) r(i)), w AS (SELECT (t // 1000) % 2678400 AS p FROM ev)
SELECT CAST(block AS BIGINT) AS block, count(p) AS n FROM b LEFT JOIN w ON s <= p AND p < e GROUP BY 1""",
)
def i17_block_counts(spark, sf_dir):
    p = _events(spark, sf_dir).select(F.expr("(t div 1000) % 2678400").alias("p"))
    # five equal blocks: the block of a point is found by arithmetic, with the floors of the block edges
    block = F.expr("filter(sequence(0L, 4L), i -> i * 2678400 div 5 <= p AND p < (i + 1) * 2678400 div 5)[0]")
    seen = p.select(block.alias("block")).groupBy("block").agg(F.count("*").alias("n"))
    return spark.range(5).select(F.col("id").alias("block")).join(seen, "block", "left").select("block", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "m1_components",
    """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_custkey // 3 + 1000000 AS b FROM orders WHERE o_orderstatus = 'P'), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, c) AS (SELECT a, a FROM both_ UNION SELECT both_.b, r.c FROM r JOIN both_ ON both_.a = r.node) SELECT node, min(c) AS component FROM r GROUP BY 1""",
)
def m1_components(spark, sf_dir):
    return hi.components(_identity_edges(spark, sf_dir))


def _identity_edges(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("a"), F.expr("o_custkey div 3 + 1000000").alias("b")).distinct()


@query(
    "m2_contradictions",
    """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_custkey // 3 + 1000000 AS b FROM orders WHERE o_orderstatus = 'P'), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, c) AS (SELECT a, a FROM both_ UNION SELECT both_.b, r.c FROM r JOIN both_ ON both_.a = r.node), k AS (SELECT node, min(c) AS c FROM r GROUP BY 1)
SELECT DISTINCT o_custkey AS a, o_custkey + 1 AS b, x.c AS component FROM orders JOIN k x ON x.node = o_custkey JOIN k y ON y.node = o_custkey + 1 WHERE x.c = y.c""",
)
def m2_contradictions(spark, sf_dir):
    different = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + 1).alias("b")).distinct()
    return hi.contradictions(hi.components(_identity_edges(spark, sf_dir)), different)


_JOBS = f"""{_EVENTS}, j AS (SELECT user_id, event_id, t, event_id % 5 AS attempts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'retry_wait' WHEN 'click' THEN 'running' ELSE 'complete' END AS status, CASE WHEN event_id % 4 > 0 THEN t + event_id % 1000 * 100000 END AS due FROM ev)"""


def _jobs(spark, sf_dir):
    e = _events(spark, sf_dir)
    status = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "error", "retry_wait").when(F.col("event_type") == "click", "running").otherwise("complete")
    at = F.when(F.col("event_id") % 4 > 0, F.col("t") + F.col("event_id") % 1000 * 100_000)
    return e.withColumn("attempts", F.col("event_id") % 5).withColumn("status", status).withColumn("due_ms", at).withColumn("lease_ms", at)


_NOW = 1_705_300_000_000


@query(
    "m7_claim_order",
    f"""WITH {_JOBS}, k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS claim FROM j WHERE attempts < 3 AND (status = 'queued' OR (status = 'retry_wait' AND (due IS NULL OR due <= {_NOW})) OR (status = 'running' AND due <= {_NOW})))
SELECT user_id, event_id, claim FROM k""",
)
def m7_claim_order(spark, sf_dir):
    j = _jobs(spark, sf_dir).where(hi.eligible(now=_NOW))
    return j.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")).cast("long").alias("claim"))


#: A lease of twelve hours, retries after five and thirty: the events of a job are hours apart.
_RULES = Rules(3, (18_000_000, 108_000_000), 43_200_000)


def _job_events(spark, sf_dir):
    i = F.col("event_id")
    kind = (
        F.when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "signup", F.when(i % 3 == 0, "claim").otherwise("heartbeat")).when(F.col("event_type") == "click", "fail")
        .when(F.col("event_type") == "purchase", F.when(i % 4 == 0, "complete").otherwise("claim")).when(i % 5 == 0, "error").when(i % 11 == 0, "cancel").otherwise("retry")
    )
    return _events(spark, sf_dir).select((F.col("user_id") * 4 + i % 4).alias("job"), "t", i.alias("seq"), kind.alias("kind"))


_JOB_LOG = f"""WITH RECURSIVE {_EVENTS}, e AS (SELECT user_id * 4 + event_id % 4 AS job, t, event_id AS seq, row_number() OVER (PARTITION BY user_id * 4 + event_id % 4 ORDER BY t, event_id) AS n,
  CASE event_type WHEN 'view' THEN 'claim' WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'claim' ELSE 'heartbeat' END WHEN 'click' THEN 'fail'
    WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'complete' ELSE 'claim' END ELSE CASE WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 11 = 0 THEN 'cancel' ELSE 'retry' END END AS kind FROM ev),
r AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS t, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS kind, false AS accepted, 'queued' AS s, CAST(0 AS INTEGER) AS a, CAST(NULL AS BIGINT) AS due, CAST(NULL AS BIGINT) AS lease FROM e
UNION ALL
SELECT job, n, t, seq, kind, ok, CASE WHEN NOT ok THEN s ELSE CASE kind WHEN 'claim' THEN 'running' WHEN 'heartbeat' THEN s WHEN 'complete' THEN 'complete' WHEN 'error' THEN 'blocked' WHEN 'cancel' THEN 'cancelled' WHEN 'retry' THEN 'queued'
    ELSE CASE WHEN a >= 3 THEN 'failed' ELSE 'retry_wait' END END END, CASE WHEN ok AND kind = 'claim' THEN a + 1 WHEN ok AND kind = 'retry' THEN 0 ELSE a END,
  CASE WHEN NOT ok THEN due WHEN kind = 'fail' AND a < 3 THEN t + CASE WHEN a <= 1 THEN 18000000 ELSE 108000000 END WHEN kind IN ('heartbeat', 'complete', 'error') THEN due END, CASE WHEN NOT ok THEN lease WHEN kind IN ('claim', 'heartbeat') THEN t + 43200000 END
FROM (SELECT *, CASE kind WHEN 'claim' THEN a < 3 AND (s = 'queued' OR s = 'retry_wait' AND due IS NULL) WHEN 'cancel' THEN s IN ('queued', 'running', 'retry_wait') WHEN 'retry' THEN s = 'failed' ELSE s = 'running' END AS ok
  FROM (SELECT e.job, e.n, e.t, e.seq, e.kind, a, CASE WHEN s = 'running' AND lease <= e.t THEN CASE WHEN a >= 3 THEN 'failed' ELSE 'queued' END ELSE s END AS s,
    CASE WHEN s = 'retry_wait' AND due <= e.t THEN NULL ELSE due END AS due, CASE WHEN s = 'running' AND lease <= e.t THEN NULL ELSE lease END AS lease FROM r JOIN e ON e.job = r.job AND e.n = r.n + 1)))"""


@query("m8_job_states", f"{_JOB_LOG} SELECT job, s AS status, CAST(a AS BIGINT) AS attempts, due AS due_ms FROM r WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY job ORDER BY n DESC) = 1")
def m8_job_states(spark, sf_dir):
    return hi.fold_jobs(_job_events(spark, sf_dir), _RULES.most, _RULES.backoff_ms, _RULES.lease_ms)


@query("m8_job_log", f"{_JOB_LOG} SELECT job, t, seq, kind, accepted, s AS status, a AS attempts, due AS due_ms, lease AS lease_ms FROM r WHERE n > 0")
def m8_job_log(spark, sf_dir):
    """What every event does to its job; what jobs do by themselves between two events shows in the next one's state."""
    return job_log(_job_events(spark, sf_dir), _RULES).where("seq IS NOT NULL").drop("fence", "last")


@query(
    "m9_ledger_running",
    """SELECT o_orderkey, CAST(sum(CASE o_orderstatus WHEN 'O' THEN c WHEN 'F' THEN -c // 2 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS exposure,
  sum(CASE o_orderstatus WHEN 'O' THEN c WHEN 'F' THEN -c // 2 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 10000000 AS within FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) * 2 AS c FROM orders)""",
)
def m9_ledger_running(spark, sf_dir):
    c = F.floor("o_totalprice").cast("long") * 2
    amount = F.when(F.col("o_orderstatus") == "O", c).when(F.col("o_orderstatus") == "F", F.expr("-CAST(floor(o_totalprice) AS BIGINT)")).otherwise(0)
    return hi.running_exposure(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], amount, 10_000_000).select("o_orderkey", "exposure", "within")


@query(
    "m10_stratified_sample",
    """WITH k AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT doc_id, source, lang, CAST(r AS BIGINT) AS rank FROM k WHERE r <= 3""",
)
def m10_stratified_sample(spark, sf_dir):
    """Three of each stratum, the hardest first: sampling is the operator."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return hi.top_per_group(d, ["source", "lang"], [F.desc("n_chars"), F.asc("doc_id")], 3).select("doc_id", "source", "lang", F.col("rank").cast("long").alias("rank"))


_PILOT = f"""{_EVENTS}, ch AS (SELECT user_id % 8 AS episode, event_id AS chunk_id, t AS start_ms, CASE WHEN event_id % 13 = 0 THEN 'human_boundary_bad' WHEN event_type = 'error' THEN 'chunk_condition_degraded'
  WHEN event_type = 'view' AND value > 100 THEN 'review_queue_overlap' WHEN value > 150 THEN 'hard_maximum' ELSE 'no_difficulty_tag' END AS difficulty FROM ev),
sv AS (SELECT *, list_position(['human_boundary_bad', 'chunk_condition_degraded', 'review_queue_overlap', 'hard_maximum', 'no_difficulty_tag'], difficulty) AS sev, CASE WHEN episode % 3 = 0 THEN 'held_out' ELSE 'development' END AS partition FROM ch),
ep AS (SELECT partition, episode, row_number() OVER (PARTITION BY partition ORDER BY episode) - 1 AS i, count(*) OVER (PARTITION BY partition) AS m FROM (SELECT DISTINCT partition, episode FROM sv)),
qt AS (SELECT episode, 40 // m + CAST(i < 40 % m AS INTEGER) AS quota, 10 // m + CAST(i < 10 % m AS INTEGER) AS hq FROM ep),
rk AS (SELECT sv.*, quota, hq, row_number() OVER (PARTITION BY episode ORDER BY sev, start_ms, chunk_id) <= hq AS hard FROM sv JOIN qt USING (episode)),
en AS (SELECT *, count(*) FILTER (WHERE NOT hard AND sev = 5) OVER (PARTITION BY episode) >= quota - hq AS enough FROM rk),
cd AS (SELECT *, NOT hard AND (NOT enough OR sev = 5) AS cand FROM en),
ps AS (SELECT *, row_number() OVER (PARTITION BY episode, cand ORDER BY start_ms, chunk_id) - 1 AS pos, count(*) OVER (PARTITION BY episode, cand) AS n FROM cd),
pilot AS (SELECT partition, episode, chunk_id, start_ms, CASE WHEN hard THEN 'difficult' ELSE 'representative' END AS category, CASE WHEN hard THEN difficulty ELSE 'temporal_spread' END AS reason, difficulty
  FROM ps WHERE hard OR (cand AND list_contains(list_transform(range(quota - hq), lambda x: (2 * x + 1) * n // (2 * (quota - hq))), pos)))"""


def _pilot_input(spark, sf_dir):
    e = _events(spark, sf_dir)
    tag = F.when(F.col("event_id") % 13 == 0, "human_boundary_bad").when(F.col("event_type") == "error", "chunk_condition_degraded").when((F.col("event_type") == "view") & (F.col("value") > 100), "review_queue_overlap")
    chunks = e.select((F.col("user_id") % 8).alias("episode"), F.col("event_id").alias("chunk_id"), F.col("t").alias("start_ms"), tag.when(F.col("value") > 150, "hard_maximum").otherwise("no_difficulty_tag").alias("difficulty"))
    split = chunks.select("episode", F.when(F.col("episode") % 3 == 0, "held_out").otherwise("development").alias("partition")).distinct()
    return chunks, split


@query("m10_pilot", f"WITH {_PILOT} SELECT partition, episode, chunk_id, start_ms, category, reason FROM pilot")
def m10_pilot(spark, sf_dir):
    """Forty chunks of each partition, ten of them the hardest: sampling is the operator."""
    return pilots.freeze_pilot(*_pilot_input(spark, sf_dir))


@query(
    "m10_pilot_coverage",
    f"""WITH {_PILOT}, av AS (SELECT partition, count(DISTINCT episode) AS episodes, count(*) FILTER (WHERE difficulty = 'chunk_condition_degraded') AS degraded_available FROM sv GROUP BY 1)
SELECT partition, any_value(episodes) AS episodes, count(*) AS chunks, count(*) FILTER (WHERE category = 'difficult') AS difficult, count(*) FILTER (WHERE category = 'representative') AS representative,
count(*) FILTER (WHERE category = 'difficult' AND difficulty = 'no_difficulty_tag') AS untagged_difficult, count(*) FILTER (WHERE category = 'representative' AND difficulty <> 'no_difficulty_tag') AS tagged_representative,
count(*) FILTER (WHERE difficulty = 'chunk_condition_degraded') AS degraded, any_value(degraded_available) AS degraded_available FROM pilot JOIN av USING (partition) GROUP BY 1""",
)
def m10_pilot_coverage(spark, sf_dir):
    chunks, split = _pilot_input(spark, sf_dir)
    return pilots.pilot_coverage(pilots.freeze_pilot(chunks, split), chunks.withColumn("degraded", F.col("difficulty") == "chunk_condition_degraded"), split, ["degraded"])


@query(
    "k11_merge_patches",
    f"""WITH {_EVENTS}, p AS (SELECT ev.*, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM ev JOIN events USING (event_id)),
l AS (SELECT user_id, t, event_id, 'k' AS path, CASE WHEN event_type = 'error' THEN NULL ELSE k END AS v FROM p UNION ALL SELECT user_id, t, event_id, 'last/' || event_type, k FROM p WHERE event_type <> 'error'),
m AS (SELECT user_id, path, max((t, event_id)) AS seen, arg_max(struct_pack(v := v), (t, event_id)).v AS v FROM l GROUP BY ALL),
e AS (SELECT user_id, max((t, event_id)) AS gone FROM p WHERE event_type = 'error' AND k % 2 = 0 GROUP BY 1)
SELECT user_id, path, CAST(v AS VARCHAR) AS value FROM m LEFT JOIN e USING (user_id) WHERE v IS NOT NULL AND (path = 'k' OR gone IS NULL OR gone < seen)""",
)
def k11_merge_patches(spark, sf_dir):
    """Each event patches its user's object: k and last.<type>; errors remove k and, where k is even, all of last."""
    k = F.expr("variant_get(try_parse_json(props), '$.k', 'bigint')").cast("string")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 1000").alias("t"), k.alias("k"))
    patch = F.when(F.col("event_type") == "error", F.when(F.col("k").cast("long") % 2 == 0, F.lit('{"k": null, "last": null}')).otherwise(F.lit('{"k": null}'))).otherwise(F.format_string('{"k": %s, "last": {"%s": %s}}', "k", "event_type", "k"))
    merged = variant.merge_patches(e.withColumn("payload", patch), ["user_id"], ["t", "event_id"])
    return merged.select("user_id", F.translate("path", variant.STEP, "/").alias("path"), "value")


@query(
    "e12_batches",
    """WITH RECURSIVE o AS (SELECT o_orderstatus AS stream, CAST(o_custkey % 97 + 1 AS BIGINT) AS size, CAST(sum(o_custkey % 97 + 1) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM orders),
b(stream, batch, s) AS (SELECT DISTINCT stream, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM o UNION ALL SELECT b.stream, b.batch + 1, min(o.e - o.size) FROM b JOIN o ON o.stream = b.stream AND o.e > b.s + 1000 GROUP BY b.stream, b.batch)
SELECT o.stream, batch, count(*) AS items, CAST(sum(size) AS BIGINT) AS bytes FROM o ASOF JOIN b ON o.stream = b.stream AND o.e - o.size >= b.s GROUP BY ALL""",
)
def e12_batches(spark, sf_dir):
    """Orders as excerpts of 1 to 97 bytes, a stream for each status, packed under a cap of a thousand."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("stream"), "o_orderkey", (F.col("o_custkey") % 97 + 1).cast("long").alias("bytes"))
    joined = batches.pack_batches(rows, "stream", ["o_orderkey"], "bytes", 1_000).join(rows, ["stream", "o_orderkey"])
    return joined.groupBy("stream", "batch").agg(F.count("*").alias("items"), F.sum("bytes").alias("bytes"))


@query(
    "m13_corrections",
    "SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' END, d.lang) AS effective, d.lang AS machine, CASE WHEN l.toxic = 1 THEN 'toxic' END AS human FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def m13_corrections(spark, sf_dir):
    h = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("human"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("machine")).join(h, "doc_id", "left")
    return d.select("doc_id", F.coalesce("human", "machine").alias("effective"), "machine", "human")


@query("m14_dispatch_matrix", "SELECT doc_id, a AS adapter FROM documents CROSS JOIN (VALUES ('a'), ('b'), ('c')) v(a) WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND (CASE WHEN quality = 1 THEN 'a' ELSE 'b' END) = a)")
def m14_dispatch_matrix(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "a").otherwise("b").alias("adapter"))
    return joins.dispatch_matrix(table(spark, sf_dir, "documents"), "doc_id", ("a", "b", "c"), done)


@query("o_set_operations", "(SELECT doc_id, 'both' AS side FROM documents INTERSECT SELECT doc_id, 'both' FROM labels) UNION ALL (SELECT doc_id, 'only' FROM documents EXCEPT SELECT doc_id, 'only' FROM labels)")
def o_set_operations(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.intersect(l).withColumn("side", F.lit("both")).unionByName(d.subtract(l).withColumn("side", F.lit("only")))


@query("b5_pointer_upsert", f"WITH {_EVENTS} SELECT user_id % 7 AS pointer, max_by(event_id, struct_pack(t := t, e := event_id)) AS event_id, count(*) AS revisions FROM ev GROUP BY 1")
def b5_pointer_upsert(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.groupBy((F.col("user_id") % 7).alias("pointer")).agg(F.max_by("event_id", F.struct("t", "event_id")).alias("event_id"), F.count("*").alias("revisions"))


@query("b6_insert_identical", "SELECT doc_id, lang FROM documents WHERE doc_id % 4 = 0")
def b6_insert_identical(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    new, _ = hi.insert_identical(d.where("doc_id % 4 <> 0"), d, ["doc_id"])
    return new


@query("b6_insert_conflicts", "SELECT doc_id, lang FROM documents WHERE doc_id % 4 = 1")
def b6_insert_conflicts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    old = d.withColumn("lang", F.when(F.col("doc_id") % 4 == 1, F.concat("lang", F.lit("?"))).otherwise(F.col("lang")))
    _, conflicts = hi.insert_identical(old, d, ["doc_id"])
    return conflicts


@query("n_ordered_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 100")
def n_ordered_page(spark, sf_dir):
    """The second page of a hundred: the limit is the page."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(100).select("o_orderkey", "o_totalprice")


@query("i16_progress", "SELECT source, lang, count(*) FILTER (quality = 1) AS done, count(*) AS total, count(*) - count(*) FILTER (quality = 1) AS \"left\" FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def i16_progress(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return ag.progress(rows, ["source", "lang"], F.col("quality") == 1)


@query(
    "i18_dispatch_report",
    f"""WITH {_EVENTS} SELECT user_id AS adapter, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'queued' END AS status, count(*) AS n, count(*) FILTER (event_type = 'purchase' AND event_id % 5 > 0) AS hypotheses, count(*) FILTER (event_type = 'error') AS failed FROM ev GROUP BY ALL""",
)
def i18_dispatch_report(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "succeeded").when(kind == "error", "failed").otherwise("queued")
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("adapter"), status.alias("status"), F.when(F.col("event_id") % 5 > 0, F.col("event_id")).alias("hypothesis_id"), F.when(kind == "error", kind).alias("error"))
    return ag.dispatch_report(rows)


@query("i15_voice_counts", "SELECT count(*) AS exemplars, count(DISTINCT (label, vec_id % 40)) AS centroids, count(DISTINCT label) AS episodes FROM embeddings")
def i15_voice_counts(spark, sf_dir):
    return ag.voice_counts(table(spark, sf_dir, "embeddings").select(F.col("label").alias("episode"), (F.col("vec_id") % 40).alias("speaker")))


_DECISIONS = """d AS (SELECT o_orderkey AS decision_id, o_custkey AS a, o_custkey // 3 + 1000000 AS b, CASE WHEN o_orderkey % 5 = 0 THEN 'different' ELSE 'same_person' END AS decision, CASE WHEN o_orderkey % 7 = 0 THEN 'superseded' ELSE 'active' END AS state, CAST(o_orderkey % 3 AS INTEGER) AS revision FROM orders WHERE o_orderstatus = 'P')"""


def _decisions(spark, sf_dir):
    i = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(
        i.alias("decision_id"), F.col("o_custkey").alias("a"), F.expr("o_custkey div 3 + 1000000").alias("b"), F.when(i % 5 == 0, "different").otherwise("same_person").alias("decision"),
        F.when(i % 7 == 0, "superseded").otherwise("active").alias("state"), (i % 3).cast("int").alias("revision"),
    )


@query("m3_undo", f"WITH {_DECISIONS} SELECT decision_id, a, b, decision, CASE WHEN state = 'active' AND decision_id % 11 = 0 THEN 'superseded' ELSE state END AS state, revision + CASE WHEN state = 'active' AND decision_id % 11 = 0 THEN 1 ELSE 0 END AS revision FROM d")
def m3_undo(spark, sf_dir):
    d = _decisions(spark, sf_dir)
    return hi.undo_decisions(d, d.where("state = 'active' AND decision_id % 11 = 0").select("decision_id", F.col("revision").alias("expected")))


@query(
    "m3_split",
    f"""WITH RECURSIVE {_DECISIONS}, e AS (SELECT DISTINCT a, b FROM d WHERE decision = 'same_person' AND state = 'active' AND a % 4 > 0), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, c) AS (SELECT a, a FROM both_ UNION SELECT both_.b, r.c FROM r JOIN both_ ON both_.a = r.node) SELECT node, min(c) AS component FROM r GROUP BY 1""",
)
def m3_split(spark, sf_dir):
    """Customers whose key divides by four are split from their groups; then the memberships are built anew."""
    d = _decisions(spark, sf_dir)
    return hi.memberships(hi.split_members(d, d.where("a % 4 = 0").select(F.col("a").alias("node"))))


_GROUPS = """ids AS (SELECT node, min(node) OVER (PARTITION BY c) AS c FROM (SELECT node, min(c) AS c FROM r GROUP BY 1)),
was AS (SELECT node, 'global-' || substr(sha256(CAST(c AS VARCHAR)), 1, 32) AS g, max(node) OVER (PARTITION BY c) AS retain FROM ids)"""


@query(
    "m3_rebuild",
    f"""WITH RECURSIVE {_DECISIONS.replace("o_custkey // 3", "o_custkey // 3 + o_orderkey % 2")}, e AS (SELECT a, b, decision_id FROM d WHERE decision = 'same_person' AND state = 'active'), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, c) AS (SELECT a, a FROM both_ UNION SELECT both_.b, r.c FROM r JOIN both_ ON both_.a = r.node), {_GROUPS},
e2 AS (SELECT a, b FROM e WHERE decision_id % 11 > 0), both2 AS (SELECT a, b FROM e2 UNION SELECT b, a FROM e2),
r2(node, c) AS (SELECT a, a FROM both2 UNION SELECT both2.b, r2.c FROM r2 JOIN both2 ON both2.a = r2.node), ids2 AS (SELECT node, min(c) AS c FROM r2 GROUP BY 1),
hit AS (SELECT DISTINCT g FROM e JOIN was ON node = a WHERE decision_id % 11 = 0)
SELECT was.node, was.g AS before, CASE WHEN i.c IS NULL THEN NULL WHEN i.c = k.c THEN was.g ELSE substr(was.g, 1, 9) || substr(sha256(was.g || ':1:' || i.c), 1, 30) END AS after
FROM was JOIN hit USING (g) LEFT JOIN ids2 i ON i.node = was.node LEFT JOIN ids2 k ON k.node = was.retain""",
)
def m3_rebuild(spark, sf_dir):
    """Every eleventh decision is undone in the kept groups; the largest key of a group retains its id."""
    d = _decisions(spark, sf_dir).withColumn("b", F.col("b") + F.col("decision_id") % 2)
    path = new_path(spark, "identity")
    identity.publish_identity(d, path)
    links = identity.read_identity(spark, path, "link").where("decision = 'same_person' AND state = 'active' AND decision_id % 11 = 0")
    most = identity.read_identity(spark, path, "member").groupBy("group_id").agg(F.max("node").alias("retain"))
    requests = links.join(most, "group_id").select("group_id", "decision_id", F.col("revision").alias("expected"), F.lit(None).alias("node"), "retain", F.lit("reviewer").alias("reviewer"))
    return identity.correct_identity(spark, path, requests).changes


@query("m4_mapping_states", f"WITH {_EVENTS}, l AS (SELECT user_id, arg_max(event_type, (t, event_id)) AS last FROM ev GROUP BY 1) SELECT event_id, user_id, event_type, CASE WHEN event_type = last THEN 'current' ELSE 'stale' END AS mapping_state FROM ev JOIN l USING (user_id)")
def m4_mapping_states(spark, sf_dir):
    return hi.mapping_states(_events(spark, sf_dir), ["user_id"], "event_type", ["t", "event_id"]).select("event_id", "user_id", "event_type", "mapping_state")


@query(
    "m5_revisions",
    f"""WITH RECURSIVE {_EVENTS}, n AS (SELECT user_id, t, event_id AS seq, event_id % 3 + event_id % 2 AS expected, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM ev),
f(user_id, k, t, seq, expected, accepted, revision) AS (SELECT user_id, k, t, seq, expected, expected = 0, CASE WHEN expected = 0 THEN 1 ELSE 0 END FROM n WHERE k = 1
  UNION ALL SELECT n.user_id, n.k, n.t, n.seq, n.expected, n.expected = f.revision, f.revision + CASE WHEN n.expected = f.revision THEN 1 ELSE 0 END FROM f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1)
SELECT user_id, t, seq, expected, accepted, CAST(revision AS BIGINT) AS revision FROM f""",
)
def m5_revisions(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "t", F.col("event_id").alias("seq"), (F.col("event_id") % 3 + F.col("event_id") % 2).alias("expected"))
    return hi.accepted_revisions(e, "user_id", ["t", "seq"], "expected")
