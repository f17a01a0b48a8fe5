"""Queries of lexical and vector retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import search, vectors
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


_TOKENS = r"""toks AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS l FROM documents),
index AS (SELECT doc_id, unnest(l) AS token, unnest(range(len(l))) AS pos FROM toks)"""


def _bm25(terms: list[list[str]], tail: str) -> str:
    hits = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS term, count(*) AS tf FROM (SELECT doc_id, p0 FROM ("
        + " UNION ALL ".join(f"SELECT doc_id, pos - {k} AS p0 FROM index WHERE token = '{w}'" for k, w in enumerate(words))
        + f") GROUP BY doc_id, p0 HAVING count(*) = {len(words)}) GROUP BY doc_id"
        for i, words in enumerate(terms)
    )
    return f"""WITH {_TOKENS}, tf AS ({hits}), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sizes AS (SELECT doc_id, len(l) AS dl FROM toks), total AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM sizes),
every AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS terms FROM tf),
scored AS (SELECT doc_id, -sum(greatest(1e-6, ln((n_docs - df + 0.5) / (df + 0.5))) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM every JOIN df USING (term) JOIN sizes USING (doc_id) CROSS JOIN total WHERE terms = {len(terms)} GROUP BY doc_id)
{tail}"""


@query("d4_bm25_search", _bm25([["the"], ["of", "the"]], "SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY 2, 1 LIMIT 20"))
def d4_bm25_search(spark, sf_dir):
    """A page of ranked results: the limit is the operator's page."""
    docs = table(spark, sf_dir, "documents")
    return search.search(docs, 'the "of the"', 20, index=search.kept_index(docs))


@query("d2_bm25_scores", _bm25([["and"], ["that"]], "SELECT doc_id, round(score, 6) AS score FROM scored"))
def d2_bm25_scores(spark, sf_dir):
    return search.bm25(search.kept_index(table(spark, sf_dir, "documents")), "and that").select("doc_id", F.round("score", 6).alias("score"))


@query(
    "d4_filtered_search",
    _bm25([["la"]], "SELECT doc_id, round(score, 6) AS score FROM scored WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src3') ORDER BY 2, 1 LIMIT 10 OFFSET 2"),
)
def d4_filtered_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return search.search(docs, "la", 10, 2, F.col("source") == "src3", search.kept_index(docs))


@query(
    "d1_phrase_match",
    f"""WITH {_TOKENS} SELECT a.doc_id, count(*) AS tf FROM index a JOIN index b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
WHERE a.token = 'in' AND b.token = 'the' GROUP BY a.doc_id""",
)
def d1_phrase_match(spark, sf_dir):
    found = search.term_frequencies(search.kept_index(table(spark, sf_dir, "documents")).of(["in", "the"]), [["in", "the"]])
    return found.select("doc_id", F.col("tf").cast("long").alias("tf"))


@query(
    "d1_token_statistics",
    f"WITH {_TOKENS} SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM index GROUP BY token",
)
def d1_token_statistics(spark, sf_dir):
    """Per token its occurrences and documents; counted per document first, so a frequent token arrives as small rows."""
    per_doc = search.tokens(table(spark, sf_dir, "documents")).groupBy("token", "doc_id").agg(F.count("*").alias("c"))
    return per_doc.groupBy("token").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


@query(
    "d3_snippets",
    f"""WITH {_TOKENS}, hit AS (SELECT doc_id, pos FROM index WHERE token = 'was'),
n AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN CURRENT ROW AND 27 FOLLOWING) AS n FROM hit),
best AS (SELECT doc_id, pos AS p0 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS r FROM n) WHERE r = 1)
SELECT doc_id, CASE WHEN p0 > 0 THEN '… ' ELSE '' END || array_to_string(l[p0 + 1 : p0 + 28], ' ') || CASE WHEN p0 + 28 < len(l) THEN ' …' ELSE '' END AS snippet
FROM best JOIN toks USING (doc_id)""",
)
def d3_snippets(spark, sf_dir):
    return search.snippets(table(spark, sf_dir, "documents"), "was")


@query("e1_norms", "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def e1_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm("embedding"), 6).alias("norm"))


@query(
    "e2_centroids",
    """WITH u AS (SELECT vec_id % 20 AS episode, label, unnest(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))) AS x,
  unnest(range(len(embedding))) AS pos FROM embeddings),
m AS (SELECT episode, label, pos, avg(x) AS x, count(*) AS n FROM u GROUP BY ALL), q AS (SELECT episode, label, sqrt(sum(x * x)) AS q FROM m GROUP BY ALL)
SELECT episode, CAST(label AS BIGINT) AS label, pos, n, round(x / q, 5) + 0.0 AS x FROM m JOIN q USING (episode, label)""",
)
def e2_centroids(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("episode", F.col("vec_id") % 20)
    found = vectors.centroids(rows, ["episode", "label"])
    return found.select("episode", F.col("label").cast("long").alias("label"), "n", F.posexplode("centroid").alias("pos", "x")).select(
        "episode", "label", F.col("pos").cast("long").alias("pos"), "n", (F.round("x", 5) + 0.0).alias("x")
    )


_KNN = """WITH u AS (SELECT vec_id, vec_id % 20 AS episode, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, episode, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM u),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, round(list_dot_product(q.v, r.v), 6) AS score FROM n q JOIN n r ON q.episode <> r.episode WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM s)
"""


@query("e4_knn", _KNN + "SELECT query_id, row_id, score, rank FROM k WHERE rank <= 10")
def e4_knn(spark, sf_dir):
    """Ten neighbours of other episodes, for every row whose id is divisible by 50: a stated query set against all rows."""
    source = table(spark, sf_dir, "embeddings")
    rows = source.select("vec_id", (F.col("vec_id") % 20).alias("episode"), vectors.l2_normalize("embedding").alias("v"))
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("episode").alias("query_group"), F.col("v").alias("query_vector"))
    index = vectors.kept_cells("episodes", source, rows.select(F.col("vec_id").alias("row_id"), F.col("episode").alias("row_group"), F.col("v").alias("row_vector")))
    found = vectors.nearest_in(index, queries, 10, digits=6)
    return found.select("query_id", "row_id", "score", F.col("rank").cast("long").alias("rank"))


@query("e8_candidates")
def e8_candidates(spark, sf_dir):
    """For each queried speaker the shortlist by centroid, reranked by greedy matching of up to ten excerpts."""
    rows = table(spark, sf_dir, "embeddings").withColumn("episode", F.col("vec_id") % 20).withColumn("speaker", F.col("episode") * 100 + F.col("label"))
    cents = vectors.centroids(rows, ["episode", "speaker"]).select("episode", "speaker", "centroid")
    queries = cents.where("speaker % 50 = 0").select(F.col("speaker").alias("query_id"), F.col("episode").alias("query_group"), F.col("centroid").alias("query_vector"))
    short = vectors.nearest(queries, cents.select(F.col("speaker").alias("row_id"), F.col("episode").alias("row_group"), F.col("centroid").alias("row_vector")), 50)
    from pyspark.sql import Window

    items = rows.withColumn("r", F.row_number().over(Window.partitionBy("speaker").orderBy("vec_id"))).where("r <= 10").select("speaker", "vec_id", "embedding")
    q = items.select(F.col("speaker").alias("query"), F.col("vec_id").alias("query_item"), F.col("embedding").alias("qv"))
    c = items.select(F.col("speaker").alias("candidate"), F.col("vec_id").alias("item"), F.col("embedding").alias("v"))
    pairs = short.select(F.col("query_id").alias("query"), F.col("row_id").alias("candidate")).join(q, "query").join(c, "candidate")
    return vectors.rerank(pairs.select("query", "candidate", "query_item", "item", "qv", "v"))
