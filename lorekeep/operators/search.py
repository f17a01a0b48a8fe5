"""Lexical retrieval: an inverted index of tokens, kept as a table and pruned by token, phrase match, BM25 and snippets."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions.work import files_state, new_path

#: Folders of an index by hash of the token; a frequent token is a run in the file of each task that read documents.
BUCKETS = 64

K1, B = 1.2, 0.75
MOST_CHARS, MOST_TERMS, SNIPPET = 256, 20, 28


def tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, token): lower-cased runs of letters and digits; diacritics stay."""
    parts = F.expr(f"filter(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), x -> x <> '')")
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(parts).alias("pos", "token"))


def parse_query(query: str) -> list[list[str]]:
    """Terms of a query: words, or quoted phrases; a hyphenated word is a phrase. ValueError for anything else."""
    if not 1 <= len(query) <= MOST_CHARS or query.count('"') % 2:
        raise ValueError("a query has 1 to 256 characters and closed quotes")
    terms = []
    for quoted, word in re.findall(r'"([^"]*)"|(\S+)', query):
        part = quoted or word
        if not re.fullmatch(r"[\w\s'.,-]+", part) or not (found := re.findall(r"[^\W_]+", part.lower())):
            raise ValueError(f"not a word or a phrase: {part!r}")
        terms.append(found)
    if not 1 <= len(terms) <= MOST_TERMS:
        raise ValueError("a query has 1 to 20 terms")
    return terms


def term_frequencies(index: DataFrame, terms: list[list[str]]) -> DataFrame:
    """(doc_id, term, tf): how often each term's words follow one another. Words are filtered before anything moves.

    A phrase's word at place k with position p votes for a start at p - k; a start with all its places is a match.
    """
    places = [(i, k, w) for i, words in enumerate(terms) for k, w in enumerate(words)]
    hits = index.where(F.col("token").isin(sorted({w for _, _, w in places})))
    votes = F.array_compact(F.array(*[F.when(F.col("token") == w, F.struct(F.lit(i).alias("term"), (F.col("pos") - k).alias("at"))) for i, k, w in places]))
    starts = hits.select("doc_id", F.explode(votes).alias("v")).groupBy("doc_id", "v.term", "v.at").agg(F.count("*").alias("n"))
    size = F.element_at(F.array(*[F.lit(len(x)) for x in terms]), F.col("term") + 1)
    return starts.where(F.col("n") == size).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@dataclass(frozen=True)
class Index:
    """postings(doc_id, pos, token, bucket) and sizes(doc_id, dl), the number of documents and their mean length."""

    postings: DataFrame
    sizes: DataFrame
    n_docs: int
    mean_length: float

    def of(self, words: list[str]) -> DataFrame:
        """The postings of these tokens: their buckets alone are read."""
        spark = self.postings.sparkSession
        buckets = [r[0] for r in spark.createDataFrame([(w,) for w in words], "token string").select(_bucket()).distinct().collect()] if "bucket" in self.postings.columns else None
        rows = self.postings if buckets is None else self.postings.where(F.col("bucket").isin(buckets))
        return rows.where(F.col("token").isin(words)).select("doc_id", "pos", "token")


def _bucket():
    return F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int").alias("bucket")


def _sizes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.expr(f"CAST(size(filter(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), x -> x <> '')) AS BIGINT)").alias("dl"))


def build_index(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the index of docs: postings in folders by bucket, sorted by token, and the documents' lengths."""
    rows = tokens(docs, doc_id, text).select("*", _bucket())
    # each task writes what it has read: a bucket's folder holds a sorted run of each, and postings are never shuffled
    rows = rows.sortWithinPartitions("bucket", "token", "doc_id", "pos")
    _sizes(docs, doc_id, text).write.parquet(f"{folder}/sizes")
    rows.write.partitionBy("bucket").parquet(f"{folder}/postings")


def open_index(spark: SparkSession, folder: str) -> Index:
    sizes = spark.read.parquet(f"{folder}/sizes")
    total = sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("m")).first()
    postings = spark.read.schema("doc_id long, pos int, token string, bucket int").parquet(f"{folder}/postings")
    return Index(postings, sizes, total.n, total.m or 0.0)


def index_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of docs as they are, without a table: for small or passing sets of documents."""
    sizes = _sizes(docs, doc_id, text)
    total = sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("m")).first()
    return Index(tokens(docs, doc_id, text), sizes, total.n, total.m or 0.0)


_BUILT: dict[tuple, Index] = {}


def kept_index(docs: DataFrame) -> Index:
    """The index of a table in files, built once in the shared folder for each state of its files (names, sizes and times)."""
    spark = docs.sparkSession
    key = (spark.sparkContext.applicationId, *files_state(docs))
    if key not in _BUILT:
        folder = new_path(spark, "index")
        build_index(docs, folder)
        _BUILT[key] = open_index(spark, folder)
    return _BUILT[key]


def bm25(index: Index, query: str, where: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) of documents with all terms, of those in where(doc_id) if given; more negative is better, as the
    usual full-text engines sort.

    idf is ln((N - n + 0.5) / (n + 0.5)), at least 1e-6, over all documents; a phrase counts as one term.
    """
    terms = parse_query(query)
    tf = term_frequencies(index.of(sorted({w for t in terms for w in t})), terms)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    every = tf.withColumn("terms", F.count("*").over(Window.partitionBy("doc_id"))).where(F.col("terms") == len(terms))
    if where is not None:
        every = every.join(where.select("doc_id"), "doc_id", "left_semi")
    rows = every.join(F.broadcast(df), "term").join(index.sizes, "doc_id")  # df has 20 rows at most
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(float(index.n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(index.mean_length or 1.0))))
    return rows.groupBy("doc_id").agg((-F.sum(part)).alias("score"))


def search(docs: DataFrame, query: str, limit: int = 20, offset: int = 0, where=None, index: Index | None = None) -> DataFrame:
    """doc_id, score of one page of results by (score, doc_id); the filter comes before scoring and the page."""
    if not (1 <= limit <= 100 and 0 <= offset <= 10_000):
        raise ValueError("limit is 1 to 100, offset 0 to 10,000")
    parse_query(query)
    found = bm25(index or index_of(docs), query, None if where is None else docs.where(where))
    found = found.select("doc_id", F.round("score", 6).alias("score"))
    return found.orderBy("score", "doc_id").offset(offset).limit(limit)


def snippets(docs: DataFrame, query: str, width: int = SNIPPET) -> DataFrame:
    """(doc_id, snippet): the window of width tokens with the most matched words, the earliest of equals."""
    words = sorted({w for t in parse_query(query) for w in t})
    parts = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    hit = tokens(docs).where(F.col("token").isin(words))
    w = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(0, width - 1)
    best = hit.withColumn("n", F.count("*").over(w)).groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "pos"))["pos"].alias("at"))
    shown = F.array_join(F.slice("parts", F.col("at") + 1, F.lit(width)), " ")
    rows = docs.select("doc_id", parts.alias("parts")).join(best, "doc_id")
    return rows.select("doc_id", F.concat(F.when(F.col("at") > 0, "… ").otherwise(""), shown, F.when(F.col("at") + width < F.size("parts"), " …").otherwise("")).alias("snippet"))
