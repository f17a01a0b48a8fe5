"""Hard negatives through summaries of vector segments.

A vector is cut into segments; of each the mean and the deviation (length of what the mean leaves) are stored. The product
of two segments is their size times the product of their means, plus or minus at most the product of their deviations.
Sums of these bound an inner product from both sides. Pairs are looked at through few long segments first; those that
neither bound rules out through more and shorter ones, and what is left by the exact integer product. Anchors and rows meet
in blocks: a stated query set against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import bounded, materialize, read

#: Segments of each level, coarse first. Anchors and rows of a block.
LEVELS, ANCHORS, ROWS = (4, 16), 512, 4_096


def summaries(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(means, deviations) of the segments of each row, both scaled so that plain products bound; segments are as even as
    the length allows."""
    cut = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    size = np.diff(cut).astype(float)
    total = np.add.reduceat(x, cut[:-1], axis=1)
    square = np.add.reduceat(x * x, cut[:-1], axis=1)
    return total / np.sqrt(size), np.sqrt(np.maximum(square - total * total / size, 0))


def bounds(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) possible inner product of every row of a with every row of b."""
    middle, off = a[0] @ b[0].T, a[1] @ b[1].T
    slack = 1e-9 * (np.abs(middle) + off) + 1e-3
    return middle - off - slack, middle + off + slack


def pair_bounds(a, b, i, j):
    middle, off = np.einsum("ij,ij->i", a[0][i], b[0][j]), np.einsum("ij,ij->i", a[1][i], b[1][j])
    slack = 1e-9 * (np.abs(middle) + off) + 1e-3
    return middle - off - slack, middle + off + slack


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact integer products of a[i] and b[j]."""
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), 1 << 15):
        out[k : k + (1 << 15)] = np.einsum("ij,ij->i", a[i[k : k + (1 << 15)]], b[j[k : k + (1 << 15)]])
    return out


def _matrix(lists: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(lists.flatten()).astype(np.int64).reshape(rows, -1)


def _best(i: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each i, by score falling and id."""
    order = np.lexsort((ids, -score, i))
    at = i[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1)) if len(at) else np.zeros(0, int)
    rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return order[rank < k]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows come sorted by block, anchors first; each block once, whole."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        held = pa.table(b) if held is None else pa.concat_tables([held, pa.table(b)])
        ids = held["block"].to_numpy()
        last = int(np.searchsorted(ids, ids[-1]))
        if last:
            done, held = held.slice(0, last), held.slice(last)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(ids[:last])) + 1, [last]))
            for s, e in zip(edges, edges[1:], strict=False):
                yield done.slice(s, e - s)
    if held is not None:
        yield held


def _sides(block: pa.Table) -> tuple[pa.Table, pa.Table]:
    block = block.combine_chunks()
    n = int(block["anchor"].to_numpy().sum())
    return block.slice(0, n), block.slice(n)


def _column(side: pa.Table, name: str) -> pa.Array:
    column = side[name].combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _positives(k: int, levels: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            anchors, rows = _sides(block)
            if not anchors.num_rows or not rows.num_rows:
                continue
            a, b = (_matrix(_column(s, "vec"), s.num_rows) for s in (anchors, rows))
            (al, au, _), (bl, bu, bv) = ([s[c].to_numpy() for c in ("label", "uid", "vec_id")] for s in (anchors, rows))
            fits = (al[:, None] == bl[None, :]) & (au[:, None] != bu[None, :])
            fa, fb = a.astype(float), b.astype(float)
            low, high = bounds(summaries(fa, levels[0]), summaries(fb, levels[0]))
            low = np.where(fits, low, -np.inf)
            # the k-th highest lower bound of an anchor is below its k-th score: what can't reach it is out
            least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(a), -np.inf)
            i, j = np.nonzero(fits & (high >= least[:, None]))
            for segments in levels[1:]:
                low, high = pair_bounds(summaries(fa, segments), summaries(fb, segments), i, j)
                order = np.lexsort((-low, i))
                first = np.searchsorted(i[order], np.arange(len(a)))
                nth = first + k - 1
                held = (nth < len(i)) & (i[order][np.minimum(nth, max(len(i) - 1, 0))] == np.arange(len(a))) if len(i) else np.zeros(len(a), bool)
                least = np.where(held, low[order][np.minimum(nth, len(i) - 1)], -np.inf) if len(i) else least
                keep = high >= least[i]
                i, j = i[keep], j[keep]
            score = products(a, b, i, j)
            top = _best(i, score, bv[j], k)
            i, j, score = i[top], j[top], score[top]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (au[i], bu[j], bv[j], score)], names=["anchor_uid", "uid", "positive_id", "positive_score"])

    return run


def _negatives(k: int, levels: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            anchors, rows = _sides(block)
            if not anchors.num_rows or not rows.num_rows:
                continue
            a, b = (_matrix(_column(s, "vec"), s.num_rows) for s in (anchors, rows))
            (al, au, _), (bl, _, bv) = ([s[c].to_numpy() for c in ("label", "uid", "vec_id")] for s in (anchors, rows))
            wanted = _column(anchors, "scores").to_pylist()  # of each anchor, the scores of its positives
            count = np.array([len(w) for w in wanted])
            score_of = np.array([w + [np.iinfo(np.int64).min] * (count.max(initial=0) - len(w)) for w in wanted], np.int64)
            real = np.arange(score_of.shape[1]) < count[:, None]
            lowest = np.where(real, 0.8 * score_of, np.inf).min(axis=1)
            highest = np.where(real, score_of.astype(float), -np.inf).max(axis=1)
            fa, fb = a.astype(float), b.astype(float)
            low, high = bounds(summaries(fa, levels[0]), summaries(fb, levels[0]))
            slack = 1e-9 * np.abs(lowest)
            i, j = np.nonzero((al[:, None] != bl[None, :]) & (high >= (lowest - slack)[:, None]) & (low <= highest[:, None]))
            for segments in levels[1:]:
                low, high = pair_bounds(summaries(fa, segments), summaries(fb, segments), i, j)
                keep = (high >= (lowest - slack)[i]) & (low <= highest[i])
                i, j = i[keep], j[keep]
            score = products(a, b, i, j)
            for p in range(score_of.shape[1]):
                of = score_of[i, p]
                # 80 p <= 100 s <= 100 p, as 4 p <= 5 s with the quotient rounded up so that nothing passes 64 bits
                within = np.flatnonzero(real[i, p] & (of >= 0) & (score >= of - of // 5) & (score <= of))
                top = within[_best(i[within], score[within], bv[j[within]], k)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (au[i[top]], score_of[i[top], p], bv[j[top]], score[top])], names=["anchor_uid", "positive_score", "negative_id", "negative_score"])

    return run


def _met(anchors: DataFrame, rows: DataFrame, extra: list[str]) -> DataFrame:
    """Anchors and rows of each block (group of anchors, group of rows), sorted, anchors first."""
    spark = rows.sparkSession
    n, m = anchors.count(), rows.count()
    a, r = max(1, -(-n // ANCHORS)), max(1, -(-m // ROWS))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = max(r, min(parts, -(-m // 256)))  # as many blocks as tasks, while blocks stay worth a task
    side = lambda d, own, others, anchor: d.withColumn("_own", F.pmod(F.xxhash64("uid"), F.lit(own))).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).withColumn("anchor", F.lit(anchor))
    left = side(anchors, a, r, 1).withColumn("block", F.col("_own") * r + F.col("_other"))
    right = side(rows, r, a, 0).withColumn("block", F.col("_other").cast("long") * r + F.col("_own"))
    for c in extra:
        right = right.withColumn(c, F.lit(None).cast(dict(anchors.dtypes)[c]))
    columns = ["block", "dim", "anchor", "uid", "vec_id", "label", "vec", *extra]
    both = left.select(columns).unionByName(right.select(columns))
    # vectors of another length are another block
    both = both.withColumn("block", F.col("dim").cast("long") * F.lit(a * r) + F.col("block"))
    return both.repartition(max(parts, 1), "block").sortWithinPartitions("block", F.col("anchor").desc())


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from rows(vec_id, embedding, label).

    Components are floor(256 x), scores integer inner products; higher ones come first, ties by smaller vec_id. Anchors are
    the rows whose vec_id is divisible by `every`; their positives are the first other rows of the same label. For each the
    first rows of other labels whose score is from 0.8 of the positive's up to it are returned, ranked from 1.

    Rows with a null vec_id, label or vector, an empty vector, or a null, NaN or infinite component take no part, nor do
    vectors whose squared length passes 62 bits (their scores fit no long). Vectors of different lengths don't meet.
    Repeated rows are rows of their own, as anchors, positives and negatives. Other columns are ignored; an empty table,
    and anchors without positives or negatives, give no rows.
    """
    vec = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(
        (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**52)) & (F.aggregate(vec, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x) * 256 + 1, F.lit(2.0))) < 2.0**62),
        F.lit(False),
    )
    own = rows.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(vec, lambda x: F.floor(x * 256)).alias("vec"))
    own = materialize(own.withColumn("dim", F.size("vec")).withColumn("uid", F.monotonically_increasing_id()), "negative-rows")
    anchors = own.where(F.pmod("vec_id", F.lit(every)) == 0)
    found = _met(anchors, own, []).mapInArrow(bounded(_positives(positives, levels)), "anchor_uid long, uid long, positive_id long, positive_score long")
    found = materialize(found, "negative-positives")
    place = F.row_number().over(Window.partitionBy("anchor_uid").orderBy(F.col("positive_score").desc(), "positive_id", "uid"))
    chosen = materialize(found.withColumn("place", place).where(F.col("place") <= positives), "negative-chosen")
    asked = chosen.groupBy("anchor_uid").agg(F.collect_set("positive_score").alias("scores"))
    asking = anchors.join(asked.withColumnRenamed("anchor_uid", "uid"), "uid")
    far = _met(asking, own, ["scores"]).mapInArrow(bounded(_negatives(negatives, levels)), "anchor_uid long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_uid", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id"))
    ranked = far.withColumn("rank", rank).where(F.col("rank") <= negatives)
    named = chosen.join(anchors.select(F.col("uid").alias("anchor_uid"), F.col("vec_id").alias("anchor_id")), "anchor_uid")
    return named.join(ranked, ["anchor_uid", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


NEGATIVES = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id,
  p.score AS positive_score, s.score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5"""
