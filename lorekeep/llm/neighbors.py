"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its nearest pivots, in order of nearness; pivots are reference vectors from a bounded sample,
apart from each other. The inverted lists are kept for pairs of pivots: a vector is filed under each pair of its NEAREST
pivots of which one is among its FIRST (its prefix), so two vectors meet if they share two pivots, one of them near the
top of both orders. Lists with one vector are dropped by their count before any vector is moved; the others are compared in
tiles of bounded size, each a matrix product, so a long list becomes many tasks. Of the lists that a linked pair shares,
found from both orders, only the lowest counts it. Tiles give counts and star links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import bounded, materialize, read
from lorekeep.operators.graph import connected_components

#: Pivots are picked from this many sampled vectors at most: SAMPLE bounds what the driver holds.
SAMPLE, PIVOTS, NEAREST, FIRST, TILE = 4_096, 512, 8, 4, 1_024


def choose_pivots(sample: np.ndarray, pivots: int = PIVOTS, apart: float = 0.6) -> np.ndarray:
    """Unit rows of sample, in order, whose cosine with every one chosen before is below apart."""
    chosen = np.empty((0, sample.shape[1]))
    for v in sample:
        if len(chosen) == pivots:
            break
        if not len(chosen) or (chosen @ v).max() < apart:
            chosen = np.vstack([chosen, v])
    return chosen


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def spare_pivots(dim: int) -> np.ndarray:
    """Pivots for a length of vectors that the sample has missed."""
    return _unit(np.random.default_rng(dim).normal(size=(64, dim)))


def _nearest(pivots: dict[int, np.ndarray], nearest: int):
    """(rep, near): the numbers of the nearest pivots of each vector, the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for v in b.column(1).to_pylist():
                known = pivots.get(len(v))
                score = (spare_pivots(len(v)) if known is None else known) @ _unit(np.array(v))
                near.append(np.argsort(-score, kind="stable")[:nearest].tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near, pa.list_(pa.int32()))], names=["rep", "near"])

    return run


def shared_list(a: np.ndarray, b: np.ndarray, first: int) -> np.ndarray:
    """For rows of pivots in order of nearness, the lowest pair of pivots under which both are filed, as two columns; for
    rows of one pivot that and itself. -1 where there is none."""
    order = np.argsort(a, axis=1)
    a = np.take_along_axis(a, order, 1)
    equal = a[:, :, None] == b[:, None, :]
    shared, rank = equal.any(axis=2), equal.argmax(axis=2)
    top = (order < first) & shared, (rank < first) & shared
    out = np.full((len(a), 2), -1, np.int64)
    if a.shape[1] == 1:
        out[shared[:, 0]] = a[shared[:, 0]]
        return out
    for i in range(a.shape[1] - 2, -1, -1):  # from the highest pair down, so the lowest is written last
        for j in range(a.shape[1] - 1, i, -1):
            both = shared[:, i] & shared[:, j] & (top[0][:, i] | top[0][:, j]) & (top[1][:, i] | top[1][:, j])
            out[both, 0], out[both, 1] = a[both, i], a[both, j]
    return out


def _star(linked: np.ndarray) -> np.ndarray:
    """The lowest row that each row of a symmetric boolean matrix reaches."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(threshold: float, first: int):
    def tile(rep, vec, weight, near, side, key) -> tuple[list, list, list]:
        left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
        hit = vec[left] @ vec[right].T >= threshold
        within = len(left) == len(right) and (left == right).all()
        i, j = np.nonzero(np.triu(hit, 1) if within else hit)
        if not len(i):
            return [], [], []
        i, j = left[i], right[j]
        own = np.concatenate([(shared_list(near[i[k : k + 65536]], near[j[k : k + 65536]], first) == key).all(axis=1) for k in range(0, len(i), 65536)])
        i, j = i[own], j[own]
        count = np.bincount(i, weights=weight[j], minlength=len(rep)) + np.bincount(j, weights=weight[i], minlength=len(rep))
        linked = np.zeros((len(rep), len(rep)), bool)
        linked[i, j] = linked[j, i] = True
        low = rep[_star(linked)]
        some = np.flatnonzero(count > 0)
        return rep[some].tolist(), low[some].tolist(), count[some].astype(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by tile; a tile may span batches."""
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch | None:
            rows = rows.combine_chunks()
            ident = np.column_stack([rows["label"].to_numpy(), rows["list"].to_numpy(), rows["ti"].to_numpy(), rows["tj"].to_numpy(), rows["dim"].to_numpy()])
            cut = np.concatenate(([0], np.flatnonzero((ident[1:] != ident[:-1]).any(axis=1)) + 1, [len(ident)]))
            reps, weights, own = rows["rep"].to_numpy(), rows["weight"].to_numpy(), rows["tile"].to_numpy()
            vecs, nears = rows["vec"].combine_chunks(), rows["near"].combine_chunks()
            flat, starts = vecs.flatten().to_numpy(), np.asarray(vecs.offsets) - vecs.offsets[0].as_py()
            flat_near, at = nears.flatten().to_numpy(), np.asarray(nears.offsets) - nears.offsets[0].as_py()
            out: tuple[list, list, list] = ([], [], [])
            for a, b in zip(cut, cut[1:], strict=False):
                if b - a < 2:
                    continue
                vec = flat[starts[a] : starts[b]].reshape(b - a, -1)
                near = flat_near[at[a] : at[b]].reshape(b - a, -1)
                key = np.array([ident[a, 1] >> 32, ident[a, 1] & 0xFFFFFFFF])
                same = ident[a, 2] == ident[a, 3]
                side = np.zeros(b - a, int) if same else np.where(own[a:b] == ident[a, 2], -1, 1)
                for have, new in zip(out, tile(reps[a:b], vec, weights[a:b], near, side, key), strict=True):
                    have += new
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["rep", "low", "links"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            whole = pa.Table.from_batches(held)
            if whole.num_rows < 4 * TILE:
                continue
            tail = [whole[c][-1].as_py() for c in ("label", "list", "ti", "tj", "dim")]
            last = np.logical_and.reduce([whole[c].to_numpy() == v for c, v in zip(("label", "list", "ti", "tj", "dim"), tail, strict=True)])
            done = int(np.argmax(last))
            if done:
                yield flush(whole.slice(0, done))
                held = whole.slice(done).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def vector_links(rows: DataFrame, threshold: float = 0.93, pivots: int = PIVOTS, nearest: int = NEAREST, first: int = FIRST, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of rows(vec_id, embedding, label).

    Two rows are compared only if their labels are equal and not null, by cosine in double precision. A vector that is
    null, zero, or holds a null, NaN or infinity links with nothing, as does a row without vec_id or label; its
    n_links is 0 and its component its own id. Equal vectors are compared once and linked with each other. Repeated
    rows are rows of their own, and so are rows that share a vec_id but not the vector or the label: each has its own
    links and component. Vectors of different lengths never link. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    vec = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(
        F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False)
    )
    own = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), vec.alias("vec"), good.alias("good"))
    own = own.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), F.reverse("vec")))
    own = materialize(own, "vectors")
    classes = own.where("good").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    # a class has a number of its own, written once: vec_ids may repeat with other vectors or labels
    classes = materialize(classes.withColumn("dim", F.size("vec").cast("long")).withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    sample = classes.orderBy("h1", "h2", "label").limit(SAMPLE).select("vec").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r.vec), []).append(r.vec)
    chosen = {d: choose_pivots(_unit(np.array(v)), pivots) for d, v in by_dim.items()}
    near = materialize(classes.select("rep", "vec").mapInArrow(bounded(_nearest(chosen, nearest)), "rep long, near array<int>"), "vector-pivots")
    pair = "shiftleft(CAST(least(near[i], near[j]) AS BIGINT), 32) + greatest(near[i], near[j])"
    ends = f"sequence(i + 1, size(near) - 1), j -> {pair}"  # i is the nearer one of the pair, so it decides
    pairs = F.expr(f"CASE WHEN size(near) = 1 THEN array(shiftleft(CAST(near[0] AS BIGINT), 32) + near[0]) ELSE flatten(transform(sequence(0, least({first}, size(near) - 1) - 1), i -> transform({ends}))) END")
    listed = classes.select("rep", "label", "dim").join(near, "rep").select("rep", "label", "dim", F.explode(pairs).alias("list"))
    listed = listed.withColumn("n", F.count("*").over(Window.partitionBy("label", "dim", "list"))).where("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    listed = listed.withColumn("tile", F.pmod(F.xxhash64("rep"), tiles).cast("int")).select(
        "rep", "label", "dim", "list", "tile", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other")
    )
    listed = listed.select("rep", "label", "dim", "list", "tile", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"))
    unit = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    moved = classes.join(near, "rep").withColumn("norm", F.sqrt(unit)).select("rep", "weight", "near", F.transform("vec", lambda x: x / F.col("norm")).alias("vec"))
    key = ["label", "dim", "list", "ti", "tj"]
    filled = listed.join(moved, "rep").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key)
    found = materialize(filled.mapInArrow(bounded(_compare(threshold, first)), "rep long, low long, links long"), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")), "vector-stars")
    groups = materialize(classes.select("label", "h1", "h2", "rep", "weight", "least").join(groups.withColumnRenamed("node", "rep"), "rep", "left"), "vector-groups")
    lowest = groups.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("lowest"))
    named = (
        groups.join(counts, "rep", "left").join(lowest, "component", "left")
        .select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("lowest", "least").alias("component"))
    )
    result = own.where("good").select("vec_id", "label", "h1", "h2").join(named, ["label", "h1", "h2"]).select(
        "vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id")
    ).unionByName(own.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_neighbors(spark, sf_dir: str) -> DataFrame:
    return vector_links(read(spark, sf_dir, "embeddings"))
