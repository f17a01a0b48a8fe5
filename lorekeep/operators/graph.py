"""Connected components of a link table: parts of it are contracted where they lie, then alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType, StructField, StructType

from lorekeep.functions.work import materialize

#: Links that are contracted at a time.
CHUNK = 1 << 18
#: A side of a join is hinted for broadcast only if it has at most this many rows.
BROADCAST_ROWS = 200_000


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
    return tuple(row)


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest one that it reaches over the links a, b: roots hang on smaller roots."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def _contract(chunk: int):
    """(node, root) of links (a, b): each node of a chunk with the smallest node that it reaches inside the chunk."""

    def stars(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = pa.Table.from_batches(batches)
        ends = pa.chunked_array(links.column(0).chunks + links.column(1).chunks).combine_chunks().dictionary_encode()
        order = pc.sort_indices(ends.dictionary)
        nodes = ends.dictionary.take(order)
        rank = np.empty(len(nodes), np.int64)
        rank[order.to_numpy()] = np.arange(len(nodes))
        ids = rank[ends.indices.to_numpy()]
        root = pa.array(_least(ids[: len(links)], ids[len(links) :], len(nodes)))
        yield from pa.table([nodes, nodes.take(root)], names=["node", "root"]).to_batches(1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= chunk:
                yield from stars(held)
                held = []
        if sum(x.num_rows for x in held):
            yield from stars(held)

    return run


def connected_components(edges: DataFrame, name: str = "links", max_rounds: int = 60, chunk: int = CHUNK) -> DataFrame:
    """(node, component): for each node of edges(a, b) the smallest node that it can reach.

    Null ends and loops are dropped; an empty table gives an empty result. Links are dealt out by ranges of their ends,
    and each task hangs the nodes of `chunk` links at a time on the smallest that they reach there. A node that lies in
    several chunks links their roots, and only these links go on in the same way. Where that doesn't halve them, and for
    ends that are neither integers nor strings, rounds of stars do the rest.
    """
    links = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), name)
    kind = links.schema["a"].dataType
    if isinstance(kind, IntegralType) or kind == StringType():
        return _contracted(links, name, max_rounds, chunk)
    return _stars(links, name, max_rounds)


def _contracted(links: DataFrame, name: str, max_rounds: int, chunk: int) -> DataFrame:
    kind = links.schema["a"].dataType
    schema = StructType([StructField("node", kind), StructField("root", kind)])
    dealt = links.repartitionByRange("a", "b").sortWithinPartitions("a", "b")
    forest = materialize(dealt.mapInArrow(_contract(chunk), schema), name)
    hung = materialize(forest.groupBy("node").agg(F.min("root").alias("m")), name)
    crossing = forest.join(hung, "node").where("root <> m").select(F.col("root").alias("a"), F.col("m").alias("b"))
    crossing = materialize(crossing.distinct(), name)
    left = crossing.count()
    if not left:
        return hung.withColumnRenamed("m", "component")
    over = _contracted(crossing, name, max_rounds, chunk) if 2 * left <= links.count() else _stars(crossing, name, max_rounds)
    over = over.withColumnRenamed("node", "m")
    over = F.broadcast(over) if 2 * left <= BROADCAST_ROWS else over  # two nodes a link at most
    return hung.join(over, "m", "left").select("node", F.coalesce("component", "m").alias("component"))


def _stars(links: DataFrame, name: str, max_rounds: int) -> DataFrame:
    """The components of links (a, b) with a > b, by stars alone.

    Each round is a few shuffles of the link table only and is written to the shared folder, so lineage stays short;
    the number of rounds grows with the logarithm of the longest chain. A chain that hasn't closed in max_rounds raises.
    """
    links = materialize(links.distinct(), name)
    before = _digest(links)
    if not before[0]:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every link now points down; the small star hangs each node's lower neighbours on the lowest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        links = materialize(small.select("e.a", "e.b").where("a <> b").distinct(), name)
        after = _digest(links)
        if after == before:
            return links.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
