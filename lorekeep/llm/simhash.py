"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is described by the number of ones in each of its 32 two-bit segments. One differing bit changes
one count by one, so the Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints.
The grid join finds vectors at distance <= 2: each fingerprint is filed under its own grid point and the points next to
it (65 at most), and two vectors at distance <= 2 always share a point. Fingerprints alone on all their points are done.
The others are verified exactly, without listing pairs: two fingerprints differ in at most two bits if and only if they
share a 64-bit word within one flipped bit of each. A flip moves a fingerprint to one of its points, so on a shared point
each is filed under the one or two flips that lead there, and words held by several fingerprints give links. Every step
is linear in the number of distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import bounded, materialize
from lorekeep.operators.graph import connected_components

SEGMENTS, WIDTH = 32, 2
SEED = 42


def fingerprint(text: str | None, shingle: int = 3, lower: bool = True) -> int:
    """Signed 64-bit SimHash of the whole text; 0 for a text that is null or has no words."""
    if not text:
        return 0
    raw = text.encode("utf-8", "surrogatepass")
    words = (raw.lower() if lower else raw).split()  # bytes: A-Z only, and white space is space and \t..\r
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64, count=n))


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: the bits that over half of the 64-bit hashes have."""
    n = len(hashes)
    # a byte lane for each bit: up to 255 rows can be added as 64-bit words before a lane is full
    lanes = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").view(np.uint64)
    sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0)
    ones = sums.view(np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [fingerprint(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(marks, pa.int64())], names=["doc_id", "text_hash", "fp"])

    return run


def over_texts(docs: DataFrame, f: Callable, schema: str) -> DataFrame:
    """f over Arrow slices of (doc_id long, text string, text_hash long), for every row."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text).alias("text_hash")).mapInArrow(bounded(f, 1), schema)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id long, text_hash long, fp long) of every row."""
    return over_texts(docs, _batches(shingle), "doc_id long, text_hash long, fp long")


def first_row() -> Column:
    """Aggregate: the row (nameless, doc_id, text_hash) with the smallest doc_id, of equal ones the smallest hash; a row
    without a doc_id, which is nameless, only if there is no other."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash"))


def _flipped(fp: Column, b: Column) -> Column:
    return fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))


def grid_point(fp: Column) -> Column:
    """The vector of segment counts, two bits for each: whether the count is two, and whether it is one or two."""
    odd, next_ = F.lit(0x5555555555555555).cast("long"), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseAND(next_).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseOR(next_).bitwiseAND(odd), 1))


def _bits() -> Column:
    return F.sequence(F.lit(0), F.lit(63))


def _near_points(fp: Column) -> Column:
    """The grid point of fp and all points next to it: those to which one flip leads."""
    return F.array_union(F.array(grid_point(fp)), F.transform(_bits(), lambda b: grid_point(_flipped(fp, b))))


def links(marks: DataFrame) -> DataFrame:
    """Links (a, b) between rows of marks(fp, rep), fp distinct, that join all fp within two bits of each other."""
    filed = marks.select("fp", "rep", F.explode(_near_points(F.col("fp"))).alias("point"))
    shared = filed.withColumn("n", F.count("*").over(Window.partitionBy("point"))).where("n > 1")
    fp, point = F.col("fp"), F.col("point")
    flips = F.transform(F.filter(_bits(), lambda b: grid_point(_flipped(fp, b)) == point), lambda b: _flipped(fp, b))
    words = shared.select("rep", F.explode(F.when(grid_point(fp) == point, F.array(fp)).otherwise(flips)).alias("word"))
    low = words.select("rep", F.min("rep").over(Window.partitionBy("word")).alias("low"))
    return low.where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()


def simhash_components(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash, fp, component_id, component_hash of every row: the first row that links of at most two bits reach.

    component_id is the smallest doc_id of the group, component_hash the smallest text_hash (xxhash64) among its rows.
    Null text counts as empty, and texts without words have fingerprint 0, linked like any other. Repeated rows stay,
    each with its group's id. A null doc_id never names a group; a group of such rows only has a null id, and the hash. Rows with one
    doc_id and different texts are told apart. An empty table gives an empty result. Columns other than doc_id and text
    are not read.
    """
    marks = materialize(fingerprints(docs, shingle), "simhash")
    classes = materialize(marks.groupBy("fp").agg(first_row().alias("first")), "simhash-classes")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = classes.select("fp", F.col("fp").alias("rep")).repartition(n, "fp")  # the classes are a few small files, but fan out
    found = connected_components(links(spread), "simhash-links")
    linked = classes.join(found, classes["fp"] == found["node"]).select("fp", "component", "first")
    firsts = linked.groupBy("component").agg(F.min("first").alias("group_first"))
    named = materialize(linked.join(firsts, "component").select("fp", "group_first"), "simhash-named")
    named = classes.join(named, "fp", "left").select("fp", F.coalesce("group_first", "first").alias("first"))
    return marks.join(named, "fp").select("doc_id", "text_hash", "fp", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("component_hash"))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    from lorekeep.llm.common import read

    found = simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
