"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame and SQL functions only.

Each source's documents, in a shuffled but fixed order, form a stream of words that is repeated as often as its target
needs and is cut into blocks of equal size. Slot i of the schedule looks up the golden-ratio point frac(i * phi) in the
cumulative targets; the r-th slot that falls to a source takes the source's block r. Ranks and stream positions are
made in two levels (within a chunk, then over the chunks' totals), so no source is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import BROADCAST_ROWS, materialize, read, small, word_count

GOLDEN = 0.6180339887498949
#: Words of a block, slots of a chunk, rows for each bucket of a stream, and cells in which points look up their source.
BLOCK_WORDS, CHUNK, BUCKET, CELLS = 512, 16_384, 1_024, 1_024


def source_targets(sizes: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(sid, source, weight, source_size, target, words): targets share all words by weight, none above max_epochs sizes.

    The shared level is found in closed form: by ascending cap per weight, a source is capped while its cap is at most
    the level that the rest would get. words is the target in whole words. Null is the last source.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("sid", F.row_number().over(w).cast("long") - 1)
    src = src.withColumn("weight", F.element_at(cycle, (F.col("sid") % len(weights) + 1).cast("int")))
    src = src.withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    up = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    everything = Window.partitionBy(F.lit(1))
    src = src.withColumn("before", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    src = src.withColumn("rest", F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    src = src.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    src = src.withColumn("capped", F.col("cap") / F.col("weight") <= (F.col("total") - F.col("before")) / F.col("rest"))
    held = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    src = src.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise((F.col("total") - held) / free * F.col("weight")))
    return src.select("sid", "source", "weight", "source_size", "target", F.least(F.round("target"), F.col("cap")).cast("long").alias("words"))


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, sid, block): the mix in order. Each source gets exactly as many slots as its words fill blocks.

    Points give each source its share within a few slots; what is over its number of blocks is cut, what is short is
    put at the end.
    """
    spark = targets.sparkSession
    quota = targets.where("words > 0").select("sid", F.ceil(F.col("words") / block_words).cast("long").alias("blocks"))
    spans = Window.orderBy("sid")
    quota = quota.withColumn("hi", F.sum("blocks").over(spans))
    n = quota.agg(F.coalesce(F.max("hi"), F.lit(0)).alias("n")).first()["n"]
    quota = quota.select("sid", "blocks", (F.col("hi") - F.col("blocks")).cast("double").alias("lo"), F.col("hi").cast("double"))
    cells = quota.select(
        "sid", (F.col("lo") / n).alias("lo"), (F.col("hi") / n).alias("hi"),
        F.explode(F.sequence(F.floor(F.col("lo") / n * CELLS), F.floor(F.col("hi") / n * CELLS))).alias("cell"),
    ) if n else quota.select("sid", "lo", "hi", F.lit(0).cast("long").alias("cell")).limit(0)
    points = spark.range(n).select(F.col("id").alias("slot"), F.expr(f"(id * {GOLDEN}D) % 1D").alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * CELLS))
    hits = points.join(small(cells), "cell").where("x >= lo AND x < hi").select("slot", "sid", F.expr(f"slot div {CHUNK}").alias("chunk"))
    hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")))
    sums = hits.groupBy("sid", "chunk").agg(F.max("r").alias("n"))
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    ranked = hits.join(sums, ["sid", "chunk"]).select("slot", "sid", (F.col("before") + F.col("r") - 1).alias("block"))
    ranked = ranked.join(small(quota.select("sid", "blocks")), "sid").where("block < blocks").select("slot", "sid", "block")
    ranked = materialize(ranked, "mix-slots")
    have = quota.join(ranked.groupBy("sid").agg(F.count("*").alias("have")), "sid", "left")
    short = have.where("coalesce(have, 0) < blocks").select("sid", F.explode(F.expr("sequence(coalesce(have, 0), blocks - 1)")).alias("block"))
    return ranked.unionByName(short.select((F.lit(n) + F.col("block")).alias("slot"), "sid", "block"))


def stream_positions(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """sizes with sid, source_size, target, words, a row key (sid, bucket, rid) and its first word's place in the source's stream."""
    n = sizes.count()
    buckets = max(1, n // BUCKET)
    rows = sizes.withColumn("bucket", F.expr(f"pmod(h, {buckets})"))
    side = targets.withColumnRenamed("source", "their_source")
    side = F.broadcast(side) if targets.count() <= BROADCAST_ROWS else side
    rows = rows.join(side, F.col("source").eqNullSafe(F.col("their_source"))).drop("their_source", "source")
    order = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size", "text_hash")
    rows = rows.withColumn("rid", F.row_number().over(order))
    rows = rows.withColumn("at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    sums = sizes.join(side, sizes["source"].eqNullSafe(F.col("their_source"))).groupBy("sid", F.expr(f"pmod(h, {buckets})").alias("bucket")).agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("sid", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(sums, ["sid", "bucket"]).withColumn("at", F.col("at") + F.col("before")).drop("before")


def mix(docs: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """The mix as spans: one row for each piece of a document in a slot, and one with null slot for each document.

    Columns: doc_id, text_hash (xxhash64 of the text), size, source_size, target, sid, bucket, rid (the row's key), turn
    (place in the repeated stream), slot, start (word of the document), n (words; 0 in the row with null slot). Null text has size 0 and is taken 0 times; null sources are one
    source; repeated rows are kept apart; an empty table gives an empty result. Only doc_id, text and source are read.
    """
    sizes = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    sizes = materialize(sizes.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_hash")), "mix-sizes")
    targets = materialize(source_targets(sizes, max_epochs, weights), "mix-targets")
    slots = schedule(targets, block_words)
    rows = stream_positions(sizes, targets)
    turns = F.expr(
        "concat(array(struct(CAST(NULL AS BIGINT) AS lo, CAST(NULL AS BIGINT) AS hi, 0L AS first)),"
        f" filter(transform(sequence(0L, {max_epochs - 1}L), e -> struct(e * source_size + at AS lo,"
        " least(e * source_size + at + size, words) AS hi, e * source_size + at AS first)), t -> t.hi > t.lo))"
    )
    rows = rows.select("doc_id", "text_hash", "size", "source_size", "target", "sid", "bucket", "rid", F.explode(turns).alias("t"))
    # a document's row without slot has a block that no slot has, another for each bucket: it finds nothing and is spread
    blocks = F.expr(f"if(t.lo IS NULL, array(-1L - bucket), sequence(t.lo div {block_words}, (t.hi - 1) div {block_words}))")
    rows = rows.select("*", F.explode(blocks).alias("block")).withColumn("lo", F.when(F.col("block") >= 0, F.greatest("t.lo", F.col("block") * block_words)))
    rows = rows.withColumn("n", F.when(F.col("block") >= 0, F.least("t.hi", (F.col("block") + 1) * block_words) - F.col("lo")).otherwise(0))
    spans = rows.join(slots, ["sid", "block"], "left").where("block < 0 OR slot IS NOT NULL")
    return spans.select("doc_id", "text_hash", "size", "source_size", "target", "sid", "bucket", "rid", F.col("t.first").alias("turn"), "slot", (F.col("lo") - F.col("t.first")).alias("start"), "n")


def mix_totals(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs."""
    spans = mix(docs, **options)
    found = spans.groupBy("sid", "bucket", "rid").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("n").cast("long").alias("taken")
    )
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_totals(read(spark, sf_dir, "documents"))
