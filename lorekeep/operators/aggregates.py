"""Distributions, order statistics, confusion tables, slices, signals and ladders of status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_statistics(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, n, mean, upper_median, p90, p95): sorted[n div 2] and ceil-rank percentiles of integer values.

    Equal values are counted first, so what is sorted is the distinct values of a group.
    """
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    counts = counts.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col(value)))
    return counts.groupBy(*by).agg(
        F.max("n").alias("n"), F.round(F.sum(F.col(value) * F.col("c")) / F.max("n"), 6).alias("mean"), at(F.floor(F.col("n") / 2) + 1).alias("upper_median"),
        at(F.ceil(F.col("n") * 90 / 100)).alias("p90"), at(F.ceil(F.col("n") * 95 / 100)).alias("p95"),
    )


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Linear interpolation at (n - 1) p."""
    return rows.groupBy(*by).agg(*[F.round(F.percentile(F.col(value).cast("double"), F.lit(p)), 6).alias(f"q{round(100 * p)}") for p in shares])


def confusion(rows: DataFrame, actual: str, predicted: str, classes: Sequence) -> DataFrame:
    """(actual, predicted, n) with zero cells."""
    grid = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("actual")).select("actual", F.explode(F.array(*[F.lit(c) for c in classes])).alias("predicted"))
    seen = rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(seen, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def slice_rollup(rows: DataFrame, by: Sequence[str], slices: Column, errors: str, total: str) -> DataFrame:
    """Errors over total for each slice; a row counts in all its slices. Status follows what could be scored."""
    s = rows.select(*by, F.explode(slices).alias("slice"), F.col(errors).alias("e"), F.col(total).alias("t"))
    scored = F.col("t") > 0
    g = s.groupBy(*by, "slice").agg(
        F.count("*").alias("n"), F.count_if(scored).alias("n_scored"), F.sum(F.when(scored, F.col("e")).otherwise(0)).alias("errors"), F.sum(F.when(scored, F.col("t")).otherwise(0)).alias("total")
    )
    status = F.when(F.col("n_scored") == 0, "unscorable").when(F.col("n_scored") < F.col("n"), "partial").otherwise("scored")
    return g.withColumn("rate", F.round(F.try_divide(F.col("errors").cast("double"), F.col("total").cast("double")), 6)).withColumn("status", status)


def dbfs(x: Column) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(1e-12)))


def signal_stats(rows: DataFrame, samples: str) -> list[Column]:
    """Expressions clipping, peak, rms, silence over an array of samples; an empty one gives 0, -120, -120, 1.

    Digital silence has the floor of dbfs, -240. A null, NaN or infinite sample raises.
    """
    v = F.transform(samples, lambda x: F.abs(x.cast("double")))
    n = F.size(samples)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (x == float("inf")))
    v = F.when(bad, F.raise_error(F.lit("signal samples must be finite")).cast("array<double>")).otherwise(v)
    share = lambda f: F.size(F.filter(v, f)) / n
    rms = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) / n)
    some = n > 0
    return [
        F.when(some, share(lambda x: x >= 0.999)).otherwise(0.0).alias("clipping"),
        F.when(some, F.round(dbfs(F.array_max(v)), 6)).otherwise(-120.0).alias("peak_dbfs"),
        F.when(some, F.round(dbfs(rms), 6)).otherwise(-120.0).alias("rms_dbfs"),
        F.when(some, share(lambda x: x < 1e-4)).otherwise(1.0).alias("silence"),
    ]


def level(score: Column, speech: Column) -> Column:
    """none, dominant, background or uncertain, by the first rung that holds."""
    return F.when(score < 0.339844, "none").when(score >= 0.80, "dominant").when(speech >= 0.565918, "background").otherwise("uncertain")


def degraded(clipping: Column, rms: Column, silence: Column) -> Column:
    return F.when((clipping > 0.01) | (rms < -45) | (silence > 0.85), "degraded").otherwise("clean")


def verdict(wer: Column, der: Column, timings: Column, *gates: Column) -> Column:
    """insufficient_evidence unless every gate holds and 200 words were timed by hand; then pass, or blocked.

    Gates are a declared split, a human-reviewed reference, a named reviewer other than the machine, model fingerprints
    and a held-out slice; null doesn't hold. With enough evidence a missing rate blocks, like one beyond its threshold.
    """
    enough = F.coalesce(timings >= 200, F.lit(False))
    for g in gates:
        enough = enough & F.coalesce(g, F.lit(False))
    return F.when(~enough, "insufficient_evidence").when(F.coalesce((wer <= 0.25) & (der <= 0.25), F.lit(False)), "pass").otherwise("blocked")


def class_means(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean probability of each class over windows(class_id, label, p); a class with two labels raises."""
    g = rows.groupBy(*by, "class_id").agg(F.avg("p").alias("p"), F.count_distinct("label").alias("_labels"), F.min("label").alias("label"))
    same = F.when(F.col("_labels") == 1, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("labels drift in class "), F.col("class_id").cast("string"))))
    return g.select(*by, "class_id", same.alias("label"), F.round("p", 6).alias("p"))


#: Ends of the bins of chunk lengths in milliseconds (fixed values), besides exactly thirty seconds.
BINS = (8_000, 10_000, 12_000, 14_000, 16_000, 18_000, 20_000, 25_000, 30_000)


def chunk_distribution(chunks: DataFrame, by: Sequence[str], hard_ms: int = 30_000, short_ms: int = 4_000) -> DataFrame:
    """One row for each group of chunks(start_ms, end_ms, reason, conflict): number, mean, upper median, p90, p95, nine bins,
    shares in percent, and how many end at the hard maximum, in a conflict, or short at the recording's end."""
    rows = chunks.withColumn("ms", F.col("end_ms") - F.col("start_ms"))
    ms = F.col("ms")
    bins = {f"bin_{a // 1000}_{b // 1000}": (ms >= a) & (ms < b) for a, b in zip(BINS, BINS[1:], strict=False)} | {"bin_30": ms == hard_ms}
    shares = {"share_8_16": (ms >= 8_000) & (ms <= 16_000), "share_over_16": ms > 16_000, "share_30": ms == hard_ms}
    counts = {"n_hard": F.col("reason") == "hard_maximum", "n_conflict": F.coalesce("conflict", F.lit(False)), "n_short_end": (F.col("reason") == "episode_end") & (ms < short_ms)}
    counted = rows.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in (bins | counts).items()], *[F.round(100 * F.count_if(c) / F.count("*"), 6).alias(n) for n, c in shares.items()])
    return order_statistics(rows, by, "ms").join(counted, list(by))


def reason_counts(chunks: DataFrame, by: Sequence[str], *columns: str) -> DataFrame:
    """(by, what, value, n): how often each value of each column is; null values aren't counted."""
    pairs = F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")) for c in columns])
    rows = chunks.select(*by, F.explode(pairs).alias("x")).select(*by, "x.*").where("value IS NOT NULL")
    return rows.groupBy(*by, "what", "value").agg(F.count("*").alias("n"))


def progress(rows: DataFrame, by: Sequence[str], done: Column) -> DataFrame:
    """(by, done, total, left)."""
    g = rows.groupBy(*by).agg(F.count_if(F.coalesce(done, F.lit(False))).alias("done"), F.count("*").alias("total"))
    return g.withColumn("left", F.col("total") - F.col("done"))


def dispatch_report(rows: DataFrame) -> DataFrame:
    """(adapter, status, n, hypotheses, failed): dispatches by adapter and status, the number with a hypothesis (of those that
    succeeded) and with an error. The ids themselves are rows of the input: where status = 'succeeded'."""
    own = (F.col("status") == "succeeded") & F.col("hypothesis_id").isNotNull()
    return rows.groupBy("adapter", "status").agg(F.count("*").alias("n"), F.count_if(own).alias("hypotheses"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def voice_counts(exemplars: DataFrame) -> DataFrame:
    """One row: exemplars, speakers with a centroid, episodes."""
    return exemplars.agg(F.count("*").alias("exemplars"), F.count_distinct("episode", "speaker").alias("centroids"), F.count_distinct("episode").alias("episodes"))
