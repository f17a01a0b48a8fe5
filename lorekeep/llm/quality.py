"""Quality classifier by hierarchical empirical Bayes.

Document level: from a bounded sample of labelled rows Spark counts features (words, openings of words, bands of a few
ratios) in good and bad documents; those that point to bad documents are kept with their log odds. The sum of a
document's log odds is cut into bands, and the shares of good and bad documents in each band, in a third of the sample
that the features are not counted on, give the document's evidence as a log likelihood ratio. Site level: the expected bad documents of each host are shrunk toward the
global share, and those of each path toward its host, by Beta priors whose strength comes from the spread of the hosts
(of the paths in their host) by the method of moments. A document's log odds are its path's plus its evidence, where the
path's and the host's sums leave the document itself out, so that its evidence counts once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import BROADCAST_ROWS, bounded, materialize, read, slices

#: The labelled rows that are fitted on at most, those with the smallest hashes of doc_id.
LABELLED = 20_000
#: Features that a task counts before it hands the counts on.
HELD = 200_000
#: A feature's least number of bad documents, also as a share of all bad ones (copies of one text are not support), and least log odds.
#: SHARE bounds the features that are kept, and sent to the tasks: a document's features, on average, over SHARE.
SUPPORT, SHARE, LOG_ODDS = 6, 0.012, 3.0
#: Upper ends of the bands of a document's summed log odds.
BANDS = (0.0, 3.5, 4.5, 6.0, 9.0, 14.0)
_ODD = re.compile(r"[^\w\s.,;:'\"()?-]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def ratios(text: str, words: list[str]) -> list[str]:
    """Features of the whole text's shape, each with its band."""
    n, chars = max(1, len(words)), max(1, len(text))
    kinds = Counter(words)
    size = min(6, n.bit_length() // 2)
    same = sum(map(str.__eq__, words, words[1:]))
    upper = len(_UPPER.findall(text))
    return [
        f"<odd {min(20, int(100 * len(_ODD.findall(text)) / chars))}",
        f"<upper {min(20, int(20 * upper / chars))}",
        f"<same {min(20, int(20 * same / n))}",
        f"<kinds {int(20 * len(kinds) / n)} {size}",
        f"<top {int(20 * max(kinds.values(), default=0) / n)} {size}",
        f"<length {min(30, chars // n)}",
    ]


def features(text: str | None) -> set[str]:
    """Distinct features: words in lower case without outer marks, their first three to six letters, and the ratios."""
    text = text or ""
    words = text.split()
    plain = {w.strip(".,;:!?\"'()").lower() for w in set(words)}
    found = set(plain)
    for k in (4, 5, 6):
        found.update(f"^{w[:k]}" for w in plain if len(w) > k)
    found.update(ratios(text, words))
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> Iterator[pa.RecordBatch]:
        names = list(counts[0].keys() | counts[1].keys())
        for i in range(0, len(names), 20_000):
            part = names[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[x] for x in part], pa.int64()) for c in counts)], names=["feature", "good", "bad"])
        for c in counts:
            c.clear()

    for b in slices(batches, 0):
        for text, bad in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts[bad].update(features(text))
            if sum(map(len, counts)) > HELD:
                yield from flush()
    yield from flush()


def _sum_log_odds(strong: dict[str, float]):
    names = frozenset(strong)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            sums = [math.fsum(sorted(strong[f] for f in features(t) & names)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(sums, pa.float64())], names=[*b.schema.names[1:], "odds"])

    return run


class Evidence:
    """The fitted document classifier: strong features with log odds, and the evidence of each band."""

    def __init__(self, strong: dict[str, float], bands: list[float], share: float):
        self.strong, self.bands, self.share = strong, bands, share

    def column(self, odds):
        out = F.lit(float(self.bands[-1]))
        for top, value in reversed(list(zip(BANDS, self.bands, strict=False))):
            out = F.when(odds <= top, F.lit(float(value))).otherwise(out)
        return out


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Evidence:
    """Fit on at most `labelled` rows of labels(doc_id, quality, toxic): bad is quality 0 or toxic 1."""
    bad = ((F.col("quality") == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).cast("int")
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(bad).alias("bad"))
    marks = materialize(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "quality-labels")  # at most `labelled` rows
    sample = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(marks), "doc_id")
    sample = materialize(sample.select("text", "bad", (F.pmod(F.xxhash64("text"), F.lit(3)) == 0).alias("held")), "quality-sample")
    sizes = {(r.held, r.bad): r.n for r in sample.groupBy("held", "bad").agg(F.count("*").alias("n")).collect()}
    n_good, n_bad = sizes.get((False, 0), 0), sizes.get((False, 1), 0)
    counted = sample.where("NOT held").select("text", "bad").mapInArrow(bounded(_count), "feature string, good long, bad long")
    counted = counted.groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("good") + 0.5) / (n_good + 1.0))
    top = counted.where(F.col("bad") >= max(SUPPORT, SHARE * n_bad)).select("feature", odds.alias("odds")).where(F.col("odds") >= LOG_ODDS)
    strong = {r.feature: r.odds for r in top.collect()}
    scored = sample.where("held").select("text", "bad").mapInArrow(bounded(_sum_log_odds(strong)), "bad int, odds double")
    n_good, n_bad = sizes.get((True, 0), 0), sizes.get((True, 1), 0)
    cases = [F.sum(((F.col("odds") > low) & (F.col("odds") <= high) & (F.col("bad") == k)).cast("int")) for low, high in zip((-1e9, *BANDS), (*BANDS, 1e9), strict=True) for k in (0, 1)]
    row = [x or 0 for x in scored.agg(*[c.alias(str(i)) for i, c in enumerate(cases)]).first()]
    good, bads = row[::2], row[1::2]
    bands = [math.log((b + 0.5) / (n_bad + 1)) - math.log((g + 0.5) / (n_good + 1)) for g, b in zip(good, bads, strict=True)]
    bands = np.maximum.accumulate(bands).tolist()  # more evidence never counts for less
    return Evidence(strong, bands, (n_bad + 1.0) / (n_good + n_bad + 2.0))


def _strength(total, square, groups, mean):
    """Beta prior strength from the spread of group shares: mean (1 - mean) / variance - 1, within 1 and 10,000."""
    var = square / groups - (total / groups) * (total / groups)
    return F.when((groups > 1) & (var > 0), F.greatest(F.lit(1.0), F.least(F.lit(1e4), mean * (1 - mean) / var - 1))).otherwise(F.lit(100.0))


def site_sums(scored: DataFrame, share: float) -> tuple[DataFrame, dict[str, float]]:
    """From scored(host, path, p), each document's chance to be bad by itself: (host_, path_, hs, hn, s, n), the sums and
    numbers of each path and its host, and the priors: the global mean and the strengths of hosts and of paths."""
    groups = materialize(scored.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")), "quality-paths")
    hosts = groups.groupBy(F.col("host").alias("h")).agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    q = F.col("hs") / F.col("hn")
    whole = hosts.agg(F.sum("hs").alias("s"), F.sum("hn").alias("n"), F.sum(q).alias("t"), F.sum(q * q).alias("t2"), F.count("*").alias("g"))
    mean = F.coalesce(F.col("s") / F.col("n"), F.lit(share))
    prior = whole.select(mean.alias("mean"), _strength(F.col("t"), F.col("t2"), F.col("g"), mean).alias("host")).first().asDict()
    hosts = F.broadcast(hosts) if hosts.count() <= BROADCAST_ROWS else hosts
    paths = groups.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select(F.col("host").alias("host_"), F.col("path").alias("path_"), "hs", "hn", "s", "n")
    host_bad = (F.col("hs") + prior["host"] * prior["mean"]) / (F.col("hn") + prior["host"])
    r = F.col("s") / F.col("n") - host_bad
    spread = paths.agg(F.sum(r).alias("t"), F.sum(r * r).alias("t2"), F.count("*").alias("g"), F.avg(host_bad).alias("m"))
    prior["path"] = spread.select(F.coalesce(_strength(F.col("t"), F.col("t2"), F.col("g"), F.col("m")), F.lit(100.0)).alias("k")).first().k
    return paths, prior


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", labelled: int = LABELLED, threshold: float = 0.5) -> DataFrame:
    """doc_id, evidence, host_bad, path_bad, p_bad, kept, text_hash (xxhash64 of the text) of every row.

    host_bad and path_bad are the posteriors of the document's site from its other documents. Null or empty text is
    judged by its features like any other; null hosts and paths are sites of their own; repeated rows are judged each;
    without labels every document has the same evidence. An empty table gives an empty result. Only doc_id, text, host
    and path are read of docs.
    """
    model = fit(docs, labels, labelled)
    rows = docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    scored = rows.mapInArrow(bounded(_sum_log_odds(model.strong)), "doc_id long, text_hash long, host string, path string, odds double")
    prior = math.log(model.share / (1 - model.share))
    scored = scored.withColumn("evidence", model.column(F.col("odds"))).withColumn("p", 1 / (1 + F.exp(-F.col("evidence") - prior)))
    scored = materialize(scored, "quality-scored")
    sites, k = site_sums(scored, model.share)
    sites = materialize(sites, "quality-sites")
    sites = F.broadcast(sites) if sites.count() <= BROADCAST_ROWS else sites
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("host_")) & F.col("path").eqNullSafe(F.col("path_")))
    joined = joined.withColumn("host_bad", (F.greatest(F.lit(0.0), F.col("hs") - F.col("p")) + k["host"] * k["mean"]) / (F.col("hn") - 1 + k["host"]))
    joined = joined.withColumn("path_bad", (F.greatest(F.lit(0.0), F.col("s") - F.col("p")) + k["path"] * F.col("host_bad")) / (F.col("n") - 1 + k["path"]))
    odds = F.log(F.col("path_bad") / (1 - F.col("path_bad"))) + F.col("evidence")
    joined = joined.withColumn("p_bad", 1 / (1 + F.exp(-odds)))
    return joined.select("doc_id", "evidence", "host_bad", "path_bad", "p_bad", (F.col("p_bad") < threshold).alias("kept"), "text_hash")


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
