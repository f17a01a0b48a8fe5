"""Sources and sinks: manifests, evaluation documents, artifacts, generations, and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import caption, rttm_seconds, timestamp
from lorekeep.sources.paths import safe_relative

EPISODE = "relative_filename string, episode_date date, sha256 string, size_bytes bigint, duration_ms bigint, codec string, channels int, sample_rate_hz int"
MANIFEST = f"schema_version int, observed_at date, selection string, golden_episode string, episodes array<struct<{EPISODE.replace(' string', ':string').replace(' date', ':date').replace(' bigint', ':bigint').replace(' int', ':int')}>>"
INTERVAL = "speaker_id:string,start_ms:bigint,end_ms:bigint,confidence:double"
EVALUATION = (
    "source_sha256 string, duration_ms bigint, time_origin_ms bigint, "
    "words array<struct<word_id:string,text:string,start_ms:bigint,end_ms:bigint,confidence:double,speaker_id:string,overlap:boolean>>, "
    f"turns array<struct<{INTERVAL}>>, exclusive_turns array<struct<{INTERVAL}>>, overlap_intervals array<struct<speaker_ids:array<string>,start_ms:bigint,end_ms:bigint>>"
)


def read_manifest(spark: SparkSession, path: str, expected: Sequence[int] = (20, 400)) -> DataFrame:
    """One row per episode of a manifest; the number of episodes, the uniqueness of their names, and that each has a date, a
    duration, a size and a digest, are checked."""
    doc = spark.read.schema(MANIFEST).json(path, multiLine=True, mode="FAILFAST")
    rows = doc.select("schema_version", "selection", "golden_episode", F.explode("episodes").alias("e")).select("*", "e.*").drop("e")
    bad = F.count_if(F.coalesce((F.col("duration_ms") <= 0) | (F.col("size_bytes") <= 0) | ~F.col("sha256").rlike("^[0-9a-f]{64}$") | F.col("episode_date").isNull(), F.lit(True)))
    n, names, faults = rows.agg(F.count("*"), F.count_distinct("relative_filename"), bad).first()
    if n not in expected or names != n or faults:
        raise ValueError(f"{n} episodes with {names} names, {faults} with invalid fields")
    return rows


def read_evaluation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, turns, overlaps) of evaluation documents; a time origin other than zero raises."""
    doc = spark.read.schema(EVALUATION).json(path, multiLine=True, mode="FAILFAST").withColumn("origin", F.coalesce("time_origin_ms", F.lit(0)))
    doc = doc.withColumn("source_sha256", F.when(F.col("origin") == 0, F.col("source_sha256")).otherwise(F.raise_error(F.lit("the time origin is not zero"))))
    part = lambda c: doc.select("source_sha256", F.explode(c).alias("x")).select("source_sha256", "x.*")
    return part("words"), part("turns"), part("overlap_intervals")


def activity_cover(counts: DataFrame, frame_ms: int, duration_ms: Column | str) -> DataFrame:
    """(episode, start_ms, end_ms, n) from frame counts(episode, frame, n): runs of equal counts that cover the recording."""
    w = Window.partitionBy("episode").orderBy("frame")
    new = (~F.lag("n").over(w).eqNullSafe(F.col("n"))).cast("int")
    runs = counts.withColumn("_run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = runs.groupBy("episode", "_run", "n").agg((F.min("frame") * frame_ms).alias("start_ms"), F.least((F.max("frame") + 1) * frame_ms, F.max(duration_ms)).alias("end_ms"))
    return g.select("episode", "start_ms", "end_ms", "n")


def assemble_words(tokens: DataFrame, duration_ms: int) -> DataFrame:
    """Words from subword tokens(episode, i, text, start_ms, end_ms): a token that opens with white space opens a word."""
    w = Window.partitionBy("episode").orderBy("i")
    new = (F.col("text").rlike(r"^\s") | (F.row_number().over(w) == 1)).cast("int")
    t = tokens.where(F.col("start_ms") < duration_ms).withColumn("word", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = t.groupBy("episode", "word").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("p"), F.min("start_ms").alias("start_ms"), F.least(F.max("end_ms"), F.lit(duration_ms)).alias("end_ms"))
    text = F.trim(F.array_join(F.transform("p", lambda x: x["text"]), ""))
    return g.select("episode", "word", text.alias("text"), "start_ms", "end_ms").where("end_ms > start_ms AND text <> ''")


def replace_partition(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions of `by` that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def publish_generation(points: DataFrame, root: str, pointer: str, generation: str, expected: int) -> DataFrame:
    """Write a generation, verify its count, then append the pointer's new row; gives the pointers in force."""
    spark, path = points.sparkSession, f"{root}/generations/{safe_relative(generation)}"
    points.write.mode("overwrite").parquet(path)
    found = spark.read.parquet(path).count()
    if found != expected:
        raise ValueError(f"{found} points were written, {expected} were expected")
    at = F.current_timestamp()
    row = spark.range(1).select(F.lit(pointer).alias("pointer"), F.lit(generation).alias("generation"), at.alias("at"))
    row.write.mode("append").parquet(f"{root}/pointers")
    return current_pointers(spark, root)


def current_pointers(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/pointers").groupBy("pointer").agg(F.max_by("generation", F.struct("at", "generation")).alias("generation"))


def export_lines(words: DataFrame, form: str) -> DataFrame:
    """(episode, n, line) of words(episode, word_id, speaker, overlap, text, start_ms, end_ms) as txt, srt or vtt cues."""
    text = caption(F.col("speaker"), F.col("overlap"), F.col("text"))
    n = F.row_number().over(Window.partitionBy("episode").orderBy("start_ms", "end_ms", "word_id"))
    sep = "," if form == "srt" else "."
    times = F.concat(timestamp("start_ms", sep), F.lit(" --> "), timestamp("end_ms", sep))
    line = {"txt": text, "srt": F.concat_ws("\n", n.cast("string"), times, text, F.lit("")), "vtt": F.concat_ws("\n", times, text, F.lit(""))}[form]
    return words.select("episode", n.cast("long").alias("n"), line.alias("line"))


def export_rttm(turns: DataFrame) -> DataFrame:
    """(episode, n, line) of turns, sorted by time."""
    n = F.row_number().over(Window.partitionBy("episode").orderBy("start_ms", "end_ms", "speaker")).cast("long")
    line = F.concat_ws(" ", F.lit("SPEAKER"), F.col("episode").cast("string"), F.lit("1"), rttm_seconds("start_ms"), rttm_seconds(F.col("end_ms") - F.col("start_ms")), F.lit("<NA> <NA>"), F.col("speaker").cast("string"), F.lit("<NA> <NA>"))
    return turns.select("episode", n.alias("n"), line.alias("line"))


def write_export(lines: DataFrame, path: str) -> None:
    """A text file for each episode; an episode's lines are one document."""
    docs = lines.groupBy("episode").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("value"))
    docs.write.mode("overwrite").partitionBy("episode").text(path)


def artifact_faults(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(artifact_id, name, fault): what the files(artifact_id, name, sha256) of artifacts lack of their manifests(artifact_id,
    file_checksums map): missing, corrupt, or unlisted (the manifest itself is never listed)."""
    want = manifests.select("artifact_id", F.explode("file_checksums").alias("name", "expected"))
    rows = want.join(files.where("name <> 'manifest.json'").select("artifact_id", "name", "sha256"), ["artifact_id", "name"], "full")
    fault = F.when(F.col("expected").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("expected"), "corrupt")
    return rows.select("artifact_id", "name", fault.alias("fault")).where("fault IS NOT NULL")


def _beyond(rows: DataFrame, kind: str) -> DataFrame:
    fault = F.when(~F.coalesce((F.col("x.start_ms") >= 0) & (F.col("x.end_ms") > F.col("x.start_ms")), F.lit(False)), "empty interval").when(F.col("x.end_ms") > F.col("duration_ms"), "beyond the duration")
    return rows.select("source_sha256", F.lit(kind).alias("kind"), fault.alias("fault")).where("fault IS NOT NULL")


def evaluation_faults(docs: DataFrame) -> DataFrame:
    """(source_sha256, kind, fault) of evaluation documents in rows of EVALUATION: intervals that are empty or beyond the
    duration, repeated word ids, overlaps of fewer than two speakers, a time origin other than zero."""
    part = lambda c: docs.select("source_sha256", "duration_ms", F.explode(c).alias("x"))
    found = None
    for c in ("words", "turns", "exclusive_turns", "overlap_intervals"):
        rows = _beyond(part(c), c)
        found = rows if found is None else found.unionByName(rows)
    again = part("words").groupBy("source_sha256", F.col("x.word_id").alias("w")).count().where("count > 1").select("source_sha256", F.lit("words").alias("kind"), F.lit("repeated id").alias("fault"))
    few = part("overlap_intervals").where(F.coalesce(F.size(F.array_distinct("x.speaker_ids")), F.lit(0)) < 2).select("source_sha256", F.lit("overlap_intervals").alias("kind"), F.lit("fewer than two speakers").alias("fault"))
    origin = docs.where(F.coalesce("time_origin_ms", F.lit(0)) != 0).select("source_sha256", F.lit("document").alias("kind"), F.lit("time origin").alias("fault"))
    return found.unionByName(again).unionByName(few).unionByName(origin)


def read_diarization(spark: SparkSession, path: str) -> DataFrame:
    """One row for each diarization document: source_sha256, duration_ms, turns, overlaps, has_turns, has_overlaps.

    Turns are under standard_turns or turns, overlaps under overlap_intervals or overlaps; a missing stream stays null and is
    told from an empty one. Without a duration it is the greatest end; a document without either raises.
    """
    turn = f"array<struct<{INTERVAL}>>"
    both = "array<struct<speaker_ids:array<string>,start_ms:bigint,end_ms:bigint>>"
    schema = f"source_sha256 string, duration_ms bigint, standard_turns {turn}, turns {turn}, overlap_intervals {both}, overlaps {both}"
    docs = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    rows = docs.select("source_sha256", "duration_ms", F.coalesce("standard_turns", "turns").alias("turns"), F.coalesce("overlap_intervals", "overlaps").alias("overlaps"))
    last = lambda c: F.array_max(F.transform(c, lambda x: x["end_ms"]))
    duration = F.coalesce("duration_ms", F.greatest(last("turns"), last("overlaps")))
    duration = F.when(duration > 0, duration).otherwise(F.raise_error(F.lit("a duration is needed where there are no intervals")).cast("long"))
    return rows.withColumn("duration_ms", duration).withColumn("has_turns", F.col("turns").isNotNull()).withColumn("has_overlaps", F.col("overlaps").isNotNull())


def read_embeddings(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    """(request_id, item_id, vector) of embedding responses; ids and vectors that don't match, or another length, raise."""
    docs = spark.read.schema("request_id string, item_ids array<string>, vectors array<array<double>>").json(path, multiLine=True, mode="FAILFAST")
    ok = (F.size("item_ids") == F.size("vectors")) & (F.size(F.array_distinct("item_ids")) == F.size("item_ids")) & F.forall("vectors", lambda v: (F.size(v) == dimensions) & F.forall(v, lambda x: ~F.isnan(x)))
    docs = docs.withColumn("request_id", F.when(F.coalesce(ok, F.lit(False)), F.col("request_id")).otherwise(F.raise_error(F.concat(F.lit("ids and vectors don't match: "), F.coalesce("request_id", F.lit("?"))))))
    return docs.select("request_id", F.explode(F.arrays_zip("item_ids", "vectors")).alias("x")).select("request_id", F.col("x.item_ids").alias("item_id"), F.col("x.vectors").alias("vector"))


def model_lock_faults(locks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(name, fault) of locks(name, repository, revision, files map of name to SHA-256): repeated names, an empty repository,
    a revision that is no commit, no files, hashes that aren't SHA-256; with files(name, file, sha256) missing or changed ones."""
    empty = F.create_map().cast("map<string,string>")
    checks = [
        (F.coalesce(F.trim("repository"), F.lit("")) == "", "repository"), (~F.coalesce(F.col("revision").rlike("^[0-9a-f]{40}$"), F.lit(False)), "revision"),
        (F.size(F.coalesce("files", empty)) == 0, "no files"), (F.exists(F.map_values(F.coalesce("files", empty)), lambda h: ~h.rlike("^[0-9a-f]{64}$")), "checksum"),
    ]
    found = locks.select("name", F.explode(F.array_compact(F.array(*[F.when(c, n) for c, n in checks]))).alias("fault"))
    found = found.unionByName(locks.groupBy("name").count().where("count > 1").select("name", F.lit("repeated name").alias("fault")))
    if files is not None:
        want = locks.select("name", F.explode("files").alias("file", "expected")).join(files, ["name", "file"], "left")
        fault = F.when(F.col("sha256").isNull(), F.concat(F.lit("missing "), "file")).when(F.col("sha256") != F.col("expected"), F.concat(F.lit("changed "), "file"))
        found = found.unionByName(want.select("name", fault.alias("fault")).where("fault IS NOT NULL"))
    return found


def reference_faults(refs: DataFrame, golden: DataFrame, least: int = 200, parts: int = 5) -> DataFrame:
    """(episode_id, fault) of reviewed references(episode_id, source_sha256, duration_ms, status, actor_type, reviewer,
    reviewed_at, words, reviewed_word_ids, manual_timing_word_ids) against golden(episode_id, sha256, duration_ms)."""
    g = golden.select("episode_id", F.col("sha256").alias("_sha"), F.col("duration_ms").alias("_duration"))
    rows = refs.join(g, "episode_id", "left")
    ids = F.transform("words", lambda w: w["word_id"])
    timed = F.array_distinct("manual_timing_word_ids")
    own = lambda w: F.array_contains("manual_timing_word_ids", w["word_id"])
    block = lambda i: F.exists("words", lambda w: own(w) & (F.floor((w["start_ms"] + w["end_ms"]) / 2) >= F.floor(F.col("duration_ms") * i / parts)) & (F.floor((w["start_ms"] + w["end_ms"]) / 2) < F.floor(F.col("duration_ms") * (i + 1) / parts)))
    covered = block(0)
    for i in range(1, parts):
        covered = covered & block(i)
    holds = {
        "not a golden episode": F.col("_sha").isNotNull(), "source differs": F.col("source_sha256").eqNullSafe(F.col("_sha")), "duration differs": F.col("duration_ms").eqNullSafe(F.col("_duration")),
        "not human-reviewed": (F.col("status") == "reviewed") & (F.col("actor_type") == "human"), "reviewer": (F.col("reviewer") != "") & (F.col("reviewer") != "machine"), "reviewed_at": F.col("reviewed_at").isNotNull(),
        "words not reviewed": F.size(F.array_except(ids, "reviewed_word_ids")) + F.size(F.array_except("reviewed_word_ids", ids)) == 0, "too few timed words": F.size(timed) >= least,
        "unknown timed word": F.size(F.array_except(timed, ids)) == 0, "a block without timed words": covered,
    }
    faults = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in holds.items()]))
    return rows.select("episode_id", F.explode(faults).alias("fault"))


def write_report(details: DataFrame, aggregate: DataFrame, path: str, private: Sequence[str]) -> None:
    """Write details as JSON lines, and aggregate without the private columns as one JSON file; a private column left in the
    aggregate raises."""
    left = sorted(set(private) & set(aggregate.columns))
    if left:
        raise ValueError(f"private columns in the aggregate: {left}")
    details.write.mode("overwrite").json(f"{path}/details")
    aggregate.coalesce(1).write.mode("overwrite").json(f"{path}/aggregate")  # one row a group of a report
