"""Artifacts published in two phases, and told apart by their manifests: complete, incomplete, corrupt."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.sources.paths import safe_relative

#: The manifest's name, the folder of unfinished work below a root, and bytes that are hashed at once.
MANIFEST, STAGING, CHUNK = "manifest.json", ".staging", 1 << 23


def _files(spark: SparkSession, path: str):
    """The file system and path as the JVM knows them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = []
        for name in b.column("path").to_pylist():
            system, path = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
            digest = hashlib.sha256()
            with system.open_input_stream(path) as f:
                while part := f.read(CHUNK):
                    digest.update(part)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=["path", "name", "size_bytes", "sha256"])


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, size_bytes) of the files below path; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"))


def scan_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, size_bytes, sha256) of the files below path, read as streams on the executors: a file may have any size."""
    return list_files(spark, path, glob).mapInArrow(_hash, "path string, name string, size_bytes long, sha256 string")


def publish_artifact(df: DataFrame, root: str, key: str) -> str:
    """Write df as Parquet to root/key/data once, whole or not at all; gives that path.

    The rows and, last, a manifest with each file's size and digest are written to a folder of this attempt below
    root/.staging, which then takes its place by one rename. An artifact that has a manifest is used again. A publisher that
    loses a race uses the winner's. What stands at root/key without a manifest is debris, and is moved to the staging folder.
    """
    spark, path = df.sparkSession, f"{root.rstrip('/')}/{safe_relative(key)}"
    files, target = _files(spark, path)
    jvm = spark.sparkContext._jvm
    manifest = jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    if files.exists(manifest):
        return f"{path}/data"
    attempt = f"{root.rstrip('/')}/{STAGING}/{uuid.uuid4().hex}"
    df.write.parquet(f"{attempt}/data")
    rows = scan_binary(spark, f"{attempt}/data", "part-*").select("name", "size_bytes", "sha256").toLocalIterator()  # a row a file
    listed = {r.name: {"size_bytes": r.size_bytes, "sha256": r.sha256} for r in rows}
    out = files.create(jvm.org.apache.hadoop.fs.Path(f"{attempt}/{MANIFEST}"), False)
    try:
        out.write(bytearray(json.dumps({"artifact_id": key, "files": listed}, sort_keys=True).encode()))
        out.hsync()
    finally:
        out.close()
    files.mkdirs(target.getParent())
    if files.exists(target) and not files.exists(manifest):
        _rename(spark, path, f"{attempt}-debris")
    try:
        _rename(spark, attempt, path)
    except Py4JJavaError:
        if not files.exists(manifest):
            raise
    return f"{path}/data"


def _rename(spark: SparkSession, old: str, new: str) -> None:
    """Rename a folder; one that already stands there is an error, not a parent."""
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    files, source = _files(spark, old)
    context = hadoop.FileContext.getFileContext(files.getUri(), sc._jsc.hadoopConfiguration())
    context.rename(source, hadoop.Path(new), sc._gateway.new_array(hadoop.Options.Rename, 0))


def artifact_states(spark: SparkSession, root: str, verify: bool = False) -> DataFrame:
    """(artifact_id, state, files, size_bytes) of the artifacts below root, in folders that hold data or a manifest.

    incomplete: no manifest; corrupt: a file of the manifest is missing, is of another size or, if verify, another digest,
    or a file isn't in it; complete: the rest. The staging folder holds no artifacts. Digests are read only if verify.
    """
    below = len(_files(spark, root)[1].toUri().getPath().rstrip("/")) + 2
    at = F.expr(f"substring(regexp_replace(path, '^[A-Za-z0-9]+:(//[^/]*)?', ''), {below})")
    here = lambda d: d.withColumn("_at", at).where(~F.col("_at").startswith(STAGING + "/"))
    data = here(scan_binary(spark, root, "part-*") if verify else list_files(spark, root, "part-*").withColumn("sha256", F.lit(None).cast("string")))
    data = data.where(F.col("_at").contains("/data/")).select(F.regexp_extract("_at", r"^(.*)/data/[^/]+$", 1).alias("artifact_id"), "name", "size_bytes", "sha256")
    body = spark.read.format("binaryFile").option("pathGlobFilter", MANIFEST).option("recursiveFileLookup", "true").load(root)
    body = here(body.select("path", F.col("content").cast("string").alias("text"))).select(F.regexp_extract("_at", r"^(.*)/[^/]+$", 1).alias("artifact_id"), "text")
    parsed = F.from_json("text", "files map<string, struct<size_bytes: bigint, sha256: string>>")["files"]
    held = body.select("artifact_id", parsed.alias("files"))
    want = held.select("artifact_id", F.explode_outer("files").alias("name", "expected")).where("name IS NOT NULL")
    differs = F.col("expected").isNull() | F.col("size_bytes").isNull() | (F.col("size_bytes") != F.col("expected.size_bytes"))
    if verify:
        differs = differs | (F.col("sha256") != F.col("expected.sha256"))
    counted = data.join(want, ["artifact_id", "name"], "full").groupBy("artifact_id").agg(
        F.count("size_bytes").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"), F.max(differs).alias("_differs")
    )
    joined = counted.join(held.select("artifact_id", F.lit(True).alias("_manifest"), F.col("files").isNull().alias("_broken")), "artifact_id", "full")
    state = F.when(F.col("_manifest").isNull(), "incomplete").when(F.coalesce("_differs", F.lit(False)) | F.col("_broken"), "corrupt").otherwise("complete")
    return joined.select("artifact_id", state.alias("state"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"))


def unregistered(spark: SparkSession, root: str, registered: DataFrame) -> DataFrame:
    """Complete artifacts below root that no row of registered(artifact_id) names."""
    return artifact_states(spark, root).where("state = 'complete'").join(registered.select("artifact_id"), "artifact_id", "left_anti")
