"""JSON payloads as Variant: leaves by path, and merge patches folded by path instead of document by document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Separates the names of a path; a control character, which no unescaped JSON name holds.
STEP = "\x1f"


def schema_of(rows: DataFrame, payload: str = "payload") -> str:
    """The schema that all JSON payloads share, as Spark words it; malformed ones say nothing."""
    return rows.agg(F.schema_of_variant_agg(F.try_parse_json(payload)).alias("s")).first()["s"]


def leaves(rows: DataFrame, payload: str = "payload", depth: int = 6) -> DataFrame:
    """rows without payload, with path and value: one row for each scalar, array or null of the JSON object payload.

    path holds the names from the top, joined by STEP; value is JSON text, 'null' for a JSON null. Malformed or null
    payloads, those that aren't objects, and empty objects have no leaves. Objects below depth levels raise.
    """
    rest = [c for c in rows.columns if c != payload]
    tvf, is_object = rows.sparkSession.tvf, lambda: F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    level = rows.select(*rest, F.lit(None).cast("string").alias("path"), F.try_parse_json(payload).alias("_v"))
    level = level.withColumn("_o", is_object()).where("_o")
    for _ in range(depth):  # leaves pass through, objects give their members
        names = level.withColumn("_in", F.when(F.col("_o"), F.col("_v"))).lateralJoin(tvf.variant_explode_outer(F.col("_in").outer()))
        names = names.where("NOT _o OR key IS NOT NULL")
        path, value = F.when(F.col("_o"), F.concat_ws(STEP, "path", "key")).otherwise(F.col("path")), F.when(F.col("_o"), F.col("value")).otherwise(F.col("_v"))
        level = names.select(*rest, path.alias("path"), value.alias("_v")).withColumn("_o", is_object())
    deep = F.when(F.col("_o"), F.raise_error(F.lit(f"an object lies deeper than {depth} levels")).cast("string"))
    return level.select(*rest, "path", deep.otherwise(F.coalesce(F.to_json("_v"), F.lit("null"))).alias("value"))


def merge_patches(rows: DataFrame, key: Sequence[str], order: Sequence[str], payload: str = "payload", depth: int = 6) -> DataFrame:
    """(key, path, value): the leaves of each key's object after its payloads are applied, in order, as JSON merge patches.

    A null removes what lies at its path; a scalar or array replaces it; objects merge. order names what is unique within a
    key. A leaf holds if no later leaf was set at its path, above it or below it, so leaves are aggregated by path and no
    task folds the whole log of a key. Empty objects say nothing. Rows with null order come first.
    """
    at = F.struct(*order)
    last = leaves(rows.select(*key, *order, payload), payload, depth).groupBy(*key, "path").agg(F.max(at).alias("at"), F.max_by("value", at).alias("value"))
    steps = F.split("path", STEP)
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda i: F.array_join(F.slice(steps, 1, i), STEP))
    above = F.when(F.size(steps) > 1, above).otherwise(F.array().cast("array<string>"))
    ends = last.select(*key, "path", "at", "value", F.explode_outer(above).alias("upper"))
    below = ends.where("upper IS NOT NULL").groupBy(*key, F.col("upper").alias("path")).agg(F.max("at").alias("below"))
    same = lambda a, b, p: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key] + [F.col(f"{a}.{p}") == F.col(f"{b}.path")]
    keys = [F.col(f"l.{k}") for k in key]
    kept = last.alias("l").join(below.alias("b"), same("l", "b", "path"), "left").where("b.below IS NULL OR NOT b.below > l.at")
    hidden = ends.alias("l").join(last.alias("u"), same("l", "u", "upper")).where("u.at > l.at").select(*keys, F.col("l.path")).distinct()
    kept = kept.select(*keys, "l.path", "l.value").alias("l").join(hidden.alias("h"), same("l", "h", "path"), "left_anti")
    return kept.where("value <> 'null'").select(*key, "path", "value")
