"""Scalar functions: normalization, tokens, timestamps, captions and ids."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normalize_exact(text: str | None) -> str | None:
    """NFC, casefold, punctuation to spaces, white space to one space."""
    if text is None:
        return None
    folded = unicodedata.normalize("NFC", text).casefold()
    return " ".join("".join(" " if unicodedata.category(c)[0] == "P" else c for c in folded).split())


@F.pandas_udf(StringType())
def normalize_udf(texts: pd.Series) -> pd.Series:
    """normalize_exact over Arrow batches: Spark has neither NFC nor casefold."""
    return texts.map(normalize_exact)


def normalize(text: Column | str) -> Column:
    """The same within the JVM, for texts that are NFC and whose lower case is their casefold."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{P}", " "), r"\s+", " "))


def tokens(text: Column | str) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def timestamp(ms: Column | str, sep: str = ",") -> Column:
    """HH:MM:SS and milliseconds."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    part = lambda n, size, width: F.lpad((F.floor(ms / n) % size).cast("string"), width, "0")
    hours = F.floor(ms / 3_600_000).cast("string")
    return F.concat(F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit(sep), part(1, 1000, 3))


def rttm_seconds(ms: Column | str) -> Column:
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def seconds_to_ms(seconds: Column | str) -> Column:
    """Decimal seconds to milliseconds, halves away from zero."""
    return F.round(F.col(seconds).cast("decimal(24,6)") * 1000 if isinstance(seconds, str) else seconds.cast("decimal(24,6)") * 1000).cast("long")


def caption(speaker: Column, overlap: Column, text: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(speaker, F.lit("UNASSIGNED")), F.lit("] "), F.when(overlap, F.lit("[OVERLAP] ")).otherwise(""), text)


def canonical_json(value) -> str:
    """Sorted keys, no spaces, UTF-8."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def fingerprint(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def row_id(*parts: Column | str) -> Column:
    """A deterministic id of a row's parts."""
    return F.substring(F.sha2(F.to_json(F.array(*[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])), 256), 1, 24)


def valid_iso_date(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.date_format(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), "yyyy-MM-dd") == text, F.lit(False))


def six_digits(ms: Column) -> Column:
    """Milliseconds as seconds with six significant digits, as C's %g writes a double of them: no zeros at the end, halves
    by what the double is exactly, and an exponent from a million seconds on. Negative times raise."""
    ms = F.when(ms >= 0, ms.cast("long")).when(ms < 0, F.raise_error(F.lit("a time is negative")).cast("long"))
    drop = F.when(ms < 1_000_000, 0).otherwise(F.length(ms.cast("string")) - 6)  # digits that are rounded away
    unit = F.pow(F.lit(10.0), drop).cast("long")
    whole, rest = F.floor(ms / unit), F.pmod(ms, unit)
    # twice a double's exact value in units of 2^-43 (2^-33 from a million seconds on) is a whole number
    shift = F.when(ms < 1_000_000_000, F.lit(1 << 43)).otherwise(F.lit(1 << 33))
    exact = ((ms / F.lit(1000.0)) * shift).cast("long").cast("decimal(19,0)") * F.lit(1000).cast("decimal(4,0)")
    asked = ms.cast("decimal(13,0)") * shift.cast("decimal(14,0)")
    half = 2 * rest == unit
    up = (2 * rest > unit) | (half & ((exact > asked) | ((exact == asked) & (F.pmod(whole, F.lit(2)) == 1))))
    n = whole + up.cast("long")
    trim = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = trim(((n * unit).cast("decimal(24,3)") / 1000).cast("string"))
    power = F.length((n * unit).cast("string")) - 4
    mantissa = trim((n.cast("decimal(24,6)") / F.pow(F.lit(10), F.length(n.cast("string")) - 1).cast("decimal(24,0)")).cast("string"))
    return F.when(n * unit < 1_000_000_000, plain).otherwise(F.concat(mantissa, F.lit("e+"), F.lpad(power.cast("string"), 2, "0")))


def listen_url(base: str, episode: Column, start_ms: Column) -> Column:
    """Where to listen: the episode percent-encoded but for letters, digits and _ . - ~, and the second, by six_digits()."""
    name = F.url_encode(episode)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        name = F.replace(name, F.lit(a), F.lit(b))
    return F.concat(F.lit(base.rstrip("/") + "/episodes/"), name, F.lit("?t="), six_digits(start_ms))


def stage_fingerprint(stage: Column, source: Column, upstream: Column, model: Column, configuration: Column, version: Column) -> Column:
    """The key of a stage's run: SHA-256 of canonical JSON. configuration is canonical JSON already, upstream an array in order.

    A stage or version without text, and hashes that aren't SHA-256, raise.
    """
    text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    sha = lambda c: c.rlike("^[0-9a-f]{64}$")
    ok = (F.length(stage) > 0) & (F.length(version) > 0) & sha(source) & F.coalesce(sha(model), F.lit(True)) & F.forall(F.coalesce(upstream, F.array().cast("array<string>")), sha)
    parts = F.concat(
        F.lit('{"configuration":'), F.coalesce(configuration, F.lit("{}")), F.lit(',"model_fingerprint_sha256":'), F.when(model.isNull(), "null").otherwise(text(model)),
        F.lit(',"pipeline_version":'), text(version), F.lit(',"source_sha256":'), text(source), F.lit(',"stage":'), text(stage), F.lit(',"upstream_artifact_hashes":'), F.to_json(F.coalesce(upstream, F.array().cast("array<string>"))), F.lit("}"),
    )
    return F.when(F.coalesce(ok, F.lit(False)), F.sha2(parts, 256)).otherwise(F.raise_error(F.lit("a stage's key needs a stage, a version and SHA-256 hashes")))


_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def point_id(name: Column) -> Column:
    """The UUID of version 5 of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(_URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def instant(text: Column, seconds: Column | None = None) -> Column:
    """An ISO instant in UTC to the microsecond, seconds later; a text without an offset is in UTC."""
    t = F.to_timestamp(text) if seconds is None else F.timestamp_add("SECOND", seconds, F.to_timestamp(text))
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def difficulty(review: Column, degraded: Column, music: Column, rapid: Column, overlaps: Column, categories: Column, conflict: Column, end_reason: Column) -> Column:
    """The strongest evidence that an interval is hard, other than from recognition itself."""
    holds = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(review.isin("bad", "awkward"), F.concat(F.lit("human_boundary_"), review)).when(holds(degraded), "chunk_condition_degraded").when(holds(music), "chunk_condition_music")
        .when(holds(rapid), "chunk_condition_rapid_turn").when(holds(overlaps), "chunk_condition_overlap").when(holds(F.array_contains(categories, "music_containing")), "review_queue_music")
        .when(holds(F.array_contains(categories, "overlap_containing")), "review_queue_overlap").when(holds(conflict), "boundary_overlap_conflict").when(end_reason == "hard_maximum", "hard_maximum").otherwise("no_difficulty_tag")
    )


def masked_tokens(text: Column, mask: Column) -> Column:
    """The white-space tokens of text without those at the indices in mask; an index beyond them raises."""
    found = tokens(text)
    beyond = F.coalesce(F.array_max(mask) >= F.size(found), F.lit(False))
    kept = F.filter(F.transform(found, lambda t, i: F.when(~F.array_contains(F.coalesce(mask, F.array().cast("array<int>")), i), t)), lambda t: t.isNotNull())
    return F.when(beyond, F.raise_error(F.lit("a mask lies beyond the tokens")).cast("array<string>")).otherwise(kept)
