"""Phrase collocations, mined by SON partitioning.

Texts stay where they are read: each task cuts what it reads into shards of one language, and mines each shard completely
at its share of the support. A phrase that reaches the support over all texts reaches that share in at least one shard,
so the union of what shards find misses none. Shards that didn't find a phrase have fewer of it than their share, which
bounds how many there can be of it in all: what can't reach the support goes. The candidates are put into a filter of
fixed size, and a second pass over all texts counts everything that passes it; what passes by chance falls short of the
support and goes. Counts are summed, scored, thinned and ranked by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import bounded, materialize, read, release, small

#: Words of a shard: SHARD at least, unless its task holds fewer of its language, and under twice as many. A task holds half
#: as many again, and a batch, before it makes one. BITS (a power of two) of the filter.
SHARD, BITS = 1 << 23, 1 << 27
#: Shards that a task makes, about, so that a rarer language, too, has some that aren't short.
DEPTH = 4
#: Places in a shard that are sorted at a time.
PART = 1 << 20
PROBES, MIX = 4, np.uint64(0x9E3779B97F4A7C15)
FOUND = "lang string, words int, phrase string, n long"

#: Of each byte: 0 in a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[list(b"\x20\x09")] = 1
KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts in order, and for each whether it begins a piece."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    letters = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    kind = KIND[letters]
    word = kind == 0
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    heads = ends[:-1][ends[:-1] < len(word)]
    begins[heads] = word[heads]
    at = np.flatnonzero(begins)
    if not len(at):
        return pa.array([], pa.string()).dictionary_encode(), np.zeros(0, bool)
    piece = np.cumsum(kind == 2)[at] + np.searchsorted(ends, at, "right") * (len(word) + 1)
    lengths = np.add.reduceat(word.astype(np.int32), at)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters[word]))
    return words.cast(pa.string()).dictionary_encode(), np.concatenate(([True], piece[1:] != piece[:-1]))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def _word_hashes(words: pa.Array) -> np.ndarray:
    parts = (words.slice(i, 1 << 16).to_pylist() for i in range(0, len(words), 1 << 16))
    return np.fromiter((xxhash.xxh64_intdigest(w) for part in parts for w in part), np.uint64, len(words))


def _first_hash(lang: str, words: np.ndarray) -> np.ndarray:
    return _mixed(words ^ np.uint64(xxhash.xxh64_intdigest(lang, 1)))


def _next_hash(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return _mixed(before * MIX + words)


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((h + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64)


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of codes in which equal ones are neighbours, where each run begins in it, and how long it is."""
    order = np.argsort(codes)
    codes = codes[order]
    begin = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return order, begin, np.diff(np.append(begin, len(codes)))


def _shares(ids: np.ndarray, first: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """For each place the part that counts the phrase of n words there, -1 where there is none to count; and the parts."""
    share = np.full(len(at), -1, np.int16)
    ends = range(PART, len(at) + PART, PART)
    fits = lambda i, j: (at[i:j] >= 0) & (at[i + 1 : j + 1] >= 0) & ~first[i + 1 : j + 1]
    spans = [(j - PART, min(j, len(at) - n + 1)) for j in ends if j - PART < len(at) - n + 1]
    parts = -(-sum(int(np.count_nonzero(fits(i, j))) for i, j in spans) // PART)
    for i, j in spans if parts else ():
        dealt = (at[i:j].astype(np.int64) + ids[i + n - 1 : j + n - 1].astype(np.int64) * 7) % parts
        share[i:j] = np.where(fits(i, j), dealt, -1)
    return share, parts


def grow(ids: np.ndarray, first: np.ndarray, vocabulary: pa.Array, lang: str, keep: Callable, most: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(words, phrases, counts), shorter phrases first: all that keep(hashes, counts) takes. A phrase is looked at only if
    both that it leaves without its first and without its last word were taken.

    A phrase taken is known by one of its places, from which its words and hash are read when they are needed: besides
    ids and first, six bytes for each place are held, and what sorting PART places takes, however many phrases there are.
    """
    size, hashes = len(vocabulary), _word_hashes(vocabulary)
    counts = sum(np.bincount(ids[i : i + PART], minlength=size) for i in range(0, len(ids), PART))
    taken = keep(_first_hash(lang, hashes), counts)
    kept = np.flatnonzero(taken)
    yield 1, vocabulary.take(pa.array(kept)), counts[kept]
    at = np.where(taken, np.arange(size, dtype=np.int32), np.int32(-1))[ids]
    for n in range(2, most + 1):
        share, parts = _shares(ids, first, at, n)
        if not parts:
            return
        for i in range(0, len(at), PART):
            at[i : i + PART][share[i : i + PART] < 0] = -1

        def codes(own: np.ndarray, n: int = n) -> np.ndarray:
            return at[own].astype(np.int64) * size + ids[own + (n - 1)]

        def taken_of(place: np.ndarray, counts: np.ndarray, n: int = n) -> np.ndarray:
            h = _first_hash(lang, hashes[ids[place]])
            for k in range(1, n):
                h = _next_hash(h, hashes[ids[place + k]])
            return keep(h, counts)

        for p in range(parts):  # equal phrases are in one part
            own = np.concatenate([(np.flatnonzero(share[i : i + PART] == p) + i).astype(np.int32) for i in range(0, len(at), PART)])
            if not len(own):
                continue
            if len(own) <= 2 * PART:
                order, begin, counts = _runs(codes(own))
                own = own[order]
                place = own[begin]
                kept = taken_of(place, counts)
                at[own] = np.repeat(np.where(kept, place, np.int32(-1)), counts)
            else:  # a frequent phrase fills it: what each stretch counted is added up
                found = []
                for i in range(0, len(own), PART):
                    order, begin, counts = _runs(codes(own[i : i + PART]))
                    found.append((own[i : i + PART][order[begin]], counts))
                place, counts = (np.concatenate(x) for x in zip(*found, strict=True))
                order, begin, _ = _runs(codes(place))
                place, counts = place[order[begin]], np.add.reduceat(counts[order], begin)
                kept, known = taken_of(place, counts), codes(place)
                names = np.where(kept, place, np.int32(-1))
                for i in range(0, len(own), PART):
                    part = own[i : i + PART]
                    at[part] = names[np.searchsorted(known, codes(part))]
            place, counts = place[kept], counts[kept]
            for i in range(0, len(place), 1 << 16):
                said = [vocabulary.take(pa.array(ids[place[i : i + (1 << 16)] + k])) for k in range(n)]
                yield n, pc.binary_join_element_wise(*said, " "), counts[i : i + (1 << 16)]


def _shards(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, pa.Array]]:
    """(lang, words of all texts in it, ids, first, vocabulary) of each shard of rows (text, lang, total)."""
    held: dict[str, list] = {}
    totals: dict[str, int] = {}

    def whole(lang: str, parts: list) -> tuple:
        known = pa.chunked_array([w.dictionary for w, _ in parts]).dictionary_encode()
        first = np.concatenate([f for _, f in parts])
        ids, end = np.empty(len(first), np.int32), len(first)
        for known_part in reversed(known.chunks):  # a part is let go once its words are renamed
            own = parts.pop()[0].indices.to_numpy()
            ids[end - len(own) : end] = known_part.indices.to_numpy()[own]
            end -= len(own)
        vocabulary = known.chunk(0).dictionary
        del known, known_part, own
        release()
        return lang, totals[lang], ids, first, vocabulary

    for b in batches:
        langs = b.column(1)
        for lang in pc.unique(langs).to_pylist():
            rows = b.filter(pc.equal(langs, lang))
            part = split_words(rows.column(0))
            if not len(part[1]):
                continue
            totals[lang] = rows.column(2)[0].as_py()
            held.setdefault(lang, []).append(part)
        while sum(len(f) for parts in held.values() for _, f in parts) >= 3 * shard // 2:
            lang = max(held, key=lambda k: sum(len(f) for _, f in held[k]))
            sizes = np.cumsum([len(f) for _, f in held[lang]])
            cut = min(int(np.searchsorted(sizes, shard)) + 1, len(sizes))
            parts, held[lang] = held[lang][:cut], held[lang][cut:]
            if not held[lang]:
                del held[lang]
            yield whole(lang, parts)
    for lang in list(held):
        yield whole(lang, held.pop(lang))


def _rows(lang: str, levels: Iterator[tuple[int, pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for n, names, counts in levels:
        for i in range(0, len(names), 1 << 16):
            part = names.slice(i, 1 << 16)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part), pa.string()), pa.array(np.full(len(part), n, np.int32)), part.cast(pa.string()), pa.array(counts[i : i + len(part)].astype(np.int64))],
                names=["lang", "words", "phrase", "n"],
            )


def _mine(support: int, most: int, shard: int):
    """What each shard finds, with the count beyond the most that a shard has without finding it; and that most, as a row of
    no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, total, ids, first, vocabulary in _shards(batches, shard):
            unseen = max(1, -(-support * len(ids) // total)) - 1
            yield from _rows(lang, [(0, pa.array([""]), np.array([unseen]))])
            found = grow(ids, first, vocabulary, lang, lambda _, counts, less=unseen: counts > less, most)
            yield from _rows(lang, ((n, names, counts - unseen) for n, names, counts in found))
            del ids, first, vocabulary

    return run


def _count(bitmap, bits: int, most: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bitmap.value

        def known(hashes: np.ndarray, _: np.ndarray) -> np.ndarray:
            hit = np.ones(len(hashes), bool)
            for p in _probes(hashes, bits):
                hit &= (words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) > 0
            return hit

        for lang, _, ids, first, vocabulary in _shards(batches, shard):
            yield from _rows(lang, grow(ids, first, vocabulary, lang, known, most))
            del ids, first, vocabulary

    return run


def _slots(bits: int):
    """(slot, mask): the words of the filter that the phrases of a task (lang, words, phrase) set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = pc.split_pattern(b.column(2), " ")
            flat = lists.flatten().dictionary_encode()
            hashes = _word_hashes(flat.dictionary)[flat.indices.to_numpy()]
            starts = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
            length = np.asarray(b.column(1))
            langs = b.column(0).dictionary_encode()
            level = np.zeros(b.num_rows, np.uint64)
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                own = np.flatnonzero(langs.indices.to_numpy() == i)
                level[own] = _first_hash(lang, hashes[starts[own]])
            for k in range(1, int(length.max(initial=0))):
                longer = np.flatnonzero(length > k)
                level[longer] = _next_hash(level[longer], hashes[starts[longer] + k])
            at = np.unique(np.concatenate(list(_probes(level, bits))))
            slot, mask = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
            begin = np.concatenate(([0], np.flatnonzero(np.diff(slot)) + 1)) if len(slot) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot[begin]), pa.array((np.bitwise_or.reduceat(mask, begin) if len(begin) else mask).view(np.int64))], names=["slot", "mask"])

    return run


def _filter(candidates: DataFrame, bits: int) -> np.ndarray:
    """The filter as an array of bits / 64 words, which bounds what comes to the driver."""
    slots = candidates.select("lang", "words", "phrase").mapInArrow(bounded(_slots(bits)), "slot long, mask long")
    rows = slots.groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits >> 6, np.uint64)
    words[rows["slot"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return words


def phrase_counts(docs: DataFrame, support: int = 100, most: int = 5, shard: int = SHARD, bits: int = BITS) -> DataFrame:
    """(lang, words, phrase, a, n): all phrases of 1 to most words with a >= support occurrences; n counts lang's words.

    See collocations() for how odd rows of docs(text, lang) are taken. bits is a power of two, 64 or more.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09.,;:!?\x0A-\x0D]+"))
    totals = materialize(rows.groupBy("lang").agg(F.sum(words).cast("long").alias("total")).where("total >= 1"), "phrase-totals")
    all_words = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-all_words // (DEPTH * shard)))
    rows = rows.join(small(totals), "lang").select("text", "lang", "total").coalesce(int(tasks))
    mined = rows.mapInArrow(bounded(_mine(support, most, shard), 0), FOUND)
    mined = materialize(mined.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")), "phrase-candidates")
    unseen = small(mined.where("words = 0").select("lang", F.col("n").alias("unseen")))
    candidates = mined.where("words > 0").join(unseen, "lang").where(F.col("n") + F.col("unseen") >= support)
    bitmap = spark.sparkContext.broadcast(_filter(candidates, bits))
    counted = rows.mapInArrow(bounded(_count(bitmap, bits, most, shard), 0), FOUND)
    whole = counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= support)
    return materialize(whole.join(small(totals), "lang").select("lang", "words", "phrase", "a", F.col("total").alias("n")), "phrase-counts")


def collocations(docs: DataFrame, support: int = 100, most: int = 5, top: int = 2_000, inside: int = 100, shard: int = SHARD, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's first `top` phrases of 2 to `most` words.

    A-Z are lower-cased; texts are split at . , ; : ! ? and line ends into pieces, pieces at spaces and tabs into words.
    A phrase has a >= support occurrences within pieces; its score is the lowest floor(1000 a n / (l r)) over its cuts into
    a first part (l occurrences) and the rest (r), of equal ones that with the shortest first part. Phrases that lie in
    a longer one with 100 f(longer) >= inside a are left out: it is enough to look at phrases longer by one word, since
    every phrase between the two occurs at least as often as the longer one. Order: score and a falling, phrase by bytes.

    Null and empty texts hold no words; a null lang is "und". Repeated rows count each; other columns are ignored. A
    language without words, and an empty table, give no rows. A text of any length is taken whole.
    """
    found = phrase_counts(docs, support, most, shard, bits)
    phrases = found.where("words >= 2")
    tokens = F.split("phrase", " ", -1)
    part = lambda start, n: F.array_join(F.slice(tokens, start, n), " ")
    cuts = phrases.select("lang", "phrase", "a", "n", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "words")
    cuts = cuts.withColumn("first", part(F.lit(1), F.col("k"))).withColumn("rest", part(F.col("k") + 1, F.col("words") - F.col("k")))
    known = found.select("lang", "phrase", "a")
    left, right = (known.select("lang", F.col("phrase").alias(c), F.col("a").alias(n)) for c, n in (("first", "l"), ("rest", "r")))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    exact = F.expr("(CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) * 1000BD) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    best = cuts.withColumn("score", exact.cast("long")).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("s"), F.first("a").alias("a"), F.first("n").alias("n"), F.first("words").alias("words")
    )
    longer = phrases.where("words >= 3").select("lang", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"), F.col("a").alias("b"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    rows = best.join(longer, ["lang", "phrase"], "left").where(F.col("b").isNull() | (F.lit(100) * F.col("b") < F.lit(inside) * F.col("a")))
    rows = materialize(rows.select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score"), "phrase-scores")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    near = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    rows = rows.withColumn("_near", F.row_number().over(near)).where(F.col("_near") <= top)  # so a language's last sort is short
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


PHRASES = r"""WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
  string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(p), '[^ \t]+') AS w FROM d),
g AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, range(1, 6) r(m) WHERE len(w) >= m),
f AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY 1),
k AS (SELECT f.lang, phrase, m, a, n, string_split(phrase, ' ') AS w FROM f JOIN n USING (lang) WHERE m >= 2 AND a >= 100),
c AS (SELECT k.*, c, x.a AS l, y.a AS r, CAST((1000::HUGEINT * k.a * k.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score FROM k, range(1, 5) t(c)
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:c], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[c + 1:k.m], ' ') WHERE c < k.m),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
o AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM k z WHERE z.lang = b.lang AND z.m > b.m AND z.a >= b.a AND contains(' ' || z.phrase || ' ', ' ' || b.phrase || ' '))),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM q WHERE rank <= 2000"""
