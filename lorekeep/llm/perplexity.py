"""Quality rules with n-gram perplexity: base rules, and a modified Kneser-Ney model with bands for each language.

The model is over the bytes of the text with one space between words, so contexts cross the border of words: a byte is
foreseen from the up to ORDER - 1 bytes before it, of its word, the space, and the word before (as far as that begins;
a mark stands before its first byte, and before the first word). What crosses a border depends on the end of one word
and the beginning of the next alone, the rest on a word alone; both are items, counted by Spark over all texts. From the
items Spark counts n-grams, the continuation counts of the lower orders, the counts of counts that give the three
discounts of each order, and the interpolated probabilities, order by order.

The model is stored as arrays of 64-bit n-gram hashes in ascending order with log probabilities, and the same for the
contexts' back-off weights and for the costs of all items, which are computed once. Tasks map the files into memory.
A document's cost is the sum of its words' and borders' costs, its figure the mean cost of a character, counting a space
for each word (the log of its perplexity). A language's band comes from all its documents that pass the base rules:
WIDTH interquartile ranges below the first quartile and above the third.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import bounded, materialize, new_path, read, slices, small

ORDER, WIDTH = 5, 4.0
#: The bytes of a border on either side of its space, fixed by ORDER; the mark before a word, which is in no UTF-8 text.
SIDE, BEGIN, SPACE = 3, 0xFF, 0x20
BIN = 0.005  # the grain of the quartiles, in nats a character
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
SYMBOLS = "#*$%&|<>"
HELD = 300_000  # items that a task counts before it hands the counts on
REMEMBERED = 150_000  # words whose costs a process remembers
_MULT = np.uint64(0x9E3779B97F4A7C15)


# ---- base rules


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words that lie in n-word windows found twice or more."""
    count = len(words) - n + 1
    if count < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = h[:count].copy()
    for k in range(1, n):
        mixed = mixed * _MULT + h[k : k + count]
    order = np.sort(mixed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    places = np.flatnonzero(np.isin(mixed, twice)).tolist()
    exact = Counter(tuple(words[i : i + n]) for i in places)  # equal hashes are no proof
    edge = np.zeros(len(words) + 1, np.int32)
    for i in places:
        if exact[tuple(words[i : i + n])] > 1:
            edge[i] += 1
            edge[i + n] -= 1
    return int((np.cumsum(edge) > 0).sum())


def base_figures(text: str, raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = raw.split(b"\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen = Counter(x for x in lines if x.split())
        dup = sum(seen.values()) - len(seen)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


# ---- items: words, and borders between them


def borders(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, texts) of the border before each word of texts that are joined by white space and begin at offsets.

    A key holds the last SIDE bytes of the word before, with the mark where that is shorter, the first SIDE bytes of the
    word and its space, and both lengths; the first word of a text has the mark alone before it.
    """
    b = np.frombuffer(raw, np.uint8)
    inside = np.concatenate(([False], (b != SPACE) & ((b < 9) | (b > 13)), [False]))
    first, last = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:]) - 1
    size = last - first + 1
    b = np.concatenate((b, np.zeros(SIDE, np.uint8))).astype(np.uint64)
    one, two = size == 1, size == 2
    u = np.uint64
    p2 = np.where(one, u(SPACE), b[first + 1])
    p3 = np.where(one, u(0), np.where(two, u(SPACE), b[first + 2]))
    s2 = np.where(one, u(BEGIN), b[last - 1])
    s3 = np.where(one, u(0), np.where(two, u(BEGIN), b[last - 2]))
    ends = s3 << u(56) | s2 << u(48) | b[last] << u(40) | np.where(one, u(2), u(3)) << u(4)
    text = np.searchsorted(offsets, first, side="right") - 1
    before = np.concatenate(([u(0)], ends[:-1]))
    opens = np.concatenate(([True], text[1:] != text[:-1])) if len(text) else np.zeros(0, bool)
    before[opens] = u(BEGIN) << u(40) | u(1) << u(4)
    return before | b[first] << u(32) | p2 << u(24) | p3 << u(16) | np.where(one, u(2), u(3)), text


def border_items(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, ends, first) of the items of keys: the bytes one after the other, where each ends, and the number of the
    first byte that is foreseen."""
    shift = lambda n: (keys >> np.uint64(n) & np.uint64(255)).astype(np.uint8)
    before, after = (keys >> np.uint64(4) & np.uint64(15)).astype(np.int64), (keys & np.uint64(15)).astype(np.int64)
    rows = np.column_stack([shift(56), shift(48), shift(40), np.full(len(keys), SPACE, np.uint8), shift(32), shift(24), shift(16)])
    place = np.arange(7)
    real = (place >= SIDE - before[:, None]) & (place < SIDE + 1 + after[:, None])
    return rows[real], np.cumsum(before + 1 + after), before + 2


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return b"\n".join(texts), np.concatenate(([0], np.cumsum(size[:-1] + 1))) if len(texts) else np.zeros(0, np.int64)


def lang_key(lang: Column) -> Column:
    """A language's name in the model: null is one of its own, apart from an empty name."""
    return F.coalesce(F.concat(F.lit("+"), lang.cast("string")), F.lit("-"))


ITEMS = "lang string, item binary, first int, n long"


def _by_lang(b: pa.RecordBatch, lang: int, text: int) -> Iterator[tuple[str, list[int], list[str]]]:
    rows: dict[str, tuple[list[int], list[str]]] = {}
    for i, (name, t) in enumerate(zip(b.column(lang).to_pylist(), b.column(text).to_pylist(), strict=True)):
        at, texts = rows.setdefault(name, ([], []))
        at.append(i)
        texts.append(t or "")
    return ((name, *x) for name, x in rows.items())


def _count_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "item", "first", "n"]
    words: dict[str, Counter] = {}
    pairs: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(back, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, c in words.items():
            if not c:
                continue
            items = [b" %b " % w for w in c]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(items, pa.binary()), pa.array([ORDER] * len(c), pa.int32()), pa.array(c.values(), pa.int64())], names=names)
        for lang, parts in pairs.items():
            keys, n = merged(parts)
            flat, ends, first = border_items(keys)
            items = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), items, pa.array(first.astype(np.int32)), pa.array(n)], names=names)
        words.clear()
        pairs.clear()

    size = 0
    for b in batches:
        for lang, _, texts in _by_lang(b, 0, 1):
            raw, offsets = _joined([t.encode("utf-8", "surrogatepass") for t in texts])
            words.setdefault(lang, Counter()).update(raw.split())
            keys, n = np.unique(borders(raw, offsets)[0], return_counts=True)
            if len(keys):
                parts = pairs.setdefault(lang, [])
                parts.append((keys, n))
                size += len(keys)
                if len(parts) > 15:
                    size -= sum(len(k) for k, _ in parts)
                    parts[:] = [merged(parts)]
                    size += len(parts[0][0])
        if size + sum(map(len, words.values())) > HELD:
            yield from flush()
            size = 0
    yield from flush()


def count_items(rows: DataFrame) -> DataFrame:
    """(lang, item, first, n): the words and borders of rows(lang, text), how often, and the byte from which they count.

    A word stands between two spaces; of its bytes those after the first SIDE are foreseen within it, with its space.
    """
    return rows.select("lang", "text").mapInArrow(bounded(_count_items, 1), ITEMS).groupBy("lang", "item", "first").agg(F.sum("n").alias("n"))


def kneser_ney(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From items(lang, item, first, n): (lang, gram, logp) of all orders, and the contexts' (lang, gram, logp) back-off weights.

    The empty gram of the first is an unseen byte. N-grams that open with the mark have their own count at every order;
    others, below the highest order, the number of bytes seen before them.
    """
    order = ORDER
    grams = items.where(F.octet_length("item") >= F.col("first")).select("lang", "n", "item", F.explode(F.sequence("first", F.octet_length("item"))).alias("p"))
    grams = grams.select("lang", "n", F.expr(f"substring(item, greatest(1, p - {order - 1}), least(p, {order}))").alias("gram"))
    raw = materialize(grams.groupBy("lang", "gram").agg(F.sum("n").alias("a")).withColumn("k", F.octet_length("gram")), "grams")
    level = raw.where(F.col("k") == order)
    levels = [level]
    for k in range(order - 1, 0, -1):
        below = level.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("a")).withColumn("k", F.lit(k))
        level = raw.where(F.col("k") == k).unionByName(below)
        levels.append(level)
    adjusted = levels[0]
    for x in levels[1:]:
        adjusted = adjusted.unionByName(x)
    adjusted = materialize(adjusted, "grams-adjusted")
    n = [F.sum((F.col("a") == i).cast("double")).alias(f"n{i}") for i in range(1, 5)]
    disc = adjusted.groupBy("lang", "k").agg(*n)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    given = lambda i, value, other: F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0) & (F.col("n1") > 0), F.greatest(F.lit(0.05), F.least(F.lit(float(i)), value))).otherwise(other)
    disc = disc.select("lang", "k", given(1, 1 - 2 * y * F.col("n2") / F.col("n1"), 0.5).alias("d1"), given(2, 2 - 3 * y * F.col("n3") / F.col("n2"), 1.0).alias("d2"), given(3, 3 - 4 * y * F.col("n4") / F.col("n3"), 1.5).alias("d3"))
    disc = small(materialize(disc, "grams-discounts"))
    d = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = adjusted.join(disc, ["lang", "k"])
    rows = rows.select("lang", "k", "gram", "a", F.least(d, F.col("a")).alias("d"), F.expr("substring(gram, 1, octet_length(gram) - 1)").alias("context"), F.expr("substring(gram, 2)").alias("suffix"))
    contexts = rows.groupBy("lang", "k", "context").agg(F.sum("a").alias("total"), (F.sum("d") / F.sum("a")).alias("gamma"), F.count("*").alias("kinds"))
    contexts = materialize(contexts, "grams-contexts")
    first = rows.where("k = 1").join(contexts.where("k = 1").drop("k"), ["lang", "context"])
    prob = first.select("lang", "gram", ((F.col("a") - F.col("d")) / F.col("total") + F.col("gamma") / (F.col("kinds") + 1)).alias("p"))
    unseen = contexts.where("k = 1").select("lang", F.unhex(F.lit("")).alias("gram"), (F.col("gamma") / (F.col("kinds") + 1)).alias("p"))
    found = prob = materialize(prob.unionByName(unseen), "grams-1")
    for k in range(2, order + 1):
        lower = prob.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
        here = rows.where(F.col("k") == k).drop("k").join(contexts.where(F.col("k") == k).drop("k"), ["lang", "context"]).join(lower, ["lang", "suffix"])
        prob = materialize(here.select("lang", "gram", ((F.col("a") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("q")).alias("p")), f"grams-{k}")
        found = found.unionByName(prob)
    back = contexts.where("k > 1 AND gamma > 0").select("lang", F.col("context").alias("gram"), F.log("gamma").alias("logp"))
    return found.select("lang", "gram", F.log("p").alias("logp")), back


# ---- sorted hash arrays


def _mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@functools.lru_cache(maxsize=10_000)
def _salt(lang: str) -> np.uint64:
    raw = lang.encode("utf-8", "surrogatepass")
    return np.uint64(zlib.crc32(raw) << 32 | zlib.crc32(raw, 1))


def _gram_hash(packed: np.ndarray, size: np.ndarray | int, lang: str) -> np.ndarray:
    """Of n-grams packed into a number each, last byte lowest; signed, as they are stored."""
    return _mix(packed ^ (np.asarray(size).astype(np.uint64) << np.uint64(56)) ^ _salt(lang)).view(np.int64)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _MULT))


def item_hash(flat: np.ndarray, ends: np.ndarray, lang: str) -> np.ndarray:
    """Of byte strings that stand one after the other in flat."""
    size = np.diff(ends, prepend=0)
    if not len(size):
        return np.zeros(0, np.int64)
    starts = ends - size
    place = np.arange(len(flat)) - np.repeat(starts, size)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat((flat.astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[place], starts)
        return _mix(sums + size.astype(np.uint64) * _MULT ^ _salt(lang)).view(np.int64)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of a column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return flat, offsets[1:] - offsets[0]


def _hash_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs, out = np.array(b.column(0).to_pylist(), object), np.zeros(b.num_rows, np.int64)
        flat, ends = _binary(b.column(1))
        size = np.diff(ends, prepend=0)
        packed = np.zeros(b.num_rows, np.uint64)
        for k in range(int(size.max(initial=0))):
            has = size > k
            packed[has] |= flat[ends[has] - 1 - k].astype(np.uint64) << np.uint64(8 * k)
        for lang in set(langs.tolist()):
            at = langs == lang
            out[at] = _gram_hash(packed[at], size[at], lang)
        yield pa.RecordBatch.from_arrays([pa.array(out), b.column(2)], names=["h", "v"])


def _store(folder: str):
    """Each task writes its rows, which come sorted, as one file that can be mapped; named anew by each attempt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([b.cast(_ARRAYS) for b in batches], _ARRAYS).combine_chunks()
        if rows.num_rows:
            store, root = fs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            name = f"{root}/{uuid.uuid4().hex}.arrow"
            with store.open_output_stream(name) as f, pa.ipc.new_file(f, _ARRAYS) as out:
                out.write_table(rows)
            yield pa.RecordBatch.from_arrays([pa.array([rows["h"][0].as_py()]), pa.array([folder + name.removeprefix(root)])], names=["least", "path"])

    return run


_ARRAYS = pa.schema([("h", pa.int64()), ("v", pa.float32())])


def store_arrays(rows: DataFrame, name: str) -> list[tuple[int, str]]:
    """Write rows(h, v) as files of ascending h; gives each one's least h and path, one for each partition."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = materialize(rows, f"{name}-rows").repartitionByRange(parts, "h").sortWithinPartitions("h")
    found = materialize(kept.mapInArrow(_store(new_path(spark, name)), "least long, path string"), f"{name}-files")
    return sorted((r.least, r.path) for r in found.collect())


class Arrays:
    """Values by hash, from files of store_arrays; local files are mapped, not read."""

    def __init__(self, files: list[tuple[int, str]]):
        self.least, self.parts = np.array([h for h, _ in files], np.int64), []
        for _, path in files:
            store, name = fs.FileSystem.from_uri(path)
            source = pa.memory_map(name) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(name)
            rows = pa.ipc.open_file(source).read_all().combine_chunks()
            self.parts.append(tuple(rows[c].chunk(0).to_numpy(zero_copy_only=True) for c in ("h", "v")))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Values; NaN for hashes that aren't there."""
        out = np.full(len(h), np.nan)
        if not self.parts or not len(h):
            return out
        order = np.argsort(h)
        h = h[order]
        part = np.maximum(np.searchsorted(self.least, h, side="right") - 1, 0)
        edges = np.searchsorted(part, np.arange(len(self.parts) + 1))
        for k in np.unique(part).tolist():
            keys, values = self.parts[k]
            here = h[edges[k] : edges[k + 1]]
            at = np.minimum(np.searchsorted(keys, here), len(keys) - 1)
            out[order[edges[k] : edges[k + 1]]] = np.where(keys[at] == here, values[at], np.nan)
        return out


class Model:
    """Costs from the files of the n-grams, the contexts and, if they are stored, the items."""

    def __init__(self, grams: list, contexts: list, items: list | None = None):
        self.grams, self.contexts = Arrays(grams), Arrays(contexts)
        self.items = Arrays(items) if items else None
        self.costs: dict[str, dict[bytes, float]] = {}
        self.remembered = 0

    def item_costs(self, flat: np.ndarray, ends: np.ndarray, first: np.ndarray, lang: str) -> np.ndarray:
        """-log probability of the bytes of each item from its `first` (counted from one) on, from the n-grams."""
        size = np.diff(ends, prepend=0)
        item = np.repeat(np.arange(len(ends)), size)
        place = np.arange(len(flat)) - (ends - size)[item]
        at = np.flatnonzero(place >= first[item] - 1)
        k = np.minimum(place[at] + 1, ORDER)  # length of the n-gram tried
        wide = np.concatenate((np.zeros(ORDER, np.uint64), flat.astype(np.uint64)))
        packed = np.zeros((ORDER + 1, len(at)), np.uint64)  # the last k bytes, and the k before the last
        before = np.zeros((ORDER + 1, len(at)), np.uint64)
        for j in range(1, ORDER + 1):
            packed[j] = packed[j - 1] | wide[at + ORDER - j + 1] << np.uint64(8 * (j - 1))
            before[j] = before[j - 1] | wide[at + ORDER - j] << np.uint64(8 * (j - 1))
        cost, left = np.zeros(len(at)), np.arange(len(at))
        while len(left):
            n = k[left]
            p = self.grams.find(_gram_hash(packed[n, left], n, lang))
            miss = np.isnan(p)
            cost[left[~miss]] -= p[~miss]
            cost[left[miss & (n == 0)]] += 20.0  # a language the model has never seen
            left = left[miss & (n > 0)]
            m = k[left] - 1
            some = m > 0
            g = self.contexts.find(_gram_hash(before[m[some], left[some]], m[some], lang))
            cost[left[some]] -= np.nan_to_num(g)
            k[left] = m
        return np.bincount(item[at], weights=cost, minlength=len(ends))

    def _known_costs(self, flat: np.ndarray, ends: np.ndarray, first: np.ndarray, lang: str) -> np.ndarray:
        if self.items is None:
            return self.item_costs(flat, ends, first, lang)
        cost = self.items.find(item_hash(flat, ends, lang))
        miss = np.flatnonzero(np.isnan(cost))
        if len(miss):  # texts that the model hasn't seen
            size = np.diff(ends, prepend=0)
            own = np.isin(np.repeat(np.arange(len(ends)), size), miss)
            cost[miss] = self.item_costs(flat[own], np.cumsum(size[miss]), first[miss], lang)
        return cost

    def text_costs(self, texts: list[bytes], words: list[list[bytes]], lang: str) -> np.ndarray:
        """-log probability of each text, given with its words."""
        known = self.costs.setdefault(lang, {})
        new = list({w for ws in words for w in ws if w not in known})
        late: dict[bytes, float] = {}
        if new:
            flat = np.frombuffer(b"".join([b" %b " % w for w in new]), np.uint8)
            ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 2)
            late = dict(zip(new, self._known_costs(flat, ends, np.full(len(new), ORDER), lang).tolist(), strict=True))
            if self.remembered < REMEMBERED:
                known.update(late)
                self.remembered += len(late)
        out = np.array([sum([late[w] if (c := known.get(w)) is None else c for w in ws]) for ws in words], float)
        keys, text = borders(*_joined(texts))
        kinds, back = np.unique(keys, return_inverse=True)
        cost = self._known_costs(*border_items(kinds), lang)
        return out + np.bincount(text, weights=cost[back], minlength=len(texts))


@functools.lru_cache(maxsize=1)
def _model(grams: tuple, contexts: tuple, items: tuple) -> Model:
    return Model(list(grams), list(contexts), list(items))


def _cost_items(grams: list, contexts: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(tuple(grams), tuple(contexts), ())
        for b in batches:
            for b in (b.slice(i, 2_000) for i in range(0, b.num_rows, 2_000)):
                langs = np.array(b.column(0).to_pylist(), object)
                h, cost = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
                for lang in set(langs.tolist()):
                    at = np.flatnonzero(langs == lang)
                    part = b.take(pa.array(at))
                    flat, ends = _binary(part.column(1))
                    h[at], cost[at] = item_hash(flat, ends, lang), model.item_costs(flat, ends, part.column(2).to_numpy().astype(np.int64), lang)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(cost.astype(np.float32))], names=["h", "v"])

    return run


def store_model(items: DataFrame) -> tuple[list, list, list]:
    """Train on items(lang, item, first, n) and write the arrays; gives the files for Model."""
    stored = []
    for name, rows in zip(("model-grams", "model-contexts"), kneser_ney(items), strict=True):
        stored.append(store_arrays(rows.select("lang", "gram", F.col("logp").cast("float")).mapInArrow(bounded(_hash_grams), "h long, v float"), name))
    costs = items.select("lang", "item", "first").mapInArrow(bounded(_cost_items(*stored)), "h long, v float")
    return *stored, store_arrays(costs, "model-items")


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _scorer(files: tuple[list, list, list]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(*map(tuple, files))
        for b in batches:
            rows: list = [None] * b.num_rows
            rate: list = [None] * b.num_rows
            for lang, at, texts in _by_lang(b, 2, 3):
                raws = [t.encode("utf-8", "surrogatepass") for t in texts]
                words = [r.split() for r in raws]
                costs = model.text_costs(raws, words, lang).tolist()
                for i, t, r, w, c in zip(at, texts, raws, words, costs, strict=True):
                    rows[i] = base_figures(t, r, w)
                    rate[i] = c / (rows[i][1] + len(w)) if w else None
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols, pa.array(rate, pa.float64())], names=["doc_id", "lang", "lang_key", *FIGURES, "nats"])

    return run


def bands(scored: DataFrame, width: float = WIDTH) -> DataFrame:
    """(lang_key, low, high) from nats of documents that pass the base rules; quartiles are exact on bins of BIN nats."""
    bins = scored.where("NOT base_failed AND nats IS NOT NULL").groupBy("lang_key", F.floor(F.col("nats") / BIN).alias("bin")).agg(F.count("*").alias("n"))
    up = Window.partitionBy("lang_key").orderBy("bin")
    share = bins.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy("lang_key")))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))) * BIN
    quartiles = share.groupBy("lang_key").agg(at(0.25).alias("q1"), (at(0.75) + BIN).alias("q3"))
    reach = width * (F.col("q3") - F.col("q1"))
    return quartiles.select("lang_key", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def quality_rules(docs: DataFrame, width: float = WIDTH) -> DataFrame:
    """doc_id, the base figures, base_failed, lang, perplexity, low, high, kept of every row.

    Null text has no words and fails the base rules; its perplexity is null. Null is a language of its own, apart from an
    empty name. Repeated rows are counted and judged each. A language without documents that pass the base rules has no
    band. An empty table gives an empty result. Columns other than doc_id, text and lang are not read.
    """
    text = F.col("text").cast("string")
    items = materialize(count_items(docs.select(lang_key(F.col("lang")).alias("lang"), text.alias("text"))), "items")
    files = store_model(items)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), lang_key(F.col("lang")).alias("lang_key"), text.alias("text"))
    schema = "doc_id long, lang string, lang_key string, " + ", ".join(f"{c} long" for c in FIGURES) + ", nats double"
    scored = rows.mapInArrow(bounded(_scorer(files), 3), schema)
    scored = materialize(scored.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")), "scored")
    joined = scored.join(small(materialize(bands(scored, width), "bands")), "lang_key", "left")
    inside = F.coalesce(F.col("nats").between(F.col("low"), F.col("high")), F.lit(True))
    return joined.select(
        "doc_id", *FIGURES, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "lang", F.exp("nats").alias("perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high")
    )


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))
