"""Encoding whole texts with a public tokenizer, and a file format for ids with keyed access.

Encoding: byte-level BPE never merges across the borders that its pre-tokenizer draws, and it draws one before every
space that a character other than white space follows. So a text is cut there, each distinct piece is encoded once by
the tokenizers library, and the ids of a text are those of its pieces joined. Pieces are remembered within a bound.

Files: a shard holds the raw ids of documents in key order, then an index. The index is a minimal perfect hash (levels
of bit arrays: a key that is alone on its bit at a level is placed there, others fall to the next level; the rank of
the bit is the key's slot) with, for each slot, a stored fingerprint, the offset and the length. A lookup hashes the
key once for each level that it falls through, compares the fingerprint, and reads one range of the payload.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import bounded, materialize, new_path, read

PIECES = 400_000  # remembered pieces of a worker process
LONGEST = 48  # characters of a piece that is remembered
SEEN = 1 << 22  # marks of pieces met before: a piece is remembered when it comes again
_DOUBLE = re.compile(r"\s (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")
_HEAD = "\uffff"  # opens the key of a piece without a space before it
_L = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_WORD = re.compile(_L)
_S = r"[!-/:-@\[-`{-~]"  # signs: a run of them after a word is one pre-token
_SIGNED = re.compile(rf"({_HEAD}?{_L})({_S}+)")
_LINES = re.compile(rf"({_HEAD}?{_L}{_S}*)\n({_L}{_S}*)")


def _byte_signs() -> dict[int, str]:
    """For the characters of words and the space, the signs by which byte-level vocabularies write their bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in (0x20, *range(0xC0, 0x100))}


class _Pieces(dict):
    """ids of pieces, encoded where they are missing; those that come again are kept, `most` at most."""

    def __init__(self, tokenizer, code: str, most: int):
        self.tokenizer, self.code, self.signs, self.most = tokenizer, code, _byte_signs(), most
        self.word = tokenizer.model.tokenize
        self.seen, self.marks, self.odd = bytearray(SEEN), 0, False

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def __missing__(self, p: str) -> bytes:
        if p.isascii() and p.isalpha():  # a word is one pre-token
            out = array(self.code, [t.id for t in self.word("Ġ" + p)]).tobytes()
        elif not p or p[0].isspace():  # never kept, so that a space before white space is always noticed
            self.odd = True
            return self.whole(" " + p)
        elif m := _SIGNED.fullmatch(p):
            out = self[m[1]] + self[_HEAD + m[2]]
        elif p[0] == _HEAD:
            out = array(self.code, [t.id for t in self.word(p[1:].translate(self.signs))]).tobytes() if _WORD.fullmatch(p, 1) else self.whole(p[1:])
        elif _WORD.fullmatch(p):
            out = array(self.code, [t.id for t in self.word("Ġ" + p.translate(self.signs))]).tobytes()
        elif m := _LINES.fullmatch(p):
            out = self[m[1]] + self[_HEAD + "\n"] + self[_HEAD + m[2]]
        else:
            out = self.whole(" " + p)
        at = hash(p) & (SEEN - 1)
        if not self.seen[at]:
            self.seen[at] = 1
            self.marks += 1
            if self.marks > SEEN // 3:
                self.seen, self.marks = bytearray(SEEN), 0
        elif len(self) < self.most and len(p) <= LONGEST:
            self[p] = out
        return out


class Encoder:
    """ids(texts): the ids of each text as little-endian bytes of self.dtype, as tokenizers gives them.

    Words go to the tokenizer's model without the search for pre-tokens, which they are by themselves; all else goes
    through the whole tokenizer. Memory is bounded by `pieces`, of at most LONGEST characters each.
    """

    def __init__(self, path: str, pieces: int = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4") if wide else np.dtype("<u2")
        kind = json.loads(self.tokenizer.to_str())
        pre = kind["pre_tokenizer"] or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and not kind["normalizer"] and kind["model"]["type"] == "BPE"
        self.known = _Pieces(self.tokenizer, "I" if wide else "H", pieces)

    def _text(self, t: str) -> bytes:
        known = self.known
        if not self.cuts or _HEAD in t or any(a in t for a in self.added):
            return known.whole(t)
        known.odd = False
        pieces = t.split(" ")
        for again in (True, False):
            if pieces[0]:
                pieces[0] = _HEAD + pieces[0]
            else:
                del pieces[0]
            out = b"".join(map(known.__getitem__, pieces))
            if not (again and known.odd and _DOUBLE.search(t)):
                return out
            pieces = _CUT.split(t)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        return [self._text(t) if t else b"" for t in texts]


@functools.lru_cache(maxsize=2)
def encoder(path: str, pieces: int = PIECES) -> Encoder:
    return Encoder(path, pieces)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---- minimal perfect hash


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of uint64 keys."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def key_of(ids: np.ndarray, nth: np.ndarray, null: np.ndarray) -> np.ndarray:
    """uint64 key of (doc_id or null, number among rows of the same doc_id)."""
    with np.errstate(over="ignore"):
        return mix(ids.astype(np.int64).view(np.uint64), 101) ^ mix(nth.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64), 102)


class PerfectHash:
    """Levels of bit arrays over distinct uint64 keys; slot() gives each key its own number below the number of keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(np.concatenate(([0], np.cumsum(bits, dtype=np.int64))) + total)
            total += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, seed = [], 1
        while len(keys):
            size = max(8, int(1.5 * len(keys)))
            at = (mix(keys, seed) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
            seed += 1
            if seed > 400:
                raise ValueError("two documents have one key")
        return cls(levels)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Slots; -1 for keys that no level places."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for seed, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True), 1):
            if not len(left):
                break
            at = (mix(keys[left], seed) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<I", len(b)) + np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        (n,), at, levels = struct.unpack_from("<I", raw), 4, []
        for _ in range(n):
            (size,) = struct.unpack_from("<I", raw, at)
            end = at + 4 + (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw[at + 4 : end], np.uint8), count=size).astype(bool))
            at = end
        return cls(levels)


# ---- shard files: magic, payload, keys, index, footer

MAGIC = b"LKIDS001"
FOOTER = struct.Struct("<QQQQIB3x8s")  # payload bytes, keys, index start, hash bytes, crc of the index, bytes of an id


def shard_bytes(payload: bytes, width: int, ids: np.ndarray, null: np.ndarray, nth: np.ndarray, lengths: np.ndarray) -> bytes:
    """A shard of documents in the order given; lengths in ids."""
    keys = key_of(ids, nth, null)
    table = PerfectHash.build(keys)
    slot = table.slot(keys)
    offsets = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    index = np.zeros(len(keys), dtype=[("mark", "<u4"), ("offset", "<u8"), ("length", "<u8")])
    index["mark"][slot], index["offset"][slot], index["length"][slot] = (mix(keys, 999) >> np.uint64(32)).astype("<u4"), offsets, lengths
    listed = np.zeros(len(keys), dtype=[("id", "<i8"), ("nth", "<u4"), ("null", "u1")])
    listed["id"], listed["nth"], listed["null"] = ids, nth, null
    hashed = table.dump()
    tail = listed.tobytes() + hashed + index.tobytes()
    return MAGIC + payload + tail + FOOTER.pack(len(payload), len(keys), len(MAGIC) + len(payload), len(hashed), zlib.crc32(tail), width, MAGIC)


class Shard:
    """Keyed access to a shard that is open for reading."""

    def __init__(self, handle):
        self.handle = handle
        size = handle.size()
        payload, n, start, hashed, crc, self.width, magic = FOOTER.unpack(handle.read_at(FOOTER.size, size - FOOTER.size))
        tail = handle.read_at(size - FOOTER.size - start, start)
        if magic != MAGIC or zlib.crc32(tail) != crc:
            raise OSError("damaged shard")
        self.payload_bytes = payload
        self.listed = np.frombuffer(tail, dtype=[("id", "<i8"), ("nth", "<u4"), ("null", "u1")], count=n)
        at = self.listed.nbytes
        self.table = PerfectHash.load(tail[at : at + hashed])
        self.index = np.frombuffer(tail, dtype=[("mark", "<u4"), ("offset", "<u8"), ("length", "<u8")], count=n, offset=at + hashed)

    def find(self, ids: np.ndarray, nth: np.ndarray, null: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 for a key that isn't in the shard (but for one in 2**32 whose fingerprint happens to agree)."""
        keys = key_of(ids, nth, null)
        slot = self.table.slot(keys)
        if len(self.index):
            slot[(self.index["mark"][slot] != (mix(keys, 999) >> np.uint64(32)).astype("<u4"))] = -1
        return slot

    def ids(self, slot: int) -> np.ndarray:
        raw = self.handle.read_at(int(self.index["length"][slot]) * self.width, len(MAGIC) + int(self.index["offset"][slot]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")

    def all_ids(self) -> np.ndarray:
        return np.frombuffer(self.handle.read_at(self.payload_bytes, len(MAGIC)), f"<u{self.width}")


MANIFEST = "part long, shard long, path string, docs long, ids long"


def _writer(folder: str, tokenizer: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (out, root) = encoder(tokenizer), fs.FileSystem.from_uri(folder)
        out.create_dir(root, recursive=True)
        part, number = TaskContext.get().partitionId(), 0
        last = np.array([end_id], enc.dtype).tobytes()
        held: list[bytes] = []
        keys: list[tuple[int, int, int]] = []
        before: tuple = (None, None, -1)

        def flush() -> pa.RecordBatch:
            nonlocal number
            lengths = np.array([len(x) // enc.dtype.itemsize for x in held], np.int64)
            cols = np.array(keys, np.int64).reshape(-1, 3)
            name = f"{root}/{part:06d}-{number:06d}-{uuid.uuid4().hex}.ids"
            with out.open_output_stream(name) as f:
                f.write(shard_bytes(b"".join(held), enc.dtype.itemsize, cols[:, 0], cols[:, 1], cols[:, 2], lengths))
            row = [[part], [number], [folder + name.removeprefix(root)], [len(held)], [int(lengths.sum())]]
            number += 1
            held.clear()
            keys.clear()
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.int64()), pa.array(row[2]), pa.array(row[3], pa.int64()), pa.array(row[4], pa.int64())], names=["part", "shard", "path", "docs", "ids"])

        size = 0
        for b in batches:
            for doc, got in zip(b.column(0).to_pylist(), enc.ids(b.column(1).to_pylist()), strict=True):
                nth = before[2] + 1 if before[:2] == (doc is None, doc) else 0
                before = (doc is None, doc, nth)
                keys.append((doc or 0, int(doc is None), nth))
                held.append(got + last)
                size += len(held[-1]) // enc.dtype.itemsize
                if size >= shard_ids:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def write_ids(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, shard_ids: int = 1 << 23, folder: str | None = None) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; gives the manifest: part, shard, path, docs, ids, start.

    Null text is empty: its ids are the end id alone. A null doc_id comes first; rows that repeat a doc_id follow one
    another and are told apart by their number. Files are named by attempt, and the manifest lists those of the attempts
    that succeeded, so a task that runs twice does no harm. start counts all ids before the shard.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "ids")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    manifest = materialize(rows.mapInArrow(bounded(_writer(folder, tokenizer or default_tokenizer(), end_id, shard_ids), 1), MANIFEST), "ids-manifest")
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as f:
                shard = Shard(f)
                listed = shard.listed
                slots = shard.find(listed["id"], listed["nth"], listed["null"])
                if (slots < 0).any():
                    raise OSError(f"{path}: a listed key has no slot")
                offsets, lengths, ids = shard.index["offset"][slots], shard.index["length"][slots], shard.all_ids()
                crcs = [zlib.crc32(ids[o : o + n].astype("<u4").tobytes()) for o, n in zip(offsets.tolist(), lengths.tolist(), strict=True)]
                cols = [
                    pa.array(listed["id"], mask=listed["null"] == 1), pa.array((offsets + np.uint64(start)).astype(np.int64)),
                    pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, looked up by key in the files of the manifest."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(n).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_ids(spark, sf_dir: str) -> DataFrame:
    return read_ids(materialize(write_ids(read(spark, sf_dir, "documents")), "ids-starts"))
