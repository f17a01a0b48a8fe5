"""Ids, the perfect hash, shard files and packing against direct encoding."""

import random
import zlib
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow.fs as fs
from tokenizers import Tokenizer

from lorekeep.llm import packing, tokens
from lorekeep.llm.packing import choose_cuts, op1_packing, pack
from lorekeep.llm.tokens import Encoder, PerfectHash, Shard, key_of, op4_token_ids, read_ids, write_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(texts):
    return [x.ids for x in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "é", "don't", "'s", "12", ",", ".", "word.", "word...", "né$$$#", "\nWord,", "x,y", " ", "　", "漢字", "🙂", "\x1c", "<|endoftext|>", "I'll", "\r\n", "…"]
    texts += ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)] + ["x" * 5000, None, ""]
    enc = Encoder(PATH)
    for _ in range(2):  # then from memory
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.ids(texts)] == plain(texts)


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 1000):
        ids = np.arange(n) * 7 - 3
        keys = key_of(ids, np.zeros(n, np.int64), np.zeros(n, np.int64))
        table = PerfectHash.load(PerfectHash.build(keys).dump())
        assert sorted(table.slot(keys).tolist()) == list(range(n))


def test_keyed_access(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i}", i) for i in range(300)], "doc_id long, text string, ids long")
    manifest = write_ids(docs, folder=f"file://{tmp_path}/ids", shard_ids=200).collect()
    assert len(manifest) > 4
    for row in manifest:
        store, name = fs.FileSystem.from_uri(row.path)
        with store.open_input_file(name) as f:
            shard = Shard(f)
            want = plain([f"text number {i}" for i in shard.listed["id"]])
            for k, i in enumerate(shard.listed["id"]):
                slot = shard.find(np.array([i]), np.array([0]), np.array([0]))[0]
                assert shard.ids(slot).tolist() == [*want[k], 2]
            missing = shard.find(np.arange(1000, 1200), np.zeros(200, int), np.zeros(200, int))
            assert (missing < 0).all()


def test_op4_query_equals_direct_encoding(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    ids = [[*x, 2] for x in plain([t for _, t in docs])]
    starts = [0, *accumulate(map(len, ids))]
    want = {(d[0], s, len(x), crc(x)) for d, s, x in zip(docs, starts, ids)}
    assert {tuple(r) for r in op4_token_ids(spark, sf).collect()} == want


def test_op4_odd_rows(spark):
    rows = [(None, "b"), (1, None), (1, None), (2, ""), (3, "a a"), (3, "a a"), (3, "a")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, start long")
    got = sorted(read_ids(write_ids(docs)).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens) for r in got][:4] == [(None, 2), (1, 1), (1, 1), (2, 1)]
    assert sorted(r.n_tokens for r in got[4:]) == [2, 3, 3]
    assert [r.start for r in got] == [0, *accumulate(r.n_tokens for r in got)][:-1]
    assert read_ids(write_ids(docs.limit(0))).count() == 0


def check_pieces(rows, ids):
    by_doc, by_seq = {}, {}
    for r in rows:
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == ids.keys()
    for spans, total in [(v, len(ids[k])) for k, v in by_doc.items()] + [(v, None) for v in by_seq.values()]:
        at = 0
        for s, n in sorted(spans):
            assert s == at
            at += n
        assert at == total if total is not None else at <= 1024
    sizes = [sum(n for _, n in v) for v in by_seq.values()]
    padding = sum(1024 - n for n in sizes if n & (n - 1))
    return padding / sum(1024 if n & (n - 1) else n for n in sizes)


def test_op1_query_packs_all_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids = dict(zip([d.doc_id for d in docs], [[*x, 0] for x in plain([d.text for d in docs])]))
    rows = op1_packing(spark, sf).collect()
    assert check_pieces(rows, ids) < 0.01
    least, parts = -(-sum(map(len, ids.values())) // 1024), len({r.sequence_id >> 32 for r in rows})
    assert len({r.sequence_id for r in rows}) <= 1.03 * least + parts


def test_packing_in_small_blocks_and_odd_rows(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "a. b. c."), (5, "Short one. " * 700)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, offset long").coalesce(1)
    ids = {r[0]: [*x, 0] for r, x in zip(rows, plain([r[1] for r in rows]))}
    check_pieces(pack(docs).collect(), ids)
    assert pack(docs.limit(0)).count() == 0
    twice = pack(spark.createDataFrame([(None, "x"), (None, "x")], "doc_id long, text string").coalesce(1)).collect()
    assert [(r.doc_id, r.length) for r in twice] == [(None, 2), (None, 2)]


def test_cuts_are_optimal():
    rng = random.Random(2)
    for _ in range(200):
        at = [0, *accumulate(rng.randint(1, 9) for _ in range(rng.randint(1, 25)))]
        pen = [0, *(rng.choice((0, 2, 5)) for _ in at[1:])]
        best = [0] + [None] * (len(at) - 1)
        cost = lambda n: 0 if n & (n - 1) == 0 else 16 - n
        for j in range(1, len(at)):
            best[j] = pen[j] + min(best[i] + cost(at[j] - at[i]) for i in range(j) if at[j] - at[i] <= 16)
        cuts = choose_cuts(np.array(at), np.array(pen, float), 16)
        total = sum(pen[j] + cost(at[j] - at[i]) for i, j in zip(cuts, cuts[1:]))
        assert cuts[0] == 0 and cuts[-1] == len(at) - 1 and total == best[-1]
        assert all(at[j] - at[i] <= 16 for i, j in zip(cuts, cuts[1:]))
    assert packing.SENTENCE < packing.INSIDE and tokens.LONGEST > 0
