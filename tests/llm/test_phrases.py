"""Collocations against brute force over all phrases."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lorekeep.llm import phrases
from lorekeep.llm.phrases import _first_hash, _next_hash, _word_hashes, collocations, grow, phrase_counts, split_words

SCHEMA = "doc_id long, text string, lang string"


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, support, most=5, top=2000):
    f, n, out = {}, Counter(), []
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for m in range(1, most + 1):
                for i in range(len(words) - m + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < support:
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in counts.items() if b >= support)
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def rows_of(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


def texts(seed, n=80):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "日本", "a-b", "x"]
    made = []
    for i in range(n):
        said = " ".join(rng.choice(words) if rng.random() < 0.7 else rng.choice(["new york city", "of the new york city", "é\t日本"]) for _ in range(rng.randrange(60)))
        made.append((i, said.replace("x", rng.choice([". ", "\n", "!?", "\x0b", " "])), rng.choice(["en", "en", "de", None])))
    return made


@pytest.mark.parametrize("shard", [40, 500, 1 << 23])
def test_equals_brute_force(spark, shard):
    rows = texts(shard)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(collocations(docs, support=7, shard=shard, bits=1 << 12)) == brute(rows, 7)
    assert rows_of(collocations(docs, support=7, top=3, shard=shard, bits=1 << 12)) == brute(rows, 7, top=3)


def test_a_full_filter_changes_nothing(spark):
    """With 64 bits everything passes the filter by chance, and the support decides alone."""
    rows = texts(5)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(collocations(docs, support=9, shard=60, bits=64)) == brute(rows, 9)


def test_odd_rows(spark):
    rows = [(1, None, "en"), (1, "", None), (None, "A b. A b", None), (None, "A b. A b", None), (2, "a b " * 50_000, "xx"), (3, " \t\n", "de"), (4, "a,b", "und")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS phrase", "2 AS n", "3 AS score", "4 AS words")
    assert rows_of(collocations(docs, support=3)) == brute(rows, 3)
    assert rows_of(collocations(docs.where("false"), support=3)) == []


def test_exact_beyond_64_bits(spark):
    """The score's product is taken in decimals of 38 digits."""
    rows = spark.sql("SELECT 3000000000L AS a, 90000000000000L AS n, 3100000000L AS l, 3200000000L AS r")
    got = rows.selectExpr("(CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) * 1000BD) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS s").first().s
    assert got == 1000 * 3000000000 * 90000000000000 // (3100000000 * 3200000000)


def test_words_and_hashes():
    words, first = split_words(pa.array(["Ab c.d", None, "", "e\tF\rg"]))
    assert words.to_pylist() == ["ab", "c", "d", "e", "f", "g"] and first.tolist() == [True, False, True, True, False, True]
    h = _word_hashes(pa.array(["a", "b"]))
    one = _first_hash("en", h)
    assert _next_hash(one[:1], h[1:]) != _next_hash(one[1:], h[:1]) and len(np.unique(np.concatenate([one, _first_hash("de", h)]))) == 4


def test_single_words_count_too(spark):
    docs = spark.createDataFrame([(1, "a b a", "en")], SCHEMA)
    assert {(r.phrase, r.a, r.n) for r in phrase_counts(docs, support=2).collect()} == {("a", 2, 3)}


def test_a_shard_holds_a_few_bytes_a_place(monkeypatch):
    """However many phrases are taken: at times of 16 million words, every array of a shard's length weighs."""
    monkeypatch.setattr(phrases, "PART", 1 << 13)
    rng = np.random.default_rng(1)
    ids, first = rng.integers(0, 5_000, 1 << 18).astype(np.int32), np.zeros(1 << 18, bool)
    names = pa.array([f"w{i}" for i in range(5_000)])
    tracemalloc.start()
    try:
        taken = sum(len(found) for _, found, _ in grow(ids, first, names, "en", lambda h, _: np.ones(len(h), bool), 5))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert taken > 3 * len(ids) and most < 24 * len(ids)


@pytest.mark.parametrize("part", [3, 16, 1 << 20])
def test_a_frequent_phrase_may_fill_a_part(monkeypatch, part):
    monkeypatch.setattr(phrases, "PART", part)
    rng = np.random.default_rng(part)
    ids = np.where(rng.random(600) < 0.8, np.arange(600) % 2, rng.integers(0, 6, 600)).astype(np.int32)
    first = rng.random(600) < 0.05
    first[0] = True
    want = Counter()
    for i in range(600):
        for n in range(1, 6):
            if i + n <= 600 and not first[i + 1 : i + n].any():
                want[" ".join("abcdef"[k] for k in ids[i : i + n])] += 1
    got = [x for _, said, n in grow(ids, first, pa.array(list("abcdef")), "en", lambda _, n: n >= 4, 5) for x in zip(said.to_pylist(), n.tolist(), strict=True)]
    assert sorted(got) == sorted((p, n) for p, n in want.items() if n >= 4)


def test_what_cannot_reach_the_support_is_no_candidate(spark, monkeypatch):
    """Found in one shard and unseen in the others: the most that these may hold of a phrase is counted."""
    rng = random.Random(12)
    rows = []
    for k in range(4):
        words = [f"w{rng.randrange(10**6)}" for _ in range(1_000)] + [f"twice{k}", f"so{k}"] * 2 + ["thrice", "more"] * (3 if k < 2 else 0)
        rows.append((k, ". ".join(" ".join(words[i : i + 2]) for i in range(0, len(words), 2)), "en"))
    docs = spark.createDataFrame(rows, SCHEMA).repartitionByRange(4, "doc_id")
    found = {}
    first = phrases._filter
    monkeypatch.setattr(phrases, "_filter", lambda candidates, bits: found.update({r.phrase: r.n for r in candidates.collect()}) or first(candidates, bits))
    got = {(r.phrase, r.a) for r in phrase_counts(docs, support=6).collect()}
    assert got == {("thrice", 6), ("more", 6), ("thrice more", 6)} and set(found) == {p for p, _ in got}
