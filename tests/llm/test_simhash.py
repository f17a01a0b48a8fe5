"""SimHash components against brute force over all pairs of fingerprints."""

import random
import re

import xxhash

from lorekeep.llm.simhash import links, op10_simhash, simhash_components


def brute_mark(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks):
    """marks: list of (id, fingerprint); smallest id reachable by links of at most two bits."""
    n, up = len(marks), list(range(len(marks)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if (marks[i][1] ^ marks[j][1]).bit_count() <= 2:
                up[top(i)] = top(j)
    least = {}
    for i in range(n):
        least[top(i)] = min(least.get(top(i), marks[i][0]), marks[i][0])
    return {marks[i][0]: least[top(i)] for i in range(n)}


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    marks = [(d.doc_id, brute_mark(d.text)) for d in docs]
    want = brute_components(marks)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op10_simhash(spark, sf).collect()}
    assert got == {i: (f"{m:016x}", want[i]) for i, m in marks}


def test_links_of_chains_and_borders(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    marks = set(base)
    for b in base:
        for _ in range(15):  # chains: each a flip or two from one before
            b ^= 1 << rng.randrange(64)
            if rng.random() < 0.6:
                b ^= 1 << rng.randrange(64)
            marks.add(b)
        marks.add(b ^ 7 << 30)  # three bits: no link by itself
    marks = list(enumerate(sorted(marks), 100))
    signed = [(m - (1 << 64) if m >> 63 else m, i) for i, m in marks]
    found = links(spark.createDataFrame(signed, "fp long, rep long")).collect()
    up = {i: i for i, _ in marks}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for r in found:
        a, b = max(top(r.a), top(r.b)), min(top(r.a), top(r.b))
        up[a] = b
    assert {i: top(i) for i, _ in marks} == brute_components(marks)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "y"), (5, "a", None), (4, "A", "z"), (4, "A", "z"), (None, "a b", "z"), (7, "w " * 30_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumnRenamed("fp", "component_id")
    got = [(r.doc_id, r.component_id) for r in simhash_components(docs).orderBy("doc_id").collect()]
    assert got == [(None, None), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (7, 7)]
    assert simhash_components(docs.limit(0)).count() == 0
