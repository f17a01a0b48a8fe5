"""Base spans against Python's re, and the bootstrap on planted contexts."""

import hashlib
import random
import re
from collections import defaultdict

from lorekeep.llm.pii import KINDS, NAMES, bootstrap, find, op9_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes_luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda: 13 <= len(d) <= 19 and passes_luhn(d),
                "phone": lambda: 9 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def text_of(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op9_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(text_of(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[0] == k for x in want) for k in KINDS]
        assert set(text_of(want).split(",")) <= set(r.spans.split(","))


def base_of(spark, texts):
    rows = find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    return {r.doc_id: [(KINDS[x.kind - 1], x.s, x.e) for x in r.spans if not x.added] for r in rows}


def test_hard_texts(spark):
    texts = [
        None, "", "a@b.c_d@e.f", "..a@b.c.d.@x.y", "a@@b.c a@b a@b.", "é🙂 x@y.zz 1.2.3.4.5.6.7.8 256.1.1.1 01.002.255.0000255",
        "+1 (555) 010-9999)) +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 5",
        "1 2 3 4 5", "x" * 50_000 + "@", "a@b" + ".c" * 20_000, "1" * 30_000, "+1" + "-" * 20_000, "1.1.1.1" * 300, "a@b.co " * 2000, "%" * 9 + "@a.b%@c.d+@e.f",
    ]
    assert base_of(spark, texts) == {i: brute(t) for i, t in enumerate(texts)}


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"word Telefon: +49 30 9018{i:04d} und mehr" for i in range(20)]
    texts += [f"mail user{i}@host.example now. badge-id={i}{i}77" for i in range(20)]
    texts += ["bitte Telefon: 030-5557-123 anrufen", "version 4.0 of 2024", "mail root2(at)host now"]
    rows = {r.doc_id: r for r in find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    add = lambda i: [(NAMES[x.kind - 1], texts[i][x.s : x.e]) for x in rows[i].spans if x.added]
    assert add(40) == [("phone", "030-5557-123")]
    assert add(41) == []
    assert add(42) == [("email", "root2(at)host")]


def test_runs_and_secrets(spark):
    """A number that runs into the next one is found by its shape; a secret by the words that secrets stand behind."""
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    phone = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{digits(4)}"
    texts = [f"reach {phone()} soon" for _ in range(60)]
    texts += [f'api token = "{rng.randbytes(20).hex()}" here' for _ in range(60)]
    joined, short = [phone() for _ in range(10)], [f"k{digits(3)}z{digits(2)}" for _ in range(10)]
    texts += [f"reach {p} {digits(3)}.{digits(2)} soon" for p in joined] + [f'api token = "{x}" here' for x in short]
    texts += [f"chapter {digits(3)} ends, {digits(2)}th of may {digits(4)}" for _ in range(40)]
    rows = {r.doc_id: r for r in find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    add = lambda i: [(NAMES[x.kind - 1], texts[i][x.s : x.e]) for x in rows[i].spans if x.added]
    assert [add(120 + i) for i in range(10)] == [[("phone", p)] for p in joined]
    assert [add(130 + i) for i in range(10)] == [[("secret", x)] for x in short]
    assert all(len(add(60 + i)) == 1 for i in range(60)) and not any(add(i) for i in [*range(60), *range(140, 180)])


def test_graph_equals_brute_force(spark):
    rng = random.Random(8)
    instances = []
    for i in range(300):
        kind = rng.choice(["email", "ip", None, None])
        instances.append((f"c{i % 220}", kind if i % 220 == i else None, [f"p{rng.randrange(8) + 8 * (('email', 'ip', None).index(kind))}" for _ in range(rng.randrange(4))]))
    edges, seeds = defaultdict(set), {}
    for core, kind, patterns in instances:
        for x in patterns:
            edges[x].add(core)
        if kind and patterns:
            seeds[core] = max(kind, seeds.get(core, kind))
    edges = {x: c for x, c in edges.items() if len(c) >= 4}
    belief = {c: (k, 1.0) for c, k in seeds.items()}
    for _ in range(3):
        scores = defaultdict(float)
        for x, cores in edges.items():
            for c in cores:
                if c in belief:
                    scores[x, belief[c][0]] += belief[c][1] / (len(cores) + 1)
        good = {k: v for k, v in scores.items() if v >= 0.4}
        new = defaultdict(list)
        for (x, kind), v in good.items():
            for c in edges[x]:
                new[c].append((v, kind))
        belief = {c: (max(v)[1], max(v)[0]) for c, v in new.items()} | {c: (k, 1.0) for c, k in seeds.items()}
    got = bootstrap(spark.createDataFrame(instances, "core string, seed string, patterns array<string>"), 3, 4, 0.4)
    got = {(r.pattern, r.kind): r.score for r in got.collect()}
    assert got.keys() == good.keys() and len(good) > 5 and all(abs(got[k] - v) < 1e-9 for k, v in good.items())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a@b.c", "k"), (1, "a@b.c", "k"), (1, "a@b.c", "k"), (2, None, None)], "doc_id long, text string, kind string").withColumnRenamed("kind", "spans")
    assert sorted((r.doc_id or 0, len(r.spans)) for r in find(docs).collect()) == [(0, 1), (1, 1), (1, 1), (2, 0)]
    assert find(docs.limit(0)).count() == 0
