"""Base rules by brute force, and the model against a plain Kneser-Ney in dictionaries."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from lorekeep.llm.perplexity import ORDER, Model, base_figures, border_items, borders, count_items, op3_quality_rules, quality_rules, store_model


def brute_figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, dup = set(), 0
    for x in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            inside |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def brute_grams(text):
    """The n-grams of a text as byte strings, each ending in the byte that is foreseen."""
    before, out = b"\xff", []
    for w in text.split():
        side = before[-3:] + b" "
        whole = side + w + b" "
        for p in range(len(side), len(whole)):
            inner = p - len(side)
            low = max(p - ORDER + 1, 0)
            out.append(whole[low : p + 1] if inner < 3 else (b" " + w + b" ")[inner + 2 - ORDER : inner + 2])
        before = b"\xff" + w
    return out


def brute_model(texts, order=ORDER):
    """Plain modified Kneser-Ney in dictionaries; gives cost(text)."""
    raw = Counter(g for t in texts for g in brute_grams(t))
    levels = {order: {g: n for g, n in raw.items() if len(g) == order}}
    for k in range(order - 1, 0, -1):
        below = Counter(g[1:] for g in levels[k + 1])
        levels[k] = {g: n for g, n in raw.items() if len(g) == k} | dict(below)
    table = [{} for _ in range(order + 1)]
    gamma = {}
    for k, grams in levels.items():
        c = Counter(grams.values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0
        d = [0.5, 1.0, 1.5]
        for i in (1, 2, 3):
            if c[1] and c[i] and c[i + 1]:
                d[i - 1] = max(0.05, min(i, i - (i + 1) * y * c[i + 1] / c[i]))
        ctx = defaultdict(list)
        for g, a in grams.items():
            ctx[g[:-1]].append((g, a, min(a, d[min(a, 3) - 1])))
        for h, rows in ctx.items():
            total = sum(a for _, a, _ in rows)
            gamma[k, h] = (sum(x for _, _, x in rows) / total, len(rows))
            for g, a, x in rows:
                table[k][g] = ((a - x) / total, h)

    def prob(g):
        if g == b"":
            return 1 / (gamma[1, b""][1] + 1)
        k, h = len(g), g[:-1]
        if (k, h) not in gamma:
            return prob(g[1:])
        return table[k].get(g, (0, None))[0] + gamma[k, h][0] * prob(g[1:])

    return lambda text: -sum(math.log(prob(g)) for g in brute_grams(text))


def test_figures():
    texts = ["", "a", "a b c a b c", "x\nx\n \n \nx y\nx y\n", "a b c d a b c e b c d", "w " * 500, "# $ é\xa0é | <a> &amp;\x1cz", "a a a a", "q\r\nq\r\n"]
    for t in texts:
        assert base_figures(t, t.encode(), t.encode().split()) == brute_figures(t), t


TEXTS = ["the cat sat on the mat and the hat", "a été là, a tea at the heat", "that man then ate than", "x", "on and on and on", "the  cat\tsat\n on a mat"]


def model_of(spark, texts, lang="+en"):
    rows = spark.createDataFrame([(lang, t) for t in texts], "lang string, text string")
    return Model(*store_model(count_items(rows)))


def test_model_equals_plain_kneser_ney(spark):
    probe = [t.encode() for t in [*TEXTS, "cat the on sat", "zzz é \u4e16", "h" * 40 + " a", ""]]
    model, cost = model_of(spark, TEXTS), brute_model([t.encode() for t in TEXTS])
    got = model.text_costs(probe, [p.split() for p in probe], "+en")
    assert np.allclose(got, [cost(p) for p in probe], rtol=1e-4)
    model.items = None  # from the n-grams alone
    assert np.allclose(Model.text_costs(model, probe, [p.split() for p in probe], "+en"), got, rtol=1e-4)


def test_items(spark):
    raw = b"ab c\n\nxyz hello  u"
    keys, text = borders(raw, np.array([0, 6]))
    flat, ends, first = border_items(keys)
    items = [bytes(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
    assert items == [b"\xff ab ", b"\xffab c ", b"\xff xyz", b"xyz hel", b"llo u "] and text.tolist() == [0, 0, 1, 1, 1] and first.tolist() == [3, 5, 3, 5, 5]
    assert len(borders(b"", np.zeros(1, np.int64))[0]) == 0 and len(borders(b" \n", np.array([0]))[0]) == 0


def test_shuffled_words_cost_more(spark):
    """Contexts cross the borders of words: an order that the corpus doesn't have is less likely."""
    rng = random.Random(6)
    verbs, things = ["sees", "takes", "holds", "finds"], ["stone", "river", "apple", "tower"]
    line = lambda: f"she {rng.choice(verbs)} one {rng.choice(things)} of these"
    texts = [" ".join(line() for _ in range(30)) for _ in range(40)]
    model = model_of(spark, texts)
    for t in texts[:10]:
        words = t.split()
        rng.shuffle(words)
        fluent, mixed = (model.text_costs([x.encode()], [x.encode().split()], "+en")[0] for x in (t, " ".join(words)))
        assert mixed > 1.15 * fluent


def test_query_and_bands(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op3_quality_rules(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        n = brute_figures(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r.kept == (not r.base_failed and r.low <= r.perplexity <= r.high)
    cost = brute_model([d.text.encode() for d in docs.values() if d.lang == "es"])
    for r in [r for r in got if r.lang == "es" and r.n_words][:5]:
        assert abs(math.log(r.perplexity) - cost(docs[r.doc_id].text.encode()) / (r.word_chars + r.n_words)) < 1e-3


def test_odd_rows(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "word " * 60, None, 1), (3, "word " * 60, None, 1), (None, "some words here", "xx", 1), (5, " ".join(f"w{i}" for i in range(5000)), "en", 1)]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in got) == [(0, 3, True, False), (1, 0, True, False), (2, 0, True, False), (3, 60, True, False), (3, 60, True, False), (5, 5000, False, True)]
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_null_and_empty_language_are_two(spark):
    texts = [" ".join(f"{a}{b}" for b in "xyzuvw" for a in "abcdefghij") for _ in range(2)]
    both = [(1, texts[0], None), (2, texts[1], "")]
    got = {r.doc_id: r.perplexity for r in quality_rules(spark.createDataFrame(both, "doc_id long, text string, lang string")).collect()}
    alone = quality_rules(spark.createDataFrame(both[:1], "doc_id long, text string, lang string")).first().perplexity
    assert abs(got[1] - alone) < 1e-6 and abs(got[2] - alone) < 1e-6
