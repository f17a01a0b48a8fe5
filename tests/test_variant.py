"""Merge patches folded by path give what applying them one after another gives."""

import json
import random

from lorekeep.functions import variant


def _apply(target, patch):
    if not isinstance(patch, dict):
        return patch
    target = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            target.pop(k, None)
        else:
            target[k] = _apply(target.get(k), v)
    return target


def _leaves(x, path=()):
    if isinstance(x, dict):
        return {k: v for n, y in x.items() for k, v in _leaves(y, (*path, n)).items()}
    return {variant.STEP.join(path): json.loads(json.dumps(x))}


def _patch(rng, depth=0):
    out = {}
    for name in rng.sample("abc", rng.randint(1, 2)):
        what = rng.random()
        out[name] = _patch(rng, depth + 1) if what < 0.5 and depth < 3 else None if what < 0.65 else [1, None, {"z": 1}] if what < 0.75 else rng.choice([1, 2.5, "x y", True, "é\"\\"])
    return out


def test_patches(spark):
    rng, rows, want = random.Random(3), [], set()
    for key in range(60):
        state = {}
        for n in range(rng.randint(1, 8)):
            patch = _patch(rng)
            rows.append((key if key else None, n, json.dumps(patch)))
            state = _apply(state, patch)
        want |= {(key if key else None, p, json.dumps(v)) for p, v in _leaves(state).items()}
    rows += [(1, 99, "{broken"), (1, 100, None), (1, 101, "[1]"), (1, 102, "{}"), (777, 0, '{"a": {}}')]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, n int, payload string")
    got = {(r.k, r.path, json.dumps(json.loads(r.value))) for r in variant.merge_patches(df, ["k"], ["n"]).collect()}
    assert got == want
    assert variant.merge_patches(df.where("false"), ["k"], ["n"]).count() == 0


def test_too_deep_and_schema(spark):
    df = spark.createDataFrame([(1, 1, '{"a": {"b": {"c": 1}}}')], "k int, n int, payload string")
    assert [r.value for r in variant.leaves(df, depth=3).collect()] == ["1"]
    try:
        variant.leaves(df, depth=2).collect()
    except Exception as e:
        assert "deeper than 2 levels" in str(e)
    else:
        raise AssertionError("nothing raised")
    assert variant.schema_of(df).startswith("OBJECT<a: OBJECT<b")
