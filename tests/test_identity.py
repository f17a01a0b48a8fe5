"""Corrections of kept identity groups against a full rebuild; folders of other groups are not read."""

import random
import shutil
from pathlib import Path

import pytest

from lorekeep.operators import identity as idn

LINK = "decision_id long, a long, b long, decision string, state string, revision int"
REQUEST = "group_id string, decision_id long, expected long, node long, retain long, reviewer string"


def plain_groups(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, a, b, decision, state, _ in links:
        if decision == "same_person" and state == "active" and a != b:
            parent[root(a)] = root(b)
    found = {}
    for x in list(parent):
        found.setdefault(root(x), set()).add(x)
    return {frozenset(g) for g in found.values() if len(g) > 1}


def kept_groups(spark, path):
    found = {}
    for r in idn.read_identity(spark, path, "member").collect():
        found.setdefault(r.group_id, set()).add(r.node)
    return found


@pytest.fixture(scope="module")
def decisions():
    rng = random.Random(5)
    rows = [(i, 10 * (i % 30) + rng.randrange(8), 10 * (i % 30) + rng.randrange(8), rng.choice(["same_person"] * 4 + ["different"]), rng.choice(["active"] * 5 + ["superseded"]), i % 3) for i in range(400)]
    return rows + [(900, 5_000, 5_001, "different", "active", 2)]


def test_equals_a_full_rebuild_and_reads_only_what_it_touches(spark, tmp_path, decisions):
    path = f"{tmp_path}/kept"
    idn.publish_identity(spark.createDataFrame(decisions, LINK), f"file://{path}")
    before = kept_groups(spark, f"file://{path}")
    assert set(map(frozenset, before.values())) == plain_groups(decisions)
    rng = random.Random(6)
    picked = sorted(before)[::5]
    requests, after, audit = [], {d[0]: d for d in decisions}, set()
    for i, g in enumerate(picked):
        nodes = sorted(before[g])
        apart = set(rng.sample(nodes[1:], max(1, len(nodes) // 3))) if i % 2 else set()
        requests += [(g, None, None, n, nodes[0], "r") for n in apart] * 2
        for d, a, b, kind, state, rev in decisions:
            inside = a in before[g] and state == "active"
            if inside and i % 2 == 0 and d % 4:
                requests.append((g, d, rev, None, nodes[0], "s"))
                audit.add((d, rev + 1, "undo", "s", g))
                after[d] = (d, a, b, kind, "superseded", rev + 1)
            elif inside and kind == "same_person" and (a in apart) != (b in apart):
                audit.add((d, rev + 1, "split", "r", g))
                after[d] = (d, a, b, kind, "superseded", rev + 1)
    folders = {"b" + g[7 : 7 + idn.DIGITS] for g in picked}
    aside = Path(tmp_path, "aside")
    aside.mkdir()
    for f in Path(path).glob("bucket=*"):
        if f.name.split("=")[1] not in folders:
            for part in f.glob("*.parquet"):  # left in place, but no longer Parquet
                shutil.copy(part, aside / f"{f.name}--{part.name}")
                part.write_bytes(b"not to be read")
                Path(part.parent, f".{part.name}.crc").unlink(missing_ok=True)
    one = next(iter(Path(path).glob(f"bucket={min(folders)}")))
    schema = spark.read.parquet(f"file://{one}").schema.add("bucket", "string")
    reader = spark.read.schema(schema)

    class Session:  # parquet() with a known schema, so no footer is opened to infer it
        read = reader

        def __getattr__(self, name):
            return getattr(spark, name)

    done = idn.correct_identity(Session(), f"file://{path}", spark.createDataFrame(requests, REQUEST))
    assert {tuple(r) for r in done.audit.collect()} == audit
    changes = {r.node: (r.before, r.after) for r in done.changes.collect()}
    assert set(changes) == set().union(*(before[g] for g in picked))
    idn.apply_identity(done, f"file://{path}")
    for part in aside.iterdir():
        folder, name = part.name.split("--")
        shutil.copy(part, Path(path, folder, name))
    now = kept_groups(spark, f"file://{path}")
    assert set(map(frozenset, now.values())) == plain_groups(after.values())
    assert {tuple(r)[:6] for r in idn.read_identity(spark, f"file://{path}", "link").collect()} == set(after.values())
    for g in picked:
        nodes = before[g]
        kept = {n for n in nodes if changes[n][1] == g}
        assert not kept or min(nodes) in kept
    state = {r.group_id: (r.state, r.revision) for r in idn.read_identity(spark, f"file://{path}", "group").collect()}
    assert {g for g, (s, _) in state.items() if s == "active"} == set(now)
    assert all(state[g][1] == 2 for g in picked) and all(state[g] == ("active", 1) for g in now if g not in picked)
    again = [(g, None, None, max(now[g]), min(now[g]), "t") for g in sorted(now) if g not in before][:1]
    assert again  # a group that came of a split is found again by its id
    new = idn.correct_identity(spark, f"file://{path}", spark.createDataFrame(again, REQUEST))
    assert {r.before for r in new.changes.collect()} == {again[0][0]}


def test_requests_that_do_not_fit(spark, tmp_path):
    path = f"file://{tmp_path}/kept"
    rows = [(1, 1, 2, "same_person", "active", 1), (2, 2, 3, "same_person", "active", 1), (3, 7, 8, "different", "active", 1)]
    idn.publish_identity(spark.createDataFrame(rows, LINK), path)
    (g,) = kept_groups(spark, path)
    run = lambda *r: idn.correct_identity(spark, path, spark.createDataFrame(list(r), REQUEST))
    for bad, what in (
        ((g, 1, 2, None, 1, "r"), "stale"), ((g, 9, 1, None, 1, "r"), "stale"), ((g, None, None, 9, 1, "r"), "not in the group"), ((g, None, None, 1, 1, "r"), "retain"),
        ((g, 1, 1, None, None, "r"), "retain"), ((g, 1, 1, None, 9, "r"), "retain"), ((None, 3, 2, None, None, "r"), "stale"),
    ):
        with pytest.raises(ValueError, match=what):
            run(bad)
    with pytest.raises(ValueError, match="retain"):
        run((g, 1, 1, None, 1, "r"), (g, 2, 1, None, 2, "r"))
    done = run((None, 3, 1, None, None, "r"))
    assert [tuple(r) for r in done.audit.collect()] == [(3, 2, "undo", "r", "")] and done.changes.count() == 0
    done = run((g, None, None, 3, 1, "r"))
    assert {tuple(r) for r in done.changes.collect()} == {(1, g, g), (2, g, g), (3, g, None)}
    none = idn.correct_identity(spark, path, spark.createDataFrame([], REQUEST))
    assert none.rows.count() == none.changes.count() == none.audit.count() == 0
