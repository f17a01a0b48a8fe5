"""Sequence alignment and scoring of recognized speech and speaker turns.

The kernels are small functions over one row's tokens; Spark partitions the rows and sums their counts.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


#: Cells of a block that is traced back directly (fixed value); a larger one is halved.
BLOCK_CELLS = 4_096


def _rows(ref: Sequence, hyp: Sequence) -> Iterator[tuple[int, int, int, int]]:
    """For each number of reference tokens, from none: four sets of bits, bit j - 1 for the place j of hyp.

    The first (second) is set if the distance to hyp[:j] is one more (less) than that to hyp[:j - 1]; the third if it is no
    more than that of one token less on either side; the fourth if it is one more than that of one reference token less.
    A row of the distance matrix is whole numbers, whose bits are worked on together.
    """
    full = (1 << len(hyp)) - 1
    at: dict[int, int] = {}
    for j, x in enumerate(hyp):
        at[x] = at.get(x, 0) | 1 << j
    up, down = full, 0
    yield up, down, 0, 0
    for x in ref:
        same = at.get(x, 0)
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        rise = (down | ~(diagonal | up)) & full
        over = (rise << 1 | 1) & full
        under = ((diagonal & up) << 1) & full
        up = (under | ~(diagonal | over)) & full
        down = over & diagonal
        yield up, down, diagonal, rise


def distance(ref: Sequence, hyp: Sequence) -> int:
    """Edit distance, without the operations."""
    for up, down, _, _ in _rows(ref, hyp):  # noqa: B007
        pass
    return len(ref) + up.bit_count() - down.bit_count()


def _last_row(ref: list[int], hyp: list[int]) -> np.ndarray:
    """Edit distances of ref to every beginning of hyp."""
    for up, down, _, _ in _rows(ref, hyp):  # noqa: B007
        pass
    size = (len(hyp) + 7) // 8
    rise, fall = (np.unpackbits(np.frombuffer(x.to_bytes(size, "little"), np.uint8), count=len(hyp), bitorder="little").astype(np.int64) for x in (up, down))
    return len(ref) + np.concatenate(([0], np.cumsum(rise - fall)))


def _trace(r: list[int], h: list[int], i0: int, j0: int) -> list[tuple[str, int, int]]:
    """The operations of a block, back from its end: pairs come before deletions before insertions."""
    rows = [x[2:] for x in _rows(r, h)]
    ops, i, j = [], len(r), len(h)
    while i and j:
        level, rise = rows[i]
        if r[i - 1] == h[j - 1]:
            i, j = i - 1, j - 1
            ops.append(("equal", i0 + i, j0 + j))
        elif not level >> (j - 1) & 1:
            i, j = i - 1, j - 1
            ops.append(("substitute", i0 + i, j0 + j))
        elif rise >> (j - 1) & 1:
            i -= 1
            ops.append(("delete", i0 + i, j0 + j))
        else:
            j -= 1
            ops.append(("insert", i0 + i, j0 + j))
    ops += [("delete", i0 + k, j0) for k in range(i - 1, -1, -1)] + [("insert", i0, j0 + k) for k in range(j - 1, -1, -1)]
    return ops[::-1]


def align(ref: list[str], hyp: list[str]) -> list[tuple[str, int, int]]:
    """(op, i, j) of a least-cost alignment, in memory that grows with the length of the texts, not its square.

    Equal ends are paired first. A block of over BLOCK_CELLS cells is halved: at the middle of its reference, where the
    hypothesis is cut at the first place of least total distance on either side. Smaller blocks are traced back.
    """
    ids: dict[str, int] = {}
    r, h = ([ids.setdefault(x, len(ids)) for x in side] for side in (ref, hyp))
    least, a, z = min(len(r), len(h)), 0, 0
    while a < least and r[a] == h[a]:
        a += 1
    while z < least - a and r[-1 - z] == h[-1 - z]:
        z += 1
    ops = [("equal", i, i) for i in range(a)]
    todo = [(a, len(r) - z, a, len(h) - z)]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        n, m = i1 - i0, j1 - j0
        if n < 2 or m < 2 or n * m <= BLOCK_CELLS:
            ops += _trace(r[i0:i1], h[j0:j1], i0, j0)
            continue
        half = i0 + n // 2
        left, right = _last_row(r[i0:half], h[j0:j1]), _last_row(r[half:i1][::-1], h[j0:j1][::-1])
        cut = j0 + int(np.argmin(left + right[::-1]))
        todo += [(half, i1, cut, j1), (i0, half, j0, cut)]  # the left part is taken up first
    return ops + [("equal", len(r) - z + k, len(h) - z + k) for k in range(z)]


def char_errors(ref: list[str], hyp: list[str]) -> int:
    """Edit distance by code points of the tokens joined by spaces."""
    short, long = sorted((" ".join(ref), " ".join(hyp)), key=len)
    if _within(short, long):
        return len(long) - len(short)
    head = len(os.path.commonprefix([short, long]))
    short, long = short[head:], long[head:]
    tail = len(os.path.commonprefix([short[::-1], long[::-1]]))
    return distance(short[: len(short) - tail], long[: len(long) - tail])


def _within(short: Sequence, long: Sequence) -> bool:
    """Whether short is long with some items left out: then what is left out is all that a least-cost alignment counts."""
    left = iter(long)
    return all(x in left for x in short)


def edit_counts(ref: list[str], hyp: list[str]) -> tuple[int, int, int]:
    """Substitutions, deletions, insertions."""
    if _within(hyp, ref):
        return 0, len(ref) - len(hyp), 0
    if _within(ref, hyp):
        return 0, 0, len(hyp) - len(ref)
    ops = [o for o, _, _ in align(ref, hyp)]
    return ops.count("substitute"), ops.count("delete"), ops.count("insert")


#: Rows whose tokens are Python objects at one time.
SLICE = 32


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of few rows: words as Python objects take many times their room in Arrow."""
    for at in range(0, batch.num_rows, SLICE):
        yield batch.slice(at, SLICE)


COUNTS = StructType([StructField(c, LongType()) for c in ("substitutions", "deletions", "insertions")])


def with_edit_counts(rows: DataFrame, pairs: dict[str, tuple[str, str]], chars: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """rows with a struct of counts for each name of pairs, whose value names two columns of token lists; null is no tokens.
    For each name of chars, likewise the errors by characters.

    One pass over Arrow batches that carries the other columns along, so the result is a plain table: any aggregate,
    join or filter may follow.
    """
    at, by_chars = ({n: (rows.columns.index(r), rows.columns.index(h)) for n, (r, h) in x.items()} for x in (pairs, chars or {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[tuple[int, int, int]]] = [[] for _ in at]
            errors: list[list[int]] = [[] for _ in by_chars]
            for x in sliced(b):
                for found, (i, j) in zip(errors, by_chars.values(), strict=True):
                    found += [char_errors(r or [], h or []) for r, h in zip(x.column(i).to_pylist(), x.column(j).to_pylist(), strict=True)]
                columns = [zip(x.column(i).to_pylist(), x.column(j).to_pylist(), strict=True) for i, j in at.values()]
                for row in zip(*columns, strict=True):
                    for k, pair in enumerate(row):  # lists that another pair of the row has too are aligned once
                        same = row.index(pair)
                        counts[k].append(counts[same][-1] if same < k else edit_counts(pair[0] or [], pair[1] or []))
            made = []
            for found in counts:
                parts = list(zip(*found, strict=True)) or [(), (), ()]
                made.append(pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in parts], names=COUNTS.names))
            made += [pa.array(x, pa.int64()) for x in errors]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *at, *by_chars])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *[StructField(n, COUNTS) for n in at], *[StructField(n, LongType()) for n in by_chars]]))


@F.udtf(returnType="op string, i int, j int")
class EditOps:
    """Table function edit_ops(ref, hyp): the operations of a least-cost alignment in order, with the places of both sides
    (of a deletion, the place in hyp before which it falls; of an insertion, that in ref). Null lists are empty."""

    def eval(self, ref: list, hyp: list) -> Iterator[tuple]:
        yield from align(list(ref or []), list(hyp or []))


def register_edit_ops(spark: SparkSession) -> None:
    """Makes edit_ops known to SQL: SELECT ... FROM t, LATERAL edit_ops(t.ref, t.hyp)."""
    spark.udtf.register("edit_ops", EditOps)


#: Cells (places of the streams times the width of the band) beyond which an interleaving isn't searched for.
ORC_CELLS = 40_000_000


def _least_errors(streams: list[list[str]], hyp: list[str]) -> int:
    """No interleaving has fewer errors: words that one side lacks."""
    common = sum((Counter(w for s in streams for w in s) & Counter(hyp)).values())
    return max(sum(map(len, streams)), len(hyp)) - common


def orc_errors(streams: list[list[str]], hyp: list[str], cells: int = ORC_CELLS) -> tuple[int, int, int, int] | None:
    """Least (errors, S, D, I) of the hypothesis against any interleaving of the reference streams; None if it would take
    more than `cells` cells.

    The lattice of places in the streams is walked in layers of equal progress, all places of a layer together, and two
    layers are held. At each place a row holds the costs by how far the hypothesis is ahead of the streams. An alignment
    with at most E errors is never further ahead or behind than E allows, so rows are bands: E starts at a lower bound and
    doubles until the result is within it, which then is the least of all.
    """
    streams = sorted((s for s in streams if s), key=len, reverse=True)
    total, m = sum(map(len, streams)), len(hyp)
    if not streams:
        return m, 0, 0, m
    ids: dict[str, int] = {}
    told = [np.array([ids.setdefault(w, len(ids)) for w in s], np.int32) for s in streams]
    heard = np.array([ids.get(w, -1) for w in hyp], np.int32)
    places = int(np.prod([len(s) + 1 for s in streams], dtype=object))
    limit = max(_least_errors(streams, hyp), 1)
    most = max(total, m)
    while True:
        limit = min(limit, most)
        # ahead by d at a place: at least |d| errors before it and |(m - total) - d| after it
        low, high = -((limit - (m - total)) // 2), (limit + (m - total)) // 2
        low, high = min(low, 0, m - total), max(high, 0, m - total)
        if places * (high - low + 1) > cells:
            return None
        cost = _band(told, heard, total, m, low, high)
        errors, substitutions = cost
        if errors <= limit:
            both = errors - substitutions
            deletions = (both + total - m) // 2
            return int(errors), int(substitutions), int(deletions), int(both - deletions)
        limit = 2 * limit


def _band(streams: list[np.ndarray], hyp: np.ndarray, total: int, m: int, low: int, high: int) -> tuple[int, int]:
    """(errors, substitutions) of the best way through the band; of equally many errors fewer substitutions are less.

    An error costs a unit, a substitution one more. Costs are kept less a unit for each word that the hypothesis is ahead,
    so a row under insertions is its running minimum. Layer t holds the places with t words of all streams: each place of
    the shorter streams, with what is left of t in the longest. Places outside it are walked too, but lead to none inside.
    """
    kind = np.int32 if total + m < 1 << 14 else np.int64
    unit, far = (1 << 14, 1 << 29) if kind is np.int32 else (1 << 32, 1 << 60)
    width = high - low + 1
    inner = [len(s) + 1 for s in streams[1:]]
    spots = np.indices(inner).reshape(len(inner), int(np.prod(inner, dtype=object)))
    done = spots.sum(0)
    backs = []  # for each shorter stream: the places that have words of it, those one word before, and the last word
    for k, s in enumerate(streams[1:]):
        rows = np.flatnonzero(spots[k])
        step = int(np.prod(inner[k + 1 :], dtype=object))
        backs.append((slice(1, None), slice(0, -1)) if len(inner) == 1 else (rows, rows - step))
        backs[-1] += (s[spots[k][rows] - 1][:, None],)
    reach = int(done.max())
    longest = np.full(len(streams[0]) + 2 * reach + 2, -3, np.int32)
    longest[reach : reach + len(streams[0])] = streams[0]
    padded = np.full(total + m + 2 * width + 4, -2, np.int32)
    base = width + 2
    padded[base + 1 : base + 1 + m] = hyp  # padded[base + j] is the word that ends at place j of the hypothesis
    paired = kind(unit + 1)
    before = np.full((len(done), width), far, kind)
    for t in range(total + 1):
        first, last = max(0, -t - low), min(width, m - t - low + 1)  # the band within the hypothesis
        if t:
            here = np.full_like(before, far)
            if first < last:
                heard = padded[base + t + low + first : base + t + low + last]
                word = longest[np.clip(t - 1 - done + reach, 0, len(longest) - 1)][:, None]
                part = here[:, first:last]
                np.add(before[:, first:last], (word != heard) * paired, out=part)  # paired: as far ahead as before
                less = before[:, first + 1 : last + 1] + 2 * unit  # deleted: one less
                np.minimum(part[:, : less.shape[1]], less, out=part[:, : less.shape[1]])
                for rows, source, word in backs:
                    back = before[source]
                    best = back[:, first:last] + (word != heard) * paired
                    np.minimum(best[:, : less.shape[1]], back[:, first + 1 : last + 1] + 2 * unit, out=best[:, : less.shape[1]])
                    part[rows] = np.minimum(part[rows], best)
        else:
            here = before
            if low <= 0 <= high:
                here[0, -low] = 0
        if first < last:
            part = here[:, first:last]
            np.minimum(np.minimum.accumulate(part, axis=1), kind(far), out=part)  # inserted: one more
        before = here
    ahead = m - total
    cost = int(before[-1, ahead - low]) + ahead * unit
    return cost // unit, cost % unit


ORC = StructType([StructField("status", StringType()), *[StructField(c, LongType()) for c in ("errors", "substitutions", "deletions", "insertions", "total")]])


def with_orc(rows: DataFrame, streams: str, hyp: str, name: str = "orc", cells: int = ORC_CELLS) -> DataFrame:
    """rows with a struct: status, errors, substitutions, deletions, insertions, total of hyp (a list of tokens) against the
    best interleaving of streams (a list of lists of tokens).

    scored; not_applicable where streams are null, or hold no token; too_large, and no numbers, where the search would
    pass `cells`. A null list among the streams, or a null hypothesis, is empty.
    """
    i, j = rows.columns.index(streams), rows.columns.index(hyp)

    def score(told: list | None, heard: list | None) -> dict:
        told = [list(s or []) for s in told or []]
        total = sum(map(len, told))
        if not total:
            return {"status": "not_applicable"}
        found = orc_errors(told, list(heard or []), cells)
        if found is None:
            return {"status": "too_large", "total": total}
        return {"status": "scored", "total": total} | dict(zip(("errors", "substitutions", "deletions", "insertions"), found, strict=True))

    kind = pa.struct([("status", pa.string()), *[(c, pa.int64()) for c in ORC.names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [score(s, h) for x in sliced(b) for s, h in zip(x.column(i).to_pylist(), x.column(j).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, kind)], names=[*b.schema.names, name])

    # a row may take a second: rows are dealt out evenly, however few bytes they are
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, ORC)]))


#: Rows up to which subsets of columns are listed.
SUBSETS = 10


def best_assignment(cost: np.ndarray) -> tuple[float, list[int]]:
    """Least total of a one-to-one assignment of rows to columns of a square matrix; of equals the first in order.

    Subsets of columns are solved from the last row up; the choice then goes down the rows, taking the lowest column
    that keeps the least total. Beyond SUBSETS rows the least total of what is left is found by augmenting paths instead.
    """
    n = len(cost)
    if n > SUBSETS:
        total = _solve(cost)
        return total, _first_columns(cost, total)
    tail = {(1 << n) - 1: 0.0}
    layers = [tail]
    for row in range(n - 1, -1, -1):
        new: dict[int, float] = {}
        for used, total in layers[-1].items():
            for c in range(n):
                if used >> c & 1:
                    before = used & ~(1 << c)
                    value = total + cost[row, c]
                    if value < new.get(before, float("inf")):
                        new[before] = value
        layers.append(new)
    layers = layers[::-1]
    used, chosen = 0, []
    for row in range(n):
        rest = layers[row + 1]
        c = next(c for c in range(n) if not used >> c & 1 and used | 1 << c in rest and cost[row, c] + rest[used | 1 << c] == layers[row][used])
        chosen.append(c)
        used |= 1 << c
    return layers[0][0], chosen


def _first_columns(cost: np.ndarray, total: float) -> list[int]:
    """The column of each row: the lowest that keeps the total."""
    left, columns, chosen = cost, list(range(len(cost))), []
    for _ in range(len(cost)):
        for k in range(len(columns)):
            rest = np.delete(left[1:], k, 1)
            after = _solve(rest) if len(rest) else 0.0
            if abs(left[0, k] + after - total) < 1e-9:
                chosen.append(columns.pop(k))
                left, total = rest, after
                break
    return chosen


def cpwer(ref: dict[str, list[str]], hyp: dict[str, list[str]]) -> dict:
    """Concatenated minimum-permutation errors: channels are paired one to one, missing ones are empty."""
    r, h = sorted(ref), sorted(hyp)
    n = max(len(r), len(h))
    r_all, h_all = [*r, *["~unmapped"] * (n - len(r))], [*h, *[None] * (n - len(h))]
    sides = lambda a, b: (ref.get(b, []), hyp.get(a, []) if a else [])
    cost = np.array([[distance(*sides(a, b)) for b in r_all] for a in h_all], float).reshape(n, n)
    _, chosen = best_assignment(cost) if n else (0.0, [])
    counts = [edit_counts(*sides(a, r_all[c])) for a, c in zip(h_all, chosen, strict=True)]  # of the chosen pairs alone
    s, d, i = (sum(c[x] for c in counts) for x in range(3))
    total = sum(map(len, ref.values()))
    mapping = {a: r_all[c] for a, c in zip(h_all, chosen, strict=True) if a and r_all[c] != "~unmapped"}
    return {"errors": s + d + i, "substitutions": s, "deletions": d, "insertions": i, "total": total, "value": (s + d + i) / total if total else None, "mapping": mapping}


def speaker_map(weights: dict[tuple[str, str], int]) -> dict[str, str | None]:
    """Hypothesis label -> reference label of greatest common time, one to one; of equals unmapped, then the larger label."""
    hyps = sorted({h for h, _ in weights})
    refs = sorted({r for _, r in weights}, reverse=True)
    n = len(hyps) + len(refs)
    if not hyps:
        return {}
    # columns: one way to stay unmapped for each hypothesis, then the references; spare rows fill the rest
    cost = np.zeros((n, n))
    for i, h in enumerate(hyps):
        for j, r in enumerate(refs):
            cost[i, len(hyps) + j] = -weights.get((h, r), 0)
    if n <= 14:
        _, chosen = best_assignment(cost)
        picked = chosen[: len(hyps)]
    else:
        picked = _hungarian(cost, hyps, refs)
    return {h: refs[c - len(hyps)] if c >= len(hyps) and weights.get((h, refs[c - len(hyps)]), 0) > 0 else None for h, c in zip(hyps, picked, strict=True)}


def _solve(cost: np.ndarray) -> float:
    """Least total by successive shortest augmenting paths with potentials."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], col = i, 0
        reach, back, done = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while match[col]:
            done[col] = True
            open_ = np.flatnonzero(~done[1:]) + 1
            slack = cost[match[col] - 1, open_ - 1] - u[match[col]] - v[open_]
            better = slack < reach[open_]
            reach[open_[better]], back[open_[better]] = slack[better], col
            nxt = open_[np.argmin(reach[open_])]
            step = reach[nxt]
            u[match[done]] += step
            v[done] -= step
            reach[open_] -= step
            col = nxt
        while col:
            match[col] = match[back[col]]
            col = back[col]
    return float(sum(cost[match[c] - 1, c - 1] for c in range(1, n + 1)))


def _hungarian(cost: np.ndarray, hyps: list, refs: list) -> list[int]:
    """As best_assignment for many labels: each row takes the first column that keeps the least total."""
    left, picked, total = cost.copy(), [], _solve(cost)
    columns = list(range(cost.shape[1]))
    for i in range(len(hyps)):
        spare = next(c for c in columns if c < len(hyps)) if any(c < len(hyps) for c in columns) else None
        options = [c for c in ([spare] if spare is not None else []) + [c for c in columns if c >= len(hyps)]]
        for c in options:
            rest = np.delete(np.delete(left, 0, 0), columns.index(c), 1)
            value = cost[i, c] + (_solve(rest) if rest.size else 0.0)
            if abs(value - total) < 1e-9:
                picked.append(c)
                left, total = rest, total - cost[i, c]
                columns.remove(c)
                break
    return picked


def word_errors(rows: DataFrame, ref: str, hyp: str) -> DataFrame:
    """rows with errors (a struct of S, D, I) and ref_words of two array columns; both are token lists."""
    return with_edit_counts(rows, {"errors": (ref, hyp)}).withColumn("ref_words", F.size(ref).cast("long"))


def error_rate(s, d, i, total):
    return F.round(F.try_divide((s + d + i).cast("double"), total.cast("double")), 6)


def timing_errors(ref: list[dict], hyp: list[dict]) -> list[tuple[int, int]]:
    """(start error, end error) of equal aligned words."""
    ops = align([w["text"] for w in ref], [w["text"] for w in hyp])
    return [(abs(ref[i]["start_ms"] - hyp[j]["start_ms"]), abs(ref[i]["end_ms"] - hyp[j]["end_ms"])) for op, i, j in ops if op == "equal"]


def diarization_sums(events: DataFrame, by: list[str], mapping: DataFrame | None = None) -> DataFrame:
    """Milliseconds of reference, missed, false alarm and confusion over events(by, ms, ref, hyp: label arrays).

    mapping(by, hyp_label, ref_label) renames hypothesis labels first; without it labels are compared as they are.
    """
    rows = events
    if mapping is not None:
        m = mapping.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("hyp_label", "ref_label"))).alias("_map"))
        rows = rows.join(m, by, "left").withColumn("hyp", F.transform("hyp", lambda x: F.coalesce(F.element_at("_map", x), F.concat(F.lit("~"), x))))
    r, h, c = F.size("ref"), F.size("hyp"), F.size(F.array_intersect("ref", "hyp"))
    ms = F.col("ms")
    return rows.groupBy(*by).agg(
        F.sum(r * ms).alias("ref_ms"), F.sum(F.greatest(F.lit(0), r - h) * ms).alias("missed_ms"), F.sum(F.greatest(F.lit(0), h - r) * ms).alias("false_ms"),
        F.sum((F.least(r, h) - c) * ms).alias("confused_ms"),
    )


def duration_events(ref: DataFrame, hyp: DataFrame, by: list[str], label: str, bucket_ms: int) -> DataFrame:
    """(by, start_ms, end_ms, ms, ref, hyp): elementary segments with the labels active on either side."""
    from lorekeep.operators.intervals import segments

    tagged = ref.select(*by, "start_ms", "end_ms", F.concat(F.lit("r"), F.col(label).cast("string")).alias("_l")).unionByName(
        hyp.select(*by, "start_ms", "end_ms", F.concat(F.lit("h"), F.col(label).cast("string")).alias("_l"))
    )
    s = segments(tagged, by, "_l", bucket_ms)
    side = lambda k: F.transform(F.filter("active", lambda x: F.substring(x, 1, 1) == k), lambda x: F.substring(x, 2, 1_000_000))
    return s.select(*by, "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("ms"), side("r").alias("ref"), side("h").alias("hyp"))

