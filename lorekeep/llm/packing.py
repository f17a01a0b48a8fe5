"""Order-preserving packing of documents into fixed windows by dynamic programming.

The documents of a partition form one stream of ids, in the order of its rows. Cuts may fall at the end of a document
(free), at the end of a sentence within one (a small penalty), and, where a stretch without either is longer than a 32nd
of a window, at steps of that inside it (a large penalty). Each window costs as much as 96 ids of padding, so that lengths
without padding (powers of two) don't multiply short windows. best[j] = penalty[j] + min over cuts i within a window before j of best[i] + padding.
Padding falls as i moves back, by one for each id, so the minimum of best[i] + position[i] over the sliding window is
kept in a monotone queue; lengths that are a power of two have no padding and are looked up apart. The stream is solved
in blocks; the last window of a block is carried into the next, so blocks leave no padding of their own.
"""

from __future__ import annotations

import functools
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import bounded, read
from lorekeep.llm.tokens import PIECES, default_tokenizer, encoder

#: Costs in ids of padding: a cut at a sentence, a cut inside one, and each window.
SENTENCE, INSIDE, WINDOW_COST = 4, 16, 96
BLOCK_IDS = 1 << 18


@functools.lru_cache(maxsize=2)
def _sentence_ends(path: str) -> np.ndarray:
    """For each id, whether its string ends a sentence or a line."""
    t = encoder(path).tokenizer
    ends = np.zeros(t.get_vocab_size(), bool)
    for token, i in t.get_vocab().items():
        ends[i] = token[-1:] in ".!?" or "Ċ" in token  # the byte-level sign for a line feed
    return ends


def choose_cuts(position: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Indices into position of the cuts of least cost; the first is 0 and the last len(position) - 1.

    position ascends strictly, from 0, by at most window a step. Of equal costs the latest start wins.
    """
    at, pen = position.tolist(), penalty.tolist()
    ends, starts, size = [], [], 1  # of windows whose length is a power of two
    while size < window:
        j = np.searchsorted(position, position - size)
        b = np.flatnonzero(position[np.minimum(j, len(position) - 1)] == position - size)
        ends.append(b)
        starts.append(j[b])
        size *= 2
    ends, starts = (np.concatenate([np.empty(0, np.int64), *x]) for x in (ends, starts))
    near = starts[np.argsort(ends, kind="stable")].tolist()
    upto = np.cumsum(np.bincount(ends, minlength=len(at))).tolist()
    best, back = [0.0] * len(at), [0] * len(at)
    queue = deque([0])
    pop, append = queue.pop, queue.append
    keep = [0.0] * len(at)  # best + position
    seen = 0
    for j in range(1, len(at)):
        p = at[j]
        low = p - window
        while at[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        cost = keep[i] + window - p
        last = upto[j]
        while seen < last:
            k = near[seen]
            seen += 1
            if best[k] < cost:
                cost, i = best[k], k
        cost += pen[j]
        best[j] = cost
        back[j] = i
        total = keep[j] = cost + p
        while queue and keep[queue[-1]] >= total:
            pop()
        append(j)
    cuts, j = [len(at) - 1], len(at) - 1
    while j:
        j = back[j]
        cuts.append(j)
    return cuts[::-1]


def _candidates(docs: list[tuple], ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and penalties of the cuts that docs (id, total, first, ids) allow."""
    ids = np.concatenate([d[3] for d in docs])
    kind = np.where(ends[ids], 1, 0).astype(np.int8)
    kind[np.cumsum([len(d[3]) for d in docs]) - 1] = 2
    at = np.concatenate(([0], np.flatnonzero(kind) + 1))
    cost = np.concatenate(([0.0], np.where(kind[at[1:] - 1] == 2, 0.0, float(SENTENCE))))
    step = max(1, window // 32)
    wide = np.flatnonzero(np.diff(at) > step)
    if len(wide):
        steps = (at[wide + 1] - at[wide] - 1) // step
        more = np.repeat(at[wide] - step * (np.cumsum(steps) - steps - 1), steps) + step * np.arange(steps.sum())
        at, cost = np.concatenate((at, more)), np.concatenate((cost, np.full(len(more), float(INSIDE))))
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    cost[1:] += WINDOW_COST
    return at, cost


NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


#: Remembered pieces of a worker that forgets them after each task.
FEW_PIECES = 50_000


def _packer(tokenizer: str, window: int, end_id: int, with_ids: bool, forget: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ends = encoder(tokenizer, FEW_PIECES if forget else PIECES), _sentence_ends(tokenizer)
        last = np.array([end_id], enc.dtype).tobytes()
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def solve(final: bool) -> pa.RecordBatch:
            nonlocal sequence, held
            at, cost = _candidates(held, ends, window)
            cuts = at[choose_cuts(at, cost, window)].tolist()
            if not final:
                cuts.pop()
            rows: list[tuple] = []
            k, begin = 0, 0  # the document that position `begin` opens
            for a, b in zip(cuts, cuts[1:], strict=False):
                p = a
                while p < b:
                    doc, total, first, ids = held[k]
                    stop = min(b, begin + len(ids))
                    part = ids[p - begin : stop - begin].astype("<u4").tobytes()
                    rows.append((doc, first + p - begin, stop - p, zlib.crc32(part), total, sequence, p - a, *((part,) if with_ids else ())))
                    p = stop
                    if p == begin + len(ids):
                        begin, k = p, k + 1
                sequence += 1
            rest = held[k:]
            if rest and cuts[-1] > begin:
                doc, total, first, ids = rest[0]
                rest[0] = (doc, total, first + cuts[-1] - begin, ids[cuts[-1] - begin :])
            held = [] if final else rest
            cols = list(zip(*rows, strict=True)) or [()] * (7 + with_ids)
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + ([pa.array(cols[7], pa.binary())] if with_ids else [])
            return pa.RecordBatch.from_arrays(arrays, names=[*NAMES, *(["ids"] if with_ids else [])])

        size = 0
        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), enc.ids(b.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(raw + last, enc.dtype)
                held.append((doc, len(ids), 0, ids))
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield solve(False)
                    size = sum(len(x[3]) for x in held)
        if held:
            yield solve(True)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            encoder.cache_clear()
            _sentence_ends.cache_clear()

    return alone if forget else run


def pack(docs: DataFrame, window: int = 1024, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = True, forget: bool = False) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ids are little-endian unsigned 32-bit. The order kept is that of the rows in each partition, which is not changed;
    the last window of a partition may be short. Sequence ids hold the partition's number in the upper half. Null text is
    empty: the document is its end id alone. A null doc_id stays null, repeated rows are packed each, an empty table
    gives an empty result, and columns other than doc_id and text are not read. With `forget` a worker remembers few pieces
    and drops them and the tokenizer after each task: for jobs in which packing is one stage and workers live on.
    """
    schema = ", ".join(f"{n} long" for n in NAMES) + (", ids binary" if with_ids else "")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(bounded(_packer(tokenizer or default_tokenizer(), window, end_id, with_ids, forget), 1), schema)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), with_ids=False)
