"""Speaker chunks of words as a stream: words wait until the watermark has passed them, then lengthen or cut the open run."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lorekeep.operators.segmentation import CHUNK_MS, CHUNK_WORDS

CHUNK = "episode long, chunk_id string, speaker string, start_ms long, end_ms long, n long, text string"
NAMES = [c.split(" ")[0] for c in CHUNK.split(", ")]
WORD = "word_id long, speaker string, text string, start_ms long, end_ms long, t long"
RUN = "t long, first long, last long, speaker string, least long, start_ms long, end_ms long, n long, text string"


class _Chunks(StatefulProcessor):
    def __init__(self, most_words: int, most_ms: int) -> None:
        self.most_words, self.most_ms = most_words, most_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", RUN)
        self.waiting = handle.getListState("waiting", WORD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        for frame in rows:
            part = frame[[c.split(" ")[0] for c in WORD.split(", ")]].astype(object)
            part = [tuple(None if pd.isna(x) else x for x in r) for r in part.itertuples(index=False)]
            if part:
                self.waiting.appendList(part)
                self.handle.registerTimer(int(max(r[5] for r in part)))
        yield pd.DataFrame(columns=NAMES)

    def _row(self, episode: int, run: tuple) -> tuple:
        _, first, last, speaker, least, _, end, n, text = run
        digest = hashlib.sha256(f"{episode}:{first}:{last}".encode()).hexdigest()
        return episode, digest[:24], speaker, least, end, n, text

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now, out = timerValues.getCurrentWatermarkInMs(), []
        run = tuple(self.open.get()) if self.open.exists() else None
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in held if r[5] <= now), key=lambda r: r[0])
        for word, speaker, text, start, end, t in due:
            cut = run and (speaker != run[3] or run[7] == self.most_words or max(end, run[6]) - run[5] > self.most_ms)
            if cut:
                out.append(self._row(key[0], run))
            if run is None or cut:
                run = (t, word, word, speaker, start, start, end, 1, text or "")
            else:
                run = (run[0], run[1], word, speaker, min(run[4], start), run[5], max(run[6], end), run[7] + 1, f"{run[8]} {text}" if text is not None else run[8])
        if due:
            later = [r for r in held if r[5] > now]
            self.waiting.put(later) if later else self.waiting.clear()
        if run and run[0] + self.most_ms <= now:  # a word that is still to come would end too late for it
            out.append(self._row(key[0], run))
            run = None
        if run:
            self.open.update(run)
            self.handle.registerTimer(int(run[0] + self.most_ms))
        else:
            self.open.clear()
        yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def chunk_stream(words: DataFrame, late: str = "1 hour", most_words: int = CHUNK_WORDS, most_ms: int = CHUNK_MS) -> DataFrame:
    """text_chunks' rows of a stream words(episode, word_id, speaker, text, start_ms, end_ms, ts), each once it is closed.

    ts is the word's start on the clock: start_ms and a constant of the episode, ascending with word_id. Words may come in
    any order within `late`; later ones are dropped. A run closes at a change of speaker, at the caps, or when the
    watermark lies most_ms behind its first word, since no word to come could join it. State is one open run of at most
    most_words words an episode, and the words that still wait. Needs the RocksDB state store.
    """
    timed = words.withColumn("t", F.unix_millis("ts")).withWatermark("ts", late)
    return timed.groupBy("episode").transformWithStateInPandas(_Chunks(most_words, most_ms), CHUNK, "Append", "EventTime")
