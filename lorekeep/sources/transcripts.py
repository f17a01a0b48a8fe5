"""RTTM and SRT as data sources of Spark: spark.read.format("rttm").load(folder), df.write.format("srt").save(folder).

Reading deals byte ranges of the files out; a record belongs to the range in which it begins. Writing is in two phases:
each task writes a file of its own into a staging folder, and only when all have succeeded the driver moves the files that
the tasks named into place and writes the list of them last. A task that is lost, or runs twice, leaves a file that nobody
named; what isn't in the list is not read.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of a range, at most.
RANGE = 32 << 20
LISTED = "_files.json"
_TIME = re.compile(r"(\d+):(\d\d):(\d\d)[,.](\d{3}) --> (\d+):(\d\d):(\d\d)[,.](\d{3})\s*\Z")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class _Range(InputPartition):
    file: str
    start: int
    end: int


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    rows: int


def _ms(seconds: str) -> int:
    whole, _, part = seconds.partition(".")
    return int(whole) * 1000 + int((part + "000")[:3])


def _rttm_row(record: str) -> tuple | None:
    f = record.split(" ")
    if f[0] != "SPEAKER" or len(f) < 8:
        raise ValueError(f"not a line of RTTM: {record[:80]!r}")
    start = _ms(f[3])
    return f[1], f[7], start, start + _ms(f[4])


def _srt_row(record: str) -> tuple | None:
    lines = record.split("\n")
    m = _TIME.match(lines[1]) if len(lines) > 1 else None
    if not m or not lines[0].strip().isdigit():
        raise ValueError(f"not a cue: {record[:80]!r}")
    t = [int(x) for x in m.groups()]
    return int(lines[0]), ((t[0] * 60 + t[1]) * 60 + t[2]) * 1000 + t[3], ((t[4] * 60 + t[5]) * 60 + t[6]) * 1000 + t[7], "\n".join(lines[2:])


def _clock(ms: int) -> str:
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"


def _rttm_text(r) -> str:
    if any(" " in str(x) or "\n" in str(x) for x in (r.episode, r.speaker)):
        raise ValueError(f"a name in RTTM holds no white space: {r.episode!r}, {r.speaker!r}")
    span = r.end_ms - r.start_ms
    return f"SPEAKER {r.episode} 1 {r.start_ms // 1000}.{r.start_ms % 1000:03d} {span // 1000}.{span % 1000:03d} <NA> <NA> {r.speaker} <NA> <NA>\n"


def _srt_text(r) -> str:
    if "\n\n" in r.text or not r.text.strip("\n"):
        raise ValueError(f"the text of cue {r.n} is empty or holds an empty line")
    return f"{r.n}\n{_clock(r.start_ms)} --> {_clock(r.end_ms)}\n{r.text}\n\n"


#: Of each form: schema, what ends a record, reader and writer of one.
FORMS = {
    "rttm": ("episode string, speaker string, start_ms bigint, end_ms bigint", b"\n", _rttm_row, _rttm_text),
    "srt": ("n bigint, start_ms bigint, end_ms bigint, text string", b"\n\n", _srt_row, _srt_text),
}


class _Reader(DataSourceReader):
    def __init__(self, form: str, path: str, size: int) -> None:
        self.form, self.path, self.size = form, path, size

    def partitions(self) -> list[_Range]:
        from pyarrow import fs

        store, root = _store(self.path)
        listed = store.get_file_info(f"{root}/{LISTED}")
        if listed.type == fs.FileType.File:
            with store.open_input_stream(f"{root}/{LISTED}") as f:
                files = [(f"{root}/{x['file']}", x["bytes"]) for x in json.loads(f.read())]
        else:  # written by others: every file of this kind
            found = store.get_file_info(fs.FileSelector(root, recursive=True))
            files = [(x.path, x.size) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.path.endswith(f".{self.form}") and "/_" not in x.path[len(root) :]]
        return [_Range(f, s, min(s + self.size, n)) for f, n in files for s in range(0, n, self.size)] or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        _, mark, row, _ = FORMS[self.form]
        if not part.file:
            return
        store, _ = _store(self.path)
        with store.open_input_file(part.file) as f:
            # begins after the first end of a record at or before the range's first byte
            at = max(part.start - len(mark), 0)
            f.seek(at)
            held, begun = b"", part.start == 0
            while True:
                got = f.read(1 << 20)
                held += got
                if not begun:
                    cut = held.find(mark)
                    if cut < 0:
                        if not got:
                            return
                        at, held = at + len(held) - len(mark) + 1, held[-len(mark) + 1 :] if len(mark) > 1 else b""
                        continue
                    held, at, begun = held[cut + len(mark) :], at + cut + len(mark), True
                while (cut := held.find(mark)) >= 0 or (not got and held):
                    if at >= part.end:
                        return
                    cut = cut if cut >= 0 else len(held)
                    record, held, at = held[:cut], held[cut + len(mark) :], at + cut + len(mark)
                    text = record.decode("utf-8").strip("\n")
                    if text:
                        yield row(text)
                if not got or at >= part.end:
                    return


class _Writer(DataSourceWriter):
    def __init__(self, form: str, path: str, overwrite: bool) -> None:
        self.form, self.path, self.overwrite = form, path, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> _Written:
        store, root = _store(self.path)
        store.create_dir(f"{root}/{self.staging}", recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.{self.form}", 0
        with store.open_output_stream(f"{root}/{self.staging}/{name}") as f:
            for r in rows:
                f.write(FORMS[self.form][3](r).encode("utf-8"))
                n += 1
        return _Written(name if n else None, n)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        before = []
        if store.get_file_info(f"{root}/{LISTED}").type == fs.FileType.File:
            with store.open_input_stream(f"{root}/{LISTED}") as f:
                before = json.loads(f.read())
        made = []
        for m in messages:
            if m is not None and m.file:
                store.move(f"{root}/{self.staging}/{m.file}", f"{root}/{m.file}")
                made.append({"file": m.file, "rows": m.rows, "bytes": store.get_file_info(f"{root}/{m.file}").size})
        with store.open_output_stream(f"{root}/{self.staging}.json") as f:
            f.write(json.dumps([*([] if self.overwrite else before), *made]).encode())
        store.move(f"{root}/{self.staging}.json", f"{root}/{LISTED}")  # from here on the new files are read
        if self.overwrite:
            for x in before:
                store.delete_file(f"{root}/{x['file']}")
        self._clear(store, root)

    def abort(self, messages: list) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


class _Transcripts(DataSource):
    form = ""

    @classmethod
    def name(cls) -> str:
        return cls.form

    def schema(self) -> str:
        return FORMS[self.form][0]

    def reader(self, schema) -> _Reader:
        return _Reader(self.form, self.options["path"], int(self.options.get("range", RANGE)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        want = [c.split(" ")[0] for c in FORMS[self.form][0].split(", ")]
        if schema.names != want:
            raise ValueError(f"{self.form} takes the columns {', '.join(want)}")
        return _Writer(self.form, self.options["path"], overwrite)


class RttmSource(_Transcripts):
    """episode, speaker, start_ms, end_ms: a line each. Names hold no white space; a line of another kind raises."""

    form = "rttm"


class SrtSource(_Transcripts):
    """n, start_ms, end_ms, text: a cue each. A text holds no empty line; what is no cue raises."""

    form = "srt"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RttmSource)
    spark.dataSource.register(SrtSource)
