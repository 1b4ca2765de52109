"""A data source of server-sent events: dumps of a stream in files that may still grow, read as a table or as a stream that resumes at its offset.

An offset is how far each file has been read, in bytes, and always stands behind a whole frame, so a torn last frame is read once it is whole. Files are
listed and measured on the driver, and read in ranges by the executors, with any file system that pyarrow opens.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a file that are one partition, up to the frame's end.
RANGE = 64 << 20
END = b"\n\n"
SCHEMA = "file string, at long, event string, data string"


def _opened(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def whole_sizes(path: str, known: dict[str, int]) -> dict[str, int]:
    """How far the frames of each file are whole: behind its last END. Only what follows ``known`` is looked at."""
    from pyarrow import fs

    system, folder = _opened(path)
    out = {}
    for f in system.get_file_info(fs.FileSelector(folder)):
        name = f.path.rsplit("/", 1)[-1]
        if not f.is_file or name.startswith((".", "_")):
            continue
        least, at, tail = known.get(name, 0), f.size, b""
        out[name] = least
        with system.open_input_file(f.path) as held:
            while at > least:
                step = max(least, at - (1 << 16))
                held.seek(step)
                tail = held.read(at - step) + tail[: len(END) - 1]
                found = tail.rfind(END)
                if found >= 0:
                    out[name] = step + found + len(END)
                    break
                at = step
    return out


def frames_of(text: bytes, at: int) -> Iterator[tuple[int, str, str]]:
    """(offset, event, data) of whole frames. Data of several lines are joined; a frame without a name is a message, and comments are left out."""
    for frame in text.split(END)[:-1]:
        event, data = "message", []
        for line in frame.decode("utf-8", "replace").split("\n"):
            name, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if name == "event":
                event = value
            elif name == "data":
                data.append(value)
        if data:
            yield at, event, "\n".join(data)
        at += len(frame) + len(END)


class Piece(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


class _Frames:
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("range", RANGE))

    def pieces(self, start: dict[str, int], end: dict[str, int]) -> list[Piece]:
        return [Piece(n, at, min(at + self.range, e)) for n, e in sorted(end.items()) for at in range(start.get(n, 0), e, self.range)]

    def read(self, partition: Piece | None) -> Iterator[tuple]:
        """The frames that begin in the range: from the first END at or behind its start, but for the file's beginning, to the END of the last. Without a whole frame anywhere Spark
        passes no range."""
        if partition is None:
            return
        system, folder = _opened(self.path)
        with system.open_input_file(f"{folder.rstrip('/')}/{partition.name}") as held:
            at = partition.start
            if partition.start:  # a frame begins here if END stands before it
                at = max(0, partition.start - len(END))
            held.seek(at)
            text = held.read(partition.end - at)
            if partition.start:
                found = text.find(END)
                if found < 0:
                    return
                at, text = at + found + len(END), text[found + len(END) :]
            while text and not text.endswith(END):
                more = held.read(1 << 16)
                if not more:
                    break
                joined = len(text)
                text += more
                found = text.find(END, max(0, joined - len(END) + 1))
                if found >= 0:
                    text = text[: found + len(END)]
                    break
            for offset, event, data in frames_of(text, at):
                if offset < partition.end:
                    yield partition.name, offset, event, data


class FramesReader(_Frames, DataSourceReader):
    def partitions(self) -> list[Piece]:
        return self.pieces({}, whole_sizes(self.path, {}))


class FramesStream(_Frames, DataSourceStreamReader):
    seen: dict[str, int] = {}  # noqa: RUF012  replaced, never changed

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        self.seen = whole_sizes(self.path, self.seen)
        return {"files": json.dumps(self.seen, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return self.pieces(json.loads(start["files"]), json.loads(end["files"]))

    def commit(self, end: dict) -> None:
        """Nothing is held until then: the offset is in the stream's checkpoint."""


class FramesSource(DataSource):
    """Option path: a folder of files of frames; range: bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FramesReader:
        return FramesReader(self.options)

    def streamReader(self, schema) -> FramesStream:
        return FramesStream(self.options)


def register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(FramesSource)
