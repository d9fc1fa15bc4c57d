"""Growing event-stream files as a stream, and the frames of bytes.

    spark.dataSource.register(SseSource)
    spark.readStream.format("marginalia_sse").load(folder)

Rows are (stream, at, event, data): file name, byte offset of the frame, its event (``message`` if
none) and its data lines joined by line breaks. Comments, and frames without data or whose data
is not JSON, are skipped, as in ``golden.parse_sse``.

The offset of a batch is the size of each file. A frame belongs to the range of bytes that its ending
blank line ends in; a reader looks back from the begin of its range for the begin of that frame. So
an unfinished frame waits, whatever batch or restart comes between, and no frame is read twice.
Ranges of more than ``rangeBytes`` are cut by the same rule; a task reads as many ranges as make up
``taskBytes``, each counted with what opening a file costs, so tasks grow with bytes, not with files. With the option ``ended`` a last frame
without blank line counts too; it is for files that grow no more.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from marginalia.sources.files import file_system

_BLANK = re.compile(rb"\r?\n\r?\n")
#: Bytes that are looked back for at a time.
_BACK = 1 << 16
#: What opening a file counts for, in bytes.
_OPEN = 1 << 16


def frame_event(frame: str) -> tuple[str, str] | None:
    """(event, data) of the text of a frame; None if it is skipped."""
    event, data = "message", []
    for line in frame.splitlines():
        field, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if field == "event" and value:
            event = value
        elif field == "data":
            data.append(value)
    joined = "\n".join(data)
    try:
        json.loads(joined)
    except ValueError:
        return None
    return event, joined


def frames(known: fs.FileSystem, path: str, start: int, stop: int, ended: bool) -> Iterator[tuple[int, str]]:
    """(byte offset, text) of the frames that end in the bytes [start, stop) of a file."""
    with known.open_input_file(path) as file:
        at, head = start, b""
        while at and not any(m.end() <= len(head) and at + m.end() <= start for m in _BLANK.finditer(head)):
            step = min(_BACK, at)
            at -= step
            head = file.read_at(step, at) + head
        last = [m.end() for m in _BLANK.finditer(head) if at + m.end() <= start]
        begin = at + (last[-1] if last else 0)
        body = head[begin - at :] + file.read_at(stop - start, start)
        done = 0

        def framed(text: bytes) -> tuple[int, str]:
            bare = text.lstrip(b"\r\n")  # of more blank lines than one all belong to the end
            return begin + done + len(text) - len(bare), bare.decode("utf-8", "replace")

        for blank in _BLANK.finditer(body):
            if begin + blank.end() > start:
                yield framed(body[done : blank.start()])
            done = blank.end()
        if ended and stop == file.size():
            yield framed(body[done:])


class Range(InputPartition):
    """Bytes [start, stop) of a file."""

    def __init__(self, file: str, start: int, stop: int):
        self.file, self.start, self.stop = file, start, stop


class Ranges(InputPartition):
    """The ranges that one task reads."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.ended = options["path"], options.get("ended", "false").lower() == "true"
        self.range_bytes = int(options.get("rangebytes", 16 << 20))
        self.task_bytes = int(options.get("taskbytes", 16 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        known, root = file_system(self.root)
        found = known.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return {i.path[len(root) + 1 :]: i.size for i in found if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        held, cost = [], 0
        for file, stop in sorted(end.items()):
            for at in range(start.get(file, 0), stop, self.range_bytes):
                one = Range(file, at, min(at + self.range_bytes, stop))
                if held and cost + one.stop - at + _OPEN > self.task_bytes:
                    out.append(Ranges(held))
                    held, cost = [], 0
                held.append(one)
                cost += one.stop - at + _OPEN
        return [*out, Ranges(held)] if held else out

    def read(self, partition: Ranges) -> Iterator[tuple]:
        known, root = file_system(self.root)
        for one in partition.ranges:
            for at, text in frames(known, f"{root}/{one.file}", one.start, one.stop, self.ended):
                if (found := frame_event(text)) is not None:
                    yield one.file, at, *found


class SseSource(DataSource):
    """``format("marginalia_sse")``: frames of the files below the path, as they are written."""

    @classmethod
    def name(cls) -> str:
        return "marginalia_sse"

    def schema(self) -> str:
        return "stream string, at long, event string, data string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})
