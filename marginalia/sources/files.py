"""A byte sink: one file a row, written in two phases.

    spark.dataSource.register(FileSink)
    rows.select("file", "content").write.format("marginalia_files").mode("append").save(root)

``file`` is a path below ``root`` with ``/`` between its parts; folders are made as needed and a
file of that name is replaced. Paths that leave the root (absolute ones, ``..``, back slashes, empty
parts, null) are errors, as are null contents and two rows of one name.

Tasks write below ``root/_staging-<job>/<attempt>``. When all have ended the driver moves the files
of the attempts that count to their places; a failed job leaves nothing but what was there.
Attempts report their folder only, so nothing of a row reaches the driver but, while it is moved,
its name. ``root`` is a folder or a URI that ``pyarrow.fs`` knows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or URI, and the path there."""
    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(root)
    known, path = fs.FileSystem.from_uri(root)
    return known, path.rstrip("/")


def safe_path(file: str | None) -> str:
    """``file`` if it stays below its root, else ValueError."""
    if not file or "\\" in file or "\0" in file:
        raise ValueError(f"no path below the root: {file!r}")
    parts = file.split("/")
    if any(p in ("", ".", "..") for p in parts) or ":" in parts[0] or parts[0].startswith("_staging-"):
        raise ValueError(f"no path below the root: {file!r}")
    return file


@dataclass
class Attempt(WriterCommitMessage):
    """The folder that a task wrote to."""

    folder: str
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, root: str, schema: StructType):
        missing = {"file", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"the file sink needs the columns file and content, not {schema.names}")
        self.root, self.staging = root, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        known, root = file_system(self.root)
        folder, n = f"{root}/{self.staging}/{uuid.uuid4().hex}", 0
        made: set[str] = set()
        for row in iterator:
            path = f"{folder}/{safe_path(row.file)}"
            if row.content is None:
                raise ValueError(f"no content for {row.file!r}")
            if known.get_file_info(path).type != fs.FileType.NotFound:
                raise ValueError(f"two rows for {row.file!r}")
            parent = path.rpartition("/")[0]
            if parent not in made:
                known.create_dir(parent, recursive=True)
                made.add(parent)
            with known.open_output_stream(path) as out:
                out.write(bytes(row.content))
            n += 1
        return Attempt(folder, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        known, root = file_system(self.root)
        attempts = [m for m in messages if m is not None and m.files]
        done = f"{root}/{self.staging}/done"  # an empty mark for each name: finds two rows of one name in two tasks

        def listed(folder: str) -> Iterator[str]:
            for info in known.get_file_info(fs.FileSelector(folder, recursive=True)):
                if info.type == fs.FileType.File:
                    yield info.path[len(folder) + 1 :]

        for attempt in attempts if len(attempts) > 1 else []:
            for file in listed(attempt.folder):
                mark = f"{done}/{file}"
                if known.get_file_info(mark).type != fs.FileType.NotFound:
                    raise ValueError(f"two rows for {file!r}")
                known.create_dir(mark, recursive=True)

        def move(pair: tuple[str, str]) -> None:
            folder, file = pair
            target = f"{root}/{file}"
            known.create_dir(target.rpartition("/")[0], recursive=True)
            known.move(f"{folder}/{file}", target)

        pairs = ((a.folder, file) for a in attempts for file in listed(a.folder))
        with ThreadPoolExecutor(16) as pool:
            for part in batched(pairs, 4096):
                list(pool.map(move, part))
        self._clear(known, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*file_system(self.root))

    def _clear(self, known: fs.FileSystem, root: str) -> None:
        if known.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            known.delete_dir(f"{root}/{self.staging}")


class FileSink(DataSource):
    """``format("marginalia_files")``: the columns ``file`` and ``content`` as files below the path."""

    @classmethod
    def name(cls) -> str:
        return "marginalia_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("the file sink replaces files of a name; use mode append")
        return _Writer(self.options["path"], schema)
