"""A stream source of new and changed files.

Spark's file source takes a path once and never looks at it again. This
source puts the files of a folder in the order of (time of last change,
name); its offset is the position of the last file taken. A file that is
written again moves behind the position and comes again, with its new
fingerprint; a restart goes on from the position in the checkpoint and
repeats nothing.

A listing is walked entry by entry and only the ``maxFiles`` first entries
behind the position are held. A file counts once it has been left alone for
``settle`` seconds, so that files of one time stamp are all there when the
position passes them; a file that arrives with an older time of change (a
copy that keeps it) is not seen here, but by ``score_new_files``.
"""

from __future__ import annotations

import fnmatch
import heapq
import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "changed_files"
SCHEMA = "path string, filename string, length bigint, modificationTime timestamp, fingerprint string"

#: A file's place in the order: time of change in microseconds, name.
Place = tuple[int, str]


def walk(folder: str, pattern: str) -> Iterator[tuple[Place, str, int]]:
    """(place, path, bytes) of every file of a folder whose name fits."""
    if "://" not in folder or folder.startswith("file://"):
        base = folder.removeprefix("file://")
        with os.scandir(base) as entries:
            for e in entries:
                if fnmatch.fnmatchcase(e.name, pattern) and not e.name.startswith((".", "_")):
                    try:
                        s = e.stat()
                    except FileNotFoundError:  # gone since it was listed
                        continue
                    if e.is_file():
                        # whole milliseconds, as Spark's listings have them
                        yield (s.st_mtime_ns // 1_000_000 * 1000, e.name), f"file://{base.rstrip('/')}/{e.name}", s.st_size
        return
    from pyarrow import fs
    store, base = fs.FileSystem.from_uri(folder)
    for f in store.get_file_info(fs.FileSelector(base)):
        if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern) \
                and not f.base_name.startswith((".", "_")):
            yield (f.mtime_ns // 1_000_000 * 1000, f.base_name), f"{folder.rstrip('/')}/{f.base_name}", f.size


def following(folder: str, pattern: str, after: Place, limit: int, until: int) -> list[tuple[Place, str, int]]:
    """The first ``limit`` files behind a place that were last changed at
    ``until`` or before, in order."""
    return heapq.nsmallest(limit, (f for f in walk(folder, pattern) if f[0] > after and f[0][0] <= until))


class _Files(InputPartition):
    def __init__(self, files: list[tuple[Place, str, int]]):
        super().__init__(None)
        self.files = files


class ChangedFilesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.pattern = options.get("pattern", "*.csv")
        self.limit = int(options.get("maxfiles", options.get("maxFiles", "100")))
        self.settle = float(options.get("settle", "1"))
        self.at: Place = (-1, "")

    def initialOffset(self) -> dict:
        return {"modified": -1, "name": ""}

    def latestOffset(self, *args) -> dict:
        """The place of the last file of the next batch; the present one
        when there is nothing new."""
        until = int((time.time() - self.settle) * 1_000_000)
        found = following(self.folder, self.pattern, self.at, self.limit, until)
        if found:
            self.at = found[-1][0]
        return {"modified": self.at[0], "name": self.at[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, last = (start["modified"], start["name"]), (end["modified"], end["name"])
        self.at = max(self.at, last)
        files = [f for f in following(self.folder, self.pattern, after, self.limit, last[0]) if f[0] <= last]
        return [_Files(files[i:i + 1000]) for i in range(0, len(files), 1000)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import datetime as dt
        for (micros, name), path, size in partition.files:
            when = dt.datetime.fromtimestamp(micros / 1e6, dt.timezone.utc)
            yield path, name, size, when, f"{size}_{micros}"

    def commit(self, end: dict) -> None:
        self.at = max(self.at, (end["modified"], end["name"]))


class ChangedFiles(DataSource):
    """``spark.readStream.format("changed_files")`` with the options
    ``path``, ``pattern``, ``maxFiles`` and ``settle``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangedFilesReader(self.options)
