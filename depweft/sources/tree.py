"""A project tree as a table.

The built-in file source drops names that begin with a dot or underscore; this data source returns every file below a root that it
may enter: folders in a skip list are not entered when seeding, and links that lead out of the root are left out. The root
lies on storage that all executors reach.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from depweft.functions import fixed

SCHEMA = "path string, size bigint, mtime_ns bigint, seeded boolean, digest string, header binary, content binary, location string, error string"
#: Bytes up to which a file's content is held in its row; of larger ones the operators read at the location what they need.
MAX_CONTENT = 4 * 1024 * 1024
HEADER = 8192
#: Folders that the driver opens at most before it hands the others to tasks, and bytes of content that a task holds at once.
OPENED_FOLDERS, HELD_BYTES = 256, 32 * 1024 * 1024


class Part(InputPartition):
    """Files that are known already, and folders to be walked."""

    def __init__(self, files: list[tuple[str, bool]], folders: list[tuple[str, bool]]):
        self.files, self.folders = files, folders


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.realpath(options["path"])
        self.skip = set(options.get("skip", ",".join(fixed.SKIP_DIRS)).split(","))

    def _inside(self, folder: str, seeded: bool) -> tuple[list[tuple[str, bool]], list[tuple[str, bool]]]:
        """Files and folders of a folder."""
        files, folders = [], []
        with os.scandir(os.path.join(self.root, folder)) as entries:
            for e in sorted(entries, key=lambda e: e.name):
                rel = f"{folder}/{e.name}" if folder else e.name
                if e.is_symlink() and not os.path.realpath(e.path).startswith(self.root + os.sep):
                    continue
                if e.is_dir():
                    if not e.is_symlink():
                        folders.append((rel, seeded and e.name not in self.skip))
                elif e.is_file():
                    files.append((rel, seeded))
        return files, folders

    def partitions(self) -> list[Part]:
        """The driver opens the uppermost folders only; each folder below them is walked by a task."""
        files, todo, done = [], [("", True)], 0
        while todo and done < OPENED_FOLDERS:
            own, below = self._inside(*todo.pop(0))
            files += own
            todo += below
            done += 1
        return [Part(files, []), *(Part([], [f]) for f in todo)]

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from partition.files
        todo = list(partition.folders)
        while todo:
            try:
                files, folders = self._inside(*todo.pop())
            except OSError:  # a folder that went away or may not be entered
                continue
            yield from files
            todo += folders


class ProjectTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "project_tree"

    def schema(self) -> str:
        return "path string, seeded boolean"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def _row(full: str, most: int) -> tuple:
    """size, mtime_ns, digest, header, content, error of a file; it is read once, and held only up to most bytes."""
    try:
        stat = os.stat(full)
        h, head, kept = hashlib.sha256(), b"", []
        with open(full, "rb") as f:
            while block := f.read(1 << 20):
                h.update(block)
                head = head or block[:HEADER]
                if stat.st_size <= most:
                    kept.append(block)
    except OSError as e:
        return None, None, None, None, None, f"{type(e).__name__}: {e.strerror or 'unreadable'}"
    return stat.st_size, stat.st_mtime_ns, h.hexdigest(), head, b"".join(kept) if stat.st_size <= most else None, None


def read_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Every file below root: SCHEMA. Options: skip (folder names), maxContent (bytes held per row).

    A file that can't be read has an error and no digest. Names are listed by folder and then spread over all tasks, so that one
    folder with most of the files is read by all of them.
    """
    spark.dataSource.register(ProjectTree)
    base, most = os.path.realpath(root), int(options.get("maxContent", str(MAX_CONTENT)))
    names = spark.read.format("project_tree").options(**options).load(root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows, held = [], 0
            for path, seeded in zip(b["path"], b["seeded"]):
                location = os.path.join(base, path)
                size, mtime, digest, head, content, error = _row(location, most)
                rows.append((path, size, mtime, seeded, digest, head, content, None if error else location, error))
                held += len(content or b"") + HEADER
                if held > HELD_BYTES:
                    yield pd.DataFrame(rows, columns=columns).astype({"size": "Int64", "mtime_ns": "Int64"})
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns).astype({"size": "Int64", "mtime_ns": "Int64"})

    return names.repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInPandas(read, SCHEMA)
