"""Bytes of files: held in a column while they are small, read where they lie beyond that."""

from __future__ import annotations

import mmap
import os
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = {"content": "binary", "location": "string", "header": "binary"}
#: Bytes read at once of a large text, and characters that two pieces of one line share.
PIECE, SHARED = 256 * 1024, 4096


@contextmanager
def opened(content, location) -> Iterator[bytes | mmap.mmap]:
    """A file's bytes for slicing: its content, or a map of the file at its location, of which only what is looked at is read."""
    if content is not None:
        yield bytes(content)
        return
    with open(location, "rb") as f:
        if not os.fstat(f.fileno()).st_size:
            yield b""
            return
        with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as view:
            yield view


def located(files: DataFrame) -> DataFrame:
    """path, content, location, header of the files whose bytes are known; missing columns are null."""
    missing = {n: F.lit(None).cast(t) for n, t in COLUMNS.items() if n not in files.columns}
    return files.withColumns(missing).where(F.col("content").isNotNull() | F.col("location").isNotNull()).select("path", *COLUMNS)


def start_of(content: str = "content", header: str = "header") -> Column:
    """The first bytes of a file, held or not."""
    return F.coalesce(F.col(content), F.col(header))


def line_pieces(read, size: int = PIECE, shared: int = SHARED) -> Iterator[str]:
    """A stream of bytes as texts of bounded length that end with a line where they can. Of a line that is longer, each further piece
    begins with a NUL, so that it passes for no line's start, and repeats the end of the one before."""
    rest, inside = b"", False
    while block := read(size):
        data = rest + block
        end = data.rfind(b"\n") + 1
        if end:
            yield ("\0" if inside else "") + data[:end].decode("utf-8", "replace")
            rest, inside = data[end:], False
        elif len(data) > size:
            yield ("\0" if inside else "") + data.decode("utf-8", "replace")
            rest, inside = data[-shared:], True
        else:
            rest = data
    if rest:
        yield ("\0" if inside else "") + rest.decode("utf-8", "replace")


def text_pieces(files: DataFrame) -> DataFrame:
    """path, text: pieces of the files that have a location only; see line_pieces."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, location in zip(b["path"], b["location"]):
                with open(location, "rb") as f:
                    for text in line_pieces(f.read):
                        yield pd.DataFrame({"path": [path], "text": [text.removeprefix("﻿")]})

    return located(files).where(F.col("content").isNull()).select("path", "location").mapInPandas(read, "path string, text string")
