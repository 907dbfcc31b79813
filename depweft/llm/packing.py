"""Filling containers of fixed capacity with whole texts.

Texts are range-sorted by their key on a Hilbert curve through their projected hashed vectors, with all bits of the key and the
hash of the text behind it, so that each task has one stretch of the curve, however many texts share a key. A task walks along its
stretch and packs neighbours best-fit, a window at a time, for all capacities at once. A text is cut only if it alone exceeds the
capacity: its full parts each fill a container, and the rest is packed like any text.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweft.llm.docvectors import TOKENIZERS, measured
from depweft.session import cut

#: Texts per stretch of the curve; a stretch is packed in one task, which holds no more than a window of it.
BLOCK_ROWS = 20_000
#: Neighbours along the curve that are packed at once, largest first, and containers that stay open meanwhile.
WINDOW, OPEN = 1024, 256

SCHEMA = "pack_name string, container_id string, doc_id bigint, part int, n_parts int, start_token bigint, n_tokens bigint"


class Packer:
    """Containers of one capacity, filled window by window. Best-fit, largest first; the containers with least room are closed first
    when more than most_open stand open after a window."""

    def __init__(self, capacity: int, most_open: int = OPEN):
        self.capacity, self.most_open, self.used = capacity, most_open, 0
        self.room: list[tuple[int, int]] = []  # (free, container), by free

    def window(self, sizes: list[int]) -> list[int]:
        """Container number of each size; none may exceed the capacity."""
        out = [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            at = bisect_left(self.room, (sizes[i], -1))
            if at < len(self.room):
                free, c = self.room.pop(at)
            else:
                free, c = self.capacity, self.used
                self.used += 1
            out[i] = c
            if free > sizes[i]:
                insort(self.room, (free - sizes[i], c))
        if len(self.room) > self.most_open:
            del self.room[: len(self.room) - self.most_open]
        return out


def pack(sizes: list[int], capacity: int, window: int = WINDOW, most_open: int = OPEN) -> list[int]:
    """Container number of each size, in order of the curve."""
    packer = Packer(capacity, most_open)
    return [c for first in range(0, len(sizes), window) for c in packer.window(sizes[first : first + window])]


def containers(documents: DataFrame, pack_sizes: DataFrame, folder: str = TOKENIZERS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Which text lies in which container, for each capacity: SCHEMA.

    One row per part of a text; texts within the capacity have one part. Null, empty and other texts without tokens need no
    room and come out with a null container. Capacities that are null or below 1 are no packs. A doc_id given twice is
    packed twice. Ties along the curve are ordered by a hash of doc_id and text.
    """
    spark = documents.sparkSession
    packs = sorted((r["pack_name"], int(r["capacity_tokens"])) for r in pack_sizes.where("capacity_tokens >= 1 AND pack_name IS NOT NULL").distinct().collect())  # a fixed table of a few rows
    if not packs:
        return spark.createDataFrame([], SCHEMA)
    items = cut(measured(documents, ["doc_id"], folder).select("doc_id", "n_tokens", "curve", F.xxhash64("doc_id", "text_hash").alias("tie")))
    stretches = max(1, -(-items.count() // block_rows))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        packers = [(name, capacity, Packer(capacity)) for name, capacity in packs]
        whole = dict.fromkeys(range(len(packs)), 0)
        for b in batches:
            for first in range(0, len(b), WINDOW):
                w = b.iloc[first : first + WINDOW]
                doc, n = w["doc_id"].to_numpy(), w["n_tokens"].to_numpy()
                for p, (name, capacity, packer) in enumerate(packers):
                    full, rest = n // capacity, n % capacity
                    parts = np.maximum(full + (rest > 0), 1)
                    at = np.flatnonzero(rest)
                    ids = [f"{task}-{c}" for c in packer.window(rest[at].tolist())]
                    yield pd.DataFrame({"pack_name": name, "container_id": ids, "doc_id": doc[at], "part": full[at].astype(np.int32), "n_parts": parts[at].astype(np.int32), "start_token": full[at] * capacity, "n_tokens": rest[at]})
                    if full.any():
                        own = np.repeat(np.arange(len(n)), full)
                        part = np.arange(len(own)) - np.repeat(np.cumsum(full) - full, full)
                        ids = [f"{task}-f{whole[p] + i}" for i in range(len(own))]
                        whole[p] += len(own)
                        yield pd.DataFrame({"pack_name": name, "container_id": ids, "doc_id": doc[own], "part": part.astype(np.int32), "n_parts": parts[own].astype(np.int32), "start_token": part * capacity, "n_tokens": np.full(len(own), capacity)})
                    none = np.flatnonzero(n == 0)
                    if len(none):
                        yield pd.DataFrame({"pack_name": name, "container_id": pd.Series([None] * len(none), dtype=object), "doc_id": doc[none], "part": np.int32(0), "n_parts": np.int32(1), "start_token": 0, "n_tokens": 0})

    sorted_items = items.repartitionByRange(stretches, "curve", "tie").sortWithinPartitions("curve", "tie", "doc_id")
    return sorted_items.select("doc_id", "n_tokens").mapInPandas(walk, SCHEMA)


def fill_report(packed: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """Per pack: containers, tokens, and the share of the room that is used."""
    sizes = pack_sizes.where("capacity_tokens >= 1").select("pack_name", "capacity_tokens").distinct()
    placed = packed.where(F.col("container_id").isNotNull())
    per_container = placed.groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    totals = per_container.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("most"), F.sum("n").alias("n_parts"))
    return totals.join(sizes, "pack_name").withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))
