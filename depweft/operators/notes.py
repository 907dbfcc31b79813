"""Notes on files: which are fresh, which are to be made, and what a model's answer holds."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweft.functions import fixed, keys

NOTE = "summary string, responsibilities array<string>, important_symbols array<string>, inputs_outputs string, notes string, limitations string"
TEXT_CHARS, ITEMS, ITEM_CHARS = 1800, 15, 220


def settings_hash(*settings) -> str:
    return hashlib.sha256(json.dumps(list(settings)).encode()).hexdigest()


def fresh_notes(nodes: DataFrame, notes: DataFrame) -> DataFrame:
    """Nodes with their valid note, if it was made from the node's present content: key, version, state, note_json.

    nodes: key, version. notes: one row per key with key, version, state, note_json."""
    done = notes.where((F.col("state") == "done") & F.col("note_json").isNotNull()).select("key", "version", "note_json")
    return nodes.select("key", "version").join(done, ["key", "version"], "left")


def plan_run(nodes: DataFrame, notes: DataFrame, settings: str, retry_failed: bool = False, max_files: int = 0) -> DataFrame:
    """Keys a run works on, deepest first, then by id; at most max_files of them unless that is 0.

    nodes: id, key, depth, version. A note with the same version and settings is left alone; a failed or skipped one is tried again
    only if asked.
    """
    kept = ["done"] if retry_failed else ["done", "failed", "skipped"]
    cached = notes.where((F.col("settings_hash") == settings) & F.col("state").isin(kept)).select("key", "version")
    todo = nodes.join(cached, ["key", "version"], "left_anti").orderBy(F.desc("depth"), "id")
    return todo.limit(max_files) if max_files else todo


def has_secrets(path: Column, text: Column) -> Column:
    """Whether a file must not be shown to a model, by its name or by what looks like a key in it."""
    return F.coalesce(path.rlike(fixed.SECRET_NAMES), F.lit(False)) | F.coalesce(keys.any_of(*(text.rlike(p) for p in fixed.SECRET_HINTS)), F.lit(False))


def prepared(files: DataFrame, edges: DataFrame, max_chars: int = 12_000, most_refs: int = 100) -> DataFrame:
    """What a model is given: path, code (bounded), truncated, references (the first in order, bounded).

    files: path, text. Files with secrets are left out. References are numbered per source before they are gathered, so at most
    most_refs are held for one file.
    """
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("source").orderBy("target", "relation"))
    refs = edges.select("source", "target", "relation", "evidence").withColumn("n", rank).where(F.col("n") <= most_refs)
    own = refs.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("n", "target", "relation", "evidence"))).alias("r"))
    shown = files.where(F.col("text").isNotNull() & ~has_secrets(F.col("path"), F.col("text")))
    joined = shown.select("path", "text").withColumn("source", F.concat(F.lit("file:"), "path")).join(own, "source", "left")
    names = F.coalesce(F.transform("r", lambda x: F.concat_ws(" ", x["relation"], x["target"])), F.array().cast("array<string>"))
    return joined.select("path", F.left("text", F.lit(max_chars)).alias("code"), (F.length("text") > max_chars).alias("truncated"), names.alias("references"))


def decode_answer(answer: Column) -> Column:
    """Note of a model's answer: code fences off, the outermost braces, known fields with bounds; null if there is no summary."""
    fence = "```"
    bare = F.regexp_replace(F.regexp_replace(F.trim(answer), rf"^{fence}(?i:json)?\s*", ""), rf"\s*{fence}$", "")
    first, last = F.instr(bare, "{"), F.length(bare) - F.instr(F.reverse(bare), "}") + 1
    braces = F.when((first > 0) & (last > first), F.substring(bare, first, last - first + 1))
    note = F.from_json(braces, NOTE)

    def text(name: str) -> Column:
        return F.coalesce(F.left(F.trim(note[name]), F.lit(TEXT_CHARS)), F.lit("")).alias(name)

    def items(name: str) -> Column:
        cut = F.transform(F.slice(note[name], 1, ITEMS), lambda v: F.left(F.trim(v), F.lit(ITEM_CHARS)))
        return F.coalesce(F.filter(cut, lambda v: v.isNotNull() & (v != "")), F.array().cast("array<string>")).alias(name)

    return F.when(F.trim(note["summary"]) != "", F.struct(text("summary"), items("responsibilities"), items("important_symbols"), text("inputs_outputs"), text("notes"), text("limitations")))


def annotate(todo: DataFrame, responder: Callable[[dict], dict]) -> DataFrame:
    """Runs a responder over prepared files: key, version, state, note_json, error. todo: key, version, code, truncated, references.

    A PermissionError makes a note skipped, any other error failed; neither stops the run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, version, code, cut, refs in zip(b["key"], b["version"], b["code"], b["truncated"], b["references"]):
                try:
                    note = responder({"file": key, "code": code, "truncated": bool(cut), "references": list(refs)})
                    if not isinstance(note, dict) or not note.get("summary"):
                        raise ValueError("the answer has no summary")
                    rows.append((key, version, "done", json.dumps(note, ensure_ascii=False), None))
                except PermissionError as e:
                    rows.append((key, version, "skipped", None, str(e)[:350]))
                except Exception as e:  # noqa: BLE001
                    rows.append((key, version, "failed", None, f"{type(e).__name__}: {e}"[:350]))
            yield pd.DataFrame(rows, columns=["key", "version", "state", "note_json", "error"])

    return todo.select("key", "version", "code", "truncated", "references").mapInPandas(run, "key string, version string, state string, note_json string, error string")
