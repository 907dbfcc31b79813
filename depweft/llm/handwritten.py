"""Which source files were not written by hand.

A file is out if a tool writes it, if it was shrunk for delivery, if it is a copy of third-party code, or if it is bulk data in the
form of code. Each text is lexed, re-emitted in a canonical layout and held against its own layout: extreme expansion marks
shrunk files, uniformity marks generated ones (with numbered names, or near perfect over many repetitions), dominance of literals
marks data. What a file's comments say of its origin and where it lies count beside that; for files without text the path alone
decides. Copies of library files are found by their shingles: a filter of the library's shingles lets pass only texts that have four
fifths of theirs in it, and these meet the library by an equi-join on their rarest ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweft.llm.lexing import layout
from depweft.session import cut, spread

#: Fields of Verdicts.
FLAGS = ("layout", "comment", "shrunk", "data", "by_hand")

#: Lines of the canonical layout per line of the file, from which on it counts as shrunk.
EXPANSION = 8.0
#: Share of lines repeated in shape, and of lines with running numbers in a name, from which on a file counts as generated.
UNIFORM, NUMBERED = 0.7, 0.6
#: Share of lines repeated in shape from which on a file with many repetitions counts as generated, numbers or not.
REPEATED = 0.9
#: Share and number of characters in literals from which on a file counts as data.
LITERALS, LITERAL_CHARS = 0.75, 200
#: Words per shingle and similarity from which on a file counts as a copy of a library file.
SHINGLE, SIMILAR = 5, 0.8
#: Bits of the filter of library shingles: sixteen for each, up to 2^29 (64 MB, broadcast). A library of more than 33 million shingles
#: only lets more texts through to the join; the result is the same.
FILTER_BITS = 29
#: Shingles of library files held at once where a library is compared within one process.
BLOCK_SHINGLES = 2_000_000

# Folders for third-party code and for tools' output, and file names that tools give.
VENDOR_FOLDERS = ["vendor", "node_modules", "bower_components", "jspm_packages", "third_party", "third-party", "thirdparty", "3rdparty", "extern", "Pods", "Carthage", "site-packages", "dist-packages", "deps", "vendored"]
OUTPUT_FOLDERS = ["generated", "generated-sources", "__generated__", "generated-src", "gen-src", "dist", "build"]
OUTPUT_NAMES = [r"_pb2(_grpc)?\.pyi?", r"\.pb\.(go|cc|h)", r"\.g(\.i)?\.cs", r"\.[Dd]esigner\.cs", r"[._-]autogen\.\w+", r"\.generated\.\w+", r"_generated\.\w+", r"_gen\.go", r"\.g\.dart"]
OUTPUT_STARTS = [r"zz_generated[._]", r"moc_"]
SHRUNK_NAMES = [r"[.-]min\.(js|css|mjs)", r"\.bundle\.(js|css)", r"\.chunk\.(js|css)", r"[.-][0-9a-f]{8,20}\.(js|css)"]

VENDOR_PATH = r"[/:](" + "|".join(re.escape(x) for x in VENDOR_FOLDERS) + ")/"
OUTPUT_PATH = r"[/:](" + "|".join(re.escape(x) for x in OUTPUT_FOLDERS) + ")/|(" + "|".join(OUTPUT_NAMES) + r")$|[/:](" + "|".join(OUTPUT_STARTS) + r")[^/]*$"
SHRUNK_PATH = "(" + "|".join(SHRUNK_NAMES) + ")$"

# What comments say of a file's origin, in the four languages of the tables: that a tool made it, that it must be left alone, or that
# people keep it. Statements are told from mere mentions by where they stand, at the start of a comment or of a sentence in it.
_MADE = re.compile(
    r"\b(auto[- ]?generated|generated|auto[- ]?generad[oa]|autogenerado|generad[oa]|produced|emitted|created|written|compiled|built|output|producid[oa]|cread[oa] por|"
    r"produit|généré|engendré|créé par|erzeugt|generiert|erstellt)\b",
    re.I,
)
_START = r"(?:^|(?<=[.!\n]))[\s/*#<!;%\-\"']*"
_BY_TOOL = re.compile(
    rf"@generated\b|<auto-?generated|\bauto[- ]?generated (file|code)\b|\b(generated|compiled|produced) from (reading \S+|\S+ (by|with|using) )|\bautogenerado\b|{_START}(this (file|code|module|class|source|header) (is|was|has been) )?(a |an )?(automatically |auto[- ]?|machine[- ])?"
    rf"(generated|created|produced|compiled|made|written)( \w+)? (by|with|using|from) |{_START}(this is )?(a |an )[\w -]{{3,40}},? (made|generated|produced) by |{_START}this is an? (automatically |auto[- ]?)?generated (file|code)|{_START}output of \w+|"
    rf"{_START}(este|esta) (archivo|fichero|código|clase) (es|fue|ha sido|está) generad[oa] |{_START}(ce fichier|ce code) (est|a été) (généré|produit) |{_START}diese datei (wird|wurde) .{{0,40}}(erzeugt|generiert)",
    re.I,
)
_HANDS_OFF = re.compile(
    r"\b(do not|don't|never|must not|should not) (be )?(edit|modif|chang|touch)|\b(manual )?(changes|edits|modifications) (will be|are|get) (lost|overwritten|discarded)|overwritten (on|by|at)|\b(edit|change) (the )?(source|template|schema|original)|\bregenerate\b|"
    r"\bno (lo |la )?(editar|edite|modificar|modifique|tocar|toque)|cambios se (pierden|perderán|sobrescriben)|\bne (pas|jamais) (le |la )?(modifier|éditer|toucher)|nicht (von hand )?(bearbeiten|ändern|editieren)|änderungen gehen verloren",
    re.I,
)
_BY_HAND = re.compile(
    r"\bnot (auto[- ]?)?generated\b|\bgenerated (only )?once\b|\bno longer (auto[- ]?)?generated\b|(?<!not )(?<!n't )\b(maintained|edited|written|kept|changed|updated)( \w+){0,2} by hand\b|\bhand[- ](written|maintained|edited|crafted)|\bmanually (maintained|edited|written)|\b(safe|free|fine) to edit\b|"
    r"\b(edita|editado|editada|mantenido|mantenida|mantiene|escrito|escrita) a mano|\bno (es|está|fue) generad[oa]|\bya no se genera|\bgenerad[oa] una (sola )?vez|généré une (seule )?fois|(maintenu|modifié|écrit)e? à la main|(nur )?einmal(ig)? (erzeugt|generiert)|\b(wird|von) hand (gepflegt|geschrieben|bearbeitet)|nicht mehr generiert",
    re.I,
)


def origin(comments: list[str]) -> str:
    """'tool', 'hand' or '' by what the comments say; of several statements that of a person counts."""
    said = ""
    for c in comments:
        if _BY_HAND.search(c):
            return "hand"
        if _BY_TOOL.search(c) or (_HANDS_OFF.search(c) and _MADE.search(c)):
            said = "tool"
    return said


_WORD = re.compile(r"\w+")


def shingles(text: str) -> set[str]:
    words = _WORD.findall(text.lower())
    return {" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def library_blocks(library: DataFrame) -> list[tuple[dict[str, list[int]], dict[int, int]]]:
    """(shingle to library files, number of shingles per file), in blocks of bounded size: a library held in the process, for copied(),
    which the tests hold copies() against."""
    blocks: list[tuple[dict, dict]] = [({}, {})]
    for n, row in enumerate(library.where(F.col("text").isNotNull()).select("text").toLocalIterator()):
        own = shingles(row["text"])
        if not own:
            continue
        if blocks[-1][0] and len(blocks[-1][0]) + len(own) > BLOCK_SHINGLES:
            blocks.append(({}, {}))
        index, sizes = blocks[-1]
        sizes[n] = len(own)
        for s in own:
            index.setdefault(s, []).append(n)
    return blocks


def copied(text: str, index: dict[str, list[int]], sizes: dict[int, int]) -> bool:
    """Whether text is a library file with slight changes: similar by its set of shingles, or a part of it for the most."""
    own = shingles(text)
    if not own:
        return False
    common: dict[int, int] = {}
    for s in own:
        for n in index.get(s, ()):
            common[n] = common.get(n, 0) + 1
    return any(c >= SIMILAR * (len(own) + sizes[n] - c) or c >= SIMILAR * len(own) and len(own) >= 8 for n, c in common.items())


def judge(path: str, text: str, index: dict | None = None, sizes: dict | None = None) -> tuple[bool, bool, bool, bool, bool]:
    """(generated, shrunk, copied, data, kept by hand) of one text, copies by a library held in the process."""
    v = verdicts(path, text)
    return v.layout or v.comment, v.shrunk, bool(index) and copied(text, index, sizes), v.data, v.by_hand


class Verdicts(NamedTuple):
    """What a text says of itself: generated by its layout, by its comments; shrunk; data; kept by hand by its comments."""

    layout: bool
    comment: bool
    shrunk: bool
    data: bool
    by_hand: bool


def verdicts(path: str, text: str) -> Verdicts:
    m = layout(path, text)
    said = origin(m.comments)
    shrunk = m.expansion >= EXPANSION
    uniform = said == "" and not shrunk and (m.repeated >= REPEATED or m.uniformity >= UNIFORM and m.numbered >= NUMBERED)
    return Verdicts(uniform, said == "tool", shrunk, m.literal_share >= LITERALS and m.literal_chars >= LITERAL_CHARS, said == "hand")


# ---- copies of library files, by joins ------------------------------------------------------------------------------

_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(SHINGLE)], np.uint64)
_WORD_HASHES: dict[str, int] = {}


def _word_hash(word: str) -> int:
    h = _WORD_HASHES.get(word)
    if h is None:
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(_WORD_HASHES) < 500_000:
            _WORD_HASHES[word] = h
    return h


def shingle_hashes(text: str) -> np.ndarray:
    """The different shingles of a text as 64-bit numbers, ascending."""
    words = _WORD.findall(text.lower())
    if len(words) < SHINGLE:
        return np.zeros(0, np.int64)
    h = np.array([_word_hash(w) for w in words], np.uint64)
    mixed = sum((h[i : len(h) - SHINGLE + 1 + i] * _POWERS[i] for i in range(SHINGLE)), np.zeros(len(h) - SHINGLE + 1, np.uint64))
    mixed ^= mixed >> np.uint64(29)
    return np.unique((mixed * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))


def library_postings(library: DataFrame) -> DataFrame:
    """lib, n, h: each different library text with the number of its shingles and one row per shingle."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lib, text in zip(b["lib"], b["text"]):
                own = shingle_hashes(text)
                yield pd.DataFrame({"lib": np.full(len(own), lib, np.int64), "n": np.full(len(own), len(own), np.int32), "h": own})

    texts = library.where(F.col("text").isNotNull()).select("text").distinct().select(F.xxhash64("text").alias("lib"), "text")
    return texts.mapInPandas(read, "lib bigint, n int, h bigint")


def shingle_filter(postings: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the library's shingles, and their number as a power of two: an aggregation, whose result is bounded by FILTER_BITS."""
    n = postings.select(F.approx_count_distinct("h")).first()[0]
    bits = min(FILTER_BITS, max(10, int(16 * n + 1).bit_length()))
    slot = F.shiftright("h", 64 - 2 * bits).bitwiseAND(F.lit((1 << bits) - 1)) if bits < 30 else F.col("h")
    rows = postings.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))).alias("b")).toArrow()
    words = np.zeros(max(1, (1 << bits) >> 6), np.int64)
    words[rows.column("word").to_numpy()] = rows.column("b").to_numpy()
    return words, bits


def passing(own: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """Whether each shingle may be one of the library's; false is proof."""
    slot = (own >> (64 - 2 * bits)) & ((1 << bits) - 1)
    return (words[slot >> 6] >> (slot & 63)) & 1 == 1


def copies(sets: DataFrame, postings: DataFrame) -> DataFrame:
    """set_id of the shingle sets (set_id bigint, own array<bigint>) that are a library file's with slight changes, or a part of one for
    the most: SIMILAR of the union, or of their own where they have 8 shingles or more.

    Either takes SIMILAR of the set's own shingles to be in one library file. So one of its rarest shingles, as many as may be missing
    and one more, must be in that file: candidates meet on these alone, and shingles that many library files share (licences) are
    seldom among them. Candidates are then counted exactly.
    """
    each = cut(sets.select("set_id", F.size("own").alias("n_own"), F.explode("own").alias("h")))
    frequency = postings.groupBy("h").agg(F.count(F.lit(1)).alias("f"))
    rank = F.row_number().over(Window.partitionBy("set_id").orderBy("f", "h"))
    rare = each.join(frequency, "h", "left").select("set_id", "n_own", "h", F.coalesce("f", F.lit(0)).alias("f")).withColumn("r", rank)
    rare = rare.where((F.col("r") <= F.col("n_own") - F.ceil(F.col("n_own") * F.lit(SIMILAR) - F.lit(1e-9)) + 1) & (F.col("f") > 0))
    pairs = rare.join(postings.select("h", "lib"), "h").select("set_id", "lib").distinct()
    common = pairs.join(each.select("set_id", "n_own", "h"), "set_id").join(postings.select("lib", "n", "h"), ["lib", "h"]).groupBy("set_id", "lib", "n_own", "n").agg(F.count(F.lit(1)).alias("c"))
    near = (F.col("c") >= SIMILAR * (F.col("n_own") + F.col("n") - F.col("c"))) | ((F.col("c") >= SIMILAR * F.col("n_own")) & (F.col("n_own") >= 8))
    return common.where(near).select("set_id").distinct()


def judged_texts(documents: DataFrame, library: DataFrame) -> DataFrame:
    """Per node_key the verdicts on its text; of several texts the one added last counts. Null and blank texts are no text. Each text is
    lexed once, whatever the size of the library."""
    spark = documents.sparkSession
    texts = documents.where(F.col("node_key").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != "")).select("node_key", "text", "added_at", "doc_id")
    postings = cut(library_postings(library))
    shared = spark.sparkContext.broadcast(shingle_filter(postings))

    def judge_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, bits = shared.value
        for b in batches:
            rows = []
            for key, at, doc, text in zip(b["node_key"], b["added_at"], b["doc_id"], b["text"]):
                own = shingle_hashes(text)
                near = len(own) and passing(own, words, bits).sum() >= SIMILAR * len(own) - 1e-9
                rows.append((key, at, doc, *verdicts(key, text), own.tolist() if near else None))
            yield pd.DataFrame(rows, columns=["node_key", "added_at", "doc_id", *FLAGS, "own"])

    schema = f"node_key string, added_at {texts.schema['added_at'].dataType.simpleString()}, doc_id bigint, " + ", ".join(f"{f} boolean" for f in FLAGS) + ", own array<bigint>"
    judged = spread(texts).mapInPandas(judge_all, schema)
    last = judged.groupBy("node_key").agg(F.max_by(F.struct(*FLAGS, "own"), F.struct("added_at", "doc_id")).alias("v"))
    last = cut(last.select("node_key", *(f"v.{f}" for f in FLAGS), "v.own", F.when(F.col("v.own").isNotNull(), F.xxhash64("v.own")).alias("set_id")))
    sets = last.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.first("own").alias("own"))
    found = copies(sets, postings).withColumn("copied", F.lit(True))
    return last.drop("own").join(found, "set_id", "left").select("node_key", *FLAGS, F.coalesce("copied", F.lit(False)).alias("copied"))


def source_keys(nodes: DataFrame, file_types: DataFrame) -> DataFrame:
    """Keys of nodes that file_types calls source: category programming or markup in any spelling."""
    kind = F.lower(F.trim("category")).isin("programming", "markup")
    keys = file_types.where(kind & F.col("key").isNotNull()).select(F.col("key").alias("node_key")).distinct()
    return keys.join(nodes.select(F.col("key").alias("node_key")).distinct(), "node_key", "left_semi")


def path_is(pattern: str) -> Column:
    return F.col("node_key").rlike(pattern)


def judged_sources(nodes: DataFrame, file_types: DataFrame, documents: DataFrame, library: DataFrame) -> DataFrame:
    """node_key, reason, evidence of the source files that were not written by hand.

    reason is the first that holds of third-party, generated, minified, data; evidence is what shows it: copy (shingles), layout, comment or
    path, the first that holds in this order. A text that says it is kept by hand outweighs a path for generated files. Empty
    tables give no rows; keys without text are judged by their path.
    """
    judged = source_keys(nodes, file_types).join(judged_texts(documents, library), "node_key", "left")
    said = {c: F.coalesce(F.col(c), F.lit(False)) for c in (*FLAGS, "copied")}
    made_path = path_is(OUTPUT_PATH) & ~said["by_hand"]
    rules = [
        ("third-party", "copy", said["copied"]), ("third-party", "path", path_is(VENDOR_PATH)),
        ("generated", "layout", said["layout"]), ("generated", "comment", said["comment"]), ("generated", "path", made_path),
        ("minified", "layout", said["shrunk"]), ("minified", "path", path_is(SHRUNK_PATH)), ("data", "layout", said["data"]),
    ]
    found = F.lit(None).cast("struct<reason:string,evidence:string>")
    for reason, evidence, holds in reversed(rules):
        found = F.when(holds, F.struct(F.lit(reason).alias("reason"), F.lit(evidence).alias("evidence"))).otherwise(found)
    return judged.select("node_key", found.alias("v")).where(F.col("v").isNotNull()).select("node_key", "v.*")


def not_handwritten(nodes: DataFrame, file_types: DataFrame, documents: DataFrame, library: DataFrame) -> DataFrame:
    """node_key, reason of judged_sources."""
    return judged_sources(nodes, file_types, documents, library).select("node_key", "reason")
