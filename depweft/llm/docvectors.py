"""Sizes in tokens of a public tokenizer, and hashed vectors of texts projected to few dimensions."""

from __future__ import annotations

import base64
import os
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from depweft.session import cut, spread

#: Folder of the tokenizer files; every function that counts takes another as a parameter.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's tokenizer splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space from this length on are merged by themselves: the pattern above can't walk over very long ones.
LONG_RUN = 10_000
# Fixed value: the white space of the pattern above.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

DIMENSIONS, BITS = 4, 8
_WORD = re.compile(r"\w+")
_LONG = re.compile(rf"[{_SPACE}]{{{LONG_RUN},}}")
_LONG_PIECE = re.compile(rf"[{_SPACE}]+")


@lru_cache(maxsize=4)
def encoding(folder: str = TOKENIZERS, name: str = VOCABULARY):
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> list[str]:
    """text in parts, cut only where the pattern cuts as well: around long runs of white space, whose last sign goes with what follows."""
    out, at = [], 0
    for m in _LONG.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += [text[at : m.start()], text[m.start() : end]]
        at = end
    out.append(text[at:])
    return [p for p in out if p] or [""]


def count_tokens(texts: list[str], folder: str = TOKENIZERS, name: str = VOCABULARY) -> list[int]:
    """Number of tokens of each text, as the tokenizer itself gives it, whatever the text's length."""
    enc = encoding(folder, name)

    def count(piece: str) -> int:
        return len(enc._encode_single_piece(piece) if len(piece) >= LONG_RUN - 1 and _LONG_PIECE.fullmatch(piece) else enc.encode_ordinary(piece))

    return [sum(map(count, pieces(t))) if t else 0 for t in texts]


@lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    return np.random.default_rng(20).standard_normal((1 << 16, DIMENSIONS))


def vector(text: str) -> np.ndarray:
    """The text's words, hashed into 65,536 buckets with damped counts, projected on random directions and scaled so that each
    coordinate is about standard normal. Texts without words give zeros."""
    words = Counter(_WORD.findall(text.lower()))
    if not words:
        return np.zeros(DIMENSIONS)
    at = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) & 0xFFFF for w in words), np.int64, len(words))
    weight = np.log1p(np.fromiter(words.values(), float, len(words)))
    return weight @ _directions()[at] / np.linalg.norm(weight)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of points with unsigned integer coordinates of so many bits (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            has = (x[i] & q) != 0
            t = np.where(has, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(has, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Hilbert keys of vectors; each coordinate is spread evenly by the logistic form of the normal distribution."""
    spread = 1 / (1 + np.exp(-1.702 * vectors))
    return hilbert(np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


# ---- topics ---------------------------------------------------------------------------------------------------------

#: Topics, dimensions of their vectors, and rounds of clustering at most; it ends when no centre moves by more than STILL.
TOPICS, TOPIC_DIMENSIONS, TOPIC_ROUNDS, STILL = 16, 48, 30, 1e-5
BUCKETS = 1 << 16
#: Vectors are held as whole numbers of this size for 1, so that sums over texts are exact in whatever order they are added.
UNIT = 32_767
#: Vectors per block of those that clustering goes over, and per task.
BLOCK, TASK = 4_096, 1 << 17


@lru_cache(maxsize=1)
def _topic_directions() -> np.ndarray:
    return np.random.default_rng(21).standard_normal((BUCKETS, TOPIC_DIMENSIONS)).astype(np.float32)


def word_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of a text and how often each stands there."""
    words = Counter(_WORD.findall(text.lower()))
    at = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for w in words), np.int64, len(words))
    return at, np.fromiter(words.values(), np.int64, len(words))


def buckets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of a text and their damped counts."""
    at, n = word_counts(text)
    return at, np.log1p(n.astype(np.float32))


def packed(text: str) -> tuple[bytes, bytes]:
    """word_counts in two bytes a word, and as many for the counts as the greatest needs."""
    at, n = word_counts(text)
    return at.astype("<u2").tobytes(), n.astype(np.min_scalar_type(int(n.max())).newbyteorder("<") if len(n) else np.uint8).tobytes()


def unpacked(at: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What buckets gives, of a packed text."""
    return np.frombuffer(at, "<u2").astype(np.int64), np.log1p(np.frombuffer(n, f"<u{2 * len(n) // len(at) if at else 1}").astype(np.float32))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def _held(x: np.ndarray) -> np.ndarray:
    return np.rint(_unit(x) * UNIT).astype("<i2")


@dataclass
class TopicModel:
    """Clusters of vocabulary: words weigh more the fewer texts hold them, and what the texts of a language have in common is taken off,
    so that a topic is what a text is about and not the language that it is in."""

    idf: np.ndarray
    languages: dict[str, np.ndarray]
    centres: np.ndarray

    def raw(self, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return _held((weight * self.idf[at]) @ _topic_directions()[at])

    def vectors(self, raw: np.ndarray, langs: Iterable[str]) -> np.ndarray:
        nothing = np.zeros(TOPIC_DIMENSIONS)
        return _held(raw - np.array([self.languages.get(g, nothing) for g in langs]).reshape(-1, TOPIC_DIMENSIONS))

    def topics(self, raw: np.ndarray, langs: Iterable[str]) -> np.ndarray:
        """Numbers of the nearest centres of texts that have words."""
        return (self.vectors(raw, langs) @ self.centres.T).argmax(axis=1) if len(self.centres) else np.zeros(len(raw), np.int64)

    def topic(self, text: str, lang: str) -> int:
        """Number of the nearest centre; the number of centres for texts without words."""
        at, weight = buckets(text)
        return int(self.topics(self.raw(at, weight)[None], [lang])[0]) if len(at) else len(self.centres)


def _idf(seen: np.ndarray, texts: int) -> np.ndarray:
    return np.log((1 + texts) / (1 + seen)).astype(np.float32)


def _chance(ids: np.ndarray, turn: int, seed: int) -> np.ndarray:
    """A number above 0 and up to 1 for each id, another in each turn (SplitMix64)."""
    z = ids.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (1 + turn + (seed << 16))) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0**-54


def _drawn(x: np.ndarray, ids: np.ndarray, centres: np.ndarray, seed: int) -> tuple[float, bytes]:
    """The next centre among the vectors x: each has a chance as the square of its distance from the nearest centre, as the one with the
    least waiting time, so that the least of all blocks is the draw from all of them. Vectors of zeros are not drawn."""
    far = np.maximum(1 - (_unit(x.astype(float)) @ centres.T).max(axis=1), 0) ** 2 if len(centres) else np.ones(len(x))
    far[(far < 1e-12) | ~x.any(axis=1)] = 0
    with np.errstate(divide="ignore"):
        wait = -np.log(_chance(ids, len(centres), seed)) / far
    wait[far == 0] = np.inf
    least = np.lexsort((ids, wait))[0]
    return float(wait[least]), x[least].tobytes()


def _sums(x: np.ndarray, ids: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Sum of the vectors x nearest to each centre; whole numbers, exact as floats."""
    x = x.astype(float)
    return ((x @ centres.T).argmax(axis=1) == np.arange(len(centres))[:, None]).astype(float) @ x


def _clusters(over: Callable[[Callable, Callable], list], topics: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means. over(step, merge): the results of step, a function of vectors and ids, for all blocks of them, some of them
    merged already."""
    centres = np.zeros((0, TOPIC_DIMENSIONS))
    while len(centres) < topics:
        wait, x = min(over(partial(_drawn, centres=centres, seed=seed), min), default=(np.inf, b""))
        if wait == np.inf:
            break
        centres = np.vstack([centres, _unit(np.frombuffer(x, "<i2").astype(float))])
    if not len(centres):
        return centres
    for _ in range(rounds):
        sums = sum(over(partial(_sums, centres=centres), sum))
        new = np.where(sums.any(axis=1, keepdims=True), _unit(sums), centres)
        if np.abs(new - centres).max() <= STILL:
            break
        centres = new
    return centres


def fit_topics(rows: list[tuple[str, list[int], list[float]]], topics: int = TOPICS, rounds: int = TOPIC_ROUNDS, seed: int = 5, ids: list[int] | None = None) -> TopicModel:
    """The model of (language, hashed words, damped counts) of texts in memory. ids: a hash of each text, by which centres are drawn."""
    seen = np.zeros(BUCKETS)
    for _, at, _ in rows:
        seen[np.array(at, np.int64)] += 1
    model = TopicModel(_idf(seen, len(rows)), {}, np.zeros((0, TOPIC_DIMENSIONS)))
    own = np.array([i for i, (_, a, _) in zip(range(len(rows)) if ids is None else ids, rows) if len(a)], np.int64)
    rows = [(g, np.array(a, np.int64), np.array(w, np.float32)) for g, a, w in rows if len(a)]
    if not rows:
        return model
    raw = np.array([model.raw(a, w) for _, a, w in rows])
    langs = np.array([g for g, *_ in rows])
    model.languages = {g: raw[langs == g].sum(axis=0, dtype=np.int64) / (langs == g).sum() for g in sorted(set(langs))}
    x = model.vectors(raw, langs)
    model.centres = _filled(_clusters(lambda step, _: [step(x, own)], topics, rounds, seed))
    return model


def _filled(centres: np.ndarray) -> np.ndarray:
    """One centre for texts that do not differ from what their languages have in common, where there are no others."""
    return centres if len(centres) else np.zeros((1, TOPIC_DIMENSIONS))


def fit_all_topics(texts: DataFrame, topics: int = TOPICS, rounds: int = TOPIC_ROUNDS, seed: int = 5) -> tuple[TopicModel, DataFrame]:
    """The model of all texts, each counted once, and the texts with raw, their vector before its language is taken off (null without words).

    texts: one row per different text, already computed, with at and n (see packed), lang, id (a hash of the text) and more. Words, languages
    and centres are counted over all of them; what the driver holds does not grow with their number.
    """
    spark = texts.sparkSession
    others = [c for c in texts.columns if c not in ("at", "n")]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            seen[BUCKETS] += len(b)
            for at in b["at"]:
                seen[np.frombuffer(at, "<u2")] += 1
        yield pd.DataFrame({"bucket": np.flatnonzero(seen), "k": seen[seen > 0]})

    counted = texts.select("at").mapInPandas(count, "bucket int, k bigint").groupBy("bucket").agg(F.sum("k").alias("k")).toPandas()
    seen = np.zeros(BUCKETS + 1, np.int64)
    seen[counted["bucket"]] = counted["k"]
    model = TopicModel(_idf(seen[:BUCKETS], int(seen[BUCKETS])), {}, np.zeros((0, TOPIC_DIMENSIONS)))
    shared = spark.sparkContext.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [shared.value.raw(*unpacked(at, n)).tobytes() if at else None for at, n in zip(b["at"].to_pylist(), b["n"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in others), pa.array(raw, pa.binary())], names=[*others, "raw"])

    placed = cut(texts.mapInArrow(place, StructType([*(texts.schema[c] for c in others), StructField("raw", BinaryType())])))
    worded = placed.where("raw IS NOT NULL").select("lang", "id", "raw")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, own in b.groupby("lang"):
                x = _rows(own["raw"])
                held[lang] = held.get(lang, 0) + np.append(x.sum(axis=0, dtype=np.int64), len(x))
        for lang, total in held.items():
            yield pd.DataFrame({"lang": lang, "d": np.arange(len(total)), "s": total})

    added = worded.mapInPandas(add, "lang string, d int, s bigint").groupBy("lang", "d").agg(F.sum("s").alias("s")).toPandas()
    sums = added.pivot(index="lang", columns="d", values="s")
    model.languages = {g: np.array(v[:-1]) / v[-1] for g, *v in sums.itertuples(name=None)}
    if not model.languages:
        return model, placed
    languages = spark.sparkContext.broadcast(model.languages)

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = TopicModel(np.zeros(0), languages.value, np.zeros(0))
        for b in batches:
            for at in range(0, len(b), BLOCK):
                some = b.iloc[at : at + BLOCK]
                yield pd.DataFrame({"x": [own.vectors(_rows(some["raw"]), some["lang"]).tobytes()], "ids": [some["id"].to_numpy("<i8").tobytes()]})

    n = int(added.loc[added["d"] == TOPIC_DIMENSIONS, "s"].sum())
    blocks = cut(worded.coalesce(-(-n // TASK)).mapInPandas(block, "x binary, ids binary"))

    def over(step: Callable, merge: Callable) -> list:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = [step(_rows([x]), np.frombuffer(ids, "<i8")) for b in batches for x, ids in zip(b["x"], b["ids"])]
            if found:
                yield pd.DataFrame({"r": [pickle.dumps(merge(found))]})

        return [pickle.loads(r["r"]) for r in blocks.mapInPandas(run, "r binary").collect()]

    model.centres = _filled(_clusters(over, topics, rounds, seed))
    return model, placed


def _rows(raw: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<i2").reshape(-1, TOPIC_DIMENSIONS)


def with_topics(texts: DataFrame, model: TopicModel) -> DataFrame:
    """texts (raw as fit_all_topics gives it, lang and more) with topic instead of raw; the number of centres for texts without words."""
    shared = texts.sparkSession.sparkContext.broadcast(TopicModel(np.zeros(0), model.languages, model.centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, langs = b["raw"].to_pylist(), b["lang"].to_pylist()
            worded = np.array([r is not None for r in raw], bool)
            topic = np.full(len(raw), len(shared.value.centres), np.int32)
            if worded.any():
                topic[worded] = shared.value.topics(_rows(r for r in raw if r is not None), [g for g, r in zip(langs, raw) if r is not None])
            kept = [c for c in b.schema.names if c != "raw"]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(topic)], names=[*kept, "topic"])

    return texts.mapInArrow(assign, StructType([*(f for f in texts.schema if f.name != "raw"), StructField("topic", IntegerType())]))


def measured(documents: DataFrame, columns: list[str], folder: str = TOKENIZERS, name: str = VOCABULARY, words: bool = False) -> DataFrame:
    """columns of documents with n_tokens, text_hash, an MD5 of the text, and curve (Hilbert key) or, with words, at and n (see packed).
    Null texts have no hash, and like empty ones no tokens."""
    kept = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["__text"]]
            out = b[[*columns, "text_hash"]].copy()
            out["n_tokens"] = count_tokens(texts, folder, name)
            if words:
                both = [packed(t) for t in texts]
                out["at"], out["n"] = [a for a, _ in both], [n for _, n in both]
            else:
                out["curve"] = curve_keys(np.array([vector(t) for t in texts]).reshape(-1, DIMENSIONS))
            yield out

    prepared = documents.select(*columns, F.md5("text").alias("text_hash"), F.col("text").alias("__text"))
    return spread(prepared).mapInPandas(measure, f"{kept}, text_hash string, n_tokens bigint, " + ("at binary, n binary" if words else "curve bigint"))
