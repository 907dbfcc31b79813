"""Personal data in free text: found by candidate generation and boosted trees, replaced by typed placeholders.

Generators with high recall propose overlapping spans; one model of boosted trees per kind scores them by form and context;
thresholds are set on calibrated probabilities; of overlapping spans the likelier stays, and an address or e-mail address
outweighs what lies in it.
"""

from __future__ import annotations

import json
import pickle
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweft.llm.boosting import Boosted, fit
from depweft.llm.pii_samples import samples
from depweft.llm.pii_spans import _LOWER, COMMON, KINDS, TABLE_BITS, Vocabulary, candidates, slots
from depweft.session import spread

#: Labelled texts that the model is fitted on, and every how many of them is held for calibration.
TRAINING_TEXTS, HELD_EVERY, SEED = 24000, 4, 7


class SampleVocabulary(Vocabulary):
    """Stands for corpus counts in training: topics and common words are frequent to different degrees, made-up names seldom occur
    (as when somebody writes a name in lower case). Every third common word never does, as in a corpus with little text in its
    language, so that the models do not rely on counts alone."""

    def __init__(self, topics: set[str]):
        self.topics = topics

    def per_million(self, word: str) -> float:
        chance = slots(word)[0] / (1 << TABLE_BITS)
        if word in COMMON:
            return max(0.0, 12.0 * chance - 4.0)
        return 3.0 + 5.0 * chance if word in self.topics else max(0.0, 6.0 * chance - 3.5)


def labelled(n: int, seed: int, kinds: tuple[str, ...] = KINDS) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind the features, labels and text numbers of the candidates in n made-up texts. Words of an address or e-mail address that
    look like a name are no examples: resolve() gives them to the address, whatever the model of names says."""
    texts, topics = samples(n, seed)
    vocabulary = SampleVocabulary(topics)
    rows: dict[str, list] = {k: [] for k in kinds}
    for i, (text, spans) in enumerate(texts):
        true = set(spans)
        covered = [(s, e) for k, s, e in spans if k in ("address", "email")]
        for kind, a, b, f in candidates(text, vocabulary, kinds):
            if kind == "name" and any(a < e and b > s for s, e in covered):
                continue
            rows[kind].append((f, (kind, a, b) in true, i))
    return {k: (np.array([r[0] for r in v], float), np.array([r[1] for r in v]), np.array([r[2] for r in v])) for k, v in rows.items()}


def fitted(kind: str, n: int = TRAINING_TEXTS, seed: int = SEED) -> Boosted:
    x, y, t = labelled(n, seed, (kind,))[kind]
    return fit(x, y, t % HELD_EVERY == 0)


#: Models as fitted by `python -m depweft.llm.fit` from the sentences and rules of pii_samples, so that no run has to fit them.
MODELS = Path(__file__).with_name("pii_models.json")


@lru_cache(maxsize=2)
def stored(path: Path = MODELS) -> dict[str, Boosted]:
    return {kind: Boosted.from_dict(d) for kind, d in json.loads(path.read_text()).items()}


def models(spark: SparkSession | None = None, n: int = TRAINING_TEXTS, seed: int = SEED) -> dict[str, Boosted]:
    """The model of each kind: the stored ones, or for another number of texts or seed fitted anew, each by a task of its own."""
    if (n, seed) == (TRAINING_TEXTS, SEED):
        return stored()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"kind": b["kind"], "model": [pickle.dumps(fitted(k, n, seed)) for k in b["kind"]]})

    kinds = spark.sparkContext.parallelize([(k,) for k in KINDS], len(KINDS)).toDF("kind string")
    return {r["kind"]: pickle.loads(r["model"]) for r in kinds.mapInPandas(work, "kind string, model binary").collect()}


def vocabulary_counts(texts: DataFrame) -> Vocabulary:
    """Counts of lower-case words over all texts, in a table of fixed size (2^21 numbers), however many texts there are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for t in b["text"]:
                seen.update(_LOWER.findall(t))
            at = np.array([s for w in seen for s in slots(w)], np.int64)
            yield pd.DataFrame({"slot": at, "n": np.repeat(np.fromiter(seen.values(), np.int64, len(seen)), 2)})

    out = np.zeros(2 << TABLE_BITS, np.int64)
    rows = texts.select("text").mapInPandas(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return Vocabulary(out, int(out.sum()) // 2)


def resolve(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Spans that do not overlap: kinds in the order of KINDS with addresses first, then by probability, then the longer."""
    order = {"address": 0, "email": 1, "id": 2, "phone": 2, "name": 3}
    kept: list[tuple[str, int, int, float]] = []
    for s in sorted(found, key=lambda s: (order[s[0]], -round(s[3], 2), s[1] - s[2], s[1], s[0])):
        if all(s[2] <= k[1] or s[1] >= k[2] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s[1])


def find(texts: list[str], by_kind: dict[str, Boosted], vocabulary: Vocabulary) -> list[list[tuple[str, int, int, float]]]:
    """Per text the (kind, start, end, probability) of its personal data, in order."""
    pool: dict[str, tuple[list, list]] = {k: ([], []) for k in KINDS}
    for i, t in enumerate(texts):
        for kind, a, b, f in candidates(t, vocabulary):
            pool[kind][0].append(f)
            pool[kind][1].append((i, a, b))
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    for kind, (x, at) in pool.items():
        if x:
            model = by_kind[kind]
            for (i, a, b), p in zip(at, model.probability(np.array(x, float))):
                if p >= model.threshold:
                    out[i].append((kind, a, b, float(p)))
    return [resolve(f) for f in out]


def _with_text(documents: DataFrame) -> DataFrame:
    return spread(documents.where(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "text"))


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, pii_kind, pii_value: every item of personal data, one row per distinct value of a text.

    Null and empty texts have none; a text is read whole, whatever its length; repeated texts and items come out for each doc_id.
    """
    texts = _with_text(documents)
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((models(spark), vocabulary_counts(texts)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_kind, vocabulary = shared.value
        for b in batches:
            found = find(list(b["text"]), by_kind, vocabulary)
            yield pd.DataFrame([(d, k, t[s:e]) for d, t, spans in zip(b["doc_id"], b["text"], found) for k, s, e, _ in spans], columns=["doc_id", "pii_kind", "pii_value"])

    return texts.mapInPandas(scan, "doc_id bigint, pii_kind string, pii_value string").distinct()


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """text with each span replaced by [KIND]; all else unchanged."""
    out, at = [], 0
    for kind, a, b, _ in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redacted(documents: DataFrame) -> DataFrame:
    """doc_id, text, n_items for every document; null texts stay null, empty ones empty."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((models(spark), vocabulary_counts(_with_text(documents))))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_kind, vocabulary = shared.value
        for b in batches:
            found = find([t or "" for t in b["text"]], by_kind, vocabulary)
            texts = [None if t is None else redact(t, s) for t, s in zip(b["text"], found)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": pd.Series(texts, dtype=object, index=b.index), "n_items": [len(s) for s in found]})

    return spread(documents.select("doc_id", "text")).mapInPandas(scan, "doc_id bigint, text string, n_items int")
