from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd

from depweft.llm import docvectors
from depweft.llm.mixing import distinct_texts
from tests.llm.test_margins import DOCS, LITTLE, THEMES, text

SOURCES = [("m", "chat")], "mix_name string, source string"


def test_every_text_counts_in_the_topics_however_many_there_are(spark):
    """Few texts of a language of its own among 24,000: left out of a sample, their language is not known, and takes the place of what they are about."""
    rng = np.random.default_rng(3)
    rows = [(i, text(rng, list(THEMES)[i % 3], "en" if i % 2 else "es", 12), "en" if i % 2 else "es", "chat") for i in range(24_000)]
    little = "zu qar vel mit ob hap".split()
    rows += [(100_000 + i, " ".join(rng.permutation([*rng.choice(THEMES[list(THEMES)[i % 3]], 6), *little * 4])), "qq", "chat") for i in range(6)]
    out = distinct_texts(spark.createDataFrame(rows, DOCS), spark.createDataFrame(*SOURCES)).select("doc_id", "topic").toPandas()
    out["theme"] = [list(THEMES)[(d - 100_000 if d >= 100_000 else d) % 3] for d in out["doc_id"]]
    known = out[out["doc_id"] < 100_000].groupby("topic")["theme"].agg(lambda t: t.value_counts().index[0])
    few = out[out["doc_id"] >= 100_000]
    assert len(few) == 6 and (few["topic"].map(known) == few["theme"]).all()


def test_topics_of_a_table_are_those_of_its_texts_in_memory(spark, monkeypatch):
    monkeypatch.setattr(docvectors, "BLOCK", 64)
    monkeypatch.setattr(docvectors, "TASK", 150)
    rng = np.random.default_rng(4)
    rows = [(i, text(rng, list(THEMES)[i % 3], "en" if i % 4 else "es", 10 + i % 40), "en" if i % 4 else "es") for i in range(700)] + [(900, "...", "en"), (901, "word " * 70_000, "en"), (902, "a", "fr")]
    packed = [(i, g, i * 7_919 - 50, *map(bytearray, docvectors.packed(t))) for i, t, g in rows]
    texts = spark.createDataFrame(packed, "doc_id bigint, lang string, id bigint, at binary, n binary").repartition(5)
    model, placed = docvectors.fit_all_topics(texts, topics=5)
    same = docvectors.fit_topics([(g, *docvectors.buckets(t)) for _, t, g in rows], topics=5, ids=[i * 7_919 - 50 for i, *_ in rows])
    seen = Counter(b for _, t, _ in rows for b in {zlib.crc32(w.encode()) & 0xFFFF for w in docvectors._WORD.findall(t.lower())})
    assert all(abs(model.idf[b] - np.log((1 + len(rows)) / (1 + n))) < 1e-6 for b, n in seen.items())
    assert (model.idf == same.idf).all() and model.languages.keys() == same.languages.keys() == {"en", "es", "fr"}
    assert all(np.allclose(model.languages[g], same.languages[g]) for g in same.languages) and np.allclose(model.centres, same.centres)
    got = docvectors.with_topics(placed.select("doc_id", "lang", "raw"), model).toPandas().set_index("doc_id")["topic"]
    assert got.to_dict() == {i: same.topic(t, g) for i, t, g in rows} and got[900] == 5


def test_packed_words_keep_their_counts():
    for n in (0, 1, 255, 256, 70_000):
        at, weight = docvectors.buckets("word " * n + "other")
        again = docvectors.unpacked(*docvectors.packed("word " * n + "other"))
        assert (at == again[0]).all() and (weight == again[1]).all()
    assert [len(x) for x in docvectors.unpacked(*docvectors.packed("..."))] == [0, 0]


def test_draws_have_the_chance_of_the_squared_distance():
    x = np.zeros((4, docvectors.TOPIC_DIMENSIONS), np.int16)
    x[0, 0], x[1, 1], x[2, 0], x[2, 1] = docvectors.UNIT, docvectors.UNIT, 23_170, 23_170
    centre = np.eye(1, docvectors.TOPIC_DIMENSIONS)
    drawn = pd.Series([np.frombuffer(docvectors._drawn(x, np.arange(4) + 10 * i, centre, 5)[1], np.int16)[1] for i in range(4000)]).value_counts(normalize=True)
    want = 1 / (1 + (1 - np.sqrt(0.5)) ** 2)
    assert set(drawn.index) == {docvectors.UNIT, 23_170} and abs(drawn[docvectors.UNIT] - want) < 0.02
