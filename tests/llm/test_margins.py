from __future__ import annotations

import numpy as np
import pandas as pd

from depweft.llm.docvectors import BUCKETS, buckets, fit_topics
from depweft.llm.mixing import bounded_scale, margins_report, mix_total, mixture, rake, shares_report

MIX = "mix_name string, source string, target_share double, max_repeats int"
DOCS = "doc_id bigint, text string, lang string, source string"
THEMES = {"garden": "seed soil rose hedge mulch spade compost prune bloom".split(), "sea": "tide reef sail anchor gull wave harbour keel mast".split(), "money": "loan bond yield audit ledger credit asset margin fee".split()}
LITTLE = {"en": "the of and to in is that it".split(), "es": "el de y que en es la se".split()}


def text(rng, theme, lang, n=60):
    words = rng.choice(THEMES[theme], n).tolist() + rng.choice(LITTLE[lang], n).tolist()
    rng.shuffle(words)
    return " ".join(words)


def test_topics_are_what_texts_are_about_and_not_their_language():
    rng = np.random.default_rng(1)
    rows = [(g, t, text(rng, t, g)) for t in THEMES for g in LITTLE for _ in range(40)]
    model = fit_topics([(g, *(x.tolist() for x in buckets(s))) for g, _, s in rows], topics=3)
    got = pd.DataFrame([(t, g, model.topic(s, g)) for g, t, s in rows], columns=["theme", "lang", "topic"])
    assert got.groupby("theme")["topic"].nunique().max() == 1 and got["topic"].nunique() == 3
    assert model.topic("", "en") == 3 and fit_topics([]).topic("a", "en") == 0 and len(model.idf) == BUCKETS


def test_a_tiny_source_falls_short_instead_of_shrinking_the_mix():
    have = {"big": 1000.0, "mid": 400.0, "tiny": 1.0}
    wanted = {"big": (0.6, 2), "mid": (0.35, 2), "tiny": (0.05, 4)}
    assert mix_total(have, wanted) == 800 / 0.35 and abs(mix_total(have, wanted, 0.0) - 80) < 1e-9
    assert abs(mix_total({"a": 10.0}, {"a": (1.0, 3)}) - 30) < 1e-9
    cells = pd.DataFrame([(s, g, t, have[s] / 4) for s in have for g in ("en", "es") for t in (0, 1)], columns=["source", "lang", "topic", "tokens"])
    out = rake(cells, wanted)
    got = (out["rate"] * out["tokens"]).groupby(out["source"]).sum()
    assert abs(got["tiny"] - 4) < 1e-6 and abs(got["big"] / got["mid"] - 0.6 / 0.35) < 1e-6


def test_raking_goes_on_until_the_marginals_hold():
    rng = np.random.default_rng(4)
    cells = pd.DataFrame([(s, g, t, int(rng.integers(1, 4000))) for s in "abc" for g in ("en", "es", "fr") for t in range(6)], columns=["source", "lang", "topic", "tokens"])
    out = rake(cells, {"a": (0.6, 50), "b": (0.3, 50), "c": (0.1, 50)}, 0.0)
    w = out["rate"] * out["tokens"]
    for margin in ("lang", "topic"):
        target = cells.groupby(margin)["tokens"].sum() / cells["tokens"].sum()
        assert np.allclose(w.groupby(out[margin]).sum() / w.sum(), target, atol=1e-4)


def test_copies_and_reports(spark):
    rng = np.random.default_rng(2)
    rows = [(i, text(rng, list(THEMES)[i % 3], "en" if i % 4 else "es", 20 + i % 30), "en" if i % 4 else "es", ["chat", "code", "mail"][i % 3 if i % 9 else 0]) for i in range(900)]
    # Texts whose first copy lies in a source that mix m does not use.
    rows += [(5000 + i, f"shared {i} " * 40, "en", "wiki") for i in range(50)] + [(6000 + i, f"shared {i} " * 40, "en", "forum") for i in range(50)]
    docs = spark.createDataFrame(rows, DOCS)
    mix = spark.createDataFrame([("m", "chat", 0.5, 3), ("m", "code", 0.42, 3), ("m", "forum", 0.08, 2), ("n", "wiki", 1.0, 1), ("bad", "chat", None, 1)], MIX)
    drawn = mixture(docs, mix)
    out = drawn.toPandas()
    assert (out[(out["mix_name"] == "m") & (out["source"] == "forum")]["doc_id"] >= 6000).all() and len(out[out["source"] == "forum"]) > 0
    assert len(out[(out["mix_name"] == "n")]) == 50 and out.groupby(["mix_name", "doc_id"]).size().max() == 1
    report = {(r["mix_name"], r["source"]): r for r in shares_report(drawn, mix).collect()}
    assert all(r["most_repeats"] <= r["max_repeats"] for k, r in report.items() if k[0] != "bad")
    margins = margins_report(docs, mix).toPandas()
    m = margins[margins["mix_name"] == "m"]
    assert set(m["margin"]) == {"source", "lang", "topic"}
    for _, g in m.groupby("margin"):
        assert abs(g["target_share"].sum() - 1) < 1e-9 and abs(g["actual_share"].sum() - 1) < 1e-9
    assert (m[m["margin"] == "lang"]["target_share"] - m[m["margin"] == "lang"]["actual_share"]).abs().max() < 0.03
    assert margins_report(docs.limit(0), mix).count() == 0 and margins_report(docs, mix.limit(0)).count() == 0


def test_texts_without_words_take_no_part_in_topics(spark):
    assert fit_topics([("en", [], []), ("en", [1, 2], [1.0, 1.0])]).topic("...", "en") == 1
    docs = spark.createDataFrame([(1, "...", "en", "chat"), (2, "!!", None, "chat"), (3, "some words here", "en", "chat")], DOCS)
    out = mixture(docs, spark.createDataFrame([("m", "chat", 1.0, 2)], MIX)).collect()
    assert {r["doc_id"] for r in out} == {1, 2, 3}


def test_bounded_scale_equals_the_search_for_the_factor():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 12))
        tokens, weights, cap = rng.integers(1, 90, n).astype(float), rng.random(n) * rng.integers(0, 2, n), int(rng.integers(1, 5))
        target = float(rng.random() * cap * tokens.sum() * 1.1)
        out = bounded_scale(tokens, weights, cap, target)
        most = cap * tokens
        assert (out <= most + 1e-9).all()
        if weights.sum() > 0 and target < most[weights > 0].sum():
            low, high = 0.0, 1e9
            for _ in range(300):
                mid = (low + high) / 2
                low, high = (mid, high) if np.minimum(most, weights * mid).sum() < target else (low, mid)
            assert np.allclose(out, np.minimum(most, weights * high), atol=1e-6)
