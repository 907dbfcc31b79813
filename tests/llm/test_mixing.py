from __future__ import annotations

import numpy as np
import pandas as pd

from depweft.llm.docvectors import count_tokens
from depweft.llm.mixing import bounded_scale, draw, mixture, rake, shares_report


def test_bounded_scale():
    t, w = np.array([10.0, 10.0, 30.0]), np.array([1.0, 5.0, 3.0])
    out = bounded_scale(t, w, 2, 45.0)
    assert abs(out.sum() - 45) < 1e-6 and (out <= 2 * t + 1e-9).all()
    assert np.allclose(bounded_scale(t, w, 2, 1000.0), 2 * t)


def test_rake_meets_sources_exactly_and_margins_closely():
    rng = np.random.default_rng(2)
    cells = pd.DataFrame([(s, g, t, int(rng.integers(500, 5000))) for s in "ab" for g in ("en", "es") for t in range(4)], columns=["source", "lang", "topic", "tokens"])
    out = rake(cells, {"a": (0.7, 4), "b": (0.2, 4), "none": (0.1, 2)})
    got = (out["rate"] * out["tokens"]).groupby(out["source"]).sum()
    assert abs(got["a"] / got.sum() - 7 / 9) < 1e-6 and out["rate"].max() <= 4 + 1e-9
    natural = cells.groupby("lang")["tokens"].sum() / cells["tokens"].sum()
    lang = (out["rate"] * out["tokens"]).groupby(out["lang"]).sum() / got.sum()
    assert abs(lang["en"] - natural["en"]) < 0.02
    assert rake(cells, {"zz": (1.0, 2)}).empty and rake(cells.head(0), {"a": (1.0, 2)}).empty


def test_draw_corrects_itself():
    rng = np.random.default_rng(5)
    tokens = np.sort(rng.integers(1, 900, 2000))[::-1].astype(float)
    rates = np.full(2000, 1.3)
    n = draw(tokens, rates, rng.random(2000))
    assert set(n) <= {1, 2} and abs((n * tokens).sum() - 1.3 * tokens.sum()) < 20


def test_mixture(spark):
    rows = [(i, f"text number {i} " * (3 + i % 11), "en" if i % 3 else "ES_ar", " Repo_Code " if i % 4 else "chat") for i in range(400)]
    rows += [(1000 + i, "the same copied text again", "en", "chat") for i in range(200)] + [(2000, None, None, "chat"), (2001, "", "en", "chat"), (2002, "loose", None, None)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, lang string, source string, n_tokens int")
    mix = spark.createDataFrame([("m", "chat", 0.5, 2), ("m", "repo-code", 0.4, 3), ("m", "wiki", 0.1, 3), ("n", "repo-code", 1.0, 1), ("x", None, 0.5, 1)], "mix_name string, source string, target_share double, max_repeats int")
    out = mixture(docs, mix).toPandas()
    tokens = {d: n for (d, *_), n in zip(rows, count_tokens([r[1] or "" for r in rows]))}
    assert all(tokens[d] == n for d, n in zip(out["doc_id"], out["n_tokens"]))
    m = out[out["mix_name"] == "m"]
    by = (m["n_tokens"] * m["repeats"]).groupby(m["source"]).sum()
    assert abs(by["chat"] / by.sum() - 5 / 9) < 0.01
    assert m[m["source"] == "chat"]["repeats"].max() <= 2 and out.groupby(["mix_name", "doc_id"]).size().max() == 1
    assert (out["doc_id"] >= 1000).sum() <= 1 and out[out["mix_name"] == "n"]["repeats"].max() == 1
    report = {(r["mix_name"], r["source"]): r for r in shares_report(mixture(docs, mix), mix).collect()}
    assert report["m", "wiki"]["actual_share"] == 0 and abs(report["n", "repo-code"]["actual_share"] - 1) < 1e-9
    assert mixture(docs.limit(0), mix).count() == 0 and mixture(docs, mix.limit(0)).count() == 0
