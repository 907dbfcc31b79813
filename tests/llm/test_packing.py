from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from depweft.llm.docvectors import count_tokens, curve_keys, encoding, hilbert, pieces, vector
from depweft.llm.packing import containers, fill_report, pack


def test_hilbert_visits_every_point_by_single_steps():
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), axis=-1).reshape(-1, n)
        keys = hilbert(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_similar_texts_lie_close_on_the_curve():
    a = "The parser reads a schema and keeps every label of the node table in order. " * 3
    b = a.replace("order", "place")
    c = "Conviene renovar cada ruta pendiente y después convertir la evidencia del panel. " * 3
    va, vb, vc = vector(a), vector(b), vector(c)
    assert np.linalg.norm(va - vb) < np.linalg.norm(va - vc)
    assert curve_keys(np.array([va, va]))[0] == curve_keys(np.array([va]))[0]
    assert not vector("").any()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=300), st.integers(1, 40), st.integers(1, 20))
def test_pack_is_whole_and_within_capacity(sizes, window, most_open):
    at = pack(sizes, 50, window, most_open)
    used = np.bincount(at, sizes) if sizes else np.zeros(0)
    assert len(at) == len(sizes) and (used <= 50).all() and (used > 0).all()


def test_pack_fills_well():
    rng = np.random.default_rng(1)
    sizes = rng.integers(5, 200, 5000).tolist()
    at = pack(sizes, 256)
    assert sum(sizes) / (256 * (max(at) + 1)) > 0.985


def test_stretches_follow_the_curve_and_split_hot_keys(spark):
    """A key that holds most texts is spread over stretches; every stretch is one piece of the curve, in all its bits."""
    same = [(i, "one and the same text") for i in range(600)]
    other = [(1000 + i, f"word{i} other{i * 7} third{i % 13} " * 5) for i in range(300)]
    docs = spark.createDataFrame(same + other, "doc_id bigint, text string")
    sizes = spark.createDataFrame([("s", 64)], "pack_name string, capacity_tokens int")
    out = containers(docs, sizes, block_rows=100).toPandas()
    out["stretch"] = out["container_id"].str.split("-").str[0].astype(int)
    assert out.groupby("container_id")["n_tokens"].sum().max() <= 64 and out["doc_id"].nunique() == 900
    assert out["stretch"].nunique() >= 7 and out[out["doc_id"] < 1000]["stretch"].nunique() >= 4
    key = {d: k for (d, _), k in zip(same + other, curve_keys(np.array([vector(t) for _, t in same + other])))}
    out["curve"] = out["doc_id"].map(key)
    ends = out.groupby("stretch")["curve"].agg(["min", "max"]).sort_index()
    assert (ends["min"].to_numpy()[1:] >= ends["max"].to_numpy()[:-1]).all()


def test_a_long_text_given_twice_has_containers_of_its_own(spark):
    docs = spark.createDataFrame([(1, "word " * 300)] * 2, "doc_id bigint, text string")
    out = containers(docs, spark.createDataFrame([("s", 64)], "pack_name string, capacity_tokens int")).toPandas()
    assert out.groupby("container_id")["n_tokens"].sum().max() <= 64 and out["n_tokens"].sum() == 2 * count_tokens(["word " * 300])[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a" * 3000, " " * 12_000, "\n" * 11_000, "\u00a0" * 10_500, "x", " y", "'s", "7" * 2500, "-" * 4000, "é" * 2100, "\x1c" * 10_100, "word  "]), max_size=6))
def test_counts_are_those_of_the_tokenizer(parts):
    text = "".join(parts)
    assert count_tokens([text]) == [len(encoding().encode_ordinary(text))]


def test_runs_that_the_pattern_cannot_walk_over():
    assert count_tokens([" " * 1_500_000 + "x"])[0] == count_tokens([" " * 1_499_999])[0] + len(encoding().encode_ordinary(" x"))


def test_long_runs_are_counted_in_pieces():
    for t in ("a" * 50_000, " " * 9_000 + "x", "ab " * 10, ""):
        assert "".join(pieces(t)) == t
    assert count_tokens(["", "hello world"]) == [0, len(encoding().encode_ordinary("hello world"))]
    assert count_tokens(["x" * 100_000])[0] > 0


def test_containers(spark):
    rows = [(1, None), (2, ""), (3, "same text " * 5), (4, "same text " * 5), (5, "word " * 1000), (6, "short"), (6, "short")] + [(100 + i, f"note {i} " * (i % 17 + 1)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id bigint, text string, block string, n_tokens int")
    sizes = spark.createDataFrame([("s", 64), ("l", 512), ("bad", None), ("zero", 0)], "pack_name string, capacity_tokens int")
    out = containers(docs, sizes).toPandas()
    tokens = dict(zip([r[0] for r in rows], count_tokens([r[1] or "" for r in rows])))
    for name, cap in (("s", 64), ("l", 512)):
        own = out[out["pack_name"] == name]
        placed = own[own["container_id"].notna()]
        assert placed.groupby("container_id")["n_tokens"].sum().max() <= cap
        per_doc = placed.groupby("doc_id")["n_tokens"].sum().to_dict()
        assert per_doc == {d: n * (2 if d == 6 else 1) for d, n in tokens.items() if n}
        assert set(own[own["container_id"].isna()]["doc_id"]) == {1, 2}
        cut = placed[placed["n_parts"] > 1]
        assert set(cut["doc_id"]) == {d for d, n in tokens.items() if n > cap}
        for _, g in cut.groupby("doc_id"):
            g = g.sort_values("part")
            assert list(g["part"]) == list(range(g["n_parts"].iloc[0])) and list(g["start_token"]) == [p * cap for p in g["part"]]
    assert set(out["pack_name"]) == {"s", "l"}
    fill = {r["pack_name"]: r["fill"] for r in fill_report(containers(docs, sizes), sizes).collect()}
    assert fill["s"] > 0.95
    assert containers(docs.limit(0), sizes).count() == 0 and containers(docs, sizes.limit(0)).count() == 0
