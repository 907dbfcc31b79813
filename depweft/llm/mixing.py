"""Mixing sources to target shares of all tokens.

Token weights of the cells (source, language, topic) are raked by iterative proportional fitting to the mix's source shares and to
the language and topic shares that the mix's sources have of themselves, under the cap on repeats, until the marginals no longer move.
The total is the greatest at which the sources can have their shares; sources that together hold no more than a small part
of the target may come out short instead of shrinking the mix, and their actual share is reported. Topics are clusters of
vocabulary. Texts are then drawn by the calibrated rates of their cells; within buckets of bounded size, drawing
goes from long texts to short ones and makes up for what chance has added or left out before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweft.llm.docvectors import TOKENIZERS, fit_all_topics, measured, with_topics
from depweft.session import cut

#: Raking ends when no cell's weight moves by more than this part of itself in a round, or at MOST_ROUNDS.
CONVERGED, MOST_ROUNDS = 1e-7, 5_000
#: Part of the target shares whose sources may come out short, their caps spent, before the total of a mix is lowered for them.
MAY_FALL_SHORT = 0.1
#: Texts per bucket of a source, drawn in one task.
BUCKET_ROWS = 50_000

SCHEMA = "mix_name string, source string, lang string, topic int, doc_id bigint, n_tokens bigint, repeats int"


def clean_source(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(source)), "_", "-")


def clean_lang(lang: Column) -> Column:
    """Primary language subtag; und where there is none."""
    tag = F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(tag != "", tag).otherwise("und")


def distinct_texts(documents: DataFrame, mixes: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """One row per mix and different text that has tokens: mix_name, doc_id (the least among the mix's sources), source, lang, topic,
    n_tokens, tie. Copies of a text are one text, so that no copy can be drawn beyond the cap; a copy in a source that the mix does
    not use takes nothing away from it.

    mixes: mix_name, source, small.
    """
    clean = documents.withColumn("source", clean_source(F.col("source"))).withColumn("lang", clean_lang(F.col("lang")))
    used = clean.join(F.broadcast(mixes.select("source").distinct()), "source", "left_semi")
    rows = measured(used, ["doc_id", "source", "lang"], folder, words=True).where("n_tokens > 0")
    per_source = rows.groupBy("text_hash", "source").agg(F.min(F.struct("doc_id", "lang", "n_tokens", "at", "n")).alias("d"))
    places = F.collect_list(F.struct("source", "d.doc_id", "d.lang")).alias("places")  # one per source of the mixes at most
    texts = per_source.groupBy("text_hash").agg(F.min("d").alias("d"), places).select("text_hash", F.xxhash64("text_hash").alias("id"), "places", "d.lang", "d.n_tokens", "d.at", "d.n")
    model, placed = fit_all_topics(cut(texts))
    each = placed.select("text_hash", "n_tokens", F.explode("places").alias("p"), "raw").select("text_hash", "n_tokens", "p.source", "p.doc_id", "p.lang", "raw")
    per_mix = with_topics(each, model).join(F.broadcast(mixes.select("mix_name", "source")), "source").select("mix_name", "text_hash", F.struct("doc_id", "source", "lang", "topic", "n_tokens").alias("d"))
    return per_mix.groupBy("mix_name", "text_hash").agg(F.min("d").alias("d")).select("mix_name", "d.*", F.xxhash64("text_hash", F.lit("draw")).alias("tie"))


def bounded_scale(tokens: np.ndarray, weights: np.ndarray, cap: float, target: float) -> np.ndarray:
    """weights times one factor, each at most cap * tokens, with the given sum; the caps themselves where that is out of reach."""
    most = cap * tokens
    if target >= most.sum() or weights.sum() <= 0:
        return most * min(1.0, target / max(most.sum(), 1e-300)) if weights.sum() <= 0 else most
    some = weights > 0
    if target >= most[some].sum():
        return most
    # In order of the factor at which each reaches its cap: with the first k at their caps, the others share what is left.
    reach = most[some] / weights[some]
    order = np.argsort(reach, kind="stable")
    capped = np.concatenate([[0.0], np.cumsum(most[some][order])[:-1]])
    free = np.cumsum(weights[some][order][::-1])[::-1]
    factor = (target - capped) / free
    return np.minimum(most, weights * factor[np.flatnonzero(factor <= reach[order])[0]])


def mix_total(have: dict[str, float], wanted: dict[str, tuple[float, int]], may_fall_short: float = MAY_FALL_SHORT) -> float:
    """Tokens of a mix: the greatest number at which the sources that can't have their share hold at most may_fall_short of all shares.

    have: tokens of each source that has any; wanted: share and cap.
    """
    shares = sum(wanted[s][0] for s in have)
    reach = sorted((wanted[s][1] * have[s] * shares / wanted[s][0], wanted[s][0] / shares) for s in have)
    short = 0.0
    for total, share in reach:
        short += share
        if short > may_fall_short + 1e-12:
            return total
    return reach[-1][0]


def rake(cells: pd.DataFrame, shares: dict[str, tuple[float, int]], may_fall_short: float = MAY_FALL_SHORT) -> pd.DataFrame:
    """cells (source, lang, topic, tokens) with rate: how often, on average, a text of the cell is to be drawn.

    shares: source to (target share, cap). Sources without texts, or with a share or cap of 0, get nothing, and the others
    keep their proportions; a source that may fall short (see mix_total) is drawn up to its cap. The last step of every round is
    that of the sources, so their shares hold exactly. Rounds go on until the weights stand still, as they do unless the
    marginals contradict the caps; then the sources win, and the report shows how far language and topic are off.
    """
    wanted = {s: (w, c) for s, (w, c) in shares.items() if w > 0 and c > 0}
    own = cells[cells["source"].isin(list(wanted)) & (cells["tokens"] > 0)].reset_index(drop=True)
    if own.empty:
        return own.assign(rate=0.0)
    tokens = own["tokens"].to_numpy(float)
    have = own.groupby("source")["tokens"].sum().to_dict()
    total_share = sum(wanted[s][0] for s in have)
    total = mix_total(have, wanted, may_fall_short)
    source_rows = {s: np.flatnonzero(own["source"] == s) for s in sorted(have)}
    goals = {s: min(total * wanted[s][0] / total_share, wanted[s][1] * have[s]) for s in source_rows}
    margins = [(np.unique(own[c].to_numpy(), return_inverse=True)[1]) for c in ("lang", "topic")]
    natural = [np.bincount(m, tokens) / tokens.sum() * sum(goals.values()) for m in margins]
    w = tokens.copy()
    for s, rows in source_rows.items():
        w[rows] = bounded_scale(tokens[rows], w[rows], wanted[s][1], goals[s])
    for _ in range(MOST_ROUNDS):
        before = w.copy()
        for m, goal in zip(margins, natural):
            w = w * (goal / np.maximum(np.bincount(m, w, len(goal)), 1e-300))[m]
        for s, rows in source_rows.items():
            w[rows] = bounded_scale(tokens[rows], w[rows], wanted[s][1], goals[s])
        if np.abs(w - before).max() <= CONVERGED * w.max():
            break
    return own.assign(rate=w / tokens)


def draw(tokens: np.ndarray, rates: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Repeats of texts in the order given: a rate's whole part, and one more by chance, corrected by what was drawn before."""
    base = np.floor(rates + 1e-9)
    more = np.clip(rates - base, 0, 1)
    out, owed = base.astype(np.int64), 0.0
    for i in range(len(tokens)):
        want = owed + more[i] * tokens[i]
        if more[i] > 1e-9 and want > chance[i] * tokens[i]:
            out[i] += 1
            want -= tokens[i]
        owed = want
    return out


def mixes_of(mix_weights: DataFrame) -> dict[str, dict[str, tuple[float, int]]]:
    """Share and cap of each source of each mix. Rows with null fields are ignored; a source given twice in a mix has the sum of its shares
    and the lesser cap."""
    mixes: dict[str, dict[str, tuple[float, int]]] = {}
    for r in mix_weights.dropna(subset=["mix_name", "source", "target_share", "max_repeats"]).collect():  # a fixed table of a few rows
        held = mixes.setdefault(r["mix_name"], {})
        share, cap = held.get(r["source"], (0.0, r["max_repeats"]))
        held[r["source"]] = (share + r["target_share"], min(cap, r["max_repeats"]))
    return mixes


def _cells(documents: DataFrame, mixes: dict, folder: str) -> tuple[DataFrame, pd.DataFrame]:
    """The different texts of each mix, and the tokens and texts of their cells: sources times language tags times topics, whatever the
    number of texts."""
    rows = [(m, s) for m, shares in sorted(mixes.items()) for s in sorted(shares)]
    texts = cut(distinct_texts(documents, documents.sparkSession.createDataFrame(rows, "mix_name string, source string"), folder))
    return texts, texts.groupBy("mix_name", "source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).toPandas()


def mixture(documents: DataFrame, mix_weights: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """The drawn texts of each mix with their repeats: SCHEMA.

    Each source that can have it gets its share of all drawn tokens up to the length of a text or so; no text is drawn more than
    max_repeats times, whatever the number of its copies. Null and empty texts and sources outside the mix are not drawn.
    """
    return _drawn(documents, mixes_of(mix_weights), folder)[0]


def _drawn(documents: DataFrame, mixes: dict, folder: str) -> tuple[DataFrame, pd.DataFrame]:
    """The drawn texts, and the cells of all mixes."""
    spark = documents.sparkSession
    nothing = spark.createDataFrame([], SCHEMA)
    if not mixes:
        return nothing, pd.DataFrame(columns=["mix_name", "source", "lang", "topic", "tokens", "n"])
    texts, cells = _cells(documents, mixes, folder)
    raked = [rake(cells[cells["mix_name"] == name], shares).assign(cap=lambda d, s=shares: [s[x][1] for x in d["source"]]) for name, shares in sorted(mixes.items())]
    rated = pd.concat(raked)
    if rated.empty:
        return nothing, cells
    rated["buckets"] = -(-rated.groupby(["mix_name", "source"])["n"].transform("sum") // BUCKET_ROWS)
    rows = [(m, s, lang, int(t), float(r), int(c), int(b)) for m, s, lang, t, r, c, b in rated[["mix_name", "source", "lang", "topic", "rate", "cap", "buckets"]].itertuples(index=False)]
    rates = spark.createDataFrame(rows, "mix_name string, source string, lang string, topic int, rate double, cap int, buckets int")

    def draw_bucket(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["n_tokens", "tie", "doc_id"], ascending=[False, True, True], kind="stable")
        chance = ((b["tie"].to_numpy() >> 11) & ((1 << 40) - 1)) / float(1 << 40)
        n = np.minimum(draw(b["n_tokens"].to_numpy(float), b["rate"].to_numpy(), chance), b["cap"].to_numpy())
        out = b[["mix_name", "source", "lang", "topic", "doc_id", "n_tokens"]].assign(repeats=n.astype(np.int32))
        return out[out["repeats"] > 0]

    rated_texts = texts.join(F.broadcast(rates), ["mix_name", "source", "lang", "topic"]).withColumn("bucket", F.pmod(F.shiftright("tie", 52), F.col("buckets")).cast("int"))
    return rated_texts.groupBy("mix_name", "source", "bucket").applyInPandas(lambda b: draw_bucket(b), SCHEMA), cells


def shares_report(drawn: DataFrame, mix_weights: DataFrame) -> DataFrame:
    """Per mix and source: target and actual share of tokens, drawn texts and tokens, and whether the source came out short of its share
    with its cap spent."""
    got = drawn.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"), F.min("repeats").alias("least_repeats"))
    total = got.groupBy("mix_name").agg(F.sum("tokens").alias("total"))
    wanted = mix_weights.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    zero = F.lit(0).cast("bigint")
    out = wanted.join(got, ["mix_name", "source"], "left").join(total, "mix_name", "left")
    actual = F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0))
    short = (actual < F.col("target_share")) & (F.coalesce("least_repeats", "max_repeats") >= F.col("max_repeats"))
    return out.select("mix_name", "source", "target_share", "max_repeats", F.coalesce("n_texts", zero).alias("n_texts"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), actual.alias("actual_share"), short.alias("came_out_short"))


def margins_report(documents: DataFrame, mix_weights: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Per mix and marginal (source, lang, topic) each value's target and actual share of the drawn tokens: mix_name, margin, value,
    target_share, actual_share. The target of a source is its share in the mix among the sources that have texts; that of a language or
    topic is what the mix's sources have of it."""
    spark = documents.sparkSession
    mixes = mixes_of(mix_weights)
    drawn, cells = _drawn(documents, mixes, folder)
    rows = []
    for name, own in cells.groupby("mix_name"):
        have = {s for s in own["source"] if mixes[name][s][0] > 0 and mixes[name][s][1] > 0}
        own = own[own["source"].isin(have)]
        shares = sum(mixes[name][s][0] for s in have)
        rows += [(name, "source", s, mixes[name][s][0] / shares) for s in sorted(have)]
        for margin in ("lang", "topic"):
            rows += [(name, margin, str(v), float(t) / float(own["tokens"].sum())) for v, t in own.groupby(margin)["tokens"].sum().items()]
    targets = spark.createDataFrame(rows, "mix_name string, margin string, value string, target_share double")
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("margin"), F.col(m).cast("string").alias("value")) for m in ("source", "lang", "topic")))).alias("m")
    got = drawn.select("mix_name", each, (F.col("n_tokens") * F.col("repeats")).alias("t")).groupBy("mix_name", "m.margin", "m.value").agg(F.sum("t").alias("t"))
    total = got.where("margin = 'source'").groupBy("mix_name").agg(F.sum("t").alias("total"))
    out = targets.join(got, ["mix_name", "margin", "value"], "left").join(F.broadcast(total), "mix_name", "left")
    return out.select("mix_name", "margin", "value", "target_share", F.coalesce(F.col("t") / F.col("total"), F.lit(0.0)).alias("actual_share"))
