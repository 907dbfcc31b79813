from __future__ import annotations

import numpy as np
import pytest

from depweft.llm.boosting import fit
from depweft.llm.pii import SampleVocabulary, find, labelled, models, personal_data, redact, redacted, resolve
from depweft.llm.pii_samples import samples
from depweft.llm.pii_spans import GENERATORS, KINDS

VOCABULARY = SampleVocabulary({"report", "cache", "schema"})


def test_generators_reach_every_labelled_span():
    texts, _ = samples(1500, 31)
    missed = total = 0
    for text, spans in texts:
        for kind, a, b in spans:
            total += 1
            missed += (a, b) not in {(s, e) for s, e, _ in GENERATORS[kind](text)}
    assert total > 1500 and missed / total < 0.02


def test_held_out_accuracy(spark):
    """Other seed, hence other names, numbers and topics than in training."""
    texts, topics = samples(1500, 77)
    found = find([t for t, _ in texts], models(spark), SampleVocabulary(topics))
    for kind in KINDS:
        true = {(i, s) for i, (_, spans) in enumerate(texts) for s in spans if s[0] == kind}
        got = {(i, s[:3]) for i, f in enumerate(found) for s in f if s[0] == kind}
        precision, recall = len(true & got) / len(got), len(true & got) / len(true)
        assert precision > 0.95 and recall > 0.88, (kind, precision, recall)


def values(spark, text):
    return [(k, text[a:b]) for k, a, b, _ in find([text], models(spark), VOCABULARY)[0]]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Write to jorun-brannel [at] mail [dot] example if it breaks.", [("email", "jorun-brannel [at] mail [dot] example")]),
        ("The log was sent to <Ana.Lind+builds@dept.example.net>.", [("email", "Ana.Lind+builds@dept.example.net")]),
        ("git clone git@code.example:token/circuit.git", []),
        ("Pinned tarnjs@7.1.2 in the manifest. Use icon_a@2x.png for dense screens.", []),
        ("Call +1 (810) 555‑0145 after six.", [("phone", "+1 (810) 555‑0145")]),
        ("job +0 517 5901602 restarted", []),
        ("Ticket 2026-466-8415 is closed.", []),
        ("The form shows SSN 937-46-0514.", [("id", "937-46-0514")]),
        ("batch 964-56-8564 of the schema rows", []),
        ("con DNI 99 996 768 J, según el alta", [("id", "99 996 768 J")]),
        ("Part no. 45136758U is out of stock.", []),
        ("Reported by Ildiko Güenabrel.", [("name", "Ildiko Güenabrel")]),
        ("owner: Brannon, Jonas", [("name", "Brannon, Jonas")]),
        ("Wexurrel wrote:", []),
        ("I live at 16 Wendelow St, Apt 8B, Hallowmere 94845, ground door.", [("address", "16 Wendelow St, Apt 8B, Hallowmere 94845")]),
        ("adresse : 22, rue aux Chardons, 25312 Port Ellow", [("address", "22, rue aux Chardons, 25312 Port Ellow")]),
        ("Figure 8: Main Street View layout of the status page", []),
        ("", []),
    ],
)
def test_lines(spark, text, expected):
    assert values(spark, text) == expected


def test_placeholders_leave_the_rest_unchanged(spark):
    text = "Según Marta Lindel, el correo es\tana@lab.test;\n\n tel: 0491 570 152 "
    spans = find([text], models(spark), VOCABULARY)[0]
    assert redact(text, spans) == "Según [NAME], el correo es\t[EMAIL];\n\n tel: [PHONE] "
    kept = resolve([("name", 5, 9, 0.9), ("address", 0, 9, 0.6), ("name", 20, 25, 0.9), ("name", 20, 25, 0.9)])
    assert [s[:3] for s in kept] == [("address", 0, 9), ("name", 20, 25)]


def test_table(spark):
    long = "Nothing here. " * 20_000 + "Reported by Corvin Pellond."
    rows = [(1, None), (2, ""), (3, "  "), (4, long), (5, "Call 0491 570 152 or 0491 570 152 now, tel: 0491 570 152"), (6, "Call 0491 570 152 or 0491 570 152 now, tel: 0491 570 152")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, pii_kind string")
    got = {tuple(r) for r in personal_data(docs).collect()}
    assert (4, "name", "Corvin Pellond") in got and {r for r in got if r[0] != 4} == {(5, "phone", "0491 570 152"), (6, "phone", "0491 570 152")}
    out = {r["doc_id"]: r for r in redacted(docs).collect()}
    assert len(out) == 6 and out[1]["text"] is None and out[2]["text"] == "" and out[3]["text"] == "  " and out[4]["text"].endswith("Reported by [NAME].")
    assert personal_data(docs.limit(0)).count() == 0


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 4))
    p = np.where((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4), 0.9, 0.1)
    y = rng.random(4000) < p
    held = np.arange(4000) % 4 == 0
    m = fit(x, y, held)
    q = m.probability(x[held])
    assert ((q > 0.5) == (p[held] > 0.5)).mean() > 0.95 and abs(q.mean() - y[held].mean()) < 0.03


def test_labels_are_sparse_but_present():
    data = labelled(300, 5)
    assert all(0 < y.sum() < len(y) for _, y, _ in data.values())
