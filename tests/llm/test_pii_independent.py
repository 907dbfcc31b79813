"""The redaction on sentences and names that took no part in fitting, and the independence of those that did."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pytest

from depweft.llm import pii_samples
from depweft.llm.pii import SampleVocabulary, find, fitted, models
from depweft.llm.pii_samples import Maker

from .held_out import FALSE, NAMES, TRUE, VALUES

DOCUMENTS = Path("/root/testdata/sf0.1/documents.parquet")
#: Words that a corpus with such lines has in lower case as well.
VOCABULARY = SampleVocabulary(set("report cache schema bank line street data machine pipeline server cloud table contents terms conditions questions force task lake world times".split()))
#: Forms of notation, not sentences.
NOTATION = {"git@{D}:{t}/{t}.git"}


@pytest.mark.parametrize("kind", list(TRUE))
def test_recall_outside_the_sentences_of_fitting(kind):
    cases = [(t.replace("{x}", v), v) for t in TRUE[kind] for v in (NAMES if kind == "name" else VALUES[kind])]
    found = find([text for text, _ in cases], models(), VOCABULARY)
    hits = sum((kind, v) in {(k, text[a:b]) for k, a, b, _ in spans} for (text, v), spans in zip(cases, found))
    assert len(cases) >= 60 and hits / len(cases) >= 0.9, (kind, hits, len(cases))


def test_organisations_products_and_numbers_are_no_personal_data():
    found = find(FALSE, models(), VOCABULARY)
    wrong = [(t, [(k, t[a:b]) for k, a, b, _ in spans]) for t, spans in zip(FALSE, found) if spans]
    assert len(wrong) <= len(FALSE) * 0.06, wrong


def test_precision_where_both_kinds_of_lines_are_mixed():
    lines = [(t.replace("{x}", v[i % len(v)]), k, v[i % len(v)]) for k, ts in TRUE.items() for v in [NAMES if k == "name" else VALUES[k]] for i, t in enumerate(ts * 3)]
    got = true = 0
    for (text, kind, value), spans in zip(lines, find([text for text, *_ in lines], models(), VOCABULARY)):
        got += len(spans)
        true += (kind, value) in {(k, text[a:b]) for k, a, b, _ in spans}
    assert true / got >= 0.95


def parts(template: str) -> list[str]:
    return re.split(r"\{\w+\}", template)


@pytest.mark.skipif(not DOCUMENTS.exists(), reason="needs the test tables")
def test_no_sentence_of_fitting_stands_in_the_tables():
    import pyarrow.parquet as pq

    texts = "\n".join(t for t in pq.read_table(DOCUMENTS, columns=["text"]).column("text").to_pylist() if t)
    templates = [t for ts in [*pii_samples._CARRIERS.values(), pii_samples._FALSE, pii_samples._PLAIN] for t in ts]
    long = [t for t in templates if sum(len(p.strip()) for p in parts(t)) >= 9 and t not in NOTATION]
    met = [t for t in long if max(map(str.strip, parts(t)), key=len) in texts and re.search(".{1,60}?".join(map(re.escape, parts(t))), texts)]
    assert len(long) > 250 and met == []


def test_held_out_sentences_are_not_those_of_fitting():
    assert not {t for ts in TRUE.values() for t in ts} & {t for ts in pii_samples._CARRIERS.values() for t in ts if sum(len(p.strip()) for p in parts(t)) >= 9}


def test_numbers_come_from_the_whole_range():
    m = Maker(3)
    ids = [m.id() for _ in range(4000)]
    assert {i[0] for i in ids if re.fullmatch(r"\d{3}-\d{2}-\d{4}", i)} == set("0123456789")
    assert len({i[:2] for i in ids if re.fullmatch(r"[A-Z]{2}\d{7}", i)}) > 100


def test_stored_models_are_those_of_the_code():
    """The models beside the code are what fitting gives; if this fails, run python -m depweft.llm.fit."""
    new, old = fitted("email"), models()["email"]
    x = np.array([[t.threshold[0], *np.linspace(0, 5, 18)][:19] for t in new.trees])
    assert new.threshold == pytest.approx(old.threshold) and np.allclose(new.probability(x), old.probability(x), atol=1e-3)
