from __future__ import annotations

import pytest

from depweft.llm.pii import SampleVocabulary, find, models, redact
from depweft.llm.pii_spans import check_digit, ids

VOCABULARY = SampleVocabulary({"report", "cache", "schema"})


def test_check_digit():
    assert check_digit("L01X00T47") == "1" and check_digit("L898902C3") == "6"


@pytest.mark.parametrize("number", ["C01X00T47", "L01X00T471", "LZ6311T47", "CFGHJKLM7", "CA12345AB", "12AB34567"])
def test_mixed_numbers_are_candidates_on_lines_of_few_digits(number):
    for text, at in ((number, 0), (f"a b\nAusweis {number}, x", 12)):
        assert (at, at + len(number)) in {(a, b) for a, b, _ in ids(text)}
    assert not list(ids(f"x-{number}")) and not list(ids(f"{number}_x"))


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("Reisepass C01X00T47", "C01X00T47"), ("Personalausweis L01X00T471", "L01X00T471"), ("Identity document LZ6311T47 was uploaded by mistake.", "LZ6311T47"), ("passport no. C4VK0RT59", "C4VK0RT59"), ("Passeport 12AB34567", "12AB34567"),
        ("Part no. C01X00T47 is out of stock.", None), ("serial L01X00T471 of the unit", None), ("sku LZ6311T47", None), ("batch 12AB34567 of the rows", None),
    ],
)
def test_mixed_numbers_are_told_from_part_numbers(spark, text, number):
    spans = find([text], models(spark), VOCABULARY)[0]
    assert [(k, text[a:b]) for k, a, b, _ in spans] == ([("id", number)] if number else [])
    assert redact(text, spans) == (text.replace(number, "[ID]") if number else text)
