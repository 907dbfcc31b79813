from __future__ import annotations

import pytest

from depweft.llm.pii_spans import GENERATORS


def found(kind, text):
    return [text[a:b] for a, b, _ in GENERATORS[kind](text)]


@pytest.mark.parametrize("value", ["C.Mayor, 5, 28001 Madrid", "Cl.Mayor, 5, 28001 Madrid", "BP. 12, 75001 Paris", "B.P. 12, 75001 Paris"])
@pytest.mark.parametrize("other", ["", "\nPlaza C. Cl. Casilla BP B.P."])
def test_an_address_does_not_hang_on_other_words_of_the_text(value, other):
    assert value in found("address", f"vive en {value}{other}")


@pytest.mark.parametrize("dot", [" dot ", " [punto] ", "."])
@pytest.mark.parametrize("parts", [1, 15, 16, 17, 18, 40, 200])
def test_veiled_first_parts_of_any_length(dot, parts):
    value = dot.join(f"part{i}" for i in range(parts)) + " [at] mail [dot] example"
    assert found("email", f"write:\nto: {value}")[-1:] == [value]


def test_decimal_numbers_with_a_cue():
    assert found("phone", "tel: 030.2345678\nx") == ["030.2345678"] and found("phone", "Fax 55.1234567") == ["55.1234567"]
    assert found("phone", "56.544072, 51.301712,\ntel") == []
