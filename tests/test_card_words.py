"""Card numbers after their label: groups with hidden places, plain runs, suffixes, borders."""

import pytest

from quillmark.operators.labelled import identifiers_of


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("4111 1111 1111 1111", ("4111111111111111", False, None)), ("4111-1111 - 1111 1111 12", ("411111111111111112", False, "12")), ("4111111111111111", ("4111111111111111", False, None)),
        ("XXXX **** ••11 1111", ("XXXXXXXXXX111111", True, None)), ("no 12 then 4111 1111 1111 1", ("4111111111111", False, None)), ("4111 1111 1", ("411111111", False, None)),
        ("4111 1111", None), ("411111111111", None), ("1" * 20, None), ("4111 1111 1111AB", None), ("A4111 1111 1111", None), ("41111 11111 11111", ("411111111111111", False, None)),
        ("4111 1111 1111 1111 1111 1111", ("41111111111111111111", False, None)), ("1234567 1234567 1234567", ("12345671234567", False, None)), ("", None), ("x" * 100 + " 4111111111111111", None),
    ],
)
def test_card(text, want):
    found = [(value, masked, suffix) for kind, value, _, masked, suffix, _ in identifiers_of(f"credit card: {text}") if kind == "card"]
    assert found == ([want] if want else [])
