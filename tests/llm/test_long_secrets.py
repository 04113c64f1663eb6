"""Secrets longer than any bound are candidates as a whole."""

import random
import string

import pytest

from quillmark.llm import pii


@pytest.mark.parametrize("n", [40, 128, 129, 700])
def test_long_tokens_are_found(n):
    r = random.Random(n)
    token = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n))
    text = f"api_key = {token} and more"
    assert ("secret", 10, 10 + n) in pii.candidates(text)
    assert pii.redact(text, pii.model().accept(text, [])) == "api_key = [SECRET] and more"
