"""Candidates, acceptance and redaction against plain versions."""

import random
import time

import numpy as np
import pytest

from quillmark.llm import pii


def walked(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def plain_accept(text):
    """Every candidate scored by itself, then compared with all that stand."""
    m, base = pii.model(), pii.base_spans(text)
    scored = []
    for kind, a, b in pii.candidates(text):
        row = pii.features(text, kind, a, b)
        raw = m.trees.start + m.trees.rate * sum(walked(t, row) for t in m.trees.trees)
        p = 1 / (1 + np.exp(-(m.a * raw + m.b)))
        if p >= m.threshold[kind]:
            scored.append((-p, a - b, a, kind, b))
    out = []
    for _, _, a, kind, b in sorted(scored):
        if all(b <= x or y <= a for _, x, y in [*base, *out]):
            out.append((kind, a, b))
    return sorted(out, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def plain_redact(text, spans):
    """Code point by code point."""
    kind = [None] * (len(text) + 1)
    groups = []
    for k, a, b in sorted(spans, key=lambda s: s[1:]):
        if groups and a < groups[-1][1]:
            groups[-1] = (groups[-1][0], max(groups[-1][1], b), min(groups[-1][2], pii.KINDS.index(k)))
        else:
            groups.append((a, b, pii.KINDS.index(k)))
    for a, b, k in groups:
        kind[a:b] = [(a, k)] * (b - a)
    out = []
    for i, c in enumerate(text):
        if kind[i] is None:
            out.append(c)
        elif kind[i][0] == i:
            out.append(f"[{pii.KINDS[kind[i][1]].upper()}]")
    return "".join(out)


def test_acceptance_and_redaction_match_plain_versions():
    r, rows = random.Random(7), pii.examples(400, seed=21)
    for _ in range(120):
        text = " ".join(r.choice(rows)[0] for _ in range(r.randint(1, 6))) + r.choice(("", " +1 (509) 555-6973 4111111111111111", " a.b@c.org 10.2.3.4"))
        base = pii.base_spans(text)
        added = pii.model().accept(text, base)
        assert added == plain_accept(text)
        assert pii.redact(text, base + added) == plain_redact(text, base + added)


def test_held_out_examples():
    """Recall and precision by kind on examples of another seed."""
    m, hit, miss, wrong = pii.model(), {}, {}, {}
    for text, kind, a, b, label in pii.examples(2100, seed=77):
        found = (kind, a, b) in m.accept(text, [])
        for table, is_so in ((hit, label and found), (miss, label and not found), (wrong, not label and found)):
            table[kind] = table.get(kind, 0) + int(bool(is_so))
    for kind in pii.ADDED_KINDS:
        assert hit[kind] / (hit[kind] + miss[kind]) > 0.9 and hit[kind] / (hit[kind] + wrong[kind]) > 0.93, kind


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("password: QzXwVbNmKjHgFdSa end", [("secret", 10, 26)]),  # no digit
        ('api_key = "abcDEFghiJKLmnoPQRstuVWXyz"', [("secret", 11, 37)]),
        ('token = "' + "aB3x" * 45 + '" x', [("secret", 9, 189)]),
        ("key: responsibilities of", []),
        ("see getElementsByClassName here", []),
        ("mail " + "x" * 200 + ".y [at] " + "d" * 80 + " [dot] a" * 6 + " [dot] com now", [("contact", 5, 351)]),
        ("", []),
    ],
)
def test_candidates_of_any_length(text, spans):
    assert pii.model().accept(text, pii.base_spans(text)) == spans


def test_redaction_is_linear():
    text = " ".join(f"a{i}@b.com" for i in range(100_000))
    spans, began = pii.base_spans(text), time.monotonic()
    assert pii.redact(text, spans) == " ".join(["[EMAIL]"] * 100_000)
    assert time.monotonic() - began < 5


@pytest.mark.parametrize(
    ("text", "span"),
    [
        ("call 06 12 34 56 78 today", ("local_phone", 5, 19)), ("tel. (030) 901820 now", ("local_phone", 5, 17)), ("telefon 0301/4567890.", ("local_phone", 8, 20)),
        ("iban de89 3704 0044 0532 0130 00 end", ("iban", 5, 32)), ("ssn 536 22 8726.", ("national_id", 4, 15)), ("write john dot doe at example dot com please", ("contact", 6, 37)),
    ],
)
def test_written_shapes_are_proposed_and_accepted(text, span):
    assert span in pii.candidates(text) and pii.model().accept(text, pii.base_spans(text)) == [span]


@pytest.mark.parametrize("text", ["order 12 34 56 78 90 parts", "see section 536 22 8726 there", "look at page dot something", "version 0301/4567890"])
def test_look_alikes_stay(text):
    assert pii.model().accept(text, pii.base_spans(text)) == []


def test_scans_of_chains_are_linear():
    for text in ("x dot " * 100_000, "a at " * 100_000, "12 " * 200_000, "0" * 500_000, "ab12 " * 100_000):
        began = time.monotonic()
        pii.candidates(text)
        assert time.monotonic() - began < 5


@pytest.mark.parametrize("first", "0123456789")
def test_found_cards_of_every_first_digit_are_redacted(first):
    body = first + "23456789012345"
    card = next(body + c for c in "0123456789" if pii.luhn(body + c))
    text = f"pay with {card} now"
    assert pii.base_spans(text) == [("card", 9, 25)] and pii.redact(text, pii.base_spans(text) + pii.model().accept(text, pii.base_spans(text))) == "pay with [CARD] now"
