"""Instances and patterns of personal data around long runs, against plain scans of the text."""

import random
import re
import time

import pytest

from ledgerlens.llm import pii


def brute(text):
    """Identifier-like tokens with the two words before them."""
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Za-z0-9](?:[A-Za-z0-9_.@+-]*[A-Za-z0-9])?", text):
        words = re.findall(r"[^\W\d_]+", text[: m.start()])[-2:]
        if 5 <= len(m[0]) <= 64 and re.search("[0-9]", m[0]) and words:
            out.append((" ".join(words).lower(), m[0].lower(), m.start(), m.end(), False))
    return out


RUN = "a" * 70
CASES = {
    RUN + "1": [],
    RUN + "1 next42": [(RUN, "next42", 72, 78, False)],
    "see " + RUN + "1 next42 end": [("see " + RUN, "next42", 76, 82, False)],
    "call me " + "." * 90 + " next42": [("call me", "next42", 99, 105, False)],
}


@pytest.mark.parametrize("text", CASES)
def test_long_runs(text):
    assert pii.instances(text, []) == CASES[text]


def test_seed_after_a_long_gap():
    text = "write to" + " " * 80 + "x@y.z"
    assert pii.instances(text, pii.base_spans(text)) == [("write to", "x@y.z", 88, 93, True)]


def test_random_texts():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices(["a", "é9", "_", ".", "-", "@", " ", "42", "id", "b" * 66, " " * 70], k=40))
        assert pii.instances(text, []) == brute(text)


def test_long_texts_stay_linear():
    began = time.time()
    pii.instances("a" * 2_000_000 + "1 " + "_" * 2_000_000 + "1-" * 1_000_000, [])
    assert time.time() - began < 20
