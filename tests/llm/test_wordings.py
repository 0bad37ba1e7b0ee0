"""Ordinary wordings that the rules of problems 2 and 3 must keep apart, and the quick looks on a whole table."""

import pandas as pd
import pytest

from strandline.llm import pii, residue
from test_gates import Open

AUTO = residue._automaton()
REAL = """Fix test|Add test|Unit test|Fix server error|Handle connection refused|Handle fatal error|Fix segmentation fault|Retry on bad gateway|Page not found handling
Allow cookies|Disable cookies|Add security check|Enable scripts|Show page not found for unknown ids|Return service unavailable when the pool is empty|Update sample text""".replace("\n", "|").split("|")


@pytest.mark.parametrize("text", REAL)
def test_short_real_messages_stay(text):
    assert residue.kind_of(AUTO, text) is None


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Bad Gateway", "error"), ("404 Not Found", "error"), ("Access denied", "error"), ("Service Unavailable. Please try again later.", "error"), ("blah blah blah tree blah blah", "filler"), ("Testing", "filler"),
        ("Enable JavaScript to continue", "script"), ("JavaScript is required.", "script"), ("服务暂时不可用", "error"), ("Zugriff verweigert", "error"),
    ],
)
def test_residue_of_few_words(text, kind):
    assert residue.kind_of(AUTO, text) == kind


@pytest.mark.parametrize("text", ["Port the Visual Basic sample", "Build on Apple Silicon", "Use Boyer Moore for search", "Hosted in San Francisco now", "Deploy to Microsoft Azure", "Works in Mozilla Firefox", "Uses Diffie Hellman exchange"])
def test_products_places_and_methods_are_no_persons(text):
    assert pii.kinds_in(text) == set()


@pytest.mark.parametrize(
    ("text", "out"),
    [
        ("write to jürgen@müller.example now", "write to [EMAIL] now"), ("почта: иван@пример.рф, спасибо", "почта: [EMAIL], спасибо"),
        ("thanks to priya raman for the patch", "thanks to [PERSON_NAME] for the patch"), ("suggested by maria lopez for the parser", "suggested by [PERSON_NAME] for the parser"),
        ("passport number" + " " * 90 + "X49030990", "passport number" + " " * 90 + "[ID_NUMBER]"), ("his passport number, as given: no. is X49030990", "his passport number, as given: no. is [ID_NUMBER]"),
    ],
)
def test_wordings_that_were_missed(text, out):
    assert pii.redacted(text) == out


def test_the_quick_looks_lose_nothing_of_a_whole_table(monkeypatch):
    rows = pd.read_parquet("/root/testdata/sf0.01/event_details.parquet", columns=["message", "author"])
    texts = [(f, t) for f in rows.columns for t in rows[f].dropna().unique() if t]
    gated = [pii.finds(pii.Normal(t), f) for f, t in texts]
    for name in ("HINT_AT", "DIGIT", "SOME_DIGITS", "MANY_DIGITS", "MAYBE_LIST", "MAYBE_INITIAL", "MAYBE_FULL"):
        monkeypatch.setattr(pii, name, Open())
    for name in ("may_spell", "may_speak"):
        monkeypatch.setattr(pii, name, lambda text: True)
    assert gated == [pii.finds(pii.Normal(t), f) for f, t in texts] and sum(map(len, gated)) > 500
