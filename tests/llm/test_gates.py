"""The quick looks before the detectors of problem 2 reject nothing that those would find."""

import pytest

from strandline.llm import pii

FINDS = {
    "(reported by jane doe)": "person_name",
    "thanks to jane doe for spotting this": "person_name",
    "found by jean-luc picard.": "person_name",
    "credit: jane doe.": "person_name",
    'kudos: "x", idea: j. mirvo harkez': "person_name",
    "thanks to D'arcy Mirvold": "person_name",
    "Tel. 030 / 123456": "phone",
    "Telefon: 0221 - 987654": "phone",
    "passport no. A1B2C3D4E5 attached": "id_number",
    "call one 2 three 4 five 6 7 8 9": "phone",
    "zoe.m at inbox punkt example": "email",
    "seen at 12A Mirvold Street": "street_address",
    "(Hauptstraße 5)": "street_address",
    "au 12 ter rue des Lilas": "street_address",
}
PLAIN = ["fix: arena overrun", "test: parser coverage", "fixed by using memcpy", "meet at noon. then 1 2 3", "seen one 2 three", "step 3 of 5 on 2024-01-02"]


class Open:
    def search(self, text):
        return True


@pytest.mark.parametrize("text", [*FINDS, *PLAIN])
@pytest.mark.parametrize("field", ["message", "author"])
def test_finds_are_the_same_without_the_gates(monkeypatch, text, field):
    gated = pii.finds(pii.Normal(text), field)
    for name in ("HINT_AT", "DIGIT", "SOME_DIGITS", "MANY_DIGITS", "MAYBE_LIST", "MAYBE_INITIAL", "MAYBE_FULL"):
        monkeypatch.setattr(pii, name, Open())
    for name in ("may_spell", "may_speak"):
        monkeypatch.setattr(pii, name, lambda text: True)
    assert pii.finds(pii.Normal(text), field) == gated


@pytest.mark.parametrize(("text", "kind"), FINDS.items())
def test_finds_that_narrower_gates_lost(text, kind):
    assert kind in pii.kinds_in(text)
