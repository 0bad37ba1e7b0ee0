"""Problem 3 on long messages: the share is that of the letters, and instructions may be long."""

import pytest

from strandline.llm import residue

AUTO = residue._automaton()
IDS = " ".join(f"req-{i}f3a9c0d{i} 192.0.2.{i} host{i}.example 2024-01-02t03:04:0{i}z" for i in range(1, 8))
LONG = "what you changed and why, which issue it closes and how reviewers can try it out on their own machines"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (f"502 Bad Gateway {IDS}", "error"), (f"502 Bad Gateway {IDS} came back since the pool closed its sockets too early", None),
        (f"[Please describe {LONG}]", "template"), (f"<describe {LONG}>", "template"), ("Adds {{ " + LONG.replace(",", "") + " }}", "template"),
    ],
)
def test_long_residue(text, kind):
    assert len(text) > 80 and residue.kind_of(AUTO, text) == kind


def test_the_early_exit_changes_nothing(monkeypatch):
    texts = [f"502 Bad Gateway {IDS}"[:n] + " the pool closed its sockets" * k for n in range(10, 300, 23) for k in range(4)]
    quick = [residue.kind_of(AUTO, t) for t in texts]
    monkeypatch.setattr(residue, "MAYBE_ID", type("All", (), {"search": lambda self, w: True})())
    assert quick == [residue.kind_of(AUTO, t) for t in texts] and "error" in quick and None in quick
