"""Items that the tests before the patterns once kept from being searched."""

import pytest

from quarrylight.llm import pii


@pytest.mark.parametrize(
    "text, value, kind",
    [
        ("my file number out loud, six six zero zero zero two six zero six", "six six zero zero zero two six zero six", "ID_NUMBER"),
        ("call five,five,five,five,five,five,five.", "five,five,five,five,five,five,five", "PHONE"),
        ("I live at 12 Elm Place.", "12 Elm Place.", "ADDRESS"),
        ("1200 Main St Springfield", "1200 Main St", "ADDRESS"),
        ("12 Elm\nStreet", "12 Elm\nStreet", "ADDRESS"),
        ("write jane.doe&commat;mail.org", "jane.doe&commat;mail.org", "EMAIL"),
        ("jane ( at ) mail.org", "jane ( at ) mail.org", "EMAIL"),
        ("my wife (Jane Miller) knows", "Jane Miller", "NAME"),
        ("12 Elm ſtreet", "12 Elm ſtreet", "ADDRESS"),
    ],
)
def test_found(text, value, kind):
    assert [(text[a:b], k) for a, b, k in pii.find(text)] == [(value, kind)]


@pytest.mark.parametrize("text", ["In 2015 they took place", "by 2020 this will close", "one of six"])
def test_not_found(text):
    assert pii.find(text) == []


def test_birth_in_capitals():
    assert "1990-02-03" not in pii.redact("DATE OF BIRTH: 1990-02-03", b"k")
