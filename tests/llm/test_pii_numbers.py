"""Pseudonyms: permutations that can be undone, valid for valid, linked across spellings; whole numbers."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quarrylight.llm import pii

K = b"k"


@given(st.from_regex(r"[A-Z]{0,3}-?[0-9]{2,12}[A-Z]?", fullmatch=True))
def test_undone(value):
    for kind in ("PHONE", "ID_NUMBER"):
        new = pii.permute_number(value, K, kind=kind)
        assert pii.permute_number(new, K, undo=True, kind=kind) == value
        assert re.sub("[0-9]", "0", re.sub("[A-Z]", "A", new)) == re.sub("[0-9]", "0", re.sub("[A-Z]", "A", value))


def test_small_formats_are_permutations():
    for n in (2, 3):
        assert len({pii._feistel(f"{i:0{n}d}", K) for i in range(10**n)}) == 10**n


def test_valid_for_valid():
    for i in range(100):
        d = f"2{i:02d}5{i % 10}01234"
        assert pii._VALID["PHONE", 10](pii.permute_digits(d, "PHONE", K))
    assert pii._luhn("4111111111111111") and pii._luhn(pii.permute_digits("4111111111111111", "ID_NUMBER", K))


def digits(x):
    return re.sub(r"\D", "", x)


def test_linked():
    plain = digits(pii.placeholder("555-123-4567", "PHONE", K))
    assert digits(pii.placeholder("(555) 123-4567", "PHONE", K)) == plain
    for other in ("+1 555 123 4567", "1-555-123-4567"):
        assert digits(pii.placeholder(other, "PHONE", K)) == "1" + plain
    assert digits(pii.placeholder("555-123-4567 ext. 12", "PHONE", K)).startswith(plain)
    said = "triple five one two three four five six seven"
    assert digits(pii.placeholder(said, "PHONE", K)) == plain
    assert pii.said_digits("double oh seven") == "007"


def test_whole_card_number():
    text = "my card 4111 1111 1111 1111 was charged"
    assert [text[a:b] for a, b, _ in pii.find(text)] == ["4111 1111 1111 1111"]
    assert "1111" not in pii.redact(text, b"z")


@pytest.mark.parametrize("date", ["1990-02-03", "12 May 1990", "May 12, 1990", "05/12/1990"])
def test_dates_of_birth(date):
    out = pii.redact(f"I was born on {date}.", K)
    assert date not in out and re.sub("[0-9]", "0", re.sub("[A-Z][a-z]+", "M", out[14:])) == re.sub("[0-9]", "0", re.sub("[A-Z][a-z]+", "M", f"{date}."))


def test_edge_cases(spark):
    assert pii.find(None) == pii.find("") == [] and pii.redact(None, K) is None and pii.redact(" ", K) == " "
    rows = [("a", "call 555-123-4567", 1), ("a", "call 555-123-4567", 1), ("b", None, 1), (None, "call 555-123-4567", 1)]
    df = spark.createDataFrame(rows, "comment_id string, comment_clean string, rec_id int")
    assert [tuple(r) for r in pii.items(df, "t", "comment_id", "comment_clean").collect()] == [("t", "a", "PHONE", 5, 17)]
    assert sorted((r.rec_id, r.text is None) for r in pii.redacted(df, "t", "comment_id", "comment_clean", K).collect()) == [("a", False), ("b", True)]
    assert pii.items(df.limit(0), "t", "comment_id", "comment_clean").count() == 0
