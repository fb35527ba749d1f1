"""Maximal segments against brute force, tail fit, evidence of the corpus, and the operator's edge cases."""

import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quarrylight.llm import toxicity as X


def maximal(scores):
    """All maximal-scoring segments by their definition: every proper prefix and suffix is positive, and none contains another."""
    good = []
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = scores[a:b]
            if all(sum(s[:i]) > 0 for i in range(1, len(s) + 1)) and all(sum(s[i:]) > 0 for i in range(len(s))):
                good.append((a, b))
    return [x for x in good if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in good)]


@given(st.lists(st.integers(-4, 4), max_size=14))
def test_segments(scores):
    found = X.segments([float(s) for s in scores])
    assert [(a, b) for a, b, _ in found] == maximal(scores)
    assert all(s == sum(scores[a:b]) for a, b, s in found)


def test_folding_and_places():
    folder = X.Folder()
    text = "You  are f i l t h, M0R0NS and idiоts!"
    tokens, at = folder.spans(text)
    assert tokens == folder(text) == ["you", "are", "filth", "morons", "and", "idiots"]
    assert [text[a:b] for a, b in at] == ["You", "are", "f i l t h", "M0R0NS", "and", "idiоts!"]
    assert folder(None) == [] and folder.spans("") == ([], [])


def test_tail_of_an_exponential_law():
    rng = random.Random(5)
    tops = [(max(0.0, (-math.log(-math.log(rng.random())) + math.log(0.1 * 80)) / 0.7), 80) for _ in range(20000)]
    scale, k = X.tail(tops)
    assert scale == pytest.approx(0.7, rel=0.1) and k == pytest.approx(0.1, rel=0.35)


CLEAN = "the bridge over the river needs a new plan and the council should ask who will pay for the work".split()
INSULTS = ["you filthy brainless maggots crawl away", "drop dead you stinking vermin", "only brainless maggots sign this"]


def _corpus(n=1500, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [" ".join(rng.choice(CLEAN) for _ in range(12)) for _ in range(3)]
        if i % 3 == 0:
            words.insert(1, "nobody at the desk has shown data")  # harmless, frequent, and in abusive comments too
        bad = i % 20 == 0
        if bad:
            words.insert(1, rng.choice(INSULTS))
        rows.append((f"c{i}", ". ".join(words), f"D{i % 4}", "Web " if i % 2 else "web"))
        if (bad and i % 40 == 0) or i % 25 == 1:
            labels.append((f"c{i}", int(bad)))
    return rows, labels


SCHEMA = "comment_id string, comment_clean string, docket_id string, channel string"


def test_operator(spark):
    rows, labels = _corpus()
    odd = [("c0", rows[0][1], "D0", "web"), ("n", None, None, None), ("e", " ", "D1", None), (None, rows[0][1], "D1", "web")]
    comments = spark.createDataFrame(rows + odd, SCHEMA)
    voted = spark.createDataFrame(labels + [("c3", None), ("c5", 0), ("c5", 1)], "comment_id string, is_abusive int")
    want = {f"c{i}" for i in range(0, 1500, 20)}
    assert {r.comment_id for r in X.abusive(comments, voted).collect()} == want
    scored = {r.comment_id: r for r in X.scored(comments, voted).collect()}
    assert len(scored) == 1502 and {k for k, r in scored.items() if r.is_abusive} == want
    assert (scored["n"].score, scored["n"].p_value) == (scored["e"].score, scored["e"].p_value) == (0.0, 1.0)
    texts = {r[0]: r[1] for r in rows}
    for r in X.passages(comments, voted).filter("comment_id is not null").collect():
        assert r.passage == texts[r.comment_id][r.start_char : r.end_char] and "nobody" not in r.passage
    rate = {(r.kind, r.name): (r.comments, r.abusive) for r in X.rates(comments, voted).collect()}
    assert rate["channel", "web"] == (1500, 75) and sum(b for (k, _), (_, b) in rate.items() if k == "docket") == 75


def test_without_labels(spark):
    comments = spark.createDataFrame([("a", "drop dead", "D", "web")], SCHEMA)
    none = spark.createDataFrame([], "comment_id string, is_abusive int")
    assert X.abusive(comments, none).count() == 0
    assert X.scored(comments, none).first().p_value == 1.0
    assert X.abusive(comments.limit(0), none).count() == 0
