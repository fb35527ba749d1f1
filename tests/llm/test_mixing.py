"""Shares reached, caps kept, edge cases."""

import pytest

from quarrylight.llm import mixing as M
from quarrylight.llm import tokens

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(tokens.TOKENIZERS), reason="no tokenizer files")


def _docs(spark):
    rows = [(i, "a" if i < 400 else "b" if i < 520 else "c", "word " * (1 + i * 7 % 90), 0) for i in range(600)]
    rows += [(3, "a", "word " * 22, 0), (900, None, "word", 0), (901, "a", None, 0), (902, "z", "word", 0), (None, "a", "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, slot int")


def test_shares_and_caps(spark):
    targets = spark.createDataFrame([("a", 0.3, 3), ("b", 0.5, 4), ("c", 0.1, 2), ("gone", 0.1, 5), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    copies, report = M.mix(_docs(spark), targets)
    cap = {"a": 3, "b": 4, "c": 2}
    rows = copies.collect()
    assert rows and all(1 <= r.copies <= cap[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    shares = {r.source: r.share for r in report.collect()}
    assert shares["gone"] == 0.0
    for source, target in (("a", 1 / 3), ("b", 5 / 9), ("c", 1 / 9)):
        assert shares[source] == pytest.approx(target, abs=0.01)


def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    copies, report = M.mix(_docs(spark).limit(0), targets)
    assert copies.count() == 0 and [r.share for r in report.collect()] == [0.0]
