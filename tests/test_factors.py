"""Themes against a dense factorisation: terms, weights of the documents and the conditions of a least error."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import factors

ODD = [None, "", "the of 12 <b>", "https://a.test/visa www.b.test/fee", "Zyzzyva", "<p>Visa</p>FEE_waiver/form-i9 'quota' c++ Kind visa fee 3days", "don't stop-gap e.g. x.y.zeta"]
WORDS = ["visa fee form delay cost".split(), "school student campus course degree".split(), "rabies puppy kennel vet leash".split()]


def texts():
    r = np.random.default_rng(1)
    return [" ".join(r.choice(WORDS[i % 3] + ["common", WORDS[(i + 1) % 3][0]], 9)) for i in range(60)] + ODD


def dense(spark, docs):
    """(keys, terms, X), a row for each document with a topic token."""
    rows = docs.select("id", T.topic_tokens(F.col("x")).alias("t")).filter("size(t) > 0").orderBy("id").collect()
    counts = []
    for r in rows:
        t = [w for w in re.findall(r"[a-z0-9_]{2,}", " ".join(r.t)) if w not in T.STOPWORDS]
        counts.append(Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:])]))
    n, df = len(rows), Counter(w for c in counts for w in c)
    names = sorted(w for w, k in df.items() if 2 <= k <= 0.95 * n)
    x = np.array([[c[w] * (np.log((1 + n) / (1 + df[w])) + 1) for w in names] for c in counts])
    return [r.id for r in rows], names, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def best(h, x):
    """Least squares with weights >= 0, by trying every set of themes."""
    tried = [np.zeros(len(h))]
    for s in (list(s) for n in range(1, len(h) + 1) for s in combinations(range(len(h)), n)):
        w = np.zeros(len(h))
        w[s] = np.linalg.lstsq(h[s].T, x, rcond=None)[0]
        tried += [w] * int((w >= 0).all())
    return min(tried, key=lambda w: np.linalg.norm(x - w @ h))


def test_themes_have_the_least_error(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "id long, x string").repartition(3)
    rows, terms = factors.themes(docs, "id", "x", 3)
    keys, names, x = dense(spark, docs)
    h = np.zeros((3, len(names)))
    for r in terms.collect():
        h[r.theme, names.index(r.term)] = r.weight
    w = np.array([best(h, v) for v in x])
    got = {r.id: (r.theme, r.strength) for r in rows.collect()}
    assert list(sorted(got)) == keys
    for k, v in zip(keys, w):
        assert abs(got[k][1] - v.max()) < 2e-6 and v[got[k][0]] > v.max() - 2e-6
    slope = w.T @ w @ h - w.T @ x
    assert np.abs(np.where(h > 0, slope, np.minimum(slope, 0))).sum() < 1e-3 * (w.T @ x).sum()
    assert np.allclose(np.linalg.norm(w, axis=0), np.linalg.norm(h, axis=1), rtol=1e-3)
    assert got[texts().index("Zyzzyva")] == (0, 0.0)
    assert len({got[i][0] for i in range(3)}) == 3 and np.mean([got[i][0] == got[i % 3][0] for i in range(60)]) > 0.9


def test_themes_of_few_documents(spark):
    for few in ([], [None], ["the"], ["visa"], ["visa fee", "school"]):
        rows, terms = factors.themes(spark.createDataFrame([(str(i), v) for i, v in enumerate(few)], "id string, x string"), "id", "x")
        assert rows.count() == sum(v not in (None, "the") for v in few)
        assert (terms.count() > 0) == (len(few) == 2)


def test_nonnegative_is_exact():
    r = np.random.default_rng(2)
    h, x = np.abs(r.normal(size=(4, 9))), r.normal(size=(50, 9))
    assert np.allclose(factors.nonnegative(h @ h.T, h @ x.T).T, [best(h, v) for v in x], atol=1e-6)


def test_nonnegative_by_sets_of_rows():
    r = np.random.default_rng(3)
    h, x = np.abs(r.normal(size=(8, 12))) ** 2, np.abs(r.normal(size=(3000, 12))) ** 3
    g, b = h @ h.T, h @ x.T
    w = factors.nonnegative(g, b, sweeps=0)  # no descent
    slope = g @ w - b
    assert (w >= 0).all() and (slope > -1e-9 * np.abs(b).max()).all() and np.abs(slope * w).max() < 1e-8 * np.abs(b).max() ** 2
    assert 0.2 < (w == 0).mean() < 0.9
    assert np.allclose(w, factors.nonnegative(g, b, inverses=factors._inverses(g)))


def test_nonnegative_of_equal_zero_and_many_rows():
    r = np.random.default_rng(4)
    h, x = np.abs(r.normal(size=(11, 30))), np.abs(r.normal(size=(200, 30))) ** 2
    for rows in (h[[0, 1, 1, 2]], np.vstack([h[:3], np.zeros((1, 30))]), np.zeros((1, 30)), h):
        w = factors.nonnegative(rows @ rows.T, rows @ x.T)
        slope = rows @ rows.T @ w - rows @ x.T
        assert (w >= 0).all() and slope.min() > -1e-5 and np.abs(slope * w).max() < 1e-5
    assert factors.nonnegative(h @ h.T, np.zeros((11, 0))).shape == (11, 0)


def test_texts_with_and_without_marks(spark):
    odd = ODD + ["a<b", "<", "x <b>y</b> <", "see http", "http://", "HTTPS://a.b c", "www.a.b<i>c", "ht<b>tp://x y", "w<i>ww.q z"]
    docs = spark.createDataFrame([(v,) for v in odd], "x string")
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce("x", F.lit("")), r"<[^>]+>", " "), r"https?://[^\s]+|www\.[^\s]+", " URL "))
    assert docs.filter(factors._plain("x") != plain).count() == 0


def test_passes_leave_the_session_as_it_is(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 77)
        factors.themes(spark.createDataFrame([(i, v) for i, v in enumerate(texts())], "id long, x string"), "id", "x", 2)
        assert spark.conf.get(name) == "77"
    finally:
        spark.conf.set(name, before)
