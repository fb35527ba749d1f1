"""Joins and orders against brute force."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import dedup, evidence, ordered, sampling, search, verify

C = F.col


@given(st.text(min_size=0, max_size=60), st.integers(0, 50), st.integers(0, 40))
@settings(max_examples=300)
def test_anchors_of_a_part_are_anchors_of_the_whole(text, start, size):
    assert set(evidence.anchors(text[start : start + size]).tolist()) <= set(evidence.anchors(text).tolist())


def test_quotes_of_any_script(spark):
    texts = ["The quick brown fox jumps over the lazy dog.", "学校需要至少五十七个月来调整这些规定。", "قد يتأثر نحو ستمئة زائر في المدينة", "short ab text", None, " "]
    quotes = ["quick  brown FOX", "需要至少五十七个月来", "يتأثر نحو ستمئة زائر", "ab", "not in any of them", "", None]
    s = spark.createDataFrame([("g", t) for t in texts] + [("g", texts[0]), ("h", texts[1]), (None, texts[0])], "g string, t string")
    q = spark.createDataFrame([("g", x) for x in quotes] + [("g", "ab"), (None, "ab"), ("h", "至少五十七个月来调整")], "g string, q string")
    got = sorted(((r.g or "", r.q or "", r.sources, r.found) for r in evidence.verify_quotes(q, s, "g", "q", "t").collect()))
    want = {"quick  brown FOX": 2, "需要至少五十七个月来": 1, "يتأثر نحو ستمئة زائر": 1, "ab": 1}
    assert got == sorted([("g", x or "", want.get(x, 0), x in want) for x in quotes] + [("g", "ab", 1, True), ("", "ab", 0, False), ("h", "至少五十七个月来调整", 1, True)])


def test_overlaps_of_all_lengths(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        start = rng.uniform(-500, 5000)
        rows.append((rng.choice("xy"), i, start, start + rng.choice([0.0, 5.0, 59.0, 60.0, 700.0, 40000.0, -30.0, -4000.0])))
    rows += [("x", 900, None, 1.0), ("x", 901, 1.0, None), (None, 902, 0.0, 9.0), ("x", 903, float("nan"), 3.0)]
    good = [r for r in rows if r[0] and r[2] is not None and r[3] is not None and r[2] == r[2]]
    want = {(a[1], b[1]) for a in good for b in good if a[0] == b[0] and a[1] < b[1] and a[2] < b[3] and a[3] > b[2]}
    got = [tuple(r) for r in evidence.overlapping(spark.createDataFrame(rows, "g string, k int, s double, e double"), "g", "k", "s", "e").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_ranges_end_at_the_least_span(spark):
    df = spark.range(1010).select(F.timestamp_seconds(F.lit(77)).alias("ts"))
    assert [tuple(r) for r in ordered.split_ranges(df, "ts", 5, 0).collect()] == [(77, 78, 1010)]
    wide = spark.range(3000).select(F.timestamp_seconds(C("id") * C("id")).alias("ts"))
    got = sorted(tuple(r) for r in ordered.split_ranges(wide, "ts", 100, 10).collect())
    assert sum(n for *_, n in got) == 3000 and all(n <= 100 or b - a <= 10 for a, b, n in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    assert ordered.split_ranges(wide.limit(0), "ts", 100, 10).count() == 0


def test_deep_paths_and_long_chains(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}") for i in range(70)], "id int, parent int, name string")
    deep = ordered.paths(chain, "id", "parent", "name").orderBy("level").collect()
    assert len(deep) == 70 and len(deep[-1].path) == 70
    nodes, edges = spark.range(200).select("id"), spark.range(198).select(C("id").alias("a"), (C("id") + 1).alias("b"))
    assert {r.id: r.root for r in dedup.components(nodes, edges).collect()} == {i: 0 if i < 199 else 199 for i in range(200)}


def test_similar_pairs(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SPLIT", 7)
    rng, words = random.Random(9), [f"w{i}" for i in range(60)]
    base = [rng.choice(words) for _ in range(90)]
    docs = []
    for i in range(60):
        t = list(base if i % 2 else [rng.choice(words) for _ in range(90)])
        for _ in range(i % 3):
            t[rng.randrange(90)] = rng.choice(words)
        docs.append((i, " ".join(t)))
    docs += [(60, docs[1][1].upper()), (61, None), (62, "few words")]

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    pairs, members = dedup.similar_pairs(spark.createDataFrame(docs, "id int, t string"), "id", "t")
    rep = {r.id: r.representative for r in members.collect()}
    sets = {i: grams(t) for i, t in docs}
    want = set()
    for a in set(rep.values()):
        for b in set(rep.values()):
            x, y = sets[a], sets[b]
            if a < b and len(x) >= 12 and len(y) >= 12 and len(x & y) / len(x | y) >= 0.85:
                want.add((a, b))
    assert rep[60] == rep[1] and {(r.a, r.b) for r in pairs.collect()} == want and want


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(search, "ROWS", 40)
    monkeypatch.setattr(search, "ASKED", 3)
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(150)] + [(150, "a", None)]
    e = spark.createDataFrame(rows, "id long, label string, v array<float>")
    q = e.filter("id % 20 = 0").select(C("id").alias("query_id"), "v")
    cosine = e.alias("e").join(q.alias("q"), C("e.id") != C("q.query_id")).select("query_id", "label", "id", F.round(search.cosine(C("q.v"), C("e.v")), 6).alias("score")).filter("score is not null")
    plain = {}
    for r in sorted(cosine.collect(), key=lambda r: (-r.score, r.id)):
        plain.setdefault((r.query_id, r.label), []).append((r.id, r.score + 0.0))
    got = {}
    for r in search.nearest(e, "id", "label", "v", q, 3).orderBy("rank").collect():
        got.setdefault((r.query_id, r.label), []).append((r.id, r.score + 0.0))
    assert got == {k: v[:3] for k, v in plain.items()}


def test_numbers_in_order(spark):
    df = spark.range(1000).select(F.pmod(C("id") * 37, F.lit(50)).alias("v"), "id").repartition(7)
    got = sampling.numbered(df, [C("v"), C("id")], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 1001)) and [(r.v, r.id) for r in got] == sorted((r.v, r.id) for r in got)


def test_copies_and_later_rows(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (3, None, 1), (4, None, 1), (5, "b", 1)], "id int, t string, at int")
    assert {r.id: r.is_copy for r in dedup.copy_flag(df, "t").collect()} == {1: True, 2: True, 3: True, 4: True, 5: False}
    assert {r.id for r in dedup.later_flag(df.filter("t is not null"), C("t"), C("at")).filter("is_later").collect()} == {1}


def test_documents_without_a_shared_token_follow(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "red red hen", None, "blue", "green"])], "id int, t string")
    asked = spark.createDataFrame([("q", "red"), ("none", "zebra"), ("null", None)], "q string, x string")
    scores = search.bm25(docs, "id", "t", asked, "q", "x")
    got = search.ranked(scores, asked, "q", docs, "id", 4).orderBy("q", "rank").collect()
    assert [r.id for r in got if r.q == "q"] == [1, 0, 2, 3] and [r.id for r in got if r.q == "none"] == [0, 1, 2, 3] == [r.id for r in got if r.q == "null"]


def test_best_matches(spark):
    a = spark.createDataFrame([(1, "one two three four"), (2, "x"), (3, None), (4, "five six seven")], "id int, text string")
    b = spark.createDataFrame([(9, "four three two one"), (8, "one two three four five"), (7, "five six seven"), (6, "Seven six FIVE")], "id int, text string")
    assert sorted((r.a, r.b, r.similarity) for r in verify.best_matches(a, b, 0.6).collect()) == [(1, 9, 1.0), (4, 6, 1.0)]


@pytest.mark.parametrize("text, want", [("In 1,234 cases of f-1 and form i-20, six weeks", ["1234", "6"]), ("3º at 12.5% (sixty)", ["12.5", "60"]), ("至少10个月", []), (None, [])])
def test_numbers(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.numeric_tokens(C("t")).alias("n")).first().n == sorted(want)


def shuffled(spark):
    """Bytes that all stages so far wrote for shuffles."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_similar_pairs_shuffle_little(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(f"w{rng.randrange(100_000)}" for _ in range(300))) for i in range(600)]
    docs += [(600 + i, t.replace(" ", "  ", 9) + " more") for i, t in docs[:20]] + [(700, ""), (701, " !"), (702, None)]
    df = spark.createDataFrame(docs, "id int, t string").repartition(2).localCheckpoint()
    before = shuffled(spark)
    pairs, members = dedup.similar_pairs(df, "id", "t")
    assert {(r.a, r.b) for r in pairs.collect()} == {(i, 600 + i) for i in range(20)} and members.count() == len(docs)
    assert shuffled(spark) - before < 600 * 300 * 16


def test_one_text(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "x"), (None, "y"), (None, "z"), (3, None), (3, "q"), (4, None), (4, None)], "k int, t string")
    want = {(1, "b"), (2, "x"), (None, "z"), (3, "q"), (4, None)}
    for most in (1_000, 0):
        monkeypatch.setattr(dedup, "BROADCAST", most)
        got = [tuple(r) for r in dedup.one_text(df, "k", "t").collect()]
        assert set(got) == want and len(got) == len(want)


def test_best_matches_of_one_pattern_shuffle_little(spark):
    pattern = lambda i: f"court hears case on the filing fee in town{i}"
    a = spark.createDataFrame([(i, pattern(i)) for i in range(0, 900, 2)], "id int, text string").repartition(2).localCheckpoint()
    b = spark.createDataFrame([(5000 - i, pattern(i % 600)) for i in range(1200)], "id int, text string").repartition(2).localCheckpoint()
    before = shuffled(spark)
    got = {r.a: (r.b, r.similarity) for r in verify.best_matches(a, b, 0.6).collect()}
    assert got == {i: (5000 - i - 600, 1.0) if i < 600 else (3801, 0.8) for i in range(0, 900, 2)}
    assert shuffled(spark) - before < 190_000
