"""Fields, sentences, quotations, claims and models on small cases: nulls, blanks, ties."""

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import fields
from quarrylight.functions import text as T
from quarrylight.operators import claims, evidence, export, models, quality, sections, verify

C = F.col


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_sentences_with_offsets(spark):
    text = '  One here. "Two?" Three (at 4 p.m. today)!\n\nno mark\n\n 5 more 😀. End'
    got = one(spark, fields.sentence_spans(C("t")), t=text)
    assert [(s.id, s.text) for s in got] == [(1, "One here."), (2, '"Two?"'), (3, "Three (at 4 p.m. today)!"), (4, "no mark"), (5, "5 more 😀."), (6, "End")]
    assert all(text[s.start : s.end] == s.text for s in got)
    assert one(spark, fields.sentence_spans(C("t")), t=None) == [] == one(spark, fields.sentence_spans(C("t")), t=" \n")


@pytest.mark.parametrize(
    "text, quote, want",
    [("a b c", "b c", (2, 5)), ("😀 a  b\nc", "a b c", (2, 8)), ("x (a+b) y", "x  (a+b)", (0, 7)), ("a b", "b a", None), ("a", "", None), ("a", " ", None), (None, "a", None), ("a", None, None)],
)
def test_locate(spark, text, quote, want):
    got = one(spark, fields.locate(C("t"), C("q")), t=text, q=quote)
    assert (got and tuple(got)) == want


def test_small_fields(spark):
    assert tuple(one(spark, fields.first_filled(("a", C("a")), ("b", C("b"))), a=" ", b="x")) == ("x", "b")
    assert one(spark, fields.page_citation(F.lit(90), C("a"), C("b")), a=5, b=7) == "90 FR 5–7"
    assert one(spark, fields.mapped(C("a"), {"x": "X"}, "other"), a=None) == "other"
    assert one(spark, fields.limited(C("a"), 5), a="abcdefg") == "abcd…" and one(spark, fields.limited(C("a"), 7), a="abcdefg") == "abcdefg"
    assert one(spark, fields.section_between(C("a"), "B\\.", "C\\."), a="A. x\nB. y\nbody\nC. z") == "B. y\nbody"
    assert [tuple(r) for r in one(spark, fields.packed_records(C("a"), ["v", "t"]), a="1 | a | b || bad || 2 | c")] == [("1", "a | b"), ("2", "c")]
    assert one(spark, fields.joined_lines(F.split("a", "\n")), a="Form I-\n94 and/\nor\n\n more ") == "Form I-94 and/or more"
    assert one(spark, fields.without_furniture(C("a"), "^Case "), a="12\nCase 1 Filed\nwell-\nknown  words") == "well-known words"
    assert one(spark, fields.rule_key(C("a")), a=None) == "" and one(spark, fields.source_text(C("a")), a="A\x00 \n b") == "A b"
    df = spark.createDataFrame([(1, 2, 3, 4)], "b int, _p int, s_z int, s_a int")
    assert fields.export_columns(df, ["b", "gone"], ["s_"]) == ["b", "s_a", "s_z"] and fields.public(df, large=["b"]).columns == ["s_z", "s_a"]


def test_traced_items(spark):
    rows = [("It rains. We stay.", "We  stay.", "claim"), ("It rains.", "It snows.", "claim"), ("It rains.", "It rains.", "odd"), (None, "x", "claim")]
    df = spark.createDataFrame(rows, "t string, q string, kind string")
    got = verify.traced(df, "t", "q", [(C("kind") != "claim", "kind")]).collect()
    assert [(r.start_char, r.end_char, r.sentence_ids or [], r.reason) for r in got] == [
        (10, 18, [2], None), (None, None, [], "quote not found"), (0, 9, [1], "kind"), (None, None, [], "quote not found"),
    ]


def test_applied_results(spark):
    prepared = spark.createDataFrame([(i, "Costs 5 dollars", ["e1", "e2"], {"e1": "it costs 5", "e2": "nothing"}) for i in range(7)], "claim_id int, claim string, retrieved array<string>, texts map<string,string>")
    results = spark.createDataFrame(
        [(1, "ok", "supported", ["e1", "e1"], "as e1 says"), (2, "ok", "supported", ["e2"], "e2"), (3, "ok", "contradicted", ["e9"], "see e9 and e91"), (4, "filtered", None, None, None), (5, "error", None, None, None), (6, "ok", "maybe", [], None)],
        "claim_id int, status string, verdict string, ids array<string>, reason string",
    )
    got = {r.claim_id: r for r in verify.applied(prepared, results).collect()}
    assert [(got[i].status, got[i].verdict, got[i].review) for i in range(7)] == [
        ("complete", "not_verifiable", True), ("complete", "supported", False), ("complete", "partially_supported", True), ("complete", "not_verifiable", True),
        ("content_filtered", "not_verifiable", True), ("model_error", "not_verifiable", True), ("complete", "not_verifiable", True),
    ]
    assert got[1].evidence_ids == ["e1"] and "Numbers not found: 5." in got[2].reason and got[3].reason.startswith("see [unknown] and e91") and got[3].evidence_ids == []


def test_model_boundary(spark):
    calls = spark.createDataFrame([("a", "one"), ("a", "one"), ("b", "bad"), ("c", "raise"), ("d", "valueerror")], "k string, r string")

    def build():
        def client(r):
            if r == "raise":
                raise TimeoutError("late")
            if r == "valueerror":
                raise ValueError("of the client")
            return "{" if r == "bad" else '{"ok": 1}'

        return client

    got = {r.k: (r.status, r.error) for r in models.ask(calls, "k", "r", build).collect()}
    assert got["a"] == ("ok", None) and got["b"][0] == "invalid" and got["c"] == ("error", "TimeoutError: late") and got["d"] == ("error", "ValueError: of the client")
    cache = spark.createDataFrame([("a", "ok", "{}", None), ("b", "error", None, "x")], "k string, status string, answer string, error string")
    assert {r.k: r.answer for r in models.ask(calls, "k", "r", build, cache).collect()}["a"] == "{}"


def test_votes_scores_and_diffs(spark):
    votes = spark.createDataFrame([("a", 1), ("a", 0), ("b", None), ("c", 0)], "k string, v int")
    assert {r.k: (r.verdict, r.agreement) for r in claims.majority(votes, ["k"], "v", [1, 0]).collect()} == {"a": (1, "1/2"), "c": (0, "1/1")}
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k int, t string"), spark.createDataFrame([(1, "y"), (3, None)], "k int, t string")
    assert sorted((r.k, r.field) for r in quality.row_differences(a, b, "k").collect()) == [(1, "t"), (2, "k"), (3, "k")]
    assert one(spark, evidence.contains_quote(C("a"), C("b")), a="He said “Yes”", b='said  "yes"') is True
    assert one(spark, export.readable(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1))), a=1) == "a=1 | b=2"
    assert one(spark, T.noisy_json(C("a"), "struct<k:int>"), a='Sure: ```json\n{"k": 3}\n```').k == 3


def test_section_tree(spark):
    text = "Preamble line\nI. First\nwrapped para-\ngraph one\n\nA. Sub\nbody\n\\1\\ a note\nII. Second\n--- PAGE 4 ---\n1. Deep\nmore"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = sections.parse(df).orderBy("section_no").collect()
    assert [(r.section_no, r.parent_no, r.label, r.heading) for r in got] == [(1, None, "", None), (2, None, "I", "First"), (3, 2, "A", "Sub"), (4, None, "II", "Second"), (5, 4, "1", "Deep")]
    assert got[1].paragraphs == ["wrapped paragraph one"] and got[2].notes == ["1 a note"] and got[4].page_end == 4


def test_designators(spark):
    text = "(a) one\n(1) two\n(i) three\nplain\n(ii) four\n(2)(i) five\n(b) six\n(h) seven\n(i) eight\n(j) nine"
    df = spark.createDataFrame([(1, text), (2, None), (3, "none here")], "doc_id long, text string")
    got = [(r.line_no, r.path, r.regular) for r in sections.designators(df, "doc_id", "text").orderBy("line_no").collect()]
    assert got == [(1, "1", True), (2, "1.1", True), (3, "1.1.1", True), (5, "1.1.2", True), (6, "1.2.1", True), (7, "2", True), (8, "8", False), (9, "9", True), (10, "10", True)]


def test_topics_and_class_terms(spark):
    from quarrylight.operators import lexical

    rows = [(i, [float(i % 2) * 10 + i * 0.001, 0.0]) for i in range(60)] + [(60, [500.0, 500.0]), (61, None)]
    got = {r.k: r.topic for r in models.topics(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v", k=2, beyond=4.0).collect()}
    assert len(got) == 61 and 61 not in got
    c = spark.createDataFrame([("x", ["fox", "fox", "hen"]), ("y", ["hen"]), ("y", [])], "g string, t array<string>")
    assert [(r.g, r.term) for r in lexical.class_terms(c, "g", "t", 1).orderBy("g").collect()] == [("x", "fox"), ("y", "hen")]
