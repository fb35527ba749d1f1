"""Main text by line blocks: wording that no list names, mark-up, blank lines, statistics of forms, edge cases."""

import random

from quarrylight.llm import boilerplate as B

STORY = [
    "The council met on Monday evening to discuss the plan for the new bridge over the river.",
    "Residents of the old town asked who would pay for it and when the work would begin.",
    "The mayor said that the budget for the coming year had not been settled yet.",
]


def lost(text, title=None, known=None):
    lines = B.stripped(text)
    rows = [(n, length, flags, (known or {}).get(B.form(lines[n - 1]))) for n, _, _, _, length, flags in B.line_rows(text, title) if n]
    return B.furniture(rows)


def test_lone_sentences_outside_the_block_are_dropped():
    text = "\n".join(["Kindly mind the gap between the platforms.", *[""] * 6, *STORY, *[""] * 6, "Reach our desk by pigeon at any hour.", "Every penny keeps this page alive."])
    assert lost(text, "Bridge plan") == [1, 17, 18]


def test_markup_is_stripped_and_lines_keep_their_numbers():
    text = "<div\nclass='x'>\n" + "\n".join(f"<p>{s}</p>" for s in STORY) + "\n<br>"
    assert lost(text) == [1, 2, 6]


def test_headline_and_subhead():
    text = "\n".join(["Menu | Sport | News", "Bridge plan", *STORY[:2], "Who pays", STORY[2]])
    assert lost(text, "Bridge plan") == [1]


def test_a_notice_inside_the_story_is_known_by_its_counts():
    notice = "Kindly mind the gap between the platforms."
    text = "\n".join([STORY[0], notice, *STORY[1:]])
    assert lost(text) == []
    assert lost(text, known={B.form(notice): (20, 0.0, 0.2, 0.5, 1.0)}) == [2]


def test_empty_and_short_texts():
    assert B.line_rows(None, None) == B.line_rows(" \n\t", None) == []
    assert lost("One short sentence is all.") == []
    assert lost("menu", "Bridge plan") == [1]


def _pages(n):
    rng = random.Random(1)
    words = "river bridge council mayor budget market school train summer garden letter window".split()
    sentence = lambda: " ".join(rng.choice(words) for _ in range(12)).capitalize() + "."
    for i in range(n):
        lines = [" ".join(sentence() for _ in range(3)) for _ in range(4)]
        lines.insert(2, "Kindly mind the gap between the platforms.")
        yield f"a{i}", "\n".join([f"Edition {i}", *lines]), None


def test_statistics_over_all_pages(spark):
    rows = list(_pages(40))
    rows += rows[:5] + [("n", None, None), (None, "x y z", None), ("e", "", None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "article_id string, article_text string, title string, form int")
    got = sorted(map(tuple, B.found(df).collect()))
    assert got == sorted((f"a{i}", n) for i in range(40) for n in (1, 4))
    kept = {r.article_id: r.body for r in B.main_text(df).collect()}
    assert len(kept) == 42 and kept["n"] is None and "platforms" not in kept["a3"]
    assert B.found(df.limit(0)).count() == 0
