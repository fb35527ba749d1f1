"""The classifier decides beside a story, by the title of the page at hand."""

from quarrylight.llm import residue as R

STORY = "The council met on Monday evening to discuss the plan for the new bridge over the river."
FILLER = "Quidam velitam sitar ornare mollit tempora finibus auctora."


def judged(text, title, score):
    return R.residue([(s, *score(s, title)) for s in R.sentences(text)])


def test_unlisted_sentence_beside_a_story():
    assert R.weak_label(FILLER) == 0
    score = lambda s, t: (0.95 if s == FILLER else 0.01, False)
    assert judged(f"{STORY}\n{FILLER}", "Bridge", score)
    assert not judged(STORY, "Bridge", score)


def test_demand_counts_only_without_a_story():
    wait = "Hold tight while our gate opens."
    score = lambda s, t: (0.95 if s == wait else 0.01, True)
    assert judged(wait, None, score)
    assert not judged(f"{STORY}\n{wait}", None, score)


def test_memo_knows_the_title():
    pages = [(f"{STORY} Page {i} is about the bridge.\nlorem ipsum dolor sitar {i}", "Bridge" if i % 2 else None) for i in range(9)]
    model = R.model_of(R._examples(pages))
    used = R.Scorer(model)
    ((first,),) = used([("lorem bridge plan", None)])
    ((second,),) = used([("lorem bridge plan", "The bridge plan")])
    assert [[second]] == R.Scorer(model)([("lorem bridge plan", "The bridge plan")]) and second != first


def test_features_of_many_are_those_of_each():
    keys = [("Lorem ipsum dolor.", 0, True), ("x", 1, False), ("ಕನ್ನಡ é\x00!", 2, False), ("", 0, True)] * 3
    index, ends = R.features(keys)
    split = [x.tolist() for x in __import__("numpy").split(index, ends[:-1])]
    assert split == [R.features([k])[0].tolist() for k in keys] and all(x == sorted(set(x)) for x in split)


def test_the_classifier_finds_unlisted_wording():
    words = "council bridge river mayor school garden market summer letter train".split()
    pages = [(" ".join(f"The {words[i % 10]} and the {words[j]} were discussed on monday." for j in range(10)), None) for i in range(40)]
    pages += [("Error: the requested resource was missing. Error: resource could not be loaded.", None), ("lorem ipsum dolor sit amet consectetur. lorem ipsum sit dolor.", None)] * 10
    model = R.model_of(R._examples(pages))
    unlisted = "The requested resource could not be located."
    assert R.weak_label(unlisted) == 0
    (((_, p, _),),) = R.Scorer(model)([(unlisted, None)])
    (((_, q, _),),) = R.Scorer(model)([("The garden and the letter were discussed on monday.", None)])
    assert p > 0.5 > q


def test_without_labels_of_both_kinds_there_is_no_model():
    assert R.model_of(R._examples([(STORY, "Bridge")])) is None
    none = R.Scorer(None)
    assert [R.residue(x) for x in none([("lorem ipsum dolor sit amet", None), (None, None), (" \n ", None)])] == [True, False, False]


def test_pages(spark):
    rows = [("a", STORY, "Bridge", "x.org", 1), ("b", f"{STORY}\nlorem ipsum dolor", "Bridge", "x.org", 1), ("b", f"{STORY}\nlorem ipsum dolor", "Bridge", "x.org", 1), ("c", None, None, None, 1), (None, "lorem ipsum", None, None, 1)]
    df = spark.createDataFrame(rows, "article_id string, article_text string, title string, domain string, label int")
    assert [r.article_id for r in R.found(df).collect()] == ["b"]
    assert R.found(df.limit(0)).count() == 0
