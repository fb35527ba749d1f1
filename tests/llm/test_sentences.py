"""Sentence units with statistics learned from a small corpus, and on the text itself."""

from quarrylight.llm import sentences as S

STATS = S.Statistics({("", "dr"), ("en", "approx")}, {("", "the"), ("", "it"), ("", "march")}, {("", "##", "märz"), ("", "approx", "march")}, {("", "no")})


def cut(text, lang="en", stats=STATS):
    return [text[a:b] for a, b in S.units(text, lang, stats)]


def test_abbreviations_numbers_and_collocations():
    assert cut("We met Dr. Smith. It rained.") == ["We met Dr. Smith.", "It rained."]
    assert cut("Am 3. März kam er. The end.", "de") == ["Am 3. März kam er.", "The end."]
    # A collocation outweighs that its second word also starts sentences.
    assert cut("It came approx. March last year.") == ["It came approx. March last year."]
    assert cut("It cost 3.5 million. See no. 7 there.") == ["It cost 3.5 million.", "See no. 7 there."]


def test_quotes_lists_and_lines():
    assert cut('He asked "Why? When?" and left. (It was late.) The end.') == ['He asked "Why? When?" and left.', "(It was late.)", "The end."]
    assert cut("Bring these:\n- one pen\n- two cards") == ["Bring these:", "- one pen", "- two cards"]
    assert cut("这是一句。那是另一句！") == ["这是一句。", "那是另一句！"]


def test_words_of_any_length_before_a_period():
    long = "x" * 60
    stats = S.Statistics({("", long)}, set(), set(), set())
    assert cut(f"See {long}. Smith there. Then go.", stats=stats) == [f"See {long}. Smith there.", "Then go."]


def test_empty():
    assert cut(None) == cut("") == cut(" \n\t") == cut("​") == []


def test_learning(spark):
    line = "We met Dr. Smith at noon. The meeting was short. It ended at 5 p.m. sharp. Later Dr. Jones spoke. The crowd went home. It was late."
    rows = [(i, line, "en", 0) for i in range(30)] + [(30, None, "en", 0), (31, " ", None, 0), (None, "A b.", "en", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n int")
    stats = S.learn(df)
    assert stats.has("abbreviations", "en", "dr") and stats.has("starters", "en", "the") and not stats.has("starters", "en", "smith")
    got = [line[r.start_char : r.end_char] for r in S.split(df).filter("doc_id = 0").orderBy("start_char").collect()]
    assert got == ["We met Dr. Smith at noon.", "The meeting was short.", "It ended at 5 p.m. sharp.", "Later Dr. Jones spoke.", "The crowd went home.", "It was late."]
    assert S.split(df.limit(0)).count() == 0
