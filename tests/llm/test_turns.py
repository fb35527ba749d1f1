"""Speaker turns against hand-made cases."""

from quarrylight.llm import turns as U

SEGMENTS = "video_id string, segment_id long, start_s double, end_s double, text string, block int"
PEOPLE = "video_id string, speaker_no int, speaker_name string, speaker_role string"


def _turns(spark, texts, people=((1, "Anna Berg", "host"), (2, "Omar Haddad", "guest")), times=None):
    rows = [("v", i, float((times or {}).get(i, i * 5)), None, t, 0) for i, t in enumerate(texts, 1)]
    df = spark.createDataFrame(rows + rows[:1], SEGMENTS)
    who = spark.createDataFrame([("v", *p) for p in people], PEOPLE)
    return [(r.first_segment_id, r.last_segment_id, r.speaker_no) for r in U.turns(df, who).orderBy("turn_no").collect()]


def test_labels_carry_on_until_another_person(spark):
    assert _turns(spark, ["Anna Berg: hello there", "and more", "Omar: thanks", "[laughter]", "so yes"]) == [(1, 2, 1), (3, 5, 2)]


def test_one_segment_in_two_turns_and_empty_remarks(spark):
    assert _turns(spark, ["Anna: one Omar: two", None, " ", "Anna: um", "00:01:02.5 more"]) == [(1, 1, 1), (1, 5, 2)]


def test_blocks_of_time_and_one_person(spark):
    far = {1: 0, 2: 700, 3: 1500, 4: 9000}
    assert _turns(spark, ["Anna: one", "two", "Omar: three", "four"], times=far) == [(1, 2, 1), (3, 4, 2)]
    assert _turns(spark, ["one", "Guest: two"], people=((3, "Anna Berg", "host"),)) == [(1, 2, 3)]


def test_texts_and_empty_tables(spark):
    df = spark.createDataFrame([("v", 1, 0.0, 1.0, "Anna: um, the the plan [noise] is ready", 0)], SEGMENTS)
    who = spark.createDataFrame([("v", 1, "Anna Berg", "host"), ("v", 2, "Omar Haddad", "guest")], PEOPLE)
    assert U.turn_texts(df, who).first().text == "the plan is ready"
    assert U.turns(df.limit(0), who).count() == 0
    assert [r.speaker_no for r in U.turns(df, who.limit(0)).collect()] == [None]
