"""Speech segments into clean speaker turns.

Label fields are extracted with SQL expressions, speakers are forward-filled by
windows, marked noise is removed, and consecutive pieces of one person become a
turn through gaps-and-islands identifiers.

Scale: a video may hold a third of all rows, so no window spans a video's
segments.  Segments are cut into blocks of ``BLOCK_S`` seconds; windows run
inside (video, block) and once over one summary row per block; the block's
carried state is joined back.  Turns are then a plain partial aggregation.

Defined results: null or blank text, and text holding only labels, time marks,
hesitations and sound notes, yields no piece.  Repeated rows of a segment count
once.  A null ``start_s`` sorts last, ties by segment id.  Speech before the
first label belongs to the lowest ``speaker_no``; a video without any known
person gets a null speaker.  Brackets of more than 60 characters hold
words, not notes.  An empty input gives an empty result.  Columns
other than the four used are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import cut

BLOCK_S = 600.0
_LATE = 1.0e12

TIME_MARKS = (
    r"(?:[\[(<]\s*\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d+)?\s*[\])>]"
    r"|(?<![\d:])\d{1,2}:\d{2}:\d{2}[.,]\d{1,3}(?:\s*-->(?:\s*\d{1,2}:\d{2}:\d{2}[.,]\d{1,3})?)?)"
)
NOISE = r"(?:\[[^\]]{0,60}\]|\([^)]{0,60}\)|\{[^}]{0,60}\}|<[^>]{0,60}>|\*[^*\n]{1,40}\*|♪[^♪]{0,60}♪|♪)"
#: Sound notes that stand in running speech; other brackets there may hold words.
SOUND_NOTES = (
    r"(?iu)(?:\[[^\]]{0,60}\]|\{[^}]{0,60}\}|<[^>]{0,60}>|\*[^*\n]{1,40}\*|♪[^♪]{0,60}♪|♪"
    r"|\((?:[^)]*(?:laugh|applau|music|door|cough|silence|inaudible|crosstalk|sigh|noise|cheer|clap)[^)]*)\))"
)
FILLERS = r"(?iu)(?<![\p{L}\p{N}'-])(?:u+h+m*(?:-huh)?|u+m+|m+h*m+(?:-h+m+)?|h+m+|e+r+m*|a+h+|e+h+|o+h+|äh+m?|euh)(?![\p{L}\p{N}'-])"
SOFT_FILLERS = r"(?iu)(?<![\p{L}\p{N}'-])(?:you know,|i mean,|kind of,|like,|eh|mmm)"

_WORD = r"(?:\p{L}\.|\p{L}[\p{L}\p{N}'’_\-]*)"
#: A possible label: caption voice tag, bracketed name, chevrons, or up to four words before a colon or spaced dash.
LABEL = (
    r"(?:<v\s+[^<>]{1,60}>"
    r"|\[\s*\p{L}[\p{L}.'’\- ]{1,50}\]"
    rf"|(?:>>+\s*|(?<![^\s])-\s+)?(?<![\p{{L}}\p{{N}}])(?:{_WORD}\s){{0,3}}{_WORD}(?:\s\d{{1,2}})?(?:\s\(\p{{L}}[\p{{L}} ]{{2,30}}\))?\s?:(?=\s|$)"
    rf"|(?:^|(?<=[.!?)\]}}>*♪]\s))(?:{_WORD}\s){{0,2}}{_WORD}(?:\s\d{{1,2}})?\s[-–—]\s"
    r"|>>+)"
)
_OPEN, _SHUT = "\u0001", "\u0002"


def _label_key(c: Column) -> Column:
    """Label text without marks: lower case, single spaces."""
    c = F.regexp_replace(c, r"^(?:<v\s+|\[\s*|>>+\s*|-\s+)", "")
    c = F.regexp_replace(c, r"\s*\(\p{L}[\p{L} ]*\)(?=\s*:?\s*$)", "")
    c = F.regexp_replace(c, r"[\s>:\]–—-]+$", "")
    return F.lower(F.regexp_replace(c, r"\s+", " "))


def _people(speakers: DataFrame) -> DataFrame:
    """One row per video: its persons and every form a label may name them by."""
    name = F.lower(F.regexp_replace(F.trim("speaker_name"), r"\s+", " "))
    words = F.split(name, " ")
    first, last = words[0], F.element_at(words, -1)
    forms = F.array(
        name,
        first,
        last,
        F.concat(F.substring(first, 1, 1), F.lit(". "), last),
        F.concat_ws(", ", last, first),
        F.lower(F.trim("speaker_role")),
        F.concat(F.lit("speaker "), F.col("speaker_no").cast("string")),
        F.format_string("speaker_%02d", F.col("speaker_no")),
    )
    return (
        speakers.select("video_id", "speaker_no", "speaker_name", "speaker_role")
        .dropna(subset=["video_id", "speaker_no"])
        .dropDuplicates(["video_id", "speaker_no"])
        .select("video_id", "speaker_no", F.array_compact(forms).alias("forms"))
        .groupBy("video_id")
        .agg(F.sort_array(F.collect_list(F.struct("speaker_no", "forms"))).alias("people"))
    )


def _resolve(people: Column, key: Column) -> Column:
    """(no, n): the person whom the longest suffix of ``key``, n words, names; else the one person within two edits."""
    words = F.split(key, " ")

    def exact(k: Column) -> Column:
        hits = F.filter(people, lambda p: F.array_contains(p["forms"], k))
        return F.when(F.size(hits) == 1, hits[0]["speaker_no"])

    suffixes = [
        F.when(F.size(words) >= n, exact(F.array_join(F.slice(words, F.size(words) - n + 1, n), " "))) for n in (4, 3, 2, 1)
    ]
    found = [F.when(s.isNotNull(), F.struct(s.alias("no"), F.lit(n).alias("n"))) for n, s in zip((4, 3, 2, 1), suffixes)]
    tail = F.element_at(words, -1)
    near = F.filter(
        people,
        lambda p: F.exists(
            p["forms"],
            lambda f: (F.length(f) >= 5) & ((F.length(f) >= 7) | (F.levenshtein(f, tail) <= 1)) & (
                (F.levenshtein(f, tail, 2) >= 0) | (F.levenshtein(f, key, 2) >= 0)
            ) & ~f.startswith("speaker"),
        ),
    )
    guess = F.struct(near[0]["speaker_no"].alias("no"), F.least(F.size(words), F.lit(2)).alias("n"))
    return F.coalesce(*found, F.when((F.length(tail) >= 4) & (F.size(near) == 1), guess))


#: A letter or digit that no hesitation sound has, and the signs of which every time mark or note has one.
_SURE, _SIGNS = r"[\p{L}\p{N}&&[^uhmeraoäUHMERAOÄ]]", r"[\[({<*♪:]"


def _has_words(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, TIME_MARKS, " "), NOISE, " "), FILLERS, " ")
    return F.when(c.rlike(_SURE) & ~c.rlike(_SIGNS), True).otherwise(bare.rlike(r"[\p{L}\p{N}]"))


def clean_speech(c: Column) -> Column:
    """Speech without time marks, sound notes, hesitations and stutters."""
    c = F.regexp_replace(F.regexp_replace(c, TIME_MARKS, " "), SOUND_NOTES, " ")
    c = F.regexp_replace(F.regexp_replace(c, FILLERS + r",?\.{0,3}", " "), SOFT_FILLERS, " ")
    c = F.regexp_replace(c, r"(?iu)(?<![\p{L}\p{N}'])(\p{L}+),? \1(?![\p{L}\p{N}'])", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+([,.;:!?])", "$1"), r"\s+", " "))


def speech_pieces(segments: DataFrame, speakers: DataFrame, with_text: bool = True) -> DataFrame:
    """(video_id, block, segment_id, start_s, pos, speaker_no, toggle, spoken, one, two[, speech]): a row per labelled remark or unlabelled rest.

    ``one`` and ``two`` are the lowest numbers of the video's persons.  Labels are resolved once per block and label, not
    per remark; without text only numbers move.
    """
    # Patterns are only tried where a sign that they need stands.
    text = F.trim(F.when(F.col("text").contains(":"), F.regexp_replace("text", TIME_MARKS, " ")).otherwise(F.col("text")))
    marked = F.when(text.rlike(r"[:\[<>]|\s[-–—]\s"), F.regexp_replace(text, f"({LABEL})", f"{_OPEN}$1{_SHUT}")).otherwise(text)
    start = F.coalesce(F.when(~F.isnan("start_s"), F.col("start_s")), F.lit(_LATE))
    segs = (
        segments.select("video_id", "segment_id", "start_s", "text")
        .filter(F.col("video_id").isNotNull() & F.col("segment_id").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}]"))
        .select("video_id", "segment_id", start.alias("start_s"), "text", F.floor(start / BLOCK_S).alias("block"))
        .repartition("video_id", "block")
        .dropDuplicates(["video_id", "block", "segment_id"])
    )
    part, at = F.col("part"), ["video_id", "block", "segment_id", "start_s", "pos"]
    label = F.when(part.contains(_SHUT), F.substring_index(part, _SHUT, 1))
    rest = F.when(part.contains(_SHUT), F.substring_index(part, _SHUT, -1)).otherwise(part)
    pieces = segs.select(*at[:-1], F.posexplode(F.split(marked, _OPEN)).alias("pos", "part")).select(*at, label.alias("label"), rest.alias("rest"))
    key = _label_key(F.col("label"))
    # A label that names nobody is speech; so both readings are tested for words.
    kept = F.concat(F.regexp_replace("label", r"^>>+\s*", ""), F.col("rest"))
    pieces = cut(
        pieces.select(
            *at,
            F.when(F.col("label").isNotNull(), key).alias("key"),
            F.coalesce(F.col("label").startswith(">>"), F.lit(False)).alias("chevrons"),
            F.coalesce(F.col("label").startswith("["), F.lit(False)).alias("bracket"),
            _has_words(F.col("rest")).alias("rest_spoken"),
            F.when(F.col("label").isNotNull(), _has_words(kept)).alias("all_spoken"),
            (F.trim("rest") == "").alias("bare"),
            *([F.col("rest"), kept.alias("kept")] if with_text else []),
        )
    )
    people = _people(speakers)
    labels = pieces.filter("key is not null").select("video_id", "block", "key").distinct().join(people, "video_id")
    labels = labels.select("video_id", "block", "key", _resolve(F.col("people"), F.col("key")).alias("who")).filter("who is not null")
    nos = F.transform("people", lambda p: p["speaker_no"])
    persons = people.select("video_id", F.size("people").alias("persons"), nos[0].alias("one"), F.try_element_at(nos, F.lit(2)).alias("two"))
    pieces = pieces.join(labels, ["video_id", "block", "key"], "left").join(persons, "video_id", "left")
    # Words that the pattern took before the name end the speech before it.
    words = F.split("key", " ")
    before = F.when(F.col("who").isNotNull() & (F.size(words) > F.col("who.n")), F.array_join(F.slice(words, F.lit(1), F.size(words) - F.col("who.n")), " ")).otherwise("")
    named = F.col("who").isNotNull()
    of_rest = named | F.col("key").isNull()
    speech = F.when(of_rest, F.col("rest")).otherwise(F.col("kept")) if with_text else F.lit(None).cast("string")
    spoken = F.when(of_rest, F.col("rest_spoken")).otherwise(F.col("all_spoken"))
    ahead = F.struct(
        (F.col("pos") * 2).alias("pos"),
        F.lit(None).cast("int").alias("no"),
        _has_words(before).alias("spoken"),
        F.lit(0).alias("toggle"),
        F.lit(False).alias("names"),
        (before if with_text else F.lit(None).cast("string")).alias("speech"),
    )
    remark = F.struct(
        (F.col("pos") * 2 + 1).alias("pos"),
        F.col("who.no").alias("no"),
        spoken.alias("spoken"),
        (F.col("chevrons") & ~named & (F.coalesce("persons", F.lit(0)) == 2)).cast("int").alias("toggle"),
        # A label with nothing at all behind it still names who speaks next; one before mere noise doesn't count.
        (named & F.col("bare")).alias("names"),
        speech.alias("speech"),
    )
    pieces = pieces.select(*at[:-1], "persons", "one", "two", F.explode(F.filter(F.array(ahead, remark), lambda x: x["spoken"] | x["names"])).alias("piece"))
    single = F.col("persons") == 1
    return pieces.select(
        *at[:-1],
        F.col("piece.pos").alias("pos"),
        F.when(single, F.col("one")).otherwise(F.col("piece.no")).alias("speaker_no"),
        F.col("piece.toggle").alias("toggle"),
        F.col("piece.spoken").alias("spoken"),
        "one",
        "two",
        *([F.col("piece.speech").alias("speech")] if with_text else []),
    )


def attributed(segments: DataFrame, speakers: DataFrame, with_text: bool = True) -> DataFrame:
    """Spoken pieces with the person who speaks and the number of their turn in the video."""
    pieces = cut(speech_pieces(segments, speakers, with_text))
    inside = Window.partitionBy("video_id", "block").orderBy("start_s", "segment_id", "pos")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = pieces.withColumn("t", F.sum("toggle").over(upto)).withColumn(
        "base", F.last(F.when(F.col("speaker_no").isNotNull(), F.struct("speaker_no", "t")), ignorenulls=True).over(upto)
    )

    blocks = pieces.groupBy("video_id", "block").agg(
        F.sum("toggle").alias("toggles"),
        F.max_by("base", F.struct("start_s", "segment_id", "pos")).alias("block_base"),
    )
    over = Window.partitionBy("video_id").orderBy("block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("t0", F.coalesce(F.sum("toggles").over(before), F.lit(0)))
    blocks = blocks.withColumn(
        "base0",
        F.last(
            F.when(
                F.col("block_base").isNotNull(),
                F.struct(F.col("block_base.speaker_no").alias("speaker_no"), (F.col("t0") + F.col("block_base.t")).alias("t")),
            ),
            ignorenulls=True,
        ).over(before),
    ).select("video_id", "block", "t0", "base0")

    pieces = pieces.join(blocks, ["video_id", "block"])
    known = F.coalesce(F.col("base.speaker_no"), F.col("base0.speaker_no"), F.col("one"))
    flips = F.col("t0") + F.col("t") - F.coalesce(F.col("t0") + F.col("base.t"), F.col("base0.t"), F.lit(0))
    other = F.when(known != F.col("one"), F.col("one")).otherwise(F.col("two"))
    pieces = pieces.withColumn("who", F.when(flips % 2 == 1, F.coalesce(other, known)).otherwise(known)).filter("spoken")

    # Gaps and islands in two levels: inside the block, then over block borders.
    changed = (~F.col("who").eqNullSafe(F.lag("who").over(inside))).cast("int")
    pieces = pieces.withColumn("first_here", F.row_number().over(inside) == 1).withColumn(
        "starts", F.when(F.col("first_here"), 0).otherwise(changed)
    )
    edges = pieces.groupBy("video_id", "block").agg(
        F.sum("starts").alias("starts"),
        F.min_by(F.struct("who"), F.struct("start_s", "segment_id", "pos")).alias("who_first"),
        F.max_by(F.struct("who"), F.struct("start_s", "segment_id", "pos")).alias("who_last"),
    )
    edges = edges.withColumn(
        "opens", (~F.col("who_first").eqNullSafe(F.lag("who_last").over(over))).cast("int")
    )
    edges = edges.withColumn(
        "turn0", F.sum(F.col("opens")).over(over) + F.coalesce(F.sum("starts").over(before), F.lit(0))
    ).select("video_id", "block", "turn0")
    return (
        pieces.withColumn("local", F.sum("starts").over(upto))
        .join(edges, ["video_id", "block"])
        .select(
            "video_id",
            "block",
            "segment_id",
            "start_s",
            "pos",
            F.col("who").cast("int").alias("speaker_no"),
            *(["speech"] if with_text else []),
            (F.col("turn0") + F.col("local")).alias("turn_no"),
        )
    )


def turns(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """(video_id, turn_no, first_segment_id, last_segment_id, speaker_no)."""
    at = F.struct("start_s", "segment_id", "pos")
    return (
        attributed(segments, speakers, with_text=False)
        .groupBy("video_id", "turn_no")
        .agg(
            F.min_by("segment_id", at).alias("first_segment_id"),
            F.max_by("segment_id", at).alias("last_segment_id"),
            F.first("speaker_no").alias("speaker_no"),
        )
    )


def turn_texts(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Clean text of each turn in parts of one block, so that no part grows with the length of a video."""
    at = F.struct("start_s", "segment_id", "pos", clean_speech(F.col("speech")).alias("speech"))
    return (
        attributed(segments, speakers)
        .groupBy("video_id", "turn_no", "block")
        .agg(F.first("speaker_no").alias("speaker_no"), F.sort_array(F.collect_list(at)).alias("said"))
        .select(
            "video_id",
            "turn_no",
            F.col("block").alias("part_no"),
            "speaker_no",
            F.array_join(F.filter(F.transform("said", lambda s: s["speech"]), lambda s: s != ""), " ").alias("text"),
        )
    )
