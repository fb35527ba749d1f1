"""Column functions on text: cleaning, tokens, keys, parsing of counts, times and titles.

All are Spark expressions.  Character classes are spelled out (``\\p{L}``, explicit
blanks) because ``\\w``, ``\\s`` and ``trim`` cover ASCII only on the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every blank that a Unicode-aware strip removes.
BLANKS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]+"

#: Words that carry no topic.
STOPWORDS = (
    "a an and are as at be been being by for from had has have he her hers him his i if in into is it its me my of on or our ours she that the their theirs "
    "them they this to was we were what when where which who will with would you your yours http https www url amp"
).split()
#: Number words that count as numbers.
NUMBER_WORDS = {"one": "1", "two": "2", "three": "3", "four": "4", "six": "6", "twelve": "12", "fifteen": "15", "thirty": "30", "sixty": "60", "ninety": "90"}


def strip(c: Column) -> Column:
    """Without blanks of any script at both ends."""
    return F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", "")


def squeeze(c: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{BLANKS}+", " "))


def clean(c: Column) -> Column:
    """Mark-up to blanks, addresses of pages to ``URL``, blanks squeezed; null to ''."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " ")
    return squeeze(F.regexp_replace(c, r"https?://[^\s]+|www\.[^\s]+", " URL "))


def html_to_text(c: Column) -> Column:
    """Breaks and paragraph ends to line feeds, other tags dropped, at most one blank line; null to ''."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)<br\s*/?>|</p>", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n\s*\n+", "\n\n"))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def slug(c: Column) -> Column:
    """Lower case, everything else than letters and digits of ASCII to single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def squashed(c: Column) -> Column:
    """Key of a title: lower-case ASCII letters and digits alone."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]", "")


def words(c: Column) -> Column:
    """Lower-case ASCII words in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))


def topic_text(c: Column) -> Column:
    c = F.translate(F.lower(clean(c)), "_/", "  ")
    return squeeze(F.regexp_replace(c, r"[^a-z0-9'#+.\- ]+", " "))


def topic_tokens(c: Column, least: int = 3, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Tokens of topics: words that may hold ' # + . -, edges stripped, of a least length and no stopwords."""
    raw = F.regexp_extract_all(topic_text(c), F.lit(r"[a-z][a-z0-9'#+.\-]*"), F.lit(0))
    bare = F.transform(raw, lambda t: F.regexp_replace(t, r"^['#+.\-]+|['#+.\-]+$", ""))
    return F.filter(bare, lambda t: (F.length(t) >= least) & ~t.isin(*stopwords))


def search_tokens(c: Column) -> Column:
    """Tokens of search: a compound such as ``a-b.c`` yields itself and its parts."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9]+(?:[-./][a-z0-9]+)*"), F.lit(0))
    parts = F.transform(found, lambda t: F.when(t.rlike("[-./]"), F.concat(F.array(t), F.split(t, "[-./]"))).otherwise(F.array(t)))
    return F.flatten(parts)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, as an inner function would otherwise do so for each element."""
    return F.transform(F.array(value), body)[0]


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens in order, with repetition."""

    def runs(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1)))
        return F.when(F.size(t) >= n, F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return tokens if n == 1 else bound(tokens, runs)


def shingles(c: Column, k: int = 5) -> Column:
    """Set of runs of ``k`` words; empty for shorter texts."""
    return F.array_distinct(ngrams(words(c), k))


def quote_key(c: Column) -> Column:
    """Curly quotes straight, blanks squeezed, lower case: texts that are equal so are equal as quotations."""
    return F.lower(squeeze(F.translate(c, "“”‘’", "\"\"''")))


def short_hash(c: Column, length: int = 16) -> Column:
    """Stable id of a string: the start of its SHA-256."""
    return F.substring(F.sha2(F.trim(c), 256), 1, length)


def uid(*parts: Column, length: int = 12) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, length)


def truth(c: Column) -> Column:
    """1, true and yes in any case are true, all else and null false."""
    return F.coalesce(F.lower(strip(c)).isin("1", "true", "yes"), F.lit(False))


def compact_to_iso(c: Column) -> Column:
    """``yyyyMMddTHHmmssZ`` as ISO time; other values stay."""
    return F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z$", "$1-$2-$3T$4:$5:$6Z")


def compact_date(c: Column) -> Column:
    """ISO date of a value that starts with eight digits, else null."""
    return F.when(c.rlike(r"^\d{8}"), F.regexp_replace(F.substring(c, 1, 8), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))


def eastern(ts: Column) -> Column:
    """UTC timestamp as wall time of the east coast, as text."""
    return F.date_format(F.from_utc_timestamp(ts, "America/New_York"), "yyyy-MM-dd HH:mm:ss")


def hms(seconds: Column) -> Column:
    """Seconds as h:mm:ss, or m:ss under an hour."""
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def to_seconds(c: Column) -> Column:
    """h:mm:ss or m:ss as seconds, else null."""
    n = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))
    return F.when(F.size(n) == 3, n[0] * 3600 + n[1] * 60 + n[2]).when(F.size(n) == 2, n[0] * 60 + n[1])


def human_count(c: Column) -> Column:
    """17K, 1.2M, 1,234 as a whole number (cut, not rounded), else null."""
    v = F.upper(F.regexp_replace(F.trim(c), ",", ""))
    unit = F.regexp_extract(v, r"^\d[\d.]*\s*([KMB]?)$", 1)
    scale = F.when(unit == "K", 1000).when(unit == "M", 1000000).when(unit == "B", 1000000000).otherwise(1)
    number = F.regexp_extract(v, r"^(\d+(?:\.\d+)?)\s*[KMB]?$", 1)
    return F.when(number != "", F.floor(F.round(number.cast("decimal(20,6)") * scale, 3)).cast("long"))


def split_title(c: Column) -> Column:
    """(title, views, reactions) of ``17K views · 183 reactions | Title | Page``."""
    raw = F.coalesce(c, F.lit(""))
    views = F.nullif(F.regexp_extract(raw, r"([\d.,]+[KMB]?) views", 1), F.lit(""))
    reactions = F.nullif(F.regexp_extract(raw, r"([\d.,]+[KMB]?) reactions", 1), F.lit(""))
    rest = F.split(raw, r" \| ", 2)
    title = F.when((views.isNotNull() | reactions.isNotNull()) & (F.size(rest) > 1), rest[1]).otherwise(raw)
    return F.struct(F.trim(title).alias("title"), views.alias("views"), reactions.alias("reactions"))


def scrub(c: Column, hide: Sequence[str] = ()) -> Column:
    """E-mail addresses and phone numbers as [removed], self-introductions as [name], given names as [creator], longest first."""
    c = F.regexp_replace(c, r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+", "[removed]")
    c = F.regexp_replace(c, r"(?:\+?1[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", "[removed]")
    c = F.regexp_replace(
        c,
        r"(?<![\p{L}\p{N}_])((?i:my name is|this is|i'm|i am))\s+((?i:(?:attorney|lawyer|dr\.?)\s+)?)[A-Z][\p{L}\p{N}_'-]+(?:[\s-]+[A-Z][\p{L}\p{N}_'-]+){0,3}",
        "$1 $2[name]",
    )
    for name in sorted(hide, key=lambda n: (-len(n), n)):
        c = F.regexp_replace(c, "(?i)" + "".join(f"\\{x}" if not x.isalnum() and x.isascii() else x for x in name), "[creator]")
    return c


#: Edges of words of any script.
_START, _STOP = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def numeric_tokens(c: Column) -> Column:
    """Sorted set of the numbers of a text, without commas, labels of forms and visas left out, some number words counted."""
    low = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"{_START}(?:(?:f|j|m|i|ds)-\d+|form\s+[a-z]+-?\d+){_STOP}", " ")
    digits = F.transform(F.regexp_extract_all(low, F.lit(rf"{_START}\d+(?:,\d{{3}})*(?:\.\d+)?{_STOP}"), F.lit(0)), lambda t: F.regexp_replace(t, ",", ""))
    words_said = F.array_distinct(F.regexp_extract_all(low, F.lit(rf"{_START}({'|'.join(NUMBER_WORDS)}){_STOP}"), F.lit(1)))
    known = F.create_map(*(F.lit(x) for kv in NUMBER_WORDS.items() for x in kv))
    said = F.transform(words_said, lambda w: known[w])
    return F.array_sort(F.array_distinct(F.concat(digits, said)))


def keyword_hits(c: Column, strong: Sequence[str], support: Sequence[str], least: int = 3) -> Column:
    """(terms, likely): strong terms as substrings and supporting ones as words; likely by one strong or ``least`` supporting terms."""
    low = F.lower(F.coalesce(c, F.lit("")))
    a = F.array_compact(F.array(*(F.when(low.contains(t), F.lit(t)) for t in strong)))
    b = F.array_compact(F.array(*(F.when(low.rlike(rf"(?:^|[^a-z0-9_]){t}(?:$|[^a-z0-9_])"), F.lit(t)) for t in support)))
    return F.struct(F.concat(a, b).alias("terms"), ((F.size(a) > 0) | (F.size(b) >= least)).alias("likely"))


def is_placeholder(c: Column) -> Column:
    """Whether every sentence only points to an attachment; false for empty texts."""
    text = strip(F.coalesce(c, F.lit("")))
    parts = F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: s != "")
    pointer = (
        r"(?i)^(please\s+)?(see|refer\s+to)\s+(the\s+)?attach(ed|ment|ments)(\s+(file\(s\)|files?|letter|documents?|comments?|pdf))?[\s.!]*$"
    )
    return (text != "") & F.forall(parts, lambda s: s.rlike(pointer))


def skip_reason(withdrawn: Column, text: Column, attachments: Column) -> Column:
    """The first reason against a comment: withdrawn, no_text, placeholder, has_attachments; null if there is none."""
    blank = strip(F.coalesce(text, F.lit(""))) == ""
    return F.when(withdrawn, "withdrawn").when(blank, "no_text").when(is_placeholder(text), "placeholder").when(attachments, "has_attachments")


def pages_of(c: Column) -> Column:
    """array<struct(page, text)> of a text with ``--- PAGE n ---`` markers."""
    numbers = F.regexp_extract_all(c, F.lit(r"--- PAGE (\d+) ---"), F.lit(1))
    texts = F.slice(F.split(c, r"--- PAGE \d+ ---"), 2, F.size(numbers))
    return F.transform(F.arrays_zip(numbers.alias("page"), texts.alias("text")), lambda x: F.struct(x["page"].cast("int").alias("page"), strip(x["text"]).alias("text")))


def pre_text(c: Column) -> Column:
    """Content of the first ``<pre>`` block without NUL and control characters."""
    return F.regexp_replace(F.regexp_extract(c, r"(?is)<pre[^>]*>(.*?)</pre>", 1), r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]", "")


def noisy_json(c: Column, schema: str) -> Column:
    """A JSON array or object in a model's answer: fences stripped, outermost brackets taken, else null."""
    bare = F.regexp_replace(c, r"(?i)```(?:json)?", "")
    kind = r"(?s)(\[.*\])" if schema.lower().startswith("array") else r"(?s)(\{.*\})"
    return F.from_json(F.regexp_extract(bare, kind, 1), schema)


def compact_json(c: Column) -> Column:
    """A struct as JSON that keeps nulls."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, 1))
