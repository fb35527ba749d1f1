"""Sentence units of documents in many languages, scripts and layouts.

Which words are abbreviations, which words start sentences and which pairs belong
together over a period is learned without labels from all documents, per
language and over all languages, by log-likelihood ratios of counts.  With these
statistics each period is classified; marks that are unambiguous, quotations,
brackets, lists, headings and wrapped lines follow rules on the text itself.

Counts are merged per batch in the workers and added by one aggregation; only
significant types that make up one in ``RAREST`` counts of their kind come back to
the driver, so their number is bounded whatever the corpus.

Defined results: null and blank texts, and texts of invisible characters only,
have no units; offsets are code points of the raw text, end exclusive; a repeated
``doc_id`` counts once (equal rows); other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import cut

#: A type must make up one in so many counts of its kind, so there are at most this many of each, whatever the corpus.
RAREST = 1_000_000
#: Log-likelihood ratio at which a type counts (chi-square with one degree of freedom, p < 0.001).
SIGNIFICANT = 10.83
#: How many times as often as it starts sentences a word must follow another one over a period to belong to it.
LIFT = 10

#: Names of languages in other codes.
_CODES = {"eng": "en", "ger": "de", "deu": "de", "cn": "zh", "chi": "zh", "zho": "zh", "fre": "fr", "fra": "fr", "spa": "es", "jpn": "ja", "kor": "ko", "rus": "ru", "ara": "ar", "hin": "hi", "tha": "th"}


def language(code: str | None) -> str:
    c = re.split(r"[-_]", (code or "").strip().lower())[0]
    return _CODES.get(c, c)


_INVISIBLE = "­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁯﻿︀-️"
_BLANK = rf"[\s\x00-\x1f\x7f{_INVISIBLE}]"
_EDGE_LEFT, _EDGE_RIGHT = re.compile(rf"{_BLANK}+"), re.compile(rf"{_BLANK}+$")
_CASELESS = "؀-ۿऀ-ॿ฀-๿ᄀ-ᇿ぀-ヿ㐀-鿿가-힣"
_WIDE = "　-ヿ㐀-鿿＀-￯"
_OPEN = {'“': '”', '„': '“', '«': '»', '「': '」', '『': '』', '（': '）', '(': ')', '[': ']', '‹': '›', '《': '》', '【': '】'}
_CLOSERS = "\"'”’“»›」』）)\\]》】"
_END = re.compile(rf"[.!?…。！？।؟۔]+[{_CLOSERS}]*(?:[   ][»])?")
_NOT_IN_WORD = re.compile(r"[\s\"“”„«»()\[\]{}<>（）「」『』,;:!?。！？—–/]")
_NEXT = re.compile(r"[\"'“„«‹「『(\[（¿¡\s  -]*([^\s\"“”„«»()\[\]<>（）「」『』,;:!?。！？।؟…]+)")
_TOKEN = re.compile(r"[^\s\"“”„«»()\[\]{}<>（）「」『』,;:]+")
_NUMBER = re.compile(r"[\d.,:/$%€£+-]*\d[\d.,:/%]*")


def _type(word: str) -> str:
    w = word.lower()
    return "##" if _NUMBER.fullmatch(w) else w


# -- statistics -------------------------------------------------------------------------------------------------------


def count_text(text: str, lang: str, out: Counter) -> None:
    """Adds (kind, language, a, b): n of one text.

    w: word without period; p: word with period, b is what follows (lower, digit, upper, caseless, none); f: word right after a
    certain break, m: capitalised word elsewhere, l: lower-case word; c: pair of a word with period and a capitalised word.
    """
    sure, dotted = True, ""
    for line in text.splitlines():
        for w in _TOKEN.findall(line):
            t, follows, ends, closes = _word(w)
            if not t:
                sure, dotted = closes, ""
                continue
            upper = follows == "upper"
            if dotted:
                out["p", lang, dotted, follows] += 1
                if upper:
                    out["c", lang, dotted, t] += 1
            if upper:
                out["f" if sure else "m", lang, t, ""] += dotted != "##"
            elif follows != "digit":
                out["l", lang, t, ""] += 1
            if ends:
                dotted = t
            else:
                out["w", lang, t, ""] += 1
                dotted = ""
            sure = closes
        if dotted:
            out["p", lang, dotted, "none"] += 1
        dotted, sure = "", True


@lru_cache(maxsize=200_000)
def _word(w: str) -> tuple[str, str, bool, bool]:
    """(type, what it is to the word before, whether a single period ends it, whether a sentence surely ends with it); no type for marks alone."""
    bare = w.strip("'’…!?。！？।؟").rstrip(".")
    if not bare:
        return "", "", False, w[-1:] in "!?।؟"
    t, first = _type(bare), bare[0]
    follows = "upper" if first.isupper() else "digit" if first.isdigit() or first in "$§#" else "lower" if first.islower() else "caseless"
    end = w[len(w.rstrip(".!?…।؟'’")) :]
    if end.startswith(".") and not end.startswith("..") and "!" not in end and "?" not in end:
        # Surely a break: a word of four letters or more that isn't capitalised and has no period inside.
        return t, follows, True, len(t) >= 4 and "." not in t and bare.islower() and bare.isalpha()
    return t, follows, False, bool(end) and end[0] in "!?।؟"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(out)
        got = pa.RecordBatch.from_pydict(
            {
                "kind": [k[0] for k in keys],
                "lang": [k[1] for k in keys],
                "a": [k[2] for k in keys],
                "b": [k[3] for k in keys],
                "n": pa.array([out[k] for k in keys], pa.int64()),
            }
        )
        out.clear()
        return got

    for batch in batches:
        for text, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                count_text(text, language(code), out)
                if len(out) > 300_000:
                    yield flush()
    if out:
        yield flush()


def _llr(k1, n1, k2, n2):
    """Twice the log-likelihood ratio of rate k1/n1 against k2/n2, signed by which is larger."""
    p = (k1 + k2) / (n1 + n2)

    def ll(k, n, p):
        inner = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(inner) + (n - k) * F.log(1 - inner)

    two = 2 * (ll(k1, n1, k1 / n1) + ll(k2, n2, k2 / n2) - ll(k1, n1, p) - ll(k2, n2, p))
    return F.when(k1 / n1 >= k2 / n2, two).otherwise(-two)


@dataclass
class Statistics:
    """Abbreviations, sentence starters, pairs over a period and numbered words, each as (language, ...); language "" is all of them."""

    abbreviations: set = field(default_factory=set)
    starters: set = field(default_factory=set)
    pairs: set = field(default_factory=set)
    numbered: set = field(default_factory=set)

    def has(self, table: str, lang: str, *key: str) -> bool:
        have = getattr(self, table)
        return (lang, *key) in have or ("", *key) in have


def learn(documents: DataFrame) -> Statistics:
    """Statistics over all documents."""
    counted = (
        documents.select("text", "lang")
        .filter(F.col("text").isNotNull())
        .mapInArrow(_counts, "kind string, lang string, a string, b string, n long")
        .groupBy("kind", "lang", "a", "b")
        .agg(F.sum("n").alias("n"))
        .filter("n > 0")
    )
    counted = cut(counted)
    both = counted.unionByName(counted.withColumn("lang", F.lit(""))).groupBy("kind", "lang", "a", "b").agg(F.sum("n").alias("n"))
    both = cut(both)
    totals = {(r.kind, r.lang): r.n for r in both.filter("lang = ''").groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    least = {k: max(3, -(-totals.get((k, ""), 0) // RAREST)) for k in "fpc"}
    of = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("n")).otherwise(0))

    # Starters: capitalised mostly right after certain breaks, and significantly more so than capitals on the whole, or a
    # significantly larger share of the words there than of all words.
    s = both.filter("kind in ('f', 'm', 'l')").groupBy("lang", "a").agg(of("f").alias("f"), of("f", "m").alias("capital"), F.sum("n").alias("n"))
    all_s = s.groupBy("lang").agg(F.sum("f").alias("all_f"), F.sum("capital").alias("all_capital"), F.sum("n").alias("all_n"))
    s = s.join(F.broadcast(all_s), "lang")
    elsewhere = F.greatest(F.col("all_n") - F.col("all_f"), F.lit(1))
    others = F.greatest(F.col("all_capital") - F.col("capital"), F.lit(1))
    by_case = _llr(F.col("f"), F.col("capital"), F.col("all_f") - F.col("f"), others)
    by_place = _llr(F.col("f"), F.col("all_f"), F.col("n") - F.col("f"), elsewhere)
    starters = s.filter((F.col("f") >= least["f"]) & (F.col("f") >= 0.6 * F.col("capital"))).filter(F.greatest(by_case, by_place) > SIGNIFICANT)

    # Abbreviations: with a period far more often than words are on the whole, and not followed like a sentence's last word.
    pairs = both.filter("kind = 'c'")
    known = starters.select("lang", F.col("a").alias("b"), F.lit(True).alias("starts"))
    begun = pairs.join(known, ["lang", "b"], "left").groupBy("lang", "a").agg(
        F.sum(F.when(F.col("starts").isNull(), F.col("n")).otherwise(0)).alias("named")
    )
    follows = lambda *b: F.sum(F.when((F.col("kind") == "p") & F.col("b").isin(*b), F.col("n")).otherwise(0))
    per = both.filter("kind in ('w', 'p')").groupBy("lang", "a").agg(
        of("p").alias("p"),
        follows("lower", "digit", "upper", "caseless").alias("followed"),
        follows("lower", "digit").alias("goes_on"),
        follows("caseless").alias("caseless"),
        follows("digit").alias("digit"),
        F.sum("n").alias("n"),
    )
    all_p = per.groupBy("lang").agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    per = per.join(F.broadcast(all_p), "lang").join(begun, ["lang", "a"], "left").withColumn("named", F.coalesce("named", F.lit(0)))
    per = per.withColumn(
        "score", _llr(F.col("p"), F.col("n"), F.greatest(F.col("all_p") - F.col("p"), F.lit(0)), F.greatest(F.col("all_n") - F.col("n"), F.lit(1)))
    )
    inner = F.col("a").rlike(r"[\p{L}]\.[\p{L}]")
    script = F.col("a").rlike(f"[{_CASELESS}]")
    # What follows without case only says something about words of such a script.
    on = (F.col("goes_on") + F.when(script, F.col("caseless")).otherwise(0) + F.col("named")) / F.greatest(F.col("followed"), F.lit(1))
    long = F.length("a")
    abbreviations = per.filter(
        (F.col("a") != "##")
        & F.col("a").rlike(r"^[\p{L}\p{M}][\p{L}\p{M}.]*$")
        # Without capitals only very short words can be told from a sentence's last word.
        & (~script | F.col("a").rlike(r"^[\u0600-\u06ff]{1,2}$|^[\u0900-\u097f]{1,3}$"))
        & (F.col("p") >= least["p"] - 1)
        & (F.col("p") >= 0.8 * F.col("n"))
        & ((F.col("score") > SIGNIFICANT) | inner)
        # The longer a word, the more it must look like an abbreviation by what follows it.
        & (inner | (on >= F.when(long <= 3, 0.3).when(long <= 8, 0.6).otherwise(0.9)))
    )
    numbered = per.filter((F.col("a") != "##") & (F.col("digit") >= least["p"]) & (F.col("digit") >= 0.5 * F.col("followed")))

    # Collocations: behind a number, an initial or an abbreviation, a word that follows it far more often than it starts sentences.
    short = abbreviations.select("lang", "a", F.lit(True).alias("short"))
    starts = s.select("lang", F.col("a").alias("b"), F.col("f").alias("b_first"))
    dots = pairs.groupBy("lang", "a").agg(F.sum("n").alias("a_n"))
    held = (
        pairs.join(short, ["lang", "a"], "left")
        .filter(((F.col("a") == "##") | (F.length("a") == 1) | F.col("short")) & (F.col("n") >= least["c"]))
        .join(dots, ["lang", "a"])
        .join(starts, ["lang", "b"], "left")
        .join(F.broadcast(all_s), "lang")
        .withColumn("b_first", F.coalesce("b_first", F.lit(0)))
        .filter(_llr(F.col("n"), F.col("a_n"), F.col("b_first"), F.greatest(F.col("all_f"), F.lit(1))) > SIGNIFICANT)
        .filter(F.col("n") * F.col("all_f") >= LIFT * F.col("b_first") * F.col("a_n"))
    )

    def rows(df: DataFrame, *keys: str) -> set:
        return {tuple(r) for r in df.select("lang", *keys).collect()}

    return Statistics(rows(abbreviations, "a"), rows(starters, "a"), rows(held, "a", "b"), rows(numbered, "a"))


# -- splitting --------------------------------------------------------------------------------------------------------

_ITEM = re.compile(r"\s*(?:[-*•–·▪◦‣]|\(?\d{1,2}[.)]|\([a-z]\)|[a-z]\))\s+\S")
_HEAD_NUMBER = re.compile(r"\s*(?:[IVXLC]{1,5}\.|\d{1,2}(?:\.\d{1,2}){0,3}\.?|§|[A-Z]\.)\s")
#: Verbs that attribute a quotation.
_SAID = r"(?:said|says|asked|wrote|told|added|replied|answered|explained|noted|warned|cried|shouted|insisted)"
_ATTRIBUTION = re.compile(
    rf"\s*(?:{_SAID}\b|(?:(?:Dr|Prof|Mr|Ms|Mrs)\.?\s)(?:[^\s.!?]+\s|\w\.\s){{1,4}}{_SAID}\b|(?:he|she|they|it|we|I|the \w+)\s{_SAID}\b|(?P<name>(?:[A-Z][\w'’-]*\.?\s){{1,4}}){_SAID}\b)"
)
_ATTRIBUTED = {
    "hi": re.compile(r"\s*(?:[^\s।!?]+\s){0,5}(?:लिखा|कहा|पूछा|बताया)"),
    "zh": re.compile(r"[^。！？，,\n]{0,14}(?:写道|说道?|问道?|表示|指出|回答)"),
    "ja": re.compile(r"(?:と|って|、|との|という)"),
}
_TERMINAL_LINE = re.compile(rf"[.!?…。！？।؟۔:：][{_CLOSERS}]*\s*$")
#: Words on which no heading or utterance ends.
_LINKS = frozenset("the a an of to in on at by for from with and or but that which who as is are was were be been its their his her our my your this these those than into about not no may will would such including per via if when while der die das des dem den ein eine einer und oder von zu im am für mit auf le la les de du des un une et ou à en au aux el los las del una y o para por con que se".split())


def _lines(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in re.finditer(r"\r\n|[\n\r  \u0085\x0b\x0c]", text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return out


def _blocks(text: str) -> list[tuple[int, int]]:
    """Stretches that no sentence leaves: paragraphs, headings, list items, lines of their own; wrapped lines are joined."""
    lines = _lines(text)
    visible = []
    for a, b in lines:
        m = _EDGE_LEFT.match(text, a, b)
        a2 = m.end() if m else a
        m = _EDGE_RIGHT.search(text, a2, b)
        visible.append((a2, m.start() if m else b))
    n = len(lines)
    length = [b - a for a, b in visible]
    blank = [x <= 0 for x in length]
    if n == 1:
        return [] if blank[0] else [visible[0]]
    widest = max(length)
    word = [len(text[a:b].split(None, 1)[0]) if b > a else 0 for a, b in visible]
    items = [not blank[i] and _ITEM.match(text, lines[i][0], lines[i][1]) is not None for i in range(n)]
    in_list = [False] * n
    for i in range(n):
        if items[i]:
            j = i - 1
            while j >= 0 and not blank[j] and not items[j] and not text[visible[j][0] : visible[j][1]].endswith((":", "：")):
                j -= 1
            ahead = i == 0 or blank[i - 1] or text[visible[i - 1][0] : visible[i - 1][1]].endswith((":", "：")) or in_list[i - 1]
            in_list[i] = ahead or (j >= 0 and not blank[j] and in_list[j] and items[j] and _marker(text, lines[j]) == _marker(text, lines[i]))
    breaks = [i for i in range(n - 1) if not blank[i] and not blank[i + 1] and not in_list[i + 1]]
    full = [i for i in breaks if length[i] + 1 + word[i + 1] > widest]
    wrapped = widest <= 120 and len(full) >= 2 and len(full) >= 0.7 * len(breaks)
    out: list[tuple[int, int]] = []
    start = None
    for i in range(n):
        if blank[i]:
            if start is not None:
                out.append((start, visible[i - 1][1]))
                start = None
            continue
        if start is None:
            start = visible[i][0]
        if i + 1 < n and not blank[i + 1]:
            join = not in_list[i + 1] and _continues(text, visible[i], visible[i + 1], wrapped, length[i] + 1 + word[i + 1] > widest and widest <= 120)
            if not join:
                out.append((start, visible[i][1]))
                start = None
    if start is not None:
        out.append((start, visible[-1][1]))
    return out


def _marker(text: str, line: tuple[int, int]) -> str:
    return re.sub(r"\w+", "1", text[line[0] : line[1]].split(None, 1)[0])


def _continues(text: str, line: tuple[int, int], after: tuple[int, int], wrapped: bool, full: bool) -> bool:
    """Whether the next line goes on with this one."""
    this, nxt = text[line[0] : line[1]], text[after[0] : after[1]]
    if wrapped:
        return full or not this.endswith((":", "："))
    if this.endswith((":", "：")):
        return False
    if _TERMINAL_LINE.search(this):
        # A paragraph of its own, unless an abbreviation ends the line and what follows can't start a sentence.
        return this.endswith(".") and nxt[:1].islower() and not nxt[1:2].isupper()
    last = this.split()[-1].lower().strip(",;")
    if this.endswith((",", ";", "、", "，", "-")) or last in _LINKS:
        return True
    first = nxt[:1]
    if first.islower() and not nxt[1:2].isupper():
        return full or len(this) >= 40
    return full and 45 <= len(this) <= 100 and (first.isdigit() or first in "$§€£(")


_MARKS = re.compile("[" + re.escape('"' + "".join(_OPEN) + "".join(_OPEN.values()) + ")]") + "]")


def _spans(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Matched quotations and brackets inside [a, b), as positions of the opening and closing mark."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    waiting: Counter = Counter()  # closing marks that the stack waits for
    straight = -1
    for m in _MARKS.finditer(text, a, b):
        c, i = m[0], m.start()
        if c == '"':
            if straight >= 0:
                out.append((straight, i))
                straight = -1
            else:
                straight = i
        elif stack and c == stack[-1][0]:
            waiting[c] -= 1
            out.append((stack.pop()[1], i))
        elif c in _OPEN:
            waiting[_OPEN[c]] += 1
            stack.append((_OPEN[c], i))
        elif c in ")]”»」』）" and waiting[c]:
            while stack:
                k, at = stack.pop()
                waiting[k] -= 1
                if k == c:
                    out.append((at, i))
                    break
    return out


def _sentences(text: str, a: int, b: int, lang: str, stats: Statistics) -> Iterator[tuple[int, int]]:
    spans = _spans(text, a, b)
    opening, openers = {o for o, _ in spans}, "\"“"
    by_open, by_close = sorted(spans), sorted((c, o) for o, c in spans)
    closes, inside, opened_upto = [c for c, _ in by_close], [], 0
    start = a
    head = _HEAD_NUMBER.match(text, a, b)
    guard = head.end() if head else a
    marker = _ITEM.match(text, a, b)
    guard = max(guard, marker.end() - 1 if marker else a)
    for m in _END.finditer(text, a, b):
        i, end = m.start(), m.end()
        if end <= start:
            continue
        while end > i + 1 and text[end - 1] in openers and (end - 1) in opening:
            end -= 1  # a quotation opens right here
        mark = m[0].rstrip(_CLOSERS.replace("\\", "") + "   ")
        if i < guard and end < b:
            continue
        closed = [(o, c) for c, o in by_close[bisect_right(closes, i) : bisect_left(closes, end)]]
        while opened_upto < len(by_open) and by_open[opened_upto][0] < i:
            inside.append(by_open[opened_upto])
            opened_upto += 1
        inside = [s for s in inside if s[1] >= i]
        if around := [s for s in inside if s[1] >= end]:
            # Inside a quotation or bracket; it splits only where the whole sentence is quoted and stands alone.
            outer = max(around, key=lambda s: s[1] - s[0])
            if outer[0] != _first(text, start, b) or not _alone(text, outer, b, lang, stats):
                continue
        if end >= b:
            yield start, b
            return
        c = text[end]
        wide = mark[-1] in "。！？" or (mark[-1] == "…" and re.match(f"[{_WIDE}]", c) is not None)
        if not wide and not c.isspace() and c not in _INVISIBLE and re.match(f"[{_WIDE}]", c) is None:
            continue
        if any(o < i for o, _ in closed):
            opened = min(o for o, _ in closed)
            at_start = opened == _first(text, start, b)
            if wide or re.match(f"[{_CASELESS}]", c):
                if not at_start or any(p.match(text, end) for k, p in _ATTRIBUTED.items() if k in ("zh", "ja") or k == lang):
                    continue
            if any(p.match(text, end) for k, p in _ATTRIBUTED.items() if k == "hi") and at_start:
                continue
            if mark[-1] in "!?" and (at := _ATTRIBUTION.match(text, end)):
                name = at["name"]
                if not name or not stats.has("starters", lang, _type(name.split()[0].rstrip("."))):
                    continue
        if _breaks(text, i, end, mark, b, lang, stats):
            yield start, end
            start = end
    if start < b:
        yield start, b


def _first(text: str, start: int, b: int) -> int:
    m = _EDGE_LEFT.match(text, start, b)
    return m.end() if m else start


def _alone(text: str, span: tuple[int, int], b: int, lang: str, stats: Statistics) -> bool:
    """Whether a quotation ends with a closing mark and no attribution or clause follows."""
    if text[span[1] - 1] not in ".!?…。！？।؟":
        return False
    end = span[1] + 1
    if end >= b:
        return True
    if any(p.match(text, end) for p in _ATTRIBUTED.values()) or not (text[end].isspace() or text[span[1] - 1] in "。！？"):
        return False
    if (at := _ATTRIBUTION.match(text, end)) and not (text[span[1] - 1] == "." and at["name"]):
        return False
    after = _NEXT.match(text, end, b)
    return after is None or not (after[1][:1].islower() and not after[1][1:2].isupper())


def _breaks(text: str, i: int, end: int, mark: str, b: int, lang: str, stats: Statistics) -> bool:
    after = _NEXT.match(text, end, b)
    if after is None:
        return True
    word = after[1]
    lower = word[:1].islower() and not word[1:2].isupper()
    if mark[-1] in "。！？।؟۔":
        return True
    if mark[-1] in "!?":
        return not lower
    if mark.endswith("…") or mark.endswith(".."):
        return not lower
    # A single period.
    if lower:
        return False
    at = i
    while at > 0 and not _NOT_IN_WORD.match(text, at - 1):
        at -= 1
    if at == i:
        # A period behind a closing mark or blank; digits right behind it are a decimal.
        return text[i - 1 : i] != " " or not word[:1].isdigit()
    before = text[at:i].lstrip("'’*_-¿¡")
    t = _type(before.rstrip("."))
    nxt = _type(word.rstrip(".'’"))
    if stats.has("pairs", lang, t, nxt):
        return False
    if t == "##":
        return True
    starts = stats.has("starters", lang, nxt)
    if word[:1].isdigit() or word[:1] in "$§#€£":
        return not (stats.has("numbered", lang, t) or stats.has("abbreviations", lang, t) or (len(t) == 1 and t.isalpha()))
    initial = len(t) == 1 and t.isalpha()
    if initial or stats.has("abbreviations", lang, t) or re.fullmatch(r"(?:\w\.)+\w", t):
        if re.match(f"[{_CASELESS}]", word):
            return False
        if initial and before.islower() and starts:
            return True
        if initial and not before.islower():
            # Initials before a name; a capital letter that ends a sentence is rare.
            return starts and nxt in _CERTAIN and not re.search(r"(?:^|\s)\w\.\s?$", text[max(0, i - 4) : i - 1])
        return starts or nxt == "i"
    return True


#: First words that no name begins with.
_CERTAIN = frozenset("the this these those it we they he she there in on at for from with to as by when while if a an".split())


def _thai(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Thai separates sentences by blanks; a blank beside a number or a foreign word separates none."""
    start = a
    for m in re.finditer(r"(?<=[ก-๛​])\s+(?=[​]*[ก-๛])", text[a:b]):
        yield start, a + m.start()
        start = a + m.end()
    yield start, b


_THAI = re.compile("[ก-๛]")


def units(text: str | None, lang: str | None, stats: Statistics) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit."""
    if not text:
        return []
    code = language(lang)
    out: list[tuple[int, int]] = []
    for a, b in _blocks(text):
        for s, e in _sentences(text, a, b, code, stats):
            thai = len(_THAI.findall(text, s, e)) if _THAI.search(text, s, e) else 0
            for x, y in _thai(text, s, e) if thai * 2 > e - s else ((s, e),):
                x = _first(text, x, y)
                m = _EDGE_RIGHT.search(text, x, y)
                y = m.start() if m else y
                if x < y:
                    out.append((x, y))
    return out


def split(documents: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char)."""
    var = documents.sparkSession.sparkContext.broadcast(learn(documents))
    schema = pa.schema([("doc_id", pa.int64()), ("start_char", pa.int32()), ("end_char", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats = var.value
        for batch in batches:
            ids, starts, ends = [], [], []
            for key, text, lang in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for a, b in units(text, lang, stats):
                    ids.append(key)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], schema=schema)

    rows = documents.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.mapInArrow(run, "doc_id long, start_char int, end_char int").distinct()
