"""Main text of pages: the story's own lines against menus, notices, teasers, sidebars and footers.

Line-block distribution: mark-up is stripped, blank lines keep their place, and
every line counts with the length of its running text.  Sums over sliding windows
of lines surge where the story begins and dive where it ends; only lines between
these points are kept, and a lone sentence makes no surge.  Statistics of all
pages refine the lengths: a sentence that only ever comes as one and the same
line, on pages with different stories, is a notice and counts nothing; one that
the corpus also knows inside paragraphs counts ``FAMILIAR`` times.  Short lines
inside the block are subheads if lines of their form stand inside blocks with text
below them nearly everywhere; the page's own headline and byline are kept.

Scale: workers turn pages into narrow rows, one per line (hashes, lengths, flags;
no text).  Form statistics are aggregated and joined back by form: forms of at
least one in ``HOT`` sentences, ``HOT`` at most, by broadcast, all others by a
shuffle in which no form is frequent.  Rows then meet once more by page.

Defined results: null and blank texts have no lines; lines are counted from 1 at
``\\n``, blank ones included, and never returned when blank; a line of nothing but
mark-up isn't the story's; a page whose text is all short has its story where its
largest window is; a repeated ``article_id`` counts once; pages found by
``residue`` have no rows; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import residue
from quarrylight.llm.common import cut

#: Lines of a window, running text in it that makes a surge, and the share of the largest block that another one needs.
WINDOW, SURGE, MASS = 11, 160, 0.1
#: Stories from which a form speaks for itself; share of one line among its occurrences that makes a sentence a notice, and one that makes it familiar.
LEAST, NOTICE, USED, FAMILIAR = 8, 0.9, 0.5, 4
#: Most forms that are broadcast.
HOT = 10_000

_I = re.IGNORECASE
_MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|</?[a-z!][^<>]*>", _I | re.S)
_EDGES = " \t\r\x0b\x0c 　﻿​‎‏"
_WIDE = re.compile("[぀-ヿ㐀-鿿가-힯]")
_CASELESS = re.compile("[؀-ۿऀ-ॿ]")
_END = re.compile(r"[.!?…。！？।؟][\"”’»」)]*$")
_DIGITS = re.compile(r"\d[\d.,:]*")
#: Separators of menus and shares.
_MENU = re.compile(r"[|›»·•▾☰↑©#®]|\S {2,}\S|\w\s/\s\w")
_BYLINE = re.compile(r"^(?:by|von|par|por|de|da|text)\s[^|]{3,60}(?:\||,|·|–|-)\s.{4,30}$|^(?:by|von|par|por)\s(?:[A-Z][\w.'’-]*\s?){1,4}$", _I)
_NAMES = re.compile(r"(?<=[\w,:’'] )(?:[A-Z][\w’'-]+(?: (?=[A-Z]))?)+")
_SENTENCE = re.compile(r"(?<=[.!?])[\"”»]?\s+|(?<=[。！？।؟])\s*")
#: Flags of a line.
TITLE, HEADLIKE, BYLINE, MENU, SHORT, BEFORE, AFTER, ABOVE, UNTITLED = (1 << i for i in range(9))


def stripped(text: str) -> list[str]:
    """The lines of a text without mark-up and outer blanks; line breaks inside mark-up still count."""
    if "<" in text:
        text = _MARKUP.sub(lambda m: " " + "\n" * m[0].count("\n"), text)
    lines = text.split("\n")
    if "&" in text:
        lines = [html.unescape(x) if "&" in x else x for x in lines]
    return [x.strip().strip(_EDGES).strip() for x in lines]


def running(line: str) -> int:
    """Length of running text in a line: 0 for anything without the form of sentences."""
    n = len(line)
    if not n:
        return 0
    ascii_ = line.isascii()
    if not ascii_ and _WIDE.search(line):
        return n * 3 if n >= 8 and _END.search(line) and not _MENU.search(line) else 0
    words = line.count(" ") + 1
    if _END.search(line):
        return n if words >= (3 if not ascii_ and _CASELESS.search(line) else 4) and not (words < 8 and _MENU.search(line)) else 0
    return n if n >= 110 and not _MENU.search(line) else 0


def body(text_of: list[int]) -> tuple[int, int]:
    """First and last line between surge and dive, by the running text of every line; (len, -1) where there is none."""
    n, half = len(text_of), WINDOW // 2
    if not any(text_of):
        return n, -1
    upto = [0, *accumulate(text_of)]
    sums = [upto[min(n, i + half + 1)] - upto[max(0, i - half)] for i in range(n)]
    level = min(SURGE, max(sums) / 2)
    blocks, i = [], 0
    while i < n:
        j = i
        while j < n and sums[j] >= level:
            j += 1
        if upto[j] > upto[i]:
            first = next(k for k in range(i, j) if text_of[k])
            last = next(k for k in range(j - 1, i - 1, -1) if text_of[k])
            blocks.append((upto[j] - upto[i], first, last))
        i = j + 1
    enough = MASS * max(blocks)[0]
    kept = [b for b in blocks if b[0] >= enough]
    return kept[0][1], kept[-1][2]


def form(line: str) -> str:
    """The line without what varies between pages: digits, and capitalised words inside it."""
    return _NAMES.sub("Nn", _DIGITS.sub("0", line))


def _norm(s: str | None) -> str:
    s = re.sub(r"\s+[-–—|]\s+[^-–—|]{2,40}$", "", s or "") if s and len(s) > 30 else (s or "")
    return re.sub(r"[\W_]+", " ", s.lower()).strip()


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "replace")) - (1 << 63)


Line = tuple[int, int, int, int, int, int]  # number from 1 (0: a later sentence of a line), sentence form, line form, story, length, flags


def line_rows(text: str | None, title: str | None) -> list[Line]:
    """A row per non-blank line, by its first sentence, and one per further sentence of a line of running text."""
    if not text or not text.strip():
        return []
    lines, raw = stripped(text), text.split("\n")
    lines += [""] * (len(raw) - len(lines))
    own = [running(x) for x in lines]
    first, last = body(own)
    story = _hash(max(lines, key=len))
    want, bare = _norm(title), (title or "").strip()
    start = want.split(" ", 1)[0]  # any line that equals the title has its first word
    shown = [i for i, x in enumerate(raw) if x.strip().strip(_EDGES).strip()]
    out: list[Line] = []
    for i, below in zip(shown, [*shown[1:], -1]):
        s = lines[i]
        wide, blanks, short = not s.isascii() and _WIDE.search(s) is not None, s.count(" "), not own[i]
        flags = 0 if want else UNTITLED
        if want and s and start in s.lower() and (_norm(s) == want or s == bare):
            flags |= TITLE
        if short:
            flags |= BYLINE if _BYLINE.search(s) else 0
            flags |= SHORT if blanks < 6 and len(s) < 50 and not _DIGITS.search(s) else 0
        flags |= HEADLIKE if (len(s) >= 8 if wide else blanks >= 3) else 0
        flags |= MENU if _MENU.search(s) else 0
        flags |= (BEFORE if i < first else 0) | (AFTER if i > last else 0) | (ABOVE if below >= 0 and own[below] else 0)
        whole = form(s)
        said = [] if short else [x for x in _SENTENCE.split(s) if x.strip()]
        keys = [form(x) for x in said] if len(said) > 1 or said and said[0] != s else [whole]
        line = _hash(whole)
        out += [(0 if k else i + 1, _hash(x), line, story, own[i], flags) for k, x in enumerate(keys)]
    return out


Known = tuple[int, float, float, float, float]  # stories; shares before the surge, after the dive, above running text; share of one line


def furniture(lines: list[tuple[int, int, int, Known | None]]) -> list[int]:
    """Numbers of the lines that aren't the story's, of (number, length, flags, statistics of the form) in order."""
    if not lines:
        return []
    axis = [0] * lines[-1][0]
    own = []
    for n, length, _, known in lines:
        if length and known:
            length = 0 if known[4] >= NOTICE else length * FAMILIAR if known[4] <= USED else length
        axis[n - 1] = length
        own.append(length)
    first, last = body(axis)
    top = next((k for k, x in enumerate(lines) if x[0] > first), len(lines))
    head = next((k for k, x in enumerate(lines) if x[2] & TITLE), -1)
    if lines[0][2] & UNTITLED:
        # Furniture of the top of the page nearly always stands there; headlines recur as teasers elsewhere.
        fits = lambda f, known: f & HEADLIKE and not f & (MENU | BYLINE) and not (known and known[1] >= 0.8)
        head = next((k for k in range(top - 1, -1, -1) if fits(*lines[k][2:])), -1)
    out = []
    for k, (n, _, flags, known) in enumerate(lines):
        if k == head:
            continue
        inside = first < n <= last + 1
        if own[k]:
            if inside:
                continue
        elif flags & BYLINE:
            if k < max(top, head + 4):
                continue
        elif inside and not flags & MENU and not lines[k][1]:
            if known:
                if known[1] + known[2] <= 0.15 and known[3] >= 0.6:
                    continue
            # Too rare to speak for itself: a few words between two lines of running text.
            elif flags & SHORT and own[k - 1] and own[k + 1]:
                continue
        out.append(n)
    return out


# -- Spark ------------------------------------------------------------------------------------------------------------

_LINES = pa.schema([("page", pa.int64()), ("article_id", pa.string()), *((c, pa.int64() if i in (1, 2, 3) else pa.int32()) for i, c in enumerate(("line_no", "form", "line", "story", "length", "flags")))])


def _pages(articles: DataFrame) -> DataFrame:
    """(page, article_id, article_text, title) with texts; a page is one version of an article."""
    rows = articles.filter(F.col("article_id").isNotNull() & F.col("article_text").isNotNull()).select("article_id", "article_text", "title")
    return rows.select(F.xxhash64("article_id", "article_text", "title").alias("page"), "*")


def _lines(articles: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in _LINES]
            for page, key, text, title in zip(*(batch.column(k).to_pylist() for k in range(4))):
                got = line_rows(text, title)
                if got:
                    columns[0] += [page] * len(got)
                    columns[1] += [key] + [None] * (len(got) - 1)  # the first row alone names the article
                    for c, values in zip(columns[2:], zip(*got)):
                        c += values
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LINES)], schema=_LINES)

    return _pages(articles).mapInArrow(run, "page long, article_id string, line_no int, form long, line long, story long, length int, flags int")


def statistics(lines: DataFrame) -> DataFrame:
    """(form, n, before, after, above, one): of each sentence form in at least ``LEAST`` stories, what ``furniture`` asks for.

    Each line counts once for a story, so copies of a story make no notice of its sentences.
    """
    flag = lambda bit: F.max(F.when(F.col("line_no") > 0, F.col("flags").bitwiseAND(bit) > 0).otherwise(False).cast("int"))
    places = {"before": BEFORE, "after": AFTER, "above": ABOVE}
    seen = lines.groupBy("form", "line", "story").agg(F.max((F.col("line_no") > 0).cast("int")).alias("first"), *(flag(b).alias(c) for c, b in places.items()))
    by_line = seen.groupBy("form", "line").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("first", *places)))
    total = by_line.groupBy("form").agg(F.sum("n").alias("total"), F.max("n").alias("top"), *(F.sum(c).alias(c) for c in ("first", *places)))
    return total.filter(F.col("first") >= LEAST).select(
        "form", "total", F.col("first").alias("n"), *((F.col(c) / F.col("first")).alias(c) for c in places), (F.col("top") / F.col("total")).alias("one")
    )


def found(articles: DataFrame) -> DataFrame:
    """(article_id, line_no) of the lines that don't belong to the story."""
    return _furniture(articles).select("article_id", "line_no").distinct()


def _furniture(articles: DataFrame) -> DataFrame:
    """(page, article_id, line_no) of the lines that don't belong to the story, without the pages found by ``residue``."""
    lines = cut(_lines(articles))
    known = cut(statistics(lines))
    # Forms of one in HOT of all occurrences: HOT at most, whatever the corpus.
    whole = known.agg(F.sum("total")).first()[0] or 0
    hot = known.filter(F.col("total") * HOT >= whole).drop("total")
    cold = known.filter(F.col("total") * HOT < whole).drop("total")
    rows = lines.filter("line_no > 0").select("page", "article_id", "line_no", "length", "flags", "form")
    often = rows.join(F.broadcast(hot), "form")
    rest = rows.join(F.broadcast(hot.select("form")), "form", "left_anti").join(cold, "form", "left")
    order = ["page", "line_no"]
    both = often.unionByName(rest).drop("form").repartition("page").sortWithinPartitions(*order)
    names = ("page", "line_no", "length", "flags", "n", "before", "after", "above", "one")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decide(table: pa.Table) -> pa.RecordBatch:
            page, *columns = (table.column(c).to_pylist() for c in names)
            article = table.column("article_id").to_pylist()
            numbers = table.column("page").to_numpy()
            at = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist()]
            out: tuple[list, list, list] = ([], [], [])
            for a, b in zip(at, [*at[1:], len(page)]):
                got = []
                for no, length, flags, n, *shares in zip(*(c[a:b] for c in columns)):
                    if not got or got[-1][0] != no:  # a repeated row of the page
                        got.append((no, length, flags, None if n is None else (n, *shares)))
                lost = furniture(got)
                out[0].extend([page[a]] * len(lost))
                out[1].extend([next(k for k in article[a:b] if k is not None)] * len(lost))
                out[2].extend(lost)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32())], ["page", "article_id", "line_no"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            pages = batch.column(batch.schema.get_field_index("page"))
            if pages[0] != pages[-1] or (held and held[-1].column("page")[-1] != pages[0]):
                # All but the last page are whole.
                table = pa.Table.from_batches([*held, batch])
                numbers = table.column("page").to_numpy()
                cut_at = int(np.flatnonzero(numbers != numbers[-1])[-1]) + 1
                yield decide(table.slice(0, cut_at))
                held = table.slice(cut_at).to_batches()
            else:
                held.append(batch)
        if held:
            yield decide(pa.Table.from_batches(held))

    lost = both.select("page", "article_id", *names[1:]).mapInArrow(run, "page long, article_id string, line_no int")
    return lost.join(residue.found(articles), "article_id", "left_anti")


def main_text(articles: DataFrame) -> DataFrame:
    """(article_id, body): the story's lines alone, one row per distinct page; pages found by ``residue`` have none, null texts a null body."""
    drop = _furniture(articles).groupBy("page").agg(F.collect_set("line_no").alias("drop"))
    pages = _pages(articles).dropDuplicates(["page"]).join(residue.found(articles), "article_id", "left_anti").join(drop, "page", "left")
    lines = F.filter(F.split("article_text", "\n"), lambda _, i: ~F.array_contains(F.coalesce("drop", F.array().cast("array<int>")), i + 1))
    empty = articles.filter(F.col("article_id").isNotNull() & F.col("article_text").isNull()).select("article_id", F.lit(None).cast("string").alias("body")).distinct()
    return pages.select("article_id", F.trim(F.array_join(lines, "\n")).alias("body")).unionByName(empty)
