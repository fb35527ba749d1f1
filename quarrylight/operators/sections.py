"""A tree of sections from the ordered lines of a document.

Headings are numbered (``1``, ``1.2``, ``A.``, ``IV.``) or upper-case lines; the
level is the one whose next expected number the heading has.  Because each line
depends on those before it, a document is parsed as one group; documents are the
unit of parallelism.  Everything behind the parse - paths, spans, links - is
expressed on the rows.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, section_no int, parent_no int, level int, label string, heading string, first_line int, last_line int, page_start int, page_end int, paragraphs array<string>, notes array<string>"

_NUMBERED = re.compile(r"^(?P<n>\d+(?:\.\d+)*)\.?\s+(?P<h>[^\W\d_].{0,118})$")
_LETTER = re.compile(r"^(?P<n>[A-Z])\.\s+(?P<h>[A-Z].{0,118})$")
_ROMAN = re.compile(r"^(?P<n>[IVXLC]+)\.\s+(?P<h>\S.{0,118})$")
_UPPER = re.compile(r"^(?=.*[A-Z])[A-Z0-9 ,;:'&()/-]{4,80}$")
_PAGE = re.compile(r"^--- PAGE (\d+) ---$|^\[\[Page (\d+)\]\]$")
_NOTE = re.compile(r"^\\(\d+)\\\s+(.*)$")


def roman(n: int) -> str:
    out = ""
    for v, s in ((100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        while n >= v:
            out, n = out + s, n - v
    return out


def _kind(line: str, counters: dict[str, int]) -> tuple[str, int, str, str] | None:
    """(kind, level, label, heading) of a heading line that continues its sequence."""
    if m := _ROMAN.match(line):
        if m["n"] == roman(counters.get("roman", 0) + 1):
            return "roman", 1, m["n"], m["h"]
    if m := _LETTER.match(line):
        if m["n"] == chr(65 + counters.get("letter", 0)):
            return "letter", 2, m["n"], m["h"]
    if (m := _NUMBERED.match(line)) and not line.endswith((".", ";", ",")):
        parts = [int(x) for x in m["n"].split(".")]
        above = ".".join(map(str, parts[:-1]))
        if parts[-1] == counters.get(f"n{above}", 0) + 1:
            return f"n{above}", 2 + len(parts), m["n"], m["h"]
    if _UPPER.match(line) and len(line.split()) >= 2:
        return "upper", 1, "", line
    return None


def parse_lines(doc_id: int, lines: list[str]) -> list[tuple]:
    """Rows of SCHEMA for one document; a preamble before the first heading is section 1 without heading, and no parent."""
    sections: list[dict] = []
    stack: list[dict] = []
    counters: dict[str, int] = {}
    page, note = None, None

    def open_(level: int, label: str, heading: str | None, at: int) -> dict:
        while stack and stack[-1]["level"] >= level:
            stack.pop()
        s = {"no": len(sections) + 1, "parent": stack[-1]["no"] if stack and stack[-1]["level"] else None, "level": level, "label": label, "heading": heading, "first": at, "last": at, "p0": page, "p1": page, "paras": [], "notes": [], "open": False}
        sections.append(s)
        stack.append(s)
        return s

    now = None
    for at, raw in enumerate(lines, 1):
        line = raw.strip()
        if m := _PAGE.match(line):
            page = int(m[1] or m[2])
            continue
        if not line:
            note = None
            if now:
                now["open"] = False
            continue
        if m := _NOTE.match(line):
            now = now or open_(0, "", None, at)
            now["notes"].append(f"{m[1]} {m[2]}")
            note = now
            continue
        if found := _kind(line, counters):
            kind, level, label, heading = found
            counters[kind] = counters.get(kind, 0) + 1
            for k in [k for k in counters if (kind == "roman" and k != "roman" and k != "upper") or (kind == "letter" and k.startswith("n")) or (kind.startswith("n") and k.startswith(f"n{label}") and k != kind)]:
                del counters[k]
            now, note = open_(level, label, heading, at), None
            continue
        now = now or open_(0, "", None, at)
        if note is not None:
            note["notes"][-1] += f" {line}"
        elif now["open"]:
            now["paras"][-1] = now["paras"][-1][:-1] + line if now["paras"][-1].endswith("-") else f"{now['paras'][-1]} {line}"
        else:
            now["paras"].append(line)
            now["open"] = True
        now["last"], now["p1"] = at, page
    return [(doc_id, s["no"], s["parent"], s["level"], s["label"], s["heading"], s["first"], s["last"], s["p0"], s["p1"], s["paras"], s["notes"]) for s in sections]


def parse(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The section rows of each document with text; one row in, its sections out, so no shuffle is needed."""
    names = [f.strip().split(" ")[0] for f in SCHEMA.replace("array<string>", "a").split(",")]

    def run(batches):
        for pdf in batches:
            rows = [r for k, t in zip(pdf[key], pdf[text]) for r in parse_lines(int(k), t.replace("\r\n", "\n").split("\n"))]
            out = pd.DataFrame(rows, columns=names)
            for c in ("parent_no", "page_start", "page_end"):
                out[c] = out[c].astype("Int32")
            yield out

    return documents.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInPandas(run, SCHEMA)


#: What numbers the levels of designators, from the outermost: letters, digits, Roman numerals, capitals, and so on.
_LEVELS = ("letter", "digit", "roman", "capital", "digit", "roman")
_DESIGNATOR = re.compile(r"^\s*((?:\((?:[A-Za-z]|\d{1,3}|[ivxl]{1,7})\)\s*)+)")


def ordinals(token: str) -> dict[str, int]:
    """The readings of a designator: kind -> number from 1."""
    out = {}
    if token.isdigit():
        out["digit"] = int(token)
    elif len(token) == 1:
        out["letter" if token.islower() else "capital"] = ord(token.lower()) - 96
    if (n := next((i for i in range(1, 50) if roman(i).lower() == token), None)) is not None:
        out["roman"] = n
    return out


def place(stack: list[int], token: str) -> tuple[list[int], bool]:
    """(new stack, regular): where a designator goes, by the number that each open level expects next.

    The next number of an open level is preferred, the innermost first, then the first number of a new level below.  What
    fits nowhere opens the outermost level of its kind and isn't regular.
    """
    read = ordinals(token)
    for level in range(len(stack) - 1, -1, -1):
        if read.get(_LEVELS[level]) == stack[level] + 1:
            return [*stack[:level], stack[level] + 1], True
    if len(stack) < len(_LEVELS) and read.get(_LEVELS[len(stack)]) == 1:
        return [*stack, 1], True
    level = next((i for i, kind in enumerate(_LEVELS) if kind in read and i <= len(stack)), None)
    return (stack, False) if level is None else ([*stack[:level], read[_LEVELS[level]]], False)


def designators(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, path, level, regular) of the lines that begin with designators; each document on its own, lines from 1.

    Null texts have no rows.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stack: list[int] = []
                for n, line in enumerate(t.split("\n"), 1):
                    if not (m := _DESIGNATOR.match(line)):
                        continue
                    regular = True
                    for token in re.findall(r"\((\w+)\)", m[1]):
                        stack, fits = place(stack, token)
                        regular &= fits
                    rows.append((k, n, ".".join(map(str, stack)), len(stack), regular))
            types = (batch.column(0).type, pa.int32(), pa.string(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x) for i, x in enumerate(types)], [key, "line_no", "path", "level", "regular"])

    return documents.filter(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"{key} {kind}, line_no int, path string, level int, regular boolean")
