"""Column functions on fields of records: picks with provenance, citations, codes, locations of quotations, sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T

_MARK = "\u0001"


def filled(c: Column) -> Column:
    """The value, null for blank ones."""
    return F.nullif(T.strip(c), F.lit(""))


def source_text(c: Column) -> Column:
    """Without NUL, blanks squeezed, case kept; null stays."""
    return T.squeeze(F.regexp_replace(c, r"\x{00}", " "))


def rule_key(c: Column) -> Column:
    """Lower case, blanks squeezed; null to ''."""
    return F.lower(T.squeeze(F.coalesce(c, F.lit(""))))


def first_filled(*candidates: tuple[str, Column]) -> Column:
    """(value, origin): the first candidate (name, column) that isn't blank, and its name; nulls where there is none."""
    picks = [F.when(filled(c).isNotNull(), F.struct(filled(c).alias("value"), F.lit(n).alias("origin"))) for n, c in candidates]
    return F.coalesce(*picks, F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("origin")))


def page_citation(volume: Column, start: Column, end: Column, series: str = "FR") -> Column:
    """``88 FR 12`` or ``88 FR 12–14``; null without a first page."""
    one = F.concat_ws(" ", volume.cast("string"), F.lit(series), start.cast("string"))
    return F.when(start.isNotNull(), F.when(start.eqNullSafe(end) | end.isNull(), one).otherwise(F.concat(one, F.lit("–"), end.cast("string"))))


def search_text(text: Column, *contexts: Column) -> Column:
    """The first context that isn't blank, a colon and the text."""
    return F.concat(F.coalesce(*(F.nullif(c, F.lit("")) for c in contexts), F.lit("")), F.lit(": "), F.coalesce(text, F.lit("")))


def mapped(c: Column, values: dict, default=None) -> Column:
    """Value of a closed list of codes; the default for all others and for null."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


def packed_records(c: Column, names: Sequence[str], outer: str = " || ", inner: str = " | ") -> Column:
    """Records of a packed string: parts with as many fields as names, the last of which may hold the separator."""
    quoted = lambda s: "".join(f"\\{x}" if x == "|" else x for x in s)
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), quoted(outer)), lambda p: F.transform(F.split(p, quoted(inner), len(names)), lambda b: T.strip(b)))
    whole = F.filter(parts, lambda p: F.size(p) == len(names))
    return F.transform(whole, lambda p: F.struct(*(p[i].alias(n) for i, n in enumerate(names))))


def section_between(text: Column, start: str, end: str) -> Column:
    """The text from the first heading line that matches ``start`` to the next that matches ``end``, or to the end; '' if there is none."""
    return T.strip(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?is)(?:^|\n)({start}[^\n]*\n.*?)(?=\n{end}|$)", 1))


def limited(c: Column, n: int, sign: str = "…") -> Column:
    """At most n characters, the last of which is the sign where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - len(sign))), F.lit(sign))).otherwise(c)


def joined_lines(lines: Column) -> Column:
    """Wrapped lines as one text: blank lines dropped, no blank behind a line that ends with a hyphen or slash."""
    kept = F.filter(F.transform(lines, lambda x: T.strip(x)), lambda x: x != "")
    step = lambda out, x: F.when(out == "", x).when(out.rlike(r"[-/]$"), F.concat(out, x)).otherwise(F.concat(out, F.lit(" "), x))
    return F.aggregate(kept, F.lit(""), step)


def without_furniture(text: Column, furniture: str) -> Column:
    """Text of a printed page as one line: a leading page number, lines that match ``furniture`` and wrapped hyphens removed."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: T.strip(x))
    lines = F.when(lines[0].rlike(r"^\d+$"), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(furniture))
    return T.squeeze(F.regexp_replace(F.array_join(kept, " "), r"-\s+(?=[a-z])", "-"))


def sentence_spans(text: Column) -> Column:
    """array<struct(id, start, end, text)>: sentences by end marks before a capital, digit or opening mark, and by blank lines.

    Offsets count code points from 0, end exclusive.
    """
    b = T.BLANKS
    marked = F.regexp_replace(text, rf"({b}*\n\n{b}*)", f"{_MARK}$1")
    marked = F.regexp_replace(marked, rf"([.!?][\"'”’)\]]*)({b}+)(?=[\p{{Lu}}\p{{Nd}}\"“‘(])", f"$1{_MARK}$2")
    piece = F.struct
    size = lambda p: F.length(p)
    start = piece(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def add(s: Column, p: Column) -> Column:
        bare = T.strip(p)
        first = s["at"] + size(p) - size(F.regexp_replace(p, f"^{b}+", ""))
        one = F.array(piece(first.alias("start"), (first + size(bare)).alias("end"), bare.alias("text")))
        return piece((s["at"] + size(p)).alias("at"), F.when(bare == "", s["out"]).otherwise(F.concat(s["out"], one)).alias("out"))

    spans = F.aggregate(F.split(F.coalesce(marked, F.lit("")), _MARK), start, add, lambda s: s["out"])
    return F.transform(spans, lambda x, i: piece((i + 1).alias("id"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))


def literal(c: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")


def locate(text: Column, quote: Column) -> Column:
    """(start, end) of the first place of a quotation: exactly, else with any blanks between its words; null if it isn't there."""
    exact = F.position(quote, text)
    words = F.filter(F.split(T.strip(quote), f"{T.BLANKS}+"), lambda w: w != "")
    pattern = F.array_join(F.transform(words, literal), f"{T.BLANKS}+")
    once = F.concat(F.lit("(?s)^(.*?)("), pattern, F.lit(")"))
    before, found = (F.get(F.regexp_extract_all(text, once, F.lit(i)), F.lit(0)) for i in (1, 2))
    loose = F.when((F.size(words) > 0) & found.isNotNull(), F.struct(F.length(before).alias("start"), (F.length(before) + F.length(found)).alias("end")))
    return F.when(quote != "", F.when(exact > 0, F.struct((exact - 1).alias("start"), (exact - 1 + F.length(quote)).alias("end"))).otherwise(loose))


def export_columns(df: DataFrame, base: Sequence[str], prefixes: Sequence[str]) -> list[str]:
    """The base columns that a table has, then those of each prefix by name; a stable list for exports."""
    have = set(df.columns)
    return [c for c in base if c in have] + [c for p in prefixes for c in sorted(df.columns) if c.startswith(p) and c not in base]


def public(df: DataFrame, private: str = "_", large: Sequence[str] = ()) -> DataFrame:
    """The table without columns of a private prefix and without large ones."""
    return df.select(*(c for c in df.columns if not c.startswith(private) and c not in large))
