"""Quotations, numbers and citations checked against source texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators.storage import cut


def contains_quote(text: Column, quote: Column) -> Column:
    """Whether a text holds a quotation but for quote marks, blanks and case; false for blank quotations."""
    return F.coalesce((T.quote_key(quote) != "") & F.contains(T.quote_key(text), T.quote_key(quote)), F.lit(False))


def quote_span(text: Column, quote: Column) -> Column:
    """(start, end) of the first exact occurrence, counted from 0, end exclusive; null without one."""
    at = F.position(quote, text)
    return F.when((at > 0) & (quote != ""), F.struct((at - 1).alias("start"), (at - 1 + F.length(quote)).alias("end")))


#: Characters of an anchor gram, and grams of a window; a quotation shorter than one window of them has no anchor.
GRAM, WINDOW = 4, 5
SHORTEST = GRAM + WINDOW - 1
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def anchors(text: str) -> np.ndarray:
    """The least hash of each window of character grams: a text shares all of these with every text that holds it."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < SHORTEST:
        return np.array([], np.int64)
    grams = sum(codes[i : len(codes) - GRAM + 1 + i] * _FACTORS[i] for i in range(GRAM))
    grams ^= grams >> np.uint64(29)
    grams *= _FACTORS[0]
    return np.unique(np.lib.stride_tricks.sliding_window_view(grams, WINDOW).min(axis=1)).view(np.int64)


def _anchor_rows(rows: DataFrame) -> DataFrame:
    """(id, anchor) of (id, key) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = anchors(text or "").tolist()
                ids += [i] * len(got)
                found += got
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.int64())], ["id", "anchor"])

    return rows.mapInArrow(run, "id string, anchor long")


def verify_quotes(quotes: DataFrame, sources: DataFrame, on: str, quote: str, text: str) -> DataFrame:
    """Quotes with ``found`` and the number of sources of the same group that hold them, in any script.

    Candidates come from character anchors (``anchors``): ids join on the rarest anchor of the quotation among the texts
    of its group, and each text meets the quotations that it can hold, where ``contains`` decides.  Quotations of fewer
    than ``SHORTEST`` characters meet all texts of their group.  Blank quotations and those without a group are in none.
    """
    group = F.col(on).cast("string")
    q = quotes.select(group.alias("g"), T.quote_key(F.col(quote)).alias("k")).filter("g is not null and k <> ''").distinct()
    q = cut(q.withColumn("id", F.md5(F.concat_ws("\u0001", "g", "k"))))
    s = sources.select(group.alias("g"), T.quote_key(F.col(text)).alias("t")).filter("g is not null and t is not null").groupBy("g", "t").agg(F.count("*").alias("n"))
    s = cut(s.withColumn("id", F.md5(F.concat_ws("\u0001", "g", "t"))))

    def anchored(rows: DataFrame, key: str, name: str) -> DataFrame:
        found = _anchor_rows(rows.select("id", key)).join(rows.select("id", "g"), "id")
        return found.select(F.col("id").alias(name), F.xxhash64("anchor", "g").alias("anchor"))

    in_quotes, in_texts = anchored(q, "k", "q"), cut(anchored(s, "t", "s"))
    seen = in_texts.groupBy("anchor").agg(F.count("*").alias("df"))
    rarest = in_quotes.join(seen, "anchor").groupBy("q").agg(F.min_by("anchor", F.struct("df", "anchor")).alias("anchor"))
    pairs = rarest.join(in_texts, "anchor").select("q", "s")
    short = q.filter(F.length("k") < SHORTEST).select(F.col("id").alias("q"), "g").join(s.select(F.col("id").alias("s"), "g"), "g").select("q", "s")
    held = (
        pairs.unionByName(short)
        .join(q.select(F.col("id").alias("q"), "k"), "q")
        .join(s.select(F.col("id").alias("s"), "t", "n"), "s")
        .filter(F.contains("t", "k"))
        .groupBy("q")
        .agg(F.sum("n").alias("sources"))
    )
    mine = F.md5(F.concat_ws("\u0001", group, T.quote_key(F.col(quote))))
    keyed = quotes.withColumn("_q", F.when(group.isNotNull() & (T.quote_key(F.col(quote)) != ""), mine))
    out = keyed.join(held.withColumnRenamed("q", "_q"), "_q", "left").withColumn("sources", F.coalesce("sources", F.lit(0)))
    return out.withColumn("found", F.col("sources") > 0).drop("_q")


def overlapping(rows: DataFrame, group: str, key: str, start: str, end: str, cell: float = 60.0) -> DataFrame:
    """(a, b): keys, a < b, of the intervals of a group that overlap.

    An interval lies in cells as wide as itself (``cell`` times a power of two), two or three of them, and looks for
    partners in its own cells and in the cells around them of the wider intervals of its group.  So long intervals make
    no more rows than short ones, and none is left out.  An interval whose end lies before its start covers what lies
    between.  Rows without a start or an end overlap nothing; keys are unique inside a group.
    """
    r = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"))
    r = r.filter("g is not null and s is not null and e is not null and not isnan(s) and not isnan(e)")
    lo, hi = F.least("s", "e"), F.greatest("s", "e")
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((hi - lo) / cell, F.lit(1.0))))).cast("int")
    r = cut(r.withColumn("level", level))
    levels = r.select("g", F.col("level").alias("at")).distinct()

    def cells(df: DataFrame, at: str) -> DataFrame:
        width = F.lit(cell) * F.pow(F.lit(2.0), F.col(at))
        return df.withColumn("cell", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))).withColumn("width", width)

    wide = cells(r, "level").select("g", F.col("level").alias("at"), "cell", "width", F.struct("k", "s", "e").alias("a"))
    narrow = cells(r.join(levels, "g").filter("at >= level"), "at").select("g", "at", "cell", "level", F.struct("k", "s", "e").alias("b"))
    a, b = F.col("a"), F.col("b")
    once = F.floor(F.greatest("a.s", "b.s") / F.col("width")) == F.col("cell")
    met = wide.join(narrow, ["g", "at", "cell"]).filter(overlaps(a["s"], a["e"], b["s"], b["e"]) & once)
    met = met.filter((F.col("level") < F.col("at")) & (a["k"] != b["k"]) | (a["k"] < b["k"]) & (F.col("level") == F.col("at")))
    return met.select(F.least("a.k", "b.k").alias("a"), F.greatest("a.k", "b.k").alias("b"))


def unsupported_numbers(claim: Column, evidence: Column) -> Column:
    """Numbers of the claim that the evidence doesn't have."""
    return F.array_except(T.numeric_tokens(claim), T.numeric_tokens(evidence))


def guard_verdict(verdict: Column, citations: Column, unsupported: Column) -> Column:
    """(verdict, review): no citation leaves nothing but not_verifiable; numbers without support lower supported to partial."""
    none = F.size(citations) == 0
    lower = (verdict == "supported") & (F.size(unsupported) > 0)
    final = F.when(none & (verdict != "not_verifiable"), "not_verifiable").when(lower, "partially_supported").otherwise(verdict)
    return F.struct(final.alias("verdict"), (none | lower).alias("review"))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (a_end > b_start)
