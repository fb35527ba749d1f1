"""File sources with explicit schemas: CSV, JSON lines, logs, cells, optional files, URL lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from csv import reader
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import ordered, sampling


class TooFewRows(ValueError):
    """A source holds fewer rows than its reader asks for, as a cut download does."""


def csv(spark: SparkSession, path: str, schema: str, required: list[str] | None = None, at_least: int = 0) -> DataFrame:
    """A CSV with quoted line breaks; bad rows keep what parses, with the raw row in ``_bad``.

    Raises if a required column is missing from the header or fewer rows come than asked for.  Quoted line breaks make a
    file the unit of work, so large tables come in many files.
    """
    head = spark.read.text(path).limit(1).first()
    names = [h.strip() for h in next(reader([head[0].lstrip("﻿")]))] if head else []
    if missing := [c for c in required or [] if c not in names]:
        raise ValueError(f"columns missing from {path}: {', '.join(missing)}")
    df = (
        spark.read.schema(f"{schema}, _bad string")
        .options(header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", maxCharsPerColumn=-1, enforceSchema=True)
        .csv(path)
    )
    if at_least and (n := df.limit(at_least).count()) < at_least:
        raise TooFewRows(f"{path} has {n} rows; at least {at_least} are expected")
    return df


def json_lines(spark: SparkSession, path: str, schema: str, torn: bool = False) -> DataFrame:
    """JSON lines; ``torn`` drops lines that don't parse, such as a last line cut by a crash."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED" if torn else "FAILFAST")


def last_writes(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row written per key of an append-only log."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), F.col(order)).alias("r")).select("r.*")


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document, or an empty table where the file is missing."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def json_cell(c: Column, schema: str) -> Column:
    """A JSON cell as a struct; blank cells are null, malformed ones raise."""
    return F.from_json(F.nullif(T.strip(c), F.lit("")), schema, {"mode": "FAILFAST"})


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url, date) of a text file with a URL and optional date per line; blank lines and ``#`` comments are left out."""
    parts = F.split(T.squeeze(F.regexp_replace("value", r"\s*#.*$", "")), " ")
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.col("p")[0] != "")
    return rows.select(F.col("p")[0].alias("url"), F.try_element_at("p", F.lit(2)).alias("date"))


def first_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The first of the candidate columns that a table has."""
    return next((c for c in candidates if c in df.columns), None)


def documents_of_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of binary files; page extraction is a ``mapInPandas`` of the caller's library."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("content_hash"))


def with_row_ids(df: DataFrame, text: str, order: list[Column], name: str = "row_id") -> DataFrame:
    """Rows with text, numbered from 1 in order unless the table has ids."""
    kept = df.filter(F.coalesce(T.strip(F.col(text)) != "", F.lit(False)))
    return kept if name in df.columns else sampling.numbered(kept, order, name)


def processed_ids(*logs: DataFrame) -> DataFrame:
    """Distinct ids of logs of one column each."""
    return reduce(DataFrame.union, logs).distinct()


def first_good(*candidates: tuple[str, Column, int]) -> Column:
    """(value, origin): the first candidate (name, text, least length) that is long enough; else an error text in its place, origin null."""
    picks = [F.when(F.length(c) >= n, F.struct(c.alias("value"), F.lit(name).alias("origin"))) for name, c, n in candidates]
    seen = F.concat_ws(" | ", *(F.concat(F.lit(f"{name}: "), F.coalesce(F.length(c).cast("string"), F.lit("none"))) for name, c, _ in candidates))
    return F.coalesce(*picks, F.struct(F.concat(F.lit("ERROR: "), seen).alias("value"), F.lit(None).cast("string").alias("origin")))


def import_previous(rows: DataFrame, previous: DataFrame, key: str, good: Column) -> DataFrame:
    """The rows and those good ones of a previous run whose key they lack."""
    return rows.unionByName(previous.filter(good).join(rows.select(key), key, "left_anti"), allowMissingColumns=True)


def pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page, text) of binary documents; ``extract`` turns the bytes of one into its pages, in the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, i, t) for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, t in enumerate(extract(content), 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["path", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, page int, text string")


def marked_text(pages_: DataFrame) -> DataFrame:
    """(path, text): the pages of each document behind ``--- PAGE n ---`` markers, in order."""
    parts = F.array_sort(F.collect_list(F.struct("page", "text")))
    one = lambda p: F.concat(F.lit("--- PAGE "), p["page"].cast("string"), F.lit(" ---\n"), p["text"])
    return pages_.groupBy("path").agg(F.array_join(F.transform(parts, one), "\n").alias("text"))


def rule_paragraphs(documents: DataFrame, key: str, xml: str, least: int = 40) -> DataFrame:
    """(key, no, heading, page, text): paragraphs of rule documents in XML, under the heading and on the page they follow.

    Footnotes and their marks are left out, the text behind them stays; documents that don't parse have no rows.
    """
    kind = documents.schema[key].dataType.simpleString()

    def read(text: str) -> Iterator[tuple[str, str, str]]:
        heading = page = ""

        def said(e: ElementTree.Element) -> str:
            inner = "" if e.tag in ("FTNT", "FTREF") else (e.text or "") + "".join(said(x) + (x.tail or "") for x in e)
            return inner

        def walk(e: ElementTree.Element) -> Iterator[tuple[str, str, str]]:
            nonlocal heading, page
            if e.tag in ("FTNT", "FTREF"):
                return
            words = " ".join(said(e).split()) if e.tag in ("HD", "SECTNO", "P", "FP") else ""
            if e.tag == "HD":
                heading = words
            elif e.tag == "SECTNO":
                heading = f"Regulatory text {words}"
            elif e.tag == "PRTPAGE":
                page = e.get("P", page)
            elif len(words) >= least:
                yield heading, page, words
            for x in e:
                yield from walk(x)

        try:
            yield from walk(ElementTree.fromstring(text))
        except ElementTree.ParseError:
            return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, *r) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, r in enumerate(read(t), 1)]
            types = (batch.column(0).type, pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [key, "no", "heading", "page", "text"])

    return documents.filter(F.col(xml).isNotNull()).select(key, xml).mapInArrow(run, f"{key} {kind}, no int, heading string, page string, text string")


def page_lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, page, line) of preformatted texts: page marks ``[[Page n]]`` carry on to the lines below and vanish, with the blank
    lines next to them."""
    lines = documents.select(key, F.posexplode(F.split(text, "\n")).alias("no", "line"))
    mark = F.regexp_extract("line", r"^\s*\[\[Page ([A-Z]?\d+)\]\]\s*$", 1)
    lines = ordered.forward_fill(lines.withColumn("mark", mark), [key], [F.col("no")], F.nullif(F.col("mark"), F.lit("")), "page")
    w = Window.partitionBy(key).orderBy("no")
    beside = (F.coalesce(F.lag("mark").over(w), F.lit("")) != "") | (F.coalesce(F.lead("mark").over(w), F.lit("")) != "")
    lines = lines.withColumn("beside", beside)
    return lines.filter((F.col("mark") == "") & ~(F.col("beside") & (T.strip(F.col("line")) == ""))).select(key, "no", "page", "line")


def sources(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, kind, title, text) of a CSV of videos, whose segments lie in files beside it, or of news; by its columns, else it raises."""
    head = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    if {"video_id", "segments_file"} <= set(head.columns):
        folder = path.rsplit("/", 1)[0]
        named = [r.segments_file for r in head.select("segments_file").distinct().collect() if r.segments_file]  # a list of files
        said = spark.read.schema("start double, end double, text string").options(header=True, escape='"').csv([f"{folder}/{n}" for n in named])
        line = F.concat(F.lit("["), T.hms(F.col("start")), F.lit("] "), F.col("text"))
        file = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
        texts = said.select(file.alias("file"), F.struct("start", line.alias("line")).alias("l")).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text"))
        rows = head.withColumn("file", F.regexp_extract("segments_file", r"([^/]+)$", 1)).join(texts, "file", "left")
        return rows.select(F.col("video_id").alias("source_id"), F.lit("video").alias("kind"), "title", "text")
    if {"url", "article_text"} <= set(head.columns):
        usable = F.col("article_text").isNotNull() & ~F.col("article_text").startswith("ERROR")
        return head.filter(usable).select(F.col("url").alias("source_id"), F.lit("news").alias("kind"), "title", F.col("article_text").alias("text"))
    raise ValueError(f"{path} has the columns of neither videos nor news: {', '.join(head.columns)}")
