"""Sinks: contract files, appends, upserts, exports of rendered lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed_csv(df: DataFrame, path: str, fields: list[str], strict: bool = True, files: int | None = None) -> None:
    """A CSV of exactly these fields in this order; unknown columns raise, or are dropped where not strict."""
    if strict and (extra := sorted(set(df.columns) - set(fields))):
        raise ValueError(f"unknown fields: {', '.join(extra)}")
    out = df.select(*fields)
    (out.coalesce(files) if files else out).write.mode("overwrite").options(header=True, escape='"').csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def upsert(index: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The index with rows of the same key replaced."""
    return index.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def new_rows(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done, each key once."""
    return rows.join(done.select(key), key, "left_anti").dropDuplicates([key])


def lines(df: DataFrame, order: list[Column], line: Column) -> DataFrame:
    """(value) in order, for a text writer."""
    return df.orderBy(*order).select(line.alias("value"))


def document(df: DataFrame, keys: list[str], order: Column, line: Column) -> DataFrame:
    """Lines of each key joined to one text in order, for reports of bounded length."""
    parts = F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("l"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["l"]), "\n").alias("text"))


def report_line(template: str, *columns: Column) -> Column:
    return F.format_string(template, *columns)


def whole(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A table that readers see as a whole or not at all: the commit protocol moves finished files in."""
    df.write.mode("overwrite").format(kind).save(path)


def stage(df: DataFrame, path: str) -> DataFrame:
    """The table as written and read again, so that later stages start from it; an existing one is taken over as it is."""
    spark = df.sparkSession
    try:
        return spark.read.schema(df.schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    whole(df, path)
    return spark.read.schema(df.schema).parquet(path)


def windows(df: DataFrame, path: str, window: str) -> None:
    """Overwrites the windows that the rows are of, and no others: a window that failed is repeated by the next run."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(window).parquet(path)


def version_link(proposed: Column, final: Column, checked_at: Column) -> Column:
    """A JSON document that links two versions."""
    return F.to_json(F.struct(proposed.alias("proposed"), final.alias("final"), checked_at.alias("checked_at")), {"ignoreNullFields": "false"})


def review_line(url: Column, day: Column, title: Column) -> Column:
    """A candidate for review as a line: address, date and title as a comment."""
    return F.concat(url, F.lit("  # "), F.coalesce(day, F.lit("no date")), F.lit(" | "), F.coalesce(title, F.lit("")))
