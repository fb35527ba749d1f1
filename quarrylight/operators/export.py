"""Between nested and flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nest(df: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str) -> DataFrame:
    """Rows of each key as an ordered array of structs."""
    return df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("v")))), lambda x: x["v"]).alias(name))


def flatten(df: DataFrame, keys: list[str], outer: str, inner: str) -> DataFrame:
    """One row per inner item of each outer item; outer items without inner ones, and rows without outer items, keep a row.

    Columns: keys, record_type, outer_no, inner_no (from 1, null where there is none), flat_row_id.
    """
    one = df.select(*keys, F.posexplode_outer(outer).alias("o", "outer_item"))
    two = one.select(*keys, "o", "outer_item", F.posexplode_outer(f"outer_item.{inner}").alias("i", "inner_item"))
    kind = F.when(F.col("inner_item").isNotNull(), inner).when(F.col("outer_item").isNotNull(), outer).otherwise("row")
    id_ = F.concat_ws(":", *(F.col(k).cast("string") for k in keys), (F.col("o") + 1).cast("string"), (F.col("i") + 1).cast("string"))
    return two.select(*keys, kind.alias("record_type"), (F.col("o") + 1).alias("outer_no"), (F.col("i") + 1).alias("inner_no"), "outer_item", "inner_item", id_.alias("flat_row_id"))


def widen(array: Column, n: int, name: str) -> list[Column]:
    """The first n items of an array as columns name_1 .. name_n, null where there are fewer."""
    return [F.try_element_at(array, F.lit(i)).alias(f"{name}_{i}") for i in range(1, n + 1)]


def label_columns(scores: Column, labels: list[str], prefix: str) -> list[Column]:
    """A map of scores as one column per known label, 0 where it is missing."""
    return [F.coalesce(scores.getItem(x), F.lit(0.0)).alias(f"{prefix}_{x}") for x in labels]


def top_label(scores: Column) -> Column:
    """Label with the highest score; ties by name."""
    best = F.array_max(F.transform(F.map_entries(scores), lambda e: F.struct(e["value"].alias("v"), F.lit(0).alias("z"))))
    return F.array_min(F.transform(F.filter(F.map_entries(scores), lambda e: e["value"] == best["v"]), lambda e: e["key"]))


def readable(items: Column) -> Column:
    """A map as ``a=1 | b=2`` in order of keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(items)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), " | ")
