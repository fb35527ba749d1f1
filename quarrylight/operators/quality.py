"""Contracts: keys, references, differences of tables, coverage, field rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def orphans(child: DataFrame, parent: DataFrame, on: Column, *columns: str) -> DataFrame:
    return child.join(parent, on, "left_anti").select(*columns)


def row_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, field, left, right) of every field that differs, null-safe; a missing row differs in its key field."""
    fields = [c for c in a.columns if c != key]
    x = a.select(F.col(key).alias("_a"), *(F.col(c).cast("string").alias(f"a_{c}") for c in fields))
    y = b.select(F.col(key).alias("_b"), *(F.col(c).cast("string").alias(f"b_{c}") for c in fields))
    both = x.join(y, x["_a"] == y["_b"], "full_outer")
    present = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    rows = [
        F.when(present & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("left"), F.col(f"b_{c}").alias("right")))
        for c in fields
    ]
    rows.append(F.when(~present, F.struct(F.lit(key).alias("field"), F.col("_a").cast("string").alias("left"), F.col("_b").cast("string").alias("right"))))
    return both.select(F.coalesce("_a", "_b").alias(key), F.explode(F.array_compact(F.array(*rows))).alias("d")).select(key, "d.*")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_left, only_right): rows without a partner, repeated rows counted."""
    left, right = a.exceptAll(b).agg(F.count("*").alias("only_left")), b.exceptAll(a).agg(F.count("*").alias("only_right"))
    return left.crossJoin(right)


def coverage(expected: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """(key, state): missing where expected isn't used, invalid where used isn't expected, used otherwise."""
    e, u = expected.select(F.col(key).alias("e")).distinct(), used.select(F.col(key).alias("u")).distinct()
    state = F.when(F.col("u").isNull(), "missing").when(F.col("e").isNull(), "invalid").otherwise("used")
    return e.join(u, F.col("e") == F.col("u"), "full_outer").select(F.coalesce("e", "u").alias(key), state.alias("state"))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """Text of the first rule that a row breaks, else null."""
    return reduce(lambda out, r: F.when(r[0], r[1]).otherwise(out), reversed(rules), F.lit(None).cast("string"))
