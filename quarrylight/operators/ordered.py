"""Operators on ordered rows: fills, running blocks, batches, ranks in ranges, as-of and step joins, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators.storage import cut


def forward_fill(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def blocks(df: DataFrame, keys: list[str], order: list[Column], starts: Column, name: str) -> DataFrame:
    """Number of the block that each row is in: the running count of starts; 0 before the first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(False)).cast("long")).over(w))


def batches(df: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def unique_names(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """``unique_name``: x, x-2, x-3 for repeated names in order."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat_ws("-", F.col(name), n.cast("string"))))


def step_label(value: Column, steps: list[tuple[str, str]]) -> Column:
    """Label of the first step (cutoff, label) whose cutoff the value is strictly below; null values have none."""
    out = F.lit(None).cast("string")
    for cutoff, label in reversed(steps):
        out = F.when(value < cutoff, label).otherwise(out)
    return out


def last_before(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, value: str) -> DataFrame:
    """As-of join: each left row with the value of the latest right row of its key at or before its time.

    Both sides are one union sorted inside (key): a single shuffle, and no row meets more than its neighbours.
    """
    columns = left.columns
    a = left.select(F.struct(*columns).alias("_l"), F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_o"))
    b = right.select(F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.col(key).alias("_k"), F.col(right_at).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_o"))
    w = Window.partitionBy("_k").orderBy("_t", "_o", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    return both.filter("_o = 1").select("_l.*", F.col("_v").alias(f"last_{value}"))


def paths(nodes: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """(key, level, path): names from the root down.  Each round joins one level, until none is left; rows with an unknown parent,
    and rows that are their own ancestors, aren't reached."""
    level = cut(nodes.filter(F.col(parent).isNull()).select(key, F.lit(0).alias("level"), F.array(name).alias("path")))
    out, n = level, 0
    while not level.isEmpty():
        n += 1
        above = level.select(F.col(key).alias("_p"), F.col("path").alias("_path"))
        level = cut(nodes.join(above, F.col(parent) == F.col("_p")).select(key, F.lit(n).alias("level"), F.concat("_path", F.array(name)).alias("path")))
        out = out.unionByName(level)
    return out


def split_ranges(df: DataFrame, at: str, most: int, least_span: int) -> DataFrame:
    """(low, high, n): ranges [low, high) of a time axis in seconds, halved while they hold more than ``most`` rows and span over ``least_span``.

    The axis starts at the first second and is a power of two of ``least_span`` (one second at least) long.  All halvings
    are counted in one aggregation over the cells of the finest, and a range is given where it needs no halving but the
    one around it does.  Empty ranges are left out.
    """
    span = max(1, least_span)
    seconds = df.filter(F.col(at).isNotNull()).select(F.unix_timestamp(at).alias("s"))
    first, last = seconds.agg(F.min("s"), F.max("s")).first()
    levels = 0 if first is None else ((last - first) // span).bit_length()
    cells = seconds.groupBy(F.floor((F.col("s") - F.lit(first)) / span).alias("cell")).agg(F.count("*").alias("n"))
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    held = cells.select("cell", "n", level).groupBy("level", F.expr("shiftright(cell, level)").alias("cell")).agg(F.sum("n").alias("n"))
    fits = held.filter((F.col("n") <= most) | (F.col("level") == 0)).select("level", "cell", "n")
    full = held.filter(F.col("n") > most).select((F.col("level") - 1).alias("level"), F.col("cell").alias("around"))
    # Below a full range, or the whole axis where that isn't full.
    kept = fits.join(full, (fits["level"] == full["level"]) & (F.floor(fits["cell"] / 2) == full["around"]), "left_semi").unionByName(fits.filter(F.col("level") == levels))
    width = F.lit(span) * F.expr("shiftleft(1L, level)")
    low = F.lit(first).cast("long") + F.col("cell") * width
    return kept.select(low.alias("low"), (low + width).alias("high"), "n")
