"""Deterministic samples: by strata with top-up, and by farthest points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quarrylight.operators.storage import cut


def hash_order(key: Column, seed: int) -> Column:
    """An order that depends on key and seed alone, the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def stratified(df: DataFrame, key: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """n rows: an equal number of each label by hash order, then a top-up from the rest in the same order."""
    labels = df.select(label).distinct().count()
    if not labels:
        return df.limit(0)
    share = n // labels
    ranked = df.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy("_h", key)))
    # The n first of each label are enough for shares and top-up, whatever the size of a label.
    near = ranked.filter(F.col("_r") <= n).withColumn("_top", (F.col("_r") > share).cast("int"))
    return near.orderBy("_top", "_h", key).limit(n).drop("_h", "_r", "_top")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """All rows with their number from 1 in order: sorted by range partitions, each numbered on its own behind those before it."""
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    # A row per partition.
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(offsets), "_part").withColumn(name, inside + F.col("_before")).drop("_part", "_before")


def rank_positions(df: DataFrame, order: list[Column], value: str) -> DataFrame:
    """``x``: rank in order scaled to [0, 1]; ``y``: value scaled to [0, 1] by its range, at least 1."""
    limits = df.agg(F.count("*").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return (
        numbered(df, order, "_r")
        .crossJoin(F.broadcast(limits))
        .withColumn("x", (F.col("_r") - 1) / F.greatest(F.lit(1), F.col("_n") - 1))
        .withColumn("y", (F.col(value) - F.col("_lo")) / F.greatest(F.lit(1.0), F.col("_hi") - F.col("_lo")))
        .drop("_r", "_n", "_lo", "_hi")
    )


def spread(df: DataFrame, order: list[Column], state: str, states: list, n: int) -> DataFrame:
    """At most n rows, one of each listed state in turn: the first of its rows for the first pick, then the row whose place in order
    is farthest from the places picked before, ties to the earlier place.  One aggregation per pick over the rows of the listed states."""
    placed = cut(numbered(df, order, "_at").filter(F.col(state).isin(states)))
    chosen: list[int] = []
    for s in states[:]:
        if len(chosen) == n:
            break
        far = F.array_min(F.array(*(F.abs(F.col("_at") - p) for p in chosen))) if chosen else F.lit(0)
        at = placed.filter(F.col(state) == s).agg(F.min_by("_at", F.struct((-far).alias("f"), F.col("_at")))).first()[0]
        if at is not None:
            chosen.append(at)
    return placed.filter(F.col("_at").isin(chosen)).drop("_at")


def farthest(df: DataFrame, key: str, x: str, y: str, n: int) -> DataFrame:
    """n keys by farthest-point order: the four corners' nearest points, then always the point farthest from those chosen.

    Every row takes part in every pick, by one aggregation each; only the picks come to the driver. A key is chosen
    once; ties go to the smaller (x, key).
    """
    points = df.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().persist()
    chosen: list[Row] = []

    def distance(cx: float, cy: float) -> Column:
        dx, dy = F.col("x") - F.lit(cx), F.col("y") - F.lit(cy)
        return dx * dx + dy * dy

    def take(order: Column) -> bool:
        left = points.filter(~F.col("k").isin([p.k for p in chosen])) if chosen else points
        p = left.agg(F.min_by(F.struct("k", "x", "y"), F.struct(order.alias("d"), "x", "k")).alias("p")).first().p
        if p is not None:
            chosen.append(p)
        return p is not None

    corners = [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)]
    while len(chosen) < n:
        if len(chosen) < 4:
            order = distance(*corners[len(chosen)])
        else:
            order = -F.array_min(F.array(*(distance(p.x, p.y) for p in chosen)))
        if not take(order):
            break
    points.unpersist()
    rows = [(p.k, i) for i, p in enumerate(chosen, 1)]
    return df.sparkSession.createDataFrame(rows, f"{key} {df.schema[key].dataType.simpleString()}, pick int")
