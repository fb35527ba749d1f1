"""Weights, scores, votes and rankings of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T


def title_weight(title: Column, claim: Column, lead: Column) -> Column:
    """3 where claim and title share two words and 0.6 of the smaller set, 2 in the lead, else 1."""
    a, b = F.array_distinct(T.words(title)), F.array_distinct(T.words(claim))
    shared = F.size(F.array_intersect(a, b))
    enough = shared / F.greatest(F.lit(1), F.least(F.size(a), F.size(b))) >= 0.6
    return F.when((shared >= 2) & enough, 3).when(F.coalesce(lead, F.lit(False)), 2).otherwise(1)


def weighted_score(df: DataFrame, keys: list[str], weight: Column, points: Column, checkable: Column) -> DataFrame:
    """Per key: weighted mean of points x 100 over checked rows (points not null), counts, coverage in percent, confidence."""
    checked = checkable & points.isNotNull()
    n, c = F.count_if(checkable), F.count_if(checked)
    s, w = F.sum(F.when(checked, weight * points)), F.sum(F.when(checked, weight))
    out = df.groupBy(*keys).agg(n.alias("checkable"), c.alias("checked"), F.round(100.0 * s / F.nullif(w, F.lit(0)), 1).alias("score"))
    coverage = F.when(F.col("checkable") > 0, F.round(100.0 * F.col("checked") / F.col("checkable"), 1))
    out = out.withColumn("coverage", coverage)
    return out.withColumn(
        "confidence",
        F.when((F.col("coverage") >= 80) & (F.col("checked") >= 3), "High").when((F.col("coverage") >= 50) & (F.col("checked") > 0), "Medium").otherwise("Low"),
    )


def majority(df: DataFrame, keys: list[str], vote: str, severity: list) -> DataFrame:
    """Per key: the most frequent vote, ties by the order of ``severity``, and the agreement as ``n/total``; nulls don't vote."""
    order = F.array_position(F.array(*(F.lit(s) for s in severity)), F.col(vote))
    n = df.filter(F.col(vote).isNotNull()).groupBy(*keys, vote).agg(F.count("*").alias("n")).withColumn("o", order)
    best = n.groupBy(*keys).agg(F.max_by(F.struct(vote, "n"), F.struct("n", -F.col("o"))).alias("b"), F.sum("n").alias("total"))
    return best.select(*keys, F.col(f"b.{vote}").alias("verdict"), F.concat_ws("/", F.col("b.n").cast("string"), F.col("total").cast("string")).alias("agreement"))


def featured(df: DataFrame, group: list[str], same: str, order: list[Column], k: int) -> DataFrame:
    """The k best rows of each group, of rows with equal ``same`` only the best."""
    first = df.groupBy(*group, same).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")
    w = Window.partitionBy(*group).orderBy(*order)
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def route(text: Column, rules: list[tuple[str, str]], fallback: str) -> Column:
    """Label of the first rule (pattern, label) that a text matches; the rules are data of the caller."""
    out = F.lit(fallback)
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out
