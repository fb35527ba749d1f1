"""The boundary to models: a scorer or client is a callable that workers build, called in Arrow batches, failures as data.

Answers are kept in a table by the hash of their request; a later run only asks
what the table lacks.  A client that raises leaves a row with its error, never a
missing row.  ``keyword_scorer`` and ``echo_client`` are deterministic stand-ins.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType


class Client(Protocol):
    """A model behind a request text: returns a JSON text or raises."""

    def __call__(self, request: str) -> str: ...


Scorer = Callable[[list[str]], list[dict[str, float]]]


def keyword_scorer(words: dict[str, list[str]]) -> Callable[[], Scorer]:
    """A stand-in for a classifier: smoothed shares of the words of each label in a text."""

    def build() -> Scorer:
        sets = {k: set(v) for k, v in words.items()}

        def score(texts: list[str]) -> list[dict[str, float]]:
            out = []
            for t in texts:
                tokens = t.lower().split()
                n = {k: 1 + sum(w in s for w in tokens) for k, s in sets.items()}
                total = sum(n.values())
                out.append({k: v / total for k, v in n.items()})
            return out

        return score

    return build


def classify(df: DataFrame, text: str, build: Callable[[], Scorer], name: str = "scores", first: int = 128, least: int = 8) -> DataFrame:
    """All rows with a map of label scores; batches are halved down to ``least`` when the scorer runs out of memory."""
    schema = StructType([*df.schema.fields, StructField(name, MapType(StringType(), DoubleType()))])
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, size = build(), first
        for pdf in batches:
            got, at, texts = [], 0, pdf[text].fillna("").tolist()
            while at < len(texts):
                try:
                    got += scorer(texts[at : at + size])
                    at += size
                except MemoryError:
                    if size <= least:
                        raise
                    size = max(least, size // 2)
            yield pdf[columns].assign(**{name: got})

    return df.mapInPandas(run, schema)


def request_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def ask(requests: DataFrame, key: str, request: str, build: Callable[[], Client], cache: DataFrame | None = None, tries: int = 2) -> DataFrame:
    """(key, status, answer, error) of each distinct request: ``ok``, ``invalid`` for an answer that isn't JSON, ``error``."""
    todo = requests.select(key, request).dropDuplicates([key])
    schema = f"{key} string, status string, answer string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = build()
        for pdf in batches:
            rows = []
            for k, r in zip(pdf[key], pdf[request]):
                status, answer, error = "error", None, None
                for _ in range(tries):
                    try:
                        answer = client(r)
                    except Exception as e:  # noqa: BLE001 - whatever a client raises is data
                        status, answer, error = "error", None, f"{type(e).__name__}: {e}"
                        continue
                    try:
                        json.loads(answer)
                    except ValueError as e:
                        status, error = "invalid", str(e)
                        continue
                    status, error = "ok", None
                    break
                rows.append((k, status, answer, error))
            yield pd.DataFrame(rows, columns=[key, "status", "answer", "error"])

    if cache is None:
        return todo.mapInPandas(run, schema)
    kept = todo.join(cache.filter("status = 'ok'"), key).select(key, "status", "answer", "error")
    return kept.unionByName(todo.join(cache.filter("status = 'ok'"), key, "left_anti").mapInPandas(run, schema))


def echo_client() -> Client:
    """A stand-in: answers with the length and the first word of the request."""
    return lambda r: json.dumps({"length": len(r), "first": r.split()[0] if r.split() else ""})


def topics(rows: DataFrame, key: str, vector: str, k: int = 8, beyond: float = 2.0) -> DataFrame:
    """(key, topic, distance): k-means on vectors; topics are numbered by size, largest first, and rows farther from their centre
    than ``beyond`` standard deviations over the mean are topic -1.  Null vectors have no row."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    points = rows.filter(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = KMeans(k=k, seed=42, featuresCol="v", predictionCol="c").fit(points)
    centres = F.array(*(F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()))
    apart = F.zip_with(vector_to_array("v"), F.element_at(centres, F.col("c") + 1), lambda a, b: (a - b) * (a - b))
    placed = model.transform(points).select(key, "c", F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x)).alias("distance"))
    limit = placed.agg((F.avg("distance") + beyond * F.coalesce(F.stddev("distance"), F.lit(0.0))).alias("limit"))
    # A row per cluster.
    order = placed.groupBy("c").agg(F.count("*").alias("n")).withColumn("no", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "c")) - 1)
    out = placed.join(F.broadcast(order), "c").crossJoin(F.broadcast(limit))
    return out.select(key, F.when(F.col("distance") > F.col("limit"), -1).otherwise(F.col("no")).alias("topic"), "distance")
