"""Lexical and dense retrieval.

BM25 with the constants of the common Okapi implementation: idf is
``ln(N - df + .5) - ln(df + .5)``, negative values become ``eps`` times the mean
idf, and repeated query tokens count repeatedly.  Statistics always cover the whole
corpus; filters apply to the ranked rows only, as they must not alter scores.

Scale: postings are one aggregation by (document, token).  Queries are a small
table whose tokens are joined to postings, so only postings of query tokens move;
the broadcast of query tokens is left to the planner, which knows their size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T

K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf, length) of every document; texts without tokens have no rows."""
    tokens = corpus.select(key, T.search_tokens(F.col(text)).alias("tokens"))
    return (
        tokens.select(key, F.size("tokens").alias("length"), F.explode("tokens").alias("token"))
        .groupBy(key, "token")
        .agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    )


def idf(posts: DataFrame, n: int) -> DataFrame:
    """(token, idf) with the floor for tokens in more than half of the documents."""
    raw = posts.groupBy("token").agg(F.count("*").alias("df"))
    raw = raw.withColumn("raw", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("token", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(corpus: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
    """(query_key, key, score) of the documents that share a token with the query; score rounded to 4 places."""
    posts = postings(corpus, key, text)
    n, total = corpus.agg(F.count("*"), F.sum(F.size(T.search_tokens(F.col(text))))).first()
    if not n or not total:
        return posts.join(queries.limit(0).select(query_key), F.lit(True)).select(query_key, key, F.lit(0.0).alias("score"))
    mean = total / n
    asked = queries.select(query_key, F.explode(T.search_tokens(F.col(query_text))).alias("token")).groupBy(query_key, "token").agg(F.count("*").alias("times"))
    part = (
        F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(mean))))
    )
    return (
        posts.join(asked, "token").join(idf(posts, n), "token").groupBy(query_key, key).agg(F.round(F.sum(part), 4).alias("score"))
    )


def top_k(scores: DataFrame, group: str, key: str, k: int, score: str = "score") -> DataFrame:
    """The k best rows of each group with their rank; ties by key."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(key))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ranked(scores: DataFrame, queries: DataFrame, query_key: str, allowed: DataFrame, key: str, k: int) -> DataFrame:
    """The k best allowed documents of every query: those without a shared token follow with score 0, in order of the key.

    Of all documents without a score only the first in order of the key can be needed: with k of them for each query
    beyond the ones that have a score, k plus the number of scored rows among the first; these are few, as scores are cut
    to the k best first and the filler is a fixed list of 2 k keys.
    """
    best = top_k(scores.filter("score > 0").join(allowed.select(key), key, "left_semi"), query_key, key, k).drop("rank")
    low = scores.filter("score <= 0").join(allowed.select(key), key, "left_semi")
    missing = k - F.count(key)
    short = queries.select(query_key).distinct().join(best.select(query_key, key), query_key, "left").groupBy(query_key).agg(missing.alias("_missing")).filter("_missing > 0")
    # Documents with a score above 0 are k - 1 at most for a short query, so the first 2 k keys hold k without.
    filler = allowed.select(key).distinct().orderBy(key).limit(2 * k)
    zero = short.crossJoin(F.broadcast(filler)).join(scores.select(query_key, key), [query_key, key], "left_anti").select(query_key, key, F.lit(0.0).alias("score"))
    low = low.join(short.select(query_key), query_key, "left_semi")
    return top_k(best.unionByName(zero).unionByName(low.select(query_key, key, "score")), query_key, key, k)


def as_of(available: Column, at: Column) -> Column:
    """Whether something was available at a time: always if it has no date or none is asked for."""
    return available.isNull() | at.isNull() | (available <= at)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null for a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b)))


#: Rows of a block of the corpus and of a block of queries in ``nearest``.
ROWS, ASKED = 16_384, 4_096


def nearest(corpus: DataFrame, key: str, label: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, label, key, score, rank): the k nearest vectors of each label for each query, the query itself left out.

    ``queries``: (query_id, v).  Blocks of queries meet blocks of the corpus in one product of matrices each; of every
    block only rows that can be among the k best come out.  A corpus block goes to as many tasks as there are blocks of
    queries, a query block to as many as there are blocks of the corpus; nothing is broadcast.  Cosines are rounded to
    six places, ties go to the lesser key; zero vectors and null ones have none.
    """
    n, asked = corpus.count(), queries.count()
    parts, groups = max(1, -(-n // ROWS)), max(1, -(-asked // ASKED))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    block = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    left = corpus.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"), block(key, parts).alias("part"), every(groups).alias("group"))
    right = queries.filter("v is not null").select("query_id", F.col("v").cast("array<double>").alias("v"), every(parts).alias("part"), block("query_id", groups).alias("group"))
    kind = corpus.schema[key].dataType.simpleString()
    names = corpus.schema[label].dataType.simpleString()

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        m = np.array(column.to_pylist(), np.float64)
        with np.errstate(invalid="ignore", divide="ignore"):
            return m / np.sqrt((m * m).sum(axis=1, keepdims=True))

    def product(rows: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", asked.schema.field("query_id").type), ("label", rows.schema.field("label").type), ("id", rows.schema.field("id").type), ("score", pa.float64())])
        if not rows.num_rows or not asked.num_rows:
            return schema.empty_table()
        ids, labels, mine = rows.column("id").to_pylist(), rows.column("label").to_pylist(), asked.column("query_id").to_pylist()
        scores = np.round(unit(asked.column("v")) @ unit(rows.column("v")).T, 6)
        out: tuple[list, list, list, list] = ([], [], [], [])
        of: dict = {}
        for j, x in enumerate(labels):
            of.setdefault(x, []).append(j)
        for x, members in of.items():
            some = scores[:, members]
            # The query itself may be among them, so one more is kept.
            bar = np.partition(np.nan_to_num(some, nan=-2.0), -(k + 1), axis=1)[:, -(k + 1)] if len(members) > k + 1 else np.full(len(mine), -2.0)
            for i, j in zip(*np.nonzero(some >= bar[:, None])):
                if ids[members[j]] != mine[i]:
                    for c, value in zip(out, (mine[i], x, ids[members[j]], float(some[i, j]))):
                        c.append(value)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    met = left.groupBy("part", "group").cogroup(right.groupBy("part", "group")).applyInArrow(product, f"query_id {kind}, label {names}, id {kind}, score double")
    w = Window.partitionBy("query_id", "label").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumnRenamed("id", key)


def quality(ranked: DataFrame, relevant: Column, query_key: str) -> DataFrame:
    """hit@1, hit@3, hit@5 and mean reciprocal rank of the first relevant row; queries without one count as misses."""
    first = ranked.groupBy(query_key).agg(F.min(F.when(relevant, F.col("rank"))).alias("first"))
    return first.agg(
        F.count("*").alias("queries"),
        *(F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 4).alias(f"hit_{k}") for k in (1, 3, 5)),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"),
    )
