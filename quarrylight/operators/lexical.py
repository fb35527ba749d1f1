"""Counts of n-grams and TF-IDF over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators.storage import cut


def top_ngrams(docs: DataFrame, text: str, sizes: tuple[int, ...] = (1, 2, 3), k: int = 100) -> DataFrame:
    """(n, term, count, rank): the k most frequent runs of filtered tokens of each size; ties by term."""
    tokens = docs.select(T.topic_tokens(F.col(text)).alias("t"))
    sized = lambda n: F.transform(T.ngrams(F.col("t"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("term")))
    grams = F.concat(*map(sized, sizes))
    counts = tokens.select(F.explode(grams).alias("g")).groupBy(F.col("g.n").alias("n"), F.col("g.term").alias("term")).agg(F.count("*").alias("count"))
    w = Window.partitionBy("n").orderBy(F.desc("count"), "term")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tfidf_terms(docs: DataFrame, key: str, text: str, sizes: tuple[int, ...] = (1, 2, 3), most: float = 0.95, features: int = 5000) -> DataFrame:
    """(term, df, mean): smooth idf ``ln((1 + n) / (1 + df)) + 1``, rows of unit length, mean weight over all documents.

    The corpus are the documents with a topic token; only runs of two or more letters, digits and underscores are terms.
    They need a document frequency of 1, 2 or 3 by the size of the corpus (below 30, below 100, above) and at most
    ``most`` of the documents; of these the most frequent ``features`` remain, ties by term.
    """
    clean = docs.select(F.col(key).alias("id"), F.array_join(T.topic_tokens(F.col(text)), " ").alias("x")).filter("x <> ''")
    found = F.regexp_extract_all("x", F.lit(r"[a-z0-9_]{2,}"), F.lit(0))
    tokens = cut(clean.select("id", F.filter(found, lambda t: ~t.isin(*T.STOPWORDS)).alias("t")))
    grams = F.concat(*(T.ngrams(F.col("t"), n) for n in sizes))
    tf = tokens.select("id", F.explode(grams).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    n = tokens.count()
    least = 1 if n < 30 else 2 if n < 100 else 3
    terms = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).filter((F.col("df") >= least) & (F.col("df") <= most * n))
    kept = terms.orderBy(F.desc("total"), "term").limit(features).select("term", "df")
    weight = F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)
    rows = tf.join(F.broadcast(kept), "term").withColumn("w", weight)
    norms = rows.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return (
        rows.join(norms, "id")
        .groupBy("term")
        .agg(F.first("df").alias("df"), F.round(F.sum(F.col("w") / F.col("norm")) / n, 8).alias("mean"))
    )


def class_terms(docs: DataFrame, label: str, tokens: str, k: int) -> DataFrame:
    """(label, term, weight, rank): ``tf ln(1 + A / f)`` with tf in the class, f in all and A the mean number of tokens of a class; ties by term."""
    n = docs.select(label, F.explode(tokens).alias("term")).groupBy(label, "term").agg(F.count("*").alias("tf"))
    f = n.groupBy("term").agg(F.sum("tf").alias("f"))
    mean = n.agg((F.sum("tf") / F.countDistinct(label)).alias("a"))
    w = n.join(f, "term").crossJoin(F.broadcast(mean)).select(label, "term", F.round(F.col("tf") * F.log(1 + F.col("a") / F.col("f")), 6).alias("weight"))
    return w.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(F.desc("weight"), "term"))).filter(F.col("rank") <= k)
