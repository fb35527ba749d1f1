"""Copies and near copies: flags, similarity joins, components, canonical rows.

The similarity join is exact.  Texts that are equal in their words are collapsed
first, so groups of copies never multiply.  Of each distinct text only the rarest
shingles that another text has are joined: two sets of Jaccard similarity t share one of the
``|s| - ceil(t |s|) + 1`` rarest ones, whatever the sizes, so common shingles,
whose pairs would explode, aren't joined on.  Components are found by propagating
the least id, with the lineage cut in every round.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators.storage import cut

LEAST_SHINGLES, SIMILAR = 12, 0.85
#: Texts of a shingle that meet in one task.
SPLIT = 1_000
#: Repeated keys that are broadcast at most, characters that are hashed at a time, and slots of an array that is broadcast.
BROADCAST, CHUNK, SLOTS = 1_000_000, 1 << 20, 1 << 22
_ODD = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def copy_flag(df: DataFrame, *columns: str) -> DataFrame:
    """All rows, with ``is_copy`` where another row has the same values; counted by aggregation, not by a window over a hot value."""
    n = df.groupBy(*(F.col(c).alias(f"_{c}") for c in columns)).agg(F.count("*").alias("_n")).filter("_n > 1")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns))
    return df.join(n, same, "left").select(*df.columns, F.col("_n").isNotNull().alias("is_copy"))


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in order; by aggregation, so that a hot key combines before the shuffle."""
    rest = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(*keys).agg(F.min_by(rest, F.struct(*order)).alias("_row")).select("_row.*")


def later_flag(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """All rows, with ``is_later`` where an earlier row has the same key."""
    first = df.select(key.alias("_key"), F.struct(*order).alias("_at")).groupBy("_key").agg(F.min("_at").alias("_first"))
    return (
        df.withColumn("_key", key)
        .join(first, "_key")
        .withColumn("is_later", F.struct(*order) > F.col("_first"))
        .drop("_key", "_first")
    )


def one_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): one row per key with its greatest text.  Only texts of repeated keys are shuffled, if these can be broadcast."""
    again = cut(df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_key"))
    rows = df.select(key, text)
    if again.count() > BROADCAST:
        return rows.groupBy(key).agg(F.max(text).alias(text))
    same, keys = F.col(key).eqNullSafe(F.col("_key")), F.broadcast(again)
    return rows.join(keys, same, "left_anti").unionByName(rows.join(keys, same, "left_semi").groupBy(key).agg(F.max(text).alias(text)))


_POWERS: dict[str, np.ndarray] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    if len(_POWERS.get("up", ())) < size:
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[:1] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:size], _POWERS["down"][:size]


def hashed_shingles(bodies: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct runs of ``k`` words of each body, in order; a body is lower-case ASCII words with a space after each."""
    text = np.frombuffer("".join(bodies).encode("ascii"), np.uint8)
    stops = np.flatnonzero(text == 32)
    starts = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
    row = np.searchsorted(np.cumsum([len(b) for b in bodies]), starts, "right")
    first = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :]) if len(row) >= k else np.zeros(0, np.int64)
    up, down = _powers(len(text) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[text] * up[:-1], dtype=np.uint64)])
    h = (sums[stops[first + k - 1]] - sums[starts[first]]) * down[starts[first]]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    row = row[first]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[str], pa.RecordBatch]]:
    """Bodies and rows, about ``CHUNK`` characters at a time."""
    for batch in batches:
        bodies, at = batch.column("body").to_pylist(), 0
        while at < len(bodies):
            to, size = at, 0
            while to < len(bodies) and (to == at or size + len(bodies[to]) <= CHUNK):
                size += len(bodies[to])
                to += 1
            yield bodies[at:to], batch.slice(at, to - at)
            at = to


def _slots(df: DataFrame) -> np.ndarray:
    """An array of ``SLOTS`` bytes from rows (slot, level)."""
    found = df.toArrow()
    out = np.zeros(SLOTS, np.uint8)
    out[found["slot"].to_numpy()] = found["level"].to_numpy()
    return out


def _levels(bodies: DataFrame, k: int) -> np.ndarray:
    """By slot, the logarithm of how many bodies have a shingle of that slot, of the shingles that several have; 0 for none.

    Any order that all texts share will do for the prefixes, so slots may mix shingles.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, _ in _chunks(batches):
            g, n = np.unique((hashed_shingles(texts, k)[1] >> np.uint64(32)).astype(np.uint32).view(np.int32), return_counts=True)
            yield pa.record_batch({"g": g, "n": n.astype(np.int32)})

    n = bodies.select("body").mapInArrow(count, "g int, n int").groupBy("g").agg(F.sum("n").alias("n")).filter("n > 1")
    slots = n.groupBy(F.pmod("g", F.lit(SLOTS)).alias("slot")).agg(F.sum("n").alias("n"))
    return _slots(slots.select("slot", F.least(F.lit(255), F.floor(8 * F.log2("n"))).cast("int").alias("level")))


def _prefixes(bodies: DataFrame, k: int, least: int, similar: float) -> DataFrame:
    """(g, c, n, s, t): the rarest shingles of each text of which one is shared with each similar text, its size, and 128 bits of the
    parities of its shingles; without shingles that no other text has."""
    sc = bodies.sparkSession.sparkContext
    shared = sc.broadcast(_levels(bodies, k))

    def prefix(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, batch in _chunks(batches):
            row, h = hashed_shingles(texts, k)
            n = np.bincount(row, minlength=len(texts))
            level = shared.value[(h >> np.uint64(32)).astype(np.int64) & (SLOTS - 1)]
            order = np.lexsort((h, level, row))
            at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            kept = (n >= least)[row] & (at < (n - np.ceil(similar * n - 1e-9) + 1)[row]) & (level[order] > 0)
            marks = []
            for half in range(2):
                bits = np.zeros((len(texts), 64), np.int64)
                mine = (h >> np.uint64(6) & np.uint64(1)).astype(np.int64) == half
                np.add.at(bits, (row[mine], (h[mine] & np.uint64(63)).astype(np.int64)), 1)
                marks.append(np.bitwise_or.reduce((bits & 1).astype(np.uint64) << np.arange(64, dtype=np.uint64), axis=1).view(np.int64))
            c = batch.column("c").to_numpy()
            yield pa.record_batch({"g": h[order][kept].view(np.int64), "c": c[row[kept]], "n": n[row[kept]].astype(np.int32), "s": marks[0][row[kept]], "t": marks[1][row[kept]]})

    return bodies.mapInArrow(prefix, "g long, c long, n int, s long, t long")


def _candidates(prefixes: DataFrame, similar: float) -> DataFrame:
    """(x, y): classes x < y that share a shingle of their prefixes and may be similar by their sizes and parities."""
    df = F.count("*").over(Window.partitionBy("g"))
    rows = prefixes.repartition("g").dropDuplicates(["g", "c"]).withColumn("df", df).filter("df > 1")

    def met(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        a, b = a.alias("a"), b.alias("b")
        apart = F.bit_count(F.col("a.s").bitwiseXOR(F.col("b.s"))) + F.bit_count(F.col("a.t").bitwiseXOR(F.col("b.t")))
        near = (F.col("a.n") * similar <= F.col("b.n") + 1e-9) & (F.col("b.n") * similar <= F.col("a.n") + 1e-9)
        # Each shingle that one text has and the other lacks turns one bit.
        close = apart <= (F.col("a.n") + F.col("b.n")) * ((1 - similar) / (1 + similar)) + 1e-9
        same = reduce(and_, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in on))
        return a.join(b, same & (F.col("a.c") < F.col("b.c")) & near & close).select(F.col("a.c").alias("x"), F.col("b.c").alias("y"))

    few, many = rows.filter(F.col("df") <= SPLIT), rows.filter(F.col("df") > SPLIT)
    # A shingle of many texts is split: one side by hash into cells of SPLIT texts, the other goes to each of them.
    cells = F.ceil(F.col("df") / SPLIT).cast("int")
    one = many.withColumn("cell", F.pmod(F.xxhash64("c"), cells).cast("int")).repartition("g", "cell")
    each = many.withColumn("cell", F.explode(F.sequence(F.lit(0), cells - 1))).repartition("g", "cell")
    return met(few, few, ["g"]).unionAll(met(one, each, ["g", "cell"])).distinct()


def _similar(candidates: DataFrame, bodies: DataFrame, k: int, similar: float) -> DataFrame:
    """(x, y, similarity) of the candidates that are similar, by their words."""
    sc = bodies.sparkSession.sparkContext
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    asked = candidates.select(F.explode(F.array("x", "y")).alias("c")).select(slot("c").alias("slot")).distinct()
    marked = sc.broadcast(_slots(asked.select("slot", F.lit(1).alias("level"))))

    def those(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked.value[batch.column("slot").to_numpy()] > 0)).select(["c", "body"])

    def shingles(body: str) -> set[tuple[str, ...]]:
        w = body.split()
        return set(zip(*(w[i:] for i in range(k))))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column("p").to_pylist(), batch.column("q").to_pylist()):
                a, b = shingles(a), shingles(b)
                both = len(a & b)
                out.append(both / (len(a) + len(b) - both))
            yield pa.record_batch({"x": batch.column("x"), "y": batch.column("y"), "similarity": pa.array(out, pa.float64())})

    texts = bodies.withColumn("slot", slot("c")).mapInArrow(those, "c long, body string").repartition("c").dropDuplicates(["c"])
    p, q = texts.select(F.col("c").alias("x"), F.col("body").alias("p")), texts.select(F.col("c").alias("y"), F.col("body").alias("q"))
    return candidates.join(p, "x").join(q, "y").select("x", "y", "p", "q").mapInArrow(compare, "x long, y long, similarity double").filter(F.col("similarity") >= similar)


def similar_pairs(docs: DataFrame, key: str, text: str, k: int = 5, least: int = LEAST_SHINGLES, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, similarity) of class representatives with a < b; members (key, representative).

    Texts with equal word sequences are one class, represented by its least key.  Texts of fewer than ``least``
    shingles are in no pair and in no class but their own.  Texts are read again for each step; of what depends on their
    length only prefixes, and the texts of candidates, are shuffled.
    """
    body = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+", " "))
    rows = docs.select(F.col(key).alias("id"), body.alias("body"))
    members = cut(rows.select("id", F.when(F.col("body") != "", F.xxhash64("body")).alias("class")).alias("m"))
    bodies = rows.select(F.xxhash64("body").alias("c"), F.concat("body", F.lit(" ")).alias("body"))
    candidates = cut(_candidates(_prefixes(bodies, k, least, similar), similar))
    found = cut(_similar(candidates, bodies, k, similar))
    reps = members.filter("class is not null").groupBy("class").agg(F.min("id").alias("representative"))
    named = lambda c, to: reps.select(F.col("class").alias(c), F.col("representative").alias(to))
    pairs = found.join(named("x", "p"), "x").join(named("y", "q"), "y").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.round("similarity", 6).alias("similarity"))
    members = members.join(reps, "class", "left").select("id", F.coalesce("representative", "id").alias("representative"))
    return pairs, members


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): the least id that each node reaches.  nodes: (id); edges: (a, b) in either direction.

    Roots only ever fall, so it ends; paths halve, so after about as many rounds as the longest path has digits in base 2.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select("id", F.col("id").alias("root")))
    while True:
        heard = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("root").alias("heard"))
        # The least root heard, and the root of that root: paths halve in each round.
        new = labels.join(heard, labels["id"] == heard["a"], "left").select("id", F.least("root", F.coalesce("heard", "root")).alias("root"))
        jump = new.select(F.col("id").alias("j"), F.col("root").alias("beyond"))
        new = cut(new.join(jump, new["root"] == jump["j"], "left").select("id", F.coalesce("beyond", "root").alias("root")))
        moved = new.join(labels.select("id", F.col("root").alias("old")), "id").filter("root <> old").limit(1).count()
        labels = new
        if not moved:
            return labels
