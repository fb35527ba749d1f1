"""Mixing sources to target shares of the total size in tokens.

Entropy balancing: each document gets a rate, the expected number of its copies.
Of all rates within [0, cap] that meet the token constraint of their source, the
ones nearest in relative entropy to one copy each are exponentially tilted,
``min(cap, exp(u * x))`` with ``x`` the document's size against the mean of its
source; ``u``, one number per source, maximises the concave dual.  Newton
iterations on all sources at once sum the dual's derivatives over the documents
with one distributed aggregation each, on a histogram of sizes that has the same
sums.  Rates are then rounded to copies: of the fractions, what
rounding leaves over is carried from long to short documents, so that the tokens of a source stay within one document of its
target, and mostly much closer; ranks are taken inside (source, size, slot), never over
a source, and the number of slots grows with the corpus.

The total is the largest that every present source can supply within its
``max_repeats``; ``budget`` asks for a smaller one.  The shares of sources without
documents go to the others in proportion, and the report says so.

Defined results: documents without a source, of sources without a target, and of
no tokens get no copies (the report counts what is available); repeated rows of a
``doc_id`` count once; ties in size are broken by a hash of the id; an empty table
gives a report of shares 0 and no copies; other columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm import tokens
from quarrylight.llm.common import cut

#: Slots by which documents of one source and size are spread, at least, and documents of the corpus for each.
SLOTS, PER_SLOT = 64, 1_000_000
#: Newton: relative error of the token constraint, and the longest step in u.
EXACT, LONGEST = 1e-6, 4.0


def _wanted(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """source -> (share, max_repeats); the table has a row per source and is small by nature."""
    rows = targets.dropna(subset=["source", "target_share", "max_repeats"]).groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    return {r.source: (float(r.target_share), int(r.max_repeats)) for r in rows.collect()}


def balance(histogram: DataFrame, goals: dict[str, tuple[float, int, float]]) -> dict[str, float]:
    """u of each source by damped Newton steps; ``goals``: source -> (target tokens, cap, mean size).

    Works on the logarithm of the token sum, in which the steps are nearly exact: with S(u) the tokens at u, the step is
    (log target - log S) / (log S)'.  A bracket keeps the steps safe where the cap flattens the sum; it halves from then on,
    so every source ends at its target or where no other number lies between.
    """
    spark = histogram.sparkSession
    u = dict.fromkeys(goals, 0.0)
    low, high = {s: -math.inf for s in goals}, {s: math.inf for s in goals}
    open_ = set(goals)
    while open_:
        now = spark.createDataFrame(
            [(s, u[s], float(goals[s][1]), goals[s][2]) for s in open_], "source string, u double, cap double, mean double"
        )
        x = F.col("n_tokens") / F.col("mean")
        rate = F.least(F.col("cap"), F.exp(F.least(F.col("u") * x, F.lit(50.0))))
        mass = rate * F.col("n_tokens") * F.col("n")
        sums = (
            histogram.join(F.broadcast(now), "source")
            .groupBy("source")
            .agg(F.sum(mass).alias("s"), F.sum(F.when(rate < F.col("cap"), mass * x).otherwise(0.0)).alias("ds"))
            .collect()
        )
        for r in sums:
            s, gap = r.source, math.log(goals[r.source][0]) - math.log(max(r.s, 1e-300))
            if abs(gap) < EXACT:
                open_.discard(s)
                continue
            low[s], high[s] = (u[s], high[s]) if gap > 0 else (low[s], u[s])
            step = gap / (r.ds / r.s) if r.ds > 0 else math.copysign(LONGEST, gap)
            new = u[s] + max(-LONGEST, min(LONGEST, step))
            if not low[s] < new < high[s]:
                new = (low[s] + high[s]) / 2 if math.isfinite(low[s] + high[s]) else new
            if new == u[s]:
                open_.discard(s)
            u[s] = new
    return u


def _quotas(sizes: pd.DataFrame) -> pd.DataFrame:
    """How many documents of each size get one copy more than the whole part of their rate.

    One source at a time: a row per size, so the longest text bounds the table, not the corpus.  What a size's rounding
    leaves over in tokens is carried to the next, shorter one, so the last leaves over less than a short document.
    """
    sizes = sizes.sort_values("n_tokens", ascending=False)
    quota, owed = [], 0.0
    for t, n, part in zip(sizes.n_tokens, sizes.n, sizes.part):
        owed += part * n * t
        q = min(n, max(0, math.floor(owed / t + 0.5)))
        owed -= q * t
        quota.append(q)
    return sizes.assign(quota=quota)[["source", "n_tokens", "n", "base", "quota"]]


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, folder: str = tokens.TOKENIZERS, name: str = tokens.NAME) -> tuple[DataFrame, DataFrame]:
    """(copies, report).

    copies: (doc_id, source, n_tokens, copies) of the documents drawn at least once.
    report: a row per source of the targets with its target share, the share of the total reached, documents, tokens and
    the most copies of one document.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "source", "text").filter(F.col("doc_id").isNotNull())
    sized = cut(tokens.sizes(docs, "doc_id", "source", folder=folder, name=name).dropDuplicates(["doc_id"]))
    wanted = _wanted(targets)
    usable = sized.filter(F.col("source").isin(list(wanted)) & (F.col("n_tokens") > 0))
    histogram = cut(usable.groupBy("source", "n_tokens").agg(F.count("*").alias("n")))

    held = histogram.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n_tokens")).alias("t")).collect()
    present = {r.source: (wanted[r.source][0], wanted[r.source][1], r.t, r.t / r.n) for r in held if wanted[r.source][0] > 0 and wanted[r.source][1] > 0}
    # Slots grow with the corpus, so the documents that are ranked in one don't.
    slots = max(SLOTS, -(-sum(r.n for r in held) // PER_SLOT))
    whole = sum(share for share, *_ in present.values())
    reach = min((cap * t * whole / share for share, cap, t, _ in present.values()), default=0.0)
    total = reach if budget is None else min(reach, float(budget))
    goals = {s: (total * share / whole, cap, mean) for s, (share, cap, t, mean) in present.items() if total > 0}
    # A source that needs every copy it may have has its rates at the cap; no finite u gives that.
    full = {s for s, (goal, cap, _) in goals.items() if goal >= cap * present[s][2] * (1 - 1e-9)}
    tilts = balance(histogram, {s: g for s, g in goals.items() if s not in full})

    rule = spark.createDataFrame(
        [(s, float(cap), mean, None if s in full else tilts[s]) for s, (_, cap, mean) in goals.items()],
        "source string, cap double, mean double, u double",
    )
    tilted = F.least(F.col("cap"), F.exp(F.least(F.col("u") * F.col("n_tokens") / F.col("mean"), F.lit(50.0))))
    rate = F.coalesce(tilted, F.col("cap"))

    # Rounding: whole parts first; the fractions are given out by size, from long documents to short ones, then evenly to slots.
    rates = histogram.join(F.broadcast(rule), "source").select("source", "n_tokens", "n", F.floor(rate).alias("base"), (rate - F.floor(rate)).alias("part"))
    quotas = rates.groupBy("source").applyInPandas(_quotas, "source string, n_tokens long, n long, base long, quota long")
    placed = usable.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int"))
    over = Window.partitionBy("source", "n_tokens").orderBy("slot")
    upto = placed.groupBy("source", "n_tokens", "slot").agg(F.count("*").alias("here")).withColumn("upto", F.sum("here").over(over))
    given = lambda m: F.floor(F.col("quota") * m / F.col("n"))
    slotted = upto.join(quotas, ["source", "n_tokens"]).select(
        "source", "n_tokens", "slot", "base", (given(F.col("upto")) - given(F.col("upto") - F.col("here"))).alias("quota")
    )
    rank = Window.partitionBy("source", "n_tokens", "slot").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    copies = (
        placed.join(slotted, ["source", "n_tokens", "slot"])
        .withColumn("copies", F.col("base") + (F.row_number().over(rank) <= F.col("quota")).cast("long"))
        .filter("copies > 0")
        .select("doc_id", "source", "n_tokens", "copies")
    )

    asked = spark.createDataFrame([(s, a, m) for s, (a, m) in wanted.items()], "source string, target_share double, max_repeats int")
    used = copies.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    stock = sized.groupBy("source").agg(F.count("*").alias("available"), F.sum("n_tokens").alias("available_tokens"))
    report = asked.join(used, "source", "left").join(stock, "source", "left")
    every = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documents", "tokens", "most_copies", "available", "available_tokens")]
    report = report.select(
        "source", "target_share", F.round(F.coalesce(F.col("tokens") / every, F.lit(0.0)), 6).alias("share"), "max_repeats", *zero
    )
    return copies, report
