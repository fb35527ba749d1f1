"""The flow of checked claims: traceable items, routes by rules, retrieval plans, results of a model with their guards, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import fields
from quarrylight.functions import text as T
from quarrylight.operators import evidence, search
from quarrylight.operators.storage import cut


def traced(items: DataFrame, text: str, quote: str, checks: Sequence[tuple[Column, str]]) -> DataFrame:
    """Items with start_char, end_char, sentence_ids and ``reason``, null for those that may stay.

    A quotation must be found and overlap a sentence; the last of the checks (broken, reason) that is broken overrides
    what was found before, as they are made in order.
    """
    spanned = items.withColumn("_at", fields.locate(F.col(text), F.col(quote))).withColumn("_s", fields.sentence_spans(F.col(text)))
    touched = F.filter("_s", lambda s: (s["start"] < F.col("_at.end")) & (s["end"] > F.col("_at.start")))
    out = spanned.withColumn("sentence_ids", F.transform(touched, lambda s: s["id"]))
    reason = F.when(F.col("_at").isNull(), "quote not found").when(F.size("sentence_ids") == 0, "no sentence")
    for broken, why in checks:
        reason = F.when(F.coalesce(broken, F.lit(False)), why).otherwise(reason)
    return out.select(*items.columns, F.col("_at.start").alias("start_char"), F.col("_at.end").alias("end_char"), "sentence_ids", reason.alias("reason"))


def routed(text: Column, window: Column, by_wording: Sequence[tuple[str, dict]], by_window: dict[str, dict], fallback: dict) -> Column:
    """(documents, tiers, review, reason) of the first rule (pattern, route) that the wording matches, else of the window, else the fallback.

    All rules of wording that match give their documents and tiers, in order and each once.
    """

    def route(r: dict) -> Column:
        lists = [F.array(*map(F.lit, r[c])).alias(c) for c in ("documents", "tiers")]
        return F.struct(*lists, F.lit(r["review"]).alias("review"), F.lit(r["reason"]).alias("reason"))

    hits = F.array_compact(F.array(*(F.when(text.rlike(p), route(r)) for p, r in by_wording)))
    merged = F.struct(
        F.array_distinct(F.flatten(F.transform(hits, lambda h: h["documents"]))).alias("documents"),
        F.array_distinct(F.flatten(F.transform(hits, lambda h: h["tiers"]))).alias("tiers"),
        (hits[0]["review"] | (F.size(hits) > 1)).alias("review"),
        F.array_join(F.transform(hits, lambda h: h["reason"]), "; ").alias("reason"),
    )
    out = route(fallback)
    for name, r in by_window.items():
        out = F.when(window == name, route(r)).otherwise(out)
    return F.when(F.size(hits) > 0, merged).otherwise(out)


def plan(claims: DataFrame, facts: DataFrame, passages: DataFrame, per_fact: int, per_claim: int, most: int) -> DataFrame:
    """(claim_id, passage_id, place, origin): what a claim is checked against.

    ``claims`` (claim_id, text, as_of), ``facts`` (fact_id, statement, passage_id of the primary passage, null for none),
    ``passages`` (passage_id, text, available).  The best facts of a claim give one primary passage each, then the best
    passages fill up to ``most``; those that came later than ``as_of`` are left out after the ranking's statistics.
    """
    asked = claims.select("claim_id", "text")
    by_fact = search.top_k(search.bm25(facts, "fact_id", "statement", asked, "claim_id", "text"), "claim_id", "fact_id", per_fact)
    primary = by_fact.join(facts.select("fact_id", "passage_id"), "fact_id").filter("passage_id is not null")
    scored = search.bm25(passages, "passage_id", "text", asked, "claim_id", "text")
    timely = scored.join(claims.select("claim_id", "as_of"), "claim_id").join(passages.select("passage_id", "available"), "passage_id")
    hits = search.top_k(timely.filter(search.as_of(F.col("available"), F.col("as_of"))), "claim_id", "passage_id", per_claim)
    both = primary.select("claim_id", "passage_id", F.lit("fact").alias("origin"), "rank").unionByName(hits.select("claim_id", "passage_id", F.lit("search").alias("origin"), "rank"))
    order = F.struct("origin", "rank")  # "fact" stands before "search"
    first = both.groupBy("claim_id", "passage_id").agg(F.min(order).alias("o"))
    w = Window.partitionBy("claim_id").orderBy("o", "passage_id")
    return first.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("claim_id", "passage_id", "place", F.col("o.origin").alias("origin"))


VERDICTS = ("supported", "partially_supported", "contradicted", "not_verifiable")


def applied(prepared: DataFrame, results: DataFrame) -> DataFrame:
    """(claim_id, status, verdict, evidence_ids, reason, review) of every prepared claim, whatever the model returned.

    ``prepared`` (claim_id, claim, retrieved: array of ids, texts: map id -> text); ``results`` (claim_id, status, verdict,
    ids, reason) with the status ``ok``, ``filtered`` or ``error``.  Claims without a result can't be verified.  Ids that
    weren't retrieved are dropped, and named in the reason only as such; a verdict without an id that stays falls to
    not_verifiable, a supported one whose numbers the cited texts lack to partially_supported.
    """
    j = prepared.join(results, "claim_id", "left")
    ids = F.coalesce("ids", F.array().cast(prepared.schema["retrieved"].dataType))
    j = j.withColumn("_valid", F.array_distinct(F.filter(ids, lambda i: F.array_contains("retrieved", i))))
    j = j.withColumn("_lost", F.array_distinct(F.filter(ids, lambda i: ~F.array_contains("retrieved", i))))
    named = lambda i: F.concat(F.lit(T._START), fields.literal(i.cast("string")), F.lit(T._STOP))
    redacted = F.aggregate("_lost", F.coalesce("reason", F.lit("")), lambda s, i: F.regexp_replace(s, named(i), F.lit("[unknown]")))
    given = F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise("not_verifiable")
    unproved = (given != "not_verifiable") & (F.size("_valid") == 0)
    cited = F.array_join(F.transform("_valid", lambda i: F.coalesce(F.try_element_at("texts", i), F.lit(""))), " ")
    missing = F.array_sort(evidence.unsupported_numbers(F.col("claim"), cited))
    lowered = (given == "supported") & ~unproved & (F.size(missing) > 0)
    ok = F.col("status") == "ok"
    verdict = F.when(~F.coalesce(ok, F.lit(False)) | unproved, "not_verifiable").when(lowered, "partially_supported").otherwise(given)
    notes = F.concat_ws(
        " ",
        F.nullif(redacted, F.lit("")),
        F.when(F.size("_lost") > 0, "Unknown ids were removed."),
        F.when(unproved, "No valid citation."),
        F.when(lowered, F.concat(F.lit("Numbers not found: "), F.array_join(missing, ", "), F.lit("."))),
    )
    reason = F.when(F.col("status").isNull(), "No result.").when(F.col("status") == "filtered", "Blocked by a content filter.").when(~ok, "No valid answer.").otherwise(notes)
    status = F.when(F.col("status").isNull() | ok, "complete").when(F.col("status") == "filtered", "content_filtered").otherwise("model_error")
    keep = F.coalesce(ok, F.lit(False)) & ~unproved
    out = j.select("claim_id", status.alias("status"), verdict.alias("verdict"), F.when(keep, F.col("_valid")).otherwise(F.array().cast(prepared.schema["retrieved"].dataType)).alias("evidence_ids"), reason.alias("reason"))
    return out.withColumn("review", (F.col("status") != "complete") | F.col("verdict").isin("partially_supported", "not_verifiable"))


def verdict_counts(rows: DataFrame, keys: Sequence[str], verdict: str) -> DataFrame:
    """Per key, or over all: claims, a count of each verdict, and those without one."""
    counts = [F.count_if(F.col(verdict) == v).alias(v) for v in VERDICTS]
    return rows.groupBy(*keys).agg(F.count("*").alias("claims"), *counts, F.count_if(F.col(verdict).isNull()).alias("unchecked"))


def facts_verified(quotes: DataFrame, passages: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """(fact_id, quotes, found, best_tier, verified, misplaced): whether all quotations of a fact stand in the passages of their document.

    ``quotes`` (fact_id, doc, quote), ``passages`` (doc, tier, text).  ``misplaced`` counts quotations whose best tier, the
    first in order, isn't an allowed one.
    """
    tiers = passages.select("tier").distinct()
    asked = quotes.select("doc", "quote").distinct().crossJoin(F.broadcast(tiers))  # tiers are a closed list
    keyed = lambda df: df.withColumn("_g", F.concat_ws("\u0002", "doc", "tier"))
    held = evidence.verify_quotes(keyed(asked), keyed(passages), "_g", "quote", "text").filter("found").groupBy("doc", "quote").agg(F.min("tier").alias("tier"))
    each = quotes.join(held, ["doc", "quote"], "left")
    return each.groupBy("fact_id").agg(
        F.count("*").alias("quotes"),
        F.count("tier").alias("found"),
        F.min("tier").alias("best_tier"),
        (F.count("*") == F.count("tier")).alias("verified"),
        F.count_if(~F.col("tier").isin(*allowed)).alias("misplaced"),
    )


def change_status(kind: Column, old_quote: Column, new_quote: Column, old_text: Column, new_text: Column) -> Column:
    """First rule that a compared change breaks, else ``validated``: quotations stand in their version, added and removed ones lack
    the other, modified ones differ, unchanged ones don't."""
    old, new = fields.rule_key(old_quote), fields.rule_key(new_quote)
    there = lambda q, t: (q != "") & F.contains(fields.rule_key(t), q)
    both = kind.isin("modified", "unchanged")
    return (
        F.when(~kind.isin("added", "removed", "modified", "unchanged") | kind.isNull(), "unknown kind")
        .when((both | (kind == "removed")) & ~there(old, old_text), "old quote not found")
        .when((both | (kind == "added")) & ~there(new, new_text), "new quote not found")
        .when((kind == "added") & (old != ""), "added has an old quote")
        .when((kind == "removed") & (new != ""), "removed has a new quote")
        .when((kind == "modified") & (old == new), "modified without a difference")
        .when((kind == "unchanged") & (old != new), "unchanged with a difference")
        .otherwise("validated")
    )


def best_matches(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity): for each left (id, text) the right one with the most similar set of words, ties by id.

    Texts of equal sets are one class, which its least right id stands for.  Most classes have an equal one; of the others
    only those are compared that may be similar enough: word sets of Jaccard similarity ``least`` share one of the
    ``|s| - ceil(least |s|) + 1`` rarest words of each.  Their best is taken while they are joined, so pairs aren't shuffled.
    """
    sets = lambda df: df.select("id", F.array_sort(F.array_distinct(T.words(F.col("text")))).alias("s")).filter("size(s) > 0")
    rows, b = sets(left), cut(sets(right).groupBy("s").agg(F.min("id").alias("b")))
    equal = cut(rows.select("s").distinct().join(b, "s", "left"))
    a = equal.filter("b is null").select("s")
    word = lambda df: df.select("s", F.explode("s").alias("w"))
    n_a, n_b = (word(x).groupBy("w").agg(F.count("*").alias(c)) for x, c in ((a, "m"), (b, "n")))
    both = cut(n_a.join(n_b, "w").select("w", (F.col("m") + F.col("n")).alias("df")))
    # Words of one side alone only count: sets are the same to the other side if they have the same other words and size.
    core = lambda x: word(x).join(both, "w").groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda t: t["w"]).alias("core")).withColumn("n", F.size("s"))
    core_a = cut(core(a))
    one, other = core_a.select("core", "n").distinct(), cut(core(b).join(b, "s").groupBy("core", "n").agg(F.min("b").alias("b")))
    first = F.size("core") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1
    prefix = lambda x: x.filter(first > 0).withColumn("w", F.explode(F.slice("core", F.lit(1), first.cast("int"))))
    met = prefix(one).join(prefix(other).select(F.col("core").alias("core_b"), F.col("n").alias("n_b"), "b", "w"), "w")
    near = (F.col("n") * least <= F.col("n_b") + 1e-9) & (F.col("n_b") * least <= F.col("n") + 1e-9)
    shared = F.size(F.array_intersect("core", "core_b"))
    scored = met.filter(near).select("core", "n", "b", (shared / (F.col("n") + F.col("n_b") - shared)).alias("similarity")).filter(F.col("similarity") >= least)
    best = scored.groupBy("core", "n").agg(F.min_by(F.struct("b", "similarity"), F.struct(-F.col("similarity"), F.col("b"))).alias("x"))
    best = core_a.join(best, ["core", "n"]).select("s", "x.b", "x.similarity")
    found = equal.filter("b is not null").select("s", "b", F.lit(1.0).alias("similarity")).unionByName(best)
    return rows.select(F.col("id").alias("a"), "s").join(found, "s").select("a", "b", F.round("similarity", 6).alias("similarity"))
