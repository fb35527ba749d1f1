"""Queries of the training-data operators; each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm import boilerplate, mixing, pii, residue, sentences, tokens, toxicity, turns


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.abusive(_t(spark, d, "comments_no_pii"), _t(spark, d, "comment_labels"))


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.scored(_t(spark, d, "comments_no_pii"), _t(spark, d, "comment_labels"))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates(_t(spark, d, "comments_no_pii"), _t(spark, d, "comment_labels"))


def p1_passages(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.passages(_t(spark, d, "comments_no_pii"), _t(spark, d, "comment_labels"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return turns.turns(_t(spark, d, "transcript_segments"), _t(spark, d, "video_speakers")).select(
        "video_id", "first_segment_id", "last_segment_id", "speaker_no"
    )


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.turn_texts(_t(spark, d, "transcript_segments"), _t(spark, d, "video_speakers"))


_RECORDS = (("comments_no_pii", "comment_id", "comment_clean"), ("transcript_segments", "segment_id", "text"))
#: Key of the pseudonyms of p4_redacted; a deployment passes its own secret to ``pii.redacted``.
_KEY = b"test key, not a secret"


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = (pii.items(_t(spark, d, t), t, i, c) for t, i, c in _RECORDS)
    return a.unionByName(b)


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    a, b = (pii.redacted(_t(spark, d, t), t, i, c, _KEY) for t, i, c in _RECORDS)
    return a.unionByName(b)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.found(_t(spark, d, "gdelt_news_articles"))


def p3_main_text(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_text(_t(spark, d, "gdelt_news_articles"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.found(_t(spark, d, "gdelt_news_articles"))


def p5_validation(spark: SparkSession, d: str) -> DataFrame:
    return residue.validation(_t(spark, d, "gdelt_news_articles"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(_t(spark, d, "documents"))


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split(_t(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {}
