"""Panels of a briefing: small tables aggregated from several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T

COMMENTS_SQL = """with c as (select distinct comment_id, docket_id, lower(trim(channel)) as channel from comments_no_pii)
select docket_id, count(*) as comments, round(100.0 * count(*) / sum(count(*)) over (), 2) as share, count(*) filter (where channel = 'web_form') as web_form, row_number() over (order by count(*) desc, docket_id) as rank from c group by docket_id"""


def comments(rows: DataFrame, dockets: DataFrame) -> DataFrame:
    """Comments per docket with the share of all, those by web form, and the rank by size."""
    c = rows.select("comment_id", "docket_id", F.lower(F.trim("channel")).alias("channel")).distinct()
    n = c.groupBy("docket_id").agg(F.count("*").alias("comments"), F.count_if(F.col("channel") == "web_form").alias("web_form"))
    one = Window.partitionBy(F.lit(1))
    return n.select(
        "docket_id",
        "comments",
        F.round(100.0 * F.col("comments") / F.sum("comments").over(one), 2).alias("share"),
        "web_form",
        F.row_number().over(one.orderBy(F.desc("comments"), "docket_id")).alias("rank"),
    )


NEWS_SQL = """with a as (select distinct article_id, domain, sourcecountry, language, length(article_text) as n from gdelt_news_articles)
select coalesce(language, 'unknown') as language, count(*) as articles, count(distinct domain) as publishers, count(distinct sourcecountry) as countries, round(avg(n), 3) as mean_chars, min(n) as least_chars, max(n) as most_chars from a group by 1"""


def news(rows: DataFrame) -> DataFrame:
    """Articles, publishers, countries and text lengths per language."""
    a = rows.select("article_id", "domain", "sourcecountry", "language", F.length("article_text").alias("n")).distinct()
    return a.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(
        F.count("*").alias("articles"),
        F.countDistinct("domain").alias("publishers"),
        F.countDistinct("sourcecountry").alias("countries"),
        F.round(F.avg("n"), 3).alias("mean_chars"),
        F.min("n").alias("least_chars"),
        F.max("n").alias("most_chars"),
    )


VIDEO_SQL = r"""with v as (select video_id, max(uploader) as uploader, max(duration_sec) as s, max(view_count) as vc from videos group by video_id),
c as (select *, case when regexp_matches(upper(replace(trim(vc), ',', '')), '^\d+(?:\.\d+)?\s*[KMB]?$') then floor(round(regexp_extract(upper(replace(trim(vc), ',', '')), '^(\d+(?:\.\d+)?)', 1)::decimal(20,6) *
case regexp_extract(upper(replace(trim(vc), ',', '')), '([KMB])$', 1) when 'K' then 1000 when 'M' then 1000000 when 'B' then 1000000000 else 1 end, 3))::bigint end as views from v)
select coalesce(uploader, 'unknown') as uploader, count(*) as videos, coalesce(sum(views), 0)::bigint as reach, round(sum(s), 3) as seconds, arg_max(video_id, (coalesce(views, -1), video_id)) as most_viewed from c group by 1"""


def video(rows: DataFrame) -> DataFrame:
    """Per uploader: videos, summed views, length, and the most viewed video; repeated rows of a video count once."""
    v = rows.groupBy("video_id").agg(F.max("uploader").alias("uploader"), F.max("duration_sec").alias("s"), F.max("view_count").alias("vc"))
    v = v.withColumn("views", T.human_count(F.col("vc")))
    return v.groupBy(F.coalesce("uploader", F.lit("unknown")).alias("uploader")).agg(
        F.count("*").alias("videos"),
        F.coalesce(F.sum("views"), F.lit(0)).alias("reach"),
        F.round(F.sum("s"), 3).alias("seconds"),
        F.max_by("video_id", F.struct(F.coalesce("views", F.lit(-1)), "video_id")).alias("most_viewed"),
    )


POLICY_SQL = "select o_orderstatus as change, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 2) as share, round(avg(o_totalprice), 2) as mean_size from orders where o_orderstatus <> 'P' group by 1"


def policy(rows: DataFrame) -> DataFrame:
    """Counts of change types without the unchanged ones; orders stand for the compared areas."""
    n = rows.filter("o_orderstatus <> 'P'").groupBy(F.col("o_orderstatus").alias("change")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean_size"))
    return n.select("change", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2).alias("share"), "mean_size")


TIMELINE_SQL = """select strftime(moment, '%Y-%m-%d') as day, docket_id, event, row_number() over (order by moment, docket_id, event) as position
from (select opens_at as moment, docket_id, 'opens' as event from dockets union all select closes_at, docket_id, 'closes' from dockets) where moment is not null"""


def timeline(dockets: DataFrame) -> DataFrame:
    """Opening and closing days of all dockets in order."""
    e = dockets.select(F.col("opens_at").alias("at"), "docket_id", F.lit("opens").alias("event")).unionByName(
        dockets.select(F.col("closes_at").alias("at"), "docket_id", F.lit("closes").alias("event"))
    )
    w = Window.partitionBy(F.lit(1)).orderBy("at", "docket_id", "event")
    return e.filter("at is not null").select(F.date_format("at", "yyyy-MM-dd").alias("day"), "docket_id", "event", F.row_number().over(w).alias("position"))


FOLLOWUPS_SQL = """select (select count(distinct comment_id) from comments_no_pii where comment_clean is null) as comments_without_text,
(select count(distinct article_id) from gdelt_news_articles where article_text is null) as articles_without_text, (select count(distinct video_id) from videos where published_date is null) as videos_without_date"""


def followups(comment_rows: DataFrame, article_rows: DataFrame, video_rows: DataFrame) -> DataFrame:
    """Counters of what still needs work, over three sources."""
    a = comment_rows.filter("comment_clean is null").agg(F.countDistinct("comment_id").alias("comments_without_text"))
    b = article_rows.filter("article_text is null").agg(F.countDistinct("article_id").alias("articles_without_text"))
    c = video_rows.filter("published_date is null").agg(F.countDistinct("video_id").alias("videos_without_date"))
    return a.crossJoin(b).crossJoin(c)


KEY_POINTS_SQL = """select (select count(distinct comment_id) from comments_no_pii) as comments, (select count(*) from dockets) as dockets, (select count(distinct article_id) from gdelt_news_articles) as articles,
(select count(distinct domain) from gdelt_news_articles) as publishers, (select count(distinct video_id) from videos) as videos, (select arg_max(docket_id, (n, docket_id)) from (select docket_id, count(distinct comment_id) as n from comments_no_pii group by 1)) as largest_docket,
(select round(100.0 * max(n) / sum(n), 2) from (select docket_id, count(distinct comment_id) as n from comments_no_pii group by 1)) as largest_share"""


def key_points(comment_rows: DataFrame, docket_rows: DataFrame, article_rows: DataFrame, video_rows: DataFrame) -> DataFrame:
    """One row of figures over all sources."""
    per = comment_rows.groupBy("docket_id").agg(F.countDistinct("comment_id").alias("n"))
    top = per.agg(F.max_by("docket_id", F.struct("n", "docket_id")).alias("largest_docket"), F.round(100.0 * F.max("n") / F.sum("n"), 2).alias("largest_share"))
    parts = [
        comment_rows.agg(F.countDistinct("comment_id").alias("comments")),
        docket_rows.agg(F.count("*").alias("dockets")),
        article_rows.agg(F.countDistinct("article_id").alias("articles"), F.countDistinct("domain").alias("publishers")),
        video_rows.agg(F.countDistinct("video_id").alias("videos")),
        top,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def shares(rows: DataFrame, label: str, score: str) -> DataFrame:
    """(label, n, pct, mean, least, most) of a closed list of labels."""
    n = rows.groupBy(label).agg(F.count("*").alias("n"), F.round(F.avg(score), 2).alias("mean"), F.min(score).alias("least"), F.max(score).alias("most"))
    return n.select(label, "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4).alias("pct"), "mean", "least", "most")


def balanced(rows: DataFrame, stance: str, quota: dict[str, int], order: list) -> DataFrame:
    """The first rows of each stance in order, as many as its quota; rows of other stances are left out."""
    most = F.create_map(*(F.lit(x) for kv in quota.items() for x in kv))[F.col(stance)]
    named = rows.filter(F.col(stance).isin(*quota))
    return named.withColumn("rank", F.row_number().over(Window.partitionBy(stance).orderBy(*order))).filter(F.col("rank") <= most)


def ends(groups: DataFrame, name: str, n: str, largest: int, smallest: int, without: list[str]) -> DataFrame:
    """The largest and the smallest groups of a short table, with their share of all; some names are counted but not listed."""
    whole = groups.agg(F.sum(n).alias("_whole"))
    named = groups.filter(~F.col(name).isin(*without))
    big, small = named.orderBy(F.desc(n), name).limit(largest), named.orderBy(n, name).limit(smallest)
    listed = big.withColumn("list", F.lit("largest")).unionByName(small.join(big.select(name), name, "left_anti").withColumn("list", F.lit("smallest")))
    return listed.crossJoin(whole).withColumn("pct", F.round(100.0 * F.col(n) / F.col("_whole"), 4)).drop("_whole")
