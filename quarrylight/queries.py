"""Queries of the core operators over whole tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import claims, dedup, evidence, export, factors, lexical, models, ordered, quality, sampling, search, sections
from quarrylight.plans import briefing

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

C = F.col


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- pieces of SQL ----------------------------------------------------------------------------------------------------

_BL = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_squeeze = lambda c: f"trim(regexp_replace({c}, '{_BL}+', ' ', 'g'))"
_strip = lambda c: f"regexp_replace({c}, '^{_BL}+|{_BL}+$', '', 'g')"
_clean = lambda c: _squeeze(
    rf"regexp_replace(regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g'), 'https?://[^\s]+|www\.[^\s]+', ' URL ', 'g')"
)
_words = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"
_stop = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_topic = lambda c: (
    f"list_filter(list_transform(regexp_extract_all({_squeeze(rf'''regexp_replace(translate(lower({_clean(c)}), '_/', '  '), '[^a-z0-9''#+.\- ]+', ' ', 'g')''')}, '[a-z][a-z0-9''#+.\\-]*'),"
    f" lambda t: regexp_replace(t, '^[''#+.\\-]+|[''#+.\\-]+$', '', 'g')), lambda t: length(t) >= 3 and not list_contains({_stop}, t))"
)
_search = lambda c: (
    rf"flatten(list_transform(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+(?:[-./][a-z0-9]+)*'),"
    r" lambda t: case when regexp_matches(t, '[-./]') then list_concat([t], regexp_split_to_array(t, '[-./]')) else [t] end))"
)
_STRAIGHT = "'“”‘’', '\"\"'''''"
_quote_key = lambda c: f"lower({_squeeze(f'translate({c}, {_STRAIGHT})')})"
_grams = lambda t, n: f"case when len({t}) >= {n} then list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i+{n - 1}], ' ')) else [] end"
_key = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]', '', 'g')"


# -- text -------------------------------------------------------------------------------------------------------------


@query(f"select comment_id, {_clean('comment_clean')} as cleaned from comments_no_pii")
def clean_text(spark, d):
    return _t(spark, d, "comments_no_pii").select("comment_id", T.clean(C("comment_clean")).alias("cleaned"))


#: Entities of the tables; the engine knows all.
_unescaped = "replace(replace(replace(replace(replace(comment_clean, '&nbsp;', chr(160)), '&#64;', '@'), '&#39;', chr(39)), '&quot;', chr(34)), '&amp;', '&')"


@query(f"select comment_id, {_clean(_unescaped)} as cleaned from comments_no_pii")
def clean_text_entities(spark, d):
    from quarrylight.functions.entities import unescape

    return _t(spark, d, "comments_no_pii").select("comment_id", T.clean(unescape("comment_clean")).alias("cleaned"))


@query(
    rf"""select comment_id, {_strip(r'''regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(comment_clean, ''), '(?i)<br\s*/?>|</p>', chr(10), 'g'), '<[^>]+>', '', 'g'), '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g')''')} as plain
from comments_no_pii"""
)
def html_to_text(spark, d):
    return _t(spark, d, "comments_no_pii").select("comment_id", T.html_to_text(C("comment_clean")).alias("plain"))


@query(r"select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) as words from documents where text is not null")
def word_count(spark, d):
    return _t(spark, d, "documents").filter("text is not null").select("doc_id", T.word_count(C("text")).cast("long").alias("words"))


@query("select article_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from gdelt_news_articles")
def label_slug(spark, d):
    return _t(spark, d, "gdelt_news_articles").select("article_id", T.slug(C("title")).alias("slug"))


@query(f"select comment_id, array_to_string({_topic('comment_clean')}, ' ') as tokens from comments_no_pii")
def tokenize_topics(spark, d):
    return _t(spark, d, "comments_no_pii").select("comment_id", F.array_join(T.topic_tokens(C("comment_clean")), " ").alias("tokens"))


@query(f"select doc_id, array_to_string({_search('text')}, ' ') as tokens from documents")
def bm25_tokens(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(T.search_tokens(C("text")), " ").alias("tokens"))


@query("select url, substr(sha256(trim(url)), 1, 16) as id, substr(sha1(concat_ws('|', domain, url)), 1, 12) as uid from gdelt_news_articles")
def stable_id(spark, d):
    return _t(spark, d, "gdelt_news_articles").select("url", T.short_hash(C("url")).alias("id"), T.uid(C("domain"), C("url")).alias("uid"))


@query(
    rf"""select article_id, coalesce(lower({_strip('is_repost')}) in ('1', 'true', 'yes'), false) as repost,
regexp_replace(seendate, '^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})Z$', '\1-\2-\3T\4:\5:\6Z') as seen_at,
case when regexp_matches(seendate, '^\d{{8}}') then regexp_replace(substr(seendate, 1, 8), '^(\d{{4}})(\d{{2}})(\d{{2}})$', '\1-\2-\3') end as seen_on
from gdelt_news_articles"""
)
def parse_flags_dates(spark, d):
    return _t(spark, d, "gdelt_news_articles").select(
        "article_id", T.truth(C("is_repost")).alias("repost"), T.compact_to_iso(C("seendate")).alias("seen_at"), T.compact_date(C("seendate")).alias("seen_on")
    )


@query(
    """select comment_id, strftime(timezone('America/New_York', timezone('UTC', collected_at)), '%Y-%m-%d %H:%M:%S') as eastern
from comments_no_pii"""
)
def eastern_time(spark, d):
    return _t(spark, d, "comments_no_pii").select("comment_id", T.eastern(C("collected_at").cast("timestamp")).alias("eastern"))


_hms = "case when floor(s / 3600) > 0 then printf('%d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60) else printf('%d:%02d', s // 60, s % 60) end"


@query(
    f"""select segment_id, label, case when len(n) = 3 then n[1] * 3600 + n[2] * 60 + n[3] else n[1] * 60 + n[2] end as back from (
select *, list_transform(regexp_extract_all(label, '\\d+'), lambda x: x::bigint) as n from (
select segment_id, {_hms} as label from (select segment_id, floor(start_s)::bigint as s from transcript_segments)))"""
)
def clock_labels(spark, d):
    s = _t(spark, d, "transcript_segments").select("segment_id", T.hms(C("start_s")).alias("label"))
    return s.withColumn("back", T.to_seconds(C("label")))


_count = lambda c: rf"""case when regexp_matches(upper(replace(trim({c}), ',', '')), '^\d+(?:\.\d+)?\s*[KMB]?$') then
floor(round(regexp_extract(upper(replace(trim({c}), ',', '')), '^(\d+(?:\.\d+)?)', 1)::decimal(20,6) *
case regexp_extract(upper(replace(trim({c}), ',', '')), '([KMB])$', 1) when 'K' then 1000 when 'M' then 1000000 when 'B' then 1000000000 else 1 end, 3))::bigint end"""  # noqa: E731


@query(f"select video_id, {_count('view_count')} as views, {_count('like_count')} as likes from videos")
def human_counts(spark, d):
    return _t(spark, d, "videos").select("video_id", T.human_count(C("view_count")).alias("views"), T.human_count(C("like_count")).alias("likes"))


@query(
    r"""with raw as (select video_id, coalesce(view_count, '0') || ' views · ' || coalesce(like_count, '0') || ' reactions | ' || coalesce(title, '') || ' | ' || coalesce(uploader, '') as r from videos)
select video_id, trim(substr(r, instr(r, ' | ') + 3)) as title, regexp_extract(r, '([\d.,]+[KMB]?) views', 1) as views, regexp_extract(r, '([\d.,]+[KMB]?) reactions', 1) as reactions
from raw where regexp_matches(r, '[\d.,]+[KMB]? views') and regexp_matches(r, '[\d.,]+[KMB]? reactions')"""
)
def split_titles(spark, d):
    raw = F.concat(F.coalesce("view_count", F.lit("0")), F.lit(" views · "), F.coalesce("like_count", F.lit("0")), F.lit(" reactions | "), F.coalesce("title", F.lit("")), F.lit(" | "), F.coalesce("uploader", F.lit("")))
    return _t(spark, d, "videos").select("video_id", T.split_title(raw).alias("s")).select("video_id", "s.*").filter("views is not null and reactions is not null")


@query(
    r"""select comment_id, regexp_replace(regexp_replace(regexp_replace(comment_clean, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+', '[removed]', 'g'),
'(?:\+?1[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}', '[removed]', 'g'),
'(^|[^\p{L}\p{N}_])((?i:my name is|this is|i''m|i am))\s+((?i:(?:attorney|lawyer|dr\.?)\s+)?)[A-Z][\p{L}\p{N}_''-]+(?:[\s-]+[A-Z][\p{L}\p{N}_''-]+){0,3}', '\1\2 \3[name]', 'g') as scrubbed from comments_no_pii"""
)
def pii_scrub(spark, d):
    return _t(spark, d, "comments_no_pii").select("comment_id", T.scrub(C("comment_clean")).alias("scrubbed"))


# RE2 has no look-around: every sign that is no part of a word is doubled, so that a match may consume one on either side.
_W = r"[^\p{L}\p{N}_]"
_said = ", ".join(f"case when regexp_matches(low, '(?:^|{_W}){w}(?:$|{_W})') then '{n}' end" for w, n in T.NUMBER_WORDS.items())
_numbers = lambda src, c: (
    rf"(select *, list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(low, '(?:^|{_W})(\d+(?:,,\d{{3}})*(?:\.\.\d+)?)(?:$|{_W})', 1), lambda t: replace(replace(t, ',,', ''), '..', '.')),"
    rf" list_filter([{_said}], lambda x: x is not null)))) as nums from"
    rf" (select *, regexp_replace(regexp_replace(lower(coalesce({c}, '')), '({_W})', '\1\1', 'g'), '(^|{_W})(?:(?:f|j|m|i|ds)--\d+|form\s+[a-z]+(?:--)?\d+)($|{_W})', '\1  \2', 'g') as low from {src}))"
)


@query(f"select comment_id, array_to_string(nums, ' ') as numbers from {_numbers('comments_no_pii', 'comment_clean')}")
def numeric_tokens(spark, d):
    return _t(spark, d, "comments_no_pii").select("comment_id", F.array_join(T.numeric_tokens(C("comment_clean")), " ").alias("numbers"))


_STRONG, _SUPPORT = ["duration of status", "fixed admission period"], ["visa", "extension", "scholars", "court", "bureau", "notice", "deadline"]


@query(
    f"""select article_id, array_to_string(list_concat(a, b), ',') as terms, len(a) > 0 or len(b) >= 3 as likely from (
select article_id, list_filter([{', '.join(f"case when contains(low, '{t}') then '{t}' end" for t in _STRONG)}], lambda x: x is not null) as a,
list_filter([{', '.join(f"case when regexp_matches(low, '(?:^|[^a-z0-9_]){t}(?:$|[^a-z0-9_])') then '{t}' end" for t in _SUPPORT)}], lambda x: x is not null) as b
from (select article_id, lower(coalesce(title, '') || ' ' || coalesce(article_text, '')) as low from gdelt_news_articles))"""
)
def keyword_relevance(spark, d):
    both = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("article_text", F.lit("")))
    hits = _t(spark, d, "gdelt_news_articles").select("article_id", T.keyword_hits(both, _STRONG, _SUPPORT).alias("h"))
    return hits.select("article_id", F.array_join("h.terms", ",").alias("terms"), C("h.likely").alias("likely"))


@query(
    rf"""select comment_id, case when t = '' then 'no_text' when len(list_filter(p, lambda s: not regexp_matches(s, '(?i)^(please\s+)?(see|refer\s+to)\s+(the\s+)?attach(ed|ment|ments)(\s+(file\(s\)|files?|letter|documents?|comments?|pdf))?[\s.!]*$'))) = 0
then 'placeholder' else 'keep' end as reason from (select comment_id, t, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') as p
from (select comment_id, {_strip("coalesce(comment_clean, '')")} as t from comments_no_pii))"""
)
def keep_or_skip(spark, d):
    text = T.strip(F.coalesce("comment_clean", F.lit("")))
    reason = F.when(text == "", "no_text").when(T.is_placeholder(C("comment_clean")), "placeholder").otherwise("keep")
    return _t(spark, d, "comments_no_pii").select("comment_id", reason.alias("reason"))


_PROPS = "k long"


@query("select event_id, event_type, (props->>'$.k')::bigint as k from events")
def json_cells(spark, d):
    return _t(spark, d, "events").select("event_id", "event_type", F.from_json("props", _PROPS)["k"].alias("k"))


@query("""select vec_id, '{"vec_id":' || vec_id || ',"label":' || coalesce(label::varchar, 'null') || ',"note":null}' as cell from embeddings""")
def compact_json(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", T.compact_json(F.struct("vec_id", "label", F.lit(None).cast("string").alias("note"))).alias("cell"))


_STEPS = [("2030-06-01", "early"), ("2031-01-01", "second_half"), ("2032-01-01", "next_year"), ("9999-12-31", "late")]
_steps_sql = "case " + " ".join(f"when seen < '{c}' then '{x}'" for c, x in _STEPS) + " end"


@query(
    f"""select milestone, count(*) as articles from (select {_steps_sql} as milestone from (select case when regexp_matches(seendate, '^\\d{{8}}')
then regexp_replace(substr(seendate, 1, 8), '^(\\d{{4}})(\\d{{2}})(\\d{{2}})$', '\\1-\\2-\\3') end as seen from gdelt_news_articles)) group by milestone"""
)
def milestones(spark, d):
    a = _t(spark, d, "gdelt_news_articles").select(ordered.step_label(T.compact_date(C("seendate")), _STEPS).alias("milestone"))
    return a.groupBy("milestone").agg(F.count("*").alias("articles"))


# -- copies -----------------------------------------------------------------------------------------------------------


@query("select doc_id, count(*) over (partition by text) > 1 as is_copy from documents")
def exact_dup_flag(spark, d):
    return dedup.copy_flag(_t(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "is_copy")


@query("select comment_id, min(collected_at) as collected_at, count(*) as times from comments_no_pii group by comment_id")
def keep_first(spark, d):
    rows = _t(spark, d, "comments_no_pii").select("comment_id", "collected_at")
    times = rows.groupBy("comment_id").agg(F.count("*").alias("times"))
    return dedup.keep_first(rows, ["comment_id"], C("collected_at")).join(times, "comment_id").select("comment_id", "collected_at", "times")


@query(
    f"""with a as (select distinct article_id, url, seendate, {_key('title')} as k from gdelt_news_articles)
select article_id, row_number() over (partition by k order by coalesce(seendate, ''), url, article_id) > 1 as is_later from a where k <> ''"""
)
def repost_flag(spark, d):
    a = _t(spark, d, "gdelt_news_articles").select("article_id", "url", F.coalesce("seendate", F.lit("")).alias("seendate"), T.squashed(C("title")).alias("k")).distinct().filter("k <> ''")
    return dedup.later_flag(a, C("k"), C("seendate"), C("url"), C("article_id")).select("article_id", "is_later")


@query("select domain, array_to_string(list_sort(list_distinct(list(found_by))), ',') as found_by from gdelt_news_articles where found_by is not null group by domain")
def found_by(spark, d):
    a = _t(spark, d, "gdelt_news_articles").filter("found_by is not null")
    return a.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_set("found_by")), ",").alias("found_by"))


@query(
    f"""with w as (select doc_id, {_words('text')} as w from documents), s as (select doc_id, list_distinct({_grams('w', 5)}) as s from w)
select doc_id, len(s) as shingles from s"""
)
def shingle_sets(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(T.shingles(C("text"))).cast("long").alias("shingles"))


_news = "with a as (select article_id, max(article_text) as t from gdelt_news_articles group by article_id)"
_sets = f""", w as (select article_id, {_words('t')} as w, array_to_string({_words('t')}, ' ') as body from a),
r as (select article_id, w, body, case when body <> '' then min(article_id) over (partition by body) else article_id end as rep from w),
s as (select distinct rep, list_distinct({_grams('w', 5)}) as s from r where article_id = rep and body <> '' and len(w) >= 5),
g as (select rep, len(s) as n, unnest(s) as g from s where len(s) >= 12),
pr as (select x.rep as a, y.rep as b, count(*) * 1.0 / (any_value(x.n) + any_value(y.n) - count(*)) as j from g x join g y on x.g = y.g and x.rep < y.rep group by 1, 2 having j >= 0.85)"""


def _near(spark, d):
    a = dedup.one_text(_t(spark, d, "gdelt_news_articles"), "article_id", "article_text")
    return dedup.similar_pairs(a, "article_id", "article_text")


@query(
    f"""{_news}{_sets}, l as (select rep, count(*) as n from (select a as rep from pr union all select b from pr) group by rep)
select r.article_id as id, r.rep as representative, coalesce(l.n, 0) as links from r left join l on r.rep = l.rep"""
)
def near_dup_links(spark, d):
    """One row per article: the representative of its class of equal texts, and the number of similar other classes."""
    pairs, members = _near(spark, d)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("r")).groupBy("r").agg(F.count("*").alias("links"))
    return members.join(ends, C("representative") == C("r"), "left").select("id", "representative", F.coalesce("links", F.lit(0)).alias("links"))


@query(f"{_news}{_sets} select a, b, round(j, 6) as similarity from pr")
def near_dup_pairs(spark, d):
    return _near(spark, d)[0]


def _roots(spark, d):
    pairs, members = _near(spark, d)
    titles = _t(spark, d, "gdelt_news_articles").select(C("article_id").alias("id"), T.squashed(C("title")).alias("k")).filter("k <> ''")
    heads = titles.groupBy("k").agg(F.min("id").alias("a"))
    by_title = titles.join(heads, "k").select("a", C("id").alias("b"))
    copies = members.select(C("representative").alias("a"), C("id").alias("b"))
    edges = pairs.select("a", "b").unionByName(by_title).unionByName(copies).filter("a <> b")
    return dedup.components(members.select("id"), edges)


_roots_sql = f"""with recursive a as (select article_id, max(article_text) as t from gdelt_news_articles group by article_id){_sets},
k as (select distinct article_id as id, {_key('title')} as k from gdelt_news_articles where {_key('title')} <> ''),
e as (select a, b from pr union select min(id) over (partition by k), id from k union select rep, article_id from r),
e2 as (select a, b from e where a <> b union select b, a from e where a <> b),
cc as (select article_id as id, article_id as root from a union select e2.b, cc.root from cc join e2 on cc.id = e2.a),
roots as (select id, min(root) as root from cc group by id)"""


@query(f"{_roots_sql} select id, root from roots")
def dup_clusters(spark, d):
    return _roots(spark, d)


@query(
    f"""{_roots_sql}, x as (select r.id, r.root, coalesce(length(a.t), 0) as n from roots r join a on a.article_id = r.id)
select root, arg_max(id, (n, -rn)) as canonical, count(*) as size from (select *, row_number() over (partition by root order by id) as rn from x) group by root"""
)
def canonical_docs(spark, d):
    """Per cluster: the longest member (ties by id) and the size."""
    lengths = _t(spark, d, "gdelt_news_articles").groupBy(C("article_id").alias("id")).agg(F.coalesce(F.length(F.max("article_text")), F.lit(0)).alias("n"))
    both = _roots(spark, d).join(lengths, "id")
    return both.groupBy("root").agg(F.min_by("id", F.struct(-C("n"), C("id"))).alias("canonical"), F.count("*").alias("size"))


# -- counts and terms -------------------------------------------------------------------------------------------------


@query(
    """select is_abusive as label, count(*) as n, round(count(*) * 1.0 / sum(count(*)) over (), 6) as share
from comment_labels group by is_abusive"""
)
def label_summary(spark, d):
    n = _t(spark, d, "comment_labels").groupBy(C("is_abusive").alias("label")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(C("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


@query(
    """with s as (select avg(value) as mean, median(value) as median, quantile_cont(value, 0.9) as p90, quantile_cont(value, 0.95) as p95, max(value) as top, avg((value >= 0.5)::int) as over from events)
select metric, round(value, 6) as value from (unpivot s on mean, median, p90, p95, top, over into name metric value value)"""
)
def score_summary(spark, d):
    v = C("value")
    s = _t(spark, d, "events").agg(
        F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.9).alias("p90"), F.percentile(v, 0.95).alias("p95"), F.max(v).alias("top"), F.avg((v >= 0.5).cast("int")).alias("over")
    )
    return s.unpivot([], ["mean", "median", "p90", "p95", "top", "over"], "metric", "value").select("metric", F.round("value", 6).alias("value"))


@query(
    r"""with w as (select comment_id, comment_clean, len(regexp_extract_all(coalesce(comment_clean, ''), '[\p{L}\p{N}_]+')) as w from comments_no_pii)
select count(*) as n, (select sum(c) from (select count(*) as c from w where comment_clean is not null group by comment_clean having count(*) > 1)) as copies,
round(median(w), 4) as median_words, round(avg(w), 4) as mean_words, round(quantile_cont(w, 0.9), 4) as p90_words from w"""
)
def corpus_summary(spark, d):
    c = _t(spark, d, "comments_no_pii").select("comment_clean", T.word_count(F.coalesce("comment_clean", F.lit(""))).alias("w"))
    copies = c.filter("comment_clean is not null").groupBy("comment_clean").agg(F.count("*").alias("c")).filter("c > 1").agg(F.sum("c").alias("copies"))
    s = c.agg(F.count("*").alias("n"), F.round(F.percentile("w", 0.5), 4).alias("median_words"), F.round(F.avg("w"), 4).alias("mean_words"), F.round(F.percentile("w", 0.9), 4).alias("p90_words"))
    return s.crossJoin(copies).select("n", "copies", "median_words", "mean_words", "p90_words")


@query("select lower(trim(channel)) as value, count(*) as n from comments_no_pii group by 1")
def value_counts(spark, d):
    return _t(spark, d, "comments_no_pii").groupBy(F.lower(F.trim("channel")).alias("value")).agg(F.count("*").alias("n"))


@query("select floor(n_chars / 250)::bigint as bin, count(*) as n from documents where n_chars is not null group by 1")
def length_histogram(spark, d):
    return _t(spark, d, "documents").filter("n_chars is not null").groupBy(F.floor(C("n_chars") / 250).alias("bin")).agg(F.count("*").alias("n"))


@query(
    f"""with t as (select {_topic('comment_clean')} as t from comments_no_pii),
g as (select 1 as n, unnest(t) as term from t union all select 2, unnest({_grams('t', 2)}) from t union all select 3, unnest({_grams('t', 3)}) from t),
c as (select n, term, count(*) as count from g group by n, term)
select * from (select *, row_number() over (partition by n order by count desc, term) as rank from c) where rank <= 100"""
)
def top_ngrams(spark, d):
    return lexical.top_ngrams(_t(spark, d, "comments_no_pii"), "comment_clean")


@query(
    f"""with c as (select id, x from (select comment_id as id, array_to_string({_topic('max(comment_clean)')}, ' ') as x from comments_no_pii group by comment_id) where x <> ''),
t as (select id, list_filter(regexp_extract_all(x, '[a-z0-9_]{{2,}}'), lambda t: not list_contains({_stop}, t)) as t from c),
g as (select id, unnest(list_concat(t, {_grams('t', 2)}, {_grams('t', 3)})) as term from t), tf as (select id, term, count(*) as tf from g group by id, term),
n as (select count(*) as n from c), df as (select term, count(*) as df, sum(tf) as total from tf group by term),
k as (select term, df from df, n where df >= case when n < 30 then 1 when n < 100 then 2 else 3 end and df <= 0.95 * n order by total desc, term limit 5000),
w as (select id, term, df, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) as w from tf join k using (term), n),
m as (select id, sqrt(sum(w * w)) as norm from w group by id)
select term, any_value(df) as df, round(sum(w / norm) / any_value(n), 8) as mean from w join m using (id), n group by term"""
)
def tfidf_terms(spark, d):
    c = _t(spark, d, "comments_no_pii").groupBy("comment_id").agg(F.max("comment_clean").alias("x"))
    return lexical.tfidf_terms(c, "comment_id", "x")


# -- search -----------------------------------------------------------------------------------------------------------

_bm25_sql = f"""with doc as (select article_id, max(coalesce(title, '') || ' ' || coalesce(article_text, '')) as x, max(domain) as domain from gdelt_news_articles group by article_id),
tok as (select article_id, unnest({_search('x')}) as token from doc), len_ as (select article_id, count(*) as l from tok group by article_id),
st as (select count(*) as n, (select sum(l) from len_) * 1.0 / count(*) as mean from doc),
p as (select article_id, token, count(*) as tf from tok group by 1, 2), df as (select token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as raw from p, st group by token, n),
idf as (select token, case when raw < 0 then 0.25 * (select avg(raw) from df) else raw end as idf from df),
q as (select docket_id, token, count(*) as times from (select docket_id, unnest({_search('docket_title')}) as token from dockets) group by 1, 2),
s as (select docket_id, article_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))), 4) as score
from q join p using (token) join idf using (token) join len_ using (article_id), st group by 1, 2),
every as (select dockets.docket_id, doc.article_id, doc.domain, coalesce(s.score, 0) as score from dockets cross join doc left join s on s.docket_id = dockets.docket_id and s.article_id = doc.article_id)"""


def _bm25(spark, d):
    a = _t(spark, d, "gdelt_news_articles").groupBy("article_id").agg(
        F.max(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("article_text", F.lit("")))).alias("x"), F.max("domain").alias("domain")
    )
    return a, search.bm25(a, "article_id", "x", _t(spark, d, "dockets"), "docket_id", "docket_title")


def _ranked(spark, d, k, allowed=None):
    a, scores = _bm25(spark, d)
    allowed = (a if allowed is None else a.filter(allowed)).select("article_id")
    return a, search.ranked(scores, _t(spark, d, "dockets"), "docket_id", allowed, "article_id", k)


@query(f"{_bm25_sql} select docket_id, article_id, score, rank from (select *, row_number() over (partition by docket_id order by score desc, article_id) as rank from every) where rank <= 5")
def bm25_topk(spark, d):
    """The five best articles of every docket title; where fewer share a token, others follow with score 0."""
    return _ranked(spark, d, 5)[1]


@query(
    f"""{_bm25_sql} select docket_id, article_id, score, rank from (select s.*, row_number() over (partition by docket_id order by score desc, article_id) as rank
from every s where domain like 'harrow%') where rank <= 5"""
)
def bm25_filtered(spark, d):
    """The filter follows the statistics of the whole corpus, so surviving rows keep their scores."""
    return _ranked(spark, d, 5, C("domain").startswith("harrow"))[1]


@query(
    f"""{_bm25_sql}, r as (select *, row_number() over (partition by docket_id order by score desc, article_id) as rank from every),
f as (select docket_id, min(case when contains(lower(x), lower(docket_id)) then rank end) as first from r join doc using (article_id) where rank <= 20 group by docket_id)
select count(*) as queries, round(avg(coalesce(first <= 1, false)::int), 4) as hit_1, round(avg(coalesce(first <= 3, false)::int), 4) as hit_3, round(avg(coalesce(first <= 5, false)::int), 4) as hit_5,
round(avg(coalesce(1.0 / first, 0)), 4) as mrr from f"""
)
def retrieval_eval(spark, d):
    """A page is relevant to a docket when it names the docket's number."""
    a, best = _ranked(spark, d, 20)
    return search.quality(best.join(a, "article_id"), F.contains(F.lower("x"), F.lower("docket_id")), "docket_id")


_dense = """with e as (select vec_id, label, embedding::double[] as v from embeddings), q as (select * from e where vec_id % 100 = 0),
s as (select q.vec_id as query_id, e.label, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) as score from q join e on q.vec_id <> e.vec_id)
select query_id, label, vec_id, score, rank from (select *, row_number() over (partition by query_id, label order by score desc, vec_id) as rank from s) where rank <= 3"""


@query(_dense)
def dense_topk(spark, d):
    """The three nearest vectors of each label for the stated query set, every id divisible by 100, against all rows."""
    e = _t(spark, d, "embeddings").select("vec_id", "label", "embedding")
    q = e.filter("vec_id % 100 = 0").select(C("vec_id").alias("query_id"), C("embedding").alias("v"))
    return search.nearest(e, "vec_id", "label", "embedding", q, 3)


# -- evidence ---------------------------------------------------------------------------------------------------------


@query(
    f"""with q as (select distinct domain, title from gdelt_news_articles where title is not null), a as (select domain, {_quote_key('article_text')} as t from gdelt_news_articles where article_text is not null)
select q.domain, q.title, count(a.t) as sources, count(a.t) > 0 as found from q left join a on q.domain = a.domain and {_quote_key('q.title')} <> '' and contains(a.t, {_quote_key('q.title')}) group by 1, 2"""
)
def quote_verify(spark, d):
    a = _t(spark, d, "gdelt_news_articles")
    q = a.filter("title is not null").select("domain", "title").distinct()
    return evidence.verify_quotes(q, a.filter("article_text is not null"), "domain", "title", "article_text").select("domain", "title", "sources", "found")


@query(
    """select distinct article_id, case when instr(article_text, title) > 0 then instr(article_text, title) - 1 end as start_char,
case when instr(article_text, title) > 0 then instr(article_text, title) - 1 + length(title) end as end_char from gdelt_news_articles where article_text is not null and title is not null"""
)
def quote_spans(spark, d):
    a = _t(spark, d, "gdelt_news_articles").filter("article_text is not null and title is not null").select("article_id", evidence.quote_span(C("article_text"), C("title")).alias("s"))
    return a.select("article_id", C("s.start").cast("long").alias("start_char"), C("s.end").cast("long").alias("end_char")).distinct()


@query(
    """with s as (select distinct video_id, segment_id, start_s, end_s from transcript_segments)
select a.segment_id as a, b.segment_id as b from s a join s b on a.video_id = b.video_id and a.segment_id < b.segment_id and a.start_s < b.end_s and a.end_s > b.start_s"""
)
def span_overlap(spark, d):
    """Overlapping segments of a video, whatever their length."""
    s = _t(spark, d, "transcript_segments").select("video_id", "segment_id", "start_s", "end_s").distinct()
    return evidence.overlapping(s, "video_id", "segment_id", "start_s", "end_s")


_guard_src = f"(select distinct article_id, title, article_text from gdelt_news_articles)"


@query(
    f"""with a as (select article_id, nums as n1, article_text from {_numbers(_guard_src, 'title')}), b as (select *, nums as n2 from {_numbers('(select article_id, n1, article_text from a)', 'article_text')})
select article_id, array_to_string(list_sort(list_filter(n1, lambda x: not list_contains(n2, x))), ' ') as unsupported,
case when article_text is null then 'not_verifiable' when len(list_filter(n1, lambda x: not list_contains(n2, x))) > 0 then 'partially_supported' else 'supported' end as verdict from b"""
)
def numeric_guard(spark, d):
    """A title's numbers against its page: without a page nothing can be verified, without support it is lowered."""
    a = _t(spark, d, "gdelt_news_articles").select("article_id", "title", "article_text").distinct()
    a = a.withColumn("u", evidence.unsupported_numbers(C("title"), C("article_text")))
    cited = F.when(C("article_text").isNotNull(), F.array("article_id")).otherwise(F.array().cast("array<string>"))
    a = a.withColumn("g", evidence.guard_verdict(F.lit("supported"), cited, C("u")))
    return a.select("article_id", F.array_join(F.array_sort("u"), " ").alias("unsupported"), C("g.verdict").alias("verdict"))


@query(
    """with c as (select comment_id, max(comment_clean) as x from comments_no_pii group by comment_id), m as (select comment_id, regexp_extract_all(x, '[A-Z]{4}-[0-9]{4}-[0-9]{4}') as ids from c where x is not null),
e as (select comment_id, unnest(ids) as id, unnest(range(1, len(ids) + 1)) as pos from m), f as (select comment_id, id, min(pos) as pos from e group by 1, 2)
select comment_id, coalesce(string_agg(case when d.docket_id is not null then f.id end, ',' order by pos), '') as cited, count(*) - count(d.docket_id) as dropped
from f left join dockets d on f.id = d.docket_id group by comment_id"""
)
def citation_guard(spark, d):
    """Docket numbers that a comment names: the known ones in order of mention, and how many unknown ones were dropped."""
    c = _t(spark, d, "comments_no_pii").groupBy("comment_id").agg(F.max("comment_clean").alias("x"))
    ids = F.array_distinct(F.regexp_extract_all("x", F.lit("[A-Z]{4}-[0-9]{4}-[0-9]{4}"), F.lit(0)))
    e = c.select("comment_id", F.posexplode(ids).alias("pos", "id"))
    known = _t(spark, d, "dockets").select(C("docket_id").alias("k"))
    e = e.join(known, C("id") == C("k"), "left")
    ordered_ids = F.transform(F.array_sort(F.collect_list(F.when(C("k").isNotNull(), F.struct("pos", "id")))), lambda x: x["id"])
    return e.groupBy("comment_id").agg(F.array_join(ordered_ids, ",").alias("cited"), (F.count("*") - F.count("k")).alias("dropped"))


# -- claims -----------------------------------------------------------------------------------------------------------

_verdict = "case l_returnflag when 'N' then 1.0 when 'A' then 0.5 when 'R' then 0.0 end"


@query(
    f"""with a as (select distinct article_id, title, article_text from gdelt_news_articles where title is not null and article_text is not null),
l as (select article_id, title, unnest(string_split(article_text, chr(10))) as line, unnest(range(1, len(string_split(article_text, chr(10))) + 1)) as no from a),
w as (select *, list_distinct({_words('title')}) as x, list_distinct({_words('line')}) as y from l), s as (select *, len(list_intersect(x, y)) as n from w)
select weight, count(*) as lines from (select case when n >= 2 and n * 1.0 / greatest(1, least(len(x), len(y))) >= 0.6 then 3 when no <= 3 then 2 else 1 end as weight from s) group by weight"""
)
def claim_weight(spark, d):
    a = _t(spark, d, "gdelt_news_articles").filter("title is not null and article_text is not null").select("article_id", "title", "article_text").distinct()
    lines = a.select("title", F.posexplode(F.split("article_text", "\n")).alias("no", "line"))
    return lines.groupBy(claims.title_weight(C("title"), C("line"), C("no") < 3).cast("int").alias("weight")).agg(F.count("*").alias("lines"))


@query(
    f"""with x as (select l_orderkey, case when l_linenumber <= 2 then 3 when l_linenumber <= 4 then 2 else 1 end as w, {_verdict} as p, l_linestatus = 'O' as c from lineitem),
s as (select l_orderkey, count(*) filter (where c) as checkable, count(*) filter (where c and p is not null) as checked, round(100.0 * sum(w * p) filter (where c) / nullif(sum(w) filter (where c and p is not null), 0), 1) as score from x group by 1)
select l_orderkey, checkable, checked, score, case when checkable > 0 then round(100.0 * checked / checkable, 1) end as coverage,
case when checkable > 0 and round(100.0 * checked / checkable, 1) >= 80 and checked >= 3 then 'High' when checkable > 0 and round(100.0 * checked / checkable, 1) >= 50 and checked > 0 then 'Medium' else 'Low' end as confidence from s"""
)
def grounding_score(spark, d):
    """The weighted score on bulk rows: an order's lines stand for its claims."""
    x = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    w = F.when(C("l_linenumber") <= 2, 3).when(C("l_linenumber") <= 4, 2).otherwise(1)
    p = F.when(C("l_returnflag") == "N", 1.0).when(C("l_returnflag") == "A", 0.5).when(C("l_returnflag") == "R", 0.0)
    return claims.weighted_score(x, ["l_orderkey"], w, p, C("l_linestatus") == "O")


@query(
    """with v as (select comment_id, is_abusive, count(*) as n from comment_labels where is_abusive is not null group by 1, 2)
select comment_id, arg_max(is_abusive, (n, is_abusive)) as verdict, max(n) || '/' || sum(n) as agreement from v group by comment_id"""
)
def majority_vote(spark, d):
    return claims.majority(_t(spark, d, "comment_labels"), ["comment_id"], "is_abusive", [1, 0])


_risk = "case l_returnflag when 'R' then 0 when 'A' then 1 else 4 end"


@query(
    f"""with x as (select l_orderkey, l_partkey, l_linenumber, l_quantity, {_risk} as risk from lineitem),
f as (select *, row_number() over (partition by l_orderkey, l_partkey order by risk, -l_quantity, l_linenumber, l_partkey) as a from x),
g as (select *, row_number() over (partition by l_orderkey order by risk, -l_quantity, l_linenumber, l_partkey) as rank from f where a = 1)
select l_orderkey, l_partkey, l_linenumber, l_quantity, risk, rank from g where rank <= 3"""
)
def featured_topk(spark, d):
    x = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", F.when(C("l_returnflag") == "R", 0).when(C("l_returnflag") == "A", 1).otherwise(4).alias("risk"))
    return claims.featured(x, ["l_orderkey"], "l_partkey", [C("risk"), -C("l_quantity"), C("l_linenumber"), C("l_partkey")], 3)


_RULES = [("(?i)\\b(court|judge|ruling|lawyers)\\b", "court"), ("(?i)\\b(docket|filed under)\\b", "docket"), ("(?i)\\b(bureau|office|department|desk)\\b", "agency")]


@query(
    f"""select route, count(*) as n from (select case {' '.join(f"when regexp_matches(x, '{p}') then '{r}'" for p, r in _RULES)} else 'other' end as route
from (select article_id, max(coalesce(title, '') || ' ' || coalesce(article_text, '')) as x from gdelt_news_articles group by article_id)) group by route"""
)
def route_rows(spark, d):
    a = _t(spark, d, "gdelt_news_articles").groupBy("article_id").agg(F.max(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("article_text", F.lit("")))).alias("x"))
    return a.groupBy(claims.route(C("x"), _RULES, "other").alias("route")).agg(F.count("*").alias("n"))


@query(
    """with p as (select user_id, ts as at_ts, max(event_id) as event_id from events where event_type = 'purchase' group by 1, 2)
select e.event_id, p.event_id as last_purchase_id from events e asof left join p on e.user_id = p.user_id and e.ts >= p.at_ts where e.event_type <> 'purchase'"""
)
def asof_join(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    bought = e.filter("event_type = 'purchase'").select("user_id", C("ts").alias("at"), C("event_id").alias("purchase_id"))
    return ordered.last_before(e.filter("event_type <> 'purchase'"), bought, "user_id", "ts", "at", "purchase_id").select("event_id", "last_purchase_id")


@query(
    """select d.docket_id, count(*) filter (where d.opens_at is null or d.opens_at <= c.collected_at) as open_then, count(*) filter (where d.closes_at < c.collected_at) as late
from (select distinct comment_id, docket_id, collected_at from comments_no_pii) c join dockets d using (docket_id) group by d.docket_id"""
)
def asof_timeline(spark, d):
    c = _t(spark, d, "comments_no_pii").select("comment_id", "docket_id", "collected_at").distinct()
    j = c.join(_t(spark, d, "dockets"), "docket_id")
    return j.groupBy("docket_id").agg(F.count_if(search.as_of(C("opens_at"), C("collected_at"))).alias("open_then"), F.count_if(C("closes_at") < C("collected_at")).alias("late"))


# -- order and structure ----------------------------------------------------------------------------------------------

_lines = """l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as no from documents where text is not null)"""


def _doc_lines(spark, d):
    docs = _t(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (C("p") + 1).alias("no"), "line")


@query(
    rf"""with {_lines}, h as (select *, case when regexp_matches(line, '^\d+(\.\d+)* \S') then line end as h from l)
select doc_id, no::bigint as no, last_value(h ignore nulls) over (partition by doc_id order by no) as heading from h"""
)
def forward_fill(spark, d):
    x = _doc_lines(spark, d)
    h = F.when(C("line").rlike(r"^\d+(\.\d+)* \S"), C("line"))
    return ordered.forward_fill(x, ["doc_id"], [C("no")], h, "heading").select("doc_id", C("no").cast("long").alias("no"), "heading")


@query(
    rf"""with {_lines} select doc_id, block, count(*) as lines from (select doc_id, sum((regexp_matches(line, ':\s*$'))::bigint) over (partition by doc_id order by no)::bigint as block from l) group by 1, 2"""
)
def comment_blocks(spark, d):
    """Sessions by marker, not by time: a line that ends with a colon opens a block."""
    x = ordered.blocks(_doc_lines(spark, d), ["doc_id"], [C("no")], C("line").rlike(r":\s*$"), "block")
    return x.groupBy("doc_id", "block").agg(F.count("*").alias("lines"))


@query("select user_id, batch, count(*) as n from (select user_id, floor((row_number() over (partition by user_id order by ts, event_id) - 1) / 8)::bigint as batch from events) group by 1, 2")
def fixed_batches(spark, d):
    return ordered.batches(_t(spark, d, "events"), ["user_id"], [C("ts"), C("event_id")], 8).groupBy("user_id", "batch").agg(F.count("*").alias("n"))


@query("select s_suppkey, s_nationkey || case when n = 1 then '' else '-' || n end as unique_name from (select *, row_number() over (partition by s_nationkey order by s_suppkey) as n from supplier)")
def unique_names(spark, d):
    s = _t(spark, d, "supplier").select("s_suppkey", C("s_nationkey").cast("string").alias("name"))
    return ordered.unique_names(s, "name", [C("s_suppkey")]).select("s_suppkey", "unique_name")


_nodes_sql = """nodes as (select 'r' || r_regionkey as id, null as parent, r_name as name from region union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name from nation
union all select 'c' || c_custkey, 'n' || c_nationkey, c_name from customer)"""


@query(
    f"""with recursive {_nodes_sql}, t as (select id, 0 as level, name as path from nodes where parent is null union all select n.id, t.level + 1, t.path || '>' || n.name from nodes n join t on n.parent = t.id)
select id, level, path from t"""
)
def section_paths(spark, d):
    r = _t(spark, d, "region").select(F.concat(F.lit("r"), C("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), C("r_name").alias("name"))
    n = _t(spark, d, "nation").select(F.concat(F.lit("n"), C("n_nationkey").cast("string")), F.concat(F.lit("r"), C("n_regionkey").cast("string")), "n_name")
    c = _t(spark, d, "customer").select(F.concat(F.lit("c"), C("c_custkey").cast("string")), F.concat(F.lit("n"), C("c_nationkey").cast("string")), "c_name")
    return ordered.paths(r.union(n).union(c), "id", "parent", "name").select("id", "level", F.array_join("path", ">").alias("path"))


@query(
    r"""select video_id, min(start_s) as first_s, max(start_s) as last_s, sum(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')))::bigint as words, count(*) as segments
from (select distinct video_id, segment_id, start_s, text from transcript_segments) group by video_id"""
)
def page_spans(spark, d):
    s = _t(spark, d, "transcript_segments").select("video_id", "segment_id", "start_s", "text").distinct()
    return s.groupBy("video_id").agg(F.min("start_s").alias("first_s"), F.max("start_s").alias("last_s"), F.sum(T.word_count(F.coalesce("text", F.lit("")))).alias("words"), F.count("*").alias("segments"))


@query(
    """with c as (select comment_id, max(comment_clean) as x from comments_no_pii group by comment_id), m as (select distinct comment_id, unnest(regexp_extract_all(x, '[A-Z]{4}-[0-9]{4}-[0-9]{4}')) as id from c where x is not null)
select d.docket_id, count(m.comment_id) as referenced_in, min(m.comment_id) as first_reference from dockets d left join m on m.id = d.docket_id group by d.docket_id"""
)
def footnote_links(spark, d):
    c = _t(spark, d, "comments_no_pii").groupBy("comment_id").agg(F.max("comment_clean").alias("x"))
    m = c.select("comment_id", F.explode(F.array_distinct(F.regexp_extract_all("x", F.lit("[A-Z]{4}-[0-9]{4}-[0-9]{4}"), F.lit(0)))).alias("id"))
    n = m.groupBy("id").agg(F.count("*").alias("n"), F.min("comment_id").alias("first_reference"))
    dk = _t(spark, d, "dockets").select("docket_id")
    return dk.join(n, C("docket_id") == C("id"), "left").select("docket_id", F.coalesce("n", F.lit(0)).alias("referenced_in"), "first_reference")


@query()
def section_tree(spark, d):
    return sections.parse(_t(spark, d, "documents"))


@query(
    """with p as (select segment_id, unnest(string_split(text, ' ')) as w, unnest(range(1, len(string_split(text, ' ')) + 1)) as page from (select segment_id, max(text) as text from transcript_segments where text is not null group by segment_id)),
j as (select segment_id, string_agg('--- PAGE ' || page || ' ---' || chr(10) || w, chr(10) order by page) as t from p group by segment_id)
select segment_id, count(*) as pages, sum(length(w))::bigint as chars from p group by segment_id"""
)
def marked_pages(spark, d):
    """Texts with page markers and back: a word stands for a page."""
    s = _t(spark, d, "transcript_segments").filter("text is not null").groupBy("segment_id").agg(F.max("text").alias("text"))
    marked = F.array_join(F.transform(F.split("text", " "), lambda w, i: F.concat(F.lit("--- PAGE "), (i + 1).cast("string"), F.lit(" ---\n"), w)), "\n")
    p = s.select("segment_id", F.explode(T.pages_of(marked)).alias("p"))
    return p.groupBy("segment_id").agg(F.count("*").alias("pages"), F.sum(F.length("p.text")).alias("chars"))


# -- quality ----------------------------------------------------------------------------------------------------------


@query(
    """with e as (select distinct source from mix_targets), u as (select distinct source from documents where source is not null)
select coalesce(e.source, u.source) as source, case when u.source is null then 'missing' when e.source is null then 'invalid' else 'used' end as state from e full outer join u on e.source = u.source"""
)
def coverage_check(spark, d):
    return quality.coverage(_t(spark, d, "mix_targets"), _t(spark, d, "documents").filter("source is not null"), "source")


@query("select 'lineitem_order' as rule, count(*) as violations from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'order_customer', count(*) from orders where o_custkey not in (select c_custkey from customer) union all select 'label_comment', count(*) from comment_labels where comment_id not in (select comment_id from comments_no_pii)")
def fk_violations(spark, d):
    li, o, cu = _t(spark, d, "lineitem"), _t(spark, d, "orders"), _t(spark, d, "customer")
    la, co = _t(spark, d, "comment_labels"), _t(spark, d, "comments_no_pii").select("comment_id")
    rules = [
        ("lineitem_order", quality.orphans(li, o, li["l_orderkey"] == o["o_orderkey"], "l_orderkey")),
        ("order_customer", quality.orphans(o, cu, o["o_custkey"] == cu["c_custkey"], "o_orderkey")),
        ("label_comment", quality.orphans(la, co, la["comment_id"] == co["comment_id"], "comment_id")),
    ]
    out = None
    for name, bad in rules:
        n = bad.agg(F.lit(name).alias("rule"), F.count("*").alias("violations"))
        out = n if out is None else out.unionAll(n)
    return out


@query("select comment_id, count(*) as rows from comments_no_pii group by comment_id having count(*) > 1")
def key_violations(spark, d):
    return quality.repeated_keys(_t(spark, d, "comments_no_pii"), "comment_id")


_fld = ["posted_date", "channel", "country", "title"]
_old = "old as (select comment_id, " + ", ".join(f"arg_min({c}, (collected_at, coalesce(posted_date,''), coalesce(channel,''))) as {c}" for c in _fld) + " from comments_no_pii group by comment_id)"


@query(
    """with a as (select c_custkey, c_name, c_mktsegment, c_nationkey::varchar as c_nationkey from customer), b as (select c_custkey, c_name, case when c_custkey % 7 = 0 then lower(c_mktsegment) else c_mktsegment end as c_mktsegment,
case when c_custkey % 11 = 0 then null else c_nationkey::varchar end as c_nationkey from customer where c_custkey % 13 <> 0)
select a.c_custkey, 'c_mktsegment' as field, a.c_mktsegment as "left", b.c_mktsegment as "right" from a join b using (c_custkey) where a.c_mktsegment is distinct from b.c_mktsegment
union all select a.c_custkey, 'c_nationkey', a.c_nationkey, b.c_nationkey from a join b using (c_custkey) where a.c_nationkey is distinct from b.c_nationkey
union all select c_custkey, 'c_custkey', c_custkey::varchar, null from a where c_custkey not in (select c_custkey from b)"""
)
def row_diff(spark, d):
    a = _t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    b = a.filter("c_custkey % 13 <> 0").withColumn("c_mktsegment", F.when(C("c_custkey") % 7 == 0, F.lower("c_mktsegment")).otherwise(C("c_mktsegment"))).withColumn("c_nationkey", F.when(C("c_custkey") % 11 != 0, C("c_nationkey")))
    return quality.row_differences(a, b, "c_custkey")


@query(
    """with a as (select o_orderpriority, o_orderstatus from orders), b as (select o_orderpriority, o_orderstatus from orders where o_orderstatus <> 'P')
select (select count(*) from (select * from a except all select * from b)) as only_left, (select count(*) from (select * from b except all select * from a)) as only_right"""
)
def multiset_equality(spark, d):
    a = _t(spark, d, "orders").select("o_orderpriority", "o_orderstatus")
    return quality.same_rows(a, a.filter("o_orderstatus <> 'P'"))


@query(
    """select reason, count(*) as n from (select case when title is null then 'no title' when posted_date is null then 'no date' when comment_clean is null then 'no text' when not regexp_matches(comment_id, '^[A-Z]{4}-[0-9]{4}-[0-9]{4}-[0-9]+$') then 'bad id' end as reason from comments_no_pii) group by reason"""
)
def validate_rows(spark, d):
    reason = quality.first_reason(
        (C("title").isNull(), "no title"), (C("posted_date").isNull(), "no date"), (C("comment_clean").isNull(), "no text"), (~C("comment_id").rlike("^[A-Z]{4}-[0-9]{4}-[0-9]{4}-[0-9]+$"), "bad id")
    )
    return _t(spark, d, "comments_no_pii").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


# -- nested rows ------------------------------------------------------------------------------------------------------


def _nested(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey")
    li = export.nest(_t(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber"], ["l_linenumber", "l_partkey"], "items")
    o = o.join(li, C("o_orderkey") == C("l_orderkey"), "left").select("o_custkey", "o_orderkey", F.coalesce("items", F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint>>")).alias("items"))
    orders = export.nest(o, ["o_custkey"], ["o_orderkey"], ["o_orderkey", "items"], "orders")
    return _t(spark, d, "customer").select("c_custkey").join(orders, C("c_custkey") == C("o_custkey"), "left").select("c_custkey", "orders")


@query(
    """with o as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as a from orders),
l as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber) as b from lineitem)
select c_custkey, case when b is not null then 'items' when a is not null then 'orders' else 'row' end as record_type, a as outer_no, b as inner_no, concat_ws(':', c_custkey, a, b) as flat_row_id
from customer left join o on c_custkey = o_custkey left join l on o_orderkey = l_orderkey"""
)
def flatten_long(spark, d):
    f = export.flatten(_nested(spark, d), ["c_custkey"], "orders", "items")
    return f.select("c_custkey", "record_type", C("outer_no").cast("long").alias("outer_no"), C("inner_no").cast("long").alias("inner_no"), "flat_row_id")


@query("select c_custkey, count(distinct o_orderkey) as orders, count(l_orderkey) as items from customer left join orders on c_custkey = o_custkey left join lineitem on o_orderkey = l_orderkey group by c_custkey")
def nested_roundtrip(spark, d):
    n = _nested(spark, d)
    items = F.aggregate(F.coalesce("orders", F.array().cast(n.schema["orders"].dataType)), F.lit(0), lambda s, o: s + F.size(o["items"]))
    return n.select("c_custkey", F.greatest(F.size("orders"), F.lit(0)).cast("long").alias("orders"), items.cast("long").alias("items"))


@query(
    """select l_orderkey, max(case when n = 1 then l_partkey end) as part_1, max(case when n = 2 then l_partkey end) as part_2 from (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as n from lineitem) group by l_orderkey"""
)
def wide_evidence(spark, d):
    n = export.nest(_t(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], ["l_partkey"], "parts")
    return n.select("l_orderkey", *export.widen(F.transform("parts", lambda p: p["l_partkey"]), 2, "part"))


@query("select user_id, count(*) filter (where event_type = 'click') * 1.0 as score_click, count(*) filter (where event_type = 'purchase') * 1.0 as score_purchase, count(*) filter (where event_type = 'view') * 1.0 as score_view from events group by user_id")
def label_columns(spark, d):
    n = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", *export.label_columns(C("m"), ["click", "purchase", "view"], "score"))


@query("select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as f, count(*) filter (where o_orderstatus = 'O') as o, count(*) filter (where o_orderstatus = 'P') as p, count(distinct o_custkey) as customers from orders group by o_orderpriority")
def tier_pivot(spark, d):
    o = _t(spark, d, "orders")
    p = o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return p.select("o_orderpriority", C("F").alias("f"), C("O").alias("o"), C("P").alias("p")).join(o.groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers")), "o_orderpriority")


# -- ingestion --------------------------------------------------------------------------------------------------------


@query("select comment_id, docket_id from (select distinct comment_id, docket_id from comments_no_pii) where comment_id not in (select comment_id from comment_labels)")
def resume_antijoin(spark, d):
    from quarrylight.sources.sinks import new_rows

    return new_rows(_t(spark, d, "comments_no_pii").select("comment_id", "docket_id"), _t(spark, d, "comment_labels"), "comment_id")


@query("select c_custkey, c_name from customer where c_custkey % 10 <> 0 union all select c_custkey, upper(c_name) from customer where c_custkey % 10 = 0")
def upsert_index(spark, d):
    from quarrylight.sources.sinks import upsert

    c = _t(spark, d, "customer").select("c_custkey", "c_name")
    return upsert(c, c.filter("c_custkey % 10 = 0").withColumn("c_name", F.upper("c_name")), "c_custkey")


@query("select o_custkey, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) as latest from orders group by o_custkey")
def latest_per_group(spark, d):
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", -C("o_orderkey"))).alias("latest"))


@query("select comment_id, arg_max(docket_id, collected_at) as docket_id, max(collected_at) as written from comments_no_pii group by comment_id")
def last_writes(spark, d):
    from quarrylight.sources.files import last_writes as last

    return last(_t(spark, d, "comments_no_pii").select("comment_id", "docket_id", C("collected_at").alias("written")), "comment_id", "written")


@query(
    """with e as (select floor(epoch(ts))::bigint as s from events where ts is not null), o as (select min(s) as a, max(s) as b from e), l as (select generate_series as level from o, generate_series(0, 40) where (b - a) // 21600 >= (1::bigint << greatest(level - 1, 0)) or level = 0),
h as (select level, ((s - a) // 21600) >> level as cell, count(*) as n from e, o, l group by 1, 2), top as (select max(level) as m from l)
select a + cell * (21600::bigint << level) as low, a + (cell + 1) * (21600::bigint << level) as high, n from h, o, top
where (n <= 250 or level = 0) and (level = m or exists (select 1 from h p where p.level = h.level + 1 and p.cell = h.cell >> 1 and p.n > 250))"""
)
def range_split(spark, d):
    return ordered.split_ranges(_t(spark, d, "events"), "ts", 250, 6 * 3600)


@query(
    r"""select article_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(coalesce(related_links, ''), 'https?://[^\s,;|]+'), lambda u: contains(lower(u), 'docket')))), ',') as links
from (select distinct article_id, related_links from gdelt_news_articles)"""
)
def page_links(spark, d):
    a = _t(spark, d, "gdelt_news_articles").select("article_id", "related_links").distinct()
    urls = F.regexp_extract_all(F.coalesce("related_links", F.lit("")), F.lit(r"https?://[^\s,;|]+"), F.lit(0))
    return a.select("article_id", F.array_join(F.array_sort(F.array_distinct(F.filter(urls, lambda u: F.contains(F.lower(u), F.lit("docket"))))), ",").alias("links"))


# -- samples and models -----------------------------------------------------------------------------------------------


@query(
    """with l as (select count(distinct source) as n from documents where source is not null), h as (select doc_id, source, md5('42:' || doc_id) as h from documents where source is not null),
r as (select *, row_number() over (partition by source order by h, doc_id) as r from h), t as (select r.*, (r > 200 // n)::int as top from r, l)
select doc_id, source from (select *, row_number() over (order by top, h, doc_id) as k from t) where k <= 200"""
)
def stratified_sample(spark, d):
    return sampling.stratified(_t(spark, d, "documents").filter("source is not null").select("doc_id", "source"), "doc_id", "source", 200)


@query()
def farthest_sample(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    lim = o.agg(F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("b"), F.min("o_orderdate").alias("c"), F.max("o_orderdate").alias("e"))
    s = lambda c: F.unix_timestamp(c)
    p = o.crossJoin(F.broadcast(lim)).select("o_orderkey", ((s("o_orderdate") - s("c")) / F.greatest(F.lit(1), s("e") - s("c"))).alias("x"), ((C("o_totalprice") - C("a")) / F.greatest(F.lit(1.0), C("b") - C("a"))).alias("y"))
    return sampling.farthest(p, "o_orderkey", "x", "y", 20)


@query(
    """with r as (select s_suppkey, row_number() over (order by s_acctbal, s_suppkey) - 1 as r, s_acctbal, count(*) over () as n, min(s_acctbal) over () as lo, max(s_acctbal) over () as hi from supplier)
select s_suppkey, round(r * 1.0 / greatest(1, n - 1), 6) as x, round((s_acctbal - lo) / greatest(1.0, hi - lo), 6) as y from r"""
)
def rank_positions(spark, d):
    r = sampling.rank_positions(_t(spark, d, "supplier").select("s_suppkey", "s_acctbal"), [C("s_acctbal"), C("s_suppkey")], "s_acctbal")
    return r.select("s_suppkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _themes(spark, d):
    c = _t(spark, d, "comments_no_pii").groupBy("comment_id").agg(F.max("comment_clean").alias("x"))
    return factors.themes(c, "comment_id", "x")


@query()
def themes(spark, d):
    """Dominant theme and strength of every comment with a topic token, and the size of the theme, by a
    non-negative factorisation."""
    rows = _themes(spark, d)[0]
    return rows.join(F.broadcast(rows.groupBy("theme").agg(F.count("*").alias("size"))), "theme").select("comment_id", "theme", "strength", "size")


@query()
def theme_terms(spark, d):
    """The 150 heaviest terms of every theme with their weights above zero, the first twelve of which describe it."""
    return _themes(spark, d)[1].filter("rank <= 150")


_hits = lambda *w: f"1 + len(list_filter(w, lambda x: list_contains({list(w)}, x)))"


@query(
    f"""with t as (select comment_id, regexp_split_to_array({_strip("lower(coalesce(comment_clean, ''))")}, '{_BL}+') as w from comments_no_pii),
n as (select comment_id, {_hits('support', 'sensible', 'modest', 'well-meant')} as s, {_hits('oppose', 'withdraw', 'costly', 'harsh', 'unworkable')} as o, {_hits('the')} as u from t)
select comment_id, case when u >= s and u >= o then 'neutral' when o >= s then 'oppose' else 'support' end as label, round((s - o) * 1.0 / (s + o + u), 6) as signed from n"""
)
def model_stage(spark, d):
    """The scorer boundary with a deterministic stand-in."""
    words = {"support": ["support", "sensible", "modest", "well-meant"], "oppose": ["oppose", "withdraw", "costly", "harsh", "unworkable"], "neutral": ["the"]}
    c = _t(spark, d, "comments_no_pii").select("comment_id", "comment_clean")
    s = models.classify(c, "comment_clean", models.keyword_scorer(words))
    return s.select("comment_id", export.top_label(C("scores")).alias("label"), F.round(C("scores")["support"] - C("scores")["oppose"], 6).alias("signed"))


@query(
    f"""select distinct sha256(article_text) as request_key, 'ok' as status, length(article_text)::bigint as length, regexp_extract({_strip('article_text')}, '^[^\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{3000}}]*') as first
from gdelt_news_articles where article_text is not null"""
)
def model_requests(spark, d):
    """Requests of the model boundary: each distinct text is asked once, and its answer read as JSON."""
    a = _t(spark, d, "gdelt_news_articles").filter("article_text is not null").select("article_id", "article_text")
    got = models.ask(a.select(models.request_key(C("article_text")).alias("request_key"), "article_text"), "request_key", "article_text", models.echo_client)
    return got.select("request_key", "status", F.from_json("answer", "length long, first string").alias("a")).select("request_key", "status", "a.length", "a.first")


# -- panels -----------------------------------------------------------------------------------------------------------


@query(briefing.COMMENTS_SQL)
def briefing_comments(spark, d):
    return briefing.comments(_t(spark, d, "comments_no_pii"), _t(spark, d, "dockets"))


@query(briefing.NEWS_SQL)
def briefing_news(spark, d):
    return briefing.news(_t(spark, d, "gdelt_news_articles"))


@query(briefing.VIDEO_SQL)
def briefing_video(spark, d):
    return briefing.video(_t(spark, d, "videos"))


@query(briefing.POLICY_SQL)
def briefing_policy(spark, d):
    return briefing.policy(_t(spark, d, "orders"))


@query(briefing.TIMELINE_SQL)
def status_timeline(spark, d):
    return briefing.timeline(_t(spark, d, "dockets"))


@query(briefing.FOLLOWUPS_SQL)
def followups(spark, d):
    return briefing.followups(_t(spark, d, "comments_no_pii"), _t(spark, d, "gdelt_news_articles"), _t(spark, d, "videos"))


# Queries of further operators register themselves.
from quarrylight import more_queries  # noqa: E402, F401
