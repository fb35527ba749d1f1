"""Further queries of the core: fields, filters, joins, nested rows, sorts and the flow of checked claims."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylight.functions import fields
from quarrylight.functions import text as T
from quarrylight.operators import export, ordered, quality, sampling, search, verify
from quarrylight.plans import briefing
from quarrylight.queries import _BL, C, _numbers, _search, _squeeze, _strip, _t, _words, query
from quarrylight.sources import files, sinks

_seen_on = lambda c: rf"case when regexp_matches({c}, '^\d{{8}}') then regexp_replace(substr({c}, 1, 8), '^(\d{{4}})(\d{{2}})(\d{{2}})$', '\1-\2-\3') end"
_filled = lambda c: f"nullif({_strip(c)}, '')"

# -- fields -----------------------------------------------------------------------------------------------------------


@query(f"select doc_id, {_squeeze('text')} as as_source, lower({_squeeze('''coalesce(text, '')''')}) as as_rule from documents")
def normal_forms(spark, d):
    return _t(spark, d, "documents").select("doc_id", fields.source_text(C("text")).alias("as_source"), fields.rule_key(C("text")).alias("as_rule"))


@query(
    f"""select distinct video_id, coalesce({_filled('published_date')}, strftime(transcribed_at, '%Y-%m-%d')) as value,
case when {_filled('published_date')} is not null then 'published' when transcribed_at is not null then 'transcribed' end as origin from videos"""
)
def date_origin(spark, d):
    """The first date that a record has, and where it comes from."""
    pick = fields.first_filled(("published", C("published_date")), ("transcribed", F.date_format("transcribed_at", "yyyy-MM-dd")))
    return _t(spark, d, "videos").select("video_id", pick.alias("p")).select("video_id", "p.value", "p.origin").distinct()


@query(
    """with s as (select doc_id, n_chars // 40 as a, case when doc_id % 3 = 0 then null else n_chars // 30 end as b, doc_id % 90 as v from documents)
select doc_id, case when a is null then null when b is null or a = b then concat_ws(' ', v, 'FR', a) else concat_ws(' ', v, 'FR', a) || '–' || b end as citation from s"""
)
def page_citations(spark, d):
    """Citations of pages from volume, first and last page; lengths stand for pages."""
    end = F.when(C("doc_id") % 3 != 0, F.floor(C("n_chars") / 30))
    return _t(spark, d, "documents").select("doc_id", fields.page_citation(C("doc_id") % 90, F.floor(C("n_chars") / 40), end).alias("citation"))


@query("""select distinct article_id, coalesce(nullif(title, ''), nullif(domain, ''), '') || ': ' || coalesce(article_text, '') as search_text from gdelt_news_articles""")
def context_text(spark, d):
    return _t(spark, d, "gdelt_news_articles").select("article_id", fields.search_text(C("article_text"), C("title"), C("domain")).alias("search_text")).distinct()


_PLATFORM = {"streambox": "video", "clipfeed": "short"}


@query(
    """select distinct video_id, case lower(trim(platform)) when 'streambox' then 'video' when 'clipfeed' then 'short' else 'other' end as kind,
case when contains(url, 'watch/') then url || '&t=' || floor(duration_sec / 2)::bigint || 's' end as link from videos"""
)
def deep_links(spark, d):
    """Codes of a closed list, and links into the middle of a record."""
    link = F.when(C("url").contains("watch/"), F.concat("url", F.lit("&t="), F.floor(C("duration_sec") / 2).cast("string"), F.lit("s")))
    return _t(spark, d, "videos").select("video_id", fields.mapped(F.lower(F.trim("platform")), _PLATFORM, "other").alias("kind"), link.alias("link")).distinct()


@query(
    """with p as (select video_id, string_agg(concat_ws(' | ', speaker_no, speaker_name, speaker_role, video_id || ' | x'), ' || ' order by speaker_no) as packed from video_speakers group by video_id)
select video_id, speaker_no::varchar as no, trim(speaker_name) as name, trim(speaker_role) as role, video_id || ' | x' as rest from video_speakers"""
)
def packed_strings(spark, d):
    """Rows packed to one string per key, in order, and parsed back."""
    s = _t(spark, d, "video_speakers")
    one = F.concat_ws(" | ", C("speaker_no").cast("string"), "speaker_name", "speaker_role", F.concat("video_id", F.lit(" | x")))
    packed = s.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("speaker_no", one.alias("t")))), lambda x: x["t"]), " || ").alias("packed"))
    return packed.select("video_id", F.explode(fields.packed_records(C("packed"), ["no", "name", "role", "rest"])).alias("r")).select("video_id", "r.*")


@query(
    rf"""select doc_id, regexp_extract(text, '(?i)\b([A-Z]{{4}}-[0-9]{{4}}-[0-9]{{4}})', 1) as number, {_strip(r'''regexp_extract(regexp_replace(coalesce(text, ''), '\r\n', chr(10), 'g'), '(?is)(?:^|\n)(\d[^\n]*\n.*?)(?:\n\d|$)', 1)''')} as first_section from documents"""
)
def header_and_section(spark, d):
    """The document number of a text and the section under its first numbered heading."""
    text = F.regexp_replace("text", "\r\n", "\n")
    number = F.regexp_extract("text", r"(?i)(?<![A-Za-z0-9_])([A-Z]{4}-[0-9]{4}-[0-9]{4})", 1)
    return _t(spark, d, "documents").select("doc_id", number.alias("number"), fields.section_between(text, r"\d", r"\d").alias("first_section"))


@query("select comment_id, collected_at, case when length(comment_clean) > 120 then rtrim(substr(comment_clean, 1, 119)) || '…' else comment_clean end as shown, round(100.0 * length(comment_clean) / nullif(sum(length(comment_clean)) over (), 0), 6) as share from comments_no_pii")
def display_values(spark, d):
    """Texts cut to a budget, and percentages."""
    c = _t(spark, d, "comments_no_pii")
    whole = c.agg(F.sum(F.length("comment_clean")).alias("whole"))
    share = F.round(100.0 * F.length("comment_clean") / C("whole"), 6)
    return c.crossJoin(F.broadcast(whole)).select("comment_id", "collected_at", fields.limited(C("comment_clean"), 120).alias("shown"), share.alias("share"))


@query("select c_custkey, c_mktsegment, c_name from customer")
def public_columns(spark, d):
    """Base columns first, then those of a prefix by name; private and large ones left out."""
    c = fields.public(_t(spark, d, "customer").withColumn("_hash", F.sha2("c_name", 256)), large=["c_acctbal"])
    return c.select(*fields.export_columns(c, ["c_custkey", "no_such_column"], ["c_mkt", "c_nam"]))


_lines = "(select doc_id, list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: " + _strip("x") + "), lambda x: x <> '') as l from documents where text is not null)"


@query(
    rf"""select doc_id, case when len(l) = 0 then '' else list_reduce(l, lambda out, x: case when regexp_matches(out, '[-/]$') then out || x else out || ' ' || x end) end as joined from {_lines}"""
)
def joined_lines(spark, d):
    return _t(spark, d, "documents").filter("text is not null").select("doc_id", fields.joined_lines(F.split("text", r"\r?\n")).alias("joined"))


@query(
    rf"""with l as (select doc_id, list_transform(string_split_regex(text, '\r?\n'), lambda x: {_strip('x')}) as l from documents where text is not null),
k as (select doc_id, list_filter(case when regexp_matches(l[1], '^\d+$') then l[2:] else l end, lambda x: x <> '' and not regexp_matches(x, '^(?:Page|Case) ')) as l from l)
select doc_id, {_squeeze(r'''regexp_replace(array_to_string(l, ' '), '-\s+([a-z])', '-\1', 'g')''')} as plain from k"""
)
def page_plain(spark, d):
    """Printed pages without page number, running heads and wrapped hyphens."""
    return _t(spark, d, "documents").filter("text is not null").select("doc_id", fields.without_furniture(C("text"), "^(?:Page|Case) ").alias("plain"))


_marked = lambda c: rf"""regexp_replace(regexp_replace({c}, '({_BL}*\n\n{_BL}*)', chr(1) || '\1', 'g'), '([.!?]["''”’)\]]*)({_BL}+)([\p{{Lu}}\p{{Nd}}"“‘(])', '\1' || chr(1) || '\2\3', 'g')"""


def _spans_sql(key: str, text: str, source: str) -> str:
    """CTEs that end with ``spans`` (key, id, first, last, sentence)."""
    return rf"""pieces as (select {key}, string_split({_marked(text)}, chr(1)) as p from {source} where {text} is not null), e as (select {key}, unnest(p) as piece, unnest(range(1, len(p) + 1)) as i from pieces),
spots as (select *, coalesce(sum(length(piece)) over (partition by {key} order by i rows between unbounded preceding and 1 preceding), 0) as before from e),
spans as (select {key}, row_number() over (partition by {key} order by i) as id, (before + length(piece) - length(regexp_replace(piece, '^{_BL}+', '')))::bigint as first, (before + length(piece) - length(regexp_replace(piece, '^{_BL}+', '')) + length({_strip('piece')}))::bigint as last, {_strip('piece')} as sentence from spots where {_strip('piece')} <> '')"""


@query(f"with {_spans_sql('doc_id', 'text', 'documents')} select doc_id, id, first, last, sentence from spans")
def sentence_offsets(spark, d):
    """Plain sentences with offsets, by marks and blank lines alone."""
    s = _t(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(fields.sentence_spans(C("text"))).alias("s"))
    return s.select("doc_id", C("s.id").cast("long").alias("id"), C("s.start").cast("long").alias("first"), C("s.end").cast("long").alias("last"), C("s.text").alias("sentence"))


# -- filters, joins, sorts --------------------------------------------------------------------------------------------


@query(
    f"""select distinct article_id, case when article_text is null then 'missing' when article_text like 'ERROR%' then 'error' when coalesce(lower({_strip('is_repost')}) in ('1', 'true', 'yes'), false) then 'repost'
when length(article_text) < 40 then 'short' else 'usable' end as state, coalesce({_seen_on('seendate')} between '2031-01-01' and '2031-12-31', false) as in_range from gdelt_news_articles"""
)
def usable_texts(spark, d):
    """Fetched texts that can be used, by the first reason against them, and whether they lie in a range of dates."""
    text, day = C("article_text"), T.compact_date(C("seendate"))
    state = F.when(text.isNull(), "missing").when(text.startswith("ERROR"), "error").when(T.truth(C("is_repost")), "repost").when(F.length(text) < 40, "short").otherwise("usable")
    return _t(spark, d, "gdelt_news_articles").select("article_id", state.alias("state"), F.coalesce(day.between("2031-01-01", "2031-12-31"), F.lit(False)).alias("in_range")).distinct()


@query(
    """select comment_id, comment_url, case when d.docket_id is null then 'unlisted' when c.collected_at > d.closes_at then 'late' else 'listed' end as state
from (select distinct comment_id, comment_url, docket_id, collected_at from comments_no_pii) c left join dockets d using (docket_id)"""
)
def listed_state(spark, d):
    """A lookup whose misses stay, with a state of their own."""
    c = _t(spark, d, "comments_no_pii").select("comment_id", "comment_url", "docket_id", "collected_at").distinct()
    j = c.join(_t(spark, d, "dockets").select(C("docket_id"), C("closes_at"), F.lit(True).alias("listed")), "docket_id", "left")
    return j.select("comment_id", "comment_url", F.when(C("listed").isNull(), "unlisted").when(C("collected_at") > C("closes_at"), "late").otherwise("listed").alias("state"))


@query(
    """with p as (select distinct docket_id, split_part(docket_id, '-', 1) as prefix from dockets union all select agency, agency from dockets),
k as (select distinct prefix from (select prefix from p union all select substr(docket_id, 1, 7) from dockets)), c as (select distinct comment_id from comments_no_pii)
select comment_id, max_by(prefix, length(prefix)) as area from c left join k on starts_with(comment_id, prefix || '-') or comment_id = prefix or starts_with(comment_id, prefix) and length(prefix) = 7 group by comment_id"""
)
def longest_prefix(spark, d):
    """The longest known prefix of an id: the parts of an id, from long to short, meet the list by equality."""
    c = _t(spark, d, "comments_no_pii").select("comment_id").distinct()
    dk = _t(spark, d, "dockets").select("docket_id")
    known = dk.select(F.split("docket_id", "-")[0].alias("prefix")).unionAll(dk.select(F.substring("docket_id", 1, 7))).distinct()
    parts = F.array(F.substring("comment_id", 1, 7), F.split("comment_id", "-")[0])
    met = c.select("comment_id", F.explode(parts).alias("prefix")).join(known, "prefix").groupBy("comment_id").agg(F.max_by("prefix", F.length("prefix")).alias("area"))
    return c.join(met, "comment_id", "left")


@query(
    """with v as (select o_orderkey, array_agg(l_partkey order by l_linenumber, l_partkey) filter (where l_linenumber <= 3) as a, list_sort(list_distinct(array_agg(l_partkey))) as b from orders left join lineitem on o_orderkey = l_orderkey group by 1)
select o_orderkey, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), list_filter(coalesce(b, []), lambda x: x is not null)))), ',') as ids from v"""
)
def union_of_ids(spark, d):
    """Sorted distinct union of two sets of ids."""
    li = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(C("l_linenumber") <= 3, C("l_partkey"))).alias("a"), F.collect_set("l_partkey").alias("b"))
    j = _t(spark, d, "orders").select("o_orderkey").join(li, C("o_orderkey") == C("l_orderkey"), "left")
    none = F.array().cast("array<bigint>")
    return j.select("o_orderkey", F.array_join(F.array_sort(F.array_union(F.coalesce("a", none), F.coalesce("b", none))), ",").alias("ids"))


@query("select vec_id, label, rank from (select vec_id, label, row_number() over (order by label desc nulls last, vec_id) as rank from embeddings) where rank <= 50")
def sorted_head(spark, d):
    """The first rows by mixed directions, nulls last: a top-k, not a sort of the table."""
    e = _t(spark, d, "embeddings").select("vec_id", "label").orderBy(F.col("label").desc_nulls_last(), "vec_id").limit(50)
    return e.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("label").desc_nulls_last(), "vec_id")).cast("long"))


@query("select channel, min(n) as least, any_value(country) as country from (select channel, country, n, row_number() over (partition by channel order by n, country) as r from (select lower(trim(channel)) as channel, coalesce(country, 'unknown') as country, count(*) as n from comments_no_pii group by 1, 2)) where r = 1 group by channel")
def smallest_groups(spark, d):
    """The smallest group of each channel: nsmallest of counts, ties by name."""
    n = _t(spark, d, "comments_no_pii").groupBy(F.lower(F.trim("channel")).alias("channel"), F.coalesce("country", F.lit("unknown")).alias("country")).agg(F.count("*").alias("n"))
    return n.groupBy("channel").agg(F.min_by("country", F.struct("n", "country")).alias("country"), F.min("n").alias("least"))


@query(
    """with a as (select domain, found_by, min(struct_pack(s := coalesce(seendate, ''), i := article_id)) as p from gdelt_news_articles where found_by is not null group by 1, 2),
m as (select domain, count(distinct article_id) as articles, max(struct_pack(n := coalesce(length(article_text), 0), i := article_id)).i as longest from gdelt_news_articles group by domain)
select m.domain, articles, longest, coalesce((select string_agg(found_by, ',' order by p) from a where a.domain = m.domain), '') as found_by from m"""
)
def cluster_rollup(spark, d):
    """Per group: size, the longest member, and distinct values in the order in which they first came."""
    a = _t(spark, d, "gdelt_news_articles")
    first = a.filter("found_by is not null").groupBy("domain", "found_by").agg(F.min(F.struct(F.coalesce("seendate", F.lit("")).alias("s"), C("article_id").alias("i"))).alias("p"))
    names = first.groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "found_by"))), lambda x: x["found_by"]), ",").alias("found_by"))
    size = F.struct(F.coalesce(F.length("article_text"), F.lit(0)).alias("n"), C("article_id").alias("i"))
    g = a.groupBy("domain").agg(F.countDistinct("article_id").alias("articles"), F.max(size).alias("m"))
    return g.join(names, "domain", "left").select("domain", "articles", C("m.i").alias("longest"), F.coalesce("found_by", F.lit("")).alias("found_by"))


@query(
    """select event_type as label, count(*) as n, round(avg(value), 6) as mean_confidence, round(count(*) * 1.0 / sum(count(*)) over (), 6) as share, row_number() over (order by count(*) desc, event_type) as place from events group by event_type"""
)
def label_confidence(spark, d):
    """Labels with count, mean confidence, share of all and place; null is a label."""
    n = _t(spark, d, "events").groupBy(C("event_type").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_confidence"))
    one = Window.partitionBy(F.lit(1))  # labels are a closed list
    return n.select("label", "n", "mean_confidence", F.round(C("n") / F.sum("n").over(one), 6).alias("share"), F.row_number().over(one.orderBy(F.desc("n"), "label")).alias("place"))


@query("select id from (select comment_id as id from comment_labels where is_abusive is not null union select comment_id from comments_no_pii where comment_clean is null)")
def processed_ids(spark, d):
    """Distinct ids of two logs."""
    a = _t(spark, d, "comment_labels").filter("is_abusive is not null").select(C("comment_id").alias("id"))
    return files.processed_ids(a, _t(spark, d, "comments_no_pii").filter("comment_clean is null").select(C("comment_id").alias("id")))


@query(
    """select distinct article_id, case when length(article_text) >= 200 then article_text when length(title) >= 40 then title else 'ERROR: text: ' || coalesce(length(article_text)::varchar, 'none') || ' | title: ' || coalesce(length(title)::varchar, 'none') end as fetched,
case when length(article_text) >= 200 then 'text' when length(title) >= 40 then 'title' end as origin from gdelt_news_articles"""
)
def fallback_chain(spark, d):
    """The first candidate that is long enough and its origin, or an error text that says what each had."""
    a = _t(spark, d, "gdelt_news_articles")
    got = files.first_good(("text", C("article_text"), 200), ("title", C("title"), 40))
    return a.select("article_id", got.alias("g")).select("article_id", C("g.value").alias("fetched"), C("g.origin").alias("origin")).distinct()


# -- nested rows and structure ----------------------------------------------------------------------------------------


@query(
    rf"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as no from documents where text is not null),
k as (select * from l where {_strip('line')} <> ''), n as (select *, row_number() over (partition by doc_id order by no) as p, sum(regexp_matches(line, ':\s*$')::int) over (partition by doc_id order by no) as block,
last_value(case when regexp_matches(line, ':\s*$') then 'asks' when regexp_matches(line, '[.!?]\s*$') then 'states' end ignore nulls) over (partition by doc_id order by no) as voice from k)
select doc_id || ':p' || printf('%03d', p) as record_id, doc_id, case when block > 0 then doc_id || '#c' || block::bigint end as block_id, coalesce(voice, 'states') as voice, line as body from n"""
)
def evidence_records(spark, d):
    """Lines of documents as evidence records: numbered, in blocks that a marker opens, with the voice of the last marker."""
    x = _t(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).filter(T.strip(C("line")) != "")
    asks = C("line").rlike(r":\s*$")
    voice = F.when(asks, "asks").when(C("line").rlike(r"[.!?]\s*$"), "states")
    x = ordered.forward_fill(ordered.blocks(x, ["doc_id"], [C("no")], asks, "block"), ["doc_id"], [C("no")], voice, "voice")
    x = x.withColumn("p", F.row_number().over(Window.partitionBy("doc_id").orderBy("no")))
    key = C("doc_id").cast("string")
    return x.select(
        F.concat(key, F.lit(":p"), F.format_string("%03d", "p")).alias("record_id"),
        "doc_id",
        F.when(C("block") > 0, F.concat(key, F.lit("#c"), C("block").cast("string"))).alias("block_id"),
        F.coalesce("voice", F.lit("states")).alias("voice"),
        C("line").alias("body"),
    )


@query(
    """with l as (select l_orderkey, l_partkey, l_quantity, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as n from lineitem)
select o_orderkey, '{"order":' || o_orderkey || ',"status":"' || o_orderstatus || '","items":[' || coalesce(string_agg('{"no":' || n || ',"part":' || l_partkey || '}', ',' order by n), '') || ']}' as payload,
coalesce(string_agg('[S' || n || '] ' || l_partkey, chr(10) order by n), '') as listing from orders left join l on o_orderkey = l_orderkey group by o_orderkey, o_orderstatus"""
)
def prompt_payload(spark, d):
    """Nested JSON and a numbered listing for a model's request."""
    li = export.nest(_t(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], ["l_partkey"], "items")
    j = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(li, C("o_orderkey") == C("l_orderkey"), "left")
    items = F.transform(F.coalesce("items", F.array().cast(li.schema["items"].dataType)), lambda x, i: F.struct((i + 1).alias("no"), x["l_partkey"].alias("part")))
    payload = T.compact_json(F.struct(C("o_orderkey").alias("order"), C("o_orderstatus").alias("status"), items.alias("items")))
    listing = F.array_join(F.transform(items, lambda x: F.concat(F.lit("[S"), x["no"].cast("string"), F.lit("] "), x["part"].cast("string"))), "\n")
    return j.select("o_orderkey", payload.alias("payload"), listing.alias("listing"))


@query(
    """with s as (select *, row_number() over (order by s_acctbal, s_suppkey) as p from supplier), f as (select min(p) as a0 from s where s_nationkey = 0),
g as (select p as a1 from s, f where s_nationkey = 1 order by -abs(p - a0), p limit 1), h as (select p as a2 from s, f, g where s_nationkey = 2 order by -least(abs(p - a0), abs(p - a1)), p limit 1)
select s_suppkey, s_nationkey from s where p in (select a0 from f union all select a1 from g union all select a2 from h)"""
)
def spread_picks(spark, d):
    """One row of each listed state, each as far as can be in rank from those picked before."""
    s = _t(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return sampling.spread(s, [C("s_acctbal"), C("s_suppkey")], "s_nationkey", [0, 1, 2], 3).select("s_suppkey", "s_nationkey")


@query(
    f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents where text is not null), k as (select *, regexp_matches(line, '^\\d+(\\.\\d+)* [^\\s\\x0b]') as head, regexp_matches(line, '^\\s*[-*•] ') as item from l)
select source, count(distinct doc_id) as documents, count(*) as lines, count(*) filter (where head) as headings, count(*) filter (where item) as items, count(*) filter (where {_strip('line')} = '') as blanks from k join documents using (doc_id) group by source"""
)
def section_report(spark, d):
    """Counts of what the texts of each source hold."""
    x = _t(spark, d, "documents").filter("text is not null").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return x.groupBy("source").agg(
        F.countDistinct("doc_id").alias("documents"), F.count("*").alias("lines"), F.count_if(C("line").rlike(r"^\d+(\.\d+)* \S")).alias("headings"),
        F.count_if(C("line").rlike(r"^\s*[-*•] ")).alias("items"), F.count_if(T.strip(C("line")) == "").alias("blanks"),
    )


# -- checked claims ---------------------------------------------------------------------------------------------------

_items = """a as (select distinct article_id, article_text as t, language, found_by, case when substr(article_id, 1, 1) in ('0', '1') then substr(article_text, 20, 80) || 'zz' else replace(substr(article_text, 20, 80), chr(10), ' ') end as quote from gdelt_news_articles where article_text is not null)"""
_flex = rf"array_to_string(list_transform(list_filter(regexp_split_to_array({_strip('quote')}, '{_BL}+'), lambda w: w <> ''), lambda w: regexp_replace(w, '([\\\\.\[\]{{}}()*+?^$|\-])', '\\\1', 'g')), '{_BL}+')"


@query(
    rf"""with {_items}, {_spans_sql('article_id', 't', 'a')}, p as (select *, instr(t, quote) as x, regexp_extract(t, '(?s)^(.*?)(' || {_flex} || ')', 1) as pre, regexp_extract(t, '(?s)^(.*?)(' || {_flex} || ')', 2) as hit from a),
q as (select *, case when quote = '' then null when x > 0 then x - 1 when {_strip('quote')} <> '' and hit <> '' then length(pre) end as s0, case when x > 0 then x - 1 + length(quote) else length(pre) + length(hit) end as e0 from p),
n as (select q.article_id, count(spans.id) as n, min(spans.id) as lo from q left join spans on spans.article_id = q.article_id and spans.first < q.e0 and spans.last > q.s0 group by q.article_id)
select q.article_id, s0::bigint as start_char, case when s0 is not null then e0 end::bigint as end_char, case when s0 is null then 0 else n end as sentences, case when s0 is not null then lo end as first_sentence,
case when found_by is null then 'no origin' when language is null or language not in ('en', 'de', 'fr') then 'unknown type' when s0 is null then 'quote not found' when n = 0 then 'no sentence' end as reason from q join n using (article_id)"""
)
def traceable_items(spark, d):
    """Quotations traced to their article and its sentences, with the reason against those that can't stay."""
    a = _t(spark, d, "gdelt_news_articles").filter("article_text is not null").select("article_id", C("article_text").alias("t"), "language", "found_by").distinct()
    part = F.substring("t", 20, 80)
    a = a.withColumn("quote", F.when(F.substring("article_id", 1, 1).isin("0", "1"), F.concat(part, F.lit("zz"))).otherwise(F.replace(part, F.lit("\n"), F.lit(" "))))
    unknown = C("language").isNull() | ~C("language").isin("en", "de", "fr")
    out = verify.traced(a, "t", "quote", [(unknown, "unknown type"), (C("found_by").isNull(), "no origin")])
    n = F.size("sentence_ids")
    return out.select("article_id", C("start_char").cast("long").alias("start_char"), C("end_char").cast("long").alias("end_char"), F.greatest(n, F.lit(0)).cast("long").alias("sentences"), F.try_element_at("sentence_ids", F.lit(1)).cast("long").alias("first_sentence"), "reason")


_WORDING = [
    ("(?i)\\b(court|judge|ruling)\\b", {"documents": ["order"], "tiers": ["J"], "review": False, "reason": "court"}),
    ("(?i)\\b(cap|limit|limits)\\b", {"documents": ["draft", "final"], "tiers": ["A", "B"], "review": False, "reason": "rule"}),
]
_WINDOWS = {"final_text": {"documents": ["final"], "tiers": ["A"], "review": False, "reason": "window"}, "stay_order": {"documents": ["final", "order"], "tiers": ["A", "J"], "review": True, "reason": "window"}}
_FALLBACK = {"documents": ["draft", "final"], "tiers": ["A"], "review": True, "reason": "unclear"}


@query(
    r"""with a as (select distinct article_id, title, search_window as w, coalesce(regexp_matches(title, '(?i)\b(court|judge|ruling)\b'), false) as j, coalesce(regexp_matches(title, '(?i)\b(cap|limit|limits)\b'), false) as r from gdelt_news_articles)
select article_id, case when j and r then 'order,draft,final' when j then 'order' when r then 'draft,final' when w = 'final_text' then 'final' when w = 'stay_order' then 'final,order' else 'draft,final' end as documents,
case when j and r then 'J,A,B' when j then 'J' when r then 'A,B' when w = 'final_text' then 'A' when w = 'stay_order' then 'A,J' else 'A' end as tiers,
case when j or r then j and r when w = 'final_text' then false when w = 'stay_order' then true else true end as review, case when j and r then 'court; rule' when j then 'court' when r then 'rule' when w in ('final_text', 'stay_order') then 'window' else 'unclear' end as reason from a"""
)
def claim_routes(spark, d):
    """Where a claim is to be checked: by its wording first, then by the window it was found in; the rules are data."""
    a = _t(spark, d, "gdelt_news_articles").select("article_id", "title", "search_window").distinct()
    r = a.select("article_id", verify.routed(F.coalesce("title", F.lit("")), C("search_window"), _WORDING, _WINDOWS, _FALLBACK).alias("r"))
    return r.select("article_id", F.array_join("r.documents", ",").alias("documents"), F.array_join("r.tiers", ",").alias("tiers"), "r.review", "r.reason")


def _rank_sql(n: str, docs: str, asked: str) -> str:
    """CTEs that end with ``n``_s (q, id, score): BM25 of ``docs`` (id, x) for ``asked`` (q, x)."""
    return f"""{n}_t as (select id, unnest({_search('x')}) as token from {docs}), {n}_l as (select id, count(*) as l from {n}_t group by id),
{n}_st as (select (select count(*) from {docs}) as n, (select sum(l) from {n}_l) * 1.0 / (select count(*) from {docs}) as mean), {n}_p as (select id, token, count(*) as tf from {n}_t group by 1, 2),
{n}_df as (select token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as raw from {n}_p, {n}_st group by token, n), {n}_idf as (select token, case when raw < 0 then 0.25 * (select avg(raw) from {n}_df) else raw end as idf from {n}_df),
{n}_q as (select q, token, count(*) as times from (select q, unnest({_search('x')}) as token from {asked}) group by 1, 2),
{n}_s as (select q, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))), 4) as score from {n}_q join {n}_p using (token) join {n}_idf using (token) join {n}_l using (id), {n}_st group by 1, 2)"""


@query(
    f"""with c as (select docket_id as q, docket_title as x, strftime(closes_at, '%Y-%m-%d') as as_of from dockets), arts as (select article_id as id, max(coalesce(title, '') || ' ' || coalesce(article_text, '')) as x, max({_seen_on('seendate')}) as available from gdelt_news_articles group by 1),
v as (select video_id as id, max(title) as x from videos group by 1), link as (select v.id, min(arts.id) as passage from v left join arts on substr(arts.id, 1, 1) = substr(md5(v.id), 1, 1) group by 1),
{_rank_sql('f', 'v', 'c')}, {_rank_sql('g', 'arts', 'c')}, facts as (select * from (select *, row_number() over (partition by q order by score desc, id) as rank from f_s) where rank <= 3),
hits as (select * from (select g_s.*, row_number() over (partition by q order by score desc, g_s.id) as rank from g_s join c using (q) join arts on arts.id = g_s.id where available is null or as_of is null or available <= as_of) where rank <= 5),
joint as (select q, passage as id, 'fact' as origin, rank from facts join link using (id) where passage is not null union all select q, id, 'search', rank from hits), o as (select q, id, min(struct_pack(origin := origin, rank := rank)) as o from joint group by 1, 2)
select q as claim_id, id as passage_id, place, o.origin as origin from (select *, row_number() over (partition by q order by o, id) as place from o) where place <= 5"""
)
def retrieval_plan(spark, d):
    """Primary passages of the best facts of a claim, then the best passages that were there in time."""
    claims = _t(spark, d, "dockets").select(C("docket_id").alias("claim_id"), C("docket_title").alias("text"), F.date_format("closes_at", "yyyy-MM-dd").alias("as_of"))
    a = _t(spark, d, "gdelt_news_articles")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("article_text", F.lit("")))
    passages = a.groupBy(C("article_id").alias("passage_id")).agg(F.max(text).alias("text"), F.max(T.compact_date(C("seendate"))).alias("available"))
    link = a.groupBy(F.substring("article_id", 1, 1).alias("first")).agg(F.min("article_id").alias("passage_id"))
    v = _t(spark, d, "videos").groupBy(C("video_id").alias("fact_id")).agg(F.max("title").alias("statement")).withColumn("first", F.substring(F.md5("fact_id"), 1, 1))
    return verify.plan(claims, v.join(link, "first", "left").drop("first"), passages, 3, 5, 5)


_told = """c as (select o_orderkey as k, o_orderstatus as s, 'Order of ' || coalesce(n, 0) || ' items' as claim, coalesce(got, []) as got, coalesce(ids, []) as ids from orders left join
(select l_orderkey, count(*) as n, list_distinct(array_agg(l_partkey order by l_linenumber, l_partkey) filter (where l_linenumber <= 3)) as got, array_agg(l_partkey order by l_linenumber, l_partkey) as ids from lineitem group by 1) on o_orderkey = l_orderkey)"""


def _checked(spark, d):
    order = F.struct("l_linenumber", "l_partkey")
    li = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.when(C("l_linenumber") <= 3, order))), lambda x: x["l_partkey"]).alias("got"),
        F.transform(F.array_sort(F.collect_list(order)), lambda x: x["l_partkey"]).alias("ids"),
    )
    none = F.array().cast("array<bigint>")
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(li, C("o_orderkey") == C("l_orderkey"), "left")
    got = F.array_distinct(F.coalesce("got", none))
    texts = F.map_from_entries(F.transform(got, lambda i: F.struct(i, F.concat(F.lit("part "), i.cast("string")))))
    prepared = o.select(C("o_orderkey").alias("claim_id"), F.concat(F.lit("Order of "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" items")).alias("claim"), got.alias("retrieved"), texts.alias("texts"))
    status = F.when(C("o_orderkey") % 11 == 0, "filtered").when(C("o_orderkey") % 13 == 0, "error").otherwise("ok")
    verdict = F.when(C("o_orderstatus") == "F", "supported").when(C("o_orderstatus") == "O", "contradicted").otherwise("perhaps")
    ids = F.coalesce("ids", none)
    reason = F.concat(F.lit("See "), F.coalesce(F.get(ids, F.size(ids) - 1).cast("string"), F.lit("nothing")))
    results = o.filter("o_orderkey % 7 <> 0").select(C("o_orderkey").alias("claim_id"), status.alias("status"), verdict.alias("verdict"), ids.alias("ids"), reason.alias("reason"))
    return verify.applied(prepared, results)


_checked_sql = f"""{_told}, r as (select *, k % 7 <> 0 as asked, case when k % 11 = 0 then 'filtered' when k % 13 = 0 then 'error' else 'ok' end as st, case s when 'F' then 'supported' when 'O' then 'contradicted' else 'not_verifiable' end as v,
list_distinct(list_filter(ids, lambda i: list_contains(got, i))) as valid0, list_distinct(list_filter(ids, lambda i: not list_contains(got, i))) as lost from c),
w as (select *, list_sort(list_filter(regexp_extract_all(claim, '\\d+'), lambda x: not list_contains(list_transform(valid0, lambda i: i::varchar), x))) as missing, v <> 'not_verifiable' and len(valid0) = 0 as unproved from r),
x as (select *, v = 'supported' and not unproved and len(missing) > 0 as lowered, case when len(ids) = 0 then 'See nothing' when list_contains(got, ids[-1]) then 'See ' || ids[-1] else 'See [unknown]' end as told from w),
f as (select k as claim_id, case when not asked or st = 'ok' then 'complete' when st = 'filtered' then 'content_filtered' else 'model_error' end as status, case when not asked or st <> 'ok' or unproved then 'not_verifiable' when lowered then 'partially_supported' else v end as verdict,
case when asked and st = 'ok' and not unproved then list_sort(valid0) else [] end as evidence_ids, case when not asked then 'No result.' when st = 'filtered' then 'Blocked by a content filter.' when st = 'error' then 'No valid answer.' else concat_ws(' ', told, case when len(lost) > 0 then 'Unknown ids were removed.' end,
case when unproved then 'No valid citation.' end, case when lowered then 'Numbers not found: ' || array_to_string(missing, ', ') || '.' end) end as reason from x)"""


@query(f"with {_checked_sql} select claim_id, status, verdict, array_to_string(evidence_ids, ',') as ids, reason, status <> 'complete' or verdict in ('partially_supported', 'not_verifiable') as review from f")
def applied_results(spark, d):
    """Results of a model on every prepared claim, with the guards on ids and numbers; orders stand for claims, their parts for evidence."""
    return _checked(spark, d).select("claim_id", "status", "verdict", F.array_join(F.array_sort("evidence_ids"), ",").alias("ids"), "reason", "review")


@query(
    f"""with {_checked_sql} select o_orderpriority, count(*) as claims, count(*) filter (where verdict = 'supported') as supported, count(*) filter (where verdict = 'partially_supported') as partially_supported, count(*) filter (where verdict = 'contradicted') as contradicted,
count(*) filter (where verdict = 'not_verifiable') as not_verifiable, 0::bigint as unchecked from f join orders on o_orderkey = claim_id group by 1"""
)
def verdict_counts(spark, d):
    rows = _checked(spark, d).join(_t(spark, d, "orders").select(C("o_orderkey").alias("claim_id"), "o_orderpriority"), "claim_id")
    return verify.verdict_counts(rows, ["o_orderpriority"], "verdict")


@query(
    f"""with {_checked_sql} select (select count(*) from orders) as claims, count(*) filter (where status = 'complete') as complete, count(*) filter (where status = 'content_filtered') as filtered, count(*) filter (where status = 'model_error') as errors, sum(len(evidence_ids))::bigint as citations,
count(*) filter (where verdict in ('partially_supported', 'not_verifiable') or status <> 'complete') as review, round(100.0 * count(*) filter (where verdict = 'supported') / count(*), 4) as supported_pct from f"""
)
def run_summary(spark, d):
    """Counters of a whole run in one aggregation."""
    n = F.count("*")
    return _checked(spark, d).agg(
        n.alias("claims"), F.count_if(C("status") == "complete").alias("complete"), F.count_if(C("status") == "content_filtered").alias("filtered"), F.count_if(C("status") == "model_error").alias("errors"),
        F.sum(F.size("evidence_ids")).alias("citations"), F.count_if("review").alias("review"), F.round(100.0 * F.count_if(C("verdict") == "supported") / n, 4).alias("supported_pct"),
    )


@query(
    """with q as (select distinct domain as fact_id, coalesce(language, 'none') as doc, title as quote from gdelt_news_articles where title is not null), p as (select coalesce(language, 'none') as doc, case when is_repost in ('1', 'true', 'True') then 'B' else 'A' end as tier, """
    + "lower(" + _squeeze("translate(article_text, '“”‘’', '\"\"''''')") + """) as t from gdelt_news_articles where article_text is not null),
h as (select q.fact_id, q.doc, q.quote, min(p.tier) as tier from q left join p on p.doc = q.doc and lower(""" + _squeeze("translate(q.quote, '“”‘’', '\"\"''''')") + """) <> '' and contains(p.t, lower(""" + _squeeze("translate(q.quote, '“”‘’', '\"\"''''')") + """)) group by 1, 2, 3)
select fact_id, count(*) as quotes, count(tier) as found, min(tier) as best_tier, count(*) = count(tier) as verified, count(*) filter (where tier not in ('A')) as misplaced from h group by fact_id"""
)
def facts_verified(spark, d):
    """Titles as the quotations of a domain's facts, in the articles of their language; reposts are the weaker tier."""
    a = _t(spark, d, "gdelt_news_articles").withColumn("doc", F.coalesce("language", F.lit("none")))
    quotes = a.filter("title is not null").select(C("domain").alias("fact_id"), "doc", C("title").alias("quote")).distinct()
    passages = a.filter("article_text is not null").select("doc", F.when(C("is_repost").isin("1", "true", "True"), "B").otherwise("A").alias("tier"), C("article_text").alias("text"))
    return verify.facts_verified(quotes, passages, ["A"])


_kind = "case c_custkey % 5 when 0 then 'added' when 1 then 'removed' when 2 then 'modified' when 3 then 'unchanged' else 'moved' end"


@query(
    f"""with x as (select c_custkey, {_kind} as kind, lower(case when c_custkey % 5 = 0 and c_custkey % 2 = 0 then '' else substr(c_name, 3, 9) end) as o, lower(case when c_custkey % 5 = 1 then '' when c_custkey % 3 = 0 then substr(c_mktsegment, 1, 4) else substr(c_name, 3, 9) end) as n, lower(c_name) as ot, lower(c_mktsegment || ' ' || c_name) as nt from customer)
select status, count(*) as n from (select case when kind = 'moved' then 'unknown kind' when kind in ('modified', 'unchanged', 'removed') and not (o <> '' and contains(ot, o)) then 'old quote not found' when kind in ('modified', 'unchanged', 'added') and not (n <> '' and contains(nt, n)) then 'new quote not found'
when kind = 'added' and o <> '' then 'added has an old quote' when kind = 'removed' and n <> '' then 'removed has a new quote' when kind = 'modified' and o = n then 'modified without a difference' when kind = 'unchanged' and o <> n then 'unchanged with a difference' else 'validated' end as status from x) group by 1"""
)
def change_validation(spark, d):
    """Rules that a compared change must keep; customers stand for provisions of two versions."""
    c, k = _t(spark, d, "customer"), C("c_custkey")
    kind = F.when(k % 5 == 0, "added").when(k % 5 == 1, "removed").when(k % 5 == 2, "modified").when(k % 5 == 3, "unchanged").otherwise("moved")
    part = F.substring("c_name", 3, 9)
    old = F.when((k % 5 == 0) & (k % 2 == 0), "").otherwise(part)
    new = F.when(k % 5 == 1, "").when(k % 3 == 0, F.substring("c_mktsegment", 1, 4)).otherwise(part)
    status = verify.change_status(kind, old, new, C("c_name"), F.concat_ws(" ", "c_mktsegment", "c_name"))
    return c.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(
    f"""with a as (select video_id as id, list_distinct({_words('max(title)')}) as s from videos group by 1), b as (select article_id as id, list_distinct({_words('max(title)')}) as s from gdelt_news_articles group by 1),
p as (select a.id as a, b.id as b, len(list_intersect(a.s, b.s)) * 1.0 / len(list_distinct(list_concat(a.s, b.s))) as j from a, b where len(a.s) > 0 and len(b.s) > 0)
select a, b, round(j, 6) as similarity from (select *, row_number() over (partition by a order by j desc, b) as r from p where j >= 0.6) where r = 1"""
)
def version_matches(spark, d):
    """The article with the most similar title for each video: matches of two lists by their words, in place of a model."""
    v = _t(spark, d, "videos").groupBy(C("video_id").alias("id")).agg(F.max("title").alias("text"))
    a = _t(spark, d, "gdelt_news_articles").groupBy(C("article_id").alias("id")).agg(F.max("title").alias("text"))
    return verify.best_matches(v, a, 0.6)


@query(briefing.KEY_POINTS_SQL)
def key_points(spark, d):
    return briefing.key_points(_t(spark, d, "comments_no_pii"), _t(spark, d, "dockets"), _t(spark, d, "gdelt_news_articles"), _t(spark, d, "videos"))


# -- panels and terms -------------------------------------------------------------------------------------------------


@query(
    f"with {_checked_sql} select verdict, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 4) as pct, round(avg(o_totalprice), 2) as mean, min(o_totalprice) as least, max(o_totalprice) as most from f join orders on o_orderkey = claim_id group by verdict"
)
def panel_verdicts(spark, d):
    """Shares of verdicts, with the mean and range of a score; totals of orders stand for scores."""
    rows = _checked(spark, d).join(_t(spark, d, "orders").select(C("o_orderkey").alias("claim_id"), "o_totalprice"), "claim_id")
    return briefing.shares(rows, "verdict", "o_totalprice")


@query(
    f"""with {_checked_sql} select claim_id, o_totalprice as weight, array_to_string(evidence_ids[1:2], ',') as cited, rank from (select f.*, o_totalprice, row_number() over (order by o_totalprice desc, claim_id) as rank from f join orders on o_orderkey = claim_id where verdict = 'contradicted') where rank <= 20"""
)
def panel_contradicted(spark, d):
    """The heaviest contradicted claims with two citations at most."""
    rows = _checked(spark, d).filter("verdict = 'contradicted'").join(_t(spark, d, "orders").select(C("o_orderkey").alias("claim_id"), C("o_totalprice").alias("weight")), "claim_id")
    top = rows.orderBy(F.desc("weight"), "claim_id").limit(20)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("weight"), "claim_id"))
    return top.select("claim_id", "weight", F.array_join(F.slice(F.array_sort("evidence_ids"), 1, 2), ",").alias("cited"), rank.alias("rank"))


_quota = {"en": 6, "de": 6, "fr": 2}


@query(
    """with a as (select distinct article_id, language, coalesce(seendate, '') as seen from gdelt_news_articles where language in ('en', 'de', 'fr')), r as (select *, row_number() over (partition by language order by seen desc, article_id) as rank from a)
select article_id, language as stance, rank from r where rank <= case language when 'fr' then 2 else 6 end"""
)
def panel_viewpoints(spark, d):
    """A balanced choice: so many of the latest rows of each stance; languages stand for stances."""
    a = _t(spark, d, "gdelt_news_articles").select("article_id", C("language").alias("stance"), F.coalesce("seendate", F.lit("")).alias("seen")).distinct()
    return briefing.balanced(a, "stance", _quota, [F.desc("seen"), C("article_id")]).select("article_id", "stance", "rank")


@query(
    """with c as (select comment_id, max(coalesce(country, 'unknown')) as g, max(docket_id) as k from comments_no_pii group by 1), n as (select g, count(*) as n, count(distinct k) as dockets from c group by g), r as (select *, row_number() over (order by n desc, g) as big, row_number() over (order by n, g) as small from n where g <> 'unknown')
select g as country, n, dockets, round(100.0 * n / (select sum(n) from n), 4) as pct, case when big <= 5 then 'largest' else 'smallest' end as list from r where big <= 5 or small <= 3"""
)
def panel_groups(spark, d):
    """The five largest and the three smallest named groups with their shares of all."""
    c = _t(spark, d, "comments_no_pii").groupBy("comment_id").agg(F.max(F.coalesce("country", F.lit("unknown"))).alias("g"), F.max("docket_id").alias("k"))
    n = c.groupBy(C("g").alias("country")).agg(F.count("*").alias("n"), F.countDistinct("k").alias("dockets"))
    return briefing.ends(n, "country", "n", 5, 3, ["unknown"])


_reach = "floor(case when regexp_matches(upper(replace(trim(view_count), ',', '')), '^\\d+(?:\\.\\d+)?\\s*[KMB]?$') then round(regexp_extract(upper(replace(trim(view_count), ',', '')), '^(\\d+(?:\\.\\d+)?)', 1)::decimal(20,6) * case right(upper(trim(view_count)), 1) when 'K' then 1000 when 'M' then 1000000 when 'B' then 1000000000 else 1 end, 3) end)::bigint"


@query(
    f"""with v as (select video_id, max(lower(trim(platform))) as platform, max({_reach}) as views, bool_or(coalesce(published_date, '') < '2031') as old, max(coalesce(published_date, '')) as p from videos group by 1)
select platform, count(*) as videos, coalesce(sum(views), 0)::bigint as reach, count(*) filter (where old) as outdated, arg_max(video_id, (coalesce(views, -1), video_id)) as most_viewed from v group by 1"""
)
def panel_reach(spark, d):
    """Reach by platform, each video once, with what is out of date and the most viewed one."""
    v = _t(spark, d, "videos").groupBy("video_id").agg(F.max(F.lower(F.trim("platform"))).alias("platform"), F.max(T.human_count(C("view_count"))).alias("views"), F.bool_or(F.coalesce("published_date", F.lit("")) < "2031").alias("old"))
    return v.groupBy("platform").agg(
        F.count("*").alias("videos"), F.coalesce(F.sum("views"), F.lit(0)).alias("reach"), F.count_if("old").alias("outdated"), F.max_by("video_id", F.struct(F.coalesce("views", F.lit(-1)), "video_id")).alias("most_viewed")
    )


@query(
    f"""with t as (select channel, unnest(t) as term from (select lower(trim(channel)) as channel, {_words('comment_clean')} as t from comments_no_pii where comment_clean is not null)), n as (select channel, term, count(*) as tf from t where length(term) >= 4 group by 1, 2),
f as (select term, sum(tf) as f from n group by 1), s as (select sum(tf) * 1.0 / count(distinct channel) as a from n), w as (select channel, n.term, round(tf * ln(1 + a / f), 6) as weight from n join f using (term), s)
select channel, term, weight, rank from (select *, row_number() over (partition by channel order by weight desc, term) as rank from w) where rank <= 10"""
)
def class_terms(spark, d):
    """The terms that tell classes of texts apart, by class-based TF-IDF; channels stand for topics."""
    from quarrylight.operators import lexical

    c = _t(spark, d, "comments_no_pii").filter("comment_clean is not null").select(F.lower(F.trim("channel")).alias("channel"), F.filter(T.words(C("comment_clean")), lambda w: F.length(w) >= 4).alias("t"))
    return lexical.class_terms(c, "channel", "t", 10)


@query()
def topic_model(spark, d):
    """Clusters of vectors, -1 for outliers, with size and place: k-means in place of a density method, so an approximation."""
    from quarrylight.operators import models

    rows = models.topics(_t(spark, d, "embeddings"), "vec_id", "embedding")
    size = rows.groupBy("topic").agg(F.count("*").alias("size"))
    return rows.join(F.broadcast(size), "topic").select("vec_id", "topic", F.round("distance", 6).alias("distance"), "size")


_skip_sql = r"^(please\s+)?(see|refer\s+to)\s+(the\s+)?attach(ed|ment|ments)(\s+(file\(s\)|files?|letter|documents?|comments?|pdf))?[\s.!]*$"


@query(
    rf"""with x as (select comment_id, country is null as withdrawn, channel = 'mail_scan' as scanned, {_strip("coalesce(comment_clean, '')")} as t from comments_no_pii), p as (select *, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') as p from x)
select comment_id, case when withdrawn then 'withdrawn' when t = '' then 'no_text' when len(list_filter(p, lambda s: not regexp_matches(s, '(?i){_skip_sql}'))) = 0 then 'placeholder' when scanned then 'has_attachments' end as reason from p"""
)
def skip_reasons(spark, d):
    """The first reason against a comment, in order; null for those that stay.  Nulls and scans stand for withdrawn ones and attachments."""
    c = _t(spark, d, "comments_no_pii")
    return c.select("comment_id", T.skip_reason(C("country").isNull(), C("comment_clean"), F.coalesce(C("channel") == "mail_scan", F.lit(False))).alias("reason"))


_HIDE = ["Stay Bureau", "Alwenmore State University", "Ann (x)"]


@query(
    "select comment_id, "
    + "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(comment_clean, '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_-]+\\.[\\p{L}\\p{N}_.-]+', '[removed]', 'g'), '(?:\\+?1[ .-]?)?\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}', '[removed]', 'g'),"
    + " '(^|[^\\p{L}\\p{N}_])((?i:my name is|this is|i''m|i am))\\s+((?i:(?:attorney|lawyer|dr\\.?)\\s+)?)[A-Z][\\p{L}\\p{N}_''-]+(?:[\\s-]+[A-Z][\\p{L}\\p{N}_''-]+){0,3}', '\\1\\2 \\3[name]', 'g'), '(?i)alwenmore state university', '[creator]', 'g'), '(?i)stay bureau', '[creator]', 'g')"
    + " as scrubbed from comments_no_pii"
)
def scrub_names(spark, d):
    """Scrubbing with a list of names, longest first."""
    return _t(spark, d, "comments_no_pii").select("comment_id", T.scrub(C("comment_clean"), _HIDE).alias("scrubbed"))


@query(
    f"""with c as (select docket_id as q, docket_title as x, strftime(closes_at, '%Y-%m-%d') as as_of from dockets), arts as (select article_id as id, max(coalesce(title, '') || ' ' || coalesce(article_text, '')) as x, max({_seen_on('seendate')}) as available, max(language) as language, max(domain) as domain, max(sourcecountry) as country, bool_or(article_text is not null) as whole from gdelt_news_articles group by 1),
{_rank_sql('g', 'arts', 'c')} select docket_id, article_id, score, rank from (select q as docket_id, g_s.id as article_id, score, row_number() over (partition by q order by score desc, g_s.id) as rank from g_s join c using (q) join arts on arts.id = g_s.id
where language in ('en', 'de') and country in ('Calderland', 'Wexmark', 'Norvania') and whole and not domain like 'harrow%' and (available is null or as_of is null or available <= as_of)) where rank <= 5"""
)
def filtered_search(spark, d):
    """Retrieval under five filters and an as-of date, all applied after the statistics of the whole corpus."""
    asked = _t(spark, d, "dockets").select("docket_id", "docket_title", F.date_format("closes_at", "yyyy-MM-dd").alias("as_of"))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("article_text", F.lit("")))
    a = _t(spark, d, "gdelt_news_articles").groupBy("article_id").agg(
        F.max(text).alias("x"), F.max(T.compact_date(C("seendate"))).alias("available"), F.max("language").alias("language"), F.max("domain").alias("domain"), F.max("sourcecountry").alias("country"), F.bool_or(C("article_text").isNotNull()).alias("whole")
    )
    scores = search.bm25(a, "article_id", "x", asked, "docket_id", "docket_title").join(asked.select("docket_id", "as_of"), "docket_id")
    fits = a.filter(C("language").isin("en", "de") & C("country").isin("Calderland", "Wexmark", "Norvania") & C("whole") & ~C("domain").startswith("harrow")).select("article_id", "available")
    timely = scores.join(fits, "article_id").filter(search.as_of(C("available"), C("as_of"))).select("docket_id", "article_id", "score")
    return search.top_k(timely, "docket_id", "article_id", 5)


@query()
def designators(spark, d):
    """Places of paragraph designators such as (a)(1)(ii) in the lines of documents."""
    from quarrylight.operators import sections

    return sections.designators(_t(spark, d, "documents"), "doc_id", "text")
