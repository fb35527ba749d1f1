"""Files, sinks and streams: tolerant reads, guards, markers, restarts."""

import json

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.sources import files, sinks
from quarrylight.streaming import ingest

C = F.col


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding) if isinstance(text, str) else text)
    return str(path)


def test_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", '﻿id,"text"\n1,"two\nlines, ""quoted"""\n2,plain\n')
    rows = files.csv(spark, path, "id int, text string", required=["id", "text"], at_least=2).orderBy("id").collect()
    assert [(r.id, r.text) for r in rows] == [(1, 'two\nlines, "quoted"'), (2, "plain")]
    with pytest.raises(files.TooFewRows):
        files.csv(spark, path, "id int, text string", at_least=3)
    with pytest.raises(ValueError, match="body"):
        files.csv(spark, path, "id int, text string", required=["body"])


def test_csv_header_with_commas_and_bad_rows(spark, tmp_path):
    path = write(tmp_path / "a.csv", b'"id","name, first"\n1,caf\xe9\nx,ok\n')
    rows = files.csv(spark, path, "id int, name string", required=["name, first"]).collect()
    assert [r.id for r in rows] == [1, None] and rows[1]._bad is not None


def test_row_ids_and_text(spark):
    df = spark.createDataFrame([("b",), (" ",), (None,), ("a",)], "t string")
    assert [(r.row_id, r.t) for r in files.with_row_ids(df, "t", [C("t")]).orderBy("row_id").collect()] == [(1, "a"), (2, "b")]
    have = df.withColumn("row_id", F.lit(7))
    assert {r.row_id for r in files.with_row_ids(have, "t", [C("t")]).collect()} == {7}


def test_json_lines_and_cells(spark, tmp_path):
    path = write(tmp_path / "log.jsonl", '{"k":"a","at":1}\n{"k":"a","at":2}\n{"k":"b","at":1}\n{"k":"c","a')
    log = files.json_lines(spark, path, "k string, at int", torn=True)
    assert sorted(map(tuple, files.last_writes(log, "k", "at").collect())) == [("a", 2), ("b", 1)]
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        files.json_lines(spark, path, "k string, at int").collect()
    assert files.optional_json(spark, str(tmp_path / "none.json"), "k string").count() == 0
    assert files.optional_json(spark, write(tmp_path / "one.json", '{\n"k": "a"\n}'), "k string").first().k == "a"
    cells = spark.createDataFrame([('{"k":1}',), (" ",), (None,)], "c string")
    assert [r.v and r.v.k for r in cells.select(files.json_cell(C("c"), "k int").alias("v")).collect()] == [1, None, None]


def test_urls_columns_and_ids(spark, tmp_path):
    path = write(tmp_path / "urls.txt", "# list\nhttps://a.example/x 2031-01-02\n\n  https://b.example/y   # note\n")
    assert [tuple(r) for r in files.url_list(spark, path).collect()] == [("https://a.example/x", "2031-01-02"), ("https://b.example/y", None)]
    df = spark.createDataFrame([(1, 2)], "b int, c int")
    assert files.first_column(df, ["a", "c", "b"]) == "c" and files.first_column(df, ["z"]) is None
    assert sorted(r.b for r in files.processed_ids(df.select("b"), df.select("c"), df.select("b")).collect()) == [1, 2]


def test_fallbacks_and_imports(spark):
    df = spark.createDataFrame([("long enough", "x"), ("no", "archived"), (None, "y")], "a string, b string")
    got = df.select(files.first_good(("direct", C("a"), 5), ("archive", C("b"), 5)).alias("g")).select("g.*").collect()
    assert [tuple(r) for r in got] == [("long enough", "direct"), ("archived", "archive"), ("ERROR: direct: none | archive: 1", None)]
    now, before = spark.createDataFrame([(1, "new")], "k int, t string"), spark.createDataFrame([(1, "old"), (2, "kept"), (3, "ERROR x")], "k int, t string")
    merged = files.import_previous(now, before, "k", ~C("t").startswith("ERROR"))
    assert sorted(map(tuple, merged.collect())) == [(1, "new"), (2, "kept")]


def test_pages(spark, tmp_path):
    write(tmp_path / "a.bin", "one\ftwo\f")
    pages = files.pages(spark, str(tmp_path / "a.bin"), lambda content: [x.decode() for x in content.split(b"\f")])
    text = files.marked_text(pages)
    assert text.first().text == "--- PAGE 1 ---\none\n--- PAGE 2 ---\ntwo\n--- PAGE 3 ---\n"
    back = text.select(F.explode(T.pages_of(C("text"))).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in back] == [(1, "one"), (2, "two"), (3, "")]


XML = """<RULE><PRTPAGE P="10"/><HD>A  <E T="3">heading</E></HD><P>Too short.</P><P>The first paragraph<FTREF/> of the rule is long<SU>1</SU> enough to stay.</P>
<FTNT><P>A footnote that is surely long enough to be taken for a paragraph.</P></FTNT><PRTPAGE P="11"/><SECTNO>§ 1.2</SECTNO><FP>Another paragraph of the rule that is long enough.</FP></RULE>"""


def test_rule_paragraphs(spark):
    df = spark.createDataFrame([("d", XML, 1), ("bad", "<RULE>", 1), ("null", None, 1)], "doc string, xml string, no int")
    got = files.rule_paragraphs(df, "doc", "xml").collect()
    assert [(r.no, r.heading, r.page, r.text) for r in got] == [
        (1, "A heading", "10", "The first paragraph of the rule is long1 enough to stay."),
        (2, "Regulatory text § 1.2", "11", "Another paragraph of the rule that is long enough."),
    ]


def test_page_lines_and_pre(spark):
    raw = "<html><pre>a\n\n[[Page 7]]\n\nb\n\nc\x00\n[[Page 8]]\nd</pre></html>"
    df = spark.createDataFrame([("d", raw)], "doc string, raw string").select("doc", T.pre_text(C("raw")).alias("t"))
    assert [(r.page, r.line) for r in files.page_lines(df, "doc", "t").orderBy("no").collect()] == [(None, "a"), ("7", "b"), ("7", ""), ("7", "c"), ("8", "d")]


def test_polymorphic_source(spark, tmp_path):
    write(tmp_path / "v1.csv", "start,end,text\n3661,3662,later\n1,2,hello\n")
    videos = write(tmp_path / "videos.csv", "video_id,title,segments_file\nv1,Talk,v1.csv\nv2,None,\n")
    got = {r.source_id: (r.kind, r.text) for r in files.sources(spark, videos).collect()}
    assert got == {"v1": ("video", "[0:01] hello\n[1:01:01] later"), "v2": ("video", None)}
    news = write(tmp_path / "news.csv", "url,title,article_text\nu1,T,body\nu2,T,ERROR: gone\nu3,T,\n")
    assert [(r.source_id, r.text) for r in files.sources(spark, news).collect()] == [("u1", "body")]
    with pytest.raises(ValueError):
        files.sources(spark, write(tmp_path / "other.csv", "a,b\n1,2\n"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "w1"), (2, 'b "q"', "w2")], "k int, t string, w string")
    with pytest.raises(ValueError, match="w"):
        sinks.fixed_csv(df, str(tmp_path / "x"), ["k", "t"])
    sinks.fixed_csv(df, str(tmp_path / "x"), ["t", "k"], strict=False, files=1)
    assert spark.read.options(header=True, escape='"').csv(str(tmp_path / "x")).columns == ["t", "k"]
    for _ in range(2):
        sinks.append_json(df.limit(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    path = str(tmp_path / "byw")
    sinks.windows(df, path, "w")
    sinks.windows(df.filter("k = 2").withColumn("t", F.lit("again")), path, "w")
    assert sorted((r.k, r.t) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "again")]
    first = sinks.stage(df, str(tmp_path / "stage"))
    assert sinks.stage(df.limit(0), str(tmp_path / "stage")).count() == first.count() == 2
    sinks.whole(df.limit(1), str(tmp_path / "stage"))
    assert spark.read.parquet(str(tmp_path / "stage")).count() == 1
    link = df.limit(1).select(sinks.version_link(F.lit("p"), F.lit(None).cast("string"), F.lit("2031-01-01")).alias("j")).first().j
    assert json.loads(link) == {"proposed": "p", "final": None, "checked_at": "2031-01-01"}
    lines = df.select(sinks.review_line(C("t"), F.lit(None).cast("string"), C("w")).alias("l")).collect()
    assert lines[0].l == "a  # no date | w1"
    doc = sinks.document(df, [], C("k"), sinks.report_line("- %s (%s)", C("t"), C("w"))).first().text
    assert doc == '- a (w1)\n- b "q" (w2)'
    assert [r.value for r in sinks.lines(df, [F.desc("k")], C("t")).collect()] == ['b "q"', "a"]


def test_stream_with_restart(spark, tmp_path):
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    schema = "id string, at timestamp"
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string").withColumn("at", F.timestamp_seconds(F.lit(1000)))

    def run():
        stream = ingest.once_per_key(ingest.read_new(spark, source, schema), "id", "at")
        ingest.ingest(stream, out, check).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    rows("a", "b", "a").write.mode("append").parquet(source)
    assert run() == ["a", "b"]
    rows("b", "c").write.mode("append").parquet(source)
    assert run() == ["a", "b", "c"] == run()
