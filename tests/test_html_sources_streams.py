import json
import os
import sqlite3
import zipfile

from pyspark.sql import functions as F

from rankweave.operators import html as H
from rankweave.sources import files as S
from rankweave.streaming.sse import assembled, assembled_stream, paced

PAGE = """<html><head><title> T </title><meta property="og:title" content="OG"><meta name="description" content="D"><link rel="canonical" href="https://a.example/x">
<meta property="article:published_time" content="2024-01-01"><script type="application/ld+json">{"@graph":[{"@type":["Article","Thing"],"datePublished":"2024-02-02","x":{"dateModified":"2024-03-03"}}]}</script></head>
<body><nav>menu</nav><div class="x sidebar">side</div><div class="sidebars">kept</div><p>One&nbsp;two</p><script>no</script><table><tr><th>1</th></tr></table><a href="https://b.example/y">B <b>c</b></a><a href="#z">in</a><a href="https://b.example/y">again</a></body></html>"""


def test_text_and_metadata():
    assert H.page_text(PAGE) == "keptOne two1B cinagain" and "side kept" in H.page_text(PAGE, classes=False) and H.page_text(None) == ""
    assert "kept" not in H.page_text(PAGE, classes="parts") and "One two" in H.page_text(PAGE, classes="parts")  # sidebars holds a name
    for name, kept in (("header", True), ("header-wide", True), ("read", True), ("ad", False), ("x popup y", False), ("Ad", True)):
        assert ("in" in H.page_text(f'<body><div class="{name}">in</div></body>')) == kept
    assert [H.page_text(f'<body><p id="{n}">in</p></body>', "parts") for n in ("header-wide", "reading", "text")] == ["", "", "in"]
    assert H.page_metadata('<div id="root">')["js_render_suspected"] and not H.page_metadata('<div id="root">', rendered=True)["js_render_suspected"] and not H.page_metadata('<div id="root">' + "x" * 400)["js_render_suspected"]
    m, g = H.page_metadata(PAGE), H.page_metadata(PAGE, ld_first=False)
    assert (m["title"], m["published"], m["modified"], m["canonical"], m["schema_types"], m["table_count"]) == ("T", "2024-02-02", "2024-03-03", "https://a.example/x", "Article|Thing", 1)
    assert (g["title"], g["published"], g["modified"]) == ("OG", "2024-01-01", "")
    assert H.result_links(PAGE) == [{"position": 1, "title": "B c", "url": "https://b.example/y"}]
    assert H.page_text("<p>a<div>b</p></i>c") == "abc"


def test_html_columns(spark):
    d = spark.createDataFrame([(PAGE,), (None,)], "html string")
    r = d.select(H.html_text("html").alias("t"), H.html_metadata("html").alias("m"), H.html_results("html").alias("l"), H.has_table(F.col("html")).alias("h"), H.has_schema_markup(F.col("html")).alias("s"), H.stripped(F.col("html")).alias("x"), H.freshness(F.col("html")).alias("f")).collect()
    assert r[0]["m"]["title"] == "T" and r[0]["h"] and r[0]["s"] and "no" not in r[0]["x"].split() and r[0]["f"] == "" and len(r[0]["l"]) == 1 and r[1]["t"] == ""
    table = '<table class="compare">' + "<tr><th>price</th></tr>" * 6 + "feature pros cons</table><h2>Pros</h2><h2>Cons</h2>"
    e = spark.createDataFrame([(table,)], "h string").select(H.comparison_score(F.col("h")), H.pros_cons_score(F.col("h"), F.lit("The pros: fast. The cons: loud.")), H.js_suspected(F.lit("x"), F.lit('<div id="root">')), H.capped(F.lit("abc"), 2)["content_truncated"]).first()
    assert e[:] == (1.0, 0.35, True, True)
    cases = [
        ("<table><tr><td>x", 0.0), ("no price, no rating, vs, score", 0.0), ("<table>" + "<tr><th>" * 6, 0.45), ("<table> vs score", 0.2), ('<table class="pricing-table">', 0.25), ('<table id="x-vs">', 0.25), ("<table>price rating pros cons", 0.35),
    ]
    got = spark.createDataFrame([(h,) for h, _ in cases], "h string").coalesce(1).select(H.comparison_score(F.col("h"))).collect()
    assert [r[0] for r in got] == [w for _, w in cases]
    marks = [("itemscope", False), ("itemscope itemtype", True), ('typeof="x" property="y"', True), ('typeof="x" vocab="y"', False), ('type="application/ld+json"', True)]
    assert [r[0] for r in spark.createDataFrame([(h,) for h, _ in marks], "h string").coalesce(1).select(H.has_schema_markup(F.col("h"))).collect()] == [w for _, w in marks]
    times = [('<time class="a" datetime="2024-03-05">', "2024-03-05"), ("<TIME datetime='2024-03-05T10:00:00+02:00'>", "2024-03-05"), ('<time datetime="March 5">', ""), ('<meta property="article:published_time" content="2024-03-05">', ""), ('"datePublished": "2024-03-05"', "")]
    assert [r[0] for r in spark.createDataFrame([(h,) for h, _ in times], "h string").coalesce(1).select(H.freshness(F.col("h"))).collect()] == [w for _, w in times]


def test_lines_by_patterns(spark):
    page = "<p>One <b>two</b></p>three<br>@media x{}<div>a css } rule</div><li>color: var(--c)</li><script>no</script>--x<h2>1234567890 1234567890 1234567890 1234567890 ab</h2>..;;a<td>End</td>"
    got = [r[0] for r in spark.createDataFrame([(page,), (None,), ("",)], "h string").coalesce(1).select(H.text_lines(F.col("h"))).collect()]
    assert got == [["One two", "three", "End"], [], []]


def test_csv_forms(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿ id ,text\n1,"a ""b""\nc"\n2,\n', encoding="utf-8")
    assert [r[:] for r in S.read_csv(spark, str(p), squash=("text",)).collect()] == [("1", 'a "b" c'), ("2", "")]
    q = tmp_path / "b.csv"
    q.write_text('prompt_id,query\nP1,one, two\nP2,"x"\n\n')
    assert [r[:] for r in S.read_first_comma(spark, str(q)).collect()] == [("P1", "one, two"), ("P2", "x")]
    m = S.read_matching(spark, [str(p), str(q)], ["query"])
    assert m.columns[:2] == ["prompt_id", "query"] and {r["file_no"] for r in m.collect()} == {1}
    assert S.read_matching(spark, [str(p)], ["none"]).count() == 0
    out = str(tmp_path / "out")
    S.write_csv(spark.createDataFrame([("x\ny", 'q"', 1)], "t string, u string, id int"), out, preferred=["id"], quote_all=True, one_line=True)
    S.write_csv(spark.createDataFrame([(" a ", "")], "t string, u string"), out + "2")
    assert S.read_csv(spark, out + "2").first()[:] == (" a ", "")  # blanks at the ends stay
    back = S.read_csv(spark, out)
    assert back.columns == ["id", "t", "u"] and back.first()[:] == ("1", "x y", 'q"')


def test_json_lines_texts_and_snapshots(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"url": "a", "ok": true}\nbroken\n{"url": "b", "ok": false}\n')
    assert sorted(r["url"] for r in S.read_jsonl(spark, str(p), "url string, ok boolean").collect()) == ["a", "b"]
    assert S.read_texts(spark, str(p)).first()["text"].startswith('{"url"')
    d = spark.createDataFrame([("h1", "t", 1), ("h1", "t", 2), ("h2", "", 3)], "h string, t string, o int")
    for _ in range(2):
        S.write_snapshots(d, "h", "t", "o", str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 1
    S.append_jsonl(d, str(tmp_path / "j"))
    S.append_jsonl(d, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 6
    assert spark.read.parquet(S.write_version(d, str(tmp_path / "v"))).count() == 3


def test_workbook_and_sqlite(spark, tmp_path):
    S.register(spark)
    x = tmp_path / "w.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(x, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="runs" r:id="r1"/><sheet name="urls" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>url</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t> n </t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>5</v></c></row><row/></sheetData></worksheet>')
    d = spark.read.format("workbook").option("path", str(x)).option("sheet", "urls").load()
    assert d.columns == ["url", "n"] and [r[:] for r in d.collect()] == [("ab", "5")]
    db = tmp_path / "d.db"
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE t (a INT, b TEXT)")
        c.execute("INSERT INTO t VALUES (1, NULL), (2, 'x')")
    q = spark.read.format("sqlite").option("path", str(db)).option("query", "SELECT a, b FROM t ORDER BY a").load()
    assert [r[:] for r in q.collect()] == [("1", None), ("2", "x")]


LINES = [
    ("c", 1, 'data: {"queries": ["q1"], "text": "He"}'), ("c", 2, ": note"), ("c", 3, 'data: {"queries": ["q2", "q1"], "refs": ["r1"], "classification": "web", "text": "llo"}'), ("c", 4, "data: [DONE]"), ("d", 1, "data: {broken"), ("c", 5, 'data: {"refs": ["r2"], "classification": "none"}'),
]


def test_chunks_in_batch(spark):
    r = assembled(spark.createDataFrame(LINES, "conversation string, ord int, line string"), "conversation", "ord", "line").collect()
    assert len(r) == 1 and r[0]["queries"] == ["q1", "q2"] and r[0]["refs"] == ["r1", "r2"] and r[0]["classification"] == "web" and r[0]["text"] == "Hello"


def test_chunks_as_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, part in enumerate((LINES[:3], LINES[3:])):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"conversation": c, "ord": o, "line": l}) for c, o, l in part))
        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    s = spark.readStream.schema("conversation string, ord int, line string").option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(src))
    q = assembled_stream(s).writeStream.format("memory").queryName("chunks").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    last = max(spark.table("chunks").collect(), key=lambda r: r["n_refs"])
    assert last["queries"] == ["q1", "q2"] and last["n_refs"] == 2 and last["classification"] == "web" and last["text"] == "Hello"


def test_windowed_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "event_type", "value")
    e.coalesce(1).write.json(str(tmp_path / "ev"))
    s = spark.readStream.schema(e.schema).json(str(tmp_path / "ev"))
    agg = s.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    q = agg.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = {(r["window"]["start"], r["event_type"]): r["n"] for r in spark.table("hours").collect()}
    want = {(r["h"], r["event_type"]): r["n"] for r in e.groupBy(F.date_trunc("hour", "ts").alias("h"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_pacing(spark):
    d = spark.createDataFrame([("a", 0, 1), ("a", 100, 2), ("a", 5000, 3), ("b", 0, 4)], "d string, ms long, o int").withColumn("at", F.timestamp_millis("ms"))
    assert sorted((r["o"], r["wait_ms"]) for r in paced(d, "d", "at", "o", 1000).collect()) == [(1, 0), (2, 900), (3, 0), (4, 0)]
