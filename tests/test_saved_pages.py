"""HTM14 to HTM16 on pages with adverts, menus and two lists of sources."""

from pyspark.sql import functions as F

from rankweave.operators import saved_pages as P

SERP = """<nav><a href="https://menu.example/">Menu</a></nav><ol><li class="b_algo"><h2><a href="https://www.a.example/x?utm_source=q">A <b>one</b></a></h2><cite>a.example › x</cite><div class="b_caption"><p>First snippet</p></div></li>
<li class="b_algo"><p>Sponsored</p><h2><a href="https://ad.example/">Ad</a></h2></li><li class="b_algo b_adTop"><h2><a href="https://ad2.example/">Ad</a></h2></li><li class="b_algo"><div class="b_ads1line"></div><h2><a href="https://ad3.example/">Ad</a></h2></li>
<li class="b_algo"><h2><a href="https://www.bing.com/aclick?u=x">Ad</a></h2></li><li class="b_algo"><h2><a href="https://c.example/">C</a></h2><p>A paragraph of more than twenty characters.</p></li><li class="b_algo"><h2></h2></li></ol><a class="sb_pagS">2</a>"""
ITEMS = """<h2>Best</h2><ul><li>Alpha - light and small <a href="https://a.example/">a.example</a><button>Copy</button><li>Beta gamma delta epsilon</ul><h3>Other</h3><ol><li>Zeta: cheap <a href="#x">in</a></li></ol>"""
LINK = '<a target="_blank" rel="noopener" href="https://%s.example/"><div class="font-semibold">%s</div><p>about</p></a>'
PANEL = f'<a href="https://nav.example/">n</a><ul><li class="sticky top">Citations</li><ul><li>{LINK % ("a", "A")}</li><li>{LINK % ("b", "B")}</li></ul><li class="sticky">More</li><ul><li>{LINK % ("a", "A")}</li><li>{LINK % ("c", "C")}</li></ul></ul>'


def test_cards(spark):
    d = spark.createDataFrame([("r", SERP), ("s", None)], "k string, h string")
    got = [tuple(r) for r in P.result_rows(d, "k", "h").orderBy("position").collect()]
    assert got == [
        ("r", 1, "A one", "https://www.a.example/x", "a.example", "a.example › x", "First snippet", 2),
        ("r", 2, "C", "https://c.example/", "c.example", "c.example", "A paragraph of more than twenty characters.", 2),
    ]


def test_items():
    assert [(i["item_section_title"], i["item_position"], i["item_name"], i["links"]) for i in P.answer_items(ITEMS)] == [("Best", 1, "Alpha", ["https://a.example/"]), ("Best", 2, "Beta gamma delta", []), ("Other", 3, "Zeta", [])]


def test_source_lists(spark):
    second = PANEL.replace('class="sticky top"', "").replace('class="sticky"', "")
    d = spark.createDataFrame([("p", PANEL), ("q", second), ("z", '<a href="https://x.example/">X</a>')], "k string, h string")
    got = [tuple(r) for r in P.source_rows(d, "k", "h").select("k", "section", "position", "title", "domain").orderBy("k", F.desc("section"), "position").collect()]
    both = [("cited", 1, "A", "a.example"), ("cited", 2, "B", "b.example"), ("additional", 1, "C", "c.example")]
    assert got == [*[("p", *x) for x in both], *[("q", *x) for x in both], ("z", "cited", 1, "X", "x.example")]


def test_the_plan_of_cards_stays_small(spark):
    """Rules over rules of a card's url are not written out over and over: that was a plan of 7.4 million characters."""
    rows = P.result_rows(spark.createDataFrame([("r", SERP)], "k string, h string"), "k", "h")
    plan, size = rows._jdf.queryExecution().optimizedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        size += sum(len(node.expressions().apply(i).toString()) for i in range(node.expressions().size()))
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert size < 200_000


def test_redirects_of_cards(spark):
    """What cannot be decoded keeps its url, by which click counters and redirects are left out."""
    bing = "https://www.bing.com/"
    urls = [bing + "ck/a?u=a1aHR0cHM6Ly90LmV4YW1wbGUveD9yZWY9MSZiPTI", bing + "ck/a?u=bad", bing + "aclick?u=x", bing + "search?q=1&ref=2", "https://doubleclick.net/x", "http://Play.b.example/?ref=1#f"]
    page = "".join(f'<li class="b_algo"><h2><a href="{u.replace("&", "&amp;")}">T{i}</a></h2></li>' for i, u in enumerate(urls))
    got = P.result_rows(spark.createDataFrame([("r", page)], "k string, h string"), "k", "h").orderBy("position").collect()
    assert [(r["position"], r["title"], r["url"], r["domain"]) for r in got] == [(1, "T0", "https://t.example/x?b=2", "t.example"), (2, "T3", bing + "search?q=1", "bing.com"), (3, "T5", "http://Play.b.example/#f", "b.example")]
