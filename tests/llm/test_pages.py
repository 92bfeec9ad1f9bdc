import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm.body import body_labels, body_text
from rankweave.llm.cut import artificial, cut_rates, features, fit, prior_shift, score_cuts
from rankweave.llm.lines import furniture_score, menu_share
from rankweave.llm.mincut import furniture_lines, min_cut
from rankweave.llm.residue import FILLER, MESSAGE, PLACEHOLDER, judge, line_marks, placeholders, residue_pages
from rankweave.llm.screen import Screen
from rankweave.llm.spam import page_evidence, phrases, stuffed_pages

PROSE = "The battery of this phone lasts for two days, and it charges in an hour. We used it at home and in the office for a week."


# minimum cut


def brute_cut(score, near, far):
    n, best = len(score), None
    for labels in itertools.product((0, 1), repeat=n):
        c = sum(max(-s, 0) if l else max(s, 0) for s, l in zip(score, labels))
        c += sum(near[i] for i in range(1, n) if labels[i] != labels[i - 1]) + sum(far[i] for i in range(2, n) if labels[i] != labels[i - 2])
        best = c if best is None else min(best, c)
    return best


def max_flow(score, near, far):
    """Augmenting paths on the graph of lines and two terminals."""
    n = len(score)
    cap = np.zeros((n + 2, n + 2))
    s, t = n, n + 1
    for i in range(n):
        cap[s, i], cap[i, t] = max(-score[i], 0), max(score[i], 0)
        if i > 0:
            cap[i, i - 1] += near[i]
            cap[i - 1, i] += near[i]
        if i > 1:
            cap[i, i - 2] += far[i]
            cap[i - 2, i] += far[i]
    flow = 0.0
    while True:
        prev, queue = {s: None}, [s]
        while queue and t not in prev:
            u = queue.pop(0)
            for v in range(n + 2):
                if v not in prev and cap[u, v] > 1e-12:
                    prev[v] = u
                    queue.append(v)
        if t not in prev:
            return flow
        path, v = [], t
        while prev[v] is not None:
            path.append((prev[v], v))
            v = prev[v]
        f = min(cap[e] for e in path)
        for u, v in path:
            cap[u, v] -= f
            cap[v, u] += f
        flow += f


def cut_value(score, near, far, labels):
    n = len(score)
    c = sum(max(-s, 0) if l else max(s, 0) for s, l in zip(score, labels))
    return c + sum(near[i] for i in range(1, n) if labels[i] != labels[i - 1]) + sum(far[i] for i in range(2, n) if labels[i] != labels[i - 2])


def test_min_cut_is_minimal_and_equals_max_flow():
    rnd = np.random.default_rng(2)
    lengths = np.array([1, 2, 3, 5, 7, 8, 8, 6, 4, 8] * 6)
    w = int(lengths.max())
    score, near, far = rnd.normal(0, 2, (len(lengths), w)).round(3), rnd.random((len(lengths), w)).round(3), rnd.random((len(lengths), w)).round(3)
    labels = min_cut(score, near, far, lengths)
    for r, n in enumerate(lengths):
        got = cut_value(score[r, :n], near[r], far[r], labels[r, :n])
        assert got == pytest.approx(brute_cut(score[r, :n], near[r], far[r]))
        assert got == pytest.approx(max_flow(score[r, :n], near[r], far[r]))


PAGE = ["Skip to main content", "Home | Blog | Contact | Sign up", "Home > Guides > Phones", "We use cookies to improve your visit. Accept all Reject all", "Acme review: is this phone worth it?", PROSE, "Pricing", PROSE, "Advertisement", "- Good screen", "You may also like", "How to choose a phone", "Is there a phone that works at home?", "© 2024 Acme. All rights reserved."]


def test_furniture_of_a_page():
    assert furniture_lines(["\n".join(PAGE)])[0] == [1, 2, 3, 4, 9, 11, 12, 13, 14]
    spaced = "\n\n".join(PAGE)
    assert furniture_lines([spaced])[0] == [2 * i - 1 for i in (1, 2, 3, 4, 9, 11, 12, 13, 14)]  # blank lines count
    assert furniture_lines([None, "", " \n ", PROSE]) == [[], [], [], []]


def test_body_columns(spark):
    spam = "Home | Blog | Contact\n" + "cheap phone buy phone best phone phone online " * 20
    error = "Home | Blog | Contact\nAccess denied. You don't have permission to open this address.\n© 2024 Acme"
    df = spark.createDataFrame([(1, "\n".join(PAGE), "x"), (2, spam, "x"), (3, error, "x"), (4, None, "x"), (5, "", "x"), (6, "\n".join(PAGE), "x")], "row_id long, content string, line_no string")
    got = {}
    for r in body_labels(df, "row_id", "content").collect():
        got.setdefault(r["row_id"], []).append(r["line_no"])
    assert got == {i: [1, 2, 3, 4, 9, 11, 12, 13, 14] for i in (1, 6)}
    text = {r["row_id"]: r["body"] for r in body_text(df, "row_id", "content").collect()}
    assert text[1] == "\n".join(PAGE[i] for i in (4, 5, 6, 7, 9)) and text[2] is None and text[3] is None and text[4] is None
    assert body_labels(df.limit(0), "row_id", "content").count() == 0


def test_long_page():
    text = "\n".join(PAGE[:4] + [PROSE] * 5000 + PAGE[-1:])
    assert furniture_lines([text])[0] == [1, 2, 3, 4, 5005]


# residue


@pytest.mark.parametrize("t", ["Buy {{product}} now.", "the ${price.from} phone", "{% block intro %}", "<%= name %>", "%%SITE_NAME%% here", "by @@author@@", "__PRICE_FROM__", "[[author]]", "see <<name>>", "a {brand_name} b", "[INSERT PRODUCT NAME]", "[Your Company]", "[intro missing]", "[object Object]", "null: x", "&lt;your name here&gt;", "%(city)s", "TODO: add summary"])
def test_placeholders(t):
    assert placeholders(t)


@pytest.mark.parametrize("t", ["The template replaces `{{first_name}}` with the name.", "reads `${LANG_CODE}` from the shell", "[Acme](https://acme.example/x) is good", "5 % of 100%", "a < b and c > d", "{1, 2}", "see [1] and [note]", "cost: $5", PROSE])
def test_no_placeholders(t):
    assert not placeholders(t)


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["Acme review", "Access denied. You don't have permission to open this address."], True), (["404 - Page not found. The page you asked for has moved."], True), (["You need to enable JavaScript to run this app."], True), (["Bitte aktivieren Sie JavaScript, um diese Seite zu nutzen."], True),
        (["Se ha producido un error. Inténtelo de nuevo en 5 minutos."], True), (["Lorem ipsum dolor sit amet consectetur adipiscing elit mauris integer donec."], True), (["Intro goes here.", "Coming soon: text text text text. TBD. TBD. TBD."], True),
        ([PROSE, "If the dashboard stays blank, enable JavaScript in the settings, reload once, and it appears.", PROSE], False), ([PROSE, "The page answered with a 404 not found error twice, so we mailed support.", PROSE], False), ([PROSE, "Acme printed lorem ipsum on its packaging for a month, a slip that buyers liked.", PROSE], False), ([PROSE], False),
    ],
)
def test_no_body(lines, want):
    assert judge(lines, [False] * len(lines))[1] is want


def test_screen_loses_no_match():
    patterns = [MESSAGE, FILLER, PLACEHOLDER]
    screen = Screen(patterns)
    lines = [PROSE, *PAGE, "access denied", "Bad gateway", "{{x}}", "goes here", "HTTP 500", "Whoops! no", "error code 5", "coming soon: x", "tbd", "[[a]]", "scripts are off"]
    for x in lines:
        for i, p in enumerate(patterns):
            if p.search(x):
                assert screen.mask(x.lower()) >> i & 1
    assert line_marks(PROSE) == 0


def test_captures_of_one_page_are_no_boilerplate(spark):
    """A real text that mentions an error stays, however often its page was captured; a menu of three pages goes."""
    real = PROSE + "\nIf the screen stays blank, enable JavaScript in the browser and reload."
    rows = [(i, "a.example", "p", real) for i in range(6)] + [(10 + i, "b.example", f"p{i}", f"Nice menu words without any end {i}\nAccess denied. You have no permission.") for i in range(4)]
    rows += [(20, "a.example", None, None), (21, "a.example", "p", "\n\n" + real), (22, "a.example", "q", "Buy {{" + "x" * 200 + "}} now.")]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], "row_id long, site string, page string, content string, _line string, _often string")
    got = {r["row_id"] for r in residue_pages(df, "row_id", "site", "content", F.col("page")).collect()}
    assert got == {10, 11, 12, 13, 22}


def test_length_changes_no_rule():
    notice = "We use cookies and similar small files to measure visits, to remember your settings and to show adverts that fit. By going on you agree to this. You can accept all cookies, refuse them, or manage settings at any time."
    told = "Its cookies jar lets you accept or refuse each tracker. " + " ".join([PROSE] * 3)
    assert len(notice) > 180 and furniture_score(notice) > 1 and furniture_score(told) < -1
    assert menu_share(" | ".join(["Home", "Blog", "Contact", "Sign up"] * 20)) > 0.9


def test_residue_columns(spark):
    rows = [
        (1, "a.example", "Access denied. You don't have permission to open this address."), (2, "a.example", PROSE + "\nBuy {{product}} now."), (3, "a.example", PROSE), (4, "a.example", None), (5, "a.example", "  "), (6, None, "You need to enable JavaScript to run this app."), (7, "a.example", "Access denied. You don't have permission to open this address."), (8, "a.example", "x " * 100000 + "{{y}}"),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "row_id long, site string, content string, n_rows string")
    got = {r["row_id"]: (r["placeholder"], r["no_body"]) for r in residue_pages(df, "row_id", "site", "content").collect()}
    assert set(got) == {1, 2, 6, 7, 8} and got[1] == (False, True) and got[2] == (True, False)
    assert residue_pages(df.limit(0), "row_id", "site", "content").count() == 0


# stuffed pages


SPAM = {
    "keywords": "best phone buy phone cheap phone phone online coupon phone sale phone review phone deal " * 6, "lines": "\n".join(f"budget phone {w}" for w in "Oslo Bergen Tromso Lund Turku Pori Vaasa Kemi Lahti Espoo".split() * 2), "links": "\n".join(f"site{i}.example/out?id={i}" for i in range(30)),
    "tags": " ".join(f"#Cheap{i % 4}Phone" for i in range(40)), "skus": "\n".join(f"Acme SKU{10000 + i} best phone | sale | cheap phone" for i in range(20)), "sentences": "Find phone and phone with our phone, the phone. Phone is the phone for phone users who want a phone. " * 6,
}
HONEST = {
    "prose": PROSE, "table": PROSE + "\n" + "\n".join(f"Model{i} | {i} | {i * 7} | quiet" for i in range(12)), "specs": PROSE + "\n" + "\n".join(f"{w}: {i}" for i, w in enumerate("Battery Screen Camera Speaker Price Weight Size Colour".split())), "flat table": " ".join(f"Model{i} {i} {i * 7} quiet" for i in range(20)),
    "links with texts": "\n".join(f"[Site{i}](https://s{i}.example/x) It is the best of the phones that we tried in the office." for i in range(8)), "menu": "Home | Blog | Contact | Sign up | Reviews | Deals\n" + PROSE, "empty": "",
}


@pytest.mark.parametrize("name", SPAM)
def test_spam(name):
    assert page_evidence(["The phone was good, and we liked it.", *[x for x in SPAM[name].split("\n") if x]])["spam"]


@pytest.mark.parametrize("name", HONEST)
def test_honest(name):
    assert not page_evidence([x for x in HONEST[name].split("\n") if x])["spam"]


def test_phrases_leave_keywords_out():
    texts = ["buy phone, best phone! buy phone best phone", "buy bike best bike buy bike best bike", "one two three four five six seven", "a b c", "best https://x.example/a best https://y.example best #BestBike"]
    size, page, found = phrases(texts)
    assert size.tolist() == [4, 4, 3, 0, 3]
    own = [set(found[page == i].tolist()) for i in range(len(texts))]
    assert own[0] and own[0] == own[1] and not own[2] and not own[3] and own[4]
    assert len(phrases([])[1]) == len(phrases([""])[1]) == 0


def test_phrases_of_a_batch_are_those_of_each_text():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("red blue the of phone bike x1 7 a.example".split()) for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    size, page, found = phrases(texts)
    for i, t in enumerate(texts):
        n, _, alone = phrases([t])
        assert n[0] == size[i] and alone.tolist() == found[page == i].tolist()


def brute_phrases(words):
    """Keyword phrases of words without function words, numbers and links."""
    keys = {w for w in words if words.count(w) >= 2}
    out = []
    for i in range(len(words) - 4):
        five = words[i : i + 5]
        if sum(w in keys for w in five) >= 4:
            out.append(tuple(five.index(w) if w in keys else w for w in five))
    return out


def test_phrases_equal_brute_force():
    rnd = random.Random(6)
    for _ in range(40):
        a, b = ([rnd.choice("red blue green phone bike desk".split()) for _ in range(rnd.randint(5, 14))] for _ in "ab")
        _, page, found = phrases([" ".join(a), " ".join(b)])
        x, y = brute_phrases(a), brute_phrases(b)
        got = found.tolist()
        assert [p == q for p in x + y for q in x + y] == [p == q for p in got for q in got]


def test_stuffed_columns(spark):
    other = {k: v.replace("phone", "desk").replace("Phone", "Desk").replace("Acme", "Nord") for k, v in SPAM.items()}
    spam = [(f"s{i}.example", t) for i, t in enumerate([*SPAM.values(), *other.values()])]
    rows = [(i, h, t) for i, (h, t) in enumerate([*spam, *[("h.example", t) for t in HONEST.values()], (None, None), ("h.example", "  "), ("z.example", SPAM["links"] * 2000), (None, SPAM["links"])])]
    rows.append(rows[0])  # a repeated row
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], "row_id long, site string, content string, phrase string, _row string")
    got = sorted(r["row_id"] for r in stuffed_pages(df, "row_id", "site", "content").collect())
    assert got == [0, *range(len(spam)), len(rows) - 3, len(rows) - 2]
    alone = df.withColumn("site", F.lit("one.example"))
    assert stuffed_pages(alone, "row_id", "site", "content").count() == 0  # nothing is replicated on other hosts
    assert stuffed_pages(df.limit(0), "row_id", "site", "content").count() == 0


# cuts


def corpus(n=700):
    rnd = random.Random(8)
    s = ["The battery of this phone lasts for two days, and it charges in an hour.", "We used it at home and in the office for a week.", "Ask the seller about the plan; the answer is rarely on the box.", "It is not perfect, but the price is fair for what you get.", "The manual explains the set-up in five short steps."]
    return ["\n".join([" ".join(rnd.choice(s) for _ in range(rnd.randint(2, 5))) for _ in range(rnd.randint(1, 4))] + rnd.choice([[], ["© 2024 Acme. All rights reserved."], ["Home | Blog | Contact"]])) for _ in range(n)]


def test_held_out_accuracy():
    texts = corpus()
    w = fit(artificial([(t, len(t), t.rsplit("\n", 1)[-1][:1] in "©H") for t in texts[:500]]))
    held = artificial([(t, len(t), t.rsplit("\n", 1)[-1][:1] in "©H") for t in texts[500:]], seed=99)
    right = [(w[f].sum() + w[-1] >= 0) == bool(y) for f, y in held]
    assert sum(right) / len(right) > 0.93
    assert features("x", None, False, False) and fit([])[-1] < 0


def test_prior_shift():
    """Log-odds learned at one half are shifted to the share that the scores show."""
    rnd = np.random.default_rng(2)
    truth = rnd.random(40_000) < 0.05
    x = rnd.normal(np.where(truth, 2.0, -2.0), 1.0)  # log-odds at one half: 4x
    bins = [(z, int(c)) for z, c in zip(*np.unique(np.round(4 * x, 1), return_counts=True))]
    share = 1 / (1 + np.exp(-prior_shift(bins, 0.5)))
    assert abs(share - 0.05) < 0.005
    assert prior_shift([], 0.5) == prior_shift(bins, 0.0) == 0.0


def test_cut_columns(spark):
    texts = corpus(300)
    rows = [(i, f"p{i}", t, len(t)) for i, t in enumerate(texts)]
    rows += [(1000, "p0", texts[0][:90], len(texts[0])), (1001, "p1", texts[1][:77], 77), (1002, "p2", None, 5), (1003, "p3", "  ", 5), (1004, "p4", texts[4], len(texts[4]) + 9), (1005, "p4", texts[4], len(texts[4]) + 9)]
    df = spark.createDataFrame([(*r, "s.example", "c") for r in rows], "row_id long, page string, content string, stated int, site string, right string")
    s = score_cuts(df, "row_id", "content", F.col("page"), "stated", "site")
    found = {r["row_id"] for r in s.filter("score >= 0.5").collect()}
    assert {1000, 1001} <= found and not found & {1002, 1003, 1004, 1005} and len(found) < 12
    rate = cut_rates(s, "site").first()
    assert rate["n_rows"] == len(rows) - 2 and 0 < rate["cut_share"] < 0.1
    assert score_cuts(df.limit(0), "row_id", "content", F.col("page"), "stated", "site").count() == 0
