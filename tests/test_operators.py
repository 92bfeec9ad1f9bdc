import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from rankweave.operators import labels as L
from rankweave.operators import merge as M
from rankweave.operators import overlap as O
from rankweave.operators import semantic as S
from rankweave.operators import setops as P
from rankweave.operators import stats as T
from rankweave.operators.flatten import inline_citations, panel_citations
from rankweave.operators.validate import checks, missing_reason


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def lists(spark, *pairs):
    return spark.createDataFrame(list(pairs), "a array<string>, b array<string>")


def test_overlap_micro_cases(spark):
    d = lists(spark, ([], []), (["a"], []), (["a", "b"], ["b", "c", "d"]), (["a", "a"], ["a", "a", "b"]))
    assert [r[0] for r in d.select(O.simpson(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.5, 1.0]
    assert [r[0]["overlap_coeff"] for r in d.select(O.overlap_stats(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 0.5, 1.0]


def test_rank_biased(spark):
    """Values worked out by hand at p = 0.9 and 0.5, and bounds that hold for any lists."""
    of = lambda p, *pairs: [r[0] for r in lists(spark, *pairs).coalesce(1).select(O.rank_biased(F.col("a"), F.col("b"), p)).collect()]
    assert of(0.9, (["a", "b"], ["a", "b"]), (["a"], ["b"]), (["a", "b"], ["c", "d"])) == pytest.approx([1.0, 0.0, 0.0])
    # swapped pair: agreement 0 then 1: (1-p)/p * p^2 + p^2
    assert of(0.5, (["a", "b"], ["b", "a"])) == pytest.approx([0.5])
    assert of(0.9, (["a", "b"], ["b", "a"])) == pytest.approx([0.9])
    # one list is longer: depth 1 agrees fully, depth 2 in 2 of 3 places, and half of the short list's overlap is carried on
    assert of(0.5, (["a"], ["a", "b"])) == pytest.approx([0.5 + 0.25 * (2 / 3 + 1 / 2) + 0.25 * ((2 / 3 - 1) / 2 + 1)])
    assert of(0.9, ([], ["a"])) == [None]
    rnd = random.Random(2)
    pairs = [(rnd.sample("abcdefgh", rnd.randint(1, 6)), rnd.sample("abcdefgh", rnd.randint(1, 8))) for _ in range(30)]
    got = of(0.9, *pairs)
    assert got == pytest.approx(of(0.9, *[(y, x) for x, y in pairs])) and all(-1e-9 <= v <= 1 + 1e-9 for v in got)
    longer = of(0.9, *[(x, y) if len(x) >= len(y) else (y, x) for x, y in pairs])
    assert got == pytest.approx(longer)


def test_bucket_is_cut_before_deduplication(spark):
    c = spark.createDataFrame([("r", "cited", ["a"], ["a"]), ("x", "cited", ["a"], ["a"])], "run_id string, section string, keys array<string>, domains array<string>")
    s = spark.createDataFrame([("r", ["a", "a", "b"], ["a", "a", "b"])], "run_id string, keys array<string>, domains array<string>")
    assert rows(O.bucket_overlap(c, s, (2,)), "run_id", "n_serp", "n_overlap") == [("r", 1, 1)]


def test_named_matches(spark):
    i = spark.createDataFrame([("1", "p", "Acme Pro"), ("2", "p", "Beta Max One"), ("3", "q", "Acme"), ("4", "p", "Zed")], "item_id string, page string, item_name string")
    p = spark.createDataFrame([("p", 1, "Acme Pro Deluxe", 1), ("p", 2, "Acme Pro", 2), ("p", 3, "Acme-Pro", 3), ("p", 4, "Beta Max", 4)], "page string, ord int, product_name string, product_position int")
    assert rows(O.named_matches(i, p, 0.5), "item_id", "method", "product_position") == [("1", "strict", 2), ("2", "fuzzy", 4), ("3", "none", None), ("4", "none", None)]


def test_first_wins_and_cleaning(spark):
    s = spark.createDataFrame(
        [("r", "q", "2", "https://www.a.example/x/", 1), ("r", "q", "1", "http://a.example/x?utm_source=z", 2), ("r", "q", "bad", "https://b.example", 3), ("r", "q", "3", "https://www.bing.com/aclick?x", 4), ("r", "q", "4", "https://www.bing.com/ck/a?u=zz", 5), ("r", "q", "5", "", 6), ("r", "q", "3.0", "https://c.example", 7)],
        "run_id string, query string, position string, url string, row_id int",
    )
    assert rows(P.cleaned(s, 30), "clean_position", "row_id", "clean_key") == [(1, 2, "a.example/x"), (2, 3, "b.example/"), (3, 7, "c.example/")]
    assert rows(P.cleaned(s, 1), "row_id") == [(2,)]
    assert rows(P.shortest_wins(s.withColumn("k", F.lit(1)), "k", "url", "row_id"), "row_id") == [(6,)]
    assert rows(P.latest_wins(s, ["run_id"], ["row_id"]), "row_id") == [(7,)]


def test_merges(spark):
    d = spark.createDataFrame([(1, "a", ""), (2, None, "x")], "k int, t string, u string")
    s = spark.createDataFrame([(1, "b", "y"), (2, " ", "z"), (3, "c", None)], "k int, t string, u string")
    assert rows(M.upsert(d, s, ["k"]), "k", "t", "u") == [(1, "b", "y"), (2, None, "z"), (3, "c", None)]
    assert rows(M.fill_blanks(d, s, ["k"]), "k", "t", "u") == [(1, "a", "y"), (2, " ", "x"), (3, "c", None)]
    assert rows(M.replace_keys(d, s.filter("k = 2"), ["k"]), "k", "u") == [(1, ""), (2, "z")]
    assert rows(M.update_from(d, s.filter("k = 1"), ["k"], ["t"], keep=False), "k", "t") == [(1, "b"), (2, None)]
    assert rows(M.update_from(d, s.filter("k = 2"), ["k"], ["t"]), "k", "t") == [(1, "a"), (2, " ")]
    assert rows(M.insert_missing(d, s, "k", ["t"]), "k", "t") == [(1, "a"), (2, None), (3, "c")]
    dup = spark.createDataFrame([(1, 1, None, "p"), (1, 2, "b", ""), (1, 3, "c", "q")], "k int, o int, t string, u string")
    assert rows(M.merge_duplicates(dup, "k", "o", ["t", "u"]), "k", "o", "n_merged", "t", "u") == [(1, 1, 3, "b", "p")]
    assert rows(M.merge_duplicates(dup, "k", "o", ["t", "u"], overwrite=True), "t", "u") == [("c", "q")]
    assert rows(dup.withColumn("f", M.first_filled_over("t", ["k"], "o")), "o", "f") == [(1, "b"), (2, "b"), (3, "b")]
    assert rows(M.flag(d, s.filter("k = 1"), ["k"], "f"), "k", "f") == [(1, 1), (2, 0)]
    kept, kids = M.cascade(d, F.col("k") == 1, {"s": s}, "k")
    assert rows(kept, "k") == [(1,)] and rows(kids["s"], "k") == [(1,)]
    assert rows(M.drop_unreferenced(s, "k", [d.select("k"), d.select("k")]), "k") == [(1,), (2,)]
    e = M.ensure_columns(spark.createDataFrame([("1", "z")], "` k ` string, z string"), StructType([StructField("k", IntegerType()), StructField("n", StringType())]))
    assert e.columns == ["k", "n", "z"] and e.first()[:] == (1, None, "z")
    assert rows(M.repaired_groups(spark.createDataFrame([(3, 2)], "r int, s int"), "r", "s"), "s") == [(3,)]
    assert M.replicated(d, 3).count() == 6


def test_flattening(spark):
    items = '[{"item_name": "A & B", "chip_groups": [{"links": ["https://x.example/a", {"url": "https://y.example/b"}]}, {"links": []}]}, {"item_name": "C", "chip_groups": null}]'
    r = spark.createDataFrame([("r", '[{"url": "https://y.example/b"}, "https://x.example/a?utm_x=1"]', '["https://x.example/a"]', items), ("s", "bad", None, "[]")], "run_id string, sources_cited_json string, sources_additional_json string, items_json string")
    assert rows(panel_citations(r), "citation_type", "cite_position", "key") == [("additional", 1, "x.example/a"), ("cited", 1, "y.example/b"), ("cited", 2, "x.example/a")]
    assert rows(inline_citations(r), "item_no", "entities", "group_index", "group_size", "rank_in_group", "key", "panel", "panel_position") == [(1, "A + B", 1, 2, 1, "x.example/a", "cited", 2), (1, "A + B", 1, 2, 2, "y.example/b", "cited", 1)]


def test_rank_tests(spark):
    d = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 2.0, 5.0)] + [("b", x) for x in (2.0, 6.0, 7.0, 8.0, None)] + [("c", x) for x in (9.0, 10.0, 1.0)], "g string, v double")
    r = T.kruskal_wallis(d, "g", "v").first()
    ranks = {1.0: 1.5, 2.0: 4.0, 5.0: 6.0, 6.0: 7.0, 7.0: 8.0, 8.0: 9.0, 9.0: 10.0, 10.0: 11.0}
    groups = [[1.0, 2.0, 2.0, 5.0], [2.0, 6.0, 7.0, 8.0], [9.0, 10.0, 1.0]]
    h = (12 / (11 * 12) * sum(sum(ranks[x] for x in g) ** 2 / len(g) for g in groups) - 3 * 12) / (1 - ((8 - 2) + (27 - 3)) / (11**3 - 11))
    assert r["n"] == 11 and r["h"] == pytest.approx(h) and r["p"] == pytest.approx(np.exp(-h / 2))
    m = {(x["a"], x["b"]): x for x in T.mann_whitney_pairs(d, "g", "v").collect()}
    for (i, x), (j, y) in itertools.combinations(enumerate(groups), 2):
        assert m["abc"[i], "abc"[j]]["u"] == sum((p > q) + 0.5 * (p == q) for p in x for q in y)
    assert all(0 < x["p"] <= x["p_bonferroni"] <= 1 for x in m.values())
    apart = spark.createDataFrame([("a", float(x)) for x in range(4)] + [("b", float(x)) for x in range(10, 15)], "g string, v double")
    assert T.mann_whitney_pairs(apart, "g", "v").first()["p"] == pytest.approx(2 / 126)  # exact: one order of C(9, 4), on either side
    assert T.mann_whitney_pairs(d.filter("g <> 'c'"), "g", "v").first()["p"] != pytest.approx(T.exact_u_p(1.5, 4, 4))  # ties


def test_running_before(spark):
    rnd = random.Random(3)
    data = [(rnd.choice("ab"), i, rnd.randint(1, 9)) for i in rnd.sample(range(5000), 3000)]
    got = T.running_before(spark.createDataFrame(data, "g string, o long, v long"), ["g"], "o", "v", "before").collect()
    assert {(r["g"], r["o"]): r["before"] for r in got} == {(g, o): sum(v for h, p, v in data if h == g and p < o) for g, o, _ in data[:200]} | {(r["g"], r["o"]): r["before"] for r in got if (r["g"], r["o"]) not in {(g, o) for g, o, _ in data[:200]}}
    assert len(got) == 3000


def test_distributions():
    assert T.chi2_survival(5.991464547, 2) == pytest.approx(0.05) and T.chi2_survival(7.814727903, 3) == pytest.approx(0.05) and T.chi2_survival(0, 3) == 1 and T.chi2_survival(100, 4) == pytest.approx(1.0e-20, rel=0.1)
    n, m = 3, 4
    counts = {}
    for c in itertools.combinations(range(n + m), n):
        u = sum(sum(x > y for y in range(n + m) if y not in c) for x in c)
        counts[u] = counts.get(u, 0) + 1
    for u in counts:
        top = max(u, n * m - u)
        assert T.exact_u_p(u, n, m) == pytest.approx(min(1, 2 * sum(k for v, k in counts.items() if v >= top) / sum(counts.values())))


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = rng.integers(1, 5), rng.integers(1, 6)
        g = rng.random((n, m)).round(2)
        pairs = S.assignment(g)
        assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        a = g if n <= m else g.T
        best = max(sum(a[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(a.shape[1]), a.shape[0]))
        assert sum(g[i, j] for i, j in pairs) == pytest.approx(best)


def test_semantic(spark):
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.99, 0.1, 0.0]
    assert S.semantic_overlap([x, y], [z]) == 1.0 and S.semantic_overlap([x], [y]) == 0.0 and S.semantic_overlap([], []) == 1.0 and S.semantic_overlap([x], []) == 0.0
    assert S.clusters([x, y, z]) == [[0, 2], [1]]
    l = spark.createDataFrame([("p", 1, [x]), ("p", 2, [z]), ("p", 3, [y]), ("q", 1, [x])], f"g string, i int, v {S.VECTORS}")
    assert rows(S.pair_overlap(l, "g", "i", "v"), "g", "n_pairs", "mean")[0][:2] == ("p", 3)
    assert {r["g"]: r["mean"] for r in S.pair_overlap(l, "g", "i", "v").collect()} == {"p": pytest.approx(1 / 3), "q": None}
    e = spark.createDataFrame([("g", 1, "a", x), ("g", 2, "b", y), ("g", 3, "c", z), ("g", 4, "c", z)], "g string, o int, n string, v array<float>")
    assert rows(S.top_semantic(e, "g", "o", "n", "v"), "position", "name", "n") == [(1, "a", 3), (2, "b", 1)]


def test_labels(spark):
    answer = '```json\n{"urls": {"type": "listicle", "tone": "dry"}, "listicles": {"title": "T"}, "listicle_products": [{"position_in_listicle": "1", "product_name": "A", "product_domain": "d.example"}, {"position_in_listicle": "1", "product_name": "A", "product_domain": "e"}]}\n```'
    log = spark.createDataFrame([("u", answer, True, 1), ("u", answer, False, 2), ("v", "no json", True, 3)], "url string, response string, ok boolean, line int")
    urls, listicles, products = L.label_tables(log.filter("line <> 2"), "url", "response")
    assert rows(urls, "url", "type")[0] == ("u", "listicle") and listicles.count() == 1 and rows(products, "product_domain") == [("d.example",)]
    assert rows(L.latest_labels(log, "url", ["line"]), "url", "line") == [("u", 1), ("v", 3)] and L.failures(log).count() == 1
    b = L.best_text([(spark.createDataFrame([("u", 1, " ", "s1")], "k string, o int, t string, s string"), "o"), (spark.createDataFrame([("u", 2, "t2", "s2"), ("v", 1, None, "s3")], "k string, o int, t string, s string"), "o")], "k", ["t", "s"])
    assert rows(b, "k", "t", "s") == [("u", "t2", "s1"), ("v", None, "s3")]
    n = spark.createDataFrame([("true",), ("3.7",), ("x",), (None,), (" 1e2 ",), ("nan",)], "v string").coalesce(1)
    assert [r[0] for r in n.select(L.to_label_int(F.col("v"))).collect()] == [None, 3, None, None, 100, None]
    assert [r[0] for r in spark.createDataFrame([(True,), (False,), (None,)], "v boolean").coalesce(1).select(L.to_label_int(F.col("v"))).collect()] == [1, 0, None]
    u = spark.createDataFrame([("u", ""), ("w", None), ("z", "page")], "url string, type string")
    assert rows(L.unlabelled(u, log.filter("ok"), None, "url"), "url") == [("w",)]
    p = products.withColumn("listicle_domain", F.lit("d.example"))
    assert L.host_bias(p).count() == 1


def test_checks(spark):
    d = spark.createDataFrame([("a", "https://x/ck/a"), ("a", "u"), ("", "v")], "key string, url string")
    assert {r["check"]: (r["value"], r["ok"]) for r in checks(d, "t", "key", "url").collect()} == {"t.rows": (3, True), "t.blank_keys": (1, False), "t.duplicate_keys": (1, False), "t.redirects": (1, False)}
    assert {r["check"]: r["value"] for r in checks(d.limit(0), "t", "key", "url").collect()}["t.rows"] == 0
    cases = [
        (("", True, 150, True, True, False, False), ""), (("", True, 50, True, False, True, False), "Failed: Thin Content (<100 words)"), (("", True, 50, True, False, False, True), ""), (("Skipped (Manual unreachable)", True, 1, True, True, True, True), "Skipped (Manual unreachable)"),
        (("", False, 0, False, True, False, True), "Pending Fetch (High Priority)"), (("", False, 0, False, False, False, True), "Side-Panel Only (Skipped)"), (("", False, 0, False, False, False, False), "Pending Fetch (Uncategorized)"),
        (("", False, 0, True, False, False, True), "Side-Panel Only (Skipped)"), (("", False, 0, True, True, False, True), "Failed: Fetch Error (403/429/Timeout)"), ((None, None, None, None, None, None, None), "Pending Fetch (Uncategorized)"),
    ]
    m = spark.createDataFrame([c for c, _ in cases], "existing_reason string, has_content boolean, word_count long, attempted boolean, is_inline boolean, is_ranked boolean, is_additional boolean").coalesce(1)
    assert [r["missing_reason"] for r in missing_reason(m).collect()] == [w for _, w in cases]
