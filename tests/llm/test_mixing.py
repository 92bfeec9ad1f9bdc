import random

from rankweave.llm.mixing import leaf_budgets, node_report, selection, share_report


def frames(spark, rows, targets):
    rows = [r if len(r) == 4 else (*r[:2], "h.example", r[2]) for r in rows]
    sized = spark.createDataFrame([(i, s, l, d, n, "x") for i, (s, l, d, n) in enumerate(rows)], "doc_id long, source string, lang string, site string, n_tokens long, budget string")
    t = spark.createDataFrame([(*x, "x") for x in targets], "source string, target_share double, max_repeats int, lang string")
    return sized, t


def report(spark, rows, targets, total=None, seed=0):
    sized, t = frames(spark, rows, targets)
    taken = selection(sized, leaf_budgets(sized, t, total), "doc_id", seed)
    return {r["source"]: r.asDict() for r in share_report(taken, sized, t).collect()}, sorted((r["doc_id"], r["uses"]) for r in taken.collect())


def corpus(n=3000):
    rnd = random.Random(1)
    return [(rnd.choice(["a", "a", "a", "b", "c", "other", None]), rnd.choice(["en", "en", "de", None]), rnd.randint(0, 60)) for _ in range(n)]


TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("none", 0.1, 2)]


def test_shares_reached(spark):
    r, taken = report(spark, corpus(), TARGETS)
    assert r["none"]["share"] == 0
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(r[s]["share"] - w / 0.9) < 0.01
    assert "other" not in r and all(r[s]["most_uses"] <= m for s, _, m in TARGETS)
    assert taken == report(spark, corpus(), TARGETS)[1]  # seeded
    assert taken != report(spark, corpus(), TARGETS, seed=1)[1]


def test_shortage_goes_to_siblings(spark):
    rows = [("a", "en", 10)] * 100 + [("b", "en", 10)] * 10
    r, _ = report(spark, rows, [("a", 0.5, 1), ("b", 0.5, 2)], total=1000)
    assert r["b"]["used_tokens"] == 200 and r["b"]["most_uses"] == 2  # all it may give
    assert r["a"]["used_tokens"] == 800
    r, _ = report(spark, rows, [("a", 0.5, 1), ("b", 0.5, 2)], total=10**6)
    assert (r["a"]["used_tokens"], r["b"]["used_tokens"]) == (1000, 200)


def test_shortage_stays_below_its_parent(spark):
    """A language that is short is made up by a language of its source, a domain by one of its language; other sources keep their budgets."""
    rows = [("a", "en", "x.example", 10)] * 900 + [("a", "de", "x.example", 10)] * 9 + [("a", "en", "y.example", 10)] * 4 + [("b", "en", "x.example", 10)] * 500
    sized, t = frames(spark, rows, [("a", 0.5, 1), ("b", 0.5, 1)])
    b = leaf_budgets(sized, t, 8000)
    n = {(r["source"], r["lang"]): r for r in node_report(b, 2).collect()}
    assert n["a", "de"]["short"] and n["a", "de"]["budget"] == 90  # all it has, less than its weight gives
    assert abs(n["a", "en"]["budget"] - (4000 - 90)) < 1e-6 and abs(n["b", "en"]["budget"] - 4000) < 1e-6
    leaves = {(r["source"], r["lang"], r["site"]): r["budget"] for r in b.collect()}
    assert abs(leaves["a", "en", "y.example"] - 40) < 1e-6 and abs(leaves["a", "en", "x.example"] - (4000 - 90 - 40)) < 1e-6
    used = share_report(selection(sized, b, "doc_id"), sized, t).collect()
    assert {r["source"]: r["used_tokens"] for r in used} == {"a": 4000, "b": 4000}


def test_many_small_leaves_miss_by_half_a_row(spark):
    rnd = random.Random(9)
    rows = [("a", rnd.choice(["en", "de", "fr"]), f"s{rnd.randint(0, 150)}", rnd.randint(50, 400)) for _ in range(900)] + [("b", None, None, 100)] * 400
    r, taken = report(spark, rows, [("a", 0.6, 2), ("b", 0.4, 2)], total=60_000)
    assert abs(r["a"]["used_tokens"] - 36_000) <= 200 and abs(r["b"]["used_tokens"] - 24_000) <= 50
    assert taken == report(spark, rows, [("a", 0.6, 2), ("b", 0.4, 2)], total=60_000)[1]
    assert all(u <= 2 for _, u in taken)


def test_levels_against_iteration(spark):
    """Closed-form levels equal water filling by iteration."""
    rnd = random.Random(4)
    for _ in range(3):
        rows = [(f"s{i}", "en", rnd.randint(1, 500)) for i in range(6)]
        targets = [(f"s{i}", rnd.random(), rnd.randint(1, 3)) for i in range(6)]
        total = rnd.randint(50, 3000)
        caps, w = [n * m for (_, _, n), (_, _, m) in zip(rows, targets)], [t[1] for t in targets]
        got, left, open_ = [0.0] * 6, float(min(total, sum(caps))), set(range(6))
        while left > 1e-9 and open_:
            share = {i: left * w[i] / sum(w[j] for j in open_) for i in open_}
            for i in list(open_):
                give = min(share[i], caps[i] - got[i])
                got[i] += give
                left -= give
                if caps[i] - got[i] < 1e-9:
                    open_.discard(i)
        sized, t = frames(spark, rows, targets)
        budgets = {r["source"]: r["budget"] for r in leaf_budgets(sized, t, total).collect()}
        assert all(abs(budgets[f"s{i}"] - got[i]) < 1e-6 for i in range(6))


def test_empty_and_blank(spark):
    assert report(spark, [], TARGETS)[1] == []
    assert report(spark, corpus(50), [])[1] == []
    assert report(spark, [("a", None, 0), ("a", None, 5)], [("a", 1.0, 1), (None, 0.2, 1), ("b", 0.0, 1)])[1] == [(1, 1)]
