import random

from pyspark.sql import functions as F

from rankweave.llm.copies import _scan, canonical_run, canonical_text, canonical_url, collapsed, copy_membership


def brute(rows):
    first = {}
    for k, i in rows:
        if k is not None and i is not None:
            first[k] = min(first.get(k, i), i)
    return sorted((i, first[k]) for k, i in rows if k is not None and i is not None)


def members(spark, rows, n):
    df = spark.createDataFrame([(k, i, "clash") for k, i in rows], "key string, row_id long, k string")
    return sorted((r["id"], r["first"]) for r in copy_membership(df, "key", "row_id", n).collect())


def test_against_brute_force(spark):
    rnd = random.Random(3)
    for n in (1, 3, 16):
        rows = [(rnd.choice(["hot", "hot", "a", "b", None, f"u{rnd.randint(0, 200)}"]), i) for i in range(3000)]
        assert members(spark, rows, n) == brute(rows)


def test_hot_key_spans_partitions(spark):
    rows = [("hot", i) for i in range(5000)] + [("a", -1), ("z", 9999)]
    got = members(spark, rows, 8)
    assert got == brute(rows)


def test_result_does_not_depend_on_reuse_or_partitions(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot", "a", "b", f"u{rnd.randint(0, 900)}"]), i) for i in range(6000)]
    want = brute(rows)
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            for n in (8, 60, 200):
                assert members(spark, rows, n) == want
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")


def test_scan_over_small_batches():
    """Every cut into batches gives the same runs; edges are only the first and the last run."""
    import pyarrow as pa

    rnd = random.Random(1)
    for _ in range(60):
        keys = sorted(rnd.choice("aabbbcdddddde") for _ in range(rnd.randint(1, 40)))
        ids = list(range(len(keys)))
        batches, at = [], 0
        while at < len(keys):
            n = rnd.randint(0, 4)
            batches.append(pa.RecordBatch.from_arrays([pa.array(keys[at : at + n], pa.string()), pa.array(ids[at : at + n], pa.int64())], names=["k", "id"]))
            at += n
        out = [r for b in _scan(iter(batches)) for r in b.to_pylist()]
        first = {k: keys.index(k) for k in set(keys)}
        assert sorted((r["k"], r["id"], r["first"]) for r in out) == [(k, i, first[k]) for k, i in zip(keys, ids)]
        assert all(r["edge"] for r in out if r["k"] in (keys[0], keys[-1]))


def test_repeats_empty_and_counts(spark):
    assert members(spark, [], 4) == []
    rows = [("a", 1), ("a", 1), ("a", 2), ("b", 3)]
    df = spark.createDataFrame(rows, "key string, row_id long")
    assert sorted((r["first"], r["n_copies"]) for r in collapsed(copy_membership(df, "key", "row_id", 4)).collect()) == [(1, 3), (3, 1)]


def urls(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, u string")
    return [r[0] for r in df.orderBy("i").select(canonical_url(F.col("u"))).collect()]


def test_canonical_urls(spark):
    same = ["https://www.a.example/x/one-two?b=2&a=1", " <HTTP://A.EXAMPLE./X//One_Two/?A=1&B=2&utm_source=z#top> ", "a.example/x/one two?a=1&&b=2&ref=q", "WWW.a.example/x/one%20two?a=1&gclid=7&b=2&"]
    assert len(set(urls(spark, same))) == 1
    others = ["a.example/x/one-two?a=2&b=1", "a.example/one-two/x?a=1&b=2", "a.example/x/one-two3?a=1&b=2", "a.example/x/one-two?a=1", "a.example/x/one-two", "b.example/x/one-two?a=1&b=2"]
    assert len(set(urls(spark, [same[0], *others]))) == len(others) + 1


def test_canonical_runs_and_texts(spark):
    df = spark.createDataFrame([("P0001_R03", "Ab,  c!")], "r string, t string")
    assert df.select(canonical_run(F.col("r")), canonical_text(F.col("t"))).first()[:] == ("p0001_r3", "ab c")
