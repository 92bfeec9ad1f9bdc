"""Phrases of stuffed pages: all of every page, as written."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from rankweave.llm.spam import HOSTS, KEYED, STITCHED, host_phrases, phrase_hosts, phrases, shingles, stuffed_pages

NAMES = "amber basil cedar dahlia elder fennel ginger hazel indigo jasmine kelp lilac maple nettle olive pepper quince rose sage thyme umber violet willow yarrow zinnia aster birch clover daisy ebony".split()
LISTED = " ".join(NAMES) + " " + "phone sale " * 5 + "phone"


def fives(text):
    words = text.lower().split()
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def test_phrases_as_written_equal_brute_force():
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("red blue the of phone bike 7 8 x1 x2".split()) for _ in range(rnd.randint(0, 25))) for _ in range(50)]
    size, page, words, keyed, patterns = shingles(texts)
    want = [(i, f) for i, t in enumerate(texts) for f in fives(t)]
    assert page.tolist() == [i for i, _ in want] and size.sum() == len(want) and keyed.sum() == len(patterns)
    pairs = set(zip(words.tolist(), (f for _, f in want)))
    assert len(pairs) == len({f for _, f in want}) == len(set(words.tolist()))  # equal hashes where the words are equal


def test_hosts_of_every_phrase(spark):
    """Phrases of ordinary pages count as well: none of these is a keyword phrase."""
    rnd = random.Random(5)
    rows = [(rnd.choice("abcd"), " ".join(rnd.choice(["one two three four five six", "we went to the old house", "rain fell on a green hill"]) + f" {x}" for x in rnd.sample(NAMES, 2))) for _ in range(60)]
    rows += [rows[0], (None, rows[1][1]), (None, None), ("a", ""), ("a", "too short")]
    want = defaultdict(set)
    for h, t in rows:
        for f in fives(t or ""):
            want[f].add(h)
    df = spark.createDataFrame(rows, "host string, content string").repartition(5)
    forms = sorted(len(hosts) for hosts in want.values() if len(hosts) >= HOSTS)
    by_words = {w for _, t in rows for w in shingles([t or ""])[2].tolist()}
    got = [r["n_hosts"] for r in phrase_hosts(host_phrases(df, "host", "content")).collect() if r["phrase"] in by_words]
    assert sorted(got) == forms


def test_phrases_as_written_decide(spark):
    """List text that another host has word for word, of which keyword phrases alone are too few."""
    size, _, found = phrases([LISTED])
    assert KEYED * size[0] <= len(found) < STITCHED * size[0]
    own = " ".join(n + "x" for n in NAMES) + LISTED.removeprefix(" ".join(NAMES))  # its words are on no other host
    df = spark.createDataFrame([(1, "a.example", LISTED), (2, "b.example", LISTED), (3, "c.example", own)], "row_id long, site string, content string")
    got = {r["row_id"]: r["replicated"] for r in stuffed_pages(df, "row_id", "site", "content").collect()}
    assert got == {1: 1.0, 2: 1.0}
    assert stuffed_pages(df.withColumn("site", F.lit("one.example")), "row_id", "site", "content").count() == 0
