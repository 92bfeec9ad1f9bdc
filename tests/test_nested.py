import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from rankweave.operators.nested import json_triples, path_groups, pivot_group, triples_of

JSON = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=12)


def flat(x, path="$", at=()):
    """Triples of a value, by the definition."""
    if isinstance(x, dict):
        out = [(path, at, "object", None)]
        for k, v in x.items():
            out += flat(v, path + "." + re.sub(r"([.\[\]\\])", r"\\\1", k), at)
        return out
    if isinstance(x, list):
        return [t for i, v in enumerate(x, 1) for t in flat(v, path + "[]", (*at, i))]
    kind = "string" if isinstance(x, str) else "null" if x is None else "boolean" if isinstance(x, bool) else "number"
    return [(path, at, kind, x if kind in ("string", "null") else json.dumps(x))]


@settings(max_examples=300, deadline=None)
@given(JSON)
def test_triples_of_any_value(x):
    assert triples_of(json.dumps(x), frozenset()) == flat(x)
    assert triples_of(json.dumps(x, indent=1, ensure_ascii=False), frozenset()) == flat(x)


BAD = ("", "[", "[1,]", "{1:2}", '{"a" 1}', "[1] x", "nul", '"a', "[1 2]", "}", '{"a":1,}', "NaN", "01", "-", "1.", "[,1]", '{"a":}', '"\x01"', "\ufeff[1]", "[1}", '{"a":1]', "'a'", "truex")


def test_invalid_and_deep():
    for bad in BAD:
        assert triples_of(bad, frozenset()) == []
        try:
            json.loads(bad)
        except ValueError:
            continue
        assert bad == "NaN"
    assert triples_of("[" * 50000 + "]" * 50000, frozenset()) == []
    assert triples_of('{"a":' * 3000 + "1" + "}" * 3000, frozenset())[-1][2:] == ("number", "1")
    assert triples_of(None, frozenset()) == triples_of(" ", frozenset()) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='[]{}",:01-.eEtrufalsn \\', max_size=14))
def test_valid_as_json_says(text):
    try:
        want = flat(json.loads(text, parse_int=lambda x: x, parse_float=lambda x: x, parse_constant=lambda x: 1 / 0))
    except (ValueError, ZeroDivisionError):
        want = []
    got = triples_of(text, frozenset())
    assert [t[:2] + t[3:] for t in got] == [t[:2] + t[3:] for t in want]


def test_numbers_keys_and_repeats():
    big = "9" * 5000
    got = triples_of('{"n": [1.10, 1e400, %s, 0.1234567890123456789012345]}' % big, frozenset())
    assert [v for *_, v in got[1:]] == ["1.10", "1e400", big, "0.1234567890123456789012345"]
    paths = [p for p, *_ in triples_of('{"a.url": 1, "a": {"url": 2}, "b[]": 3, "c\\\\": 4}', frozenset())]
    assert paths == ["$", "$.a\\.url", "$.a", "$.a.url", "$.b\\[\\]", "$.c\\\\"]
    assert triples_of('{"a": {"x": 1, "y": 2}, "b": 3, "a": [4]}', frozenset()) == [("$", (), "object", None), ("$.b", (), "number", "3"), ("$.a[]", (1,), "number", "4")]


def test_kept_paths_only():
    text = '[{"url": "u", "urls": ["no"], "x": {"url": "no", "deep": [[{}]]}}, "s"]'
    assert triples_of(text, frozenset(["$"]), frozenset(["$[]", "$[].url"])) == [("$[]", (1,), "object", None), ("$[].url", (1,), "string", "u"), ("$[]", (2,), "string", "s")]


REPEATED = {"j": ("$", "$[].g", "$[].g[].links")}


def rows(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, j string, path string")
    return json_triples(df, "id", REPEATED)


def urls(spark, texts):
    t = rows(spark, texts)
    d = pivot_group(t, "id", ["j"], "$[].g[].links[]", {"self": "", "url": ".url"})
    return sorted((r["id"], tuple(r["ordinals"]), r["self"] or r["url"]) for r in d.collect())


def test_links_and_places(spark):
    texts = [
        json.dumps([{"g": [{"links": ["a", None, {"url": "b"}, {"t": 1}]}, {"links": []}]}, 5, {"g": {"links": "c"}}]),
        json.dumps({"g": [{"links": {"url": "d", "x": {"url": "no"}}}]}),
        json.dumps(json.dumps([{"g": json.dumps([{"links": ["e"]}])}])),
        '[{"g": [{"links": ["cut"',
        None,
        "",
        '[{"g": [{"links": ["\\ud800f"]}]}]',
    ]
    got = urls(spark, texts)
    assert got == [
        (0, (1, 1, 1), "a"), (0, (1, 1, 2), None), (0, (1, 1, 3), "b"), (0, (1, 1, 4), None), (0, (3, 1, 1), "c"), (1, (1, 1, 1), "d"), (2, (1, 1, 1), "e"), (6, (1, 1, 1), "?f"),
    ]


def test_groups_empty_and_repeats(spark):
    g = {r["ancestor"]: r["paths"] for r in path_groups(rows(spark, ['[{"a": 1, "g": [{"b": true}]}]'])).collect()}
    assert g == {"$[]": ["$[]", "$[].a"], "$[].g[]": ["$[].g[]", "$[].g[].b"]}
    assert rows(spark, []).count() == 0
    assert len(urls(spark, ['[{"g": [{"links": ["a"]}]}]'] * 2)) == 2


def test_keeps_whole_long_texts(spark):
    long = "x" * 1_000_000
    assert urls(spark, [json.dumps([{"g": [{"links": [long]}]}])]) == [(0, (1, 1, 1), long)]
