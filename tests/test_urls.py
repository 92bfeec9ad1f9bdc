import random
from urllib.parse import parse_qsl, urlencode, urlsplit

import pytest
from pyspark.sql import functions as F

from rankweave.functions import urls as U
from rankweave.functions.hosts import site_of


def values(spark, f, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("u")).alias("x")).collect()]


def key2(u):
    """The rule in plain Python."""
    u = (u or "").strip()
    if not u:
        return ""
    p = urlsplit(u if "://" in u else "https://" + u)
    host = p.netloc.lower()
    host = host[4:] if host.startswith("www.") else host
    path = p.path or "/"
    path = path[:-1] if len(path) > 1 and path.endswith("/") else path
    kept = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in U.ALL_TRACKING]
    q = urlencode(kept)
    return (host + path + ("?" + q if q else "")).lstrip("/")


URLS = [
    "https://www.Example.org/a/b/?utm_source=x&b=2&a=1#top", "http://example.org", "example.org/x?ref=1", "HTTPS://EXAMPLE.org:8080/A/", None, "", "  https://a.example/x  ",
    "https://a.example/?q=a+b&c=%20d&e=", "https://a.example/p?x=1&&y=2", "https://a.example/p?GCLID=1&Utm_Medium=2&z=*~", "https://a.example//b//", "https://a_b.example/x|y",
]


def test_key2_cases(spark):
    assert values(spark, U.url_key2, URLS) == [key2(u) for u in URLS]


def test_key2_on_random_urls(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abz09._~- ") for _ in range(rnd.randint(0, n))).strip()
    urls = []
    for _ in range(400):
        u = rnd.choice(["", "http://", "HTTPS://"]) + rnd.choice(["", "www.", "WWW."]) + rnd.choice(["a.org", "B.Example", "x.y.example:80"])
        u += "".join("/" + word(4) for _ in range(rnd.randint(0, 3)))
        if rnd.random() < 0.6:
            u += "?" + "&".join(rnd.choice(["a", "b", "utm_x", "Ref", "gclid", "hl"]) + rnd.choice(["", "=", "=1", "=a+b", "=%20c", "=é"]) for _ in range(rnd.randint(1, 4)))
        urls.append(u + rnd.choice(["", "#", "#f?x=1"]))
    assert values(spark, U.url_key2, urls) == [key2(u) for u in urls]


@pytest.mark.parametrize(
    ("name", "url", "want"),
    [
        ("url_key3", "https://a.example/x?spm=1&ref=2", "a.example/x?spm=1"),
        ("url_key4", "https://a.example:81/x/?ref=2&b=1", "a.example/x?b=1"),
        ("url_key5", "https://a.example:81/x?ref=2&mc_cid=3", "a.example/x?ref=2"),
        ("url_key6", "https://apps.microsoft.com/x?hl=en&test_uuid=4&b=1", "apps.microsoft.com/x?b=1"),
        ("url_key7", "https://www.A.example/X/?test_variant=1#y", "https://www.a.example/x"),
        ("url_key8", "HTTP://www.A.example/X/?b=1", "a.example/x/?b=1"),
        ("url_key9", "https://www.A.example/X//?b=1", "https://www.a.example/x"),
        ("url_key10", "https://www.A.example/X//?b=1", "a.example/x"),
        ("clean_url", "https://A.example/x?utm_source=1&b=2#c", "https://A.example/x?b=2#c"),
        ("clean_url", "https://a.example/?source=1&ref=2&msclkid=3&spm=4", "https://a.example/?msclkid=3&spm=4"),
        ("clean_url", "a.example/?ref=2", "a.example/?ref=2"),
        ("domain1", "WWW.A.example:8080/x", "a.example:8080"),
        ("domain2", "a.Example/x", "a.Example/x"),
        ("domain3", "a.example/x", ""),
        ("domain3", "https://WWW.A.example/x", "www.a.example"),
        ("domain4", "www.A.example/x", "a.example"),
        ("domain5", "https://www.A.example/x", "A.example"),
        ("domain6", "https://www.A.example/x", "www.A.example"),
        ("domain7", "https://www.A.example:1/x", "a.example"),
        ("domain8", "https://my.www.a.example/x", "my.a.example"),
        ("domain8", "no url", "no url"),
        ("domain9", "https://x.y.a.example/z", "a.example"),
        ("domain10", "https://apps.microsoft.com/x", "com"),
        ("domain10", "play.a.example:8080/x", "a.example:8080"),
        ("domain11", "www.www.a.example", "a.example"),
    ],
)
def test_variants(spark, name, url, want):
    assert values(spark, getattr(U, name), [url]) == [want]


def test_redirects(spark):
    import base64

    coded = base64.urlsafe_b64encode(b"https://www.target.example/a?utm_x=1&b=2").decode().rstrip("=")
    r = f"https://www.bing.com/ck/a?x=1&u=a1{coded}&ntb=1"
    assert values(spark, U.decode_redirect, [r, "https://www.bing.com/ck/a?u=a1L3ZpZGVvcw", "https://x.example/", None]) == ["https://www.target.example/a?utm_x=1&b=2", "", "https://x.example/", ""]
    assert values(spark, U.url_key1, [r]) == ["target.example/a?b=2"]
    bing = "https://www.bing.com/x?u="
    got = values(spark, U.decode_any, [r, bing + "https%3A%2F%2Fa.example%2F%3Fref%3D1%26b%3D2", bing + "zz" + coded, bing + b"https://a.example".hex(), "https://x.example/?u=https%3A%2F%2Fa.example", "https://www.bing.com/ck/x/u=a1" + coded, bing + "L3ZpZGVvcw"])
    assert got == ["https://www.target.example/a?utm_x=1&b=2", "https://a.example/?b=2", "https://www.target.example/a?utm_x=1&b=2", "https://a.example", None, "https://www.target.example/a?utm_x=1&b=2", None]


def test_hosts_hashes_and_text(spark):
    assert values(spark, site_of, [" <Https://WWW.A.example./x>", "a.example/x", "//b.example:80", "", None]) == ["a.example", "a.example", "b.example", None, None]
    assert values(spark, U.short_hash, ["abc"]) == ["ba7816bf8f01cfea"]
    assert values(spark, U.urls_in, ["see https://a.example/x, and (https://a.example/x) https://b.example. [HTTPS://c.example/?a=1]!", None]) == [["https://a.example/x", "https://b.example", "HTTPS://c.example/?a=1"], []]
