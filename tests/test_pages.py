import pytest
from pyspark.sql import functions as F

from trawlnet.functions import html as H
from trawlnet.functions.charsets import codec_of, content_type, decode_body, prescan
from trawlnet.functions.patterns import check_regex, glob_regex, passes
from trawlnet.functions.robots import parse_robots, robots_allowed, sitemaps_in_scope
from trawlnet.functions.sitemaps import decode_sitemap, lastmod_utc, parse_sitemap_xml, traverse
from trawlnet.functions.text import error_group, js_number, js_number_column, pretty_json, retry_after_ms

BASE = "https://example.com/dir/page"


@pytest.mark.parametrize(
    ("page", "css", "want"),
    [
        ('<a href="b">B</a><a href="https://o.dev/c">', "a", ["https://example.com/dir/b", "https://o.dev/c"]),
        ('<a href="?a=1&amp;b=2"><a href="/q?x=1&copy=2">', "a", ["https://example.com/dir/page?a=1&b=2", "https://example.com/q?x=1&copy=2"]),
        ('<a href=""><a><a href="   ">', "a", ["https://example.com/dir/page"]),
        ('<a href="x"><base href="https://cdn.dev/b/">', "a", ["https://cdn.dev/b/x"]),
        ('<script>"<a href=/s>"</script><!-- <a href="/c"> --><a href="/r">', "a", ["https://example.com/r"]),
        ('<template><a href="/t"></template><noscript><a href="/n"></noscript>', "a", ["https://example.com/t", "https://example.com/n"]),
        ('<A HREF="/u"><svg><a xlink:href="/x"></svg>', "a", ["https://example.com/u"]),
        ('<nav><a href="/n"></nav><a href="/m">', "nav a", ["https://example.com/n"]),
        ('<a rel="next" href="/a"><link rel=next href="/l">', "[rel=next]", ["https://example.com/a", "https://example.com/l"]),
        ('<p><a href="/1"></p><p class=x></p><p><a href="/2"></p>', "p.x + p a", ["https://example.com/2"]),
        ("", "a", []),
    ],
)
def test_links(page, css, want):
    assert H.links(page, css, BASE) == want


def test_documents():
    d = H.document("<html><title> T &amp; x </title><ul><li>a<li>b</ul><p id=p>one<p>two<br>x</html>")
    assert [e.text for e in d.select("li")] == ["a", "b"]
    assert [e.text for e in d.select("p:not(#p)")] == ["twox"]
    assert d.select("li:nth-child(2), li:first-child")[0].text == "a"
    assert d.select("ul:has(li)")[0].html == "<ul><li>a</li><li>b</li></ul>"
    assert H.title("<title> T &amp; x </title>") == "T & x" and H.title("<p>") is None
    with pytest.raises(ValueError):
        H.compile_selector("a[")


def test_text_functions():
    assert [js_number(x) for x in ("", " 0x1A ", "1e3", "inf", "1d", "-Infinity", ".5")] == [0.0, 26.0, 1000.0, None, None, float("-inf"), 0.5]
    assert [retry_after_ms(x, 0) for x in ("5", "0", "1.5", "-1", "", "abc", "Thu, 01 Jan 1970 00:00:10 GMT", None)] == [5000, None, None, None, None, None, 10000, None]
    assert pretty_json('{"a":[1,{}],"b":1e21,"c":1e-07,"d":"é"}') == '{\n  "a": [\n    1,\n    {}\n  ],\n  "b": 1e+21,\n  "c": 1e-7,\n  "d": "é"\n}'
    assert codec_of("latin1") == "cp1252" and codec_of("nope") is None


def test_native_text(spark):
    df = spark.createDataFrame([("",), ("0x1A",), ("inf",), (None,), ("1e3",)], "x string")
    assert [r[0] for r in df.select(js_number_column(F.col("x"))).collect()] == [0.0, 26.0, None, None, 1000.0]
    one = spark.range(1).select(error_group(F.lit("a 12 b\nc")).alias("g"), content_type(F.lit('Text/HTML; Charset="X"')).alias("c"), content_type(F.lit(None).cast("string")).alias("n"), decode_body(F.encode(F.lit("é"), "UTF-8"), F.lit("latin1")).alias("d")).first()
    assert one.g == "a _ b" and tuple(one.c) == ("text/html", "X") and tuple(one.n) == ("application/octet-stream", None) and one.d == "Ã©"
    pages = spark.createDataFrame([(bytearray(b'<META CONTENT="text/html; charset=Shift_JIS">'),), (bytearray(b" " * 1024 + b'<meta charset="x">'),), (None,)], "b binary")
    assert [r[0] for r in pages.select(prescan(F.col("b"))).collect()] == ["Shift_JIS", None, None]
    mods = spark.createDataFrame([("2024-05-01T10:20Z",), ("2024-05",), ("nope",), (None,), ("2024-05-01T10:20:30.123+02:00",)], "x string")
    assert [str(r[0]) for r in mods.select(lastmod_utc(F.col("x")).cast("string")).collect()] == ["2024-05-01 10:20:00", "2024-05-01 00:00:00", "None", "None", "2024-05-01 08:20:30.123"]


def test_patterns(spark):
    df = spark.createDataFrame([("https://e.com/a/b",), ("https://e.com/a",), ("https://E.com/A/x?y",)], "u string")
    assert df.where(passes(F.col("u"), ["https://e.com/*"])).count() == 1
    assert df.where(passes(F.col("u"), ["https://e.com/**"], ["**/b"])).count() == 2
    assert df.where(passes(F.col("u"), ["http{s,}://e.com/a/{b,c}"])).count() == 1
    with pytest.raises(ValueError):
        glob_regex("  ")
    with pytest.raises(ValueError):
        check_regex("(?=a)")


ROBOTS = """# x
User-agent: Foo/1.0
User-agent: bar
Disallow: /private*secret$
Crawl-delay: 3
User-agent: *
Disallow: /a
Allow: /a/b
Disallow:
Sitemap: https://e.com/s.xml
Sitemap: https://o.com/s.xml
user-agent: foo
Disallow: /z
"""


def test_robots(spark):
    p = parse_robots(ROBOTS)
    assert {g["agent"]: g["crawl_delay"] for g in p["groups"]} == {"foo": 3.0, "bar": 3.0, "*": None}
    assert p["sitemaps"] == ["https://e.com/s.xml", "https://o.com/s.xml"]
    files = spark.createDataFrame([("https://e.com", ROBOTS)], "origin string, content string")
    urls = spark.createDataFrame([("https://e.com/a/b",), ("https://e.com/a",), ("https://e.com/private/x-secret",), ("https://e.com/z",), ("http://e.com/a",), ("bad",)], "url string")

    def allowed(agent):
        return {r.url: r.allowed for r in robots_allowed(urls, files, agent).collect()}

    assert allowed("*") == {"https://e.com/a/b": True, "https://e.com/a": False, "https://e.com/private/x-secret": True, "https://e.com/z": True, "http://e.com/a": True, "bad": True}
    assert allowed("FOO/2") == {"https://e.com/a/b": True, "https://e.com/a": True, "https://e.com/private/x-secret": False, "https://e.com/z": False, "http://e.com/a": True, "bad": True}
    maps = spark.createDataFrame([("https://e.com", "https://e.com/s.xml"), ("https://e.com", "https://o.com/s.xml")], "origin string, sitemap string")
    assert sitemaps_in_scope(maps).count() == 1


def test_sitemaps(spark):
    import gzip

    xml = "<urlset><url><loc> https://e.com/a </loc><lastmod>2024-05-01</lastmod><lastmod>bad</lastmod><changefreq>daily</changefreq><changefreq>x</changefreq><priority>0.5</priority><priority>x</priority></url><url><priority></priority></url></urlset>"
    assert parse_sitemap_xml(xml) == [{"kind": "url", "loc": "https://e.com/a", "lastmod": "2024-05-01", "changefreq": "daily", "priority": None}]
    assert decode_sitemap(gzip.compress(xml.encode()), "https://e.com/s.xml.gz", None)[0]["loc"] == "https://e.com/a"
    assert decode_sitemap(b" https://e.com/1 \n\n", "x.txt", None)[0]["loc"] == "https://e.com/1"
    for bad in (("<a>", "x.xml"), ("x", "x.bin")):
        with pytest.raises(ValueError):
            decode_sitemap(bad[0].encode(), bad[1], None)
    index = b"<sitemapindex><sitemap><loc>https://e.com/p.xml</loc></sitemap><sitemap><loc>https://o.com/q.xml</loc></sitemap><sitemap><loc>https://e.com/i.xml</loc></sitemap></sitemapindex>"
    pages = b"<urlset><url><loc>https://e.com/1</loc></url><url><loc>https://o.com/2</loc></url></urlset>"
    captured = spark.createDataFrame([("https://e.com/i.xml", "text/xml", bytearray(index)), ("https://e.com/p.xml", "text/xml", bytearray(pages))], "url string, mime string, body binary")
    got = traverse(spark.createDataFrame([("https://e.com/i.xml",)], "url string"), captured).collect()
    assert [(r.loc, r.depth) for r in got] == [("https://e.com/1", 1)]
