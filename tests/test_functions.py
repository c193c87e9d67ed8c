import random
import time

import pytest
from pyspark.sql import functions as F

from crawlframe.functions import html, text, urls


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} string" for k in cols)
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr.alias("v")).first()["v"]


def many(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_emails(spark):
    got = many(spark, ["Write A@B.org, a@b.org or c.d+e@x-y.co.uk; not a@b", "none", "<i>q@w.io</i>", None],
               text.extract_emails)
    assert got[:3] == [["a@b.org", "c.d+e@x-y.co.uk"], [], ["q@w.io"]]


def test_keywords(spark):
    got = one(spark, text.count_keywords(F.col("c"), ["The", "aa", "zz", "x.y"]), c="Then THE other aaaaa x.y")
    assert got == {"The": 3, "aa": 2, "x.y": 1}
    assert one(spark, text.count_keywords(F.col("c"), []), c="x") == {}
    with pytest.raises(ValueError):
        text.count_keywords(F.col("c"), ["ok", ""])


def test_error_category(spark):
    cases = {
        "connection Timeout": "Timeout", "Connection refused 404": "Connection Error",
        "page NOT FOUND 403": "Not Found (404)", "403": "Forbidden (403)", "access forbidden 500": "Forbidden (403)",
        "Internal Server error": "Server Error (5xx)", "DNS lookup failed": "DNS Error",
        "no such host": "Other", "blocked by robots.txt": "Other", "": "Other",
    }
    assert many(spark, list(cases), text.error_category) == list(cases.values())


def test_truncate_and_display(spark):
    assert many(spark, ["abcdefgh", "abcde", "ü" * 9], lambda c: text.truncate_text(c, 6)) == \
        ["abc...", "abcde", "üüü..."]
    got = one(spark, text.keyword_list_display(F.expr("map('the', 3, 'que', 1)")), c="")
    assert got == "que (1), the (3)"
    assert one(spark, text.keyword_finding(F.lit("the"), F.lit(2)), c="") == "the (found 2 times)"
    assert one(spark, text.process_time_ms(F.lit(1_500_000)), c="") == 1.5


def test_domains(spark):
    values = ["http://u:p@H.org:80/x", "https://h.org?q=1", "HTTP://h.org/a", "ftp://f.org/z", "no slash", ""]
    assert many(spark, values, urls.report_domain) == \
        ["u:p@H.org:80", "h.org?q=1", "HTTP:", "ftp:", "no slash", ""]
    assert many(spark, values, urls.url_host) == ["H.org:80", "h.org", "h.org", "f.org", "", ""]


def test_validity(spark):
    values = ["http://a", "HTTPS://a/b", "ftp://a", "//a/b", "/x", "", "mailto:x@y", "http:x", "1http://a",
              ":x", "http://a b/", "http://a:8x/", "http://a/%zz", "http://[::1]:80/", "http://a/x y|z"]
    assert many(spark, values, urls.is_valid_url) == [
        True, True, False, False, False, False, False, True, False,
        False, False, False, False, True, True]
    assert many(spark, values, urls.is_submittable_url) == [
        True, True, True, False, False, False, False, False, False,
        False, False, False, False, True, True]


BASE = "http://h.org:81/a/b/c?q=1#frag"


@pytest.mark.parametrize("ref,expected", [
    ("", "http://h.org:81/a/b/c?q=1#frag"),
    ("#f", "http://h.org:81/a/b/c?q=1#f"),
    ("?x=é y", "http://h.org:81/a/b/c?x=é y"),
    ("d", "http://h.org:81/a/b/d"),
    ("/d", "http://h.org:81/d"),
    ("./d", "http://h.org:81/a/b/d"),
    ("../d", "http://h.org:81/a/d"),
    ("../../../d", "http://h.org:81/d"),
    ("..", "http://h.org:81/a/"),
    (".", "http://h.org:81/a/b/"),
    ("d/../e/.", "http://h.org:81/a/b/e/"),
    ("/a/./b//c/..", "http://h.org:81/a/b//"),
    ("//other.net/x/../y", "http://other.net/y"),
    ("//other.net", "http://other.net"),
    ("HTTPS://Other.net", "https://Other.net"),
    ("https://other.net?z#t", "https://other.net?z#t"),
    ("/für", "http://h.org:81/f%C3%BCr"),
    ("/a b*~+$&,:;=@", "http://h.org:81/a%20b%2A~+$&,:;=@"),
    ("/a%20b*(x)'!", "http://h.org:81/a%20b*(x)'!"),
    ("/%41 b", "http://h.org:81/A%20b"),
    ("mailto:x@y.org", "mailto:x@y.org"),
    ("#é x", "http://h.org:81/a/b/c?q=1#%C3%A9%20x"),
    ("http://u:p@x.org/", "http://u:p@x.org/"),
    ("http://fü.de/", "http://f%C3%BC.de/"),
    (" x", "http://h.org:81/a/b/%20x"),
    ("///x", "http://h.org:81///x"),
    ("a:b/c", "a:b/c"),
    ("1:b", None), ("/%zz", None), ("/a\nb", None), ("http://a b/", None),
])
def test_resolve(spark, ref, expected):
    assert one(spark, urls.resolve_url(F.col("b"), F.col("r")), b=BASE, r=ref) == expected


def test_resolve_pathless_base(spark):
    assert one(spark, urls.resolve_url(F.col("b"), F.col("r")), b="http://h.org", r="x") == "http://h.org/x"
    assert one(spark, urls.resolve_url(F.col("b"), F.col("r")), b="http://h.org", r="?q") == "http://h.org?q"


def test_titles(spark):
    values = [
        "<html><title> A &amp; B &lt;x&gt; </title><title>second</title>",
        "<TITLE lang='x'>\n caf&eacute; &#8364;&#x20AC;&#150; &amp;lt; &unknown; &copy </TITLE>",
        "<!-- <title>no</title> --><script>'<title>no</title>'</script><title>yes</title>",
        "no title", "<title></title>", "<title>open",
    ]
    assert many(spark, values, html.extract_title) == \
        ["A & B <x>", "café €€– &lt; &unknown; ©", "yes", "", "", "open"]


def test_links(spark):
    page = """<base href="http://elsewhere.org/">
      <a class=x href="/one?a=1&amp;b=2">1</a> <A HREF='two'>2</A> <a href=three/>3</a>
      <a title="x href=/wrong > y" href="/four#z">4</a> <a data-href="/no" name=q>no</a>
      <a href="mailto:a@b.org">m</a> <a href="">self</a> <a href="/one?a=1&amp;b=2">dup</a>
      <!-- <a href="/comment">c</a> --> <script>var s = '<a href="/script">';</script>
      <script src="/app.js"></script> <img alt="src" src="i.png"><img src = //cdn.net/z.gif >
      <abbr href="/abbr">n</abbr><a href="/five" href="/six">5</a> <a href>bare</a>
      <textarea><a href="/textarea"></textarea>"""
    got = one(spark, html.extract_links(F.col("h"), F.col("b")), h=page, b="https://h.org/d/p")
    assert got == [
        "https://h.org/one?a=1&b=2", "https://h.org/d/two", "https://h.org/d/three/", "https://h.org/four#z",
        "https://h.org/d/p", "https://h.org/five",
        "https://h.org/app.js", "https://h.org/d/i.png", "https://cdn.net/z.gif"]
    assert one(spark, html.extract_links(F.col("h"), F.col("b")), h=page, b="http://bad host/") == []


def test_long_markup_does_not_exhaust_the_stack(spark):
    page = "<a " + "x" * 200_000 + " y='" + "z" * 200_000 + "' href='/end'>" + "<!--" + "-" * 200_000
    page += "<title>" + "t" * 1000
    got = one(spark, html.extract_links(F.col("h"), F.col("b")), h=page, b="http://h.org/")
    assert got == ["http://h.org/end"]


def test_references_in_attributes_and_text(spark):
    page = """<a href="/p?a=1&reg=eu&copy=2&sect=3">1</a><a href="/q?x&amp;y&lt;z">2</a><a href="/r?a&copy">3</a>
    <a href="/s?&ampb&#x41;&notit;">4</a><img src="/t?z=">"""
    got = one(spark, html.raw_references(F.col("v")), v=page)
    assert got == ["/p?a=1&reg=eu&copy=2&sect=3", "/q?x&y<z", "/r?a©", "/s?&ampbA&notit;", "/t?z="]
    titles = ["<title>&ampb &copy2 &notin; &amp;amp; &zzz;</title>", "<title>a &amp; b</title>", "<title>plain</title>"]
    assert many(spark, titles, html.extract_title) == ["&b ©2 ∉ &amp; &zzz;", "a & b", "plain"]


def seconds(spark, expression, value):
    """Time and result of the expression over one row."""
    df = spark.createDataFrame([(value,)], "v string")
    start = time.perf_counter()
    found = df.select(expression(F.col("v")).alias("x")).first()["x"]
    return time.perf_counter() - start, found


LONG = {
    "letters before an address": (text.extract_emails, lambda n: "x" * n + " a@b.org", ["a@b.org"]),
    "letters that end in nothing": (text.extract_emails, lambda n: "@" + "x" * n, []),
    "a domain without an end": (text.extract_emails, lambda n: "a@" + "b." * (n // 2) + "1", []),
    "many signs": (text.extract_emails, lambda n: "a@" * (n // 2), []),
    "tags in open quotes": (html.raw_references, lambda n: '<a href="x ' * (n // 11), None),
    "tags that never end": (html.raw_references, lambda n: "<a " * (n // 3), []),
    "names that never end": (html.raw_references, lambda n: "<a" * (n // 2), []),
    "names up to one end": (html.raw_references, lambda n: "<a" * (n // 2) + ">", []),
    "a last quote that is open": (html.raw_references, lambda n: '<a href="/x">' + "<b c='d" * (n // 7) + "<p>" * 9, ["/x"]),
    "raw text without an end": (html.raw_references, lambda n: '<img src="/i">' + "<script " * (n // 8), ["/i"]),
    "raw text that is not closed": (html.raw_references, lambda n: '<img src="/i">' + "<style>" * (n // 7), ["/i"]),
    "comments that are open": (html.raw_references, lambda n: '<img src="/i">' + "<!--" * (n // 4), ["/i"]),
    "titles in open raw text": (html.extract_title, lambda n: "<script " * (n // 8), ""),
    "one tag of many attributes": (html.raw_references, lambda n: "<a " + "b " * (n // 2) + "href=/x>", ["/x"]),
}


@pytest.mark.parametrize("name", LONG)
def test_time_is_near_linear_in_the_length(spark, name):
    """A page of 1 MB takes seconds, and twice the length about twice the time."""
    expression, page, expected = LONG[name]
    seconds(spark, expression, page(1_000))
    half, _ = seconds(spark, expression, page(500_000))
    whole, found = seconds(spark, expression, page(1_000_000))
    assert expected is None or found == expected
    assert whole < 10 and whole < 3 * half + 1


def brute_emails(value):
    import re
    return list(dict.fromkeys(m.lower() for m in re.findall(text.EMAIL_PATTERN, value)))


def test_addresses_are_those_of_the_plain_pattern(spark):
    rng = random.Random(3)
    values = ["a@b.com_x@y.org", "a@b.com.x@y.org", "a@b.co@c.de", "..a@b..cc", "a@b.c1.dd-e@f.gg", "x@y.z a@@b.cc", "a@b.com+c@d.ee@f.gg"]
    values += ["".join(rng.choice("aB1.@_-+% é") for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert many(spark, values, text.extract_emails) == [brute_emails(v) for v in values]


def test_broken_markup(spark):
    pages = [
        """<a href="/1">x</a><p class=it's><a href='/2'>y</a><b title=don't a="><a href=/no>">""",
        """<a href="/1" <a href="/2">z</a><img src=/3 alt="open><a href=/4>""",
        """<a/href=/1><a href = "/2"/><a =href="/no" href=/3 >""", """<a href=/1><iframe src=/no""", """<a href=/1><a href=/no""",
        """<a "href=/no" href='/1'><A\nHREF\n=\n/2\n><a href=/x"y'>""", """<a href="/1><a href=/2>"><a href=/3>""",
    ]
    assert many(spark, pages, html.raw_references) == [
        ["/1", "/2"], ["/1"], ["/1", "/2", "/3"], ["/1"], ["/1"], ["/1", "/2", "/x\"y'"], ["/1><a href=/2>", "/3"]]
