"""Facts about the column functions, one small table each."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions import language, links, scoring, text
from gleaner.functions.text import REQUEST_LIMITS
from gleaner.operators import summary
from gleaner.sources import feeds, pages


WORDS = language.Lexicon(
    ["akan", "baru", "bir", "das", "der", "ein", "est", "estar", "für", "ile", "ini", "ist", "la", "le", "les", "neu", "nicht", "nova"]
    + ["para", "que", "sind", "tidak", "und", "untuk", "wir", "yang", "yeni", "zu"]
)


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTPS://Blog.Example.com:443//a//b/?utm_source=x&b=2&a=1#top", "https://blog.example.com/a/b?a=1&b=2"),
        ("http://example.com:80", "http://example.com/"),
        ("http://example.com:8080/x/", "http://example.com:8080/x"),
        ("https://e.com/p?source=rss----abc---4", "https://e.com/p"),
        ("https://e.com/p?source=newsletter", "https://e.com/p?source=newsletter"),
        ("https://e.com/p?flag&q=a%20b/c", "https://e.com/p?flag=&q=a+b%2Fc"),
        ("https://e.com/p?b=2&a=2&a=1", "https://e.com/p?a=2&a=1&b=2"),
        ("https://e.com/p?REF=me&fbclid=1&gclid=2", "https://e.com/p"),
        ("ftp://e.com/p", None),
        ("https://me:pw@e.com/p", None),
        ("nonsense", None),
    ],
)
def test_canonical_url(spark, url, expected):
    assert one(spark, url, links.canonical_url) == expected


@pytest.mark.parametrize(
    "url, key",
    [
        ("https://e.com/p?source=rss------github-5", "https://e.com/p"),
        ("https://e.com/p?source=rss-x&foo=1", "https://e.com/p?foo=1"),
        ("https://e.com/p?foo=1&source=rss-x", "https://e.com/p?foo=1"),
        ("https://e.com/p?source=newsletter", "https://e.com/p?source=newsletter"),
    ],
)
def test_dedupe_key(spark, url, key):
    assert one(spark, url, links.dedupe_key) == key


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Tom &amp; Jerry&#39;s &#x201C;show&#x201D;", "Tom & Jerry's “show”"),
        ("1 &lt; 2 &amp;&amp; 3", "1 < 2 && 3"),
        ("&amp;amp;lt;b&amp;amp;gt;", "<b>"),
        ("&#128640; &#xD800; &unknown; &#0;", "🚀 &#xD800; &unknown; &#0;"),
        ("plain", "plain"),
    ],
)
def test_decode_entities(spark, raw, expected):
    assert one(spark, raw, text.decode_entities) == expected


def test_markup_goes_before_entities(spark):
    raw = "<p>Use &lt;div&gt;\n```js\ncode\n```  here ![x](http://a/b.png)</p>"
    assert one(spark, raw, text.strip_markup) == "Use <div> here"
    assert one(spark, "<br/>", text.strip_markup) is None


@pytest.mark.parametrize(
    "written, expected",
    [
        ("Wed, 31 Jan 2024 05:00:00 GMT", "2024-01-31 05:00:00"),
        ("Wed, 31 Jan 2024 05:00:00 +0200", "2024-01-31 03:00:00"),
        ("2024-01-31T05:00:00Z", "2024-01-31 05:00:00"),
        ("soon", None),
        ("", None),
    ],
)
def test_any_date(spark, written, expected):
    found = one(spark, written, lambda v: F.date_format(text.any_date(v), "yyyy-MM-dd HH:mm:ss"))
    assert found == expected


def test_shingles(spark):
    assert one(spark, "Hello, brave NEW world", text.shingles) == ["hello brave", "brave new", "new world"]
    assert one(spark, "Single", text.shingles) == ["single"]
    assert one(spark, "Привет мир", text.shingles) == []


@pytest.mark.parametrize(
    "title, foreign",
    [
        ("Полное руководство по нейросетям", True),
        ("機械学習の最新動向", True),
        ("Cómo usar la nueva herramienta para los equipos", True),
        ("Das ist nicht der Weg und wir sind zu spät", True),
        ("Bagaimana ini bisa tidak akan untuk yang baru", True),
        ("Was ist neu in Next.js 16? Ein Überblick für Einsteiger", True),
        ("O que muda com a nova versão do React para quem está começando", True),
        ("Yapay zeka ile yeni bir uygulama nasıl yapılır", True),
        ("A la carte pricing for Vercel's new compute tiers", False),
        ("Red Hat and NVIDIA partner on enterprise inference", False),
        ("How the new release of the compiler makes builds faster", False),
        ("A tour of São Paulo for engineers", False),
        ("", False),
    ],
)
def test_language(spark, title, foreign):  # with the words that these titles hold
    nothing = F.lit(None).cast("string")
    assert one(spark, title, lambda v: language.is_non_english(v, nothing, nothing, WORDS)) is foreign


def test_long_text_without_english_words(spark):
    prose = " ".join(f"zorb{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    nothing = F.lit(None).cast("string")
    assert one(spark, prose, lambda v: language.is_non_english(F.lit("Zorb"), nothing, v, WORDS)) is True
    assert one(spark, "zorb " * 60, lambda v: language.is_non_english(F.lit("Zorb"), nothing, v, WORDS)) is False


def test_a_wider_lexicon_is_a_parameter(spark):
    nothing = F.lit(None).cast("string")
    title = "kuna faras momi tule"
    assert one(spark, title, lambda v: language.is_non_english(v, nothing, nothing, WORDS)) is False
    wider = language.Lexicon(foreign=("kuna", "momi"))
    assert one(spark, title, lambda v: language.is_non_english(v, nothing, nothing, wider)) is True


@pytest.mark.parametrize(
    "url, safe",
    [
        ("https://cdn.example.com/a.png", True),
        ("http://cdn.example.com/a.png", False),
        ("https://localhost/a.png", False),
        ("https://10.0.0.1/a.png", False),
        ("https://8.8.8.8/a.png", True),
        ("https://printer.local/a.png", False),
        ("https://cdn.example.com/1x1.gif", False),
        ("https://miro.medium.com/v2/resize:fill:88/1.png", False),
        ("https://miro.medium.com/v2/resize:fit:1200/1.png", True),
        ("https://cdn.example.com/" + "a" * 2050, False),
    ],
)
def test_safe_image(spark, url, safe):
    assert one(spark, url, links.safe_image_url) == (url if safe else None)


def test_narrowed_image_never_grows(spark):
    narrow = lambda v: links.narrowed_image_url(v, 360)
    assert one(spark, "https://c.example.com/max/1200/a.png", narrow) == "https://c.example.com/max/360/a.png"
    assert one(spark, "https://c.example.com/max/200/a.png", narrow) == "https://c.example.com/max/200/a.png"
    assert one(spark, "https://c.example.com/resize:fill:900/a.png", narrow) == "https://c.example.com/resize:fill:360/a.png"
    assert one(spark, "https://c.example.com/a.png", narrow) == "https://c.example.com/a.png"


def test_recency_and_exploration(spark):
    now = F.lit("2024-01-31").cast("timestamp")
    assert one(spark, "2024-01-29", lambda v: scoring.recency(v.cast("timestamp"), now)) == 0.5
    assert one(spark, "2025-01-01", lambda v: scoring.recency(v.cast("timestamp"), now)) == 1.0
    assert one(spark, None, lambda v: scoring.recency(v.cast("timestamp"), now)) == 0.0
    code = 0
    for character in "item-1":
        code = (code * 31 + ord(character)) % 2**32
    assert one(spark, "item-1", scoring.exploration) == (code % 1000) / 1000


def test_sentences_split_on_glued_capitals(spark):
    found = one(spark, "It works, and how?In May it grew. U.S.A is one. \"Yes\" he said", summary.sentences)
    assert found == ["It works, and how?", "In May it grew.", "U.S.A is one.", '"Yes" he said']


def test_key_points_keep_text_order_and_limits(spark):
    good = [f"The engine number {i} makes every single query run much faster than before." for i in range(6)]
    chrome = ["Subscribe to our weekly newsletter for more stories like this one today.", "Too short.", "Image size18 shows the long caption that lost every bit of its space."]
    body = " ".join([good[0], chrome[0], good[1], chrome[1], chrome[2], *good[2:]])
    rows = spark.createDataFrame([("a", body), ("b", None)], "id string, body_content string")
    points = {row["id"]: row["points"] for row in summary.key_points(rows, 4).collect()}
    assert points["a"] == good[:4] and "b" not in points
    assert len(summary.key_points(rows, 99).first()["points"]) == 6


def test_feed_dialects_and_images(spark):
    rss = """<rss xmlns:media="m" xmlns:content="c"><channel>
    <item><title>First</title><link>https://e.com/1</link><guid isPermaLink="false">g1</guid>
      <enclosure url="https://e.com/a.mp3" type="audio/mpeg"/><enclosure url="/pic.png" type="image/png"/>
      <pubDate>Wed, 31 Jan 2024 05:00:00 GMT</pubDate><description>Short &amp;amp; sweet</description></item>
    <item><title>No link</title></item>
    <item><title>Markup</title><link>https://e.com/2</link><content:encoded><![CDATA[<p>Hi <img src="https://e.com/b.png"> all</p>]]></content:encoded></item>
    </channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>t1</id><title>Entry</title>
      <link rel="self" href="https://e.com/self"/><link href="https://e.com/3"/><link rel="enclosure" href="https://e.com/c.png"/>
      <author><name>Ann</name></author><summary>Sum</summary><content>Whole text</content><updated>2024-01-30T00:00:00Z</updated></entry></feed>"""
    raw = spark.createDataFrame([("r", "s", rss), ("a", "s", atom), ("x", "s", "<broken")], "payload_id string, source_id string, payload string")
    rows = {row["title"]: row for row in feeds.normalize_feeds(raw).collect()}
    assert set(rows) == {"First", "Markup", "Entry"}
    assert rows["First"]["external_id"] == "g1" and rows["First"]["summary"] == "Short & sweet"
    assert rows["First"]["image_url"] == "https://e.com/pic.png"
    assert rows["Markup"]["image_url"] == "https://e.com/b.png" and rows["Markup"]["body_text"] == "Hi all"
    assert rows["Entry"]["canonical_url"] == "https://e.com/3" and rows["Entry"]["image_url"] == "https://e.com/c.png"
    assert rows["Entry"]["author"] == "Ann" and rows["Entry"]["body_text"] == "Whole text"


def test_entries_per_payload(spark):
    items = "".join(f"<item><title>T{i}</title><link>https://e.com/{i}</link></item>" for i in range(60))
    raw = spark.createDataFrame([("p", "s", f"<rss><channel>{items}</channel></rss>")], "payload_id string, source_id string, payload string")
    assert sorted(row["position"] for row in feeds.normalize_rss(raw).collect()) == list(range(60))
    limited = feeds.normalize_rss(raw, limits=REQUEST_LIMITS).collect()
    assert sorted(row["position"] for row in limited) == list(range(50))


def test_page_metadata_sources(spark):
    html = """<html><head><title>Plain title</title><meta property="og:title" content="Shared &amp; titled">
    <meta name="description" content="About it"><link rel="canonical" href="/story">
    <script type="application/ld+json">{broken</script>
    <script type="application/ld+json">{"@graph":[{"@type":"WebSite","author":"No"},{"@type":"NewsArticle","image":["/lead.png"],
      "author":[{"name":"Ada"}],"datePublished":"2024-01-30T10:00:00Z"}]}</script></head>
    <body><nav>Menu</nav><article><h1>Head</h1><p>Body text.</p></article><footer>End</footer></body></html>"""
    rows = spark.createDataFrame([(1, "https://www.e.com/x", html)], "page_id bigint, url string, html string")
    row = pages.extract_page_metadata(rows).first()
    assert row["canonical_url"] == "https://www.e.com/story" and row["title"] == "Shared & titled"
    assert row["author"] == "Ada" and row["summary"] == "About it" and row["body_text"] == "Head Body text."
    assert row["image_url"] == "https://www.e.com/lead.png" and str(row["published_at"]).startswith("2024-01-30")


def test_page_engagement_reads_escaped_counters(spark):
    html = r'{"clapCount":12} {\"totalClapCount\":340} {"claps":999}'
    rows = spark.createDataFrame([(1, html), (2, "none")], "page_id bigint, html string")
    assert {r["page_id"]: r["engagement_count"] for r in pages.page_engagement(rows).collect()} == {1: 340, 2: 0}
