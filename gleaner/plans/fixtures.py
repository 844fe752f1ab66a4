"""The data model laid over the given tables, so that every query has articles to read.

Each view is a deterministic derivation of whole tables; ``gleaner.plans.views``
states the same derivations in SQL.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.language import Lexicon
from gleaner.session import prepare
from gleaner.sources.tables import read_driver_table

NOW_TEXT = "2024-01-31 00:00:00"

TOPICS = [(0, "Onth"), (1, "Reat"), (2, "Reble"), (3, "Ened"), (4, "Ouaux")]
TOPIC_ALIASES = [
    (0, "onth"), (0, "aner"), (1, "reat"), (1, "hely"), (2, "reble"),
    (2, "inti"), (3, "ened"), (3, "hand"), (4, "ouaux"), (4, "aiment"),
]
SOURCE_TYPES = [
    "rss", "atom", "medium_rss", "api", "web", "platform",
    "hacker_news", "dev_to", "stack_exchange", "github_releases", "youtube",
]
PLATFORMS = ["hacker_news", "reddit", "dev_to", "stack_exchange", "github", "youtube"]
EVENT_PLATFORMS = {"click": "hacker_news", "view": "dev_to", "error": "reddit", "signup": "github", "purchase": "youtube"}
EVENT_NAMES = {"click": "open", "view": "impression", "error": "crash", "signup": "complete", "purchase": "save"}
# Function words of languages other than English, whatever the given tables hold.
FOREIGN_WORDS = [
    # German
    "auf", "aus", "bei", "das", "dem", "den", "der", "des", "durch", "ein", "eine", "einem", "einen", "einer", "für", "im",
    "ist", "nach", "nicht", "oder", "sich", "sind", "und", "vom", "von", "werden", "wird", "zu", "zum", "zur", "über",
    # French
    "au", "aux", "avec", "ce", "ces", "cette", "dans", "de", "depuis", "du", "elle", "est", "et", "il", "je", "la",
    "le", "les", "leur", "même", "nous", "ou", "où", "par", "pas", "pour", "que", "qui", "ses", "sont", "sur", "très",
    "un", "une", "vos",
    # Spanish
    "al", "como", "con", "cuando", "del", "desde", "el", "ella", "esta", "este", "hasta", "las", "los", "más", "muy", "nos",
    "para", "pero", "por", "porque", "se", "ser", "sin", "sobre", "su", "sus", "también", "una", "y", "ya",
    # Portuguese
    "ao", "com", "da", "dos", "ele", "foi", "isso", "mas", "muito", "não", "pela", "pelo", "quando", "são", "sem", "seu",
    "sua", "uma", "você",
    # Italian
    "che", "degli", "della", "delle", "di", "gli", "nel", "nella", "perché", "più", "questo", "sono", "tra",
    # Dutch
    "aan", "deze", "door", "een", "het", "maar", "naar", "niet", "ook", "te", "van", "voor", "wij", "worden", "zijn",
    # Turkish
    "bir", "bu", "çok", "daha", "değil", "gibi", "için", "ile", "ne", "ve",
    # Indonesian
    "adalah", "akan", "dari", "dengan", "ini", "itu", "juga", "pada", "tidak", "untuk", "yang",
    # Czech
    "ale", "ani", "jako", "jsou", "která", "který", "není", "od", "pro", "že",
    # Hungarian
    "az", "egy", "és", "hogy", "mint", "nem", "vagy",
]
LEXICON = Lexicon(FOREIGN_WORDS)
TIERS = ["official", "community", "probationary", "unknown"]


def now() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp")


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _map(key: Column, table: dict[str, str]) -> Column:
    result = F.lit(None).cast("string")
    for name, value in table.items():
        result = F.when(key == name, value).otherwise(result)
    return result


def minus_minutes(minutes: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(now()) - minutes.cast("bigint") * 60_000_000)


def minus_hours(hours: Column) -> Column:
    return minus_minutes(hours * 60)


def cached_view(build):
    """Plan a view once per fixture set; several operators of a query share it."""

    @wraps(build)
    def view(self):
        if build.__name__ not in self._views:
            self._views[build.__name__] = build(self)
        return self._views[build.__name__]

    return view


class Fixtures:
    """Lazy views over one folder of the given tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}
        self._views: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = read_driver_table(self.spark, self.folder, name)
        return self._tables[name]

    def documents_total(self) -> Column:
        return self.table("documents").agg(F.count(F.lit(1))).scalar()

    def pages_total(self) -> Column:
        return self.table("pages").agg(F.count(F.lit(1))).scalar()

    @cached_view
    def items(self) -> DataFrame:
        n = F.col("doc_id")
        text = F.col("text")
        author = (
            F.when(n % 7 == 0, None).when(n % 7 == 1, "Unknown").when(n % 7 == 2, " Ada Writer ").when(n % 7 == 3, "n/a")
            .otherwise(F.concat(F.lit("Writer "), (n % 13).cast("string")))
        )
        published = F.when(n % 50 == 0, None).otherwise(minus_hours((n * 37) % 2400))
        return self.table("documents").select(
            n.cast("string").alias("id"),
            n.alias("n"),
            F.col("source").alias("source_id"),
            F.array_join(F.slice(F.filter(F.split(text, "[ \t\n\r]+", 14), lambda word: word != ""), 1, 12), " ").alias("title"),
            F.when(n % 11 != 0, F.substring_index(text, "\n", 1)).alias("summary"),
            text.alias("body_content"),
            F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), n.cast("string")).alias("canonical_url"),
            F.when(n % 3 != 0, F.concat(F.lit("https://images.example.com/max/"), (n % 1500).cast("string"), F.lit("/"), n.cast("string"), F.lit(".png"))).alias("image_url"),
            author.alias("author"),
            published.alias("published_at"),
            F.timestamp_micros(F.unix_micros(F.coalesce(published, now())) + 3_600_000_000).alias("fetched_at"),
            (n % 17 == 0).alias("is_hidden"),
            F.when(n % 4 == 0, now()).alias("backfilled_at"),
        )

    def listed_items(self) -> DataFrame:
        """Items as a feed reads them: word counts are stored, so that lists never read a body."""
        return self.items().withColumn("word_count", F.lit(None).cast("int")).drop("body_content")

    def links(self) -> DataFrame:
        """Stored rows whose link is a page address, some stamped, some unusable."""
        pages = self.table("pages").select("page_id", F.col("url").alias("page_url"))
        items = self.items().select("id", "n", "source_id", "image_url", "body_content", "fetched_at", "published_at", "title")
        joined = items.withColumn("page_id", F.col("n") % self.pages_total()).join(pages, "page_id")
        separator = F.when(F.contains("page_url", F.lit("?")), "&").otherwise("?")
        stamp = F.concat("page_url", separator, F.lit("source=rss----"), (F.col("n") % 7).cast("string"), F.lit("---4"))
        url = (
            F.when(F.col("n") % 97 == 1, F.concat(F.lit("ftp://files.example.com/"), "id"))
            .when(F.col("n") % 101 == 1, F.concat(F.lit("https://me:secret@example.com/"), "id"))
            .when((F.col("n") % 5 == 0) & ~F.contains("page_url", F.lit("#")), stamp)
            .otherwise(F.col("page_url"))
        )
        return joined.withColumn("canonical_url", url).withColumn("url_hash", F.sha2("canonical_url", 256)).withColumn(
            "image_url", F.when(F.col("n") % 2 == 0, F.col("image_url"))
        ).drop("page_id", "page_url")

    @cached_view
    def sources(self) -> DataFrame:
        k = F.col("k")
        return (
            self.table("documents").select(F.col("source").alias("source_id")).distinct()
            .withColumn("k", F.substring("source_id", 4, 9).cast("bigint"))
            .select(
                "source_id",
                "k",
                F.concat(F.lit("Feed "), "source_id").alias("name"),
                _pick(k % 11, SOURCE_TYPES).alias("source_type"),
                (k % 7 != 6).alias("is_active"),
                F.when(k % 5 != 0, k * 15).cast("int").alias("fetch_interval_minutes"),
                F.when(k % 12 != 0, minus_minutes(k * 20)).alias("last_fetched_at"),
                F.when(k % 8 == 3, minus_hours(F.lit(216))).when(k % 6 != 0, minus_minutes(k * 13)).alias("last_success_at"),
                F.when(k % 9 == 8, "FETCH_FAILED").alias("last_error"),
                F.when(k % 3 != 0, k + 20).cast("int").alias("max_article_age_days"),
                F.when(k % 10 != 9, _pick(k % 4, TIERS)).alias("trust_tier"),
            )
        )

    @cached_view
    def topics(self) -> DataFrame:
        return self.spark.createDataFrame(TOPICS, "topic_id bigint, name string")

    @cached_view
    def topic_aliases(self) -> DataFrame:
        return self.spark.createDataFrame(TOPIC_ALIASES, "topic_id bigint, alias string")

    @cached_view
    def source_topics(self) -> DataFrame:
        k = F.col("k")
        first = F.when(k % 6 < 5, k % 6)
        second = F.when(k % 4 == 1, (k + 2) % 5)
        wanted = F.array_compact(F.array_distinct(F.array(first, second)))
        return self.sources().select("source_id", F.explode(wanted).alias("topic_id"))

    @cached_view
    def item_topics(self) -> DataFrame:
        """Stored links: the source's topics and every topic named in title or summary."""
        text = F.lower(F.concat_ws(" ", "title", F.coalesce("summary", F.lit(""))))
        named = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(alias)), F.lit(topic).cast("bigint")) for topic, alias in TOPIC_ALIASES]))
        matched = self.items().select(F.col("id").alias("item_id"), F.explode(named).alias("topic_id"))
        declared = self.items().select(F.col("id").alias("item_id"), "source_id").join(self.source_topics(), "source_id")
        return matched.unionByName(declared.select("item_id", "topic_id")).distinct()

    def events(self) -> DataFrame:
        """Reader and crowd events, tied to an item."""
        return self.table("events").withColumn("item_n", F.col("event_id") % self.documents_total())

    def signals(self) -> DataFrame:
        return self.events().groupBy(F.col("item_n").cast("string").alias("item_id")).agg(
            F.count(F.lit(1)).alias("engagement_count"),
            F.count_distinct("event_type").alias("source_count"),
            F.max("event_type").alias("platform"),
            F.max("ts").alias("collected_at"),
        )

    def user_topics(self) -> DataFrame:
        u = F.col("user_id")
        return self.table("events").select("user_id").distinct().select(
            "user_id", F.explode(F.array_distinct(F.array(u % 5, (u * 3 + 1) % 5))).alias("topic_id")
        )

    def affinity(self) -> DataFrame:
        u = F.col("user_id")
        return self.table("events").select("user_id").distinct().select(
            "user_id", (u % 5).alias("topic_id"), (u % 31 - 5).cast("double").alias("affinity")
        )

    def _orders(self) -> DataFrame:
        return self.table("orders").withColumn("item_id", (F.col("o_orderkey") % self.documents_total()).cast("string")).withColumn(
            "user_id", F.col("o_custkey") % 150
        )

    def saved(self) -> DataFrame:
        first = F.struct("o_orderdate", "o_orderkey")
        return self._orders().groupBy("user_id", "item_id").agg(
            F.min_by(F.col("o_orderstatus") == "F", first).alias("is_read"), F.min("o_orderdate").alias("saved_at")
        )

    def submissions(self) -> DataFrame:
        return self._orders().filter(F.col("o_orderpriority") == "1-URGENT").select(
            F.col("o_orderkey").alias("submission_id"),
            "user_id",
            "item_id",
            F.when(F.col("o_orderkey") % 10 == 0, "failed").otherwise("completed").alias("status"),
        )

    def candidates(self) -> DataFrame:
        """Incoming candidates, one per document, with every case the gate knows."""
        n = F.col("n")
        url = (
            F.when(n % 29 == 3, F.concat(F.lit("https://old.reddit.com/r/"), "id"))
            .when(n % 31 == 3, F.lit("not a link"))
            .otherwise(F.col("canonical_url"))
        )
        body = F.when(n % 41 == 3, "Please subscribe to continue.").when(n % 13 != 5, F.col("body_content"))
        return self.items().select(
            "id",
            "n",
            "source_id",
            n.alias("position"),
            "title",
            F.when(n % 37 == 3, F.concat(F.lit("Sponsored post: "), "title")).otherwise(F.col("summary")).alias("summary"),
            body.alias("body_text"),
            url.alias("canonical_url"),
            "image_url",
            "author",
            "published_at",
            "fetched_at",
            F.when(n % 10 == 0, "release").when(n % 10 == 1, "video").otherwise("article").alias("kind"),
            F.when(n % 4 != 0, _pick(n % 6, PLATFORMS)).alias("platform"),
            F.when(n % 5 != 0, (n * 7) % 120).alias("engagement_count"),
            (n % 19 == 3).alias("paywalled"),
            (n % 23 == 3).alias("duplicate"),
        )

    def stored_titles(self) -> DataFrame:
        """Already stored articles: one per page, titled as the page is."""
        p = F.col("page_id")
        return self.table("pages").select(
            F.concat(F.lit("p"), p.cast("string")).alias("id"),
            F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
            minus_hours((p * 11) % 1000).alias("fetched_at"),
        )

    def page_metadata(self) -> DataFrame:
        """Fetched pages for candidates: the page with the candidate's number, when there is one."""
        pages = self.table("pages").select(F.col("page_id").alias("n"), "html")
        prose = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("html", "(?s)<article>(.*)</article>", 1), "<[^>]*>", " "), r"[ \t\n\r]+", " "))
        return pages.join(self.items().select("n", "canonical_url"), "n").select(
            "canonical_url",
            F.concat(F.lit("Page author "), (F.col("n") % 5).cast("string")).alias("author"),
            F.concat(F.lit("Page summary "), F.col("n").cast("string")).alias("summary"),
            prose.alias("body_text"),
            F.when(F.col("n") % 4 != 0, F.concat(F.lit("https://pages.example.com/"), F.col("n").cast("string"), F.lit(".png"))).alias("image_url"),
            (F.col("n") % 9 == 0).alias("failed"),
        )

    def runs(self) -> DataFrame:
        c = F.col("o_custkey")
        status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "succeeded").otherwise("running")
        done = F.col("o_orderstatus") != "P"
        return self.table("orders").select(
            F.col("o_orderkey").alias("run_id"),
            F.concat(F.lit("src"), (c % 23).cast("string")).alias("source_id"),
            F.col("o_orderdate").alias("started_at"),
            F.when(done, F.timestamp_micros(F.unix_micros("o_orderdate") + c * 1_000_000)).alias("completed_at"),
            status.alias("status"),
            (c % 20).alias("fetched"),
            (c % 7).alias("inserted"),
            (c % 5).alias("duplicates"),
            (c % 3).alias("rejected"),
            (c % 2).alias("enriched"),
            F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("error_count"),
            F.when(F.col("o_orderstatus") == "F", "FETCH_FAILED").alias("error_message"),
        )

    def fetch_attempts(self) -> DataFrame:
        p = F.col("page_id")
        code = F.when(p % 6 == 0, "HTTP_403").when(p % 6 == 1, "TIMEOUT").when(p % 6 == 2, "socket hang up")
        return self.table("pages").select("url", code.alias("error_code"))

    def verdicts(self) -> DataFrame:
        """Several verdicts per link and day, as re-runs produce them."""
        n = F.col("user_id")
        return self.table("events").select(
            F.sha2(F.concat(F.lit("item-"), n.cast("string")), 256).alias("url_hash"),
            F.concat(F.lit("https://example.com/"), n.cast("string")).alias("canonical_url"),
            F.concat(F.lit("Story "), n.cast("string"), F.lit(" seen "), F.col("event_id").cast("string")).alias("title"),
            F.concat(F.lit("src"), (n % 23).cast("string")).alias("source_id"),
            (F.col("event_id") * 13 % 1001 / F.lit(1000.0)).alias("score"),
            (F.col("event_id") * 13 % 1001 >= 600).alias("accepted"),
            F.when(F.col("event_id") * 13 % 1001 >= 600, "qualified").otherwise(_pick(F.col("event_id") % 4, ["stale", "thin_content", "non_english", "below_threshold"])).alias("reason"),
            F.col("ts").alias("created_at"),
        )

    def hits(self) -> DataFrame:
        n = F.col("user_id") % 10
        return self.table("events").select(
            n.cast("string").alias("item_id"),
            F.col("event_id").alias("hit_id"),
            F.col("ts").alias("seen_at"),
            _map(F.col("event_type"), EVENT_PLATFORMS).alias("platform"),
            F.when(F.col("event_id") % 9 != 0, F.col("value") * 10 - 50).alias("reported"),
            F.concat(F.lit("src"), (F.col("event_id") % 3).cast("string")).alias("source_id"),
            F.when(n % 6 != 0, F.concat(F.lit("src"), (n % 3).cast("string"))).alias("stored_source_id"),
        )

    def state_events(self) -> DataFrame:
        flag = F.col("l_returnflag")
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("user_id"),
            (F.col("l_partkey") % 50).cast("string").alias("item_id"),
            F.col("l_shipdate").alias("at"),
            (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
            F.when(flag == "A", F.lit(True)).when(flag == "R", F.lit(False)).alias("saved"),
            F.when(flag == "N", F.col("l_linestatus") == "O").alias("read"),
        )

    def raw_events(self) -> DataFrame:
        """Reader events as JSON text, some of them invalid."""
        e = F.col("event_id")
        payload = F.struct(
            F.when(e % 31 != 0, F.concat(F.lit("e"), e.cast("string"))).alias("client_event_id"),
            F.col("item_n").cast("string").alias("content_item_id"),
            _map(F.col("event_type"), EVENT_NAMES).alias("type"),
            F.when(e % 50 == 0, F.lit(-1.0)).when(e % 51 == 0, F.lit(1.5)).when(e % 3 == 0, F.floor("value").cast("double")).alias("dwell_seconds"),
            F.when(e % 4 == 0, F.col("value") / 100).alias("completion_ratio"),
            F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
        )
        return self.events().select(e.alias("event_id"), F.to_json(payload).alias("payload"))

    def quota_requests(self) -> DataFrame:
        return self.table("events").select(
            F.when(F.col("event_type").isin("click", "view"), "github").otherwise("stack_exchange").alias("platform"),
            F.col("event_id").alias("request_id"),
            F.col("ts").alias("asked_at"),
        )

    # Raw payloads, built from the items so that the expected candidates are known.

    def _batched(self, entry: Column, wrap) -> DataFrame:
        rows = self.items().select(F.floor(F.col("n") / 50).alias("batch"), "n", entry.alias("entry"))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda row: row["entry"])
        built = rows.groupBy("batch").agg(wrap(listed).alias("payload")).repartition(self.spark.sparkContext.defaultParallelism, "batch")
        return built.select(
            F.concat(F.lit("p"), F.col("batch").cast("string")).alias("payload_id"),
            F.concat(F.lit("src"), (F.col("batch") % 20).cast("string")).alias("source_id"),
            F.concat(F.lit("acme/tool"), (F.col("batch") % 3).cast("string")).alias("repo"),
            "payload",
        )

    def raw_hacker_news(self) -> DataFrame:
        n = F.col("n")
        entry = F.struct(
            F.when(n % 53 != 0, n.cast("string")).alias("objectID"),
            "title",
            F.when(n % 15 != 0, F.col("canonical_url")).alias("url"),
            F.when(n % 8 != 0, n * 7 % 120 - 10).alias("points"),
            (n % 30).alias("num_comments"),
            F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        )
        return self._batched(entry, lambda hits: F.to_json(F.struct(hits.alias("hits"))))

    def raw_dev_to(self) -> DataFrame:
        n = F.col("n")
        entry = F.struct(
            n.alias("id"),
            "title",
            F.concat(F.lit(" "), "title", F.lit(" ")).alias("description"),
            F.concat(F.lit("https://dev.example.com/p/"), "id").alias("url"),
            F.when(n % 3 == 0, "  ").when(n % 3 == 1, F.concat(F.lit(" "), "canonical_url")).alias("canonical_url"),
            F.when(n % 4 == 0, "").otherwise(F.col("image_url")).alias("cover_image"),
            F.when(n % 5 != 0, F.concat(F.lit("https://social.example.com/"), "id")).alias("social_image"),
            F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
            (n * 7 % 60 - 5).alias("positive_reactions_count"),
            (n % 9).alias("comments_count"),
            F.struct(F.col("author").alias("name")).alias("user"),
        )
        return self._batched(entry, F.to_json)

    @staticmethod
    def _escaped(text) -> Column:
        amp = F.replace(F.col(text) if isinstance(text, str) else text, F.lit("&"), F.lit("&amp;"))
        return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def raw_stack_exchange(self) -> DataFrame:
        n = F.col("n")
        entry = F.struct(
            n.alias("question_id"),
            F.concat(self._escaped("title"), F.lit(" what&#39;s &quot;next&quot;")).alias("title"),
            F.col("canonical_url").alias("link"),
            (n % 40 - 5).alias("score"),
            (n % 6).alias("answer_count"),
            (n % 6 > 0).alias("is_answered"),
            F.coalesce(F.unix_seconds("published_at"), F.lit(0)).alias("creation_date"),
            F.concat(F.lit("<p>"), self._escaped("body_content"), F.lit("</p>")).alias("body"),
        )
        wrap = lambda items: F.to_json(F.struct(F.when(F.col("batch") % 10 == 9, 30).alias("backoff"), items.alias("items")))
        return self._batched(entry, wrap)

    def raw_releases(self) -> DataFrame:
        n = F.col("n")
        entry = F.struct(
            n.alias("id"),
            F.when(n % 8 == 0, " ").when(n % 8 == 1, F.concat(F.lit("Tool"), (n % 3).cast("string"), F.lit(" release "), "id")).otherwise(F.col("title")).alias("name"),
            F.concat(F.lit("v"), "id").alias("tag_name"),
            F.col("canonical_url").alias("html_url"),
            F.concat(F.lit("![shot](https://x.example.com/a.png) "), self._escaped("body_content")).alias("body"),
            F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
            (n % 12 == 0).alias("draft"),
            (n % 14 == 0).alias("prerelease"),
            F.struct((n % 200 - 20).alias("total_count")).alias("reactions"),
        )
        return self._batched(entry, F.to_json)

    def raw_rss(self) -> DataFrame:
        n = F.col("n")
        e = self._escaped
        tag = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))).otherwise("")
        entry = F.concat(
            F.lit("<item>"),
            tag("title", e(e("title"))),
            tag("link", F.when(n % 33 != 0, e(F.concat("canonical_url", F.lit("?utm_source=x&b=2&a=1"))))),
            F.concat(F.lit('<guid isPermaLink="false">g'), "id", F.lit("</guid>")),
            tag("dc:creator", e("author")),
            F.concat(F.lit("<description><![CDATA[<p>"), e(F.coalesce("summary", F.lit(""))), F.lit("</p>]]></description>")),
            F.concat(F.lit("<content:encoded><![CDATA[<div>"), e("body_content"), F.lit("</div>]]></content:encoded>")),
            tag("pubDate", F.date_format("published_at", "EEE, d MMM yyyy HH:mm:ss 'GMT'")),
            F.when(F.col("image_url").isNotNull(), F.concat(F.lit('<media:thumbnail url="'), "image_url", F.lit('"/>'))).otherwise(""),
            F.lit("</item>"),
        )
        head = '<rss version="2.0" xmlns:dc="urn:dc" xmlns:content="urn:content" xmlns:media="urn:media"><channel><title>All</title>'
        return self._batched(entry, lambda items: F.concat(F.lit(head), F.array_join(items, ""), F.lit("</channel></rss>")))

    def raw_atom(self) -> DataFrame:
        n = F.col("n")
        e = self._escaped
        entry = F.concat(
            F.lit("<entry><id>tag:"), "id", F.lit("</id><title>"), e(e("title")), F.lit("</title>"),
            F.when(n % 21 != 0, F.concat(F.lit('<link rel="self" href="https://feeds.example.com/self"/><link href="'), "canonical_url", F.lit('/"/>'))).otherwise(""),
            F.when(F.col("author").isNotNull(), F.concat(F.lit("<author><name>"), e("author"), F.lit("</name></author>"))).otherwise(""),
            F.lit("<content>"), e(e("body_content")), F.lit("</content>"),
            F.when(F.col("published_at").isNotNull(), F.concat(F.lit("<updated>"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated>"))).otherwise(""),
            F.lit("</entry>"),
        )
        return self._batched(entry, lambda items: F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), F.array_join(items, ""), F.lit("</feed>")))

    def raw_youtube(self) -> DataFrame:
        n = F.col("n")
        e = self._escaped
        entry = F.concat(
            F.lit("<entry><yt:videoId>vid"), "id", F.lit("</yt:videoId><title>"), e("title"), F.lit("</title>"),
            F.lit('<link rel="alternate" href="https://www.youtube.com/watch?v=other"/><author><name>Channel</name></author>'),
            F.when(F.col("published_at").isNotNull(), F.concat(F.lit("<published>"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</published>"))).otherwise(""),
            F.lit("<media:group><media:description>"), e(e("body_content")), F.lit('</media:description><media:thumbnail url="https://i.ytimg.com/vi/'), "id", F.lit('.jpg"/>'),
            F.lit('<media:community><media:starRating count="'), (n % 500).cast("string"), F.lit('"/><media:statistics views="'), (n * 37 % 9000).cast("string"), F.lit('"/></media:community></media:group></entry>'),
        )
        head = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:yt="urn:yt" xmlns:media="urn:media">'
        return self._batched(entry, lambda items: F.concat(F.lit(head), F.array_join(items, ""), F.lit("</feed>")))
