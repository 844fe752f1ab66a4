"""The ingest pass on a few payloads, in batch and as a stream."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions.language import Lexicon
from gleaner.operators import quota, reports, skew, state
from gleaner.operators.ingest import ingest_batch, ingest_into
from gleaner.sources import feeds
from gleaner.sources.snapshots import Change, Conflict, Snapshots
from gleaner.sources.tables import schema_of
from gleaner.streaming import jobs

BODY = "Widgets are small parts. " * 120


def entry(title, link, body=BODY, when="Tue, 30 Jan 2024 10:00:00 GMT"):
    return f"<item><title>{title}</title><link>{link}</link><description>About widgets</description><content:encoded>{body}</content:encoded><pubDate>{when}</pubDate></item>"


def payload(*entries):
    return '<rss xmlns:content="c"><channel>' + "".join(entries) + "</channel></rss>"


PAYLOADS = [
    ("p1", "good", payload(
        entry("Widgets learn to sing a new song today", "https://good.com/1?utm_source=x"),
        entry("Widgets learn to sing a new song today", "https://good.com/2"),
        entry("Widgets already stored in the table before", "https://good.com/stored"),
        entry("Widgets in short", "https://good.com/3", "Tiny."),
        entry("Widgets of last year", "https://good.com/4", when="Tue, 31 Jan 2023 10:00:00 GMT"),
    )),
    ("p2", "lost", payload(entry("Widgets nobody declared a topic for", "https://lost.com/1"))),
]


def tables(spark):
    return {
        "items": spark.createDataFrame(
            [("old", "good", "An unrelated stored headline", "https://good.com/stored")], "id string, source_id string, title string, canonical_url string"
        ).withColumn("url_hash", F.sha2("canonical_url", 256)).withColumn("fetched_at", F.lit("2024-01-29").cast("timestamp")),
        "sources": spark.createDataFrame(
            [("good", "official", None), ("lost", "community", None)], "source_id string, trust_tier string, max_article_age_days int"
        ),
        "source_topics": spark.createDataFrame([("good", 1)], "source_id string, topic_id bigint"),
        "topic_aliases": spark.createDataFrame([(1, "widgets")], "topic_id bigint, alias string"),
    }


def now():
    return F.lit("2024-01-31").cast("timestamp")


def raw(spark):
    return spark.createDataFrame(PAYLOADS, "payload_id string, source_id string, payload string")


def check_runs(rows):
    runs = {r["source_id"]: r for r in rows}
    good = runs["good"]
    assert (good["fetched"], good["inserted"], good["duplicates"], good["rejected"], good["status"]) == (4, 1, 1, 2, "succeeded")
    assert (runs["lost"]["status"], runs["lost"]["error_message"]) == ("failed", "SOURCE_TOPICS_MISSING")


def test_ingest_batch(spark):
    known = tables(spark)
    result = ingest_batch(feeds.normalize_rss(raw(spark)), known["items"], known["sources"], known["source_topics"], known["topic_aliases"], now(), lexicon=Lexicon([]))
    check_runs(result.runs.collect())
    assert [r["canonical_url"] for r in result.new_items.collect()] == ["https://good.com/1"]
    reasons = {r["canonical_url"]: r["reason"] for r in result.verdicts.collect()}
    assert reasons == {"https://good.com/1": "qualified", "https://good.com/2": "near_duplicate_title", "https://good.com/3": "thin_content"}
    assert {r["item_id"] for r in result.topic_links.collect()} == {result.new_items.first()["id"], "old"}


def seeded(spark, folder):
    """Stored tables as of version 0."""
    known, stored = tables(spark), Snapshots(spark, str(folder))
    schema = schema_of("content_items")
    items = known["items"]
    items = items.select(*[F.col(f.name) if f.name in items.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    sources = known["sources"].selectExpr("*", "CAST(NULL AS TIMESTAMP) AS last_fetched_at", "CAST(NULL AS TIMESTAMP) AS last_success_at", "CAST(NULL AS STRING) AS last_error")
    stored.commit("seed", 0, {"content_items": Change(items), "sources": Change(sources, ["source_id"])})
    return stored


def dictionaries(spark):
    known = tables(spark)
    return {name: known[name] for name in ("source_topics", "topic_aliases")}


def contents(stored):
    names = stored.manifest()["tables"]
    return {name: sorted(map(str, stored.read(name).drop("part").collect())) for name in names}


def test_ingest_stream_equals_the_batch_and_a_retry_changes_nothing(spark, tmp_path):
    raw(spark).write.parquet(str(tmp_path / "payloads"))
    stored = seeded(spark, tmp_path / "stream")

    def run(checkpoint):
        stream = spark.readStream.schema(raw(spark).schema).parquet(str(tmp_path / "payloads"))
        job = jobs.ingest_stream(stream, feeds.normalize_rss, stored, dictionaries, str(tmp_path / checkpoint), now(), lexicon=Lexicon([]))
        job.awaitTermination(120)

    run("checkpoint")
    by_stream, version = contents(stored), stored.version()
    runs = {r["source_id"]: r for r in stored.read("ingestion_runs").collect()}
    good, lost = runs["good"], runs["lost"]
    assert (good["items_seen"], good["items_inserted"], good["items_skipped"], good["status"], good["error_count"]) == (4, 1, 3, "succeeded", 0)
    assert (lost["status"], lost["error_message"], lost["error_count"]) == ("failed", "SOURCE_TOPICS_MISSING", 1)
    sources = {r["source_id"]: r for r in stored.read("sources").collect()}
    assert sources["good"]["last_success_at"] is not None and sources["good"]["last_error"] is None
    assert sources["lost"]["last_success_at"] is None and sources["lost"]["last_error"] == "SOURCE_TOPICS_MISSING"
    assert sources["lost"]["last_fetched_at"] is not None

    batch = seeded(spark, tmp_path / "batch")
    known = dictionaries(spark)
    assert ingest_into(batch, "ingest", 0, feeds.normalize_rss(raw(spark)), known["source_topics"], known["topic_aliases"], now(), lexicon=Lexicon([]))
    assert contents(batch) == by_stream
    # A stream that lost its checkpoint offers batch 0 again.
    run("lost checkpoint")
    assert stored.version() == version and contents(stored) == by_stream


def test_a_second_pass_finds_what_the_first_stored_and_folds_signals(spark, tmp_path):
    stored, known = seeded(spark, tmp_path / "tables"), dictionaries(spark)
    hits = feeds.normalize_rss(raw(spark)).withColumn("platform", F.lit("github"))
    for batch, count in enumerate((7, 3)):
        offered = hits.withColumn("engagement_count", F.lit(count).cast("bigint"))
        assert ingest_into(stored, "ingest", batch, offered, known["source_topics"], known["topic_aliases"], now(), lexicon=Lexicon([]))
    assert stored.read("content_items").count() == 2
    second = {(r["run_id"], r["items_inserted"]) for r in stored.read("ingestion_runs").filter("source_id = 'good'").collect()}
    assert second == {("ingest:0:good", 1), ("ingest:1:good", 0)}
    signals = state.signals_of(stored.read("signal_summaries")).collect()
    assert [(r["engagement_count"], r["source_count"]) for r in signals] == [(7, 1), (7, 1)]
    # Of one day and link the first verdict is kept.
    assert stored.read("discovery_candidates").groupBy("url_hash", "day").count().filter("count > 1").isEmpty()


def test_pages_that_failed_are_counted(spark):
    known = tables(spark)
    pages = spark.createDataFrame(
        [("https://good.com/1", "HTTP_403"), ("https://good.com/3", None)], "canonical_url string, error_code string"
    ).selectExpr("*", "'x' AS author", "'s' AS summary", "'b' AS body_text", "'i' AS image_url")
    result = ingest_batch(
        feeds.normalize_rss(raw(spark)), known["items"], known["sources"], known["source_topics"], known["topic_aliases"], now(), pages, lexicon=Lexicon([])
    )
    failures = {r["failure"]: r["failures"] for r in reports.fetch_failures(result.page_attempts).collect()}
    assert failures == {"good.com:HTTP_403": 1, "good.com:NOT_FETCHED": 1}
    (good,) = result.runs.filter("source_id = 'good'").collect()
    assert (good["pages_asked"], good["pages_failed"], good["enriched"]) == (3, 2, 1)


def test_snapshots_change_together(spark, tmp_path):
    stored = Snapshots(spark, str(tmp_path), most_parts=2)
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k int, v string")
    assert stored.read("a") is None and stored.version() == -1
    assert stored.commit("w", 0, {"a": Change(rows((1, "x"), (2, "y")), ["k"]), "log": Change(rows((1, "x")))})
    assert not stored.commit("w", 0, {"a": Change(rows((9, "again")), ["k"])})
    assert stored.commit("w", 1, {"a": Change(rows((2, "z"), (3, None)), ["k"]), "log": Change(rows((2, "y")))})
    assert sorted(map(tuple, stored.read("a").collect())) == [(1, "x"), (2, "z"), (3, None)]
    assert sorted(map(tuple, stored.read("a", 0).collect())) == [(1, "x"), (2, "y")]
    with pytest.raises(Conflict):
        stored.commit("other", 0, {"log": Change(rows((5, "v")))}, base=0)
    # What fails between two tables is not seen in either.
    broken = rows((7, "x")).withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        stored.commit("w", 2, {"log": Change(rows((6, "w"))), "a": Change(broken, ["k"])})
    assert stored.version() == 1 and stored.read("log").count() == 2
    assert stored.commit("w", 2, {"a": Change(rows((1, "n")), ["k"])})
    assert len(stored.manifest()["tables"]["a"]["parts"]) == 1
    assert sorted(map(tuple, stored.read("a").collect())) == [(1, "n"), (2, "z"), (3, None)]
    stored.expire()
    assert sorted(map(tuple, stored.read("a").collect())) == [(1, "n"), (2, "z"), (3, None)] and stored.read("log").count() == 2
    assert len(list((tmp_path / "data" / "a").iterdir())) == 1 and len(list((tmp_path / "versions").glob("*.json"))) == 1
    # Two writers that read one version: one publishes, the other is refused.
    manifest = stored.manifest()
    manifest["version"] += 1
    stored._publish(dict(manifest))
    with pytest.raises(Conflict):
        stored._publish(dict(manifest))


def test_verdict_stream_keeps_the_earliest_of_a_batch(spark, tmp_path):
    rows = spark.range(400).selectExpr(
        "sha2(CAST(id % 20 AS STRING), 256) AS url_hash", "'u' AS canonical_url", "CONCAT('t', id) AS title", "'s' AS source_id",
        "id / 1000D AS score", "false AS accepted", "'stale' AS reason", "id % 3 AS topic_id",
        "timestamp_seconds(1706000000 + (id * 7919 % 400) * 900) AS created_at",
    )
    rows.repartition(9).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    jobs.verdict_log_stream(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    columns = ["url_hash", "day", "title", "topic_id"]
    logged = spark.read.parquet(str(tmp_path / "out")).select(*columns)
    expected = state.verdict_log(rows).select(*columns)
    assert sorted(map(str, logged.collect())) == sorted(map(str, expected.collect()))
    # What comes later for a logged link and day changes nothing; a new day is logged.
    later = rows.filter("id < 20").withColumn("title", F.lit("later"))
    later.unionByName(later.withColumn("created_at", F.expr("created_at + INTERVAL 90 DAYS"))).write.mode("append").parquet(str(tmp_path / "in"))
    jobs.verdict_log_stream(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).filter("title = 'later'").count() == 20


def test_every_candidate_is_accounted_for_across_sources(spark):
    known = tables(spark)
    known["sources"] = spark.createDataFrame([("a", "official", None), ("b", "official", None)], "source_id string, trust_tier string, max_article_age_days int")
    known["source_topics"] = spark.createDataFrame([("a", 1), ("b", 1)], "source_id string, topic_id bigint")
    shared = "Widgets of two makers sing the very same song today"
    own = [entry(f"Widgets part {n} {n * 7} {n * 11} {n * 13}", f"https://a.com/{n}") for n in range(30)]
    raw_rows = [("p1", "a", payload(*own, entry(shared, "https://a.com/s"))), ("p2", "b", payload(entry(shared, "https://b.com/s")))]
    raw_table = spark.createDataFrame(raw_rows, "payload_id string, source_id string, payload string")
    result = ingest_batch(feeds.normalize_rss(raw_table), known["items"], known["sources"], known["source_topics"], known["topic_aliases"], now(), lexicon=Lexicon([]))
    runs = {r["source_id"]: r for r in result.runs.collect()}
    assert (runs["a"]["fetched"], runs["b"]["fetched"]) == (31, 1) and result.verdicts.count() == 32
    assert [r["source_id"] for r in result.new_items.filter(F.col("title") == shared).collect()] == ["a"]
    assert all(r["fetched"] == r["inserted"] + r["duplicates"] + r["rejected"] for r in runs.values())


def test_signals_of_many_batches_equal_one_fold_and_write_what_they_touch(spark, tmp_path):
    hits = spark.range(600).selectExpr(
        "CAST(id % 5 AS STRING) AS item_id", "id AS hit_id", "timestamp_seconds(1706000000 + id * 60) AS seen_at",
        "element_at(array('github', 'reddit', 'dev_to'), CAST(id * id % 3 + 1 AS INT)) AS platform", "CAST(id % 50 AS DOUBLE) AS reported",
        "'s1' AS source_id", "CASE WHEN id % 2 = 0 THEN 's2' END AS stored_source_id",
    )
    for n in range(6):
        hits.filter(f"hit_id DIV 100 = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    only = hits.filter("hit_id = 5").selectExpr("'lone' AS item_id", "hit_id + 1000 AS hit_id", "seen_at + INTERVAL 9 DAYS AS seen_at", "platform", "reported", "source_id", "stored_source_id")
    stored = Snapshots(spark, str(tmp_path / "tables"), most_parts=3)

    def run():
        stream = spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.signals_stream(stream, stored, str(tmp_path / "checkpoint")).awaitTermination(120)

    run()
    only.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    expected = state.signals_fold(hits.unionByName(only)).collect()
    got = state.signals_of(stored.read("signal_summaries")).collect()
    assert sorted(map(str, got)) == sorted(map(str, expected)) and len(got) == 6
    manifest = stored.manifest()
    assert manifest["version"] >= 6 and len(manifest["tables"]["signal_summaries"]["parts"]) <= 3
    last = manifest["tables"]["signal_summaries"]["parts"][-1]
    assert spark.read.parquet(f"{tmp_path}/tables/{last}").count() in (1, 6)
    assert len(list((tmp_path / "tables" / "data" / "signal_summaries").iterdir())) <= 5


def test_one_item_with_all_hits_is_many_tasks(spark):
    hits = spark.range(4000).selectExpr(
        "'hot' AS item_id", "id AS hit_id", "timestamp_seconds(1706000000 + id % 3000) AS seen_at", "IF(id % 7 = 0, 'github', 'reddit') AS platform",
        "1.0D AS reported", "'s1' AS source_id", "'s2' AS stored_source_id",
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    try:
        looked = skew.with_last(hits, "item_id", [F.col("seen_at").asc(), F.col("hit_id").asc()], "platform", "before")
        rows = looked.collect()
        ranges = hits.repartitionByRange("item_id", "seen_at", "hit_id").select(F.spark_partition_id()).distinct().count()
        signals = state.signals_fold(hits).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranges > 1
    assert [(row["engagement_count"], row["source_count"]) for row in signals] == [(1, 2)]
    ordered = sorted(rows, key=lambda row: (row["seen_at"], row["hit_id"]))
    assert [row["before"] for row in ordered] == [None, *[row["platform"] for row in ordered[:-1]]]


def test_quota_with_costs_is_first_fit(spark):
    costs = [3, 5, 4, 1, 9, 2, 1, 0, 1]
    rows = [("p", n, f"2024-01-01 00:00:{n:02d}", c) for n, c in enumerate(costs)] + [("other", 99, "2024-01-01 00:00:00", 1)]
    asked = spark.createDataFrame(rows, "platform string, request_id long, at string, cost int").withColumn("asked_at", F.col("at").cast("timestamp"))
    decided = quota.quota_ledger(asked, budgets=quota.budget_table(spark, {"p": (10, 60)})).collect()
    assert {row["request_id"]: row["granted"] for row in decided} == {0: True, 1: True, 2: False, 3: True, 4: False, 5: False, 6: True, 7: False, 8: False}
    opened = quota.open_windows(quota.quota_ledger(asked.filter("request_id < 3"), budgets=quota.budget_table(spark, {"p": (10, 60)})))
    assert [row["used"] for row in opened.collect()] == [8]
    rest = quota.quota_ledger(asked.filter("request_id >= 3"), opened, quota.budget_table(spark, {"p": (10, 60)})).collect()
    assert {row["request_id"] for row in rest if row["granted"]} == {3, 6}
