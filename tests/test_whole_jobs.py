"""Places where a query once did less than the whole job, each on the least input that shows it."""

from datetime import datetime
from pathlib import Path

from compare import difference, oracle
from pyspark.sql import functions as F

import __spark_entry__ as contract
from gleaner.functions.language import Lexicon
from gleaner.operators import dedupe
from gleaner.plans.fixtures import Fixtures
from gleaner.plans.stream_fixtures import streamed_table
from gleaner.sources import pages

FOLDER = "/root/testdata/sf0.001"


def test_purge_query_spares_what_any_reader_saved(spark):
    plan = contract.queries()["language_purge_plan"](spark, FOLDER)
    saved = {r.item_id for r in Fixtures(spark, FOLDER).saved().filter("user_id >= 2").select("item_id").distinct().collect()}
    actions = {r.id: r.action for r in plan.collect()}
    assert saved & set(actions)
    assert not {i for i in saved & set(actions) if actions[i] == "remove"}


def test_purge_plan_has_each_action(spark):
    now, foreign = datetime(2024, 1, 31), "der hund und die katze sind nicht auf dem dach und der mann ist im haus " * 5
    items = spark.createDataFrame(
        [(i, foreign, foreign, foreign, now) for i in ("a", "b", "c", "d")] + [("e", "The dog", "The dog is here", "The dog is in the house", now)],
        "id string, title string, summary string, body_content string, fetched_at timestamp",
    )
    saved = spark.createDataFrame([(0, "b"), (70, "c"), (71, "d"), (72, "e")], "user_id long, item_id string")
    submissions = spark.createDataFrame([(1, "d"), (2, None)], "submission_id long, item_id string")
    lexicon = Lexicon(["der", "und", "die", "nicht", "auf", "dem", "ist", "im"])
    plan = dedupe.language_purge_plan(items, saved, submissions, F.lit(now), lexicon=lexicon)
    assert {r.id: r.action for r in plan.collect()} == {
        "a": "remove", "b": "saved_by_reader", "c": "saved_by_reader", "d": "reader_submission",
    }


def test_copies_of_one_title_are_members_of_an_edition(spark):
    title = "one title that nothing else resembles"
    rows = [(f"c{i}", title, datetime(2024, 1, 1 + i % 6)) for i in range(30)]
    rows += [("late", title, datetime(2024, 3, 1)), ("alone", "quite another headline here", None), ("none", "", None)]
    items = spark.createDataFrame(rows, "id string, title string, published_at timestamp")
    members = dedupe.edition_members(items).collect()
    assert sorted((r.id, r["items"]) for r in members) == sorted([(f"c{i}", 30) for i in range(30)] + [("late", 1), ("alone", 1)])
    assert len({r.node for r in members}) == 3
    assert dedupe.duplicate_pairs(items).count() == 0


def test_members_match_their_sql(spark):
    name = "duplicate_members"
    problem, rows = difference(spark, oracle(FOLDER), FOLDER, contract.queries()[name], contract.oracle_sql()[name])
    assert problem is None and rows > 0, problem


def test_streams_read_tables_that_are_folders_of_parts(spark, tmp_path):
    whole = spark.read.parquet(f"{FOLDER}/documents.parquet")
    whole.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (FOLDER, tmp_path):
        taken = []
        stream = streamed_table(Fixtures(spark, str(folder)), "documents")
        job = stream.writeStream.foreachBatch(lambda batch, _: taken.append(batch.count()))
        job.option("checkpointLocation", f"{tmp_path}/{len(str(folder))}").trigger(availableNow=True).start().awaitTermination()
        assert sum(taken) == whole.count()


def test_page_engagement_searches_a_page_for_links_once(spark):
    html = '<link rel="image_src" href="https://miro.medium.com/a.png"><i>"clapCount":7</i>'
    found = pages.page_engagement(spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id long, html string"))
    assert {tuple(row) for row in found.collect()} == {(1, 7, "https://miro.medium.com/a.png"), (2, 0, None), (3, 0, None)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("<link") == 1
