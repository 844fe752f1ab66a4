"""Documents without a word, as tables at size hold them."""

import duckdb
from compare import difference

import __spark_entry__ as contract
from gleaner.sources import apis

TEXTS = ["", "   ", "\n\n", "A text of a few words."]


def test_releases_of_blank_documents_match_their_sql(spark, tmp_path):
    rows = [(n, TEXTS[n % len(TEXTS)], "en", "src1") for n in range(100, 124)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    name = "normalize_github_releases"
    problem, count = difference(spark, con, str(tmp_path), contract.queries()[name], contract.oracle_sql()[name])
    assert problem is None, problem
    assert count > 10


def test_a_release_without_a_name_goes_by_its_tag(spark):
    names = {1: '"name":"",', 2: '"name":"  ",', 3: "", 4: '"name":"Notes",'}
    listed = ",".join(
        f'{{"id":{k},{name}"tag_name":"v{k}","html_url":"https://e.com/{k}","published_at":"2024-01-01T00:00:00Z"}}' for k, name in names.items()
    )
    raw = spark.createDataFrame([("p", "s", "a/b", f"[{listed}]")], "payload_id string, source_id string, repo string, payload string")

    def titles(**options):
        return [r["title"] for r in apis.normalize_github_releases(raw, **options).orderBy("external_id").collect()]

    assert titles() == ["a/b v1", "a/b v2", "a/b v3", "a/b Notes"]
    assert titles(keep_empty_names=True) == ["a/b ", "a/b v2", "a/b v3", "a/b Notes"]
