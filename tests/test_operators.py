"""Operators on small tables, against brute force and under skew."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleaner.functions.language import Lexicon
from gleaner.operators import dedupe, gate, precedence, quota, ranking, similarity, skew, state, topics
from gleaner.operators.components import connected_components
from gleaner.operators.skew import checked_join

NOW = datetime(2024, 1, 31)


def sql_now():
    return F.lit("2024-01-31").cast("timestamp")


def shingle_set(title):
    words = [w for w in "".join(c if c.isalnum() else " " for c in title.lower()).split()]
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} if len(words) > 1 else set(words)


def alike(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return bool(a and b) and len(a & b) / len(a | b) > 0.8


def titles_of(seed, total):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(rng.randint(1, 14))) for _ in range(12)]
    out = []
    for _ in range(total):
        words = rng.choice(base).split()
        if rng.random() < 0.4:
            words[rng.randrange(len(words))] = rng.choice("xyz") * 3
        if rng.random() < 0.2:
            words.append("tail")
        out.append(" ".join(words))
    return out


def brute_groups(rows):
    parent = {row[0]: row[0] for row in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(rows, 2):
        near = a[2] is None or b[2] is None or abs(a[2] - b[2]) <= timedelta(days=7)
        if near and alike(a[1], b[1]):
            parent[find(a[0])] = find(b[0])
    groups = {}
    for row in rows:
        groups.setdefault(find(row[0]), set()).add(row[0])
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def item_table(spark, rows):
    data = [(i, t, p, p, "word " * 3, None, None) for i, t, p in rows]
    return spark.createDataFrame(
        data, "id string, title string, published_at timestamp, fetched_at timestamp, body_content string, image_url string, author string"
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_duplicate_groups_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 3)
    rng = random.Random(seed)
    rows = [
        (f"i{n:03d}", title, None if rng.random() < 0.05 else NOW - timedelta(hours=rng.randint(0, 1400)))
        for n, title in enumerate(titles_of(seed, 120))
    ]
    found = dedupe.duplicate_groups(item_table(spark, rows)).collect()
    groups = {}
    for row in found:
        groups.setdefault(row["keep_id"], set()).add(row["id"])
    assert {frozenset(g) for g in groups.values()} == brute_groups(rows)


def test_a_third_of_all_rows_with_one_title(spark):
    """Copies make one edition per run of dates; pairs do not grow with their number."""
    hot = [(f"h{n:04d}", "The very same headline again and again", NOW - timedelta(days=n % 5)) for n in range(400)]
    old = [(f"o{n:04d}", "The very same headline again and again", NOW - timedelta(days=100 + n % 3)) for n in range(200)]
    cold = [(f"c{n:04d}", f"Story {n} about topic{n} with words{n * 7}", NOW) for n in range(600)]
    items = item_table(spark, hot + old + cold)
    assert dedupe.duplicate_pairs(items).count() == 0
    sizes = {r["keep_id"]: r["members"] for r in dedupe.duplicate_groups(items).select("keep_id", "members").distinct().collect()}
    assert sorted(sizes.values()) == [200, 400]


def test_groups_do_not_depend_on_partitioning(spark):
    rows = [(f"i{n}", t, NOW - timedelta(days=n % 9)) for n, t in enumerate(titles_of(5, 60))]
    once = sorted(map(tuple, dedupe.duplicate_groups(item_table(spark, rows)).collect()))
    again = sorted(map(tuple, dedupe.duplicate_groups(item_table(spark, rows[::-1]).repartition(7)).collect()))
    assert once == again


def test_components_of_chain_star_and_cycle(spark):
    chain = [(f"a{n:03d}", f"a{n + 1:03d}") for n in range(60)]
    star = [("b000", f"b{n:03d}") for n in range(1, 50)]
    cycle = [(f"c{n}", f"c{(n + 1) % 7}") for n in range(7)]
    edges = spark.createDataFrame(chain + star + cycle, "src string, dst string")
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert {v for k, v in found.items() if k[0] == "a"} == {"a000"}
    assert {v for k, v in found.items() if k[0] == "b"} == {"b000"}
    assert {v for k, v in found.items() if k[0] == "c"} == {"c0"}


def test_near_duplicate_titles(spark):
    stored = titles_of(3, 40)
    asked = titles_of(4, 40) + stored[:3]
    candidates = spark.createDataFrame([(str(n), t) for n, t in enumerate(asked)], "id string, title string")
    known = spark.createDataFrame([(t,) for t in stored], "title string")
    found = {int(r["id"]) for r in similarity.near_duplicate_titles(candidates, known).collect()}
    assert found == {n for n, t in enumerate(asked) if any(alike(t, s) for s in stored)}


def in_batch(rows, across):
    """ids blocked, by walking the rows in order."""
    held, out = {}, set()
    for source, place, id_, title, eligible in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        kept = held.setdefault("" if across else source, [])
        if any(alike(title, other) for other in kept):
            out.add(id_)
        elif eligible:
            kept.append(title)
    return out


@pytest.mark.parametrize("across, fold_edges", [(False, 200_000), (True, 200_000), (False, 4), (True, 4), (True, 0)])
def test_in_batch_decides_as_a_walk_does(spark, monkeypatch, across, fold_edges):
    monkeypatch.setattr(precedence, "FOLD_EDGES", fold_edges)
    titles = titles_of(11, 60) + titles_of(11, 20) + ["", "word"]
    rows = [(f"s{n * 7 % 4}", n * 13 % 83, str(n), t, n % 5 > 0) for n, t in enumerate(titles)]
    table = spark.createDataFrame(rows, "source_id string, place int, id string, title string, eligible boolean")
    found = gate.near_duplicate_in_batch(table, within=None if across else "source_id").filter("in_batch").collect()
    assert {r["id"] for r in found} == in_batch(rows, across)


def test_a_long_chain_takes_few_jobs(spark):
    edges = spark.range(1, 5001).selectExpr("'r' AS run", "id AS later", "id - 1 AS earlier", "id AS turn")
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        blocked = {r["node"] for r in precedence.blocked_nodes(edges).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert blocked == set(range(1, 5001, 2)) and jobs < 20


def test_components_decide_for_themselves(spark, monkeypatch):
    monkeypatch.setattr(precedence, "FOLD_EDGES", 60)
    rng = random.Random(3)
    edges = {(k % 40 * 100 + a, k % 40 * 100 + b) for k in range(900) for b, a in [sorted(rng.sample(range(12 + k % 40), 2))]}
    edges |= {(9000 + k, 9000 + k - d) for k in range(3, 40) for d in (1, 3)}  # a component above the limit
    accepted_by = {}
    for later, earlier in edges:
        accepted_by.setdefault(later, []).append(earlier)
    blocked = set()
    for later in sorted(accepted_by):
        if any(e not in blocked for e in accepted_by[later]):
            blocked.add(later)
    df = spark.createDataFrame([("r", a, b, a) for a, b in sorted(edges)], "run string, later long, earlier long, turn long")
    assert sorted(r["node"] for r in precedence.blocked_nodes(df).collect()) == sorted(blocked)


def test_one_source_may_offer_many(spark):
    table = spark.range(100_000).selectExpr(
        "'s' AS source_id", "CAST(id AS INT) AS place", "CAST(id AS STRING) AS id", "true AS eligible",
        "CASE WHEN id % 3 = 0 THEN 'the same long headline about one thing' ELSE concat('story ', id, ' of ', id * 7, ' words ', id * 11) END AS title",
    )
    assert gate.near_duplicate_in_batch(table).filter("in_batch").count() == 33_333


def test_in_batch_only_accepted_titles_block(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [("s", 1, "1", long, False), ("s", 2, "2", long, True), ("s", 3, "3", long, True), ("t", 1, "4", long, True)]
    table = spark.createDataFrame(rows, "source_id string, place int, id string, title string, eligible boolean")
    assert {r["id"]: r["in_batch"] for r in gate.near_duplicate_in_batch(table).collect()} == {"1": False, "2": False, "3": True, "4": False}


def candidate(**over):
    row = {
        "id": "1", "source_id": "s", "title": "Widgets reach version two", "summary": None, "body_text": "word " * 500,
        "canonical_url": "https://e.com/1", "published_at": NOW, "kind": "article", "engagement_count": None, "platform": None,
        "paywalled": False, "duplicate": False,
    }
    return {**row, **over}


SCHEMA = (
    "id string, source_id string, title string, summary string, body_text string, canonical_url string, published_at timestamp, "
    "kind string, engagement_count bigint, platform string, paywalled boolean, duplicate boolean"
)


@pytest.mark.parametrize(
    "over, reason",
    [
        ({}, "qualified"),
        ({"duplicate": True}, "duplicate_url_hash"),
        ({"canonical_url": "https://old.reddit.com/r/x"}, "aggregator_domain"),
        ({"canonical_url": "https://notreddit.com/r/x"}, "qualified"),
        ({"summary": "A sponsored post"}, "spam_markers"),
        ({"body_text": "Subscribe to continue"}, "paywalled_without_summary"),
        ({"paywalled": True, "body_text": None}, "paywalled_without_summary"),
        ({"title": "Полное руководство widgets по нейросетям и данным"}, "non_english"),
        ({"title": "Nothing here"}, "no_topic_relevance"),
        ({"body_text": "widgets " * 20}, "thin_content"),
        ({"body_text": "widgets " * 20, "kind": "release"}, "qualified"),
        ({"body_text": ""}, "no_extractable_content"),
        ({"published_at": NOW - timedelta(days=61)}, "stale"),
        ({"published_at": NOW - timedelta(days=61), "kind": "release"}, "qualified"),
        ({"title": "Other", "body_text": "word " * 150 + "widgets", "engagement_count": 0, "platform": "dev_to"}, "qualified"),
        ({"title": "Other", "body_text": "word " * 150 + "widgets", "engagement_count": 0, "platform": "dev_to", "published_at": NOW - timedelta(days=30)}, "below_threshold"),
    ],
)
def test_gate_reasons(spark, over, reason):
    fields = [f.split()[0] for f in SCHEMA.split(", ")]
    row = candidate(**over)
    table = spark.createDataFrame([tuple(row[f] for f in fields)], SCHEMA)
    context = spark.createDataFrame([("s", ["widgets"], "official")], "source_id string, aliases array<string>, trust string")
    verdict = gate.qualify(table, context, sql_now(), lexicon=Lexicon([])).first()
    assert verdict["reason"] == reason
    assert verdict["accepted"] is (reason == "qualified")


def test_weights_and_redistribution(spark):
    assert sum(gate.WEIGHTS.values()) == pytest.approx(1)
    fields = [f.split()[0] for f in SCHEMA.split(", ")]
    rows = [candidate(id="none"), candidate(id="zero", engagement_count=0, platform="hacker_news"), candidate(id="full", engagement_count=50, platform="hacker_news")]
    table = spark.createDataFrame([tuple(r[f] for f in fields) for r in rows], SCHEMA)
    context = spark.createDataFrame([("s", ["widgets"], "official")], "source_id string, aliases array<string>, trust string")
    scores = {r["id"]: r["score"] for r in gate.qualify(table, context, sql_now(), lexicon=Lexicon([])).collect()}
    assert scores["none"] == pytest.approx(1) and scores["full"] == pytest.approx(1) and scores["zero"] == pytest.approx(0.85)


def test_leading_topic_and_default_dictionary(spark):
    rows = [("1", "NVIDIA doubles CUDA speed", "OpenAI is named once", None, []), ("2", "No names", "none", "reactjs and tsconfig", [])]
    items = spark.createDataFrame(rows, "id string, title string, summary string, body_content string, topics array<bigint>")
    words = topics.default_dictionary(spark)
    lead = {r["id"]: r["leading_topics"] for r in topics.leading_topics(items, words).collect()}
    assert lead == {"1": [2], "2": []}
    found = {(r["id"], r["topic_id"]): r["hits"] for r in topics.classify(items, words).collect()}
    assert found == {("1", 0): 1, ("1", 2): 2, ("2", 8): 2, ("2", 9): 1}


def test_positions_of_a_hot_reader(spark):
    rows = [("hot" if n % 3 else f"u{n % 7}", str(n).zfill(5), float(n * 37 % 50)) for n in range(3000)]
    table = spark.createDataFrame(rows, "user_id string, id string, for_you_score double")
    placed = ranking.positions(table, "user_id", ranking.view_order("for-you")).collect()
    by_user = {}
    for user, item, score in rows:
        by_user.setdefault(user, []).append((-score, item))
    expected = {(user, item): n for user, listed in by_user.items() for n, (_, item) in enumerate(sorted(listed), 1)}
    assert {(r["user_id"], r["id"]): r["position"] for r in placed} == expected


def test_salted_join_is_a_plain_join(spark):
    many = spark.createDataFrame([(0 if n % 3 else n % 5, n) for n in range(300)], "k int, item int")
    few = spark.createDataFrame([(n % 5, n) for n in range(20)], "k int, reader int")
    plain = many.join(few, "k").select("k", "item", "reader").collect()
    salted = skew.salted_join(many, few, "k", "item", block_rows=10).select("k", "item", "reader").collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, salted))


def test_quota_ledger_matches_a_sequential_walk(spark):
    rng = random.Random(7)
    at, rows = {"github": NOW, "stack_exchange": NOW}, []
    for n in range(900):
        platform = rng.choice(list(at))
        at[platform] += timedelta(seconds=rng.choice([0, 1, 40, 300, 3600 if rng.random() < 0.1 else 5]))
        rows.append((platform, n, at[platform]))
    requests = spark.createDataFrame(rows, "platform string, request_id bigint, asked_at timestamp")
    start, used, expected = {}, {}, {}
    for platform, n, when in sorted(rows, key=lambda r: (r[2], r[1])):
        limit, minutes = quota.BUDGETS[platform]
        if platform not in start or start[platform] < when - timedelta(minutes=minutes):
            start[platform], used[platform] = when, 0
        expected[n] = used[platform] < limit
        used[platform] += expected[n]
    decided = quota.quota_ledger(requests)
    assert {r["request_id"]: r["granted"] for r in decided.collect()} == expected
    middle = sorted(r[2] for r in rows)[450]
    first = quota.quota_ledger(requests.filter(F.col("asked_at") <= middle))
    second = quota.quota_ledger(requests.filter(F.col("asked_at") > middle), quota.open_windows(first))
    assert {r["request_id"]: r["granted"] for r in first.unionByName(second).collect()} == expected


def test_signals_fold_in_two_stretches(spark):
    rng = random.Random(9)
    rows = [
        (str(rng.randrange(4)), n, NOW + timedelta(minutes=rng.randrange(3000)), rng.choice(["a", "b"]), rng.choice([None, -3.0, 7.9, 20.0]), rng.choice(["s", "t"]), rng.choice([None, "s"]))
        for n in range(200)
    ]
    hits = spark.createDataFrame(rows, "item_id string, hit_id bigint, seen_at timestamp, platform string, reported double, source_id string, stored_source_id string")
    expected = {}
    for item, _, _, platform, reported, source, stored in sorted(rows, key=lambda r: (r[2], r[1])):
        if reported is None:
            continue
        best, count, last = expected.get(item, (0, 1, None))
        independent = stored is not None and stored != source and last != platform
        expected[item] = (max(best, max(0, int(reported // 1))), max(count, 2 if independent else 1), platform)
    found = {r["item_id"]: (r["engagement_count"], r["source_count"], r["platform"]) for r in state.signals_fold(hits).collect()}
    assert found == expected
    middle = NOW + timedelta(minutes=1500)
    halves = state.merge_hit_summaries(state.hit_summaries(hits.filter(F.col("seen_at") <= middle)), state.hit_summaries(hits.filter(F.col("seen_at") > middle)))
    merged = {r["item_id"]: (r["engagement_count"], r["source_count"], r["platform"]) for r in state.signals_of(halves).collect()}
    assert merged == expected


def test_texts_stay_where_they_are_scanned(spark):
    """No exchange above a text column in the gate, even where Spark broadcasts nothing by itself."""
    fields = [f.split()[0] for f in SCHEMA.split(", ")]
    table = spark.createDataFrame([tuple(candidate()[f] for f in fields)] * 3, SCHEMA)
    context = spark.createDataFrame([("s", ["widgets"], "official")], "source_id string, aliases array<string>, trust string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = gate.qualify(table, context, sql_now(), lexicon=Lexicon([]))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_checked_join_beyond_its_size(spark):
    many = spark.range(500).selectExpr("id", "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 3 > 0 THEN 'hot' ELSE 'k' || id % 7 END AS k", "'t' AS text")
    few = spark.createDataFrame([("hot", 1), ("k1", 2), ("k9", 3)], "k string, v int")
    expected = sorted((r["id"], r["k"], r["v"] or 0) for r in many.join(few, "k", "left").collect())
    for most in (0, 1 << 20):
        found = checked_join(many, few, "k", "id", most)
        assert sorted((r["id"], r["k"], r["v"] or 0) for r in found.collect()) == expected


def test_key_points_stay_in_the_rows_of_their_texts(spark):
    from gleaner.operators import summary

    texts = [("a", None), ("b", ""), ("c", " ".join(f"The number {n} of widgets grew by {n % 7} parts in the plant of town {n % 3}." for n in range(3000)))]
    rows = spark.createDataFrame(texts, "id string, body_content string")
    points = summary.key_points(rows, 4)
    assert "Exchange" not in points._jdf.queryExecution().executedPlan().toString()
    (row,) = points.collect()
    assert row["id"] == "c" and len(row["points"]) == 4
    assert summary.key_points(rows.limit(0)).count() == 0


def test_a_large_dictionary_is_joined(spark):
    from gleaner.operators import topics

    rows = [("a", "Widget999x and widget7x", None, "tail widget12345x"), ("b", None, "", None), ("c", "x", "über Größe", "nothing"), ("d", "ab", "c", "")]
    items = spark.createDataFrame(rows, "id string, title string, summary string, body_content string")
    named = spark.range(30_000).selectExpr("id % 97 AS topic_id", "concat('Widget', id, 'x') AS alias")
    short = spark.createDataFrame([(500, "x"), (501, "GRÖSSE"), (501, "größe"), (502, "ab c"), (503, "")], "topic_id bigint, alias string")
    large = named.unionByName(short).filter("alias <> ''")
    joined = topics.classify(items, large)
    assert "calar" not in joined._jdf.queryExecution().optimizedPlan().toString()
    inline = topics.classify(items, large, inline_bytes=1 << 30)
    columns = ["id", "topic_id", "hits", "confidence"]
    assert sorted(map(tuple, joined.select(*columns).collect())) == sorted(map(tuple, inline.select(*columns).collect()))
    some = large.filter("topic_id > 90 OR alias LIKE '%999x'")
    by_join = topics.leading_topics(items.filter("title IS NOT NULL"), some, inline_bytes=0)
    in_place = topics.leading_topics(items.filter("title IS NOT NULL"), some, inline_bytes=1 << 30)
    columns = ["id", "leading_topics", "leading_weight"]
    assert sorted(map(str, by_join.select(*columns).collect())) == sorted(map(str, in_place.select(*columns).collect()))
    assert topics.classify(items, large.limit(0), inline_bytes=-1).count() == 0
    # Without room for a broadcast, probes are joined by run.
    texts = items.selectExpr("id", "lower(concat_ws(' ', title, summary, body_content)) AS text")
    lowered = large.selectExpr("lower(alias) AS alias")
    wide, narrow = (sorted(map(tuple, topics.matched_aliases(texts, lowered, b).collect())) for b in (0, 1 << 26))
    assert wide == narrow and ("a", "widget999x") in wide and ("d", "ab c") in wide
