"""The LSH forest, conversation repair and collocations against plain versions."""

import random

import llm_brute as brute
import pyarrow as pa
import pytest
from pyspark.sql import Row
from test_llm_operators import odd_rows, random_rows, same, table

from gleaner.llm import collocations, conversation_repair, minhash_forest, ngram_jaccard, quality_rules, substring_dedup, words


def thue_morse(first, length=1024):
    return "".join("ab"[(bin(k).count("1") + first) & 1] for k in range(length))


def near_rows(seed, families=6, copies=25):
    rng = random.Random(seed)
    out = []
    for f in range(families):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(30, 200))]
        for c in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 9)}"
            text = " ".join(own)
            out.append((1000 + f * copies + c, text.upper() if rng.random() < 0.2 else text, "a"))
    rng.shuffle(out)
    return out


def rows_of(rows):
    return [Row(doc_id=i, text=t, source=s, lang=None) for i, t, s in rows]


def test_patterned_letters_do_not_collide(spark):
    a, b = thue_morse(0), thue_morse(1)
    (block,) = words.blocks(pa.array([f"{a} {b}"]))
    for kind in (0, 1):
        first, second = block.word_hashes(kind)
        assert first != second
        pattern, other = block.word_hashes(kind)[[int(c == "b") for c in a]], block.word_hashes(kind)[[int(c == "a") for c in a]]
        (x,), (y,) = (words.window_hashes(h, pattern.nonzero()[0][:1] * 0, 1024, kind) for h in (pattern, other))
        assert x != y
    shared = " ".join(f"s{k}" for k in range(49))
    df = table(spark, [(1, f"{a} {shared}", "h"), (2, f"{b} {shared}", "h")])
    assert {row["n_removed"] for row in substring_dedup.digests(df).collect()} == {0}
    third = [" ".join(x if k % 3 == 0 else f"c{k}" for k in range(60)) for x in (a, b)]
    df = table(spark, [(1, third[0], "h"), (2, third[1], "h"), (3, f"{a}\n{b}", "h")])
    assert len({row["class_id"] for row in ngram_jaccard.classes(df).collect()}) == 3
    assert {row["component_id"] for row in minhash_forest.near_duplicates(df).collect()} == {1, 2, 3}
    lines = {row["doc_id"]: row["n_dup_lines"] for row in quality_rules.verdicts(df).collect()}
    assert lines[3] == 0


def test_windows_of_any_size_tell_their_words_apart():
    rng = random.Random(3)
    text = " ".join(rng.choice("abc") for _ in range(400))
    (block,) = words.blocks(pa.array([text]))
    own = brute.words(text)
    for size in (1, 2, 3, 5, 8, 20, 50):
        starts = block.window_starts(size)
        seen = {}
        for at, h in zip(starts.tolist(), words.window_hashes(block.word_hashes(), starts, size).tolist(), strict=True):
            assert seen.setdefault(tuple(own[at : at + size]), h) == h
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("limits", [None, (2, 3)])
def test_forest(spark, monkeypatch, limits):
    if limits:
        monkeypatch.setattr(minhash_forest, "REGION_ROWS", limits[0])
        monkeypatch.setattr(minhash_forest, "BLOCK_ROWS", limits[1])
    rows = odd_rows() + random_rows(5, 40) + near_rows(6)
    got = minhash_forest.near_duplicates(table(spark, rows))
    expected = [(d.doc_id, *x) for d, x in zip(rows_of(rows), brute.forest_components(rows_of(rows)), strict=True)]
    same(got.select("doc_id", "n_shingles", "component_id", "kept"), expected)
    same(minhash_forest.near_duplicates(table(spark, rows).limit(0)), [])


def test_forest_finds_nearly_all_pairs():
    assert minhash_forest.loss(0.85) < 1e-4
    assert minhash_forest.loss(0.9) < 1e-6
    assert 0 < minhash_forest.agreement_for(0.85) < minhash_forest.VALUES * 0.85


CONVERSATIONS = "conv_id string, turn long, role string, text string, conv_key string, audit string, kind int"


def talks(seed, count=60):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "tool", "", None]
    texts = ["Hi.", "Yes!", "No?", "cut off", "", " \t", None, "Hi.", "é.\x0b", "x" * 3000 + "."]
    out = []
    for c in range(count):
        for _ in range(rng.randint(0, 4)):
            turn = rng.choice([None, 0, 1, 2, 3, 9])
            out.append((None if c == 7 else f"c{c}", turn, rng.choice(roles), rng.choice(texts)))
    return out + [("all", t, r, "Same.") for t, r in enumerate(["user", "assistant"] * 2)] + [("", 1, "user", "Hi.")]


def by_conversation(rows):
    found = {}
    for conv_id, *row in rows:
        found.setdefault(conv_id, []).append(tuple(row))
    return found


@pytest.mark.parametrize("limits", [{}, {"large_rows": 1, "block_rows": 1}, {"large_bytes": 5, "block_rows": 2}])
def test_conversations_are_repaired(spark, limits):
    rows = talks(11)
    df = spark.createDataFrame([(*row, "k", "a", 1) for row in rows], CONVERSATIONS).repartition(5)
    got = conversation_repair.judged(df, **limits)
    expected = [(key, *brute.repair(own)) for key, own in by_conversation(rows).items()]
    same(got, expected)
    turns = conversation_repair.repaired_turns(df, got).collect()
    made = {}
    for row in sorted(turns, key=lambda row: row["at"]):
        made.setdefault(row["conv_id"], []).append(f"{row['role']}:{row['text']}")
    for row in got.collect():
        assert brute.sha("\n".join(made.get(row["conv_id"], []))) == row["repaired_sha256"]


def test_no_conversations_and_no_rows_left(spark):
    df = spark.createDataFrame([], CONVERSATIONS)
    assert conversation_repair.judged(df).count() == 0
    every = spark.createDataFrame([("gone", 1, "user", "Hi.", "", "", 0)], CONVERSATIONS)
    (row,) = conversation_repair.judged(df, every).collect()
    assert tuple(row) == ("gone", 0, 0, 0, 0, 0, 0, "", brute.sha(""))


def test_one_long_conversation_in_tables_equals_one_pass():
    rng = random.Random(2)
    rows = [(rng.random() < 0.2, rng.random() < 0.2, rng.choice("suax")) for _ in range(700)]
    whole = conversation_repair.decided(conversation_repair.table_of(rows))
    for size in (1, 7, 128):
        tables = conversation_repair._Tables(size)
        for row in rows:
            tables.add(row)
        assert conversation_repair.decided(tables.whole()) == whole


def spoken(seed, count=120):
    rng = random.Random(seed)
    letters = ["the", "Big", "cat", "über", "a\x00b", "…", "x", "y", "z", "new", "york", "city"]
    out = []
    for i in range(count):
        parts = [rng.choice(["New York City", "big cat", rng.choice(letters)]) + rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randint(0, 60))]
        out.append((i, "".join(parts), rng.choice(["en", "de", None, ""])))
    return out + [(900, None, "en"), (901, "", "en"), (902, " . ,", "fr"), (903, "one", "fr"), (None, "big cat " * 20, "en")]


LANGS = "doc_id long, text string, lang string, range int, f long, phrase string"


@pytest.mark.parametrize("limits", [{}, {"shard_paths": 40, "range_paths": 25}, {"top": 3, "least": 2, "range_paths": 60}])
def test_collocations(spark, limits, monkeypatch):
    monkeypatch.setattr(collocations, "FAN", 4)
    rows = spoken(4)
    df = spark.createDataFrame([(*row, 1, 2, "p") for row in rows], LANGS).repartition(4)
    options = {k: v for k, v in limits.items() if k in ("top", "least")}
    expected = brute.collocations([Row(text=t, lang=x) for _, t, x in rows], **options)
    assert len(expected) > 5
    same(collocations.collocations(df, **limits), expected)


def test_collocations_of_no_rows_and_long_texts(spark, monkeypatch):
    df = spark.createDataFrame([], LANGS)
    assert collocations.collocations(df).count() == 0
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 64)
    text = "a b c, d e! " * 50 + "no end " * 40
    column = pa.array([text, "x y", None])
    parts = [
        collocations.block_paths(data, edges, pa.array([b"en", b"en", b"de"]).slice(at, rows), 3)
        for at, rows, data, edges in collocations._blocks(column)
    ]
    assert len(parts) > 3
    columns, weight = collocations.united(parts).paths()
    assert weight.sum() == len(text.split()) + 2
    monkeypatch.undo()
    (block,) = collocations._blocks(column)
    whole = collocations.block_paths(block[2], block[3], pa.array([b"en", b"en", b"de"]), 3)
    other, counts = whole.paths()
    assert [x.tolist() for x in columns[1:]] == [x.tolist() for x in other[1:]] and weight.tolist() == counts.tolist()


def test_transducers_are_minimal_and_survive_their_bytes():
    data = b"a x y, b x y, c x y, a x z"
    text = pa.array([data.decode()])
    ((_, _, bytes_, edges),) = collocations._blocks(text)
    built = collocations.block_paths(bytes_, edges, pa.array([b"en"]), 3).automaton()
    back = collocations.Transducer.from_bytes(pa.py_buffer(built.to_bytes()))
    columns, weight = built.paths()
    assert [c.tolist() for c in back.paths()[0]] == [c.tolist() for c in columns] and back.paths()[1].tolist() == weight.tolist()
    # b x and c x continue alike; a x does not: two states of three.
    after_two = built.levels[3][0]
    assert len(after_two) - 1 < len({(a, b) for a, b in zip(columns[1].tolist(), columns[2].tolist(), strict=True)})
    parts = [["a", "x", "q"], ["x", "y", None], ["y", None, None]]
    assert built.composed(pa.array(["en"] * 3), parts).tolist() == [1, 3, 0]
    assert built.composed(pa.array(["fr"] * 3), parts).tolist() == [0, 0, 0]


INNER = ["_repeats", "_of_doc", "_copy_keys", "_is_copy", "_text_key", "repeats", "is_copy", "of_doc", "row", "kept", "id", "own", "own_key"]
INNER += ["kept_text", "_kept", "_kept_text", "_kept_id", "_bad", "text_key", "class_id", "part", "key"]


@pytest.mark.parametrize(
    "stage",
    [substring_dedup.cut_repeats, ngram_jaccard.keep_one, quality_rules.keep_good],
    ids=["cut_repeats", "keep_one", "keep_good"],
)
def test_columns_with_the_names_used_inside_are_kept(spark, stage):
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(1, long, "a"), (2, long + " and more", "a"), (3, " ".join(f"v{k}" for k in range(90)), "b")]
    df = spark.createDataFrame([(*r, *[99] * len(INNER)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in INNER))
    out = stage(df)
    assert out.columns == df.columns
    got = out.collect()
    assert got and all(row[name] == 99 for row in got for name in INNER)


def test_links_count_texts_not_sets(spark):
    text = "a b c d e f g h"
    rows = [(1, text, "x"), (2, text, "x"), (3, text.replace(" ", "  "), "x"), (4, text.replace(" ", "\n"), "x")]
    got = {row["doc_id"]: row["n_links"] for row in ngram_jaccard.classes(table(spark, rows)).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 2}


def test_archives_are_normalised_and_read_by_many_tasks(spark, tmp_path):
    from gleaner.llm import warc
    from gleaner.llm.storage import Shelf

    pages = spark.range(700).selectExpr("id AS page_id", "CONCAT('http://x/', id) AS url", "REPEAT(CONCAT('<p>', id), 20) AS html").repartition(14)
    shelf = Shelf(spark, "warc-tasks")
    archives = shelf.put("archives", warc.write_monolithic(warc.with_revisits(pages).repartition(14), f"{shelf.folder}/raw"))
    index = warc.normalised(archives, f"{shelf.folder}/raw", f"{shelf.folder}/warc")
    by_task = index.selectExpr("spark_partition_id() AS task", "file").distinct().groupBy("task").count().collect()
    assert len(by_task) >= 10 and max(row["count"] for row in by_task) <= 3
    index = shelf.put("index", index)
    read = warc.read_records(index, f"{shelf.folder}/warc")
    assert read.selectExpr("spark_partition_id() AS task").distinct().count() > 2 and read.count() == 700
