"""What tasks hold in memory, and what Python workers keep from one task to the next."""

from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gleaner.llm import bpe, collocations
from gleaner.llm.storage import Shelf


def row_groups(folder: str) -> list[list]:
    """The row groups of each file of a table."""
    files = [pq.ParquetFile(path).metadata for path in Path(folder.removeprefix("file:")).glob("*.parquet")]
    return [[file.row_group(k) for k in range(file.num_row_groups)] for file in files if file.num_rows]


def test_the_encoder_keeps_no_long_words_and_nothing_after_its_task():
    tokenizer = bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))
    long = [f"{chr(97 + n % 26)}" * 100_000 for n in range(20)]
    tokenizer.encode(" ".join([*long, "plain words stay"]))
    assert 0 < sum(len(word) + len(written) for word, written in tokenizer._words.items()) < 1_000
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["some words", None, ""])], names=["doc_id", "text"])
    rows = pa.Table.from_batches(bpe.encoded_batches(iter([batch]), tokenizer, True)).to_pylist()
    assert [row["n_tokens"] for row in rows] == [len(tokenizer.encode("some words")), 0, 0]
    assert rows[0]["ids"] == tokenizer.encode("some words") and rows[1]["ids"] == []
    tokenizer.forget()
    list(bpe.encoded_batches(iter([batch]), tokenizer, False))
    assert not tokenizer._words and not tokenizer._pairs


def test_wide_rows_are_written_in_small_row_groups(spark):
    shelf = Shelf(spark, "wide")
    rows = spark.range(0, 150, numPartitions=1).select("id", F.randstr(300_000, F.lit(7)).cast("binary").alias("automaton"))
    assert shelf.put("rows", rows, wide=True).count() == 150
    (groups,) = row_groups(f"{shelf.folder}/rows")
    assert max(group.num_rows for group in groups) < 40 and max(group.total_byte_size for group in groups) < 12 << 20


def test_shards_are_wide_rows(spark, monkeypatch):
    folders = []
    monkeypatch.setattr(Shelf, "drop", lambda self, *names: folders.extend(f"{self.folder}/{name}" for name in names))
    docs = spark.createDataFrame([(f"one two three w{k} w{k + 1}", "en") for k in range(40)], "text string, lang string").repartition(1)
    assert collocations.collocations(docs, least=2).count() > 0
    assert {group.column(2).compression for groups in row_groups(folders[0]) for group in groups} == {"UNCOMPRESSED"}


def test_steps_to_many_ranges_are_about_equally_wide(spark, monkeypatch):
    """1,600 ranges took a step of 4 ranges, each a task with a fourth of all shards."""
    bounds, tasks = [(b"en", b"w%05d" % k, b"", b"") for k in range(1, 1_600)], []
    monkeypatch.setattr(collocations, "keys_of_tasks", lambda spark, ranges: tasks.append(ranges) or list(range(ranges)))
    monkeypatch.setattr(Shelf, "put", lambda self, name, df, wide=False: df)
    shards = spark.createDataFrame([], "automaton binary")
    collocations.by_range(shards, bounds, Shelf(spark, "steps"), 1_000)
    assert tasks == [41, 1_600]
