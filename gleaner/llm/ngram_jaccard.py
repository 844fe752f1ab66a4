"""Jaccard join of word n-gram sets by chosen paths.

A document is the set of its runs of five words. Runs of the recursion are
independent: a run sends each set down one path of sampled shared tokens. The token
sampled from a set is the one with the least value under a random order of all
tokens, so two sets of similarity s sample the same one with probability s. Sets
that sampled alike share a bucket; a bucket that is still large is split again, by
two further sampled tokens, so that a similar pair stays together in at least one
child with probability 1 - (1 - s)**2. A bucket is left alone when it is small or
when splitting no longer pays, as in a group of copies. The number of runs follows
from the depth and the recall asked for, as if runs were independent; as they share
the sketch below their roots, about 3 in 100,000 links at exactly 0.8 are lost (``loss``).

Buckets are brute-forced in cells of bounded size: a large one is cut into blocks
whose pairs go to different tasks. Inside a cell pairs exist only as array indices;
a task returns link counts and a spanning forest, never pairs. A pair that meets in
several buckets counts in the smallest one. Two tests come before the exact one:
set sizes and the agreement of the sampled tokens. Only sets that still have a
partner fetch their text again for the exact test.

Documents with equal sets are one node, weighted by its distinct texts, so copies cost
nothing. Classes are the connected components.

Inside, a set goes by 64 bits of its fingerprint, and equal sets are told by 128.

Defined results: a text of one to four words is one shingle of all its words; a text
without words (or null) is alone in its class. A null id has a null class and no
links. Rows that repeat an id are one document, so their classes are one. An empty table
gives an empty result. A text is worked on as a whole, in arrays of about ten bytes for
each of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words
from gleaner.llm.groups import edges_of, whole_groups
from gleaner.llm.storage import Shelf
from gleaner.operators.components import connected_components

WORDS_PER_SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.99999

# Parameters of the recursion.
BUCKET_ROWS = 100
MAX_DEPTH = 3
CHILDREN = 2
BLOCK_ROWS = 1_500
TOKEN_ROWS = 2_000
SKETCH = 32
SKETCH_LOSS = 1e-7

_SKETCH_KEYS = np.random.default_rng(23).integers(1, 1 << 63, (2, SKETCH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs_for(recall: float, similarity: float) -> int:
    """Runs after which a pair of this similarity is lost with probability 1 - recall at most, were they independent."""
    kept = similarity * (1 - (1 - similarity) ** CHILDREN) ** MAX_DEPTH
    return math.ceil(math.log(1 - recall) / math.log(1 - kept))


def loss(runs: int, similarity: float) -> float:
    """Probability that a pair is lost at full depth: below the roots all runs draw from the same positions."""
    below, lost = SKETCH - runs, 0.0
    for k in range(below + 1):
        chance = math.comb(below, k) * similarity**k * (1 - similarity) ** (below - k)
        stays = 1.0
        for _ in range(MAX_DEPTH):
            stays = 1 - (1 - k / below * stays) ** CHILDREN
        lost += chance * (1 - similarity * stays) ** runs
    return lost


def agreement_for(similarity: float) -> int:
    """Least agreement of two sketches that a pair of this similarity misses with probability SKETCH_LOSS at most."""
    below = 0.0
    for k in range(SKETCH + 1):
        below += math.comb(SKETCH, k) * similarity**k * (1 - similarity) ** (SKETCH - k)
        if below > SKETCH_LOSS:
            return k
    return SKETCH


def shingle_sets(block: words.Block, size: int, folded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows of a block, by row and value, and where each row begins."""
    counts = block.counts()
    starts = block.window_starts(size)
    short = np.flatnonzero((counts > 0) & (counts < size))
    rows = np.concatenate((block.row_of_words()[starts], short))
    own = block.word_hashes(folded=folded)
    hashes = np.concatenate(
        (words.window_hashes(own, starts, size), words.run_hashes(own, block.first[short], block.first[short + 1]))
    )
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = edges_of(rows, hashes)[:-1]
    hashes, rows = hashes[new], rows[new]
    return hashes, np.searchsorted(rows, np.arange(block.rows + 1))


def fingerprints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits of each row's set, whatever its order; 0 for an empty one."""
    out = np.zeros((2, len(first) - 1), dtype=np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for kind, salt in enumerate((0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)):
            out[kind, some] = np.add.reduceat(words.mixed(hashes ^ np.uint64(salt)), first[some])
    return out


def _sketches(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch["text"]):
                hashes, first = shingle_sets(block, size)
                n = np.diff(first)
                some = np.flatnonzero(n)
                prints = fingerprints(hashes, first)
                sketch = np.zeros((block.rows, SKETCH), dtype=np.uint64)
                if len(some):
                    at = first[some]
                    for k in range(SKETCH):
                        value = hashes * _SKETCH_KEYS[0, k]
                        value ^= value >> np.uint64(32)
                        value *= _SKETCH_KEYS[1, k]
                        sketch[some, k] = np.minimum.reduceat(value, at)
                offsets = pa.array(np.arange(block.rows + 1, dtype=np.int32) * SKETCH)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(block.row, block.rows),
                        batch["text_key"].slice(block.row, block.rows),
                        pa.array(n.astype(np.int64)),
                        pa.array(prints[0].view(np.int64)),
                        pa.array(prints[1].view(np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array(sketch.reshape(-1).view(np.int64))),
                    ],
                    names=["doc_id", "text_key", "n", "f1", "f2", "sketch"],
                )

    return scan


def _with_sizes(rows: DataFrame) -> DataFrame:
    """Rows of buckets of two or more, with the size of their bucket."""
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return rows.join(sizes, "bucket")


def _child(level: int, turn: int, runs: int) -> Column:
    """Bucket of a set below ``bucket``: by one of the tokens that no run used at its root."""
    draw = F.xxhash64("bucket", F.lit(level), F.lit(turn))
    token = F.get("sketch", (F.lit(runs) + F.pmod(draw, F.lit(SKETCH - runs))).cast("int"))
    return F.xxhash64("bucket", F.lit(level), F.lit(turn), token)


def chosen_paths(sets: DataFrame, shelf: Shelf, runs: int) -> DataFrame:
    """(bucket, size, f1) of the leaves of all runs."""
    tokens = F.posexplode(F.slice("sketch", 1, runs)).alias("run", "token")
    roots = sets.select("f1", tokens).select(F.xxhash64("run", "token").alias("bucket"), "f1")
    level = shelf.put("paths0", _with_sizes(roots))
    leaves = level.filter(F.col("size") <= BUCKET_ROWS)
    large = level.filter(F.col("size") > BUCKET_ROWS)
    for depth in range(1, MAX_DEPTH + 1):
        if large.isEmpty():
            return leaves
        children = F.explode(F.array(*[_child(depth, turn, runs) for turn in range(CHILDREN)])).alias("child")
        split = large.join(sets.select("f1", "sketch"), "f1").select(
            F.col("bucket").alias("parent"), F.col("size").alias("parent_size"), children, "f1"
        )
        split = shelf.put(f"split{depth}", split.withColumnRenamed("child", "bucket"))
        sizes = split.groupBy("parent", "parent_size", "bucket").agg(F.count(F.lit(1)).alias("size"))
        work = sizes.groupBy("parent", "parent_size").agg(F.sum(F.col("size") * F.col("size")).alias("work"))
        pays = work.filter("2 * work < parent_size * parent_size").select(F.col("parent").alias("bucket"))
        pays = shelf.put(f"pays{depth}", pays)
        leaves = leaves.unionByName(large.join(pays, "bucket", "left_anti"))
        kept = sizes.join(pays.select(F.col("bucket").alias("parent")), "parent", "left_semi").filter("size > 1")
        level = split.select("bucket", "f1").join(kept.select("bucket", "size"), "bucket")
        level = shelf.put(f"paths{depth}", level.select("bucket", "size", "f1"))
        leaves = leaves.unionByName(level.filter(F.col("size") <= BUCKET_ROWS).select(*leaves.columns))
        large = level.filter(F.col("size") > BUCKET_ROWS).select(*leaves.columns)
    return leaves.unionByName(large)


def in_cells(leaves: DataFrame) -> DataFrame:
    """One row for each cell that a set takes part in: (bucket, left, right, f1). Small buckets are one cell."""
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("f1"), blocks).cast("int")
    cut = leaves.select("bucket", "f1", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return cut.select(
        "bucket", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "f1", "own"
    )


def _matrix(column: pa.ChunkedArray, width: int | None = None, fill: int = 0) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, lengths = column.flatten().to_numpy(), column.value_lengths().to_numpy()
    width = int(lengths.max()) if width is None else width
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.full((len(lengths), width), fill, dtype=flat.dtype)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, np.arange(len(flat)) - first] = flat
    return out


def _pairs_of_cell(cell: pa.Table, threshold: float, agreement: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, partner rows) of the likely pairs that count in this cell; each pair once."""
    n, own = cell["n"].to_numpy(), cell["own"].to_numpy()
    left, right, bucket = cell["left"][0].as_py(), cell["right"][0].as_py(), cell["bucket"][0].as_py()
    sketch, paths = _matrix(cell["sketch"]), _matrix(cell["leaves"])
    lengths = cell["leaves"].combine_chunks().value_lengths().to_numpy()
    for i in range(len(n) - 1):
        j = np.arange(i + 1, len(n))
        near = (threshold * n[i] <= n[j] + 1e-9) & (threshold * n[j] <= n[i] + 1e-9)
        if left != right:
            near &= own[j] != own[i]
        j = j[near]
        j = j[(sketch[j] == sketch[i]).sum(axis=1) >= agreement] if len(j) else j
        if not len(j):
            continue
        # The leaves of both, ascending: a pair counts where the first shared leaf is this bucket.
        mine = paths[i, : lengths[i]]
        before = mine[mine < bucket]
        if len(before):
            inside = np.arange(paths.shape[1]) < lengths[j][:, None]
            j = j[~(np.isin(paths[j], before) & inside).any(axis=1)]
        if len(j):
            yield i, j


_CELL = ["bucket", "left", "right"]


def _cells(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    for table in whole_groups(batches, _CELL, rows):
        edges = edges_of(*[table[name].to_numpy() for name in _CELL])
        for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if stop - start > 1:
                yield table.slice(start, stop - start)


def _needed(threshold: float, agreement: int):
    """Sets that have a likely partner in a cell."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            wanted = np.zeros(cell.num_rows, dtype=bool)
            for i, j in _pairs_of_cell(cell, threshold, agreement):
                wanted[i] = True
                wanted[j] = True
            if wanted.any():
                yield from cell.filter(pa.array(wanted)).combine_chunks().to_batches()

    return scan


def _with_tokens(size: int):
    """The shingles of each text, if it has the fingerprint that its row expects."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.schema.names
            for block in words.blocks(batch["text"]):
                hashes, first = shingle_sets(block, size)
                own = batch.slice(block.row, block.rows)
                right = fingerprints(hashes, first)[0].view(np.int64) == own["f1"].to_numpy()
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))
                columns = [lists if name == "text" else own[name] for name in cells]
                names = ["tokens" if name == "text" else name for name in cells]
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(right))

    return scan


def _verified(threshold: float, agreement: int):
    """For each set of a cell: the texts it is linked with there, and the least set that its links reach."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches, TOKEN_ROWS):
            _, once = np.unique(cell["f1"].to_numpy(), return_index=True)  # rows that repeat an id bring a text twice
            if len(once) < cell.num_rows:
                cell = cell.take(pa.array(np.sort(once)))
            n, ids, keys = cell["n"].to_numpy(), cell["set_id"].to_numpy(), cell["f1"].to_numpy()
            texts = cell["texts"].to_numpy()
            tokens = cell["tokens"].combine_chunks()
            lengths = tokens.value_lengths().to_numpy()
            first = np.concatenate(([0], np.cumsum(lengths)))
            _, local = np.unique(tokens.flatten().to_numpy(), return_inverse=True)
            held = np.zeros(local.max() + 1, dtype=bool)
            links = np.zeros(len(n), dtype=np.int64)
            root = np.arange(len(n))

            def find(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for i, j in _pairs_of_cell(cell, threshold, agreement):
                held[local[first[i] : first[i + 1]]] = True
                spans = [held[local[first[k] : first[k + 1]]] for k in j.tolist()]
                shared = np.array([np.count_nonzero(x) for x in spans])
                held[local[first[i] : first[i + 1]]] = False
                j = j[shared + 1e-9 >= threshold * (n[i] + n[j] - shared)]
                j = j[ids[j] != ids[i]]
                links[i] += texts[j].sum()
                links[j] += texts[i]
                for k in j.tolist():
                    a, b = find(i), find(k)
                    if a != b:
                        root[max(a, b)] = min(a, b)
            linked = np.flatnonzero(links)
            if len(linked):
                roots = np.array([find(x) for x in linked.tolist()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[linked]), pa.array(ids[linked]), pa.array(links[linked]), pa.array(ids[roots])],
                    names=["f1", "set_id", "links", "root"],
                )

    return scan


def classes(
    docs: DataFrame, threshold: float = THRESHOLD, size: int = WORDS_PER_SHINGLE, recall: float = RECALL
) -> DataFrame:
    """(doc_id, class_id, n_links, n_shingles) of every row of ``docs`` (doc_id, text).

    class_id: least doc_id of the class. n_links: other distinct texts at the threshold or
    above, those with the same shingles included; copies of one text count once.
    """
    return _placed(docs, threshold, size, recall).drop("text_key")


def _placed(docs: DataFrame, threshold: float, size: int, recall: float) -> DataFrame:
    """``classes`` with the hash of each row's text."""
    shelf = Shelf(docs.sparkSession, "ngram-jaccard")
    runs, agreement = runs_for(recall, threshold), agreement_for(threshold)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    schema = "doc_id long, text_key long, n long, f1 long, f2 long, sketch array<long>"
    sketched = texts.mapInArrow(_sketches(size), schema)
    sketches = shelf.put("sketches", sketched)

    # One row for each distinct set; of its documents the least id stands for it.
    known = sketches.filter("n > 0 AND doc_id IS NOT NULL")
    first = [F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")]
    grouped = known.groupBy("f1", "f2", "text_key").agg(*first)
    grouped = grouped.groupBy("f1", "f2").agg(*first, F.count(F.lit(1)).alias("texts")).withColumnRenamed("doc_id", "set_id")
    sets = shelf.put("sets", grouped)

    leaves = shelf.put("leaves", chosen_paths(sets, shelf, runs))
    paths = leaves.groupBy("f1").agg(F.array_sort(F.collect_set("bucket")).alias("leaves"))
    placed = in_cells(leaves).join(sets.join(paths, "f1"), "f1")
    placed = placed.select(*_CELL, "f1", "set_id", "own", "n", "texts", "sketch", "leaves")
    dealt = placed.repartition(*_CELL).sortWithinPartitions(*_CELL)
    needed = shelf.put("needed", dealt.mapInArrow(_needed(threshold, agreement), dealt.schema))

    source = texts.select(F.col("doc_id").alias("set_id"), "text")
    fetched = needed.join(source, "set_id").select(*needed.columns, "text")
    columns = [field for field in needed.schema if field.name != "text"]
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in columns) + ", tokens array<long>"
    tokens = fetched.mapInArrow(_with_tokens(size), schema)
    dealt = tokens.repartition(*_CELL).sortWithinPartitions(*_CELL)
    linked = shelf.put(
        "linked", dealt.mapInArrow(_verified(threshold, agreement), "f1 long, set_id long, links long, root long")
    )

    components = connected_components(linked.select(F.col("set_id").alias("src"), F.col("root").alias("dst")))
    degree = linked.groupBy("f1").agg(F.sum("links").alias("links"))
    named = (
        sets.join(components.select(F.col("node").alias("set_id"), "component"), "set_id", "left")
        .join(degree, "f1", "left")
        .select("f1", "f2", F.coalesce("component", "set_id").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("texts") - 1).alias("links"))
    )
    with_words = sketches.filter("n > 0").join(named, ["f1", "f2"], "left")
    alone = sketches.filter("n = 0").withColumns({"class": F.col("doc_id"), "links": F.lit(0)})
    columns = ["doc_id", "text_key", "n", "class", "links"]
    known_id = F.col("doc_id").isNotNull()
    return (
        with_words.select(*columns)
        .unionByName(alone.select(*columns))
        .select(
            "doc_id",
            F.when(known_id, F.col("class")).alias("class_id"),
            F.when(known_id, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
            F.col("n").alias("n_shingles"),
            "text_key",
        )
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, size: int = WORDS_PER_SHINGLE) -> DataFrame:
    """The documents of the least id of each class, once; rows with a null id stay.

    Of an id with several texts each one that stands for its class stays. Other columns
    are kept whatever their names.
    """
    found = _placed(docs, threshold, size, RECALL).filter("doc_id = class_id")
    found = found.select(F.col("doc_id").alias("kept"), F.col("text_key").alias("kept_text")).distinct()
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
        F.col("doc_id").alias("id"),
        F.xxhash64("text").alias("own"),
    )
    kept = rows.join(found, (rows["id"] == found["kept"]) & (rows["own"] == found["kept_text"]), "left_semi")
    kept = kept.dropDuplicates(["id", "own"]).select("row.*")
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))
