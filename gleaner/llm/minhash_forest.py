"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document is the set of its runs of five words, A-Z lower-cased. Its signature is 80
least hash values under 80 orders of all shingles, cut into ``TREES`` sequences of
``DEPTH``. In each tree the signatures stand in sorted order; neighbours there share a
longest common prefix, and a pair of similarity s shares d values with probability
s**d. A *region* is a run of that order with a common prefix. Its depth is adaptive: a
region begins at ``LEAST_DEPTH``; while it has more than ``REGION_ROWS`` members it is
cut into those that share one value more, up to ``DEPTH``. A pair of exactly 0.85 is
lost by all trees with probability ``loss(0.85)``, 8 in 100,000, if every region is cut
to the end, and 1 in 10 million in regions that stay at two or three values.

A region that is still large at full depth is mostly one family of near copies. Only
connections are asked for, so two steps keep it near linear and lose nothing:

1. *Leaders.* The first member of a region leads it. Every set takes, of the leaders of
   its regions, the one whose signature agrees most, and is confirmed against that one
   alone. Confirmed links give first components.
2. *The rest.* Pairs inside one component cannot change it. In each region the members
   outside its largest component meet all others, in cells of ``BLOCK_ROWS`` squared at
   most, which go to different tasks. A pair is looked at in the least region it shares,
   if sizes and signatures allow it, and confirmed on the full sets of shingles.

Cells return a spanning forest of what they join, never pairs. Exact copies are one set
before all this. A set goes by 64 bits of its fingerprint; equal sets are told by 128.

Defined results: a text of one to four words has one shingle of all its words. A text
without words, or null, has none and is linked with nothing. A null id has a null
component and is kept; it stands for no one. Rows that repeat an id are judged each on
its own text. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words
from gleaner.llm.groups import edges_of, whole_groups
from gleaner.llm.ngram_jaccard import fingerprints, shingle_sets
from gleaner.llm.storage import Shelf
from gleaner.operators.components import connected_components

WORDS_PER_SHINGLE = 5
PERCENT = 85

TREES = 16
DEPTH = 5
LEAST_DEPTH = 2
VALUES = TREES * DEPTH

REGION_ROWS = 64
BLOCK_ROWS = 1_000
SKETCH_LOSS = 1e-7

_KEYS = np.random.default_rng(41).integers(1, 1 << 63, (2, VALUES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LEVELS = DEPTH - LEAST_DEPTH + 1


def loss(similarity: float, depth: int = DEPTH) -> float:
    """Probability that a pair shares no region when all regions are cut to ``depth``."""
    return (1 - similarity**depth) ** TREES


def agreement_for(similarity: float) -> int:
    """Least number of equal bytes of two sketches that a pair misses with probability SKETCH_LOSS at most."""
    equal, below = similarity + (1 - similarity) / 256, 0.0
    for k in range(VALUES + 1):
        below += math.comb(VALUES, k) * equal**k * (1 - equal) ** (VALUES - k)
        if below > SKETCH_LOSS:
            return k
    return VALUES


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, VALUES) least values of each row's set; 0 for an empty one."""
    out = np.zeros((len(first) - 1, VALUES), dtype=np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        at = first[some]
        for k in range(VALUES):
            value = hashes * _KEYS[0, k]
            value ^= value >> np.uint64(32)
            value *= _KEYS[1, k]
            out[some, k] = np.minimum.reduceat(value, at)
    return out


def prefix_keys(values: np.ndarray) -> np.ndarray:
    """(rows, TREES, _LEVELS): a key for each tree's prefix of LEAST_DEPTH values, of one more, and so on."""
    trees = values.reshape(-1, TREES, DEPTH)
    key = np.broadcast_to(words.mixed(np.arange(1, TREES + 1, dtype=np.uint64)), trees.shape[:2])
    out = []
    for depth in range(DEPTH):
        key = words.mixed(key ^ words.mixed(trees[:, :, depth] + np.uint64(depth)))
        if depth + 1 >= LEAST_DEPTH:
            out.append(key)
    return np.stack(out, axis=2)


def _lists(values: np.ndarray, width: int) -> pa.Array:
    offsets = np.arange(len(values) // width + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _binary(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    data = pa.py_buffer(np.ascontiguousarray(rows))
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), data])


def _sketches(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch["text"]):
                hashes, first = shingle_sets(block, size, folded=True)
                prints = fingerprints(hashes, first)
                values = signatures(hashes, first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(block.row, block.rows),
                        pa.array(np.diff(first).astype(np.int64)),
                        pa.array(prints[0].view(np.int64)),
                        pa.array(prints[1].view(np.int64)),
                        _lists(prefix_keys(values).reshape(-1).view(np.int64), TREES * _LEVELS),
                        _binary((values >> np.uint64(56)).astype(np.uint8)),
                    ],
                    names=["doc_id", "n", "f1", "f2", "keys", "sketch"],
                )

    return scan


def regions(sets: DataFrame, shelf: Shelf) -> DataFrame:
    """(region, size, f1) for all trees: prefixes of adaptive depth with two members or more."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    keys = sets.select("f1", "keys", tree)
    level = keys.select(
        "f1", *[F.get("keys", F.col("tree") * _LEVELS + k).alias(f"key{k}") for k in range(_LEVELS)]
    )
    leaves = None
    for k in range(_LEVELS):
        own = f"key{k}"
        sizes = level.groupBy(own).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        deeper = [f"key{m}" for m in range(k + 1, _LEVELS)]
        level = shelf.put(f"level{k}", level.join(sizes, own).select("f1", F.col(own).alias("region"), "size", *deeper))
        done = level if k == _LEVELS - 1 else level.filter(F.col("size") <= REGION_ROWS)
        done = done.select("region", "size", "f1")
        leaves = done if leaves is None else leaves.unionByName(done)
        level = level.filter(F.col("size") > REGION_ROWS).select("f1", *deeper)
    return leaves


def _rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A matrix of the bytes of sketches, which all have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data, edges = words.text_buffer(column)
    return data[edges[0] : edges[-1]].reshape(-1, VALUES)


def _agreements(percent: int, need: int):
    """(f1, leader, agree) of the pairs that may be linked."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            agree = (_rows_of(batch["sketch"]) == _rows_of(batch["lead_sketch"])).sum(axis=1)
            n, m = batch["n"].to_numpy(), batch["lead_n"].to_numpy()
            likely = (agree >= need) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            kept = batch.filter(pa.array(likely))
            yield pa.RecordBatch.from_arrays(
                [kept["f1"], kept["leader"], pa.array(agree[likely].astype(np.int32))], names=["f1", "leader", "agree"]
            )

    return scan


class _Cell:
    """Members of a cell: those on the left meet those on the right that are in another component."""

    def __init__(self, table: pa.Table, percent: int, need: int):
        self.n, self.f1 = table["n"].to_numpy(), table["f1"].to_numpy()
        self.sketch = _rows_of(table["sketch"])
        _, self.component = np.unique(table["component"].to_numpy(), return_inverse=True)
        self.left = np.flatnonzero(table["left"].to_numpy(zero_copy_only=False))
        self.right = np.flatnonzero(table["right"].to_numpy(zero_copy_only=False))
        self.percent, self.need = percent, need

    def likely(self) -> Iterator[tuple[int, np.ndarray]]:
        """(left row, right rows) that sizes and sketches allow."""
        for some in np.array_split(self.left, max(1, len(self.left) * len(self.right) * VALUES >> 24)):
            n, m = self.n[some][:, None], self.n[self.right][None, :]
            fits = self.component[some][:, None] != self.component[self.right][None, :]
            fits &= 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)
            row, column = np.nonzero(fits)
            pairs = np.zeros(len(row), dtype=bool)
            for a in range(0, len(row), 1 << 18):
                part = slice(a, a + (1 << 18))
                pairs[part] = (self.sketch[some[row[part]]] == self.sketch[self.right[column[part]]]).sum(axis=1) >= self.need
            row, column = row[pairs], column[pairs]
            runs = edges_of(row)
            for a, b in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
                yield int(some[row[a]]), self.right[column[a:b]]


_CELL = ["region", "lower", "upper"]


def _cells(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    for table in whole_groups(batches, _CELL, rows):
        edges = edges_of(*[table[name].to_numpy() for name in _CELL])
        for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if stop - start > 1:
                yield table.slice(start, stop - start)


def _needed(percent: int, need: int):
    """Members of a cell that have a likely partner there which they meet in no lesser region."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _cells(batches, 20_000):
            cell = _Cell(table, percent, need)
            lists = table["regions"].combine_chunks()
            flat, lengths = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            first = np.concatenate(([0], np.cumsum(lengths)))
            region = table["region"][0].as_py()
            wanted = np.zeros(table.num_rows, dtype=bool)
            for i, j in cell.likely():
                mine = flat[first[i] : first[i + 1]]
                mine = mine[mine < region]
                if len(mine):
                    inside = np.concatenate([flat[first[k] : first[k + 1]] for k in j.tolist()])
                    met = np.add.reduceat(np.isin(inside, mine), np.cumsum(lengths[j]) - lengths[j]) > 0
                    j = j[~met]
                if len(j):
                    wanted[i] = True
                    wanted[j] = True
            if wanted.any():
                yield from table.filter(pa.array(wanted)).drop_columns(["regions"]).combine_chunks().to_batches()

    return scan


def _with_tokens(size: int):
    """The shingles of each text, if it is the text that its row expects."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [name for name in batch.schema.names if name != "text"]
            for block in words.blocks(batch["text"]):
                hashes, first = shingle_sets(block, size, folded=True)
                own = batch.slice(block.row, block.rows)
                right = fingerprints(hashes, first)[0].view(np.int64) == own["f1"].to_numpy()
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))
                out = pa.RecordBatch.from_arrays([*[own[name] for name in kept], lists], names=[*kept, "tokens"])
                yield out.filter(pa.array(right))

    return scan


def _confirmed(percent: int, need: int):
    """(src, dst): links on full sets that join two components of a cell."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _cells(batches, 2_000):
            cell = _Cell(table, percent, need)
            tokens = table["tokens"].combine_chunks()
            first = np.concatenate(([0], np.cumsum(tokens.value_lengths().to_numpy())))
            _, local = np.unique(tokens.flatten().to_numpy(), return_inverse=True)
            held = np.zeros(local.max() + 1, dtype=bool)
            root = np.arange(cell.component.max() + 1)
            ends: tuple[list[int], list[int]] = [], []

            def find(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for i, partners in cell.likely():
                own = local[first[i] : first[i + 1]]
                held[own] = True
                for j in partners.tolist():
                    a, b = find(cell.component[i]), find(cell.component[j])
                    if a == b:
                        continue
                    shared = int(np.count_nonzero(held[local[first[j] : first[j + 1]]]))
                    if 100 * shared >= percent * (int(cell.n[i]) + int(cell.n[j]) - shared):
                        root[max(a, b)] = min(a, b)
                        ends[0].append(cell.f1[i])
                        ends[1].append(cell.f1[j])
                held[own] = False
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["src", "dst"])

    return scan


class _Links:
    """Confirms cells: fetches the texts of their members once each and tests full sets."""

    def __init__(self, docs: DataFrame, shelf: Shelf, size: int, percent: int, need: int):
        self.texts = docs.select(F.col("doc_id").alias("set_id"), "text").filter("set_id IS NOT NULL")
        self.shelf, self.size, self.percent, self.need = shelf, size, percent, need

    def confirmed(self, name: str, members: DataFrame) -> DataFrame:
        """members: (region, lower, upper, left, right, f1, set_id, n, component, sketch)."""
        fetched = members.join(self.texts, "set_id")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema)
        rows = fetched.select(*members.columns, "text").mapInArrow(_with_tokens(self.size), f"{schema}, tokens array<long>")
        once = rows.repartition(*_CELL).sortWithinPartitions(*_CELL, "f1")
        return self.shelf.put(name, once.mapInArrow(_confirmed(self.percent, self.need), "src long, dst long"))


def _led(members: DataFrame, shelf: Shelf, percent: int, need: int) -> DataFrame:
    """Each set with the leader whose sketch agrees most, in cells of the leader."""
    lead = F.min(F.struct("f1", "set_id", "n", "sketch")).alias("lead")
    leaders = members.groupBy("region").agg(lead)
    pairs = members.join(leaders, "region").filter("f1 <> lead.f1").select(
        "f1", "n", "sketch", F.col("lead.f1").alias("leader"), F.col("lead.n").alias("lead_n"), F.col("lead.sketch").alias("lead_sketch")
    )
    agreed = pairs.mapInArrow(_agreements(percent, need), "f1 long, leader long, agree int")
    best = agreed.groupBy("f1").agg(F.max(F.struct("agree", "leader"))["leader"].alias("leader"))
    return shelf.put("best", best)


def _cells_of_leaders(best: DataFrame, sets: DataFrame) -> DataFrame:
    """A leader meets its followers, in blocks of BLOCK_ROWS."""
    own = sets.select("f1", "set_id", "n", F.col("f1").alias("component"), "sketch")
    counts = best.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("f1"), F.col("blocks")).cast("int")
    followers = best.join(counts, "leader").select(
        "f1", F.col("leader").alias("region"), block.alias("lower"), F.lit(False).alias("left"), F.lit(True).alias("right")
    )
    leaders = counts.select(
        F.col("leader").alias("f1"),
        F.col("leader").alias("region"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("lower"),
        F.lit(True).alias("left"),
        F.lit(False).alias("right"),
    )
    rows = followers.unionByName(leaders).withColumn("upper", F.lit(0))
    return rows.join(own, "f1").select(*_CELL, "left", "right", "f1", "set_id", "n", "component", "sketch")


def _cells_of_regions(members: DataFrame, components: DataFrame) -> DataFrame:
    """In regions of several components: those outside the largest one against all."""
    known = members.join(components.select(F.col("node").alias("f1"), "component"), "f1", "left").withColumn(
        "component", F.coalesce("component", "f1")
    )
    parts = known.groupBy("region", "component").agg(F.count(F.lit(1)).alias("rows"))
    mixed = (
        parts.groupBy("region")
        .agg(
            F.count(F.lit(1)).alias("parts"),
            F.sum("rows").alias("every"),
            F.max(F.struct("rows", "component")).alias("largest"),
        )
        .filter("parts > 1")
        .select(
            "region",
            F.col("largest.component").alias("main"),
            F.ceil((F.col("every") - F.col("largest.rows")) / BLOCK_ROWS).cast("int").alias("lowers"),
            F.ceil(F.col("every") / BLOCK_ROWS).cast("int").alias("uppers"),
        )
    )
    rows = known.join(mixed, "region").withColumn("minor", F.col("component") != F.col("main"))
    draw = F.xxhash64("f1")
    lower, upper = F.pmod(draw, F.col("lowers")).cast("int"), F.pmod(draw, F.col("uppers")).cast("int")

    def cell(lower, upper, left):
        return F.struct(lower.alias("lower"), upper.alias("upper"), left.alias("left"), (~left).alias("right"))

    as_left = F.when(
        F.col("minor"), F.transform(F.sequence(F.lit(0), F.col("uppers") - 1), lambda k: cell(lower, k, F.lit(True)))
    )
    as_right = F.transform(F.sequence(F.lit(0), F.col("lowers") - 1), lambda k: cell(k, upper, F.lit(False)))
    places = F.concat(F.coalesce(as_left, F.slice(as_right, 1, 0)), as_right)
    keep = ["region", "f1", "set_id", "n", "component", "sketch", "regions"]
    placed = rows.select(*keep, F.explode(places).alias("cell")).select(*keep, "cell.*")
    return placed.groupBy(*_CELL, "f1").agg(
        F.max("left").alias("left"),
        F.max("right").alias("right"),
        *[F.first(name).alias(name) for name in ("set_id", "n", "component", "sketch", "regions")],
    )


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = WORDS_PER_SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Links: 100 * intersection >= ``percent`` * union. component_id: least doc_id of the
    component; kept: the documents with that id.
    """
    shelf = Shelf(docs.sparkSession, "minhash-forest")
    need = agreement_for(percent / 100)
    texts = docs.select("doc_id", "text")
    schema = "doc_id long, n long, f1 long, f2 long, keys array<long>, sketch binary"
    sketches = shelf.put("sketches", texts.mapInArrow(_sketches(size), schema))
    known = sketches.filter("n > 0 AND doc_id IS NOT NULL")
    grouped = known.groupBy("f1", "f2").agg(
        F.min("doc_id").alias("set_id"), *[F.first(name).alias(name) for name in ("n", "keys", "sketch")]
    )
    sets = shelf.put("sets", grouped)

    leaves = regions(sets, shelf)
    own = leaves.groupBy("f1").agg(F.array_sort(F.collect_list("region")).alias("regions"))
    facts = sets.select("f1", "set_id", "n", "sketch").join(own, "f1")
    members = shelf.put("members", leaves.select("region", "f1").join(facts, "f1"))
    shelf.drop(*[f"level{k}" for k in range(_LEVELS)])

    links = _Links(texts, shelf, size, percent, need)
    best = _led(members, shelf, percent, need)
    first = links.confirmed("led", _cells_of_leaders(best, sets))
    components = shelf.put("components", connected_components(first))

    cells = _cells_of_regions(members, components)
    dealt = cells.select(*_CELL, "left", "right", "f1", "set_id", "n", "component", "sketch", "regions")
    dealt = dealt.repartition(*_CELL).sortWithinPartitions(*_CELL, "f1")
    columns = [field for field in dealt.schema if field.name != "regions"]
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in columns)
    needed = shelf.put("needed", dealt.mapInArrow(_needed(percent, need), schema))
    shelf.drop("members")
    rest = links.confirmed("rest", needed)

    every = connected_components(first.unionByName(rest))
    named = sets.select("f1", "f2", "set_id").join(every.withColumnRenamed("node", "f1"), "f1", "left")
    named = shelf.put("named", named.withColumn("component", F.coalesce("component", "f1")))
    labels = named.groupBy("component").agg(F.min("set_id").alias("component_id"))
    named = named.join(labels, "component").select("f1", "f2", "component_id")

    with_words = sketches.filter("n > 0").select("doc_id", "n", "f1", "f2").join(named, ["f1", "f2"], "left")
    alone = sketches.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return (
        with_words.select("doc_id", "n", "component_id")
        .unionByName(alone)
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            component.alias("component_id"),
            F.col("doc_id").eqNullSafe(component).alias("kept"),
        )
    )


# Every pair of sets that share a shingle, and the closure of the links.
ORACLE = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
s AS (
    SELECT doc_id, list_sort(list_distinct(CASE
        WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS sh
    FROM w
),
sets AS (SELECT md5(array_to_string(sh, chr(10))) AS node, len(sh) AS n, any_value(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY 1, 2),
tokens AS (SELECT node, n, unnest(sh) AS token FROM sets),
links AS (
    SELECT a.node AS x, b.node AS y
    FROM tokens a JOIN tokens b ON a.token = b.token AND a.node <> b.node
    GROUP BY a.node, b.node, a.n, b.n
    HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
reach AS (
    SELECT node AS x, node AS y FROM sets
    UNION
    SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
),
owners AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(sh, chr(10))) AS node FROM s),
least AS (SELECT r.x AS node, min(o.doc_id) AS component FROM reach r JOIN owners o ON o.node = r.y AND o.n > 0 GROUP BY r.x)
SELECT o.doc_id, o.n AS n_shingles, coalesce(l.component, o.doc_id) AS component_id,
    o.doc_id = coalesce(l.component, o.doc_id) AS kept
FROM owners o LEFT JOIN least l ON o.n > 0 AND l.node = o.node
"""
