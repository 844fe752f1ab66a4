"""Collocations of a corpus, from counts in weighted acyclic automata.

A *count transducer* maps paths (language, word, word, word; a piece's end pads a path)
to counts. It is acyclic and minimal: from the last word back, states with the same arcs
and weights are registered as one. Every word of a text begins one path, so the count of
any phrase is the total of the paths that have it as prefix.

1. A task builds transducers from the sorted n-grams of its texts, block by block, and
   joins them until one holds ``SHARD_PATHS`` paths. Such a shard is a row of a table,
   with a few paths evenly spread over it (*marks*). Minimal states and a dictionary of
   the shard's words make a path cost six bytes or so.
2. Paths are divided into ranges of about ``RANGE_PATHS`` by boundaries that come from the
   marks. Boundaries only balance work and may fall inside a frequent word or pair.
3. Each shard is cut at the boundaries. The parts of one range are united and their weights summed, so no
   count depends on how rows were dealt. Many ranges are reached in steps of ``FAN`` at most, about
   equally wide, with shards joined anew between. Phrases below ``least`` are left out; what begins
   or ends a range may be incomplete, is kept, and is summed over ranges.
4. The parts of candidates are composed with the transducers of the ranges they lie in.

What is shuffled are parts of transducers: rows by range and shard, not by n-gram. The
driver sees ``MARKS`` paths at most, whatever the size of the input.

Defined results: a null text has no words, a null language is ``und``. Ids are not read;
rows that repeat count as often as they occur. Very long texts are worked on in blocks
that end where a piece ends. An empty table has no collocations.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm import words
from gleaner.llm.groups import edges_of
from gleaner.llm.storage import Shelf

LEAST = 10
MOST_WORDS = 3
TOP = 2_000
COVERED_PERCENT = 50

BLOCK_BYTES = 1 << 20
SHARD_PATHS = 300_000
RANGE_PATHS = 800_000
HELD_PATHS = 200_000
FAN = 512
MARKS_PER_SHARD = 64
MARKS = 50_000
HIGH = b"\xff"  # above every word in UTF-8

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09]] = True
_END = np.zeros(256, dtype=bool)
_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32

Path = tuple[bytes, ...]


def _order(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Order of paths, level by level."""
    bits = [max(1, int(column.max(initial=0)).bit_length()) for column in columns]
    if sum(bits) > 63:
        return np.lexsort(columns[::-1])
    key = np.zeros(len(columns[0]), dtype=np.int64)
    for column, width in zip(columns, bits, strict=True):
        key <<= width
        key |= column
    return np.argsort(key, kind="stable")


def _registered(first: np.ndarray, label: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """States with equal arcs become one: (first, label, value) of those that stay, and the state of each."""
    lengths = np.diff(first)
    place = np.arange(len(label)) - np.repeat(first[:-1], lengths)
    arcs = words.mixed(words.mixed(label.astype(np.uint64) ^ words.mixed(place.astype(np.uint64))) + value.astype(np.uint64))
    totals = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(arcs, dtype=np.uint64)))
    hashes = words.mixed(totals[first[1:]] - totals[first[:-1]]) ^ lengths.astype(np.uint64)
    _, kept, state = np.unique(hashes, return_index=True, return_inverse=True)
    twin = np.repeat(first[kept[state]], lengths) + place
    same = (lengths == lengths[kept[state]]).all() and twin.max(initial=-1) < len(label)
    if not (same and (label[twin] == label).all() and (value[twin] == value).all()):
        return first, label, value, np.arange(len(lengths))  # two different states with one hash: register none
    own = np.repeat(first[kept], lengths[kept]) + _places(lengths[kept])
    return np.concatenate(([0], np.cumsum(lengths[kept]))), label[own], value[own], state


def _places(lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


class Paths:
    """Sorted distinct paths as columns of labels, level by level, and their weights: what is joined and cut."""

    def __init__(self, langs: list[bytes], dictionary: pa.Array, columns: Sequence[np.ndarray], weight: np.ndarray):
        self.langs, self.words, self.columns, self.weight = langs, dictionary, columns, weight

    def paths(self) -> tuple[Sequence[np.ndarray], np.ndarray]:
        return self.columns, self.weight

    @property
    def size(self) -> int:
        return len(self.weight)

    def path(self, at: int) -> Path:
        labels = [int(column[at]) for column in self.columns]
        return (self.langs[labels[0]], *[self.words[label - 1].as_py() if label else b"" for label in labels[1:]])

    def automaton(self) -> Transducer:
        return Transducer.of_paths(self.langs, self.words, self.columns, self.weight)


class Transducer:
    """A minimal weighted acyclic automaton. Level k: states with ``first``, and arcs with ``label`` and ``value``.

    Labels of the first level are places in ``langs``, of others places in ``words`` plus
    one, and 0 for an end. Values are states of the next level, at the last one weights.
    """

    def __init__(
        self, langs: list[bytes], dictionary: pa.Array, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int
    ):
        self.langs, self.words, self.levels, self.size = langs, dictionary, levels, size

    @staticmethod
    def of_paths(langs: list[bytes], dictionary: pa.Array, columns: Sequence[np.ndarray], weight: np.ndarray) -> Transducer:
        """columns: labels of sorted distinct paths, level by level."""
        levels, value = [], weight
        rows = np.arange(len(weight))
        for depth in range(len(columns) - 1, -1, -1):
            label = columns[depth][rows]
            edges = edges_of(*[column[rows] for column in columns[:depth]]) if depth else np.array([0, len(rows)])
            *level, state = _registered(edges, label, value)
            levels.append(tuple(level))
            value, rows = state, rows[edges[:-1]]
        return Transducer(langs, dictionary, levels[::-1], len(weight))

    def paths(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Labels of all paths in order, level by level, and their weights."""
        columns: list[np.ndarray] = []
        state = np.zeros(1, dtype=np.int64)
        for first, label, value in self.levels:
            lengths = first[state + 1] - first[state]
            arc = np.repeat(first[state], lengths) + _places(lengths)
            columns = [np.repeat(column, lengths) for column in columns] + [label[arc]]
            state = value[arc]
        return columns, state

    def composed(self, langs: pa.Array, parts: list[list[str | None]]) -> np.ndarray:
        """Weights of phrases: the acceptor of ``parts`` walked along the arcs; 0 where there is none.

        parts: for each level below the language, the words of all phrases; null is an end.
        """
        lang = pc.index_in(langs.cast(pa.binary()), value_set=pa.array(self.langs, pa.binary())).fill_null(-1)
        labels = [lang.to_numpy().astype(np.int64)]
        for part in parts:
            at = pc.index_in(pa.array(part, pa.string()).cast(pa.binary()), value_set=self.words).fill_null(-2).to_numpy() + 1
            labels.append(np.where(np.array([word is None for word in part], dtype=bool), 0, at).astype(np.int64))
        state, alive = np.zeros(len(langs), dtype=np.int64), np.ones(len(langs), dtype=bool)
        for (first, label, value), wanted in zip(self.levels, labels, strict=True):
            alive &= wanted >= 0
            keys = np.repeat(np.arange(len(first) - 1), np.diff(first)) << 32 | label
            if not len(keys):
                return np.zeros(len(langs), dtype=np.int64)
            key = np.where(alive, state << 32 | np.maximum(wanted, 0), 0)
            arc = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            alive &= keys[arc] == key
            state = np.where(alive, value[arc], 0)
        return np.where(alive, state, 0)

    def flat(self) -> Paths:
        columns, weight = self.paths()
        return Paths(self.langs, self.words, columns, weight)

    def to_bytes(self) -> bytes:
        """Lengths of all arrays and the arrays, compressed; small parts cost few bytes besides."""
        arrays = []
        for column in (pa.array(self.langs, pa.binary()), self.words):
            data, edges = words.text_buffer(column)
            arrays += [(edges - edges[0]).astype(np.int32), data[edges[0] : edges[-1]]]
        for first, label, value in self.levels:
            arrays += [np.diff(first).astype(np.int32), label.astype(np.int32), value.astype(np.int64)]
        raw = np.array([self.size, len(arrays), *map(len, arrays)], dtype=np.int64).tobytes() + b"".join(x.tobytes() for x in arrays)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    @staticmethod
    def from_bytes(data: pa.Buffer) -> Transducer:
        size = int.from_bytes(data[:8], "little")
        raw = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)
        paths, count = np.frombuffer(raw, np.int64, 2).tolist()
        lengths = np.frombuffer(raw, np.int64, count, 16).tolist()
        kinds = [np.int32, np.uint8, np.int32, np.uint8, *[np.int32, np.int32, np.int64] * ((count - 4) // 3)]
        arrays, at = [], 8 * (count + 2)
        for length, kind in zip(lengths, kinds, strict=True):
            arrays.append(np.frombuffer(raw, kind, length, at))
            at += arrays[-1].nbytes
        langs, dictionary = (
            pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(spelled)])
            for offsets, spelled in (arrays[:2], arrays[2:4])
        )
        levels = [
            (np.concatenate(([0], np.cumsum(arrays[k], dtype=np.int64))), arrays[k + 1], arrays[k + 2])
            for k in range(4, count, 3)
        ]
        return Transducer(langs.to_pylist(), dictionary, levels, paths)


def _ranked(dictionary: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct values in order of bytes, and the place there of each value."""
    encoded = dictionary.dictionary_encode()
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return encoded.dictionary.take(pa.array(order)), rank[encoded.indices.to_numpy()].astype(np.int32)


def united(parts: list[Paths]) -> Paths:
    """All paths as one; weights of equal paths are summed."""
    if len(parts) == 1:
        return parts[0]
    langs, lang_rank = _ranked(pa.array([lang for part in parts for lang in part.langs], pa.binary()))
    dictionary, rank = _ranked(pa.concat_arrays([part.words for part in parts]))
    columns, weights, lang_at, word_at = [], [], 0, 0
    for part in parts:
        own, weight = part.paths()
        of_lang = lang_rank[lang_at : lang_at + len(part.langs)]
        of_word = np.zeros(len(part.words) + 1, dtype=np.int32)
        of_word[1:] = rank[word_at : word_at + len(part.words)] + 1
        columns.append([of_lang[own[0]], *[of_word[column] for column in own[1:]]])
        weights.append(weight)
        lang_at, word_at = lang_at + len(part.langs), word_at + len(part.words)
    return _summed(langs.to_pylist(), dictionary, [np.concatenate(level) for level in zip(*columns, strict=True)], np.concatenate(weights))


def _summed(langs: list[bytes], dictionary: pa.Array, columns: list[np.ndarray], weight: np.ndarray) -> Paths:
    order = _order(columns)
    columns, weight = [column[order] for column in columns], weight[order]
    edges = edges_of(*columns)
    totals = np.add.reduceat(weight, edges[:-1]) if len(weight) else weight
    return Paths(langs, dictionary, [column[edges[:-1]] for column in columns], totals)


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, row edges). A very long text comes in parts that end where a piece does."""
    data, edges = words.text_buffer(column)
    for row, stop in words.row_blocks(edges, BLOCK_BYTES):
        begin, end = int(edges[row]), int(edges[stop])
        if stop - row > 1 or end - begin <= BLOCK_BYTES:
            yield row, stop - row, data[begin:end], edges[row : stop + 1] - begin
            continue
        while begin < end:
            to = end
            if end - begin > BLOCK_BYTES:
                ends = np.flatnonzero(_END[data[begin : begin + BLOCK_BYTES]])
                if not len(ends):
                    ends = BLOCK_BYTES + np.flatnonzero(_END[data[begin + BLOCK_BYTES : end]])[:1]
                to = begin + int(ends[-1]) + 1 if len(ends) else end
            yield row, 1, data[begin:to], np.array([0, to - begin])
            begin = to


def block_paths(data: np.ndarray, edges: np.ndarray, langs: pa.Array, most_words: int) -> Paths:
    """Paths of the words of some rows."""
    data = _FOLD[data]
    ends_piece = _END[data]
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~(_SPACE[data] | ends_piece)
    step = np.diff(inside)
    starts, ends = step[:-1] == 1, step[1:] == -1
    cuts = edges[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    glued = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    starts[glued], ends[glued - 1] = True, True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    row = np.searchsorted(edges, starts, side="right") - 1
    piece = row + np.cumsum(ends_piece, dtype=np.int64)[starts] if len(starts) else row

    lengths = ends - starts
    letters = data[np.repeat(starts, lengths) + _places(lengths)]
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    spelled = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    dictionary, rank = _ranked(spelled)
    names, lang = _ranked(langs)
    columns, word = [lang[row]], rank + 1
    for k in range(most_words):
        own = np.zeros(len(word), dtype=np.int32)
        here = slice(0, max(0, len(word) - k))
        own[here] = np.where(piece[k:] == piece[here], word[k:], 0)
        columns.append(own)
    return _summed(names.to_pylist(), dictionary, columns, np.ones(len(word), dtype=np.int64))


class _Joined:
    """Paths held until there are twice ``most``, or twice what the last join left, then joined."""

    def __init__(self, most: int):
        self.limit, self.held, self.paths = 2 * most, [], 0

    def add(self, part: Paths) -> None:
        self.held.append(part)
        self.paths += part.size
        if self.paths >= self.limit:
            self.join()

    def join(self) -> Paths:
        whole = united(self.held)
        self.held, self.paths = [whole], whole.size
        self.limit = max(self.limit, 2 * whole.size)
        return whole


_PATH = pa.list_(pa.binary())


def _shards(most_words: int, shard_paths: int):
    def row(whole: Paths) -> pa.RecordBatch:
        at = np.linspace(0, whole.size - 1, min(MARKS_PER_SHARD, whole.size)).astype(np.int64)
        marks = [list(whole.path(int(k))) for k in at]
        automaton = whole.automaton().to_bytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([whole.size]), pa.array([marks], pa.list_(_PATH)), pa.array([automaton], pa.binary())],
            names=["paths", "marks", "automaton"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = _Joined(shard_paths)
        for batch in batches:
            langs = batch["lang"].cast(pa.binary())
            for at, rows, data, edges in _blocks(batch["text"]):
                part = block_paths(data, edges, langs.slice(at, rows), most_words)
                if len(part.words):
                    joined.add(part)
                if joined.paths >= shard_paths:
                    yield row(joined.join())
                    joined = _Joined(shard_paths)
        if joined.held:
            yield row(joined.join())

    return scan


def _cut(boundaries: list[Path], tasks: list[int]):
    """Each shard's paths by range, as transducers of their own. tasks: a key for each range."""

    def below(whole: Paths, columns: list[np.ndarray], spelled: list[bytes], bound: Path) -> int:
        low, high = 0, len(columns[0])
        for level, (column, name) in enumerate(zip(columns, bound, strict=True)):
            names = spelled if level else whole.langs
            label = bisect_left(names, name) + (level > 0) if name or not level else 0
            exact = label == 0 if level and not name else (label - (level > 0) < len(names) and names[label - (level > 0)] == name)
            part, label = column[low:high], column.dtype.type(label)
            start = low + int(np.searchsorted(part, label))
            if not exact:
                return start
            low, high = start, low + int(np.searchsorted(part, label, side="right"))
        return low

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["automaton"]:
                whole = Transducer.from_bytes(data.as_buffer()).flat()
                columns, weight = whole.paths()
                spelled = whole.words.to_pylist()
                places = [0, *[below(whole, columns, spelled, bound) for bound in boundaries], len(weight)]
                for k, (a, b) in enumerate(zip(places, places[1:], strict=False)):
                    if a == b:
                        continue
                    used = np.unique(np.concatenate([column[a:b] for column in columns[1:]]))
                    used = used[used > 0]
                    own = [np.searchsorted(used, column[a:b]) + (column[a:b] > 0) for column in columns[1:]]
                    part = Transducer.of_paths(whole.langs, whole.words.take(pa.array(used - 1)), [columns[0][a:b], *own], weight[a:b])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int32()), pa.array([tasks[k]]), pa.array([part.to_bytes()], pa.binary())],
                        names=["range", "task", "automaton"],
                    )

    return scan


_FOUND = "range int, lang string, phrase string, words int, f long, automaton binary"


def _phrases(whole: Paths, columns: list[np.ndarray], at: np.ndarray, depth: int) -> pa.Array:
    spelled = [whole.words.take(pa.array(column[at] - 1)).cast(pa.string()) for column in columns[1 : depth + 1]]
    return pc.binary_join_element_wise(*spelled, " ") if depth > 1 else spelled[0]


def _counted(least: int):
    """Of each range: its phrases with their counts, and one transducer of these."""

    def rows(key: int, whole: Paths) -> Iterator[pa.RecordBatch]:
        columns, weight = whole.paths()
        names = pa.array(whole.langs, pa.binary()).cast(pa.string())
        lists: list[list[np.ndarray]] = []
        for depth in range(len(columns)):
            edges = edges_of(*columns[: depth + 1])
            at, total = edges[:-1], np.add.reduceat(weight, edges[:-1])
            kept = (total >= least) | (depth == 0)
            kept[[0, -1]] = True
            kept &= columns[depth][at] > 0 if depth else True
            at, total = at[kept], total[kept]
            if depth:
                zeros = [np.zeros(len(at), dtype=np.int64)] * (len(columns) - 1 - depth)
                lists.append([*[column[at] for column in columns[: depth + 1]], *zeros, total])
            if depth != 1 and len(at):
                phrase = _phrases(whole, columns, at, depth) if depth else pa.array([""] * len(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key] * len(at), pa.int32()),
                        names.take(pa.array(columns[0][at])),
                        phrase,
                        pa.array([depth] * len(at), pa.int32()),
                        pa.array(total),
                        pa.nulls(len(at), pa.binary()),
                    ],
                    names=["range", "lang", "phrase", "words", "f", "automaton"],
                )
        *paths, total = [np.concatenate(column) for column in zip(*lists, strict=True)]
        used = np.unique(np.concatenate(paths[1:]))
        used = used[used > 0]
        own = [np.searchsorted(used, column) + (column > 0) for column in paths[1:]]
        pruned = _summed(whole.langs, whole.words.take(pa.array(used - 1)), [paths[0], *own], total)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([key], pa.int32()),
                pa.nulls(1, pa.string()),
                pa.nulls(1, pa.string()),
                pa.array([-1], pa.int32()),
                pa.array([0], pa.int64()),
                pa.array([pruned.automaton().to_bytes()], pa.binary()),
            ],
            names=["range", "lang", "phrase", "words", "f", "automaton"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, joined = None, _Joined(HELD_PATHS)
        for batch in batches:
            for own, data in zip(batch["range"].to_pylist(), batch["automaton"], strict=True):
                if own != key and joined.held:
                    yield from rows(key, joined.join())
                    joined = _Joined(HELD_PATHS)
                key = own
                joined.add(Transducer.from_bytes(data.as_buffer()).flat())
        if joined.held:
            yield from rows(key, joined.join())

    return scan


def _rejoined(shard_paths: int):
    """Parts of one range, joined to shards of that range."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(whole: Paths) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([whole.automaton().to_bytes()], pa.binary())], names=["automaton"])

        key, joined = None, _Joined(shard_paths)
        for batch in batches:
            for own, data in zip(batch["range"].to_pylist(), batch["automaton"], strict=True):
                if joined.held and (own != key or joined.paths >= shard_paths):
                    yield row(joined.join())
                    joined = _Joined(shard_paths)
                key = own
                joined.add(Transducer.from_bytes(data.as_buffer()).flat())
        if joined.held:
            yield row(joined.join())

    return scan


def _routed(boundaries: list[Path], most_words: int):
    """The ranges that hold paths with a phrase as prefix."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ranges = [], []
            for k, (lang, part) in enumerate(zip(batch["lang"].to_pylist(), batch["part"].to_pylist(), strict=True)):
                prefix = (lang.encode(), *part.encode().split(b" "))
                low = bisect_right(boundaries, (*prefix, *[b""] * (most_words + 1 - len(prefix))))
                high = bisect_right(boundaries, (*prefix, HIGH))
                row += [k] * (high - low + 1)
                ranges += range(low, high + 1)
            kept = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ranges, pa.int32()), kept["lang"], kept["part"]], names=["range", "lang", "part"]
            )

    return scan


def _looked_up(most_words: int):
    """Rows by range, each range's transducer before the phrases to look up."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, whole = None, None
        for batch in batches:
            edges = edges_of(batch["range"].to_numpy())
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                rows = batch.slice(a, b - a)
                if rows["range"][0].as_py() != key:
                    key, whole = rows["range"][0].as_py(), None
                if rows["automaton"][0].is_valid:
                    whole, rows = Transducer.from_bytes(rows["automaton"][0].as_buffer()), rows.slice(1)
                if whole is None or not rows.num_rows:
                    continue
                split = [part.split(" ") for part in rows["part"].to_pylist()]
                parts = [[one[k] if k < len(one) else None for one in split] for k in range(most_words)]
                weight = whole.composed(rows["lang"], parts)
                yield pa.RecordBatch.from_arrays([rows["lang"], rows["part"], pa.array(weight)], names=["lang", "part", "f"])

    return scan


def boundaries_of(shards: DataFrame, range_paths: int) -> list[Path]:
    """Paths at which ranges begin, about ``range_paths`` apart."""
    paths = shards.agg(F.sum("paths").alias("paths")).first()["paths"] or 0
    ranges = min(-(-paths // range_paths), MARKS)
    if ranges < 2:
        return []
    marks = shards.select(F.explode("marks").alias("mark")).orderBy(F.xxhash64("mark"), "mark").limit(MARKS)
    found = sorted(tuple(bytes(part) for part in row["mark"]) for row in marks.collect())
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)})


def keys_of_tasks(spark: SparkSession, tasks: int) -> list[int]:
    """A number for each of so many tasks that ``repartition`` deals to that task alone, so that none gets two ranges."""
    task = F.pmod(F.hash("id"), F.lit(tasks)).alias("task")
    drawn = spark.range(0, 24 * tasks + 1_000, numPartitions=1).groupBy(task).agg(F.min("id").alias("id"))
    found = {row["task"]: row["id"] for row in drawn.collect()}
    return [found.get(task, task) for task in range(tasks)]


def by_range(shards: DataFrame, boundaries: list[Path], shelf: Shelf, shard_paths: int) -> DataFrame:
    """(range, automaton): the parts of all shards, sorted by range within partitions.

    With more than ``FAN`` ranges, shards are first divided into coarse ranges and joined
    anew there, so that no shard is ever cut into many small parts. Steps are about equally
    wide, so that no task gets a large part of all shards.
    """

    def dealt(shards: DataFrame, bounds: list[Path]) -> DataFrame:
        ranges = len(bounds) + 1
        cut = _cut(bounds, keys_of_tasks(shards.sparkSession, ranges))
        parts = shards.select("automaton").mapInArrow(cut, "range int, task long, automaton binary")
        return parts.repartition(ranges, "task").sortWithinPartitions("range").drop("task")

    steps, every, count = [], len(boundaries), 1
    while FAN**count < every:
        count += 1
    fan = next(k for k in range(1, FAN + 1) if k**count >= every)
    while every > fan:
        every = -(-every // fan)
        steps.append(every)
    for k in reversed(steps):
        coarse = sorted({boundaries[len(boundaries) * m // (k + 1)] for m in range(1, k + 1)})
        joined = dealt(shards, coarse).mapInArrow(_rejoined(shard_paths), "automaton binary")
        shards = shelf.put(f"coarse{k}", joined, wide=True)
    return dealt(shards, boundaries)


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    most_words: int = MOST_WORDS,
    top: int = TOP,
    covered_percent: int = COVERED_PERCENT,
    shard_paths: int = SHARD_PATHS,
    range_paths: int = RANGE_PATHS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language. docs: (text, lang)."""
    shelf = Shelf(docs.sparkSession, "collocations")
    texts = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    schema = "paths long, marks array<array<binary>>, automaton binary"
    shards = shelf.put("shards", texts.mapInArrow(_shards(most_words, shard_paths), schema), wide=True)
    boundaries = boundaries_of(shards, range_paths)
    dealt = by_range(shards, boundaries, shelf, shard_paths)
    found = shelf.put("found", dealt.mapInArrow(_counted(least), _FOUND))
    shelf.drop("shards")

    totals = found.filter("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    candidates = found.filter("words > 1").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("a"))
    candidates = shelf.put("candidates", candidates.filter(F.col("a") >= least))

    split = F.split("phrase", " ")
    ends = F.transform(
        F.sequence(F.lit(1), F.col("words") - 1),
        lambda k: F.struct(
            k.alias("k"),
            F.array_join(F.slice(split, F.lit(1), k), " ").alias("head"),
            F.array_join(F.slice(split, k + 1, F.col("words")), " ").alias("tail"),
        ),
    )
    cuts = candidates.select("lang", "phrase", "words", "a", F.inline(ends))
    parts = cuts.select("lang", F.explode(F.array("head", "tail")).alias("part")).distinct()
    wanted = parts.mapInArrow(_routed(boundaries, most_words), "range int, lang string, part string")
    automata = found.filter("automaton IS NOT NULL").select("range", "automaton")
    both = automata.unionByName(wanted, allowMissingColumns=True)
    both = both.repartition(len(boundaries) + 1, "range").sortWithinPartitions("range", F.col("automaton").isNull())
    counts = both.mapInArrow(_looked_up(most_words), "lang string, part string, f long").groupBy("lang", "part").agg(F.sum("f").alias("f"))
    counts = shelf.put("counts", counts)

    heads = counts.select("lang", F.col("part").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r"))
    # Decimals of 38 digits hold the products exactly; the score is at most 1,000,000.
    wide = {name: F.col(name).cast("decimal(19,0)") for name in ("a", "l", "r")}
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumns({f"_{k}": v for k, v in wide.items()})
    scored = scored.withColumn("score", F.expr("(cast(1000000 as decimal(7,0)) * _a * _a) div (_l * _r)"))
    least_cut = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    best = scored.groupBy("lang", "phrase", "words", "a").agg(least_cut).select(
        "lang", "phrase", "words", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")
    )

    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda size: F.transform(
                F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: F.array_join(F.slice(split, at, size), " ")
            ),
        )
    )
    longer = candidates.filter("words > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(
        f"longest IS NULL OR 100 * longest < {covered_percent} * a"
    )
    kept = kept.select("lang", "phrase", "a", "l", "r", "score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    first = kept.withColumn("at", salted).filter(F.col("at") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
    SELECT lang, size, w[p:p + size - 1] AS g
    FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS p
        FROM words, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size)
),
f AS (SELECT lang, size, array_to_string(g, ' ') AS phrase, g, count(*) AS f FROM grams GROUP BY lang, size, g),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, g, f AS a FROM f WHERE size > 1 AND f >= 10),
cuts AS (
    SELECT c.*, k, array_to_string(g[:k], ' ') AS head, array_to_string(g[k + 1:], ' ') AS tail
    FROM candidates c, (SELECT unnest([1, 2]) AS k) WHERE k < size
),
scored AS (
    SELECT c.lang, c.phrase, c.a, k, h.f AS l, t.f AS r,
        ((1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * t.f))::BIGINT AS score
    FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
    SELECT lang, phrase, max(a) AS longest
    FROM (SELECT lang, a, unnest([array_to_string(g[:2], ' '), array_to_string(g[2:], ' ')]) AS phrase FROM candidates WHERE size = 3)
    GROUP BY lang, phrase
),
ranked AS (
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
    FROM best b LEFT JOIN longer g USING (lang, phrase)
    WHERE longest IS NULL OR 100 * longest < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
