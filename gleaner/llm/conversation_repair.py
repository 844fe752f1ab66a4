"""Repair of the structure of conversations by cheapest edits, decided on whole-number weights.

A repaired conversation is empty, or one optional system turn and then user and assistant
turns in pairs. Rows stand in order of turn (nulls first), then role, then text. A row's
first fault counts: blank (only white space), duplicate (role and text seen earlier in
the conversation), truncated (no sentence end at its end). Edits and what they cost:

- Keep 0, Rerole to user or assistant 1; 5 more for a truncated row
- Delete 2, the only edit of blank and duplicate rows
- Insert an empty user or assistant turn 5, anywhere

A way of editing is one whole number: its cost in the high digits, and below it a fixed
number of three-bit digits, from the left one for each edit's letter (D, I, K, R, in this
order), zeros at the end. The least number is the cheapest way, and among the cheapest
the one whose letters come first. Dynamic programming over rows and four states (nothing
yet, after system, after user, after assistant) takes minima of such numbers and no
other decision. From a state the role of an inserted or reroled turn is fixed, so the
letters alone give back the repaired rows.

Most conversations are small and are whole in one task. A *large* one (more than
``LARGE_ROWS`` rows or ``LARGE_BYTES`` bytes; it may hold a third of all rows) is spread
by range over tasks. Duplicates come from an aggregate of first places. Each task makes, from blocks of its rows, a table of
the least weights from each of the four states to each; such tables compose, as two ways
between the same states over the same rows never extend one another at equal cost. Only
digesting or listing the repaired rows reads a conversation in one stream, a row at a time.

Defined results: a null role or text is one space, in rows and in hashes. A null turn is
first and counts in no gap; a null conversation id is one conversation. Roles are told
by their first letter, s, u or a; an empty or other role can be reroled or deleted. An
empty table gives no conversations. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.storage import Shelf

LARGE_ROWS = 1_000
LARGE_BYTES = 4 << 20
BLOCK_ROWS = 128

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# White space, sentence ends, edit letters in the order of ASCII.
SPACE, ENDS, LETTERS = " \t\n\x0b\x0c\r", ".!?", "DIKR"
D, I, K, R = 1, 2, 3, 4  # noqa: E741
_AS_LETTERS = str.maketrans("1234", LETTERS)

START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = ("su", "ua", "au")

_ORDER = ["has_turn", "turn", "role", "text"]

# A row as the decision sees it: must it go, is it truncated, its role's first letter.
Row = tuple[bool, bool, str]
# Cost, number of letters, and the letters as octal digits of a number.
Way = tuple[int, int, int]
Table = dict[tuple[int, int], Way]


def _after_inserts(ways: list, top: int) -> list:
    """Up to two turns inserted; a third would come back to a state already reached."""
    best, layer = list(ways), ways
    for _ in range(2):
        further = [None] * 4
        for state, way in enumerate(layer):
            if way is not None:
                weight, free = way
                offer = (weight + (INSERT << top) + (I << 3 * (free - 1)), free - 1)
                target = _NEXT[state]
                further[target] = offer if further[target] is None else min(further[target], offer)
        layer = further
        best = [b if a is None else a if b is None else min(a, b) for a, b in zip(best, layer, strict=True)]
    return best


def ways_from(entry: int, rows: list[Row]) -> dict[int, Way]:
    """The least way of editing ``rows`` from a state to each state that can be reached."""
    digits = 3 * len(rows) + 2
    top = 3 * digits
    ways: list = [None] * 4
    ways[entry] = (0, digits)
    ways = _after_inserts(ways, top)
    for must_go, truncated, initial in rows:
        further: list = [None] * 4
        extra = TRUNCATED if truncated else 0
        for state, way in enumerate(ways):
            if way is None:
                continue
            weight, free = way
            place = 3 * (free - 1)
            offers = [(state, DELETE, D)]
            if not must_go:
                offers.append((_NEXT[state], REROLE + extra, R))
                kept = _KEPT.get((state, initial))
                if kept is not None:
                    offers.append((kept, KEEP + extra, K))
            for target, cost, letter in offers:
                offer = (weight + (cost << top) + (letter << place), free - 1)
                if further[target] is None or offer < further[target]:
                    further[target] = offer
        ways = _after_inserts(further, top)
    low = (1 << top) - 1
    return {
        state: (way[0] >> top, digits - way[1], (way[0] & low) >> 3 * way[1]) for state, way in enumerate(ways) if way is not None
    }


def table_of(rows: list[Row]) -> Table:
    return {(entry, state): way for entry in range(4) for state, way in ways_from(entry, rows).items()}


def _lesser(a: Way, b: Way) -> Way:
    width = max(a[1], b[1])
    return min(a, b, key=lambda way: (way[0], way[2] << 3 * (width - way[1])))


def composed(first: Table, second: Table) -> Table:
    """Ways through both, each by the least sum over the state between."""
    out: Table = {}
    for (entry, middle), (cost, length, letters) in first.items():
        for state in range(4):
            rest = second.get((middle, state))
            if rest is not None:
                way = (cost + rest[0], length + rest[1], letters << 3 * rest[1] | rest[2])
                known = out.get((entry, state))
                out[entry, state] = way if known is None else _lesser(known, way)
    return out


def decided(table: Table) -> tuple[int, str]:
    """Cost and letters of the least way from nothing to a whole conversation."""
    ways = [table[START, state] for state in (START, ASSISTANT) if (START, state) in table]
    cost, length, letters = ways[0] if len(ways) == 1 else _lesser(*ways)
    return cost, format(letters, "o").translate(_AS_LETTERS) if length else ""


class _Tables:
    """Table of a growing run of rows: blocks, joined in pairs of like size."""

    def __init__(self, block_rows: int):
        self.block_rows, self.rows, self.stack = block_rows, [], []

    def add(self, row: Row) -> None:
        self.rows.append(row)
        if len(self.rows) == self.block_rows:
            self.close()

    def close(self) -> None:
        level, table = 0, table_of(self.rows)
        while self.stack and self.stack[-1][0] == level:
            level, table = level + 1, composed(self.stack.pop()[1], table)
        self.stack.append((level, table))
        self.rows = []

    def whole(self) -> Table:
        if self.rows or not self.stack:
            self.close()
        table = self.stack[-1][1]
        for _, before in reversed(self.stack[:-1]):
            table = composed(before, table)
        return table


def _fault(text: str) -> tuple[bool, bool]:
    """Is a text blank, is it truncated."""
    bare = text.rstrip(SPACE)
    return not bare, bool(bare) and bare[-1] not in ENDS


def repaired(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what stands after the edits, in order."""
    state = START
    for letter in audit:
        if letter == "I":
            state = _NEXT[state]
            yield letter, _ROLE[state], ""
            continue
        role, text = next(rows)
        if letter == "R":
            state = _NEXT[state]
            yield letter, _ROLE[state], text
        elif letter == "K":
            state = _KEPT[state, role[:1]]
            yield letter, role, text


def _sha(turns: Iterator[tuple[str, str, str]]) -> str:
    digest, begun = hashlib.sha256(), False
    for _, role, text in turns:
        digest.update(f"\n{role}:{text}".encode() if begun else f"{role}:{text}".encode())
        begun = True
    return digest.hexdigest()


FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [field.split()[0] for field in FIGURES.split(", ")]


def _judged(rows: list[tuple[int | None, str, str]]) -> tuple:
    """The figures of one whole conversation; rows: (turn, role, text) in order."""
    turns = {turn for turn, _, _ in rows if turn is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen: set[tuple[str, str]] = set()
    counts, tables = [0, 0, 0], _Tables(BLOCK_ROWS)
    for _, role, text in rows:
        blank, truncated = _fault(text)
        duplicate = not blank and (role, text) in seen
        seen.add((role, text))
        truncated = truncated and not duplicate
        for k, fault in enumerate((blank, duplicate, truncated)):
            counts[k] += fault
        tables.add((blank or duplicate, truncated, role[:1]))
    illegal = sum(a[1][:1] + b[1][:1] not in _LEGAL for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = decided(tables.whole())
    return gaps, *counts, illegal, cost, audit, _sha(repaired(iter([row[1:] for row in rows]), audit))


def _conversations(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[str, Iterator[tuple]]]:
    """Conversations of rows in order, each with its rows, a batch of them in memory at a time."""
    from itertools import groupby

    def rows():
        for batch in batches:
            yield from zip(*[batch[name].to_pylist() for name in ("conv_key", *columns)], strict=True)

    for key, own in groupby(rows(), key=lambda row: row[0]):
        yield key, (row[1:] for row in own)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[list] = [[] for _ in range(len(_NAMES) + 1)]
    for key, rows in _conversations(batches, "turn", "role", "text"):
        for column, value in zip(out, (key, *_judged(list(rows))), strict=True):
            column.append(value)
        if len(out[0]) == 2_000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["conv_key", *_NAMES])
            out = [[] for _ in out]
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["conv_key", *_NAMES])


_SEGMENT = "conv_key string, part int, duplicate long, blank long, truncated long, illegal long, head string, tail string, ways string"


def _as_text(table: Table) -> str:
    return " ".join(f"{a}{b}:{cost}:{length}:{letters:o}" for (a, b), (cost, length, letters) in table.items())


def _as_table(text: str) -> Table:
    out: Table = {}
    for way in text.split(" "):
        ends, cost, length, letters = way.split(":")
        out[int(ends[0]), int(ends[1])] = (int(cost), int(length), int(letters, 8))
    return out


def _segments(block_rows: int):
    """What one task holds of each large conversation, without its texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for key, rows in _conversations(batches, "role", "text", "again"):
            counts, tables = {"duplicate": 0, "blank": 0, "truncated": 0, "illegal": 0}, _Tables(block_rows)
            head, tail = None, None
            for role, text, again in rows:
                blank, truncated = _fault(text)
                duplicate = again and not blank
                truncated = truncated and not duplicate
                counts["blank"] += blank
                counts["duplicate"] += duplicate
                counts["truncated"] += truncated
                counts["illegal"] += tail is not None and tail + role[:1] not in _LEGAL
                head, tail = role[:1] if head is None else head, role[:1]
                tables.add((blank or duplicate, truncated, role[:1]))
            row = {"conv_key": key, "part": part, **counts, "head": head, "tail": tail, "ways": _as_text(tables.whole())}
            yield pa.RecordBatch.from_pylist([row]).cast(_ARROW_SEGMENT)

    return scan


_ARROW_SEGMENT = pa.schema(
    [(name, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[kind]) for name, kind in map(str.split, _SEGMENT.split(", "))]
)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole large conversations from their segments in order."""
    for key, segments in _conversations(batches, "duplicate", "blank", "truncated", "illegal", "head", "tail", "ways"):
        totals, tail, table = [0, 0, 0, 0], None, None
        for *counts, head, end, ways in segments:
            totals = [a + b for a, b in zip(totals, counts, strict=True)]
            totals[3] += tail is not None and tail + head not in _LEGAL
            tail = end
            table = _as_table(ways) if table is None else composed(table, _as_table(ways))
        cost, audit = decided(table)
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("conv_key", "duplicate", "blank", "truncated", "illegal", "cost", "audit"), (key, *totals, cost, audit), strict=True))]
        )


def _with_audit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[tuple[str, str, str]]]]:
    """Conversations and their repaired turns; the first row of each brings its letters."""
    for key, rows in _conversations(batches, "role", "text", "audit"):
        audit = next(rows)[2]
        yield key, repaired(((role, text) for role, text, _ in rows), audit or "")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, turns in _with_audit(batches):
        yield pa.RecordBatch.from_pylist([{"conv_key": key, "repaired_sha256": _sha(turns)}])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_key", "at", "edit", "role", "text"]
    for key, turns in _with_audit(batches):
        held: list[tuple] = []
        for at, turn in enumerate(turns):
            held.append((key, at, *turn))
            if len(held) == 500:
                yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in held])
                held = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in held])


def conv_key(conv_id: Column) -> Column:
    """A key that tells null from every id."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _rows(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        conv_key(F.col("conv_id")).alias("conv_key"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )


def _streamed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows in order, each conversation's letters before them."""
    marks = audits.select("conv_key", F.lit(0).alias("kind"), "audit")
    every = rows.withColumn("kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    return every.repartition("conv_key").sortWithinPartitions("conv_key", "kind", *_ORDER)


def _large(rows: DataFrame, shelf: Shelf, block_rows: int) -> DataFrame:
    """The figures of large conversations."""
    rows = shelf.put("large_rows", rows.withColumn("row", F.monotonically_increasing_id()))
    same = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2")]
    place = F.struct("has_turn", F.coalesce("turn", F.lit(0)).alias("turn"), "row")
    keyed = rows.select("*", *same, place.alias("place"))
    firsts = keyed.groupBy("conv_key", "h1", "h2").agg(F.min("place").alias("first"))
    seen = keyed.join(firsts, ["conv_key", "h1", "h2"]).withColumn("again", F.col("place") > F.col("first"))
    seen = shelf.put("large_seen", seen.select("conv_key", *_ORDER, "row", "again"))
    order = ["conv_key", *_ORDER, "row"]
    segments = seen.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_segments(block_rows), _SEGMENT)
    segments = shelf.put("segments", segments).repartition("conv_key").sortWithinPartitions("conv_key", "part")
    figures = "conv_key string, duplicate long, blank long, truncated long, illegal long, cost long, audit string"
    audits = shelf.put("audits", segments.mapInArrow(_joined, figures))

    shas = _streamed(rows.drop("row"), audits).mapInArrow(_digests, "conv_key string, repaired_sha256 string")
    turns = rows.filter("has_turn").groupBy("conv_key", "turn").agg(F.count(F.lit(1)).alias("rows"))
    span = F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))
    gaps = turns.groupBy("conv_key").agg(span.alias("gaps"))
    out = audits.join(shas, "conv_key").join(gaps, "conv_key", "left")
    return out.select("conv_key", F.coalesce("gaps", F.lit(0)).alias("gaps"), *_NAMES[1:])


def judged(
    conversations: DataFrame,
    every: DataFrame | None = None,
    large_rows: int = LARGE_ROWS,
    large_bytes: int = LARGE_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per conversation: conv_id and FIGURES. conversations: (conv_id, turn, role, text).

    every: a table whose conv_ids are returned, with or without rows; by default the
    conversations themselves.
    """
    shelf = Shelf(conversations.sparkSession, "conversation-repair")
    rows = _rows(conversations)
    sizes = rows.groupBy("conv_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("role") + F.octet_length("text")).alias("size")
    )
    is_large = (F.col("n") > large_rows) | (F.col("size") > large_bytes)
    large = shelf.put("large", sizes.filter(is_large).select("conv_key"))
    small = rows.join(large, "conv_key", "left_anti").repartition("conv_key").sortWithinPartitions("conv_key", *_ORDER)
    found = small.mapInArrow(_small, f"conv_key string, {FIGURES}")
    if not large.isEmpty():
        found = found.unionByName(_large(rows.join(large, "conv_key", "left_semi"), shelf, block_rows))
    found = shelf.put("found", found)
    ids = (conversations if every is None else every).groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows"))
    ids = ids.select("conv_id", conv_key(F.col("conv_id")).alias("conv_key"))
    none = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return ids.join(found, "conv_key", "left").select(
        "conv_id", *[F.coalesce(name, none.get(name, F.lit(0))).alias(name) for name in _NAMES]
    )


def repaired_turns(conversations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(conv_id, at, edit, role, text): the turns that stand after the edits. verdicts: as from ``judged``."""
    audits = verdicts.select(conv_key(F.col("conv_id")).alias("conv_key"), "audit")
    schema = "conv_key string, at long, edit string, role string, text string"
    turns = _streamed(_rows(conversations), audits).mapInArrow(_listed, schema)
    kind = conversations.schema["conv_id"].dataType
    conv_id = F.when(F.col("conv_key") != "", F.substring("conv_key", 2, 1 << 30).cast(kind))
    return turns.select(conv_id.alias("conv_id"), "at", "edit", "role", "text")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with one kind of damage each, or none, drawn from conversation and turn."""
    name = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    )
    rows = conversations.select("conv_id", "turn", "role", "text", (F.crc32(name) % 20).alias("draw")).filter("draw <> 0")
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    bare = F.regexp_replace(text, "[.!?]", "")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("draw") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, bare).otherwise(text).alias("text"),
        F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _oracle() -> str:
    """The same in SQL: a way is the text of its cost, in eight digits, and its letters."""

    def plus(way: str, cost: str, letter: str) -> str:
        return f"(lpad((substr({way}, 1, 8)::INT + {cost})::VARCHAR, 8, '0') || substr({way}, 9) || '{letter}')"

    def after_inserts(source: str, keep: str) -> str:
        """Two layers of inserted turns over columns w0-w3."""
        one = {2: f"least({', '.join(plus(f'w{s}', '5', 'I') for s in (0, 1, 3))})", 3: plus("w2", "5", "I")}
        two = {2: plus("i3", "5", "I"), 3: plus("i2", "5", "I")}
        return f"""SELECT {keep}, w0, w1, least(w2, i2, {two[2]}) AS w2, least(w3, i3, {two[3]}) AS w3
            FROM (SELECT *, {one[2]} AS i2, {one[3]} AS i3 FROM ({source}))"""

    def kept(way: str, initial: str) -> str:
        return f"CASE WHEN NOT gone AND r0 = '{initial}' THEN {plus(way, 'extra', 'K')} END"

    def reroled(way: str) -> str:
        return f"CASE WHEN NOT gone THEN {plus(way, 'extra + 1', 'R')} END"

    def deleted(way: str) -> str:
        return plus(way, "2", "D")

    to_user = [f(w) for w in ("w0", "w1", "w3") for f in (lambda w: kept(w, "u"), reroled)]
    step = f"""SELECT p.conv_id, p.i + 1 AS i, {deleted('w0')} AS w0,
            least({deleted('w1')}, {kept('w0', 's')}) AS w1,
            least({deleted('w2')}, {', '.join(to_user)}) AS w2,
            least({deleted('w3')}, {kept('w2', 'a')}, {reroled('w2')}) AS w3
        FROM ways p JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i + 1"""
    first = "SELECT conv_id, 0 AS i, '00000000' AS w0, NULL::VARCHAR AS w1, NULL::VARCHAR AS w2, NULL::VARCHAR AS w3 FROM ids"
    return rf"""
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)),
        lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
ids AS (SELECT DISTINCT conv_id FROM conversations),
drawn AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_prepend(4294967295, list_transform(
            string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS draw
    FROM conversations, crc_table
),
rows_after AS (
    SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
        CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) FROM drawn) WHERE draw <> 0
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last, substr(role, 1, 1) AS r0
    FROM rows_after
),
faults AS (
    SELECT *, last = '' AS blank,
        last <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
        lag(r0) OVER (PARTITION BY conv_id ORDER BY i) AS before
    FROM placed
),
marked AS (
    SELECT *, blank OR duplicate AS gone, NOT blank AND NOT duplicate AND last NOT IN ('.', '!', '?') AS truncated,
        CASE WHEN last NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra
    FROM faults
),
ways AS (
    {after_inserts(first, "conv_id, i")}
    UNION ALL
    {after_inserts(step, "conv_id, i")}
),
decided AS (
    SELECT conv_id, least(w0, w3) AS way FROM ways
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
),
audits AS (SELECT conv_id, substr(way, 1, 8)::BIGINT AS cost, substr(way, 9) AS audit FROM decided),
edits AS (
    SELECT conv_id, audit, 0 AS p, 0 AS i, '' AS state, NULL::VARCHAR AS made FROM audits
    UNION ALL
    SELECT e.conv_id, e.audit, e.p + 1, CASE WHEN letter = 'I' THEN e.i ELSE e.i + 1 END,
        CASE letter WHEN 'D' THEN e.state WHEN 'K' THEN m.r0 ELSE CASE WHEN e.state = 'u' THEN 'a' ELSE 'u' END END,
        CASE letter WHEN 'D' THEN e.made ELSE concat_ws(chr(10), e.made, CASE
            WHEN letter = 'K' THEN m.role || ':' || m.text
            ELSE CASE WHEN e.state = 'u' THEN 'assistant:' ELSE 'user:' END || CASE letter WHEN 'R' THEN m.text ELSE '' END END) END
    FROM (SELECT *, substr(audit, p + 1, 1) AS letter FROM edits) e
    LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM e.conv_id AND m.i = e.i + 1
    WHERE e.p < length(e.audit)
),
made AS (SELECT conv_id, made FROM edits WHERE p = length(audit)),
figures AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
        count(*) FILTER (before || r0 NOT IN ('su', 'ua', 'au')) AS illegal
    FROM marked GROUP BY conv_id
)
SELECT a.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate,
    coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal, a.cost, a.audit,
    sha256(coalesce(m.made, '')) AS repaired_sha256
FROM audits a
LEFT JOIN made m ON m.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM a.conv_id
"""


ORACLE = _oracle()
