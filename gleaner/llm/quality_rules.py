"""Quality rules with cross-document line frequency.

Lines are normalised (words joined by one space, A-Z lower-cased) and hashed; per host
the distinct documents of each line are counted. A line in more than ``LINE_SHARE`` of
its host's distinct documents, and in ``LINE_DOCS`` at least, is boilerplate and is removed from
all but its first document, so no content vanishes altogether. A document is depleted,
and rejected, when fewer than half of its words are left. The share is relative, so
a verdict does not change when host and corpus grow alike.

Documents with equal texts count as one document, for a line and for its host: a line that is frequent only
because its document was copied is the business of the dedup stages.

Base rules need one document only: too few words, or too many repeated three-word
windows. Everything per document is computed at the scan; what is shuffled is one row
for each distinct line, and only its hash. Counts are map-side combined.

Defined results: a null text has no words and no lines. A null host is a host of its
own. A null id is judged like any other, but is first only if no other id has the
line. Rows that repeat an id are judged each on its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words
from gleaner.llm.groups import edges_of
from gleaner.llm.storage import Shelf

# Parameters of the line rule.
LINE_SHARE = 0.01
LINE_DOCS = 10
LEAST_KEPT = 0.5

# The base rules.
LEAST_WORDS = 50
MOST_REPEATED = 0.5
REPEAT_WINDOW = 3

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80

SCHEMA = (
    "doc_id long, host string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, lines array<struct<line:long,n:long>>"
)


def _running(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(values)))


def _repeat_words(block: words.Block, hashes: np.ndarray) -> np.ndarray:
    """Words of each row inside three-word windows that its text has twice or more."""
    starts = block.window_starts(REPEAT_WINDOW)
    rows = block.row_of_words()[starts]
    keys = words.window_hashes(hashes, starts, REPEAT_WINDOW)
    order = np.lexsort((keys, rows))
    edges = edges_of(rows[order], keys[order])
    several = np.repeat(np.diff(edges) > 1, np.diff(edges)) if len(starts) else np.zeros(0, dtype=bool)
    found = starts[order[several]]
    marks = np.zeros(len(block.starts) + 1, dtype=np.int64)
    np.add.at(marks, found, 1)
    np.add.at(marks, found + REPEAT_WINDOW, -1)
    return np.diff(_running(np.cumsum(marks)[:-1] > 0)[block.first])


def _lines(block: words.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line in bytes, and its row. A text of k line breaks has k + 1 lines."""
    breaks = np.flatnonzero(block.data == 0x0A)
    row = np.searchsorted(block.edges, breaks, side="right") - 1
    starts = np.concatenate((block.edges[:-1], breaks + 1))
    ends = np.concatenate((block.edges[1:], breaks))
    rows = np.concatenate((np.arange(block.rows), row))
    order = np.lexsort((starts, rows))
    return starts[order], ends[np.lexsort((ends, rows))], rows[order]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in words.blocks(batch["text"]):
            chars = np.diff(_running(_FIRST_BYTE[block.data])[np.stack((block.starts, block.ends))], axis=0)[0]
            symbols = np.diff(_running(_SYMBOL[block.data])[block.edges])

            starts, ends, rows = _lines(block)
            lo, hi = np.searchsorted(block.starts, starts), np.searchsorted(block.starts, ends)
            worded = hi > lo
            starts, ends, rows, lo, hi = starts[worded], ends[worded], rows[worded], lo[worded], hi[worded]
            raw = words.span_hashes(block.data, starts, ends)
            order = np.lexsort((raw, rows))
            edges = edges_of(rows[order], raw[order])
            repeated = np.ones(len(order), dtype=bool)
            repeated[edges[:-1]] = False
            dups = np.bincount(rows[order][repeated], minlength=block.rows)

            normal = words.run_hashes(block.word_hashes(folded=True), lo, hi)
            order = np.lexsort((normal, rows))
            edges = edges_of(rows[order], normal[order])
            of_line = np.diff(_running((hi - lo)[order])[edges])
            line_rows, lines = rows[order][edges[:-1]], normal[order][edges[:-1]]
            first = np.searchsorted(line_rows, np.arange(block.rows + 1)).astype(np.int32)
            structs = pa.StructArray.from_arrays(
                [pa.array(lines.view(np.int64)), pa.array(of_line.astype(np.int64))], names=["line", "n"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].slice(block.row, block.rows),
                    batch["host"].slice(block.row, block.rows),
                    batch["text_key"].slice(block.row, block.rows),
                    pa.array(block.counts()),
                    pa.array(np.diff(_running(chars)[block.first])),
                    pa.array(symbols),
                    pa.array(dups),
                    pa.array(_repeat_words(block, block.word_hashes())),
                    pa.ListArray.from_arrays(pa.array(first), structs),
                ],
                names=[field.split()[0] for field in SCHEMA.split(", ")[:8]] + ["lines"],
            )


def verdicts(
    docs: DataFrame,
    host: str = "source",
    line_share: float = LINE_SHARE,
    line_docs: int = LINE_DOCS,
    least_kept: float = LEAST_KEPT,
) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, host): base figures, words left, kept."""
    shelf = Shelf(docs.sparkSession, "quality-rules")
    texts = docs.select("doc_id", "text", F.col(host).alias("host"), F.xxhash64("text").alias("text_key"))
    scanned = shelf.put("scanned", texts.mapInArrow(_scan, SCHEMA)).withColumn("host", F.coalesce("host", F.lit("")))

    lines = scanned.select("doc_id", "host", "text_key", F.explode("lines.line").alias("line"))
    texts_of_host = scanned.select("host", "text_key").distinct()
    hosts = texts_of_host.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    counted = (
        lines.groupBy("host", "line", "text_key")
        .agg(F.min("doc_id").alias("first"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("found"), F.min("first").alias("first"))
        .filter(F.col("found") >= line_docs)
    )
    frequent = counted.join(hosts, "host").filter(F.col("found") > line_share * F.col("docs"))
    frequent = shelf.put("frequent", frequent.select("host", "line", "first"))

    own = scanned.select("doc_id", "host", "text_key", F.inline("lines"))
    lost = (
        own.join(frequent, ["host", "line"])
        .filter("first IS NULL OR doc_id IS NULL OR doc_id > first")
        .select("doc_id", "text_key", "host", "line", "n")
        .distinct()
        .groupBy("doc_id", "text_key", "host")
        .agg(F.sum("n").alias("lost"))
    )
    judged = scanned.drop("lines").alias("s").join(
        lost.alias("l"), F.expr("s.doc_id <=> l.doc_id AND s.text_key = l.text_key AND s.host = l.host"), "left"
    )
    words_left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words")
    )
    return judged.select(
        "s.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (words_left >= least_kept * F.col("n_words"))).alias("kept"),
        words_left.alias("n_words_left"),
        "s.text_key",
    )


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that are kept, unchanged."""
    kept = verdicts(docs, host).filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_text"))
    same_text = F.xxhash64(docs["text"]) == kept["_kept_text"]
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]) & same_text, "left_semi")


ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, text, coalesce(text, '') AS body,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS found
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM t WHERE len(w) >= {REPEAT_WINDOW})
),
repeats AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + {REPEAT_WINDOW})) AS q FROM windows WHERE found > 1) GROUP BY doc_id),
lines AS (
    SELECT doc_id, host, text, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
    FROM (SELECT doc_id, host, text, unnest(string_split(body, chr(10))) AS line FROM t)
),
worded AS (
    SELECT doc_id, host, text, line, len(lw) AS n,
        translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normal
    FROM lines WHERE len(lw) > 0
),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY doc_id),
hosts AS (SELECT host, count(*) AS docs FROM (SELECT DISTINCT host, text FROM t) GROUP BY host),
frequent AS (
    SELECT host, normal, first FROM (SELECT host, normal, count(DISTINCT text) AS found, min(doc_id) AS first FROM worded GROUP BY host, normal)
    JOIN hosts USING (host) WHERE found >= {LINE_DOCS} AND found > {LINE_SHARE} * docs
),
lost AS (SELECT doc_id, sum(n) AS n FROM worded JOIN frequent USING (host, normal) WHERE doc_id > first GROUP BY doc_id),
judged AS (
    SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(w) - coalesce(l.n, 0)::BIGINT AS n_words_left
    FROM t LEFT JOIN dups d USING (doc_id) LEFT JOIN repeats r USING (doc_id) LEFT JOIN lost l USING (doc_id)
)
SELECT * EXCLUDE (failed), failed AS base_failed, NOT failed AND n_words_left >= {LEAST_KEPT} * n_words AS kept
FROM (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {int(100 * MOST_REPEATED)} * n_words AS failed FROM judged)
"""
