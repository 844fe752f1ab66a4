"""URL filters by a bit-parallel wildcard automaton.

Rules are globs: ``*`` stands for any characters but ``/``, ``**`` for any at all. All
globs are laid end to end over the bits of a few 64-bit words, one bit for each
character that a glob still expects. Reading one character of the text shifts the
states of all globs at once: a state survives if its own character was read, or
stays in place if it is a wildcard's. States of many URLs are advanced together, a
column of characters at a time, so the work is (longest URL) x (words of bits) vector
steps and does not depend on how many rules match.

Only distinct bytes need a mask, and bits at the start of a word take their carry from
the word before, so any number of rules fits. A rule set is a broadcast-free argument
of the task: patterns are few by nature (they are rules, not data).

The canonical URL is host + path; see ``parts``. Among the rules that match, the one
with the longest text wins, and of equally long ones the first in the list. Without a
match the default verdict holds.

Defined results: a null URL, or one without ``://``, has an empty host and path and
matches no rule with a host. Rows that repeat an id are judged each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.storage import prepared

# The rules of the query, as (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DEFAULT = "allow"

ROWS_AT_ONCE = 4096


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    globs: tuple[str, ...]


def host_rules(rules: list[tuple[str, str, str]] = RULES) -> list[Rule]:
    """A rule fits its host and all subdomains, where the path begins with the rule's."""
    return [Rule(h + p, v, (f"{h}{p}**", f"*.{h}{p}**")) for h, p, v in rules]


class Automaton:
    """All globs of a rule list over shared bit words."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        bits = 0
        literal: list[tuple[int, int]] = []  # bit, byte
        stars: list[tuple[int, bool]] = []  # bit, may it read a slash
        starts: list[int] = []
        self.finals: list[tuple[int, int]] = []  # bit, rule
        # Bit k of a glob is set when its first k parts have been read.
        for number, rule in enumerate(rules):
            for glob in rule.globs:
                starts.append(bits)
                data, at = glob.encode(), 0
                while at < len(data):
                    if data[at : at + 2] == b"**":
                        stars.append((bits, True))
                        at += 2
                    elif data[at : at + 1] == b"*":
                        stars.append((bits, False))
                        at += 1
                    else:
                        literal.append((bits, data[at]))
                        bits += 1
                        at += 1
                self.finals.append((bits, number))
                bits += 1
        self.words = (bits + 63) // 64 or 1
        self.step = np.zeros((256, self.words), dtype=np.uint64)
        self.stay = np.zeros((256, self.words), dtype=np.uint64)
        self.start = np.zeros(self.words, dtype=np.uint64)
        for bit, byte in literal:
            self.step[byte, bit // 64] |= np.uint64(1 << bit % 64)
        for bit, slash in stars:
            self.stay[:, bit // 64] |= np.uint64(1 << bit % 64)
            if not slash:
                self.stay[ord("/"), bit // 64] &= ~np.uint64(1 << bit % 64)
        for bit in starts:
            self.start[bit // 64] |= np.uint64(1 << bit % 64)
        # Rules by preference, the best one first.
        self.order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), i))

    def advance(self, states: np.ndarray, read: np.ndarray) -> np.ndarray:
        """States (rows, words) after each row read its byte."""
        moved = states & self.step[read]
        out = moved << np.uint64(1)
        out[:, 1:] |= moved[:, :-1] >> np.uint64(63)
        return out | (states & self.stay[read])

    def best(self, texts: pa.Array) -> np.ndarray:
        """Index of the winning rule of each text, or -1."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        out = np.full(len(texts), -1, dtype=np.int64)
        lengths = np.array([len(x) for x in texts.to_pylist()], dtype=np.int64)
        order = np.argsort(lengths, kind="stable")
        for at in range(0, len(order), ROWS_AT_ONCE):
            rows = order[at : at + ROWS_AT_ONCE]
            own = texts.take(pa.array(rows)).to_pylist()
            out[rows] = self._block(own, lengths[rows])
        return out

    def _block(self, texts: list[bytes], lengths: np.ndarray) -> np.ndarray:
        states = np.tile(self.start, (len(texts), 1))
        edges = np.concatenate(([0], np.cumsum(lengths)))
        data = np.frombuffer(b"".join(texts) + b"\0", dtype=np.uint8)
        for k in range(int(lengths[-1]) if len(lengths) else 0):
            live = int(np.searchsorted(lengths, k, side="right"))  # sorted by length: the rest still reads
            states[live:] = self.advance(states[live:], data[edges[live:-1] + k])
        matched = np.zeros((len(texts), len(self.rules)), dtype=bool)
        for bit, rule in self.finals:
            matched[:, rule] |= (states[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) != 0
        out = np.full(len(texts), -1, dtype=np.int64)
        for rule in reversed(self.order):
            out[matched[:, rule]] = rule
        return out


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: what stands between ``://`` and the path, A-Z lower-cased, and the path up to ``?`` or ``#``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judged(pages: DataFrame, rules: list[Rule] | None = None, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url)."""
    prepared(pages.sparkSession)
    rules = host_rules() if rules is None else rules
    automaton = Automaton(rules)
    names = pa.array([rule.text for rule in rules] + [None], pa.string())
    verdicts = pa.array([rule.verdict for rule in rules] + [default], pa.string())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = pa.array(automaton.best(batch["canonical"]) % (len(rules) + 1))
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["host"], batch["path"], names.take(best), verdicts.take(best)],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    return split.withColumn("canonical", F.concat("host", "path")).mapInArrow(
        scan, "page_id long, host string, path string, rule string, verdict string"
    )


ORACLE = """
WITH p AS (
  SELECT page_id, lower_az(host) AS host, path FROM (
    SELECT page_id,
           CASE WHEN coalesce(strpos(url, '://'), 0) = 0 THEN '' ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') END AS host,
           CASE WHEN coalesce(strpos(url, '://'), 0) = 0 THEN '' ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END AS path
    FROM pages)
), r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT p.page_id, p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m
""".replace("lower_az(host)", "translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
