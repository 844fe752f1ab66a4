"""Anchors of windows, found for all bytes of a block at once."""

import random

import numpy as np

from gleaner.llm import suffix_dedup, words


def test_every_byte_hash_is_the_hash_of_each_range():
    data = np.frombuffer(random.Random(3).randbytes(500), dtype=np.uint8)
    for size in (1, 8, 32, 500, 501):
        starts = np.arange(max(0, len(data) - size + 1))
        assert words.every_byte_hash(data, size).tolist() == words.byte_hashes(data, starts, starts + size).tolist()


def test_anchors_are_those_of_a_plain_walk():
    draw = random.Random(4)
    for window, size in ((10, 3), (10, 10), (7, 1), (12, 5)) * 30:
        lengths = [draw.choice((0, 1, window - 1, window, draw.randint(0, 60))) for _ in range(draw.randint(1, 9))]
        edges = np.cumsum([0, *lengths])
        data = np.array([draw.choice(b"ab") for _ in range(edges[-1])], dtype=np.uint8)
        plain = []
        for row, (begin, end) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            for low in range(begin, end - window + 1):
                starts = np.arange(low, low + window - size + 1)
                hashes = words.byte_hashes(data, starts, starts + size).tolist()
                at = low + min(range(len(hashes)), key=lambda k: (hashes[k] >> 32, k))
                if plain and plain[-1][:2] == [row, at]:
                    plain[-1][3] = low
                else:
                    plain.append([row, at, low, low, hashes[at - low]])
        found = [x.tolist() for x in suffix_dedup._anchors(data, edges, window, size)]
        assert [list(entry) for entry in zip(*found, strict=True)] == plain
