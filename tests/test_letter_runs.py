"""Runs of letters that propose the aliases of a large dictionary."""

import random

import pyarrow as pa

from gleaner.operators import topics


def test_letter_runs_are_those_of_a_plain_walk():
    draw = random.Random(5)
    texts = [None, "", "a", "ab", "\U0001f600\U0001f600b", *["".join(draw.choices("abé\U0001f600 ", k=draw.randint(0, 60))) for _ in range(50)]]
    for size in (1, 2, 3):
        found = topics.letter_runs.func(pa.array(texts), pa.array([size] * len(texts), pa.int32())).to_pylist()
        for text, codes in zip(texts, found, strict=True):
            text = text or ""
            plain = {sum(ord(c) << 21 * (size - 1 - k) for k, c in enumerate(text[at : at + size])) for at in range(len(text) - size + 1)}
            assert len(codes) == len(plain) and set(codes) == plain


def test_aliases_of_any_letters_are_found_in_whole_texts(spark):
    words = ["\U0001f600\U0001f601x", "\U0001f602", "éa", "abcd", "zzz"]
    texts = [(1, "q \U0001f600\U0001f601x q"), (2, "a\U0001f602b éa"), (3, "x" * 50_000 + "abcd"), (4, None), (5, "ab")]
    found = topics.matched_aliases(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in words], "alias string"))
    assert sorted(tuple(row) for row in found.collect()) == sorted(
        (i, w) for i, text in texts for w in words if w in (text or "")
    )
