"""Places where a corpus operator once did less than the whole job, each on the least input that shows it."""

from gleaner.llm import ngram_jaccard, quality_rules

DOCS = "doc_id long, text string, source string"


def test_copies_do_not_raise_the_line_limit(spark):
    """A line in 12 of 600 distinct documents (2 %), beside 1,200 copies of one of them."""
    common = " ".join(f"c{k}" for k in range(60))
    own = lambda i: " ".join(f"u{i}x{k}" for k in range(50))
    distinct = [(i, f"{common}\n{own(i)}" if i < 12 else own(i), "h") for i in range(600)]
    copies = [(1000 + i, own(599), "h") for i in range(1200)]
    left = []
    for rows in (distinct, distinct + copies):
        out = quality_rules.verdicts(spark.createDataFrame(rows, DOCS))
        left.append({r.doc_id: (r.kept, r.n_words_left) for r in out.filter("doc_id < 600").collect()})
    assert left[0] == left[1]
    assert left[0][0] == (True, 110) and all(left[0][i] == (False, 50) for i in range(1, 12))


def test_each_text_of_a_repeated_id_is_judged(spark):
    one, two, three = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(7, one, "h"), (7, two, "h"), (7, two, "h"), (9, two, "h"), (3, three, "h"), (8, three, "h"), (8, "alone", "h"), (None, one, "h")]
    out = ngram_jaccard.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in out) == sorted([(0, one), (7, one), (7, two), (3, three), (8, "alone")])


def test_stated_loss_is_over_shared_positions():
    runs = ngram_jaccard.runs_for(ngram_jaccard.RECALL, 0.8)
    assert runs == 10 and 3.0e-5 < ngram_jaccard.loss(runs, 0.8) < 3.2e-5
