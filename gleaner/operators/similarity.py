"""Near-identical titles: an exact set-similarity join that stays even under skew.

* Equal titles are one row (``title_sets``), so copies never multiply.
* Shingles are ordered by rarity and only a prefix is indexed; together with the
  length test this finds every pair above the threshold (prefix filtering).
* A posting list that is still long is cut into blocks; block pairs are spread
  over tasks, so no task ever holds a whole list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import jaccard, shingles
from gleaner.session import settled

# Two titles are near-duplicates above this similarity.
NEAR_DUPLICATE_THRESHOLD = 0.8

BLOCK_ROWS = 2_000


def with_title_key(df: DataFrame, title_col: str = "title") -> DataFrame:
    """Adds shingles and set_id, a digest equal exactly for titles with equal shingle sets."""
    cut = df.withColumn("shingles", F.array_sort(shingles(F.col(title_col))))
    return cut.withColumn("set_id", F.when(F.size("shingles") > 0, F.md5(F.array_join("shingles", "\n"))))


def title_sets(keyed: DataFrame) -> DataFrame:
    """One row per distinct shingle set; titles without shingles match nothing."""
    return (
        keyed.filter(F.col("set_id").isNotNull())
        .groupBy("set_id")
        .agg(F.first("shingles").alias("shingles"))
        .withColumn("n", F.size("shingles"))
    )


def _prefix_length(size: Column, threshold: float) -> Column:
    return size - F.ceil(size * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1


def _prefixed(sets: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """Sets with their shingles in global rarity order, and the indexed prefix."""
    ranked = (
        sets.select("set_id", "n", F.explode("shingles").alias("shingle"))
        .join(frequency, "shingle", "left")
        .groupBy("set_id", "n")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle"))).alias("ranked"))
        .select("set_id", "n", F.transform("ranked", lambda entry: entry["shingle"]).alias("shingles"))
    )
    return ranked.withColumn("prefix", F.slice("shingles", F.lit(1), _prefix_length(F.col("n"), threshold)))


def _frequency(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))


def _postings(prefixed: DataFrame, side: str) -> DataFrame:
    return prefixed.select(
        F.explode("prefix").alias("shingle"),
        F.struct("set_id", "n", "shingles", "prefix").alias(side),
    )


def _blocks(postings: DataFrame, name: str) -> DataFrame:
    rows = F.count(F.lit(1))
    return postings.groupBy("shingle").agg(F.ceil(rows / BLOCK_ROWS).cast("int").alias(name))


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """Keep a pair at its first shared prefix shingle only, and test the whole sets."""
    left, right = F.col("left"), F.col("right")
    similarity = jaccard(left["shingles"], right["shingles"])
    return (
        pairs.filter((right["n"] >= left["n"] * threshold) & (left["n"] >= right["n"] * threshold))
        .filter(F.array_intersect(left["prefix"], right["prefix"])[0] == F.col("shingle"))
        .withColumn("similarity", similarity)
        .filter(F.col("similarity") > threshold)
        .select(left["set_id"].alias("set_a"), right["set_id"].alias("set_b"), "similarity")
    )


def _block_join(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Join posting lists block by block; lists of ordinary length are one block."""
    left_blocks, right_blocks = _blocks(left, "left_blocks"), _blocks(right, "right_blocks")
    sizes = left_blocks.join(right_blocks, "shingle")

    def own_block(side: str) -> Column:
        return F.pmod(F.xxhash64(F.col(side)["set_id"]), F.col(f"{side}_blocks")).cast("int")

    def spread(other: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))

    left_rows = left.join(sizes, "shingle").select(
        "shingle", "left", own_block("left").alias("lb"), spread("right").alias("rb")
    )
    right_rows = right.join(sizes, "shingle").select(
        "shingle", "right", own_block("right").alias("rb"), spread("left").alias("lb")
    )
    return left_rows.join(right_rows, ["shingle", "lb", "rb"]).filter(condition)


def similar_sets(sets: DataFrame, threshold: float = NEAR_DUPLICATE_THRESHOLD) -> DataFrame:
    """Pairs of distinct title sets (set_a < set_b) more similar than the threshold."""
    sets = settled(sets)
    prefixed = settled(_prefixed(sets, _frequency(sets), threshold))
    ordered = F.col("left")["set_id"] < F.col("right")["set_id"]
    return _verified(_block_join(_postings(prefixed, "left"), _postings(prefixed, "right"), ordered), threshold)


def similar_across(left: DataFrame, right: DataFrame, threshold: float = NEAR_DUPLICATE_THRESHOLD) -> DataFrame:
    """Pairs between two tables of title sets; equal sets are matched by key, not by shingle."""
    left, right = settled(left), settled(right)
    frequency = _frequency(right)
    left_prefixed, right_prefixed = (settled(_prefixed(sets, frequency, threshold)) for sets in (left, right))
    unequal = F.col("left")["set_id"] != F.col("right")["set_id"]
    pairs = _block_join(_postings(left_prefixed, "left"), _postings(right_prefixed, "right"), unequal)
    equal = left.join(right, "set_id", "left_semi").select(
        F.col("set_id").alias("set_a"), F.col("set_id").alias("set_b"), F.lit(1.0).alias("similarity")
    )
    return _verified(pairs, threshold).unionByName(equal)


def near_duplicate_titles(
    candidates: DataFrame, titles: DataFrame, threshold: float = NEAR_DUPLICATE_THRESHOLD
) -> DataFrame:
    """Candidates whose title is a near-duplicate of any given title."""
    keyed = with_title_key(candidates)
    hits = similar_across(title_sets(keyed), title_sets(with_title_key(titles)), threshold)
    return keyed.join(hits.select(F.col("set_a").alias("set_id")).distinct(), "set_id", "left_semi").drop(
        "set_id", "shingles"
    )
