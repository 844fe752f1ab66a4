"""Queries over link keys and exact duplicates."""

from pyspark.sql import functions as F

from gleaner.operators import keys
from gleaner.plans.registry import query, stamp, text
from gleaner.plans.views import dedupe_key, stamp as sql_stamp, with_views


@query(
    "canonicalize_links",
    with_views("SELECT id, new_url AS canonical_url, sha256(new_url) AS url_hash, error FROM fx_keyed", "fx_keyed"),
)
def canonicalize_links(fx):
    links = fx.links().select("id", F.col("canonical_url").alias("url"))
    return keys.canonicalize_links(links, "url").select("id", "canonical_url", "url_hash", "error")


@query("dedupe_key", with_views(f"SELECT id, {dedupe_key('canonical_url')} AS dedupe_key FROM fx_links", "fx_links"))
def dedupe_keys(fx):
    return keys.with_dedupe_key(fx.links()).select("id", "dedupe_key")


KEEPERS = f"""
    SELECT id, dedupe_key, first_value(id) OVER (PARTITION BY dedupe_key ORDER BY
        (CASE WHEN image_url IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN body_content IS NOT NULL THEN 1 ELSE 0 END) DESC,
        fetched_at, id) AS keep_id
    FROM (SELECT *, {dedupe_key('canonical_url')} AS dedupe_key FROM fx_links)"""


@query(
    "merge_exact_duplicates_items",
    with_views("SELECT id, dedupe_key FROM keepers WHERE id = keep_id", "fx_links", extra={"keepers": KEEPERS}),
)
def exact_items(fx):
    survivors, _ = keys.merge_exact_duplicates(fx.links(), fx.saved())
    return survivors.select("id", "dedupe_key")


@query(
    "merge_exact_duplicates_saves",
    with_views(
        f"""SELECT user_id, target AS item_id, is_read, {sql_stamp('saved_at')} AS saved_at FROM (
            SELECT s.user_id, coalesce(k.keep_id, s.item_id) AS target, s.item_id, s.is_read, s.saved_at,
                coalesce(k.keep_id <> s.item_id, FALSE) AS moved
            FROM fx_saved s LEFT JOIN keepers k ON k.id = s.item_id)
        QUALIFY row_number() OVER (PARTITION BY user_id, target ORDER BY moved, saved_at, item_id) = 1""",
        "fx_links", "fx_saved", extra={"keepers": KEEPERS},
    ),
)
def exact_saves(fx):
    _, saves = keys.merge_exact_duplicates(fx.links(), fx.saved())
    return saves.select("user_id", "item_id", "is_read", stamp("saved_at").alias("saved_at"))


@query(
    "recanonicalize_plan",
    with_views(
        """SELECT id, new_url AS canonical_url, new_hash AS url_hash, keep_id,
            CASE WHEN new_hash IS NULL THEN 'unparseable' WHEN keep_id <> id THEN 'merged'
                 WHEN new_hash = url_hash THEN 'unchanged' ELSE 'rewritten' END AS action
        FROM (SELECT *, CASE WHEN new_hash IS NOT NULL THEN first_value(id) OVER (PARTITION BY new_hash ORDER BY
                (CASE WHEN image_url IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN body_content IS NOT NULL THEN 1 ELSE 0 END) DESC,
                fetched_at, id) END AS keep_id
            FROM (SELECT *, sha256(new_url) AS new_hash FROM fx_keyed))""",
        "fx_keyed",
    ),
)
def recanonicalize_plan(fx):
    return keys.recanonicalize_plan(fx.links())


@query(
    "match_existing",
    with_views(
        f"""SELECT c.id, coalesce(h.m.id, k.m.id) AS existing_id, coalesce(h.m.source_id, k.m.source_id) AS existing_source_id
        FROM (SELECT id, new_url, sha256(new_url) AS new_hash FROM fx_keyed WHERE error IS NULL) c
        LEFT JOIN (SELECT url_hash, min({{'id': id, 'source_id': source_id}}) AS m FROM stored GROUP BY 1) h ON h.url_hash = c.new_hash
        LEFT JOIN (SELECT dedupe_key, min({{'id': id, 'source_id': source_id}}) AS m FROM stored GROUP BY 1) k ON k.dedupe_key = c.new_url""",
        "fx_keyed",
        extra={"stored": f"SELECT id, source_id, url_hash, {dedupe_key('canonical_url')} AS dedupe_key FROM fx_links"},
    ),
)
def match_existing(fx):
    incoming = keys.canonicalize_links(fx.links().select("id", F.col("canonical_url").alias("url")), "url")
    found = keys.match_existing(incoming.filter("error is null"), fx.links())
    return found.select("id", "existing_id", "existing_source_id")


@query(
    "word_counts",
    with_views(
        """SELECT id, CAST(w AS VARCHAR) AS word_count, CAST(CASE WHEN w > 0 THEN greatest(1, CAST(floor(w / 200e0 + 0.5e0) AS INTEGER)) END AS VARCHAR) AS reading_minutes
        FROM (SELECT id, CASE WHEN trim(body_text) <> '' THEN len(regexp_split_to_array(trim(body_text), '\\s+')) END AS w FROM fx_candidates)""",
        "fx_candidates",
    ),
)
def word_counts(fx):
    counted = keys.word_counts(fx.candidates(), "body_text")
    return counted.select("id", text("word_count").alias("word_count"), text("reading_minutes").alias("reading_minutes"))
