"""Named queries over the supplied tables, each with its SQL.

Every query runs its operator over whole tables; limits appear only where a
page or a top-k is the operator.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.lineage import Scratch
from tagloom.operators import ingest as arrivals
from tagloom.operators import deltas, dml, graphs, health, implications, merge, rating, relations, review, search, similarity, stats
from tagloom.plans.oracle import sql
from tagloom.sources.proxies import SOURCE_PRIORITY, Catalog
from tagloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, build: Callable[[Catalog], DataFrame], body: str | None, recursive: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(Catalog(spark, sf_dir))
    if body is not None:
        ORACLE[name] = sql(body, recursive)


# --- search -----------------------------------------------------------------


def _search(name: str, query: str, where: str) -> None:
    add(name, lambda c: search.search(c, query), f"SELECT item_id, filepath FROM items i WHERE {where}")


def _tag(*names: str) -> str:
    return " AND ".join(f"item_id IN (SELECT item_id FROM item_tags WHERE tag = '{n}')" for n in names)


def _pages(order: str, keys: str) -> None:
    add(
        f"search_order_{order}", lambda c: search.search(c, f"red order:{order}", limit=50),
        f"SELECT item_id, filepath, CAST(row_number() OVER (ORDER BY {keys}, item_id) AS INTEGER) AS rank FROM items WHERE {_tag('red')} ORDER BY {keys}, item_id LIMIT 50",
    )


add(
    "search_tags_all", lambda c: search.search(c, "red bolt economy -gear order:score", limit=100),
    f"""SELECT item_id, filepath, CAST(row_number() OVER (ORDER BY coalesce(score, -999999) DESC, item_id) AS INTEGER) AS rank FROM items
    WHERE {_tag('red', 'bolt', 'economy')} AND item_id NOT IN (SELECT item_id FROM item_tags WHERE tag = 'gear') AND NOT contains(filepath, 'gear')
    ORDER BY coalesce(score, -999999) DESC, item_id LIMIT 100""",
)
add("search_all", lambda c: search.search(c, ""), "SELECT item_id, filepath FROM items")
_search("search_conjunction", "red bolt economy", _tag("red", "bolt", "economy"))
_search("search_negative", "red -bolt -.png", f"{_tag('red')} AND item_id NOT IN (SELECT item_id FROM item_tags WHERE tag = 'bolt') AND NOT contains(filepath, '.png')")
_search("search_source_all", "source:a source:n", "item_id IN (SELECT item_id FROM item_sources WHERE source = 'A') AND item_id IN (SELECT item_id FROM item_sources WHERE source = 'N')")
_search("search_pool", "pool:1 red", f"item_id IN (SELECT item_id FROM pool_items JOIN pools USING (pool_id) WHERE contains(lower(name), '1')) AND {_tag('red')}")
_search("search_has_pool", "has:pool small", f"item_id IN (SELECT item_id FROM pool_items) AND {_tag('small')}")
_search("search_ext", ".png .mp4 rod", f"(filepath LIKE '%.png' OR filepath LIKE '%.mp4') AND {_tag('rod')}")
_search("search_filename", "filename:ord_12", "contains(lower(filepath), 'ord_12')")
_search("search_has_parent", "has:parent", "parent_id IS NOT NULL")
_search("search_has_child", "has:child", "post_id IN (SELECT parent_id FROM items WHERE parent_id IS NOT NULL)")
_search("search_has_relationship", "has:relationship", "parent_id IS NOT NULL OR post_id IN (SELECT parent_id FROM items WHERE parent_id IS NOT NULL)")
_search("search_upscaled", "has:upscaled cold", f"upscaled_width IS NOT NULL AND upscaled_height IS NOT NULL AND {_tag('cold')}")
_search("search_not_upscaled", "-has:upscaled cold", f"upscaled_width IS NULL AND upscaled_height IS NULL AND {_tag('cold')}")
_search("search_video", "has:video", "filepath LIKE '%.mp4' OR filepath LIKE '%.webm'")
_search("search_favourite", "is:fav blue", f"item_id IN (SELECT item_id FROM favourites) AND {_tag('blue')}")
_search("search_metadata_missing", "metadata:missing", "item_id NOT IN (SELECT item_id FROM item_sources WHERE source <> 'local_tagger')")
_search("search_category_tag", "general:red copyright:promo", "item_id IN (SELECT item_id FROM item_tags WHERE tag = 'red' AND category = 'general') AND item_id IN (SELECT item_id FROM item_tags WHERE tag = 'promo' AND category = 'copyright')")
_search("search_rating", "rating_general large", _tag("rating:general", "large"))
_search("search_freetext", 'olt "widg" red', f"{_tag('red')} AND (item_id IN (SELECT item_id FROM item_tags WHERE contains(tag, 'olt')) OR contains(filepath, 'olt')) AND (item_id IN (SELECT item_id FROM item_tags WHERE contains(tag, 'widg')) OR contains(filepath, 'widg'))")
_pages("score", "coalesce(score, -999999) DESC")
_pages("score_asc", "coalesce(score, -999999)")
_pages("fav", "coalesce(fav_count, -999999) DESC")
_pages("new", "ingested_at DESC")
_pages("old", "ingested_at")
add("search_page", lambda c: search.search(c, "red", limit=25, offset=50), f"SELECT item_id, filepath, CAST(row_number() OVER (ORDER BY item_id) + 50 AS INTEGER) AS rank FROM (SELECT item_id, filepath FROM items WHERE {_tag('red')} ORDER BY item_id LIMIT 25 OFFSET 50)")
add("search_page_info", lambda c: search.page_info(search.search(c, "red"), 150), f"SELECT count(*) AS total, CAST(ceil(count(*) / 150.0) AS BIGINT) AS total_pages FROM items WHERE {_tag('red')}")
add("items_with_tags", search.items_with_tags, "SELECT i.item_id, i.filepath, coalesce(t.tags, '') AS tags FROM items i LEFT JOIN (SELECT item_id, string_agg(DISTINCT tag, ' ' ORDER BY tag) AS tags FROM item_tags GROUP BY 1) t ON t.item_id = i.item_id")
add("pool_contents", lambda c: search.pool_contents(c, "12"), "SELECT p.pool_id, i.item_id, i.filepath, p.sort_order FROM pool_items p JOIN pools q ON q.pool_id = p.pool_id JOIN items i ON i.item_id = p.item_id WHERE contains(lower(q.name), '12')")
add("tag_browse", lambda c: search.tag_browse(c, "o", "character", 30, 10), "SELECT tag, category, count(DISTINCT item_id) AS n FROM item_tags WHERE contains(tag, 'o') AND category = 'character' GROUP BY 1, 2 ORDER BY tag, category LIMIT 30 OFFSET 10")
add(
    "autocomplete", lambda c: search.autocomplete(c, "red bo"),
    """WITH best AS (SELECT tag, category, count(DISTINCT item_id) AS n FROM item_tags WHERE contains(lower(tag), 'bo') AND NOT starts_with(tag, 'rating_') GROUP BY 1, 2 ORDER BY n DESC, tag LIMIT 20),
    placed AS (SELECT tag, category, n, starts_with(lower(tag), 'bo') AS is_prefix, CAST(row_number() OVER (PARTITION BY category ORDER BY starts_with(lower(tag), 'bo') DESC, n DESC, tag) AS INTEGER) AS place,
      CASE category WHEN 'character' THEN 1 WHEN 'copyright' THEN 2 WHEN 'artist' THEN 3 WHEN 'species' THEN 4 WHEN 'general' THEN 5 WHEN 'meta' THEN 6 ELSE 0 END AS group_order FROM best)
    SELECT tag, category, n, is_prefix, place, CAST(group_order AS INTEGER) AS group_order FROM placed WHERE place <= 5""",
)
add("pool_search", lambda c: search.pool_search(c, "build"), "SELECT p.pool_id, p.name, count(i.item_id) AS n FROM pools p LEFT JOIN pool_items i ON i.pool_id = p.pool_id WHERE contains(lower(p.name), 'build') OR contains(lower(p.description), 'build') GROUP BY 1, 2")
add("small_items", lambda c: search.small_items(c.items.withColumn("filesize", F.coalesce("score", F.lit(0))), 300, 300, 0.5, 100), "SELECT item_id, image_width, image_height FROM items WHERE (image_width <= 300 OR image_height <= 300 OR image_width * image_height / 1000000.0 <= 0.5 OR coalesce(score, 0) / 1024.0 <= 100) AND upscaled_width IS NULL")
add(
    "review_feed_unrated", lambda c: search.review_feed(c, 100, 40),
    """WITH page AS (SELECT item_id, filepath FROM items WHERE item_id > 100 AND item_id NOT IN (SELECT item_id FROM item_tags WHERE tag LIKE 'rating:%') ORDER BY item_id LIMIT 40)
    SELECT p.item_id, p.filepath, coalesce(string_agg(DISTINCT t.tag, ' ' ORDER BY t.tag), '') AS tags FROM page p LEFT JOIN item_tags t ON t.item_id = p.item_id GROUP BY 1, 2""",
)
add("unrated_items", lambda c: c.items.join(c.item_tags.where("tag like 'rating:%'"), "item_id", "left_anti").select("item_id"), "SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM item_tags WHERE tag LIKE 'rating:%')")
add("document_freetext", lambda c: search.free_text(c.raw("documents"), ["the", "tion"]), "SELECT doc_id, CAST(CASE WHEN list_contains(string_split_regex(lower(text), '\\s+'), 'the') THEN 1 ELSE 0 END + CASE WHEN list_contains(string_split_regex(lower(text), '\\s+'), 'tion') THEN 1 ELSE 0 END AS INTEGER) AS whole_words FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion')")

# --- counts -----------------------------------------------------------------

add("avg_tags_per_item", lambda c: stats.avg_tags_per_item(c.item_tags), "SELECT round(avg(n), 1) AS avg_tags FROM (SELECT count(*) AS n FROM item_tags GROUP BY item_id)")
add("source_breakdown", lambda c: stats.count_by(c.item_sources, "source"), "SELECT source, count(*) AS n FROM item_sources GROUP BY 1")
add("category_counts", lambda c: stats.count_by(c.tags, "category"), "SELECT category, count(*) AS n FROM tags WHERE category IS NOT NULL GROUP BY 1")
add("tag_counts", lambda c: stats.tag_counts(c.item_tags), "SELECT tag, count(DISTINCT item_id) AS n FROM item_tags GROUP BY 1")
add("all_tags_sorted", lambda c: stats.all_tags(c.tags, c.item_tags), "SELECT t.tag, t.category, count(DISTINCT i.item_id) AS n FROM tags t LEFT JOIN item_tags i ON i.tag = t.tag GROUP BY 1, 2")
add(
    "dashboard", stats.dashboard,
    """SELECT 'total' AS facet, 'items' AS key, CAST(count(*) AS DOUBLE) AS value FROM items UNION ALL SELECT 'total', 'favourites', CAST(count(*) AS DOUBLE) FROM favourites
    UNION ALL SELECT 'total', 'avg_tags', round(avg(n), 1) FROM (SELECT count(*) AS n FROM item_tags GROUP BY item_id) UNION ALL SELECT 'source', source, CAST(count(*) AS DOUBLE) FROM item_sources GROUP BY source
    UNION ALL SELECT 'category', category, CAST(count(*) AS DOUBLE) FROM tags GROUP BY category
    UNION ALL SELECT 'top_tag', tag, CAST(n AS DOUBLE) FROM (SELECT tag, count(DISTINCT item_id) AS n FROM item_tags GROUP BY tag ORDER BY n DESC, tag LIMIT 20)""",
)
add(
    "categorization_stats", lambda c: stats.categorization_stats(c.tags, c.item_tags),
    """WITH u AS (SELECT t.tag, t.extended_category AS e, count(DISTINCT i.item_id) AS n FROM tags t LEFT JOIN item_tags i ON i.tag = t.tag GROUP BY 1, 2, t.category)
    SELECT count(*) AS tags, count(e) AS categorized, CAST(sum(CASE WHEN e IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS uses_categorized, CAST(sum(n) AS BIGINT) AS uses, round(100.0 * count(e) / count(*), 1) AS percent FROM u""",
)
add(
    "rating_distribution", stats.rating_distribution,
    """SELECT t.tag AS rating, count(*) FILTER (WHERE active_source = 'A') AS source_a, count(*) FILTER (WHERE active_source = 'N') AS source_n, count(*) FILTER (WHERE active_source = 'R') AS source_r, count(*) AS total
    FROM item_tags t JOIN items i ON i.item_id = t.item_id WHERE t.tag LIKE 'rating:%' GROUP BY 1""",
)
add(
    "prediction_crossref", lambda c: stats.prediction_crossref(c.predictions, c.item_tags, "red", 0.45, 5),
    "SELECT tag, round(avg(confidence), 6) AS avg_confidence, count(DISTINCT item_id) AS n FROM predictions WHERE item_id IN (SELECT item_id FROM item_tags WHERE tag = 'red') GROUP BY 1 HAVING avg(confidence) >= 0.45 AND count(DISTINCT item_id) >= 5",
)
add("tag_samples_top3", lambda c: stats.tag_samples(c.item_tags), "SELECT tag, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS samples FROM (SELECT tag, item_id, row_number() OVER (PARTITION BY tag ORDER BY item_id) AS r FROM (SELECT DISTINCT tag, item_id FROM item_tags)) WHERE r <= 3 GROUP BY 1")
add("coverage", stats.coverage, "SELECT count(*) AS items, min(score) AS min_score, max(score) AS max_score, round(100.0 * count(upscaled_width) / count(*), 1) AS upscaled_percent, round(100.0 * count(score) / count(*), 1) AS score_percent, round(100.0 * count(active_source) / count(*), 1) AS source_percent FROM items")
add("collection_status", stats.collection_status, "SELECT (SELECT count(*) FROM items) AS items, count(DISTINCT item_id) AS tagged, count(DISTINCT CASE WHEN tag LIKE 'rating:%' THEN item_id END) AS rated FROM item_tags")

# --- similarity -------------------------------------------------------------

QUERY_ITEM = 7
add("tag_weights", lambda c: similarity.catalog_weights(c).select("tag", "category", "n", F.round("weight", 6).alias("weight"), F.round("weight2", 6).alias("weight2")), "SELECT tag, category, n, round(weight, 6) AS weight, round(weight2, 6) AS weight2 FROM weighted_tags")


def _sums(weight: str, general: bool = False) -> str:
    only = "AND (category = 'general' OR NOT EXISTS (SELECT 1 FROM item_tags WHERE item_id = 7 AND category = 'general'))" if general else ""
    return f"""WITH wt AS (SELECT i.item_id, i.tag, i.category, {weight} AS w FROM item_tags i JOIN weighted_tags k ON k.tag = i.tag AND k.category = i.category),
    q AS (SELECT tag, category, w FROM wt WHERE item_id = 7 {only}),
    s AS (SELECT wt.item_id, sum(wt.w) AS other, sum(CASE WHEN q.tag IS NOT NULL THEN wt.w END) AS inter, (SELECT sum(w) FROM q) AS own FROM wt LEFT JOIN q ON q.tag = wt.tag AND q.category = wt.category WHERE wt.item_id <> 7 GROUP BY 1 HAVING count(q.tag) > 0)"""


_PLAIN = "inter / (own + other - inter)"
_ASYMMETRIC = "0.6 * inter / own + 0.4 * inter / (own + other - inter)"
for _method, _weight, _formula in (
    ("jaccard", "1.0", _PLAIN), ("weighted", "k.weight", _PLAIN), ("weighted_tfidf", "k.weight2", _PLAIN), ("asymmetric", "k.weight", _ASYMMETRIC), ("asymmetric_tfidf", "k.weight2", _ASYMMETRIC),
):
    add(f"sim_{_method}", lambda c, m=_method: similarity.similar_by_tags(c, QUERY_ITEM, m).select("item_id", F.round("score", 6).alias("score")), f"{_sums(_weight)} SELECT item_id, round({_formula}, 6) AS score FROM s")
add(
    "related_by_tags", lambda c: similarity.related_by_tags(c, QUERY_ITEM),
    f"{_sums('k.weight', True)}, r AS (SELECT item_id, round({_PLAIN}, 6) AS score FROM s WHERE {_PLAIN} > 0.1 ORDER BY 2 DESC, 1 LIMIT 20) SELECT item_id, score, CAST(row_number() OVER (ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM r",
)
_COS = "list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))) / sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) / sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
add(
    "cosine_topk", lambda c: similarity.nearest(c.raw("embeddings"), QUERY_ITEM, 20),
    f"WITH s AS (SELECT b.vec_id AS item_id, round({_COS}, 5) AS score FROM embeddings a JOIN embeddings b ON a.vec_id = 7 AND b.vec_id <> 7 ORDER BY 2 DESC, 1 LIMIT 20) SELECT item_id, score, CAST(row_number() OVER (ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM s",
)
add(
    "neighbour_cache", lambda c: similarity.neighbour_cache(c.raw("embeddings"), 50),
    f"WITH s AS (SELECT a.vec_id AS source_id, b.vec_id AS similar_id, round({_COS}, 5) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY score DESC, similar_id) AS INTEGER) AS rank FROM s) SELECT source_id, similar_id, score, rank FROM r WHERE rank <= 50",
)
add("hamming_pairs", lambda c: similarity.hamming_pairs(c.signatures, 20), "SELECT a, b, CAST(distance AS INTEGER) AS distance FROM pairs")
add("hamming_pairs_banded", lambda c: similarity.hamming_pairs(c.signatures, 7), "SELECT a, b, CAST(distance AS INTEGER) AS distance FROM pairs WHERE distance <= 7")
def _near_pairs(c: Catalog) -> DataFrame:
    """Pairs within 20 bits, found once and read by all that reviews them."""
    return c.kept("pairs-20", lambda: Scratch(c.spark, "pairs").save(similarity.hamming_pairs(c.signatures, 20), "pairs"), ("embeddings",))


def _coloured(c: Catalog) -> DataFrame:
    """Signatures with a colour signature of one word, which every fifth item lacks."""
    return c.signatures.withColumn("c0", F.when(F.col("item_id") % 5 != 0, F.col("w1")))


add(
    "visual_range_colour", lambda c: similarity.visual_range(_coloured(c), QUERY_ITEM, 30.0, 50, colour=0.3).withColumn("distance", F.round("distance", 6)),
    """WITH s AS (SELECT *, CASE WHEN item_id % 5 <> 0 THEN w1 END AS c0 FROM signatures),
    d AS (SELECT b.item_id, 64.0 * (1 - (0.7 * greatest(0, 1 - (bit_count(xor(a.w0, b.w0)) + bit_count(xor(a.w1, b.w1))) / 64.0) + 0.3 * coalesce(greatest(0, 1 - bit_count(xor(a.c0, b.c0)) / 32.0), 0))) AS distance FROM s a JOIN s b ON a.item_id = 7 AND b.item_id <> 7),
    t AS (SELECT * FROM d WHERE distance <= 30 ORDER BY distance, item_id LIMIT 50) SELECT item_id, round(CAST(distance AS DOUBLE), 6) AS distance, CAST(row_number() OVER (ORDER BY t.distance, item_id) AS INTEGER) AS rank FROM t""",
)
add(
    "visual_range", lambda c: similarity.visual_range(c.signatures, QUERY_ITEM, 28.0, 50),
    """WITH d AS (SELECT b.item_id, CAST(bit_count(xor(a.w0, b.w0)) + bit_count(xor(a.w1, b.w1)) AS DOUBLE) AS distance FROM signatures a JOIN signatures b ON a.item_id = 7 AND b.item_id <> 7),
    t AS (SELECT * FROM d WHERE distance <= 28 ORDER BY distance, item_id LIMIT 50) SELECT item_id, distance, CAST(row_number() OVER (ORDER BY distance, item_id) AS INTEGER) AS rank FROM t""",
)
add(
    "dup_groups", lambda c: similarity.signature_groups(c.signatures, 20),
    """WITH lk AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a AS item_id, a AS r FROM lk UNION SELECT reach.item_id, lk.b FROM reach JOIN lk ON lk.a = reach.r)
    SELECT min(r) AS group_id, item_id FROM reach GROUP BY item_id""", recursive=True,
)
add(
    "star_groups", lambda c: graphs.star_groups(_near_pairs(c)),
    """WITH ends AS (SELECT a AS id FROM pairs UNION SELECT b FROM pairs), n AS (SELECT id, row_number() OVER (ORDER BY id) AS k, (SELECT list(a) FROM pairs WHERE b = id) AS smaller FROM ends),
    h AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS heads UNION ALL SELECT n.k, CASE WHEN len(list_intersect(h.heads, coalesce(n.smaller, []))) > 0 THEN h.heads ELSE list_append(h.heads, n.id) END FROM h JOIN n ON n.k = h.k + 1),
    f AS (SELECT heads FROM h ORDER BY k DESC LIMIT 1) SELECT coalesce(list_min(list_intersect(f.heads, coalesce(n.smaller, []))), n.id) AS group_id, n.id AS item_id FROM n CROSS JOIN f""", recursive=True,
)


def _blended(c: Catalog) -> DataFrame:
    visual = similarity.visual_range(c.signatures, QUERY_ITEM, 30.0, 500).select("item_id", (1 - F.col("distance") / 64).alias("score"))
    semantic = similarity.top(similarity.nearest(c.raw("embeddings"), QUERY_ITEM, 500), 500, 0.1)
    tags = similarity.top(similarity.similar_by_tags(c, QUERY_ITEM), 500, 0.1)
    return similarity.blend({"visual": visual, "tag": tags, "semantic": semantic}, {"visual": 0.2, "tag": 0.2, "semantic": 0.6}, 12)


add(
    "blended", _blended,
    f"""{_sums('k.weight')}, t AS (SELECT item_id, score FROM (SELECT item_id, round({_PLAIN}, 6) AS score FROM s WHERE {_PLAIN} > 0.1 ORDER BY 2 DESC, 1 LIMIT 500)),
    d AS (SELECT b.item_id, bit_count(xor(a.w0, b.w0)) + bit_count(xor(a.w1, b.w1)) AS distance FROM signatures a JOIN signatures b ON a.item_id = 7 AND b.item_id <> 7),
    v AS (SELECT item_id, 1 - distance / 64.0 AS score FROM (SELECT * FROM d WHERE distance <= 30 ORDER BY distance, item_id LIMIT 500)),
    m AS (SELECT item_id, score FROM (SELECT b.vec_id AS item_id, round({_COS}, 5) AS score FROM embeddings a JOIN embeddings b ON a.vec_id = 7 AND b.vec_id <> 7 ORDER BY 2 DESC, 1 LIMIT 500) WHERE score > 0.1),
    u AS (SELECT item_id, score * 0.2 AS score FROM t UNION ALL SELECT item_id, score * 0.2 FROM v UNION ALL SELECT item_id, score * 0.6 FROM m),
    g AS (SELECT item_id, round(sum(score), 6) AS score FROM u GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12)
    SELECT item_id, score, CAST(row_number() OVER (ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM g""",
)
add("idf_stats", lambda c: similarity.idf_stats(similarity.catalog_weights(c)), "SELECT count(*) AS n, round(min(weight2), 5) AS least, round(max(weight2), 5) AS most, round(avg(weight2), 5) AS mean, round(median(weight2), 5) AS median, round(stddev_samp(weight2), 5) AS sd FROM weighted_tags")
add("category_weight_impact", lambda c: similarity.category_impact(similarity.catalog_weights(c)), "SELECT category, count(*) AS n, round(avg(weight), 6) AS mean_weight, round(avg(weight2), 6) AS mean_weight2, round(max(weight2) / min(weight2), 6) AS ratio FROM weighted_tags GROUP BY 1")
add("score_buckets", lambda c: similarity.score_buckets(similarity.similar_by_tags(c, QUERY_ITEM)), f"{_sums('k.weight')}, b AS (SELECT CAST(least(floor(round({_PLAIN}, 6) * 10), 9) AS INTEGER) AS bucket FROM s) SELECT bucket, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM b), 2) AS percent FROM b GROUP BY 1")
add("sparse_dense_items", lambda c: similarity.sparse_and_dense(c.item_tags), "WITH n AS (SELECT item_id, count(*) AS n FROM item_tags GROUP BY 1) SELECT item_id, n, 'sparse' AS \"end\" FROM (SELECT * FROM n ORDER BY n, item_id LIMIT 10) UNION ALL SELECT item_id, n, 'dense' FROM (SELECT * FROM n ORDER BY n DESC, item_id LIMIT 10)")
add(
    "weight_tuning_corr", lambda c: similarity.weight_tuning(c, QUERY_ITEM, [0.2, 0.4, 0.6, 0.8]),
    f"{_sums('k.weight')}, g AS (SELECT {_PLAIN} AS plain, inter / own AS cover, CAST(unnest([0.2, 0.4, 0.6, 0.8]) AS DOUBLE) AS alpha FROM s) SELECT alpha, round(corr(plain, alpha * cover + (1 - alpha) * plain), 5) AS r, count(*) AS n FROM g GROUP BY 1",
)

# --- classifier -------------------------------------------------------------


def _rated(c: Catalog) -> tuple[DataFrame, DataFrame]:
    rated = rating.rated_items(c.item_tags)
    return rated, rating.features(c.item_tags, rated)


def _weights(keys: str, rows: str) -> str:
    return f"""k AS (SELECT {keys}, rating, count(*) AS n FROM {rows} GROUP BY {keys}, rating), t AS (SELECT {keys}, sum(n) AS n_total FROM k GROUP BY {keys}),
    r AS (SELECT rating, count(*) AS n_rating, (SELECT count(*) FROM rated) AS n_all FROM rated GROUP BY 1),
    w AS (SELECT {', '.join('t.' + x.strip() for x in keys.split(','))}, r.rating, ln(greatest(coalesce(k.n, 0) / CAST(r.n_rating AS DOUBLE), 1e-10) / greatest((t.n_total - coalesce(k.n, 0)) / CAST(r.n_all - r.n_rating AS DOUBLE), 1e-10)) AS weight, coalesce(k.n, 0) AS n
      FROM t CROSS JOIN r LEFT JOIN k ON {' AND '.join(f'k.{x.strip()} = t.{x.strip()}' for x in keys.split(','))} AND k.rating = r.rating WHERE r.n_rating < r.n_all)"""


_TAG_W = _weights("tag", "features")
_PAIRS = "f AS (SELECT tag FROM features GROUP BY 1 HAVING count(*) >= 10), c AS (SELECT item_id, rating, tag FROM features WHERE tag IN (SELECT tag FROM f)), p AS (SELECT a.tag AS tag1, b.tag AS tag2, count(*) AS n FROM c a JOIN c b ON a.item_id = b.item_id AND a.tag < b.tag GROUP BY 1, 2 HAVING count(*) >= 10 ORDER BY n DESC, tag1, tag2 LIMIT 25000)"
_PAIR_ROWS = "pr AS (SELECT a.item_id, a.rating, p.tag1, p.tag2 FROM p JOIN features a ON a.tag = p.tag1 JOIN features b ON b.item_id = a.item_id AND b.tag = p.tag2)"


def _renamed(text: str, **names: str) -> str:
    for old, new in names.items():
        text = re.sub(rf"\b{old}\b", new, text)
    return text


_PAIR_W = _renamed(_weights("tag1, tag2", "pr"), k="pk", t="pt", r="rr", w="pw")
_SCORES = f"""WITH {_TAG_W}, {_PAIRS}, {_PAIR_ROWS}, {_PAIR_W}, u AS (SELECT DISTINCT item_id, tag FROM item_tags WHERE tag NOT LIKE 'rating%'),
    first AS (SELECT item_id, tag FROM (SELECT item_id, tag, row_number() OVER (PARTITION BY item_id ORDER BY tag) AS place FROM u) WHERE place <= 100),
    parts AS (SELECT u.item_id, w.rating, w.weight FROM u JOIN w ON w.tag = u.tag AND abs(w.weight) > 0.01
      UNION ALL SELECT a.item_id, pw.rating, 1.5 * pw.weight FROM first a JOIN pw ON pw.tag1 = a.tag AND abs(pw.weight) > 0.01 JOIN first b ON b.item_id = a.item_id AND b.tag = pw.tag2),
    x AS (SELECT parts.item_id, q.rating, coalesce(sum(CASE WHEN parts.rating = q.rating THEN parts.weight END), 0) AS score FROM parts CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS rating) q GROUP BY 1, 2)"""


def _trained(c: Catalog, limit: int | None = 25_000) -> tuple[DataFrame, DataFrame]:
    rated, found = _rated(c)
    scratch = Scratch(c.spark, "model")
    return scratch.save(rating.weigh(found, rated, ["tag"]), "tags"), scratch.save(rating.pair_weights(rating.pair_counts(found, limit=limit), rated), "pairs")


def _model(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """Tag and pair weights as written tables, trained once and read by every inference (OP-193)."""
    return c.kept("model", lambda: _trained(c))


def _unrated_tags(c: Catalog) -> DataFrame:
    return c.item_tags.where(~F.startswith("tag", F.lit("rating"))).select("item_id", "tag")


def _scored(c: Catalog) -> DataFrame:
    return rating.scores(_unrated_tags(c), *_model(c))


def _scored_whole(c: Catalog) -> DataFrame:
    """Scores by the weights of all frequent pairs, over all tags of an item."""
    return rating.scores(_unrated_tags(c), *c.kept("model-whole", lambda: _trained(c, None)), max_pair_tags=None)


add("rated_items", lambda c: rating.rated_items(c.item_tags), "SELECT item_id, CAST(rating AS BIGINT) AS rating FROM rated")
add("llr_tag_weights", lambda c: rating.weigh(_rated(c)[1], _rated(c)[0], ["tag"]).withColumn("weight", F.round("weight", 6)), f"WITH {_TAG_W} SELECT tag, CAST(rating AS BIGINT) AS rating, round(weight, 6) AS weight, n FROM w WHERE abs(weight) > 0.01")
add("frequent_pairs", lambda c: rating.frequent_pairs(_rated(c)[1]), f"WITH {_PAIRS} SELECT tag1, tag2, n FROM p")
add(
    "llr_pair_weights", lambda c: rating.pair_weights(rating.pair_counts(_rated(c)[1]), _rated(c)[0]).withColumn("weight", F.round("weight", 6)),
    f"WITH {_PAIRS}, {_PAIR_ROWS}, {_weights('tag1, tag2', 'pr')} SELECT tag1, tag2, CAST(rating AS BIGINT) AS rating, round(weight, 6) AS weight, n FROM w WHERE abs(weight) > 0.01",
)
_SCORES_WHOLE = _SCORES.replace(" ORDER BY n DESC, tag1, tag2 LIMIT 25000", "").replace(" WHERE place <= 100", "")
add("rating_scores", lambda c: _scored_whole(c).select("item_id", F.col("rating").cast("int").alias("rating"), F.round("score", 5).alias("score")), f"{_SCORES_WHOLE} SELECT item_id, CAST(rating AS INTEGER) AS rating, round(score, 5) AS score FROM x")
_SOFT = f"{_SCORES}, y AS (SELECT item_id, rating, exp(score - max(score) OVER (PARTITION BY item_id)) AS e FROM x), z AS (SELECT item_id, rating, e / sum(e) OVER (PARTITION BY item_id) AS p FROM y)"
add("rating_softmax", lambda c: rating.softmax(_scored(c)).select("item_id", F.col("rating").cast("int").alias("rating"), F.round("p", 5).alias("p")), f"{_SOFT} SELECT item_id, CAST(rating AS INTEGER) AS rating, round(p, 5) AS p FROM z")
add(
    "rating_predict", lambda c: rating.decide(rating.softmax(_scored(c))),
    f"""{_SOFT}, b AS (SELECT item_id, rating, round(p, 9) AS p, row_number() OVER (PARTITION BY item_id ORDER BY round(p, 9) DESC, rating) AS r FROM z)
    SELECT item_id, CASE WHEN p >= CASE rating WHEN 0 THEN 0.5 WHEN 1 THEN 0.6 WHEN 2 THEN 0.7 ELSE 0.8 END THEN CASE rating WHEN 0 THEN 'rating:general' WHEN 1 THEN 'rating:sensitive' WHEN 2 THEN 'rating:questionable' ELSE 'rating:explicit' END END AS rating, round(p, 5) AS confidence FROM b WHERE r = 1""",
)
add("top_weighted_tags", lambda c: rating.top_weighted(rating.weigh(_rated(c)[1], _rated(c)[0], ["tag"]), 0, 25), f"WITH {_TAG_W} SELECT tag, round(weight, 3) AS weight, n FROM w WHERE abs(weight) > 0.01 AND rating = 0 ORDER BY 2 DESC, n DESC, tag LIMIT 25")

# --- implications -----------------------------------------------------------

_CORR = "o AS (SELECT DISTINCT item_id, tag FROM item_tags WHERE category = 'character'), q AS (SELECT DISTINCT item_id, tag FROM item_tags WHERE category IN ('copyright', 'general')), n AS (SELECT tag, count(*) AS n FROM o GROUP BY 1), j AS (SELECT o.tag AS source_tag, q.tag AS implied_tag, count(*) AS sample FROM o JOIN q ON q.item_id = o.item_id GROUP BY 1, 2 HAVING count(*) >= 3), cr AS (SELECT source_tag, implied_tag, round(sample / CAST(n AS DOUBLE), 6) AS confidence, sample, n - sample AS affected FROM j JOIN n ON n.tag = source_tag WHERE sample / CAST(n AS DOUBLE) >= 0.85)"
_naming = lambda c: implications.naming_rules(c.tags, c.item_tags)
add("impl_naming", _naming, "SELECT r.source_tag, r.implied_tag, CAST(CASE WHEN r.implied_tag IN (SELECT tag FROM tags WHERE category = 'copyright') THEN 0.92 ELSE 0.95 END AS DOUBLE) AS confidence, n AS affected FROM rules r JOIN (SELECT tag, count(DISTINCT item_id) AS n FROM item_tags GROUP BY 1) t ON t.tag = r.source_tag")
add("impl_correlation", lambda c: implications.correlated_rules(c.tags, c.item_tags), f"WITH {_CORR} SELECT * FROM cr")
_CLOSED = "cl AS (SELECT source_tag, implied_tag, 1 AS depth FROM rules UNION SELECT cl.source_tag, rules.implied_tag, cl.depth + 1 FROM cl JOIN rules ON rules.source_tag = cl.implied_tag WHERE cl.depth < 1000)"
add("impl_closure", lambda c: implications.closure(_naming(c)), f"WITH {_CLOSED} SELECT source_tag, implied_tag, CAST(min(depth) AS INTEGER) AS depth FROM cl GROUP BY 1, 2", recursive=True)
add("impl_apply", lambda c: implications.missing_tags(c.item_tags.where("category <> 'copyright'"), implications.closure(_naming(c))), f"WITH {_CLOSED}, h AS (SELECT item_id, tag FROM item_tags WHERE category <> 'copyright') SELECT DISTINCT h.item_id, cl.implied_tag AS tag FROM h JOIN cl ON cl.source_tag = h.tag WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.item_id = h.item_id AND x.tag = cl.implied_tag)", recursive=True)
add("impl_preview", lambda c: implications.preview(c.item_tags, "bolt", "red"), "WITH s AS (SELECT DISTINCT item_id FROM item_tags WHERE tag = 'bolt'), t AS (SELECT DISTINCT item_id FROM item_tags WHERE tag = 'red') SELECT count(*) AS total, count(t.item_id) AS already, count(*) - count(t.item_id) AS will_gain FROM s LEFT JOIN t ON t.item_id = s.item_id")
add("impl_reverse", lambda c: implications.implying(_naming(c)), "SELECT implied_tag, count(DISTINCT source_tag) AS n, string_agg(DISTINCT source_tag, ',' ORDER BY source_tag) AS sources FROM rules GROUP BY 1")
add("impl_auto_approve", lambda c: implications.auto_approved(_naming(c), implications.correlated_rules(c.tags, c.item_tags)), f"WITH {_CORR} SELECT source_tag, implied_tag, 'naming_pattern' AS kind FROM rules UNION ALL SELECT source_tag, implied_tag, 'correlation' FROM cr WHERE confidence >= 0.95 AND sample >= 10")

# --- graph ------------------------------------------------------------------

_edges = lambda c: relations.backfill(c.items)
add("rel_backfill", _edges, "SELECT a, b, kind, source FROM relations")


def _pool_edges(c: Catalog) -> DataFrame:
    """The first item of each pool as parent of the others."""
    first = c.pool_items.where("sort_order = 1").select("pool_id", F.col("item_id").alias("a"))
    return c.pool_items.where("sort_order > 1").join(first, "pool_id").select("a", F.col("item_id").alias("b"), F.lit("parent_child").alias("kind"), F.lit("pool").alias("source"))


add("rel_siblings", lambda c: relations.siblings(_pool_edges(c)), "WITH e AS (SELECT f.item_id AS a, p.item_id AS b FROM pool_items p JOIN pool_items f ON f.pool_id = p.pool_id AND f.sort_order = 1 WHERE p.sort_order > 1) SELECT DISTINCT x.b AS a, y.b AS b FROM e x JOIN e y ON x.a = y.a AND x.b < y.b")
add("rel_family", lambda c: relations.family(c.items, _edges(c), 30), "WITH m AS (SELECT post_id, parent_id FROM items WHERE item_id = 30) SELECT DISTINCT item_id FROM (SELECT b AS item_id FROM relations WHERE a = 30 UNION SELECT a FROM relations WHERE b = 30 UNION SELECT i.item_id FROM items i JOIN m ON i.parent_id = m.post_id OR i.post_id = m.parent_id OR i.parent_id = m.parent_id) WHERE item_id <> 30")
add("rel_descendants", lambda c: relations.descendants(_edges(c)), "WITH d AS (SELECT a AS ancestor, b AS descendant, 1 AS depth FROM relations UNION SELECT d.ancestor, relations.b, d.depth + 1 FROM d JOIN relations ON relations.a = d.descendant WHERE d.depth < 1000) SELECT ancestor, descendant, CAST(min(depth) AS INTEGER) AS depth FROM d GROUP BY 1, 2", recursive=True)
add("rel_perspective", lambda c: relations.perspective(_edges(c), 30), "SELECT CASE WHEN a = 30 THEN b ELSE a END AS other, CASE WHEN a = 30 THEN 'child' ELSE 'parent' END AS role FROM relations WHERE a = 30 OR b = 30")
add("rel_reviewed", lambda c: relations.reviewed(_edges(c)), "SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM relations")
add("rel_summary", lambda c: relations.summary(_edges(c)), "SELECT kind, source, count(*) AS n FROM relations GROUP BY 1, 2")

# --- merge ------------------------------------------------------------------


def _two_sources(c: Catalog) -> DataFrame:
    """Each item's tags as two sources give them: one calls types general."""
    return c.item_tags.unionByName(c.item_tags.where("category = 'copyright'").withColumn("category", F.lit("general")))


def _raw_metadata(c: Catalog) -> DataFrame:
    """Items' JSON of two sources, from the event table: an id, a score and tags."""
    k = F.get_json_object("props", "$.k")
    data = F.concat(F.lit('{"sources": {"x": {"id": '), F.col("event_id").cast("string"), F.lit(', "score": {"total": '), k, F.lit('}, "tags": {"general": ["'), F.col("event_type"), F.lit('"], "artist": ["u'), F.col("user_id").cast("string"), F.lit('"]}}, "y": {"score": 3, "tags": "'), F.col("event_type"), F.lit(' extra"}}}'))
    return c.raw("events").select(F.col("event_id").alias("item_id"), data.alias("data"))


add("primary_source", lambda c: merge.primary_source(c.item_sources, SOURCE_PRIORITY), "SELECT item_id, min(source) AS source FROM item_sources GROUP BY 1")
add("merge_sources", lambda c: merge.merge_categories(_two_sources(c)), "WITH p AS (SELECT item_id, tag, max(CASE category WHEN 'character' THEN 6 WHEN 'species' THEN 5 WHEN 'copyright' THEN 4 WHEN 'artist' THEN 3 WHEN 'meta' THEN 2 ELSE 1 END) AS p FROM item_tags GROUP BY 1, 2) SELECT item_id, tag, CASE p WHEN 6 THEN 'character' WHEN 5 THEN 'species' WHEN 4 THEN 'copyright' WHEN 3 THEN 'artist' WHEN 2 THEN 'meta' ELSE 'general' END AS category FROM p")
add("merge_two", lambda c: merge.merge_two(c.item_tags.where("category <> 'artist'"), c.item_tags), "SELECT item_id, category, string_agg(DISTINCT tag, ' ' ORDER BY tag) AS tags FROM item_tags WHERE category <> 'artist' GROUP BY 1, 2")
add("dedupe_categories", lambda c: merge.dedupe_general(_two_sources(c)), "WITH t AS MATERIALIZED (SELECT item_id, tag, category FROM item_tags UNION ALL SELECT item_id, tag, 'general' FROM item_tags WHERE category = 'copyright'), o AS (SELECT item_id, tag, bool_or(category <> 'general') AS other FROM t GROUP BY 1, 2) SELECT t.item_id, t.tag, t.category FROM t JOIN o ON o.item_id = t.item_id AND o.tag = t.tag WHERE t.category <> 'general' OR NOT o.other")
add("category_pivot", lambda c: merge.category_columns(c.item_tags), "SELECT item_id, " + ", ".join(f"coalesce(string_agg(DISTINCT CASE WHEN category = '{x}' THEN tag END, ' ' ORDER BY CASE WHEN category = '{x}' THEN tag END), '') AS tags_{x}" for x in ("character", "copyright", "artist", "species", "meta", "general")) + " FROM item_tags GROUP BY 1")
add("orphan_repair", lambda c: merge.repair_missing(merge.category_columns(c.item_tags), c.item_tags.where("category <> 'meta'")), "SELECT item_id, tag, category FROM item_tags WHERE category = 'meta'")
add("rename_ratings", lambda c: merge.rename_ratings(c.item_tags.withColumn("tag", F.regexp_replace("tag", "^rating:", "rating_"))), "SELECT DISTINCT item_id, tag, category FROM item_tags")
add("multi_source_items", lambda c: merge.multi_source_items(c.item_sources), "SELECT item_id, count(DISTINCT source) AS n FROM item_sources GROUP BY 1 HAVING count(DISTINCT source) > 1")
add("json_extract_tags", lambda c: merge.extract_tags(_raw_metadata(c)), "SELECT event_id AS item_id, 'x' AS source, 'general' AS category, event_type AS tag FROM events UNION ALL SELECT event_id, 'x', 'artist', 'u' || CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT event_id, 'y', 'general', event_type FROM events UNION ALL SELECT event_id, 'y', 'general', 'extra' FROM events")
add("json_extract_score", lambda c: _raw_metadata(c).select("item_id", merge.score_of(F.col("data"), ["x", "y"]).alias("score")), "SELECT event_id AS item_id, coalesce(CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT), 3) AS score FROM events")
add("cooccurring_tags", lambda c: merge.cooccurring(c.item_tags, "red"), "SELECT tag, count(DISTINCT item_id) AS n FROM item_tags WHERE tag <> 'red' AND item_id IN (SELECT item_id FROM item_tags WHERE tag = 'red') GROUP BY 1 ORDER BY n DESC, tag LIMIT 10")
add(
    "category_suggest", lambda c: merge.suggest_category(c.tags, c.item_tags),
    """WITH s AS (SELECT a.tag, b.category AS beside, count(*) AS n FROM item_tags a JOIN item_tags b ON a.item_id = b.item_id AND (a.tag <> b.tag OR a.category <> b.category) GROUP BY 1, 2),
    r AS (SELECT tag, beside, row_number() OVER (PARTITION BY tag ORDER BY n DESC, beside) AS r FROM s)
    SELECT DISTINCT t.tag, CASE WHEN t.tag LIKE 'rating:%' THEN 'meta' ELSE coalesce(r.beside, 'general') END AS suggestion FROM tags t LEFT JOIN r ON r.tag = t.tag AND r.r = 1""",
)


def _incoming(c: Catalog) -> DataFrame:
    return c.tags.where("category in ('artist', 'general')").select("tag", F.lit("19_Meta_Attributes").alias("extended_category"))


for _mode, _value in (("merge", "coalesce(extended_category, i)"), ("update", "coalesce(i, extended_category)"), ("overwrite", "i")):
    add(f"import_{_mode}", lambda c, m=_mode: merge.import_categories(c.tags, _incoming(c), m), f"SELECT tag, category, {_value} AS extended_category FROM (SELECT *, CASE WHEN tag IN (SELECT tag FROM tags WHERE category IN ('artist', 'general')) THEN '19_Meta_Attributes' END AS i FROM tags)")
add("sync_base", lambda c: merge.sync_base(c.tags), "SELECT tag, CASE WHEN category IN ('general', 'meta') AND extended_category IS NOT NULL THEN 'general' ELSE category END AS category, extended_category FROM tags")
add("display_groups", lambda c: merge.display_groups(c.item_tags, stats.tag_counts(c.item_tags), QUERY_ITEM), "WITH n AS (SELECT tag, count(DISTINCT item_id) AS n FROM item_tags GROUP BY 1) SELECT category, string_agg(i.tag || '=' || CAST(n AS VARCHAR), ' ' ORDER BY i.tag || '=' || CAST(n AS VARCHAR)) AS tags FROM item_tags i JOIN n ON n.tag = i.tag WHERE item_id = 7 GROUP BY 1")

# --- change log and tables --------------------------------------------------

add("delta_diff", lambda c: deltas.diff(c.item_tags.where("category <> 'artist'"), c.item_tags.where("category <> 'meta'")), "SELECT item_id, tag, 'add' AS op FROM item_tags WHERE category = 'artist' UNION ALL SELECT item_id, tag, 'remove' FROM item_tags WHERE category = 'meta'")
_LAST = "l AS (SELECT md5, tag, op, row_number() OVER (PARTITION BY md5, tag ORDER BY ts DESC, id DESC) AS r, lag(op) OVER (PARTITION BY md5, tag ORDER BY ts, id) AS before FROM deltas)"
_SEQ = "o AS (SELECT md5, tag, op, row_number() OVER (PARTITION BY md5, tag ORDER BY ts, id) AS k, count(*) OVER (PARTITION BY md5, tag) AS n FROM deltas)"
add("delta_net", lambda c: deltas.net_state(c.deltas), f"WITH {_SEQ}, s AS (SELECT md5, tag, op AS state, k, n FROM o WHERE k = 1 UNION ALL SELECT s.md5, s.tag, CASE WHEN o.op = 'add' THEN 'add' WHEN s.state = 'add' THEN 'none' ELSE 'remove' END, o.k, o.n FROM s JOIN o ON o.md5 = s.md5 AND o.tag = s.tag AND o.k = s.k + 1) SELECT md5, tag, state AS op FROM s WHERE k = n AND state <> 'none'", recursive=True)
add("delta_compact", lambda c: deltas.compacted(c.deltas), f"WITH {_SEQ}, s AS (SELECT md5, tag, op AS state, k, n FROM o WHERE k = 1 UNION ALL SELECT s.md5, s.tag, CASE WHEN s.state = 'none' OR s.state = o.op THEN o.op ELSE 'none' END, o.k, o.n FROM s JOIN o ON o.md5 = s.md5 AND o.tag = s.tag AND o.k = s.k + 1) SELECT md5, tag, state AS op FROM s WHERE k = n AND state <> 'none'", recursive=True)
add("delta_replay", lambda c: deltas.replay(c.deltas.where("op = 'remove'").select("md5", "tag").distinct(), c.deltas), f"WITH {_LAST} SELECT DISTINCT md5, tag FROM l WHERE r = 1 AND op = 'add'")
add("upsert_tags", lambda c: dml.upsert(c.tags.select("tag", "category"), c.tags.where("category = 'artist'").select("tag", F.lit("meta").alias("category")), ["tag"]), "SELECT tag, CASE category WHEN 'artist' THEN 'meta' ELSE category END AS category FROM tags")
add("insert_ignore", lambda c: dml.insert_ignore(c.item_tags.where("category = 'general'").select("item_id", "tag", "category"), c.item_tags.where("category in ('general', 'artist')").select("item_id", "tag", "category"), ["item_id", "tag"]), "SELECT item_id, tag, category FROM item_tags WHERE category IN ('general', 'artist')")
add("update_by_key", lambda c: dml.update(c.items.select("item_id", "score", "fav_count"), c.favourites.select("item_id", F.lit(5).cast("long").alias("score")), ["item_id"]), "SELECT item_id, CASE WHEN item_id % 7 = 0 THEN 5 ELSE score END AS score, fav_count FROM items")
add("cascade_delete", lambda c: dml.delete_cascade(c.items, {"tags": c.item_tags}, c.favourites.select("item_id"), "item_id")[1]["tags"].select("item_id", "tag"), "SELECT item_id, tag FROM item_tags WHERE item_id NOT IN (SELECT item_id FROM favourites)")
add("toggle_favourites", lambda c: dml.toggle(c.favourites, c.items.where("fav_count < 30").select("item_id"), "item_id"), "SELECT item_id FROM favourites WHERE item_id NOT IN (SELECT item_id FROM items WHERE fav_count < 30) UNION ALL SELECT item_id FROM items WHERE fav_count < 30 AND item_id NOT IN (SELECT item_id FROM favourites)")
add("pool_next_order", lambda c: dml.next_order(c.pool_items), "SELECT pool_id, max(sort_order) + 1 AS next_order FROM pool_items GROUP BY 1")


def _reordered(c: Catalog) -> DataFrame:
    rows = c.raw("conversations").select(F.col("conv_id").alias("pool_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), (F.col("turn") + 1).alias("sort_order"))
    return dml.reorder(rows, 4, 4000, 3)


add("pool_reorder", _reordered, "SELECT conv_id AS pool_id, conv_id * 1000 + turn AS item_id, CASE WHEN conv_id <> 4 THEN turn + 1 WHEN turn = 0 THEN 3 WHEN turn + 1 BETWEEN 2 AND 3 THEN turn ELSE turn + 1 END AS sort_order FROM conversations")
add("trusted_predictions", lambda c: dml.trusted_predictions(c.predictions, 0.5).select("item_id", "tag"), "SELECT item_id, tag FROM predictions WHERE confidence >= 0.5")
add("surrogate_keys", lambda c: dml.surrogate_keys(c.tags.select(F.col("tag").alias("name"))), "SELECT tag AS name, row_number() OVER (ORDER BY tag) AS key FROM (SELECT DISTINCT tag FROM tags)")

# --- review and health ------------------------------------------------------


def _scored_pairs(c: Catalog) -> DataFrame:
    """Pairs of signatures with metadata of the items of their ids and stand-ins for what pixels give."""
    meta = c.items.select("item_id", (F.col("image_width") * F.col("image_height")).alias("px"), F.coalesce("score", F.lit(0)).alias("fs"), F.col("fav_count").alias("tg"))
    pairs = _near_pairs(c)
    x, y = (meta.select(*(F.col(k).alias(f"{k}_{s}") for k in meta.columns)) for s in ("a", "b"))
    j = pairs.join(x, F.col("a") == F.col("item_id_a")).join(y, F.col("b") == F.col("item_id_b"))
    stand_in = {"visual_signal": (F.col("a") * 7 + F.col("b")) % 60 / 1000.0, "largest_blob_ratio": (F.col("a") + F.col("b")) % 9 / 2000.0, "peak_blob_contrast": F.col("a") % 5 / 10.0, "changed_ratio": F.col("b") % 7 / 10.0, "mean_abs_diff": F.col("a") % 3 / 10.0}
    made = j.select("a", "b", "distance", review.ratio(F.col("px_a"), F.col("px_b")).alias("pixel_ratio"), review.ratio(F.col("fs_a"), F.col("fs_b")).alias("filesize_ratio"), review.gap(F.col("tg_a"), F.col("tg_b")).alias("tag_gap_ratio"), *(v.alias(k) for k, v in stand_in.items()))
    return review.suggestions(made)


_REVIEW = """p0 AS (SELECT a, b, distance, least(x.image_width * x.image_height, y.image_width * y.image_height) / CAST(greatest(x.image_width * x.image_height, y.image_width * y.image_height) AS DOUBLE) AS px,
    least(greatest(coalesce(x.score, 0), 1), greatest(coalesce(y.score, 0), 1)) / CAST(greatest(greatest(coalesce(x.score, 0), 1), greatest(coalesce(y.score, 0), 1)) AS DOUBLE) AS fs, abs(x.fav_count - y.fav_count) / CAST(greatest(x.fav_count, y.fav_count, 1) AS DOUBLE) AS gap,
    ((a * 7 + b) % 60) / 1000.0 AS visual, ((a + b) % 9) / 2000.0 AS blob, (a % 5) / 10.0 AS contrast, (b % 7) / 10.0 AS changed, (a % 3) / 10.0 AS mad FROM pairs JOIN items x ON x.item_id = a JOIN items y ON y.item_id = b),
    p1 AS (SELECT *, (1 - px) * 0.020 + (1 - fs) * 0.012 + gap * 0.006 AS raw FROM p0),
    p2 AS (SELECT *, CASE WHEN raw <= 0 THEN 0.0 WHEN visual >= 0.02 OR blob >= 0.0025 THEN raw ELSE raw * greatest(0.15, least(1.0, visual / 0.02), least(1.0, blob / 0.0025)) END AS adj FROM p1),
    sp AS (SELECT *, least(1.0, visual + adj) AS signal FROM p2)"""
add("suggestion_score", lambda c: _scored_pairs(c).select("a", "b", F.round("metadata_adjustment", 6).alias("adjustment"), F.round("signal", 6).alias("signal")), f"WITH {_REVIEW} SELECT a, b, CAST(round(adj, 6) AS DOUBLE) AS adjustment, CAST(round(signal, 6) AS DOUBLE) AS signal FROM sp")


def _labelled(c: Catalog) -> DataFrame:
    name, sure = review.label(F.col("signal"), *review.bounds())
    return _scored_pairs(c).select("a", "b", name.alias("label"), F.round(sure, 4).alias("confidence"))


add("suggestion_label", _labelled, f"WITH {_REVIEW} SELECT a, b, CASE WHEN signal <= 0.012 THEN 'likely_duplicate' WHEN signal >= 0.04 THEN 'likely_variation' ELSE 'uncertain' END AS label, CAST(round(least(1.0, CASE WHEN signal <= 0.012 THEN (0.012 - signal) / 0.012 WHEN signal >= 0.04 THEN (signal - 0.04) / 0.96 ELSE 1 - least(1.0, abs(signal - 0.026) / 0.014) END), 4) AS DOUBLE) AS confidence FROM sp")
_BUCKET = "CASE WHEN signal <= 0.012 THEN 0 WHEN signal < 0.04 THEN 1 ELSE 2 END"
for _mode, _keys, _where in (
    ("distance", "distance", "TRUE"), ("duplicate_first", f"{_BUCKET}, signal, distance", "TRUE"), ("likely_duplicates", "signal, distance", "signal <= 0.012"), ("duplicate_hunt", f"{_BUCKET}, signal, blob, contrast, changed, distance, mad", "TRUE"),
):
    add(
        f"queue_{_mode}", lambda c, m=_mode: review.queue(_scored_pairs(c), relations.reviewed(_edges(c)), m, 20, 20, 50),
        f"WITH {_REVIEW}, rv AS (SELECT least(a, b) AS a, greatest(a, b) AS b FROM relations), op AS (SELECT * FROM sp WHERE distance <= 20 AND NOT EXISTS (SELECT 1 FROM rv WHERE rv.a = sp.a AND rv.b = sp.b) AND {_where} ORDER BY {_keys}, a, b LIMIT 50)"
        f" SELECT a, b, CAST(distance AS INTEGER) AS distance, CAST(round(signal, 6) AS DOUBLE) AS signal, CAST(greatest(0.0, round((1 - distance / 20.0) * 100, 1)) AS DOUBLE) AS confidence, CAST(row_number() OVER (ORDER BY {_keys}, a, b) AS INTEGER) AS place FROM op",
    )


def _calibrated(c: Catalog) -> DataFrame:
    name, _ = review.label(F.col("signal"), *review.bounds())
    action = F.element_at(F.array(*map(F.lit, ("delete_a", "delete_b", "non_duplicate", "related", "skip"))), ((F.col("a") + F.col("b")) % 5 + 1).cast("int"))
    return review.calibration(_scored_pairs(c).select(name.alias("suggested"), action.alias("action")))


add(
    "calibration", _calibrated,
    f"""WITH {_REVIEW}, l AS (SELECT CASE WHEN signal <= 0.012 THEN 'likely_duplicate' WHEN signal >= 0.04 THEN 'likely_variation' ELSE 'uncertain' END AS suggested, CASE (a + b) % 5 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'duplicate' WHEN 4 THEN 'other' ELSE 'variation' END AS manual FROM sp)
    SELECT suggested, manual, CASE WHEN suggested = 'uncertain' OR manual = 'other' THEN 'uncertain' WHEN (suggested = 'likely_duplicate' AND manual = 'duplicate') OR (suggested = 'likely_variation' AND manual = 'variation') THEN 'matches' ELSE 'mismatches' END AS outcome, count(*) AS n FROM l GROUP BY 1, 2, 3""",
)
add("exact_duplicates", lambda c: review.exact_duplicates(c.raw("documents"), F.col("text"), "doc_id"), "WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS keeper FROM documents) SELECT doc_id AS id, keeper FROM k WHERE doc_id <> keeper")
add("health_null_source", lambda c: health.null_source(c, SOURCE_PRIORITY), "SELECT i.item_id, min(s.source) AS source FROM items i JOIN item_sources s ON s.item_id = i.item_id WHERE active_source IS NULL GROUP BY 1")
add("health_priority", lambda c: health.wrong_priority(c, SOURCE_PRIORITY), "WITH m AS (SELECT item_id, min(source) AS expected FROM item_sources GROUP BY 1 HAVING count(*) > 1) SELECT i.item_id, active_source, expected FROM items i JOIN m ON m.item_id = i.item_id WHERE active_source <> expected")
add("health_orphans", lambda c: health.orphans(c.item_tags, c.items.where("fav_count > 50"), "item_id").groupBy("category").agg(F.count("*").alias("n")), "SELECT category, count(*) AS n FROM item_tags WHERE item_id NOT IN (SELECT item_id FROM items WHERE fav_count > 50) GROUP BY 1")
add("health_without_tags", health.without_tags, "SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM item_tags)")
add(
    "broken_items", lambda c: health.broken_items(c, c.raw("embeddings"), 64),
    """WITH f AS (SELECT item_id, 'no_tags' AS issue FROM items WHERE item_id NOT IN (SELECT item_id FROM item_tags) UNION SELECT item_id, 'no_embedding' FROM items WHERE item_id NOT IN (SELECT vec_id FROM embeddings WHERE len(embedding) = 64)
    UNION SELECT item_id, 'no_hash' FROM items WHERE upscaled_width IS NULL AND filepath NOT LIKE '%.mp4' AND filepath NOT LIKE '%.webm') SELECT item_id, string_agg(issue, ',' ORDER BY issue) AS issues, count(*) AS n FROM f GROUP BY 1""",
)
add(
    "health_run", lambda c: health.run_checks({"null_source": health.null_source(c, SOURCE_PRIORITY), "priority": health.wrong_priority(c, SOURCE_PRIORITY), "without_tags": health.without_tags(c)}),
    """WITH m AS (SELECT item_id, min(source) AS expected, count(*) AS n FROM item_sources GROUP BY 1), f AS (
    SELECT 'null_source' AS "check", count(m.item_id) AS found FROM items i LEFT JOIN m ON m.item_id = i.item_id WHERE active_source IS NULL UNION ALL SELECT 'priority', count(*) FROM items i JOIN m ON m.item_id = i.item_id WHERE n > 1 AND active_source <> expected
    UNION ALL SELECT 'without_tags', count(*) FROM items WHERE item_id NOT IN (SELECT item_id FROM item_tags)) SELECT "check", found, found = 0 AS passed FROM f""",
)

# --- arrivals -----------------------------------------------------------------


def _frames(c: Catalog) -> DataFrame:
    """Each line of an order as one frame's prediction."""
    parts = c.raw("part").select("p_partkey", F.split("p_name", " ")[1].alias("tag"))
    return c.raw("lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("item_id"), "tag", F.lit("other").alias("category"), (F.col("l_discount") * 10).alias("confidence"))


def _raw_outputs(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """A model's raw outputs, a line of an order as a picture of its own and each part as a tag, and the parts' names."""
    rows = c.raw("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), F.col("l_partkey").cast("long").alias("idx"), (F.col("l_discount") * 100 - 5).alias("logit"))
    kind = F.when(F.col("p_partkey") % 4 == 0, "character").when(F.col("p_partkey") % 4 == 1, "unknown")
    tag = F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("rating_"), "p_name")).otherwise(F.col("p_name"))
    return rows, c.raw("part").where("p_partkey % 11 <> 0").select(F.col("p_partkey").cast("long").alias("idx"), tag.alias("tag"), kind.alias("category"))


add(
    "tagger_outputs", lambda c: arrivals.tagger_outputs(*_raw_outputs(c), shown=0.7, shown_by_category={"character": 0.9}),
    """WITH o AS (SELECT l_orderkey * 10 + l_linenumber AS item_id, p_name AS tag, CASE p_partkey % 4 WHEN 0 THEN 'character' ELSE 'general' END AS category, 1 / (1 + exp(-(l_discount * 100 - 5))) AS p
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 11 <> 0 AND p_partkey % 9 <> 0)
    SELECT item_id, tag, category, round(p, 6) AS confidence, p >= CASE category WHEN 'character' THEN 0.9 ELSE 0.7 END AS shown FROM o WHERE p >= 0.5""",
)


def _hits(c: Catalog) -> DataFrame:
    return c.raw("events").select(F.col("event_id").alias("item_id"), F.col("value").alias("similarity"), F.concat(F.lit("https://site.example/posts/"), F.col("user_id").cast("string")).alias("url"))


add("frame_votes", lambda c: arrivals.frame_votes(_frames(c)), "SELECT l_orderkey AS item_id, split_part(p_name, ' ', 2) AS tag, 'general' AS category FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount * 10 >= 0.5 GROUP BY 1, 2 HAVING count(*) >= 2 OR max(l_discount * 10) >= 0.8")
add("source_policy", lambda c: arrivals.source_policy(c.item_sources, ["A"], "N", ["R"]), "SELECT item_id, bool_or(source = 'A') AS has_trusted, bool_or(source = 'N') AS has_tagger, bool_and(source = 'R') AS stands_alone FROM item_sources GROUP BY 1")
add("search_hits", lambda c: arrivals.search_hits(_hits(c), 60.0), "SELECT event_id AS item_id, 'site.example' AS host, user_id AS post_id FROM events WHERE value >= 60")
add(
    "value_quantiles", lambda c: arrivals.quantiles(c.raw("events"), "event_type", "value"),
    """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, CAST(max(n) AS BIGINT) AS n, min(value) AS least, max(CASE WHEN k = round_even((n - 1) * 0.25, 0) THEN value END) AS p25, max(CASE WHEN k = round_even((n - 1) * 0.5, 0) THEN value END) AS p50, max(CASE WHEN k = round_even((n - 1) * 0.75, 0) THEN value END) AS p75,
    max(value) AS most, round(avg(value), 6) AS mean FROM o GROUP BY 1""",
)
add("score_spread", lambda c: arrivals.score_spread(similarity.similar_by_tags(c, QUERY_ITEM)), f"{_sums('k.weight')} SELECT count(*) AS n, round(max({_PLAIN}) - min({_PLAIN}), 5) AS spread, round(max({_PLAIN}), 5) AS best, round(min({_PLAIN}), 5) AS worst FROM s")

# --- streams ----------------------------------------------------------------


def _events(c: Catalog) -> DataFrame:
    return c.spark.readStream.schema(c.raw("events").schema).parquet(f"{c.sf_dir}/events*.parquet")  # a pattern, so that one file will do


_timed = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
add("stream_dedupe", lambda c: ingest.drain(ingest.distinct_by(_events(c).select("user_id", "event_type"), ["user_id", "event_type"])), "SELECT DISTINCT user_id, event_type FROM events")
add("stream_counters", lambda c: ingest.drain(ingest.counters(_events(c), "event_type"), "complete"), "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
add("stream_tumbling", lambda c: ingest.drain(ingest.windowed_counts(_timed(_events(c)), "ts", "1 day", late="30 days", key="event_type"), "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n"), "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
add("stream_rate_30s", lambda c: ingest.sliding_rate(c.raw("events").select("event_id", "user_id", "ts"), "user_id", "ts", 30).select("event_id", "rate"), "SELECT a.event_id, count(*) AS rate FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 30 SECOND GROUP BY 1")
add("stream_latest", lambda c: ingest.latest(c.raw("events"), "ts").select("event_id", "user_id"), "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
_LIMIT_STEP = """CASE WHEN len(w) < lim THEN CASE WHEN (len(w) + 1) * 2 < lim THEN least(lim + 1, 20) ELSE lim END ELSE greatest(2, lim // 2) END"""
add(
    "stream_state", lambda c: ingest.drain(ingest.adaptive_limiter(_events(c)), "update", ["user_id"]),
    f"""WITH e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS seen, CAST(0 AS BIGINT) AS allowed, 20 AS lim, CAST(NULL AS BIGINT) AS last, CAST([] AS BIGINT[]) AS stamps FROM e
      UNION ALL SELECT user_id, k, seen + 1, allowed + CASE WHEN len(w) < lim THEN 1 ELSE 0 END, {_LIMIT_STEP}, t, CASE WHEN len(w) < lim THEN list_append(w, t) ELSE w END FROM (
        SELECT e.user_id, e.k, e.t, CASE WHEN fresh THEN 0 ELSE seen END AS seen, CASE WHEN fresh THEN 0 ELSE allowed END AS allowed, CASE WHEN fresh THEN 20 ELSE lim END AS lim,
          CASE WHEN fresh THEN [] ELSE list_filter(stamps, lambda x: x > e.t - 30000000) END AS w
        FROM (SELECT s.*, e.t AS t, e.k AS ek, e.t - s.last > 604800000000 AS fresh FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1) j JOIN e ON e.user_id = j.user_id AND e.k = j.ek))
    SELECT s.user_id, seen, allowed, CAST(lim AS INTEGER) AS "limit" FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k AND e.k = e.n""", recursive=True,
)

from tagloom.plans import lifecycles  # noqa: E402, F401  registers its queries too
