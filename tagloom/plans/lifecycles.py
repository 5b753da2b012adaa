"""Named queries of writes, rebuilds, rule and model lives, files and previews, each with its SQL; see ``registry``."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import columns, pixels
from tagloom.functions.lineage import Scratch
from tagloom.operators import coded, deltas, detail, dml, health, implications, maintenance, merge, rating, rebuild, relations, review, rules, search, similarity, stats
from tagloom.operators import ingest as arrivals
from tagloom.plans import jobs
from tagloom.plans.oracle import TABLES
from tagloom.plans.registry import _REVIEW, _SOFT, _edges, _events, _model, _naming, _near_pairs, _rated, _scored_pairs, _tag, _weights, _PAIR_ROWS, _PAIRS, ORACLE, add
from tagloom.sources import files
from tagloom.sources.proxies import Catalog
from tagloom.streaming import commits, ingest

def byte_shares(contents: list[bytes]) -> np.ndarray:
    """A stand-in for a model: how often each of 16 groups of bytes occurs."""
    return np.stack([np.bincount(np.frombuffer(b, np.uint8) >> 4, minlength=16) for b in contents]) if contents else np.zeros((0, 16))


PRIORITY = ("alpha", "beta", "gamma")
OTHER_PRIORITY = ("gamma", "beta", "alpha")

# --- rebuild ----------------------------------------------------------------

_FIRST = "first AS (SELECT item_id, CASE WHEN has_alpha THEN 'alpha' WHEN has_beta THEN 'beta' WHEN has_gamma THEN 'gamma' END AS source, CASE WHEN has_gamma THEN 'gamma' WHEN has_beta THEN 'beta' WHEN has_alpha THEN 'alpha' END AS other FROM meta_rows)"
_ROWS = "src AS (SELECT item_id, source, tag, category FROM source_tags UNION SELECT item_id, source, rating, 'meta' FROM source_ratings)"
_MERGED = """mg AS (SELECT item_id, tag, CASE max(CASE category WHEN 'character' THEN 6 WHEN 'species' THEN 5 WHEN 'copyright' THEN 4 WHEN 'artist' THEN 3 WHEN 'meta' THEN 2 ELSE 1 END) WHEN 6 THEN 'character' WHEN 5 THEN 'species' WHEN 4 THEN 'copyright' WHEN 3 THEN 'artist' WHEN 2 THEN 'meta' ELSE 'general' END AS category
    FROM source_tags GROUP BY 1, 2 UNION ALL SELECT item_id, min(rating), 'meta' FROM source_ratings GROUP BY 1)"""
_SEVERAL = "CAST(has_alpha AS INTEGER) + CAST(has_beta AS INTEGER) + CAST(has_gamma AS INTEGER) > 1"
_BASE = f"{_FIRST}, {_ROWS}, base AS (SELECT src.item_id, tag, category FROM src JOIN first ON first.item_id = src.item_id AND first.source = src.source)"


def _base(c: Catalog) -> DataFrame:
    return rebuild.rebuild(c.metadata, PRIORITY)


def _active(c: Catalog) -> DataFrame:
    return rebuild.rebuilt_items(c.metadata, PRIORITY).select("item_id", F.when(F.col("item_id") % 4 == 0, rebuild.MERGED).otherwise(F.col("active_source")).alias("active_source"))


def _hand_log(c: Catalog) -> DataFrame:
    """Hand-made changes: a tag added to every 11th item, the event's own tag taken from every 13th."""
    e = c.raw("events").select(F.col("event_id").alias("item_id"), "event_type")
    added = e.where("item_id % 11 = 0").select("item_id", F.lit("handmade").alias("tag"), F.lit("general").alias("category"), F.lit("add").alias("op"))
    return added.unionByName(e.where("item_id % 13 = 0").select("item_id", F.col("event_type").alias("tag"), F.lit("general").alias("category"), F.lit("remove").alias("op")))


add("source_summary", lambda c: rebuild.summary_of_sources(c.metadata), "SELECT r.item_id, r.source, r.post_id, r.parent_id, r.has_children, t.tags, sr.rating FROM (SELECT item_id, 'alpha' AS source, item_id AS post_id, CAST(user_id AS BIGINT) AS parent_id, TRUE AS has_children FROM meta_rows WHERE has_alpha UNION ALL SELECT item_id, 'beta', item_id + 1000000, k, FALSE FROM meta_rows WHERE has_beta UNION ALL SELECT item_id, 'gamma', item_id + 2000000, NULL, FALSE FROM meta_rows WHERE has_gamma) r JOIN (SELECT item_id, source, string_agg(DISTINCT tag, ' ' ORDER BY tag) AS tags FROM source_tags GROUP BY 1, 2) t ON t.item_id = r.item_id AND t.source = r.source LEFT JOIN source_ratings sr ON sr.item_id = r.item_id AND sr.source = r.source")
add("source_ratings_read", lambda c: merge.extract_rating(c.metadata), "SELECT item_id, source, rating FROM source_ratings")
add("rebuild_tags", _base, f"WITH {_BASE} SELECT item_id, tag, category FROM base")
add("rebuild_items", lambda c: rebuild.rebuilt_items(c.metadata, PRIORITY), f"WITH {_FIRST} SELECT m.item_id, f.source AS active_source, CASE f.source WHEN 'alpha' THEN m.item_id WHEN 'beta' THEN m.item_id + 1000000 ELSE m.item_id + 2000000 END AS post_id, CASE f.source WHEN 'alpha' THEN CAST(user_id AS BIGINT) WHEN 'beta' THEN k END AS parent_id, f.source = 'alpha' AS has_children FROM meta_rows m JOIN first f ON f.item_id = m.item_id WHERE f.source IS NOT NULL")
add(
    "rebuild_with_log", lambda c: rebuild.rebuild(c.metadata, PRIORITY, _hand_log(c)),
    f"WITH {_BASE} SELECT b.item_id, tag, category FROM base b JOIN events e ON e.event_id = b.item_id WHERE NOT (b.item_id % 13 = 0 AND tag = event_type) UNION ALL SELECT event_id, 'handmade', 'general' FROM events WHERE event_id % 11 = 0",
)
add(
    "rebuild_merged", lambda c: rebuild.rebuild(c.metadata, PRIORITY, merged=True),
    f"WITH {_BASE}, {_MERGED} SELECT item_id, tag, category FROM base WHERE item_id NOT IN (SELECT item_id FROM meta_rows WHERE {_SEVERAL}) UNION ALL SELECT item_id, tag, category FROM mg WHERE item_id IN (SELECT item_id FROM meta_rows WHERE {_SEVERAL})",
)
add(
    "switch_source", lambda c: rebuild.switch_source(_base(c), c.metadata, c.raw("events").where("event_id % 3 = 1").select(F.col("event_id").alias("item_id"), F.lit("beta").alias("source"))),
    f"WITH {_BASE} SELECT item_id, tag, category FROM base WHERE NOT (item_id % 3 = 1 AND item_id % 2 = 0) UNION ALL SELECT item_id, tag, category FROM src WHERE source = 'beta' AND item_id % 3 = 1",
)
_ACT = f"act AS (SELECT m.item_id, CASE WHEN m.item_id % 4 = 0 THEN 'merged' ELSE f.source END AS active_source, {_SEVERAL} AS several FROM meta_rows m JOIN first f ON f.item_id = m.item_id WHERE f.source IS NOT NULL)"
add("merge_apply", lambda c: rebuild.apply_merged(_base(c), _active(c), c.metadata)[0], f"WITH {_BASE}, {_MERGED}, {_ACT}, todo AS (SELECT item_id FROM act WHERE several AND active_source <> 'merged') SELECT item_id, tag, category FROM base WHERE item_id NOT IN (SELECT item_id FROM todo) UNION ALL SELECT item_id, tag, category FROM mg WHERE item_id IN (SELECT item_id FROM todo)")
add("merge_apply_active", lambda c: rebuild.apply_merged(_base(c), _active(c), c.metadata)[1], f"WITH {_FIRST}, {_ACT} SELECT item_id, CASE WHEN several THEN 'merged' ELSE active_source END AS active_source FROM act")
add("merge_revert", lambda c: rebuild.revert_merged(_base(c), _active(c), c.metadata, OTHER_PRIORITY)[0], f"WITH {_BASE}, {_ACT} SELECT item_id, tag, category FROM base WHERE item_id % 4 <> 0 UNION ALL SELECT src.item_id, tag, category FROM src JOIN first ON first.item_id = src.item_id AND first.other = src.source WHERE src.item_id % 4 = 0")
add("merge_revert_active", lambda c: rebuild.revert_merged(_base(c), _active(c), c.metadata, OTHER_PRIORITY)[1], f"WITH {_FIRST}, {_ACT} SELECT act.item_id, CASE WHEN active_source = 'merged' THEN other ELSE active_source END AS active_source FROM act JOIN first ON first.item_id = act.item_id")
add("priority_change", lambda c: rebuild.reactivated(c.metadata, PRIORITY, OTHER_PRIORITY), f"WITH {_FIRST} SELECT item_id, source AS before, other AS after FROM first WHERE source <> other")
add("priority_apply", lambda c: rebuild.apply_priority(_base(c), c.metadata, OTHER_PRIORITY, rebuild.priority_hash(PRIORITY))[0], f"WITH {_FIRST}, {_ROWS} SELECT src.item_id, tag, category FROM src JOIN first ON first.item_id = src.item_id AND first.other = src.source")


def _canonical_hash(c: Catalog) -> DataFrame:
    """The priority lists' hashes, computed by Spark from their canonical JSON."""
    names = c.raw("region").select("r_name", F.concat(F.lit('{"priority": ["'), F.col("r_name"), F.lit('"], "version": 1}')).alias("text"))
    return names.select("r_name", F.sha2("text", 256).alias("hash"), (F.sha2("text", 256) == F.lit(hashlib.sha256(json.dumps({"priority": ["ASIA"], "version": 1}, sort_keys=True).encode()).hexdigest())).alias("is_asia"))


add("priority_hashes", _canonical_hash, "SELECT r_name, sha256('{\"priority\": [\"' || r_name || '\"], \"version\": 1}') AS hash, r_name = 'ASIA' AS is_asia FROM region")

# --- item pages -------------------------------------------------------------



add(
    "item_details", lambda c: detail.details(c.items, c.item_tags, c.metadata, PRIORITY),
    f"""WITH {_FIRST}, t AS (SELECT item_id, string_agg(DISTINCT tag, ' ' ORDER BY tag) AS tags FROM item_tags GROUP BY 1)
    SELECT i.item_id, i.filepath, coalesce(t.tags, '') AS all_tags, coalesce(i.active_source, first.source) AS active_source,
    coalesce(array_to_string(list_filter([CASE WHEN has_alpha THEN 'alpha' END, CASE WHEN has_beta THEN 'beta' END, CASE WHEN has_gamma THEN 'gamma' END], lambda x: x IS NOT NULL), ','), '') AS sources
    FROM items i LEFT JOIN t ON t.item_id = i.item_id LEFT JOIN meta_rows m ON m.item_id = i.item_id LEFT JOIN first ON first.item_id = i.item_id""",
)

add("merged_predictions", lambda c: detail.merged_general(c.items.withColumn("active_source", F.when(F.col("item_id") % 5 == 0, detail.LOCAL_TAGGER).otherwise(F.col("active_source"))), c.item_tags.where(F.length("tag") > 4), c.predictions, 0.6), "SELECT DISTINCT p.item_id, p.tag FROM predictions p WHERE confidence >= 0.6 AND p.item_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM item_tags t WHERE t.item_id = p.item_id AND t.tag = p.tag AND t.category = 'general' AND length(t.tag) > 4)")


def _scattered(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """Items of which every fifth is known by another post id, and the map from the old ids to hashes."""
    items = c.items.withColumn("post_id", F.when(F.col("item_id") % 5 == 0, F.col("item_id") + 10**9).otherwise(F.col("item_id")))
    return items, c.items.where("item_id % 5 = 0 and item_id % 2 = 0").select("post_id", "md5")


add(
    "related_items", lambda c: detail.related(*_scattered(c)),
    """WITH p AS (SELECT i.item_id AS child, i.parent_id AS parent FROM items i JOIN items q ON q.item_id = i.parent_id WHERE i.parent_id <> i.item_id AND (i.parent_id % 5 <> 0 OR i.parent_id % 2 = 0))
    SELECT child AS item_id, parent AS other, 'parent' AS role FROM p UNION ALL SELECT parent, child, 'child' FROM p""",
)
add("implied_tags", lambda c: detail.implied_tags(c.facts, c.tags), "SELECT f.item_id, f.tag, f.category, t.extended_category FROM facts f JOIN tags t ON t.tag = f.tag AND t.category = f.category WHERE f.source = 'implication'")
add("favourite_paths", lambda c: detail.favourite_paths(c.items, c.favourites), "SELECT item_id, filepath FROM items WHERE item_id IN (SELECT item_id FROM favourites)")
add(
    "cache_refreshed",
    lambda c: detail.refreshed(c.pool_items, c.pool_items.where("pool_id % 7 <> 0").withColumn("sort_order", F.col("sort_order") * 10), c.pools.where("pool_id % 3 = 0 or pool_id % 7 = 0"), "pool_id"),
    "SELECT pool_id, item_id, CASE WHEN pool_id % 3 = 0 THEN sort_order * 10 ELSE sort_order END AS sort_order FROM pool_items WHERE pool_id % 7 <> 0",
)


def _edited(c: Catalog) -> DataFrame:
    """Every 9th item gets its general tags and one new tag."""
    mine = c.item_tags.where("item_id % 9 = 0 and category = 'general'")
    return mine.select("item_id", "tag", "category").unionByName(mine.select("item_id").distinct().select("item_id", F.lit("edited").alias("tag"), F.lit("meta").alias("category")))


_EDIT = "ed AS (SELECT item_id, tag, category FROM item_tags WHERE item_id % 9 = 0 AND category = 'general' UNION SELECT item_id, 'edited', 'meta' FROM item_tags WHERE item_id % 9 = 0 AND category = 'general')"
add("edit_tags", lambda c: detail.edit_tags(c.item_tags, _edited(c))[0], f"WITH {_EDIT} SELECT item_id, tag, category FROM item_tags WHERE item_id NOT IN (SELECT item_id FROM ed) UNION ALL SELECT item_id, tag, category FROM ed")
add("edit_changes", lambda c: detail.edit_tags(c.item_tags, _edited(c))[1], f"WITH {_EDIT} SELECT DISTINCT item_id, 'edited' AS tag, 'add' AS op FROM ed UNION ALL SELECT DISTINCT t.item_id, t.tag, 'remove' FROM item_tags t WHERE t.item_id IN (SELECT item_id FROM ed) AND NOT EXISTS (SELECT 1 FROM ed WHERE ed.item_id = t.item_id AND ed.tag = t.tag)")
add("category_texts", search.category_texts, "SELECT item_id, " + " || ' ' || ".join(f"coalesce(string_agg(DISTINCT CASE WHEN category = '{x}' THEN tag END, ' ' ORDER BY CASE WHEN category = '{x}' THEN tag END), '')" for x in ("character", "copyright", "artist", "species", "meta", "general")) + " AS tags_all FROM item_tags GROUP BY 1")
add("tag_browse_total", lambda c: search.tag_browse_total(c, "o", "character"), "SELECT count(*) AS total FROM (SELECT DISTINCT tag, category FROM item_tags WHERE contains(tag, 'o') AND category = 'character')")
add("review_feed_ai", lambda c: search.review_feed(c, 50, 40, "ai_predicted"), "WITH page AS (SELECT item_id, filepath FROM items WHERE item_id > 50 AND item_id IN (SELECT item_id FROM facts WHERE tag LIKE 'rating:%' AND source = 'ai_inference') ORDER BY item_id LIMIT 40) SELECT p.item_id, p.filepath, coalesce(string_agg(DISTINCT t.tag, ' ' ORDER BY t.tag), '') AS tags FROM page p LEFT JOIN item_tags t ON t.item_id = p.item_id GROUP BY 1, 2")
add("review_feed_all", lambda c: search.review_feed(c, 10, 30, "all", skip=(33, 35)), "WITH page AS (SELECT item_id, filepath FROM items WHERE item_id > 10 AND item_id NOT IN (33, 35) ORDER BY item_id LIMIT 30) SELECT p.item_id, p.filepath, coalesce(string_agg(DISTINCT t.tag, ' ' ORDER BY t.tag), '') AS tags FROM page p LEFT JOIN item_tags t ON t.item_id = p.item_id GROUP BY 1, 2")
_INDEX = "ix AS (SELECT DISTINCT unnest(regexp_extract_all(lower(filepath), '[a-z0-9]+')) AS word, item_id, 'path' AS field FROM items UNION SELECT unnest(list_append(regexp_extract_all(lower(tag), '[a-z0-9]+'), lower(tag))), item_id, 'tag' FROM item_tags)"
add("text_index", lambda c: search.text_index(c.items, c.item_tags), f"WITH {_INDEX} SELECT word, item_id, field FROM ix")
add(
    "index_search", lambda c: search.index_search(search.text_index(c.items, c.item_tags), ["red", "png"], ["bra"]),
    f"""WITH {_INDEX}, w AS (SELECT DISTINCT word, item_id FROM ix), d AS (SELECT word, ln(1 + (SELECT count(DISTINCT item_id) FROM ix) / CAST(count(*) AS DOUBLE)) AS rarity FROM w GROUP BY 1),
    h AS (SELECT item_id, 'a' AS term, rarity AS s FROM w JOIN d USING (word) WHERE word = 'red' UNION ALL SELECT item_id, 'b', rarity FROM w JOIN d USING (word) WHERE word = 'png' UNION ALL SELECT item_id, 'c', max(rarity) * 0.5 FROM w JOIN d USING (word) WHERE word LIKE 'bra%' GROUP BY 1)
    SELECT item_id, round(sum(s), 6) AS score FROM h GROUP BY 1 HAVING count(*) = 3""",
)
add(
    "index_updated", lambda c: search.index_updated(search.text_index(c.items, c.item_tags), c.items.where("item_id % 10 <> 0"), c.item_tags.where("item_id % 10 <> 0 and (item_id % 6 <> 0 or category = 'meta')"), c.items.where("item_id % 10 = 0 or item_id % 6 = 0").select("item_id")),
    f"WITH {_INDEX}, kept AS (SELECT * FROM ix WHERE item_id % 10 <> 0) SELECT word, item_id, field FROM kept WHERE item_id % 6 <> 0 OR field = 'path' UNION SELECT unnest(list_append(regexp_extract_all(lower(tag), '[a-z0-9]+'), lower(tag))), item_id, 'tag' FROM item_tags WHERE item_id % 10 <> 0 AND item_id % 6 = 0 AND category = 'meta'",
)
add(
    "filter_suggestions", lambda c: search.filters_for(c.raw("nation").select(F.lower(F.substring("n_name", 1, 2)).alias("token")).union(c.item_sources.select(F.concat(F.lit("source:"), F.lower("source")))).union(c.item_tags.where("tag like 'rating:%'").select(F.expr("substr(tag, 1, 9)"))).union(c.item_tags.where("tag like 'rating:%'").select(F.expr("substr(tag, 8, 3)"))), PRIORITY).where("filter rlike '^(rating|source):'"),
    """WITH tk AS (SELECT DISTINCT lower(substr(n_name, 1, 2)) AS token FROM nation UNION SELECT DISTINCT 'source:' || lower(source) FROM item_sources UNION SELECT substr(tag, 1, 9) FROM item_tags WHERE tag LIKE 'rating:%' UNION SELECT substr(tag, 8, 3) FROM item_tags WHERE tag LIKE 'rating:%'),
    kw AS (SELECT 'rating:' || unnest(['general', 'sensitive', 'questionable', 'explicit']) AS filter UNION ALL SELECT 'source:' || unnest(['alpha', 'beta', 'gamma'])),
    wd AS (SELECT filter, filter AS word FROM kw UNION ALL SELECT filter, split_part(filter, ':', 2) FROM kw UNION ALL SELECT filter, split_part(filter, ':', 1) FROM kw WHERE filter LIKE 'rating:%' UNION ALL SELECT 'rating:general', 'safe')
    SELECT DISTINCT token, filter FROM tk JOIN wd ON starts_with(word, token)""",
)
add("random_page", lambda c: files.random_page(c.items, 20, 5).select("item_id", "filepath"), "SELECT item_id, filepath FROM items ORDER BY md5(CAST(item_id AS VARCHAR) || '|5'), item_id LIMIT 20")

# --- rules ------------------------------------------------------------------


def _suggested(c: Catalog) -> DataFrame:
    return rules.suggestions(_naming(c), implications.correlated_rules(c.tags, c.item_tags), c.tags)


def _rules(c: Catalog) -> DataFrame:
    """Rules from names, one in seven of them switched off."""
    status = F.when(F.length("source_tag") % 7 == 0, "inactive").otherwise("active")
    return _naming(c).select("source_tag", "implied_tag", F.lit("naming_pattern").alias("inference_type"), "confidence", status.alias("status"))


_CONF = "CAST(CASE WHEN implied_tag IN (SELECT tag FROM tags WHERE category = 'copyright') THEN 0.92 ELSE 0.95 END AS DOUBLE)"
_CAT = "ca AS (SELECT tag, min(category) AS category FROM tags GROUP BY 1)"
_CORRELATED = "o AS (SELECT DISTINCT item_id, tag FROM item_tags WHERE category = 'character'), q AS (SELECT DISTINCT item_id, tag FROM item_tags WHERE category IN ('copyright', 'general')), n AS (SELECT tag, count(*) AS n FROM o GROUP BY 1), j AS (SELECT o.tag AS source_tag, q.tag AS implied_tag, count(*) AS sample FROM o JOIN q ON q.item_id = o.item_id GROUP BY 1, 2 HAVING count(*) >= 3), cr AS (SELECT source_tag, implied_tag, round(sample / CAST(n AS DOUBLE), 6) AS confidence FROM j JOIN n ON n.tag = source_tag WHERE sample / CAST(n AS DOUBLE) >= 0.85)"
_SUGGESTED = f"{_CAT}, {_CORRELATED}, sg AS (SELECT x.*, a.category AS source_category, b.category AS implied_category FROM (SELECT source_tag, implied_tag, 'naming_pattern' AS pattern_type, {_CONF} AS confidence FROM rules UNION ALL SELECT source_tag, implied_tag, 'correlation', confidence FROM cr) x JOIN ca a ON a.tag = source_tag JOIN ca b ON b.tag = implied_tag)"
add("rule_suggestions", _suggested, f"WITH {_SUGGESTED} SELECT * FROM sg")
add("rule_suggestions_filtered", lambda c: rules.filtered(_suggested(c), "o", "naming_pattern", ["character"], ["!copyright"]), f"WITH {_SUGGESTED} SELECT * FROM sg WHERE pattern_type = 'naming_pattern' AND (contains(source_tag, 'o') OR contains(implied_tag, 'o')) AND source_category = 'character' AND implied_category <> 'copyright'")
add("rule_suggestions_page", lambda c: rules.page(_suggested(c), 2, 25), f"WITH {_SUGGESTED} SELECT * FROM sg ORDER BY pattern_type, source_tag, implied_tag LIMIT 25 OFFSET 25")
add("rule_suggestions_summary", lambda c: rules.summary(_suggested(c), 25), f"WITH {_SUGGESTED} SELECT count(*) AS total, count(*) FILTER (WHERE pattern_type = 'naming_pattern') AS naming, count(*) FILTER (WHERE pattern_type = 'correlation') AS correlation, CAST(ceil(count(*) / 25.0) AS BIGINT) AS pages FROM sg")
_RULES = f"ru AS (SELECT source_tag, implied_tag, 'naming_pattern' AS inference_type, {_CONF} AS confidence, CASE WHEN length(source_tag) % 7 = 0 THEN 'inactive' ELSE 'active' END AS status FROM rules)"


def _pairs_by_hand(c: Catalog) -> DataFrame:
    """Every known word implies 'red'; so does a tag that does not exist."""
    words = c.item_tags.where("category = 'general'").select(F.col("tag").alias("source_tag")).distinct()
    return words.unionByName(words.limit(1).select(F.lit("no such tag").alias("source_tag"))).withColumn("implied_tag", F.lit("red"))


add("rules_manual", lambda c: rules.manual(_rules(c), _pairs_by_hand(c), c.tags), f"WITH {_RULES} SELECT * FROM ru UNION ALL SELECT DISTINCT tag, 'red', 'manual', CAST(1.0 AS DOUBLE), 'active' FROM item_tags WHERE category = 'general' AND tag <> 'red'")
add("rules_approved", lambda c: rules.approved(_rules(c).where("confidence > 0.93"), _suggested(c).select("source_tag", "implied_tag", F.col("pattern_type").alias("inference_type"), "confidence").where("inference_type = 'naming_pattern'"), c.tags), f"WITH {_RULES} SELECT source_tag, implied_tag, inference_type, confidence, CASE WHEN confidence > 0.93 THEN status ELSE 'active' END AS status FROM ru")
add("rules_deleted", lambda c: rules.deleted(_rules(c), _naming(c).where("source_tag like 'b%'").select("source_tag", "implied_tag")), f"WITH {_RULES} SELECT * FROM ru WHERE source_tag NOT LIKE 'b%'")
add("rules_all_deleted", lambda c: rules.deleted(_rules(c)), f"WITH {_RULES} SELECT * FROM ru WHERE status <> 'active'")
add("rules_listed", lambda c: rules.listed(_rules(c), c.tags), f"WITH {_RULES}, {_CAT} SELECT source_tag, a.category AS source_category, implied_tag, b.category AS implied_category, inference_type, confidence FROM ru JOIN ca a ON a.tag = source_tag JOIN ca b ON b.tag = implied_tag WHERE status = 'active'")
add("rules_used", lambda c: rules.used(_rules(c), c.facts), f"WITH {_RULES}, n AS (SELECT tag, count(DISTINCT item_id) AS items FROM item_tags GROUP BY 1) SELECT source_tag, implied_tag, items FROM ru JOIN n ON n.tag = source_tag")
add("rules_new_only", lambda c: rules.without_existing(_suggested(c), _rules(c)), f"WITH {_SUGGESTED} SELECT * FROM sg WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.source_tag = sg.source_tag AND r.implied_tag = sg.implied_tag)")
_ACTIVE = "ac AS (SELECT source_tag, implied_tag FROM ru WHERE status = 'active'), cl AS (SELECT source_tag, implied_tag FROM ac UNION SELECT cl.source_tag, ac.implied_tag FROM cl JOIN ac ON ac.source_tag = cl.implied_tag)"
_CLEAN = "fa AS (SELECT item_id, tag, category, source FROM facts WHERE source <> 'implication'), ad AS (SELECT DISTINCT fa.item_id, cl.implied_tag AS tag FROM fa JOIN cl ON cl.source_tag = fa.tag WHERE NOT EXISTS (SELECT 1 FROM fa x WHERE x.item_id = fa.item_id AND x.tag = cl.implied_tag))"
add("rules_reapplied", lambda c: rules.reapplied(c.facts, _rules(c), c.tags)[0], f"WITH {_RULES}, {_CAT}, {_ACTIVE}, {_CLEAN} SELECT item_id, tag, category, source FROM fa UNION ALL SELECT ad.item_id, ad.tag, coalesce(ca.category, 'general'), 'implication' FROM ad LEFT JOIN ca ON ca.tag = ad.tag", recursive=True)
add("rules_reapplied_counts", lambda c: rules.reapplied(c.facts, _rules(c), c.tags)[1], f"WITH {_RULES}, {_ACTIVE}, {_CLEAN} SELECT (SELECT count(*) FROM facts WHERE source = 'implication') AS cleared, (SELECT count(*) FROM ac) AS rules, count(*) AS tags_added, count(DISTINCT item_id) AS items_updated FROM ad", recursive=True)
add("rules_cleared", lambda c: rules.cleared(c.facts), "SELECT item_id, tag, category, source FROM facts WHERE source <> 'implication'")
add("impl_apply_one", lambda c: rules.applied_one(c.facts, "bolt", "red"), "SELECT DISTINCT item_id, 'red' AS tag, 'general' AS category, 'implication' AS source FROM item_tags WHERE tag = 'bolt' AND item_id NOT IN (SELECT item_id FROM item_tags WHERE tag = 'red')")
add("impl_chain", lambda c: implications.chain(_naming(c), c.tags), f"WITH {_CAT}, cl AS (SELECT source_tag, implied_tag, 1 AS depth FROM rules UNION SELECT cl.source_tag, rules.implied_tag, cl.depth + 1 FROM cl JOIN rules ON rules.source_tag = cl.implied_tag WHERE cl.depth < 10), m AS (SELECT source_tag, implied_tag, CAST(min(depth) AS INTEGER) AS depth FROM cl GROUP BY 1, 2) SELECT source_tag, implied_tag, depth, coalesce(category, 'general') AS category FROM m LEFT JOIN ca ON ca.tag = implied_tag", recursive=True)


def _chain_rules(c: Catalog) -> DataFrame:
    """Items of a pool in order as a chain of rules, far longer than a tree view."""
    after = c.pool_items.select("pool_id", F.col("item_id").alias("b"), (F.col("sort_order") - 1).alias("sort_order"))
    return c.pool_items.join(after, ["pool_id", "sort_order"]).select(F.col("item_id").cast("string").alias("source_tag"), F.col("b").cast("string").alias("implied_tag"))


def _asked_rules(c: Catalog) -> DataFrame:
    """From each pool's last item to its first, and the other way."""
    ends = c.pool_items.groupBy("pool_id").agg(F.min_by("item_id", "sort_order").alias("x"), F.max_by("item_id", "sort_order").alias("y"))
    x, y = F.col("x").cast("string"), F.col("y").cast("string")
    return ends.select(y.alias("source_tag"), x.alias("implied_tag")).unionByName(ends.select(x.alias("source_tag"), y.alias("implied_tag"))).distinct()


add(
    "impl_cycle_check", lambda c: implications.cycle_checks(_chain_rules(c), _asked_rules(c)),
    "WITH e AS (SELECT pool_id, arg_min(item_id, sort_order) AS x, arg_max(item_id, sort_order) AS y FROM pool_items GROUP BY 1) SELECT DISTINCT CAST(y AS VARCHAR) AS source_tag, CAST(x AS VARCHAR) AS implied_tag, TRUE AS cycle FROM e UNION SELECT CAST(x AS VARCHAR), CAST(y AS VARCHAR), x = y FROM e",
)

# --- classifier -------------------------------------------------------------

_TAG_WEIGHTS = _weights("tag", "features")


def _inferred(c: Catalog) -> DataFrame:
    return rating.infer(rating.unrated(c.items, c.item_tags), c.item_tags, *_model(c))


_INFERRED = f"""{_SOFT}, b AS (SELECT item_id, rating, round(p, 9) AS p, row_number() OVER (PARTITION BY item_id ORDER BY round(p, 9) DESC, rating) AS r FROM z),
    un AS (SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM rated)),
    inf AS (SELECT un.item_id, CASE WHEN p >= CASE b.rating WHEN 0 THEN 0.5 WHEN 1 THEN 0.6 WHEN 2 THEN 0.7 ELSE 0.8 END THEN CASE b.rating WHEN 0 THEN 'rating:general' WHEN 1 THEN 'rating:sensitive' WHEN 2 THEN 'rating:questionable' ELSE 'rating:explicit' END END AS rating, coalesce(round(p, 5), 0) AS confidence FROM un LEFT JOIN b ON b.item_id = un.item_id AND b.r = 1)"""
add("rating_infer", _inferred, f"{_INFERRED} SELECT item_id, rating, CAST(confidence AS DOUBLE) AS confidence FROM inf")
add("rating_infer_stats", lambda c: rating.inference_stats(_inferred(c)), f"{_INFERRED} SELECT count(*) AS processed, count(rating) AS rated, count(*) FILTER (WHERE rating IS NULL AND confidence > 0) AS skipped_low, count(*) FILTER (WHERE rating IS NULL AND confidence = 0) AS skipped_unknown, " + ", ".join(f"count(*) FILTER (WHERE rating = 'rating:{x}') AS {x}" for x in ("general", "sensitive", "questionable", "explicit")) + " FROM inf")
add("rating_train", lambda c: rating.train(c.item_tags, rating.Config(pruning_threshold=0.5))[0].withColumn("weight", F.round("weight", 6)), f"WITH {_TAG_WEIGHTS} SELECT tag, CAST(rating AS BIGINT) AS rating, round(weight, 6) AS weight, n FROM w WHERE abs(weight) >= 0.5")
add("top_weighted_pairs", lambda c: rating.top_weighted_pairs(rating.pair_weights(rating.pair_counts(_rated(c)[1]), _rated(c)[0]), 1, 25), f"WITH {_PAIRS}, {_PAIR_ROWS}, {_weights('tag1, tag2', 'pr')} SELECT tag1, tag2, round(weight, 3) AS weight, n FROM w WHERE abs(weight) > 0.01 AND rating = 1 ORDER BY 3 DESC, n DESC, tag1, tag2 LIMIT 25")


def _chosen(c: Catalog) -> DataFrame:
    """New ratings for every 8th item; every 16th loses its own."""
    return c.items.where("item_id % 8 = 0").select("item_id", F.when(F.col("item_id") % 16 != 0, F.lit("rating:explicit")).alias("rating"))


_CHOSEN = "ch AS (SELECT item_id, CASE WHEN item_id % 16 <> 0 THEN 'rating:explicit' END AS rating FROM items WHERE item_id % 8 = 0)"
add("rating_set", lambda c: rating.set_ratings(c.facts, _chosen(c)), f"WITH {_CHOSEN} SELECT item_id, tag, category, source FROM facts WHERE NOT (tag LIKE 'rating:%' AND item_id IN (SELECT item_id FROM ch)) UNION ALL SELECT item_id, unnest([rating, 'rating-source:user']), 'meta', 'user' FROM ch WHERE rating IS NOT NULL")
add("rating_set_log", lambda c: rating.rating_changes(c.facts, _chosen(c)), f"WITH {_CHOSEN} SELECT item_id, rating AS tag, 'add' AS op FROM ch WHERE rating IS NOT NULL UNION ALL SELECT f.item_id, f.tag, 'remove' FROM facts f JOIN ch ON ch.item_id = f.item_id WHERE f.tag LIKE 'rating:%' AND ch.rating IS NOT NULL AND f.tag <> ch.rating")


def _rating_log(c: Catalog) -> DataFrame:
    return c.deltas.withColumn("tag", F.when(F.col("tag") == "click", "rating:general").otherwise(F.col("tag")))


_STATS = "SELECT TRUE AS trained, p AS pending, p >= 50 AS stale, u AS unrated, count(*) AS ratings, count(*) FILTER (WHERE source = 'user') AS by_user, count(*) FILTER (WHERE source = 'original') AS by_source, count(*) FILTER (WHERE source = 'ai_inference') AS by_model FROM facts, (SELECT count(*) AS p FROM deltas WHERE tag = 'click' AND ts > TIMESTAMP '2024-01-05 00:00:00'), (SELECT count(*) AS u FROM items WHERE item_id NOT IN (SELECT item_id FROM rated)) WHERE tag LIKE 'rating:%' GROUP BY p, u"
add("rating_model_stats", lambda c: rating.model_stats(c.items, c.facts, _rating_log(c), "2024-01-05 00:00:00"), _STATS)
add("rating_clear_inferred", lambda c: rating.without_inferred(c.facts), "SELECT item_id, tag, category, source FROM facts WHERE source <> 'ai_inference'")
def _settings(c: Catalog) -> DataFrame:
    """Settings as a table: numbers of rows of other tables, and a name that is none."""
    count = lambda name, key: c.raw(name).agg(F.lit(key).alias("key"), F.count("*").cast("double").alias("value"))
    return count("customer", "min_training_samples").unionByName(count("nation", "stale_after")).unionByName(count("region", "no_such_setting"))


add(
    "rating_config", lambda c: rating.config_from(_settings(c)).updated("min_confidence", 0.25).table(c.items).where("key in ('min_confidence', 'min_training_samples', 'stale_after', 'threshold_explicit', 'no_such_setting')"),
    "SELECT 'min_training_samples' AS key, CAST(count(*) AS DOUBLE) AS value FROM customer UNION ALL SELECT 'stale_after', count(*) FROM nation UNION ALL SELECT 'min_confidence', 0.25 UNION ALL SELECT 'threshold_explicit', 0.8",
)
def _half_inferred(c: Catalog) -> DataFrame:
    """The tag table with every tenth item's rating given by the model, all else by its source."""
    by_model = (F.col("item_id") % 10 == 0) & F.startswith("tag", F.lit("rating:"))
    return c.item_tags.withColumn("source", F.when(by_model, "ai_inference").otherwise("original"))


add(
    "rating_retrained", lambda c: rating.retrain_and_reapply(c.items, _half_inferred(c))[0].where("source = 'ai_inference' and tag like 'rating:%'").select("item_id", "tag"),
    f"""{_SOFT}, best AS (SELECT item_id, rating, round(p, 9) AS p, row_number() OVER (PARTITION BY item_id ORDER BY round(p, 9) DESC, rating) AS r FROM z WHERE item_id NOT IN (SELECT item_id FROM rated)),
    told AS (SELECT item_id, CASE WHEN p >= CASE rating WHEN 0 THEN 0.5 WHEN 1 THEN 0.6 WHEN 2 THEN 0.7 ELSE 0.8 END THEN 'rating:' || ['general', 'sensitive', 'questionable', 'explicit'][rating + 1] END AS tag FROM best WHERE r = 1)
    SELECT item_id, tag FROM told WHERE tag IS NOT NULL""",
)
# the model of that query has not seen the ratings that a model gave
_GIVEN = f"item_tags AS ({TABLES['item_tags']})"
ORACLE["rating_retrained"] = ORACLE["rating_retrained"].replace(_GIVEN, f"all_tags AS ({TABLES['item_tags']}), item_tags AS (SELECT * FROM all_tags WHERE NOT (item_id % 10 = 0 AND tag LIKE 'rating:%'))")

# --- derived tables kept up -------------------------------------------------


def _after_edits(c: Catalog) -> maintenance.Derived:
    """Items of every 9th number lose their makers and get a new tag; every 31st item goes; the derived tables follow."""
    key = ["item_id", "tag", "category"]
    lost = c.item_tags.where("item_id % 9 = 0 and category = 'artist'").select(*key, F.lit("remove").alias("op"))
    new = c.items.where("item_id % 9 = 0").select("item_id", F.lit("Edited_now").alias("tag"), F.lit("meta").alias("category"), F.lit("add").alias("op"))
    after = maintenance.edited(c.item_tags, lost.unionByName(new))
    touched = maintenance.items_of_tags(c.item_tags, after, new.select("tag")).union(lost.select("item_id")).union(c.items.where("item_id % 31 = 0").select("item_id"))
    return maintenance.maintained(maintenance.built(c.items, c.item_tags), c.items.where("item_id % 31 <> 0"), c.item_tags, after, touched)


_EDITED = "nt AS (SELECT item_id, tag, category FROM item_tags WHERE item_id % 31 <> 0 AND NOT (item_id % 9 = 0 AND category = 'artist') UNION ALL SELECT item_id, 'Edited_now', 'meta' FROM items WHERE item_id % 9 = 0 AND item_id % 31 <> 0)"
add("maintained_counts", lambda c: _after_edits(c).counts, f"WITH {_EDITED} SELECT tag, category, count(*) AS n FROM nt GROUP BY 1, 2")
add("maintained_texts", lambda c: _after_edits(c).texts, f"WITH {_EDITED}, tx AS (SELECT item_id, string_agg(DISTINCT tag, ' ' ORDER BY tag) AS tags FROM nt GROUP BY 1) SELECT i.item_id, coalesce(tx.tags, '') AS tags FROM items i LEFT JOIN tx ON tx.item_id = i.item_id WHERE i.item_id % 31 <> 0")
add(
    "maintained_index", lambda c: _after_edits(c).index.where("field = 'tag'").groupBy("word").agg(F.count("item_id").alias("n"), F.sum("item_id").alias("ids")),  # the index holds no row twice
    f"""WITH {_EDITED}, wd AS (SELECT DISTINCT item_id, unnest(list_concat([lower(tag)], regexp_extract_all(lower(tag), '[\\p{{L}}\\p{{N}}]+'))) AS word FROM nt)
    SELECT word, count(DISTINCT item_id) AS n, CAST(sum(item_id) AS BIGINT) AS ids FROM wd GROUP BY 1""",
)

add("maintained_bits", lambda c: coded.items_of(_after_edits(c).bits.where("word like '%o%'")).groupBy("item_id").agg(F.count("*").alias("n")), f"WITH {_EDITED} SELECT item_id, count(DISTINCT lower(tag)) AS n FROM nt WHERE lower(tag) LIKE '%o%' GROUP BY 1")

# --- tags as integers and bits ----------------------------------------------

_CODES = "cd AS (SELECT word, row_number() OVER (ORDER BY word) AS tag_id FROM (SELECT DISTINCT lower(tag) AS word FROM item_tags) w)"
_BITS = "bt AS (SELECT word, run, CAST(CASE WHEN b > 9223372036854775807 THEN b - 18446744073709551616 ELSE b END AS BIGINT) AS bits FROM (SELECT lower(tag) AS word, item_id // 64 AS run, bit_or(CAST(1 AS HUGEINT) << CAST(item_id % 64 AS INTEGER)) AS b FROM item_tags GROUP BY 1, 2) x)"
add("tags_numbered", lambda c: c.tag_dictionary, f"WITH {_CODES} SELECT word, tag_id FROM cd")
add("tags_numbered_later", lambda c: coded.tag_dictionary(c.item_tags, coded.tag_dictionary(c.item_tags.where("category = 'artist'"))), "WITH wd AS (SELECT lower(tag) AS word, bool_or(category = 'artist') AS old FROM item_tags GROUP BY 1) SELECT word, row_number() OVER (ORDER BY NOT old, word) AS tag_id FROM wd")
add("items_coded", lambda c: coded.coded_items(c.item_tags, c.tag_dictionary).select("item_id", F.array_join(F.transform("tag_ids", lambda k: k.cast("string")), " ").alias("tag_ids")), f"WITH {_CODES} SELECT item_id, string_agg(CAST(tag_id AS VARCHAR), ' ' ORDER BY tag_id) AS tag_ids FROM (SELECT DISTINCT item_id, tag_id FROM item_tags JOIN cd ON word = lower(tag)) x GROUP BY 1")
add("items_decoded", lambda c: coded.decoded_items(coded.coded_items(c.item_tags, c.tag_dictionary), c.tag_dictionary), "SELECT DISTINCT item_id, lower(tag) AS word FROM item_tags")
add("tag_bits", lambda c: c.tag_bits, f"WITH {_BITS} SELECT word, run, bits FROM bt")
add("bits_conjunction", lambda c: coded.items_of(coded.combined(c.tag_bits, ["red", "bolt"], ["gear", "rating:general"])), "SELECT DISTINCT item_id FROM item_tags WHERE item_id IN (SELECT item_id FROM item_tags WHERE tag = 'red') AND item_id IN (SELECT item_id FROM item_tags WHERE tag = 'bolt') AND item_id NOT IN (SELECT item_id FROM item_tags WHERE tag IN ('gear', 'rating:general'))")
add("bits_counted", lambda c: coded.counted(coded.combined(c.tag_bits, ["red"], ["gear"])), "SELECT count(DISTINCT item_id) AS n FROM item_tags WHERE tag = 'red' AND item_id NOT IN (SELECT item_id FROM item_tags WHERE tag = 'gear')")
add("search_exclusions", lambda c: search.search(c, "-red -bolt"), "SELECT item_id, filepath FROM items WHERE item_id NOT IN (SELECT item_id FROM item_tags WHERE tag IN ('red', 'bolt')) AND NOT contains(filepath, 'red') AND NOT contains(filepath, 'bolt')")

# --- graph ------------------------------------------------------------------


def _asked_edges(c: Catalog) -> DataFrame:
    """Each item as a parent of its own ancestors' first, of itself, and of an item far away."""
    e = _edges(c)
    back = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return back.unionByName(e.select("a", F.col("a").alias("b"))).unionByName(e.select("a", (F.col("b") + 10**9).alias("b"))).unionByName(e.select("a", "b")).distinct()


_ASK = "ask AS (SELECT b AS a, a AS b FROM relations UNION SELECT a, a FROM relations UNION SELECT a, b + 1000000000 FROM relations UNION SELECT a, b FROM relations)"
add("rel_cycle_check", lambda c: relations.cycle_checks(_edges(c), _asked_edges(c)), f"WITH {_ASK}, d AS (SELECT a, b FROM relations UNION SELECT d.a, r.b FROM d JOIN relations r ON r.a = d.b) SELECT ask.a, ask.b, ask.a = ask.b OR EXISTS (SELECT 1 FROM d WHERE d.a = ask.b AND d.b = ask.a) AS cycle FROM ask", recursive=True)
add("rel_manual_checks", lambda c: relations.manual_checks(_edges(c), c.items, _asked_edges(c)), f"WITH {_ASK} SELECT a, b, CASE WHEN a = b THEN 'self' WHEN b >= 1000000000 THEN 'unknown item' WHEN EXISTS (SELECT 1 FROM relations r WHERE r.a = ask.a AND r.b = ask.b) THEN 'exists' ELSE 'mutual' END AS problem FROM ask")


def _views(c: Catalog) -> DataFrame:
    """From every pool's second item: its first is the parent, its third a sibling, itself nothing."""
    at = lambda k: c.pool_items.where(F.col("sort_order") == k).select("pool_id", F.col("item_id").alias(f"i{k}"))
    rows = at(1).join(at(2), "pool_id").join(at(3), "pool_id")
    each = F.array(F.struct(F.col("i1").alias("other"), F.lit("parent").alias("role")), F.struct(F.col("i3").alias("other"), F.lit("sibling").alias("role")), F.struct(F.col("i2").alias("other"), F.lit("child").alias("role")))
    return rows.select(F.col("i2").alias("item_id"), F.explode(each).alias("v")).select("item_id", "v.other", "v.role")


_VIEWS = "pv AS (SELECT x.item_id AS i1, y.item_id AS i2, z.item_id AS i3 FROM pool_items x JOIN pool_items y ON y.pool_id = x.pool_id AND y.sort_order = 2 JOIN pool_items z ON z.pool_id = x.pool_id AND z.sort_order = 3 WHERE x.sort_order = 1)"
_MADE = "md AS (SELECT i1 AS a, i2 AS b, 'parent_child' AS kind FROM pv UNION SELECT least(i2, i3), greatest(i2, i3), 'sibling' FROM pv)"
add("rel_create_manual", lambda c: relations.create_manual(_edges(c), c.items, _views(c)), f"WITH {_VIEWS}, {_MADE} SELECT a, b, kind, source FROM relations UNION ALL SELECT a, b, kind, 'manual' FROM md WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE r.a = md.a AND r.b = md.b AND r.kind = md.kind)")
add("rel_delete", lambda c: relations.delete_edges(_edges(c), _edges(c).where("a % 2 = 0").select(F.col("b").alias("a"), F.col("a").alias("b")), "parent_child"), "SELECT a, b, kind, source FROM relations WHERE a % 2 <> 0")
add("rel_update_manual", lambda c: relations.update_manual(_edges(c), c.items, _edges(c).where("a % 2 = 0").select("a", "b", "kind"), _edges(c).where("a % 2 = 0").select(F.col("b").alias("item_id"), F.col("a").alias("other"), F.lit("sibling").alias("role"))), "SELECT a, b, kind, source FROM relations WHERE a % 2 <> 0 UNION ALL SELECT DISTINCT least(a, b), greatest(a, b), 'sibling', 'manual' FROM relations WHERE a % 2 = 0")
add("rel_add_counts", lambda c: relations.add_counted(_edges(c).where("a % 3 = 0"), _edges(c)), "SELECT count(*) FILTER (WHERE a % 3 <> 0) AS success, count(*) FILTER (WHERE a % 3 = 0) AS skipped FROM relations")
add("rel_between", lambda c: relations.between(_edges(c), _edges(c).where("a % 3 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"))), "SELECT a, b, kind, source FROM relations WHERE a % 3 = 0")
add(
    "rel_arrivals", lambda c: relations.link_arrivals(_edges(c).where("b % 4 <> 0 and a % 4 <> 0"), c.items, c.items.where("item_id % 4 = 0").select("item_id")),
    """WITH known AS (SELECT a, b FROM relations WHERE b % 4 <> 0 AND a % 4 <> 0), up AS (SELECT a, b FROM relations WHERE b % 4 = 0), down AS (SELECT a, b FROM relations WHERE a % 4 = 0)
    SELECT a, b, 'parent_child' AS kind, 'ingested' AS source FROM up UNION SELECT a, b, 'parent_child', 'ingested' FROM down UNION SELECT least(u.b, k.b), greatest(u.b, k.b), 'sibling', 'ingested' FROM up u JOIN known k ON k.a = u.a AND k.b <> u.b""",
)
add("rel_backfill_inputs", lambda c: relations.backfill_inputs(c.items.where("item_id % 5 <> 0")), "SELECT count(*) FILTER (WHERE parent_id % 5 <> 0) AS resolved, count(*) FILTER (WHERE parent_id % 5 = 0) AS unresolved, CAST(0 AS BIGINT) AS self_links FROM items WHERE parent_id IS NOT NULL AND item_id % 5 <> 0")
add("rel_without_automatic", lambda c: relations.without_automatic(_edges(c).unionByName(_edges(c).where("a % 7 = 0").withColumn("source", F.lit("manual")))), "SELECT a, b, kind, 'manual' AS source FROM relations WHERE a % 7 = 0")


def _actions(c: Catalog) -> DataFrame:
    """A review action on every pair, by the sum of its ids."""
    what = ("delete_a", "delete_b", "non_duplicate", "related", "related")
    how = ("", "", "", "parent_child_ba", "sibling")
    at = ((F.col("a") + F.col("b")) % 5 + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), at)
    return _near_pairs(c).select("a", "b", pick(what).alias("action"), pick(how).alias("detail"))


_PK = "pk AS (SELECT a, b, (a + b) % 5 AS m FROM pairs)"
add("review_commit_relations", lambda c: review.commit(_near_pairs(c), _edges(c).limit(0), _actions(c))[1], f"WITH {_PK} SELECT a, b, 'non_duplicate' AS kind, 'review' AS source FROM pk WHERE m = 2 UNION ALL SELECT b, a, 'parent_child', 'review' FROM pk WHERE m = 3 UNION ALL SELECT a, b, 'sibling', 'review' FROM pk WHERE m = 4")
add("review_commit_deleted", lambda c: review.commit(_near_pairs(c), _edges(c).limit(0), _actions(c))[2], f"WITH {_PK} SELECT a AS item_id FROM pk WHERE m = 0 UNION SELECT b FROM pk WHERE m = 1")
add("review_commit_left", lambda c: review.commit(_near_pairs(c), _edges(c).limit(0), _actions(c).where("(a + b) % 5 < 4"))[0], "SELECT a, b, CAST(distance AS INTEGER) AS distance FROM pairs WHERE (a + b) % 5 = 4")
add(
    "suggestions_replaced", lambda c: review.replaced(_scored_pairs(c), _near_pairs(c).where("a % 2 <> 0"), _scored_pairs(c).where("(a + b) % 3 = 0").withColumn("signal", F.lit(1.0))).select("a", "b", F.round("signal", 4).alias("signal")),
    f"WITH {_REVIEW} SELECT a, b, CASE WHEN (a + b) % 3 = 0 THEN 1.0 ELSE round(signal, 4) END AS signal FROM sp WHERE a % 2 <> 0",
)


def _dated_edges(c: Catalog) -> DataFrame:
    """Each relation once as it was found and once or twice made by hand later."""
    e = _edges(c).withColumn("made_at", F.timestamp_seconds((F.col("a") + F.col("b")) % 1000))
    again = e.where("a % 2 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit("sibling").alias("kind"), F.lit("manual").alias("source"), F.timestamp_seconds((F.col("a") * 7 + F.col("b")) % 1000).alias("made_at"))
    return e.unionByName(again).unionByName(e.where("a % 5 = 0").withColumn("source", F.lit("review")))


add(
    "rel_latest", lambda c: relations.latest_between(_dated_edges(c), _edges(c).select("a", "b")).select("a", "b", "kind", "source", F.unix_seconds("made_at").alias("s")),
    """WITH e AS (SELECT a, b, a AS x, b AS y, kind, source, (a + b) % 1000 AS s FROM relations UNION ALL SELECT b, a, a, b, 'sibling', 'manual', (a * 7 + b) % 1000 FROM relations WHERE a % 2 = 0 UNION ALL SELECT a, b, a, b, kind, 'review', (a + b) % 1000 FROM relations WHERE a % 5 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY s DESC, kind, source, a) AS place FROM e) SELECT a, b, kind, source, s FROM r WHERE place = 1""",
)
add(
    "rule_suggestions_fresh", lambda c: rules.unexpired(_suggested(c).withColumn("made_at", F.timestamp_seconds(F.length("source_tag") * 60)), F.timestamp_seconds(F.lit(1500))).select("source_tag", "implied_tag", "pattern_type"),
    f"WITH {_SUGGESTED} SELECT source_tag, implied_tag, pattern_type FROM sg WHERE length(source_tag) * 60 > 1500 - 300",
)

# --- similarity -------------------------------------------------------------

_UNIT = "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings"
_NEAR = f"un AS ({_UNIT}), cs AS (SELECT a.vec_id AS source_id, b.vec_id AS similar_id, round(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 5) AS score FROM un a JOIN un b ON a.vec_id <> b.vec_id), nr AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY score DESC, similar_id) AS INTEGER) AS rank FROM cs)"


def _cache(c: Catalog, k: int = 10) -> DataFrame:
    """The neighbour cache of all vectors, made once and read by all that needs as many neighbours."""
    return c.kept(f"neighbours-{k}", lambda: Scratch(c.spark, "neighbour-cache").save(similarity.neighbour_cache(c.raw("embeddings"), k), "cache"), ("embeddings",))


add("neighbours_read", lambda c: similarity.cached_neighbours(_cache(c), c.items, 7, 5, exclude=c.items.where("item_id % 3 = 0").select("item_id")), f"WITH {_NEAR}, x AS (SELECT similar_id, filepath, nr.score, row_number() OVER (ORDER BY rank) AS r FROM nr JOIN items ON item_id = similar_id WHERE source_id = 7 AND rank <= 10 AND similar_id % 3 <> 0) SELECT similar_id, filepath, score, CAST(r AS INTEGER) AS rank FROM x WHERE r <= 5")
add("neighbours_replaced", lambda c: similarity.cache_replaced(_cache(c, 3), _cache(c, 3).where("source_id % 4 = 0").select("source_id", "similar_id", (F.col("score") / 2).alias("score")), c.raw("embeddings").where("vec_id % 4 = 0").select(F.col("vec_id").alias("item_id")), 2), f"WITH {_NEAR} SELECT source_id, similar_id, CASE WHEN source_id % 4 = 0 THEN score / 2 ELSE score END AS score, rank FROM nr WHERE rank <= CASE WHEN source_id % 4 = 0 THEN 2 ELSE 3 END")
add("neighbours_of_some", lambda c: similarity.neighbour_cache(c.raw("embeddings"), 4, sources=c.raw("embeddings").where("vec_id < 20").select(F.col("vec_id").alias("item_id"))), f"WITH {_NEAR} SELECT source_id, similar_id, score, rank FROM nr WHERE rank <= 4 AND source_id < 20")


def _vectors_edited(c: Catalog) -> DataFrame:
    return c.raw("embeddings").where("vec_id % 23 <> 0").withColumn("embedding", F.expr("if(vec_id % 17 = 0, reverse(embedding), embedding)"))


add(
    "neighbours_maintained", lambda c: similarity.neighbours_maintained(_cache(c, 6), _vectors_edited(c), c.raw("embeddings").where("vec_id % 17 = 0 or vec_id % 23 = 0").select(F.col("vec_id").alias("item_id")), 6),
    "WITH " + _NEAR.replace("FROM embeddings)", "FROM (SELECT vec_id, CASE WHEN vec_id % 17 = 0 THEN list_reverse(embedding) ELSE embedding END AS embedding FROM embeddings WHERE vec_id % 23 <> 0) e)") + " SELECT source_id, similar_id, score, rank FROM nr WHERE rank <= 6",
)
add("neighbours_cleared", lambda c: similarity.cache_without(_cache(c, 3), c.raw("embeddings").where("vec_id % 4 = 0").select(F.col("vec_id").alias("item_id"))), f"WITH {_NEAR} SELECT source_id, similar_id, score, rank FROM nr WHERE rank <= 3 AND source_id % 4 <> 0 AND similar_id % 4 <> 0")
add("neighbours_stats", lambda c: similarity.cache_stats(_cache(c, 3), c.raw("embeddings")), f"WITH {_NEAR} SELECT count(*) AS rows, count(DISTINCT source_id) AS sources, (SELECT count(*) FROM embeddings) AS items, CAST(100.0 AS DOUBLE) AS coverage, max(score) AS best, min(score) AS worst FROM nr WHERE rank <= 3")
add("vectors_sound", lambda c: similarity.sound_vectors(c.raw("embeddings"), 64).select("vec_id"), "SELECT vec_id FROM embeddings WHERE len(embedding) = 64")
add("vector_coverage", lambda c: similarity.vector_coverage(c.items, c.raw("embeddings")), "SELECT count(*) AS items, count(vec_id) AS embedded, count(*) - count(vec_id) AS missing FROM items LEFT JOIN embeddings ON vec_id = item_id")
add("hash_queue", lambda c: similarity.hash_queue(c.items, c.items.where("item_id % 3 = 0").select("item_id", F.col("md5").alias("phash")), c.items.where("item_id % 7 = 0").select("item_id"), ("mp4",)), "SELECT item_id, filepath FROM items WHERE item_id % 3 <> 0 AND item_id % 7 <> 0 AND filepath NOT LIKE '%.mp4'")
add("hash_again_pairs", lambda c: similarity.hashed_again(c.items.select("item_id", F.col("md5").alias("phash")), c.items.where("item_id % 3 = 0").select("item_id", F.lit("0").alias("phash")), similarity.hamming_pairs(c.signatures, 20))[1], "SELECT a, b, CAST(distance AS INTEGER) AS distance FROM pairs WHERE NOT (a % 3 = 0 AND a IN (SELECT item_id FROM items)) AND NOT (b % 3 = 0 AND b IN (SELECT item_id FROM items))")


def _item_pairs(c: Catalog) -> DataFrame:
    """Items of a pool that follow each other."""
    after = c.pool_items.select("pool_id", F.col("item_id").alias("b"), (F.col("sort_order") - 1).alias("sort_order"))
    return c.pool_items.join(after, ["pool_id", "sort_order"]).select(F.col("item_id").alias("a"), "b")


_PAIR_SCORES = """pp AS (SELECT x.item_id AS a, y.item_id AS b FROM pool_items x JOIN pool_items y ON y.pool_id = x.pool_id AND y.sort_order = x.sort_order + 1),
    tw AS (SELECT i.item_id, i.tag, i.category, k.weight, k.weight2 FROM item_tags i JOIN weighted_tags k ON k.tag = i.tag AND k.category = i.category), ts AS (SELECT item_id, count(*) AS n, sum(weight) AS w, sum(weight2) AS w2 FROM tw GROUP BY 1),
    sh AS (SELECT pp.a, pp.b, count(*) AS n, sum(x.weight) AS w, sum(x.weight2) AS w2 FROM pp JOIN tw x ON x.item_id = pp.a JOIN tw y ON y.item_id = pp.b AND y.tag = x.tag AND y.category = x.category GROUP BY 1, 2),
    al AS (SELECT pp.a, pp.b, coalesce(sh.n, 0) AS n, coalesce(sh.w, 0) AS w, coalesce(sh.w2, 0) AS w2, coalesce(x.n, 0) AS na, coalesce(x.w, 0) AS wa, coalesce(x.w2, 0) AS w2a, coalesce(y.n, 0) AS nb, coalesce(y.w, 0) AS wb, coalesce(y.w2, 0) AS w2b FROM pp LEFT JOIN sh ON sh.a = pp.a AND sh.b = pp.b LEFT JOIN ts x ON x.item_id = pp.a LEFT JOIN ts y ON y.item_id = pp.b),
    ms AS (SELECT a, b, 'jaccard' AS method, n / CAST(nullif(na + nb - n, 0) AS DOUBLE) AS score FROM al UNION ALL SELECT a, b, 'weighted', w / nullif(wa + wb - w, 0) FROM al UNION ALL SELECT a, b, 'weighted_tfidf', w2 / nullif(w2a + w2b - w2, 0) FROM al
      UNION ALL SELECT a, b, 'asymmetric', 0.6 * coalesce(w / nullif(wa, 0), 0) + 0.4 * coalesce(w / nullif(wa + wb - w, 0), 0) FROM al UNION ALL SELECT a, b, 'asymmetric_tfidf', 0.6 * coalesce(w2 / nullif(w2a, 0), 0) + 0.4 * coalesce(w2 / nullif(w2a + w2b - w2, 0), 0) FROM al),
    mt AS (SELECT a, b, method, coalesce(score, 0) AS score FROM ms)"""
add("method_scores", lambda c: similarity.method_scores(c, _item_pairs(c)).withColumn("score", F.round("score", 5)), f"WITH {_PAIR_SCORES} SELECT a, b, method, round(score, 5) AS score FROM mt")
add("method_distribution", lambda c: similarity.method_distribution(similarity.method_scores(c, _item_pairs(c))), f"WITH {_PAIR_SCORES}, bk AS (SELECT method, CAST(least(floor(round(score, 6) * 10), 9) AS INTEGER) AS bucket FROM mt) SELECT method, bucket, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY method), 2) AS percent FROM bk GROUP BY 1, 2")
add("method_spread", lambda c: similarity.method_spread(similarity.method_scores(c, _item_pairs(c))), f"WITH {_PAIR_SCORES} SELECT method, round(min(score), 5) AS least, round(max(score), 5) AS most, round(avg(score), 5) AS mean, round(stddev_samp(score), 5) AS sd FROM mt GROUP BY 1")
_GRID = f"""{_NEAR}, tp AS (SELECT source_id AS a, similar_id AS b, score AS cosine FROM nr WHERE rank <= 10 AND score > 0), tw AS (SELECT i.item_id, i.tag, i.category, k.weight FROM item_tags i JOIN weighted_tags k ON k.tag = i.tag AND k.category = i.category),
    st AS (SELECT * FROM (SELECT unnest(['character', 'character', 'general']) AS category, unnest([0.5, 2.0, 2.0]) AS multiplier) CROSS JOIN (SELECT unnest([0.3, 0.6, 0.9]) AS alpha)),
    sd AS (SELECT item_id, category, sum(weight) AS w FROM tw GROUP BY 1, 2), si AS (SELECT tp.a, tp.b, x.category, sum(x.weight) AS w FROM tp JOIN tw x ON x.item_id = tp.a JOIN tw y ON y.item_id = tp.b AND y.tag = x.tag AND y.category = x.category GROUP BY 1, 2, 3),
    oa AS (SELECT tp.a, tp.b, tp.cosine, st.category, st.multiplier, st.alpha, sum(sd.w * CASE WHEN sd.category = st.category THEN st.multiplier ELSE 1 END) AS own FROM tp CROSS JOIN st JOIN sd ON sd.item_id = tp.a GROUP BY ALL),
    ob AS (SELECT tp.a, tp.b, st.category, st.multiplier, st.alpha, sum(sd.w * CASE WHEN sd.category = st.category THEN st.multiplier ELSE 1 END) AS other FROM tp CROSS JOIN st JOIN sd ON sd.item_id = tp.b GROUP BY ALL),
    oi AS (SELECT si.a, si.b, st.category, st.multiplier, st.alpha, sum(si.w * CASE WHEN si.category = st.category THEN st.multiplier ELSE 1 END) AS inter FROM si CROSS JOIN st GROUP BY ALL),
    sc AS (SELECT oa.category, oa.multiplier, oa.alpha, oa.cosine, oa.alpha * coalesce(inter, 0) / own + (1 - oa.alpha) * coalesce(inter, 0) / (own + other - coalesce(inter, 0)) AS s FROM oa JOIN ob USING (a, b, category, multiplier, alpha) LEFT JOIN oi USING (a, b, category, multiplier, alpha))"""
add("tuning_grid", lambda c: similarity.tuning_grid(c, similarity.tuning_pairs(c.raw("embeddings")), [0.3, 0.6, 0.9], {"character": [0.5, 2.0], "general": [2.0]}), f"WITH {_GRID} SELECT category, CAST(multiplier AS DOUBLE) AS multiplier, CAST(alpha AS DOUBLE) AS alpha, round(corr(cosine, s), 5) AS r, count(*) AS n FROM sc GROUP BY 1, 2, 3")
add("signature_hex", lambda c: c.items.select("item_id", columns.hamming_hex(F.col("md5"), F.md5(F.col("filepath")), 128).alias("bits"), F.round(columns.hybrid_score(F.lit(0.8), (F.col("fav_count") / 100.0), 0.25)[0], 6).alias("score")), "SELECT item_id, CAST(" + " + ".join(f"bit_count(xor(CAST('0x' || substr(md5, {8 * i + 1}, 8) AS BIGINT), CAST('0x' || substr(md5(filepath), {8 * i + 1}, 8) AS BIGINT)))" for i in range(4)) + " AS INTEGER) AS bits, round(0.6 + 0.25 * fav_count / 100.0, 6) AS score FROM items")

# --- writes -----------------------------------------------------------------


def _newcomers(c: Catalog) -> dict[str, DataFrame]:
    """New items: one in three is known by its content, one in five by its path, one in seven may not stand alone."""
    new, i = c.items.where("item_id % 2 = 0"), F.col("item_id")
    made = new.select((i + 10**9).alias("item_id"), F.when(i % 3 == 0, F.col("md5")).otherwise(F.md5((i + 10**9).cast("string"))).alias("md5"), F.when(i % 5 == 0, F.col("filepath")).otherwise(F.concat(F.lit("new/"), i.cast("string"))).alias("filepath"), (i % 7 == 0).alias("stands_alone"))
    return {"items": made, "tags": made.select("item_id", F.lit("fresh").alias("tag"))}


_GOOD = "item_id % 2 = 0 AND item_id % 3 <> 0 AND item_id % 5 <> 0 AND item_id % 7 <> 0"
add("insert_items", lambda c: dml.insert_items({"items": c.items.select("item_id", "md5", "filepath"), "tags": c.item_tags.select("item_id", "tag")}, _newcomers(c))[1], f"SELECT item_id + 1000000000 AS item_id, {_GOOD} AS inserted FROM items WHERE item_id % 2 = 0")
add("insert_items_children", lambda c: dml.insert_items({"items": c.items.select("item_id", "md5", "filepath"), "tags": c.item_tags.where("category = 'meta'").select("item_id", "tag")}, _newcomers(c))[0]["tags"], f"SELECT item_id, tag FROM item_tags WHERE category = 'meta' UNION ALL SELECT item_id + 1000000000, 'fresh' FROM items WHERE {_GOOD}")
add("replace_tags", lambda c: dml.replace_children(c.item_tags.select("item_id", "tag"), c.items.where("item_id % 6 = 0").select("item_id", F.lit("only").alias("tag")), "item_id"), "SELECT item_id, tag FROM item_tags WHERE item_id % 6 <> 0 UNION ALL SELECT item_id, 'only' FROM items WHERE item_id % 6 = 0")
add("pool_add", lambda c: dml.add_to_pool(c.pool_items, c.items.where("item_id % 50 = 1").select(F.lit(1).cast("long").alias("pool_id"), "item_id")), "WITH top AS (SELECT coalesce(max(sort_order), 0) AS t FROM pool_items WHERE pool_id = 1), nw AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS r FROM items WHERE item_id % 50 = 1 AND item_id NOT IN (SELECT item_id FROM pool_items WHERE pool_id = 1)) SELECT pool_id, item_id, sort_order FROM pool_items UNION ALL SELECT 1, item_id, t + r FROM nw CROSS JOIN top")
add("pool_remove", lambda c: dml.remove_pools(c.pools, c.pool_items, c.pools.where("pool_id % 2 = 0").select("pool_id"))[1], "SELECT pool_id, item_id, sort_order FROM pool_items WHERE pool_id % 2 <> 0")
add("delta_clear", lambda c: deltas.clear(c.deltas, "7").select("id"), "SELECT id FROM deltas WHERE md5 <> '7'")
add("surrogate_more", lambda c: dml.surrogate_keys(c.tags.select(F.col("tag").alias("name")), c.tags.where("category = 'artist'").select(F.col("tag").alias("name")).distinct().withColumn("key", F.hash("name").cast("long") * 0 + 5)).where("key > 5"), "SELECT tag AS name, row_number() OVER (ORDER BY tag) + 5 AS key FROM (SELECT DISTINCT tag FROM tags WHERE tag NOT IN (SELECT tag FROM tags WHERE category = 'artist'))")

# --- health, files and arrivals ---------------------------------------------


def _disk(c: Catalog) -> DataFrame:
    """Files as a scan would find them: the items' own but every 4th, under images/, and some that are not known."""
    own = c.items.where("item_id % 4 <> 0").select(F.concat(F.lit("images/"), F.col("filepath")).alias("path"), "md5", F.col("item_id").alias("length"))
    new = c.items.where("item_id % 6 = 0").select(F.concat(F.lit("/Images/drop/"), F.col("item_id").cast("string"), F.lit(".PNG")).alias("path"), F.when(F.col("item_id") % 12 == 0, F.lit("same")).otherwise(F.md5(F.concat(F.lit("x"), F.col("item_id").cast("string")))).alias("md5"), F.col("item_id").alias("length"))
    return own.unionByName(new)


add("files_unprocessed", lambda c: files.unprocessed(_disk(c), c.items), "SELECT CASE WHEN item_id % 12 = 0 THEN 'same' ELSE md5('x' || CAST(item_id AS VARCHAR)) END AS md5, min('drop/' || CAST(item_id AS VARCHAR) || '.PNG') AS filepath FROM items WHERE item_id % 6 = 0 GROUP BY 1")
add("files_missing", lambda c: files.missing_files(c.items, _disk(c)), "SELECT item_id, filepath FROM items WHERE item_id % 4 = 0")
add("files_other_format", lambda c: files.other_format(_disk(c), "png").select("path"), "SELECT 'images/' || filepath AS path FROM items WHERE item_id % 4 <> 0 AND filepath NOT LIKE '%.png'")
add("files_oversized", lambda c: files.oversized(_disk(c), 500), "SELECT 'images/' || filepath AS path, item_id AS length FROM items WHERE item_id % 4 <> 0 AND item_id > 500 UNION ALL SELECT '/Images/drop/' || CAST(item_id AS VARCHAR) || '.PNG', item_id FROM items WHERE item_id % 6 = 0 AND item_id > 500")
add("names_natural", lambda c: c.pools.select("pool_id", columns.natural_key(F.col("name")).alias("key")), "SELECT pool_id, lower(regexp_extract(name, '^([^0-9]*)([0-9]*)$', 1)) || lpad(regexp_extract(name, '^([^0-9]*)([0-9]*)$', 2), 12, '0') AS key FROM pools")
add("names_paths", lambda c: c.items.select("item_id", columns.plain_path(F.concat(F.lit("/IMAGES/"), F.col("filepath"))).alias("plain"), columns.preview_path(F.concat(F.lit("images/"), F.col("filepath"))).alias("preview")), "SELECT item_id, filepath AS plain, 'thumbnails/' || substr(md5(split_part(filepath, '/', 2)), 1, 3) || '/' || split_part(split_part(filepath, '/', 2), '.', 1) || '.webp' AS preview FROM items")
add("names_ids", lambda c: c.items.select("item_id", columns.id_in_name(F.concat((F.col("item_id") + 1_000_000).cast("string"), F.when(F.col("item_id") % 3 == 0, "_p0.png").when(F.col("item_id") % 3 == 1, ".png").otherwise("x.png"))).alias("post")), "SELECT item_id, CASE WHEN item_id % 3 < 2 THEN item_id + 1000000 END AS post FROM items")
add("names_short", lambda c: c.raw("documents").select("doc_id", F.octet_length(columns.short_name(F.concat(F.regexp_replace(F.substring("text", 1, 300), r"[/.\s]", ""), F.lit(".png")), 200)).alias("bytes")).where("bytes <= 200").select("doc_id"), "SELECT doc_id FROM documents WHERE text IS NOT NULL")
add("dictionary_labels", lambda c: files.with_aliases(c.pools.select(F.col("name").alias("tag"), F.array(F.concat(F.lit("alias of "), F.col("name"))).alias("aliases"), F.col("description").alias("category")), c.pools.where("pool_id % 2 = 0").select(F.col("name").alias("tag"))), "SELECT name AS tag, description AS category FROM pools WHERE pool_id % 2 <> 0 UNION ALL SELECT 'alias of ' || name, description FROM pools")
add("dictionary_new", lambda c: files.new_tags(stats.tag_counts(c.item_tags).withColumnRenamed("n", "count"), c.tags.where("category = 'general'").select("tag"), 15).select("tag", "count"), 'SELECT tag, count(DISTINCT item_id) AS "count" FROM item_tags WHERE tag NOT IN (SELECT tag FROM tags WHERE category = \'general\') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15')
add("model_info", lambda c: files.model_info(*_model(c)), f"WITH {_TAG_WEIGHTS}, {_PAIRS}, {_PAIR_ROWS} SELECT (SELECT count(*) FROM w WHERE abs(weight) > 0.01) AS tags, (SELECT count(*) FROM (WITH {_weights('tag1, tag2', 'pr')} SELECT * FROM w WHERE abs(weight) > 0.01)) AS pairs")
add("artefacts_missing", lambda c: health.without_artefact(c.items, c.items.where("item_id % 3 <> 0").select(F.concat(F.lit("thumbs/"), F.regexp_replace("filepath", r"\.[^./]+$", ""), F.lit(".webp")).alias("path")), "thumbs/", ".webp"), "SELECT item_id, 'thumbs/' || split_part(filepath, '.', 1) || '.webp' AS expected FROM items WHERE item_id % 3 = 0")
add("cleanup_delete", lambda c: health.cleanup({"items": c.items, "tags": c.item_tags}, c.items.where("item_id % 9 = 0").select("item_id"), "delete")[0]["tags"].select("item_id", "tag"), "SELECT item_id, tag FROM item_tags WHERE item_id % 9 <> 0")
add("cleanup_retry", lambda c: health.cleanup({"items": c.items, "embeddings": c.raw("embeddings").withColumnRenamed("vec_id", "item_id")}, c.items.where("item_id % 9 = 0").select("item_id"), "retry")[1], "SELECT item_id, filepath FROM items WHERE item_id % 9 = 0")
add("payloads_flat", lambda c: arrivals.flatten_payload(c.raw("events").select(F.col("event_id").alias("item_id"), F.lit("x").alias("source"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"file": {"url": "u'), F.col("event_id").cast("string"), F.lit('", "width": 3, "size": 9}}'))).otherwise(F.concat(F.lit('{"file_url": "v'), F.col("event_id").cast("string"), F.lit('", "image_height": 7}'))).alias("data"))), "SELECT event_id AS item_id, 'x' AS source, CASE WHEN event_id % 2 = 0 THEN 'u' ELSE 'v' END || CAST(event_id AS VARCHAR) AS url, CASE WHEN event_id % 2 = 0 THEN CAST(3 AS BIGINT) END AS width, CASE WHEN event_id % 2 = 1 THEN CAST(7 AS BIGINT) END AS height, CASE WHEN event_id % 2 = 0 THEN CAST(9 AS BIGINT) END AS size FROM events")
add("labels_corrected", lambda c: arrivals.corrected_labels(c.raw("events").select(F.col("event_id").cast("string").alias("tag"), F.concat(F.lit(" "), F.col("event_type")).alias("label")), {"click": "view"}, ["view", "purchase"]), "SELECT CAST(event_id AS VARCHAR) AS tag, CASE event_type WHEN 'click' THEN 'view' ELSE event_type END AS label FROM events WHERE event_type IN ('click', 'view', 'purchase')")


def _arrived(c: Catalog) -> DataFrame:
    return c.raw("events").select(F.concat(F.lit("in/"), F.col("event_id").cast("string")).alias("path"), F.when(F.col("event_id") % 17 != 0, F.md5(F.col("user_id").cast("string"))).alias("md5"))


_KNOWN = "user_id % 4 = 0"
add(
    "arrival_outcomes", lambda c: ingest.outcomes(_arrived(c), c.raw("events").where(_KNOWN).select(F.md5(F.col("user_id").cast("string")).alias("md5"))).groupBy("outcome").agg(F.count("*").alias("n")),
    f"WITH x AS (SELECT event_id, user_id, CASE WHEN event_id % 17 = 0 THEN 'error' WHEN {_KNOWN} THEN 'duplicate' END AS o FROM events), y AS (SELECT event_id, coalesce(o, CASE WHEN row_number() OVER (PARTITION BY user_id, o ORDER BY 'in/' || CAST(event_id AS VARCHAR)) = 1 THEN 'success' ELSE 'race_condition' END) AS o FROM x) SELECT o AS outcome, count(*) AS n FROM y GROUP BY 1",
)
add("arrival_new_content", lambda c: ingest.new_content(_arrived(c).where("md5 is not null"), c.raw("events").where(_KNOWN).select(F.md5(F.col("user_id").cast("string")).alias("md5"))).select("md5"), f"SELECT DISTINCT md5(CAST(user_id AS VARCHAR)) AS md5 FROM events WHERE event_id % 17 <> 0 AND NOT ({_KNOWN})")
def _by(c: Catalog, path: str) -> DataFrame:
    """Events under few paths, so that some come within two seconds of each other."""
    return _events(c).select(F.expr(path).alias("path"), F.col("ts").cast("timestamp").alias("ts"))


add(
    "stream_debounced", lambda c: ingest.drain(ingest.settled(_by(c, "cast(user_id % 2 as string)"), "path")).select("path", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "n"),
    f"""WITH e AS (SELECT CAST(user_id % 2 AS VARCHAR) AS path, epoch_us(ts) AS t, epoch_us(max(ts) OVER ()) AS top FROM events), l AS (SELECT *, lag(t) OVER (PARTITION BY path ORDER BY t) AS prev FROM e),
    r AS (SELECT *, sum(CASE WHEN prev IS NULL OR t - prev > 2000000 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY t RANGE UNBOUNDED PRECEDING) AS run FROM l)
    SELECT path, min(t) AS first_us, max(t) AS last_us, count(*) AS n FROM r GROUP BY path, run HAVING max(t) + 2000000 <= max(top) - 60000000""",
)
add(
    "stream_throttled", lambda c: ingest.drain(ingest.throttled(_by(c, "event_type"), "path")).select("path", F.unix_micros("ts").alias("t")),
    f"""WITH e AS (SELECT DISTINCT event_type AS path, epoch_us(ts) AS t FROM events),
    p AS (SELECT path, min(t) AS t FROM e GROUP BY path UNION ALL SELECT path, t FROM (SELECT p.path, min(e.t) AS t FROM p JOIN e ON e.path = p.path AND e.t >= p.t + 2000000 GROUP BY p.path, p.t) q) SELECT path, t FROM p""", recursive=True,
)


def _committed(c: Catalog) -> commits.Ledger:
    """The arrivals of all events in two batches, each offered twice."""
    ledger, rows = commits.Ledger(c.spark, Scratch(c.spark, "arrivals").root), _arrived(c)
    early = rows.where(F.substring_index("path", "/", -1).cast("long") % 3 > 0)
    for batch, number in ((early, 0), (early, 0), (rows.join(early, "path", "left_anti"), 1), (early, 1)):
        ledger.arrive(batch, number)
    return ledger


_LEDGER = """x AS (SELECT 'in/' || CAST(event_id AS VARCHAR) AS path, CASE WHEN event_id % 17 <> 0 THEN md5(CAST(user_id AS VARCHAR)) END AS md5, CASE WHEN event_id % 3 > 0 THEN 0 ELSE 1 END AS batch FROM events),
    f AS (SELECT *, min(batch) OVER (PARTITION BY md5) AS first_batch, min(path) OVER (PARTITION BY md5, batch) AS first_path FROM x),
    o AS (SELECT path, md5, CASE WHEN md5 IS NULL THEN 'error' WHEN first_batch < batch THEN 'duplicate' WHEN path <> first_path THEN 'race_condition' ELSE 'success' END AS outcome FROM f)"""
add("ledger_outcomes", lambda c: _committed(c).outcomes(), f"WITH {_LEDGER} SELECT path, md5, outcome FROM o")
add("ledger_items", lambda c: _committed(c).items(), f"WITH {_LEDGER} SELECT md5, path FROM o WHERE outcome = 'success'")


def _listings(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """A folder of orders before and after: some moved, some rewritten, some new, some gone."""
    files = c.items.select("item_id", F.col("filepath").alias("path"), "md5")
    before = files.where("item_id % 5 <> 0").select("path", "md5")
    path = F.when(F.col("item_id") % 7 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    return before, files.where("item_id % 11 <> 0").select(path.alias("path"), F.when(F.col("item_id") % 13 == 0, F.md5("md5")).otherwise(F.col("md5")).alias("md5"))


add(
    "files_changed", lambda c: commits.folder_changes(*_listings(c)),
    """WITH k AS (SELECT filepath AS was, CASE WHEN item_id % 7 = 0 THEN 'moved/' || filepath ELSE filepath END AS path, item_id % 5 <> 0 AS there, item_id % 11 <> 0 AS now, item_id % 7 = 0 AS moves, item_id % 13 = 0 AS other FROM items)
    SELECT 'created' AS kind, path, CAST(NULL AS VARCHAR) AS was FROM k WHERE now AND (NOT there OR moves AND other) UNION ALL SELECT 'removed', NULL, was FROM k WHERE there AND (NOT now OR moves AND other)
    UNION ALL SELECT 'moved', path, was FROM k WHERE now AND there AND moves AND NOT other UNION ALL SELECT 'changed', path, was FROM k WHERE now AND there AND NOT moves AND other""",
)
add("search_terms_repeated", lambda c: search.search(c, "red RED red order:none"), f"SELECT item_id, filepath FROM items WHERE {_tag('red')}")

# --- maintenance and pictures -----------------------------------------------

add(
    "maintenance", jobs.run_maintenance,
    """SELECT 'recount' AS job, count(DISTINCT tag) AS n FROM item_tags UNION ALL SELECT 'recategorise', CAST(0 AS BIGINT)
    UNION ALL SELECT 'duplicates', count(*) FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS keeper FROM documents) WHERE doc_id <> keeper
    UNION ALL SELECT 'orphans', CAST(0 AS BIGINT) UNION ALL SELECT 'without_tags', count(*) FROM items WHERE item_id NOT IN (SELECT item_id FROM item_tags) UNION ALL SELECT 'pivot', count(DISTINCT item_id) FROM item_tags""",
)


def _pictures(c: Catalog) -> DataFrame:
    """Vectors as grey pictures of 8 x 8, values from 0 to 1."""
    grey = F.transform("embedding", lambda x: F.least(F.greatest(x.cast("double") + 0.5, F.lit(0.0)), F.lit(1.0)))
    return c.raw("embeddings").select("vec_id", grey.alias("grey"))


def _compared(c: Catalog) -> DataFrame:
    """Each picture against the next one."""
    a, b = _pictures(c), _pictures(c).select((F.col("vec_id") - 1).alias("vec_id"), F.col("grey").alias("other"))
    return a.join(b, "vec_id").select("vec_id", pixels.differences_of("grey", "other").alias("m")).select("vec_id", "m.*")


_GREY = "g AS (SELECT vec_id, list_transform(embedding, lambda x: least(greatest(CAST(x AS DOUBLE) + 0.5, 0.0), 1.0)) AS v FROM embeddings)"
add("pixel_mean_difference", lambda c: _compared(c).select("vec_id", F.round("mean_abs_diff", 6).alias("mean_abs_diff"), F.round("mask_mismatch", 6).alias("mask_mismatch")), f"WITH {_GREY} SELECT a.vec_id, round(list_avg(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i]))), 6) AS mean_abs_diff, CAST(0.0 AS DOUBLE) AS mask_mismatch FROM g a JOIN g b ON b.vec_id = a.vec_id + 1")
add("pixel_metrics", lambda c: _compared(c).select("vec_id", "changed_ratio", "largest_blob_ratio", "blob_count", "peak_blob_contrast", "visual_signal"), None)
add("pixel_hashes", lambda c: _pictures(c).select("vec_id", pixels.phash_of("grey").alias("phash")), None)
add(
    "embeddings_made",
    lambda c: similarity.embedded(c.raw("pages").select(F.col("page_id").alias("item_id"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("content")), byte_shares)
    # the order of the sixteen shares, equal ones by place, tells the counts behind them apart
    .select("item_id", F.array_join(F.transform(F.array_sort(F.transform("embedding", lambda x, k: F.struct((-x).alias("x"), k.alias("k")))), lambda s: s["k"].cast("string")), ",").alias("ranking")),
    """WITH hx AS (SELECT page_id, hex(encode(coalesce(html, ''))) AS h FROM pages),
    up AS (SELECT page_id, regexp_replace(h, '(.).', '\\1', 'g') AS u FROM hx), ct AS (SELECT page_id, list_transform(range(0, 16), lambda k: len(u) - len(replace(u, '0123456789ABCDEF'[k + 1], ''))) AS n FROM up)
    SELECT page_id AS item_id, array_to_string(list_transform(list_sort(list_transform(range(0, 16), lambda k: {'x': -n[k + 1], 'k': k})), lambda s: CAST(s.k AS VARCHAR)), ',') AS ranking FROM ct""",
)


# --- round trips through files ----------------------------------------------


def _path(c: Catalog, name: str) -> str:
    return f"{Scratch(c.spark, name).root}/{name}"


def _model_again(c: Catalog) -> DataFrame:
    path = _path(c, "model")
    files.save_model(*_model(c), path)
    return files.load_model(c.spark, path)[0].withColumn("weight", F.round("weight", 6))


def _appended(c: Catalog) -> DataFrame:
    """Nations written as JSON lines twice."""
    path, rows = _path(c, "lines"), c.raw("nation").select("n_nationkey", "n_name")
    files.write_json(rows, path)
    files.write_json(rows.where("n_nationkey % 2 = 0"), path, append=True)
    return c.spark.read.schema("n_nationkey long, n_name string").json(path).groupBy("n_nationkey").agg(F.count("*").alias("n"))


def _indexed(c: Catalog) -> DataFrame:
    """Each region's JSON file by its hash."""
    path = _path(c, "json")
    text = F.concat(F.lit('{"md5": "'), F.md5("r_name"), F.lit('", "name": "'), F.col("r_name"), F.lit('"}'))
    c.raw("region").select(text.alias("value"), "r_name").write.partitionBy("r_name").text(path)  # a file for each
    found = files.metadata_index(c.spark, path).select("md5")
    return found.join(c.raw("region").select(F.md5("r_name").alias("md5"), F.col("r_name").alias("name")), "md5")


def _compacted(c: Catalog) -> DataFrame:
    path = _path(c, "compact")
    files.compact(c.pool_items, path, 3, "item_id")
    return c.spark.read.parquet(path)


def _batched(c: Catalog) -> DataFrame:
    """The event stream written batch by batch."""
    path = _path(c, "batches")
    ingest.write_batches(_events(c).select("event_id", "event_type"), lambda df, n: df.write.mode("overwrite").parquet(f"{path}/rows/batch={n}"), f"{path}/checkpoint")
    return c.spark.read.parquet(f"{path}/rows").select("event_id", "event_type")


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
add("files_scanned", lambda c: files.scan_files(c.spark, c.sf_dir, [".parquet"]).select(F.regexp_extract("path", r"([a-z_]+)\.parquet", 1).alias("name")).distinct(), f"SELECT unnest({_TABLES}) AS name")
add("model_round_trip", _model_again, f"WITH {_TAG_WEIGHTS} SELECT tag, CAST(rating AS BIGINT) AS rating, round(weight, 6) AS weight, n FROM w WHERE abs(weight) > 0.01")
add("json_lines", _appended, "SELECT n_nationkey, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n FROM nation")
add("json_index", _indexed, "SELECT md5(r_name) AS md5, r_name AS name FROM region")
add("compacted_table", _compacted, "SELECT pool_id, item_id, sort_order FROM pool_items")
add("stream_batches", _batched, "SELECT event_id, event_type FROM events")

# --- more of reviews, tags and neighbours -----------------------------------


def _judged(c: Catalog) -> DataFrame:
    return _scored_pairs(c).withColumn("is_duplicate", (F.col("a") + F.col("b")) % 5 < 2)


add("calibration_precision", lambda c: review.precision_at(_judged(c), [F.col("signal"), F.col("distance"), F.col("a"), F.col("b")], (10, 50, 250)), f"WITH {_REVIEW}, o AS (SELECT (a + b) % 5 < 2 AS d, row_number() OVER (ORDER BY signal, distance, a, b) AS place FROM sp), k AS (SELECT CAST(unnest([10, 50, 250]) AS INTEGER) AS k) SELECT k, count(*) AS n, count(*) FILTER (WHERE d) AS right, round(count(*) FILTER (WHERE d) / CAST(count(*) AS DOUBLE), 4) AS precision FROM k JOIN o ON place <= k GROUP BY 1")
add("calibration_quantiles", lambda c: arrivals.quantiles(_judged(c).select(F.col("is_duplicate").cast("string").alias("g"), "distance"), "g", "distance").select("g", "n", "p25", "p50", "p75"), f"""WITH {_REVIEW}, o AS (SELECT CAST((a + b) % 5 < 2 AS VARCHAR) AS g, CAST(distance AS INTEGER) AS d, row_number() OVER (PARTITION BY (a + b) % 5 < 2 ORDER BY distance) - 1 AS k, count(*) OVER (PARTITION BY (a + b) % 5 < 2) AS n FROM sp)
    SELECT g, CAST(max(n) AS BIGINT) AS n, max(CASE WHEN k = round_even((n - 1) * 0.25, 0) THEN d END) AS p25, max(CASE WHEN k = round_even((n - 1) * 0.5, 0) THEN d END) AS p50, max(CASE WHEN k = round_even((n - 1) * 0.75, 0) THEN d END) AS p75 FROM o GROUP BY 1""")


def _asked_tags(c: Catalog) -> DataFrame:
    names = c.pools.select((F.col("pool_id") * 2).alias("place"), F.col("name").alias("tag"))
    own = c.item_tags.where("category = 'general'").select("tag").distinct()
    return names.unionByName(own.select((F.length("tag") * 2 + 1).cast("long").alias("place"), "tag"))


add("tags_in_order", lambda c: merge.tags_in_order(_asked_tags(c), c.tags, stats.tag_counts(c.item_tags)), "WITH n AS (SELECT tag, count(DISTINCT item_id) AS n FROM item_tags GROUP BY 1), e AS (SELECT tag, min(extended_category) AS extended_category FROM tags GROUP BY 1), x AS (SELECT pool_id * 2 AS place, name AS tag FROM pools UNION ALL SELECT DISTINCT length(tag) * 2 + 1, tag FROM item_tags WHERE category = 'general') SELECT place, x.tag, e.extended_category, coalesce(n.n, 0) AS n FROM x LEFT JOIN e ON e.tag = x.tag LEFT JOIN n ON n.tag = x.tag")
add("tags_categorised", lambda c: merge.set_categories(c.tags, c.tags.where("category = 'artist'").select("tag", F.lit("21_Status").alias("extended_category"))), "SELECT tag, category, CASE WHEN tag IN (SELECT tag FROM tags WHERE category = 'artist') THEN '21_Status' ELSE extended_category END AS extended_category FROM tags")
add(
    "neighbours_without_family", lambda c: similarity.nearest(c.raw("embeddings"), 30, 10, exclude=relations.family(c.items, _edges(c), 30)),
    f"WITH {_NEAR}, m AS (SELECT post_id, parent_id FROM items WHERE item_id = 30), fm AS (SELECT b AS item_id FROM relations WHERE a = 30 UNION SELECT a FROM relations WHERE b = 30 UNION SELECT i.item_id FROM items i JOIN m ON i.parent_id = m.post_id OR i.post_id = m.parent_id OR i.parent_id = m.parent_id), k AS (SELECT similar_id AS item_id, score FROM nr WHERE source_id = 30 AND similar_id NOT IN (SELECT item_id FROM fm) ORDER BY score DESC, similar_id LIMIT 10) SELECT item_id, score, CAST(row_number() OVER (ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM k",
)
