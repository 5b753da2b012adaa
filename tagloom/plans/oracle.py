"""The domain tables of ``sources.proxies`` as SQL, for oracle queries."""

from __future__ import annotations

import re

_RATING = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'rating:general' WHEN '2' THEN 'rating:sensitive' WHEN '3' THEN 'rating:questionable' WHEN '4' THEN 'rating:explicit' END"
_W0 = " + ".join(f"(CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i} ELSE 0 END)" for i in range(32))
_W1 = " + ".join(f"(CASE WHEN embedding[{i + 33}] > 0 THEN {1 << i} ELSE 0 END)" for i in range(32))

TABLES = {
    "items": """SELECT o_orderkey AS item_id,
        'c' || CAST(o_custkey AS VARCHAR) || '/ord_' || CAST(o_orderkey AS VARCHAR) || CASE o_orderstatus WHEN 'F' THEN '.png' WHEN 'O' THEN '.jpg' ELSE '.mp4' END AS filepath,
        md5(CAST(o_orderkey AS VARCHAR)) AS md5, o_orderkey AS post_id,
        CASE WHEN o_orderkey % 3 = 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS parent_id,
        CASE WHEN o_orderkey % 10 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS score, o_orderkey % 97 AS fav_count, o_orderdate AS ingested_at,
        100 + (o_orderkey * 37) % 4000 AS image_width, 100 + (o_orderkey * 53) % 3000 AS image_height,
        CASE WHEN o_orderkey % 4 = 0 THEN 2 * (100 + (o_orderkey * 37) % 4000) END AS upscaled_width, CASE WHEN o_orderkey % 4 = 0 THEN 2 * (100 + (o_orderkey * 53) % 3000) END AS upscaled_height,
        CASE WHEN o_orderkey % 11 <> 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END END AS active_source
        FROM orders""",
    "part_words": """SELECT DISTINCT l_orderkey AS item_id, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, lower(p_type) AS kind, replace(lower(p_brand), '#', '_') AS brand
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "item_tags": f"""SELECT item_id, w1 AS tag, 'general' AS category FROM part_words UNION SELECT item_id, w2, 'general' FROM part_words
        UNION SELECT item_id, kind, 'copyright' FROM part_words UNION SELECT item_id, brand, 'artist' FROM part_words
        UNION SELECT item_id, w2 || '_(' || kind || ')', 'character' FROM part_words UNION SELECT item_id, w2 || '_(' || w1 || ')_(' || kind || ')', 'character' FROM part_words
        UNION SELECT o_orderkey, {_RATING}, 'meta' FROM orders WHERE substr(o_orderpriority, 1, 1) < '5'""",
    "tags": """SELECT DISTINCT tag, category, CASE WHEN category IN ('general', 'copyright') THEN
        CASE length(tag) % 4 WHEN 0 THEN '00_Subject_Count' WHEN 1 THEN '01_Body_Physique' WHEN 2 THEN '02_Body_Hair' ELSE '03_Body_Face' END END AS extended_category FROM item_tags""",
    "item_sources": "SELECT DISTINCT l_orderkey AS item_id, l_returnflag AS source FROM lineitem",
    "pools": "SELECT c_custkey AS pool_id, c_name AS name, c_mktsegment AS description FROM customer",
    "pool_items": "SELECT o_custkey AS pool_id, o_orderkey AS item_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS sort_order FROM orders",
    "favourites": "SELECT o_orderkey AS item_id, o_orderdate AS created_at FROM orders WHERE o_orderkey % 7 = 0",
    "predictions": "SELECT l_orderkey AS item_id, split_part(p_name, ' ', 2) AS tag, 'general' AS category, max(l_discount * 10) AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "facts": """SELECT *, CASE (item_id + length(tag)) % 10 WHEN 0 THEN 'implication' WHEN 1 THEN 'ai_inference' WHEN 2 THEN 'user' ELSE 'original' END AS source FROM item_tags""",
    "meta_rows": """SELECT event_id AS item_id, user_id, event_type, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, event_id % 3 > 0 AS has_alpha, event_id % 2 = 0 AS has_beta, event_id % 5 = 0 AS has_gamma FROM events""",
    "source_tags": """SELECT item_id, 'alpha' AS source, 'character' AS category, 'hero' || CAST(k % 7 AS VARCHAR) AS tag FROM meta_rows WHERE has_alpha
        UNION SELECT item_id, 'alpha', 'general', event_type FROM meta_rows WHERE has_alpha UNION SELECT item_id, 'alpha', 'general', 'shared' || CAST(k % 5 AS VARCHAR) FROM meta_rows WHERE has_alpha
        UNION SELECT item_id, 'beta', 'general', event_type FROM meta_rows WHERE has_beta UNION SELECT item_id, 'beta', 'general', 'extra' FROM meta_rows WHERE has_beta
        UNION SELECT item_id, 'beta', 'species', 'shared' || CAST(k % 5 AS VARCHAR) FROM meta_rows WHERE has_beta UNION SELECT item_id, 'beta', 'artist', 'u' || CAST(user_id AS VARCHAR) FROM meta_rows WHERE has_beta
        UNION SELECT item_id, 'gamma', 'general', 'plain' FROM meta_rows WHERE has_gamma UNION SELECT item_id, 'gamma', 'general', 'shared' || CAST(k % 5 AS VARCHAR) FROM meta_rows WHERE has_gamma""",
    "source_ratings": """SELECT item_id, 'alpha' AS source, CASE k % 4 WHEN 0 THEN 'rating:general' WHEN 1 THEN 'rating:sensitive' WHEN 2 THEN 'rating:questionable' ELSE 'rating:explicit' END AS rating FROM meta_rows WHERE has_alpha
        UNION ALL SELECT item_id, 'beta', 'rating:sensitive' FROM meta_rows WHERE has_beta""",
    "deltas": "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS md5, event_type AS tag, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'add' ELSE 'remove' END AS op, ts FROM events",
    "signatures": f"SELECT vec_id AS item_id, CAST({_W0} AS BIGINT) AS w0, CAST({_W1} AS BIGINT) AS w1 FROM embeddings",
    "relations": "SELECT parent_id AS a, item_id AS b, 'parent_child' AS kind, 'backfill' AS source FROM items WHERE parent_id IS NOT NULL AND parent_id <> item_id",
    "rated": """SELECT item_id, min(CASE tag WHEN 'rating:general' THEN 0 WHEN 'rating:sensitive' THEN 1 WHEN 'rating:questionable' THEN 2 ELSE 3 END) AS rating
        FROM item_tags WHERE tag LIKE 'rating:%' GROUP BY 1""",
    "weighted_tags": """SELECT tag, category, n, w / ln(n + 1) AS weight, w * (ln(total / (n + 1)) + 1) AS weight2 FROM (
        SELECT t.tag, t.category, t.n, CASE t.category WHEN 'character' THEN 6.0 WHEN 'copyright' THEN 3.0 WHEN 'artist' THEN 2.0 WHEN 'species' THEN 2.5 WHEN 'general' THEN 3.0 WHEN 'meta' THEN 0.5 ELSE 1.0 END AS w,
        (SELECT CAST(count(*) AS DOUBLE) FROM items) AS total FROM (SELECT tag, category, CAST(count(*) AS DOUBLE) AS n FROM item_tags GROUP BY 1, 2) t)""",
    "features": "SELECT r.item_id, r.rating, t.tag FROM rated r JOIN item_tags t ON t.item_id = r.item_id WHERE t.tag NOT LIKE 'rating%'",
    "rules": """SELECT tag AS source_tag, regexp_extract(tag, '\\(([^)]+)\\)$', 1) AS implied_tag FROM tags WHERE category = 'character'
        AND regexp_extract(tag, '\\(([^)]+)\\)$', 1) IN (SELECT tag FROM tags WHERE category = 'copyright')
        UNION SELECT tag, regexp_extract(tag, '^(.+?)_\\([^)]+\\)_\\((.+?)\\)$', 1) || '_(' || regexp_extract(tag, '^(.+?)_\\([^)]+\\)_\\((.+?)\\)$', 2) || ')' FROM tags
        WHERE category = 'character' AND regexp_extract(tag, '^(.+?)_\\([^)]+\\)_\\((.+?)\\)$', 1) <> ''""",
    "pairs": """SELECT a.item_id AS a, b.item_id AS b, bit_count(xor(a.w0, b.w0)) + bit_count(xor(a.w1, b.w1)) AS distance
        FROM signatures a JOIN signatures b ON a.item_id < b.item_id WHERE bit_count(xor(a.w0, b.w0)) + bit_count(xor(a.w1, b.w1)) <= 20""",
}


def sql(body: str, recursive: bool = False) -> str:
    """The body with the domain tables that it names put before it."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name, definition in TABLES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                add(definition)
                if name not in needed:
                    needed.append(name)

    add(body)
    head = ", ".join(f"{name} AS ({TABLES[name]})" for name in needed)
    lead = body.lstrip()
    if lead[:5].upper() == "WITH ":
        return f"WITH {'RECURSIVE ' if recursive else ''}{head + ', ' if head else ''}{lead[5:]}"
    return f"WITH {head} {lead}" if head else lead
