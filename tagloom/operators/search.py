"""Search over tagged items: one declarative plan per query.

Every filter is applied, results hold each item once, and every order ends with
item_id.  Conditions on whole tags are one intersection of bits, words of 64
items sorted by tag, where the tags are pushed into the scan, so no tag list is
built for items that do not match.  A part of a word is found by the postings of its runs of three
characters and then compared.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.constants import AUTOCOMPLETE_ORDER, BASE_CATEGORIES, RATINGS, VIDEO_EXTENSIONS
from tagloom.functions.lineage import hashed
from tagloom.operators.coded import with_words
from tagloom.operators.dsl import FLAGS, SearchSpec, parse
from tagloom.sources.proxies import Catalog

MISSING = -999_999
ORDER_KEYS = ("score", "score_desc", "score_asc", "fav", "fav_desc", "fav_asc", "new", "ingested", "newest", "recent", "old", "oldest")


def with_all(items: DataFrame, bridge: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Items that hold all values: relational division by a counted semi-join (OP-047, OP-055)."""
    if not values:
        return items
    hit = bridge.where(F.lower(column).isin(*values)).groupBy("item_id").agg(F.countDistinct(F.lower(column)).alias("n")).where(F.col("n") == len(set(values)))
    return items.join(hit, "item_id", "left_semi")


def holding(c: Catalog, word: str) -> DataFrame:
    """(item_id, sure) of items of which a tag, or perhaps the path, holds the word: postings of all its runs of three characters, of which those of tags are compared with the word (OP-050, OP-120)."""
    runs = sorted({word[k : k + 3] for k in range(len(word) - 2)})
    every = lambda table, key: table.where(F.col("gram").isin(*runs)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(runs)).select(key)
    tags = every(c.tag_grams, "word").where(F.contains("word", F.lit(word)))
    tagged = c.postings.join(tags, "word", "left_semi").select("item_id", F.lit(True).alias("sure"))
    return tagged.unionByName(every(c.path_grams, "item_id").withColumn("sure", F.lit(False))).groupBy("item_id").agg(F.max("sure").alias("sure"))


def with_part(items: DataFrame, c: Catalog, word: str) -> DataFrame:
    """Items where the word is part of a tag or of the path; words of fewer than three characters are looked for in all tags and paths (OP-049, OP-050)."""
    if len(word) >= 3:
        return items.join(holding(c, word), "item_id").where(F.col("sure") | F.contains(F.lower("filepath"), F.lit(word))).drop("sure")
    tagged = c.postings.where(F.contains("word", F.lit(word))).select("item_id")
    named = items.where(F.contains(F.lower("filepath"), F.lit(word))).select("item_id")
    return items.join(tagged.unionByName(named), "item_id", "left_semi")


def order_columns(key: str | None) -> list[Column]:
    """Sort keys of an ``order:`` value; missing values count as a number below all (OP-101)."""
    score, fav = F.coalesce("score", F.lit(MISSING)), F.coalesce("fav_count", F.lit(MISSING))
    known = {
        "score": score.desc(), "score_desc": score.desc(), "score_asc": score.asc(), "fav": fav.desc(), "fav_desc": fav.desc(), "fav_asc": fav.asc(),
        **dict.fromkeys(("new", "ingested", "newest", "recent"), F.col("ingested_at").desc_nulls_last()), **dict.fromkeys(("old", "oldest"), F.col("ingested_at").asc_nulls_last()),
    }
    return [known[key], F.col("item_id").asc()] if key in known else [F.col("item_id").asc()]


def compile_search(spec: SearchSpec, c: Catalog) -> DataFrame:
    """The items of a parsed query, unordered (OP-046, OP-051)."""
    items = c.items
    if spec.extensions:
        items = items.where(reduce(lambda a, b: a | b, (F.endswith(F.lower("filepath"), F.lit("." + e)) for e in spec.extensions)))
    if spec.filename:
        items = items.where(F.contains(F.lower("filepath"), F.lit(spec.filename)))
    if "parent" in spec.flags:
        items = items.where("parent_id is not null")
    children = c.items.where("parent_id is not null").select(F.col("parent_id").alias("post_id"))
    if "child" in spec.flags:
        items = items.join(children, "post_id", "left_semi")
    if "relationship" in spec.flags:
        either = items.where("parent_id is not null").select("item_id").unionByName(items.join(children, "post_id", "left_semi").select("item_id"))
        items = items.join(either, "item_id", "left_semi")
    if "upscaled" in spec.flags:
        items = items.where("upscaled_width is not null and upscaled_height is not null")
    if "not_upscaled" in spec.flags:
        items = items.where("upscaled_width is null and upscaled_height is null")
    if "favourite" in spec.flags:
        items = items.join(c.favourites, "item_id", "left_semi")
    if "metadata_missing" in spec.flags:
        items = items.join(c.item_sources.where("source <> 'local_tagger'"), "item_id", "left_anti")
    if "pool" in spec.flags:
        items = items.join(c.pool_items, "item_id", "left_semi")
    if spec.pool:
        named = c.pools.where(F.contains(F.lower("name"), F.lit(spec.pool))).select("pool_id")
        items = items.join(c.pool_items.join(named, "pool_id", "left_semi"), "item_id", "left_semi")
    items = with_all(items, c.item_sources, "source", tuple(s.lower() for s in spec.sources))
    for category, tag in spec.in_category:
        items = items.join(c.item_tags.where((F.col("category") == category) & (F.lower("tag") == tag)), "item_id", "left_semi")
    known: set[str] = set()
    if spec.terms:  # one small lookup decides which words are tags
        known = {r.word for r in c.tag_bits.where(F.col("word").isin(*spec.terms)).select("word").distinct().collect()}
    every = [*spec.ratings, *(t for t in spec.terms if t in known)]
    if every or spec.negative:  # else the tag table is not asked for
        items = with_words(items, c.tag_bits, every, spec.negative)
    for word in [t for t in spec.terms if t not in known] + list(spec.free):
        items = with_part(items, c, word)
    for word in spec.negative:
        items = items.where(~F.contains(F.lower("filepath"), F.lit(word)))
    return items


def search(c: Catalog, query: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(item_id, filepath, rank) of a query; rank is the place in its order, for paged results (OP-046, OP-103)."""
    spec = parse(query)
    found = compile_search(spec, c).select("item_id", "filepath", "score", "fav_count", "ingested_at")
    if limit is None and spec.order is None:
        return found.select("item_id", "filepath")
    ordered = found.orderBy(*order_columns(spec.order))
    if limit is not None:
        ordered = ordered.offset(offset).limit(limit)
        place = F.row_number().over(Window.orderBy(*order_columns(spec.order))) + offset  # over one page
        return ordered.select("item_id", "filepath", place.cast("int").alias("rank"))
    return ordered.select("item_id", "filepath")


def page_info(found: DataFrame, per_page: int) -> DataFrame:
    """(total, total_pages) of a result (OP-103)."""
    return found.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / per_page).cast("long"))


def items_with_tags(c: Catalog) -> DataFrame:
    """(item_id, filepath, tags): tags sorted and joined by a space, empty for none (OP-001, OP-095)."""
    tags = c.item_tags.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("tags"))
    return c.items.join(tags, "item_id", "left").select("item_id", "filepath", F.coalesce("tags", F.lit("")).alias("tags"))


def category_texts(c: Catalog) -> DataFrame:
    """(item_id, tags_all): the six categories' texts, each possibly empty, joined by a space in their fixed order (OP-052)."""
    cell = lambda k: F.coalesce(F.array_join(F.array_sort(F.collect_set(F.when(F.col("category") == k, F.col("tag")))), " "), F.lit(""))
    return c.item_tags.groupBy("item_id").agg(F.concat_ws(" ", *(cell(k) for k in BASE_CATEGORIES)).alias("tags_all"))


def pool_contents(c: Catalog, name: str) -> DataFrame:
    """Items of pools whose name contains the text, with their place (OP-056)."""
    named = c.pools.where(F.contains(F.lower("name"), F.lit(name.lower())))
    return c.pool_items.join(named, "pool_id").join(c.items, "item_id").select("pool_id", "item_id", "filepath", "sort_order")


def tag_browse(c: Catalog, text: str = "", category: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """(tag, category, n): tags in use, filtered, a page by name (OP-057)."""
    kept = c.item_tags.where(F.contains(F.lower("tag"), F.lit(text.lower())))
    if category:
        kept = kept.where(F.col("category") == category)
    return kept.groupBy("tag", "category").agg(F.countDistinct("item_id").alias("n")).where("n > 0").orderBy("tag", "category").offset(offset).limit(limit)


def tag_browse_total(c: Catalog, text: str = "", category: str | None = None) -> DataFrame:
    """(total) of tags that ``tag_browse`` pages through (OP-057)."""
    kept = c.item_tags.where(F.contains(F.lower("tag"), F.lit(text.lower())))
    return (kept.where(F.col("category") == category) if category else kept).select("tag", "category").distinct().agg(F.count("*").alias("total"))


def autocomplete(c: Catalog, query: str, top: int = 20, per_category: int = 5) -> DataFrame:
    """(tag, category, n, is_prefix, place): the most used tags that hold the last word, by category (OP-058)."""
    token = (query.strip().lower().split() or [""])[-1]
    negative, word = token.startswith("-"), token.removeprefix("-")
    hit = c.item_tags.where(F.contains(F.lower("tag"), F.lit(word)) & ~F.startswith("tag", F.lit("rating_")) & F.lit(len(word) >= 2))
    best = hit.groupBy("tag", "category").agg(F.countDistinct("item_id").alias("n")).orderBy(F.desc("n"), "tag").limit(top)
    order = F.array_position(F.array(*map(F.lit, AUTOCOMPLETE_ORDER)), F.col("category"))
    rows = best.withColumn("is_prefix", F.startswith(F.lower("tag"), F.lit(word)))
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("is_prefix"), F.desc("n"), "tag"))
    rows = rows.withColumn("place", place.cast("int")).where(F.col("place") <= per_category).withColumn("group_order", order.cast("int"))
    return rows.withColumn("tag", F.concat(F.lit("-" if negative else ""), "tag"))


def filter_keywords(sources: Sequence[str] = ()) -> dict[str, tuple[str, ...]]:
    """Filters that the search box offers, each with words that lead to it, from the language's own tables (OP-058)."""
    found = {r: ("rating", r.partition(":")[2], *(("safe",) if r == RATINGS[0] else ())) for r in RATINGS}
    found |= {f"source:{s.lower()}": (s.lower(),) for s in sources}
    found |= {f: (f.partition(":")[2],) for f in FLAGS if not f.startswith("-")}
    found |= {f".{e}": (e,) for e in (*VIDEO_EXTENSIONS, "gif")} | {"has:video": ("video", *VIDEO_EXTENSIONS), "pool:": ("pool",), "filename:": ("filename",)}
    return found | {f"order:{k}": ("order", k) for k in ORDER_KEYS}


def filter_suggestions(token: str, sources: Sequence[str] = ()) -> list[str]:
    """Search filters that a word may begin (OP-058)."""
    return [f for f, words in filter_keywords(sources).items() if len(token) >= 2 and (f.startswith(token) or any(w.startswith(token) for w in words))]


def filters_for(tokens: DataFrame, sources: Sequence[str] = ()) -> DataFrame:
    """(token, filter) of all tokens (token) of two characters or more: the filters that each may begin (OP-058).

    The filters and their words are a table of the language's size, whatever the tokens.
    """
    rows = [(f, w) for f, words in filter_keywords(sources).items() for w in (f, *words)]
    known = tokens.sparkSession.createDataFrame(rows, "filter string, word string")
    asked = tokens.where(F.length("token") >= 2).select("token").distinct()
    return asked.join(F.broadcast(known), F.startswith("word", F.col("token"))).select("token", "filter").distinct()


def pool_search(c: Catalog, text: str) -> DataFrame:
    """(pool_id, name, n) of pools whose name or description holds the text (OP-059)."""
    hit = c.pools.where(F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("description"), F.lit(text.lower())))
    return hit.join(c.pool_items, "pool_id", "left").groupBy("pool_id", "name").agg(F.count("item_id").alias("n"))


def small_items(items: DataFrame, width: int | None = None, height: int | None = None, megapixels: float | None = None, kilobytes: float | None = None, exclude_upscaled: bool = True) -> DataFrame:
    """Items that any of the given limits calls small: narrow or low, of few pixels, of a small file (``filesize``) (OP-062)."""
    w, h = F.col("image_width"), F.col("image_height")
    checks = [(w <= width) | (h <= height)] if width is not None and height is not None else []
    checks += [w * h / 1_000_000.0 <= megapixels] if megapixels is not None else []
    checks += [F.col("filesize") / 1024.0 <= kilobytes] if kilobytes is not None else []
    small = reduce(lambda a, b: a | b, checks, F.lit(False))
    return items.where(small & (F.col("upscaled_width").isNull() if exclude_upscaled else F.lit(True))).select("item_id", "image_width", "image_height")


def review_feed(c: Catalog, after_id: int, limit: int, mode: str = "unrated", facts: DataFrame | None = None, skip: Sequence[int] = ()) -> DataFrame:
    """The next items by id with their tags: without a rating, with one that the model gave, or any (OP-061, OP-188).

    facts: the tag table with the source of each tag, for mode "ai_predicted".
    """
    rated = c.item_tags.where(F.startswith("tag", F.lit("rating:")))
    page = c.items.where(F.col("item_id") > after_id)
    page = page.where(~F.col("item_id").isin(*skip)) if skip else page
    if mode == "unrated":
        page = page.join(rated, "item_id", "left_anti")
    elif mode == "ai_predicted":
        page = page.join((facts if facts is not None else c.facts).where(F.startswith("tag", F.lit("rating:")) & (F.col("source") == "ai_inference")), "item_id", "left_semi")
    page = page.orderBy("item_id").limit(limit).select("item_id", "filepath")
    tags = c.item_tags.join(page, "item_id", "left_semi").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("tags"))
    return page.join(tags, "item_id", "left").select("item_id", "filepath", F.coalesce("tags", F.lit("")).alias("tags"))


def text_index(items: DataFrame, item_tags: DataFrame) -> DataFrame:
    """(word, item_id, field): the inverted index of paths and tags; write it partitioned or sorted by word (OP-008).

    A path's words are its runs of letters and digits; a tag is a word itself,
    and so are the runs within it.  Names are dealt by item before they become
    words, so words are neither moved nor compared with those of other items,
    and a join by item that follows moves nothing again.
    """
    runs = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"))
    per_item = lambda rows, name: rows.select("item_id", name).repartition("item_id").groupBy("item_id").agg(F.collect_set(name).alias("names"))
    words = lambda made: F.explode(F.array_distinct(F.flatten(F.transform("names", made)))).alias("word")
    paths = per_item(items, "filepath").select(words(runs), "item_id", F.lit("path").alias("field"))
    tags = per_item(item_tags, "tag").select(words(lambda t: F.concat(F.array(F.lower(t)), runs(t))), "item_id", F.lit("tag").alias("field"))
    return paths.unionByName(tags)


def index_updated(index: DataFrame, items: DataFrame, item_tags: DataFrame, changed: DataFrame) -> DataFrame:
    """The index after items (item_id) were added, changed or removed: their old rows go, rows of those that still exist come (OP-009)."""
    fresh = text_index(items.join(hashed(changed), "item_id", "left_semi"), item_tags.join(hashed(changed), "item_id", "left_semi"))
    return index.join(hashed(changed), "item_id", "left_anti").unionByName(fresh)


def index_search(index: DataFrame, words: Sequence[str], prefixes: Sequence[str] = ()) -> DataFrame:
    """(item_id, score): items that hold every word and a word of each prefix, the best first (OP-048).

    A whole word scores its rarity, ln(1 + N / n); a prefix half the rarest of
    the words that it matches.  Conditions on words reach the index's scan.
    """
    wanted = [(w.lower(), False) for w in dict.fromkeys(words)] + [(p.lower(), True) for p in dict.fromkeys(prefixes)]
    if not wanted:
        return index.select("item_id", F.lit(0.0).alias("score")).where(F.lit(False))
    hit = reduce(lambda a, b: a | b, (F.startswith("word", F.lit(w)) if p else F.col("word") == w for w, p in wanted))
    rows = index.where(hit).select("word", "item_id").distinct()
    df = rows.groupBy("word").agg(F.count("*").alias("n"))
    total = index.agg(F.countDistinct("item_id").alias("total"))  # one row
    rare = df.join(F.broadcast(total), F.lit(True)).select("word", F.log(1 + F.col("total") / F.col("n")).alias("rarity"))
    terms = F.array_compact(F.array(*(F.when(F.startswith("word", F.lit(w)) if p else F.col("word") == w, F.struct(F.lit(k).alias("term"), F.lit(0.5 if p else 1.0).alias("part"))) for k, (w, p) in enumerate(wanted))))
    per = rows.join(rare, "word").select("item_id", F.explode(terms).alias("t"), "rarity").groupBy("item_id", "t.term").agg(F.max(F.col("rarity") * F.col("t.part")).alias("s"))
    found = per.groupBy("item_id").agg(F.count("*").alias("n"), F.sum("s").alias("score")).where(F.col("n") == len(wanted))
    return found.select("item_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "item_id")


def free_text(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Documents that hold every term as a word or part of one, and how many are whole words (OP-048)."""
    low = F.lower("text")
    hit = reduce(lambda a, b: a & b, (F.contains(low, F.lit(t.lower())) for t in terms))
    whole = F.size(F.array_intersect(F.filter(F.split(low, r"\s+"), lambda w: w != ""), F.array(*(F.lit(t.lower()) for t in terms))))
    return docs.where(hit).select("doc_id", whole.alias("whole_words"))
