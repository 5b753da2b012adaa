"""Column builders shared by the operators, and their registration as SQL functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.constants import CATEGORY_WEIGHTS, EXTENDED_META, RATING_CODES


def words(text: Column) -> Column:
    """Lower-cased words, split on white space, empties dropped (OP-121)."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def popcount(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming(left: list[Column], right: list[Column]) -> Column:
    """Differing bits of two hashes given as integer words (OP-126, OP-162)."""
    return reduce(lambda x, y: x + y, (popcount(a, b) for a, b in zip(left, right, strict=True)))


def hex_words(hash_: Column, n: int) -> list[Column]:
    """A hex hash of n x 32 bits as integer words; null where it does not parse."""
    return [F.try_to_number(F.conv(F.substring(hash_, 8 * i + 1, 8), 16, 10), F.lit("9999999999")).cast("long") for i in range(n)]


def hamming_hex(a: Column, b: Column, bits: int = 64) -> Column:
    """Differing bits of two hex hashes; all bits where either does not parse (OP-162)."""
    ok = lambda h: h.rlike(f"^[0-9A-Fa-f]{{{bits // 4}}}$")
    part = lambda h, i: F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")
    d = reduce(lambda x, y: x + y, (popcount(part(a, i), part(b, i)) for i in range(bits // 32)))
    return F.when(ok(a) & ok(b), d).otherwise(F.lit(bits)).cast("int")


def hash_score(distance: Column, bits: int = 64) -> Column:
    """max(0, 1 - d / bits) (OP-163)."""
    return F.greatest(F.lit(0.0), 1.0 - distance / F.lit(float(bits)))


def hybrid_score(p: Column, c: Column, color_weight: float) -> tuple[Column, Column]:
    """Blend of structure and colour score, and its distance on a scale of 64 (OP-164)."""
    score = (1.0 - color_weight) * p + color_weight * F.coalesce(c, F.lit(0.0))
    return score, 64.0 * (1.0 - score)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def jaccard(a: Column, b: Column) -> Column:
    """Size of intersection over union of two arrays; 0 where either is empty (OP-150)."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / any_).otherwise(F.lit(0.0))


def choose(value: Column, options: dict[str, object], default: object = None) -> Column:
    out = F.lit(default)
    for key, result in reversed(list(options.items())):
        out = F.when(value == key, F.lit(result)).otherwise(out)
    return out


def category_weight(category: Column) -> Column:
    """Weight of a base category, 1 where unknown (OP-153)."""
    return choose(category, CATEGORY_WEIGHTS, 1.0)


def base_of_extended(extended: Column) -> Column:
    """Base category of an extended one."""
    return F.when(extended.isin(*EXTENDED_META), "meta").when(extended.isNotNull(), "general")


def normal_rating(tag: Column) -> Column:
    """rating_x becomes rating:x for the known ratings (OP-123)."""
    return F.when(tag.rlike("^rating_(general|sensitive|questionable|explicit)$"), F.regexp_replace(tag, "^rating_", "rating:")).otherwise(tag)


def rating_of_code(code: Column) -> Column:
    return choose(F.lower(code), dict(RATING_CODES))


def natural_key(name: Column) -> Column:
    """A key that sorts digit runs by value (OP-113): each is written with leading zeros to twelve places."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 12, "0")).otherwise(p)), "")


def hash_bucket(name: Column) -> Column:
    """Three hex digits of a name's MD5: its directory (OP-125)."""
    return F.substring(F.md5(name), 1, 3)


def plain_path(path: Column) -> Column:
    """Without a leading slash and an images/ prefix in any case (OP-124)."""
    return F.regexp_replace(F.regexp_replace(path, "^/+", ""), "(?i)^images/", "")


def preview_path(path: Column, folder: str = "thumbnails", extension: str = ".webp") -> Column:
    """Where a picture's preview lies: the folder, the bucket of its name, the name with another extension (OP-124)."""
    name = F.element_at(F.split(plain_path(path), "/"), -1)
    return F.concat(F.lit(folder + "/"), hash_bucket(name), F.lit("/"), F.regexp_replace(name, r"\.[^.]+$", ""), F.lit(extension))


def short_name(name: Column, most: int = 200) -> Column:
    """A file name of at most so many bytes: a longer one is cut and gets eight digits of its hash before its extension (OP-124)."""
    extension = F.regexp_extract(name, r"(\.[^.]{1,10})$", 1)
    stem = F.substring(name, F.lit(1), F.lit((most - 20) // 4))  # a character has at most four bytes
    return F.when(F.octet_length(name) <= most, name).otherwise(F.concat(stem, F.lit("_"), F.substring(F.md5(name), 1, 8), extension))


#: How a file name may hold a post's number: before a page mark, after a site's name, or as the whole name.
NAME_IDS = (r"([0-9]{6,})_p[0-9]+\.", r"(?i)[a-z]+[_-]([0-9]{6,})\.", r"^([0-9]{6,9})(?:\.[^.]*)?$")


def id_in_name(name: Column) -> Column:
    """A post's number in a file name; null without one (OP-122)."""
    return F.coalesce(*(F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in NAME_IDS)).try_cast("long")


def nearest_rank(values: Column, q: float) -> Column:
    """The value at the rounded index (n - 1) q of a sorted array (OP-132)."""
    return F.element_at(F.sort_array(values), (F.rint((F.size(values) - 1) * F.lit(q)) + 1).cast("int"))


def register(spark: SparkSession) -> None:
    """SQL functions of the engine: hamming_hex64, tag_jaccard, natural_sort_key, hash_bucket."""
    for statement in (
        "CREATE OR REPLACE TEMPORARY FUNCTION hamming_hex64(a STRING, b STRING) RETURNS INT RETURN CASE WHEN a RLIKE '^[0-9A-Fa-f]{16}$' AND b RLIKE '^[0-9A-Fa-f]{16}$' THEN"
        " bit_count(CAST(conv(substring(a,1,8),16,10) AS BIGINT) ^ CAST(conv(substring(b,1,8),16,10) AS BIGINT)) + bit_count(CAST(conv(substring(a,9,8),16,10) AS BIGINT) ^ CAST(conv(substring(b,9,8),16,10) AS BIGINT)) ELSE 64 END",
        "CREATE OR REPLACE TEMPORARY FUNCTION tag_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE RETURN CASE WHEN size(a) > 0 AND size(b) > 0 THEN size(array_intersect(a, b)) / size(array_union(a, b)) ELSE 0.0 END",
        "CREATE OR REPLACE TEMPORARY FUNCTION natural_sort_key(name STRING) RETURNS STRING RETURN array_join(transform(regexp_extract_all(lower(name), '([0-9]+|[^0-9]+)', 1), p -> CASE WHEN p RLIKE '^[0-9]' THEN lpad(p, 12, '0') ELSE p END), '')",
        "CREATE OR REPLACE TEMPORARY FUNCTION hash_bucket(name STRING) RETURNS STRING RETURN substring(md5(name), 1, 3)",
    ):
        spark.sql(statement)
