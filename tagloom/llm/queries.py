"""The thin queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import chat_repair, mixing, packing, pii, quality_rules, sentence_pieces, simhash_trie, source_divergence, substring_dedup, timestamps, topk_search, warc_fixity, weak_labels


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors.where("vec_id % 50 = 0"), vectors)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, _table(spark, sf_dir, "labels")))


def op4_weak_label_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf_dir, "documents")))


def op6_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair_chats(_table(spark, sf_dir, "conversations"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage: of each 50 pages one has another first character, one is cut to half, one is lost, and one stands there twice, once under a new id."""
    which, html = F.pmod("page_id", F.lit(50)), F.coalesce("html", F.lit(""))
    changed = F.when(which == 7, F.concat(F.lit("?"), F.substring(html, 2, 2**31 - 1))).when(which == 17, F.substring(html, F.lit(1), F.floor(F.length(html) / 2).cast("int"))).otherwise(F.col("html"))
    there = pages.where((which != 27) | F.col("page_id").isNull()).withColumn("html", changed)
    return there.unionByName(pages.where(which == 37).withColumn("page_id", F.col("page_id") + 10**12))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return warc_fixity.check_replica(pages, damaged(pages))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_table(spark, sf_dir, "documents"))


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digest(_table(spark, sf_dir, "documents"))


def op13_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.normalise(_table(spark, sf_dir, "stamps"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk_search, op2_simhash_near_dedup, op3_quality_rules, op4_weak_label_classifier, op5_personal_data, op6_chat_repair, op7_best_fit_packing, op8_warc_fixity, op9_substring_dedup, op10_source_mixing, op11_source_divergence, op12_sentence_pieces, op13_timestamps)}


OP1_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP8_SQL = """
WITH primary_pages AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), replica_pages AS (
  SELECT page_id, url, CASE page_id % 50 WHEN 7 THEN '?' || substr(html, 2) WHEN 17 THEN substr(html, 1, CAST(floor(length(html) / 2) AS BIGINT)) ELSE html END AS html
  FROM primary_pages WHERE page_id % 50 <> 27
  UNION ALL SELECT page_id + 1000000000000, url, html FROM primary_pages WHERE page_id % 50 = 37
), both_sides AS (
  SELECT 'p' AS side, * FROM primary_pages UNION ALL SELECT 'r', * FROM replica_pages
), named AS (
  SELECT *, md5(CAST(page_id AS VARCHAR) || '|' || url) AS h FROM both_sides
), recorded AS (
  SELECT side, page_id,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
         || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:'
         || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>' || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
         || html || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM named
), hashed AS (
  SELECT side, page_id, CAST(floor(page_id / 2048.0) AS BIGINT) AS archive, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS sha256 FROM recorded
), placed AS (
  SELECT *, CAST(sum(length) OVER (PARTITION BY side, archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length AS BIGINT) AS start FROM hashed
), judged AS (
  SELECT coalesce(p.page_id, r.page_id) AS page_id, coalesce(p.archive, r.archive) AS archive, coalesce(p.start, r.start) AS start, coalesce(p.length, r.length) AS length, coalesce(p.sha256, r.sha256) AS sha256,
         CASE WHEN r.page_id IS NULL THEN 'missing' WHEN p.page_id IS NULL THEN 'added' WHEN p.sha256 <> r.sha256 THEN 'corrupt' WHEN p.start <> r.start THEN 'moved' ELSE 'intact' END AS status
  FROM (SELECT * FROM placed WHERE side = 'p') p FULL JOIN (SELECT * FROM placed WHERE side = 'r') r ON p.page_id = r.page_id
)
SELECT page_id, archive, page_id - 2048 * archive AS leaf, start AS "offset", length, sha256, CAST(1 AS BIGINT) AS copies, status, status IN ('intact', 'moved') AS intact FROM judged
"""

_NEXT = " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER d" for k in range(1, 13))])
OP9_SQL = f"""
WITH t AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS words FROM documents
), w AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS word FROM t
), g AS (
  SELECT doc_id, pos, {_NEXT} AS passage FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), least_doc AS (
  SELECT passage, min(doc_id) AS lo FROM g WHERE passage IS NOT NULL GROUP BY passage
), starts AS (
  SELECT g.doc_id, g.pos FROM g JOIN least_doc m ON m.passage = g.passage WHERE m.lo < g.doc_id
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM starts CROSS JOIN (SELECT unnest(range(0, 13)) AS k)
), kept AS (
  SELECT w.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY w.pos) AS text
  FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.pos = w.pos WHERE gone.pos IS NULL GROUP BY 1
)
SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id
"""


OP11_SQL = r"""
WITH read_docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), kept_terms AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM read_docs) GROUP BY ALL HAVING count(*) >= 10
), occurrences AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(words) AS term FROM read_docs) GROUP BY ALL
), found_groups AS (
  SELECT DISTINCT lang, source FROM read_docs
), grid AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n
  FROM found_groups g JOIN kept_terms k USING (lang) LEFT JOIN occurrences o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
), of_group AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source) AS size, count(*) OVER (PARTITION BY lang, source) AS v FROM grid
), of_lang AS (
  SELECT lang, term, n, sum(n) OVER (PARTITION BY lang) AS size, count(*) OVER (PARTITION BY lang) AS v FROM (SELECT lang, term, sum(n) AS n FROM grid GROUP BY ALL)
), shares AS (
  SELECT lang, source, term, n, CAST(1 + (CAST(1000000000 AS HUGEINT) * CAST(n + 2 AS HUGEINT)) // CAST(size + 2 * v AS HUGEINT) AS HUGEINT) AS p FROM of_group
), lang_shares AS (
  SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * CAST(n + 2 AS HUGEINT)) // CAST(size + 2 * v AS HUGEINT) AS HUGEINT) AS q FROM of_lang
), by_pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
), all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM found_groups a JOIN found_groups b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN by_pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), by_term AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM by_term)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

_WHEN = r"([T ](\d\d):(\d\d)(:(\d\d))?( ?([AP])M)?( ?(Z|[+-]\d\d:?\d\d))?)?".replace(r"\d", "[0-9]")
_MONTHS = "|".join(timestamps.MONTHS)
# written apart from the operator: a kind per form, days from 1970 by DuckDB's dates, offsets tried in quarters of an hour, a skipped time by the offset a day later
OP13_SQL = f"""
WITH stripped AS (
  SELECT stamp_id, source, zone, regexp_replace(raw, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS t FROM stamps
), kinds AS (
  SELECT *, CASE
    WHEN regexp_full_match(t, '[0-9]{{10}}') THEN 's' WHEN regexp_full_match(t, '[0-9]{{13}}') THEN 'ms'
    WHEN regexp_full_match(t, '20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}{_WHEN}') THEN 'iso' WHEN regexp_full_match(t, '20[0-9]{{6}}{_WHEN}') THEN 'plain'
    WHEN regexp_full_match(t, '[0-9]{{2}}[.][0-9]{{2}}[.]20[0-9]{{2}}{_WHEN}') THEN 'dots' WHEN regexp_full_match(t, '[0-9]{{2}} ({_MONTHS}) 20[0-9]{{2}}{_WHEN}') THEN 'named'
    WHEN regexp_full_match(t, '[0-9]{{2}}/[0-9]{{2}}/20[0-9]{{2}}{_WHEN}') THEN 'slash' ELSE 'bad' END AS kind
  FROM stripped
), cut AS (
  SELECT *, CASE kind WHEN 'iso' THEN 10 WHEN 'plain' THEN 8 WHEN 'dots' THEN 10 WHEN 'named' THEN 11 WHEN 'slash' THEN 10 END AS n FROM kinds
), fields AS (
  SELECT *,
    CASE kind WHEN 'iso' THEN t[1:4] WHEN 'plain' THEN t[1:4] WHEN 'named' THEN t[8:11] ELSE t[7:10] END AS y,
    CASE kind WHEN 'iso' THEN t[6:7] WHEN 'plain' THEN t[5:6] WHEN 'named' THEN lpad(CAST((instr('JanFebMarAprMayJunJulAugSepOctNovDec', t[4:6]) + 2) // 3 AS VARCHAR), 2, '0') ELSE t[4:5] END AS m,
    CASE kind WHEN 'iso' THEN t[9:10] WHEN 'plain' THEN t[7:8] ELSE t[1:2] END AS d,
    regexp_extract(t[n + 1:], '^{_WHEN}$', ['all', 'h', 'mi', 'cs', 's', 'ch', 'half', 'co', 'off']) AS w
  FROM cut
), times AS (
  SELECT *, w.h AS h, w.mi AS mi, w.s AS s, w.half AS half, w.off AS off,
    kind NOT IN ('s', 'ms', 'bad') AND (w.h = '' OR (CASE WHEN w.half = '' THEN w.h <= '23' ELSE w.h BETWEEN '01' AND '12' END)) AND w.mi <= '59' AND w.s <= '59'
      AND (w.off IN ('', 'Z') OR (w.off[2:3] <= '14' AND right(w.off, 2) <= '59')) AS fits
  FROM fields
), days AS (
  SELECT *, CASE WHEN fits THEN TRY_CAST(y || '-' || m || '-' || d AS DATE) END AS by_day,
    CASE WHEN fits THEN TRY_CAST(CASE kind WHEN 'slash' THEN y || '-' || d || '-' || m ELSE y || '-' || m || '-' || d END AS DATE) END AS by_month,
    CASE WHEN fits THEN 3600 * CASE WHEN h = '' THEN 0 WHEN half = '' THEN CAST(h AS INT) ELSE CAST(h AS INT) % 12 + CASE half WHEN 'P' THEN 12 ELSE 0 END END
      + 60 * coalesce(TRY_CAST(mi AS INT), 0) + coalesce(TRY_CAST(s AS INT), 0) END AS second_of_day,
    CASE WHEN fits THEN CASE WHEN off = 'Z' THEN 0 WHEN off <> '' THEN (CASE off[1:1] WHEN '-' THEN -1 ELSE 1 END) * (3600 * CAST(off[2:3] AS INT) + 60 * CAST(right(off, 2) AS INT)) END END AS "offset"
  FROM times
), votes AS (
  SELECT source, count(by_day) AS n_day, count(by_month) AS n_month FROM days WHERE kind = 'slash' AND (by_day IS NULL) <> (by_month IS NULL) GROUP BY source
), told AS (
  SELECT d.*, coalesce(n_day, 0) AS n_day, coalesce(n_month, 0) AS n_month,
    CASE WHEN kind IN ('s', 'ms') THEN 'epoch' WHEN by_day IS NULL AND by_month IS NULL THEN 'bad' WHEN by_day <> by_month THEN CASE WHEN coalesce(n_day, 0) <> coalesce(n_month, 0) THEN 'votes' ELSE 'default' END ELSE 'plain' END AS rule
  FROM days d LEFT JOIN votes v ON v.source IS NOT DISTINCT FROM d.source
), walls AS (
  SELECT *, CASE WHEN rule IN ('votes', 'default') AND n_month > n_day THEN by_month WHEN rule <> 'bad' THEN coalesce(by_day, by_month) END + to_seconds(second_of_day) AS wall FROM told
), tried AS (
  SELECT *, CASE WHEN "offset" IS NULL AND rule <> 'bad' AND kind NOT IN ('s', 'ms') THEN
    list_filter(list_transform(range(-56, 57), lambda q: 900 * q), lambda o: timezone(zone, to_timestamp(epoch(wall) - o)) = wall) END AS hits
  FROM walls
), solved AS (
  SELECT *, CASE WHEN hits IS NULL THEN "offset" WHEN len(hits) > 0 THEN list_min(hits) ELSE CAST(epoch(timezone(zone, to_timestamp(epoch(wall) + 86400))) - epoch(wall) - 86400 AS BIGINT) END AS final FROM tried
)
SELECT stamp_id, CASE kind WHEN 's' THEN CAST(t AS BIGINT) * 1000000 WHEN 'ms' THEN CAST(t AS BIGINT) * 1000 ELSE CAST(epoch(wall) AS BIGINT) * 1000000 - final * 1000000 END AS utc_us,
  rule, rule IN ('votes', 'default') OR coalesce(len(hits) <> 1, false) AS ambiguous
FROM solved
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": OP1_SQL, "op8_warc_fixity": OP8_SQL, "op9_substring_dedup": OP9_SQL, "op11_source_divergence": OP11_SQL, "op13_timestamps": OP13_SQL}
