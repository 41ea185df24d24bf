"""The pN_ queries over the tables of a data folder, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalogue import COMPATIBLE_SQL, SQL, VIDEOS_SQL, sequence_sql
from ..tables import table
from .components import connected_groups
from .fingerprints import alike_pairs
from .history import refused_rows
from .layouts import layout_counts, layout_groups
from .lookalike import lookalike_classes, lookalike_pairs

# encoding, packing and abuse are imported where they are used: their libraries take up the driver's memory


def _layouts(spark: SparkSession, folder: str) -> list[DataFrame]:
    names = table(spark, folder, "files", "ord", "raw_name").select(F.col("ord").alias("key"), F.lit("").alias("scope"), F.col("raw_name").alias("name"))
    titles = table(spark, folder, "name_cache", "name_id", "core_title", "year", "episode").select(
        F.col("name_id").alias("key"),
        F.concat_ws("/", F.coalesce(F.col("year").cast("string"), F.lit("-")), F.coalesce(F.col("episode").cast("string"), F.lit("-"))).alias("scope"),
        F.col("core_title").alias("name"),
    )
    return [layout_groups(names, looks=True), layout_groups(titles)]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = [groups.withColumn("tab", F.lit(tab)) for groups, tab in zip(_layouts(spark, folder), ("files", "name_cache"))]
    return found[0].union(found[1]).where("key <> first_key").select("tab", "first_key", F.col("key").alias("copy_key"))


def p1_copies(spark: SparkSession, folder: str) -> DataFrame:
    """``tab, first_key, copies`` of every record that comes in more than one row: itself and its copies."""
    counts = [layout_counts(groups).select(F.lit(tab).alias("tab"), "first_key", "copies") for groups, tab in zip(_layouts(spark, folder), ("files", "name_cache"))]
    return counts[0].union(counts[1])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike_pairs(table(spark, folder, "files", "ord", "raw_name"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """``member, class_key``: files whose names look like another, with the first file of their look."""
    return lookalike_classes(table(spark, folder, "files", "ord", "raw_name"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    matches = table(spark, folder, "video_matches", "left", "right", "similarity")
    accepted = matches.where("`left` <> `right` and similarity >= 85 and not isnan(similarity)")
    return connected_groups(accepted)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files", "ord", "full_hash", "duration", "fingerprint", "fingerprint_version", "image_fingerprint", "audio_fingerprint")
    found = [alike_pairs(files, medium).select(F.lit(medium).alias("medium"), "ord_a", "ord_b") for medium in ("video", "image", "audio")]
    return found[0].union(found[1]).union(found[2])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("ord", "full_hash", "duration", "fingerprint", "fingerprint_version")
    return refused_rows(table(spark, folder, "files", *columns), table(spark, folder, "incoming_files", *columns))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    from .encoding import token_ids

    return token_ids(table(spark, folder, "documents", "doc_id", "text"))


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    from .encoding import token_counts
    from .packing import packed_items

    return packed_items(token_counts(table(spark, folder, "documents", "doc_id", "text")), "doc_id", "tokens")


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    from .abuse import scored_documents

    return scored_documents(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "labels", "doc_id", "abusive"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    from .abuse import THRESHOLD

    return _scores(spark, folder).where(F.col("score") >= THRESHOLD).select("doc_id")


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder)


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    from .abuse import source_rates

    return source_rates(_scores(spark, folder))


P3_SQL = """
WITH RECURSIVE accepted AS (
  SELECT DISTINCT "left" AS a, "right" AS b FROM video_matches
  WHERE "left" <> "right" AND similarity >= 85 AND similarity::VARCHAR <> 'nan'
), links AS (SELECT a, b FROM accepted UNION SELECT b, a FROM accepted),
reach(member, other) AS (
  SELECT a, a FROM links UNION SELECT r.member, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT member, min(other) AS group_key FROM reach GROUP BY member
"""


_VIDEO_BITS = 9  # frames of which some pair must be that near in alike videos (see alikeness)
_CLASSES_SQL = f"SELECT words, min(ord) AS id FROM ({VIDEOS_SQL}) GROUP BY words"
_IMAGES_SQL = "SELECT ord, full_hash, image_fingerprint AS words FROM files WHERE len(image_fingerprint) = 4"
P4_SQL = f"""
WITH RECURSIVE classes AS ({_CLASSES_SQL}),
{sequence_sql("SELECT a.id AS ord_a, b.id AS ord_b, a.words AS aw, b.words AS bw FROM classes a JOIN classes b ON a.id <= b.id", _VIDEO_BITS)},
videos AS (SELECT v.*, c.id FROM ({VIDEOS_SQL}) v JOIN classes c USING (words)),
alike AS (SELECT ord_a AS x, ord_b AS y FROM scores WHERE similarity >= 85 UNION SELECT ord_b, ord_a FROM scores WHERE similarity >= 85)
SELECT 'video' AS medium, a.ord AS ord_a, b.ord AS ord_b FROM alike JOIN videos a ON a.id = x JOIN videos b ON b.id = y
  WHERE a.ord < b.ord AND {COMPATIBLE_SQL} AND NOT coalesce(a.full_hash = b.full_hash, false)
UNION ALL SELECT 'image', a.ord, b.ord FROM ({_IMAGES_SQL}) a JOIN ({_IMAGES_SQL}) b ON a.ord < b.ord AND NOT coalesce(a.full_hash = b.full_hash, false)
  WHERE 0.8::DOUBLE * (100.0 * (1.0 - bit_count(xor(a.words[1], b.words[1])) / 64.0::DOUBLE)) + 0.2::DOUBLE * (100.0 * (1.0 -
    (abs(a.words[2] - b.words[2]) + abs(a.words[3] - b.words[3]) + abs(a.words[4] - b.words[4])) / 765.0::DOUBLE)) >= 90
UNION ALL SELECT 'audio', ord_a, ord_b FROM ({SQL["audio_pairs"]})
"""
P5_SQL = f"""
WITH RECURSIVE both_ AS (SELECT ord, full_hash, CASE WHEN len(fingerprint) > 0 AND fingerprint_version = 2 AND duration > 0 AND duration::VARCHAR <> 'nan' THEN fingerprint END AS words, duration, kind
  FROM (SELECT ord, full_hash, fingerprint, fingerprint_version, duration, 0 AS kind FROM files UNION ALL SELECT ord, full_hash, fingerprint, fingerprint_version, duration, 1 FROM incoming_files)),
classes AS (SELECT words, min(ord) AS id, max(kind) AS kind FROM both_ WHERE words IS NOT NULL GROUP BY words),
{sequence_sql("SELECT a.id AS ord_a, b.id AS ord_b, a.words AS aw, b.words AS bw FROM classes a JOIN classes b ON a.id <= b.id AND (a.kind = 1 OR b.kind = 1)", _VIDEO_BITS)},
rows_ AS (SELECT r.*, c.id FROM both_ r LEFT JOIN classes c USING (words)),
alike AS (SELECT ord_a AS x, ord_b AS y FROM scores WHERE similarity >= 85 UNION SELECT ord_b, ord_a FROM scores WHERE similarity >= 85),
near_ AS (SELECT b.ord, min(a.ord) FILTER (a.kind = 0) AS old, list(a.ord) FILTER (a.kind = 1) AS new FROM rows_ b JOIN alike ON x = b.id JOIN rows_ a ON a.id = y AND a.ord < b.ord
  WHERE b.kind = 1 AND {COMPATIBLE_SQL} GROUP BY b.ord),
same_ AS (SELECT b.ord, min(a.ord) FILTER (a.kind = 0) AS old, list(a.ord) FILTER (a.kind = 1) AS new FROM rows_ b JOIN rows_ a ON a.full_hash = b.full_hash AND a.ord < b.ord WHERE b.kind = 1 GROUP BY b.ord),
asked AS (SELECT r.ord, row_number() OVER (ORDER BY r.ord) AS nth, s.old AS same_old, coalesce(s.new, []) AS same_new, n.old AS near_old, coalesce(n.new, []) AS near_new
  FROM incoming_files r LEFT JOIN same_ s USING (ord) LEFT JOIN near_ n USING (ord)),
steps AS (SELECT 0::BIGINT AS nth, []::BIGINT[] AS taken UNION ALL
  SELECT a.nth, CASE WHEN a.same_old IS NULL AND a.near_old IS NULL AND NOT list_has_any(taken, a.same_new) AND NOT list_has_any(taken, a.near_new) THEN list_append(taken, a.ord) ELSE taken END
  FROM steps JOIN asked a ON a.nth = steps.nth + 1),
final AS (SELECT taken FROM steps ORDER BY nth DESC LIMIT 1),
told AS (SELECT ord, least(same_old, list_min(list_intersect(same_new, taken))) AS by_hash, least(near_old, list_min(list_intersect(near_new, taken))) AS by_words FROM asked, final)
SELECT coalesce(by_hash, by_words) AS seen_ord, ord AS new_ord, CASE WHEN by_hash IS NOT NULL THEN 'exact' ELSE 'near' END AS how FROM told WHERE coalesce(by_hash, by_words) IS NOT NULL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p1_copies": p1_copies, "p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found,
        "p6_ids": p6_ids, "p7_packed": p7_packed, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates,
    }


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL}
