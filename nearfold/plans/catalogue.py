"""The catalogue of queries over a data folder, each with the SQL that must give the same rows.

Every query takes its whole tables. Searches that have no result of linear size take as queries the
rows whose ord or id is divisible by 100, against all rows. Report orders show a report's first rows.

The SQL tells NaN by its text: DuckDB takes isnan from a file's statistics, and those leave NaN out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media, paths
from ..functions.hashing import ALGORITHM, full_hash, partial_hash
from ..functions.names import BRACKETED, FLAG_WORDS, GENERIC_WORDS, NOT_EPISODES, QUALITY_WORDS, contextual_name, normalized_name
from ..functions.similarity import hamming_similarity, image_similarity
from ..operators import clusters, evaluation, exact, journal, matching, naming, planning, review, store
from ..runtime import stage
from ..sources.listing import owned_by_first_root
from ..tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL where there is one."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


# Exact duplicates


@query("""
SELECT full_hash AS hash_value, arg_min(size, ord) AS size, count(*) AS copies,
       string_agg(path, '|' ORDER BY path) AS paths, 100.0::DOUBLE AS similarity
FROM files WHERE full_hash IS NOT NULL GROUP BY full_hash HAVING count(*) > 1
""")
def exact_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact.exact_groups(table(spark, folder, "files", "ord", "path", "size", "full_hash"))
    return groups.withColumn("paths", F.array_join("paths", "|")).orderBy(F.desc("size"), "paths")


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "source", "text").where("text is not null")
    content = F.col("text").cast("binary")
    return docs.select("doc_id", "source", content.alias("content"), F.octet_length(content).cast("long").alias("size"))


WINDOWS_SQL = """
SELECT doc_id, source, encode(text) AS content, octet_length(encode(text))::BIGINT AS size,
  CASE WHEN octet_length(encode(text)) <= 65536 THEN [0::BIGINT] ELSE list_sort(list_distinct(
    [0::BIGINT, octet_length(encode(text)) - 65536] ||
    list_transform([1.0::DOUBLE / 3, 1.0::DOUBLE / 2, 2.0::DOUBLE / 3],
      lambda f: greatest(0, least(floor(octet_length(encode(text)) * f)::BIGINT, octet_length(encode(text)) - 65536))))) END AS starts
FROM documents WHERE text IS NOT NULL
"""
PARTIAL_SQL = f"""
SELECT doc_id, source, content, size,
  sha256(list_reduce([encode(size::VARCHAR)] || list_transform(starts, lambda s: content[s + 1:s + 65536]), lambda a, b: a || b)) AS partial_hash
FROM ({WINDOWS_SQL})
"""


@query(f"SELECT doc_id, size, partial_hash FROM ({PARTIAL_SQL})")
def partial_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return _contents(spark, folder).select("doc_id", "size", partial_hash(F.col("content")).alias("partial_hash"))


@query("SELECT doc_id, 'sha256' AS algorithm, sha256(text) AS digest FROM documents")
def full_hashes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return docs.select("doc_id", F.lit(ALGORITHM).alias("algorithm"), full_hash(F.col("text")).alias("digest"))


@query(f"""
WITH h AS ({PARTIAL_SQL}),
s AS (SELECT * FROM h WHERE size IN (SELECT size FROM h GROUP BY size HAVING count(*) > 1)),
p AS (SELECT * FROM s WHERE (size, partial_hash) IN (SELECT (size, partial_hash) FROM s GROUP BY size, partial_hash HAVING count(*) > 1))
SELECT (SELECT count(*) FROM h) AS contents, (SELECT count(*) FROM s) AS same_size, (SELECT count(*) FROM p) AS same_partial,
  (SELECT count(*) FROM p WHERE sha256(content) IN (SELECT sha256(content) FROM p GROUP BY 1 HAVING count(*) > 1)) AS same_content
""")
def exact_prune_counts(spark: SparkSession, folder: str) -> DataFrame:
    contents = _contents(spark, folder)
    hashed = exact.hashed_contents(contents)
    same = exact.collided(hashed, "full_hash", "full_hash_algo")
    parts = {"contents": contents, "same_size": exact.collided(contents, "size"), "same_partial": hashed, "same_content": same}
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3]).agg(*(F.max(F.when(F.col("part") == name, F.col("n"))).alias(name) for name in parts))


# Sources and media types

MEDIA_SQL = """CASE WHEN regexp_extract(lower(path), '[^/](\\.[^./]+)$', 1) IN ({video}) THEN 'video'
 WHEN regexp_extract(lower(path), '[^/](\\.[^./]+)$', 1) IN ({image}) THEN 'image'
 WHEN regexp_extract(lower(path), '[^/](\\.[^./]+)$', 1) IN ({audio}) THEN 'audio' ELSE 'file' END""".format(
    **{k: ", ".join(f"'{x}'" for x in v) for k, v in media.MEDIA.items()}
)


@query(f"SELECT {MEDIA_SQL} AS media_type, count(*) AS files, sum(size)::BIGINT AS bytes FROM files GROUP BY 1")
def media_types(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files", "path", "size")
    return files.groupBy(media.media_type(F.col("path")).alias("media_type")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(f"""
WITH claims AS (
  SELECT f.path, r.root, row_number() OVER (PARTITION BY f.path ORDER BY r.position, r.root) AS nth
  FROM files f JOIN roots r ON f.path = r.root OR starts_with(f.path, r.root || '/')
  WHERE {MEDIA_SQL.replace("path", "f.path")} <> 'file'
)
SELECT root, count(*) AS files FROM claims WHERE nth = 1 GROUP BY root
""")
def first_root_wins(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files", "path").where(media.has_extension(F.col("path")))
    owned = owned_by_first_root(files, table(spark, folder, "roots", "root", "position"))
    return owned.groupBy("root").agg(F.count("*").alias("files"))


@query("""
SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS files,
  len(string_split(trim(regexp_replace(path, '/[^/]*$', ''), '/'), '/')) AS depth
FROM files GROUP BY ALL
""")
def source_folders(spark: SparkSession, folder: str) -> DataFrame:
    return planning.source_folders(table(spark, folder, "files", "path"))


# Similarity joins


@query("""
SELECT a.ord AS ord_a, b.ord AS ord_b,
  0.8 * (100.0 * (1.0 - bit_count(xor(a.image_fingerprint[1], b.image_fingerprint[1])) / 64.0::DOUBLE)) + 0.2 * (100.0 * (1.0 -
  (abs(a.image_fingerprint[2] - b.image_fingerprint[2]) + abs(a.image_fingerprint[3] - b.image_fingerprint[3]) + abs(a.image_fingerprint[4] - b.image_fingerprint[4])) / 765.0::DOUBLE)) AS similarity
FROM files a JOIN files b ON a.ord < b.ord AND len(a.image_fingerprint) = 4 AND len(b.image_fingerprint) = 4
  AND bit_count(xor(a.image_fingerprint[1], b.image_fingerprint[1])) <= 8 AND NOT coalesce(a.full_hash = b.full_hash, false)
WHERE similarity >= 90
""")
def image_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return matching.image_matches(table(spark, folder, "files", "ord", "full_hash", "image_fingerprint"))


@query("""
WITH t AS (SELECT ord, full_hash, duration, audio_fingerprint AS w, len(audio_fingerprint) AS n FROM files
  WHERE len(audio_fingerprint) > 0 AND duration IS NOT NULL AND duration::VARCHAR <> 'nan'),
p AS (SELECT a.ord AS ord_a, b.ord AS ord_b, a.w AS aw, b.w AS bw, a.n AS an, b.n AS bn, unnest(range(-8, 9)) AS s FROM t a
  JOIN t b ON a.ord < b.ord AND abs(a.duration - b.duration) <= 3.0 AND NOT coalesce(a.full_hash = b.full_hash, false)),
o AS (SELECT *, greatest(0, s) AS ia, greatest(0, -s) AS ib, least(an - greatest(0, s), bn - greatest(0, -s)) AS o FROM p),
d AS (SELECT ord_a, ord_b, 100.0 * (1.0 - list_sum(list_transform(range(1, o + 1), lambda i: bit_count(xor(aw[ia + i], bw[ib + i]))))::DOUBLE / (o * 32)) AS score
  FROM o WHERE o >= greatest(1, floor(least(an, bn) * 0.9::DOUBLE)))
SELECT ord_a, ord_b, max(score) AS similarity FROM d GROUP BY ord_a, ord_b HAVING max(score) >= 94
""")
def audio_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return matching.audio_matches(table(spark, folder, "files", "ord", "full_hash", "duration", "audio_fingerprint"))


@query("""
WITH v AS (SELECT ord, full_hash, duration FROM files
  WHERE len(fingerprint) > 0 AND fingerprint_version = 2 AND duration > 0 AND duration::VARCHAR <> 'nan')
SELECT a.ord, count(*) AS candidates FROM v a JOIN v b ON a.ord <> b.ord AND greatest(a.duration, b.duration) / least(a.duration, b.duration) <= 1.5
  AND greatest(a.duration, b.duration) - least(a.duration, b.duration) <= 900 AND NOT coalesce(a.full_hash = b.full_hash, false)
WHERE a.ord % 100 = 0 GROUP BY a.ord
""")
def video_candidates(spark: SparkSession, folder: str) -> DataFrame:
    rows = matching.videos(table(spark, folder, "files", "ord", "full_hash", "duration", "fingerprint", "fingerprint_version")).drop("words")
    pairs = matching.video_candidates(rows.where("ord % 100 = 0"), rows)
    return pairs.groupBy(F.col("ord_a").alias("ord")).agg(F.count("*").alias("candidates"))


VIDEOS_SQL = """SELECT ord, full_hash, duration, fingerprint AS words FROM files
  WHERE len(fingerprint) > 0 AND fingerprint_version = 2 AND duration > 0 AND duration::VARCHAR <> 'nan'"""
COMPATIBLE_SQL = "greatest(a.duration, b.duration) / least(a.duration, b.duration) <= 1.5 AND greatest(a.duration, b.duration) - least(a.duration, b.duration) <= 900"


def sequence_sql(pairs: str, bits: int) -> str:
    """Common tables that end in ``scores`` (ord_a, ord_b, similarity) of ``pairs`` (ord_a, ord_b, aw, bw) with frames within ``bits``.

    ``state[j + 1][k + 1]`` is the best total of k matches among the frames seen so far and the first j of the other side.
    """
    return f"""near AS (SELECT *, len(aw) AS n, len(bw) AS l, least(len(aw), len(bw)) AS s FROM ({pairs})
  WHERE list_min(list_transform(aw, lambda x: list_min(list_transform(bw, lambda y: bit_count(xor(x, y)))))) <= {bits}),
dp AS (SELECT ord_a, ord_b, aw, bw, n, l, s, 0 AS i, list_transform(range(0, l + 1), lambda j: list_transform(range(0, s + 1), lambda k: CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE -1e18::DOUBLE END)) AS state FROM near
  UNION ALL SELECT ord_a, ord_b, aw, bw, n, l, s, i + 1, list_transform(range(0, l + 1), lambda j: list_transform(range(0, s + 1), lambda k:
    CASE WHEN k = 0 THEN 0.0::DOUBLE WHEN j = 0 THEN -1e18::DOUBLE ELSE greatest(state[j + 1][k + 1],
      list_max(list_transform(range(1, j + 1), lambda q: state[q][k] + 100.0::DOUBLE * (1.0::DOUBLE - bit_count(xor(aw[i + 1], bw[q])) / 64.0::DOUBLE)))) END)) FROM dp WHERE i < n),
scores AS (SELECT ord_a, ord_b, greatest(0.0::DOUBLE, list_max(list_transform(range(greatest(1, ceil(s * 0.6::DOUBLE)::BIGINT), s + 1),
  lambda m: state[l + 1][m + 1] / m - (1.0::DOUBLE - m / s::DOUBLE) * 20.0::DOUBLE))) AS similarity FROM dp WHERE i = n)"""


_SEARCHED_SQL = f"""SELECT a.ord AS ord_a, b.ord AS ord_b, a.words AS aw, b.words AS bw FROM ({VIDEOS_SQL}) a JOIN ({VIDEOS_SQL}) b
  ON a.ord <> b.ord AND {COMPATIBLE_SQL} AND NOT coalesce(a.full_hash = b.full_hash, false) WHERE a.ord % 100 = 0"""


@query(f"""
WITH RECURSIVE {sequence_sql(_SEARCHED_SQL, 22)},
d AS (SELECT s.*, abs(a.duration - b.duration) AS delta FROM scores s JOIN files a ON a.ord = ord_a JOIN files b ON b.ord = ord_b)
SELECT *, similarity < 85 AND delta > 0.05 AND delta <= 180 AS recheck FROM d WHERE similarity >= 85 OR similarity >= 65 AND delta > 0.05 AND delta <= 180
""")
def video_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = matching.videos(table(spark, folder, "files", "ord", "full_hash", "duration", "fingerprint", "fingerprint_version"))
    return matching.video_matches(rows.where("ord % 100 = 0"), rows, recheck=True)


# Names

# DuckDB's expressions know no looking around: edges of words are taken in and put back, twice, as neighbours share one
_EDGE, _SPACE = r"[^\p{L}\p{N}_]", r"[\t-\r\x{85}\p{Z}]"


def _words_sql(text: str, words: str) -> str:
    once = f"regexp_replace({text}, '(^|{_EDGE})(?i:{words})({_EDGE}|$)', '\\1 \\2', 'g')"
    return f"regexp_replace({once}, '(^|{_EDGE})(?i:{words})({_EDGE}|$)', '\\1 \\2', 'g')"


_NUMBER_SQL = "TRY_CAST(translate({}, '０１２３４５６７８９', '0123456789') AS INT)"
_EPISODE_SQL = rf"(?i)(?:^|{_SPACE}|[._-])(?:e|ep|episode)?{_SPACE}*0*(\p{{Nd}}{{1,4}})(?:v\p{{Nd}}+)?(?:{_SPACE}|[._-]|$)"
_YEAR_SQL = r"(?:^|[^\p{Nd}])((?:19|20)\p{Nd}{2})(?:[^\p{Nd}]|$)"
TITLES_SQL = rf"""
WITH w AS (SELECT ord, raw_name AS raw, translate(raw_name, '_.', '  ') AS spaced FROM files),
y AS (SELECT *, {_NUMBER_SQL.format(f"regexp_extract(spaced, '{_YEAR_SQL}', 1)")} AS year,
  string_split(regexp_replace(spaced, '{_EPISODE_SQL}', chr(1) || '\0' || chr(1) || '\1' || chr(1), 'g'), chr(1)) AS parts FROM w),
k AS (SELECT *, list_max(list_filter(range(1, (len(parts) - 1) // 3 + 1), lambda i:
  NOT coalesce({_NUMBER_SQL.format("parts[3 * i]")} IN ({", ".join(map(str, NOT_EPISODES))}), false)
  AND {_NUMBER_SQL.format("parts[3 * i]")} IS DISTINCT FROM coalesce(year, -1))) AS place FROM y),
t AS (SELECT *, CASE WHEN place IS NULL THEN spaced ELSE array_to_string(list_transform(parts, lambda x, i:
  CASE WHEN i = 3 * place - 1 THEN ' ' WHEN i % 3 = 0 THEN '' ELSE x END), '') END AS cut FROM k),
q AS (SELECT *, {_words_sql(f"regexp_replace(cut, '{BRACKETED}', ' ', 'g')", QUALITY_WORDS)} AS plain FROM t),
f AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(plain, '{_YEAR_SQL}', ' ', 'g'), '[-–—|]+', ' ', 'g'), '{_SPACE}+', ' ', 'g'), ' ') AS title FROM q)
SELECT ord, CASE WHEN raw IS NOT NULL THEN CASE WHEN title = '' THEN raw ELSE title END END AS core_title, year,
  CASE WHEN place IS NOT NULL THEN {_NUMBER_SQL.format("parts[3 * place]")} END AS episode,
  CASE WHEN raw IS NOT NULL THEN array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(spaced, '(^|{_EDGE})(?i:{w})({_EDGE}|$)') THEN '{w}' END" for w in FLAG_WORDS)}], lambda x: x IS NOT NULL), '|') END AS flags,
  CASE WHEN raw IS NOT NULL THEN 'fallback' END AS source
FROM f
"""


@query(TITLES_SQL)
def title_normalize(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files", "ord", "raw_name").withColumn("name", normalized_name("raw_name"))
    return files.select("ord", "name.core_title", "name.year", "name.episode", F.array_join("name.flags", "|").alias("flags"), "name.source")


@query(rf"""
WITH b AS (SELECT ord, raw_name AS raw, coalesce(trim(string_split(path, '/')[-2], ' '), '') AS folder,
  {_words_sql(_words_sql(f"regexp_replace(raw_name, '{BRACKETED}', ' ', 'g')", QUALITY_WORDS), GENERIC_WORDS)} AS rest FROM files)
SELECT ord, CASE WHEN regexp_matches(regexp_replace(rest, '\p{{Nd}}+|[^\p{{L}}\p{{N}}_]+', ' ', 'g'), '^[ _]*$') AND folder <> '' THEN folder || ' - ' || raw ELSE raw END AS name
FROM b
""")
def contextual_names(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files", "ord", "raw_name", "path")
    return files.select("ord", contextual_name(F.col("raw_name"), F.col("path")).alias("name"))


@query("""
SELECT (row_number() OVER (ORDER BY raw_name) - 1) // 150 AS batch, raw_name AS name
FROM (SELECT DISTINCT raw_name FROM files WHERE raw_name IS NOT NULL)
""")
def name_batches(spark: SparkSession, folder: str) -> DataFrame:
    return naming.name_batches(table(spark, folder, "files", "raw_name").withColumnRenamed("raw_name", "name"))


@query("""
SELECT f.ord, n.core_title, n.year, n.episode FROM files f JOIN name_cache n ON n.raw_name = f.raw_name
WHERE n.provider = 'fallback' AND n.prompt_hash = '9b1d40c2e7aa'
""")
def stored_name_lookup(spark: SparkSession, folder: str) -> DataFrame:
    names = naming.stored_names(table(spark, folder, "name_cache"), provider="fallback", prompt_hash="9b1d40c2e7aa")
    files = table(spark, folder, "files", "ord", "raw_name")
    return files.join(names, "raw_name").select("ord", "core_title", "year", "episode")


def _titled(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "name_cache", "raw_name", "core_title", "year", "episode")
    return table(spark, folder, "files", "ord", "path", "raw_name").join(names, "raw_name", "left")


ACCEPTED_SQL = """SELECT "left", "right", similarity, level FROM video_matches WHERE "left" <> "right" AND similarity >= 85 AND similarity::VARCHAR <> 'nan'"""
CONFIRMED_SQL = f"""
SELECT path FROM files WHERE full_hash IN (SELECT full_hash FROM files WHERE full_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION SELECT "left" FROM ({ACCEPTED_SQL}) UNION SELECT "right" FROM ({ACCEPTED_SQL})
"""


def _accepted(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "video_matches", "left", "right", "similarity", "level").where("`left` <> `right` and similarity >= 85 and not isnan(similarity)")


def _confirmed(spark: SparkSession, folder: str) -> DataFrame:
    matches = _accepted(spark, folder)
    same = exact.collided(table(spark, folder, "files", "path", "full_hash"), "full_hash").select("path")
    return same.union(matches.select("left")).union(matches.select("right")).distinct()


@query(CONFIRMED_SQL)
def confirmed_paths(spark: SparkSession, folder: str) -> DataFrame:
    return _confirmed(spark, folder)


@query(f"""
WITH t AS (SELECT f.ord, f.path, n.core_title, lower(trim(n.core_title, ' ')) AS title, n.year, n.episode
  FROM files f JOIN name_cache n ON n.raw_name = f.raw_name WHERE f.path NOT IN ({CONFIRMED_SQL}))
SELECT 'name:' || title || '|' || coalesce(year::VARCHAR, 'None') || '|' || coalesce(episode::VARCHAR, 'None') AS key, 100.0::DOUBLE AS similarity,
  arg_min(core_title, ord) AS title, year, episode, count(*) AS files
FROM t WHERE title <> '' GROUP BY t.title, year, episode HAVING count(*) > 1
""")
def name_hints_exact(spark: SparkSession, folder: str) -> DataFrame:
    return naming.exact_hints(_titled(spark, folder), _confirmed(spark, folder))


def _common_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts of up to 120 letters, one bit per letter of ``a``."""
    masks = f"list_transform(string_split({b}, ''), lambda c: list_sum(list_transform(range(0, len({a})), lambda i: CASE WHEN ({a})[i + 1] = c THEN (1::HUGEINT << i::INT) ELSE 0::HUGEINT END))::HUGEINT)"
    return f"bit_count(list_reduce([0::HUGEINT] || {masks}, lambda r, m: ((r | m) & ~((r | m) - ((r << 1) | 1::HUGEINT))) & ((1::HUGEINT << len({a})::INT) - 1)))"


def _ratio_sql(a: str, b: str) -> str:
    return f"200.0::DOUBLE * {_common_sql(a, b)} / (len({a}) + len({b}))"


FUZZY_SQL = f"""
WITH k AS (SELECT DISTINCT lower(trim(core_title, ' ')) AS title, year, episode FROM name_cache WHERE trim(core_title, ' ') <> ''),
w AS (SELECT *, list_sort(list_distinct(list_filter(string_split_regex(title, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'), lambda x: x <> ''))) AS words FROM k),
p AS (SELECT a.title AS left_title, b.title AS right_title, a.year, a.episode, list_sort(list_filter(a.words, lambda x: list_contains(b.words, x))) AS shared,
  list_filter(a.words, lambda x: NOT list_contains(b.words, x)) AS la, list_filter(b.words, lambda x: NOT list_contains(a.words, x)) AS lb
  FROM w a JOIN w b ON a.title < b.title AND a.year IS NOT DISTINCT FROM b.year AND a.episode IS NOT DISTINCT FROM b.episode
  WHERE len(a.words) > 0 AND len(b.words) > 0),
t AS (SELECT *, array_to_string(shared, ' ') AS s, array_to_string(shared || la, ' ') AS x, array_to_string(shared || lb, ' ') AS y FROM p WHERE len(la) > 0 AND len(lb) > 0),
b AS (SELECT * FROM t WHERE 200.0 * least(len(x), len(y)) / (len(x) + len(y)) >= 92 OR len(s) > 0 AND 200.0 * len(s) / (len(s) + least(len(x), len(y))) >= 92),
r AS (SELECT left_title, right_title, year, episode, greatest({_ratio_sql("x", "y")},
  CASE WHEN len(s) > 0 THEN {_ratio_sql("s", "x")} ELSE 0 END, CASE WHEN len(s) > 0 THEN {_ratio_sql("s", "y")} ELSE 0 END) AS similarity FROM b)
SELECT * FROM r WHERE similarity >= 92 AND similarity < 100
"""


@query(FUZZY_SQL)
def name_hints_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "name_cache", "name_id", "core_title", "year", "episode")
    keys = naming.name_keys(names)
    return naming.fuzzy_hints(keys, keys).where("left_title < right_title")


# Clusters and folders

CLUSTERS_SQL = f"""
WITH RECURSIVE m AS ({ACCEPTED_SQL}),
i AS (SELECT m.* FROM m WHERE "left" IN (SELECT path FROM files) AND "right" IN (SELECT path FROM files)),
x AS (SELECT path, min(path) OVER (PARTITION BY full_hash) AS first, count(*) OVER (PARTITION BY full_hash) AS n FROM files WHERE full_hash IS NOT NULL),
e AS (SELECT first AS a, path AS b FROM x WHERE n > 1 UNION SELECT "left", "right" FROM i),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, other) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM reach r JOIN l ON l.a = r.other),
parts AS (SELECT node AS path, min(other) AS component FROM reach GROUP BY node),
evidence AS (SELECT component, count(DISTINCT level) AS kinds, min(level) AS kind, min(similarity) AS least FROM i JOIN parts ON parts.path = i."left" GROUP BY component),
c AS (SELECT path, component, CASE WHEN kinds IS NULL THEN 'exact' WHEN kinds > 1 THEN 'content' ELSE kind END AS level, coalesce(least, 100.0) AS confidence FROM parts LEFT JOIN evidence USING (component)),
n AS (SELECT f.path, f.root, CASE WHEN lower(trim(n.core_title, ' ')) <> '' THEN 'name:' || lower(trim(n.core_title, ' ')) || '|' || coalesce(year::VARCHAR, 'None') || '|' || coalesce(episode::VARCHAR, 'None') END AS name_id
  FROM files f LEFT JOIN name_cache n ON n.raw_name = f.raw_name),
clusters AS (SELECT n.path, n.root, CASE WHEN c.path IS NOT NULL THEN c.level || ':' || c.component WHEN name_id IS NOT NULL THEN name_id ELSE 'path:' || n.path END AS cluster_id,
  CASE WHEN c.path IS NOT NULL THEN c.level WHEN name_id IS NOT NULL THEN 'name' ELSE 'path' END AS level,
  CASE WHEN c.path IS NOT NULL THEN c.confidence WHEN name_id IS NOT NULL THEN 70.0 ELSE 0.0 END::DOUBLE AS confidence
  FROM n LEFT JOIN c ON c.path = n.path)
"""


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files", "path", "root", "full_hash")
    same = exact.collided(files, "full_hash").select(F.col("full_hash").alias("hash_value"), "path")
    # read several times by what follows
    return stage(clusters.assignments(files, same, _accepted(spark, folder), _titled(spark, folder)), "clusters")


@query(CLUSTERS_SQL + "SELECT * FROM clusters")
def file_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return _clusters(spark, folder)


OVERLAP_SQL = CLUSTERS_SQL + """,
s AS (SELECT DISTINCT root, cluster_id AS id FROM clusters),
u AS (SELECT DISTINCT root, CASE WHEN level IN ('name', 'path') THEN 'unconfirmed:' || path ELSE cluster_id END AS id FROM clusters),
sp AS (SELECT a.root AS "left", b.root AS "right", count(*) AS shared FROM s a JOIN s b ON a.id = b.id AND a.root < b.root GROUP BY ALL),
up AS (SELECT a.root AS "left", b.root AS "right", count(*) AS shared FROM u a JOIN u b ON a.id = b.id AND a.root < b.root GROUP BY ALL),
sn AS (SELECT root, count(*) AS n FROM s GROUP BY root), un AS (SELECT root, count(*) AS n FROM u GROUP BY root),
o AS (SELECT sp."left", sp."right", coalesce(up.shared, 0) AS content_shared, ul.n AS content_left, ur.n AS content_right,
  sp.shared AS name_shared, sl.n AS name_left, sr.n AS name_right FROM sp LEFT JOIN up ON up."left" = sp."left" AND up."right" = sp."right"
  JOIN sn sl ON sl.root = sp."left" JOIN sn sr ON sr.root = sp."right" JOIN un ul ON ul.root = sp."left" JOIN un ur ON ur.root = sp."right"),
pairs AS (SELECT *, 100.0 * content_shared / (content_left + content_right - content_shared)::DOUBLE AS content_similarity,
  100.0 * name_shared / (name_left + name_right - name_shared)::DOUBLE AS name_similarity FROM o)
"""


@query(OVERLAP_SQL + "SELECT * FROM pairs WHERE content_similarity >= 1 OR name_similarity >= 1")
def folder_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.folder_pairs(_clusters(spark, folder), 1.0)


@query(OVERLAP_SQL + """
SELECT p."left", p."right", c.path FROM pairs p JOIN clusters c ON c.root = p."left"
WHERE (content_similarity >= 1 OR name_similarity >= 1) AND NOT EXISTS (SELECT 1 FROM clusters o WHERE o.root = p."right" AND o.cluster_id = c.cluster_id)
""")
def folder_left_only(spark: SparkSession, folder: str) -> DataFrame:
    found = _clusters(spark, folder)
    return clusters.one_sided(found, clusters.folder_pairs(found, 1.0), "left")


@query(OVERLAP_SQL + """
SELECT p."left", p."right", a.cluster_id, a.level, a.level NOT IN ('name', 'path') AS content_backed, a.files AS left_files, b.files AS right_files
FROM pairs p JOIN (SELECT root, cluster_id, level, count(*) AS files FROM clusters GROUP BY ALL) a ON a.root = p."left"
JOIN (SELECT root, cluster_id, count(*) AS files FROM clusters GROUP BY ALL) b ON b.root = p."right" AND b.cluster_id = a.cluster_id
WHERE content_similarity >= 1 OR name_similarity >= 1
""")
def folder_matched(spark: SparkSession, folder: str) -> DataFrame:
    found = _clusters(spark, folder)
    return clusters.matched_clusters(found, clusters.folder_pairs(found, 1.0))


# The store


@query("""
SELECT count(*) AS files, count(full_hash) AS hashed, count(duration) AS with_duration, count(fingerprint) AS video_fingerprints,
  count(image_fingerprint) AS image_fingerprints, count(audio_fingerprint) AS audio_fingerprints,
  count(*) FILTER (fingerprint IS NOT NULL AND fingerprint_version = 2) AS current_video_fingerprints FROM files
""")
def cache_stats(spark: SparkSession, folder: str) -> DataFrame:
    return store.statistics(table(spark, folder, "files"))


@query("SELECT expected_hash_algorithm AS algorithm, count(*) AS n FROM operations WHERE expected_hash_algorithm IS NOT NULL GROUP BY 1")
def hash_algo_counts(spark: SparkSession, folder: str) -> DataFrame:
    return store.counts_by(table(spark, folder, "operations").withColumnRenamed("expected_hash_algorithm", "algorithm"), "algorithm")


@query("SELECT provider, model, prompt_hash, count(*) AS n FROM name_cache GROUP BY ALL")
def provider_counts(spark: SparkSession, folder: str) -> DataFrame:
    return store.counts_by(table(spark, folder, "name_cache"), "provider", "model", "prompt_hash")


@query("""
WITH scanned AS (SELECT path, size + (CASE WHEN ord % 7 = 0 THEN 1 ELSE 0 END) AS size, mtime + (CASE WHEN ord % 11 = 0 THEN 60 ELSE 0 END) AS mtime FROM files),
j AS (SELECT s.path, s.size = f.size AND abs(s.mtime - f.mtime) <= 1e-6 AS reused, f.full_hash, f.duration, f.fingerprint, f.fingerprint_version FROM scanned s JOIN files f ON f.path = s.path)
SELECT path, reused, CASE WHEN reused THEN full_hash END AS full_hash, CASE WHEN reused THEN duration END AS duration,
  coalesce(reused AND fingerprint_version = 2 AND fingerprint IS NOT NULL, false) AS has_video FROM j
""")
def incremental_reuse(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "files", "ord", "path", "size", "mtime", "raw_name", "full_hash", "duration", "fingerprint", "fingerprint_version")
    scanned = stored.select("path", (F.col("size") + F.when(F.col("ord") % 7 == 0, 1).otherwise(0)).alias("size"), (F.col("mtime") + F.when(F.col("ord") % 11 == 0, 60).otherwise(0)).alias("mtime"), "raw_name")
    found = store.hydrated(scanned, stored)
    return found.select("path", "reused", "full_hash", "duration", F.col("fingerprint").isNotNull().alias("has_video"))


@query("""
WITH up AS (SELECT raw_name, name_id, 'refreshed: ' || core_title AS core_title FROM name_cache WHERE provider = 'remote'
  UNION ALL SELECT DISTINCT i.raw_name, NULL, NULL FROM incoming_files i WHERE i.raw_name NOT IN (SELECT raw_name FROM name_cache))
SELECT raw_name, name_id, core_title FROM name_cache WHERE raw_name NOT IN (SELECT raw_name FROM up) UNION ALL SELECT * FROM up
""")
def name_upsert(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "name_cache", "raw_name", "name_id", "core_title", "provider")
    again = names.where("provider = 'remote'").select("raw_name", "name_id", F.concat(F.lit("refreshed: "), "core_title").alias("core_title"))
    fresh = table(spark, folder, "incoming_files", "raw_name").distinct().join(names, "raw_name", "left_anti")
    return store.upserted(names.drop("provider"), again.unionByName(fresh, allowMissingColumns=True), "raw_name")


@query("""
SELECT path, full_hash, CASE WHEN b THEN NULL ELSE duration END AS duration, CASE WHEN b THEN NULL ELSE fingerprint_version END AS fingerprint_version
FROM (SELECT *, root = (SELECT root FROM roots ORDER BY position LIMIT 1) AS b FROM files)
""")
def cache_invalidation(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files", "path", "root", "full_hash", "duration", "fingerprint_version")
    first = table(spark, folder, "roots").orderBy("position").limit(1).select("root")
    return store.cleared(files, files.join(F.broadcast(first), "root", "left_semi"), "video").drop("root")


# Thresholds

SCORES_SQL = """(SELECT duration_delta <= 1.0 AS expected, similarity, similarity AS raw_similarity, duration_delta <= 3.0 AS eligible
  FROM video_matches WHERE similarity IS NOT NULL AND similarity::VARCHAR <> 'nan')"""


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "video_matches", "similarity", "duration_delta").where("similarity is not null and not isnan(similarity)")
    return rows.select((F.col("duration_delta") <= 1.0).alias("expected"), "similarity", F.col("similarity").alias("raw_similarity"), (F.col("duration_delta") <= 3.0).alias("eligible"))


@query(f"""
SELECT 85.0::DOUBLE AS threshold, *, 5 * fp + fn AS weighted_errors FROM (SELECT count(*) FILTER (expected AND similarity >= 85) AS tp, count(*) FILTER (NOT expected AND similarity >= 85) AS fp,
  count(*) FILTER (NOT expected AND similarity < 85) AS tn, count(*) FILTER (expected AND similarity < 85) AS fn FROM {SCORES_SQL})
""")
def threshold_confusion(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.evaluate_threshold(_scores(spark, folder), 85.0)


@query(f"""
WITH s AS {SCORES_SQL}, e AS (SELECT similarity AS mark, count(*) FILTER (expected) AS p, count(*) FILTER (NOT expected) AS n FROM s GROUP BY 1),
c AS (SELECT DISTINCT mark FROM (SELECT greatest(0, least(100, similarity)) AS mark FROM s UNION ALL SELECT least(100, greatest(0, least(100, similarity)) + 0.01::DOUBLE) FROM s
  UNION ALL SELECT unnest([0.0::DOUBLE, 100, 85]))),
k AS (SELECT c.mark, coalesce(sum(p) FILTER (e.mark >= c.mark), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (e.mark >= c.mark), 0)::BIGINT AS fp,
  coalesce(sum(n) FILTER (e.mark < c.mark), 0)::BIGINT AS tn, coalesce(sum(p) FILTER (e.mark < c.mark), 0)::BIGINT AS fn FROM c, e GROUP BY c.mark)
SELECT round(mark, 2) AS threshold, tp, fp, tn, fn, 5 * fp + fn AS weighted_errors FROM k ORDER BY 5 * fp + fn, fp, fn, abs(round(mark, 2) - 85), -round(mark, 2) LIMIT 1
""")
def threshold_recommend(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.recommend_threshold(_scores(spark, folder), 85.0)


@query(f"""
SELECT count(*) FILTER (expected) AS positives, count(*) FILTER (NOT expected) AS negatives, min(similarity) FILTER (expected) AS min_positive,
  max(similarity) FILTER (NOT expected) AS max_negative, min(raw_similarity) FILTER (expected) AS min_raw_positive, max(raw_similarity) FILTER (NOT expected) AS max_raw_negative,
  count(*) FILTER (expected AND NOT eligible) AS ineligible_positives, count(*) FILTER (NOT expected AND NOT eligible) AS ineligible_negatives,
  count(*) FILTER (expected AND similarity >= 85) AS tp, count(*) FILTER (NOT expected AND similarity >= 85) AS fp,
  count(*) FILTER (NOT expected AND similarity < 85) AS tn, count(*) FILTER (expected AND similarity < 85) AS fn FROM {SCORES_SQL}
""")
def score_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.summarize(_scores(spark, folder), 85.0)


# The journal

LATEST_SQL = "(SELECT DISTINCT ON (operation_id) * FROM operations ORDER BY operation_id, logged_at DESC, finished_at DESC NULLS LAST, status DESC)"


def _operations(spark: SparkSession, folder: str) -> DataFrame:
    return journal.latest(table(spark, folder, "operations"))


@query(f"SELECT operation_id, action, status, source, destination, requested_at, finished_at, group_id FROM {LATEST_SQL}")
def journal_latest(spark: SparkSession, folder: str) -> DataFrame:
    return _operations(spark, folder).select("operation_id", "action", "status", "source", "destination", "requested_at", "finished_at", "group_id")


@query(f"SELECT operation_id, action, status, requested_at FROM {LATEST_SQL} ORDER BY requested_at DESC, operation_id LIMIT 500")
def recent_operations(spark: SparkSession, folder: str) -> DataFrame:
    return journal.recent(_operations(spark, folder)).select("operation_id", "action", "status", "requested_at")


@query(f"""
SELECT group_id, arg_max(action, (requested_at, operation_id)) AS action, arg_max(status, (requested_at, operation_id)) AS status
FROM {LATEST_SQL} WHERE group_id IS NOT NULL GROUP BY group_id
""")
def latest_decision(spark: SparkSession, folder: str) -> DataFrame:
    return journal.decisions(_operations(spark, folder))


BATCHES_SQL = f"""o AS {LATEST_SQL},
moves AS (SELECT *, coalesce(group_id, 'single:' || operation_id) AS batch_id FROM o WHERE action = 'move'),
batches AS (SELECT batch_id, min(requested_at) AS created_at, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'requested') THEN 'running' WHEN bool_and(status = 'skipped') THEN 'rolled back' ELSE 'completed' END AS status FROM moves GROUP BY 1)"""


def _batches(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    # a move of no group is a batch of its own
    moves = _operations(spark, folder).where("action = 'move'").withColumn("batch_id", F.coalesce("group_id", F.concat(F.lit("single:"), "operation_id")))
    has = lambda s: F.max(F.col("status") == s)
    status = F.when(has("failed"), "failed").when(has("requested"), "running").when(F.min(F.col("status") == "skipped"), "rolled back").otherwise("completed")
    return moves.groupBy("batch_id").agg(F.min("requested_at").alias("created_at"), status.alias("status")), moves


@query(f"""
WITH {BATCHES_SQL} SELECT b.batch_id, b.created_at, b.status, count(*) AS moves FROM batches b JOIN moves m ON m.batch_id = b.batch_id AND m.status = 'completed'
WHERE b.status IN ('completed', 'running', 'failed') GROUP BY ALL
""")
def undoable_batches(spark: SparkSession, folder: str) -> DataFrame:
    return journal.undoable_batches(*_batches(spark, folder))


@query(f"""
WITH {BATCHES_SQL} SELECT b.batch_id, b.created_at, b.status, count(*) AS moves FROM batches b JOIN moves m ON m.batch_id = b.batch_id AND m.status = 'completed'
WHERE b.status IN ('completed', 'running', 'failed') GROUP BY ALL ORDER BY created_at DESC, batch_id LIMIT 1
""")
def latest_undoable(spark: SparkSession, folder: str) -> DataFrame:
    return journal.latest_undoable(*_batches(spark, folder))


@query(f"WITH {BATCHES_SQL} SELECT batch_id, operation_id, row_number() OVER (PARTITION BY batch_id ORDER BY requested_at, operation_id) - 1 AS sequence FROM moves")
def move_sequence(spark: SparkSession, folder: str) -> DataFrame:
    return journal.sequenced(_batches(spark, folder)[1], "batch_id", "requested_at", "operation_id").select("batch_id", "operation_id", "sequence")


@query(f"""
SELECT operation_id, row_number() OVER (PARTITION BY coalesce(group_id, 'none'), source ORDER BY requested_at, operation_id) > 1 AS skipped FROM {LATEST_SQL}
""")
def repeated_sources(spark: SparkSession, folder: str) -> DataFrame:
    jobs = _operations(spark, folder).withColumn("batch_id", F.coalesce("group_id", F.lit("none")))
    return journal.repeated_sources(jobs, "batch_id", "requested_at", "operation_id").select("operation_id", "skipped")


@query("""
WITH k AS (SELECT *, min(ord) OVER (PARTITION BY raw_name) AS keeper_ord FROM files)
SELECT f.raw_name, f.keeper_ord, f.ord, coalesce(f.size = g.size AND f.full_hash = g.full_hash, false) AS matches
FROM k f JOIN files g ON g.ord = f.keeper_ord WHERE f.ord <> f.keeper_ord
""")
def keeper_identity(spark: SparkSession, folder: str) -> DataFrame:
    return journal.keeper_checks(table(spark, folder, "files", "ord", "raw_name", "size", "full_hash"), "raw_name")


@query(f"""
SELECT action, status, count(*) AS operations, count(finished_at) AS finished, count(*) FILTER (reversible <> 0) AS reversible,
  round(sum(coalesce(finished_at - requested_at, 0)), 3) AS seconds FROM {LATEST_SQL} GROUP BY ALL
""")
def outcome_rates(spark: SparkSession, folder: str) -> DataFrame:
    return journal.outcome_rates(_operations(spark, folder)).withColumn("seconds", F.round("seconds", 3))


# Plans

@query("""
WITH m AS (SELECT path AS source, '/library/' || string_split(path, '/')[3] || '/' || string_split(path, '/')[-1] AS destination, size FROM files),
w AS (SELECT destination, count(*) AS wanted FROM m GROUP BY 1), e AS (SELECT DISTINCT destination FROM operations WHERE destination IS NOT NULL)
SELECT source, m.destination, size, CASE WHEN source = m.destination THEN 'already in place' WHEN e.destination IS NOT NULL OR wanted > 1 THEN 'conflict' ELSE 'ready' END AS status
FROM m JOIN w ON w.destination = m.destination LEFT JOIN e ON e.destination = m.destination
""")
def move_plan(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files", "path", "size", "mtime")
    folders = files.select(paths.parent(F.col("path")).alias("folder")).distinct()
    mappings = folders.select("folder", F.lit("/library").alias("final_root"), F.split("folder", "/")[2].alias("destination"))
    existing = table(spark, folder, "operations", "destination").where("destination is not null").select(F.col("destination").alias("path"))
    return planning.move_plan(files, mappings, existing).drop("mtime")


@query("""
SELECT name_id, CASE WHEN v <> '' AND NOT regexp_matches(v, '[<>:"/\\\\|?*\\x00-\\x1f]') THEN v END AS folder
FROM (SELECT name_id, regexp_replace(trim(raw_name, ' '), '[. ]+$', '') AS v FROM name_cache)
""")
def folder_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "name_cache", "name_id", "raw_name").select("name_id", paths.folder_name(F.col("raw_name")).alias("folder"))


@query("""
SELECT operation_id, destination, sha1(action || chr(0) || source) AS digest,
  'operation:' || substr(sha256('operation' || chr(0) || source), 1, 16) AS item_id, 'custom-' || substr(sha1(action || chr(0) || status), 1, 8) AS preset
FROM (SELECT DISTINCT operation_id, action, status, source, destination FROM operations)
""")
def derived_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "operations", "operation_id", "action", "status", "source", "destination").distinct()
    return rows.select(
        "operation_id", "destination", F.sha1(F.concat_ws("\0", "action", "source")).alias("digest"),
        paths.group_id(F.lit("operation"), F.array("source")).alias("item_id"), paths.preset_id(F.lit("custom"), F.array("action", "status")).alias("preset"),
    )


@query("""
SELECT ord, '/quarantine/' || string_split(root, '/')[-1] || '-' || substr(sha256(lower(root)), 1, 8) || '/' ||
  CASE WHEN starts_with(path, root || '/') THEN substr(path, length(root) + 2) ELSE string_split(path, '/')[-1] END AS aside,
  regexp_replace(path, '\\.[^./]*$', '') || '.x265-slow.mkv' AS encoded FROM files
""")
def quarantine_paths(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files", "ord", "root", "path")
    return files.select("ord", paths.quarantine_path(F.lit("/quarantine"), F.col("root"), F.col("path")).alias("aside"), paths.output_path(F.col("path"), F.lit("x265-slow")).alias("encoded"))


# Review, compression and probes


@query("""
SELECT path, size, duration FROM files WHERE regexp_extract(lower(path), '[^/](\\.[^./]+)$', 1) IN ('.mkv', '.mp4')
  AND size / 1048576.0 >= 100 AND size / 1048576.0 <= 2000 AND coalesce(duration, 0) / 60.0 >= 10 AND coalesce(duration, 0) / 60.0 <= 60
""")
def compression_filter(spark: SparkSession, folder: str) -> DataFrame:
    return review.compression_filter(table(spark, folder, "files", "path", "size", "duration"), {".mkv", ".mp4"}, 100, 2000, 10, 60)


def _items(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact.exact_groups(table(spark, folder, "files", "ord", "path", "size", "full_hash"))
    matches = _accepted(spark, folder).distinct()
    pairs = clusters.folder_pairs(_clusters(spark, folder), 1.0)
    hints = naming.exact_hints(_titled(spark, folder), _confirmed(spark, folder))
    two = F.concat_ws("|", F.least("left", "right"), F.greatest("left", "right"))
    return review.review_items([
        review.item("exact", groups, F.array_join("paths", "|"), F.col("similarity"), F.col("hash_value"), F.desc("size")),
        *(review.item(level, matches.where(F.col("level") == level), two, F.col("similarity"), F.lit(level), F.desc("similarity")) for level in clusters.MEDIA),
        review.item("folder", pairs, two, F.greatest("content_similarity", "name_similarity"), F.lit("clusters in common"), F.desc("content_similarity")),
        review.item("name", hints, F.col("key"), F.col("similarity"), F.col("title"), F.desc("similarity")),
    ])


COUNTS_SQL = OVERLAP_SQL + f""",
hints AS (SELECT 1 FROM (SELECT lower(trim(n.core_title, ' ')) AS title, n.year, n.episode FROM files f JOIN name_cache n ON n.raw_name = f.raw_name
  WHERE f.path NOT IN ({CONFIRMED_SQL})) WHERE title <> '' GROUP BY title, year, episode HAVING count(*) > 1),
n AS (SELECT 'exact' AS category, count(*) AS n FROM (SELECT 1 FROM files WHERE full_hash IS NOT NULL GROUP BY full_hash HAVING count(*) > 1)
  UNION ALL SELECT v, (SELECT count(*) FROM (SELECT DISTINCT * FROM ({ACCEPTED_SQL})) WHERE level = v) FROM (SELECT unnest(['video', 'image', 'audio']) AS v)
  UNION ALL SELECT 'folder', count(*) FROM pairs WHERE content_similarity >= 1 OR name_similarity >= 1
  UNION ALL SELECT 'name', count(*) FROM hints)
"""


@query(COUNTS_SQL.replace("\nn AS (SELECT 'exact'", "\nkinds AS (SELECT 'exact'") + "SELECT category, n FROM kinds UNION ALL SELECT 'all', sum(n)::BIGINT FROM kinds")
def category_counts(spark: SparkSession, folder: str) -> DataFrame:
    return review.category_counts(_items(spark, folder))


@query(OVERLAP_SQL + f""",
same_hash AS (SELECT full_hash, count(*) AS n, string_agg(path, '|' ORDER BY path) AS paths FROM files WHERE full_hash IS NOT NULL GROUP BY full_hash HAVING count(*) > 1),
hinted AS (SELECT 'name:' || title || '|' || coalesce(year::VARCHAR, 'None') || '|' || coalesce(episode::VARCHAR, 'None') AS key, arg_min(core_title, ord) AS title
  FROM (SELECT f.ord, n.core_title, lower(trim(n.core_title, ' ')) AS title, n.year, n.episode FROM files f JOIN name_cache n ON n.raw_name = f.raw_name WHERE f.path NOT IN ({CONFIRMED_SQL})) AS x
  WHERE title <> '' GROUP BY x.title, year, episode HAVING count(*) > 1)
SELECT 'exact' AS category, paths, 100.0::DOUBLE AS confidence, full_hash AS evidence FROM same_hash
UNION ALL SELECT level, least("left", "right") || '|' || greatest("left", "right"), similarity, level FROM (SELECT DISTINCT * FROM ({ACCEPTED_SQL})) WHERE level IN ('video', 'image', 'audio')
UNION ALL SELECT 'folder', "left" || '|' || "right", greatest(content_similarity, name_similarity), 'clusters in common' FROM pairs WHERE content_similarity >= 1 OR name_similarity >= 1
UNION ALL SELECT 'name', key, 100.0, title FROM hinted
""")
def review_items(spark: SparkSession, folder: str) -> DataFrame:
    return _items(spark, folder)


@query("""
SELECT ord, 'matroska' AS container, CASE WHEN duration::VARCHAR <> 'nan' THEN duration END AS duration, size * 8 AS bit_rate, 2 AS streams, (ord % 3)::INT AS chapters,
  CASE WHEN ord % 4 = 0 THEN NULL ELSE 24000.0::DOUBLE / (1000 + ord % 4) END AS frame_rate, ord % 2 = 0 AS has_default
FROM files
""")
def probe_reports(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files", "ord", "size", "duration")
    number = F.when(~F.isnan("duration"), F.col("duration").cast("string"))
    rate = F.concat(F.lit("24000/"), F.when(F.col("ord") % 4 == 0, F.lit(0)).otherwise(1000 + F.col("ord") % 4).cast("string"))
    video = F.struct(F.lit("0").alias("index"), F.lit("video").alias("codec_type"), number.alias("duration"), rate.alias("avg_frame_rate"), F.struct((F.col("ord") % 2 == 0).cast("int").alias("default")).alias("disposition"))
    audio = F.struct(F.lit("1").alias("index"), F.lit("audio").alias("codec_type"), F.lit(None).cast("string").alias("duration"), F.lit(None).cast("string").alias("avg_frame_rate"), F.struct(F.lit(0).alias("default")).alias("disposition"))
    chapters = F.transform(F.slice(F.array(F.lit("1"), F.lit("2")), F.lit(1), (F.col("ord") % 3).cast("int")), lambda i: F.struct(i.alias("id")))
    report = F.to_json(F.struct(F.struct(F.lit("matroska").alias("format_name"), (F.col("size") * 8).cast("string").alias("bit_rate")).alias("format"), F.array(video, audio).alias("streams"), chapters.alias("chapters")))
    read = files.select("ord", media.probe(report).alias("p"))
    first = F.element_at(media.streams_of(F.col("p.streams"), "video"), 1)
    return read.select("ord", "p.container", "p.duration", "p.bit_rate", F.size("p.streams").alias("streams"), "p.chapters", first["frame_rate"].alias("frame_rate"), first["default"].alias("has_default"))


@query("""
SELECT operation_id, expected_size - (length(source) * 1000) AS saved_bytes, CASE WHEN expected_size > 0 THEN 100.0::DOUBLE * (expected_size - length(source) * 1000) / expected_size ELSE 0.0 END AS savings_percent
FROM (SELECT DISTINCT operation_id, source, expected_size FROM operations WHERE expected_size IS NOT NULL)
""")
def encode_savings(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "operations", "operation_id", "source", "expected_size").where("expected_size is not null").distinct()
    saved, percent = media.savings(F.col("expected_size"), F.length("source") * 1000)
    return rows.select("operation_id", saved.alias("saved_bytes"), percent.alias("savings_percent"))


@query("""
SELECT ord, CASE WHEN size >= 1099511627776 THEN printf('%.1f', size / 1099511627776.0::DOUBLE) || ' TiB' WHEN size >= 1073741824 THEN printf('%.1f', size / 1073741824.0::DOUBLE) || ' GiB' WHEN size >= 1048576 THEN printf('%.1f', size / 1048576.0::DOUBLE) || ' MiB' WHEN size >= 1024 THEN printf('%.1f', size / 1024.0::DOUBLE) || ' KiB' ELSE size || ' B' END AS size,
  CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) WHEN s IS NOT NULL THEN printf('%d:%02d', s // 60, s % 60) END AS length
FROM (SELECT ord, size, CASE WHEN duration::VARCHAR <> 'nan' THEN greatest(0, round_even(duration, 0))::BIGINT END AS s FROM files)
""")
def shown_sizes(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files", "ord", "size", "duration")
    return files.select("ord", media.human_size(F.col("size")).alias("size"), media.clock(F.col("duration")).alias("length"))


# The order of reports: their first rows, numbered

TOP = 100


def _numbered(rows: DataFrame) -> DataFrame:
    """The first TOP rows of an ordered table with their place from 1."""
    names = rows.columns
    return rows.limit(TOP).agg(F.collect_list(F.struct("*")).alias("r")).select(F.posexplode("r").alias("nth", "r")).select(F.expr("cast(nth + 1 as bigint)").alias("nth"), *(f"r.`{c}`" for c in names))


@query(f"""
SELECT row_number() OVER (ORDER BY round(similarity, 2) DESC, "left", "right") AS nth, "left", "right", level
FROM (SELECT "left", "right", level, max(similarity) AS similarity FROM ({ACCEPTED_SQL}) GROUP BY ALL) ORDER BY nth LIMIT {TOP}
""")
def match_order(spark: SparkSession, folder: str) -> DataFrame:
    best = _accepted(spark, folder).groupBy("left", "right", "level").agg(F.max("similarity").alias("similarity"))
    return _numbered(matching.in_order(best).select("left", "right", "level"))


@query(SQL["name_hints_exact"].replace("SELECT 'name:'", f"SELECT row_number() OVER (ORDER BY similarity DESC, title, key) AS nth, key FROM (SELECT 'name:'") + f") ORDER BY nth LIMIT {TOP}")
def hint_order(spark: SparkSession, folder: str) -> DataFrame:
    return _numbered(naming.hints_in_order(name_hints_exact(spark, folder)).select("key"))


@query(OVERLAP_SQL + f"""
SELECT row_number() OVER (ORDER BY content_similarity DESC, name_similarity DESC, "left", "right") AS nth, "left", "right" FROM pairs
WHERE content_similarity >= 1 OR name_similarity >= 1 ORDER BY nth LIMIT {TOP}
""")
def folder_order(spark: SparkSession, folder: str) -> DataFrame:
    return _numbered(clusters.folders_in_order(folder_overlap(spark, folder)).select("left", "right"))


@query(f"""
WITH {BATCHES_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY requested_at, operation_id) AS n FROM moves)
SELECT batch_id, operation_id, row_number() OVER (PARTITION BY batch_id ORDER BY n DESC) - 1 AS undo FROM s WHERE status = 'completed'
""")
def undo_order(spark: SparkSession, folder: str) -> DataFrame:
    return journal.undo_order(_batches(spark, folder)[1], "batch_id", "requested_at", "operation_id").select("batch_id", "operation_id", "undo")


@query("""
WITH r AS (SELECT full_hash, path, min(path) OVER (PARTITION BY full_hash) AS first_path, count(*) OVER (PARTITION BY full_hash) AS copies FROM files WHERE full_hash IS NOT NULL)
SELECT full_hash AS hash_value, path, first_path, copies FROM r WHERE copies > 1
""")
def exact_members(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_members(table(spark, folder, "files", "path", "full_hash"))


@query("""
SELECT ord, CASE WHEN ord % 5 = 0 THEN 'encoder' WHEN ord % 60 > 51 THEN 'quality' WHEN ord % 7 = 0 THEN 'pixel format' END AS problem FROM files
""")
def preset_checks(spark: SparkSession, folder: str) -> DataFrame:
    encoder = F.when(F.col("ord") % 5 == 0, "libvpx").otherwise("libx265")
    pixels = F.when(F.col("ord") % 7 == 0, "rgb24").otherwise("yuv420p")
    return table(spark, folder, "files", "ord").select("ord", paths.preset_problem(encoder, F.col("ord") % 60, pixels).alias("problem"))


@query("""
SELECT ord, (ord % 4000)::DOUBLE AS seconds, CASE WHEN duration > 0 THEN least(100.0::DOUBLE, 100.0::DOUBLE * (ord % 4000) / duration) ELSE 0.0::DOUBLE END AS percent, 'continue' AS message
FROM (SELECT ord, CASE WHEN duration::VARCHAR <> 'nan' THEN duration END AS duration FROM files)
""")
def progress_reports(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files", "ord", "duration")
    seconds = F.col("ord") % 4000
    clock = F.format_string("%d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60)
    block = F.concat(F.lit("frame=1\nout_time="), clock, F.lit("\nprogress=continue"))
    known = F.when(~F.isnan("duration"), F.col("duration"))
    return files.select("ord", media.progress(block, known).alias("p")).select("ord", "p.seconds", "p.percent", "p.message")


# Operators that the queries above reach only in part


@query("SELECT path, full_hash, NULL::DOUBLE AS duration, NULL::INT AS fingerprint_version FROM files")
def migrated_store(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files", "path", "full_hash", "duration", "fingerprint_version")
    return store.migrated(files.drop("duration", "fingerprint_version"), files.schema)


@query("""
WITH k AS (SELECT full_hash, arg_min(fingerprint, ord) AS kept, min(ord) AS first FROM files WHERE full_hash IS NOT NULL AND fingerprint IS NOT NULL GROUP BY full_hash)
SELECT f.ord, CASE WHEN len(kept) > 0 AND len(kept) = len(fingerprint) THEN greatest(0.0::DOUBLE, 100.0::DOUBLE * (1.0::DOUBLE -
  list_sum(list_transform(range(1, len(kept) + 1), lambda i: bit_count(xor(kept[i], fingerprint[i]))))::DOUBLE / (len(kept) * 64))) ELSE 0.0::DOUBLE END AS similarity
FROM files f JOIN k USING (full_hash) WHERE fingerprint IS NOT NULL AND f.ord <> first
""")
def keeper_hamming(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files", "ord", "full_hash", "fingerprint").where("full_hash is not null and fingerprint is not null")
    kept = files.groupBy("full_hash").agg(F.min_by("fingerprint", "ord").alias("kept"), F.min("ord").alias("first"))
    return files.join(kept, "full_hash").where("ord <> first").select("ord", hamming_similarity(F.col("kept"), F.col("fingerprint")).alias("similarity"))


@query(f"""
WITH t AS ({TITLES_SQL.replace("FROM files)", "FROM (SELECT name_id AS ord, raw_name FROM name_cache))")})
SELECT n.name_id // 150 AS batch, (n.name_id % 150)::INT AS id, CASE WHEN m THEN trim(n.core_title, ' ') ELSE t.core_title END AS core_title, CASE WHEN m THEN n.year ELSE t.year END AS year,
  CASE WHEN m THEN n.episode ELSE t.episode END AS episode, CASE WHEN m THEN 'dub' ELSE t.flags END AS flags, CASE WHEN m THEN 'model' ELSE 'fallback' END AS source
FROM (SELECT *, name_id % 3 <> 0 AND trim(core_title, ' ') <> '' IS TRUE AS m FROM name_cache) n JOIN t ON t.ord = n.name_id
""")
def model_replies(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "name_cache", "name_id", "raw_name", "core_title", "year", "episode")
    asked = names.select(F.floor(F.col("name_id") / 150).alias("batch"), (F.col("name_id") % 150).cast("int").alias("id"), F.col("raw_name").alias("name"), "name_id", "core_title", "year", "episode")
    told = asked.where("name_id % 3 <> 0 and trim(core_title) <> ''")
    item = F.struct("id", "core_title", "year", "episode", F.array(F.lit("DUB")).alias("flags"))
    replies = told.groupBy("batch").agg(F.to_json(F.struct(F.collect_list(item).alias("results"))).alias("json"))
    wrapped = F.when(F.col("batch") % 2 == 0, F.col("json")).otherwise(F.concat(F.lit("Here it is: "), F.col("json"), F.lit(" Done.")))
    found = naming.coerced(replies.select("batch", wrapped.alias("reply")), asked.select("batch", "id", "name"))
    return found.select("batch", "id", "core_title", "year", "episode", F.array_join("flags", "|").alias("flags"), "source")


@query("""
SELECT count(*) AS loaded, count(*) FILTER (ord % 3 = 0) AS checked, coalesce(sum(size) FILTER (ord % 3 = 0), 0)::BIGINT AS bytes
FROM files WHERE regexp_extract(lower(path), '[^/](\\.[^./]+)$', 1) IN ('.mkv', '.mp4')
""")
def compression_totals(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files", "ord", "path", "size").where(media.suffix(F.col("path")).isin(".mkv", ".mp4"))
    return review.compression_summary(files.select("path", "size"), files.where("ord % 3 = 0").select("path"))


@query(f"""
WITH d AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM files), n AS (SELECT folder, len(string_split(trim(folder, '/'), '/')) AS depth FROM d)
SELECT row_number() OVER (ORDER BY depth DESC, folder DESC) AS nth, folder, depth FROM n ORDER BY nth LIMIT {TOP}
""")
def emptied_folders(spark: SparkSession, folder: str) -> DataFrame:
    folders = table(spark, folder, "files", "path").select(paths.parent(F.col("path")).alias("folder")).distinct()
    return _numbered(planning.deepest_first(folders))


@query(f"""
WITH p AS ({SQL["move_plan"]}), s AS (SELECT * FROM p WHERE status <> 'ready' OR size % 2 = 0)
SELECT count(*) AS planned, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'conflict') AS conflicts FROM s
""")
def chosen_moves(spark: SparkSession, folder: str) -> DataFrame:
    plan = move_plan(spark, folder)
    chosen = planning.selected_moves(plan, plan.where("size % 2 = 0").select("source", "destination"))
    parts = {"planned": chosen, "ready": planning.ready_moves(chosen), "conflicts": planning.conflicts(chosen)}
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, rows in parts.items()]
    every = counts[0].union(counts[1]).union(counts[2])
    return every.agg(*(F.max(F.when(F.col("part") == name, F.col("n"))).alias(name) for name in parts))


@query("""
SELECT ord, array_to_string(list_filter([CASE WHEN abs(duration - (duration + ord % 3)) > greatest(1.0::DOUBLE, duration * 0.005::DOUBLE) THEN 'duration' END,
  CASE WHEN ord % 4 < 1 THEN 'audio' END, CASE WHEN ord % 5 < 2 THEN 'subtitle' END, CASE WHEN ord % 11 = 0 THEN 'first frame' END], lambda x: x IS NOT NULL), '|') AS problems,
  size - ord % 2 * 2 + 1 < size AS smaller
FROM (SELECT ord, size, CASE WHEN duration::VARCHAR <> 'nan' THEN duration END AS duration FROM files)
""")
def encoded_checks(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files", "ord", "size", "duration").withColumn("duration", F.when(~F.isnan("duration"), F.col("duration")))
    outputs = files.select(
        "ord", F.col("duration").alias("source_duration"), (F.col("duration") + F.col("ord") % 3).alias("output_duration"),
        *(F.lit(1).alias(f"{s}_{k}") for s in ("source", "output") for k in ("video", "chapters")), F.lit(1).alias("source_audio"), (F.col("ord") % 4).alias("output_audio"),
        F.lit(2).alias("source_subtitle"), (F.col("ord") % 5).alias("output_subtitle"), (F.col("ord") % 11 != 0).alias("decodes"),
        F.col("size").alias("source_size"), (F.col("size") - F.col("ord") % 2 * 2 + 1).alias("output_size"),
    )
    return review.output_checks(outputs).select("ord", F.array_join("problems", "|").alias("problems"), "smaller")


@query(f"SELECT paths, confidence FROM ({SQL['review_items']}) WHERE category = 'video'")
def video_items(spark: SparkSession, folder: str) -> DataFrame:
    return review.filtered(_items(spark, folder), "video").select("paths", "confidence")


@query(f"""
SELECT category, category = 'exact' AS keepable, count(*) AS n FROM ({SQL["review_items"]}) WHERE category IN ('exact', 'video', 'image', 'audio') GROUP BY ALL
""")
def changeable_items(spark: SparkSession, folder: str) -> DataFrame:
    items = _items(spark, folder)
    keep = journal.eligible_for(items, "keep").select("category").distinct().withColumn("keepable", F.lit(True))
    counts = journal.eligible_for(items, "recycle").groupBy("category").agg(F.count("*").alias("n"))
    return counts.join(keep, "category", "left").select("category", F.coalesce("keepable", F.lit(False)).alias("keepable"), "n")


@query("""
WITH i AS (SELECT ord, path, full_hash, CASE WHEN len(image_fingerprint) = 4 THEN image_fingerprint END AS w FROM files WHERE full_hash IS NOT NULL),
k AS (SELECT full_hash, min(ord) AS first FROM i GROUP BY full_hash),
p AS (SELECT b.ord, a.w AS aw, b.w AS bw FROM i b JOIN k USING (full_hash) JOIN i a ON a.ord = k.first WHERE b.ord <> k.first)
SELECT ord::VARCHAR AS name, round(CASE WHEN aw IS NOT NULL AND bw IS NOT NULL THEN 0.8 * (100.0 * (1.0 - bit_count(xor(aw[1], bw[1])) / 64.0::DOUBLE)) + 0.2 * (100.0 * (1.0 -
  (abs(aw[2] - bw[2]) + abs(aw[3] - bw[3]) + abs(aw[4] - bw[4])) / 765.0::DOUBLE)) ELSE 0.0 END, 2) AS similarity,
  aw IS NOT NULL AND bw IS NOT NULL AS eligible, CASE WHEN NOT (aw IS NOT NULL AND bw IS NOT NULL) THEN 'no image' END AS note FROM p
""")
def image_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files", "ord", "path", "full_hash", "image_fingerprint").where("full_hash is not null")
    first = files.groupBy("full_hash").agg(F.min_by("path", "ord").alias("left"), F.min("ord").alias("first"))
    pairs = files.join(first, "full_hash").where("ord <> first").select(F.col("ord").cast("string").alias("name"), "left", F.col("path").alias("right"), F.lit(True).alias("expected"))
    prints = files.select("path", F.when(F.size("image_fingerprint") == 4, F.col("image_fingerprint")).alias("words"))
    left, right = F.col("left_words"), F.col("right_words")
    found = evaluation.evaluated_pairs(pairs, prints, image_similarity(left, right), left.isNotNull() & right.isNotNull(), "no image")
    return found.select("name", "similarity", "eligible", "note")


@query("""
WITH d AS (SELECT DISTINCT string_split(path, '/')[-2] AS folder FROM files), t AS (SELECT '[F' || length(folder) || '] ' || folder AS folder FROM d WHERE folder IS NOT NULL UNION SELECT folder FROM d WHERE folder IS NOT NULL),
p AS (SELECT folder, trim(regexp_replace(folder, '^[\\t-\\r ]*(?i:\\[F[0-9]+\\])[\\t-\\r ]*', ''), ' ') AS plain FROM t),
v AS (SELECT folder, regexp_replace(trim(CASE WHEN plain = '' THEN folder ELSE plain END, ' '), '[. ]+$', '') AS a, regexp_replace(trim(folder, ' '), '[. ]+$', '') AS b FROM p)
SELECT folder, CASE WHEN a <> '' AND NOT regexp_matches(a, '[<>:"/\\\\|?*\\x00-\\x1f]') THEN a WHEN b <> '' AND NOT regexp_matches(b, '[<>:"/\\\\|?*\\x00-\\x1f]') THEN b END AS final FROM v
""")
def final_names(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "files", "path").select(F.try_element_at(F.split("path", "/"), F.lit(-2)).alias("folder")).where("folder is not null").distinct()
    tagged = names.select(F.concat(F.lit("[F"), F.length("folder").cast("string"), F.lit("] "), "folder").alias("folder"))
    return names.union(tagged).distinct().select("folder", paths.final_name(F.col("folder")).alias("final"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
