"""Release-style names to titles: native regular expressions, and the token-set ratio as an Arrow function."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and word lists of the title rules.
QUALITY_WORDS = (
    "480p|720p|1080p|2160p|4k|8k|x264|x265|h264|h265|hevc|aac|flac|opus|web-dl|webrip|bdrip|bluray|hdrip|dvdrip|"
    "repack|proper|alt|alternate|extended|uncut|sub|subs|dub|dual audio"
)
GENERIC_WORDS = "e|ep|episode|part|disc|cd|track|poster|cover|folder|thumbnail|thumb|image|img|photo|scan|серия"
FLAG_WORDS = ("dub", "ova", "sub")
YEAR = r"(?U)(?:^|[^\d])((?:19|20)\d{2})(?:[^\d]|$)"
EPISODE = r"(?iU)(?:^|[\s._-])(?:e|ep|episode)?\s*0*(\d{1,4})(?:v\d+)?(?:[\s._-]|$)"
BRACKETED = r"\[[^\]]+\]|\([^)]+\)"
NOT_EPISODES = (360, 480, 540, 720, 1080, 1440, 2160, 4320)

_MARK = "\u0001"


def whole(words: str) -> str:
    """A pattern for whole words: letters, numbers and the underscore belong to words, marks and joiners do not."""
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{words})(?![\p{{L}}\p{{N}}_])"



def _number(digits: Column) -> Column:
    """Full-width digits count as digits."""
    return F.translate(digits, "０１２３４５６７８９", "0123456789").try_cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often it is read."""
    return F.transform(F.array(value), body)[0]


def _episode_place(parts: Column, year: Column) -> Column:
    """Number of the last place in ``parts`` (text, match, number, text, ...) that can be an episode; null if none can."""
    places = F.filter(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor((F.size(parts) - 1) / 3).cast("int"))),
        lambda i: (F.size(parts) > i * 3 - 1) & let(
            _number(F.get(parts, i * 3 - 1)), lambda n: ~F.coalesce(n.isin(*NOT_EPISODES) | n.eqNullSafe(F.coalesce(year, F.lit(-1))), F.lit(False))
        ),
    )
    return F.when(F.size(places) > 0, F.try_element_at(places, F.lit(-1)))


def _without_episode(spaced: Column, parts: Column, place: Column) -> Column:
    """The text with its episode cut out: other matches stay, their numbers apart from the text do not."""
    kept = F.transform(parts, lambda x, i: F.when(i == place * 3 - 2, " ").when(i % 3 == 2, "").otherwise(x))
    return F.when(place.isNull(), spaced).otherwise(F.array_join(kept, ""))


def _title(text: Column) -> Column:
    for pattern in (BRACKETED, whole(QUALITY_WORDS), YEAR, r"[-–—|]+", r"(?U)\s+"):
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(text)


def normalized_name(raw: str | Column) -> Column:
    """``struct<core_title, year, episode, flags, source>`` of a raw name; null for null."""
    raw = F.col(raw) if isinstance(raw, str) else raw

    def fields(spaced: Column, year: Column, parts: Column, place: Column) -> Column:
        flags = F.filter(F.array(*(F.when(spaced.rlike(whole(w)), F.lit(w)) for w in FLAG_WORDS)), lambda x: x.isNotNull())
        title = let(_title(_without_episode(spaced, parts, place)), lambda t: F.when(t == "", raw).otherwise(t))
        episode = F.when(place.isNotNull(), _number(F.get(parts, place * 3 - 1)))
        return F.struct(title.alias("core_title"), year.alias("year"), episode.alias("episode"), flags.alias("flags"), F.lit("fallback").alias("source"))

    def marked(spaced: Column) -> Column:
        return F.split(F.regexp_replace(spaced, EPISODE, f"{_MARK}$0{_MARK}$1{_MARK}"), _MARK)

    found = let(
        F.translate(raw, "_.", "  "),
        lambda w: let(
            _number(F.regexp_extract(w, YEAR, 1)),
            lambda y: let(marked(w), lambda p: let(_episode_place(p, y), lambda k: fields(w, y, p, k))),
        ),
    )
    return F.when(raw.isNotNull(), found)


def contextual_name(raw: Column, path: Column) -> Column:
    """The raw name, with its folder before it where nothing but generic words, quality words and digits is left."""
    steps = (BRACKETED, whole(QUALITY_WORDS), whole(GENERIC_WORDS), r"(?U)\d+|[^\p{L}\p{N}_]+")
    left = reduce(lambda text, pattern: F.regexp_replace(text, pattern, " "), steps, raw)
    folder = F.trim(F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit("")))
    bare = (F.trim(left) == "") | F.trim(left).rlike("^[ _]+$")
    return F.when(bare & (folder != ""), F.concat(folder, F.lit(" - "), raw)).otherwise(raw)


def title_key(title: Column) -> Column:
    """Key form of a title: lower case, trimmed."""
    return F.lower(F.trim(title))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the longer text."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row, full = 0, (1 << len(a)) - 1
    for x in b:
        grown = row | places.get(x, 0)
        row = grown & ~(grown - (row << 1 | 1)) & full
    return row.bit_count()


def _ratio(a: str, b: str) -> float:
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def set_ratio(a: str | None, b: str | None) -> float:
    """Token-set ratio: 100 where one text's words contain the other's, else the best of three ratios."""
    left, right = set((a or "").split()), set((b or "").split())
    if not left or not right:
        return 0.0
    both, only_a, only_b = (" ".join(sorted(x)) for x in (left & right, left - right, right - left))
    if both and (not only_a or not only_b):
        return 100.0
    with_a, with_b = (f"{both} {x}".strip() for x in (only_a, only_b))
    scores = [_ratio(with_a, with_b)]
    if both:
        scores += [_ratio(both, with_a), _ratio(both, with_b)]
    return max(scores)


@F.arrow_udf(T.DoubleType())
def token_set_ratio(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array([set_ratio(a, b) for a, b in zip(left.to_pylist(), right.to_pylist())], pa.float64())


def json_object(reply: Column) -> Column:
    """The JSON object in a model's reply: the text itself, else from its first ``{`` to its last ``}``; null if neither parses."""
    inner = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    parsed = F.coalesce(F.try_parse_json(reply), F.try_parse_json(inner))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)
