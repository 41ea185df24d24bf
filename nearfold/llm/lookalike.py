"""One form for text that looks the same: a confusables skeleton.

The skeleton of a text is its compatibility decomposition, each character replaced by the prototype
of its look-alikes, characters without width removed, every blank of one space turned into a plain
space, then decomposed again. Texts look the same exactly when their skeletons are equal. Letter
case, number and place of blanks, tabs and line ends, kinds of dashes and quote marks, digits
against letters, and visible accents stay different.

Defined results: the skeleton of null is null, of an empty text empty; texts of any length are
taken whole; unpaired surrogates are kept as they are.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship_package, stage

# Letters of other scripts and the Latin letter that looks the same, in pairs. These are
# the pairs that fonts draw alike, not all that the public list of confusable characters holds.
CYRILLIC = "АAВBЕEКKМMНHОOРPСCТTХXІIЈJЅSУYԚQԜWҮYӀIԌGаaеeоoрpсcуyхxіiјjѕsһhԁdԛqԝwүyӏlҺh"
GREEK = "ΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧXϹCϺMοoνvϲcϳjιiαaρpυu"
ARMENIAN = "ՕOՍUԼLԼLօoսuհhոnցgզqյj"
CHEROKEE = "ᎪAᏴBᏟCᎠDᎬEᎻHᎫJᏦKᏞLᎷMᏢPᏒRᏚSᎢTᏙVᎳWᏃZ"
OTHERS = "ıiɑaɡgꓐBꓑPꓓDꓔTꓖGꓗKꓙJꓚCꓜZꓝFꓟMꓠNꓡLꓢSꓣRꓦVꓧHꓪWꓫXꓬYꓮAꓰEꓲIꓳOꓴU"
COPTIC = "ⲀAⲂBⲈEⲎHⲒIⲔKⲘMⲚNⲞOⲢPⲤCⲦTⲨYⲬXⲟoⲣpⲥcⲭx"
SMALL_CAPITALS = "ᴄcᴏoꜱsᴜuᴠvᴡwᴢz"
RARE = "ѴVѵvƽsꭹyꮃwꮓzꮩvꮪsꮯc"
#: Kana and the ideographs drawn alike.
KANA = "エ工カ力タ夕ト卜ニ二ハ八ロ口ヘへノ丿"
#: Format characters that are drawn, so not without width.
DRAWN_FORMAT = "؀؁؂؃؄؅۝܏࣢\U000110bd\U000110cd"
#: Characters without width that are not format characters.
WIDTHLESS = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"

_PAIRS = CYRILLIC + GREEK + ARMENIAN + CHEROKEE + OTHERS + COPTIC + SMALL_CAPITALS + RARE + KANA
PROTOTYPES = dict(zip(_PAIRS[::2], _PAIRS[1::2]))


def prototype(char: str) -> str:
    """What one decomposed character becomes; nothing for a character without width."""
    kind = unicodedata.category(char)
    if kind == "Cf" and char not in DRAWN_FORMAT or char in WIDTHLESS:
        return ""
    if 0xFE00 <= ord(char) <= 0xFE0F or 0xE0100 <= ord(char) <= 0xE01EF:
        return ""
    if kind == "Zs":
        return " "
    return PROTOTYPES.get(char, char)


class _Table(dict):
    """Code point -> prototype, filled in as characters are met."""

    def __missing__(self, code: int) -> str:
        self[code] = found = prototype(chr(code))
        return found


@lru_cache(1)
def _table() -> _Table:
    return _Table()


def skeleton(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    plain = unicodedata.normalize("NFKD", text).translate(_table())
    return unicodedata.normalize("NFKD", plain)


@F.arrow_udf(T.StringType())
def _skeleton_column(texts: pa.Array) -> pa.Array:
    return pa.array([skeleton(x) for x in texts.to_pylist()], pa.string())


def skeleton_of(column: str | Column) -> Column:
    """The skeleton of a text column; plain ASCII is its own skeleton."""
    return _skeleton_column(F.col(column) if isinstance(column, str) else column)


def lookalike_classes(rows: DataFrame, key: str = "ord", text: str = "raw_name") -> DataFrame:
    """``member, class_key`` of every row whose text looks like a different one: rows of one skeleton with the smallest key of them.

    Linear in the rows, however many look the same: strings are brought together per skeleton, rows only
    meet the key of their string.
    """
    ship_package(rows.sparkSession)
    named = rows.select(F.col(key).alias("k"), F.col(text).alias("s")).where("k is not null and s is not null")
    strings = stage(named.groupBy("s").agg(F.min("k").alias("least")).select("s", "least", skeleton_of("s").alias("look")), "looks")
    classes = strings.groupBy("look").agg(F.min("least").alias("class_key"), F.count("*").alias("n")).where("n > 1")
    keyed = strings.join(classes, "look").select("s", "class_key")
    return named.join(keyed, "s").select(F.col("k").alias("member"), "class_key")


def lookalike_pairs(rows: DataFrame, key: str = "ord", text: str = "raw_name", *, rows_per_salt: int = 50_000) -> DataFrame:
    """``ord_a, ord_b`` of all rows whose texts look the same but are not the same string, ``ord_a < ord_b``.

    Different strings are paired first, per skeleton, and only strings that have a partner go on to
    their rows; a string with more than ``rows_per_salt`` rows is cut into that many salted parts on
    both sides, so no task holds a hot string whole. Null texts and null keys have no pair; repeated
    rows are rows of their own.
    """
    ship_package(rows.sparkSession)
    named = rows.select(F.col(key).alias("k"), F.col(text).alias("s")).where("k is not null and s is not null")
    strings = (
        named.groupBy("s").agg(F.count("*").alias("n"))
        .select("s", F.ceil(F.col("n") / F.lit(rows_per_salt)).cast("int").alias("parts"), skeleton_of("s").alias("look"))
    )
    a, b = strings.toDF("s_a", "parts_a", "look"), strings.toDF("s_b", "parts_b", "look_b")
    pairs = stage(a.join(b, (a.look == b.look_b) & (a.s_a < b.s_b)).select("s_a", "parts_a", "s_b", "parts_b"), "lookalikes")
    paired = pairs.select(F.col("s_a").alias("s"), F.col("parts_a").alias("parts")).union(pairs.select("s_b", "parts_b")).distinct()
    members = named.join(paired, "s").select("k", "s", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int").alias("part"))
    left, right = members.toDF("k_a", "s_a", "part_a"), members.toDF("k_b", "s_b", "part_b")
    for side in "ab":
        others = [c for c in pairs.columns if c != f"parts_{side}"]
        pairs = pairs.select(*others, F.explode(F.sequence(F.lit(0), F.col(f"parts_{side}") - 1)).alias(f"part_{side}"))
    found = pairs.join(left, ["s_a", "part_a"]).join(right, ["s_b", "part_b"])
    return found.select(F.least("k_a", "k_b").alias("ord_a"), F.greatest("k_a", "k_b").alias("ord_b"))
