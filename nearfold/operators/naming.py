"""Normalised names of files, from a store where it has them and by rule where not, and hints from equal or alike titles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import contextual_name, json_object, normalized_name, title_key, token_set_ratio
from ..runtime import stage

BATCH = 150


def contextual_names(files: DataFrame) -> DataFrame:
    """``path, name``: the name under which each file is normalised."""
    return files.select("path", contextual_name(F.col("raw_name"), F.col("path")).alias("name"))


def stored_names(store: DataFrame, provider: str | None = None, model: str | None = None, prompt_hash: str | None = None) -> DataFrame:
    """Rows of a name store that match every qualifier given."""
    for column, value in (("provider", provider), ("model", model), ("prompt_hash", prompt_hash)):
        if value is not None:
            store = store.where(F.col(column) == value)
    return store


def looked_up(names: DataFrame, store: DataFrame) -> DataFrame:
    """``name`` rows with title, year and episode from the store, by rule where the store has none; ``source`` tells."""
    known = store.select(F.col("raw_name").alias("name"), "core_title", "year", "episode", F.lit("store").alias("source"))
    rule = normalized_name("name")
    joined = names.join(known, "name", "left")
    return joined.select(
        *names.columns,
        *(F.when(F.col("source").isNull(), rule[c]).otherwise(F.col(c)).alias(c) for c in ("core_title", "year", "episode")),
        F.coalesce("source", F.lit("fallback")).alias("source"),
    )


def name_batches(names: DataFrame, size: int = BATCH) -> DataFrame:
    """Distinct names, sorted and cut into batches of ``size``: ``batch, name``.

    The running number comes from range-partitioned parts and their offsets, not from one sorted task.
    """
    ordered = names.select("name").where("name is not null").distinct().repartitionByRange("name").sortWithinPartitions("name")
    placed = ordered.withColumn("id", F.monotonically_increasing_id())
    placed = placed.select("name", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    placed = stage(placed, "name-order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, "part").select(F.floor((F.col("start") + F.col("at")) / F.lit(size)).alias("batch"), "name")


def asked_of_model(asked: DataFrame, client: Callable[[list[tuple[int, str]], bool], str]) -> DataFrame:
    """``batch, reply`` from a model for each batch of ``asked`` (batch, id, name).

    ``client(rows, strict)`` gets at most ``BATCH`` (id, name) and answers with text; one that fails is
    asked once more with ``strict`` off, and a batch that fails again has a null reply, so ``coerced``
    falls back on the rules. Never called unless a client is given.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            replies = []
            for ids, names in zip(frame["ids"], frame["names"]):
                reply = None
                for strict in (True, False):
                    try:
                        reply = client(list(zip(map(int, ids), names)), strict)
                        break
                    except Exception:  # noqa: BLE001 - whatever the client raises, the rules take over
                        continue
                replies.append(reply)
            yield pd.DataFrame({"batch": frame["batch"], "reply": replies})

    rows = F.sort_array(F.collect_list(F.struct("id", "name")))  # a batch is bounded
    grouped = asked.groupBy("batch").agg(rows.alias("rows")).select("batch", F.col("rows.id").alias("ids"), F.col("rows.name").alias("names"))
    return grouped.mapInPandas(ask, f"batch {asked.schema['batch'].dataType.simpleString()}, reply string")


def coerced(replies: DataFrame, asked: DataFrame) -> DataFrame:
    """``id, name, core_title, year, episode, flags, source`` from model replies, one row per name asked.

    ``replies`` has ``batch, reply`` (JSON, possibly wrapped in other text), ``asked`` ``batch, id, name``.
    Unknown ids are dropped, years and episodes that are no integers are null, and names without a
    usable result are normalised by rule.
    """
    rows = "array<struct<id: int, core_title: string, year: string, episode: string, flags: array<string>>>"
    results = replies.select("batch", F.explode(F.from_json(F.to_json(json_object(F.col("reply"))), f"struct<results: {rows}>")["results"]).alias("r"))
    results = results.select("batch", F.col("r.id").alias("id"), F.col("r.core_title").alias("title"), _integer(F.col("r.year")).alias("y"), _integer(F.col("r.episode")).alias("e"), F.coalesce("r.flags", F.array().cast("array<string>")).alias("f"))
    results = results.where("trim(title) <> ''").dropDuplicates(["batch", "id"])
    rule, got = normalized_name("name"), F.col("title").isNotNull()
    joined = asked.join(results, ["batch", "id"], "left")
    return joined.select(
        "batch", "id", "name", F.when(got, F.trim("title")).otherwise(rule["core_title"]).alias("core_title"),
        F.when(got, F.col("y")).otherwise(rule["year"]).alias("year"), F.when(got, F.col("e")).otherwise(rule["episode"]).alias("episode"),
        F.when(got, F.transform(F.array_compact("f"), F.lower)).otherwise(rule["flags"]).alias("flags"),
        F.when(got, F.lit("model")).otherwise(F.lit("fallback")).alias("source"),
    )


def _integer(text: Column) -> Column:
    return F.when(text.rlike(r"^-?\d+$"), text.try_cast("int"))


def name_keys(titled: DataFrame) -> DataFrame:
    """Rows with ``title`` in key form; rows without a usable title are dropped."""
    return titled.withColumn("title", title_key(F.col("core_title"))).where("title <> ''")


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("None"))


def exact_hints(titled: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Hints from equal keys: ``key, similarity, title, year, episode, files``, of two or more unconfirmed files.

    ``titled`` has ord, path, core_title, year, episode; ``confirmed`` has path, the files that content matches.
    The title shown is that of the first unconfirmed file.
    """
    free = name_keys(titled).join(confirmed, "path", "left_anti")
    grouped = free.groupBy("title", "year", "episode").agg(F.count("*").alias("files"), F.min_by("core_title", "ord").alias("shown")).where("files > 1")
    key = F.concat(F.lit("name:"), F.concat_ws("|", "title", _text("year"), _text("episode")))
    return grouped.select(key.alias("key"), F.lit(100.0).alias("similarity"), F.col("shown").alias("title"), "year", "episode", "files")


#: What parts the words of a title, as in the token-set ratio.
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def letters_at_least(text: Column, times: int) -> Column:
    """64 bits: which of 64 kinds of letters the text has that often. A letter more or less changes one bit of one ``times``."""
    kinds = F.array_sort(F.transform(F.split(text, ""), lambda c: F.pmod(F.xxhash64(c), F.lit(64)).cast("int")))
    often = F.filter(kinds, lambda k, i: (i >= times - 1) & (F.get(kinds, i - (times - 1)) == k)) if times > 1 else kinds
    return F.aggregate(often, F.lit(0).cast("long"), lambda bits, k: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))


#: Letters about as often as they come, so that classes of letters by their place are of about one size.
COMMON_LETTERS = " eaoirnsultkmhdgbzcvypfjwxq"
#: Thresholds from which titles are looked up by their letters; below, those of one year and episode are all compared.
LETTERED_FROM = 70.0
#: More than any rounding of a ratio.
_ROOM = 1e-6


def _class_of(letter: Column, classes: Column) -> Column:
    place = F.instr(F.lit(COMMON_LETTERS), letter)
    return F.pmod(F.when(place > 0, place).otherwise(F.ascii(letter)), classes)


def _letter_keys(own: DataFrame, threshold: float) -> DataFrame:
    """Rows once per ``parts`` (a number of classes of letters) and class, with a hash of the letters it has of the class.

    Texts with a ratio of ``threshold`` differ in at most d letters, by their lengths: of d + 1 classes of letters they have one equally.
    """
    if threshold < LETTERED_FROM:
        return own.withColumns({"parts": F.lit(0), "key": F.xxhash64("year", "episode")})
    share = 1 - threshold / 100.0
    # the other text may have from n * t / (200 - t) to n * (200 - t) / t letters
    least, most = (
        F.greatest(F.lit(0), F.floor(F.col("n") * (1 + x) * share + room).cast("int"))
        for x, room in ((threshold / (200.0 - threshold), -_ROOM), ((200.0 - threshold) / threshold, 2 * _ROOM))
    )
    parted = own.withColumn("letters", F.array_sort(F.split("plain", ""))).withColumn("parts", F.explode(F.sequence(least + 1, most + 1)))
    parted = parted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    some = F.filter("letters", lambda c: _class_of(c, F.col("parts")) == F.col("part"))
    return parted.withColumn("key", F.xxhash64("year", "episode", "parts", "part", some)).drop("letters", "part")


def _rarest_first(own: DataFrame, words: DataFrame) -> DataFrame:
    """``own`` with its words as ``ranked``, those rare in ``words`` (word, one row per title) first."""
    often = words.groupBy("word").agg(F.count("*").alias("often"))
    ranked = own.select("side", F.explode("words").alias("word")).join(often, "word", "left")
    ranked = ranked.groupBy("side").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word"))).alias("ranked"))
    return own.join(ranked.select("side", F.col("ranked.word").alias("ranked")), "side")


def _needed(ranked: Column, most: Column) -> Column:
    """The first of the words that can't all be among those left out: with their blanks they are longer than ``most``."""
    size = lambda words: F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w) + 1)
    return F.filter(ranked, lambda _, i: size(F.slice(ranked, F.lit(1), i)) <= most)


def fuzzy_hints(queries: DataFrame, keys: DataFrame, threshold: float = 92.0) -> DataFrame:
    """``left_title, right_title, year, episode, similarity`` of alike but unequal titles of one year and episode.

    Texts of which one's words contain the other's score 100 and are left out, as equal ones are. Two titles
    are looked at only where a hit is possible: where they have all letters of some class equally often (a hit
    by the words of both), or where a word is common to both that a title cannot do without (a hit by the
    words they share, of which one title leaves out little). No hit is missed, and titles that share no key
    are never compared. Bounds by letters follow, in compiled code, before the pair is scored.
    """
    distinct = F.array_join(F.array_distinct(F.array_remove(F.split("title", BLANKS), "")), " ")
    sides = []
    for rows in (queries,) if queries is keys else (queries, keys):
        own = rows.select("title", "year", "episode").distinct().withColumn("plain", distinct).where("plain <> ''")
        sides.append(stage(own.select("title", "year", "episode", "plain", F.length("plain").alias("n"), F.split("plain", " ").alias("words"), *(letters_at_least(F.col("plain"), t).alias(f"b{t}") for t in (1, 2))), "titles"))
    sides = [sides[0], sides[-1]]
    left, right = (lambda c: F.col(f"left_{c}")), (lambda c: F.col(f"right_{c}"))
    same = left("year").eqNullSafe(right("year")) & left("episode").eqNullSafe(right("episode")) & (left("title") != right("title"))

    def bits(combine) -> Column:
        return F.bit_count(combine(left("b1"), right("b1"))) + F.bit_count(combine(left("b2"), right("b2")))

    def named(df: DataFrame, side: str) -> DataFrame:
        return df.toDF(*(f"{side}_{c}" for c in df.columns))

    total = left("n") + right("n")
    close = bits(lambda a, b: a.bitwiseXOR(b)) <= total * (1 - threshold / 100.0) + _ROOM
    close &= F.least(left("n"), right("n")) * 200.0 >= total * threshold - _ROOM
    if threshold >= LETTERED_FROM:
        close &= left("parts") == F.floor(total * (1 - threshold / 100.0) + _ROOM) + 1
    lettered = [named(_letter_keys(own.select("title", "year", "episode", "plain", "n", "b1", "b2"), threshold).drop("plain"), side) for own, side in zip(sides, ("left", "right"))]
    shown = ["left_title", "right_title", left("year").alias("year"), left("episode").alias("episode")]
    agree = (left("key") == right("key")) & (left("parts") == right("parts"))
    pairs = lettered[0].join(lettered[1], agree & same & close).select(*shown)
    spare = 1 - threshold / (200.0 - threshold)  # share of a title that the words in common may leave out
    for one, two in (("left", "right"), ("right", "left")):
        brief, whole = (sides if one == "left" else sides[::-1])
        postings = whole.select("title", "year", "episode", "b1", "b2", F.explode("words").alias("word"))
        # a word left out takes its blank with it
        some = brief.where(F.array_min(F.transform("words", F.length)) + 1 <= F.col("n") * spare + _ROOM).withColumn("side", F.struct("title", "year", "episode"))
        ranked = _rarest_first(some, postings).withColumn("word", F.explode(_needed(F.col("ranked"), F.col("n") * spare + _ROOM)))
        ranked, postings = named(ranked.select("title", "year", "episode", "n", "b1", "b2", "word"), one), named(postings, two)
        within = bits(lambda a, b: (a if one == "left" else b).bitwiseAND(F.bitwise_not(b if one == "left" else a))) <= F.col(f"{one}_n") * spare + _ROOM
        pairs = pairs.union(ranked.join(postings, (left("word") == right("word")) & same & within).select(*shown))
    scored = pairs.distinct().withColumn("similarity", token_set_ratio("left_title", "right_title"))
    return scored.where((F.col("similarity") >= threshold) & (F.col("similarity") < 100))


def all_hints(titled: DataFrame, confirmed: DataFrame, threshold: float = 92.0) -> DataFrame:
    """Hints from equal keys and from alike ones: the columns of ``exact_hints`` and the sorted ``paths`` of the unconfirmed files.

    Alike keys are compared whether or not files of them are confirmed; a hint needs two unconfirmed
    files of the two keys together. The key seen first, by ord, is named first.
    """
    keyed = name_keys(titled).join(confirmed.select("path").distinct().withColumn("seen", F.lit(True)), "path", "left")
    free = F.when(F.col("seen").isNull(), F.col("path"))
    keys = stage(keyed.groupBy("title", "year", "episode").agg(
        F.min("ord").alias("first"), F.sort_array(F.collect_list(free)).alias("paths"), F.min_by("core_title", F.when(free.isNotNull(), F.col("ord"))).alias("shown")
    ), "name-keys")
    suffix = F.concat_ws("|", _text("year"), _text("episode"))
    equal = keys.where(F.size("paths") > 1).select(
        F.concat(F.lit("name:"), F.col("title"), F.lit("|"), suffix).alias("key"), F.lit(100.0).alias("similarity"), F.col("shown").alias("title"), "year", "episode",
        F.size("paths").cast("long").alias("files"), "paths",
    )
    near = fuzzy_hints(keys, keys, threshold).where("left_title < right_title")
    sides = [keys.select(F.col("title").alias(f"{s}_title"), F.col("year").alias(f"{s}_year"), F.col("episode").alias(f"{s}_episode"), F.col("first").alias(f"{s}_first"), F.col("paths").alias(f"{s}_paths")) for s in ("left", "right")]
    for name, side in zip(("left", "right"), sides):
        same = (near[f"{name}_title"] == side[f"{name}_title"]) & near["year"].eqNullSafe(side[f"{name}_year"]) & near["episode"].eqNullSafe(side[f"{name}_episode"])
        near = near.join(side, same).drop(side[f"{name}_title"]).drop(f"{name}_year", f"{name}_episode")
    ahead = F.col("left_first") < F.col("right_first")
    one, two = (F.when(c, F.col("left_title")).otherwise(F.col("right_title")) for c in (ahead, ~ahead))
    paths = F.sort_array(F.concat("left_paths", "right_paths"))
    alike = near.where(F.size("left_paths") + F.size("right_paths") > 1).select(
        F.concat(F.lit("fuzzy:"), one, F.lit("|"), two, F.lit("|"), suffix).alias("key"), F.round("similarity", 2).alias("similarity"),
        F.concat(one, F.lit(" / "), two).alias("title"), "year", "episode", F.size(paths).cast("long").alias("files"), paths.alias("paths"),
    )
    return equal.union(alike)


def hints_in_order(hints: DataFrame) -> DataFrame:
    """Hints as a report lists them: the surest first, then by title and key."""
    return hints.orderBy(F.desc("similarity"), "title", "key")
