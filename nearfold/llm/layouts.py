"""Records that differ only in layout: blanks, punctuation, letter case or the order of words.

A name is streamed once through a lookup table that skips what is neither letter nor digit and folds
the rest, straight into polynomial hashes; no canonical text is built. Two pairs of hashes come out:
of all letters and digits in their order, and of the multiset of words (the sum over words of a
mixed word hash). Equal hashes are then verified on the original texts: two pointers walk both texts
at once, skipping and folding, and word multisets are compared as such. Rows that only collided get
a key of their own. Records linked by either hash, directly or through others, are one group.

Defined results: null names and null keys belong to no group; names without any letter or digit are
equal only to identical names; repeated rows are records of their own; texts are read whole. A
combining mark that follows a letter belongs to its word.
"""

from __future__ import annotations

import hashlib
import itertools
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package, stage, unstage
from ..operators.combinations import mixed
from .components import connected_groups
from .lookalike import CYRILLIC, GREEK, prototype

#: Odd bases of the two polynomials, and what the codes are multiplied with before mixing.
BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
SALTS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


#: How the letters of a word are read: by their Latin look-alikes, as Cyrillic, as Greek, or each as it is.
LATIN, CYRILLIC_WORD, GREEK_WORD, OWN = range(4)
#: What the letters of a word say about it: only Latin, only Cyrillic, only Greek; a Cyrillic or Greek letter that looks Latin.
ONLY_LATIN, ONLY_CYRILLIC, ONLY_GREEK, LOOKS_CYRILLIC, LOOKS_GREEK = 1, 2, 4, 8, 16
_CODES = 0x110000


def _inverse(pairs: str) -> dict[str, str]:
    back: dict[str, str] = {}
    for letter, latin in zip(pairs[::2], pairs[1::2]):
        back.setdefault(latin, letter)
    return back


_BACK = {CYRILLIC_WORD: _inverse(CYRILLIC), GREEK_WORD: _inverse(GREEK)}


class FoldTable:
    """Code point and reading -> up to ``WIDTH`` folded codes, none for a skipped one; filled in as characters are met.

    ``looks`` says whether look-alike characters fold to one. Letter case and look-alikes do not go
    together letter by letter (the capital of a Cyrillic letter may look Latin, the small one not), so a
    word is read in the script that its unmistakable letters belong to.
    """

    WIDTH = 24  # the longest compatibility decomposition has 18

    def __init__(self, looks: bool):
        self.looks = looks
        self.known = np.zeros(4 * _CODES if looks else _CODES, np.int32)
        self.says = np.zeros(_CODES, np.uint8)
        self.codes = np.zeros((1024, self.WIDTH), np.int32)
        self.sizes = np.zeros(1024, np.int8)
        self.used = 1
        self._folded: dict[tuple[str, int], str] = {}

    def fold(self, char: str, reading: int = LATIN) -> str:
        """The folded letters, digits and marks of one character; empty for a skipped one."""
        if (char, reading) not in self._folded:
            self._folded[char, reading] = self._fold(char, reading)
        return self._folded[char, reading]

    def _fold(self, char: str, reading: int) -> str:
        if self.looks:
            parts = [(x, prototype(x)) for x in unicodedata.normalize("NFKD", char)]
            if reading == OWN:
                text = "".join(p and x for x, p in parts)
            else:
                back = _BACK.get(reading, {})
                text = "".join(back.get(p, p) for _, p in parts)
            char = "".join(prototype(x) for x in unicodedata.normalize("NFKD", text.casefold()))
        return "".join(x for x in unicodedata.normalize("NFD", char.casefold()) if unicodedata.category(x)[0] in "LNM")

    def widthless(self, char: str) -> bool:
        return self.looks and not prototype(char)

    def said(self, char: str) -> int:
        """What a character says about the script of its word."""
        out = 0
        for x in unicodedata.normalize("NFKD", char) if self.looks and not char.isascii() else char if self.looks else "":
            if x.isalpha():
                script, looks = unicodedata.name(x, "").split(" ")[0], prototype(x) != x
                if script == "LATIN":
                    out |= 0 if looks or x in _BACK[CYRILLIC_WORD] else ONLY_LATIN
                elif script == "CYRILLIC":
                    out |= LOOKS_CYRILLIC if looks else ONLY_CYRILLIC
                elif script == "GREEK":
                    out |= LOOKS_GREEK if looks else ONLY_GREEK
        return out

    def learn(self, codes: np.ndarray, reading: int = LATIN) -> None:
        base = reading * _CODES
        for code in np.unique(codes[self.known[base + codes] == 0]):
            if self.used == len(self.sizes):
                self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
                self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            char = chr(code)
            folded = self.fold(char, reading)
            self.codes[self.used, : len(folded)] = [ord(x) for x in folded]
            # -1: skipped without ending a word
            self.sizes[self.used] = -1 if not folded and self.widthless(char) else len(folded)
            self.known[base + code] = self.used
            self.says[code] = self.said(char)
            self.used += 1


def first_reading(says):
    """The reading of words by what their letters say; elementwise."""
    only = says & 7
    return np.where(only == ONLY_CYRILLIC, CYRILLIC_WORD, np.where(only == ONLY_GREEK, GREEK_WORD, LATIN))


def second_reading(says):
    """Another reading of words with letters of two scripts that leave the first open, else the first."""
    only, looks = says & 7, says & (LOOKS_CYRILLIC | LOOKS_GREEK)
    mixed_ = (only & (only - (only > 0))) != 0
    open_ = (only == 0) & (looks != 0)
    other = np.where((looks & LOOKS_CYRILLIC) != 0, CYRILLIC_WORD, GREEK_WORD)
    return np.where(mixed_, OWN, np.where(open_, other, first_reading(says)))


def code_points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of texts, and where each text begins and ends."""
    # marks in another order are the same text: only texts with marks are looked at
    strings = [x if x.isascii() or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFD", x) for x in strings]
    ends = np.cumsum([0, *map(len, strings)])
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), ends


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def streamed(strings: list[str], table: FoldTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text, the rows of texts that have a second reading, and the hashes of that.

    Hashes are five per text: two of its letters and digits in order, two of its multiset of words, and the number of the former.
    """
    codes, ends = code_points(strings)
    table.learn(codes)
    breaks = np.zeros(len(codes) + 1, np.int64)
    # a word begins at a text's first code and after a character that is skipped and has a width
    breaks[1:] = table.sizes[table.known[codes]] == 0
    breaks[ends[:-1]] += 1
    word = np.cumsum(breaks)[: len(codes)]
    if not table.looks or not len(codes):
        return hashes_of(codes, ends, word, table.known[codes], table), np.zeros(0, np.int64), np.zeros((5, 0), np.uint64)
    begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    says = np.bitwise_or.reduceat(table.says[codes], begins)
    sizes = np.diff(np.append(begins, len(codes)))
    ways = [np.repeat(way(says), sizes) for way in (first_reading, second_reading)]
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    for reading in (CYRILLIC_WORD, GREEK_WORD, OWN):
        for way in ways:
            table.learn(codes[way == reading], reading)
    plain = hashes_of(codes, ends, word, table.known[ways[0] * _CODES + codes], table)
    rows = np.unique(row[ways[0] != ways[1]])
    kept = np.isin(row, rows)
    inner = np.concatenate([[0], np.cumsum(np.diff(ends)[rows])])
    other = hashes_of(codes[kept], inner, word[kept], table.known[(ways[1] * _CODES + codes)[kept]], table)
    differs = (other[:4] != plain[:4, rows]).any(0)
    return plain, rows[differs], other[:, differs]


def hashes_of(codes: np.ndarray, ends: np.ndarray, word: np.ndarray, entry: np.ndarray, table: FoldTable) -> np.ndarray:
    """The five hashes of texts given as codes, the word that each code belongs to, and the entry it folds by."""
    kept = np.maximum(table.sizes[entry].astype(np.int64), 0)
    row = np.repeat(np.repeat(np.arange(len(ends) - 1), np.diff(ends)), kept)
    first = np.repeat(np.cumsum(kept) - kept, kept)
    total = int(kept.sum())
    out = np.zeros((5, len(ends) - 1), np.uint64)
    counts = np.bincount(row, minlength=len(ends) - 1)
    out[4] = counts
    if not total:
        return out
    folded = table.codes[np.repeat(entry, kept), np.arange(total) - first].astype(np.uint64)
    word = np.repeat(word, kept)
    begins = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (row[1:] != row[:-1])]))
    starts = np.cumsum(counts) - counts
    full = counts > 0
    lengths = np.diff(np.append(begins, total))
    in_row = np.arange(total) - np.repeat(starts, counts)
    in_word = np.arange(total) - np.repeat(begins, lengths)
    for i in (0, 1):
        term = mixed(folded * SALTS[i])
        power = powers(BASES[i], int(counts.max()))
        out[i, full] = np.add.reduceat(term * power[in_row], starts[full])
        of_word = mixed(np.add.reduceat(term * power[in_word], begins) + lengths.astype(np.uint64) * SALTS[1 - i])
        word_row = row[begins]
        out[2 + i, full] = np.add.reduceat(of_word, np.searchsorted(word_row, np.flatnonzero(full)))
    return out


def folded_codes(text: str, table: FoldTable, second: bool = False) -> Iterator[str]:
    """The kept codes of a text one by one, an empty string where a word ends; a word is looked through for its script first."""
    way, word, says = second_reading if second else first_reading, [], 0
    for char in text if text.isascii() else unicodedata.normalize("NFD", text):
        if table.fold(char):
            word.append(char)
            says |= table.said(char)
        elif not table.widthless(char):
            yield from _read(word, table, int(way(np.int64(says))))
            yield ""
            word, says = [], 0
    yield from _read(word, table, int(way(np.int64(says))))


def _read(word: list[str], table: FoldTable, reading: int) -> Iterator[str]:
    for char in word:
        yield from table.fold(char, reading)


def same_sequence(a: Iterator[str], b: Iterator[str]) -> bool:
    """Two pointers over both texts, each skipping what does not count."""
    left, right = (x for x in a if x), (x for x in b if x)
    done = object()
    while True:
        x, y = next(left, done), next(right, done)
        if x is not y and x != y:
            return False
        if x is done:
            return True


def words_of(codes: Iterator[str]) -> Iterator[str]:
    word = []
    for x in itertools.chain(codes, [""]):
        if x:
            word.append(x)
        elif word:
            yield "".join(word)
            word = []


def hashed(looks: bool):
    """Adds the four hashes to batches of (key, scope, name), and whether they are those of a second reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = FoldTable(looks)
        for batch in batches:
            names = [x or "" for x in batch.column("name").to_pylist()]
            hashes, rows, others = streamed(names, table)
            for i in np.flatnonzero(hashes[4] == 0):  # nothing but punctuation: the text itself decides
                digest = np.frombuffer(hashlib.blake2b(names[i].encode("utf-8", "surrogatepass"), digest_size=16).digest(), np.uint64)
                hashes[:2, i] = hashes[2:4, i] = digest
            for some, found, second in ((batch, hashes, False), (batch.take(pa.array(rows)), others, True)):
                columns = [pa.array(h.view(np.int64)) for h in found[:4]]
                flag = pa.array(np.full(some.num_rows, second))
                yield pa.RecordBatch.from_arrays([*some.columns, *columns, flag], [*batch.schema.names, "s1", "s2", "w1", "w2", "second"])

    return run


def checked(looks: bool):
    """Of batches (key, second, kind, name, other, other_second) those rows whose texts are not equal after all, with a digest of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = FoldTable(looks)
        for batch in batches:
            bad, digests = [], []
            columns = (batch.column(c).to_pylist() for c in ("kind", "name", "second", "other", "other_second"))
            for i, (kind, name, second, other, other_second) in enumerate(zip(*columns)):
                a, b = ((text, table, flag) for text, flag in ((name, second), (other, other_second)))
                if kind == "s":
                    same = same_sequence(folded_codes(*a), folded_codes(*b))
                else:
                    same = Counter(words_of(folded_codes(*a))) == Counter(words_of(folded_codes(*b)))
                if not same:
                    text = "".join(folded_codes(*a)) if kind == "s" else "\0".join(sorted(words_of(folded_codes(*a))))
                    bad.append(i)
                    digests.append(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
            if bad:
                some = batch.take(pa.array(bad))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("key", "second", "kind")), pa.array(digests)], ["key", "second", "kind", "digest"])

    return run


def layout_groups(records: DataFrame, *, looks: bool = False) -> DataFrame:
    """``key, first_key`` for every record that shares its group with another.

    ``records`` has ``key`` (long, unique), ``scope`` (text; only records of one scope are compared)
    and ``name``. ``looks`` brings names to one form first, by the table of look-alikes; a word that
    can be read in two scripts is read in both, and its record links what either reading does.
    """
    ship_package(records.sparkSession)
    rows = records.where("key is not null and name is not null").select("key", "scope", "name")
    fields = "key long, scope string, name string, s1 long, s2 long, w1 long, w2 long, second boolean"
    rows = stage(rows.mapInArrow(hashed(looks), fields), "layouts")
    # a record has four links at most: two readings, two kinds
    linked = _links(rows, "s", looks).union(_links(rows, "w", looks)).groupBy("key").agg(F.min("first").alias("a"), F.collect_set("first").alias("firsts"))
    linked = stage(linked, "layout-links")
    # only first records that some record ties together need the search for groups
    ties = linked.where(F.size("firsts") > 1).select("a", F.explode("firsts").alias("b")).where("a <> b").distinct()
    groups = connected_groups(ties, "a", "b")
    found = linked.join(groups, F.col("a") == F.col("member"), "left").select("key", F.coalesce("group_key", "a").alias("first_key"))
    unstage(rows)
    return found


def layout_counts(groups: DataFrame) -> DataFrame:
    """``first_key, copies`` of each group of ``layout_groups``: its record and how many records are one with it."""
    return groups.groupBy("first_key").agg(F.count("*").alias("copies"))


def _links(rows: DataFrame, kind: str, looks: bool) -> DataFrame:
    """``key, first``: the smallest record with the same verified hashes, for groups of two or more."""
    hashes = [f"{kind}1", f"{kind}2"]
    groups = rows.groupBy("scope", *hashes).agg(F.min(F.struct("key", "second")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = groups.select("scope", *hashes, F.col("least.key").alias("first"), F.col("least.second").alias("other_second"))
    members = stage(rows.join(groups, ["scope", *hashes]).select("key", "second", "scope", "name", "first", "other_second"), f"layout-{kind}")
    firsts = members.where("key = first and second = other_second").select("first", "other_second", F.col("name").alias("other"))
    compared = members.join(firsts, ["first", "other_second"]).where("name <> other")
    compared = compared.select("key", "second", F.lit(kind).alias("kind"), "name", "other", "other_second")
    false = compared.mapInArrow(checked(looks), "key long, second boolean, kind string, digest string").drop("kind")
    false = stage(false, f"layout-{kind}-false")
    if not false.limit(1).count():
        return members.select("key", "first")
    good = members.join(false, ["key", "second"], "left")
    again = good.where("digest is not null")
    regrouped = again.groupBy("scope", "first", "digest").agg(F.min("key").alias("own"))
    again = again.join(regrouped, ["scope", "first", "digest"]).select("key", F.col("own").alias("first"))
    return good.where("digest is null").select("key", "first").union(again)
