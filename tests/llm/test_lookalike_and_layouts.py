import itertools
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfold.llm.layouts import FoldTable, folded_codes, layout_counts, layout_groups, same_sequence, streamed, words_of
from nearfold.llm.lookalike import lookalike_classes, lookalike_pairs, skeleton


def pairs(df):
    return sorted((r.ord_a, r.ord_b) for r in df.collect())


def test_skeletons():
    same = ["Café II", "Café II", "Ｃａｆé　Ⅱ", "C​a­fé II", "Сafé II", "Cаfé ІІ", "﻿Café II"]
    assert len({skeleton(x) for x in same}) == 1
    different = ["Cafe II", "café II", "Café  II", "Café\tII", "Café II ", "Café–II", "Café-II", "Café 11", "Café ll", "Cafè II"]
    assert len({skeleton(x) for x in [*same, *different]}) == 1 + len(different)
    assert skeleton("ｶﾞ") == skeleton("ガ") != skeleton("カ") and skeleton(None) is None and skeleton("") == ""


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_skeleton_is_stable(text):
    assert skeleton(skeleton(text)) == skeleton(text) == skeleton(unicodedata.normalize("NFC", text)) == skeleton(unicodedata.normalize("NFD", text))


def test_lookalike_pairs(spark):
    rows = [(1, "a b"), (2, "а b"), (3, "a b"), (4, "a b"), (5, "a  b"), (6, None), (7, ""), (8, "​"), (9, "A b"), (None, "а b"), (10, "x" * 60000), (11, "х" + "x" * 59999)]
    df = spark.createDataFrame([(k, s, 0, "s") for k, s in rows], "ord long, raw_name string, parts int, look string")
    want = [(a, b) for (a, x), (b, y) in itertools.combinations([r for r in rows if r[0] is not None and r[1] is not None], 2) if x != y and skeleton(x) == skeleton(y)]
    assert pairs(lookalike_pairs(df)) == sorted(want) and (2, 3) in want and (1, 4) not in want
    assert pairs(lookalike_pairs(df, rows_per_salt=1)) == sorted(want)
    assert pairs(lookalike_pairs(df.where("false"))) == []


def test_hot_string_is_salted_and_whole(spark):
    df = spark.range(600).selectExpr("id as ord", "case when id % 3 = 0 then 'hot name' when id % 3 = 1 then concat('n', id) else case when id < 9 then 'hоt name' else concat('m', id) end end as raw_name")
    assert lookalike_pairs(df, rows_per_salt=50).count() == 200 * 3


def grouped(df):
    return {r.key: r.first_key for r in df.collect()}


def brute(rows, looks):
    table, parent, seen = FoldTable(looks), {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for key, scope, name in sorted(r for r in rows if r[0] is not None and r[2] is not None):
        parent[key] = key
        for second in (False, True):
            words = sorted(words_of(folded_codes(name, table, second)))
            ordered = "".join(folded_codes(name, table, second))
            for mark in ([("s", scope, ordered), ("w", scope, tuple(words))] if ordered else [("raw", scope, name)]):
                if mark in seen:
                    a, b = sorted((find(seen[mark]), find(key)))
                    parent[b] = a
                else:
                    seen[mark] = key
    groups = defaultdict(list)
    for key in parent:
        groups[find(key)].append(key)
    return {k: first for first, members in groups.items() if len(members) > 1 for k in members}


NAMES = [
    "Some Title - 01", "01 some.title", "SOMETITLE01", "Title Some 01", "some title title 01", "Some_Title_01!!", "straße 1", "STRASSE 1", "", None, " - ", "-", " - ",
    "Ga·rden", "Garden", "a" * 70000, "A" * 70000, "Ⅱ x", "II x", "é", "é", "E", "ΣΑΣ", "σας",
]


def test_layout_groups(spark):
    rows = [(i, "" if i % 5 else None, n) for i, n in enumerate(NAMES)] + [(100, "other", NAMES[0]), (None, "", NAMES[0])]
    rows = [(k, s or "", n) for k, s, n in rows]
    df = spark.createDataFrame([(k, s, n, 1, "x") for k, s, n in rows], "key long, scope string, name string, s1 int, first string")
    for looks in (False, True):
        assert grouped(layout_groups(df, looks=looks)) == brute(rows, looks)
    assert grouped(layout_groups(df.where("false"))) == {}


def test_layout_chains_join_over_both_hashes(spark):
    names = ["a bc", "bc a", "bca", "b ca", "ca b", "zz"]
    df = spark.createDataFrame(list(enumerate(names)), "key long, name string").selectExpr("key", "'' as scope", "name")
    assert grouped(layout_groups(df)) == dict.fromkeys(range(5), 0)


def test_streamed_hashes_follow_equality():
    texts = [n for n in NAMES if n] + ["b a", "a b", "ab", "a  b", "ab c", "a bc"]
    table = FoldTable(False)
    hashes = streamed(texts, table)[0]

    def codes(text):
        return folded_codes(text, table)

    for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2):
        if hashes[4, i] and hashes[4, j]:
            assert (hashes[0, i] == hashes[0, j]) == same_sequence(codes(a), codes(b)), (a[:9], b[:9])
            assert (hashes[2, i] == hashes[2, j]) == (sorted(words_of(codes(a))) == sorted(words_of(codes(b)))), (a[:9], b[:9])


def test_false_collisions_are_split(spark, monkeypatch):
    from nearfold.llm import layouts

    real = layouts.streamed

    def colliding(texts, table):
        out, *rest = real(texts, table)
        out[:4, out[4] > 0] = np.uint64(7)
        return out, *rest

    rows = [(0, "", "a b"), (1, "", "c d"), (2, "", "A-B"), (3, "", "d c"), (4, "", "e")]
    table = FoldTable(False)
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(3)], ["key", "scope", "name"])
    monkeypatch.setattr(layouts, "streamed", colliding)
    hashed = list(layouts.hashed(False)(iter([batch])))[0].to_pylist()
    staged = spark.createDataFrame(hashed, "key long, scope string, name string, s1 long, s2 long, w1 long, w2 long, second boolean")
    links = {kind: {r.key: r["first"] for r in layouts._links(staged, kind, False).collect()} for kind in "sw"}
    assert links["s"][2] == 0 and links["s"][1] != links["s"][0] and links["w"][3] == links["w"][1] != 0
    assert links["s"][4] not in (0, 1) and not same_sequence(folded_codes("a b", table), folded_codes("c d", table))


def test_case_and_looks_together(spark):
    alike = [
        ["Старий Тара 01", "СТАРИЙ ТАРА 01", "старий_тара_01", "CTAPИЙ тара - 01", "Стaрий TАРА 01"],
        ["Marble Home 2", "Μаrble HОME 2", "MARBLE ΗOME 2", "2 marble home"],
        ["van", "VAN", "Vаn"],
        ["nan"],
        ["notes 49 тИРАТИГЕ", "NOTES 49 Тиратиге", "notes49тиратиге", "NOTES49ТИРАТИГЕ"],
        ["ТАРА", "тара", "TAPA"],
    ]
    names = [n for group in alike for n in group]
    df = spark.createDataFrame(list(enumerate(names)), "key long, name string").selectExpr("key", "'' as scope", "name")
    found = grouped(layout_groups(df, looks=True))
    want, at = {}, 0
    for group in alike:
        want.update({at + i: at for i in range(len(group)) if len(group) > 1})
        at += len(group)
    assert found == want
    assert {r.first_key: r.copies for r in layout_counts(layout_groups(df, looks=True)).collect()} == {k: list(want.values()).count(k) for k in set(want.values())}


def test_lookalike_classes_are_the_closure_of_the_pairs(spark):
    names = ["Abc", "Аbc", "Ａbc", "abc", "x", "x", "х", "ⲟk", "ok", "ᴏk", None]
    df = spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "ord long, raw_name string")
    assert {r.member: r.class_key for r in lookalike_classes(df).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 8, 9: 8, 10: 8}
    linked = {x for r in lookalike_pairs(df).collect() for x in r}
    assert linked == {r.member for r in lookalike_classes(df).collect()}
