import itertools
import random

import numpy as np
import pytest

from nearfold.functions.similarity import audio_scores, sequence_scores
from nearfold.llm import combinations
from nearfold.llm.alikeness import AUDIO, VIDEO
from nearfold.llm.combinations import Entries, Index, combination_pairs, covering_family, family, groups_of, subset_family
from nearfold.llm.components import connected_groups, roots_of
from nearfold.llm.expansion import member_pairs
from nearfold.llm.fingerprints import alike_pairs
from nearfold.llm.history import History, refused_rows
from nearfold.llm.hotpairs import combined, near_words


def smallest(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {x: find(x) for x in parent}


def test_roots():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 400):
        a, b = rng.integers(0, n, n), rng.integers(0, n, n)
        want = smallest([*zip(a.tolist(), b.tolist()), *((i, i) for i in range(n))])
        assert roots_of(n, a, b).tolist() == [want[i] for i in range(n)]


@pytest.mark.parametrize("per_task", [1 << 20, 40, 7])
def test_connected_groups(spark, per_task):
    rng = random.Random(per_task)
    edges = [(f"v{rng.randrange(90):02d}", f"v{rng.randrange(90):02d}") for _ in range(60)] + [(f"c{i:02d}", f"c{(i + 1) % 60:02d}") for i in range(60)]
    edges += [("hub", f"h{i:02d}") for i in range(50)] + [("x", "x"), ("😀", "я"), (None, "q"), ("q", None)] + edges[:5] + [(b, a) for a, b in edges[5:9]]
    df = spark.createDataFrame([(a, b, "m", 1) for a, b in edges], "left string, right string, member string, root int")
    got = connected_groups(df, edges_per_task=per_task)
    rows = got.collect()
    assert {r.member: r.group_key for r in rows} == smallest(edges) and len(rows) == len({r.member for r in rows})


def test_connected_groups_of_numbers_and_of_nothing(spark):
    df = spark.createDataFrame([(5, 9), (9, 2), (7, 7)], "left long, right long")
    assert {r.member: r.group_key for r in connected_groups(df).collect()} == {2: 2, 5: 2, 9: 2, 7: 7}
    assert connected_groups(df.where("false")).count() == 0


def signed(word):
    return word - 2**64 if word >= 2**63 else word


def flipped(rng, word, bits, width=64):
    for i in rng.sample(range(width), bits):
        word ^= 1 << i
    return word


def every_word(values, offsets):
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return Entries(np.zeros(len(row), np.int64), values[offsets[0] : offsets[-1]], row)


@pytest.mark.parametrize("width,tolerance", [(16, 1), (16, 2), (12, 3), (11, 4), (10, 5)])
def test_families_leave_a_combination_whole(width, tolerance):
    families = [subset_family(3, width, tolerance, k) for k in (1, 2, 3)] + [covering_family(3, width, tolerance)]
    for masks in families:
        for damaged in itertools.combinations(range(3, 3 + width), tolerance):
            harm = sum(1 << i for i in damaged)
            assert any(not m & harm for m in masks)


@pytest.mark.parametrize("words", [10, 10**5, 10**7, 10**10])
@pytest.mark.parametrize("bits,tolerance", [(64, 9), (64, 8), (64, 11), (32, 1), (32, 2)])
def test_the_chosen_family_leaves_a_combination_whole(words, bits, tolerance):
    rng = random.Random(tolerance)
    masks = family(words, bits, tolerance)
    for _ in range(2000):
        harm = sum(1 << i for i in rng.sample(range(bits), tolerance))
        assert any(not m & harm for m in masks)
    groups = groups_of(masks, words, 1 << 22)
    assert sorted(m for g, _, _ in groups for m in g) == sorted(masks) and all(not shared & ~m for g, shared, _ in groups for m in g)


@pytest.mark.parametrize("bits,most,words,per_task", [(64, 4, 10, 1 << 22), (64, 4, 10**7, 1 << 22), (64, 8, 10**6, 1 << 22), (32, 1, 10**6, 1 << 19), (64, 9, 300, 1 << 22)])
def test_combinations_miss_nothing_within_tolerance(spark, bits, most, words, per_task):
    rng = random.Random(bits + most)
    items = []
    for i in range(60):
        base = rng.getrandbits(bits)
        items += [(2 * i, [base, rng.getrandbits(bits)]), (2 * i + 1, [rng.getrandbits(bits), flipped(rng, base, rng.randrange(most + 2), bits)])]
    df = spark.createDataFrame([(i, [signed(w) for w in ws]) for i, ws in items], "id long, words array<long>")
    want = {(a, b) for a, x in items for b, y in items if a < b and any((v ^ w).bit_count() <= most for v in x for w in y)}
    rows = combination_pairs(df, [Index(every_word, bits, most, words)], per_task=per_task).collect()
    assert {(r.a, r.b) for r in rows} == want and len(rows) == len(want)
    assert combination_pairs(df.where("false"), [Index(every_word, bits, most, words)]).count() == 0


def test_groups_of_a_large_table_are_sent_in_rounds(spark):
    large = [Index(every_word, 64, 9, 5_000_000, keys=27), Index(every_word, 64, 8, 72_000_000)]
    rounds = combinations.rounds_of(large, combinations.ENTRIES_PER_TASK, combinations.ENTRIES_PER_ROUND)
    sent = [sum(large[g.index].words * large[g.index].keys for g in r) for r in rounds]
    assert len(rounds) > 10 and max(sent) <= 2 * 27 * 5_000_000
    assert [(g.index, g.masks) for r in rounds for g in r] == [(i, m) for i, x in enumerate(large) for m, _, _ in x.groups(combinations.ENTRIES_PER_TASK)]
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    items = [(i, [signed(flipped(rng, rng.choice(base), rng.randrange(6))) for _ in range(rng.randrange(1, 4))]) for i in range(150)]
    df = spark.createDataFrame(items, "id long, words array<long>")
    index = [Index(every_word, 64, 5, 300), Index(every_word, 64, 2, 300)]
    assert len(combinations.rounds_of(index, 40, 1)) > 2
    want = {(r.a, r.b) for r in combination_pairs(df, index).collect()}
    got = [(r.a, r.b) for r in combination_pairs(df, index, per_task=40, per_round=1).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


def test_a_staged_write_leaves_no_shuffle_files(spark):
    from nearfold import runtime

    def files() -> int:
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    before = files()
    staged = runtime.stage(spark.range(1000).selectExpr("id", "id * 7 % 10 as x").repartition(3, "x"), "tidy")
    assert files() <= before and spark.conf.get(runtime.TIDY, "false") == "false"
    assert staged.count() == 1000


def test_more_words_get_longer_combinations():
    sizes = [min(m.bit_count() for m in family(n, 64, 4)) for n in (100, 10**6, 10**8, 10**10)]
    assert sizes == sorted(sizes) and sizes[-1] > sizes[0]


@pytest.mark.parametrize("few", [1, 64])
def test_near_words(monkeypatch, few):
    from nearfold.llm import hotpairs

    monkeypatch.setattr(hotpairs, "FEW_WORDS", few)
    rng = random.Random(4)
    hot = [rng.getrandbits(64) for _ in range(5)] + [0, 1]
    words = hot[:2] + [flipped(rng, rng.choice(hot), rng.randrange(16)) for _ in range(80)] + [rng.getrandbits(64) for _ in range(20)] + hot[:1]
    at, which = near_words(np.array(words, np.uint64), np.array(hot, np.uint64), 11, 64)
    want = [(i, j) for i, w in enumerate(words) for j, h in enumerate(hot) if (w ^ h).bit_count() <= 11]
    assert list(zip(at.tolist(), which.tolist())) == want


def test_combined_labels_count_as_often_as_they_come():
    assert combined([1, 1, 1, 1], 2) == combined([1, 1], 2) and len(combined([1, 1, 2], 2)) == 2 and not combined([1], 2)


def test_distances():
    assert VIDEO.distance(15, 0, True) == 9 and VIDEO.distance(15, 0, False) == 8 and VIDEO.distance(15, 2) == 11 and AUDIO.distance(25, 0) == 1
    assert all(VIDEO.distance(n, VIDEO.lost(n)) <= VIDEO.reach for n in range(1, 200)) and VIDEO.lost(1) == 0 and VIDEO.lost(15) == 2


def test_member_pairs_salted(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 1)], "a long, b long")
    members = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 100), (3, 200)], "g long, m long")
    got = [(r.m_a, r.m_b) for r in member_pairs(pairs, members, per_salt=4).collect()]
    assert sorted(got) == sorted([(i, 100) for i in range(30)] + [(i, j) for i in range(30) for j in range(30)])


def make_media(rng, noise=9):
    rows = []
    for f in range(25):
        base = [rng.getrandbits(64) for _ in range(15)]
        for copy in range(4):
            words = [flipped(rng, w, rng.randrange(0, noise if rng.random() < 0.9 else 20)) for w in base]
            for _ in range(rng.randrange(3)):
                words.pop(rng.randrange(len(words))) if rng.random() < 0.5 else words.insert(rng.randrange(len(words)), rng.getrandbits(64))
            rows.append({"fingerprint": [signed(w) for w in words], "fingerprint_version": rng.choice([2, 2, 2, 1, None]), "duration": 1000.0 + rng.choice([0, 1, 600]), "full_hash": rng.choice([None, f"{f}", f"{f}-{copy}"])})
            rows.append(dict(rows[-1], full_hash=rng.choice([None, rows[-1]["full_hash"]])))
    for f in range(20):
        word, colour = rng.getrandbits(64), [rng.randrange(256) for _ in range(3)]
        for _ in range(4):
            rows.append({"image_fingerprint": [signed(flipped(rng, word, rng.randrange(11))), *colour], "full_hash": rng.choice([None, f"i{f}"])})
    for f in range(15):
        words = [rng.getrandbits(32) for _ in range(25)]
        for _ in range(4):
            some = [flipped(rng, w, rng.choice([0, 0, 1, 2]), 32) for w in words[rng.randrange(4) :]]
            rows.append({"audio_fingerprint": some, "duration": 100.0 + rng.randrange(6), "full_hash": rng.choice([None, f"a{f}"])})
    short = [rng.getrandbits(64)]
    rows += [{"fingerprint": [signed(flipped(rng, w, 9)) for w in short], "fingerprint_version": 2, "duration": 50.0} for _ in range(2)]
    rows += [{"fingerprint": f, "fingerprint_version": 2, "duration": d} for f, d in (([], 1.0), (None, 1.0), ([None, 1], 1.0), ([5], None), ([5], float("nan")), ([5], 0.0), ([5], -1.0))]
    rows += [{"audio_fingerprint": f, "duration": d} for f, d in (([], 1.0), ([3], None), ([3], float("nan")))] + [{"image_fingerprint": f} for f in ([], [1], [1, 2, 3, 4, 5], [None, 1, 1, 1])]
    return rows


def ragged(rows, kind):
    return np.array([w for r in rows for w in r], kind).view(np.uint64), np.cumsum([0, *map(len, rows)])


def brute_media(rows, medium):
    out = set()
    for j, b in enumerate(rows):
        for i, a in enumerate(rows[:j]):
            if a.get("full_hash") and a.get("full_hash") == b.get("full_hash"):
                continue
            if medium == "image":
                x, y = a.get("image_fingerprint"), b.get("image_fingerprint")
                if x and y and len(x) == len(y) == 4 and None not in x + y:
                    score = 0.8 * (100 * (1 - ((x[0] ^ y[0]) & (2**64 - 1)).bit_count() / 64)) + 0.2 * (100 * (1 - sum(abs(p - q) for p, q in zip(x[1:], y[1:])) / 765))
                    if score >= 90:
                        out.add((i, j))
                continue
            column = "fingerprint" if medium == "video" else "audio_fingerprint"
            x, y, d, e = a.get(column), b.get(column), a.get("duration"), b.get("duration")
            if not x or not y or None in x + y or d is None or e is None or d != d or e != e:
                continue
            if medium == "video":
                if a["fingerprint_version"] == b["fingerprint_version"] == 2 and min(d, e) > 0 and max(d, e) / min(d, e) <= 1.5 and abs(d - e) <= 900:
                    if sequence_scores(*ragged([x], np.int64), *ragged([y], np.int64))[0] >= 85:
                        out.add((i, j))
            elif abs(d - e) <= 3 and audio_scores(*ragged([x], np.int64), *ragged([y], np.int64))[0] >= 94:
                out.add((i, j))
    return out


@pytest.mark.parametrize("medium", ["video", "image", "audio"])
def test_alike_pairs_equal_brute_force(spark, make_files, medium):
    rows = make_media(random.Random(11))
    got = [(r.ord_a, r.ord_b) for r in alike_pairs(make_files(rows), medium).collect()]
    want = brute_media(rows, medium)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert alike_pairs(make_files(rows).where("false"), medium).count() == 0


def hot_media(rng, n=60):
    """Items that share hot words; partners agree on these only and are too far apart in the others to be found by them."""
    shared, silence = [rng.getrandbits(64) for _ in range(7)], [rng.getrandbits(32) for _ in range(5)]
    rows = []
    for i in range(n):
        video, audio = [rng.getrandbits(64) for _ in range(8)], [rng.getrandbits(32) for _ in range(5)]
        for copy in range(2 if i % 2 else 1):
            words = [flipped(rng, w, 12) for w in video] if copy else video
            tracks = [flipped(rng, w, 3, 32) for w in audio] if copy else audio
            rows.append({"fingerprint": [signed(w) for w in shared + words], "fingerprint_version": 2, "duration": 500.0, "audio_fingerprint": silence + tracks})
    # a frame near a hot one, in an item that never held it
    rows.append({"fingerprint": [signed(w) for w in [flipped(rng, shared[0], 3)] + [flipped(rng, w, 10) for w in shared[1:]]] + rows[0]["fingerprint"][7:], "fingerprint_version": 2, "duration": 500.0})
    return rows


@pytest.mark.parametrize("medium", ["video", "audio"])
def test_pairs_that_share_only_hot_words(spark, make_files, monkeypatch, medium):
    monkeypatch.setattr(combinations, "HOT_ITEMS", 20)
    rows = hot_media(random.Random(5))
    got = [(r.ord_a, r.ord_b) for r in alike_pairs(make_files(rows), medium).collect()]
    want = brute_media(rows, medium)
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 30


@pytest.mark.parametrize("words", [10, 10**7, 10**10])
def test_videos_at_the_edge_are_found_with_any_family(spark, make_files, monkeypatch, words):
    monkeypatch.setattr(combinations, "family", lambda _, bits, tolerance: family(words, bits, tolerance))
    rng, rows = random.Random(words), []
    for _ in range(40):
        frames = [rng.getrandbits(64) for _ in range(8)]
        rows += [{"fingerprint": [signed(w) for w in x], "fingerprint_version": 2, "duration": 500.0} for x in (frames, [flipped(rng, w, 9) for w in frames])]
    got = {(r.ord_a, r.ord_b) for r in alike_pairs(make_files(rows), "video").collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(40)}


def odd_lengths(rng):
    """Videos cut, extended and very unlike in length, at the edge of the score."""
    rows = []
    for f in range(30):
        base = [rng.getrandbits(64) for _ in range(rng.choice([1, 2, 3, 5, 15, 15, 24, 40]))]
        for bits in (0, 9, 8, 6):
            words = [flipped(rng, w, bits) for w in base]
            for _ in range(rng.randrange(4)):
                if rng.random() < 0.5 and len(words) > 1:
                    words.pop(rng.randrange(len(words)))
                else:
                    words.insert(rng.randrange(len(words) + 1), rng.getrandbits(64))
            rows.append({"fingerprint": [signed(w) for w in words], "fingerprint_version": 2, "duration": 500.0})
    return rows


def test_videos_of_odd_lengths(spark, make_files):
    rows = odd_lengths(random.Random(8))
    got = {(r.ord_a, r.ord_b) for r in alike_pairs(make_files(rows), "video").collect()}
    assert got == brute_media(rows, "video") and len(got) > 50


def black_frames(rng, n=200):
    """Videos of which most hold some of three frequent frames, exact or a few bits off, up to nothing else."""
    frequent, rows = [0, rng.getrandbits(64), rng.getrandbits(64)], []
    for i in range(n):
        base = [rng.getrandbits(64) for _ in range(rng.choice([1, 3, 6, 10, 15, 15, 15]))]
        for at in rng.sample(range(len(base)), min(len(base), rng.choice([0, 1, 1, 2, 3, 5]))):
            base[at] = rng.choice(frequent)
        for bits in (0, rng.choice([9, 10, 11, 12]))[: 1 + i % 2]:
            words = [flipped(rng, w, bits if w not in frequent else rng.choice([0, 0, 1, 4])) for w in base]
            rows.append({"fingerprint": [signed(w) for w in words], "fingerprint_version": 2, "duration": 500.0 + rng.choice([0, 0, 400])})
    return rows


def test_videos_with_frequent_frames(spark, make_files, monkeypatch):
    monkeypatch.setattr(combinations, "HOT_ITEMS", 20)
    rows = black_frames(random.Random(12))
    got = {(r.ord_a, r.ord_b) for r in alike_pairs(make_files(rows), "video").collect()}
    assert got == brute_media(rows, "video") and len(got) > 50


def test_images_of_one_frequent_word(spark, make_files, monkeypatch):
    monkeypatch.setattr(combinations, "HOT_ITEMS", 20)
    rng = random.Random(3)
    rows = [{"image_fingerprint": [signed(flipped(rng, 5, rng.choice([0, 0, 0, 2, 9]))), *(rng.randrange(256) for _ in range(3))]} for _ in range(80)]
    got = {(r.ord_a, r.ord_b) for r in alike_pairs(make_files(rows), "image").collect()}
    assert got == brute_media(rows, "image") and len(got) > 50


def sequential(old, new):
    accepted, out = [dict(r, ord=i) for i, r in enumerate(old)], set()

    def words(r):
        f, d = r.get("fingerprint"), r.get("duration")
        return f if f and None not in f and r.get("fingerprint_version") == 2 and d is not None and d == d and d > 0 else None

    for r in sorted(new, key=lambda r: r["ord"]):
        same = [a["ord"] for a in accepted if r.get("full_hash") is not None and a.get("full_hash") == r["full_hash"]]
        near = []
        if not same and words(r):
            for a in accepted:
                if words(a) and max(a["duration"], r["duration"]) / min(a["duration"], r["duration"]) <= 1.5 and abs(a["duration"] - r["duration"]) <= 900:
                    if sequence_scores(*ragged([words(a)], np.int64), *ragged([words(r)], np.int64))[0] >= 85:
                        near.append(a["ord"])
        if same or near:
            out.add((min(same or near), r["ord"], "exact" if same else "near"))
        else:
            accepted.append(r)
    return out


def refused(make_files, old, new):
    new = [dict(r, ord=1000 + i) for i, r in enumerate(new)]
    got = [tuple(r) for r in refused_rows(make_files(old), make_files(new)).collect()]
    want = sequential(old, new)
    assert len(got) == len(set(got)) and set(got) == want
    return want


def test_refused_rows_that_share_only_hot_words(spark, make_files, monkeypatch):
    monkeypatch.setattr(combinations, "HOT_ITEMS", 20)
    rng = random.Random(6)
    shared = [rng.getrandbits(64) for _ in range(7)]
    other = [[rng.getrandbits(64) for _ in range(8)] for _ in range(40)]
    media = [[{"fingerprint": [signed(w) for w in shared + [flipped(rng, w, bits) for w in words]], "fingerprint_version": 2, "duration": 500.0} for words in other] for bits in (0, 12)]
    assert len(refused(make_files, *media)) == 40


@pytest.mark.parametrize("frames", [1, 2, 15])
def test_refused_rows_at_the_edge(spark, make_files, frames):
    rng = random.Random(frames)
    words = [[rng.getrandbits(64) for _ in range(frames)] for _ in range(40)]
    media = [[{"fingerprint": [signed(flipped(rng, w, bits)) for w in f], "fingerprint_version": 2, "duration": 500.0} for f in words] for bits in (0, 9)]
    assert len(refused(make_files, *media)) == 40


def test_refused_rows_with_the_noise_of_pairs(spark, make_files):
    rows = [r for r in make_media(random.Random(31)) if "fingerprint" in r]
    random.Random(1).shuffle(rows)
    refused(make_files, rows[:100], rows[100:])


@pytest.mark.parametrize("step", [200_000, 40])
def test_refused_rows_equal_one_by_one(spark, make_files, step):
    rng = random.Random(21)
    rows = [r for r in make_media(rng, 5) if "fingerprint" in r] + [{"full_hash": None}, {"full_hash": "lone"}, {"full_hash": "lone"}]
    rng.shuffle(rows)
    old, new = rows[:60], [dict(r, ord=1000 + i) for i, r in enumerate(rows[60:] + rows[60:75])]
    got = [tuple(r) for r in refused_rows(make_files(old), make_files(new), step_rows=step).collect()]
    want = sequential(old, new)
    assert len(got) == len(set(got)) and set(got) == want and {h for *_, h in want} == {"exact", "near"}


def test_refused_rows_of_empty_tables(spark, make_files):
    new = make_files([{"ord": 1000, "full_hash": "h"}, {"ord": 1001, "full_hash": "h"}, {"ord": 1002}])
    none = make_files([{}]).where("false")
    assert [tuple(r) for r in refused_rows(none, new).collect()] == [(1000, 1001, "exact")]
    assert refused_rows(make_files([{"full_hash": "h"}]), new.where("false")).count() == 0


@pytest.mark.parametrize("make", [odd_lengths, black_frames])
@pytest.mark.parametrize("chunk", [1000, 10])
def test_refused_rows_of_hard_videos(spark, make_files, monkeypatch, make, chunk):
    from nearfold.llm import history

    monkeypatch.setattr(combinations, "HOT_ITEMS", 20)
    monkeypatch.setattr(history, "FIRST_CHUNK", chunk)
    rng = random.Random(17)
    rows = make(rng)
    rng.shuffle(rows)
    for i, row in enumerate(rows):
        row.update(full_hash=rng.choice([None, None, f"{i % 40}"]), duration=row["duration"] * rng.choice([1, 1, 1.4, 3]))
    half = len(rows) // 2
    assert len(refused(make_files, rows[:half], rows[half:] + rows[half : half + 20])) > 20


def test_a_large_batch_searches_the_old_history_once(spark, make_files, monkeypatch):
    from nearfold.llm import history

    searched, probed = [], history._probed
    monkeypatch.setattr(history, "_probed", lambda folders, *rest: searched.append(str(folders)) or probed(folders, *rest))
    rows = [r for r in make_media(random.Random(43), 5) if "fingerprint" in r]
    random.Random(3).shuffle(rows)
    old, new = rows[:60], [dict(r, ord=1000 + i) for i, r in enumerate(rows[60:])]
    got = {tuple(r) for r in refused_rows(make_files(old), make_files(new), step_rows=len(new) // 3).collect()}
    assert got == sequential(old, new)
    assert sum("signatures/number=1/" in folders for folders in searched) == 1 < len(searched)


@pytest.mark.parametrize("tolerance", [0, 3, 8, 9, 11])
def test_crossing_words_misses_none(tolerance):
    rng = np.random.default_rng(tolerance)
    a = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, tolerance + i % 2, False)) for i in range(600)], np.uint64)
    b = np.concatenate([a[:600] ^ flips, rng.integers(0, 1 << 63, 900, dtype=np.uint64), np.repeat(a[:2], 700)])
    masks = combinations.crossing_family(len(a), len(b), 64, tolerance)
    got = {pair for i, j in combinations.crossing_words(a, b, masks, tolerance) for pair in zip(i.tolist(), j.tolist())}
    assert got == set(zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(a[:, None] ^ b) <= tolerance))))


def test_a_history_is_opened_again_and_merged(spark, make_files, monkeypatch, tmp_path):
    from nearfold.llm import history

    monkeypatch.setattr(history, "MOST_PARTS", 3)
    rows = [r for r in make_media(random.Random(41), 5) if "fingerprint" in r]
    random.Random(2).shuffle(rows)
    new = [dict(r, ord=1000 + i) for i, r in enumerate(rows[80:])]
    path = f"file://{tmp_path}/store"
    History.create(make_files(rows[:80]), path)
    got, numbers = set(), []
    for at in range(0, len(new), 25):
        opened = History.open(spark, path)
        got |= {tuple(r) for r in opened.take_in(make_files(new[at : at + 25])).collect()}
        numbers.append(len(opened.state["parts"]))
    assert got == sequential(rows[:80], new) and max(numbers) == 3
    with pytest.raises(FileNotFoundError):
        History.open(spark, f"file://{tmp_path}/none")


def test_a_batch_that_failed_is_taken_in_again(spark, make_files, monkeypatch, tmp_path):
    path = f"file://{tmp_path}/store"
    History.create(make_files([{"full_hash": "a"}]), path)
    batch = make_files([{"ord": 1000, "full_hash": "b"}, {"ord": 1001, "full_hash": "a"}])
    with monkeypatch.context() as broken:
        broken.setattr(History, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            History.open(spark, path).take_in(batch)
    assert [tuple(r) for r in History.open(spark, path).take_in(batch).collect()] == [(0, 1001, "exact")]
    assert {tuple(r) for r in History.open(spark, path).take_in(batch).collect()} == {(1000, 1000, "exact"), (0, 1001, "exact")}


def test_many_newcomers_of_one_fingerprint(spark, make_files):
    rng = random.Random(1)
    words = [rng.getrandbits(64) for _ in range(15)]
    alike = [{"fingerprint": [signed(flipped(rng, w, rng.randrange(3))) for w in words], "fingerprint_version": 2, "duration": 500.0, "ord": 1000 + i} for i in range(4000)]
    got = [tuple(r) for r in refused_rows(make_files([{"full_hash": "x"}]), make_files(alike)).collect()]
    assert sorted(got) == [(1000, i, "near") for i in range(1001, 5000)]
