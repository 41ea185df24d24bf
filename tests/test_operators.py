import random

import pytest
from pyspark.sql import functions as F

from nearfold.operators import clusters, evaluation, exact, journal, matching, naming, planning, review, store
from nearfold.operators.components import components


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)] + [("s", "s"), (None, "x")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = components(spark.createDataFrame(edges, "left string, right string"))
    assert sorted((r.node, r.component) for r in got.collect()) == sorted((x, find(x)) for x in parent)
    assert components(spark.createDataFrame([], "left string, right string")).count() == 0


def test_exact_stages(spark, make_files):
    contents = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "abd"), (4, "longer"), (5, None)], "id int, content string")
    contents = contents.withColumn("size", F.octet_length("content").cast("long"))
    hashed = exact.hashed_contents(contents)
    assert sorted(r.id for r in hashed.collect()) == [1, 2] and hashed.select("full_hash").distinct().count() == 1
    groups = exact.exact_groups(make_files([{"full_hash": "h"}, {"full_hash": "h"}, {"full_hash": None}, {"full_hash": "i"}])).collect()
    assert [(g.hash_value, g.copies, g.paths) for g in groups] == [("h", 2, ["/r/0.mkv", "/r/1.mkv"])]


def test_image_matches_equal_brute_force(spark, make_files):
    rng = random.Random(2)
    rows = []
    for _ in range(60):
        word = rng.getrandbits(64)
        colour = [rng.randrange(256) for _ in range(3)]
        for _ in range(3):
            flipped = word
            for _ in range(rng.randrange(12)):
                flipped ^= 1 << rng.randrange(64)
            signed = flipped - 2**64 if flipped >= 2**63 else flipped
            rows.append({"image_fingerprint": [signed, *(min(255, c + rng.randrange(9)) for c in colour)], "full_hash": rng.choice([None, "a", str(len(rows))])})
    rows += [{"image_fingerprint": [1]}, {"image_fingerprint": None}]
    files = make_files(rows)
    for threshold in (90.0, 70.0, 0.0):
        want = set()
        for i, a in enumerate(rows[:-2]):
            for j, b in enumerate(rows[:i]):
                x, y = a["image_fingerprint"], b["image_fingerprint"]
                score = 0.8 * 100 * (1 - ((x[0] ^ y[0]) & (2**64 - 1)).bit_count() / 64) + 0.2 * 100 * (1 - sum(abs(p - q) for p, q in zip(x[1:], y[1:])) / 765)
                if score >= threshold and not (a["full_hash"] and a["full_hash"] == b["full_hash"]):
                    want.add((j, i))
        assert {(r.ord_a, r.ord_b) for r in matching.image_matches(files, threshold).collect()} == want
    assert matching.image_matches(files, 101.0).count() == 0


def test_image_matches_leave_out_null_words_and_copies(spark, make_files):
    words = [[5, 1, 2, 3], [5, 1, 2, 3], [5, 1, 2, 3], [7, 1, 2, 3], [5, 1, None, 3], [5, 1, None, 3], [None, 1, 2, 3], [None, 1, 2, 3]]
    files = make_files([{"image_fingerprint": w, "full_hash": h} for w, h in zip(words, ["a", "a", None, "a", "b", "c", "d", "e"])])
    found = {(r.ord_a, r.ord_b): r.similarity for r in matching.image_matches(files).collect()}
    assert found == {(0, 2): 100.0, (1, 2): 100.0, (2, 3): 98.75}


def test_image_matches_shuffle_no_row_per_image_and_mask(spark, make_files):
    files = make_files([{"image_fingerprint": [i * 0x0123456789ABCD, 0, 0, 0]} for i in range(3000)])
    plan = matching.image_matches(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_video_matches_and_recheck(spark, make_files):
    zeros, top, ones, half = [0] * 5, [-(2**63)] * 5, [-1] * 5, [0xFFFF] * 5
    files = make_files([{"fingerprint": f, "fingerprint_version": 2, "duration": d} for f, d in ((zeros, 60.0), (top, 60.0), (ones, 60.0), (half, 61.0), ([], 60.0))])
    rows = matching.videos(files)
    pairs = matching.video_matches(rows, rows).where("ord_a < ord_b").collect()
    assert [(r.ord_a, r.ord_b) for r in pairs] == [(0, 1)]
    again = matching.video_matches(rows, rows, recheck=True).where("ord_a < ord_b")
    assert {(r.ord_a, r.ord_b) for r in again.where("recheck").collect()} == {(0, 3), (1, 3)}

    def zero_frames(batches):
        for batch in batches:
            yield batch.assign(words=[zeros for _ in batch["path"]])

    best = matching.realigned(again, files, zero_frames).where("ord_a = 0 and ord_b = 3").collect()
    assert [r.similarity for r in best] == [100.0]


def test_bound_is_never_too_low(spark):
    import numpy as np

    from nearfold.functions.similarity import alike_sequences, score_bound, sequence_scores

    rng = random.Random(5)
    left = [[rng.getrandbits(63) & rng.getrandbits(63) for _ in range(rng.randrange(1, 16))] for _ in range(200)]
    right = [[w ^ (1 << rng.randrange(60)) if rng.random() < 0.7 else rng.getrandbits(63) for w in a][: rng.randrange(1, 16)] for a in left]
    ragged = [(np.array([w for r in x for w in r], np.uint64), np.cumsum([0, *map(len, x)])) for x in (left, right)]
    exact = sequence_scores(*ragged[0], *ragged[1])
    assert (score_bound(*ragged[0], *ragged[1]) + 1e-6 >= exact).all()
    assert (alike_sequences(*ragged[0], *ragged[1], 85.0) == (exact >= 85)).all() and (exact >= 85).any()


def test_clusters_and_folder_goldens(spark):
    files = spark.createDataFrame([("/a/1", "/a"), ("/b/1", "/b"), ("/b/2", "/b"), ("/b/3", "/b"), ("/a/2", "/a")], "path string, root string")
    same = spark.createDataFrame([("h", "/a/1"), ("h", "/b/1")], "hash_value string, path string")
    none = spark.createDataFrame([], "left string, right string, similarity double, level string")
    names = spark.createDataFrame([], "path string, core_title string, year int, episode int")
    found = clusters.assignments(files, same, none, names)
    assert {r.path: (r.cluster_id, r.level, r.confidence) for r in found.collect()}["/b/1"] == ("exact:/a/1", "exact", 100.0)
    pair = clusters.folder_pairs(found, 0).first()
    assert (pair.left, pair.right, pair.content_similarity) == ("/a", "/b", 25.0)
    small = clusters.folder_pairs(clusters.assignments(files.where("path <> '/b/3' and path <> '/a/2'"), same, none, names), 50.0).collect()
    assert [p.content_similarity for p in small] == [50.0]
    media = spark.createDataFrame([("/a/1", "/b/2", 93.0, "image"), ("/b/2", "/b/3", 91.0, "image"), ("/b/2", "/zz", 1.0, "video")], none.schema)
    levels = {r.path: (r.cluster_id, r.level, r.confidence) for r in clusters.assignments(files, same, media, names).collect()}
    assert levels["/b/1"] == ("image:/a/1", "image", 91.0) and levels["/a/2"] == ("path:/a/2", "path", 0.0)
    assert {r.path for r in clusters.one_sided(found, clusters.folder_pairs(found, 0), "right").collect()} == {"/b/2", "/b/3"}


def test_name_hints(spark):
    rows = [(1, "/1", "Title", None, 1), (2, "/2", "title ", None, 1), (3, "/3", "Title", 2000, 1), (4, "/4", "TITLE", None, 1), (5, "/5", None, None, 1)]
    titled = spark.createDataFrame(rows, "ord long, path string, core_title string, year int, episode int")
    hints = naming.exact_hints(titled, spark.createDataFrame([("/1",)], "path string")).collect()
    assert [(h.key, h.title, h.files) for h in hints] == [("name:title|None|1", "title ", 2)]
    keys = naming.name_keys(spark.createDataFrame([("the night clock", None, 1), ("the night clack", None, 1), ("night", None, 1), ("the night clock", None, 2)], "core_title string, year int, episode int"))
    pairs = naming.fuzzy_hints(keys, keys, 90.0).collect()
    assert {(p.left_title, p.right_title) for p in pairs} == {("the night clock", "the night clack"), ("the night clack", "the night clock")}


def test_model_replies_are_coerced(spark):
    asked = spark.createDataFrame([(0, 1, "A 01"), (0, 2, "B 02"), (1, 1, "C 03")], "batch int, id int, name string")
    replies = spark.createDataFrame([(0, 'ok {"results": [{"id": 1, "core_title": "A!", "year": "x", "episode": 7}, {"id": 9, "core_title": "?"}]}'), (1, "broken")], "batch int, reply string")
    got = {(r.batch, r.id): (r.core_title, r.year, r.episode, r.source) for r in naming.coerced(replies, asked).collect()}
    assert got == {(0, 1): ("A!", None, 7, "model"), (0, 2): ("B", None, 2, "fallback"), (1, 1): ("C", None, 3, "fallback")}


def test_thresholds(spark):
    rows = [("a", True, 95.0), ("b", True, 70.0), ("c", False, 89.0), ("d", False, 10.0)]
    scores = spark.createDataFrame([(n, e, s, s, True) for n, e, s in rows], "name string, expected boolean, similarity double, raw_similarity double, eligible boolean")
    assert tuple(evaluation.evaluate_threshold(scores, 85.0).first())[1:] == (1, 1, 1, 1, 6)
    best = evaluation.recommend_threshold(scores, 90.0).first()
    assert (best.threshold, best.fp, best.fn) == (90.0, 0, 1)
    assert evaluation.recommend_threshold(scores.where("false"), 85.0).first().threshold == 85.0
    for seed in range(4):
        rng = random.Random(seed)
        some = [(rng.random() < 0.5, rng.choice([float(rng.randrange(-3, 104)), rng.random() * 100])) for _ in range(30)]
        df = spark.createDataFrame([("", e, s, s, True) for e, s in some], scores.schema)
        marks = {0.0, 100.0, 50.0} | {m for _, s in some for c in [min(100, max(0, s))] for m in (c, min(100, c + 0.01))}

        def cost(t):
            fp, fn = sum(s >= t and not e for e, s in some), sum(s < t and e for e, s in some)
            return 5 * fp + fn, fp, fn, abs(round(t, 2) - 50), -round(t, 2)

        want = min(marks, key=cost)
        got = evaluation.recommend_threshold(df, 50.0).first()
        assert (got.weighted_errors, got.fp, got.fn) == cost(want)[:3] and got.threshold == pytest.approx(round(want, 2), abs=0.011)


def test_evaluated_pairs(spark):
    pairs = spark.createDataFrame([("p", "/a", "/b", True), ("q", "/a", "/c", False)], "name string, left string, right string, expected boolean")
    prints = spark.createDataFrame([("/a", 10.0), ("/b", 11.0), ("/c", 99.0)], "path string, duration double")
    got = evaluation.evaluated_pairs(pairs, prints, F.lit(77.777), F.abs(F.col("left_duration") - F.col("right_duration")) <= 3, "too long apart").orderBy("name").collect()
    assert [(r.similarity, r.raw_similarity, r.eligible, r.note) for r in got] == [(77.78, 77.78, True, None), (0.0, 77.78, False, "too long apart")]


def test_store(spark):
    stored = spark.createDataFrame([("/a", 1, 5.0, "x", "h", 9.0, [1], 2), ("/b", 1, 5.0, "y", "i", None, [2], 1), ("/c", 1, 5.0, "z", "j", None, None, None)], "path string, size long, mtime double, raw_name string, full_hash string, duration double, fingerprint array<long>, fingerprint_version int")
    scanned = spark.createDataFrame([("/a", 1, 5.0, "new"), ("/b", 1, 5.0000005, "new"), ("/c", 2, 5.0, "new"), ("/d", 1, 1.0, "new")], "path string, size long, mtime double, raw_name string")
    got = {r.path: (r.reused, r.raw_name, r.full_hash, r.fingerprint) for r in store.hydrated(scanned, stored).collect()}
    assert got == {"/a": (True, "x", "h", [1]), "/b": (True, "y", "i", None), "/c": (False, "new", None, None), "/d": (False, "new", None, None)}
    up = store.upserted(stored, stored.where("path = '/a'").withColumn("raw_name", F.lit("again")).withColumn("more", F.lit(1)), "path")
    assert up.count() == 3 and up.where("raw_name = 'again'").count() == 1 and "more" not in stored.columns
    gone = {r.path: (r.duration, r.full_hash) for r in store.cleared(stored, stored.where("path = '/a'"), "video").collect()}
    assert gone["/a"] == (None, "h")
    assert set(store.migrated(stored.drop("duration"), stored.schema).columns) == set(stored.columns)


def test_journal(spark):
    rows = [("a", "move", "requested", "g", 1.0, 1), ("a", "move", "completed", "g", 1.0, 2), ("b", "keep", "skipped", "g", 2.0, 1), ("b", "keep", "skipped", "g", 2.0, 1)]
    log = spark.createDataFrame([(i, a, s, g, r, r if s != "requested" else None, t) for i, a, s, g, r, t in rows], "operation_id string, action string, status string, group_id string, requested_at double, finished_at double, logged_at long")
    now = journal.latest(log)
    assert {r.operation_id: r.status for r in now.collect()} == {"a": "completed", "b": "skipped"}
    assert journal.decisions(now).first().action == "keep" and journal.recent(now, 0).count() == 1
    jobs = spark.createDataFrame([(1, "s", 1), (1, "s", 2), (1, "t", 3)], "batch int, source string, at int")
    assert [r.skipped for r in journal.repeated_sources(jobs, "batch", "at").orderBy("at").collect()] == [False, True, False]
    items = spark.createDataFrame([("exact",), ("name",), ("video",)], "category string")
    assert journal.eligible_for(items, "keep").count() == 1 and journal.eligible_for(items, "move").count() == 2
    plan = spark.createDataFrame([("/q/x", 1), ("/q/x", 2)], "to string, at int")
    assert [r.nth for r in journal.free_paths(plan, "to", spark.createDataFrame([("/q/x",)], "path string"), "at").orderBy("at").collect()] == [1, 2]


def test_move_plan(spark):
    files = spark.createDataFrame([(f"/t/{p}", 1, 0.0) for p in ("a/1.mkv", "b/1.mkv", "a/2.mkv", "a/3.mkv", "c/deep/4.mkv")], "path string, size long, mtime double")
    mappings = spark.createDataFrame([("/t/a", "/t2", "."), ("/t/b", "/t2", ".")], "folder string, final_root string, destination string")
    plan = planning.move_plan(files, mappings, spark.createDataFrame([("/t2/2.mkv",)], "path string"))
    assert {r.source: r.status for r in plan.collect()} == {"/t/a/1.mkv": "conflict", "/t/b/1.mkv": "conflict", "/t/a/2.mkv": "conflict", "/t/a/3.mkv": "ready"}
    chosen = planning.selected_moves(plan, spark.createDataFrame([("x", "y")], "source string, destination string"))
    assert chosen.count() == 3
    folders = planning.source_folders(files)
    assert [r.folder for r in folders.collect()] == ["/t/a", "/t/b", "/t/c/deep"]
    assert planning.deepest_first(folders.select("folder")).first().folder == "/t/c/deep"
    maps = planning.suggested_mappings(spark.createDataFrame([("/t/My Show", "/t"), ("/t/extras", "/t"), ("/u/x", "/u")], "folder string, title_root string"), spark.createDataFrame([("/t", "My Show"), ("/u", "Other")], "title_root string, final_name string"))
    assert {r.folder: r.destination for r in maps.collect()} == {"/t/My Show": ".", "/t/extras": "extras", "/u/x": "."}


def test_review(spark):
    outputs = spark.createDataFrame([(100.0, 100.4, 9, 8, 1, 1, 1, 1, 0, 0, 2, 2, True), (1000.0, 990.0, 9, 9, 1, 1, 2, 1, 0, 0, 2, 2, False)], "source_duration double, output_duration double, source_size long, output_size long, source_video int, output_video int, source_audio int, output_audio int, source_subtitle int, output_subtitle int, source_chapters int, output_chapters int, decodes boolean")
    assert [(r.problems, r.smaller) for r in review.output_checks(outputs).collect()] == [([], True), (["duration", "audio", "first frame"], False)]
    items = spark.createDataFrame([("exact", "a"), ("exact", "b"), ("video", "c")], "category string, paths string")
    counts = {r.category: r.n for r in review.category_counts(items).collect()}
    assert counts == {"exact": 2, "video": 1, "image": 0, "audio": 0, "folder": 0, "name": 0, "all": 3}
    assert review.filtered(items, "video").count() == 1 and {r.title for r in review.numbered(items, "paths").collect()} == {"Exact 1", "Exact 2", "Video 1"}


@pytest.mark.parametrize("once,cell", [(False, 7), (True, 16384)])
def test_video_matches_equal_brute_force_without_rows_of_pairs(spark, make_files, monkeypatch, once, cell):
    import numpy as np

    from nearfold.functions.similarity import sequence_scores

    monkeypatch.setattr(matching, "CELL_VIDEOS", cell)
    rng = random.Random(cell)
    base = [rng.getrandbits(64) for _ in range(17)]

    def noisy(frames):
        return [w ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(30))) for w in frames]

    rows = []
    for i in range(60):
        at, n = rng.randrange(3), rng.choice([1, 2, 5, 9, 14, 15])
        frames = noisy(base[at : at + n]) if rng.random() < 0.8 else [rng.getrandbits(64) for _ in range(n)]
        frames = [w - 2**64 if w >= 2**63 else w for w in frames]
        rows.append({"fingerprint": frames, "fingerprint_version": 2, "duration": rng.choice([60.0, 90.0, 91.0, 134.9, 3000.0, 3900.0, 3900.1, 1e-3]), "full_hash": rng.choice([None, "a", str(i)])})
    videos = matching.videos(make_files(rows))
    for least in (85.0, 65.0, 0.0):
        want = {}
        for i, a in enumerate(rows):
            for j, b in enumerate(rows):
                low, high = sorted((a["duration"], b["duration"]))
                if (i < j if once else i != j) and high / low <= 1.5 and high - low <= 900 and not (a["full_hash"] and a["full_hash"] == b["full_hash"]):
                    x, y = (np.array(f["fingerprint"], np.int64).view(np.uint64) for f in (a, b))
                    score = sequence_scores(x, np.array([0, len(x)]), y, np.array([0, len(y)]))[0]
                    if score >= least:
                        want[i, j] = (high - low, score)
        found = matching.video_matches(videos, videos, least, once=once)
        got = found.collect()
        assert {(r.ord_a, r.ord_b): (r.delta, r.similarity) for r in got} == want and len(got) == len(want)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    none = matching.video_matches(videos.where("false"), videos, 85.0)
    assert none.count() == 0


def test_fuzzy_hints_of_titles_with_repeated_words(spark):
    keys = spark.createDataFrame([("abcdefghijklm abcdefghijklm", None, None), ("abcdefghijklmn", None, None)], "title string, year int, episode int")
    assert [round(p.similarity) for p in naming.fuzzy_hints(keys, keys).where("left_title < right_title").collect()] == [96]


def test_journal_rows_are_requested_and_ended(spark, tmp_path):
    columns = "operation_id string, action string, source string, destination string, requested_at double, message string"
    asked = spark.createDataFrame([("a", "move", "/x", "/y", 1.0, ""), ("b", "delete", "/z", None, 2.0, "")], columns)
    path = f"{tmp_path}/journal"
    journal.appended(journal.requested(asked, F.timestamp_seconds(F.lit(1))), path)
    results = spark.createDataFrame([("a", "completed", 5.0, "done"), ("gone", "failed", 6.0, "")], "operation_id string, status string, finished_at double, message string")
    journal.appended(journal.outcomes(spark.read.parquet(path), results, F.timestamp_seconds(F.lit(2))), path)
    rows = {r.operation_id: (r.status, r.finished_at, r.message) for r in journal.latest(spark.read.parquet(path)).collect()}
    assert rows == {"a": ("completed", 5.0, "done"), "b": ("requested", None, "")} and spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        journal.requested(asked.drop("source"), F.current_timestamp())


def test_exact_groups_keep_algorithms_apart(spark):
    rows = [(1, "/a", 5, "h", "sha256"), (2, "/b", 5, "h", "blake3"), (3, "/c", 5, "h", "sha256"), (4, "/d", 5, "g", None), (5, "/e", 5, "g", None)]
    files = spark.createDataFrame(rows, "ord long, path string, size long, full_hash string, full_hash_algo string")
    assert sorted(r.paths for r in exact.exact_groups(files).collect()) == [["/a", "/c"], ["/d", "/e"]]
    assert {(r.path, r.first_path, r.copies) for r in exact.exact_members(files).collect()} == {("/a", "/a", 2), ("/c", "/a", 2), ("/d", "/d", 2), ("/e", "/d", 2)}


def test_kept_bits_leave_close_words_a_mask():
    import random

    rng = random.Random(2)
    for bits, distance in ((64, 8), (32, 1), (32, 3), (64, 20), (64, 63)):
        for words in (10, 10**6, 10**10):
            masks = matching.kept_bits(bits, distance, words)
            for _ in range(200):
                harm = sum(1 << i for i in rng.sample(range(bits), distance))
                assert any(not m & harm for m in masks)


def test_fuzzy_hints_equal_comparing_all_pairs(spark):
    from nearfold.functions.names import set_ratio

    rng = random.Random(5)
    words = ["night", "clock", "the", "naruto", "тиха", "вода", "aaa", "aa", "42", "harbour", "s"]
    titles = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(60)}
    for title in list(titles):
        some = list(title)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(some) + 1)
            some[at : at + rng.randrange(2)] = rng.choice(["", "x", "a", " ", " "])
        titles.add("".join(some).strip())
    titles.discard("")
    keys = naming.name_keys(spark.createDataFrame([(t, None, None) for t in sorted(titles)], "core_title string, year int, episode int"))
    for threshold in (92.0, 75.0):
        got = {(r.left_title, r.right_title) for r in naming.fuzzy_hints(keys, keys, threshold).collect()}
        assert got == {(a, b) for a in titles for b in titles if a != b and threshold <= set_ratio(a, b) < 100} and got


def test_fuzzy_hints_compare_only_titles_that_share_a_key(spark):
    from nearfold.functions.names import set_ratio

    rng = random.Random(8)
    letters = "abcdefghijklmnoprstuvzяжшのネ𝒜𝒞"
    word = lambda low, high: "".join(rng.choice(letters) for _ in range(rng.randrange(low, high)))
    titles = set()
    for _ in range(25):
        some = [word(1, 9) for _ in range(rng.randrange(1, 7))]
        titles.add(" ".join(some))
        titles.add(" ".join([*some, word(1, 3)]))
        titles.add(" ".join([*some[::-1], word(1, 2), *(word(4, 9) for _ in range(5))]))
        at = rng.randrange(len(some))
        some[at] = some[at][:-1] + word(1, 3)
        titles.add(" ".join(some))
    titles |= {"a" * n for n in range(9, 30)} | {"ab " * 8 + c for c in "abc"}
    rows = [(t, rng.choice([None, 2000]), rng.choice([None, 1])) for t in sorted(titles) for _ in range(3)]
    keys = spark.createDataFrame(rows, "title string, year int, episode int").withColumn("title", F.trim("title"))
    known = {(r.title, r.year, r.episode) for r in keys.collect()}
    for threshold in (92.0, 80.0, 60.0):
        hints = naming.fuzzy_hints(keys, keys, threshold)
        got = [(r.left_title, r.right_title, r.year, r.episode) for r in hints.collect()]
        want = {(a, b, y, e) for a, y, e in known for b, z, f in known if (y, e) == (z, f) and a != b and threshold <= set_ratio(a, b) < 100}
        assert set(got) == want and len(got) == len(want) and want
        if threshold >= naming.LETTERED_FROM:
            joins = [line for line in hints._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in line and "left_title" in line]
            assert joins and all("left_key" in j or "left_word" in j for j in joins)
