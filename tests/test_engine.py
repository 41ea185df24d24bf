import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold import options
from nearfold.engine import Cancelled, Engine, html_report, json_report, nested_report
from nearfold.sources import listing, manifest, media
from nearfold.streaming.arrivals import watch_arrivals


def test_engine_run(spark, make_files):
    rows = [
        {"path": "/a/Show 01 <x>.mkv", "root": "/a", "raw_name": "Show 01 <x>", "full_hash": "h"}, {"path": "/b/Show 01.mkv", "root": "/b", "raw_name": "Show 01", "full_hash": "h"},
        {"path": "/a/v.mkv", "root": "/a", "fingerprint": [5] * 15, "fingerprint_version": 2, "duration": 60.0, "raw_name": "alpha"},
        {"path": "/b/w.mkv", "root": "/b", "fingerprint": [4] * 15, "fingerprint_version": 2, "duration": 61.0, "raw_name": "beta"},
        {"path": "/a/Other 02.mkv", "root": "/a", "raw_name": "Other 02"}, {"path": "/b/other-02.mkv", "root": "/b", "raw_name": "other-02"},
    ]
    events = []
    found = Engine(spark, events.append).run(make_files(rows), options.Options(folder_threshold=10))
    assert found.exact.count() == 1 and found.image.count() == 0
    assert [(r.left, r.right, r.similarity, r.duration_delta) for r in found.video.collect()] == [("/a/v.mkv", "/b/w.mkv", 98.44, 1.0)]
    assert [h.key for h in found.hints.collect()] == ["name:other|None|2"]
    assert found.folders.first().content_similarity == pytest.approx(50.0)
    assert [e.stage for e in events if e.kind == "completed"] == ["scanning", "exact", "video", "images", "audio", "names", "clustering"]
    sections = {r.section: json.loads(r.json) for r in json_report(found).collect()}
    assert sections["exact"]["copies"] == 2 and "&lt;x&gt;" in html_report(found)
    skipped = Engine(spark, events.append).run(make_files(rows), options.Options(skip_video=True))
    assert skipped.video.count() == 0
    with pytest.raises(Cancelled):
        Engine(spark, cancelled=lambda: True).run(make_files(rows))


def test_engine_run_gives_fuzzy_hints(spark, make_files):
    names = ["starship voyages", "starship voyagez", "lonely planet", "lonely planes"]
    rows = [{"path": f"/a/{n}.mkv", "raw_name": n, "full_hash": "h" if n.startswith("lonely") else None} for n in names]
    found = Engine(spark).run(make_files(rows), options.Options()).hints.collect()
    assert [(h.key, h.similarity, h.title, h.paths) for h in found] == [
        ("fuzzy:starship voyages|starship voyagez|None|None", 93.75, "starship voyages / starship voyagez", ["/a/starship voyages.mkv", "/a/starship voyagez.mkv"])
    ]
    assert Engine(spark).run(make_files(rows), options.Options(name_threshold=95)).hints.count() == 0


def test_options(tmp_path):
    assert options.Options().video_threshold == 85.0
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"matching": {"video": 80, "images": 91}, "audio": {"skip": True}, "names": {"name-provider": "none"}, "reports": {"html": "o.html"}, "cache": {"path": "c"}, "workers": 7}))
    loaded = options.load(str(file), workers=9, video_threshold=None)
    assert (loaded.video_threshold, loaded.image_threshold, loaded.skip_audio, loaded.name_provider, loaded.output, loaded.cache, loaded.workers) == (80, 91, True, "none", "o.html", "c", 9)
    assert options.load(environment={"LMSTUDIO_URL": "u"}).lmstudio_url == "u"
    assert options.flattened({"ai-names": False})["name_provider"] == "none"
    for bad in ({"video_threshold": "x"}, {"image_threshold": 101}, {"audio_threshold": float("nan")}, {"workers": 0}, {"workers": 65}, {"name_provider": "other"}):
        with pytest.raises(ValueError):
            options.Options(**bad)
    assert options.Options(max_image_candidates=0).max_image_candidates == 2


def test_scan(spark, tmp_path):
    for name in ("a/one.MKV", "a/sub/two.mp4", "a/.hidden.mkv", "a/empty.mkv", "a/skip.txt", "b/three.flac"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"" if "empty" in name else b"x")
    roots = [str(tmp_path / "a"), str(tmp_path / "a/sub"), str(tmp_path / "b"), str(tmp_path / "none")]
    rows = listing.scan(spark, roots).collect()
    found = {r.path: r for r in rows if r.path}
    assert {p.split("/")[-1] for p in found} == {"one.MKV", "two.mp4", ".hidden.mkv", "empty.mkv", "three.flac"}
    assert all(r.root == roots[0] for p, r in found.items() if "/a/" in p) and [r.error for r in rows if r.path is None] == ["not a folder"]
    (tmp_path / "a/link").symlink_to(tmp_path / "a")
    assert listing.videos_below(spark, roots[0]).count() == 4


class FakeDecoder:
    def duration(self, path):
        if "broken" in path:
            raise OSError("no")
        return 100.0

    def frames(self, path, times):
        return [np.outer(np.arange(32), np.full(32, t)) for t in times]

    def picture(self, path):
        return np.arange(1024).reshape(32, 32), (1, 2, 3)

    def words(self, path):
        return [7, 8]


class CutDecoder(FakeDecoder):
    def frames(self, path, times):
        return [np.random.default_rng(int(t)).integers(0, 255, (32, 32)) for t in times]


def test_engine_run_realigns_cut_videos(spark, make_files):
    longer, shorter = (media.video_words(CutDecoder(), "/v.mkv", span, start) for span, start in ((1000.0, 0.0), (900.0, 100.0)))
    mixed = longer[:10] + shorter[10:]  # alike in some frames, so that the plain score is worth a second look
    rows = [{"fingerprint": f, "fingerprint_version": 2, "duration": d, "raw_name": n} for f, d, n in ((mixed, 1000.0, "alpha"), (shorter, 900.0, "beta"))]
    events = []
    found = Engine(spark, events.append, decoder=CutDecoder()).run(make_files(rows)).video.collect()
    assert [r.similarity for r in found] == [100.0] and not [e for e in events if e.kind == "warning"]
    assert Engine(spark, events.append).run(make_files(rows)).video.count() == 0 and [e.stage for e in events if e.kind == "warning"] == ["video"]


def test_fingerprints(spark):
    files = spark.createDataFrame([("/v.mkv",), ("/i.png",), ("/a.mp3",), ("/t.txt",), ("/broken.mkv",)], "path string")
    got = {r.path: r for r in media.fingerprints(files, FakeDecoder(), parts=2).collect()}
    assert len(got) == 4 and len(got["/v.mkv"].fingerprint) == 15 and got["/v.mkv"].fingerprint_version == 2
    assert got["/i.png"].image_fingerprint[1:] == [1, 2, 3] and got["/a.mp3"].audio_fingerprint == [7, 8] and "OSError" in got["/broken.mkv"].error
    assert media.FfmpegDecoder("/nowhere/ffmpeg", "/nowhere/ffprobe").available() is False


def test_manifest(spark, tmp_path):
    file = tmp_path / "m.json"
    file.write_text(json.dumps({"pairs": [{"media_type": "video", "name": "n", "left": "a.mkv", "right": "/x/b.mkv", "expected_match": True}]}))
    row = manifest.read_manifest(spark, str(file)).first()
    assert (row.left, row.right, row.expected) == (f"{tmp_path}/a.mkv", "/x/b.mkv", True)


def test_arrivals_stream(spark, make_files, tmp_path):
    source, stored, found = (str(tmp_path / x) for x in ("in", "store", "found"))
    first = make_files([{"ord": 1, "path": "/1", "full_hash": "h"}, {"ord": 2, "path": "/2", "full_hash": "h"}])
    first.coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(first.schema).parquet(source)
    watch_arrivals(stream(), stored, found, str(tmp_path / "cp")).awaitTermination()
    make_files([{"ord": 3, "path": "/3", "full_hash": "h"}, {"ord": 1, "path": "/1", "full_hash": "h"}, {"ord": 4, "path": "/4"}]).coalesce(1).write.mode("append").parquet(source)
    watch_arrivals(stream(), stored, found, str(tmp_path / "cp")).awaitTermination()
    assert {(r.path, r.known_path) for r in spark.read.parquet(found).collect()} == {("/2", "/1"), ("/3", "/1")}
    assert spark.read.parquet(stored).count() == 4


def test_failure_and_cancelling_are_told_and_the_report_nests(spark, make_files):
    events = []
    files = make_files([{"full_hash": "h"}, {"full_hash": "h"}])
    with pytest.raises(Cancelled):
        Engine(spark, events.append, cancelled=lambda: True).run(files)
    with pytest.raises(Exception):
        Engine(spark, events.append).run(files.withColumn("ord", F.expr("raise_error('broken')").cast("long")))
    assert [e.kind for e in events] == ["cancelled", "started", "failed"]
    sections = {r.section: json.loads(r.json) for r in nested_report(Engine(spark).run(files)).collect()}
    assert len(sections["exact"]) == 1 and sections["video"] == [] and set(sections) == {"exact", "video", "image", "audio", "hints", "folders"}
