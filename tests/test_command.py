import json

from nearfold.__main__ import main
from nearfold.operators import naming, review
from nearfold.plans.thresholds import manifest_prints, medium_scores, threshold_report

from .test_engine import FakeDecoder


def test_command_writes_reports_and_reuses_the_store(spark, tmp_path, capsys):
    for name, text in (("a/one 01.mkv", "same"), ("b/one-01.mkv", "same"), ("b/two 02.mkv", "else")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    base = ["--folders", str(tmp_path / "a"), str(tmp_path / "b"), "--cache", str(tmp_path / "store"), "--output", str(tmp_path / "r.html"), "--json-output", str(tmp_path / "r"), "--folder-threshold", "1"]
    for _ in range(2):
        assert main(base) == 0
        found = spark.read.text(str(tmp_path / "r")).where("section = 'exact'").collect()
        assert len(found) == 1 and json.loads(found[0].value)["copies"] == 2
        assert spark.read.parquet(str(tmp_path / "store")).count() == 3
    assert "one-01" in (tmp_path / "r.html").read_text()
    assert main(["--inspect-cache", "--cache", str(tmp_path / "store")]) == 0 and "files" in capsys.readouterr().out
    assert main([]) == 2 and main(["--folders", "x", "--video-threshold", "200"]) == 2


def test_model_is_asked_in_batches(spark):
    asked = spark.createDataFrame([(i // 2, i, f"Name {i:02d}") for i in range(6)], "batch int, id int, name string")

    def client(rows, strict):
        if rows[0][0] == 0 and strict or rows[0][0] == 4:
            raise OSError("busy")
        return json.dumps({"results": [{"id": i, "core_title": n.upper()} for i, n in rows]})

    got = {r.id: (r.core_title, r.source) for r in naming.coerced(naming.asked_of_model(asked, client), asked).collect()}
    assert got[0] == ("NAME 00", "model") and got[3] == ("NAME 03", "model") and got[5] == ("Name", "fallback")


def test_threshold_report(spark):
    rows = [("video", "p", "/v1.mkv", "/v2.mkv", True), ("image", "q", "/a.png", "/b.png", True), ("audio", "r", "/a.mp3", "/b.mp3", False)]
    pairs = spark.createDataFrame(rows, "media_type string, name string, left string, right string, expected boolean")
    prints = manifest_prints(pairs, FakeDecoder())
    report = {r.medium: r for r in threshold_report(spark, {m: medium_scores(pairs, prints, m) for m in ("video", "image", "audio")}).collect()}
    assert (report["video"].tp, report["image"].tp, report["audio"].fp) == (1, 1, 1) and report["audio"].recommended_errors == 5


def test_compression_summary(spark):
    videos = spark.createDataFrame([("/a", 5), ("/b", 7)], "path string, size long")
    assert tuple(review.compression_summary(videos, spark.createDataFrame([("/b",), ("/b",)], "path string")).first()) == (2, 1, 7)
