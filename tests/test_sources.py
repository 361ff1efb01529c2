import csv
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from spanloom.plans import runner
from spanloom.sources import assets as A
from spanloom.sources import caches as C
from spanloom.sources import readers as R
from spanloom.sources import sinks as K


def test_jsonl_and_submission(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"qid":31,"vid":"kitchen","duration":50,"query":" stir the pot ","relevant_windows":[[1,4],[30,80],[6,6]]}\n\n{"vid":"yard","duration":9,"query":"q"}\n')
    a, b = R.jsonl_samples(spark, str(tmp_path / "a.jsonl"), group="g").orderBy("video").collect()
    assert (a.id, a.query, a.group, [(s.start, s.end) for s in a.targets], b.id, b.targets) == ("31", "stir the pot", "g", [(1, 4), (30, 50)], "test:3", [])
    assert R.jsonl_samples(spark, str(tmp_path / "none.jsonl")).count() == 0
    rows = R.jsonl_samples(spark, str(tmp_path / "a.jsonl")).withColumn("spans", F.col("targets"))
    lines = [json.loads(r.value) for r in K.submission(rows).collect()]
    assert {x["qid"] for x in lines} == {31, "test:3"} and [1.0, 4.0, 1.0] in lines[0]["pred_relevant_windows"] + lines[1]["pred_relevant_windows"]
    K.write_jsonl(spark.createDataFrame([(None, 1)], "b string, a int"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":1,"b":null}'


def test_lines_are_numbered_over_partitions(spark):
    rows = spark.createDataFrame([(f"l{i}",) for i in range(50)], "value string").coalesce(1).repartition(1).sortWithinPartitions("value")
    many = spark.range(0, 1000, 1, 7).select(F.col("id").cast("string").alias("value"))
    assert all(int(r.value) == r.line for r in R.numbered(many).collect()) and R.numbered(rows).agg(F.max("line")).first()[0] == 49


def test_catalog(spark):
    files = ["videos/s01-d02-CAM-009.AVI", "videos/s01-d02-cam-004.avi", "videos/s01-d02.webm", "videos/b.webm", "videos/b.mp4", "x/b.mp4", "x/videos/z.mp4", "rgb_videos_30fps_480/s01-d02.mp4", "rgb_videos_30fps_480/c.mkv"]
    paths = spark.createDataFrame([(f"/d/{f}",) for f in files], "path string")
    got = {r.stem: r.path for r in R.video_catalog(paths, "/d").collect()}
    # a take's name comes from its camera file or from a file of that name, whichever is first by folder and suffix
    assert got == {"s01-d02-cam-004": "/d/videos/s01-d02-cam-004.avi", "s01-d02": "/d/videos/s01-d02.webm", "b": "/d/videos/b.mp4", "c": "/d/rgb_videos_30fps_480/c.mkv"}


def test_no_videos(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        R.video_index(spark, str(tmp_path))


def test_tsv(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("video\tquestion\tanswer\tduration\nw.mp4\tthe TEXTUAL query 'he says 'no' and determine' and determine when\t4 to 11\t6\nv\tjust this\t[[1, 2]]\t\n")
    a, b = R.tsv_samples(spark, str(tmp_path / "a.tsv")).orderBy("id").collect()
    assert (a.id, a.query, a.duration, [(s.start, s.end) for s in a.targets]) == ("0", "he says 'no' and determine", 11.0, [(4, 11)])
    assert (b.id, b.query, b.duration) == ("1", "just this", None)

    class Media:
        def probe(self, path):
            return C.VideoInfo(33.0, 3.0, 99)

    videos = spark.createDataFrame([("w", "/v/w.mp4"), ("v", "/v/v.mp4")], "stem string, path string")
    rows = R.tsv_samples(spark, str(tmp_path / "a.tsv"), videos, Media()).orderBy("id").collect()
    assert [(r.duration, r.path) for r in rows] == [(11.0, "/v/w.mp4"), (33.0, "/v/v.mp4")]
    info = C.probed(videos, Media()).first()
    assert (info.duration, info.fps, info.frames) == (33.0, 3.0, 99)


def test_manifest(tmp_path):
    K.ensure_manifest(str(tmp_path / "m.json"), {"a": 1})
    K.ensure_manifest(str(tmp_path / "m.json"), {"a": 1})
    with pytest.raises(ValueError):
        K.ensure_manifest(str(tmp_path / "m.json"), {"a": 2})


def test_cache_keys(spark):
    times = F.array(F.lit(0.5), F.lit(12.25))
    r = spark.range(1).select(C.feature_key(F.lit("/v/a.mp4"), "clip", times).alias("f"), C.frame_key(F.lit("/v/a.mp4"), 336, times).alias("k"), C.frame_name(F.lit(7), F.lit(2.5)).alias("n")).first()
    assert r.f == hashlib.sha256(b"/v/a.mp4\0clip\x000.500000,12.250000").hexdigest()
    assert r.k == hashlib.sha256(b"/v/a.mp4\x00336\x000.500000,12.250000").hexdigest()[:20] and r.n == "0007-2.500.jpg"


def test_windows_are_cached_once(spark, tmp_path):
    samples = spark.createDataFrame([("a", 40.0), ("b", 100.0)], "id string, duration double")
    cuts = spark.createDataFrame([("b", [50.0])], "id string, boundaries array<double>")
    path = str(tmp_path / "cache")
    C.write_windows(C.with_windows(samples.where("id = 'b'"), cuts), path)
    C.write_windows(C.with_windows(samples), path)
    got = {r.id: (r.source, [tuple(w) for w in r.windows]) for r in C.read_windows(spark, path).collect()}
    assert got == {"a": ("uniform-fallback", [(0, 40)]), "b": ("content", [(0, 50), (48, 100)])}


def test_checkpoint_and_digest(tmp_path, monkeypatch):
    (tmp_path / "w.bin").write_bytes(b"weights")
    monkeypatch.setenv("OWN_CHECKPOINT", str(tmp_path / "w.bin"))
    assert C.checkpoint(None, "OWN_CHECKPOINT", "/none") == str(tmp_path / "w.bin") == C.checkpoint(str(tmp_path / "w.bin"), "X", "")
    assert C.digest(str(tmp_path / "w.bin")) == hashlib.sha256(b"weights").hexdigest()
    with pytest.raises(FileNotFoundError):
        C.checkpoint("/no/such", "X", "")


def test_assets(spark, tmp_path):
    files = spark.createDataFrame([(f"/v/{n}",) for n in ("s1-d2-cam-003.avi", "S1-D2-cam-004.avi", "s9-d9.mp4", "notes.txt")], "path string")
    takes = spark.createDataFrame([(" S1-d2 ",), ("s1-d2",)], "vid string")
    expected = A.normal_ids(takes, takes=True)
    assert [r.video for r in expected.collect()] == ["s1-d2"] and A.verified(expected, A.present_ids(files, takes=True), exact=False) == 1
    assert [r.path for r in A.superfluous(files, expected).collect()] == ["/v/s9-d9.mp4"]
    with pytest.raises(ValueError, match="not expected"):
        A.verified(expected, A.present_ids(files, takes=True))
    with pytest.raises(FileNotFoundError, match="missing"):
        A.verified(A.normal_ids(takes), A.present_ids(files))
    with pytest.raises(Exception, match="invalid video id"):
        A.normal_ids(spark.createDataFrame([("a/b",)], "vid string")).collect()
    assert A.completed(str(tmp_path)) is None
    A.complete(str(tmp_path), {"url": "u"})
    assert A.completed(str(tmp_path))["source"] == {"url": "u"}


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    data, root = tmp_path / "data", str(tmp_path / "results")
    (data / "videos").mkdir(parents=True)
    for v in ("one", "two", "three"):
        (data / "videos" / f"{v}.mp4").write_bytes(b"film")
    lines = [{"qid": i, "vid": v, "duration": 60 + i, "query": f"q{i}", "relevant_windows": [[5, 20]]} for i, v in enumerate(("one", "two", "three", "one"))]
    (data / "test.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    go = lambda percent, **more: runner.run(spark, root, str(data), "tacos", "stub", "coverage-query", percent, 4, **more)
    half = go(50)
    assert (half["status"], half["requested"], half["successful"]) == ("complete", 2, 2) and set(half["metrics"]) >= {"miou", "r1_5"}
    log = f"{half['run_directory']}/predictions"
    first = {r.id: r.batch for r in spark.read.schema(runner.LOG).json(log).collect()}
    whole = go(100)
    later = {r.id: r.batch for r in spark.read.schema(runner.LOG).json(log).collect()}
    assert whole["successful"] == 4 and len(later) == 4 and all(later[i] == b for i, b in first.items())
    rows = list(csv.DictReader(open(f"{root}/index.csv")))
    assert [(r["subset"], r["successful"], r["run"]) for r in rows] == [("050", "2", "runs/tacos/stub/coverage-query/seed-4"), ("100", "4", "runs/tacos/stub/coverage-query/seed-4")]
    assert "| tacos | stub | coverage-query | 4 | 100% | 4/4 |" in open(f"{root}/RESULTS.md").read()
    assert go(0)["status"] == "empty" and runner.command(["list"]) == 0
    hidden = data / "highlight_test_release.jsonl"
    hidden.write_text("".join(json.dumps({"qid": i, "vid": "two", "duration": 90, "query": "q"}) + "\n" for i in range(2)))
    out = runner.run(spark, root, str(data), "qvhighlights", "stub", "coarse-to-fine-64", 100, 4)
    assert out["metrics"] is None and {json.loads(r.value)["qid"] for r in spark.read.text(out["submission"]).collect()} == {0, 1}
