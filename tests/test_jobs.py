"""Whole jobs on a folder: prepare, review, prepare again, finalize."""

import json

import pytest

from stillpoint.options import ReviewOptions, SelectionOptions
from stillpoint.plans import workflows as wf
from stillpoint.plans.requests import checked_requests
from stillpoint.sources import manifests as mf


@pytest.fixture
def folder(tmp_path):
    for name in ("videos/b.mp4", "videos/a/x.MOV", "videos/a/notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    return tmp_path


def tools(spark, folder):
    a, b = f"{folder}/videos/a/x.MOV", f"{folder}/videos/b.mp4"
    files = spark.createDataFrame([(a,), (b,)], "path string")
    probes = spark.createDataFrame([(a, '{"format":{"duration":"65"}}'), (b, "")], "path string, payload string")
    log = "frame:0 pts:1 pts_time:30.5\nlavfi.scene_score=0.9\nframe:1 pts:2 pts_time:41.0\nlavfi.scene_score=0.2"
    logs = spark.createDataFrame([(a, log), (b, "frame:0 pts:1 pts_time:7.0\nlavfi.scene_score=0.5")], "path string, text string")
    return files, probes, logs


def manifest(path):
    lines = []
    for part in sorted((p for p in path.glob("part-*")), key=lambda p: p.name):
        lines += [json.loads(x) for x in part.read_text().splitlines()]
    return lines


def test_prepare_review_finalize(spark, folder):
    out, options = f"{folder}/out", SelectionOptions()
    files, probes, logs = tools(spark, folder)
    done = wf.prepare_job(spark, f"{folder}/videos", out, files, probes, logs, options)
    rows = manifest(folder / "out/manifests/candidate_keyframes.jsonl")
    assert done.candidate_count == len(rows) == 7 and done.keyframe_count == 0 and done.keyframes_manifest is None
    # input order of the videos, then time
    assert [(r["video_path"][-5:], r["timestamp_seconds"], r["source"]) for r in rows] == [
        ("x.MOV", 0.0, "seed"), ("x.MOV", 20.0, "periodic"), ("x.MOV", 30.5, "scene"), ("x.MOV", 41.0, "scene"), ("x.MOV", 60.0, "periodic"), ("b.mp4", 0.0, "seed"), ("b.mp4", 7.0, "scene"),
    ]
    assert all(list(r) == mf.CANDIDATE_KEYS and r["decision"] == "pending" for r in rows)
    work = done.worklist.collect()
    assert {w.attempt_t for w in work if w.image_path == rows[2]["image_path"]} == {30.5, 30.25, 30.0, 29.5} and {w.quality for w in work} == {2}

    # the detector's threshold was its own: the scene of score 0.2 is planned
    assert [r["score"] for r in rows if r["source"] == "scene"] == [0.9, 0.2, 0.5]
    # a person decides; the next run carries the decisions and asks only for what is absent
    rows[2]["decision"], rows[3]["decision"] = "accepted", "rejected"
    for part in (folder / "out/manifests/candidate_keyframes.jsonl").iterdir():
        part.unlink()
    (folder / "out/manifests/candidate_keyframes.jsonl/part-00000.txt").write_text("\n".join(map(json.dumps, rows)) + "\n")
    have = files.unionByName(spark.createDataFrame([(rows[0]["image_path"],)], "path string"))
    again = wf.prepare_job(spark, f"{folder}/videos", out, have, probes, logs, options)
    assert [r["decision"] for r in manifest(folder / "out/manifests/candidate_keyframes.jsonl")] == ["pending", "pending", "accepted", "rejected", "pending", "pending", "pending"]
    assert {w.image_path for w in again.worklist.collect()} == {r["image_path"] for r in rows[1:]}
    everything = wf.prepare_job(spark, f"{folder}/videos", out, have, probes, logs, SelectionOptions(overwrite=True, image_quality=5)).worklist.collect()
    assert len({w.image_path for w in everything}) == 7 and {w.quality for w in everything} == {5}

    final = wf.finalize_job(spark, again.candidates_manifest, out, files, ReviewOptions(max_keyframes=2))
    kept = manifest(folder / "out/manifests/keyframes.jsonl")
    assert (final.candidate_count, final.keyframe_count) == (7, 4) == (7, len(kept))
    # by video id, then time
    assert [(r["video_id"][0], r["timestamp_seconds"]) for r in kept] == [("a", 0.0), ("a", 30.5), ("b", 0.0), ("b", 7.0)]
    assert [json.loads(json.dumps(r["metadata"]))["review_decision"] for r in kept] == ["pending", "accepted", "pending", "pending"]
    assert {(w.source_image, w.image_path) for w in final.worklist.collect()} == {(next(c["image_path"] for c in rows if c["candidate_id"] == r["candidate_id"]), r["image_path"]) for r in kept}
    whole = wf.run_job(spark, f"{folder}/videos", out, files, probes, logs, options, ReviewOptions(pending="reject"))
    assert [r["timestamp_seconds"] for r in manifest(folder / "out/manifests/keyframes.jsonl")] == [30.5] and whole.keyframe_count == 1
    assert mf.read_keyframes(spark, whole.keyframes_manifest).count() == 1


def test_scenes_without_a_score_reach_the_manifest(spark, folder):
    files, probes, logs = tools(spark, folder)
    a, b = (r.path for r in files.collect())
    shown = "[Parsed_showinfo_2] n: 0 pts_time:33.25 pos:9\n[Parsed_showinfo_2] n: 1 pts_time:3.5"
    logs = spark.createDataFrame([(a, 1, shown), (b, 2, "lavfi.scene_score=0.5"), (b, 1, "frame:0 pts:1 pts_time:7.0\nframe:1 pts:2 pts_time:9.5")], "path string, part int, text string")
    done = wf.run_job(spark, f"{folder}/videos", f"{folder}/out", files, probes, logs, SelectionOptions(), ReviewOptions())
    kept = [(r["video_path"][-5:], r["timestamp_seconds"], r["score"]) for r in manifest(folder / "out/manifests/keyframes.jsonl") if r["source"] == "scene"]
    # the parts of b's log are read in their order: its score belongs to the last frame of part 1
    assert kept == [("x.MOV", 3.5, None), ("x.MOV", 33.25, None), ("b.mp4", 7.0, None), ("b.mp4", 9.5, 0.5)]
    assert done.candidate_count == 9
    with pytest.raises(ValueError):
        wf.prepare_job(spark, f"{folder}/videos", f"{folder}/out", files, probes, logs.drop("part"), SelectionOptions())
    with pytest.raises(Exception):
        unlike = probes.unionByName(spark.createDataFrame([(a, '{"format":{"duration":"66"}}')], probes.schema))
        wf.prepare_job(spark, f"{folder}/videos", f"{folder}/out", files, unlike, logs, SelectionOptions())


def test_jobs_leave_only_what_their_results_read(spark, folder):
    import os

    files, probes, logs = tools(spark, folder)
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    wf.run_job(spark, f"{folder}/videos", f"{folder}/out", files, probes, logs, SelectionOptions(), ReviewOptions())
    assert sorted(x.split("-")[0] for x in set(os.listdir(root)) - before) == ["candidates", "keyframes"]


def test_missing_video_is_an_error(spark, folder):
    files, probes, logs = tools(spark, folder)
    with pytest.raises(FileNotFoundError):
        wf.prepare_job(spark, f"{folder}/videos", f"{folder}/out", files.limit(1), probes, logs, SelectionOptions())
    assert not (folder / "out").exists()


def test_a_failed_write_leaves_the_manifest(spark, folder):
    path = f"{folder}/m.jsonl"
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "candidate_id string, ord long")
    assert mf.write_manifest(rows, ["candidate_id"], path, ["ord"]) == 2
    with pytest.raises(Exception):
        mf.write_manifest(rows.selectExpr("raise_error('no') AS candidate_id", "ord"), ["candidate_id"], path, ["ord"])
    assert manifest(folder / "m.jsonl") == [{"candidate_id": "a"}, {"candidate_id": "b"}]


@pytest.mark.parametrize("dies_in", ["point", "discard", "move", "discard pointer"])
def test_a_writer_that_dies_leaves_a_whole_manifest(spark, folder, monkeypatch, dies_in):
    path = f"{folder}/m.jsonl"
    row = {"candidate_id": "c", "video_id": "v", "video_path": "p", "timestamp_seconds": 1.0, "image_path": "i", "source": "scene", "score": None, "decision": "pending", "metadata": "{}"}
    kinds = "candidate_id string, video_id string, video_path string, timestamp_seconds double, image_path string, source string, score double, decision string, metadata string, ord long"
    make = lambda names: spark.createDataFrame([tuple({**row, "candidate_id": n}.values()) + (k,) for k, n in enumerate(names)], kinds)
    read = lambda: [r.candidate_id for r in mf.read_candidates(spark, path).orderBy("ord").collect()]
    mf.write_manifest(make("ab"), mf.CANDIDATE_KEYS, path, ["ord"])

    def die(real, when):
        def run(spark, at, *rest):
            if when(at):
                raise RuntimeError("the driver dies")
            return real(spark, at, *rest)

        return run

    with monkeypatch.context() as m:
        step, pointer = dies_in.split()[0], dies_in.endswith("pointer")
        m.setattr(mf, step, die(getattr(mf, step), lambda at: at.endswith(".current") == (pointer or step == "point")))
        with pytest.raises(RuntimeError):
            mf.write_manifest(make("xyz"), mf.CANDIDATE_KEYS, path, ["ord"])
    assert read() == (["a", "b"] if dies_in == "point" else ["x", "y", "z"])
    # the next writer settles what was left and may read what it replaces
    assert mf.write_manifest(mf.read_candidates(spark, path).filter("candidate_id <> 'x'"), mf.CANDIDATE_KEYS, path, ["ord"]) == 2
    assert read() == (["a", "b"] if dies_in == "point" else ["y", "z"])
    assert not (folder / "m.jsonl.current").exists()


def test_threads_have_their_own_scratch(spark):
    import threading

    from stillpoint.functions.tables import scratch, written

    inside, outside, problems = threading.Event(), threading.Event(), []

    def other():
        try:
            with scratch(spark):
                inside.set()
                outside.wait(60)
                assert written(spark.range(3), "theirs").count() == 3
        except Exception as e:  # noqa: BLE001
            problems.append(e)

    thread = threading.Thread(target=other)
    thread.start()
    inside.wait(60)
    with scratch(spark):
        mine = written(spark.range(5), "mine")
        outside.set()
        thread.join()
        assert mine.count() == 5 and not problems


def test_requests(spark):
    nan, inf = float("nan"), float("inf")
    good = (0.35, 20.0, 2.0, 120, 2, " Reject ", None)
    cases = [(good, None)]
    for at, value, problem in [
        (0, nan, "scene_threshold"), (0, 1.5, "scene_threshold"), (0, None, "scene_threshold"), (1, 0.0, "interval"), (1, inf, "interval"), (2, -1.0, "spacing"), (2, 0.0, None), (3, 0, "max_candidates"),
        (3, None, None), (4, None, "image_quality"), (4, 0, "image_quality"), (5, None, "pending"), (5, "maybe", "pending"), (6, 0, "max_keyframes"), (6, 1, None),
    ]:
        cases.append(((*good[:at], value, *good[at + 1 :]), problem))
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i long, scene_threshold double, interval double, spacing double, max_candidates long, image_quality long, pending string, max_keyframes long")
    got = {r.i: r.problem for r in checked_requests(df).collect()}
    assert got == {i: p for i, (_, p) in enumerate(cases)}
