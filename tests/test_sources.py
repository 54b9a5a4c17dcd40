import hashlib
import json

import pytest

from stillpoint.sources import manifests as mf
from stillpoint.sources import probes as pr
from stillpoint.sources import videos as vs


def sha(path):
    return hashlib.sha1(path.encode()).hexdigest()[:10]


def lines(spark, rows):
    return spark.createDataFrame(list(enumerate(rows, 1)), "line_no long, line string")


def test_video_rows(spark):
    given = ['"a/b.mp4"', '{"id":7,"video_path":"x.mp4","lang":"vi","metadata":{"lang":"en","s":1}}', " ", '{"path":"","video_path":"y.mp4"}']
    got = vs.normalise_rows(vs.parse_jsonl(lines(spark, given)), "/m").orderBy("video_ord").collect()
    assert [(r.video_id, r.path) for r in got] == [("a-b-" + sha("/m/a/b.mp4"), "/m/a/b.mp4"), ("7", "/m/x.mp4"), ("y-" + sha("/m/y.mp4"), "/m/y.mp4")]
    assert [json.loads(r.metadata) for r in got] == [{}, {"lang": "vi", "s": 1}, {}]


@pytest.mark.parametrize("row", ['{"video_id":"q"}', "{}", "5", '{"path":"x.mp4","metadata":[1]}', "{bad"])
def test_bad_video_rows(spark, row):
    with pytest.raises(Exception):
        vs.normalise_rows(vs.parse_jsonl(lines(spark, [row])), "/m").collect()


@pytest.mark.parametrize("text,n", [('["a.mp4","b.mp4"]', 2), ('{"videos":["a.mp4"]}', 1), ('{"videos":null,"items":["a.mp4","c.mp4"]}', 2), ('{"videos":5,"items":[]}', -1), ('{"x":1}', -1)])
def test_json_manifest(spark, text, n):
    df = spark.createDataFrame([(text,)], "text string")
    if n < 0:
        with pytest.raises(Exception):
            vs.parse_json(df).collect()
    else:
        assert vs.normalise_rows(vs.parse_json(df), "/m").count() == n


def test_folder_and_dispatch(spark, tmp_path):
    for name in ("b/x.MP4", "a-b.mov", "a/y.mkv", "a/no.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    got = vs.load_videos(spark, str(tmp_path)).orderBy("video_ord").collect()
    assert [json.loads(r.metadata)["relative_path"] for r in got] == ["a/y.mkv", "a-b.mov", "b/x.MP4"]
    assert [json.loads(r.metadata)["relative_path"] for r in vs.load_videos(spark, str(tmp_path), recursive=False).collect()] == ["a-b.mov"]
    (tmp_path / "l.JSONL").write_text('"a.mp4"\n\n"b.mp4"\n')
    rows = vs.load_videos(spark, str(tmp_path / "l.JSONL")).orderBy("video_ord").collect()
    assert [(r.video_ord, r.path) for r in rows] == [(1, f"{tmp_path}/a.mp4"), (3, f"{tmp_path}/b.mp4")]
    with pytest.raises(FileNotFoundError):
        vs.load_videos(spark, str(tmp_path / "none.json"))
    with pytest.raises(ValueError):
        vs.source_kind("x.csv", False)
    with pytest.raises(FileNotFoundError):
        vs.require_videos(vs.load_videos(spark, str(tmp_path / "l.JSONL")), spark.createDataFrame([], "path string"))


BASE = {"candidate_id": "c", "video_id": 5, "video_path": "p", "timestamp_seconds": "1.5", "image_path": "i", "source": "scene", "score": None}


def test_candidate_rows(spark):
    got = mf.parse_candidates(lines(spark, [json.dumps(BASE), "  ", json.dumps(BASE | {"decision": "accepted", "score": 0.5, "metadata": {"a": [1]}})])).orderBy("ord").collect()
    assert [(r.video_id, r.timestamp_seconds, r.score, r.decision, r.metadata, r.ord) for r in got] == [("5", 1.5, None, "pending", "{}", 1), ("5", 1.5, 0.5, "accepted", '{"a":[1]}', 3)]


@pytest.mark.parametrize("row", [json.dumps(BASE | {"decision": None}), json.dumps(BASE | {"decision": "maybe"}), "[1]", "{bad", json.dumps({"candidate_id": "c"}), json.dumps(BASE | {"metadata": 1})])
def test_bad_candidate_rows(spark, row):
    with pytest.raises(Exception):
        mf.parse_candidates(lines(spark, [row])).collect()


def test_write_and_read_back(spark, tmp_path):
    rows = mf.parse_candidates(lines(spark, [json.dumps(BASE | {"metadata": {"k": "é"}})]))
    for _ in range(2):
        mf.write_manifest(rows, mf.CANDIDATE_KEYS, str(tmp_path / "out"), ["ord"])
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert list(json.loads(text)) == mf.CANDIDATE_KEYS and '"score":null' in text and "é" in text


def test_probe(spark):
    df = spark.createDataFrame([(i, "v", p) for i, p in enumerate(['{"format":{"duration":"12.5"}}', '{"format":{"duration":"N/A"}}', "{}", "", None])], "video_ord long, video_id string, payload string")
    assert [r.duration for r in pr.parse_probe(df).orderBy("video_ord").collect()] == [12.5, None, None, None, None]
    with pytest.raises(Exception):
        pr.parse_probe(spark.createDataFrame([(1, "v", '{"format":{"duration":"inf"}}')], "video_ord long, video_id string, payload string")).collect()


@pytest.mark.parametrize("payload", ["not json", "[1]", " ", '"x"', '{"format":5}', '{"format":null}', '{"format":{"duration":"abc"}}', '{"format":{"duration":[1]}}'])
def test_broken_probe_is_an_error(spark, payload):
    with pytest.raises(Exception):
        pr.parse_probe(spark.createDataFrame([(1, "v", payload)], "video_ord long, video_id string, payload string")).collect()


def test_probe_without_a_duration(spark):
    given = ['{"format":{}}', '{"format":{"duration":null}}', '{"format":{"duration":7}}', '{"streams":[]}']
    df = spark.createDataFrame([(i, "v", p) for i, p in enumerate(given)], "video_ord long, video_id string, payload string")
    assert [r.duration for r in pr.parse_probe(df).orderBy("video_ord").collect()] == [None, None, 7.0, None]


A, B = "frame:0 pts:100 pts_time:4.0", "frame:1 pts:200 pts_time:8.0"


def test_a_number_that_is_none_is_an_error(spark):
    texts = spark.createDataFrame([(1, "v", "frame:0 pts:1 pts_time:1e")], "video_ord long, video_id string, text string")
    with pytest.raises(Exception):
        pr.parse_scene_log(pr.split_log(texts)).collect()


@pytest.mark.parametrize(
    "log,want",
    [
        ([A, "lavfi.scene_score=0.52", B], [(4.0, 0.52), (8.0, None)]),
        ([A, "lavfi.scene_score=0.52", B, "[Parsed_showinfo_2] n: 0 pts_time:9.0"], [(4.0, 0.52), (8.0, None)]),
        (["lavfi.scene_score=0.9", "frame:0 pts:1 pts_time:1.0"], [(1.0, None)]),
        (["frame:0 pts:1 pts_time:1.0", "lavfi.scene_score=0.4", "lavfi.scene_score=0.6"], [(1.0, 0.6)]),
        (["showinfo x pts_time:3.5", "showinfo x pts_time:2.5"], [(2.5, None), (3.5, None)]),
        (["frame: 3  pts:\t-7\tpts_time: 1.5\tpos:3", "x lavfi.scene_score=0.5,"], [(1.5, 0.5)]),
        (["frame:0 pts:1 pts_time:1.0", "lavfi.scene_score=nan"], [(1.0, None)]),
        (["frame:0 pts:1 pts_time:1.5e1;pts_time:2.0"], [(15.0, None)]),
        (["subframe:0\u2003pts:1 pts_time:+.5"], [(0.5, None)]),
        (["frame:0 pts_time:1.0 pts:1", "frame: pts:1 pts_time:1.0"], []),
        (["showinfo pts_time:1.0 pts_time:2.0x lavfi.scene_score=0.3"], [(2.0, None)]),
    ],
)
def test_scene_log(spark, log, want):
    texts = spark.createDataFrame([(1, "v", "\r".join(log))], "video_ord long, video_id string, text string")
    assert [(r.t, r.score) for r in pr.parse_scene_log(pr.split_log(texts)).orderBy("t").collect()] == want
