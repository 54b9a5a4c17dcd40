"""Queries of the selection and review operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stillpoint.functions.ids import video_id
from stillpoint.functions.ranks import review_priority
from stillpoint.functions.spans import placed
from stillpoint.functions.tables import new_path
from stillpoint.operators import events as ev
from stillpoint.operators import review as rv
from stillpoint.options import ReviewOptions, SelectionOptions
from stillpoint.plans import workflows as wf
from stillpoint.plans.requests import checked_requests
from stillpoint.queries.base import CAND, CID, DPRIO, EV, KID, PRIO, STEP, VID, candidates, events, query, table, videos
from stillpoint.sources import manifests as mf
from stillpoint.sources import probes as pr
from stillpoint.sources import videos as vs

OPTIONS = SelectionOptions(scene_threshold=0.35, interval=STEP, spacing=STEP, max_candidates=20)
REVIEW = ReviewOptions(pending="accept", max_keyframes=5)
ALL = "video_ord, video_id, t, source, score, ord"
LANE = 1 << 40


@query("scene_filter", f"WITH {EV} SELECT {ALL} FROM ev WHERE score > 0.35")
def scene_filter(spark, d):
    return ev.scene_filter(events(spark, d), 0.35)


@query("nonnegative_events", f"WITH {EV} SELECT video_ord, video_id, t - 86400 AS t, source, score, ord FROM ev WHERE t - 86400 >= 0")
def nonnegative_events(spark, d):
    return ev.nonnegative_events(events(spark, d).withColumn("t", F.col("t") - 86400))


SEED = "SELECT video_ord, video_id, CAST(0 AS DOUBLE) AS t, 'seed' AS source, CAST(1 AS DOUBLE) AS score, CAST(0 AS BIGINT) AS ord FROM vid"
PERIODIC = f"SELECT video_ord, video_id, i * CAST({STEP} AS DOUBLE) AS t, 'periodic' AS source, CAST(0 AS DOUBLE) AS score, CAST(i AS BIGINT) AS ord FROM vid, LATERAL (SELECT unnest(generate_series(1, CAST(floor(duration / {STEP}) AS BIGINT))) AS i) WHERE duration > 0"
TAIL = f"""SELECT video_ord, video_id, greatest(0, duration - 1) AS t, 'periodic' AS source, CAST(0 AS DOUBLE) AS score, n + 1 AS ord
  FROM (SELECT *, CAST(floor(duration / {STEP}) AS BIGINT) AS n FROM vid WHERE duration > 0)
  WHERE duration - 1 > 0 AND (n < 1 OR duration - 1 - n * CAST({STEP} AS DOUBLE) > {STEP / 2})"""


@query("seed_events", f"WITH {EV}, {VID} {SEED}")
def seed_events(spark, d):
    return ev.seed_events(videos(spark, d))


@query("periodic_events", f"WITH {EV}, {VID} {PERIODIC}")
def periodic_events(spark, d):
    return ev.periodic_events(videos(spark, d), STEP)


@query("tail_event", f"WITH {EV}, {VID} {TAIL}")
def tail_event(spark, d):
    return ev.tail_events(videos(spark, d), STEP)


SCENES = f"SELECT video_ord, video_id, t, source, score, ord FROM (SELECT *, row_number() OVER (PARTITION BY video_ord, CAST(round_even(t * 1000, 0) AS BIGINT) ORDER BY t, ord) AS n FROM ev WHERE source = 'scene' AND score > 0.35) WHERE n = 1"
UNION = f"""u AS (
  {SEED}
  UNION ALL SELECT video_ord, video_id, t, source, score, ord + {LANE} FROM ({SCENES})
  UNION ALL SELECT video_ord, video_id, t, source, score, ord + {2 * LANE} FROM ({PERIODIC})
  UNION ALL SELECT video_ord, video_id, t, source, score, ord + {2 * LANE} FROM ({TAIL})
)"""


@query("event_union", f"WITH {EV}, {VID}, {UNION} SELECT * FROM u")
def event_union(spark, d):
    v, e = videos(spark, d), events(spark, d).filter("source = 'scene'")
    found = ev.scene_dedupe(ev.scene_filter(e, 0.35))
    return ev.event_union(ev.seed_events(v), found, ev.periodic_events(v, STEP).unionByName(ev.tail_events(v, STEP)))


@query(
    "read_attempts",
    f"""WITH {EV}, a AS (SELECT *, [t, greatest(0, t - 0.25), greatest(0, t - 0.5), greatest(0, t - 1.0)] AS l FROM ev),
b AS (SELECT ord, unnest(l) AS attempt_t, generate_subscripts(l, 1) AS p FROM a),
c AS (SELECT ord, attempt_t, min(p) AS p FROM b GROUP BY ord, attempt_t)
SELECT ord, attempt_t, CAST(row_number() OVER (PARTITION BY ord ORDER BY p) - 1 AS INTEGER) AS attempt FROM c""",
)
def read_attempts(spark, d):
    return ev.read_attempts(events(spark, d)).select("ord", "attempt", "attempt_t")


@query(
    "scene_dedupe",
    f"WITH {EV}, s AS (SELECT * REPLACE (floor(t / 36000) AS t) FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY video_ord, CAST(round_even(t * 1000, 0) AS BIGINT) ORDER BY t, ord) AS n FROM s) SELECT {ALL} FROM r WHERE n = 1",
)
def scene_dedupe(spark, d):
    return ev.scene_dedupe(events(spark, d).withColumn("t", F.floor(F.col("t") / 36000).cast("double")))


def merged(source: str, name: str) -> str:
    """Recursive SQL of the spacing merge over ``source``, as CTE ``name``."""
    return f"""{name}_r AS (
  SELECT *, {PRIO} AS prio, coalesce(score, 0) AS sc, row_number() OVER (PARTITION BY video_ord ORDER BY t, ord) AS rn FROM {source}
), {name}_f AS (
  SELECT video_ord, rn, t AS last_t, prio AS last_p, sc AS last_s, ord AS last_ord, 1 AS seg FROM {name}_r WHERE rn = 1
  UNION ALL
  SELECT r.video_ord, r.rn,
    CASE WHEN r.t - f.last_t >= {STEP} OR r.prio > f.last_p OR (r.prio = f.last_p AND r.sc > f.last_s) THEN r.t ELSE f.last_t END,
    CASE WHEN r.t - f.last_t >= {STEP} OR r.prio > f.last_p OR (r.prio = f.last_p AND r.sc > f.last_s) THEN r.prio ELSE f.last_p END,
    CASE WHEN r.t - f.last_t >= {STEP} OR r.prio > f.last_p OR (r.prio = f.last_p AND r.sc > f.last_s) THEN r.sc ELSE f.last_s END,
    CASE WHEN r.t - f.last_t >= {STEP} OR r.prio > f.last_p OR (r.prio = f.last_p AND r.sc > f.last_s) THEN r.ord ELSE f.last_ord END,
    f.seg + CASE WHEN r.t - f.last_t >= {STEP} THEN 1 ELSE 0 END
  FROM {name}_f f JOIN {name}_r r ON r.video_ord = f.video_ord AND r.rn = f.rn + 1
), {name}_k AS (
  SELECT video_ord, seg, arg_max(last_ord, rn) AS ord FROM {name}_f GROUP BY video_ord, seg
), {name} AS (
  SELECT s.video_ord, s.video_id, s.t, s.source, s.score, s.ord FROM {source} s JOIN {name}_k k ON k.video_ord = s.video_ord AND k.ord = s.ord
)"""


@query("spacing_merge", f"WITH RECURSIVE {EV}, {merged('ev', 'm')} SELECT * FROM m")
def spacing_merge(spark, d):
    return ev.spacing_merge(events(spark, d), STEP)


CAPPED = f"SELECT video_ord, video_id, t, source, score, ord FROM (SELECT *, row_number() OVER (PARTITION BY video_ord ORDER BY {PRIO} DESC, coalesce(score, 0) DESC, t, ord) AS n FROM {{}}) WHERE n <= 20"


@query("candidate_cap", f"WITH {EV} {CAPPED.format('ev')}")
def candidate_cap(spark, d):
    return ev.candidate_cap(events(spark, d), 20)


@query("selection_rank", f"WITH {EV} SELECT ord, CAST(row_number() OVER (PARTITION BY video_ord ORDER BY {PRIO} DESC, coalesce(score, 0) DESC, t, ord) AS INTEGER) AS place FROM ev")
def selection_rank(spark, d):
    from pyspark.sql.window import Window

    from stillpoint.functions.ranks import best_first, source_priority

    order = Window.partitionBy("video_ord").orderBy(*best_first(source_priority(F.col("source")), F.col("score"), F.col("t"), F.col("ord")))
    return events(spark, d).select("ord", F.row_number().over(order).alias("place"))


ROW = "candidate_id, video_id, video_path, t AS timestamp_seconds, image_path, source, score, decision, metadata, video_ord, ord"


@query("candidate_rows", f"WITH {EV}, {CAND} SELECT {ROW.replace('decision', chr(39) + 'pending' + chr(39) + ' AS decision')} FROM cand")
def candidate_rows(spark, d):
    return rv.candidate_rows(events(spark, d).withColumn("video_path", F.concat(F.lit("/videos/"), "video_id", F.lit(".mp4"))), "/out/candidates")


PLAN = f"{EV}, {VID}, {UNION}, {merged('u', 'm')}, p AS ({CAPPED.format('m')})"


def _plan_inputs(spark, d):
    return videos(spark, d), ev.scene_filter(events(spark, d).filter("source = 'scene'"), OPTIONS.scene_threshold)


@query("plan", f"WITH RECURSIVE {PLAN} SELECT * FROM p")
def plan(spark, d):
    return wf.plan(*_plan_inputs(spark, d), OPTIONS)


UNSCORED = f"{EV.replace('value / 500 AS score', 'CASE WHEN event_id % 2 = 0 THEN value / 500 END AS score')}"


@query("plan_as_found", f"WITH RECURSIVE {PLAN.replace(EV, UNSCORED).replace('score > 0.35', 'true')} SELECT * FROM p")
def plan_as_found(spark, d):
    """Scenes of a log without scores for half of them, as a detector's own threshold left them."""
    found = events(spark, d).filter("source = 'scene'").withColumn("score", F.when(F.col("ord") % 2 == 0, F.col("score")))
    return wf.plan(videos(spark, d), found, OPTIONS)


def _earlier(spark, d):
    """An earlier manifest: even events decided by id, later rows winning."""
    rows = wf.prepare(*_plan_inputs(spark, d), "/out/candidates", OPTIONS).filter("ord % 2 = 0")
    first = rows.withColumn("decision", F.lit("accepted")).withColumn("ord", F.lit(1).cast("long"))
    again = rows.filter("video_ord % 2 = 0").withColumn("decision", F.lit("rejected")).withColumn("ord", F.lit(2).cast("long"))
    return first.unionByName(again)


PREPARED = f"""c AS (
  SELECT {CID} AS candidate_id, p.video_id, path AS video_path, p.t, '/out/candidates/' || p.video_id || '/' || {CID} || '.jpg' AS image_path, source, score,
    CASE WHEN ord % 2 <> 0 THEN 'pending' WHEN p.video_ord % 2 = 0 THEN 'rejected' ELSE 'accepted' END AS decision,
    '{{"selector":"scene_plus_periodic"}}' AS metadata, p.video_ord, ord
  FROM p JOIN (SELECT video_ord AS vo, path FROM vid) ON vo = p.video_ord
)""".replace("video_id || '_'", "p.video_id || '_'").replace("t * 1000", "p.t * 1000")
# ids that two planned events share carry the decision of either; the data has none


@query("prepare", f"WITH RECURSIVE {PLAN}, {PREPARED} SELECT {ROW} FROM c")
def prepare(spark, d):
    return wf.prepare(*_plan_inputs(spark, d), "/out/candidates", OPTIONS, _earlier(spark, d))


@query("last_decision", f"WITH {EV}, {CAND} SELECT candidate_id, arg_max(decision, ord) AS decision FROM cand GROUP BY candidate_id")
def last_decision(spark, d):
    return rv.last_decisions(candidates(spark, d))


@query(
    "carry_decisions",
    f"WITH {EV}, {CAND}, old AS (SELECT candidate_id, arg_max(decision, ord) AS dec FROM cand WHERE ord % 2 = 0 GROUP BY candidate_id) SELECT candidate_id, ord, coalesce(dec, 'pending') AS decision FROM cand LEFT JOIN old USING (candidate_id)",
)
def carry_decisions(spark, d):
    rows = candidates(spark, d)
    return rv.carry_decisions(rows, rv.last_decisions(rows.filter("ord % 2 = 0"))).select("candidate_id", "ord", "decision")


@query("extraction_worklist", f"WITH {EV}, {CAND} SELECT candidate_id, image_path, ord FROM cand WHERE image_path NOT IN (SELECT image_path FROM cand WHERE ord % 4 = 0)")
def extraction_worklist(spark, d):
    rows = candidates(spark, d)
    return rv.worklist(rows, rows.filter("ord % 4 = 0").select(F.col("image_path").alias("path"))).select("candidate_id", "image_path", "ord")


@query("review_filter", f"WITH {EV}, {CAND} SELECT candidate_id, decision, ord FROM cand WHERE decision = 'accepted'")
def review_filter(spark, d):
    return rv.review_filter(candidates(spark, d), "reject").select("candidate_id", "decision", "ord")


@query("review_rank", f"WITH {EV}, {CAND} SELECT ord, {DPRIO} + {PRIO} AS priority FROM cand")
def review_rank(spark, d):
    return candidates(spark, d).select("ord", review_priority(F.col("decision"), F.col("source")).alias("priority"))


KEPT = f"k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {DPRIO} + {PRIO} DESC, coalesce(score, 0) DESC, t, ord) AS n FROM {{}} WHERE decision <> 'rejected') WHERE n <= 5)"


@query("keyframe_cap", f"WITH {EV}, {CAND}, {KEPT.format('cand')} SELECT candidate_id, ord FROM k")
def keyframe_cap(spark, d):
    return rv.keyframe_cap(rv.review_filter(candidates(spark, d)), 5).select("candidate_id", "ord")


KEYFRAME = f"""SELECT {KID} AS keyframe_id, candidate_id, video_id, video_path, t AS timestamp_seconds,
  '/out/keyframes/' || video_id || '/' || {KID} || '.jpg' AS image_path, source, score,
  '{{"review_decision":"' || decision || '","selector":"scene_plus_periodic"}}' AS metadata, image_path AS source_image, ord"""


def _sorted(rows):
    """JSON metadata with its keys in order, as text compares them."""
    entries = F.array_sort(F.map_entries(F.from_json("metadata", "map<string,string>")))
    return rows.withColumn("metadata", F.to_json(F.map_from_entries(entries)))


@query("keyframe_rows", f"WITH {EV}, {CAND} {KEYFRAME} FROM cand")
def keyframe_rows(spark, d):
    return _sorted(rv.keyframe_rows(candidates(spark, d), "/out/keyframes"))


@query("finalize", f"WITH {EV}, {CAND}, {KEPT.format('cand')} {KEYFRAME} FROM k")
def finalize(spark, d):
    return _sorted(wf.finalize(candidates(spark, d), "/out/keyframes", REVIEW))


@query("export_worklist", f"WITH {EV}, {CAND}, {KEPT.format('cand')}, f AS ({KEYFRAME} FROM k) SELECT source_image, image_path FROM f WHERE image_path NOT IN (SELECT image_path FROM f WHERE ord % 4 = 0)")
def export_worklist(spark, d):
    rows = wf.finalize(candidates(spark, d), "/out/keyframes", REVIEW)
    return rv.worklist(rows, rows.filter("ord % 4 = 0").select(F.col("image_path").alias("path"))).select("source_image", "image_path")


@query("run_summary", f"WITH {EV}, {CAND}, {KEPT.format('cand')} SELECT (SELECT count(*) FROM cand) AS candidate_count, (SELECT count(*) FROM k) AS keyframe_count")
def run_summary(spark, d):
    rows = candidates(spark, d)
    return rv.run_summary(rows, wf.finalize(rows, "/out/keyframes", REVIEW))


@query("output_order", f"WITH {EV}, {CAND}, {KEPT.format('cand')} SELECT candidate_id, ord, CAST(row_number() OVER (ORDER BY video_id, t, ord) AS INTEGER) AS place FROM k")
def output_order(spark, d):
    rows = rv.keyframe_cap(rv.review_filter(candidates(spark, d)), 5)
    return placed(rows, mf.KEYFRAME_ORDER, "place").select("candidate_id", "ord", (F.col("place") + 1).cast("int").alias("place"))


RUN = f"""WITH RECURSIVE {PLAN}, {PREPARED.replace("'/out/candidates/'", "'/out/candidates/'")}, {KEPT.format('c')} {KEYFRAME} FROM k"""


@query("run_all", RUN)
def run_all(spark, d):
    return _sorted(wf.run(*_plan_inputs(spark, d), "/out", OPTIONS, REVIEW, _earlier(spark, d)))


@query("probe_parse", f"WITH {EV}, {VID} SELECT video_ord, video_id, CASE WHEN video_ord % 5 IN (0, 1, 2) THEN NULL ELSE round(duration, 3) END AS duration FROM vid")
def probe_parse(spark, d):
    v = videos(spark, d)
    third = F.col("video_ord") % 5
    text = F.when(third == 0, "").when(third == 1, '{"format":{"duration":"N/A"}}').when(third == 2, "{}").otherwise(F.concat(F.lit('{"format":{"duration":"'), F.round("duration", 3).cast("string"), F.lit('"}}')))
    return pr.parse_probe(v.select("video_ord", "video_id", text.alias("payload")))


@query(
    "scene_log_parse",
    f"""WITH {EV}, s AS (SELECT video_ord, video_id, ord, round(t, 3) AS t, CASE WHEN video_ord % 4 = 0 OR ord % 3 = 0 THEN NULL ELSE round(score, 3) END AS score FROM ev),
r AS (SELECT *, row_number() OVER (PARTITION BY video_ord, CAST(round_even(t * 1000, 0) AS BIGINT) ORDER BY t, ord) AS n FROM s)
SELECT video_id, t, score FROM r WHERE n = 1""",
)
def scene_log_parse(spark, d):
    t, s = F.round("t", 3).cast("string"), F.round("score", 3).cast("string")
    frame = F.concat(F.lit("frame:"), F.col("ord").cast("string"), F.lit(" pts:"), F.col("ord").cast("string"), F.lit(" pts_time:"), t)
    info = F.concat(F.lit("[Parsed_showinfo_2] n: 0 pts_time:"), t)
    early, score = F.lit("lavfi.scene_score=9.5"), F.concat(F.lit("lavfi.scene_score="), s)
    lines = F.when(F.col("video_ord") % 4 == 0, F.array(info)).when(F.col("ord") % 3 == 0, F.array(frame, info)).otherwise(F.array(frame, early, info, score))
    logs = events(spark, d).select("video_ord", "video_id", F.posexplode(lines).alias("p", "line"), (F.col("ord") * 8).alias("base"))
    return pr.parse_scene_log(logs.select("video_ord", "video_id", (F.col("base") + F.col("p")).alias("line_no"), "line")).select("video_id", "t", "score")


def _id_sql(path: str, label: str) -> str:
    slug = f"trim(lower(regexp_replace({label}, '[^a-zA-Z0-9]+', '-', 'g')), '-')"
    return f"CASE WHEN {slug} = '' THEN 'video' ELSE {slug} END || '-' || substr(sha1({path}), 1, 10)"


PATHS = "pp AS (SELECT page_id, '/m/' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS raw FROM pages), p AS (SELECT page_id, CASE WHEN length(regexp_replace(raw, '/+$', '')) > 0 THEN regexp_replace(raw, '/+$', '') ELSE raw END AS path FROM pp), q AS (SELECT page_id, path, regexp_replace(substr(path, 4), '([^/])\\.[^./]+$', '\\1') AS label FROM p)"


def _paths(spark, d):
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, d, "pages").select(F.col("page_id").alias("video_ord"), bare.alias("bare"))


@query("video_ids", f"WITH {PATHS} SELECT page_id AS video_ord, {_id_sql('path', 'label')} AS video_id FROM q")
def video_ids(spark, d):
    return _paths(spark, d).select("video_ord", video_id(F.concat(F.lit("/m/"), "bare"), "/m").alias("video_id"))


@query("video_paths", f"WITH {PATHS} SELECT path FROM q")
def video_paths(spark, d):
    rows = _paths(spark, d).select("video_ord", F.parse_json(F.to_json(F.array("bare"))).alias("a"))
    return vs.video_paths(vs.normalise_rows(rows.select("video_ord", F.variant_get("a", "$[0]", "variant").alias("payload")), "/m"))


@query("missing_videos", f"WITH {PATHS} SELECT page_id AS video_ord, path FROM q WHERE path NOT IN (SELECT path FROM q WHERE page_id % 7 <> 3) ORDER BY page_id LIMIT 3")
def missing_videos(spark, d):
    from stillpoint.functions.ids import tidy_path

    rows = _paths(spark, d).select("video_ord", tidy_path(F.concat(F.lit("/m/"), "bare")).alias("path"))
    return vs.missing_videos(rows, rows.filter("video_ord % 7 <> 3")).select("video_ord", "path")


def _payload_json():
    """Video objects made of documents: an id or none, metadata under and beside."""
    return F.to_json(
        F.struct(
            F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("id"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".mp4")).alias("video_path"),
            F.col("lang"), F.struct(F.lit("x").alias("lang"), F.col("n_chars").cast("string").alias("n_chars")).alias("metadata"),
        )
    )


VIDEO_ROWS = f"""v AS (SELECT doc_id, '/m/' || source || '/' || doc_id || '.mp4' AS path, source || '/' || doc_id AS label, lang, n_chars FROM documents),
w AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id <> 0 THEN CAST(doc_id AS VARCHAR) ELSE {_id_sql('path', 'label')} END AS video_id, path, '{{"lang":"' || lang || '","n_chars":"' || n_chars || '"}}' AS metadata FROM v)"""


@query("manifest_rows", f"WITH {VIDEO_ROWS} SELECT doc_id AS video_ord, video_id, path, metadata FROM w")
def manifest_rows(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("video_ord"), F.parse_json(_payload_json()).alias("payload"))
    return _sorted(vs.normalise_rows(rows, "/m"))


@query("manifest_jsonl", f"WITH {VIDEO_ROWS} SELECT doc_id AS video_ord, video_id, path, metadata FROM w WHERE doc_id % 3 <> 2 UNION ALL SELECT doc_id, {_id_sql('path', 'label')}, path, '{{}}' FROM v WHERE doc_id % 3 = 2")
def manifest_jsonl(spark, d):
    docs = table(spark, d, "documents")
    name = F.concat(F.lit('"'), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit('.mp4"'))
    line = F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("  "), name)).otherwise(_payload_json())
    lines = docs.select(F.col("doc_id").alias("line_no"), F.explode(F.array(line, F.lit("  "))).alias("line"))
    return _sorted(vs.normalise_rows(vs.parse_jsonl(lines), "/m"))


@query("manifest_json", f"WITH {VIDEO_ROWS} SELECT source, video_id, path, metadata FROM w JOIN (SELECT doc_id, source FROM documents) USING (doc_id)")
def manifest_json(spark, d):
    docs = table(spark, d, "documents").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    inner = docs.groupBy("source", "salt").agg(F.collect_list(_payload_json()).alias("rows"))
    text = F.concat(F.when(F.col("salt") % 2 == 0, '{"videos":[').otherwise('{"videos":null,"items":['), F.array_join("rows", ","), F.lit("]}"))
    parsed = vs.parse_json(inner.select(text.alias("text")))
    rows = _sorted(vs.normalise_rows(parsed, "/m"))
    return rows.select(F.regexp_extract("path", "^/m/([^/]+)/", 1).alias("source"), "video_id", "path", "metadata")


@query("candidate_manifest", f"WITH {EV}, {CAND} SELECT candidate_id, t AS timestamp_seconds, score, CASE WHEN ord % 5 = 0 THEN 'pending' ELSE decision END AS decision, metadata, ord FROM cand")
def candidate_manifest(spark, d):
    rows = candidates(spark, d)
    lines = mf.json_lines(rows, mf.CANDIDATE_KEYS).withColumn("value", F.when(F.col("ord") % 5 == 0, F.regexp_replace("value", ',"decision":"[a-z]+"', "")).otherwise(F.col("value")))
    return mf.parse_candidates(lines.select(F.col("ord").alias("line_no"), F.col("value").alias("line"))).select("candidate_id", "timestamp_seconds", "score", "decision", "metadata", "ord")


@query("keyframe_manifest", f"WITH {EV}, {CAND}, f AS ({KEYFRAME} FROM cand) SELECT keyframe_id, candidate_id, timestamp_seconds, image_path, score, metadata, ord FROM f")
def keyframe_manifest(spark, d):
    rows = rv.keyframe_rows(candidates(spark, d), "/out/keyframes")
    lines = mf.json_lines(rows, mf.KEYFRAME_KEYS).select(F.col("ord").alias("line_no"), F.col("value").alias("line"))
    return _sorted(mf.parse_keyframes(lines)).select("keyframe_id", "candidate_id", "timestamp_seconds", "image_path", "score", "metadata", "ord")


@query("manifest_write", f"WITH {EV}, {CAND} SELECT row_number() OVER (ORDER BY video_ord, t, ord) AS line_no, json_object('candidate_id', candidate_id, 'video_id', video_id, 'source', source, 'score', CASE WHEN ord % 2 = 0 THEN CAST(ord AS INTEGER) END, 'decision', decision, 'metadata', json(metadata)) AS line FROM cand")
def manifest_write(spark, d):
    """Write the manifest, then read its lines back."""
    rows = candidates(spark, d).withColumn("score", F.when(F.col("ord") % 2 == 0, F.col("ord")))
    path = new_path(spark, "manifest.jsonl")
    mf.write_manifest(rows, ["candidate_id", "video_id", "source", "score", "decision", "metadata"], path, mf.CANDIDATE_ORDER)
    return vs.numbered_lines(spark, path)


FILES = "'/m/' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || CASE page_id % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MkV' WHEN 2 THEN '/x.webm' ELSE '.txt' END"


@query(
    "discover_videos",
    f"""WITH f AS (SELECT page_id, {FILES} AS path FROM pages), v AS (SELECT path, substr(path, 4) AS relative FROM f WHERE page_id % 4 <> 3)
SELECT row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS video_ord, path, '{{"relative_path":"' || relative || '"}}' AS metadata FROM v""",
)
def discover_videos(spark, d):
    """The addresses of pages as a listing of files."""
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    kind = F.col("page_id") % 4
    end = F.when(kind == 0, ".mp4").when(kind == 1, ".MkV").when(kind == 2, "/x.webm").otherwise(".txt")
    files = table(spark, d, "pages").select(F.concat(F.lit("/m/"), bare, end).alias("path"))
    return vs.listed_videos(files, "/m").select("video_ord", "path", "metadata")


@query(
    "source_dispatch",
    f"""WITH f AS (SELECT page_id, page_id % 5 = 4 AS is_directory, {FILES.replace("'.mp4'", "'.JSONL'").replace("'.MkV'", "'.json'")} AS source FROM pages)
SELECT page_id, CASE WHEN is_directory THEN 'directory' WHEN lower(source) LIKE '%.jsonl' THEN 'jsonl' WHEN lower(source) LIKE '%.json' THEN 'json' END AS kind FROM f""",
)
def source_dispatch(spark, d):
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    kind = F.col("page_id") % 4
    end = F.when(kind == 0, ".JSONL").when(kind == 1, ".json").when(kind == 2, "/x.webm").otherwise(".txt")
    sources = table(spark, d, "pages").select("page_id", F.concat(F.lit("/m/"), bare, end).alias("source"), (F.col("page_id") % 5 == 4).alias("is_directory"))
    return vs.source_kinds(sources).select("page_id", "kind")


@query(
    "job_options",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_discount * 11 AS scene_threshold, l_quantity - 3 AS interval, l_tax * 100 - 1 AS spacing,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber - 1 END AS max_candidates, l_partkey % 11 AS image_quality,
  CASE l_returnflag WHEN 'A' THEN ' Accept ' WHEN 'R' THEN 'reject' WHEN 'N' THEN CASE l_linestatus WHEN 'O' THEN 'ACCEPT' ELSE 'later' END END AS pending,
  CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 3 - 1 END AS max_keyframes FROM lineitem)
SELECT l_orderkey, l_linenumber, lower(trim(pending)) AS policy, CASE WHEN NOT scene_threshold BETWEEN 0 AND 1 THEN 'scene_threshold' WHEN interval <= 0 THEN 'interval' WHEN spacing < 0 THEN 'spacing'
  WHEN max_candidates <= 0 THEN 'max_candidates' WHEN image_quality <= 0 THEN 'image_quality' WHEN lower(trim(pending)) NOT IN ('accept', 'reject') THEN 'pending' WHEN max_keyframes <= 0 THEN 'max_keyframes' END AS problem FROM r""",
)
def job_options(spark, d):
    """Lines of orders as job requests."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    pending = F.when(flag == "A", " Accept ").when(flag == "R", "reject").when(flag == "N", F.when(status == "O", "ACCEPT").otherwise("later"))
    requests = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") * 11).alias("scene_threshold"), (F.col("l_quantity") - 3).alias("interval"), (F.col("l_tax") * 100 - 1).alias("spacing"),
        F.when(F.col("l_linenumber") != 7, F.col("l_linenumber") - 1).alias("max_candidates"), (F.col("l_partkey") % 11).alias("image_quality"), pending.alias("pending"),
        F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey") % 3 - 1).alias("max_keyframes"),
    )
    return checked_requests(requests).select("l_orderkey", "l_linenumber", "policy", "problem")
