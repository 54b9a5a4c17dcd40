"""Queries of the search, temporal and corpus operators, with their SQL.

Documents are the text of keyframes, embeddings their vectors (the label is a colour class
and a video), events their times.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from stillpoint.functions.ids import keyframe_id, millis
from stillpoint.functions.tables import kept, new_path, scratch
from stillpoint.operators import corpus as co
from stillpoint.operators import search as se
from stillpoint.operators import temporal as te
from stillpoint.queries.base import EV, KID, events, query, table
from stillpoint.sources.index_store import KeyframeStore
from stillpoint.sources.text_store import TextStore, co_located


def _items(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")


def _queries(spark, d):
    """The whole benchmark texts."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


TERMS = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
POST = f"post AS (SELECT term, item_id, count(*) AS tf FROM (SELECT doc_id AS item_id, unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY term, item_id)"
QT = f"""q0 AS (SELECT item_id AS query_id, text AS qtext FROM benchmark),
qt AS (SELECT query_id, len(ts) AS n_terms, unnest(ts) AS term FROM (SELECT query_id, list_distinct({TERMS.format('qtext')}) AS ts FROM q0))"""
EXACT = f"{POST}, {QT}, hit AS (SELECT query_id, item_id, CAST(sum(tf) AS BIGINT) AS score FROM post JOIN qt USING (term) GROUP BY query_id, item_id HAVING count(*) = any_value(n_terms))"


@query("text_index", f"WITH {POST} SELECT term, item_id, tf FROM post")
def text_index(spark, d):
    return se.text_index(_items(spark, d))


@query("term_frequency", f"WITH {POST} SELECT term, count(*) AS df FROM post GROUP BY term")
def term_frequency(spark, d):
    return se.document_frequency(se.text_index(_items(spark, d)))


@contextmanager
def _store(spark, d, items=None):
    """The documents as a stored index, dropped at the end."""
    store = TextStore.create(spark, new_path(spark, "text-index"), _items(spark, d) if items is None else items)
    try:
        with co_located(spark):
            yield store
    finally:
        store.drop()


@query("stored_index", f"WITH {POST}, d AS (SELECT term, count(*) AS df FROM post GROUP BY term) SELECT term, item_id, tf, df FROM post JOIN d USING (term)")
def stored_index(spark, d):
    """Half of the documents indexed, the others added in two steps, then merged."""
    items = _items(spark, d)
    with _store(spark, d, items.filter("item_id % 2 = 0")) as store, scratch(spark):
        store.add(items.filter("item_id % 4 = 1"))
        store.add(items.filter("item_id % 4 = 3"))
        store.merge()
        return kept(store.postings().join(store.frequencies(), "term"), "stored-index")


@query("text_exact", f"WITH {EXACT} SELECT query_id, item_id, score, contains(lower(text), lower(qtext)) AS phrase FROM hit JOIN q0 USING (query_id) JOIN documents ON doc_id = item_id")
def text_exact(spark, d):
    with _store(spark, d) as store, scratch(spark):
        return kept(se.text_exact(store, _queries(spark, d), _items(spark, d)), "hits")


@query(
    "text_fuzzy",
    # terms within distance 1 have the first or the last half of the shorter one in common
    f"""WITH {POST}, {QT}, qk AS (
  SELECT term, d, length(term) + d AS n, left(term, m // 2) AS head, right(term, m - m // 2) AS tail FROM (
    SELECT term, d, least(length(term), length(term) + d) AS m FROM (SELECT DISTINCT term FROM qt), (SELECT unnest([-1, 0, 1]) AS d))
), vk AS (
  SELECT term, d, length(term) AS n, left(term, m // 2) AS head, right(term, m - m // 2) AS tail FROM (
    SELECT term, d, least(length(term), length(term) - d) AS m FROM (SELECT DISTINCT term FROM post), (SELECT unnest([-1, 0, 1]) AS d))
), half AS (
  SELECT qk.term AS q, vk.term AS v FROM qk JOIN vk USING (d, n, head) UNION SELECT qk.term, vk.term FROM qk JOIN vk USING (d, n, tail)
), near AS (
  SELECT q, v AS term, CAST(q <> v AS INTEGER) AS dist FROM half
  WHERE len(list_filter(range(0, greatest(length(q), length(v))), lambda i: left(q, i) = left(v, i) AND (
    substr(q, i + 2) = substr(v, i + 2) OR substr(q, i + 2) = substr(v, i + 1) OR substr(q, i + 1) = substr(v, i + 2)))) > 0
), best AS (
  SELECT query_id, item_id, qt.term AS q, max(tf / (1 + dist)) AS s, any_value(n_terms) AS n_terms FROM qt JOIN near ON near.q = qt.term JOIN post ON post.term = near.term GROUP BY query_id, item_id, qt.term
)
SELECT query_id, item_id, round(sum(s), 6) AS score FROM best GROUP BY query_id, item_id HAVING count(*) = any_value(n_terms)""",
)
def text_fuzzy(spark, d):
    with _store(spark, d) as store, scratch(spark):
        return kept(se.text_fuzzy(store, _queries(spark, d)).withColumn("score", F.round("score", 6)), "hits")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"), F.array("label").alias("dominant_colors"), F.col("label").alias("video_id"))


def _asked(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), F.col("label").alias("color"))


E64 = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
COS = "list_inner_product(q.e, c.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.e, c.e)))"
SIM = f"{E64}, s AS (SELECT q.vec_id AS query_id, c.vec_id AS item_id, q.label AS qlabel, c.label, {COS} AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)"
TOP = "SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank, score FROM {}"


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query("vector_topk", f"WITH {SIM} SELECT query_id, item_id, rank, round(score, 6) AS score FROM ({TOP.format('s')}) WHERE rank <= 10")
def vector_topk(spark, d):
    items = _vectors(spark, d).select("item_id", "vec")
    return _rounded(se.vector_top_k(items, _asked(spark, d).select("query_id", "vec"), 10))


@query("color_search", f"WITH {SIM} SELECT query_id, item_id, rank, round(score, 6) AS score FROM ({TOP.format('(SELECT * FROM s WHERE label = qlabel)')}) WHERE rank <= 5")
def color_search(spark, d):
    return _rounded(se.color_search(_vectors(spark, d).select("item_id", "vec", "dominant_colors"), _asked(spark, d), 5))


@query("color_filter", "SELECT vec_id AS item_id FROM embeddings WHERE label = 3")
def color_filter(spark, d):
    return se.color_filter(_vectors(spark, d), 3).select("item_id")


@query(
    "clip_to_video",
    f"""WITH {SIM}, b AS (SELECT query_id % 200 AS clip_id, query_id, label AS video_id, max(score) AS best FROM s GROUP BY ALL),
w AS (SELECT clip_id, video_id, sum(best) AS score FROM b GROUP BY ALL)
SELECT clip_id, video_id, round(score, 6) AS score FROM w QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, video_id) <= 3""",
)
def clip_to_video(spark, d):
    frames = _asked(spark, d).select((F.col("query_id") % 200).alias("clip_id"), "query_id", "vec")
    return _rounded(se.clip_to_video(_vectors(spark, d).select("item_id", "vec", "video_id"), frames, 3).drop("rank")).withColumn("video_id", F.col("video_id").cast("int"))


def _hits(spark, d):
    with _store(spark, d) as store, scratch(spark):
        return kept(se.text_exact(store, _queries(spark, d)).withColumn("score", F.col("score").cast("double")), "hits")


@query("index_filter", f"WITH {EXACT} SELECT query_id, item_id, CAST(score AS DOUBLE) AS score FROM hit JOIN documents ON doc_id = item_id WHERE lang = 'en' AND n_chars > 500")
def index_filter(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "item_id")
    objects = docs.withColumn("detected_objects", F.array(F.struct(F.col("lang").alias("label"), F.lit(1.0).alias("score"))))
    return se.index_filter(_hits(spark, d), objects, se.has_object("en", 0.5) & (F.col("n_chars") > 500))


def _length_hits(spark, d, hits):
    """A second index: the same pairs, scored by the length of the item."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("n_chars").cast("double").alias("score"))
    return hits.drop("score").join(docs, "item_id").select("query_id", "item_id", "score")


def _fan(spark, d, hits):
    return se.fan_out(text=hits, size=_length_hits(spark, d, hits))


FAN = f"""{EXACT}, l AS (
  SELECT query_id, item_id, CAST(score AS DOUBLE) AS score, 'text' AS signal FROM hit
  UNION ALL SELECT query_id, item_id, CAST(n_chars AS DOUBLE), 'size' FROM hit JOIN documents ON doc_id = item_id
), n AS (
  SELECT query_id, item_id, signal, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS score
  FROM l WINDOW w AS (PARTITION BY query_id, signal)
), fan AS (
  SELECT query_id, item_id, max(score) FILTER (WHERE signal = 'text') AS text, max(score) FILTER (WHERE signal = 'size') AS size FROM n GROUP BY query_id, item_id
)"""
RANKED = f"{FAN}, r AS ({TOP.format('(SELECT query_id, item_id, coalesce(text, 0) * 0.75 + coalesce(size, 0) * 0.25 AS score FROM fan)')}), top AS (SELECT * FROM r WHERE rank <= 10)"


@query("fanout_combine", f"WITH {FAN} SELECT query_id, item_id, round(text, 6) AS text, round(size, 6) AS size FROM fan")
def fanout_combine(spark, d):
    out = _fan(spark, d, _hits(spark, d))
    return out.select("query_id", "item_id", F.round("text", 6).alias("text"), F.round("size", 6).alias("size"))


def _ranked(spark, d, hits=None):
    return se.weighted_rerank(_fan(spark, d, hits or _hits(spark, d)), {"text": 0.75, "size": 0.25}, 10)


@query("weighted_rerank", f"WITH {RANKED} SELECT query_id, item_id, rank, round(score, 6) AS score FROM top")
def weighted_rerank(spark, d):
    return _rounded(_ranked(spark, d))


def _labels(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("relevant"))


@query(
    "feedback_rerank",
    f"""WITH {RANKED}, f AS (SELECT query_id, item_id, score + CASE quality WHEN 1 THEN 0.5 WHEN 0 THEN -0.25 ELSE 0 END AS score FROM top LEFT JOIN labels ON doc_id = item_id)
SELECT query_id, item_id, rank, round(score, 6) AS score FROM ({TOP.format('f')})""",
)
def feedback_rerank(spark, d):
    return _rounded(se.feedback_rerank(_ranked(spark, d), _labels(spark, d), 0.5, 0.25))


@query(
    "retrieval_eval",
    f"""WITH {RANKED}, truth AS (SELECT DISTINCT query_id, item_id FROM hit JOIN labels ON doc_id = item_id WHERE quality = 1),
e AS (SELECT query_id, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS recall, min(rank) AS first FROM truth LEFT JOIN top USING (query_id, item_id) GROUP BY query_id)
SELECT count(*) AS n_queries, round(avg(recall), 6) AS recall_at_k, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM e""",
)
def retrieval_eval(spark, d):
    hits = _hits(spark, d)
    truth = hits.join(_labels(spark, d).filter("relevant = 1"), "item_id", "left_semi")
    out = se.retrieval_eval(_ranked(spark, d, hits), truth, 5)
    return out.select("n_queries", F.round("recall_at_k", 6).alias("recall_at_k"), F.round("mrr", 6).alias("mrr"))


@query(
    "answer_evidence",
    f"""WITH {RANKED} SELECT query_id, CAST(count(*) AS INTEGER) AS n_hits, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rank) AS item_ids,
  md5(string_agg(coalesce(d.text, ''), chr(10) ORDER BY rank)) AS evidence FROM top LEFT JOIN documents d ON doc_id = item_id WHERE rank <= 3 GROUP BY query_id""",
)
def answer_evidence(spark, d):
    return co.answer_evidence(_ranked(spark, d), _items(spark, d), 3).withColumn("evidence", F.md5("evidence"))


def _frames(spark, d):
    return events(spark, d).filter("source <> 'seed'").select("video_id", F.col("ord").alias("frame_id"), "t", "score", "source")


def _segments(spark, d):
    return events(spark, d).filter("source = 'seed'").select("video_id", F.col("ord").alias("segment_id"), "t")


@query(
    "nearest_segment",
    f"""WITH {EV}, f AS (SELECT * FROM ev WHERE source <> 'seed'), s AS (SELECT video_id, ord AS segment_id, t AS st FROM ev WHERE source = 'seed'),
j AS (SELECT f.video_id, f.ord AS frame_id, f.t, s.segment_id, abs(s.st - f.t) AS distance, row_number() OVER (PARTITION BY f.ord ORDER BY abs(s.st - f.t), s.st, s.segment_id) AS n FROM f LEFT JOIN s ON s.video_id = f.video_id)
SELECT video_id, frame_id, t, segment_id, round(distance, 6) AS distance FROM j WHERE n = 1""",
)
def nearest_segment(spark, d):
    return te.nearest_segment(_frames(spark, d).select("video_id", "frame_id", "t"), _segments(spark, d)).withColumn("distance", F.round("distance", 6))


@query(
    "neighbors",
    f"""WITH {EV}, p AS (SELECT video_id, ord AS frame_id, t, row_number() OVER (PARTITION BY video_id ORDER BY t, ord) AS n FROM ev),
h AS (SELECT DISTINCT p.video_id, p.n + i AS n FROM p, (SELECT unnest([-2, -1, 0, 1, 2]) AS i) WHERE p.frame_id % 50 = 0)
SELECT video_id, frame_id, t FROM p JOIN h USING (video_id, n)""",
)
def neighbors(spark, d):
    frames = events(spark, d).select("video_id", F.col("ord").alias("frame_id"), "t")
    return te.neighbors(frames.filter("frame_id % 50 = 0"), frames, 2)


SLICE = "SELECT video_id, frame_id, t, '{0}' AS part FROM (SELECT *, percent_rank() OVER (PARTITION BY video_id ORDER BY t {1}, frame_id {1}) AS p FROM f) WHERE p <= 0.25"


@query(
    "temporal_slice",
    f"""WITH {EV}, f AS (SELECT video_id, ord AS frame_id, t FROM ev), a AS (SELECT video_id, min(t) AS anchor_t FROM ev WHERE source = 'seed' GROUP BY video_id)
{SLICE.format('first', 'ASC')} UNION ALL {SLICE.format('last', 'DESC')} UNION ALL SELECT video_id, frame_id, t, 'after' FROM f JOIN a USING (video_id) WHERE t > anchor_t""",
)
def temporal_slice(spark, d):
    frames = events(spark, d).select("video_id", F.col("ord").alias("frame_id"), "t")
    anchors = _segments(spark, d).groupBy("video_id").agg(F.min("t").alias("anchor_t"))
    return te.union_all(*[te.temporal_slice(frames, part, 0.25, anchors).withColumn("part", F.lit(part)) for part in ("first", "last", "after")])


STEPS = ["view", "click", "purchase"]
GAP = 43_200.0


@query(
    "sequences",
    f"""WITH h AS (SELECT CAST(user_id AS VARCHAR) AS video_id, event_type, epoch_us(ts) AS at, event_id, value / 500 AS score FROM events),
c AS (SELECT a.video_id, a.score + b.score + p.score AS total, [a.event_id, b.event_id, p.event_id] AS chain FROM h a
  JOIN h b ON b.video_id = a.video_id AND b.event_type = 'click' AND b.at > a.at AND b.at - a.at <= {int(GAP * 1e6)}
  JOIN h p ON p.video_id = a.video_id AND p.event_type = 'purchase' AND p.at > b.at AND p.at - b.at <= {int(GAP * 1e6)} WHERE a.event_type = 'view')
SELECT video_id, round(max(total), 6) AS total FROM c GROUP BY video_id""",
)
def sequences(spark, d):
    steps = table(spark, d, "events").select(F.col("event_id").alias("frame_id"), F.col("event_type").alias("step"))
    hits = events(spark, d).select("video_id", "t", F.col("ord").alias("frame_id"), "score").join(steps, "frame_id")
    return te.sequences(hits, STEPS, GAP).select("video_id", F.round("total", 6).alias("total"))


#: (query, step, event type, gap): queries of one to four sub-events.
SUB_EVENTS = [
    (1, 1, "view", None), (1, 2, "click", 43_200.0), (1, 3, "purchase", 43_200.0), (2, 1, "view", None), (2, 2, "purchase", 86_400.0), (3, 1, "signup", None), (3, 2, "view", 172_800.0),
    (3, 3, "click", 86_400.0), (3, 4, "purchase", 259_200.0), (4, 1, "error", None), (5, 1, "signup", None), (5, 2, "error", None),
]
_SUB = ", ".join(f"({q}, {s}, '{e}', {'NULL' if g is None else int(g * 1e6)})" for q, s, e, g in SUB_EVENTS)


@query(
    "query_sequences",
    f"""WITH RECURSIVE sub(query_id, step, event_type, gap) AS (SELECT * FROM (VALUES {_SUB}) s(a, b, c, d)),
h AS (SELECT query_id, step, CAST(user_id AS VARCHAR) AS video_id, epoch_us(ts) AS us, gap, value / 500 AS score FROM events JOIN sub USING (event_type)),
c AS (
  SELECT query_id, video_id, step, us, max(score) AS total FROM h WHERE step = 1 GROUP BY ALL
  UNION ALL SELECT h.query_id, h.video_id, h.step, h.us, max(c.total + h.score) FROM c JOIN h ON h.query_id = c.query_id AND h.video_id = c.video_id AND h.step = c.step + 1
    AND h.us > c.us AND (h.gap IS NULL OR h.us - c.us <= h.gap) GROUP BY ALL
), n AS (SELECT query_id, max(step) AS step FROM sub GROUP BY query_id)
SELECT CAST(query_id AS BIGINT) AS query_id, video_id, round(max(total), 6) AS total FROM c JOIN n USING (query_id, step) GROUP BY query_id, video_id""",
)
def query_sequences(spark, d):
    steps = spark.createDataFrame(SUB_EVENTS, "query_id long, step int, event_type string, gap double")
    kinds = table(spark, d, "events").select(F.col("event_id").alias("frame_id"), "event_type")
    found = events(spark, d).select("video_id", "t", F.col("ord").alias("frame_id"), "score").join(kinds, "frame_id")
    hits = found.join(steps.select("query_id", "step", "event_type"), "event_type")
    return te.query_sequences(hits, steps).select("query_id", "video_id", F.round("total", 6).alias("total"))


def _signals(spark, d):
    """Hit lists of three indexes over one query set: texts, vectors like the query's own,
    and the nearness of either kind of hit to moments of the query. An event is the frame of
    the document and of the vector of its id."""
    text = _hits(spark, d)
    vectors = _vectors(spark, d).select("item_id", "vec")
    asked = _queries(spark, d).select("query_id").distinct().join(vectors.withColumnRenamed("item_id", "query_id"), "query_id")
    like = se.vector_top_k(vectors, asked, 10).drop("rank")
    frames = events(spark, d).select(F.col("ord").alias("item_id"), "video_id", "t")
    moments = events(spark, d).filter("source = 'seed'").select((F.col("ord") % 20).alias("m"), "video_id", "t")
    anchors = _queries(spark, d).select("query_id", (F.col("query_id") % 20).alias("m")).join(moments, "m")
    both = text.select("query_id", "item_id").unionByName(like.select("query_id", "item_id"))
    return se.fan_out(text=text, vector=like, time=te.temporal_proximity(both, frames, anchors, 3600.0))


_ASKED = SIM.replace("q.vec_id % 50 = 0", "q.vec_id IN (SELECT item_id FROM benchmark)")
SIGNALS = f"""{EXACT}, {EV}, {_ASKED}, near AS ({TOP.format('s')} QUALIFY rank <= 10), either AS (SELECT query_id, item_id FROM hit UNION SELECT query_id, item_id FROM near),
dist AS (
  SELECT query_id, item_id, 1 / (1 + min(abs(a.t - f.t)) / 3600) AS score FROM either JOIN ev f ON f.ord = item_id
  JOIN ev a ON a.source = 'seed' AND a.video_id = f.video_id AND a.ord % 20 = query_id % 20 GROUP BY query_id, item_id
), l AS (
  SELECT query_id, item_id, CAST(score AS DOUBLE) AS score, 'text' AS signal FROM hit UNION ALL SELECT query_id, item_id, score, 'vector' FROM near UNION ALL SELECT query_id, item_id, score, 'time' FROM dist
), n AS (
  SELECT query_id, item_id, signal, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS score
  FROM l WINDOW w AS (PARTITION BY query_id, signal)
), fan AS (
  SELECT query_id, item_id, max(score) FILTER (WHERE signal = 'text') AS text, max(score) FILTER (WHERE signal = 'vector') AS vector, max(score) FILTER (WHERE signal = 'time') AS time FROM n GROUP BY query_id, item_id
)"""


@query("signal_fusion", f"WITH {SIGNALS} SELECT query_id, item_id, round(text, 4) AS text, round(vector, 4) AS vector, round(time, 4) AS time FROM fan")
def signal_fusion(spark, d):
    return _signals(spark, d).select("query_id", "item_id", *[F.round(c, 4).alias(c) for c in ("text", "vector", "time")])


@query(
    "signal_rerank",
    f"""WITH {SIGNALS}, w AS (SELECT query_id, item_id, round(coalesce(text, 0) * 0.5 + coalesce(vector, 0) * 0.3 + coalesce(time, 0) * 0.2, 9) AS score FROM fan)
SELECT query_id, item_id, rank, round(score, 4) AS score FROM ({TOP.format('w')}) WHERE rank <= 5""",
)
def signal_rerank(spark, d):
    ranked = se.weighted_rerank(_signals(spark, d), {"text": 0.5, "vector": 0.3, "time": 0.2}, 5)
    return ranked.select("query_id", "item_id", "rank", F.round("score", 4).alias("score"))


@query("object_counts", "SELECT event_id // 10 AS frame_id, event_type AS label, count(*) AS n FROM events GROUP BY ALL")
def object_counts(spark, d):
    rows = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 10).alias("frame_id"))
    return co.object_counts(rows.agg(F.collect_list(F.struct(F.col("event_type").alias("label"), (F.col("value") / 500).alias("score"))).alias("detected_objects")))


@query(
    "keyframe_index",
    f"""WITH {EV}, f AS (SELECT video_id, ord AS frame_id, t FROM ev WHERE source = 'scene')
SELECT f.video_id, f.frame_id, f.t, md5(d.text) AS ocr, e.label AS color, c.n AS n_turns FROM f LEFT JOIN documents d ON d.doc_id = f.frame_id LEFT JOIN embeddings e ON e.vec_id = f.frame_id
LEFT JOIN (SELECT CAST(conv_id AS VARCHAR) AS video_id, count(*) AS n FROM conversations GROUP BY conv_id) c ON c.video_id = f.video_id""",
)
def keyframe_index(spark, d):
    frames = events(spark, d).filter("source = 'scene'").select("video_id", F.col("ord").alias("frame_id"), "t")
    ocr = table(spark, d, "documents").select(F.col("doc_id").alias("frame_id"), F.md5("text").alias("ocr"))
    colors = table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("label").alias("color"))
    turns = table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("video_id")).agg(F.count(F.lit(1)).alias("n_turns"))
    return co.keyframe_index(frames, turns, ocr=ocr, colors=colors)


@contextmanager
def _index(spark, d):
    """The whole keyframe index of the scene events: an event's document, vector, colour and
    ten further events as objects; the turns of a conversation are its video's transcript."""
    frames = events(spark, d).filter("source = 'scene'")
    store = KeyframeStore(spark, new_path(spark, "keyframe-index"))
    try:
        path = F.concat(F.lit("/out/keyframes/"), "video_id", F.lit("/"), keyframe_id(F.col("video_id"), F.col("t")), F.lit(".jpg"))
        store.put("keyframes", frames.select(F.col("ord").alias("frame_id"), "video_id", millis(F.col("t")).alias("timestamp_ms"), path.alias("keyframe_path")))
        vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("embedding").alias("clip_embedding"), F.array(F.concat(F.lit("c"), F.col("label").cast("string"))).alias("dominant_colors"))
        store.put("embeddings", vectors)
        store.put("colors", vectors)
        store.put("texts", table(spark, d, "documents").select(F.col("doc_id").alias("frame_id"), F.col("text").alias("ocr_text")))
        one = F.struct(F.col("event_type").alias("label"), (F.col("value") / 500).alias("score"))
        store.put("objects", table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 10).alias("frame_id")).agg(F.collect_list(one).alias("detected_objects")))
        talk = table(spark, d, "conversations")
        segments = talk.select(F.col("conv_id").cast("string").alias("video_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("segment_id"), (F.col("turn") * 21_600).cast("double").alias("t"), "text")
        store.put_speech(frames.select("video_id", F.col("ord").alias("frame_id"), "t"), segments)
        about = talk.groupBy(F.col("conv_id").cast("string").alias("video_id")).agg(F.concat(F.lit("turns:"), F.count(F.lit(1)).cast("string")).alias("source_metadata_ref"))
        store.put("metadata", frames.select("video_id", F.col("ord").alias("frame_id")).join(about, "video_id"))
        yield store
    finally:
        store.drop()


INDEX = f"""{EV}, seg AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, conv_id * 1000 + turn AS segment_id, CAST(turn * 21600 AS DOUBLE) AS st, text AS asr_text FROM conversations),
asr AS (
  SELECT ord AS frame_id, segment_id, asr_text FROM ev JOIN seg USING (video_id) WHERE source = 'scene'
  QUALIFY row_number() OVER (PARTITION BY ord ORDER BY abs(st - t), st, segment_id) = 1
), obj AS (
  SELECT frame_id, string_agg(label || ' x ' || n, ', ' ORDER BY label) AS objects FROM (SELECT event_id // 10 AS frame_id, event_type AS label, CAST(count(*) AS VARCHAR) AS n FROM events GROUP BY ALL) GROUP BY frame_id
), meta AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, 'turns:' || count(*) AS ref FROM conversations GROUP BY conv_id),
ix AS (
  SELECT ev.ord AS frame_id, ev.video_id, CAST(round_even(ev.t * 1000, 0) AS BIGINT) AS timestamp_ms, '/out/keyframes/' || ev.video_id || '/' || {KID.replace('video_id', 'ev.video_id').replace('t * 1000', 'ev.t * 1000')} || '.jpg' AS keyframe_path,
    e.embedding, d.text, CASE WHEN e.vec_id IS NOT NULL THEN 'c' || e.label END AS color, coalesce(obj.objects, '') AS objects, asr.segment_id, asr.asr_text, meta.ref
  FROM ev LEFT JOIN embeddings e ON e.vec_id = ev.ord LEFT JOIN documents d ON d.doc_id = ev.ord LEFT JOIN obj ON obj.frame_id = ev.ord LEFT JOIN asr ON asr.frame_id = ev.ord LEFT JOIN meta ON meta.video_id = ev.video_id
  WHERE ev.source = 'scene'
)"""


@query(
    "keyframe_index_whole",
    f"""WITH {INDEX} SELECT frame_id, video_id, timestamp_ms, keyframe_path, len(embedding) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first_component, md5(text) AS ocr, color,
  objects, segment_id AS asr_window_id, md5(asr_text) AS asr, ref AS source_metadata_ref FROM ix""",
)
def keyframe_index_whole(spark, d):
    with _index(spark, d) as store, scratch(spark):
        rows = store.index()
        told = co.hit_evidence(rows.select(F.lit(0).alias("query_id"), F.col("frame_id").alias("item_id"), F.lit(1).alias("rank")), rows, 1).select(F.col("item_id").alias("frame_id"), "objects")
        size = F.when(F.col("clip_embedding").isNotNull(), F.size("clip_embedding").cast("long")).alias("dims")
        out = rows.join(told, "frame_id").select(
            "frame_id", "video_id", "timestamp_ms", "keyframe_path", size, F.round(F.col("clip_embedding")[0].cast("double"), 6).alias("first_component"), F.md5("ocr_text").alias("ocr"),
            F.col("dominant_colors")[0].alias("color"), "objects", "asr_window_id", F.md5("asr_text").alias("asr"), "source_metadata_ref",
        )
        return kept(out, "index")


#: For every question the scene events nearest to its own number, three of them.
NEAREST = "SELECT item_id AS query_id, ord AS item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY abs(ord - item_id), ord) AS INTEGER) AS rank FROM benchmark JOIN ev ON source = 'scene' AND abs(ord - item_id) <= 20"


@query(
    "question_evidence",
    f"""WITH {INDEX}, hits AS ({NEAREST} QUALIFY rank <= 3),
e AS (SELECT query_id, rank, concat(coalesce(text, ''), chr(10), coalesce(objects, ''), chr(10), coalesce(asr_text, '')) AS told FROM hits LEFT JOIN ix ON frame_id = item_id)
SELECT query_id, CAST(count(*) AS INTEGER) AS n_hits, md5(string_agg(told, chr(10) ORDER BY rank)) AS evidence FROM e GROUP BY query_id""",
)
def question_evidence(spark, d):
    asked = _queries(spark, d).select("query_id", F.explode(F.sequence(F.col("query_id") - 20, F.col("query_id") + 20)).alias("item_id"))
    frames = events(spark, d).filter("source = 'scene'").select(F.col("ord").alias("item_id"))
    hits = asked.join(frames, "item_id").withColumn("score", -F.abs(F.col("item_id") - F.col("query_id")).cast("double"))
    with _index(spark, d) as store, scratch(spark):
        return kept(co.question_evidence(co.hit_evidence(se.top_k(hits, 3), store.index(), 3)).withColumn("evidence", F.md5("evidence")), "evidence")


@query(
    "corpus_profile",
    f"""WITH {EV}, v AS (SELECT video_id, CAST(video_ord % 5 AS VARCHAR) AS topic, max(t) AS duration, count(*) FILTER (WHERE source = 'scene') AS keyframes, count(*) AS frames FROM ev GROUP BY ALL)
SELECT topic, count(*) AS videos, round(sum(duration) / 3600, 4) AS hours, min(duration) AS shortest, max(duration) AS longest, round(1 - sum(keyframes) / sum(frames), 6) AS reduction FROM v GROUP BY ROLLUP (topic)""",
)
def corpus_profile(spark, d):
    v = events(spark, d).groupBy("video_id", (F.col("video_ord") % 5).cast("string").alias("topic")).agg(
        F.max("t").alias("duration"), F.count(F.when(F.col("source") == "scene", 1)).alias("keyframes"), F.count(F.lit(1)).alias("frames")
    )
    out = co.corpus_profile(v)
    return out.withColumn("hours", F.round("hours", 4)).withColumn("reduction", F.round("reduction", 6))


@query("exact_groups", f"WITH n AS (SELECT doc_id AS item_id, array_to_string({TERMS.format('text')}, ' ') AS k FROM documents) SELECT item_id, min(item_id) OVER (PARTITION BY k) AS group_id FROM n")
def exact_groups(spark, d):
    return co.exact_groups(_items(spark, d))


@query("duplicate_groups", None)
def duplicate_groups(spark, d):
    return co.duplicate_groups(_items(spark, d))
