"""The stages of the pipeline: odd rows, empty tables, clashing columns, and what they catch."""

import itertools
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stillpoint.llm import jaccard, toxicity

SF = "/root/testdata/sf0.01"


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()) + rng.choice(["", "s", "ed"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, repeats and extra columns whose names clash, and labels."""
    rng, rows = random.Random(3), []
    lines = [prose(rng, 12) for _ in range(30)]
    for i in range(40):
        rows.append((i, "\n".join(prose(rng, 12) for _ in range(6))))
    rows += [(100 + i, "\n".join([*lines[:10], prose(rng, 3)])) for i in range(4)]  # near copies that share their lines
    rows += [(None, None), (None, ""), (None, rows[0][1]), (200, "twice\nthe same"), (200, "twice\nthe same"), (201, None), (202, ""), (203, " \n "), (204, "\u6f22\u5b57"), (205, "\n".join(lines * 40))]
    path = str(tmp_path_factory.mktemp("pipeline"))
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", "k", 1, 2, "w", "h") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, did long, rid long, whole_text string, _id string")
    df.write.parquet(f"{path}/documents.parquet")
    df.filter("doc_id < 40").select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic")).write.parquet(f"{path}/labels.parquet")
    return path


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]


def test_stages_on_odd_rows_and_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        none = stage(spark, docs.filter("false"), folder)
        assert none.count() == 0 and none.columns == out.columns
        rows = out.collect()
        if name == "best_fit_packing":
            assert len({(r.doc_id, r.ids_crc32) for r in rows if r.piece == 0}) == docs.select("doc_id", F.coalesce("text", F.lit(""))).distinct().count()
            continue
        assert out.columns == docs.columns and {(r.row, r.kept, r.did, r.whole_text, r._id) for r in rows} <= {("r", "k", 1, "w", "h")}
        if name in ("line_dedup", "suffix_array_dedup"):
            assert len(rows) == docs.count() and all(r.n_chars == len(r.text) for r in rows)
        if name == "ngram_jaccard_join":
            ids = [r.doc_id for r in rows]
            assert ids.count(100) == 1 and not {101, 102, 103} & set(ids) and ids.count(200) == 1
            assert {201, 202, 203, 204} <= set(ids) and ids.count(None) == 2  # texts without words stay; a copy of document 0 doesn't


def test_near_copies_are_judged_before_their_lines_went(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = corpus_pipeline.line_filter(spark, docs, folder)
    ids = [r.doc_id for r in corpus_pipeline.near_duplicate_filter(spark, left, folder).collect()]
    assert 100 in ids and not {101, 102, 103} & set(ids)


def test_what_the_line_stage_leaves_is_compared_too(spark, tmp_path):
    """Two documents whose lines but one are those of others, and that line near copies: by
    the texts they came with they are unlike."""
    rng = random.Random(5)
    one, two = ("\n".join(prose(rng, 12) for _ in range(12)) for _ in range(2))
    rest = prose(rng, 60)
    rows = [(1, one), (2, two), (3, f"{one}\n{rest}"), (4, f"{rest} alpha\n{two}"), (5, prose(rng, 60)), (6, f"{two}\n{prose(rng, 60)}")]
    path = str(tmp_path)
    spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long").write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_filter(spark, docs, path).collect()} == {1, 2, 3, 4, 5, 6}
    left = corpus_pipeline.line_filter(spark, docs, path)
    assert {r.doc_id: r.text for r in left.collect()}[4] == f"{rest} alpha"
    kept = {r.doc_id: r.text for r in corpus_pipeline.near_duplicate_filter(spark, left, path).collect()}
    assert set(kept) == {1, 2, 3, 5, 6} and kept[3] == rest


def test_toxic_rows_go_by_their_text(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    keep = {(r.did, r.predicted) for r in toxicity.score_toxicity(docs, model).collect()}
    kept = toxicity.drop_toxic(docs, model).select("doc_id").collect()
    for i in range(40):
        assert ((i, 0) in keep) == any(r.doc_id == i for r in kept)


def test_near_copies_of_the_tables_go(spark):
    """Of the redundant documents by brute force among those that pass the toxicity stage, nine
    in ten and more are gone after the near-duplicate stage, and no others but copies of what
    lines are left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = corpus_pipeline.toxicity_filter(spark, docs, SF)
    rows = [(r.doc_id, r.text or "") for r in clean.select("doc_id", "text").collect()]
    sets = [set(jaccard.shingles(t, 5).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y) - 1e-9:
            low, high = sorted((group[a], group[b]), key=lambda g: rows[g][0])
            group = [low if g == high else g for g in group]
    redundant = {rows[k][0] for k, g in enumerate(group) if g != k}
    left = corpus_pipeline.line_filter(spark, clean, SF)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_filter(spark, left, SF).select("doc_id").collect()}
    gone = {i for i, _ in rows} - kept
    assert len(redundant) > 50 and len(redundant & gone) >= 0.9 * len(redundant)
    lines = {r.doc_id: r.text for r in left.select("doc_id", "text").collect()}
    for i in gone - redundant:
        own = set(jaccard.shingles(lines[i], 5).tolist())
        others = (set(jaccard.shingles(lines[j], 5).tolist()) for j in kept if j < i)
        assert any(own and len(own & o) >= 0.8 * len(own | o) - 1e-9 for o in others)


def test_pipeline_on_tables(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100
    assert {r.total for r in out.groupBy("sequence_id").agg(F.sum("length").alias("total"), F.max(F.col("offset") + F.col("length")).alias("end")).filter("total <> end or total > 2048").collect()} == set()


def test_batches_of_long_rows_end_by_bytes(spark, folder):
    """Rows of 100 kB: a stage leaves a session in which a thousand of them are not one batch."""

    def nbytes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["n"])

    before = spark.conf.get(key := "spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        corpus_pipeline.pack(spark, spark.createDataFrame([], "doc_id long, text string"), folder)
        sizes = spark.range(100).coalesce(1).select(F.repeat(F.lit("x"), 100_000).alias("t")).mapInArrow(nbytes, "n long").toPandas()["n"]
        assert sizes.max() <= (corpus_pipeline.BATCH_MB << 20) + 200_000 and sizes.sum() >= 100 * 100_000
    finally:
        spark.conf.set(key, before)


FREED = """
import re
import pyarrow as pa
from stillpoint.functions.tables import returning

def anonymous():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def helper():
    held = [bytearray(100_000) for _ in range(2000)]
    last.append(bytearray(100_000))  # what lies above keeps the heap from shrinking by itself
    yield pa.record_batch([pa.array([len(held)])], names=["n"])

last, before = [], anonymous()
print(sum(b.column("n")[0].as_py() for b in returning(helper())), anonymous() - before)
"""


def test_a_task_gives_back_what_it_freed():
    """200 MB in pieces that the allocator would hold on to."""
    out = subprocess.run([sys.executable, "-c", FREED], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    rows, left = out.stdout.split()
    assert int(rows) == 2000 and float(left) < 100


def test_near_duplicates_write_no_whole_rows(spark, folder, monkeypatch):
    """Only rows that their id doesn't tell are written as a whole for the search, and an id that
    looks like a row's number is no number."""
    from stillpoint.functions import tables

    odd = corpus_pipeline.FAR
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    source = docs.unionByName(docs.filter("doc_id in (7, 8)").withColumn("doc_id", F.col("doc_id") - 7 + odd))
    path = f"{folder}/far"
    source.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    source = spark.read.parquet(f"{path}/documents.parquet")
    wrote, real = {}, tables._write

    def counted(df, tag, scope):
        out = real(df, tag, scope)
        if "row" in df.columns:
            wrote[tag] = out.count()
        return out

    monkeypatch.setattr(tables, "_write", counted)
    ids = [r.doc_id for r in corpus_pipeline.near_duplicate_filter(spark, source, path).collect()]
    assert sum(wrote.values()) <= source.groupBy("doc_id").count().filter(f"count > 1 or doc_id is null or doc_id >= {odd}").agg(F.sum("count")).first()[0]
    assert {7, 8} <= set(ids) and not {odd, odd + 1} & set(ids) and ids.count(100) == 1 and ids.count(200) == 1
