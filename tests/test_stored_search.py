"""Stored postings, two-pass vectors and tables of queries against full scans."""

import random
import re

import numpy as np
import pytest

from docketlake.operators import batch_search as B
from docketlake.operators import postings as X
from docketlake.operators import quantized as Q
from docketlake.operators import search as S
from test_collection import scanned


def texts(n=600, seed=1):
    r = random.Random(seed)
    words = ["the", "court", "appeal", "bail", "murder", "section 302", "pld 2019", "order", "law", "judge"] + [f"{a}{b}x" for a in "abcdefgh" for b in "qrst"]
    weights = [200, 80, 40, 20, 10, 8, 8, 60, 30, 30] + [1] * 32
    return [(i, None if i % 97 == 0 else " ".join(r.choices(words, weights, k=r.choice([3, 10, 40, 300]))), "en" if i % 3 else None) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    frame = S.with_sparse(spark.createDataFrame(texts(), "doc_id long, text string, lang string").repartition(4))
    path = str(tmp_path_factory.mktemp("index") / "x")
    X.build(frame, path, "doc_id", carried=["lang"], segment=16)
    return frame, path


@pytest.mark.parametrize("query", ["the appeal", "section 302 of the pld 2019", "aqx brx", "murder", "bail bail order", "nothing known here", "", "ab 12"])
@pytest.mark.parametrize("lang", [None, "en"])
def test_postings_find_what_a_scan_finds(spark, docs, query, lang):
    frame, path = docs
    where = (lambda rows: S.build_filter(rows, lang=lang)) if lang else None
    want = S.search_sparse(frame, query, 7, where(frame) if where else None, key="doc_id").select("doc_id", "score").collect()
    assert list(map(tuple, X.search(spark, path, query, 7, "doc_id", where).collect())) == list(map(tuple, want))


def test_segments_below_the_kth_score_are_not_read(spark, docs):
    frame, path = docs
    wanted = X.query_terms(spark, "the court")
    first, rest = X.open_segments(spark, path, wanted, "doc_id", 5)
    whole = X.segment_bounds(spark, path, wanted).count()
    assert len(first) == X.PROBED and whole > 30 and rest.count() < whole / 4


def test_only_rows_of_the_query_terms_are_read(spark, docs):
    path = docs[1]
    found = X.search(spark, path, "brx", 5, "doc_id")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    total = spark.read.parquet(f"{path}/postings").count()
    assert re.search(r"PartitionFilters: \[[^\]]*folder", plan) and re.search(r"PushedFilters: \[[^\]]*idx", plan) and "regexp" not in plan
    assert scanned(found) < total / 4


def test_an_index_of_nothing(spark, tmp_path):
    frame = S.with_sparse(spark.createDataFrame([(1, None), (2, "12")], "doc_id long, text string"))
    X.build(frame, str(tmp_path / "x"), "doc_id")
    assert X.search(spark, str(tmp_path / "x"), "the court", 5, "doc_id").count() == 0


def vectors(n=700, dims=24, seed=3):
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in r.normal(size=dims) * (1 if i % 5 else 100)], i % 4) for i in range(n)]
    rows += [(n + i, rows[5][1], 9) for i in range(20)] + [(n + 50, None, 1), (n + 51, [1.0] * 3, 1), (n + 52, [0.0] * dims, 1), (n + 53, [float("nan")] * dims, 1)]
    return rows


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    frame = spark.createDataFrame(vectors(), "vec_id long, dense array<float>, label int")
    path = str(tmp_path_factory.mktemp("vectors") / "v")
    Q.build(frame, path, "vec_id", "dense", ["label"])
    return frame, path


@pytest.mark.parametrize("at,limit,label", [(0, 10, None), (5, 8, None), (5, 30, None), (17, 10, 3), (3, 5000, None)])
def test_two_passes_find_what_a_scan_finds(spark, stored, at, limit, label):
    frame, path = stored
    query = list(frame.filter(f"vec_id = {at}").first()["dense"])
    where = (lambda rows: S.build_filter(rows, label=label)) if label else None
    usable = frame.filter("vec_id != 753")  # a vector of NaN has no one-byte form
    want = S.search_dense(usable, query, limit, where(usable) if where else None, key="vec_id").select("vec_id", "score").collect()
    found = Q.search(spark, path, query, limit, "vec_id", where=where).select("vec_id", "score").collect()
    assert list(map(tuple, found)) == list(map(tuple, want))


def test_the_second_pass_is_short(spark, stored):
    frame, path = stored
    query = list(frame.filter("vec_id = 9").first()["dense"])
    assert Q.candidates(spark, path, query, "vec_id", 10).count() < 60
    plan = spark.read.parquet(path).select("vec_id", Q.bounds(spark.read.parquet(path)["small"], query).alias("b"))._jdf.queryExecution().executedPlan().toString()
    assert "dense" not in plan


def test_zero_vectors_and_thresholds(spark, stored):
    frame, path = stored
    query = list(frame.filter("vec_id = 5").first()["dense"])
    found = Q.search(spark, path, query, 40, "vec_id", score_threshold=0.999999)
    assert sorted(r.vec_id for r in found.collect()) == [5, *range(700, 720)]


@pytest.mark.parametrize("limit,block", [(3, 512), (10, 4)])
def test_batches_equal_single_searches(spark, monkeypatch, limit, block):
    monkeypatch.setattr(B, "QUERY_BLOCK", block)
    monkeypatch.setattr(B, "PENDING", 50)
    rows, dense = texts(150, 7), {i: v for i, v, _ in vectors(200)}
    points = spark.createDataFrame([(i, t, dense[i] if i % 4 else None) for i, t, _ in rows], "doc_id long, text string, dense array<float>").repartition(3)
    points = S.with_sparse(points)
    asked = [(10, "the appeal", dense[3]), (11, "murder law", None), (12, None, dense[8]), (13, "", [1.0, 2.0]), (None, "bail order", dense[60]), (15, "aqx", dense[9])]
    queries = S.with_sparse(spark.createDataFrame(asked, "qid long, text string, dense array<float>"))
    found = {}
    for r in B.hybrid_batch(points, queries, "qid", limit, "doc_id").collect():
        found.setdefault(r.qid, []).append((r["rank"], r.doc_id, round(r.score, 9)))
    for q, text, vector in asked:
        fit = vector if vector and len(vector) == 24 else None
        legs = [S.search_dense(points, fit, 20, key="doc_id")] if fit else []
        legs.append(S.search_sparse(points, text or "", 20, key="doc_id"))
        want = [(i + 1, r.doc_id, round(r.score, 9)) for i, r in enumerate(S.fuse([leg.select("doc_id", "score") for leg in legs], "doc_id", limit).collect())]
        assert sorted(found.get(q, [])) == want


def test_batches_of_nothing(spark):
    points = spark.createDataFrame([], "doc_id string, dense array<float>, sparse struct<indices:array<bigint>,values:array<double>>")
    queries = spark.createDataFrame([], "qid long, dense array<float>, sparse struct<indices:array<bigint>,values:array<double>>")
    assert B.hybrid_batch(points, queries, "qid", 3, "doc_id").count() == 0


def test_text_keys(spark):
    points = spark.createDataFrame([(f"k{i % 7}{i}", [float(i % 5), 1.0]) for i in range(40)], "point_uuid string, dense array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, dense array<double>")
    want = [r.point_uuid for r in S.search_dense(points, [1.0, 0.0], 9).collect()]
    assert [r.point_uuid for r in B.dense_batch(points, queries, "qid", 9).orderBy("rank").collect()] == want
