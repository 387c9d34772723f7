"""Fences come from the sketches: they follow each source's distribution, without floors or size switches."""

import duckdb
import pytest
from pyspark.sql import functions as F

from docketlake.llm import quality_rules as Q


def text(words, symbols=0, length=5):
    return " ".join("abcdefghijklmnop"[i % 9:][:length] + f"{i}"[-1] for i in range(words)) + " |" * symbols


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def two_sources(shift=0):
    """One source of plain prose and one whose texts hold a symbol per about ten words, and the same text in both."""
    rows = [(i, text(80 + i % 7), "en", "plain") for i in range(1200)]
    rows += [(2000 + i, text(80, 8 + i % 5 + shift), "en", "tables") for i in range(1200)]
    return rows + [(5000, text(80, 9), "en", "plain"), (5001, text(80, 9), "en", "tables")]


def verdicts(spark, rows):
    measures = Q.measured(documents(spark, rows)).drop("text")
    fences = {r["source"]: r.asDict() for r in Q.limits(measures).collect()}
    return fences, {r["doc_id"]: r for r in Q.with_verdict(measures).select("doc_id", "kept", "reasons").collect()}


def test_sources_have_fences_of_their_own(spark):
    fences, found = verdicts(spark, two_sources())
    assert fences["plain"]["fence_symbol_rate"] < fences["tables"]["fence_symbol_rate"]
    assert not found[5000]["kept"] and found[5000]["reasons"] == ["symbol_rate"] and found[5001]["kept"]


def test_a_distribution_that_moves_takes_its_fence_along(spark):
    near, far = (verdicts(spark, two_sources(shift))[0] for shift in (0, 20))
    assert far["tables"]["fence_symbol_rate"] > near["tables"]["fence_symbol_rate"] > 0
    assert far["plain"]["fence_symbol_rate"] == near["plain"]["fence_symbol_rate"]


def test_weight_grows_smoothly_with_size(spark):
    """A source's fence moves from its language's to its own as it grows; no row count switches it."""
    seen = []
    for size in (1, 20, 60, 150, 199, 200, 201, 600, 2400):
        rows = [(i, text(80, 6), "en", "big") for i in range(3000)] + [(9000 + i, text(80, 20), "en", "small") for i in range(size)]
        measures = documents(spark, rows).select("lang", "source", F.struct(
            F.lit(100).alias("n_words"), F.lit(0).alias("n_repeat_words"), *[F.when(F.col("source") == "small", 2000 + F.col("doc_id") % 7).otherwise(600 + F.col("doc_id") % 5).cast("bigint").alias(m) for m in Q.METRICS]).alias("m"))
        seen.append({r["source"]: r["fence_word_length"] for r in Q.limits(measures).collect()}["small"])
    assert seen[0] < 1000 and seen[-1] > 1900 and len(set(seen[4:7])) == 1


def test_sketches_merge_by_adding(spark):
    measures = Q.measured(documents(spark, two_sources())).drop("text")
    halves = [Q.sketches(measures.filter(f"doc_id % 2 = {i}"), ["lang", "source"]) for i in (0, 1)]
    both = Q.merged(halves[0].unionByName(halves[1]), ["lang", "source"])
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, Q.sketches(measures, ["lang", "source"]).collect()))


def test_clean_documents_of_the_given_tables_stay(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = Q.op2_quality_rules(spark, folder).join(labels, "doc_id").filter("NOT base_failed AND quality IS NOT NULL").collect()
    good, bad = ([r["kept"] for r in found if r["quality"] == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.97 and bad and sum(bad) / len(bad) < 0.1


@pytest.mark.parametrize("rows", [two_sources()[::7], []])
def test_sql_has_the_same_fences(spark, tmp_path, rows):
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    answer, got = base.sql(Q.RULES_SQL), Q.op2_quality_rules(spark, str(tmp_path))
    assert sorted(answer.fetchall(), key=repr) == sorted(map(tuple, got.select(*answer.columns).collect()), key=repr)
