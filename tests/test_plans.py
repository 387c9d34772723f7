"""Plans: what is shuffled, what is pushed, where Python runs."""

from docketlake.operators import dedup as D
from docketlake.operators import search as S
from docketlake.operators.extraction import extract_tier_a
from docketlake.operators.segmentation import chunks
from docketlake.workload import extraction, relational, search
from docketlake.workload.tables import table
from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_work_needs_no_shuffle_and_no_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for df in (extract_tier_a(docs), chunks(docs), S.with_sparse(docs)):
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text


def test_search_is_a_scan_and_a_bounded_top(spark, sf_dir):
    docs = S.with_sparse(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text = plan(S.search_sparse(docs, "the others", 10, key="doc_id"))
    assert "TakeOrderedAndProject" in text and "Join" not in text
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    text = plan(S.search_dense(vectors, [0.1] * 64, 10, key="vec_id", vector="embedding"))
    assert "TakeOrderedAndProject" in text and "Join" not in text


def test_first_wins_drops_losers_before_the_shuffle(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    text = plan(D.first_per_group(orders, ["o_custkey"], ["o_orderkey"]))
    assert text.count("WindowGroupLimit") == 2 and ", Partial" in text


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    text = plan(S.search_dense(vectors, [0.1] * 64, 5, S.build_filter(vectors, label=[1, 2]), key="vec_id", vector="embedding"))
    assert "PushedFilters: [In(label, [1,2])]" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan(relational.limit_rows(spark, sf_dir))


def test_named_fields_drop_the_work_for_others(spark, sf_dir):
    text = plan(extract_tier_a(table(spark, sf_dir, "documents", "text"), fields=("fine_amount_pkr",)))
    assert "fine" in text and "Police" not in text


def test_salted_lookup_equals_the_plain_one(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_custkey") % 3).alias("k"))
    known = spark.createDataFrame([(0,), (0,), (2,), (None,)], "k long")
    plain = D.flag_known(orders, known, "k", "seen").orderBy("o_orderkey").collect()
    assert plain == D.flag_known(orders, known, "k", "seen", spread=4).orderBy("o_orderkey").collect()
    assert {r.seen for r in plain} == {True, False} and len(plain) == 1500


def test_no_query_joins_without_keys(spark, sf_dir):
    for module in (search, relational, extraction):
        for name, run in module.QUERIES.items():
            text = plan(run(spark, sf_dir))
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
