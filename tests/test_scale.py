"""Work per row and per task: searches behind plain words, tasks dealt by rows, expressions computed once."""

import glob
import re

import pytest
from pyspark.sql import functions as F

from docketlake.functions import citations as C
from docketlake.functions import courts as K
from docketlake.functions import dates as D
from docketlake.functions import people as P
from docketlake.functions import sections as S
from docketlake.functions import text as T
from docketlake.operators import collection as L
from docketlake.operators import extraction as X
from docketlake.workload import extraction as E
from docketlake.workload import judgments as J

ODD = [
    "IN THE SUPREME COURT OF PAKİSTAN\nArtıcle 10-A of the Conſtitution, fır no. 7/2001",
    "Lahore High Court. Offence of Zina Ordinance, 1979 Anti-Terrorism Act 1997 x Rules,2001 9 of Order 5555",
    "a b c d e f g Act 19991 h Act, 2001; The Act 1999, and so-called Rules. 1988 and the Act\n2004",
    "Section 302 P.PC u/s 34 PPC, under section 9 of the P.P.C; 5 pp.c", "", "12 March 2001 March 5, 2002May 6 2003 ab 7 2004", None,
]


def lists(spark, *columns):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id int, text string")
    return [tuple(row)[1:] for row in frame.select("id", *columns).orderBy("id").collect()]


def test_fold_keeps_positions_and_case_pairs(spark):
    texts = [row[0] for row in lists(spark, T.fold(F.col("text")))]
    assert [t and len(t) for t in texts] == [t and len(t) for t in ODD]
    assert "pakistan" in texts[0] and "constitution" in texts[0]


def test_words_and_openings_are_those_of_every_match():
    assert T.required_words(X.INDICATORS["weapon_recovered"])[-1] == ("recovered",)
    assert T.required_words(r"a?b(?:cd|e)*") == ()
    assert re.fullmatch(T.opening(r"(?:the\s+)?(?:ab|cd)") + "..", "cb") and T.opening("abc") == "" and T.opening(r"(?:a|bc)") == ""


@pytest.mark.parametrize("pattern, flags", [(p, "i") for p in C.CITATIONS + [C.ARTICLE, C.FIR_NUMBER] + X.CASE_NUMBERS] + [(p, "") for p in P.VICTIM + P.ACCUSED])
def test_words_do_not_change_matches(spark, pattern, flags):
    text = F.col("text")
    rows = lists(spark, T.every(text, pattern, 0, flags), T.every(text, pattern, 0, flags, T.fold(text)), T.first(text, pattern, 0, flags), T.first(text, pattern, 0, flags, T.fold(text)))
    assert all(plain == gated and one == gated_one for plain, gated, one, gated_one in rows)


def test_statutes_and_dates_in_spans_are_those_of_the_whole_text(spark):
    text = F.col("text")
    whole = T.sorted_set(F.transform(T.every(text, C.STATUTE, 1, "i"), lambda s: T.rstrip(T.strip(T.squash(s)), ",. ")))
    rows = lists(spark, whole, C.statutes(text, T.fold(text)), T.every(text, D.MONTH_DAY_YEAR, 0, "i"), T.every(text, D.MONTH_FIRST, 0, "i"))
    assert all(a == b and c == d for a, b, c, d in rows)
    assert len(rows[2][1]) > 2 and len(rows[5][3]) > 2


def test_court_names_cut_from_the_text_are_those_a_regex_finds(spark):
    text = F.col("text")
    found = [row[0] for row in lists(spark, K.court_name(text))]
    assert found[0] == "SUPREME COURT OF PAKİSTAN" and found[1] == "Lahore High Court" and found[2] is None


def test_the_court_is_looked_for_once(spark, sf_dir):
    plan = E.court_codes(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("COURT[") == 1


def test_a_section_begins_at_the_first_accepted_match(spark):
    far = "x" * 60 + " the facts of the case " + "y" * 60 + "\nBrief facts of the case"
    frame = spark.createDataFrame([(far,), ("The facts of the case",), ("none",)], "text string")
    rows = frame.select(S.rhetorical_start(T.fold(F.col("text")), S.RHETORICAL[0][1][0])).collect()
    assert [r[0] for r in rows] == [far.index("Brief"), 4, None]


def test_judgments_are_dealt_by_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(J, "TASK_ROWS", 50)
    frame = J.judgments(spark, sf_dir)
    sizes = [r[0] for r in frame.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == -(-sum(sizes) // 50) and max(sizes) < 100


def test_loads_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "TASK_ROWS", 50)
    stored = L.Collection(spark, str(tmp_path / "c"))
    points = spark.range(500).select(F.format_string("p%04d", "id").alias("point_uuid"), F.lit(1).alias("version"))
    assert stored.upsert(points, "version") == 500
    assert len(glob.glob(f"{stored.path}/loads/*/part-*.parquet")) > 5
    assert stored.upsert(points.unionByName(points.withColumn("version", F.col("version") + F.col("version"))).filter("point_uuid < 'p0200'"), "version") == 200
    assert stored.read().groupBy("version").count().orderBy("version").collect() == [(1, 300), (2, 200)]
