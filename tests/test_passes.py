"""Model answers: coercion, passages, points, retries."""

import json

from docketlake.functions import model_json as M
from docketlake.operators import passes as P
from docketlake.operators.layouts import TIER_B, TIER_C
from pyspark.sql import functions as F


def answers(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, answer string")


def test_layout_sizes():
    assert len(TIER_B) == 92 and len(TIER_C) == 17


def test_tier_b_coercion(spark):
    body = {
        "judgment_type": "acquittal", "special_law": "none", "weapon_type": "sword", "injury_count": "3",
        "accomplices_count": 3.7, "criminal_history_count": "3.7", "victim_delay_reporting": True,
        "motive_proven": "Yes", "insanity_plea": 1, "remorse_shown": False, "motive_category": 0,
        "murder_category": "khata", "aggravating_factors": ["brutality", None, "N/A", 5], "mitigating_factors": "remorse",
        "grounds_for_appeal_list": 7, "brutality_level": "top", "defense_adequate": "n/a",
        "Sentencing": {"brutality_level": "extreme", "first_offense": True, "murder_category": None},
    }
    r = P.parse_tier_b(answers(spark, "```json\n" + json.dumps(body) + "\n```", "not json")).orderBy("i").collect()
    b = r[0].tier_b
    assert (b.judgment_type, b.special_law, b.weapon_type) == ("acquittal", None, None)
    assert r[0].tier_b_rejects == ["weapon_type=sword"]
    assert (b.injury_count, b.accomplices_count, b.criminal_history_count, b.victim_delay_reporting) == (3, 3, None, 1)
    assert (b.motive_proven, b.insanity_plea, b.remorse_shown, b.first_offense) == (True, None, False, True)
    assert (b.motive_category, b.murder_category, b.brutality_level, b.defense_adequate) == (None, None, "extreme", None)
    assert b.aggravating_factors == ["brutality", "5"] and b.mitigating_factors == ["remorse"]
    assert b.grounds_for_appeal_list == [] and b.premeditation_indicators == []
    assert r[1].tier_b.judgment_type is None and r[1].tier_b.aggravating_factors == []
    kept = P.parse_tier_b(answers(spark, json.dumps(body)), keep_none=True).first()
    assert kept.tier_b.special_law == "none"


def test_tier_c(spark):
    body = {"ratio_decidendi": "  a principle ", "motive_evidence": "short", "Other": {"operative_order_text": "Appeal dismissed"},
            "expert_findings_key": 12345678}
    c = P.parse_tier_c(answers(spark, json.dumps(body))).first().tier_c
    assert c.ratio_decidendi == "a principle" and c.operative_order_text == "Appeal dismissed"
    assert c.motive_evidence is None and c.expert_findings_key is None


def test_points(spark):
    ok = {"point_type": "facts", "text": "  long enough text ", "source_paragraphs": [1, "2", "x", 3.9, None],
          "sections_cited": ["s 1", "", None, " s 2 "], "extraction_confidence": "1.7", "scope": " ", "evidence_type": "oral"}
    body = {"points": [ok, {"point_type": "bad", "text": "long enough text"}, 7, {"point_type": "issue", "text": "short"},
                       {"point_type": "issue", "text": "another long text", "extraction_confidence": "high"}], "total_issues": 2}
    rows = P.parse_points(answers(spark, json.dumps(body), '{"points": 3}', "[1]", "{}")).orderBy("i").collect()
    a, b = rows[0].points
    assert (a.sequence, a.text, a.source_paragraphs, a.sections_cited) == (0, "long enough text", [1, 2, 3], ["s 1", "s 2"])
    assert (a.extraction_confidence, a.scope, a.evidence_type) == (1.0, None, "oral")
    assert (b.sequence, b.point_type, b.extraction_confidence) == (1, "issue", 0.5)
    assert tuple(rows[0].points_meta) == (5, 2, 3, None) and rows[0].total_issues == 2
    assert [r.points_meta.error for r in rows[1:]] == ["points field is not a list", "answer is not an object", None]
    assert [r.points for r in rows[1:]] == [[], [], []]


def test_ask_retries_and_reports(spark):
    class Flaky:
        def __init__(self):
            self.calls = 0

        def complete(self, prompt):
            self.calls += 1
            if prompt == "no":
                raise P.Refused("policy")
            if prompt == "bad" or self.calls == 1:
                raise RuntimeError("down")
            return prompt.upper()

    df = spark.createDataFrame([("a",), ("no",), ("bad",), (None,)], "prompt string").coalesce(1)
    rows = P.ask(df, "prompt", Flaky, wait_base=0.01).collect()
    assert [(r.answer, r.answer_error) for r in rows] == [
        ("A", None), (None, "content_refused: policy"), (None, "failed after 3 attempts: down"), (None, None)]


def test_payload_keeps_empty_lists_and_drops_nulls(spark):
    df = spark.range(1).select(F.struct(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b")).alias("x"),
                               F.struct(F.array().cast("array<string>").alias("c")).alias("y"))
    assert df.select(P.payload_json(F.col("x"), F.col("y"))).first()[0] == '{"a":1,"c":[]}'


def test_fence(spark):
    df = answers(spark, "x ```\n{}\n``` y", "{}")
    assert [r[0].strip() for r in df.select(M.without_fence(F.col("answer"))).collect()] == ["{}", "{}"]
