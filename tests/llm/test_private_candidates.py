"""Candidates of the private data operator: each kind alone in a text, and beside base spans."""

from docketlake.llm import private_data


def found(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = frame.select("i", private_data.candidates(frame["t"], private_data.base_spans(frame["t"])).alias("c")).collect()
    return {texts[r["i"]]: [texts[r["i"]][c["start"]:c["end"]] for c in r["c"]] for r in got}


def test_each_kind_alone_is_found(spark):
    want = {"é@x": "é@x", "so 12/34.56": "12/34.56", "of a1b2c3d4e5f6g7h8i9j0k1l2": "a1b2c3d4e5f6g7h8i9j0k1l2", "by Dr. Ada": "Dr. Ada",
            "password: Xk29vLq8Tz": "Xk29vLq8Tz", "secret=Zq8rT5yPw2Lm9": "Zq8rT5yPw2Lm9", "API_KEY = 'ab12/cd34+ef56/gh78+ij90": "ab12/cd34+ef56/gh78+ij90"}
    assert found(spark, list(want)) == {t: [c] for t, c in want.items()}


def test_neighbours_of_base_spans_are_found(spark):
    want = {"host 10.0.0.1 123-45-6789": ["123-45-6789"], "123-45-6789 10.0.0.1 (987) 654-321": ["123-45-6789", "987) 654-321"],
            "𝒳 mail a@b.co, password: Xk29vLq8Tz and 10.0.0.1/10.0.0.2": ["Xk29vLq8Tz"], "a@b.co. 10.0.0.1": []}
    assert found(spark, list(want)) == want
