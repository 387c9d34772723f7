import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, m string"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def prose(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + i * 104729) % 5003}" for i in range(n))


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """A folder of small tables with nulls, blanks, repeated rows, a long text and clashing columns."""
    texts = [None, "", " \n\t ", "a", "word " * 30000, prose(1, 80), prose(1, 80), prose(2, 90) + " " + PASSAGE + " " + prose(3, 50),
             prose(4, 60) + ' token = "0123456789abcdef0123456789abcdef01234567" x@mail.example.com 256.1.1.1 10.0.0.1', prose(5, 70) + "\n" + prose(6, 20)]
    rows = [(i, t, None if i == 3 else "en", None if i == 5 else f"s{i % 2}", None, "x", "y", "z") for i, t in enumerate(texts)]
    rows += [rows[9], (None, prose(8, 100), "en", "s1", None, None, None, None)]
    folder = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, PASSAGE), (1, PASSAGE), (2, None), (3, "never seen words here at all today")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(5, 1, 0), (8, 0, 1), (9, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    turns = [(1, 1, "assistant", "b <|im_end|> \\ <\\|x|>"), (1, 0, "user", None), (1, 2, "assistant", "c\nd"), (1, 2, "assistant", "c\nd"), (None, None, None, "x"), (2, 0, "assistant", "")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.5] * 63 + [None], [0.5] * 63 + [nan], [-inf] + [0.5] * 63, [0.25] * 64, [0.25] * 64, [-0.0001] * 64]
    vectors = [(i, v, None if i % 2 else 1) for i, v in enumerate(odd)] + [(i, [((i * 37 + j * 61) % 97) / 97 - 0.5 for j in range(64)], i % 3) for i in range(10, 30)]
    spark.createDataFrame([*vectors, (None, [1.0] * 64, None)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="session")
def empty(spark, small, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "labels", "conversations", "embeddings"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder
