"""The stored collection: versions, broken writes, compaction, pruned reads."""

import pytest

from docketlake.operators import collection as C
from docketlake.operators import points as P

SCHEMA = "point_uuid string, version int, text string"


def loaded(spark, store, *rows, schema=SCHEMA):
    P.upsert(spark, spark.createDataFrame(list(rows), schema), store, "version")
    return sorted((r.point_uuid, r.version, r.text) for r in P.read_collection(spark, store).collect())


def test_upsert_keeps_the_highest_version(spark, tmp_path):
    store = str(tmp_path / "c")
    P.upsert(spark, spark.createDataFrame([], SCHEMA), store, "version")
    assert P.collection_info(spark, store) == {"exists": False}
    assert loaded(spark, store, ("a", 1, "x"), ("b", 1, "y"), ("a", 2, "z")) == [("a", 2, "z"), ("b", 1, "y")]
    assert loaded(spark, store, ("b", 3, "new"), ("c", 1, "w")) == [("a", 2, "z"), ("b", 3, "new"), ("c", 1, "w")]
    assert loaded(spark, store, ("b", 3, "new"), ("a", 1, "old"), (None, 9, "no id")) == [("a", 2, "z"), ("b", 3, "new"), ("c", 1, "w")]
    assert P.collection_info(spark, store)["points_count"] == 3
    assert not P.create_collection(spark, store, P.read_collection(spark, store).schema)


def test_create_then_upsert_twice(spark, tmp_path):
    path = str(tmp_path / "made")
    new = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "point_uuid string, v long, payload string")
    assert P.create_collection(spark, path, new.schema) and P.read_collection(spark, path).count() == 0
    P.upsert(spark, new, path, "v")
    P.upsert(spark, spark.createDataFrame([("a", 2, "z")], new.schema), path, "v")
    assert {(r.point_uuid, r.v, r.payload) for r in P.read_collection(spark, path).collect()} == {("a", 2, "z"), ("b", 1, "y")}


def test_a_repeated_load_adds_nothing(spark, tmp_path):
    store, rows = C.Collection(spark, str(tmp_path / "c")), spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], SCHEMA)
    assert store.upsert(rows, "version") == 2
    before = store.manifest()
    assert store.upsert(rows, "version") == 0 and store.manifest() == before and store.numbers() == [0]


def test_a_write_that_breaks_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    store = C.Collection(spark, path)
    store.upsert(spark.createDataFrame([("a", 1, "x")], SCHEMA), "version")
    with monkeypatch.context() as broken:
        broken.setattr(C.Collection, "_switch", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.upsert(spark.createDataFrame([("a", 2, "y"), ("b", 2, "y")], SCHEMA), "version")
        with pytest.raises(OSError):
            store.upsert(spark.createDataFrame([("a", 3, "y")], SCHEMA), "version")
    assert [(r.point_uuid, r.version) for r in store.read().collect()] == [("a", 1)]
    assert store.vacuum() == 2 and [(r.point_uuid, r.version) for r in store.read().collect()] == [("a", 1)]
    assert loaded(spark, path, ("a", 2, "y"), ("b", 2, "y")) == [("a", 2, "y"), ("b", 2, "y")]


def test_a_half_written_manifest_is_no_manifest(spark, tmp_path):
    store = C.Collection(spark, str(tmp_path / "c"))
    store.upsert(spark.createDataFrame([("a", 1, "x")], SCHEMA), "version")
    (tmp_path / "c" / "manifest" / "1.abc.draft").write_text('{"schema"')
    assert store.numbers() == [0] and store.read().count() == 1


def test_older_versions_can_be_read_until_they_are_cleared(spark, tmp_path):
    store = C.Collection(spark, str(tmp_path / "c"))
    for version in (1, 2, 3):
        store.upsert(spark.createDataFrame([("a", version, "x"), (f"n{version}", version, "y")], SCHEMA), "version")
    assert [store.read(n).count() for n in store.numbers()[:1]] == [2] and store.read().count() == 4
    store.compact(whole=True)
    assert store.manifest()["deltas"] == [] and store.read().count() == 4
    store.vacuum()
    assert len(store.numbers()) == 1 and {(r.point_uuid, r.version) for r in store.read().collect()} == {("a", 3), ("n1", 1), ("n2", 2), ("n3", 3)}


def test_deltas_are_merged_by_number_and_by_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "MERGE_AT", 1e9)
    monkeypatch.setattr(C, "MOST_DELTAS", 3)
    store = C.Collection(spark, str(tmp_path / "c"))
    for version in range(1, 8):
        store.upsert(spark.createDataFrame([(f"p{i}", version, f"{version}") for i in range(version % 3, 9, 2)], SCHEMA), "version")
        assert len(store.manifest()["deltas"]) <= 3
    want = {f"p{i}": max(v for v in range(1, 8) if i in range(v % 3, 9, 2)) for i in range(9)}
    assert {r.point_uuid: r.version for r in store.read().collect()} == want
    monkeypatch.setattr(C, "MERGE_AT", 0.0)
    store.upsert(spark.createDataFrame([("p0", 99, "z")], SCHEMA), "version")
    assert store.manifest()["deltas"] == [] and {r.point_uuid: r.version for r in store.read().collect()} == {**want, "p0": 99}


def test_new_columns_come_in_with_a_later_load(spark, tmp_path):
    store = C.Collection(spark, str(tmp_path / "c"))
    store.upsert(spark.createDataFrame([("a", 1, "x")], SCHEMA), "version")
    store.upsert(spark.createDataFrame([("b", 1, "y", 5)], SCHEMA + ", pages int"), "version")
    assert sorted(map(tuple, store.read().collect())) == [("a", 1, "x", None), ("b", 1, "y", 5)]


def test_tasks_grow_with_the_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "TASK_BYTES", 2000)
    store = C.Collection(spark, str(tmp_path / "c"))
    store.upsert(spark.createDataFrame([(f"p{i:04}", 1, str(i) * 50) for i in range(500)], SCHEMA), "version")
    files = len(list((tmp_path / "c" / "loads").glob("*/*.parquet")))
    assert files >= 5 and store.read().count() == 500


def scanned(frame):
    """Rows that the scans of a collected frame handed on."""
    plan, total = frame._jdf.queryExecution().executedPlan(), 0
    stack = [plan]
    while stack:
        node = stack.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            stack.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            stack.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return total


def test_filters_on_rare_values_read_a_part_of_the_files(spark, tmp_path, monkeypatch):
    """Levels are clustered; numbers are scattered over all files and found by their Bloom filters."""
    monkeypatch.setattr(C, "TASK_BYTES", 20_000)
    store = C.Collection(spark, str(tmp_path / "c"))
    rows = [(f"p{i:05}", 1, f"text {i * 7919 % 10007}" * 5, f"level {i % 40:02}", f"case {i * 31 % 9973}") for i in range(20_000)]
    store.upsert(spark.createDataFrame(rows, SCHEMA + ", court_level string, case_number string"), "version")
    assert len(list((tmp_path / "c" / "loads").glob("*/*.parquet"))) >= 10
    for where, most in (("court_level = 'level 07'", 0.15), ("case_number = 'case 31'", 0.3)):
        found = store.read().filter(where)
        assert found.count() in (2, 3, 500)
        found = store.read().filter(where).select("point_uuid", "text")
        found.collect()
        assert 0 < scanned(found) < most * 20_000


def test_vectors_of_other_lengths_have_no_score(spark):
    from docketlake.functions.vectors import cosine

    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [])], "id long, v array<double>")
    assert {r.id: r.s for r in rows.select("id", cosine(rows["v"], [1.0, 0.0]).alias("s")).collect()} == {1: 1.0, 2: None, 3: None, 4: None}
