"""Cover-tree product codes against plain comparisons."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from docketlake.llm import vector_codes as V


def nearest(rows, book):
    return np.array([((r - book) ** 2).sum(axis=1) for r in rows]).argmin(axis=1)


def plain(rows, parts=4, entries=256, rounds=4):
    """(id, label, code, error) of all rows and the codebooks, by comparing everything."""
    ids = sorted({i for i, _, _ in rows if i is not None}) + [None] * any(i is None for i, _, _ in rows)
    ints = [[int(np.floor(1024 * float(x))) for x in v] for _, v, _ in rows]
    first = [min(v for (i, _, _), v in zip(rows, ints) if i == k) for k in ids[:entries]]
    books, cut = np.split(np.array(first), parts, axis=1), np.split(np.array(ints), parts, axis=1)
    for _ in range(rounds):
        for p in range(parts):
            at = nearest(cut[p], books[p])
            books[p] = np.array([[int(s) // int((at == e).sum()) for s in cut[p][at == e].sum(axis=0)] if (at == e).any() else b for e, b in enumerate(books[p].tolist())])
    at = [nearest(c, b) for c, b in zip(cut, books)]
    errors = sum(((c - b[a]) ** 2).sum(axis=1) for c, b, a in zip(cut, books, at))
    return [(i, label, "".join(f"{a[n]:02x}" for a in at), int(errors[n])) for n, (i, _, label) in enumerate(rows)], books


def clustered(seed, n, dims, centers=6, spread=0.05):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(centers, dims))
    return [[float(x) for x in middle[r.integers(centers)] + r.normal(size=dims) * spread] for _ in range(n)]


@pytest.mark.parametrize("seed,dims,entries,block", [(1, 64, 256, 2048), (2, 8, 16, 32), (3, 16, 5, 300), (4, 4, 256, 64)])
def test_codes_equal_plain_lloyd(spark, monkeypatch, seed, dims, entries, block):
    monkeypatch.setattr(V, "BLOCK", block)
    vectors = clustered(seed, 330, dims) + [[0.25] * dims] * 40
    rows = [(i * 3 % 401, v, i % 5 or None) for i, v in enumerate(vectors)] + [(5, vectors[0], 9), (5, vectors[0], 9), (None, vectors[1], 1)]
    frame = spark.createDataFrame(rows, "k long, v array<double>, size int").repartition(3)
    want, books = plain(rows, entries=entries)
    found, got = V.compress(frame, "k", "v", "size", entries=entries)
    assert all((a == b).all() for a, b in zip(books, got))
    assert Counter(tuple(r) for r in found.select("k", "size", "code", "error").collect()) == Counter(want)
    assert V.books_sha256(got) == hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()


def test_whole_subtrees_are_assigned():
    rows = np.floor(1024 * np.array(clustered(7, 2000, 16, spread=0.01))).astype(np.int64)
    tree, book = V.CoverTree(rows), rows[np.random.default_rng(1).choice(2000, 8, replace=False)]
    chosen, sums, counts, compared = tree.assign(book)
    want = nearest(rows, book)
    assert (chosen[tree.row_of] == want).all() and compared < 1000
    assert all((sums[e] == rows[want == e].sum(axis=0)).all() and counts[e] == (want == e).sum() for e in range(8))


def test_cover_tree_shape():
    rows = np.floor(1024 * np.array(clustered(8, 500, 4, spread=0.3))).astype(np.int64)
    tree = V.CoverTree(rows)
    assert (tree.rows[tree.row_of] == rows).all()
    for n in range(len(tree.center)):
        below = range(tree.child[n], tree.last[n])
        far = lambda a, b: float(np.sqrt(((tree.rows[a] - tree.rows[b]) ** 2).sum()))
        assert max(far(tree.center[n], i) for i in range(tree.start[n], tree.end[n])) == pytest.approx(tree.radius[n])
        assert [i for c in below for i in range(tree.start[c], tree.end[c])] == (list(range(tree.start[n], tree.end[n])) if below else [])
        assert all(tree.radius[c] <= tree.radius[n] / 2 for c in below)
        assert all(far(tree.center[a], tree.center[b]) > tree.radius[n] / 2 for a in below for b in below if a < b)


def test_ties_large_numbers_and_other_lengths(spark):
    big = 90000.0
    rows = [(1, [big, -big, 0.0, 0.0], 1), (2, [big, -big, 0.0, 0.0], 1), (3, [-big, big, 1.0, 0.5], 1), (4, [1e30] * 4, 1), (5, [1.0] * 8, 1), (6, [1.0] * 3, 1)]
    found, books = V.compress(spark.createDataFrame(rows, "k long, v array<double>, c int"), "k", "v", "c", entries=2)
    want, _ = plain(rows[:3], entries=2)
    assert sorted(map(tuple, found.select("k", "c", "code", "error").collect())) == sorted(want)
    assert V.decoded("01010101", books).tolist() == [big, -big, 0.0, 0.0]  # ties went to entry 0, the average moved away


def test_label_errors(spark, small):
    found = V.op11_vector_codes(spark, small).collect()
    assert {r["vec_id"] for r in found} == {5, 6, 7, None, *range(10, 30)}
    labels = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    for r in found:
        assert r["label_error"] == sum(x["error"] for x in found if labels[x["vec_id"]] == labels[r["vec_id"]])
