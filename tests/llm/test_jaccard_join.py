"""The Jaccard join against all pairs."""

import random
import re

import pytest

from docketlake.llm import jaccard_join as J


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i:i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set()


def plain(rows):
    """Sorted (id, set size, component) of (id, text) rows by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    group[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    return sorted(((k, len(s), min((x for x in least[find(i)] if x is not None), default=None)) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=repr)


def families(seed, n):
    """Chains and stars of edited texts, texts around shared passages, copies."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(400)}"
    passage = [word() for _ in range(60)]
    out = []
    while len(out) < n:
        base = [word() for _ in range(r.randrange(1, 90))]
        if r.random() < 0.4:
            base = base[:r.randrange(0, 12)] + passage + base[12:12 + r.randrange(0, 20)]
        for _ in range(r.randrange(1, 9)):
            out.append(" ".join(base))
            if r.random() < 0.6:
                at = r.randrange(len(base))
                base = base[:at] + [word()] * r.randrange(0, 3) + base[at + 1:] or ["x"]
    texts = [t.upper() if r.random() < 0.2 else t for t in out[:n]]
    return [(i * 13 % 1009, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,frequent", [(1, 2048), (2, 3), (3, 3)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "SPREAD", 4)
    rows = families(seed, 260) + [(None, "a b c d e f g h"), (None, "a b c d e f g h"), (2000, None), (2001, " \n"), (2002, "one two"), (2003, "One  two"), (2004, "two one"), (2005, "x " * 3000)]
    frame = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, n long, tokens string").repartition(6)
    assert sorted(map(tuple, J.joined(frame).collect()), key=repr) == plain(rows)


def test_near_copies_meet_heads_only(spark):
    """A family of m near copies is linked by about m candidates, not m * m / 2."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(300)]
    rows = [(i, " ".join(base[:k] + [f"edit{i}"] + base[k + 1:])) for i, k in enumerate(r.randrange(5, 295) for _ in range(400))]
    sets = J.shingle_sets(spark.createDataFrame(rows, "id long, text string"), "text", "id")
    seen = []
    whole = J.verified
    try:
        J.verified = lambda pairs, *a: seen.append(pairs.count()) or whole(pairs, *a)
        classes, roots = J.similar_classes(sets)
        assert classes.count() == 400 and roots.select("root").distinct().count() == 1 and roots.count() == 400
    finally:
        J.verified = whole
    assert sum(seen) < 4 * 400


def test_groups_of_one_prefix_are_expanded(spark):
    """Sets of one size and prefix that differ behind it are one group of several classes."""
    common = [f"c{i}" for i in range(200)]
    texts = [(i, " ".join(["r1 r2 r3"] + common[:150] + [f"z{i % 3}"])) for i in range(6)] + [(10 + i, " ".join(common[i:i + 150])) for i in range(40)]
    assert sorted(map(tuple, J.joined(spark.createDataFrame(texts, "doc_id long, text string")).collect()), key=repr) == plain(texts)


def test_query_on_given_tables(spark, sf_dir, small):
    for folder in (sf_dir, small):
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
        found = J.op13_jaccard_join(spark, folder)
        assert found.columns == ["doc_id", "n_shingles", "component_id"] and sorted(map(tuple, found.collect()), key=repr) == plain(rows)


def test_prefix_lengths():
    assert [n + (-n * 80 // 100) + 1 for n in (1, 2, 4, 5, 9, 10, 100)] == [1, 1, 1, 2, 2, 3, 21]
