"""Benchmark decontamination on edited passages and on items without an id."""

import random

from docketlake.llm import decontamination as D


def edited(seed):
    """An item of 49 words and the same with its middle word changed: similarity 0.8."""
    r = random.Random(seed)
    item = [f"w{r.randrange(10**6)}" for _ in range(49)]
    return item, item[:24] + ["other"] + item[25:]


def test_edited_items_at_the_bound_are_found(spark):
    pairs = [edited(seed) for seed in range(1500)]
    apart = [(D.simhash(D.shingle_hashes(a)) ^ D.simhash(D.shingle_hashes(b))) & (2**64 - 1) for a, b in pairs]
    far = [i for i, x in enumerate(apart) if x.bit_count() > 17]
    assert far
    some = [*far, *range(20)]
    items = spark.createDataFrame([(i, " ".join(pairs[i][0])) for i in sorted(set(some))], "item_id long, text string")
    docs = spark.createDataFrame([(i, "before it " + " ".join(pairs[i][1]) + " behind it") for i in sorted(set(some))], "doc_id long, text string")
    found = D.find_leaks(docs, items, ["doc_id"]).collect()
    assert sorted((r["doc_id"], r["item_id"], r["similarity"]) for r in found) == [(i, i, 0.8) for i in sorted(set(some))]


def test_items_without_an_id_are_found(spark):
    a, b, c = (" ".join(edited(seed)[0]) for seed in (1, 2, 3))
    items = spark.createDataFrame([(None, a), (None, a), (None, b), (None, c), (7, c)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {a} y {b}"), (2, c), (3, "none of them")], "doc_id long, text string")
    found = D.find_leaks(docs, items, ["doc_id"]).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0, r["item_copies"], r["start_word"]) for r in found) == [(1, 0, 1, 51), (1, 0, 2, 1), (2, 7, 2, 0)]
