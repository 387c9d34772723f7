"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from docketlake.llm import prefix_trie as T

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(convs):
    """The rows for {conversation: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = own + sum(saved[k] for k in kids[node])
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], digest(ends[n])) for n, m in members.items()]


def rebuilt(convs):
    def of(c):
        h = zlib.crc32(str(c).encode()) % 9
        return convs.get(c - c % 5, [])[:h] + convs[c][h:]

    return {c: of(c) for c in convs}


def conversations(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            found[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in found.items()}


def same(got, want):
    return sorted(map(tuple, got.select(*COLUMNS).collect()), key=repr) == sorted(want, key=repr)


def shared_turns(seed, n, letters=3, most=7):
    r = random.Random(seed)
    return [(c, i, r.choice(["user", "assistant"])[: 1 + 3 * (i % 2)], r.choice("xyz"[:letters]) * (i + 1) + "é" * (c % 2 and i == 3)) for c in range(n) for i in range(r.randrange(1, most))]


@pytest.mark.parametrize("seed,n,block,parts", [(1, 60, 1, 4), (2, 200, 7, 3), (3, 200, 10**6, 1), (4, 150, 3, 8), (5, 1, 5, 2), (6, 400, 20, 5)])
def test_trie_equals_all_prefixes(spark, monkeypatch, seed, n, block, parts):
    monkeypatch.setattr(T, "BLOCK_TURNS", block)
    rows = shared_turns(seed, n)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        assert same(T.trie(T.sequences(frame)), plain(conversations(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_forest_of_one_block_is_rim_free_inside():
    digests = lambda s: b"".join(hashlib.sha256(x.encode()).digest()[:16] for x in s)
    rows = sorted((digests(s), [1] * len(s), 1, i, "e") for i, s in enumerate(["", "a", "ab", "abc", "abd", "b", "bcd", "bce"]))
    nodes = T.Forest(rows).table(0).to_pylist()
    assert len(nodes) == 9 and {n["key"] is None for n in nodes} == {True, False}
    assert all((n["parent"] is None) != (n["parent_conv_id"] is None) or n["depth"] == 0 for n in nodes)


def test_many_copies_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(T, "ID_BITS", 2)
    rows = [(c, i, "user", "same") for c in range(300) for i in range(2)] + [(1000, i, "user", "same" if i < 2 else f"t{i}") for i in range(500)]
    rows += [(2000 + c, 0, "user", "same") for c in range(20)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert same(T.trie(T.sequences(frame)), plain(conversations(rows)))


def test_query_on_given_tables(spark, sf_dir, small):
    for folder in (sf_dir, small):
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert same(T.op12_prefix_trie(spark, folder), plain(rebuilt(conversations(rows))))


def test_nulls_turnless_and_other_columns(spark):
    rows = [(7, None, None, None), (7, 0, "user", None), (7, None, "", ""), (None, 0, "user", "x"), (3, 1, "a", "b"), (4, 1, "ab", ""), (9, 0, "a", "b"), (10**12, 0, "a", "b")]
    frame = spark.createDataFrame([(*r, "n", "d") for r in rows], "conv_id long, turn long, role string, text string, turns string, seq string")
    assert same(T.trie(T.sequences(frame)), plain(conversations(rows)))
    found = T.trie(T.rebuilt(T.sequences(frame)))
    assert same(found, plain(rebuilt(conversations(rows)))) and any(r["depth"] == 0 and r["n_convs"] == 5 for r in found.collect())
