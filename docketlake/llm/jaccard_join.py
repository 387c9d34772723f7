"""Exact Jaccard join of word shingles by grouped prefixes.

A document is its set of distinct shingle hashes (64 bits). Tokens are ordered by a counter
sketch of all documents (rare first) and then by hash; two sets of similarity t share a token
among the first n - ceil(t * n) + 1 of each, their prefixes. Documents of one size and prefix are
one group, so copies and near copies post their prefix once. A posting list holds the groups
with a token; what passes the filters of size and position is expanded to members and verified
on the whole sets, so that the sketch and the filters never decide a result.

Components need not see all pairs of a family of near copies. First every posting is compared
with the head of its list, the group with fewest rarer tokens, hence closest to the others, and
every member with the first of its group; lists of frequent tokens are dealt over SPREAD parts
whose heads are compared with the list's. What links is contracted. From then on only members of
different components meet: per list, those outside the list's largest component are compared
with its first 8, then 64 units, if lists are heavy, and at last with all others. Each pair that
could still join two components is verified; pairs inside a component can change nothing.

Null and blank texts have no set and link with nothing; texts of fewer words than a shingle are
one shingle. A-Z count as a-z, words are runs of anything but ASCII blanks. Ids may be null or
repeat: rows are told apart by their place, and a component's id is its smallest known id. An
empty table gives no rows; other columns are not read. A text is one row, hashed in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.common import BROADCAST_ROWS, stage
from docketlake.llm.graph import components

WIDTH, PERCENT = 5, 80
#: Counters of the sketch, and how they travel.
COUNTERS, CHUNK = 1 << 19, 1 << 13
#: Tokens counted this far above the average are frequent; their lists are dealt over SPREAD parts.
FREQUENT, SPREAD = 2048, 64
#: Units of a list that others are compared with before all of them are, and how many times the lists' size that must save.
PROBES, WORTH = (8, 64), 8
_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(str(i), 7) | 1 for i in range(64)], np.uint64)


class _Words(dict):
    """Hashes of words seen before; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 16:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def shingle_set(text: str | None, known: dict, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    if not len(words):
        return np.zeros(0, np.int64)
    wide = min(width, len(words))
    h = np.full(len(words) - wide + 1, wide, np.uint64)
    for i in range(wide):
        h += words[i:len(words) - wide + 1 + i] * _MULTIPLIERS[i]
    return np.unique(_mixed(h)).view(np.int64)


def _pair(data: bytes) -> tuple[int, int]:
    """128 bits of a hash as two signed longs."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(data), np.int64).tolist())


def shingle_sets(docs: DataFrame, text: str, *carried: str, width: int = WIDTH) -> DataFrame:
    """Staged (carried columns, row, n, s1, s2, tokens); s1 and s2 are equal for equal sets."""
    held = docs.select(*carried, F.col(text).alias("__text"))

    def run(batches):
        known, row = _Words(), TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                sets = [shingle_set(t.as_py(), known, width) for t in some.column("__text")]
                signs = [_pair(s.tobytes()) for s in sets]
                columns = [some.column(c) for c in carried] + [
                    pa.array(np.arange(row, row + len(sets))), pa.array([len(s) for s in sets], pa.int64()), pa.array([s[0] for s in signs], pa.int64()),
                    pa.array([s[1] for s in signs], pa.int64()), pa.LargeListArray.from_arrays(np.cumsum([0, *map(len, sets)]), np.concatenate(sets)).cast(pa.list_(pa.int64()))]
                row += len(sets)
                yield pa.RecordBatch.from_arrays(columns, names=[*carried, "row", "n", "s1", "s2", "tokens"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in held.schema if f.name != "__text")
    return stage(held.mapInArrow(run, kinds + "row long, n long, s1 long, s2 long, tokens array<long>"), "shingle-sets")


def token_counts(sets: DataFrame) -> np.ndarray:
    """How many sets hold a token of each counter, over all rows; tasks send and the driver holds COUNTERS numbers."""
    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            flat = batch.column("tokens").flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(_counter(flat), minlength=COUNTERS)
        parts = total.reshape(-1, CHUNK)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["chunk", "counts"])

    def add(batches):
        total = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                counts = np.frombuffer(counts, np.int64)
                total[chunk] = total[chunk] + counts if chunk in total else counts
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["chunk", "counts"])

    kind = "chunk int, counts binary"
    parts = sets.select("tokens").mapInArrow(count, kind).repartition("chunk").mapInArrow(add, kind).collect()
    out = np.zeros((COUNTERS // CHUNK, CHUNK), np.int64)
    for r in parts:
        out[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """Staged (row, n, p1, p2, calm, prefix) of rows with a set; tokens from place ``calm`` on are frequent."""
    shared = sets.sparkSession.sparkContext.broadcast((counts, counts.mean() + FREQUENT))

    def run(batches):
        counts, frequent = shared.value
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            found = []
            for tokens in batch.column("tokens"):
                tokens = tokens.values.to_numpy(zero_copy_only=False)
                n = len(tokens)
                seen = counts[_counter(tokens)]
                first = np.lexsort((tokens, seen))[:n + (-n * percent // 100) + 1]
                prefix = tokens[first]
                found.append((*_pair(prefix.tobytes() + n.to_bytes(8, "little")), int((seen[first] < frequent).sum()), prefix))
            columns = list(zip(*found))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.list_(pa.int64()))],
                                             names=["row", "n", "p1", "p2", "calm", "prefix"])

    held = sets.filter("n > 0").select("row", "n", "tokens")
    return stage(held.mapInArrow(run, "row long, n long, p1 long, p2 long, calm long, prefix array<long>"), "prefixes")


def _may_link(n: Column, at: Column, m: Column, to: Column, percent: int) -> Column:
    """Whether sets of n and m tokens whose first common one has places ``at`` and ``to`` can reach the similarity."""
    alike = (F.least(n, m) * 100) >= F.greatest(n, m) * percent
    return alike & (F.least(n - at, m - to) * (100 + percent) >= (n + m) * percent)


def _side_by_side(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, v, n, m, a, b): staged pairs with size and tokens (row, n, tokens) of both."""
    ids = stage(pairs.select(F.col("u").alias("of")).unionByName(pairs.select(F.col("v").alias("of"))).distinct(), "candidates")
    few = ids.count() <= BROADCAST_ROWS
    held = rows.join(F.broadcast(ids) if few else ids, rows["row"] == ids["of"], "left_semi")
    held = held if few else stage(held, "candidate-sets")
    one = held.select(F.col("row").alias("u"), "n", F.col("tokens").alias("a"))
    two = held.select(F.col("row").alias("v"), F.col("n").alias("m"), F.col("tokens").alias("b"))
    # A head meets many others: merge joins, whose oversized partitions Spark splits at run time.
    met = one.join(F.broadcast(pairs), "u") if pairs.count() <= BROADCAST_ROWS else pairs.hint("merge").join(one, "u")
    return met.hint("merge").join(two, "v")


def verified(pairs: DataFrame, sets: DataFrame, posts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Staged (u, v) of the staged candidate pairs whose whole sets reach the similarity.

    Prefixes, a fifth of the sets, are compared first: common tokens up to the end of the prefix that
    ends first are in both, so what both share is at most these and all that lies behind one of them.
    """
    enough = lambda both: both * (100 + percent) >= (F.col("n") + F.col("m")) * percent
    both = F.size(F.array_intersect("a", "b"))
    near = _side_by_side(pairs, posts.select("row", "n", F.col("prefix").alias("tokens")))
    behind = F.greatest(F.col("n") - F.size("a"), F.col("m") - F.size("b"))
    close = stage(near.filter(enough(both + behind)).select("u", "v"), "close-pairs")
    return stage(_side_by_side(close, sets.select("row", "n", "tokens")).filter(enough(both)).select("u", "v"), "links")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _posting_lists(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members of groups of several classes' rows: g, row; staged lists: token, part, g, n, at, head) of staged prefixes.

    A group bears the name of its first row. Lists of one group are left out.
    """
    firsts = posts.groupBy("p1", "p2").agg(F.min("row").alias("g"), F.count("*").alias("k")).filter("k > 1")
    firsts = stage(firsts, "shared-prefixes")
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    members = stage(posts.select("row", "p1", "p2").join(firsts, ["p1", "p2"]).select("g", "row"), "group-rows")
    doubles = members.filter("row != g").select(F.col("row").alias("of"))
    few = doubles.count() <= BROADCAST_ROWS
    groups = posts.join(F.broadcast(doubles) if few else doubles, posts["row"] == doubles["of"], "left_anti")
    flat = groups.select(F.col("row").alias("g"), "n", "calm", F.posexplode("prefix").alias("at", "token"))
    part = F.when(F.col("at") < F.col("calm"), -1).otherwise(F.pmod(F.xxhash64("g"), F.lit(SPREAD)).cast("int"))
    in_list = Window.partitionBy("token", "part")
    flat = flat.select("token", part.alias("part"), "g", F.col("n").cast("int").alias("n"), "at")
    lists = flat.withColumn("held", F.count("*").over(in_list)).withColumn("head", F.min(F.struct("at", "n", "g")).over(in_list))
    return members, stage(lists.filter("held > 1 OR part >= 0").select("token", "part", "g", "n", "at", "head"), "posting-lists")


def _head_pairs(lists: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Round 1: every group with the head of each of its lists, heads of parts with the list's, members with their group."""
    near = lists.filter((F.col("g") != F.col("head.g")) & _may_link(F.col("n"), F.col("at"), F.col("head.n"), F.col("head.at"), percent))
    near = near.select("g", F.col("head.g").alias("to"))
    heads = lists.filter("part >= 0").groupBy("token", "part").agg(F.min("head").alias("head"))
    tops = heads.groupBy("token").agg(F.min("head").alias("top"))
    tied = heads.join(tops, "token").filter("head.g != top.g").filter(_may_link(F.col("head.n"), F.col("head.at"), F.col("top.n"), F.col("top.at"), percent))
    near = near.unionByName(tied.select(F.col("head.g").alias("g"), F.col("top.g").alias("to"))).distinct()
    spelt = near.join(members, "g", "left").select(F.coalesce("class", "g").alias("a"), F.col("to").alias("b"))
    inside = members.filter("class != g").select(F.col("class").alias("a"), F.col("g").alias("b"))
    return stage(spelt.unionByName(inside).select(*_ordered("a", "b")).distinct(), "pairs")


def _open_lists(units: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged (units with their component's root; lists of several components: token, main, rest, held)."""
    named = units.join(roots, units["class"] == roots["node"], "left").select("token", "class", "n", "at", F.coalesce("root", "class").alias("root"))
    named = stage(named, "named-units")
    sums = named.groupBy("token", "root").agg(F.count("*").alias("k")).groupBy("token")
    lists = sums.agg(F.max(F.struct("k", "root")).alias("main"), F.sum("k").alias("held"), F.count("*").alias("roots")).filter("roots > 1")
    return named, stage(lists.select("token", F.col("main.root").alias("main"), (F.col("held") - F.col("main.k")).alias("rest"), "held"), "open-lists")


def _cross_pairs(named: DataFrame, open_: DataFrame, seen: DataFrame, probes: int | None, percent: int) -> DataFrame | None:
    """Staged pairs of different components that share a list and were not ``seen``.

    Per list, units outside its largest component meet the first ``probes`` of the list, or all of it
    (None). With probes, None is returned where meeting all is little work anyway.
    """
    if probes and not open_.agg(F.sum("held") * WORTH < F.sum(F.col("rest") * F.col("held"))).first()[0]:
        return None
    here = stage(named.join(open_.select("token", "main"), "token"), "open-units")
    rest, others = here.filter("root != main").alias("r"), here
    if probes:
        first = F.row_number().over(Window.partitionBy("token").orderBy("at", "n", "class"))
        others = here.withColumn("place", first).filter(F.col("place") <= probes)
    others = others.alias("o")
    # Of two sets the smaller one's common token is among its first n - ceil(2t / (1 + t) * n) + 1.
    smaller = F.struct("r.n", "r.class") < F.struct("o.n", "o.class")
    n, at = F.when(smaller, F.col("r.n")).otherwise(F.col("o.n")), F.when(smaller, F.col("r.at")).otherwise(F.col("o.at"))
    early = (n - at) * (100 + percent) >= n * (2 * percent)
    once = F.lit(True) if probes else (F.col("o.root") == F.col("o.main")) | (F.col("r.class") < F.col("o.class"))
    meets = (F.col("r.token") == F.col("o.token")) & (F.col("r.root") != F.col("o.root")) & once & early
    met = rest.join(others, meets & _may_link(F.col("r.n"), F.col("r.at"), F.col("o.n"), F.col("o.at"), percent))
    return stage(met.select(*_ordered("r.class", "o.class")).distinct().join(seen, ["u", "v"], "left_anti"), "pairs")


def similar_classes(sets: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(classes of equal sets: s1, s2, class; roots of linked classes: node, root) of staged shingle sets."""
    posts = prefixes(sets, token_counts(sets), percent)
    # A class of equal sets bears the name of its first row.
    classes = stage(sets.filter("n > 0").groupBy("s1", "s2").agg(F.min("row").alias("class")), "set-classes")
    rows, lists = _posting_lists(posts)
    members = stage(rows.join(classes, rows["row"] == classes["class"]).select("g", "class"), "group-members")

    seen = _head_pairs(lists, members, percent)
    links = verified(seen, sets, posts, percent)
    # Members of a group share all of its lists, and one more that holds them alone.
    spelt = lists.join(members, "g", "left").select("token", F.coalesce("class", "g").alias("class"), "n", "at")
    own = members.join(sets.select(F.col("row").alias("class"), F.col("n").cast("int").alias("n")), "class").select(F.xxhash64("g", F.lit("group")).alias("token"), "class", "n", F.lit(0).alias("at"))
    units = stage(spelt.unionByName(own), "units")
    roots = stage(components(links), "roots")
    named, open_ = _open_lists(units, roots)
    for probes in (*PROBES, None):
        pairs = _cross_pairs(named, open_, seen, probes, percent)
        if pairs is not None:
            seen, links = seen.unionByName(pairs), verified(pairs, sets, posts, percent)
            if not links.isEmpty():
                roots = stage(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links)), "roots")
                named, open_ = _open_lists(units, roots) if probes else (named, open_)
    return classes, roots


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    sets = shingle_sets(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), "text", "id", width=width)
    classes, roots = similar_classes(sets, percent)
    kept = sets.filter("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    met = kept.join(classes, ["s1", "s2"]).join(roots, F.col("class") == F.col("node"), "left")
    met = stage(met.select("s1", "s2", "least", "copies", "root"), "rooted-classes")
    least = met.filter("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component_id"))
    linked = met.filter("root IS NOT NULL").select("s1", "s2", "root").join(least, "root").select("s1", "s2", "component_id")
    copies = met.filter("root IS NULL AND copies > 1").select("s1", "s2", F.col("least").alias("component_id"))
    known = linked.unionByName(copies).withColumn("known", F.lit(True))
    alone = sets.filter("n = 0").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    found = sets.filter("n > 0").select("id", "n", "s1", "s2").join(known, ["s1", "s2"], "left")
    found = found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return found.unionByName(alone)


def op13_jaccard_join(spark, sf_dir):
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"))
