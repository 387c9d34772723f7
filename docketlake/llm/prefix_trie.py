"""The trie of conversation prefixes: sorted sequences, union-find over their common prefixes.

A conversation is a sequence of turns; a node is a distinct sequence of first d turns, from the
empty root on. Turns are known by 16 bytes of the SHA-256 of role and text, so texts never
travel, and a sequence is the concatenation of its turns' digests: bytes sort as sequences do.

Equal sequences become one row first. The distinct ones are sorted over the whole table, and
each task cuts its range into blocks of BLOCK_TURNS turns or one sequence. In a block the
neighbours' longest common prefixes are edges, taken in descending depth: each merge of two
components (union-find) creates or joins the branching node at that depth, after both sides have
been climbed to it node by node. A node is complete if neither the first nor the last sequence
of the block starts with it, since prefixes own consecutive sequences. The others are the rim.

Rims are contracted forests, a row per rim node and block. They merge by the node's digest: counts
add up, and so do the sums over complete nodes below. What rim nodes add themselves is known
only after that; each is credited to the first block that holds it and carried up by running
sums along the rims of the blocks. All of it are grouped sums, no block knows its neighbour.

Null roles and texts are empty, null turns come first, equal turns order by their digest, so
repeated rows are turns of their own. Rows without a conversation id are left out. Other columns
are not read. An empty table has no root. A conversation's turn digests (16 bytes and a length
a turn) lie in one row; ids of equal conversations are joined in runs of 2^ID_BITS and
digested as a stream.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.common import stage, with_small

WIDE, BLOCK_TURNS, ID_BITS = 16, 200_000, 10
NO_ENDS = hashlib.sha256(b"").hexdigest()
_NODES = pa.schema([(n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] +
                   [(n, pa.string()) for n in ("ends", "parent", "key")] + [("block", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("bytes", pa.int64())])
_ROW = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends string, parent string, key string, block long, first boolean, last boolean, bytes long")


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn; the role's length keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256), 1, 2 * WIDE))


def sequences(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's ordered structs of digest d and text bytes n."""
    one = F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"), turn_digest(F.col(role), F.col(text)).alias("d"),
                   F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n"))
    held = turns.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv_id"), one.alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["d"].alias("d"), t["n"].alias("n")))
    return held.groupBy("conv_id").agg(ordered.alias("turns"))


def _distinct(convs: DataFrame) -> DataFrame:
    """(seq, sizes, n, first, ends): each sequence once, with its conversations' number, smallest id and digest of ids."""
    joined = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["d"])), ""))
    flat = convs.select("conv_id", joined.alias("seq"), F.transform("turns", lambda t: t["n"]).alias("sizes"))
    flat = stage(flat.withColumn("of", F.sha2("seq", 256)), "sequences")
    one = flat.groupBy("of").agg(F.any_value("seq").alias("seq"), F.any_value("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("first"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    runs = flat.groupBy("of", F.shiftright("conv_id", ID_BITS).alias("run")).agg(ids.alias("ids"))

    def digests(batches):
        of, state = None, None
        for batch in batches:
            found = []
            for k, some in zip(batch.column("of").to_pylist(), batch.column("ids").to_pylist()):
                if k == of:
                    state.update(b"," + some.encode())
                    continue
                if state:
                    found.append((of, state.hexdigest()))
                of, state = k, hashlib.sha256(some.encode())
            yield pa.RecordBatch.from_pylist([{"key": k, "ends": d} for k, d in found], schema=schema)
        if state:
            yield pa.RecordBatch.from_pylist([{"key": of, "ends": state.hexdigest()}], schema=schema)

    schema = pa.schema([("key", pa.string()), ("ends", pa.string())])
    ends = runs.repartition("of").sortWithinPartitions("of", "run").select("of", "ids").mapInArrow(digests, "key string, ends string")
    return stage(one.join(ends, one["of"] == ends["key"]).select("seq", "sizes", "n", "first", "ends"), "distinct-sequences")


class Forest:
    """The trie of consecutive sorted sequences, grown from its deepest merges up.

    ``rows``: (sequence, text bytes per turn, conversations, smallest id, digest of ids). Nodes
    are lists in the order of the constants below; low and high are the first and last row
    under a node, and sums cover complete nodes below it, itself excluded.
    """

    CONV, DEPTH, PARENT, MEMBERS, CHILDREN, LEAVES, SAVED, ENDS, LOW, HIGH = range(10)

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        self.nodes = [[first, len(seq) // WIDE, None, n, 0, 0, 0, ends, i, i] for i, (seq, _, n, first, ends) in enumerate(rows)]
        self._grow()

    def rim(self, node: list) -> bool:
        """Whether other blocks may hold this prefix, too."""
        return node[self.LOW] == 0 or node[self.HIGH] == len(self.rows) - 1

    def bytes(self, node: list) -> int:
        """Bytes of the text of the node's last turn."""
        return self.rows[node[self.LOW]][1][node[self.DEPTH] - 1] if node[self.DEPTH] else 0

    def _hang(self, child: int, depth: int, at: int | None = None) -> int:
        """Puts a finished node below the node ``at``, or below a new one at ``depth``."""
        node = self.nodes[child]
        if at is None:
            at = len(self.nodes)
            self.nodes.append([node[self.CONV], depth, None, 0, 0, 0, 0, None, node[self.LOW], node[self.HIGH]])
        to = self.nodes[at]
        node[self.PARENT] = at
        to[self.CONV], to[self.MEMBERS] = min(to[self.CONV], node[self.CONV]), to[self.MEMBERS] + node[self.MEMBERS]
        to[self.LOW], to[self.HIGH] = min(to[self.LOW], node[self.LOW]), max(to[self.HIGH], node[self.HIGH])
        to[self.LEAVES], to[self.SAVED] = to[self.LEAVES] + node[self.LEAVES], to[self.SAVED] + node[self.SAVED]
        if not self.rim(node):
            to[self.CHILDREN] += 1
            to[self.LEAVES] += node[self.CHILDREN] == 0
            to[self.SAVED] += (node[self.MEMBERS] - 1) * self.bytes(node)
        return at

    def _climb(self, node: int, depth: int) -> int:
        """The ancestor just below ``depth``; the nodes passed have one child each."""
        while self.nodes[node][self.DEPTH] > depth + 1:
            node = self._hang(node, self.nodes[node][self.DEPTH] - 1)
        return node

    def _grow(self) -> None:
        shared = []
        for (a, *_), (b, *_) in zip(self.rows, self.rows[1:]):
            d, most = 0, WIDE * min(len(a) // WIDE, len(b) // WIDE)
            while d < most and a[d:d + WIDE] == b[d:d + WIDE]:
                d += WIDE
            shared.append(d // WIDE)
        root = list(range(len(self.rows)))
        top = list(range(len(self.rows)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        # Of equal depths the left edge comes first: only its left side can have a node at that depth already.
        for i in sorted(range(len(shared)), key=lambda i: -shared[i]):
            depth, a, b = shared[i], find(i), find(i + 1)
            at = top[a]
            if self.nodes[at][self.DEPTH] > depth:
                at = self._hang(self._climb(at, depth), depth)
            self._hang(self._climb(top[b], depth), depth, at)
            if self.nodes[top[a]][self.MEMBERS] < self.nodes[top[b]][self.MEMBERS]:
                a, b = b, a
            root[b], top[a] = a, at
        whole = top[find(0)]
        if self.nodes[whole][self.DEPTH]:
            self._hang(self._climb(whole, 0), 0)

    def _keys(self, row: int) -> list[str]:
        """Digests of all prefixes of a row's sequence."""
        seq, state = self.rows[row][0], hashlib.sha256()
        keys = [state.hexdigest()]
        for d in range(0, len(seq), WIDE):
            state.update(seq[d:d + WIDE])
            keys.append(state.hexdigest())
        return keys

    def table(self, block: int) -> pa.RecordBatch:
        """All nodes: complete ones with their sums, rim ones with their share and their key."""
        first, last = self._keys(0), self._keys(len(self.rows) - 1)
        key = lambda n: first[n[self.DEPTH]] if n[self.LOW] == 0 else last[n[self.DEPTH]]
        out = []
        for n in self.nodes:
            up, rim = None if n[self.PARENT] is None else self.nodes[n[self.PARENT]], self.rim(n)
            known = up is not None and not self.rim(up)
            own = (0, 0) if rim else (n[self.CHILDREN] == 0, (n[self.MEMBERS] - 1) * self.bytes(n))
            out.append((n[self.CONV], n[self.DEPTH], up[self.CONV] if known else None, n[self.MEMBERS], n[self.CHILDREN], n[self.LEAVES] + own[0], n[self.SAVED] + own[1], n[self.ENDS],
                        None if known or up is None else key(up), key(n) if rim else None, block, rim and n[self.LOW] == 0, rim and n[self.HIGH] == len(self.rows) - 1, self.bytes(n)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _NODES)], schema=_NODES)


def _forests(batches):
    rows, turns, number = [], 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("seq", "sizes", "n", "first", "ends"))):
            rows.append(row)
            turns += len(row[1]) + 1
            if turns >= BLOCK_TURNS:
                yield Forest(rows).table(number)
                rows, turns, number = [], 0, number + 1
    if rows:
        yield Forest(rows).table(number)


def _merged_rims(rims: DataFrame) -> DataFrame:
    """Rim nodes once each with all their figures; every step is a grouped sum."""
    added = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    same = [F.max(c).alias(c) for c in ("depth", "parent", "ends", "bytes")]
    met = rims.groupBy("key").agg(F.min("conv_id").alias("conv_id"), *added, *same, F.min(F.struct("block", "first", "last")).alias("at"))
    met = stage(met, "rims")
    kids = met.groupBy("parent").agg(F.count("*").alias("more")).withColumnRenamed("parent", "of").filter("of IS NOT NULL")
    met = met.join(kids, met["key"] == kids["of"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("of", "more")
    # What a rim node adds itself is credited to one block and carried up along that block's rims.
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    own = met.select(F.lit(None).cast("string").alias("key"), "depth", "at.block", "at.first", "at.last", leaf.alias("leaf"), saved.alias("saved"))
    rows = own.unionByName(rims.select("key", "depth", "block", "first", "last", F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved")))
    both = F.col("first") & F.col("last")
    side = F.when(both, 0).when(F.col("first"), 1).otherwise(2)
    along = Window.partitionBy("block", "side").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, 0)
    forks = Window.partitionBy("block")
    rows = rows.withColumn("side", side)
    for c in ("leaf", "saved"):
        below = F.sum(F.when(~both, F.col(c)).otherwise(0)).over(forks)
        rows = rows.withColumn(f"{c}s", F.sum(c).over(along) + F.when(both, below).otherwise(0))
    carried = rows.filter("key IS NOT NULL").groupBy(F.col("key").alias("of")).agg(F.sum("leafs").alias("leafs"), F.sum("saveds").alias("saveds"))
    full = met.join(carried, met["key"] == carried["of"])
    full = full.withColumns({"n_leaves": F.col("n_leaves") + F.col("leafs"), "saved_tokens": F.col("saved_tokens") + F.col("saveds")})
    return stage(full.select("key", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"), "merged-rims")


def trie(convs: DataFrame) -> DataFrame:
    """A row per prefix of the conversations (conv_id, turns of digest d and text bytes n)."""
    ordered = _distinct(convs).repartitionByRange("seq").sortWithinPartitions("seq")
    nodes = stage(ordered.mapInArrow(_forests, _ROW), "trie-nodes")
    rims = _merged_rims(nodes.filter("key IS NOT NULL"))
    names = rims.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_of"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    both = nodes.filter("key IS NULL").select("parent", *columns).unionByName(rims.withColumn("parent_conv_id", F.lit(None).cast("long")).select("parent", *columns))
    named = with_small(both, names, names.count(), ["parent"])
    return named.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent_of")).select(*columns[:-1], F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Every conversation c behind the first crc32(c) % 9 turns of conversation c - c % 5, which replace as many of its own."""
    convs = stage(convs, "conversation-turns")
    most = 8
    heads = convs.select(F.col("conv_id").alias("of"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    met = convs.join(heads, F.col("conv_id") - F.col("conv_id") % 5 == F.col("of"), "left").withColumn("h", h)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    taken = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return met.select("conv_id", F.concat(taken, own).alias("turns"))


def op12_prefix_trie(spark, sf_dir):
    return trie(rebuilt(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
