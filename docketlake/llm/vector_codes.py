"""Product codes for vectors: cover-tree Lloyd on blocks that stay where they are.

Components become integers (floor of 1024 times the value), vectors are cut into equal parts,
and each part position has a codebook that a few Lloyd rounds improve.

Rows are packed into blocks of BLOCK vectors; per part a block holds a cover tree of its
distinct part vectors: children lie within half their parent's radius and further than that from
each other, and nodes own consecutive places, so that differences of cumulative sums are the
sums of subtrees. Blocks are staged once. A round walks every tree from its root: an entry that
is further from a node's centre than the nearest one by more than twice the node's radius can be
nearest to no vector below. One entry left takes the whole subtree by its cumulative sums; only
leaves that stay ambiguous compare vectors. Distances are exact integers, ties go to the lower
index, and bounds have a margin, so results equal those of plain comparisons.

Between rounds only sums travel: at most one row per entry, component and task, added up by
Spark, and the driver holds the codebooks alone.

Dropped: null vectors, null, NaN and infinite components, lengths that are not a multiple of the
number of parts or differ from the kept vector with the smallest id, and components beyond
``_limit`` (about 10^5), whose squared distances would overflow a long. Codebooks start from
distinct ids: of rows with one id the smallest vector counts; a null id comes last. Repeated
rows are encoded each. With fewer ids than entries the codebook is shorter. Tables without a
kept row give no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from docketlake.llm.common import stage, with_small

PARTS, ENTRIES, ROUNDS = 4, 256, 4
BLOCK, LEAF = 2048, 16


def _limit(width: int) -> float:
    """Components of smaller size have squared distances below 2^62 over ``width`` components."""
    return (2.0**62 / max(width, 1)) ** 0.5 / 2048 - 1


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows: through floats where they are exact, else through longs."""
    top = float(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    if 16 * top * top * a.shape[1] < 2.0**53:
        a, b = a.astype(np.float64), b.astype(np.float64)
        return np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)[None]
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def _runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, end), one after the other."""
    sizes = ends - starts
    return np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(sizes.sum())


class CoverTree:
    """A cover tree of distinct integer rows with weights; nodes are in level order."""

    def __init__(self, rows: np.ndarray):
        found, self.row_of, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        self.row_of = self.row_of.reshape(-1)
        apart = np.sqrt(_squares(found, found).astype(np.float64))
        order = np.empty(len(found), np.int64)
        center, start, end, radius, child, last = [], [], [], [], [], []
        todo = [(0, np.arange(len(found)), 0)]
        while todo:
            ahead = []
            base = len(center) + len(todo)
            for c, members, at in todo:
                far = apart[c, members]
                center.append(c), start.append(at), end.append(at + len(members)), radius.append(far.max())
                child.append(base + len(ahead))
                if len(members) <= LEAF or radius[-1] == 0:
                    order[at:at + len(members)] = members
                else:
                    cover = radius[-1] / 2
                    near = far <= cover
                    groups, rest = [(c, members[near])], members[~near]
                    while len(rest):
                        near = apart[rest[0], rest] <= cover
                        groups.append((rest[0], rest[near]))
                        rest = rest[~near]
                    for g, some in groups:
                        ahead.append((g, some, at))
                        at += len(some)
                last.append(base + len(ahead))
            todo = ahead
        place = np.empty(len(found), np.int64)
        place[order] = np.arange(len(found))
        self.row_of = place[self.row_of]
        self.rows, self.counts, self.center = found[order], counts[order], place[np.array(center)]
        self.start, self.end, self.radius = np.array(start), np.array(end), np.array(radius)
        self.child, self.last = np.array(child), np.array(last)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Cumulative sums and counts before each place; a subtree's are the difference at its ends."""
        weighted = np.cumsum(self.rows.astype(np.int64) * self.counts[:, None], axis=0)
        return np.vstack([np.zeros((1, weighted.shape[1]), np.int64), weighted]), np.concatenate([[0], np.cumsum(self.counts)])

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(entry per place, sums per entry, counts per entry, places that needed a comparison of their own)."""
        own, first = np.unique(book, axis=0, return_index=True)
        own, first = own[np.argsort(first)], np.sort(first)  # equal entries: the lowest index stands for them
        rows = self.rows.astype(np.int64)
        before, counted = self.sums()
        chosen = np.empty(len(rows), np.int64)
        sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
        compared = 0
        nodes, open_ = np.array([0]), np.ones((1, len(own)), bool)
        while len(nodes):
            far = np.sqrt(_squares(rows[self.center[nodes]], own).astype(np.float64))
            far[~open_] = np.inf
            reach = far.min(axis=1) + 2 * self.radius[nodes]
            open_ = far <= (reach * (1 + 1e-9) + 1e-6)[:, None]
            sure = open_.sum(axis=1) == 1
            at, to = self.start[nodes[sure]], self.end[nodes[sure]]
            entry = first[open_[sure].argmax(axis=1)]
            chosen[_runs(at, to)] = np.repeat(entry, to - at)
            np.add.at(sums, entry, before[to] - before[at])
            np.add.at(counts, entry, counted[to] - counted[at])
            leaf = self.child[nodes] == self.last[nodes]
            few, allowed = nodes[~sure & leaf], open_[~sure & leaf]
            places = _runs(self.start[few], self.end[few])
            if len(places):
                squares = _squares(rows[places], own)
                squares[~np.repeat(allowed, self.end[few] - self.start[few], axis=0)] = np.iinfo(np.int64).max
                chosen[places] = entry = first[squares.argmin(axis=1)]
                np.add.at(sums, entry, rows[places] * self.counts[places, None])
                np.add.at(counts, entry, self.counts[places])
                compared += len(places)
            deeper, open_ = nodes[~sure & ~leaf], open_[~sure & ~leaf]
            open_ = np.repeat(open_, self.last[deeper] - self.child[deeper], axis=0)
            nodes = _runs(self.child[deeper], self.last[deeper])
        return chosen, sums, counts, compared


def _whole(vectors: pa.Array, length: int) -> np.ndarray:
    """Rows of integers of a list array without nulls."""
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False)
    return np.floor(1024.0 * flat.astype(np.float64)).astype(np.int64).reshape(-1, length)


def usable(frame: DataFrame, key: str, vector: str, parts: int, *carried: str) -> tuple[DataFrame, int]:
    """(rows with columns id, vector and c0, c1, ... that can be encoded, their length)."""
    held = frame.select(F.col(key).alias("id"), F.col(vector).alias("vector"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)])
    size = F.size("vector")
    bound = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))  # NaN counts as the largest
    whole = held.filter(F.col("vector").isNotNull() & (size > 0) & (size % parts == 0) & ~F.exists("vector", lambda x: x.isNull()))
    whole = whole.filter(bound < F.when(size > 0, F.lit(_limit(1)) / F.sqrt(size / parts)))
    least = whole.agg(F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", F.size("vector").alias("n"))).alias("s")).first()["s"]
    length = least["n"] if least else 0
    return whole.filter(F.size("vector") == length), length


def first_books(rows: DataFrame, length: int, parts: int, entries: int) -> list[np.ndarray]:
    """Codebooks cut from the vectors with the ``entries`` smallest ids; each task sends that many rows at most."""
    def run(batches):
        best = {}
        for batch in batches:
            ids = pc.unique(batch.column("id"))
            ids = pa.concat_arrays([ids, pa.array([k for k in best if k is not None], ids.type)]).unique()
            ids = ids.take(pc.sort_indices(ids)[:entries])  # nulls at the end
            some = batch.filter(pc.is_in(batch.column("id"), value_set=ids))
            for k, v in zip(some.column("id").to_pylist(), _whole(some.column("vector"), length).tolist()):
                best[k] = min(best.get(k, v), v)
            keep = set(ids.to_pylist())
            best = {k: v for k, v in best.items() if k in keep}
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(list(best), batch.schema.field("id").type), pa.array(list(best.values()), pa.list_(pa.int64()))], names=["id", "v"])

    if not length:
        return []
    found = rows.select("id", "vector").mapInArrow(run, StructType([rows.schema["id"]]).add("v", ArrayType(LongType())))
    least = found.groupBy("id").agg(F.min("v").alias("v")).orderBy(F.asc_nulls_last("id")).limit(entries).collect()
    return np.split(np.array([r["v"] for r in least], np.int64), parts, axis=1)


def blocks(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """Staged blocks: the rows' columns in an array, and per part a pickled cover tree."""
    names = [c for c in rows.columns if c != "vector"]

    def packed(held: pa.Table):
        whole = np.concatenate([_whole(chunk, length) for chunk in held.column("vector").chunks])
        trees = []
        for part in np.split(whole, parts, axis=1):
            tree = CoverTree(part)
            if np.abs(tree.rows).max(initial=0) < 2**31:
                tree.rows = tree.rows.astype(np.int32)
            trees.append(pickle.dumps(tree))
        columns = [held.column(c).combine_chunks() for c in names]
        structs = pa.StructArray.from_arrays(columns, fields=[held.schema.field(c) for c in names])
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(structs)], pa.int32()), structs), pa.array([trees], pa.list_(pa.binary()))], names=["rows", "trees"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                held, n = [*held, some], n + some.num_rows
                while n >= BLOCK:
                    table = pa.Table.from_batches(held)
                    yield packed(table.slice(0, BLOCK))
                    held, n = table.slice(BLOCK).to_batches(), n - BLOCK
        if n:
            yield packed(pa.Table.from_batches(held))

    of = StructType([rows.schema[c] for c in names])
    return stage(rows.mapInArrow(run, f"rows array<{of.simpleString()}>, trees array<binary>"), "cover-blocks")


def lloyd(held: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over staged blocks; unused entries stay."""
    shared = held.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        books = shared.value
        totals = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            for trees in batch.column("trees"):
                for total, book, tree in zip(totals, books, trees):
                    _, sums, counts, _ = pickle.loads(tree.as_py()).assign(book)
                    total[:, :-1] += sums
                    total[:, -1] += counts
        for p, total in enumerate(totals):
            e, i = np.nonzero(np.where(total[:, -1:] > 0, 1, 0) * np.ones(total.shape, int))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), p, np.int32)), pa.array(e.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(total[e, i])], names=["part", "entry", "place", "total"])

    added = held.select("trees").mapInArrow(run, "part int, entry int, place int, total long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))
    totals = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
    for r in added.collect():  # one number per entry and component
        totals[r["part"]][r["entry"], r["place"]] = r["total"]
    return [np.where(t[:, -1:] > 0, t[:, :-1] // np.maximum(t[:, -1:], 1), b) for t, b in zip(totals, books)]


def train(held: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    for _ in range(rounds if books else 0):
        books = lloyd(held, books)
    return books


def codes(held: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The rows' columns, ``code`` (two hex digits per part) and ``error`` (squared distance to what it stands for)."""
    shared = held.sparkSession.sparkContext.broadcast(books)
    of = held.schema["rows"].dataType.elementType

    def run(batches):
        books = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("rows")[i].values
                index, error = np.empty((len(rows), len(books)), np.uint8), np.zeros(len(rows), np.int64)
                for p, (book, tree) in enumerate(zip(books, batch.column("trees")[i])):
                    tree = pickle.loads(tree.as_py())
                    chosen = tree.assign(book)[0]
                    error += ((tree.rows.astype(np.int64) - book[chosen]) ** 2).sum(axis=1)[tree.row_of]
                    index[:, p] = chosen[tree.row_of]
                found = [bytes(r).hex() for r in index]
                yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(found), pa.array(error)], names=[*[f.name for f in of], "code", "error"])

    return held.mapInArrow(run, StructType([*of]).add("code", StringType()).add("error", LongType()))


def books_sha256(books: list[np.ndarray]) -> str:
    """Digest of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def decoded(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The vector a code stands for."""
    return np.concatenate([b[i] for b, i in zip(books, bytes.fromhex(code))]) / 1024.0


def compress(frame: DataFrame, key: str, vector: str, *carried: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(staged rows with key, carried columns, code and error; the codebooks)."""
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    rows, length = usable(frame, key, vector, parts, *carried)
    held = blocks(rows, length, parts)
    books = train(held, first_books(rows, length, parts, entries), rounds)
    names = {"id": key, **{f"c{i}": c for i, c in enumerate(carried)}}
    found = stage(codes(held, books), "vector-codes")
    return found.select(*[F.col(c).alias(n) for c, n in names.items()], "code", "error"), books


def op11_vector_codes(spark, sf_dir):
    found, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
    per_label = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    per_label = stage(per_label, "label-errors")
    out = with_small(found, per_label, per_label.count(), ["label"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _round_sql(n: int) -> str:
    """Nearest entries for codebook ``n``, and the next codebook."""
    return f"""near{n} AS MATERIALIZED (SELECT r, p, min((x2 - 2 * list_dot_product(x, c) + c2)::BIGINT * 256 + e) AS de FROM parts JOIN book{n} USING (p) GROUP BY r, p),
      sums{n} AS (SELECT p, e, list(floor(s / n) ORDER BY i) AS c FROM (SELECT p, de % 256 AS e, i, sum(x[i]) AS s, count(*) AS n
        FROM near{n} JOIN parts USING (r, p), range(1, 17) t(i) GROUP BY ALL) GROUP BY p, e),
      book{n + 1} AS MATERIALIZED (SELECT *, list_dot_product(c, c) AS c2 FROM (SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM book{n} b LEFT JOIN sums{n} s USING (p, e)))"""


CODES_SQL = f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)) AS v
        FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
      parts AS MATERIALIZED (SELECT *, list_dot_product(x, x) AS x2 FROM (SELECT r, p, v[p * 16 + 1:p * 16 + 16]::DOUBLE[] AS x FROM kept, range(4) t(p))),
      book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c, x2 AS c2 FROM parts WHERE r <= 256),
      {", ".join(_round_sql(n) for n in range(ROUNDS))},
      final AS (SELECT r, p, min((x2 - 2 * list_dot_product(x, c) + c2)::BIGINT * 256 + e) AS de FROM parts JOIN book{ROUNDS} USING (p) GROUP BY r, p),
      coded AS (SELECT r, string_agg(lower(printf('%02x', (de % 256)::INT)), '' ORDER BY p) AS code, sum(de // 256)::BIGINT AS error FROM final GROUP BY r)
      SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
        (SELECT sha256(string_agg(array_to_string(c::BIGINT[], ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256
      FROM coded JOIN kept USING (r)"""
