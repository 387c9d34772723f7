"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies each of its documents should
have, whole copies plus a fraction. Pivotal rounding turns the fractions into 0 or 1: two
documents meet, one gives words to the other at random until one of them is integral, and the
other goes on; each way is taken as often as keeps both expectations. The words of a source
stay exactly what they were, up to the one document that is left over at the end.

It runs as a reduction tree. Documents of a source are dealt into blocks of about ``BLOCK``,
each block is folded from its largest document to its smallest and leaves at most one
fractional document, and the leftovers are the next level's input. A hot source is many
blocks. Equal rows (id, source, size) are counted first and folded as one unit, so that
repeated rows never make a block large. Random numbers are hashes of the ids: reruns agree.

A null source is a source of its own, sorted last; null texts have size 0 and are never taken
for words; sources without words have target 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.common import stage, uniform, with_small

WEIGHTS = [5, 2, 1]
SHARE, MOST, BLOCK = 1.5, 2.0, 256
EPS = 1e-9


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: source_size, target, copies (target per word) and units (rows).

    Sources in code point order, null last, weigh 5, 2, 1, repeating. A source that would
    exceed ``most`` times its size stops there; the rest is shared anew until none does.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).cast("bigint").alias("source_size"), F.count("*").alias("units"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # one row per source
    turns = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    per = stage(per.withColumn("weight", F.get(turns, (place - 1) % len(WEIGHTS))), "mix-sources")
    total = (per.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, F.lit(False)
    while True:
        fixed, free = per.agg(F.sum(F.when(full, most * F.col("source_size")).otherwise(0.0)),
                              F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        if not free:
            break
        before, level = level, (total - fixed) / free
        if level <= before:
            break
        full = F.col("weight") * F.lit(level) >= most * F.col("source_size")
    target = F.least(F.col("weight") * F.lit(level), most * F.col("source_size"))
    return per.withColumn("target", target.cast("double")).withColumn(
        "copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def _fold(level: int, seed: int):
    """Expression over the sorted block ``units``: struct of decided units and the one left."""
    u = f"(cast(shiftrightunsigned(xxhash64(a.left.h, x.h, {level}, {seed}), 11) as double) * {2.0 ** -53!r})"
    given = lambda who, p: f"named_struct('size', {who}.size, 'h', {who}.h, 'doc_id', {who}.doc_id, 'm', {who}.m, 'base', {who}.base, 'p', {p})"
    old, unit = "a.left", given("x", "x.p")
    # Words that may go to the old unit, and from it; each way is taken as often as keeps both expectations.
    room = "named_struct('up', least((1 - a.left.p) * a.left.size, x.p * x.size), 'down', least(a.left.p * a.left.size, (1 - x.p) * x.size))"
    moved = f"transform(array({room}), v -> IF({u} * (v.up + v.down) < v.down, v.up, -v.down))[0]"
    after = f"transform(array({moved}), t -> named_struct('old', a.left.p + t / a.left.size, 'new', x.p - t / x.size))[0]"
    meet = f"""transform(array({after}), q -> IF(q.old <= {EPS} OR q.old >= 1 - {EPS},
      named_struct('done', {given(old, 'q.old')}, 'left', {given('x', 'q.new')}),
      named_struct('done', {given('x', 'q.new')}, 'left', {given(old, 'q.old')})))[0]"""
    return F.expr(f"""aggregate(slice(units, 2, size(units)),
      named_struct('decided', slice(units, 1, 0), 'left', units[0]),
      (a, x) -> CASE WHEN a.left.p <= {EPS} OR a.left.p >= 1 - {EPS} THEN named_struct('decided', concat(a.decided, array(a.left)), 'left', {unit})
                     ELSE transform(array({meet}), r -> named_struct('decided', concat(a.decided, array(r.done)), 'left', r.left))[0] END)""")


def pivotal(units: DataFrame, seed: int = 0) -> DataFrame:
    """Rounds ``p`` of units (source, doc_id, size, m, h, base, p, blocks) to 0 or 1; the sum of p * size stays as it was per source."""
    decided, level = None, 0
    integral = (F.col("p") <= EPS) | (F.col("p") >= 1 - EPS)
    columns = ["source", "doc_id", "size", "m", "h", "base", "p"]
    while True:
        block = F.pmod(F.xxhash64("h", F.lit(level)), F.col("blocks")).alias("block")
        grouped = units.filter(~integral).groupBy("source", "blocks", block).agg(F.sort_array(F.collect_list(
            F.struct("size", "h", "doc_id", "m", "base", "p")), asc=False).alias("units"))
        folded = stage(grouped.select("source", "blocks", _fold(level, seed).alias("r")), f"mix-level{level}")
        done = folded.select("source", F.inline("r.decided")).select(*columns)
        left = folded.select("source", "blocks", F.col("r.left").alias("u")).select("source", "u.*", "blocks").select(*columns, "blocks")
        parts = [done, units.filter(integral).select(*columns)]
        decided = parts[0].unionByName(parts[1]) if decided is None else decided.unionByName(parts[0]).unionByName(parts[1])
        most = folded.agg(F.max("blocks")).first()[0]
        if (most or 1) <= 1:
            # One document per source at most is left over; it is decided alone.
            alone = uniform(F.col("h"), F.lit(-1 - seed)) < F.col("p")
            last = left.withColumn("p", F.when(integral, F.col("p")).otherwise(alone.cast("double")))
            return decided.unionByName(last.select(*columns))
        units, level = left.withColumn("blocks", F.ceil(F.col("blocks") / BLOCK).cast("bigint")), level + 1


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Rows (doc_id, source, size, m, source_size, target, whole): ``m`` equal rows have ``whole`` copies together."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    equal = docs.select("doc_id", "source", size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))
    sizes = stage(equal, "mix-sizes")
    targets = source_targets(sizes)
    sources = targets.count()
    whole = F.floor(F.col("copies") * F.col("m") + EPS)
    units = with_small(sizes, targets, sources, ["source"])
    units = units.withColumn("base", whole.cast("bigint")).withColumn("p", F.when(F.col("size") > 0, F.greatest(F.col("copies") * F.col("m") - whole, F.lit(0.0))).otherwise(0.0))
    units = units.withColumn("h", F.xxhash64("doc_id", "size")).withColumn("blocks", F.ceil(F.col("units") / BLOCK).cast("bigint"))
    rounded = pivotal(units.select("source", "doc_id", "size", "m", "h", "base", "p", "blocks"), seed)
    rounded = rounded.select("doc_id", "source", "size", "m", (F.col("base") + F.round("p").cast("bigint")).alias("whole"))
    return with_small(rounded, targets.select("source", "source_size", "target"), sources, ["source"])


def op9_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    each = mix(docs).withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))))
    copies = F.floor(F.col("whole") / F.col("m")) + (F.col("i") <= F.pmod("whole", "m")).cast("bigint")
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("bigint").alias("taken"), copies.cast("int").alias("copies"))


def _joined(doc_id: Column, source: Column, size: Column) -> dict[str, Column]:
    """Columns without nulls that tell documents apart as the mix does: a hash, and the values behind it."""
    return {"key": F.xxhash64(doc_id, source, size), "no_id": doc_id.isNull(), "id": F.coalesce(doc_id, F.lit(0)),
            "no_source": source.isNull(), "of": F.coalesce(source, F.lit("")), "n": size}


def mix_documents(spark, docs, sf_dir):
    """Pipeline stage: every document as often as the mix takes it, columns unchanged.

    Texts pass one shuffle; repeated rows share their copies where the join has brought them together.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()])
    size = F.coalesce(F.regexp_count(at["text"], F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    held = held.withColumn("size", size)
    own = _joined(F.col(at["doc_id"]), F.col(at["source"]), F.col("size"))
    taken = mix(docs.select("doc_id", "source", "text")).filter("whole > 0")
    taken = taken.select(*[c.alias(k) for k, c in _joined(F.col("doc_id"), F.col("source"), F.col("size")).items()], "m", "whole")
    rows = held.select(*names, *[c.alias(k) for k, c in own.items()]).join(taken, list(own))
    place = F.row_number().over(Window.partitionBy(*own).orderBy("key"))
    rows = rows.withColumn("share", F.floor(F.col("whole") / F.col("m")) + (place <= F.pmod("whole", "m")).cast("bigint"))
    out = rows.filter("share > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("share"))))
    return out.select(*[F.col(n).alias(c) for c, n in at.items()])
