"""Quality rules whose cutoffs come from the data: quantile sketches per language and source.

Every document gets a few integer metrics (rates per 10,000 words or characters). A metric's
distribution per (language, source) is kept as a sketch: counts per log-linear bucket, exact
below 64 and within 1/32 above. Sketches are ordinary rows, so merging is adding counts, and
partial sketches are merged before the shuffle whatever the size of a source. A language's own
sketch is the merged one of its sources.

Documents that fail the base rule say nothing about ordinary ones and are in no sketch.
An upper fence is a high quantile plus a multiple of its distance from the median (at least the
width of a bucket, the sketch's resolution there); METRICS says which quantile and multiple. Nothing else decides: a distribution that moves takes its fence along.
Small groups lean on larger ones without a switch: a language's counts are joined by PRIOR documents
spread as all documents are, a source's by PRIOR documents spread as its language's. So the weight
of what a group itself says grows smoothly with its size. Documents are then joined to their fences.

Null or empty texts have zero words and fail the base rule; null languages and sources form
groups of their own. Repeated rows are judged alike, row by row. Empty tables give no rows. Texts
of any length are measured whole, in n log n. Other columns are neither read nor changed by
``keep_good``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.common import SYMBOLS, let, stage, with_small, words

#: Metrics that are judged, each only from above: the quantile and the multiple of its distance from the median.
METRICS = {"symbol_rate": (0.8, 6), "dup_line_rate": (0.99, 1), "repeat_rate": (0.99, 1), "upper_rate": (0.99, 3), "word_length": (0.8, 12)}
#: Documents' worth of the larger group's distribution in each group's own.
PRIOR = 100
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SCAN_BELOW = 64


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur at least twice in the text.

    Windows are compared by 64-bit hashes. Few repeated windows are looked up by scanning
    their list; for many, windows are sorted with their positions, which stays n log n.
    """
    none, last = F.lit(0).cast("bigint"), F.size(w) - 3

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(-3).alias("at"), none.alias("n"))
        step = lambda s, p: F.struct(p.alias("at"), (s["n"] + F.least(F.lit(3), p - s["at"])).alias("n"))
        return F.aggregate(positions, start, step, lambda s: s["n"])

    def by_scan(h: Column, repeated: Column) -> Column:
        return covered(F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(repeated, F.get(h, i))))

    def by_sort(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, i, j: F.get(s, i)["h"].eqNullSafe(F.get(s, j)["h"])
        found = let(ordered, lambda s: F.transform(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(s, i, i + 1) | ((i > 0) & same(s, i, F.greatest(i - 1, F.lit(0))))),
            lambda i: F.get(s, i)["i"]))
        return covered(F.sort_array(found))

    def repeats(h: Column) -> Column:
        again = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, F.greatest(i - 1, F.lit(0)))))))
        return let(again, lambda d: F.when(F.size(d) < SCAN_BELOW, by_scan(h, d)).otherwise(by_sort(h)))

    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeats(h)).otherwise(none))
    return F.when(last >= 1, some).otherwise(none)


def base_metrics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper."""
    whole = F.coalesce(text, F.lit(""))
    full_lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    n = lambda c: c.cast("bigint")
    return let(words(text), lambda w: F.struct(
        n(F.size(w)).alias("n_words"),
        n(F.length(F.concat_ws("", w))).alias("word_chars"),
        n(F.length(whole) - F.length(F.regexp_replace(whole, f"[{SYMBOLS}]+", ""))).alias("n_symbols"),
        n(let(full_lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
        _repeat_words(w).alias("n_repeat_words"),
        n(F.length(whole) - F.length(F.regexp_replace(whole, r"\p{Lu}{2,}", ""))).alias("n_upper"),
        n(F.size(full_lines)).alias("n_lines"),
    ))


def measured(docs: DataFrame) -> DataFrame:
    """The documents with their base metrics and rates as columns of the struct ``m``."""
    rate = lambda part, whole: F.expr(f"int(10000 * {part} div greatest({whole}, 1L))")
    return docs.withColumn("m", base_metrics(F.col("text"))).withColumn("m", F.struct(
        "m.*",
        rate("m.n_symbols", "m.word_chars").alias("symbol_rate"),
        rate("m.n_dup_lines", "m.n_lines").alias("dup_line_rate"),
        rate("m.n_repeat_words", "m.n_words").alias("repeat_rate"),
        rate("m.n_upper", "m.word_chars").alias("upper_rate"),
        F.expr("int(100 * m.word_chars div greatest(m.n_words, 1L))").alias("word_length"),
    ))


def bucket(value: Column) -> Column:
    """Sketch bucket of a non-negative integer: itself below 64, else 32 per power of two."""
    bits = F.length(F.bin(value))
    shift = F.greatest(bits - 6, F.lit(0))
    return (shift * 32 + F.call_function("shiftright", value.cast("bigint"), shift)).cast("int")


def _shift(b: Column) -> Column:
    return F.when(b < 64, F.lit(0)).otherwise(F.floor(b / 32) - 1).cast("int")


def bucket_top(b: Column) -> Column:
    """The largest value of a bucket."""
    return F.call_function("shiftleft", (b - _shift(b) * 32 + 1).cast("bigint"), _shift(b)) - 1


def bucket_width(b: Column) -> Column:
    """How many values a bucket holds."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), _shift(b))


def sketches(measures: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per key, metric and bucket; two such tables merge by adding ``n``."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(f"m.{m}")).alias("bucket")) for m in METRICS])
    rows = measures.select(*keys, F.inline(pairs).alias("metric", "bucket"))
    return rows.groupBy(*keys, "metric", "bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def blended(sketch: DataFrame, keys: list[str], larger: DataFrame, shared: list[str]) -> DataFrame:
    """The sketches of ``keys`` with PRIOR documents spread as in the sketch of their ``shared`` keys in ``larger``."""
    whole = Window.partitionBy(*shared, "metric")
    spread = larger.select(*[F.col(k).alias(f"of_{k}") for k in shared], F.col("metric").alias("of_metric"), "bucket", (PRIOR * F.col("n") / F.sum("n").over(whole)).alias("n"))
    groups = sketch.select(*keys, "metric").distinct()
    on = [groups["metric"] == spread["of_metric"], *[groups[k].eqNullSafe(spread[f"of_{k}"]) for k in shared]]
    prior = groups.join(spread, on).select(*keys, "metric", "bucket", "n")
    return merged(sketch.withColumn("n", F.col("n").cast("double")).unionByName(prior), keys)


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the upper fence of each metric. A key's sketch is one array of a few hundred buckets at most."""
    sorted_ = F.sort_array(F.collect_list(F.struct("bucket", "n")))
    per = sketch.groupBy(*keys, "metric").agg(sorted_.alias("s"))

    def quantile(q: Column) -> Column:
        total = F.aggregate("s", F.lit(0.0), lambda a, b: a + b["n"])
        start = F.struct(F.lit(0.0).alias("seen"), F.lit(-1).alias("at"))
        # Sums of shares are rounded; a hair's breadth below the quantile counts as reached.
        step = lambda a, b: F.struct(
            (a["seen"] + b["n"]).alias("seen"),
            F.when((a["at"] < 0) & ((a["seen"] + b["n"]) * (1 + 1e-9) >= total * q), b["bucket"]).otherwise(a["at"]).alias("at"))
        return F.aggregate("s", start, step, lambda a: a["at"])

    of = lambda i: F.create_map(*[F.lit(x) for m, v in METRICS.items() for x in (m, float(v[i]))])[F.col("metric")]
    per = per.withColumns({"high": quantile(of(0)), "mid": quantile(F.lit(0.5)), "reach": of(1)})
    # Distances below the sketch's resolution are not known; a bucket's width stands for them.
    far = F.greatest(bucket_top(F.col("high")) - bucket_top(F.col("mid")), bucket_width(F.col("high")))
    fence = bucket_top(F.col("high")) + F.floor(far * F.col("reach"))
    return per.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, fence)).alias(f"fence_{m}") for m in METRICS])


def base_failed() -> Column:
    return (F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("m.n_words"))


def limits(measures: DataFrame) -> DataFrame:
    """Staged (lang, source, fence per metric) of measured documents; none for groups that fail the base rule as a whole."""
    by_source = stage(sketches(measures.filter(~base_failed()), ["lang", "source"]), "quality-sketch")
    by_lang = merged(by_source, ["lang"])
    by_lang = stage(blended(by_lang, ["lang"], merged(by_source, []), []), "language-sketch")
    return stage(fences(blended(by_source, ["lang", "source"], by_lang, ["lang"]), ["lang", "source"]), "quality-fences")


def with_verdict(measures: DataFrame) -> DataFrame:
    """Adds base_failed, reasons (metrics beyond their fence) and kept to measured documents.

    ``measures`` should be staged: it is read once for the sketches and once for the verdict.
    """
    known = limits(measures)
    judged = with_small(measures, known, known.count(), ["lang", "source"])
    beyond = F.array_compact(F.array(*[F.when(F.col(f"m.{m}") > F.col(f"fence_{m}"), F.lit(m)) for m in METRICS]))
    return judged.withColumn("base_failed", base_failed()).withColumn("reasons", beyond) \
        .withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0)).drop(*[f"fence_{m}" for m in METRICS])


def op2_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    measures = stage(measured(docs).drop("text"), "quality-measures")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return with_verdict(measures).select("doc_id", *[f"m.{c}" for c in base], "base_failed", "kept", F.array_join("reasons", ",").alias("reasons"))


def keep_good(spark, docs, sf_dir):
    """Pipeline stage: the documents whose verdict is kept, with their columns unchanged."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    at = {c: n for n, c in zip(names, docs.columns)}
    held = held.select(*names, *[F.col(at[c]).alias(c) for c in ("text", "lang", "source")])
    measures = stage(measured(held).drop("text"), "quality-measures")
    good = with_verdict(measures).filter("kept")
    return good.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])


def _sql_rates() -> str:
    rate = "CAST(10000 * {} // greatest({}, 1) AS BIGINT) AS {}".format
    return ", ".join([
        rate("n_symbols", "word_chars", "symbol_rate"), rate("n_dup_lines", "n_lines", "dup_line_rate"),
        rate("n_repeat_words", "n_words", "repeat_rate"), rate("n_upper", "word_chars", "upper_rate"),
        "CAST(100 * word_chars // greatest(n_words, 1) AS BIGINT) AS word_length"])


def _sql_blend(name: str, keys: str, own: str, larger: str, shared: str) -> str:
    """Sketches of ``keys`` with a share of the larger group's."""
    on = " AND ".join(["g.metric = l.metric", *[f"g.{k} IS NOT DISTINCT FROM l.{k}" for k in shared.split() if k]])
    return f"""
{name} AS (SELECT {keys}, metric, bucket, sum(n) AS n FROM (SELECT {keys}, metric, bucket, n::DOUBLE AS n FROM {own}
  UNION ALL SELECT {", ".join("g." + k.strip() for k in keys.split(","))}, g.metric, l.bucket, {PRIOR} * l.share FROM (SELECT DISTINCT {keys}, metric FROM {own}) g JOIN
    (SELECT *, n / sum(n) OVER (PARTITION BY {", ".join([*shared.split(), "metric"])}) AS share FROM {larger}) l ON {on}) GROUP BY ALL)"""


def _sql_fences() -> str:
    """A row per source and metric: cumulated counts give the buckets of the two quantiles."""
    top = "((({0} - (CASE WHEN {0} < 64 THEN 0 ELSE {0} // 32 - 1 END) * 32) + 1) << (CASE WHEN {0} < 64 THEN 0 ELSE {0} // 32 - 1 END)) - 1".format
    of = lambda i: "CASE metric " + " ".join(f"WHEN '{m}' THEN {v[i]}" for m, v in METRICS.items()) + " END"
    reached = "seen * (1 + 1e-9) >= total *"
    return f"""
run AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY lang, source, metric) AS total FROM by_source),
spots AS (SELECT lang, source, metric, min(bucket) FILTER ({reached} 0.5) AS mid, min(bucket) FILTER ({reached} {of(0)}) AS high FROM run GROUP BY ALL),
fences AS (SELECT lang, source, metric, {top('high')} + {of(1)} * greatest(({top('high')}) - ({top('mid')}), 1 << (CASE WHEN high < 64 THEN 0 ELSE high // 32 - 1 END)) AS fence FROM spots)"""


RULES_SQL = fr"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(text, '[ 	-
]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM texts),
placed AS (SELECT rid, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM split),
windows AS (SELECT rid, i, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c FROM placed WINDOW p AS (PARTITION BY rid ORDER BY i)),
again AS (SELECT rid, i FROM windows WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
covered AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY rid),
base AS (SELECT rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  length(text) - length(regexp_replace(text, '\p{{Lu}}{{2,}}', '', 'g')) AS n_upper, len(lines) AS n_lines
  FROM split LEFT JOIN covered USING (rid)),
rated AS (SELECT *, {_sql_rates()}, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS failed FROM base),
metrics AS (SELECT rid, lang, source, failed, unnest([{", ".join(f"'{m}'" for m in METRICS)}]) AS metric, unnest([{", ".join(METRICS)}]) AS value FROM rated),
sketch AS (SELECT lang, source, metric, bucket, count(*) AS n FROM (
  SELECT *, (greatest(length(bin(value)) - 6, 0) * 32 + (value >> CAST(greatest(length(bin(value)) - 6, 0) AS BIGINT))) AS bucket FROM metrics WHERE NOT failed) GROUP BY ALL),
of_lang AS (SELECT lang, metric, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
of_all AS (SELECT metric, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
{_sql_blend("by_lang", "lang", "of_lang", "of_all", "")}, {_sql_blend("by_source", "lang, source", "sketch", "by_lang", "lang")}, {_sql_fences()},
judged AS (SELECT rid, string_agg(m.metric, ',' ORDER BY list_position([{", ".join(f"'{m}'" for m in METRICS)}], m.metric)) AS reasons
  FROM metrics m JOIN fences f ON m.metric = f.metric AND m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
  WHERE m.value > f.fence GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
  NOT failed AND reasons IS NULL AS kept, coalesce(reasons, '') AS reasons
FROM rated LEFT JOIN judged USING (rid)"""
