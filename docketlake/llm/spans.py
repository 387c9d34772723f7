"""Where a pattern matches in a text, in code points, with expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlake.llm.common import let

BLOCK = 256


def located(text: Column, pattern: str, around: int = 24) -> Column:
    """Array of (start, end, match, before, after): leftmost non-overlapping matches, ``around`` characters on each side.

    The pieces between matches and the matches themselves give the positions by running sums,
    built in blocks so that texts with very many matches stay cheap.
    """
    zero = F.lit(0).cast("bigint")
    one, many = "array<struct<start:bigint,end:bigint>>", "array<array<struct<start:bigint,end:bigint>>>"

    def of(gaps: Column, hits: Column) -> Column:
        def add(s: Column, i: Column) -> Column:
            return let(s["at"] + F.length(F.get(gaps, i)), lambda start: let(start + F.length(F.get(hits, i)), lambda end: F.struct(
                end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))))

        def block(s: Column, b: Column) -> Column:
            inside = F.sequence(b, F.least(b + BLOCK, F.size(hits)) - 1)
            return let(F.aggregate(inside, F.struct(s["at"].alias("at"), F.array().cast(one).alias("out")), add),
                       lambda r: F.struct(r["at"].alias("at"), F.concat(s["out"], F.array(r["out"])).alias("out")))

        blocks = F.sequence(F.lit(0), F.size(hits) - 1, F.lit(BLOCK))
        places = F.flatten(F.aggregate(blocks, F.struct(zero.alias("at"), F.array().cast(many).alias("out")), block)["out"])
        tail = lambda g: F.substr(g, F.greatest(F.length(g) - around, F.lit(0)) + 1)
        return F.transform(places, lambda p, i: F.struct(
            p["start"].alias("start"), p["end"].alias("end"), F.get(hits, i).alias("match"),
            tail(F.get(gaps, i)).alias("before"), F.substr(F.get(gaps, i + 1), F.lit(1), F.lit(around)).alias("after")))

    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(hits, lambda h: F.when(F.size(h) > 0, let(F.split(text, pattern, -1), lambda g: of(g, h))).otherwise(none))
