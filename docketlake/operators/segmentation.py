"""Structural sections, rhetorical sections and chunks. All narrow: no shuffle.

A document is one row, so its sections and chunks are built inside that row with
array expressions and exploded at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions import sections as S
from docketlake.functions.text import WHITESPACE, fold, is_blank, on_lower, rx, strip

# Sizes in characters.
SINGLE_LIMIT = 100_000
TARGET = 2048
OVERLAP = 256
MIN_CHUNK = 200
PARAGRAPH_BOUNDARY = r"\n\s*(?=\d{1,3}\.\s)"
# A noncharacter marks paragraph starts; it cannot occur in valid text.
_MARK = "\ufdd0"


_SECTIONS_TYPE = (
    "array<struct<section_type:string,text:string,paragraph_numbers:array<bigint>,"
    "start_char:int,end_char:int>>"
)
_KINDS = ["header", "body", "disposition"]


def with_sections(docs: DataFrame, text: str = "text", into: str = "sections") -> DataFrame:
    """Adds array ``into`` of (section_type, text, paragraph_numbers, start_char, end_char).

    Header up to the marker, body, and the disposition found in the last 30 %.
    Offsets count from the start of the stripped text. Blank texts have no sections.
    Intermediate values are plain columns, each computed once: a struct would be
    taken apart again and its expression repeated for every field read.
    """
    p = f"__{into}_"

    def c(name: str) -> Column:
        return F.col(p + name)

    def add(df: DataFrame, **columns: Column) -> DataFrame:
        return df.withColumns({p + name: value for name, value in columns.items()})

    df = add(docs, whole=F.when(~is_blank(F.col(text)), strip(F.col(text))))
    df = add(df, marked=S.around_match(c("whole"), S.MARKER, "m"), size=F.length(c("whole")))
    # The attribution is looked for only where there is no marker.
    unmarked = F.when(F.size(c("marked")) == 1, c("whole"))
    df = add(df, attributed=S.around_match(unmarked, S.ATTRIBUTION_RUN, ""))
    start = F.when(F.size(c("marked")) == 2, F.length(F.get(c("marked"), F.lit(0)))).when(
        F.size(c("attributed")) == 2, F.length(F.get(c("attributed"), F.lit(0)))
    ).otherwise(F.when(c("whole").isNotNull(), 0))
    behind = F.when(F.size(c("marked")) == 2, c("size") - F.length(F.get(c("marked"), F.lit(1))))
    df = add(df, start=start)
    df = add(df, end=F.coalesce(behind, c("start")))
    df = add(df, search_from=F.greatest(c("end"), (c("size") * F.lit(S.DISPOSITION_SHARE)).cast("int")))
    searched = fold(S.cut(c("whole"), c("search_from"), c("size")))
    df = add(df, disposed=S.around_match(searched, on_lower(S.DISPOSITION), "m"))
    df = add(df, at=F.when(F.size(c("disposed")) == 2, c("search_from") + F.length(F.get(c("disposed"), F.lit(0)))))
    df = add(df, window=S.cut(c("whole"), F.greatest(c("end"), c("at") - S.DISPOSITION_LOOKBACK), c("at")))
    line_start = F.when(
        c("window").contains("\n"), c("at") - F.length(F.substring_index(c("window"), "\n", -1))
    ).otherwise(c("at"))
    # Position 0 counts as "none": the body is then the whole text.
    df = add(df, tail=F.when(line_start != 0, line_start))
    df = add(
        df,
        raw_header=F.when(c("start") > 0, S.cut(c("whole"), F.lit(0), c("end"))),
        raw_body=S.cut(c("whole"), c("end"), F.coalesce(c("tail"), c("size"))),
        raw_disposition=F.when(c("tail") < c("size"), S.cut(c("whole"), c("tail"), c("size"))),
        from_header=F.lit(0),
        from_body=c("end"),
        from_disposition=c("tail"),
    )
    df = add(df, **{f"text_{k}": strip(c(f"raw_{k}")) for k in _KINDS})
    df = add(
        df,
        **{
            f"at_{k}": c(f"from_{k}") + F.length(c(f"raw_{k}")) - F.length(F.ltrim(c(f"raw_{k}"), F.lit(WHITESPACE)))
            for k in _KINDS
        },
    )

    def section(kind: str, body: Column, start: Column, numbered: bool) -> Column:
        numbers = S.paragraph_numbers(body) if numbered else F.array().cast("array<bigint>")
        return F.struct(
            F.lit(kind).alias("section_type"),
            body.alias("text"),
            numbers.alias("paragraph_numbers"),
            start.cast("int").alias("start_char"),
            (start + F.length(body)).cast("int").alias("end_char"),
        )

    parts = F.array(
        *(
            F.when(c(f"text_{k}") != "", section(k, c(f"text_{k}"), c(f"at_{k}"), k == "body"))
            for k in _KINDS
        )
    )
    df = add(df, found=F.array_compact(parts))
    everything = F.array(section("body", c("whole"), F.lit(0), True))
    value = (
        F.when(c("whole").isNull(), F.array().cast(_SECTIONS_TYPE))
        .when(F.size(c("found")) > 0, c("found"))
        .otherwise(everything)
    )
    return df.select(*(F.col(name) for name in docs.columns), value.alias(into))


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per section."""
    keep = [F.col(name) for name in docs.columns if name != text]
    # Outer, then a test on the result: for a plain inline Spark would copy the whole
    # section expression into a filter below it.
    rows = with_sections(docs, text, "section").select(*keep, F.inline_outer("section"))
    return rows.filter(F.col("section_type").isNotNull())


def rhetorical_map(docs: DataFrame, text: str = "text", into: str = "parts") -> DataFrame:
    """Adds map ``into`` of section name → text (facts, issues, …, order)."""
    c, p = F.col, f"__{into}_"
    source = F.coalesce(c(text), F.lit(""))
    staged = docs.withColumn(p + "text", source).withColumn(p + "low", fold(c(p + "text")))
    staged = staged.withColumn(p + "marks", S.rhetorical_marks(c(p + "text"), c(p + "low")))
    marks = F.array_sort(F.filter(c(p + "marks"), lambda m: m["at"].isNotNull()))
    staged = staged.withColumn(p + "sorted", marks)
    named = F.coalesce(
        S.pieces_between(c(p + "text"), c(p + "sorted")),
        F.array().cast("array<struct<name:string,text:string>>"),
    )
    always = F.array(
        F.struct(F.lit("full_text").alias("name"), c(p + "text").alias("text")),
        F.struct(F.lit("header").alias("name"), S.header_piece(c(p + "text")).alias("text")),
    )
    return staged.withColumn(into, F.map_from_entries(F.concat(always, named))).drop(
        p + "text", p + "low", p + "marks", p + "sorted"
    )


# ── Chunks ────────────────────────────────────────────────────────────────

_PIECE = "struct<raw:string,start:int,end:int>"


def _piece(raw: Column, start: Column, end: Column) -> Column:
    return F.struct(raw.alias("raw"), start.alias("start"), end.alias("end"))


def _overlap(reach: Column) -> Column:
    """What the next chunk repeats of ``reach``, the last 256 characters packed.

    From a paragraph start, else after the last sentence end, else all of it.
    """
    # The next paragraph starts with a line feed, which may complete the last number.
    before, match = S.before_and_match(F.concat(reach, F.lit("\n")), PARAGRAPH_BOUNDARY, "")
    ahead = F.when(match != "", F.length(before))
    after_sentence = F.length(reach) - F.length(F.substring_index(reach, ". ", -1))
    return (
        F.when(ahead.isNotNull(), S.cut(reach, ahead, F.length(reach)))
        .when(reach.contains(". ") & (after_sentence > 2), S.cut(reach, after_sentence, F.length(reach)))
        .otherwise(reach)
    )


def _flush(chunks: Column, open_chunk: Column) -> Column:
    """Close the open chunk; a tiny one extends the chunk before it."""
    size = F.length(strip(open_chunk["raw"]))
    last = F.element_at(chunks, -1)
    beyond = open_chunk["end"] - last["end"]
    merged = _piece(
        F.concat(last["raw"], F.right(open_chunk["raw"], beyond)), last["start"], open_chunk["end"]
    )
    rest = F.slice(chunks, F.lit(1), F.size(chunks) - 1)
    return (
        F.when(size == 0, chunks)
        .when((size >= MIN_CHUNK) | (F.size(chunks) == 0), F.concat(chunks, F.array(open_chunk)))
        .otherwise(F.concat(rest, F.array(merged)))
    )


def _pack(text: Column, base: Column) -> Column:
    """Paragraphs of a long span packed greedily to about 2,048 characters."""
    marked = F.regexp_replace(text, rx(PARAGRAPH_BOUNDARY), _MARK + "$0")
    paragraphs = F.filter(F.split(marked, _MARK, -1), lambda x: F.length(x) > 0)

    def add(state: Column, para: Column) -> Column:
        current = state["current"]
        end = current["end"] + F.length(para)
        full = (F.length(current["raw"]) > 0) & (
            F.length(current["raw"]) + F.length(para) > TARGET
        )
        repeated = _overlap(state["reach"])
        restarted = _piece(
            F.concat(repeated, para), current["end"] - F.length(repeated), end
        )
        extended = _piece(F.concat(current["raw"], para), current["start"], end)
        return F.struct(
            F.when(full, _flush(state["chunks"], current)).otherwise(state["chunks"]).alias("chunks"),
            F.when(full, restarted).otherwise(extended).alias("current"),
            F.right(F.concat(state["reach"], para), F.lit(OVERLAP)).alias("reach"),
        )

    start = F.struct(
        F.array().cast(f"array<{_PIECE}>").alias("chunks"),
        _piece(F.lit(""), base, base).alias("current"),
        F.lit("").alias("reach"),
    )
    return F.aggregate(paragraphs, start, add, lambda s: _flush(s["chunks"], s["current"]))


_CHUNK = "struct<raw:string,start:int,end:int,section_type:string>"


def _chunk(raw: Column, start: Column, end: Column, kind: Column) -> Column:
    return F.struct(
        raw.alias("raw"), start.alias("start"), end.alias("end"), kind.alias("section_type")
    )


def _split_sections(whole: Column, sections: Column) -> Column:
    """Chunks of a long text: tiny sections join the next one, or the last chunk."""

    def add(state: Column, section: Column) -> Column:
        start = F.coalesce(state["pending_start"], section["start_char"])
        end = section["end_char"]
        span = S.cut(whole, start, end)
        size = F.length(strip(span))
        kind = section["section_type"]
        split = F.transform(
            _pack(strip(span), start), lambda x: _chunk(x["raw"], x["start"], x["end"], kind)
        )
        made = F.when(size <= TARGET, F.array(_chunk(span, start, end, kind))).otherwise(split)
        tiny = size < MIN_CHUNK
        return F.struct(
            F.when(tiny, state["chunks"]).otherwise(F.concat(state["chunks"], made)).alias("chunks"),
            F.when(tiny, start).alias("pending_start"),
            F.when(tiny, end).alias("pending_end"),
        )

    def finish(state: Column) -> Column:
        last = F.element_at(state["chunks"], -1)
        start = F.coalesce(last["start"], state["pending_start"])
        merged = _chunk(
            S.cut(whole, start, state["pending_end"]),
            start,
            state["pending_end"],
            F.coalesce(last["section_type"], F.lit("body")),
        )
        rest = F.when(
            F.size(state["chunks"]) > 1,
            F.slice(state["chunks"], F.lit(1), F.size(state["chunks"]) - 1),
        ).otherwise(F.array().cast(f"array<{_CHUNK}>"))
        return F.when(state["pending_start"].isNull(), state["chunks"]).otherwise(
            F.concat(rest, F.array(merged))
        )

    begin = F.struct(
        F.array().cast(f"array<{_CHUNK}>").alias("chunks"),
        F.lit(None).cast("int").alias("pending_start"),
        F.lit(None).cast("int").alias("pending_end"),
    )
    return F.aggregate(sections, begin, add, finish)


def with_summary(text: Column, summary: Column | None) -> Column:
    if summary is None:
        return text
    prefix = F.concat(F.lit("[Summary: "), strip(summary), F.lit("]\n\n"))
    return F.when(F.coalesce(summary, F.lit("")) == "", text).otherwise(F.concat(prefix, text))


def with_chunks(
    docs: DataFrame, text: str = "text", into: str = "chunks", single_limit: int = SINGLE_LIMIT
) -> DataFrame:
    """Adds array ``into`` of (raw, start, end, section_type); empty for blank texts.

    Texts up to ``single_limit`` are one chunk; longer ones are split at numbered
    paragraphs within their sections. Only the long rows pay for section parsing and
    packing: those expressions see null for the others.
    """
    c = F.col
    base = docs.withColumn("__whole", F.when(~is_blank(c(text)), strip(c(text))))
    whole = c("__whole")
    long = F.length(whole) > single_limit
    base = with_sections(base.withColumn("__long", F.when(long, whole)), "__long", "__sections")
    single = F.array(_chunk(whole, F.lit(0), F.length(whole), F.lit("body")))
    made = (
        F.when(whole.isNull(), F.array().cast(f"array<{_CHUNK}>"))
        .when(long, _split_sections(whole, c("__sections")))
        .otherwise(single)
    )
    return base.withColumn(into, made).drop("__whole", "__long", "__sections")


def chunks(
    docs: DataFrame, text: str = "text", summary: str | None = None, single_limit: int = SINGLE_LIMIT
) -> DataFrame:
    """One row per chunk, every other column carried along. Offsets index the
    stripped text; blank texts give none."""
    c = F.col
    keep = [c(name) for name in docs.columns if name != text]
    base = with_chunks(docs, text, "__chunks", single_limit)
    rows = base.select(
        *keep, F.size("__chunks").alias("total_chunks"),
        F.posexplode_outer("__chunks").alias("chunk_index", "__c"),
    ).filter(c("__c").isNotNull())
    prefix = None if summary is None else c(summary)
    return rows.select(
        *keep,
        "chunk_index",
        "total_chunks",
        c("__c.section_type"),
        c("__c.start").alias("char_start"),
        c("__c.end").alias("char_end"),
        with_summary(strip(c("__c.raw")), prefix).alias("text"),
    )
