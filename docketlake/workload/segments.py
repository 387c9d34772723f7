"""Sections, chunks and truncation."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlake.functions import sections as S
from docketlake.functions.text import truncate_middle
from docketlake.operators import segmentation as G
from docketlake.workload import duck as Q
from docketlake.workload import judgments as J
from docketlake.workload.tables import table

# Lowered from 100,000 so that the long path runs on these texts.
LONG = 4000
# Limit, kept head, kept tail and marker of each pass.
TRUNCATIONS = {
    "classify": (25_000, 12_000, 12_000, "\n\n[...MIDDLE SECTION OMITTED...]\n\n"),
    "passages": (30_000, 15_000, 15_000, "\n\n[...MIDDLE SECTION OMITTED...]\n\n"),
    "points": (30_000, 18_000, 12_000, "\n\n[...MIDDLE SECTION OMITTED FOR LENGTH...]\n\n"),
    "summary": (12_000, 8_000, 4_000, "\n\n[...middle truncated...]\n\n"),
}
NUMBERED_SQL = "replace(text, chr(10), chr(10) || (doc_id % 90 + 1)::VARCHAR || '. ')"


def numbered_documents(spark, sf_dir):
    """Documents whose lines are numbered paragraphs, some behind a marker line."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    number = F.concat(F.lit("\n"), (F.col("doc_id") % 90 + 1).cast("string"), F.lit(". "))
    body = F.replace(F.col("text"), F.lit("\n"), number)
    marked = F.concat(F.lit("In the matter\nJUDGMENT\n"), body, F.lit("\nThe appeal is dismissed.\nJudge\n"))
    return docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, marked).otherwise(body).alias("text"))


def sections(spark, sf_dir):
    rows = G.sections(J.judgments(spark, sf_dir).select("judgment_id", "text"))
    return rows.select(
        "judgment_id", "section_type", F.md5("text").alias("digest"), "start_char", "end_char",
        F.array_join(F.col("paragraph_numbers").cast("array<string>"), ",").alias("paragraphs"),
    )


def _cut(pattern: str, flags: str, group: int, source: str) -> str:
    return f"regexp_extract({source}, '(?s)\\A(.*?)((?{flags}-s:{pattern}))', {group})"


_SPACE = r"'^\s+|\s+$'"
SECTIONS_SQL = f"""WITH t AS (SELECT judgment_id, regexp_replace(text, {_SPACE}, '', 'g') AS t FROM ({J.SQL})),
m AS (SELECT *, {_cut(S.MARKER, 'm', 2, 't')} AS g2, length({_cut(S.MARKER, 'm', 1, 't')}) AS a1,
   {_cut(S.ATTRIBUTION, 'm', 2, 't')} AS h2, length({_cut(S.ATTRIBUTION, 'm', 1, 't')}) AS b1 FROM t),
e AS (SELECT judgment_id, t, CASE WHEN g2 <> '' THEN a1 WHEN h2 <> '' THEN b1 ELSE 0 END AS ms,
   CASE WHEN g2 <> '' THEN a1 + length(g2) WHEN h2 <> '' THEN b1 ELSE 0 END AS me FROM m),
f AS (SELECT *, greatest(me, floor(length(t) * 0.7::DOUBLE)::BIGINT) AS sf FROM e),
d AS (SELECT *, CASE WHEN {_cut(S.DISPOSITION, 'im', 2, 't[sf + 1:]')} <> '' THEN sf + length({_cut(S.DISPOSITION, 'im', 1, 't[sf + 1:]')}) END AS ap FROM f),
w AS (SELECT *, t[greatest(me, ap - 200) + 1:ap] AS win FROM d),
x AS (SELECT *, nullif(CASE WHEN contains(win, chr(10)) THEN ap - length(string_split(win, chr(10))[-1]) ELSE ap END, 0) AS ds FROM w),
p AS (SELECT judgment_id, t, 'header' AS section_type, 0 AS s, me AS e FROM x WHERE ms > 0 UNION ALL
   SELECT judgment_id, t, 'body', me, coalesce(ds, length(t)) FROM x UNION ALL
   SELECT judgment_id, t, 'disposition', ds, length(t) FROM x WHERE ds < length(t)),
r AS (SELECT judgment_id, section_type, t[s + 1:e] AS raw, s FROM p),
q AS (SELECT judgment_id, section_type, regexp_replace(raw, {_SPACE}, '', 'g') AS text, s + length(regexp_extract(raw, '^\\s*')) AS st FROM r)
SELECT judgment_id, section_type, md5(text) AS digest, st::INT AS start_char, (st + length(text))::INT AS end_char,
  CASE WHEN section_type = 'body' THEN coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?m)^\\s*(\\d{{1,3}})\\.\\s', 1), lambda n: n::BIGINT))), ','), '') ELSE '' END AS paragraphs
FROM q WHERE text <> ''"""


def paragraph_numbers(spark, sf_dir):
    docs = numbered_documents(spark, sf_dir)
    return docs.select("doc_id", F.array_join(S.paragraph_numbers(F.col("text")).cast("array<string>"), ",").alias("paragraphs"))


def rhetorical_sections(spark, sf_dir):
    docs = G.rhetorical_map(J.judgments(spark, sf_dir).select("judgment_id", "text"))
    rows = docs.select("judgment_id", F.explode_outer("parts").alias("section", "piece"))
    return rows.select("judgment_id", "section", F.length("piece").alias("chars"), F.md5("piece").alias("digest"))


def chunks(spark, sf_dir):
    docs = numbered_documents(spark, sf_dir)
    return G.chunks(docs.withColumn("summary", F.lit("A case. ")), summary="summary", single_limit=LONG)


def chunk_invariants(spark, sf_dir):
    """Per document: chunks are dense, start at 0, end at the end, and leave no gap."""
    rows = G.chunks(numbered_documents(spark, sf_dir), single_limit=LONG)
    return rows.groupBy("doc_id").agg(
        (F.count("*") == F.max("total_chunks")).alias("complete"),
        (F.max("chunk_index") == F.max("total_chunks") - 1).alias("dense"),
        F.min("char_start").alias("first_char"),
        F.max("char_end").alias("last_char"),
        (F.sum(F.col("char_end") - F.col("char_start")) >= F.max("char_end") - 2 * F.max("total_chunks")).alias("covered"),
    )


def truncations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    long = F.repeat(F.col("text"), 3)
    return docs.select(
        "doc_id", *(F.md5(truncate_middle(long, *rule)).alias(name) for name, rule in TRUNCATIONS.items())
    )


def _truncate_sql(limit: int, keep_head: int, keep_tail: int, marker: str) -> str:
    marker = Q.lit(marker).replace("\n", "' || chr(10) || '")
    return f"md5(CASE WHEN length(t) > {limit} THEN left(t, {keep_head}) || {marker} || right(t, {keep_tail}) ELSE t END)"


def _rhetorical_sql() -> str:
    """Matches unnested with running positions, then the same acceptance and order."""
    found = " UNION ALL ".join(
        f"""SELECT judgment_id, text, {rank} AS rank, '{name}' AS name, {n} AS pat, unnest(generate_series(1, len(m))) AS i, m, s FROM
        (SELECT judgment_id, text, regexp_extract_all(text, {Q.re2(p, 'im')}) AS m, regexp_split_to_array(text, {Q.re2(p, 'im')}) AS s FROM t)"""
        for rank, (name, patterns) in enumerate(S.RHETORICAL)
        for n, p in enumerate(patterns)
    )
    long = f"length({Q.strip('text')}) >= {S.MIN_SPLIT_TEXT}"
    size = "list_sum(list_transform({}, lambda x: length(x)))"
    return f"""WITH t AS (SELECT judgment_id, text FROM ({J.SQL})),
f AS ({found}),
p AS (SELECT judgment_id, text, rank, name, pat, i, ({size.format('s[1:i]')} + coalesce({size.format('m[1:i - 1]')}, 0))::BIGINT AS pos FROM f),
w AS (SELECT *, text[greatest(pos - {S.LINE_START_LOOKBACK}, 0) + 1:pos] AS seen FROM p),
a AS (SELECT * FROM w WHERE length({Q.strip("CASE WHEN contains(seen, chr(10)) THEN string_split(seen, chr(10))[-1] ELSE text[1:pos] END")}) < {S.LINE_START_LIMIT}),
o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY judgment_id, name ORDER BY pat, i) = 1),
c AS (SELECT judgment_id, name AS section, trim(text[pos + 1:coalesce(lead(pos) OVER (PARTITION BY judgment_id ORDER BY pos, rank), length(text))], {Q.SPACES}) AS piece FROM o WHERE {long}),
r AS (SELECT judgment_id, 'full_text' AS section, text AS piece FROM t UNION ALL
  SELECT judgment_id, 'header', {Q.strip(f"CASE WHEN {long} THEN left(text, least(length(text) // {S.HEADER_SHARE}, {S.HEADER_LIMIT})) ELSE text END")} FROM t UNION ALL
  SELECT * FROM c WHERE length(piece) > {S.MIN_PIECE})
SELECT judgment_id, section, length(piece) AS chars, md5(piece) AS digest FROM r"""


_MARKED_SQL = f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'In the matter' || chr(10) || 'JUDGMENT' || chr(10) || {NUMBERED_SQL} ||
  chr(10) || 'The appeal is dismissed.' || chr(10) || 'Judge' || chr(10) ELSE {NUMBERED_SQL} END AS text FROM documents"""
QUERIES = {
    "sections": sections,
    "paragraph_numbers": paragraph_numbers,
    "rhetorical_sections": rhetorical_sections,
    "chunks": chunks,
    "chunk_invariants": chunk_invariants,
    "truncations": truncations,
}
ORACLES = {
    "sections": SECTIONS_SQL,
    "rhetorical_sections": _rhetorical_sql(),
    "paragraph_numbers": rf"""SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(
      regexp_extract_all(text, '(?m)^\s*(\d{{1,3}})\.\s', 1), lambda n: n::BIGINT))), ','), '') AS paragraphs FROM ({_MARKED_SQL})""",
    "chunk_invariants": f"""SELECT doc_id, true AS complete, true AS dense, 0 AS first_char, length({Q.strip('text')})::INT AS last_char,
      true AS covered FROM ({_MARKED_SQL}) WHERE {Q.strip('text')} <> ''""",
    "truncations": f"SELECT doc_id, {', '.join(f'{_truncate_sql(*rule)} AS {name}' for name, rule in TRUNCATIONS.items())} FROM (SELECT doc_id, repeat(text, 3) AS t FROM documents)",
}
