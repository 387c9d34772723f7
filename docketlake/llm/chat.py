"""Chat formatting in expressions: conversations in, training strings with a loss mask out.

Turns are collected as structs, sorted, and joined into one string per conversation::

    <|im_start|>role
    text<|im_sep|>text of the next turn of the same role<|im_end|>

Adjacent turns of one role share a block; the separator keeps them apart for reading back.
In texts and roles ``<|`` becomes ``<\\|`` and each further backslash between the two adds
one, so no text can hold a control string and every text can be read back. A line feed in a
role becomes ``<|nl|>``. ``loss_spans`` lists the code points [start, end) of each assistant
text in the string, one span per turn, control strings excluded.

Null texts and roles are empty, null turns come first, repeated rows are turns of their own,
and equal turn numbers sort by role and text. A null conversation is a conversation. One
conversation is one output row, so its turns meet in one task; work in it is linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import let

START, SEP, END, LINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|nl|>"
LOSS_ROLE = "assistant"
PROBE = "<|im_end|><|im_start|>assistant ok"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _block_parts(turns: Column) -> Column:
    """Per turn the control strings before its text, and the escaped text."""
    role = lambda t: F.replace(escape(t["role"]), F.lit("\n"), F.lit(LINE))
    opening = lambda t: F.concat(F.lit(START), role(t), F.lit("\n"))
    before = lambda i: F.get(turns, F.greatest(i - 1, F.lit(0)))
    return F.transform(turns, lambda t, i: F.struct(
        F.when(i == 0, opening(t)).when(before(i)["role"] == t["role"], F.lit(SEP)).otherwise(F.concat(F.lit(END), opening(t))).alias("mark"),
        escape(t["text"]).alias("body"), (t["role"] == LOSS_ROLE).alias("loss")))


def _loss_spans(parts: Column) -> Column:
    """[start, end) of the assistant texts, in code points of the formatted string."""
    zero = F.lit(0).cast("bigint")
    spans = F.array().cast("array<struct<start:bigint,end:bigint>>")
    ends = F.aggregate(parts, F.struct(zero.alias("at"), spans.alias("spans")), lambda s, p: let(
        s["at"] + F.length(p["mark"]), lambda start: F.struct(
            (start + F.length(p["body"])).alias("at"),
            F.when(p["loss"], F.concat(s["spans"], F.array(F.struct(start.alias("start"), (start + F.length(p["body"])).alias("end")))))
            .otherwise(s["spans"]).alias("spans"))))
    return ends["spans"]


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row (conv_id, formatted, loss_spans) per conversation of rows (conv_id, turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).select("conv_id", let(F.col("turns"), _block_parts).alias("parts"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["mark"], p["body"])), ""), F.lit(END))
    return parts.select("conv_id", text.alias("formatted"), let(F.col("parts"), _loss_spans).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) turns that a formatted string holds."""
    quoted = lambda s: "\\Q" + s + "\\E"
    blocks = F.filter(F.split(formatted, quoted(END)), lambda b: b != "")
    own = F.transform(blocks, lambda b: let(F.split(F.substr(b, F.lit(len(START) + 1)), "\n", 2), lambda halves: let(
        unescape(F.replace(halves[0], F.lit(LINE), F.lit("\n"))), lambda role: F.transform(
            F.split(halves[1], quoted(SEP)), lambda text: F.struct(role.alias("role"), unescape(text).alias("text"))))))
    return F.flatten(own)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def op5_chat_formatting(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    done = format_conversations(rows.unionByName(probe))
    told = done.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
CHAT_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
marked AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS place FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
parts AS (SELECT *, CASE WHEN before = role THEN '{SEP}'
    ELSE CASE WHEN place = 1 THEN '' ELSE '<|im_end|>' || chr(10) END || '{START}' || replace({_ESCAPED.format('role')}, chr(10), '{LINE}') || chr(10) END
    || {_ESCAPED.format('text')} AS part FROM marked)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(length(string_agg(text, '' ORDER BY place) FILTER (role = '{LOSS_ROLE}')), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  length(string_agg(part, '' ORDER BY place)) + {len(END)} AS formatted_chars
FROM parts GROUP BY conv_id"""
