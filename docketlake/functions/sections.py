"""Where a judgment's parts begin and end. Positions count characters from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlake.functions.text import every, may_match, on_lower, opening, rx, sorted_set, strip, try_long

# The marker between header and body, attribution, disposition phrases.
MARKER = r"^\s*(?:J\s*U\s*D\s*G\s*M\s*E\s*N\s*T|O\s*R\s*D\s*E\s*R|JUDGMENT|ORDER)\s*$"
ATTRIBUTION = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,\s*J\.?\s*[:—–-]"
# The same for Java: a run of names is never given back, since no other end of it meets a comma. Without that, a long
# run overflows the stack of its task.
ATTRIBUTION_RUN = ATTRIBUTION.replace("[a-z]+)*,", "[a-z]++)*+,")
DISPOSITION = (
    r"(?:appeal|petition|application|case)\s+is\s+(?:hereby\s+)?(?:dismissed|allowed|disposed)"
    r"|ordered\s+accordingly"
    r"|these?\s+are\s+(?:the\s+)?reasons"
    r"|(?:mfr|m\.?f\.?r\.?)\s*[-–—]\s*(?:islamabad|approved|office)"
    r"|(?:chief\s+justice|judge)\s*$"
)
NUMBERED_PARAGRAPH = r"^\s*(\d{1,3})\.\s"
DISPOSITION_SHARE = 0.7
DISPOSITION_LOOKBACK = 200
# Phrases that open a rhetorical section, first accepted one wins.
RHETORICAL = [
    ("facts", [
        r"(?:brief\s+)?facts\s+(?:of\s+the\s+case|leading\s+to)",
        r"factual\s+(?:background|matrix|narrative)",
        r"prosecution\s+(?:case|story|version)\s+(?:in\s+brief|as\s+set)",
        r"(?:the\s+)?(?:brief|relevant)\s+facts",
    ]),
    ("issues", [
        r"points?\s+(?:of|for)\s+determination",
        r"(?:the\s+)?issues?\s+(?:framed|to\s+be\s+determined|for\s+consideration)",
        r"questions?\s+(?:of\s+law|for\s+consideration|that\s+arise)",
    ]),
    ("petitioner_arguments", [
        r"(?:learned\s+)?counsel\s+for\s+(?:the\s+)?(?:appellant|petitioner|accused)",
        r"arguments?\s+(?:on\s+behalf\s+)?(?:of|by)\s+(?:the\s+)?(?:appellant|petitioner)",
        r"(?:the\s+)?(?:appellant|petitioner)(?:'s)?\s+(?:case|arguments?|submissions?|contentions?)",
    ]),
    ("respondent_arguments", [
        r"(?:learned\s+)?counsel\s+for\s+(?:the\s+)?(?:respondent|state|complainant|prosecution)",
        r"arguments?\s+(?:on\s+behalf\s+)?(?:of|by)\s+(?:the\s+)?(?:respondent|state)",
        r"(?:the\s+)?(?:respondent|state|prosecution)(?:'s)?\s+(?:case|arguments?|submissions?|contentions?)",
    ]),
    ("evidence", [
        r"(?:the\s+)?evidence\s+(?:on\s+record|produced|adduced)",
        r"appraisal\s+of\s+evidence",
        r"(?:the\s+)?(?:prosecution|ocular|documentary)\s+evidence",
        r"examination\s+of\s+(?:witnesses|evidence)",
    ]),
    ("reasoning", [
        r"(?:we\s+have\s+)?(?:heard|considered|examined)\s+(?:the\s+)?(?:learned\s+)?counsel",
        r"(?:our|my)\s+(?:analysis|reasoning|consideration|examination)",
        r"(?:after\s+)?(?:hearing|considering)\s+(?:the\s+)?(?:arguments|submissions)",
        r"(?:I|we)\s+have\s+(?:carefully\s+)?(?:gone\s+through|perused|examined)",
    ]),
    ("order", [
        r"(?:in\s+the\s+)?(?:result|light\s+of\s+(?:the\s+)?above|upshot)",
        r"(?:the\s+)?appeal\s+is\s+(?:accordingly\s+)?(?:allowed|dismissed|disposed)",
        r"(?:for\s+the\s+)?(?:foregoing|above(?:\s+mentioned)?)\s+reasons",
        r"operative\s+(?:part|order|portion)",
        r"order\s*$",
    ]),
]
HEADER_SHARE, HEADER_LIMIT = 7, 3000
LINE_START_LOOKBACK, LINE_START_LIMIT = 50, 30
MIN_SPLIT_TEXT, MIN_PIECE = 200, 50


def cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def paragraph_numbers(text: Column) -> Column:
    return sorted_set(F.transform(every(text, NUMBERED_PARAGRAPH, 1, "m"), try_long))


def before_and_match(text: Column, pattern: str, flags: str) -> tuple[Column, Column]:
    """(text before the first match, the match), both '' when there is none."""
    inline = f"(?{flags}:{pattern})" if flags else f"(?:{pattern})"
    whole = rx(rf"\A(?s:(.*?))({inline})")
    return F.regexp_extract(text, whole, 1), F.regexp_extract(text, whole, 2)


def around_match(text: Column, pattern: str, flags: str) -> Column:
    """[text before the first match, text after it], or [text] when there is none."""
    return F.split(text, rx(pattern, flags), 2)


def rhetorical_start(folded: Column, pattern: str) -> Column:
    """Position of the first match that stands near the start of a line.

    Most often the first match does. Otherwise the matches are walked in order: pieces
    between matches and matches alternate, so positions are running sums, and the last
    50 characters are all that is needed to find the line start. A match far from any
    line feed counts as near only when nothing but a short text precedes it.
    """
    p = rx(f"{opening(on_lower(pattern))}(?:{on_lower(pattern)})", "m")

    def near(seen: Column, before: Column) -> Column:
        near_line = F.length(strip(F.substring_index(seen, "\n", -1))) < LINE_START_LIMIT
        near_top = F.length(strip(before)) < LINE_START_LIMIT
        return F.when(seen.contains("\n"), near_line).otherwise(near_top)

    pieces, hits = F.split(folded, p, -1), F.regexp_extract_all(folded, F.lit(p), F.lit(0))
    steps = F.arrays_zip(pieces.alias("piece"), hits.alias("hit"))
    steps = F.filter(steps, lambda s: s["hit"].isNotNull())

    def step(state: Column, s: Column) -> Column:
        at = state["end"] + F.length(s["piece"])
        seen = F.right(F.concat(state["context"], s["piece"]), F.lit(LINE_START_LOOKBACK))
        accepted = near(seen, F.substring(folded, 1, at))
        return F.when(state["found"].isNotNull(), state).otherwise(
            F.struct(
                (at + F.length(s["hit"])).alias("end"),
                F.right(F.concat(seen, s["hit"]), F.lit(LINE_START_LOOKBACK)).alias("context"),
                F.when(accepted, at).alias("found"),
            )
        )

    start = F.struct(
        F.lit(0).alias("end"), F.lit("").alias("context"), F.lit(None).cast("int").alias("found")
    )

    def from_first(parts: Column) -> Column:
        before = F.get(parts, F.lit(0))
        accepted = near(F.right(before, F.lit(LINE_START_LOOKBACK)), before)
        walked = F.aggregate(steps, start, step)["found"]
        return F.when(F.size(parts) == 2, F.when(accepted, F.length(before)).otherwise(walked))

    # Most texts lack most phrases: they are searched only where the words stand in the text.
    found = F.get(F.transform(F.array(F.split(folded, p, 2)), from_first), F.lit(0))
    return F.when(may_match(folded, pattern), found)


def rhetorical_marks(text: Column, folded: Column) -> Column:
    """Array of (at, rank, name) of the seven sections; null for texts too short to split."""
    long_enough = F.length(strip(text)) >= MIN_SPLIT_TEXT
    marks = F.array(
        *(
            F.struct(
                F.coalesce(*(rhetorical_start(folded, p) for p in patterns)).alias("at"),
                F.lit(rank).alias("rank"),
                F.lit(name).alias("name"),
            )
            for rank, (name, patterns) in enumerate(RHETORICAL)
        )
    )
    return F.when(long_enough, marks)


def pieces_between(text: Column, marks: Column) -> Column:
    """Named texts from each mark to the next; ``marks`` is sorted by position."""
    ends = F.transform(
        marks, lambda m, i: F.coalesce(F.get(marks, i + 1)["at"], F.length(text))
    )
    cuts = F.transform(
        marks,
        lambda m, i: F.struct(
            m["name"].alias("name"), strip(cut(text, m["at"], F.get(ends, i))).alias("text")
        ),
    )
    return F.filter(cuts, lambda c: F.length(c["text"]) > MIN_PIECE)


def header_piece(text: Column) -> Column:
    header_end = F.least(F.floor(F.length(text) / HEADER_SHARE).cast("int"), F.lit(HEADER_LIMIT))
    return F.when(
        F.length(strip(text)) >= MIN_SPLIT_TEXT, strip(F.substring(text, F.lit(1), header_end))
    ).otherwise(strip(text))
