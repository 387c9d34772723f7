"""String building blocks shared by every parser: spans, trimming, regex dialect."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain word, or a word and the pattern behind it.
type Head = str | tuple[str, str]
# The characters a Unicode-aware strip removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def rx(pattern: str, flags: str = "") -> str:
    """Java form of a pattern: Unicode classes, only a line feed ends a line.

    ``flags`` takes ``i`` (ignore case), ``m`` (anchors at lines), ``s`` (dot
    matches line feeds).
    """
    return f"(?dU{flags}){pattern}"


def fold(text: Column) -> Column:
    """Lower case, character for character: positions stay, and a letter meets every form a regex that ignores case gives it."""
    plain = text
    for odd, letter in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")):
        plain = F.replace(plain, F.lit(odd), F.lit(letter))
    return F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(plain))


@cache
def required_words(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Words of a match, lower-cased: of each tuple at least one stands in every text that matches."""

    def weakest(words: tuple[str, ...]) -> int:
        return min(map(len, words), default=0)

    def walk(items) -> list[tuple[str, ...]]:
        found, run = [], ""
        for kind, value in [*items, (None, None)]:
            if kind is _parser.LITERAL:
                run += chr(value).lower()
                continue
            found, run = found + [(run,)], ""
            if kind is _parser.SUBPATTERN:
                found += walk(value[3])
            elif kind in (_parser.MAX_REPEAT, _parser.MIN_REPEAT, _parser.POSSESSIVE_REPEAT) and value[0] > 0:
                found += walk(value[2])
            elif kind is _parser.BRANCH:
                best = [max(walk(arm), key=weakest) for arm in value[1]]
                found.append(tuple(dict.fromkeys(word for words in best for word in words)))
        return found

    return tuple(dict.fromkeys(words for words in walk(_parser.parse(pattern)) if weakest(words) > 1))


@cache
def opening(pattern: str) -> str:
    """Lookahead for the first two letters of a match, '' where the pattern leaves them open.

    It changes no match: one look at two letters stands before the alternatives, which
    would otherwise all be tried at every character.
    """

    def starts(items: list) -> set[str] | None:
        kind, value = items[0] if items else (None, None)
        if kind is _parser.LITERAL and len(items) > 1 and items[1][0] is _parser.LITERAL:
            two = chr(value) + chr(items[1][1])
            return {two} if two.isascii() and two.isalnum() else None
        if kind is _parser.SUBPATTERN and not value[1] and not value[2]:
            return starts([*value[3], *items[1:]])
        if kind is _parser.BRANCH:
            arms = [[*arm, *items[1:]] for arm in value[1]]
        elif kind is _parser.MAX_REPEAT and tuple(value[:2]) == (0, 1):
            arms = [[*value[2], *items[1:]], items[1:]]
        else:
            return None
        found = [starts(arm) for arm in arms]
        return None if None in found else set().union(*found)

    pairs = starts(list(_parser.parse(pattern))) or set()
    letters = ("".join(sorted({pair[i] for pair in pairs})) for i in (0, 1))
    return "(?=[{}][{}])".format(*letters) if len(pairs) > 1 else ""


def may_match(folded: Column, pattern: str) -> Column:
    """Whether a folded text holds the words a match needs: a search for plain words is far cheaper than a regex.

    Each word is a pass over the text, so the longest come first and short ones only where there is no other.
    """
    groups = sorted(required_words(pattern), key=lambda words: (len(words), -min(map(len, words))))
    test = F.lit(True)
    for words in [words for words in groups if min(map(len, words)) > 3] or groups:
        test = test & contains_any(folded, *words)
    return test


def first(text: Column, pattern: str, group: int = 1, flags: str = "", within: Column | None = None) -> Column:
    """Group of the first match, null when there is none.

    The match takes the rest of the text with it, so that the list of all matches ends
    there. Unlike a comparison with '', a list names the expression once: nested uses
    stay small and nothing is matched twice.
    """
    held = f"({pattern})" if group == 0 else f"(?:{pattern})"
    ahead = "" if "i" in flags or within is None else opening(pattern)
    return F.get(every(text, ahead + held + "(?s:.*)", max(group, 1), flags, within), F.lit(0))


def first_at(text: Column, heads: Sequence[Head], tail: str, group: int = 1, flags: str = "", folded: Column | None = None) -> Column:
    """Group of the first match of ``(?:head|…)tail``, null when there is none.

    ``heads`` are plain words, or pairs of one and what follows it, without groups; no head
    begins within another, and the tail is never empty. A pattern that begins with a plain word
    is found by skipping, so each head is looked for by itself, and the longest rest of the text wins.
    With ``folded``, the folded text, case is ignored: the heads are lower-cased, and the
    place found in the folded text is that in the text. A few letters fold into a class that does
    not hold them in the text; if the place fails for one, the whole text is searched.
    """
    pairs = [(head, "") if isinstance(head, str) else head for head in heads]
    pattern = rf"(?:{'|'.join(re.escape(word) + more for word, more in pairs)}){tail}"
    all_flags = flags + ("" if folded is None else "i")
    searched = text if folded is None else folded
    form = str if folded is None else on_lower
    tail = f"(?{flags}:{form(tail)})" if flags else form(tail)

    def rest(word: str, more: str) -> Column:
        found = F.regexp_extract(searched, rx(f"{re.escape(word)}({form(more)}{tail}(?s:.*))"), 1)
        return F.struct(F.coalesce(found, F.lit("")).alias("rest"), F.lit(len(word)).alias("word"))

    def at(best: Column) -> Column:
        found = first(F.right(text, F.length(best["rest"]) + best["word"]), rf"\A{pattern}", group, all_flags)
        return found if folded is None else F.coalesce(found, first(text, pattern, group, all_flags))

    return F.aggregate(
        F.array(*(rest(word, more) for word, more in pairs)),
        F.struct(F.lit("").alias("rest"), F.lit(0).alias("word")),
        lambda best, found: F.when(F.length(found["rest"]) > F.length(best["rest"]), found).otherwise(best),
        lambda best: F.when(best["rest"] != "", at(best)),
    )


def every(text: Column, pattern: str, group: int = 1, flags: str = "", within: Column | None = None) -> Column:
    """Group of all matches, in text order.

    With ``within``, the folded text or a folded longer one, texts that lack a word
    every match has are not searched.
    """
    found = F.regexp_extract_all(text, F.lit(rx(pattern, flags)), F.lit(group))
    if within is None:
        return found
    return F.when(~may_match(within, pattern), F.array().cast("array<string>")).otherwise(found)


def has(text: Column, pattern: str, flags: str = "", within: Column | None = None) -> Column:
    ahead = "" if "i" in flags or within is None else opening(pattern)
    found = text.rlike(rx(ahead + f"(?:{pattern})", flags))
    return found if within is None else may_match(within, pattern) & found


def on_lower(pattern: str) -> str:
    """Form of a case-insensitive pattern for lower-cased text.

    Matching lower-cased text case-sensitively is about ten times faster than
    ignoring case at every character.
    """
    if any(f"\\{letter}" in pattern for letter in "SWDBAZ"):
        raise ValueError(f"pattern has case-bearing escapes: {pattern}")
    return pattern.lower()


def replace(text: Column, pattern: str, by: str = "", flags: str = "") -> Column:
    return F.regexp_replace(text, rx(pattern, flags), by)


def strip(text: Column, chars: str = WHITESPACE) -> Column:
    return F.btrim(text, F.lit(chars))


def rstrip(text: Column, chars: str = WHITESPACE) -> Column:
    return F.rtrim(text, F.lit(chars))


def squash(text: Column) -> Column:
    """Every whitespace run becomes one blank."""
    return replace(text, r"\s+", " ")


def head(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def contains_any(text: Column, *needles: str) -> Column:
    test = F.lit(False)
    for needle in needles:
        test = test | text.contains(needle)
    return test


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def text_or_empty(text: Column) -> Column:
    """Records carry '' where the capture had nothing."""
    return strip(F.coalesce(text, F.lit("")))


def try_long(text: Column) -> Column:
    return text.try_cast("bigint")


def sorted_set(values: Column) -> Column:
    return F.sort_array(F.array_distinct(F.array_compact(values)))


def truncate_middle(text: Column, limit: int, keep_head: int, keep_tail: int, marker: str) -> Column:
    """Texts above ``limit`` keep both ends around ``marker``."""
    return F.when(
        F.length(text) > limit,
        F.concat(head(text, keep_head), F.lit(marker), tail(text, keep_tail)),
    ).otherwise(text)


def title_case_if_upper(name: Column) -> Column:
    """ALL CAPS names in title case, others as they are."""
    upper = (name == F.upper(name)) & (name != F.lower(name))
    return F.when(upper, F.initcap(name)).otherwise(name)
