"""SQL fragments for the DuckDB side of a query: the same rules in RE2 and DuckDB SQL."""

from __future__ import annotations

from docketlake.functions import dates as D

SPACES = "' ' || chr(9) || chr(10) || chr(13)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str, flags: str = "") -> str:
    pattern = pattern.replace(r"\d++", r"\d+")
    on = "".join(f for f in "ims" if f in flags)
    off = "" if "s" in flags else "-s"
    return lit(f"(?{on}{off}){pattern}")


def first(text: str, pattern: str, group: int = 1, flags: str = "") -> str:
    return f"nullif(regexp_extract({text}, {re2(pattern, flags)}, {group}), '')"


def every(text: str, pattern: str, group: int = 1, flags: str = "") -> str:
    return f"regexp_extract_all({text}, {re2(pattern, flags)}, {group})"


def has(text: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({text}, {re2(pattern, flags)})"


def replace(text: str, pattern: str, by: str = "", flags: str = "") -> str:
    return f"regexp_replace({text}, {re2(pattern, flags)}, {lit(by)}, 'g')"


def squash(text: str) -> str:
    return replace(text, r"\s+", " ")


def strip(text: str) -> str:
    return f"trim({text}, {SPACES})"


def coalesce(*parts: str) -> str:
    return f"coalesce({', '.join(parts)})"


def joined_set(values: str) -> str:
    return f"array_to_string(list_sort(list_distinct({values})), '|')"


def contains_any(text: str, *needles: str) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(n)})" for n in needles) + ")"


def month(word: str) -> str:
    arms = " ".join(f"WHEN '{name}' THEN {n}" for name, n in D.MONTHS.items())
    return f"(CASE lower({word}) {arms} END)"


def ymd(y: str, m: str, d: str) -> str:
    return (
        f"try_cast(({y})::VARCHAR || '-' || lpad(({m})::VARCHAR, 2, '0') || '-' || "
        f"lpad(({d})::VARCHAR, 2, '0') AS DATE)"
    )


def parse_date(x: str) -> str:
    def g(pattern: str, group: int) -> str:
        return first(x, pattern, group, "i")

    dmy, mdy = month(g(D.DAY_MONTH_YEAR, 2)), month(g(D.MONTH_DAY_YEAR, 1))
    return f"""(CASE WHEN {g(D.ISO, 0)} IS NOT NULL THEN {ymd(g(D.ISO, 1), g(D.ISO, 2), g(D.ISO, 3))}
      WHEN {dmy} IS NOT NULL THEN {ymd(g(D.DAY_MONTH_YEAR, 3), dmy, g(D.DAY_MONTH_YEAR, 1))}
      WHEN {mdy} IS NOT NULL THEN {ymd(g(D.MONTH_DAY_YEAR, 3), mdy, g(D.MONTH_DAY_YEAR, 2))}
      WHEN {g(D.NUMERIC, 0)} IS NOT NULL THEN {ymd(g(D.NUMERIC, 3), g(D.NUMERIC, 2), g(D.NUMERIC, 1))} END)"""


def by_rule(source: str, rules, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {contains_any(source, *needles)} THEN {lit(label)}" for label, needles in rules)
    return f"(CASE {arms} ELSE {default} END)"
