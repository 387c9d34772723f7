"""Direct extraction over the derived judgments."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlake.functions import citations as C
from docketlake.functions import courts as K
from docketlake.functions import people as P
from docketlake.functions.dates import all_dates
from docketlake.functions.people import judge_names_any_case
from docketlake.functions.text import fold, head, squash
from docketlake.operators import extraction as X
from docketlake.workload import duck as Q
from docketlake.workload import judgments as J

SOURCE = f"j AS (SELECT judgment_id, source_url, text, left(text, 2000) AS h2000, lower(text) AS low FROM ({J.SQL}))"


def _tier_a(*fields: str):
    def run(spark, sf_dir):
        out = X.extract_tier_a(J.judgments(spark, sf_dir), source_url="source_url", fields=fields)
        return out.select("judgment_id", *(_flat(f) for f in fields))

    return run


def _flat(field: str):
    value = F.col(f"tier_a.{field}")
    if X.TIER_A[field].startswith("array"):
        return F.array_join(value.cast("array<string>"), "|").alias(field)
    return value.alias(field)


# ── identity ──
IDENTITY = ("case_id", "case_number", "case_title", "case_type", "court_name", "court_level",
            "jurisdiction_province", "date_judgment", "source_url")


def _date_sql(field: str) -> str:
    spans = {"operative": "right(text, 2000)", "header1500": "left(text, 1500)", "low": "text",
             "opening5000": "left(text, 5000)"}
    return Q.coalesce(
        *(Q.parse_date(Q.first(spans[s], p, 1, "i")) for s, p in X.DATED_FIELDS[field]), "NULL::DATE"
    )


_NUMBER = Q.strip(Q.squash(Q.coalesce(*(Q.first("h2000", p, 1, "i") for p in X.CASE_NUMBERS))))
_COURT = Q.coalesce(
    *(Q.first("h2000", n, 0, "i") for n in K.COURT_NAMES),
    Q.strip(Q.first("h2000", K.COURT_FALLBACK, 1, "i")),
)
_LEVEL = """(CASE WHEN contains(src, 'supreme') THEN 'supreme_court' WHEN contains(src, 'high court') THEN 'high_court'
  WHEN contains(src, 'anti') AND contains(src, 'terrorism') THEN 'anti_terrorism_court'
  WHEN contains(src, 'shariat') THEN 'federal_shariat'
  WHEN contains(src, 'session') OR contains(src, 'trial') THEN 'trial_court'
  WHEN contains(src, 'special') THEN 'special_court' END)"""


def _party_sql(x: str) -> str:
    labels = "|".join(P.PARTY_LABELS)
    n = f"trim(rtrim({x}, '. …' || chr(9) || chr(10)))"
    n = Q.replace(n, rf"(?:(?:^|\s+)(?:{labels})\.*)+$", "", "i")
    n = f"trim({Q.replace(n, rf'^(?:(?:{labels})\.*(?:\s+|$))+', '', 'i')})"
    return f"(CASE WHEN length({n}) > 2 THEN {n} END)"


_LEFT = _party_sql(f"left({Q.strip(Q.first('flat3000', P.VERSUS, 1, 'i'))}, 100)")
_RIGHT = _party_sql(f"left({Q.strip(Q.first('flat3000', P.VERSUS, 2, 'i'))}, 100)")
_CASE_TYPE = Q.by_rule(
    "lower(case_number)", K.CASE_TYPES,
    "CASE WHEN contains(left(low, 500), 'suo motu') THEN 'suo_motu' "
    "WHEN contains(left(low, 500), 'contempt') THEN 'contempt' END",
)
IDENTITY_SQL = f"""WITH {SOURCE},
a AS (SELECT *, {_NUMBER} AS case_number, {_COURT} AS court_name, {_date_sql('date_judgment')} AS date_judgment,
             {Q.squash('left(text, 3000)')} AS flat3000 FROM j),
b AS (SELECT *, lower(coalesce(court_name, text)) AS src FROM a)
SELECT judgment_id,
  CASE WHEN case_number IS NOT NULL THEN left(sha256(coalesce(court_name, 'unknown') || ':' || case_number || ':' ||
       coalesce(date_judgment::VARCHAR, 'unknown')), 16) END AS case_id,
  case_number, {_LEFT} || ' v. ' || {_RIGHT} AS case_title, {_CASE_TYPE} AS case_type, court_name,
  {_LEVEL} AS court_level, {Q.by_rule('src', K.PROVINCES)} AS jurisdiction_province, date_judgment,
  nullif(source_url, '') AS source_url
FROM b"""

# ── dates ──
DATES = ("date_judgment", "date_incident", "date_fir", "date_filed")
DATES_SQL = f"""WITH {SOURCE} SELECT judgment_id, {', '.join(f'{_date_sql(f)} AS {f}' for f in DATES)} FROM j"""


def all_dates_found(spark, sf_dir):
    docs = J.judgments(spark, sf_dir)
    found = all_dates(F.col("text"))
    return docs.select(
        "judgment_id",
        F.array_join(F.transform(found, lambda d: F.concat(d["source"], F.lit("="), d["date"].cast("string"))), "|").alias("dates"),
    )


def _all_dates_sql() -> str:
    from docketlake.functions import dates as D

    hits = " || ".join(
        Q.every("text", p, 0, "i") for p in (D.ISO, D.DAY_MONTH_YEAR, D.MONTH_DAY_YEAR, D.NUMERIC)
    )
    return f"""WITH {SOURCE}, h AS (SELECT judgment_id, unnest({hits}) AS s, generate_subscripts({hits}, 1) AS i FROM j),
p AS (SELECT judgment_id, i, s, {Q.parse_date('s')} AS d FROM h)
SELECT j.judgment_id, coalesce(string_agg(s || '=' || d::VARCHAR, '|' ORDER BY i) FILTER (WHERE d IS NOT NULL), '') AS dates
FROM j LEFT JOIN p USING (judgment_id) GROUP BY j.judgment_id"""


# ── citations and sections ──
CITED = ("ppc_sections", "section_34_applied", "forum_category", "precedents_cited", "statutes_discussed",
         "constitutional_articles", "fir_number")
_SECTION_34 = r"(?:Section\s+34\s+P\.?P\.?C|34\s+P\.?P\.?C|P\.?P\.?C\.?\s+34|Section\s+34\s+read\s+with)"


def _digits(captures: str) -> str:
    return rf"flatten(list_transform({captures}, lambda c: regexp_extract_all(c, '\d+', 0)))"


def _overlap(sections: list[int]) -> str:
    return f"len(list_intersect(nums, {sections})) > 0"


CITED_SQL = f"""WITH {SOURCE},
s AS (SELECT *, list_filter(list_sort(list_distinct(list_transform(
    {_digits(' || '.join([Q.every('text', C.PENAL_EITHER, 0, 'i'), Q.every('text', C.PENAL_NAMED), Q.every('text', C.PENAL_LIST), Q.every('text', C.PENAL_UNDER + r'(?is:.{0,25}?P[.]?P[.]?C)'), Q.every('text', C.PENAL_READ_WITH)]))},
    lambda n: n::BIGINT))), lambda n: NOT list_contains({C.PROCEDURE_SECTIONS}, n)) AS nums FROM j)
SELECT judgment_id, array_to_string(nums, '|') AS ppc_sections, {Q.has('text', _SECTION_34, 'i')} AS section_34_applied,
  CASE WHEN {_overlap(C.MURDER_SECTIONS)} THEN 'murder' WHEN {_overlap(C.SEXUAL_SECTIONS)} THEN 'sexual_assault'
       WHEN {_overlap(C.THEFT_SECTIONS)} THEN 'theft' END AS forum_category,
  {Q.joined_set('list_transform(' + ' || '.join(Q.every('text', p, 0, 'i') for p in C.CITATIONS) + ', lambda c: ' + Q.strip(Q.squash('c')) + ')')} AS precedents_cited,
  {Q.joined_set('list_transform(' + Q.every('text', C.STATUTE, 0, 'i') + ", lambda c: rtrim(" + Q.strip(Q.squash('c')) + ", ',. '))")} AS statutes_discussed,
  {Q.joined_set(Q.every('text', C.ARTICLE, 1, 'i'))} AS constitutional_articles,
  {Q.strip(Q.squash(Q.first('text', C.FIR_NUMBER, 0, 'i')))} AS fir_number
FROM s"""

# ── people ──
PEOPLE = ("judge_names", "accused_name", "victim_name", "complainant_name", "police_station", "prosecutor_name",
          "defense_counsel")


def _judges_sql(names: str, stop: list[str], upper: bool) -> str:
    name = "trim(n)"
    if upper:
        words = "list_transform(string_split(trim(n), ' '), lambda w: upper(left(w, 1)) || lower(w[2:]))"
        name = f"(CASE WHEN trim(n) = upper(trim(n)) THEN array_to_string({words}, ' ') ELSE trim(n) END)"
    cut = Q.replace(name, rf"(?:\s+(?:{'|'.join(stop)}))+$")
    cleaned = f"list_transform({names}, lambda n: {cut})"
    return Q.joined_set(f"list_filter({cleaned}, lambda n: contains(n, ' '))")


def _block(pattern: str) -> str:
    return Q.squash(f"coalesce({Q.first('left(text, 3000)', pattern, 1, 'is')}, '')")


_FLAT = Q.squash("left(text, 3000)")
JUDGES_SQL = _judges_sql(
    f"({Q.every('flat3000', P.JUSTICE)} || {Q.every('block', P.JUSTICE_IN_BLOCK)})", P.NOT_A_NAME, False
)
JUDGES_ANY_SQL = _judges_sql(
    f"({Q.every('flat3000', P.JUSTICE_ANY_CASE)} || {Q.every('block2', P.JUSTICE_ANY_CASE_IN_BLOCK)} || {Q.every('flat3000', P.HONBLE)})",
    P.NOT_A_NAME + P.NOT_A_NAME_EITHER, True,
)
_ACCUSED = Q.coalesce(
    *(f"(CASE WHEN lower({Q.first('flat5000', p)}) NOT IN ({', '.join(map(Q.lit, P.NOT_ACCUSED))}) THEN {Q.first('flat5000', p)} END)"
      for p in P.ACCUSED)
)
_SPANS_SQL = f"""{SOURCE}, p AS (SELECT *, {_FLAT} AS flat3000, {Q.squash('left(text, 4000)')} AS flat4000,
  {Q.squash('left(text, 5000)')} AS flat5000, {_block(P.PRESENT)} AS block, {_block(P.PRESENT_TO_END)} AS block2,
  left(text, 8000) AS o8000 FROM j)"""
PEOPLE_SQL = f"""WITH {_SPANS_SQL}
SELECT judgment_id, {JUDGES_SQL} AS judge_names, {_ACCUSED} AS accused_name,
  {Q.coalesce(*(Q.first('o8000', p) for p in P.VICTIM))} AS victim_name,
  {Q.first('o8000', P.COMPLAINANT)} AS complainant_name, {Q.first('o8000', P.POLICE_STATION)} AS police_station,
  {Q.coalesce(*(Q.first('flat4000', p, 1, 'i') for p in P.PROSECUTOR))} AS prosecutor_name,
  {Q.coalesce(*(Q.first('flat4000', p, 1, 'i') for p in P.DEFENSE))} AS defense_counsel
FROM p"""


def judges_any_case(spark, sf_dir):
    docs = J.judgments(spark, sf_dir)
    docs = docs.withColumns({"low": fold(F.col("text")), "flat": squash(head(F.col("text"), 3000))})
    names = judge_names_any_case(F.col("text"), F.col("low"), F.col("flat"))
    return docs.select("judgment_id", F.array_join(names, "|").alias("judge_names"))


JUDGES_ANY_CASE_SQL = f"WITH {_SPANS_SQL} SELECT judgment_id, {JUDGES_ANY_SQL} AS judge_names FROM p"

# ── indicators, counts, outcome ──
INDICATORS = tuple(X.INDICATORS)
INDICATORS_SQL = f"""WITH {SOURCE} SELECT judgment_id, {', '.join(f"{Q.has('text', p, 'i')} AS {f}" for f, p in X.INDICATORS.items())} FROM j"""

OUTCOME = ("prosecution_witness_count", "defense_witness_count", "eyewitness_count", "fir_delay_hours",
           "sentence_total_months", "fine_amount_pkr", "sentence_modified_to", "lower_court_case_number",
           "lower_court_name")


def _count_sql(patterns: list[str]) -> str:
    return Q.coalesce(*(f"try_cast({Q.first('text', p, 1, 'i')} AS BIGINT)" for p in patterns), "NULL::BIGINT")


def _cut_sql(x: str) -> str:
    for stopper in X.LOWER_COURT_STOPPERS:
        # The stoppers never open the name, so the first occurrence is the cut.
        x = f"(CASE WHEN {Q.has(x, f'^.+?{stopper}', 'is')} THEN rtrim({Q.strip(Q.replace(x, f'^(.+?){stopper}.*$', chr(92) + '1', 'is'))}, ',. ') ELSE {x} END)"
    return x


_YEARS = r"(\d+)\s+years?"
OUTCOME_SQL = rf"""WITH {SOURCE}, e AS (SELECT *, right(low, 2000) AS op, right(low, 5000) AS ending, left(text, 8000) AS o8000 FROM j),
n AS (SELECT *, {Q.strip(Q.first('o8000', X.LOWER_COURT, 0, 'i'))} AS below FROM e)
SELECT judgment_id,
  coalesce({_count_sql(X.PROSECUTION_WITNESSES)}, list_max(list_transform({Q.every('text', X.NUMBERED_WITNESS)}, lambda n: n::BIGINT))) AS prosecution_witness_count,
  {_count_sql(X.DEFENSE_WITNESSES)} AS defense_witness_count, {_count_sql(X.EYEWITNESSES)} AS eyewitness_count,
  coalesce({_count_sql([X.DELAY_HOURS])}, {_count_sql([X.DELAY_ANY])} *
     CASE WHEN contains(lower({Q.first('text', X.DELAY_ANY, 0, 'i')}), 'day') THEN 24 ELSE 1 END) AS fir_delay_hours,
  CASE WHEN contains(op, 'imprisonment for life') OR contains(op, 'life imprisonment') OR {Q.has('op', X.DEATH_TO_LIFE_SENTENCE)} THEN 300
    ELSE coalesce({Q.first('op', X.YEARS_OF_PRISON)}::BIGINT * 12, {Q.first('op', X.MONTHS_OF_PRISON)}::BIGINT) END AS sentence_total_months,
  replace({Q.first('text', X.FINE, 1, 'i')}, ',', '')::BIGINT AS fine_amount_pkr,
  CASE WHEN {Q.has('ending', X.DEATH_TO_LIFE)} OR (contains(ending, 'death') AND contains(ending, 'life') AND {Q.contains_any('ending', 'reduced', 'commuted', 'altered')}) THEN 'death_to_life'
    WHEN contains(ending, 'life') AND {Q.has('ending', _YEARS)} AND {Q.contains_any('ending', 'reduced', 'modified')}
    THEN 'life_to_' || {Q.first('ending', _YEARS)} || 'years' END AS sentence_modified_to,
  {Q.strip(Q.coalesce(*(Q.first('o8000', p, 0, 'i') for p in X.LOWER_COURT_CASE)))} AS lower_court_case_number,
  {_cut_sql('below')} AS lower_court_name
FROM n"""


def court_codes(spark, sf_dir):
    docs = J.judgments(spark, sf_dir)
    docs = docs.withColumn("low", fold(F.col("text")))
    docs = docs.withColumn("court", F.coalesce(K.court_name(F.col("text"), F.col("low")), F.col("text")))
    return docs.select("judgment_id", K.court_code(F.col("court")).alias("court_code"))


COURT_CODES_SQL = f"""WITH {SOURCE}, a AS (SELECT judgment_id, lower(coalesce({_COURT}, text)) AS src FROM j)
SELECT judgment_id, {Q.by_rule('src', [(code, (needle,)) for needle, code in K.COURT_CODES], "'UNKNOWN'")} AS court_code FROM a"""

QUERIES = {
    "case_identity": _tier_a(*IDENTITY),
    "case_dates": _tier_a(*DATES),
    "all_dates_found": all_dates_found,
    "cited_law": _tier_a(*CITED),
    "people_named": _tier_a(*PEOPLE),
    "judges_any_case": judges_any_case,
    "evidence_indicators": _tier_a(*INDICATORS),
    "witnesses_and_outcome": _tier_a(*OUTCOME),
    "court_codes": court_codes,
}
ORACLES = {
    "case_identity": IDENTITY_SQL,
    "case_dates": DATES_SQL,
    "all_dates_found": _all_dates_sql(),
    "cited_law": CITED_SQL,
    "people_named": PEOPLE_SQL,
    "judges_any_case": JUDGES_ANY_CASE_SQL,
    "evidence_indicators": INDICATORS_SQL,
    "witnesses_and_outcome": OUTCOME_SQL,
    "court_codes": COURT_CODES_SQL,
}
