"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides spans.

Base spans (email, ip, card, phone) come from fixed patterns and checks and always stay. Beyond
them, wide candidates (addresses with an @, number groups, long mixed tokens, assigned
credentials, titled names) get votes (1 private, -1 not, 0 no opinion) from labelers of three
kinds: regular expressions, gazetteers and context words. Expectation-maximisation over the
counted vote patterns (at most 3 ** 5 rows) estimates how reliable each labeler is and how
probable each pattern is private; those soft labels train the span classifier, a naive Bayes
model over shape features, which decides every candidate. Candidates are searched in the gaps
between the base spans, so the spans of both never overlap.

All of it is expressions and small aggregations: spans stay inside the row of their document,
and what leaves it are counts per vote pattern and feature value. Null and empty texts have no
spans. Patterns are linear in the length of a text: each run is entered at its start only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import let, stage
from docketlake.llm.spans import located

BASE = ["email", "ip", "card", "phone"]
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# A run is entered at its start or where the last match ended; dots only before a host character.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++\.(?={_HOST})(?:[A-Za-z0-9.-](?<!\.(?!{_HOST})))++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[0-9\x20-](?<![\x20-](?![0-9])))++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Gazetteers and context words.
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Señor Señora Monsieur Madame".split()
SUFFIXES = "com org net edu gov info de fr es uk eu io".split()
CREDENTIALS = "token secret password passwort passwd pwd api_key apikey api-key access_key clave contraseña jeton".split()
CUES = "mail phone tel call fax contact contacto correo téléphone telefon card karte carte tarjeta ip address host server login user".split()
ANTI_CUES = "isbn page seite version vol issue article section paragraph".split()

_CRED = "|".join(CREDENTIALS)
_TITLE = "|".join(TITLES)
CANDIDATE = "|".join([
    r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[\p{L}0-9-][\p{L}0-9.-]*+",
    rf"(?<=(?i:{_CRED})\x20{{0,2}}[:=]\x20{{0,2}}[\"']?)(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{{8,}}+",
    r"(?<![\p{L}0-9_.])\+?[0-9][0-9\x20()./-]{5,40}[0-9](?![\p{L}0-9_])",
    r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,64}[0-9])[A-Za-z0-9_-]{24,}+",
    rf"(?<!\p{{L}})(?:{_TITLE})\.?\x20\p{{Lu}}[\p{{L}}'-]+",
])
# Holds wherever CANDIDATE has a match: a branch for each of its alternatives.
_GUARD = rf"@|[0-9][0-9\x20()./-]{{5}}|[A-Za-z0-9_-]{{24}}|[:=](?<=(?i:{_CRED})\x20{{0,2}}[:=])|(?<!\p{{L}})(?:{_TITLE})\.?\x20\p{{Lu}}"
LABELERS = ["pattern", "check", "gazetteer", "context", "shape"]
FEATURES = ["kind", "length", "digits", "letters", "before_char", "after_char"]


def luhn(digits: Column) -> Column:
    padded = F.lpad(digits, 19, "0")
    value = lambda i: F.ascii(F.substr(padded, i, F.lit(1))) - 48
    total = F.aggregate(F.sequence(F.lit(1), F.lit(19)), F.lit(0), lambda s, i: s + F.when(
        i % 2 == 0, 2 * value(i) - F.when(value(i) > 4, 9).otherwise(0)).otherwise(value(i)))
    return total % 10 == 0


def _bytes_ok(match: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))


def _card_ok(match: Column) -> Column:
    return let(F.regexp_replace(match, r"[\x20-]", ""), lambda d: F.length(d).between(16, 19) & luhn(F.substr(d, F.lit(1), F.lit(19))))


def _phone_ok(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", "")).between(8, 15)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end), by kind as in BASE, then start."""
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")

    def of(kind: str, guard: Column, pattern: str, ok) -> Column:
        found = F.transform(F.filter(located(text, pattern, 0), lambda s: ok(s["match"])), lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return F.when(guard, found).otherwise(none)

    return F.concat(
        of("email", F.contains(text, F.lit("@")), EMAIL, lambda m: F.lit(True)),
        of("ip", text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), IP, _bytes_ok),
        of("card", text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), CARD, _card_ok),
        of("phone", F.contains(text, F.lit("+")), PHONE, _phone_ok))


def _votes_and_features(s: Column) -> Column:
    """Votes of the labelers and features of one located candidate."""
    m, before = s["match"], F.lower(s["before"])
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(m, r"\P{L}", ""))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0).cast("int")
    listed = lambda ws: r"(?<!\p{L})(?:" + "|".join(ws) + r")(?!\p{L})"
    credential = before.rlike(rf"(?:{_CRED})\x20{{0,2}}[:=]\x20{{0,2}}[\"']?$")
    number = (letters == 0) & ~F.contains(m, F.lit("@"))
    quad = m.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    kind = F.when(F.contains(m, F.lit("@")), "contact").when(credential, "secret").when(number, "number").when(m.rlike(rf"^(?:{_TITLE})\.?\x20"), "person").otherwise("token")
    size = F.length(m)
    return F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        vote(m.rlike(rf"^{_LOCAL}+@{_HOST}+(?:\.{_HOST}+)+$") | quad | m.rlike(r"^\+[0-9]") | m.rlike(r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}$"), letters == size).alias("pattern"),
        vote(number & ((quad & _bytes_ok(m)) | ((digits >= 13) & (digits <= 19) & luhn(F.lpad(F.regexp_replace(m, "[^0-9]", ""), 19, "0")))),
             number & ((quad & ~_bytes_ok(m)) | (digits < 8) | (digits > 19))).alias("check"),
        vote(m.rlike(rf"\.(?:{'|'.join(SUFFIXES)})$") | m.rlike(r"^\+(?:1|33|34|44|49)\D") | m.rlike(rf"^(?:{_TITLE})\b"), m.rlike(r"^(?:19|20)[0-9]{2}[ /-]")).alias("gazetteer"),
        vote(credential | before.rlike(listed(CUES)), before.rlike(listed(ANTI_CUES))).alias("context"),
        vote((digits >= 8) & (letters >= 4), (letters > 0) & (digits == 0) & ~F.contains(m, F.lit("@"))).alias("shape"),
        kind.alias("kind"), F.least(F.floor(size / 8), F.lit(6)).cast("string").alias("length"),
        F.floor(4 * digits / size).cast("string").alias("digits"), F.floor(4 * letters / size).cast("string").alias("letters"),
        F.regexp_replace(F.regexp_replace(F.right(s["before"], F.lit(1)), r"\p{L}", "a"), r"[0-9]", "0").alias("before_char"),
        F.regexp_replace(F.regexp_replace(F.left(s["after"], F.lit(1)), r"\p{L}", "a"), r"[0-9]", "0").alias("after_char"))


def candidates(text: Column, base: Column) -> Column:
    """Candidates in the gaps between the base spans, with votes and features."""
    # Base spans become characters that no candidate holds; all places stay.
    blank = lambda t, b: F.overlay(t, F.repeat(F.lit("\x00"), (b["end"] - b["start"]).cast("int")), (b["start"] + 1).cast("int"))
    gaps = F.when(F.size(base) > 0, F.aggregate(base, text, blank)).otherwise(text)
    return let(gaps, _judgeable)


def _judgeable(text: Column) -> Column:
    none = F.filter(F.array(_votes_and_features(F.struct(*[F.lit(0).cast("bigint").alias(n) for n in ("start", "end")], *[F.lit("0").alias(n) for n in ("match", "before", "after")]))), lambda c: F.lit(False))
    return F.when(text.rlike(_GUARD), F.transform(located(text, CANDIDATE), _votes_and_features)).otherwise(none)


def reliabilities(patterns: DataFrame, rounds: int = 12) -> tuple[float, dict]:
    """EM over counted vote patterns: the share of private spans, and per labeler and vote the
    probability of the vote given private and given not. Every round is one small aggregation."""
    share = 0.5
    odds = {(name, v): (0.6, 0.2) if v == 1 else (0.1, 0.5) if v == -1 else (0.3, 0.3) for name in LABELERS for v in (1, -1, 0)}
    for _ in range(rounds):
        p = posterior(share, odds)
        sums = [F.sum(F.col("n")).alias("all"), F.sum(F.col("n") * p).alias("private")]
        for name, v in odds:
            hit = F.when(F.col(name) == v, F.col("n")).otherwise(0)
            sums += [F.sum(hit * p).alias(f"yes_{name}_{v}"), F.sum(hit * (1 - p)).alias(f"no_{name}_{v}")]
        row = patterns.agg(*sums).first().asDict()
        if not row["all"]:
            return share, odds
        yes, no = row["private"], row["all"] - row["private"]
        share = min(max(yes / row["all"], 0.01), 0.99)
        odds = {(name, v): ((row[f"yes_{name}_{v}"] + 1) / (yes + 3), (row[f"no_{name}_{v}"] + 1) / (no + 3)) for name, v in odds}
    return share, odds


def posterior(share: float, odds: dict) -> Column:
    total = F.lit(math.log(share / (1 - share)))
    for name in LABELERS:
        total = total + F.when(F.col(name) == 1, math.log(odds[name, 1][0] / odds[name, 1][1])).when(
            F.col(name) == -1, math.log(odds[name, -1][0] / odds[name, -1][1])).otherwise(math.log(odds[name, 0][0] / odds[name, 0][1]))
    return 1 / (1 + F.exp(-total))


def trained(spans: DataFrame) -> tuple[float, dict, tuple[float, dict]]:
    """The span classifier (prior log-odds, log-odds per feature value) and the labelers' model.

    ``spans`` is staged and holds the array ``found`` per document."""
    rows = spans.select(F.inline("found")).groupBy(*LABELERS, *FEATURES).agg(F.count("*").alias("n"))
    counted = stage(rows, "span-patterns")
    model = reliabilities(stage(counted.groupBy(*LABELERS).agg(F.sum("n").alias("n")), "vote-patterns"))
    soft = counted.withColumn("p", posterior(*model))
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])
    sums = soft.select("n", "p", F.inline(pairs).alias("feature", "value")).groupBy("feature", "value").agg(
        F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect()  # feature values: dozens
    yes, no = (sum(r[k] for r in sums if r["feature"] == "kind") for k in ("yes", "no"))
    prior = math.log((yes + 1) / (no + 1))
    values = {}
    for r in sums:
        k = sum(x["feature"] == r["feature"] for x in sums)
        values.setdefault(r["feature"], {})[r["value"]] = math.log((r["yes"] + 1) / (yes + k)) - math.log((r["no"] + 1) / (no + k))
    return prior, values, model


def span_score(c: Column, prior: float, values: dict) -> Column:
    total = F.lit(prior)
    for feature, known in values.items():
        weight = F.lit(0.0)
        for value, w in sorted(known.items()):
            weight = F.when(c[feature] == value, w).otherwise(weight)
        total = total + weight
    return 1 / (1 + F.exp(-total))


def find_private(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Rows (keys, base, added): base spans and the spans the classifier adds, (kind, start, end)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    spans = stage(docs.select(*keys, whole.alias("__text")).withColumn("base", base_spans(F.col("__text")))
                  .withColumn("found", candidates(F.col("__text"), F.col("base"))).drop("__text"), "private-spans")
    prior, values, _ = trained(spans)
    added = F.transform(F.filter("found", lambda c: span_score(c, prior, values) >= 0.5), lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return spans.select(*keys, "base", F.array_sort(added).alias("added"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_private_data(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_private(docs, ["doc_id"])
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                        _joined(F.concat("base", "added")).alias("spans"))
