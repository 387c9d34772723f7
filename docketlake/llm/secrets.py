"""Secret scan: a random forest removes the false positives of a wide pattern.

Candidates are runs of 16 and more letters, digits and ``_+/-`` (with base64 padding), most of
them long words, names or paths, and the values of 4 and more characters assigned to a credential
name: quoted ones up to their quote, bare ones up to a blank, quote, ``<``, ``>``, the next
``name=`` of a query or the punctuation that ends a sentence. Addresses, further assignments and
quoted sentences with a long run in them are searched inside instead. Features: length, changes of character class, distinct characters, digit and capital
shares, how much of its letters the corpus' own words cover (dictionary coverage), the path or
source it was found under (hashed), and its neighbours: an assignment or quote before it, the
word before and the word behind it (hashed), a credential word nearby.

The forest (Spark ML, trained on all labelled findings, distributed) learns from findings that
carry a label. ``labelled_by_assignment`` makes such findings where no reviewed ones exist: a
quoted value of a credential assignment is a secret, a run of letters alone that stands as a
word is not, all else is unlabelled and judged by the forest alone.

Null and empty texts hold no candidate. Null paths are a path of their own. Repeated rows are
repeated findings. Without two classes of labelled findings there is nothing to learn and
every candidate is kept with the share of secrets among the labels (1 if none) as score.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import let, stage
from docketlake.llm.spans import located

CREDENTIAL_WORDS = "token secret password passwd pwd key api auth credential bearer".split()
_WORDS, _RUN = "|".join(CREDENTIAL_WORDS), "[A-Za-z0-9_+/-]{16}"
_NAME = rf"(?:{_WORDS})(?:s|[0-9]{{1,4}}|[_-][A-Za-z0-9_-]{{1,16}})?"
_ASSIGN = r"[\\\"']{0,2}[\x20\t]{0,3}(?:=>|:=|=|:)[\x20\t]{0,3}\\?"
_STOP = r"\s\"'`<>"
# Every loop is possessive, so that long values need no stack and no second look.
_BARE = rf"(?:(?![.,;:)\]}}]{{1,8}}(?:[{_STOP}]|\z))(?:[^{_STOP}&,;]|[&,;](?![A-Za-z0-9_.-]++=|{_RUN}))){{4,}}+"
_QUOTED = "|".join(rf"(?<={q})(?:(?:[^{q}\s\\]|\\\S){{4,}}+(?={q})|(?![^{q}\r\n]*{_RUN})(?:[^{q}\r\n\\]|\\.){{4,}}+(?={q}))" for q in "\"'")
# Cheap looks back come first: a character, then the sign of an assignment, then the name before it.
_VALUE = (rf"(?<=[:=>\x20\t\\\"'])(?<=[:=>][\x20\t]{{0,3}}\\?[\"']?)(?<=(?i:{_NAME}){_ASSIGN}[\"']?)(?![=:>\s])"
          rf"(?![A-Za-z][A-Za-z0-9+.-]*+://)(?!(?i:[A-Za-z0-9_-]{{0,20}}{_NAME})[=:])(?:{_QUOTED}|{_BARE})")
PATTERN = rf"{_VALUE}|(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{{16,}}+(?:={{1,2}}+(?![A-Za-z0-9_+/=-]|[\"'][^\s,;)\]}}]))?+"
HASHED, MIN_DOCS, TREES, DEPTH = 16, 5, 20, 6
NUMBERS = ["length", "transitions", "distinct", "digits", "capitals", "coverage", "assigned", "quoted", "credential"]
HASHES = ["path", "word_before", "word_after"]


def findings(docs: DataFrame, keys: list[str], path: str, text: str = "text") -> DataFrame:
    """Rows (keys, path, start, end, candidate, before, after)."""
    spans = located(F.coalesce(F.col(text), F.lit("")), PATTERN, 32)
    # The name of an assignment may be a candidate itself; it still stands before its value.
    spans = let(spans, lambda all_: F.transform(all_, lambda s, i: s.withField("before", F.right(F.concat(F.coalesce(F.get(all_, i - 1)["match"], F.lit("")), s["before"]), F.lit(32)))))
    held = docs.select(*keys, F.col(path).cast("string").alias("path"), spans.alias("found"))
    return held.select(*keys, "path", F.inline("found").alias("start", "end", "candidate", "before", "after"))


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lower-cased words (3 to 24 letters) of at least MIN_DOCS texts, counted over all texts."""
    found = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w).between(3, 24)))
    return docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_DOCS).select("word")


def _share(candidate: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(candidate, pattern, "")) / F.length(candidate)


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds the feature columns. ``found`` is staged; distinct candidates alone meet the dictionary."""
    pieces = F.filter(F.split(F.lower("candidate"), r"[^\p{L}]+"), lambda p: F.length(p) >= 3)
    each = found.select("candidate").distinct().select("candidate", F.explode(pieces).alias("piece"))
    covered = each.join(words, each["piece"] == words["word"]).groupBy("candidate").agg(F.sum(F.length("piece")).alias("covered"))
    covered = covered.select(F.col("candidate").alias("candidate_of"), "covered")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace("candidate", "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    last = F.lower(F.regexp_extract("before", r"([\p{L}\p{N}_]+)[^\p{L}\p{N}_]*$", 1))
    first = F.lower(F.regexp_extract("after", r"^[^\p{L}\p{N}_]*([\p{L}\p{N}_]+)", 1))
    slot = lambda c: F.pmod(F.xxhash64(F.coalesce(c, F.lit("\x00"))), F.lit(HASHED)).cast("double")
    return found.join(covered, found["candidate"] == covered["candidate_of"], "left").drop("candidate_of").select(
        *found.columns,
        F.length("candidate").cast("double").alias("length"),
        (F.length(classes) / F.length("candidate")).alias("transitions"),
        F.size(F.array_distinct(F.split("candidate", ""))).cast("double").alias("distinct"),
        _share(F.col("candidate"), "[^0-9]").alias("digits"),
        _share(F.col("candidate"), "[^A-Z]").alias("capitals"),
        (F.coalesce("covered", F.lit(0)) / F.greatest(F.length(F.regexp_replace("candidate", r"[^A-Za-z]", "")), F.lit(1))).alias("coverage"),
        F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double").alias("assigned"),
        F.col("before").rlike(r"[\"']$").cast("double").alias("quoted"),
        F.lower("before").rlike("|".join(CREDENTIAL_WORDS)).cast("double").alias("credential"),
        slot(F.regexp_extract("path", r"([^/.]*)[^/]*$", 1)).alias("path_slot"), slot(last).alias("word_before_slot"), slot(first).alias("word_after_slot"))


def labelled_by_assignment(found: DataFrame) -> DataFrame:
    """Adds ``label``: 1 secret, 0 not, null unknown."""
    secret = F.lower("before").rlike(rf"{_NAME}(?:\s*[=:]\s*|{_ASSIGN})[\"']$") & F.col("after").rlike("^[\"']")
    word = F.col("candidate").rlike("^[A-Za-z]+$") & ~F.col("before").rlike("[=:\"']\\s*$")
    return found.withColumn("label", F.when(secret, 1.0).when(word, 0.0))


def judge(featured: DataFrame) -> DataFrame:
    """Adds ``score`` (probability of a secret); rows with a label train the forest."""
    counts = featured.filter("label IS NOT NULL").agg(F.count("*"), F.sum("label")).first()
    if not counts[0] or counts[1] in (0, counts[0]):
        return featured.withColumn("score", F.lit(float(counts[1] / counts[0]) if counts[0] else 1.0))
    inputs = NUMBERS + [f"{h}_slot" for h in HASHES]
    rows = VectorAssembler(inputCols=inputs, outputCol="features").transform(featured)
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=7, maxBins=32, subsamplingRate=0.8)
    model = forest.fit(rows.filter("label IS NOT NULL"))
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def op1_secret_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = stage(findings(docs, ["doc_id"], "source"), "secret-findings")
    featured = stage(labelled_by_assignment(with_features(found, dictionary(docs))), "secret-features")
    return judge(featured).select("doc_id", "start", "end", "candidate", F.round("score", 6).alias("score"), (F.col("score") >= 0.5).cast("int").alias("secret"))
