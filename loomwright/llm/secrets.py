"""Secret scans with a random forest that removes false positives, in DataFrame functions and Spark ML only.

Candidates are all runs of key-like characters that are long enough and hold a digit, without the names before = or :
that lead them; a word can hold many (JSON, CSV, minified code). Values that a keyword is assigned are candidates too where
they have no digit or hold punctuation. Features are the candidate's length,
its character classes and the transitions between them, the share of its letter runs that a dictionary of common words
covers, the depth and kind of its path, and the words around it. The forest is trained on labelled findings. Whether a
candidate parses as a harmless value or has the form of a known kind of secret is evidence for labels alone: the forest
never sees it, so that it has to tell other shapes by how they are built and where they stand.

Defined cases: a null or empty text has no candidates; a null path has depth 0; labelled findings of one class only, or
none, leave every candidate with probability 1 (nothing is removed); repeated rows give repeated findings; an empty
table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import SPACES, let
from .sampling import lowest_hashes
from .storage import materialise
from .tables import table

MIN_LENGTH = 12
CANDIDATE = r"[A-Za-z0-9+/_=.:@-]{12,}"
#: Leading names of a run, each with its = or : and 12 characters or more after it; not the scheme of a URL or the groups of an address.
HEAD = r"^(?:(?![0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{0,4}:)(?:[A-Za-z_][A-Za-z0-9_.-]*+|[A-Za-z0-9]{16,}+)[=:]++(?!//)(?=.{12}))++"
#: The features look at so many characters before a candidate, for a name that it is assigned to.
LEAD = 80
#: A value that a name in the same word is assigned, of 8 characters or more that neither quote nor separate.
VALUE = r"[^\"'`\\\s,;<>]{8,}+"
PAIR = r"(?:^|[^A-Za-z0-9_.-])(([A-Za-z0-9_.-]{1,64}+)[\"'`\\]*+[=:]++>?[\"'`\\]*+)(" + VALUE + ")"
ASSIGNED = r"([A-Za-z0-9_.-]+)[\"'`\\]*\s*[=:]+>?\s*[\"'`\\]*$"
#: The forest is fitted on about so many labelled findings of each class, chosen among those of all documents by a hash.
FIT_ROWS = 20_000
#: The dictionary has the words that this share of all documents have, so it is no longer than the distinct words of a
#: document on average, divided by the share.
DICTIONARY_SHARE = 0.005
TREES, DEPTH = 20, 6
# The JVM recurses on a repeated group unless it is possessive or bounded, so every such group here is one of these.
_ADDRESS = r"\d{1,3}(?:\.\d{1,3}){3}(?:[:/]\d{1,5})?|(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}|[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}"
_DATE = r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?:[T_:-]?\d{1,2}[:.]?\d{2}(?:[:.]?\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}"
_MAIL = r"(?:mailto:)?[A-Za-z0-9_.+=-]+@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
_PLAIN = r"(?:[A-Z]?[a-z]{2,20}|[A-Z]{2,12}|\d{1,6}|[A-Za-z](?![A-Za-z]))"
_NAME = r"[._-]*" + _PLAIN + r"(?:[._@-]*" + _PLAIN + r"){0,7}+"
_URL = r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[A-Za-z0-9.-]+(?::\d+)?(?:/(?:" + _NAME + r")?)*+"
_PATH = r"(?:[A-Za-z]:)?[.]{0,2}/?(?:" + _NAME + r")(?:/(?:" + _NAME + r"))++/?"
_NUMBER = r"[+-]?[\d.-]+(?:[eE][+-]?\d+)?|v?\d+(?:\.\d+)++(?:[-+.][A-Za-z]+[.-]?\d*)?"
HARMLESS = "^(?:" + "|".join((_ADDRESS, _DATE, _MAIL, _URL, _PATH, _NUMBER)) + ")$"
SHAPED = r"^eyJ[A-Za-z0-9_=-]{8,}\.[A-Za-z0-9_=-]{8,}\.|//[^/@:]*:[^/@]{6,}@|^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}|^xox[abeprs]-[A-Za-z0-9-]{10,}|^[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|^AIza[A-Za-z0-9_-]{35}"
#: Words that name a secret when they stand before it.
KEYWORDS = ["token", "key", "secret", "password", "passwd", "apikey", "api_key", "credential", "auth"]
FEATURES = [
    "length", "digits", "uppers", "lowers", "others", "transitions", "distinct", "hex_only", "dictionary",
    "path_depth", "path_code", "after_keyword", "after_equals", "quoted",
]


def _pieces(run: Column) -> Column:
    """(text before in the run, candidate) of a run: its value, and those of its leading names that could be secrets too;
    the whole run where it has no leading name or the value has no digit."""
    head = F.regexp_extract(run, HEAD, 0)
    value = F.substr(run, F.length(head) + 1)
    names = F.regexp_extract_all(head, F.lit("[^=:]+[=:]+"), F.lit(0))
    split = lambda n: F.transform(F.concat(n, F.array(value)), lambda x, i: F.struct(F.coalesce(F.get(n, i - 1), F.lit("")).alias("lead"), F.when(i < F.size(n), F.regexp_replace(x, "[=:]+$", "")).otherwise(x).alias("candidate")))
    whole = F.array(F.struct(F.lit("").alias("lead"), run.alias("candidate")))
    return F.when((head == "") | ~value.rlike("[0-9]"), whole).otherwise(let(names, split))


def _found(word: Column) -> Column:
    """(whether the first of the word, whether of its last run, text before, candidate) for each candidate of a word."""
    runs = F.regexp_extract_all(word, F.lit(CANDIDATE), F.lit(0))
    gaps = F.regexp_extract_all(word, F.lit("(?s)(.*?)" + CANDIDATE), F.lit(1))

    def of_run(z: Column, run: Column, i: Column) -> Column:
        lead = F.concat(F.coalesce(F.get(z["runs"], i - 1), F.lit("")), F.get(z["gaps"], i))
        each = lambda p, k: F.struct(((i == 0) & (k == 0)).alias("first"), (i == F.size(z["runs"]) - 1).alias("last"), F.right(F.when(k == 0, lead).otherwise(p["lead"]), F.lit(LEAD)).alias("lead"), p["candidate"].alias("candidate"))
        return F.transform(_pieces(run), each)

    every = let(F.struct(runs.alias("runs"), gaps.alias("gaps")), lambda z: F.flatten(F.transform(z["runs"], lambda r, i: of_run(z, r, i))))
    return F.filter(every, lambda p: (F.length(p["candidate"]) >= MIN_LENGTH) & p["candidate"].rlike("[0-9]"))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, word position, place among the word's candidates, candidate, text before it in the word, neighbouring words,
    path): one row for each candidate of each text. Only a word's first candidate has the words before it, and only those
    of its last run the word after it, so that a long word isn't copied for each."""
    where = F.lit("") if path is None else F.coalesce(F.col(path).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACES), "").alias("w"), where.alias("path"))
    long_enough = lambda w: F.filter(F.transform(w, lambda x, i: F.struct(i.alias("at"), x.alias("word"), F.get(w, i - 1).alias("before"), F.get(w, i - 2).alias("before2"), F.get(w, i + 1).alias("after"))), lambda s: (F.length(s["word"]) >= MIN_LENGTH) & s["word"].rlike("[0-9]") & s["word"].rlike(CANDIDATE))
    words = rows.select("key", "path", F.explode(long_enough(F.col("w"))).alias("s"))
    near = lambda p, name, on: F.when(p[on], F.coalesce(F.col(f"s.{name}"), F.lit(""))).otherwise("").alias(name)
    parts = F.transform(_found(F.col("s.word")), lambda p: F.struct(p["candidate"].alias("candidate"), p["lead"].alias("lead"), near(p, "before", "first"), near(p, "before2", "first"), near(p, "after", "last")))
    found = words.select("key", "path", F.col("s.at").cast("long").alias("at"), F.posexplode(parts).alias("nth", "p"))
    return found.select("key", "at", F.col("nth").cast("long").alias("nth"), "p.*", "path")


def _keyword(name: Column) -> Column:
    """Whether a part of a name, between _ . - or a change of case, is one of ``KEYWORDS``."""
    return F.arrays_overlap(F.split(F.lower(F.regexp_replace(F.regexp_replace(name, "[^A-Za-z_.-]", ""), "([a-z])([A-Z])", "$1_$2")), "[_.-]+"), F.array(*map(F.lit, KEYWORDS)))


def assigned_values(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """More candidates, with the columns of ``candidates`` and nth from -1 down: values that a name with a keyword is assigned
    and that hold no candidate, since they have no digit or are cut by punctuation. The name stands in the same word, or in
    the one or two words before it (of at most 64 characters each)."""
    where = F.lit("") if path is None else F.coalesce(F.col(path).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACES), "").alias("w"), where.alias("path"))
    around = lambda w: F.transform(w, lambda x, i: F.struct(i.alias("at"), x.alias("word"), F.get(w, i - 1).alias("before"), F.get(w, i - 2).alias("before2"), F.get(w, i + 1).alias("after")))
    assigns = lambda c: c.rlike("[=:]>?[\"'`\\\\]*$")
    some = lambda s: (F.length(s["word"]) >= 8) & (s["word"].rlike("[=:]") | assigns(F.coalesce(F.right(s["before"], F.lit(8)), F.lit(""))))
    words = rows.select("key", "path", F.explode(F.filter(around(F.col("w")), some)).alias("s")).select("key", "path", "s.*")
    named = F.regexp_extract(F.concat_ws(" ", F.right("before2", F.lit(64)), F.right("before", F.lit(64))), ASSIGNED, 1)
    near = lambda c: F.coalesce(F.right(c, F.lit(LEAD)), F.lit("")).alias(c)
    pair = lambda n: F.regexp_extract_all("word", F.lit(PAIR), F.lit(n))
    none = [F.lit("").alias(c) for c in ("before", "before2")]
    inside = F.transform(F.arrays_zip(pair(1).alias("lead"), pair(2).alias("name"), pair(3).alias("value")), lambda p: F.struct(p["lead"].alias("lead"), p["name"].alias("name"), p["value"].alias("value"), *none))
    value = lambda n: F.regexp_extract("word", "^([\"'`\\\\]*+)(" + VALUE + ")", n)
    behind = F.array(F.struct(value(1).alias("lead"), named.alias("name"), value(2).alias("value"), near("before"), near("before2")))
    fresh = lambda p: (p["value"] != "") & _keyword(p["name"]) & ~(p["value"].rlike(CANDIDATE) & p["value"].rlike("[0-9]"))
    pairs = words.select("key", "path", F.col("at").cast("long").alias("at"), F.filter(F.concat(inside, behind), fresh).alias("pairs"))  # a long word isn't copied for each
    found = pairs.select("key", "path", "at", F.posexplode("pairs").alias("n", "p"))
    return found.select("key", "at", (-1 - F.col("n")).cast("long").alias("nth"), F.col("p.value").alias("candidate"), F.right("p.lead", F.lit(LEAD)).alias("lead"), "p.before", "p.before2", F.lit("").alias("after"), "path")


def common_words(docs: DataFrame, text: str = "text", share: float = DICTIONARY_SHARE) -> list[str]:
    """The words of 3 letters or more that a share of the documents have, in order."""
    least = max(1.0, share * docs.count())
    each = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}"), F.lit(0)))).alias("word"))
    return sorted(r["word"] for r in each.groupBy("word").count().filter(F.col("count") >= least).select("word").collect())


def _classes(x: Column) -> Column:
    """One letter for the class of each character."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[A-Z]", "U"), "[a-z]", "l"), "[0-9]", "0"), "[^Ul0]", ".")


def with_features(found: DataFrame, dictionary: list[str]) -> DataFrame:
    """``found`` with the forest's features; ratios are by the candidate's length."""
    c = F.col("candidate")
    n = F.length(c).cast("double")
    kind = lambda mark: F.length(F.regexp_replace("kinds", f"[^{mark}]", "")) / n
    pairs = F.length(F.regexp_replace("kinds", r"(.)\1*", "x")) - 1
    covered = F.aggregate(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0)), lambda x: x.isin(dictionary)), F.lit(0), lambda a, x: a + F.length(x))
    text = F.concat_ws(" ", F.right("before2", F.lit(LEAD)), F.right("before", F.lit(LEAD)), "lead")
    own = F.regexp_extract(text, ASSIGNED, 1)
    values = {
        "length": n, "digits": kind("0"), "uppers": kind("U"), "lowers": kind("l"), "others": kind("."),
        "transitions": pairs / n, "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "hex_only": c.rlike("^[0-9a-fA-F]+$").cast("double"), "dictionary": covered / n,
        "path_depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"), "path_code": F.lower("path").rlike(r"\.(py|js|env|ya?ml|json|conf|ini|sh)$").cast("double"),
        "after_keyword": (_keyword(F.col("before2")) | _keyword(F.col("before")) | _keyword(own)).cast("double"), "after_equals": text.rlike(ASSIGNED).cast("double"), "quoted": F.col("lead").rlike("[\"'`]$").cast("double"),
    }
    return found.withColumn("kinds", _classes(c)).withColumns({k: v.cast("double") for k, v in values.items()}).drop("kinds")


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel | None:
    """A forest from findings with features and a column ``label`` (0 or 1); none if a class is missing."""
    rows = labelled.filter(F.col("label").isNotNull()).select(*FEATURES, F.col("label").cast("double").alias("label"))
    if rows.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7).fit(vectors.select("features", "label"))


def score(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """``found`` (with features) with the probability of a true secret."""
    if model is None:
        return found.withColumn("probability", F.lit(1.0))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
    scored = model.transform(vectors).withColumn("probability_", vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("probability_", "probability")


def harmless(c: Column) -> Column:
    """Whether a candidate parses as a number, an IP or hardware address, a date or time, a mail address, a URL without
    user information, a version, or a path of plain names."""
    return F.coalesce(F.rtrim(c, F.lit(".:,=-")).rlike(HARMLESS), F.lit(False))


def shaped(c: Column) -> Column:
    """Whether a candidate has the form of a known kind of secret: a signed token, a URL or address with a password, or
    a prefix of well-known issuers."""
    return F.coalesce(c.rlike(SHAPED), F.lit(False))


def weak_label() -> Column:
    """Labels where the tables have none. 0: what parses as ``harmless``. 1: what is ``shaped`` as a secret, or is
    assigned to a keyword, has 16 characters or more, digits and letters, and hardly a word of the dictionary. Else
    null. Neither ``harmless`` nor ``shaped`` is a feature."""
    c = F.col("candidate")
    assigned = (F.col("after_keyword") == 1) & (F.col("after_equals") == 1) & (F.col("length") >= 16) & c.rlike("[A-Za-z]") & (F.col("dictionary") < 0.3)
    return F.when(shaped(c), 1).when(harmless(c), 0).when(assigned, 1)


def training_rows(labelled: DataFrame, most: int = FIT_ROWS, place: tuple[str, ...] = ("key", "at", "nth")) -> DataFrame:
    """About ``most`` rows of each label, those of the lowest hashes of their place and candidate."""
    return lowest_hashes(labelled, "label", [*place, "candidate"], most)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    every = candidates(docs, path="source").unionByName(assigned_values(docs, path="source"))
    found = materialise(with_features(every, common_words(docs)).select("key", "at", "nth", "candidate", *FEATURES), "secrets-found")
    scored = score(found, fit(training_rows(found.withColumn("label", weak_label()))))
    return scored.select(F.col("key").alias("doc_id"), "at", "nth", "candidate", F.round("probability", 6).alias("probability"), (F.col("probability") >= 0.5).alias("secret"))
