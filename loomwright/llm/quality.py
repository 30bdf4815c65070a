"""Quality rules: a decision list of threshold conjunctions learned by sequential covering, in DataFrame functions only.

Statistics of a text are array functions inside its row, so nothing is shuffled and a long text costs n log n. Rules are
grown on two thirds of a bounded sample of labelled rows by information gain and pruned on the rest; every step is one
Spark aggregation over binned statistics that returns a row for each statistic and bin. The list becomes one ordered
conditional expression.

Defined cases: a null or empty text has no words and fails the base rule; a label of null, or without its document, is
not learned from; with too few labelled rows of either class the list is empty and keeps all that passes the base rule;
repeated rows are judged alike; an empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import lowest_hashes
from .storage import materialise
from .tables import free_name, table

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: The fit takes about so many labelled rows of each class, those of the lowest hashes of their keys.
FIT_ROWS = 20_000
BINS = 32
MAX_RULES = 8
MAX_CONDITIONS = 4
MIN_PRECISION = 0.97
MIN_COVER = 0.01


def let(value: Column, use) -> Column:  # noqa: ANN001
    """``use`` of a value that is evaluated once for a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def _repeated(items: Column, field: str) -> Column:
    """The items of a sorted array of structs whose field equals that of a neighbour."""
    return let(items, lambda s: F.filter(s, lambda x, k: _same(F.get(s, k - 1)[field], x[field]) | _same(F.get(s, k + 1)[field], x[field])))


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that stand twice or more in the array.

    Windows with equal hashes are found by sorting, then compared as words, so the count is exact.
    """

    def exact(w: Column, found: Column) -> Column:
        named = F.sort_array(F.transform(found, lambda x: F.struct(F.concat_ws(" ", F.slice(w, x["i"] + 1, 3)).alias("g"), x["i"].alias("i"))))
        places = F.sort_array(F.transform(_repeated(named, "g"), lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    def count(w: Column, h: Column) -> Column:
        paired = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(w, _repeated(paired, "h")))

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows(w), lambda h: count(w, h)))).cast("long")


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts and those of the ratios that rules are learned from; of the input columns only those
    named as the counts are replaced."""
    words = free_name(docs, "words")
    t = F.coalesce(F.col(text), F.lit(""))
    removed = lambda x, chars: F.length(x) - F.length(F.translate(x, chars, ""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lines = lambda x: F.filter(F.split(x, "\n"), lambda s: F.length(F.translate(s, "\x20\x09\x0a\x0b\x0c\x0d", "")) > 0)
    rows = docs.withColumn(words, F.array_remove(F.split(t, SPACES), ""))
    rows = rows.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(t, "\x20\x09\x0a\x0b\x0c\x0d", "")).cast("long"),
        "n_symbols": removed(t, SYMBOLS).cast("long"),
        "n_dup_lines": let(lines(t), lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long"),
        "n_repeat_words": repeat_words(F.col(words)),
        "n_distinct": F.size(F.array_distinct(words)).cast("long"),
        "n_upper": removed(t, upper).cast("long"),
        "n_marks": removed(t, "!?").cast("long"),
        "n_digits": removed(t, "0123456789").cast("long"),
    })
    return rows.drop(words)


#: Ratios by name: numerator and denominator among the counts.
RATIOS = {"symbols_per_word": ("n_symbols", "n_words"), "repeated": ("n_repeat_words", "n_words"), "duplicate_lines": ("n_dup_lines", "n_words"), "distinct": ("n_distinct", "n_words"), "upper": ("n_upper", "word_chars"), "marks_per_word": ("n_marks", "n_words"), "digits": ("n_digits", "word_chars"), "word_length": ("word_chars", "n_words")}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_marks", "n_digits")


def ratio(name: str) -> Column:
    top, bottom = RATIOS[name]
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1)).cast("double")


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return ratio(self.name) > self.threshold if self.above else ratio(self.name) <= self.threshold


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def learn_rules(statistics: DataFrame, bad: Column, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS, min_precision: float = MIN_PRECISION, min_cover: float = MIN_COVER) -> list[Rule]:
    """Ordered rules that say ``bad``, from a small table of text_statistics with a key column ``_fold`` (0 to 2)."""
    names = list(RATIOS)
    cuts = statistics.agg(*(F.percentile_approx(ratio(n), [k / BINS for k in range(1, BINS)], 10_000).alias(n) for n in names)).first()
    cuts = {n: sorted(set(cuts[n] or [])) for n in names}
    place = lambda n: F.size(F.filter(F.array(*map(F.lit, cuts[n])).cast("array<double>"), lambda c: ratio(n) > c))
    rows = statistics.withColumn("_bad", bad).withColumn("_bins", F.array(*map(place, names))).persist()
    total = rows.filter("_bad").count()
    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules and total:
        rule = _grow(rows.filter(left & (F.col("_fold") > 0)), names, cuts, max_conditions)
        rule = _prune(rows.filter(left & (F.col("_fold") == 0)), rule, min_precision, min_cover * total / 3)
        if not rule:
            break
        rules.append(rule)
        left = left & ~_all(rule)
    rows.unpersist()
    return rules


def _grow(rows: DataFrame, names: list[str], cuts: dict[str, list[float]], most: int) -> Rule:
    rule: Rule = ()
    while len(rule) < most:
        bins = rows.filter(_all(rule)).select(F.posexplode("_bins").alias("f", "bin"), "_bad").groupBy("f", "bin").agg(F.count_if("_bad").alias("p"), F.count_if(~F.col("_bad")).alias("n")).collect()
        counts = {n: [[0, 0] for _ in range(len(cuts[n]) + 1)] for n in names}
        for r in bins:
            counts[names[r["f"]]][r["bin"]] = [r["p"], r["n"]]
        all_p, all_n = (sum(x[k] for x in counts[names[0]]) for k in (0, 1))
        if not all_p or not all_n:
            break
        before = math.log2(all_p / (all_p + all_n))
        best = (1e-9, None)
        for name in names:
            p = n = 0
            for cut, (dp, dn) in zip(cuts[name], counts[name]):
                p, n = p + dp, n + dn
                for above, pp, nn in ((False, p, n), (True, all_p - p, all_n - n)):
                    if pp and (gain := pp * (math.log2(pp / (pp + nn)) - before)) > best[0]:
                        best = (gain, Condition(name, above, cut))
        if best[1] is None:
            break
        rule += (best[1],)
    return rule


def _prune(rows: DataFrame, rule: Rule, min_precision: float, min_cover: float) -> Rule:
    """The shortest beginning of a rule with the best worth on held-out rows; none if it is not precise enough."""
    if not rule:
        return ()
    sums = rows.agg(*(F.count_if(_all(rule[:k]) & (F.col("_bad") if bad else ~F.col("_bad"))).alias(f"{'p' if bad else 'n'}{k}") for k in range(1, len(rule) + 1) for bad in (True, False))).first()
    worth = lambda k: (sums[f"p{k}"] - sums[f"n{k}"]) / max(1, sums[f"p{k}"] + sums[f"n{k}"])
    k = max(range(1, len(rule) + 1), key=lambda k: (round(worth(k), 3), -k))
    p, n = sums[f"p{k}"], sums[f"n{k}"]
    return rule[:k] if p and p >= min_cover and p >= min_precision * (p + n) else ()


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(kept, number of the rule that fires or 0) as ordered conditional expressions."""
    kept, fired = F.lit(True), F.lit(0)
    for number, rule in reversed(list(enumerate(rules, 1))):
        kept, fired = F.when(_all(rule), F.lit(False)).otherwise(kept), F.when(_all(rule), F.lit(number)).otherwise(fired)
    return kept, fired


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS, **options) -> list[Rule]:  # noqa: ANN003
    """Rules for label 0 from about ``fit_rows`` labelled rows of each class, so rare ones are learned from as well. The
    sampled labels are bounded, so they are broadcast."""
    usable = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    sample = lowest_hashes(usable, "_label", ["_key"], fit_rows).withColumn("_fold", (F.pmod(F.xxhash64("_key", F.lit("fold")), F.lit(3))).cast("int"))
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(sample), F.col("_id") == F.col("_key"))
    fitted = materialise(text_statistics(rows).select("_fold", "_label", *COUNTS), "quality-fit")
    return learn_rules(fitted.coalesce(1), F.col("_label") == 0, **options)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    kept, fired = verdict(rules)
    rows = text_statistics(docs.select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & kept).alias("kept"), fired.alias("rule"))
