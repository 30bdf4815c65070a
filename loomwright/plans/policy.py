"""The selection policy: settings, bonuses, the order of reasons, caps and the final plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import names_term, view_score
from ..operators.ranking import max_cap, min_pad, numbered


@dataclass(frozen=True)
class Settings:
    """Fixed defaults of the selection."""

    top_n: int = 30
    top_fraction: float = 0.25
    threshold: float = 0.85
    group_threshold: float = 0.1
    max_tests: int = 0
    min_tests: int = 0
    call_graph_depth: int = 2
    reach_depth: int = 0
    on_judge_error: str = "reach"
    without_judge: str = "reach"
    static_bonus: float = 0.2
    covered_bonus: float = 0.3
    judge_batch: int = 100
    judge_questions: int = 6000
    max_files: int = 60
    max_lines: int = 3000
    ignore: tuple[str, ...] = ("**/*.md", "docs/**", ".github/**")
    full_run: tuple[str, ...] = ("rust-toolchain", "rust-toolchain.toml", ".cargo/**", ".config/nextest.toml")


def bonus(settings: Settings, boosting: bool) -> Column:
    """Nothing for forced tests; more for covered ones if coverage boosts; some for static evidence."""
    covered = F.lit(boosting) & (F.coalesce(F.col("n_hit"), F.lit(0)) > 0)
    static = F.col("evidence_kind").isin("Direct", "Helper", "Transitive")
    return F.when(F.col("must").isNotNull(), 0.0).when(covered, settings.covered_bonus).when(static, settings.static_bonus).otherwise(0.0)


def rank_views(candidates: DataFrame, settings: Settings) -> DataFrame:
    """Candidates with score, rank_names, rank_body and the caps of both views, which count what the view ranked."""
    rows = candidates.withColumn("score", view_score(F.col("names"), F.col("body"), F.col("bonus")))
    views = ("names", "body")
    each = rows.select("test_id", F.inline(F.array(*(F.struct(F.lit(v).alias("view"), F.least(F.when(F.col(v).isNotNull(), F.col(v) + F.col("bonus")), F.when(F.col(v).isNotNull(), F.lit(1.0))).alias("s")) for v in views))))
    placed = numbered(each.filter("s IS NOT NULL"), F.col("s").desc(), F.col("test_id"), within="view")  # both views at once
    ranks = placed.groupBy("test_id").agg(*(F.max(F.when(F.col("view") == v, F.col("number"))).alias(f"rank_{v}") for v in views))
    caps = rows.agg(*(F.least(F.lit(settings.top_n), F.ceil(F.lit(settings.top_fraction) * F.count(v))).alias(f"cap_{v}") for v in views))
    return rows.join(ranks, "test_id", "left").crossJoin(F.broadcast(caps))  # the caps are one row


def reasons(settings: Settings, judge_on: bool, judge_failed: bool) -> Column:
    """The reasons of a candidate as an array: the first kind that applies, in the policy's order."""
    one = lambda text: F.array(F.lit(text))
    judged = F.array_compact(F.array(F.when(F.col("rank_names") <= F.col("cap_names"), "top-n:names"), F.when(F.col("rank_body") <= F.col("cap_body"), "top-n:body"), F.when(F.col("score") >= settings.threshold, "threshold")))
    cascade = F.when(F.col("must").isNotNull(), F.array("must")).when(F.col("gated"), one("not-covered"))
    if not judge_on:
        if settings.without_judge == "reach":
            return cascade.otherwise(one("reach"))
        return cascade.when(F.col("evidence_kind").isNotNull(), one("evidence")).otherwise(one("no-evidence"))
    if judge_failed and settings.on_judge_error == "reach":
        return cascade.otherwise(one("judge-error"))
    state = lambda name: (F.col("screen") == name) | (F.col("judge") == name)
    return (
        cascade.when(F.col("screen") == "dropped", one("screened-out"))
        .when(state("overbudget"), one("unjudged"))
        .when(state("uncached"), one("uncached"))
        .when(state("failed"), one("judge-failed"))
        .when(F.col("judge") == "judged", F.when(F.size(judged) > 0, judged).otherwise(one("below-cut")))
        .otherwise(one("unjudged"))
    )


def decide(candidates: DataFrame, settings: Settings = Settings(), judge_on: bool = True, judge_failed: bool = False) -> DataFrame:
    """Ranked candidates with reasons and selected, after the caps.

    candidates(test_id, must, gated, evidence_kind, screen, judge, names, body, bonus, group_score).
    """
    rows = rank_views(candidates, settings).withColumn("reasons", reasons(settings, judge_on, judge_failed))
    first = F.col("reasons")[0]
    rows = rows.withColumn("selected", F.col("must").isNotNull() | ~first.isin("not-covered", "no-evidence", "screened-out", "below-cut", "judge-failed"))
    rows = rows.withColumn("key", F.greatest(F.coalesce("score", "group_score", F.lit(0.0)), F.col("bonus")))
    if settings.max_tests:
        rows = max_cap(rows.withColumn("forced", F.col("must").isNotNull()), "selected", "forced", "key", "test_id", settings.max_tests)
        rows = rows.withColumn("reasons", F.when(F.col("capped"), F.array_append("reasons", F.lit("max-tests"))).otherwise(F.col("reasons"))).drop("capped", "forced")
    if settings.min_tests:
        rows = min_pad(rows, "selected", "key", "test_id", settings.min_tests)
        rows = rows.withColumn("reasons", F.when(F.col("padded"), F.array_append("reasons", F.lit("min-tests"))).otherwise(F.col("reasons"))).drop("padded")
    return rows


def keep_expression(selected: Column, never: Column, changed: Column) -> Column:
    """Selected and not quarantined; tests that changed run all the same."""
    return (selected & ~never) | changed


def plan_terms(selected: DataFrame, package: str, name: str) -> DataFrame:
    """(package, term): one filter term for each package's selected tests."""
    names = selected.groupBy(package).agg(F.collect_set(name).alias("names"))
    return names.select(package, names_term(F.col(package), F.col("names")).alias("term"))


def summary(decided: DataFrame) -> DataFrame:
    """(layer, n): how many candidates each layer of the selection touched, and by which reason tests were picked; the
    exclusive counts are of tests that only that reason picked."""
    has = lambda text: F.array_contains("reasons", text)
    top, sure = has("top-n:names") | has("top-n:body"), has("threshold")
    layers = {
        "candidates": F.lit(True), "forced": F.col("must").isNotNull(), "not covered": has("not-covered"), "screened out": has("screened-out"),
        "judged": F.col("judge") == "judged", "top of a view": top, "threshold": sure, "only top of a view": top & ~sure, "only threshold": sure & ~top,
        "unjudged": has("unjudged"), "selected": F.col("selected"),
    }
    counts = decided.agg(*(F.count_if(v).alias(k) for k, v in layers.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("layer"), F.col(f"`{k}`").alias("n")) for k in layers))).alias("x")).select("x.*")


def explain(decided: DataFrame, name: str, part: str) -> DataFrame:
    """(name, why) of the candidates whose name contains ``part``: verdict and reasons, and, where the columns are there,
    coverage (n_hit), evidence and the ranks in both views."""
    has = set(decided.columns)
    parts = [F.concat(F.when(F.col("selected"), "selected: ").otherwise("skipped: "), F.array_join("reasons", ", "))]
    if "n_hit" in has:
        parts.append(F.when(F.col("n_hit").isNull(), "coverage unknown").when(F.col("n_hit") == 0, "covers no changed function").otherwise(F.format_string("covers %d changed", "n_hit")))
    if "evidence_kind" in has:
        parts.append(F.concat(F.lit("evidence "), F.col("evidence_kind")))
    parts += [F.concat(F.lit(f"rank {v} "), F.col(f"rank_{v}").cast("string")) for v in ("names", "body") if f"rank_{v}" in has]
    return decided.filter(F.col(name).contains(part)).select(name, F.concat_ws("; ", *parts).alias("why"))


def report(decided: DataFrame, *columns: str) -> DataFrame:
    """(value): each candidate as a JSON object of the columns, absent ones left out."""
    return decided.select(F.to_json(F.struct(*columns)).alias("value"))


def usage_cost(usage: DataFrame, per_million: float = 0.042) -> DataFrame:
    """One row of sums over usage(requests, input_tokens, output_tokens), with the price of the input tokens."""
    sums = usage.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("requests", "input_tokens", "output_tokens")))
    return sums.withColumn("cost", F.col("input_tokens") * F.lit(per_million / 1_000_000))


def report_lines(decided: DataFrame, package: str, name: str, place: str) -> DataFrame:
    """Selected tests as tab-separated lines."""
    return decided.filter("selected").select(F.concat_ws("\t", package, name, place).alias("value"))
