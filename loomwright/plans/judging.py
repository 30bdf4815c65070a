"""Screening and judging: groups of tests, a budget of questions in two stages, and a judge that is any callable."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import cache_split
from ..operators.ranking import numbered
from .policy import Settings

#: A judge answers questions(qkey, question) with (qkey, score); a question without a row has no answer.
Judge = Callable[[DataFrame], DataFrame]


def open_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates that nothing forces and coverage doesn't rule out."""
    return candidates.filter(F.col("must").isNull() & ~F.coalesce(F.col("gated"), F.lit(False)))


def test_groups(candidates: DataFrame) -> DataFrame:
    """(file, module, first, members, evidence): open candidates (position, file, module, bonus, must, gated) by file and
    module; first is the least position, evidence whether any has a bonus."""
    found = open_candidates(candidates).groupBy("file", "module")
    return found.agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("members"), F.max(F.col("bonus") > 0).alias("evidence"))


def screening_plan(groups: DataFrame, budget: int) -> DataFrame:
    """``groups`` with screen: kept-evidence, single (nothing to ask for one test), ask, or overbudget. Each question costs
    one, in order of the groups."""
    certain = F.when(F.col("evidence"), "kept-evidence").when(F.col("members") == 1, "single")
    rows = groups.withColumn("screen", certain)
    asked = numbered(rows.filter("screen IS NULL"), "first").withColumn("screen", F.when(F.col("number") <= budget, "ask").otherwise("overbudget")).drop("number")
    return rows.filter("screen IS NOT NULL").unionByName(asked)


def screened(planned: DataFrame, answers: DataFrame, threshold: float, cached_only: bool = False) -> DataFrame:
    """``planned`` groups with screen and group_score after answers(file, module, score): a group below the threshold is
    dropped; without an answer it is failed, or uncached if nothing but the cache was asked."""
    rows = planned.join(answers.select("file", "module", F.col("score").alias("group_score")), ["file", "module"], "left")
    lost = F.lit("uncached" if cached_only else "failed")
    answer = F.when(F.col("group_score").isNull(), lost).when(F.col("group_score") < threshold, "dropped").otherwise("kept")
    asked = F.col("screen") == "ask"
    return rows.withColumn("group_score", F.when(asked, F.col("group_score"))).withColumn("screen", F.when(asked, answer).otherwise(F.col("screen")))


def judging_plan(candidates: DataFrame, groups: DataFrame, budget: int, views: int) -> DataFrame:
    """Open candidates with their group's screen and judge: ask for those that survived and whose ``views`` questions fit
    what the screening left of the budget, all of a test or none, in order of position; overbudget for the rest of them."""
    asked = groups.agg(F.count_if(F.col("screen").isin("ask", "kept", "dropped", "failed", "uncached")).alias("_asked"))  # one row
    rows = open_candidates(candidates).join(groups.select("file", "module", "screen", *(c for c in ("group_score",) if c in groups.columns)), ["file", "module"])
    survives = F.col("screen").isin("kept-evidence", "single", "kept")
    left = numbered(rows.filter(survives), "position").crossJoin(F.broadcast(asked))
    fits = F.col("number") * views <= F.lit(budget) - F.col("_asked")
    judged = left.withColumn("judge", F.when(fits, "ask").otherwise("overbudget")).drop("number", "_asked")
    return judged.unionByName(rows.filter(~survives).withColumn("judge", F.lit("notasked")))


def view_scores(planned: DataFrame, answers: DataFrame, views: tuple[str, ...] = ("names", "body")) -> DataFrame:
    """``planned`` candidates with a score for each view from answers(test_id, view, score), and judge: judged if any view
    has one, failed if none of an asked test has."""
    wide = answers.groupBy("test_id").pivot("view", list(views)).agg(F.first("score"))
    rows = planned.join(wide, "test_id", "left")
    answered = F.coalesce(*(F.col(v) for v in views)).isNotNull()
    return rows.withColumn("judge", F.when(F.col("judge") == "ask", F.when(answered, "judged").otherwise("failed")).otherwise(F.col("judge")))


def ask(questions: DataFrame, log: DataFrame, judge: Judge | None) -> tuple[DataFrame, DataFrame]:
    """(answers (qkey, score), fresh ones among them) of questions(qkey, question): from the log, and from the judge for the
    rest; without a judge only the log answers."""
    known, missing = cache_split(questions, log.select("qkey", "score"), "qkey")
    if judge is None:
        fresh = known.select("qkey", "score").limit(0)
    else:
        fresh = judge(missing.select("qkey", "question").dropDuplicates(["qkey"])).select("qkey", "score")
    return known.select("qkey", "score").unionByName(fresh), fresh


def halved(batch: list, ask_batch: Callable[[list], list | None]) -> list:
    """Answers to a batch that may be refused for its size (None): it is asked in halves then. A single question that is
    refused has no answer (None); an answer of the wrong length fails its whole batch."""
    out, parts = [], [batch]
    while parts:
        part = parts.pop()
        found = ask_batch(part) if part else []
        if found is None and len(part) > 1:
            middle = len(part) // 2
            parts += [part[middle:], part[:middle]]
        else:
            out += found if found is not None and len(found) == len(part) else [None] * len(part)
    return out


class Unavailable(Exception):
    """A judge that can't answer now, with the status that it gave."""

    def __init__(self, status: int):
        super().__init__(status)
        self.status = status


#: Statuses that pass: another attempt is worth its while (fixed values).
PASSING = (429, 503, 529)


def retried(ask_batch: Callable[[list], list | None], attempts: int = 3, pause: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable[[list], list | None]:
    """``ask_batch`` with so many attempts in all while it is ``Unavailable`` for a passing status, the pause between them
    doubling each time."""

    def asked(batch: list) -> list | None:
        for n in range(attempts):
            try:
                return ask_batch(batch)
            except Unavailable as refusal:
                if refusal.status not in PASSING or n + 1 == attempts:
                    raise
            sleep(pause * 2**n)
        return []

    return asked


def breaking(ask_batch: Callable[[list], list | None]) -> Callable[[list], list | None]:
    """``ask_batch`` until it fails once; that batch and all later ones have no answers, and nothing more is asked."""
    broken = False

    def asked(batch: list) -> list | None:
        nonlocal broken
        if not broken:
            try:
                return ask_batch(batch)
            except Exception:  # noqa: BLE001  any failure opens the circuit
                broken = True
        return []

    return asked


def batched_judge(ask_batch: Callable[[list[str]], list[float] | None], batch: int = Settings.judge_batch, attempts: int = 1, pause: float = 0.5) -> Judge:
    """A judge that asks so many questions at a time inside its tasks, with so many attempts. After a failure a task asks no
    more: each has a circuit breaker of its own, and what it leaves has no answer."""
    import pandas as pd

    def answer(frames):  # noqa: ANN001, ANN202
        asked = breaking(retried(ask_batch, attempts, pause))
        for frame in frames:
            for n in range(0, len(frame), batch):
                part = frame.iloc[n : n + batch]
                yield pd.DataFrame({"qkey": part["qkey"], "score": pd.array(halved(part["question"].tolist(), asked), dtype="Float64")}).dropna()

    return lambda questions: questions.select("qkey", "question").mapInPandas(answer, "qkey string, score double")


def group_questions(groups: DataFrame, names: DataFrame, most_chars: int = 600) -> DataFrame:
    """(file, module, question): a question about each group as a JSON object; names(file, module, name), cut at so many
    characters."""
    own = names.groupBy("file", "module").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("tests"))
    fields = F.struct("file", "module", F.substring("tests", 1, most_chars).alias("tests"))
    return groups.select("file", "module").join(own, ["file", "module"]).select("file", "module", F.to_json(fields).alias("question"))


def parse_answers(responses: DataFrame, questions: DataFrame, field: str = "score") -> tuple[DataFrame, DataFrame]:
    """(answers (qkey, score), batches (batch, asked, input_tokens, output_tokens, failure)) of responses(batch, text) to
    questions(batch, place, qkey), places from 0 on.

    A response names its answers by place (t0, t1, ...); ``field`` is the name of the number in an answer. A batch counts as a whole: if its response is missing, is no JSON or
    lacks one of its answers, none of it is taken, failure says why, and its usage is 0.
    """
    shape = f"answers map<string, struct<`{field}`:double>>, usage struct<input_tokens:bigint,output_tokens:bigint>"
    read = responses.select("batch", F.from_json("text", shape).alias("r")).select("batch", "r.answers", "r.usage")
    asked = questions.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("place", "qkey"))).alias("q"))
    given = lambda x: F.col("answers")[F.concat(F.lit("t"), x["place"].cast("string"))][field]
    score = lambda x: F.when(~F.isnan(given(x)), given(x))
    rows = asked.join(read.withColumn("_r", F.lit(True)), "batch", "left").withColumn("s", F.transform("q", lambda x: F.struct(x["qkey"].alias("qkey"), score(x).alias("score"))))
    lacking = F.exists("s", lambda x: x["score"].isNull())
    failure = F.when(F.col("_r").isNull(), "no response").when(F.col("answers").isNull(), "response without answers").when(lacking, "answers missing")
    told = rows.withColumn("failure", failure)
    tokens = lambda k: F.when(F.col("failure").isNull(), F.coalesce(F.col(f"usage.{k}"), F.lit(0))).otherwise(0).cast("long").alias(k)
    taken = told.filter("failure IS NULL").select(F.explode("s").alias("x")).select("x.qkey", "x.score")
    return taken, told.select("batch", F.size("q").alias("asked"), tokens("input_tokens"), tokens("output_tokens"), "failure")
