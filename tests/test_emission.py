"""Plan emission for both runners, ranking without one-task limits, and the order of appended answers."""

import time

from pyspark.sql import functions as F

from loomwright.operators import ranking
from loomwright.plans import emission
from loomwright.sources import readers


def tables(spark, candidates):
    return (
        spark.createDataFrame(candidates, "pkg int, module string, name string, must string, selected boolean"),
        spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 2)], "pkg int, hops int"),
        spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (4, "four"), (5, "five")], "pkg int, name string"),
        spark.createDataFrame([(3,), (5,)], "pkg int"),
    )


CANDIDATES = [(1, "m", "b", "changed", True), (1, "m", "a", None, True), (1, "", "a", None, True), (1, "", "z", None, False), (2, "x", "t", None, True), (3, "x", "u", "changed", True), (4, "x", "v", None, False)]


def test_filter_and_command(spark):
    terms = emission.package_terms(*tables(spark, CANDIDATES))
    assert [tuple(r) for r in terms.orderBy("hops", "name").collect()] == [(0, "three", "package(=three)", None), (0, "two", "package(=two) & test(/(^|::)(t)($|::)/)", None), (1, "one", "package(=one) & test(/(^|::)(a|b)($|::)/)", "package(=one) & test(/(^|::)(b)($|::)/)")]
    chosen = "(package(=three)) | (package(=two) & test(/(^|::)(t)($|::)/)) | (package(=one) & test(/(^|::)(a|b)($|::)/))"
    row = emission.filter_plan(terms).first()
    assert row["filter"] == chosen and row["command"] == ["cargo", "nextest", "run", "-p", "three", "-p", "two", "-p", "one", "-E", chosen]
    row = emission.filter_plan(terms, ("test(s)",), ("package(=two)", "package(=new)"), more=("-q",)).first()
    want = f"(({chosen}) & not (test(s))) | (package(=one) & test(/(^|::)(b)($|::)/)) | (package(=two)) | (package(=new))"
    assert row["filter"] == want and row["command"][3:] == ["-p", "three", "-p", "two", "-p", "one", "-p", "new", "-E", want, "-q"]
    assert emission.filter_plan(terms, extras=("test(any)",)).first()["command"][3:5] == ["--workspace", "-E"]
    nothing = terms.limit(0)
    assert tuple(emission.filter_plan(nothing).first()) == (None, None)
    assert emission.filter_plan(nothing, extras=("package(=p)",)).first()["command"] == ["cargo", "nextest", "run", "-p", "p", "-E", "(package(=p))"]
    assert tuple(emission.filter_plan(nothing, full=True).first()) == (None, ["cargo", "nextest", "run", "--workspace"])
    assert emission.filter_plan(terms, ("a", "b"), full=True).first()["command"][3:] == ["--workspace", "-E", "all() & not (a | b)"]


def test_commands_by_package(spark):
    candidates, reached, packages, whole = tables(spark, CANDIDATES)
    rows = emission.package_commands(candidates, reached, packages, whole, ("package(=one)", "test(x)", "package(=new name)"), more=("-q",))
    lines = {r["name"]: (r["hops"], r["line"]) for r in rows.withColumn("line", emission.command_line(F.col("command"))).collect()}
    assert lines == {"three": (0, "cargo test -p three -q"), "two": (0, "cargo test -p two -q -- x::t"), "one": (1, "cargo test -p one -q"), "new name": (None, "cargo test -p 'new name' -q")}
    assert emission.package_commands(candidates, reached, packages, whole).filter("name = 'one'").first()["command"] == ["cargo", "test", "-p", "one", "--", "a", "m::a", "m::b"]
    assert [r["command"] for r in emission.package_commands(candidates, reached, packages, whole, full=True).collect()] == [["cargo", "test", "--workspace"]]
    assert sorted(r["note"] for r in emission.runner_notes(spark, ("a",), ("package(=x)", "test(y)")).collect()) == ["a runner without filters ignores: a", "no runner without filters can express: test(y)"]
    assert emission.runner_notes(spark, (), ()).count() == 0


def test_budgets_and_padding(spark):
    rows = spark.range(50).select(F.col("id").alias("p"), (F.col("id") % 7).alias("k"), (F.col("id") % 9 == 0).alias("sel"))
    assert sorted(r["p"] for r in ranking.within_budget(rows.repartition(5), "p", 3, 31).collect()) == list(range(10))
    assert ranking.min_pad(rows, "sel", "k", "p", F.count_if("sel") + 2).filter("padded").count() == 2


def test_later_appends_win(spark, tmp_path):
    path = str(tmp_path / "log")
    for n in range(4):
        readers.append_answers(spark.createDataFrame([("k", 0.1 * n), (f"only{n}", 1.0)], "qkey string, score double").repartition(2), path)
        time.sleep(1.1)
    found = {r["qkey"]: r["score"] for r in readers.answer_log(spark, path).collect()}
    assert found == {"k": 0.1 * 3, "only0": 1.0, "only1": 1.0, "only2": 1.0, "only3": 1.0}
