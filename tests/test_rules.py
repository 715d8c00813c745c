"""Patterns, rules, scripts, scans and sinks in cases that the tables don't have."""

import pytest
from pyspark.sql import functions as F

from pathloom.functions import constraints, facts
from pathloom.plans import patterns, rules
from pathloom.sources import scans, sinks


@pytest.mark.parametrize("text", ["", "a;", "a when", "(a | b & c)", "a; )", "a{x=}", "<... a"])
def test_bad_patterns(text):
    with pytest.raises(ValueError):
        patterns.compiled(text)


def test_optional_items_give_two_ways():
    assert patterns.compiled("a; ?b; c") == patterns.SeqOr(patterns.compiled("a; b; c"), patterns.compiled("a; c"))


def test_a_script_that_rejects_all_resets(spark):
    env = spark.createDataFrame([("1", ["r"])], "x string, matched array<string>")
    out = rules.script(env, ["x"], ["y"], lambda x: None)
    assert out.columns == ["matched"] and out.collect()[0].matched == []


def test_defaults_and_unbound_inputs(spark):
    env = spark.createDataFrame([("1", None, ["r"]), (None, "z", ["r"])], "x string, w string, matched array<string>")
    out = rules.script(env, ["x", "w"], ["y"], lambda x, w: {"y": x + w}, defaults={"w": "d"})
    assert {(r.x, r.y) for r in out.collect()} == {("1", "1d"), (None, None)}


def test_iteration_takes_runs_on_files_first():
    seen = []

    def step(run):
        seen.append(run[2])
        return run, [(("f",), (), 2), ((), (), 3)] if run[2] == 1 else []

    rules.iterate([((), (), 1), ((), (), 4)], step)
    assert seen == [1, 2, 4, 3]


def test_groups_and_ranges(spark):
    lists = spark.createDataFrame([(1, "a.c:3-9,-5\nb.c\n\n \nc.c: 7\n")], "id long, text string")
    found = {tuple(r)[1:] for r in scans.groups(lists).collect()}
    assert found == {(0, "a.c", 3, 9, True), (0, "a.c", 5, 5, False), (0, "b.c", None, None, None), (1, "c.c", 7, 7, True)}


def test_facts_are_looked_up_greedily(spark):
    """The latest begin decides, even if no end of it reaches far enough; broken lines are left out."""
    lines = spark.createDataFrame([("f;1;9;ints;2, 1",), ("f;3;4;bounds;..5",), ("f;3;6;other;x",), ("f;7;5;ints;1",), ("junk",), ("f;a;5;ints;1",)], "value string")
    f = facts.scan(lines)
    assert f.count() == 3
    asked = spark.createDataFrame([(1, "f", 3, 5), (2, "f", 5, 8), (3, "f", 2, 9), (4, "g", 1, 1)], "id long, file string, p long, q long")
    assert {(r.id, r.begin, r.end) for r in facts.find(asked, f).collect()} == {(1, 3, 6), (3, 1, 9)}


def test_integers_with_suffixes(spark):
    df = spark.createDataFrame([("12UL",), ("-3",), ("x",), (None,)], "v string")
    got = [r.n for r in df.select(constraints.integer(F.col("v")).alias("n")).collect()]
    assert got == [12, -3, None, None]


def test_edits_and_conflicts(spark):
    texts = spark.createDataFrame([("f", "abcdef"), ("g", "x")], "file string, text string")
    edits = spark.createDataFrame([("f", 1, 2, "X"), ("f", 4, 0, "+"), ("f", 6, 0, "!")], "file string, offset int, length int, new string")
    assert {tuple(r) for r in rules.applied(texts, edits).collect()} == {("f", "aXd+ef!"), ("g", "x")}
    assert rules.conflicts(edits).isEmpty()
    more = edits.union(spark.createDataFrame([("f", 2, 1, "")], edits.schema))
    assert [r.offset for r in rules.conflicts(more).collect()] == [2]


def test_disagreeing_results_are_dropped(spark):
    good, bad = sinks.agreed(spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("b", "2")], "file string, text string"))
    assert [r.file for r in good.collect()] == ["a"] and [r.file for r in bad.collect()] == ["b"]


def test_text_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one\ntwo")
    rows = scans.texts(spark, str(tmp_path), "*.txt").collect()
    assert [r.text for r in rows] == ["one\ntwo"] and rows[0].path.endswith("a.txt")
