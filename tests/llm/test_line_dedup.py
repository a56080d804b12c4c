import random

import plain
import pytest

from cliptide.llm.line_dedup import LineRuns, dedup_lines

SCHEMA = "doc_id long, text string, lines string"


def rows_of(df, doc="doc_id", out="lines_"):
    return {r[doc]: tuple(r[out]) for r in df.collect()}


def made(n=60, seed=3):
    rng = random.Random(seed)
    lines = ["short", "", "  ", "x" * 19, "y" * 20, " \tShared line number one here\x0b ", "shared LINE number one here", "É" * 20, "é" * 20, "a line that two documents hold, no more"]
    lines += [f"line {i} of a text that others have too" for i in range(12)]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9))), "own") for i in range(n)]
    return docs + [(1000, None, None), (1001, "", ""), (1002, "\n\n", ""), (1003, "shared line number one here\n" * 300, "")]


@pytest.mark.parametrize("batches,fan_in", [(1, 2), (5, 2), (6, 3)])
def test_same_as_plain(spark, batches, fan_in):
    docs = made()
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    found = dedup_lines(df, batches=batches, fan_in=fan_in)
    assert found.columns == ["doc_id", "text", "lines", "lines_"]
    assert rows_of(found) == plain.dedup_lines([d[:2] for d in docs])


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_and_null_ids(spark):
    line = "a line of more than twenty characters"
    df = spark.createDataFrame([(1, line), (1, line), (7, line), (7, line), (None, line)], "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.lines.kept) for r in dedup_lines(df).collect())
    assert found == [(0, ""), (1, ""), (1, ""), (7, line), (7, line)]


def test_runs_are_compacted_by_level(spark):
    runs = LineRuns(spark, fan_in=2)
    for batch in range(5):
        runs.add(spark.createDataFrame([(i, i, 100 - batch) for i in range(batch, batch + 3)], "h1 long, h2 long, doc_id long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    found = {r.h1: (r.n, r.holder) for r in runs.merged().collect()}
    assert found == {0: (1, 100), 1: (2, 100), 2: (3, 100), 3: (3, 99), 4: (3, 98), 5: (2, 97), 6: (1, 96)}
    runs.close()


def test_runs_on_the_main_path_are_not_shuffled_again(spark):
    runs = LineRuns(spark)
    runs.add(spark.createDataFrame([(1, 1, 1)], "h1 long, h2 long, doc_id long"))
    plan = spark.table(runs.runs()[0]).groupBy("h1", "h2").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    runs.close()


def test_runs_leave_no_files(spark):
    import os

    from cliptide.session import checkpoint_dir

    folder = os.path.join(checkpoint_dir(spark), "tables")
    held = lambda: {f for f in (os.listdir(folder) if os.path.isdir(folder) else []) if f.startswith("line_run")}
    before = held()
    rows = [(i, "a line that many share\nown line number %d here" % i) for i in range(60)]
    dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert held() == before and not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run")]
