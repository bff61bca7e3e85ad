"""Patterns on long texts, caps, stored history, staged tables, parsed JSON."""

import random
import time

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import fixed
from reviewlake.functions.text import hits, strip_c_comments
from reviewlake.operators import history
from reviewlake.operators.features import _squeezed, distinct_snippets
from reviewlake.operators.nodes import node_table
from reviewlake.operators.rules_python import unused_variables
from reviewlake.plans import inputs
from reviewlake.sources import sinks, stage
from tests.conftest import code_frame

# The same patterns with repeats that step back, as the rules state them.
PLAIN_PANEL = r"^\s*(?:[\w:<>\[\],*&]+\s+)+[A-Za-z_]\w*\s*\([^;{}]*\)\s*(?:\{|$)"
PLAIN_DECLARATION = fixed.DECLARATION.replace(r"^\s*+", r"^\s*")
PIECES = ["int ", "foo", "(", ")", " {", "\n", "\n\n", "  ", "static ", "a*", "<T> ", "x, y", ";", "}", "/*", "*/", "//", "if "]


def counted(spark, codes, column):
    return [r[0] for r in code_frame(spark, codes).orderBy("snippet_id").select(column).collect()]


def test_linear_patterns_count_the_same(spark):
    rng = random.Random(5)
    codes = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 25))) for _ in range(4000)]
    code = F.col("code")
    assert counted(spark, codes, hits(code, PLAIN_PANEL, "m")) == counted(
        spark, codes, hits(_squeezed(code), fixed.PANEL_FUNCTION, "m"))
    assert counted(spark, codes, hits(code, PLAIN_DECLARATION, "m")) == counted(
        spark, codes, hits(_squeezed(code), fixed.DECLARATION, "m"))
    plain = F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")
    assert counted(spark, codes, plain) == counted(spark, codes, strip_c_comments(code))


@pytest.mark.parametrize("text", ["word " * 100_000, "\n" * 100_000, "/* a " * 100_000, "int f(\n" * 2000])
def test_long_texts_end_soon(spark, text):
    start = time.time()
    clean = strip_c_comments(F.col("code"))
    counted(spark, [text], hits(_squeezed(clean), fixed.PANEL_FUNCTION, "m") + hits(_squeezed(clean), fixed.DECLARATION, "m"))
    assert time.time() - start < 20


def test_order_of_many_targets(spark):
    names = [f"v{i}" for i in range(150)]
    nodes = node_table(code_frame(spark, [" = ".join(names) + " = f()\n"], "python"))
    rows = unused_variables(nodes).select("o1", "fix").orderBy("o1").collect()
    assert len({r.o1 for r in rows}) == 150
    assert [n for r in rows for n in names if f"'{n}'" in r.fix or f" {n} " in f" {r.fix} "][:150] == names


def reviewed(spark, first, n):
    return spark.range(first, first + n).selectExpr(
        "id review_id", "1L user_id", "'x' code", "'a.py' filename", "10.0D confidence", "false syntax_error",
        "cast(null as int) error_line", "'' error_msg", "array(named_struct('name', 'N', 'line', 1, 'fix', 'F')) issues",
        "1 complexity", "timestamp'2024-01-01 00:00:00' created_at")


def test_batches_and_streams_share_a_history(spark, tmp_path):
    folder = str(tmp_path / "history")
    sinks.append_reviews(reviewed(spark, 0, 5), folder)
    sinks.append_reviews(reviewed(spark, 5, 5), folder)
    records = sinks.review_records(reviewed(spark, 10, 3))
    for run in ("s1", "s2"):        # two streams that both begin with batch 0; one batch is repeated
        sinks.write_records(records, folder, run, 0)
    sinks.write_records(records, folder, "s2", 0)
    stored = sinks.read_reviews(spark, folder)
    assert stored.count() == 16 and stored.columns == records.columns


def test_scope_deletes_what_was_staged(spark):
    with stage.stage_scope(spark):
        held = stage.staged(spark.range(3).toDF("x"), "scoped")
        path = held.inputFiles()[0].removeprefix("file://")
        assert held.count() == 3
    with pytest.raises(FileNotFoundError):
        open(path)


def test_json_is_parsed_once(spark, sf):
    stats = history.workspace_stats(inputs.parsed_reviews(spark, sf), inputs.now())
    series = history.score_series(inputs.reviews(spark, sf))
    for df in (stats, series):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_copies_are_found_without_sorting_texts(spark):
    rows = code_frame(spark, ["a", "b", "a"])
    assert sorted((r.snippet_id, r.code) for r in distinct_snippets(rows).collect()) == [(0, "a"), (1, "b")]
    kept = distinct_snippets(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in kept


def test_rows_of_a_long_elif_chain_are_linear(spark):
    code = "def f(x):\n    if x == 0:\n        return 0\n" + "".join(
        f"    elif x == {i}:\n        y = {i}\n" for i in range(1, 400)) + "    else:\n        return 1\n"
    nodes = node_table(code_frame(spark, [code], "python"))
    rows, entries, deepest = nodes.agg(F.count("*"), F.sum(F.size("path")), F.max("level")).first()
    assert entries < 3 * rows and deepest == 400
