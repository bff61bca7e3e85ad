"""Physical plans and behaviour under skew."""

import re

from pyspark.sql import functions as F

from reviewlake.operators import history, metrics, rules_clike, sampling
from reviewlake.operators.features import distinct_snippets, join_by_code
from reviewlake.operators.lines import clean_c_like, line_facts, with_review_language
from reviewlake.operators.nodes import node_table
from reviewlake.operators.rules_python import JOIN_RULES, row_issues
from reviewlake.operators.tokens import c_like_syntax
from reviewlake.plans import inputs
from reviewlake.plans.catalog import REGISTRY
from reviewlake.plans.corpus import TEMPLATES, code_corpus
from reviewlake.plans.review import review
from reviewlake.sources.stage import staged


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> list[str]:
    return re.findall(r"Exchange (?:hash|range|Round|Single)\w*\([^)]*\)", text)


def test_scan_reads_only_the_needed_columns(spark, sf):
    text = plan(inputs.snippets(spark, sf).select("snippet_id", "review_language"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "text" not in schema and "n_chars" in schema
    text = plan(inputs.reviews(spark, sf).filter("user_id = 7"))
    assert "EqualTo(user_id,7)" in text


def test_line_rules_without_loops_need_no_shuffle(spark, sf):
    facts = staged(line_facts(inputs.clean(spark, sf)), "lines")
    assert not exchanges(plan(rules_clike.line_issues(facts, ["CJ-2", "CJ-12"])))
    # One exchange and one sort serve all loop rules; the text is not in it.
    text = plan(rules_clike.line_issues(facts))
    assert len(exchanges(text)) == 1 and "hashpartitioning(snippet_id" in text


def test_a_line_rule_tests_lines_for_itself_only(spark, sf):
    # Each test for another rule, and each time that a line is stripped again, is work on every line of every text.
    text = plan(REGISTRY["text_cj_8_literal_no_semicolon"](spark, sf))
    assert text.count("trim(") == 1 and "THEN CJ-8" in text and "THEN CJ-1 " not in text and "THEN CJ-3 " not in text
    clean = staged(inputs.clean(spark, sf), "clean")
    whole = staged(rules_clike.line_issues(line_facts(clean)), "issues")
    for rule in ("CJ-1", "CJ-4", "CJ-8", "CJ-14"):
        found = rules_clike.line_issues(line_facts(clean, [rule]), [rule])
        assert found.count() and sorted(found.collect()) == sorted(whole.filter(F.col("rule") == rule).collect())


def test_function_and_bracket_windows_share_one_exchange(spark, sf):
    facts = staged(line_facts(inputs.clean(spark, sf)), "lines")
    assert len(exchanges(plan(rules_clike.function_extents(facts)))) == 1
    source = staged(inputs.snippets(spark, sf), "snippets")
    assert len(exchanges(plan(c_like_syntax(source)))) == 1


def test_row_rules_are_one_scan_without_shuffle(spark, sf):
    nodes = staged(node_table(inputs.snippets(spark, sf)), "nodes")
    text = plan(row_issues(nodes))
    assert not exchanges(text) and text.count("FileScan") == 1


def test_no_nested_loop_or_cartesian_join(spark, sf):
    source = staged(inputs.snippets(spark, sf), "snippets")
    nodes = staged(node_table(source), "nodes")
    facts = staged(line_facts(clean_c_like(source)), "lines")
    frames = [rule(nodes) for rule in JOIN_RULES.values()]
    frames += [rules_clike.c_like_issues(clean_c_like(source), facts), c_like_syntax(source),
               metrics.threshold_sweep(inputs.scored(spark, sf), {}, {}),
               metrics.rank_auc(inputs.scored(spark, sf), ["review_language"]),
               sampling.stratified_split(inputs.scored(spark, sf), ["label"], "snippet_id")]
    for frame in frames:
        text = plan(frame)
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_newest_reviews_are_limited_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(history.latest_reviews(inputs.reviews(spark, sf)))
    text = plan(history.latest_reviews(inputs.reviews(spark, sf)))
    assert text.rindex("Partial") > text.index("Exchange")


def test_hot_copies_collapse_before_the_shuffle(spark):
    hot = spark.range(30000).select(
        F.col("id").alias("snippet_id"),
        F.when(F.col("id") % 3 == 0, "def f():\n    return 1\n")
        .otherwise(F.concat(F.lit("x = "), F.col("id"))).alias("code"),
        F.lit("python").alias("review_language"))
    distinct = distinct_snippets(hot)
    text = plan(distinct)
    assert text.count("partial_min") >= 1 and text.index("Exchange") < text.index("partial_min")
    assert distinct.count() == 20001
    back = join_by_code(hot, distinct.select("code_hash", "review_language",
                                             F.col("snippet_id").alias("rep")))
    assert back.count() == 30000
    assert back.filter("rep = 0").count() == 10000


def test_rows_that_repeat_and_ids_with_two_texts(spark):
    """Each row gets the result of its own text, once, whatever ids it shares."""
    loop = "for i in range(3):\n    print(i)\n"
    rows = spark.createDataFrame([(1, loop), (1, loop), (2, "def f(:\n"), (2, "x = 1\n"), (3, loop)],
                                 "snippet_id long, code string").selectExpr("*", "'python' language", "'a.py' filename")
    with_language = rows.selectExpr("snippet_id", "code", "language review_language")
    assert sorted((r.snippet_id, r.code) for r in distinct_snippets(with_language).collect()) == [
        (1, loop), (2, "def f(:\n"), (2, "x = 1\n")]
    got = sorted((r.snippet_id, r.syntax_error, r.complexity) for r in review(rows).collect())
    alone = review(rows.filter("snippet_id = 3")).first()
    assert got == sorted([(1, False, alone.complexity)] * 2 + [(2, True, 1), (2, False, 1), (3, False, alone.complexity)])


def test_hot_text_is_split_in_the_join_back(spark):
    """One text in a third of all rows: its partition is cut and joined in parts."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
                "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 300000, 1, 8).select(
            F.col("id").alias("snippet_id"), F.lit("python").alias("review_language"),
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("code"))
        per_code = staged(rows.groupBy(F.sha2("code", 256).alias("code_hash"), "review_language")
                          .agg(F.min("snippet_id").alias("rep")), "per-code")
        joined = join_by_code(rows, per_code)
        out = joined.collect()
        assert len(out) == 300000 and sum(r.rep == 0 for r in out) == 100000
        assert "skew=true" in plan(joined)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_one_user_with_a_third_of_all_reviews(spark):
    rows = spark.range(30000).select(
        F.col("id").alias("review_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("user_id"),
        F.lit("a.py").alias("filename"), F.lit(None).cast("string").alias("result"),
        F.timestamp_seconds(F.col("id")).alias("created_at"))
    newest = history.latest_reviews(rows)
    hot = [r.review_id for r in newest.filter("user_id = 0").collect()]
    assert sorted(hot) == list(range(29997 - 49 * 3, 29998, 3))
    assert newest.count() == 20000 + 50


def test_a_very_long_snippet(spark):
    """One text with most of all lines: every rule stays linear in its length."""
    body = "for (int i = 0; i < 9; i++) {\n  g(i);\n}\n" * 20000
    rows = spark.createDataFrame(
        [(0, "int f(int a) {\n" + body + "return f(a);\n}\n", "cpp"), (1, "int g() {\n}\n", "cpp")],
        "snippet_id long, code string, review_language string")
    clean = clean_c_like(rows)
    facts = staged(line_facts(clean), "lines")
    got = rules_clike.c_like_issues(clean, facts).groupBy("snippet_id", "rule").count().collect()
    assert {(r.snippet_id, r.rule): r["count"] for r in got} == {
        (0, "CJ-1"): 19999, (0, "CJ-26"): 1, (1, "CJ-25"): 1}
    assert c_like_syntax(rows).count() == 0


def test_review_gives_every_copy_its_result(spark, sf):
    corpus = code_corpus(spark, sf)
    copies = corpus.unionByName(corpus.withColumn("snippet_id", F.col("snippet_id") + 100000))
    rows = review(copies).collect()
    assert len(rows) == 2 * corpus.count()
    by_id = {r.snippet_id: r for r in rows}
    for i, r in by_id.items():
        if i < 100000:
            other = by_id[i + 100000]
            assert (r.confidence, r.issues) == (other.confidence, other.issues)


def test_review_without_snippets(spark):
    empty = spark.createDataFrame([], "snippet_id long, code string, docstring string, "
                                      "repo string, path string, language string, filename string")
    assert review(empty).count() == 0


def test_corpus_templates_are_ascii_and_resolve(spark, sf):
    assert all(t[3].isascii() for t in TEMPLATES)
    langs = {r.review_language for r in
             with_review_language(code_corpus(spark, sf)).select("review_language").distinct()
             .collect()}
    assert langs == {"python", "cpp", "java"}


def test_registered_rules_parse_the_texts_once(spark, sf):
    """Rules that join nodes read them back; the plan itself parses nothing a second time."""
    from reviewlake.plans.catalog import REGISTRY

    for name, run in REGISTRY.items():
        if re.match(r"py_\d+_|fe_5", name):
            assert plan(run(spark, sf)).count("MapInArrow") <= 1, name


def test_snippet_tables_parse_each_text_once(spark):
    """Copies get the tables of their text, row for row as if each were reviewed by itself."""
    from reviewlake.plans.review import ReviewTables, SnippetTables

    texts = [("python", "while True:\n    x = 1 / 0\n"), ("python", "def f(:\n"), ("cpp", "int f() {\n  return 1 / 0;\n}\n"),
             ("java", "while True:\n    x = 1 / 0\n")]
    rows = spark.createDataFrame([(i, texts[i % 4][1], texts[i % 4][0]) for i in range(40)],
                                 "snippet_id long, code string, review_language string")
    every, plain = SnippetTables(rows), ReviewTables(rows)
    assert every.of_texts.snippets.count() == 4 and every.of_texts.nodes.select("snippet_id").distinct().count() == 2

    def seen(frame):
        return sorted(map(repr, frame.select(sorted(frame.columns)).collect()))

    assert seen(every.issues) == seen(plain.issues) and seen(every.features) == seen(plain.features)
    assert seen(every.ranked()) == seen(plain.ranked()) and seen(every.results()) == seen(plain.results())
    assert seen(every.issue_counts()) == seen(plain.issues.groupBy("name", "line", "fix").agg(F.count("*").alias("snippets")))
