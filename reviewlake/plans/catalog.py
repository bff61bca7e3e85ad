"""Registered queries: one per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions import fixed, lang, text
from reviewlake.operators import (
    clean, features, history, metrics, models, rules_clike, rules_python, sampling, scoring,
)
from reviewlake.operators.lines import LINE_RULES, explode_lines
from reviewlake.operators.nodes import node_table, parse_status
from reviewlake.operators.tokens import c_like_syntax
from reviewlake.plans import flows, inputs
from reviewlake.plans.corpus import code_corpus
from reviewlake.plans.review import (
    SnippetTables, find_syntax_error, logical_issues, review,
)
from reviewlake.sources import corpus as readers
from reviewlake.sources import sinks
from reviewlake.sources.stage import staged
from reviewlake.streaming.review_stream import read_requests, start_review_stream

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return add


def _round(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


# ---- sources and sinks -------------------------------------------------------

SHOWN = ["code", "docstring", "repo", "language"]


@query("io_1_src_jsonl")
def src_jsonl(spark, sf_dir):
    folder = inputs.fresh_folder(spark, "jsonl")
    rows = code_corpus(spark, sf_dir)
    inputs.write_jsonl(rows.select("code", "repo", "path", "language"), folder)
    return readers.read_jsonl(spark, folder).select(*SHOWN, "path")


@query("io_2_src_source_files")
def src_source_files(spark, sf_dir):
    folder = inputs.fresh_folder(spark, "sources")
    inputs.write_source_tree(inputs.snippets(spark, sf_dir).filter("review_language = 'cpp'"),
                             folder)
    rows = readers.read_source_files(spark, folder)
    return rows.select(
        F.regexp_extract("path", r"snippet_id=(\d+)", 1).cast("long").alias("snippet_id"), *SHOWN)


def _java(spark, sf_dir):
    return inputs.snippets(spark, sf_dir).filter("review_language = 'java'")


@query("io_3_src_java_csv")
def src_java_csv(spark, sf_dir):
    folder = inputs.fresh_folder(spark, "csv")
    inputs.write_java_csv(_java(spark, sf_dir), folder)
    return readers.read_java_csv(spark, folder).select(*SHOWN)


@query("io_4_corpus_union")
def corpus_union(spark, sf_dir):
    """The row cap falls into the sources: all JSONL rows come first."""
    folder = inputs.fresh_folder(spark, "union")
    rows = inputs.snippets(spark, sf_dir)
    python = rows.filter("review_language = 'python'")
    inputs.write_jsonl(python.select("code", "repo", "path", F.lit("python").alias("language")),
                       f"{folder}/a")
    inputs.write_source_tree(rows.filter("review_language = 'cpp'"), f"{folder}/b")
    inputs.write_java_csv(_java(spark, sf_dir), f"{folder}/c")
    cap = python.count() + 20
    capped = readers.read_corpus(spark, folder, max_rows=cap).withColumn("part", F.lit("capped"))
    whole = readers.read_corpus(spark, folder).withColumn("part", F.lit("whole"))
    return whole.unionByName(capped).groupBy("part", "language").agg(F.count("*").alias("n"))


def _sample_lines(spark, sf_dir):
    """JSON lines of every shape the sample readers must cope with."""
    kind = F.col("snippet_id") % 9
    code = F.col("code")

    def obj(**fields):
        return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]),
                         {"ignoreNullFields": "false"})

    one, null, blank = F.lit(1), F.lit(None).cast("int"), F.lit("")
    line = (
        F.when(kind == 0, obj(code=code, bug_risk=one))
        .when(kind == 1, obj(code=blank, func_code_string=code, label=F.lit(" 0 ")))
        .when(kind == 2, obj(code=code, bug_risk=null, label=one))
        .when(kind == 3, obj(code=code, label=F.lit("x")))
        .when(kind == 4, obj(code=null, whole_func_string=code, label=F.lit(1.7)))
        .when(kind == 5, F.lit("{broken"))
        .when(kind == 6, obj(code=code, label=F.lit(True)))
        .when(kind == 7, obj(bug_risk=one))
        .otherwise(F.lit("")))
    return code_corpus(spark, sf_dir).select(line.alias("value"))


@query("io_5_labeled_samples")
def labeled_samples(spark, sf_dir):
    folder = inputs.fresh_folder(spark, "labeled")
    _sample_lines(spark, sf_dir).write.text(folder)
    return readers.read_labeled(spark, [folder], max_samples=None).select("code", "label")


@query("io_6_unlabeled_samples")
def unlabeled_samples(spark, sf_dir):
    folder = inputs.fresh_folder(spark, "unlabeled")
    _sample_lines(spark, sf_dir).write.text(folder)
    return readers.read_unlabeled(spark, [folder]).select("code")


@query("io_7_feature_sink")
def feature_sink(spark, sf_dir):
    folder = inputs.fresh_folder(spark, "features")
    sinks.write_features(inputs.labeled_features(spark, sf_dir), folder)
    return sinks.read_features(spark, folder).select(
        "snippet_id", "review_language", "bug_risk", *fixed.FEATURES)


@query("io_8_review_sink")
def review_sink(spark, sf_dir):
    folder = inputs.fresh_folder(spark, "history")
    parsed = inputs.parsed_reviews(spark, sf_dir).select(
        "review_id", "user_id", "code", "filename", "created_at", "result.*")
    sinks.append_reviews(parsed, folder)
    stored = sinks.read_reviews(spark, folder).withColumn(
        "result", sinks.parse_result(F.col("result")))
    return _history_columns(stored)


@query("io_10_compiler_log_parse")
def compiler_log_parse(spark, sf_dir):
    n = F.col("n_chars").cast("string")
    cpp = F.concat(F.lit("a.cpp: In function 'main':\na.cpp:"), n,
                   F.lit(":5: error: expected ';' before '}'\na.cpp:7:1: warning: unused variable "
                         "'x' [-Wunused]\na.cpp:9:2: warning:  no return  \na.cpp:9:2: note: here"))
    java = F.concat(F.lit("A.java:"), n, F.lit(": error: cannot find symbol\n  int x\n"
                                               "A.java:3: warning: unused variable y\n1 error"))
    logs = inputs.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("snippet_id"),
        F.when(F.col("doc_id") % 2 == 0, "cpp").otherwise("java").alias("language"),
        F.when(F.col("doc_id") % 2 == 0, cpp).otherwise(java).alias("log"))
    return readers.compiler_issues(logs).select("snippet_id", "name", "line", "fix")


# ---- languages, cleaning, labels ----------------------------------------------

def _language_query(name, expr):
    @query(name)
    def run(spark, sf_dir):
        return code_corpus(spark, sf_dir).select("snippet_id", expr().alias("lang"))


_language_query("cl_1_normalize_language", lambda: lang.normalize_language(F.col("language")))
_language_query("cl_2_language_from_filename", lambda: lang.language_from_filename(
    F.col("filename")))
_language_query("cl_3_language_from_path", lambda: lang.language_from_path(F.col("path")))
_language_query("cl_4_language_from_code", lambda: lang.language_from_code(F.col("code")))
_language_query("cl_5_resolve_review_language", lambda: lang.resolve_review_language(
    F.col("language"), F.col("filename"), F.col("code")))
_language_query("cl_6_resolve_row_language", lambda: lang.resolve_row_language(
    F.col("language"), F.col("path")))


@query("cl_7_clean_dataset")
def clean_dataset(spark, sf_dir):
    return clean.clean_dataset(code_corpus(spark, sf_dir)).select(
        "snippet_id", "code", "review_language")


@query("cl_8_language_distribution")
def language_distribution(spark, sf_dir):
    labeled = clean.with_bug_risk(clean.clean_dataset(code_corpus(spark, sf_dir)))
    by_label = clean.label_distribution(labeled).select(
        "review_language", F.col("bug_risk").cast("string").alias("bug_risk"), "n")
    by_language = clean.language_distribution(labeled).select(
        "review_language", F.lit("all").alias("bug_risk"), "n")
    return by_language.unionByName(by_label)


@query("cl_9_bug_risk_label")
def bug_risk_label(spark, sf_dir):
    return inputs.snippets(spark, sf_dir).select("snippet_id", clean.bug_risk_label(
        F.col("code"), F.col("review_language")).alias("bug_risk"))


@query("cl_10_strip_c_comments")
def strip_c_comments(spark, sf_dir):
    return inputs.clean(spark, sf_dir)


@query("cl_11_blank_strings_in_line")
def blank_strings_in_line(spark, sf_dir):
    lines = explode_lines(inputs.clean(spark, sf_dir))
    return lines.select("snippet_id", "n", text.blank_strings(F.col("line")).alias("line"))


@query("cl_12_explode_lines")
def lines_query(spark, sf_dir):
    return explode_lines(inputs.clean(spark, sf_dir)).select("snippet_id", "n", "line")


@query("cl_12b_explode_lines_of_pages")
def page_lines(spark, sf_dir):
    """Non-blank lines of whole web pages, comments kept."""
    pages = inputs.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("snippet_id"), F.lit("cpp").alias("review_language"),
        F.col("html").alias("clean"))
    return explode_lines(pages).groupBy("snippet_id").agg(
        F.count("*").alias("lines"), F.max("n").alias("last_line"),
        F.sum(F.length("line")).alias("chars"))


@query("cl_13_language_from_upload")
def language_from_upload(spark, sf_dir):
    chosen = F.element_at(F.array(*map(F.lit, ["Python", "C++", "Java", "Go"])),
                          (F.col("snippet_id") % 4 + 1).cast("int"))
    name = F.col("filename")
    return code_corpus(spark, sf_dir).select(
        "snippet_id", lang.upload_language(name, chosen).alias("upload"),
        lang.dashboard_review_language(name).alias("review"),
        lang.dashboard_display_language(name).alias("display"))


# ---- syntax --------------------------------------------------------------------

@query("sx_1_c_like_syntax")
def sx_1(spark, sf_dir):
    return c_like_syntax(inputs.snippets(spark, sf_dir))


@query("sx_1b_c_like_syntax_of_pages")
def sx_1_pages(spark, sf_dir):
    """The bracket check over whole web pages, three of four made faulty."""
    html, kind = F.col("html"), F.col("page_id") % 4
    code = (F.when(kind == 0, html).when(kind == 1, F.replace(html, F.lit("track("), F.lit("track[")))
            .when(kind == 2, F.concat(html, F.lit("'tail"))).otherwise(F.concat(F.lit("{"), html)))
    pages = inputs.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("snippet_id"), F.lit("cpp").alias("review_language"),
        code.alias("code"))
    return c_like_syntax(pages)


@query("sx_2_python_syntax")
def sx_2(spark, sf_dir):
    return parse_status(inputs.snippets(spark, sf_dir)).select(
        "snippet_id", "parse_ok", "error_line")


@query("sx_3_find_syntax_error")
def sx_3(spark, sf_dir):
    source = inputs.snippets(spark, sf_dir)
    found = find_syntax_error(source, node_table(source))
    message = F.when(F.col("review_language") != "python", F.col("error.message"))
    return found.select("snippet_id", F.col("error.type").alias("type"),
                        F.col("error.line").alias("line"), message.alias("message"))


@query("sx_4_find_logical_issues")
def sx_4(spark, sf_dir):
    return logical_issues(review(code_corpus(spark, sf_dir)))


# ---- features --------------------------------------------------------------------

@query("fe_1_features_c_like")
def fe_1(spark, sf_dir):
    return features.features_c_like(inputs.snippets(spark, sf_dir))


@query("fe_2_features_python")
def fe_2(spark, sf_dir):
    source = inputs.snippets(spark, sf_dir)
    return features.features_python(source, node_table(source))


@query("fe_3_features_legacy")
def fe_3(spark, sf_dir):
    return features.features_legacy(inputs.feature_rows(spark, sf_dir))


@query("fe_4_rich_c_like")
def fe_4(spark, sf_dir):
    return features.rich_c_like(inputs.snippets(spark, sf_dir))


@query("fe_5_rich_python")
def fe_5(spark, sf_dir):
    source = inputs.snippets(spark, sf_dir)
    return features.rich_python(source, staged(node_table(source), "nodes"))


@query("fe_6_panel_stats")
def fe_6(spark, sf_dir):
    source = staged(inputs.snippets(spark, sf_dir), "snippets")
    return features.panel_stats(source, node_table(source), review(source))


@query("fe_7_distinct_features")
def fe_7(spark, sf_dir):
    source = inputs.snippets(spark, sf_dir)
    distinct = staged(features.distinct_snippets(source), "distinct")
    rows = features.features(distinct, node_table(distinct))
    per_code = distinct.select("snippet_id", "code_hash").join(rows, "snippet_id").drop("snippet_id")
    return features.join_by_code(source, per_code)


# ---- defect rules -----------------------------------------------------------------

ISSUE = ["snippet_id", "name", "line", "fix"]


def _issue_query(key, fn):
    @query(key)
    def run(spark, sf_dir):
        return fn(spark, sf_dir).select(*ISSUE)


CJ_NAMES = {
    "CJ-1": "nested_loop", "CJ-2": "infinite_loop", "CJ-3": "division_by_zero",
    "CJ-4": "input_in_loop", "CJ-5": "sorting_in_loop", "CJ-6": "return_no_semicolon",
    "CJ-7": "statement_no_semicolon", "CJ-8": "literal_no_semicolon",
    "CJ-9": "assignment_in_condition", "CJ-10": "endl_in_loop", "CJ-11": "pow_to_int",
    "CJ-12": "unsafe_c_function", "CJ-13": "string_equality", "CJ-14": "string_concat_in_loop",
    "CJ-15": "broad_catch", "CJ-16": "cpp_overflow", "CJ-17": "java_overflow",
    "CJ-18": "cpp_file_overflow", "CJ-19": "missing_break", "CJ-20": "mixed_printf_cout",
    "CJ-21": "empty_catch", "CJ-22": "null_pointer", "CJ-23": "memory_leak",
    "CJ-24": "unclosed_resource", "CJ-25": "no_return_value", "CJ-26": "bare_recursion",
    "CJ-27": "array_out_of_bounds", "CJ-28": "high_complexity",
}


def _c_like_query(rule):
    def run(spark, sf_dir):
        if rule == "CJ-28":
            return scoring.complexity_issues(inputs.feature_rows(spark, sf_dir))
        if rule in rules_clike.FILE_RULES:
            return rules_clike.file_issues(inputs.clean(spark, sf_dir), [rule])
        if rule in LINE_RULES:
            return rules_clike.line_issues(inputs.facts(spark, sf_dir, [rule]), [rule])
        facts = inputs.facts(spark, sf_dir)
        if rule == "CJ-19":
            return rules_clike.switch_issues(facts)
        if rule == "CJ-27":
            return rules_clike.array_issues(facts)
        return rules_clike.function_issues(facts, (rule,))

    _issue_query(f"cj_{rule[3:]}_{CJ_NAMES[rule]}", run)


for _rule in CJ_NAMES:
    _c_like_query(_rule)


# Queries that also run over real texts.
OVER_TEXTS = ["cl_9_bug_risk_label", "cl_10_strip_c_comments", "cl_11_blank_strings_in_line", "cl_12_explode_lines",
              "sx_1_c_like_syntax", "fe_1_features_c_like", "fe_4_rich_c_like", "cj_1_nested_loop",
              "cj_7_statement_no_semicolon", "cj_8_literal_no_semicolon", "cj_14_string_concat_in_loop",
              "cj_19_missing_break", "cj_21_empty_catch", "cj_25_no_return_value", "cj_27_array_out_of_bounds"]


def _text_query(name):
    def run(spark, sf_dir):
        with inputs.snippets_from(inputs.text_snippets):
            return REGISTRY[name](spark, sf_dir)

    REGISTRY[f"text_{name}"] = run


for _name in OVER_TEXTS:
    _text_query(_name)


def _python_query(rule, fn):
    def run(spark, sf_dir):
        nodes = inputs.nodes(spark, sf_dir)
        # Rules that join nodes to nodes read them several times: the texts are parsed once all the same.
        nodes = staged(nodes, "nodes") if rule in rules_python.JOIN_RULES else nodes
        return scoring.distinct_issues(rules_python.rule_issues(nodes, rule))

    _issue_query(f"py_{rule[3:]}_{fn.__name__}", run)


for _rule, _fn in rules_python.PYTHON_RULES.items():
    _python_query(_rule, _fn)


# ---- scoring ------------------------------------------------------------------------

def _tables(spark, sf_dir) -> SnippetTables:
    """Review tables of all snippets, copies included."""
    return SnippetTables(inputs.snippets(spark, sf_dir).withColumn("code", F.coalesce("code", F.lit(""))))


def _results(spark, sf_dir) -> DataFrame:
    return review(code_corpus(spark, sf_dir))


@query("s_1_distinct_issues")
def s_1(spark, sf_dir):
    return _tables(spark, sf_dir).issue_counts()


@query("s_2_complexity")
def s_2(spark, sf_dir):
    return inputs.feature_rows(spark, sf_dir).select(
        "snippet_id", scoring.complexity(F.col("num_loops")).alias("complexity"))


@query("s_3_risk_score")
def s_3(spark, sf_dir):
    """Risk without and with a probability, over event rows of every shape."""
    rows = inputs.events(spark, sf_dir).select(
        "event_id", (F.col("k") % 4).alias("issues"), (F.col("k") % 5).alias("loops"),
        (F.col("k") % 7).alias("conditions"),
        (F.col("event_id") % 1000 / 1000.0).alias("probability"),
        (F.col("event_id") % 11 / 10.0).alias("threshold"))
    args = [F.col("issues"), F.col("loops"), F.col("conditions")]
    return _round(rows.select(
        "event_id", scoring.risk_score(*args).alias("risk"),
        scoring.risk_score(*args, F.col("probability"), F.col("threshold")).alias("model_risk")),
        "risk", "model_risk")


@query("s_4_rank_issues")
def s_4(spark, sf_dir):
    return _tables(spark, sf_dir).ranked().select(*ISSUE, "rank", "position")


def _issue_names(spark, sf_dir):
    """Names of every registered issue, spread over the event rows, with a risk."""
    names = inputs.ISSUE_NAMES
    arr = F.array(*map(F.lit, names))
    return inputs.events(spark, sf_dir).select(
        "event_id", F.element_at(arr, (F.col("event_id") % len(names) + 1).cast("int"))
        .alias("name"), F.least("value", F.lit(100.0)).alias("confidence"))


@query("s_5_severity_3_app")
def s_5(spark, sf_dir):
    return _issue_names(spark, sf_dir).select(
        "event_id", scoring.severity_app(F.col("name")).alias("severity"))


@query("s_6_severity_3_panel")
def s_6(spark, sf_dir):
    return _issue_names(spark, sf_dir).select(
        "event_id", scoring.severity_panel(F.col("name")).alias("severity"))


@query("s_7_template_lookup")
def s_7(spark, sf_dir):
    return scoring.template_lookup(_issue_names(spark, sf_dir)).select(
        "event_id", "name", "severity_hint", "explanation", "template_fix")


@query("s_8_issue_severity")
def s_8(spark, sf_dir):
    return _issue_names(spark, sf_dir).select(
        "event_id", scoring.issue_severity(F.col("name"), F.col("confidence")).alias("severity"))


@query("s_9_worst_severity")
def s_9(spark, sf_dir):
    worst = scoring.worst_severity(F.col("issues.name"), F.col("confidence"))
    return _results(spark, sf_dir).select("snippet_id", worst.alias("severity"))


def _event_scores(spark, sf_dir):
    return inputs.parsed_reviews(spark, sf_dir).select(
        "review_id", F.col("result.confidence").alias("confidence"),
        history.total_issues(F.col("result")).alias("n"),
        F.col("result.syntax_error").alias("syntax_error"))


@query("s_10_scores")
def s_10(spark, sf_dir):
    c, n, e = F.col("confidence"), F.col("n"), F.col("syntax_error")
    return _event_scores(spark, sf_dir).select(
        "review_id", scoring.app_score(c, n, e).alias("app_score"),
        scoring.panel_score(c, e).alias("panel_score"))


@query("s_11_health_label")
def s_11(spark, sf_dir):
    return _event_scores(spark, sf_dir).select(
        "review_id", scoring.health_label(F.col("confidence"), F.col("n")).alias("health"))


@query("s_12_score_band")
def s_12(spark, sf_dir):
    c, n, e = F.col("confidence"), F.col("n"), F.col("syntax_error")
    return _event_scores(spark, sf_dir).select(
        "review_id", scoring.app_band(scoring.app_score(c, n, e)).alias("app_band"),
        scoring.panel_band(scoring.panel_score(c, e)).alias("panel_band"))


@query("s_13_panel_issues")
def s_13(spark, sf_dir):
    # The parser's message text is not part of the comparison.
    rows = scoring.panel_issues(_results(spark, sf_dir))
    return rows.select("snippet_id", "position", "name", "line", "severity")


@query("s_14_review_result")
def s_14(spark, sf_dir):
    listed = F.array_join(F.transform("issues", lambda i: F.concat(
        i["name"], F.lit("@"), i["line"].cast("string"), F.lit(":"), i["fix"])), "|")
    message = F.when(F.col("review_language") != "python", F.col("error_msg"))
    return _results(spark, sf_dir).select(
        "snippet_id", "review_language", "confidence", "syntax_error", "error_line",
        message.alias("error_msg"), listed.alias("issues"), "complexity")


@query("s_15_primary_issue")
def s_15(spark, sf_dir):
    return _results(spark, sf_dir).select(
        "snippet_id", scoring.primary_issue(F.col("issues")).alias("issue"))


# ---- models and evaluation -----------------------------------------------------------

# For tests; the registered queries use the operators' defaults, on all labelled rows.
SMALL = models.TrainSettings(candidates=2, folds=2, grid={
    "num_trees": [8, 12], "max_depth": [4, None], "min_split": [2, 4], "min_leaf": [1],
    "features": ["sqrt"]})


@query("ml_1_stratified_split")
def ml_1(spark, sf_dir):
    return sampling.stratified_split(inputs.scored(spark, sf_dir), ["label"], "snippet_id").select(
        "snippet_id", "label", "is_test")


@query("ml_2_class_guard")
def ml_2(spark, sf_dir):
    rows = inputs.scored(spark, sf_dir).select(
        F.when(F.col("snippet_id") % 50 == 0, "ruby").when(F.col("snippet_id") % 50 == 1, "cpp")
        .when(F.col("label") == 1, "java").otherwise("python").alias("review_language"),
        F.col("label").alias("bug_risk"))
    return sampling.class_guard(rows, fixed.SUPPORTED)


@query("ml_3_class_weights")
def ml_3(spark, sf_dir):
    rows = sampling.class_weights(inputs.scored(spark, sf_dir), "label", ("review_language",))
    return _round(rows.select("snippet_id", "weight"), "weight")


def _train_rows(spark, sf_dir):
    """Labelled features with labels that vary within each language."""
    rows = inputs.labeled_features(spark, sf_dir).withColumn(
        "bug_risk", F.when(F.col("snippet_id") % 10 == 0, 1 - F.col("bug_risk"))
        .otherwise(F.col("bug_risk")))
    return staged(rows, "train-rows")


_packages: dict[tuple, tuple[dict, dict]] = {}


def _package(spark, sf_dir):
    """The full search and fit, trained once for each session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _packages:
        _packages[key] = models.train_models(_train_rows(spark, sf_dir))
    return _packages[key]


@query("ml_4_tuned_forest")
def ml_4(spark, sf_dir):
    """The parameters that the search found, by language."""
    _, meta = _package(spark, sf_dir)
    rows = [(k, name, str(value)) for k, m in meta["language_metrics"].items()
            for name, value in [*sorted(m["best_params"].items()), ("cv_score", f"{m['best_cv_score']:.6f}")]]
    return spark.createDataFrame(rows, "review_language string, param string, value string")


@query("ml_5_sigmoid_calibration")
def ml_5(spark, sf_dir):
    """Calibrated probabilities of all labelled rows of the languages that have a model."""
    package, _ = _package(spark, sf_dir)
    rows = _train_rows(spark, sf_dir).filter(F.col("review_language").isin(list(package)))
    return models.predict_probability(package, rows).select(
        "snippet_id", "review_language", F.col("bug_risk").alias("label"), "probability")


@query("ml_6_threshold_sweep")
def ml_6(spark, sf_dir):
    rows = metrics.threshold_sweep(inputs.scored(spark, sf_dir), fixed.THRESHOLD_BETA,
                                   fixed.MIN_RECALL)
    return _round(rows, "threshold", "f1", "fbeta", "precision", "recall")


@query("ml_7_per_language_train")
def ml_7(spark, sf_dir):
    _, meta = _package(spark, sf_dir)
    rows = [(lang_, m["decision_threshold"], m["metrics"]["f1"], m["metrics"]["roc_auc"],
             m["train_size"], m["test_size"]) for lang_, m in meta["language_metrics"].items()]
    return spark.createDataFrame(rows, "review_language string, threshold double, f1 double, "
                                       "roc_auc double, train_size long, test_size long")


def _scored_by_model(spark, sf_dir, folder=None):
    rows = _train_rows(spark, sf_dir)
    package, meta = _package(spark, sf_dir)
    if folder:
        sinks.save_package(spark, package, meta, folder)
        package, meta = sinks.load_package(spark, folder)
    return models.batch_probabilities(rows.withColumn("n_issues", F.lit(1)), package, meta)


@query("ml_8_batch_score")
def ml_8(spark, sf_dir):
    package = _package(spark, sf_dir)
    return review(code_corpus(spark, sf_dir), package).select(
        "snippet_id", "review_language", "confidence")


@query("io_9_model_package")
def model_package(spark, sf_dir):
    return _scored_by_model(spark, sf_dir, inputs.fresh_folder(spark, "package"))


@query("ml_9_binary_metrics")
def ml_9(spark, sf_dir):
    rows = inputs.scored(spark, sf_dir).withColumn("threshold", F.lit(0.425))
    return _round(metrics.binary_metrics(rows, ["review_language"]), "precision", "recall", "f1",
                  "f1_default_threshold", "roc_auc")


@query("ml_9b_class_report")
def ml_9b(spark, sf_dir):
    rows = inputs.scored(spark, sf_dir).withColumn(
        "predicted", (F.col("probability") >= 0.425).cast("int"))
    return _round(metrics.class_report(rows, "label", "predicted", ("review_language",)),
                  "precision", "recall", "f1")


@query("ml_9c_report_summary")
def ml_9c(spark, sf_dir):
    rows = inputs.scored(spark, sf_dir).withColumn(
        "predicted", (F.col("probability") >= 0.425).cast("int"))
    report = metrics.class_report(rows, "label", "predicted", ("review_language",))
    return _round(metrics.report_summary(report, ("review_language",)), "precision", "recall", "f1")


@query("ml_10_issue_dataset")
def ml_10(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    encoded, _ = models.encode_labels(models.issue_dataset(tables.features, tables.results()),
                                      "issue")
    return encoded.select("snippet_id", "issue", F.col("label").cast("int").alias("label"),
                          "num_lines", "num_loops")


@query("ml_11_issue_classifier")
def ml_11(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    data = models.issue_dataset(tables.features, tables.results())
    return models.train_issue_classifier(data)[1]


@query("ml_12_severity_dataset")
def ml_12(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    encoded, _ = models.encode_labels(models.severity_dataset(tables.features, tables.results()),
                                      "severity")
    return encoded.select("snippet_id", "severity", F.col("label").cast("int").alias("label"),
                          "num_lines", "num_loops")


@query("ml_13_severity_classifier")
def ml_13(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    data = models.severity_dataset(tables.features, tables.results())
    return models.train_severity_classifier(data)[1]


@query("ml_13b_isotonic_curve")
def ml_13b(spark, sf_dir):
    """The curve of each language at each of its scores, rows weighing more where labels are rare."""
    rows = inputs.scored(spark, sf_dir).select("review_language", F.col("probability").alias("score"), F.col("label").alias("hit"),
                                               (F.col("label") * 2 + 1).cast("double").alias("weight"))
    curve = models.isotonic_curves(rows, ["review_language"])
    asked = rows.select("review_language", "score").distinct()
    steps = curve.withColumnRenamed("review_language", "language")
    return _round(asked.join(steps, (F.col("language") == F.col("review_language")) & F.col("score").between(
        F.col("low"), F.col("high"))).select("review_language", "score", "value"), "value")


@query("ev_1_predict_flag")
def ev_1(spark, sf_dir):
    return _results(spark, sf_dir).select("snippet_id", metrics.predict_flag(
        F.size("issues"), F.col("confidence")).alias("predicted"))


def _eval_rows(spark, sf_dir):
    latency = (F.col("snippet_id") * 31 % 97) / 10.0
    return inputs.scored(spark, sf_dir).withColumn("latency_ms", latency)


@query("ev_2_eval_metrics")
def ev_2(spark, sf_dir):
    rows = _eval_rows(spark, sf_dir).withColumn(
        "predicted", metrics.predict_flag(F.lit(0), F.col("probability") * 100))
    return _round(metrics.eval_metrics(rows, ["review_language"]), *metrics.METRICS)


@query("ev_3_eval_compare")
def ev_3(spark, sf_dir):
    rows = _eval_rows(spark, sf_dir)
    rules = rows.withColumn("mode", F.lit("rules")).withColumn(
        "predicted", (F.col("snippet_id") % 3 == 0).cast("int"))
    model = rows.withColumn("mode", F.lit("model")).withColumn(
        "predicted", (F.col("probability") >= 0.5).cast("int"))
    table = metrics.eval_compare(rules.unionByName(model), ["rules", "model"])
    return _round(table, "rules", "model")


@query("ev_4_synthetic_labels")
def ev_4(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    texts = tables.of_texts
    return tables.given(metrics.synthetic_labels(texts.snippets.select("snippet_id"), texts.issues,
                                                 limit=None).select("snippet_id", "label"))


@query("main_build_dataset")
def main_build_dataset(spark, sf_dir):
    return flows.build_dataset(code_corpus(spark, sf_dir))


def _labeled_snippets(spark, sf_dir):
    labels = inputs.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("snippet_id"), F.col("quality").alias("label"))
    return code_corpus(spark, sf_dir).select("snippet_id", "code").join(labels, "snippet_id")


@query("main_evaluate_rules")
def main_evaluate_rules(spark, sf_dir):
    """All labelled snippets, reviewed as Python; times differ from run to run."""
    table = flows.evaluate(_labeled_snippets(spark, sf_dir))
    return _round(table.filter(~F.col("metric").contains("latency")), "rules")


def _unlabeled_files(spark, sf_dir):
    folder = inputs.fresh_folder(spark, "unlabeled")
    inputs.write_jsonl(code_corpus(spark, sf_dir).select("code"), folder)
    return [folder]


@query("main_evaluate_unlabeled")
def main_evaluate_unlabeled(spark, sf_dir):
    """Files without labels: the rules give the labels that they are then measured by."""
    samples = flows.samples_of_files(spark, _unlabeled_files(spark, sf_dir), max_samples=None)
    table = flows.evaluate(samples)
    return _round(table.filter(~F.col("metric").contains("latency")), "rules")


@query("main_classifier_rows")
def main_classifier_rows(spark, sf_dir):
    """How many rows of each class files without labels give to the two classifiers."""
    issue, severity = flows.classifier_rows(spark, _unlabeled_files(spark, sf_dir))
    kinds = issue.select(F.lit("issue").alias("classifier"), F.col("issue").alias("class")).unionByName(
        severity.select(F.lit("severity").alias("classifier"), F.col("severity").alias("class")))
    return kinds.groupBy("classifier", "class").agg(F.count("*").alias("n"))


@query("main_evaluate_model")
def main_evaluate_model(spark, sf_dir):
    package = _package(spark, sf_dir)
    return flows.evaluate(_labeled_snippets(spark, sf_dir), package)


# ---- review history ---------------------------------------------------------------------

def _history_columns(rows):
    result = F.col("result")
    first = F.try_element_at(result["issues"], F.lit(1))
    return rows.select(
        "review_id", "user_id", "filename", result["confidence"].alias("confidence"),
        result["syntax_error"].alias("syntax_error"), result["error_line"].alias("error_line"),
        result["error_msg"].alias("error_msg"), result["complexity"].alias("complexity"),
        F.size(result["issues"]).alias("n_issues"), first["name"].alias("first_name"),
        first["line"].alias("first_line"), first["fix"].alias("first_fix"))


@query("rh_1_latest_reviews")
def rh_1(spark, sf_dir):
    return _history_columns(history.latest_reviews(inputs.reviews(spark, sf_dir)))


@query("rh_1b_latest_reviews_of_user")
def rh_1b(spark, sf_dir):
    """Only the user's part of the stored history is read."""
    folder = inputs.fresh_folder(spark, "by-user")
    sinks.write_records(inputs.reviews(spark, sf_dir), folder, "all", 0)
    return _history_columns(history.latest_reviews(sinks.read_reviews(spark, folder, user_id=7)))


@query("rh_2_reviews_with_user")
def rh_2(spark, sf_dir):
    joined = history.reviews_with_user(inputs.reviews(spark, sf_dir), inputs.users(spark, sf_dir))
    return joined.select("review_id", "user_id", "username", "filename")


STATS = ["total_reviews", "total_issues", "avg_score", "unique_files", "recent_reviews"]


@query("rh_3_workspace_stats")
def rh_3(spark, sf_dir):
    return history.workspace_stats(inputs.parsed_reviews(spark, sf_dir), inputs.now())


@query("rh_3b_maintained_stats")
def rh_3b(spark, sf_dir):
    """The same totals from what three batches have brought along; the second is written twice."""
    folder = inputs.fresh_folder(spark, "totals")
    rows = inputs.reviews(spark, sf_dir)
    for part in (0, 1, 2, 1):
        sinks.write_records(rows.filter(F.pmod("review_id", F.lit(3)) == part), folder, "run", part)
    return history.maintained_stats(sinks.read_totals(spark, folder), sinks.read_reviews(spark, folder), inputs.now())


@query("rh_4_score_series")
def rh_4(spark, sf_dir):
    return history.score_series(inputs.reviews(spark, sf_dir))


@query("rh_5_status_tag")
def rh_5(spark, sf_dir):
    return inputs.parsed_reviews(spark, sf_dir).select(
        "review_id", history.status_tag(F.col("result")).alias("tag"),
        history.issue_label(F.col("result")).alias("label"))


@query("rh_6_date_buckets")
def rh_6(spark, sf_dir):
    t = F.col("created_at")
    rows = inputs.reviews(spark, sf_dir).select(
        history.calendar_bucket(inputs.now(), t).alias("panel_bucket"),
        history.elapsed_bucket(inputs.now(), t).alias("app_bucket"))
    return rows.groupBy("panel_bucket", "app_bucket").agg(F.count("*").alias("n"))


@query("rh_7_time_ago")
def rh_7(spark, sf_dir):
    t, now = F.col("created_at"), inputs.now()
    return inputs.reviews(spark, sf_dir).select(
        "review_id", history.time_ago_app(now, t).alias("app"),
        history.time_ago_sidebar(now, t).alias("sidebar"),
        history.time_ago_workspace(now, t).alias("workspace"))


@query("rh_8_filename_search")
def rh_8(spark, sf_dir):
    return history.filename_search(inputs.reviews(spark, sf_dir), "E_3.PY").select(
        "review_id", "filename")


@query("rh_9_user_profile_stats")
def rh_9(spark, sf_dir):
    stats = history.workspace_stats(inputs.parsed_reviews(spark, sf_dir), inputs.now())
    return history.user_profile_stats(inputs.users(spark, sf_dir), stats)


# ---- streaming and the node table ----------------------------------------------------------

@query("st_1_review_stream")
def st_1(spark, sf_dir):
    folder = inputs.fresh_folder(spark, "stream")
    requests = code_corpus(spark, sf_dir).select(
        "snippet_id", (F.col("snippet_id") % 10).alias("user_id"), "code", "filename", "language",
        inputs.now().alias("created_at"))
    requests.write.json(f"{folder}/in")
    start_review_stream(read_requests(spark, f"{folder}/in"), f"{folder}/history",
                        f"{folder}/checkpoint").awaitTermination()
    stored = sinks.read_reviews(spark, f"{folder}/history").withColumn(
        "result", sinks.parse_result(F.col("result")))
    return stored.select(
        F.col("review_id").alias("snippet_id"), "user_id",
        F.col("result.confidence").alias("confidence"),
        F.col("result.syntax_error").alias("syntax_error"),
        F.size("result.issues").alias("n_issues"))


@query("uf_1_node_table")
def uf_1(spark, sf_dir):
    return inputs.nodes(spark, sf_dir).filter("parse_ok").groupBy("snippet_id").agg(
        F.count_if(F.col("type") == "Name").alias("names"),
        F.count_if(F.col("type") == "Call").alias("calls"),
        F.max("end_line").alias("last_line"))

