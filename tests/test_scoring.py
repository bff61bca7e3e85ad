import random

from pyspark.sql import functions as F

from reviewlake.functions.numbers import round_half_even
from reviewlake.operators import scoring
from reviewlake.plans.review import review


def test_rounding_is_exact(spark):
    rng = random.Random(3)
    values = [rng.randrange(1, 4000) / rng.choice([20, 40, 8, 200, 3, 7, 1000]) for _ in range(5000)]
    values += [2.45, 0.05, 0.15, 2.675, 1.005, 2.25, 2.35, 0.0, 95.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", *[round_half_even(F.col("v"), d).alias(f"r{d}") for d in (0, 1, 2)]).collect()
    for r in rows:
        assert (r.r0, r.r1, r.r2) == (round(r.v, 0), round(r.v, 1), round(r.v, 2))


def _risk(n, loops, ifs, p=None, t=None):
    if n >= 2:
        return round(min(95.0, n * 18.0 + loops * 10 + ifs * 4), 2)
    if n == 0 and loops <= 1 and ifs <= 2:
        return round(loops * 8.0 + ifs * 3, 2)
    if p is None:
        return round(min(95.0, n * 16.0 + loops * 10 + ifs * 4), 2)
    t = min(max(0.5 if t is None else t, 0.05), 0.95)
    s = 50.0 + 50.0 * (p - t) / (1.0 - t) if p >= t else 50.0 * (p / t)
    return round(min(100.0, max(0.0, min(100.0, s + n * 15.0))), 2)


def test_risk(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(4), rng.randrange(5), rng.randrange(6),
             rng.choice([None, rng.random()]), rng.choice([None, 0.0, 1.0, rng.random()]))
            for _ in range(2000)]
    frame = spark.createDataFrame(rows, "n int, l int, c int, p double, t double")
    got = frame.select("*", scoring.risk_score(*map(F.col, "nlcpt")).alias("r")).collect()
    for r in got:
        assert r.r == _risk(r.n, r.l, r.c, r.p, r.t)


def test_distinct_keeps_the_first_place(spark):
    rows = [(1, "A", "n", 3, "f", 2, 5, 0), (1, "B", "n", 3, "f", 1, 9, 0), (1, "A", "n", 3, "g", 1, 1, 0)]
    frame = spark.createDataFrame(rows, "snippet_id long, rule string, name string, line int, "
                                        "fix string, phase int, o1 int, o2 int")
    got = sorted((r.fix, int(r.place)) for r in scoring.distinct_issues(frame).collect())
    assert got == [("f", 10 ** 25 + 9 * 10 ** 12), ("g", 10 ** 25 + 10 ** 12)]


def test_ranking_keeps_report_order_in_ties(spark):
    rows = [("Unused variable", 1, 1), ("Division by zero", 9, 2), ("Bare except clause", 1, 0),
            ("Possible memory leak", 0, 3), ("Possible missing semicolon", 9, 1)]
    frame = spark.createDataFrame(
        [(1, n, line, "f", o) for n, line, o in rows],
        "snippet_id long, name string, line int, fix string, place int")
    got = [r.name for r in scoring.rank_issues(frame).orderBy("position").collect()]
    assert got == ["Possible missing semicolon", "Division by zero", "Possible memory leak",
                   "Bare except clause", "Unused variable"]


def _names(spark, values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def test_template_lookup(spark):
    values = ["Division by zero", "DIVISION BY ZERO here", "Compiler Error: x", "Nothing",
              "possible missing semi", "Unreachable code after"]
    rows = {r.name: r.severity_hint for r in scoring.template_lookup(_names(spark, values)).collect()}
    assert rows == {"Division by zero": "CRITICAL", "DIVISION BY ZERO here": "CRITICAL",
                    "Compiler Error: x": "CRITICAL", "Nothing": "MEDIUM",
                    "possible missing semi": "CRITICAL", "Unreachable code after": "LOW"}


def test_severities(spark):
    frame = _names(spark, ["Unused variable", "Bare except clause", "Division by zero",
                           "My Compiler Error", "Unknown"])
    got = frame.select("name", *[scoring.issue_severity(F.col("name"), F.lit(c)).alias(f"c{c}")
                                 for c in (79, 80)]).collect()
    assert [(r.c79, r.c80) for r in got] == [
        ("LOW", "MEDIUM"), ("MEDIUM", "HIGH"), ("CRITICAL", "CRITICAL"), ("CRITICAL", "CRITICAL"),
        ("MEDIUM", "HIGH")]
    worst = spark.sql("select array('Unused variable', 'Possible memory leak') a, "
                      "cast(array() as array<string>) b").select(
        scoring.worst_severity(F.col("a"), F.lit(10)), scoring.worst_severity(F.col("b"), F.lit(99)))
    assert tuple(worst.first()) == ("HIGH", "LOW")


def test_scores_and_labels(spark):
    row = spark.range(1).select(
        scoring.app_score(F.lit(33.9), F.lit(2), F.lit(False)),
        scoring.app_score(F.lit(95.0), F.lit(9), F.lit(False)),
        scoring.app_score(F.lit(0.0), F.lit(0), F.lit(False)),
        scoring.app_score(F.lit(0.0), F.lit(0), F.lit(True)),
        scoring.panel_score(F.lit(33.5), F.lit(False)), scoring.panel_score(F.lit(1.0), F.lit(True)),
        scoring.health_label(F.lit(70.0), F.lit(2)), scoring.health_label(F.lit(70.1), F.lit(0)),
        scoring.health_label(F.lit(35.0), F.lit(0)), scoring.app_band(F.lit(75)),
        scoring.panel_band(F.lit(75))).first()
    assert tuple(row) == (51, 10, 99, 20, 67, 10, "risky", "critical", "healthy", "green", "orange")


def test_order_within_a_line(spark):
    """Issues of one rank on one line keep the order in which they are found."""
    rows = spark.createDataFrame([
        (0, "int b[2];\nint a[2];\nx = a[9] + b[7] + a[3] + a[9];\n", "cpp", None),
        (1, "z = y = 1\ndef f():\n    z = y = 2\n    return q\n", "python", None),
    ], "snippet_id long, code string, language string, filename string")
    got = {r.snippet_id: [(i.line, i.fix.split("'")[1], i.fix) for i in r.issues]
           for r in review(rows).collect()}
    bounds = [(line, name, fix.split("index ")[1].split()[0]) for line, name, fix in got[0]]
    assert bounds == [(1, "b", "2"), (2, "a", "2"), (3, "b", "7"), (3, "a", "9"), (3, "a", "3")]
    assert [(line, name) for line, name, _ in got[1]] == [(1, "z"), (1, "y"), (3, "z"), (3, "y")]
