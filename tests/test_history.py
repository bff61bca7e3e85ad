from datetime import datetime, timedelta

from pyspark.sql import functions as F

from reviewlake.operators import history
from reviewlake.sources import sinks
from reviewlake.sources.sinks import result_json

NOW = datetime(2024, 3, 10, 12, 0, 0)


def _ago(spark, deltas):
    rows = [(i, NOW - d) for i, d in enumerate(deltas)]
    return spark.createDataFrame(rows, "i int, t timestamp")


def test_times_and_buckets(spark):
    d = timedelta
    frame = _ago(spark, [d(seconds=-5), d(seconds=59), d(seconds=60), d(minutes=59, seconds=59),
                         d(hours=1), d(hours=2), d(hours=12, seconds=1), d(hours=24), d(hours=47),
                         d(hours=48)])
    now, t = F.lit(NOW), F.col("t")
    rows = frame.orderBy("i").select(
        history.time_ago_app(now, t), history.time_ago_sidebar(now, t),
        history.time_ago_workspace(now, t), history.calendar_bucket(now, t),
        history.elapsed_bucket(now, t)).collect()
    assert [tuple(r) for r in rows] == [
        ("just now", "-1 min ago", "-1m ago", "Today", "Earlier"),
        ("just now", "1 min ago", "1m ago", "Today", "Today"),
        ("1 min ago", "1 min ago", "1m ago", "Today", "Today"),
        ("59 min ago", "59 min ago", "59m ago", "Today", "Today"),
        ("1 hr ago", "1 hour ago", "1h ago", "Today", "Today"),
        ("2 hr ago", "2 hours ago", "2h ago", "Today", "Today"),
        ("12 hr ago", "12 hours ago", "12h ago", "Yesterday", "Today"),
        ("1 day ago", "1 day ago", "1d ago", "Yesterday", "Yesterday"),
        ("1 day ago", "1 day ago", "1d ago", "Earlier", "Yesterday"),
        ("2 day ago", "2 days ago", "2d ago", "Earlier", "Earlier")]


def _reviews(spark, rows):
    """(user, file, seconds ago, risk, failed, issues)"""
    frame = spark.createDataFrame(
        [(i, u, f, NOW - timedelta(seconds=s), r, e, n) for i, (u, f, s, r, e, n) in enumerate(rows)],
        "review_id long, user_id long, filename string, created_at timestamp, risk double, "
        "failed boolean, n int")
    issues = F.transform(F.slice(F.array(*[F.lit(i) for i in range(9)]), F.lit(1), F.col("n")),
                         lambda i: F.struct(F.lit("x").alias("name"), i.alias("line"),
                                            F.lit("f").alias("fix")))
    return frame.withColumn("result", result_json(
        F.col("risk"), F.col("failed"), F.lit(None).cast("int"), F.lit(""), issues, F.lit(1)))


def test_stats_series_and_search(spark):
    rows = [(1, "a.py", i * 3600, 20.5, i == 3, i % 3) for i in range(60)]
    rows += [(2, "B.py", 40 * 86400, 0.0, False, 0), (2, None, 5, 100.0, False, 1)]
    reviews = _reviews(spark, rows)
    newest = history.latest_reviews(reviews)
    assert {r.user_id: r["count"] for r in newest.groupBy("user_id").count().collect()} == {1: 50, 2: 2}
    assert sorted(r.review_id for r in newest.filter("user_id = 1").collect()) == list(range(50))
    parsed = history.latest_reviews(reviews, limit=1000)
    stats = {r.user_id: r for r in history.workspace_stats(parsed, F.lit(NOW)).collect()}
    assert (stats[1].total_reviews, stats[1].total_issues) == (60, 60 + 1)
    assert stats[1].avg_score == int((59 * 80 + 10) / 60 + 0.5)
    assert (stats[2].unique_files, stats[2].recent_reviews, stats[2].avg_score) == (2, 1, 50)
    series = history.score_series(parsed).filter("user_id = 1").orderBy("position").collect()
    assert [r.review_id for r in series] == list(range(13, -1, -1))
    assert [r.score for r in series][-4:] == [10, 80, 80, 80]
    found = history.filename_search(reviews, "b.PY").collect()
    assert [r.filename for r in found] == ["B.py"]
    tags = parsed.filter("user_id = 1 and review_id < 4").orderBy("review_id").select(
        history.status_tag(F.col("result")), history.issue_label(F.col("result"))).collect()
    assert [tuple(r) for r in tags] == [("Clean", "Fixed"), ("1 issue", "1 issue"),
                                        ("2 issues", "2 issues"), ("Syntax Error", "Syntax error")]


def test_users(spark):
    users = spark.createDataFrame([(1, "ann", NOW), (3, "cy", NOW)],
                                  "id long, username string, created_at timestamp")
    reviews = _reviews(spark, [(1, "a.py", 1, 0.0, False, 2), (9, "b.py", 1, 0.0, False, 0)])
    joined = history.reviews_with_user(reviews, users).collect()
    assert [(r.user_id, r.username) for r in joined] == [(1, "ann")]
    stats = history.workspace_stats(history.latest_reviews(reviews), F.lit(NOW))
    got = {r.user_id: (r.total_reviews, r.total_issues) for r in
           history.user_profile_stats(users, stats).collect()}
    assert got == {1: (1, 2), 3: (0, 0)}


def test_totals_follow_every_batch(spark, tmp_path):
    """They equal the full computation after each batch, a repeated one and a compaction, up to the second of the 30 days."""
    folder, day = str(tmp_path / "history"), 86400
    edges = [30 * day - 1, 30 * day, 30 * day + 1, 30 * day - 43_000, 30 * day + 40_000, 29 * day, 31 * day, -5, 0]
    rows = [(u, f, s + extra, 12.5 * (s % 7), s % 4 == 0, s % 3) for u in (1, 2) for f in ("a.py", None) for s in edges
            for extra in (0, 3600)]

    def batch(part):
        return (_reviews(spark, rows).filter(F.pmod("review_id", F.lit(4)) == part).withColumn("code", F.lit(""))
                .select("review_id", "user_id", "code", "filename", "result", "created_at"))

    def check():
        stored = sinks.read_reviews(spark, folder)
        parsed = stored.withColumn("result", sinks.parse_result(F.col("result")))
        want = history.workspace_stats(parsed, F.lit(NOW)).collect()
        got = history.maintained_stats(sinks.read_totals(spark, folder), stored, F.lit(NOW)).select(*want[0].asDict()).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and sum(r.recent_reviews for r in want) > 0

    for number, part in ((0, 0), (1, 1), (0, 2), (2, 3)):
        sinks.write_records(batch(part), folder, "run", number)
        check()
    assert sinks.compact(spark, folder) == 3
    check()
    sinks.write_records(batch(0), folder, "run", 1)
    check()
