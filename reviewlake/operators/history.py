"""Review-history analytics. "Now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from reviewlake.functions.numbers import round_half_up
from reviewlake.operators.scoring import panel_score
from reviewlake.sources.sinks import parse_result

DAY = 86400


def latest_reviews(reviews: DataFrame, limit: int = 50, user_id: int | None = None) -> DataFrame:
    """The newest reviews of each user, or of one user, with the result parsed.

    The rank limit is applied in the map tasks too, so a user with a third of
    all reviews sends no more than ``limit`` rows per task.
    """
    rows = reviews if user_id is None else reviews.filter(F.col("user_id") == user_id)
    order = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(),
                                                  F.col("review_id").desc())
    newest = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return newest.withColumn("result", parse_result(F.col("result")))


def reviews_with_user(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """Each review with its user; the planner's size check picks the join."""
    return reviews.join(users.withColumnRenamed("id", "user_id").withColumnRenamed(
        "created_at", "user_since"), "user_id")


def issue_count(result: Column) -> Column:
    return F.size(result["issues"])


def total_issues(result: Column) -> Column:
    """A syntax error counts as one issue."""
    return issue_count(result) + result["syntax_error"].cast("int")


def score(result: Column) -> Column:
    return panel_score(result["confidence"], result["syntax_error"])


def seconds_before(now: Column, created_at: Column) -> Column:
    """Seconds since ``created_at``, with the fraction."""
    micros = F.unix_micros(now) - F.unix_micros(created_at)
    return micros / F.lit(1_000_000.0)


def workspace_stats(reviews: DataFrame, now: Column) -> DataFrame:
    """Totals per user over reviews whose ``result`` is parsed."""
    # Files are counted over the distinct (user, file) pairs, so the pairs of a
    # very active user spread over many tasks.
    files = reviews.groupBy("user_id", "filename").agg(
        F.count("*").alias("n"), F.sum(total_issues(F.col("result"))).alias("issues"),
        F.sum(score(F.col("result"))).alias("scores"),
        F.count_if(seconds_before(now, F.col("created_at")) < 30 * DAY).alias("recent"))
    return files.groupBy("user_id").agg(
        F.sum("n").alias("total_reviews"), F.sum("issues").alias("total_issues"),
        round_half_up(F.sum("scores") / F.sum("n")).cast("int").alias("avg_score"),
        F.count("*").alias("unique_files"), F.sum("recent").alias("recent_reviews"))


def maintained_stats(totals: DataFrame, reviews: DataFrame, now: Column) -> DataFrame:
    """``workspace_stats`` from the totals by file and day that batches have brought along.

    Of the ``reviews`` only the rows of the one day are counted on which the last 30 days begin, and none is parsed.
    """
    begin = F.timestamp_micros(F.unix_micros(now) - F.lit(30 * DAY * 1_000_000))
    files = totals.groupBy("user_id", "filename").agg(
        F.sum("n").alias("n"), F.sum("issues").alias("issues"), F.sum("scores").alias("scores"),
        F.sum(F.when(F.col("day") > F.to_date(begin), F.col("n")).otherwise(0)).alias("recent"), F.lit(1).alias("files"))
    # As a range of times, which the files' statistics can answer.
    edge = reviews.filter((F.col("created_at") > begin) & (F.col("created_at") < F.date_add(F.to_date(begin), 1).cast("timestamp")))
    first_day = edge.groupBy("user_id").agg(F.count("*").alias("recent")).select(
        "user_id", *[F.lit(0).cast("long").alias(c) for c in ("n", "issues", "scores")], "recent", F.lit(0).alias("files"))
    columns = ["user_id", "n", "issues", "scores", "recent", "files"]
    return files.select(*columns).unionByName(first_day).groupBy("user_id").agg(
        F.sum("n").alias("total_reviews"), F.sum("issues").alias("total_issues"),
        round_half_up(F.sum("scores") / F.sum("n")).cast("int").alias("avg_score"),
        F.sum("files").alias("unique_files"), F.sum("recent").alias("recent_reviews"))


def score_series(reviews: DataFrame, points: int = 14) -> DataFrame:
    """Scores of the newest reviews per user, oldest first.

    ``result`` may still be text: then only the rows that are kept are parsed.
    """
    newest = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(),
                                                   F.col("review_id").desc())
    kept = (reviews.withColumn("place", F.row_number().over(newest))
            .filter(F.col("place") <= points))
    if isinstance(reviews.schema["result"].dataType, StringType):
        kept = kept.withColumn("result", parse_result(F.col("result")))
    oldest = Window.partitionBy("user_id").orderBy(F.col("place").desc())
    return kept.select("user_id", "review_id", F.row_number().over(oldest).alias("position"),
                       score(F.col("result")).alias("score"))


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n > 1, "s").otherwise(""))


def status_tag(result: Column) -> Column:
    return (F.when(result["syntax_error"], "Syntax Error")
            .when(issue_count(result) == 0, "Clean").otherwise(_plural(issue_count(result), "issue")))


def issue_label(result: Column) -> Column:
    return (F.when(result["syntax_error"], "Syntax error")
            .when(issue_count(result) == 0, "Fixed").otherwise(_plural(issue_count(result), "issue")))


def calendar_bucket(now: Column, created_at: Column) -> Column:
    """Today, Yesterday or Earlier by calendar day."""
    day = F.to_date(created_at)
    return (F.when(day == F.to_date(now), "Today")
            .when(day == F.date_sub(F.to_date(now), 1), "Yesterday").otherwise("Earlier"))


def elapsed_bucket(now: Column, created_at: Column) -> Column:
    """The same by whole days gone by."""
    days = F.floor(seconds_before(now, created_at) / DAY)
    return F.when(days == 0, "Today").when(days == 1, "Yesterday").otherwise("Earlier")


def _text(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(unit))


def time_ago_app(now: Column, created_at: Column) -> Column:
    # Whole seconds, cut towards zero.
    s = seconds_before(now, created_at).cast("long")
    return (F.when(s < 60, "just now")
            .when(s < 3600, _text(F.floor(s / 60), " min ago"))
            .when(s < DAY, _text(F.floor(s / 3600), " hr ago"))
            .otherwise(_text(F.floor(s / DAY), " day ago")))


def _clock(now: Column, created_at: Column) -> tuple[Column, Column, Column]:
    """Whole minutes (0 shown as 1), hours and days; the screens count milliseconds."""
    millis = F.unix_millis(now) - F.unix_millis(created_at)
    mins = F.floor(millis / 60000)
    hours = F.floor(mins / 60)
    return mins, hours, F.floor(hours / 24)


def time_ago_sidebar(now: Column, created_at: Column) -> Column:
    mins, hours, days = _clock(now, created_at)
    shown = F.when(mins == 0, 1).otherwise(mins)
    return (F.when(mins < 60, _text(shown, " min ago"))
            .when(hours < 24, F.concat(_plural(hours, "hour"), F.lit(" ago")))
            .otherwise(F.concat(_plural(days, "day"), F.lit(" ago"))))


def time_ago_workspace(now: Column, created_at: Column) -> Column:
    mins, hours, days = _clock(now, created_at)
    shown = F.when(mins == 0, 1).otherwise(mins)
    return (F.when(mins < 60, _text(shown, "m ago"))
            .when(hours < 24, _text(hours, "h ago"))
            .otherwise(_text(days, "d ago")))


def filename_search(reviews: DataFrame, query: str) -> DataFrame:
    return reviews.filter(F.lower("filename").contains(query.lower()))


def user_profile_stats(users: DataFrame, stats: DataFrame) -> DataFrame:
    """Every user with totals; users without reviews have zeros."""
    names = ["total_reviews", "total_issues", "avg_score", "unique_files", "recent_reviews"]
    return (users.withColumnRenamed("id", "user_id").join(stats, "user_id", "left")
            .select("user_id", "username",
                    *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names]))
