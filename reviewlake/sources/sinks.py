"""Writers and their readers: features, review history, model packages."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reviewlake.functions import fixed
from reviewlake.operators.models import CalibratedForest, read_meta, write_meta
from reviewlake.operators.scoring import panel_score
from reviewlake.sources.stage import staged

RESULT_JSON = ("confidence double, syntax_error boolean, error_line int, error_msg string, "
               "issues array<array<string>>, complexity int")


def write_features(rows: DataFrame, folder: str) -> None:
    """Features, label and language, one folder per language."""
    (rows.select("snippet_id", *fixed.FEATURES, "bug_risk", "review_language")
     .write.mode("overwrite").partitionBy("review_language").parquet(folder))


def read_features(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def _quoted(col: Column) -> Column:
    """JSON text of one string."""
    text = F.to_json(F.array(col))
    return F.substr(text, F.lit(2), F.length(text) - 2)


def result_json(confidence: Column, syntax_error: Column, error_line: Column, error_msg: Column,
                issues: Column, complexity: Column) -> Column:
    """A review result as JSON; an issue is the array ``[name, line, fix]``."""
    listed = F.transform(issues, lambda i: F.concat(
        F.lit("["), _quoted(i["name"]), F.lit(","), i["line"].cast("string"), F.lit(","),
        _quoted(i["fix"]), F.lit("]")))
    head = F.to_json(F.struct(
        confidence.alias("confidence"), syntax_error.alias("syntax_error"),
        error_line.alias("error_line"), error_msg.alias("error_msg")),
        {"ignoreNullFields": "false"})
    return F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"issues":['),
                    F.array_join(listed, ","), F.lit('],"complexity":'),
                    complexity.cast("string"), F.lit("}"))


def parse_result(col: Column) -> Column:
    """The result struct of a JSON text; an empty text gives null."""
    def unpacked(raw: Column) -> Column:
        issues = F.transform(raw["issues"], lambda i: F.struct(
            F.get(i, 0).alias("name"), F.get(i, 1).try_cast("int").alias("line"),
            F.get(i, 2).alias("fix")))
        return F.when(raw.isNotNull(), F.struct(
            raw["confidence"].alias("confidence"), raw["syntax_error"].alias("syntax_error"),
            raw["error_line"].alias("error_line"), raw["error_msg"].alias("error_msg"),
            issues.alias("issues"), raw["complexity"].alias("complexity")))

    # As the element of an array the parsed value is bound once; each field would parse the text again otherwise.
    parsed = F.array(F.from_json(F.nullif(col, F.lit("")), RESULT_JSON))
    return F.get(F.transform(parsed, unpacked), 0)


def review_records(reviewed: DataFrame) -> DataFrame:
    """History rows: the result columns packed into JSON."""
    result = result_json(*[F.col(c) for c in ("confidence", "syntax_error", "error_line",
                                              "error_msg", "issues", "complexity")])
    return reviewed.select("review_id", "user_id", "code", "filename", result.alias("result"),
                           "created_at")


RECORDS = ("review_id long, user_id long, code string, filename string, result string, created_at timestamp, "
           "run_id string, batch_id long")
STORED = RECORDS + ", version string, bucket int"
TOTALS = ("user_id long, filename string, day date, n long, issues long, scores long, run_id string, batch_id long")
LOG = "run_id string, batch_id long, version string, written long, compacted int"
BUCKETS = 64
"""Parts of a history by user; fixed, since readers of one user go by it."""


def user_bucket(user_id: Column) -> Column:
    return F.pmod(F.xxhash64(user_id.cast("long")), F.lit(BUCKETS)).cast("int")


def day_totals(records: DataFrame) -> DataFrame:
    """What a history's rows add to the totals of their users, by file and day (of the session's time zone).

    Sums of such rows are the totals of any set of batches, so a batch brings its own and takes them away when it is replaced.
    """
    result = F.col("parsed")
    parsed = records.select("user_id", "filename", "run_id", "batch_id", F.to_date("created_at").alias("day"),
                            parse_result(F.col("result")).alias("parsed"))
    issues = F.size(result["issues"]) + result["syntax_error"].cast("int")
    return parsed.groupBy("user_id", "filename", "day", "run_id", "batch_id").agg(
        F.count("*").alias("n"), F.sum(issues).alias("issues"),
        F.sum(panel_score(result["confidence"], result["syntax_error"])).alias("scores"))


def _write_history(records: DataFrame, folder: str) -> str:
    """Rows and their totals under one version."""
    version = _write_version(records, folder)
    totals = day_totals(_read_or_empty(records.sparkSession, STORED, f"{folder}/data").filter(F.col("version") == version))
    _write_version(totals, folder, TOTALS, order=("user_id", "day"), place="totals", version=version)
    return version


def _write_version(records: DataFrame, folder: str, schema: str = RECORDS, bucket: Column | None = None,
                   order: tuple[str, ...] = ("user_id", "-unix_micros(created_at)"), place: str = "data",
                   version: str | None = None) -> str:
    """Rows in a folder of their own that no reader sees yet: by bucket, and in order within it."""
    version = version or f"v-{uuid.uuid4().hex}"
    bucket = user_bucket(F.col("user_id")) if bucket is None else bucket
    typed = records.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(schema)])
    (typed.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", *map(F.expr, order))
     .write.partitionBy("bucket").parquet(f"{folder}/{place}/version={version}"))
    return version


def _commit(entries: DataFrame, folder: str) -> None:
    """One new file in the log, which appears under its name whole or not at all: from then on readers see its versions."""
    entries.coalesce(1).write.mode("append").parquet(f"{folder}/log")


def write_records(records: DataFrame, folder: str, run_id: str, batch_id: int) -> None:
    """One batch of one run: a batch that is repeated replaces its own rows and no others.

    Its rows are written first and become visible, all at once, with an entry in the log; what an unfinished writer
    leaves behind is never read. Until a repeated batch is committed, readers see the rows of the first time.
    """
    stamped = records.withColumn("run_id", F.lit(run_id)).withColumn("batch_id", F.lit(batch_id).cast("long"))
    started = time.time_ns()
    version = _write_history(stamped, folder)
    _commit(records.sparkSession.createDataFrame([(run_id, batch_id, version, started, 0)], LOG), folder)


def append_reviews(reviewed: DataFrame, folder: str) -> None:
    """Every call is a run of its own."""
    write_records(review_records(reviewed), folder, uuid.uuid4().hex, 0)


def _read_or_empty(spark: SparkSession, schema: str, folder: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """``run_id, batch_id, version, written`` of the rows that count: of each batch what was written last.

    A compacted copy has the time of the batch that it copies, and so never hides a newer one.
    """
    log = _read_or_empty(spark, LOG, f"{folder}/log")
    newest = F.max(F.struct("written", "compacted", "version")).alias("newest")
    return log.groupBy("run_id", "batch_id").agg(newest).select("run_id", "batch_id", "newest.version", "newest.written")


def read_reviews(spark: SparkSession, folder: str, user_id: int | None = None) -> DataFrame:
    """All committed rows of batches and streams, or those of one user: then only the user's bucket is read.

    The log is read before the rows are listed, so a reader sees whole batches as of then. A folder without a history is empty.
    """
    visible = staged(committed(spark, folder).select("run_id", "batch_id", "version"), "snapshot")
    rows = _read_or_empty(spark, STORED, f"{folder}/data")
    if user_id is not None:
        rows = rows.filter((F.col("bucket") == user_bucket(F.lit(user_id))) & (F.col("user_id") == user_id))
    return rows.join(visible, ["run_id", "batch_id", "version"], "left_semi").drop("run_id", "batch_id", "version", "bucket")


def read_totals(spark: SparkSession, folder: str) -> DataFrame:
    """``user_id, filename, day, n, issues, scores`` of the batches that ``read_reviews`` would show; sums over rows count."""
    visible = staged(committed(spark, folder).select("run_id", "batch_id", "version"), "snapshot")
    rows = _read_or_empty(spark, TOTALS + ", version string, bucket int", f"{folder}/totals")
    return rows.join(visible, ["run_id", "batch_id", "version"], "left_semi").drop("run_id", "batch_id", "version", "bucket")


def compact(spark: SparkSession, folder: str) -> int:
    """Copy all committed rows into one version with few files a bucket; returns how many batches were copied.

    Batches stay apart in the copy, so one that is repeated later still replaces its own rows. Old files stay for readers that
    have begun; a batch without rows keeps its entry.
    """
    batches = staged(committed(spark, folder), "batches")
    rows = _read_or_empty(spark, STORED, f"{folder}/data").join(
        batches.select("run_id", "batch_id", "version"), ["run_id", "batch_id", "version"], "left_semi")
    n = batches.count()
    if n:
        version = _write_history(rows, folder)
        _commit(batches.select("run_id", "batch_id", F.lit(version).alias("version"), "written", F.lit(1).alias("compacted")), folder)
    return n


# ---- results remembered by code ---------------------------------------------------

REMEMBERED = "code_hash string, review_language string, result string, seen_at timestamp, run_id string, batch_id long"


def code_bucket(code_hash: Column) -> Column:
    return F.pmod(F.xxhash64(code_hash), F.lit(BUCKETS)).cast("int")


def remember(results: DataFrame, folder: str, run_id: str, batch_id: int) -> None:
    """Keep review results by ``code_hash, review_language``; a repeated batch replaces its own."""
    packed = results.select(
        "code_hash", "review_language", result_json(*[F.col(c) for c in (
            "confidence", "syntax_error", "error_line", "error_msg", "issues", "complexity")]).alias("result"),
        F.current_timestamp().alias("seen_at"), F.lit(run_id).alias("run_id"), F.lit(batch_id).cast("long").alias("batch_id"))
    started = time.time_ns()
    version = _write_version(packed, folder, REMEMBERED, code_bucket(F.col("code_hash")), ("code_hash", "review_language"))
    _commit(results.sparkSession.createDataFrame([(run_id, batch_id, version, started, 0)], LOG), folder)


def recall(asked: DataFrame, folder: str, keep_days: float | None = None) -> DataFrame:
    """``code_hash, review_language`` and the result columns of those asked for that are remembered.

    ``asked``: distinct ``code_hash, review_language``. Results older than ``keep_days`` count as forgotten; the newest
    of several is taken.
    """
    spark = asked.sparkSession
    visible = staged(committed(spark, folder).select("run_id", "batch_id", "version"), "snapshot")
    rows = _read_or_empty(spark, REMEMBERED + ", version string, bucket int", f"{folder}/data")
    if keep_days is not None:
        rows = rows.filter(F.col("seen_at") >= F.current_timestamp() - F.make_dt_interval(secs=F.lit(keep_days * 86400.0)))
    keys = asked.select("code_hash", "review_language", code_bucket(F.col("code_hash")).alias("bucket"))
    known = (rows.join(keys, ["bucket", "code_hash", "review_language"], "left_semi")
             .join(visible, ["run_id", "batch_id", "version"], "left_semi")
             .groupBy("code_hash", "review_language").agg(F.max(F.struct("seen_at", "result")).alias("newest")))
    parsed = known.withColumn("result", parse_result(F.col("newest.result")))
    return parsed.select("code_hash", "review_language", "result.*")


def save_package(spark: SparkSession, models: dict[str, CalibratedForest], meta: dict,
                 folder: str) -> None:
    """One saved forest per language and the meta data as JSON text."""
    for language, model in models.items():
        model.save(f"{folder}/models/{language}")
    write_meta(spark, meta, folder)


def load_package(spark: SparkSession, folder: str) -> tuple[dict[str, CalibratedForest], dict]:
    """``(models, meta)``; a bare forest counts as a package of the default language."""
    try:
        meta = read_meta(spark, folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return ({"python": CalibratedForest.load(spark, folder)},
                {"artifact_version": "legacy", "default_language": "python"})
    models = {lang: CalibratedForest.load(spark, f"{folder}/models/{lang}")
              for lang in meta["trained_languages"]}
    return models, meta
