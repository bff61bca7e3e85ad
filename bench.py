"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from reviewlake.operators import history, metrics
from reviewlake.operators.clean import clean_dataset, with_bug_risk
from reviewlake.operators.features import features_c_like, rich_c_like, rich_python
from reviewlake.operators.lines import clean_c_like, line_facts, with_review_language
from reviewlake.operators.nodes import node_table
from reviewlake.operators.rules_clike import c_like_issues
from reviewlake.operators.rules_python import python_issues
from reviewlake.operators.tokens import c_like_syntax
from reviewlake.plans import inputs
from reviewlake.plans.corpus import code_corpus
from reviewlake.plans.review import review
from reviewlake.sources.stage import staged

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def source(spark):
    return with_review_language(code_corpus(spark, SF_DIR))


def q_clean_label(spark):
    return with_bug_risk(clean_dataset(code_corpus(spark, SF_DIR)))


def q_c_like_syntax(spark):
    return c_like_syntax(source(spark))


def q_c_like_rules(spark):
    clean = clean_c_like(source(spark))
    return c_like_issues(clean, staged(line_facts(clean), "lines"))


def q_python_rules(spark):
    return python_issues(staged(node_table(source(spark)), "nodes"))


def q_features(spark):
    return features_c_like(source(spark))


def q_rich(spark):
    rows = source(spark)
    nodes = staged(node_table(rows), "nodes")
    return rich_c_like(rows).unionByName(rich_python(rows, nodes))


def q_review(spark):
    return review(code_corpus(spark, SF_DIR))


def q_latest_reviews(spark):
    return history.latest_reviews(inputs.reviews(spark, SF_DIR))


def q_workspace_stats(spark):
    return history.workspace_stats(inputs.parsed_reviews(spark, SF_DIR), inputs.now())


def q_score_series(spark):
    return history.score_series(inputs.reviews(spark, SF_DIR))


def q_threshold_sweep(spark):
    return metrics.threshold_sweep(inputs.scored(spark, SF_DIR), {"java": 2.0}, {"java": 0.7})


def q_binary_metrics(spark):
    rows = inputs.scored(spark, SF_DIR).withColumn("threshold", F.lit(0.425))
    return metrics.binary_metrics(rows, ["review_language"])


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")}


def main():
    spark = (SparkSession.builder.master(f"local[{CPUS}]")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             # Little data, much work per byte: let small partitions stay apart.
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up is not part of any query: compile and read once before the clock runs.
    source(spark).groupBy("review_language").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name, fn in QUERIES.items():
        start = time.perf_counter()
        # Every column of every row is computed, none reaches the driver.
        fn(spark).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    snippets = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    print(json.dumps({
        "metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "snippets": snippets,
        "review_ms_per_snippet": round(1000 * times["review"] / snippets, 3)}))


if __name__ == "__main__":
    main()
