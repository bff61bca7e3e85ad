"""Exact ranks, splits and folds by hash order, with no group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 3          # hex digits of the hash: 4096 buckets per group


def hashed_rank(df: DataFrame, keys: list[str], id_col: str, seed: int = 42) -> DataFrame:
    """Add ``hash_rank`` (1-based, by md5 of seed and id) and ``group_size`` within ``keys``.

    Rows are ranked inside small hash buckets, and a bucket's first rank comes
    from the bucket counts: 4096 per group at most, however large a group is.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col)))).withColumn(
        "_b", F.substring("_h", 1, PREFIX))
    counts = hashed.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = counts.select(
        *keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("group_size"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_h", id_col)
    return (
        hashed.withColumn("_r", F.row_number().over(inside))
        .join(offsets, [*keys, "_b"])
        .withColumn("hash_rank", F.col("_before") + F.col("_r"))
        .drop("_h", "_b", "_r", "_before")
    )


def stratified_split(df: DataFrame, label: list[str], id_col: str, test_size: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Add ``is_test``: the first fifth (rounded) of each label in hash order."""
    ranked = hashed_rank(df, label, id_col, seed)
    n_test = F.floor(F.col("group_size") * F.lit(test_size) + F.lit(0.5))
    return ranked.withColumn("is_test", F.col("hash_rank") <= n_test).drop(
        "hash_rank", "group_size")


def stratified_folds(df: DataFrame, label: list[str], id_col: str, folds: int,
                     seed: int = 42) -> DataFrame:
    """Add ``fold`` 0 .. folds-1, each label spread evenly."""
    ranked = hashed_rank(df, label, id_col, seed + 1)
    return ranked.withColumn("fold", (F.col("hash_rank") % folds).cast("int")).drop(
        "hash_rank", "group_size")


def class_weights(df: DataFrame, label: str, groups: tuple = ()) -> DataFrame:
    """Add ``weight`` = n / (classes * n of the class), within ``groups``."""
    counts = df.groupBy(*groups, label).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    weights = counts.select(*groups, label, (
        F.sum("_n").over(whole) / (F.count("*").over(whole) * F.col("_n"))).alias("weight"))
    return df.join(weights, [*groups, label])


def class_guard(rows: DataFrame, supported: list[str], label: str = "bug_risk",
                test_size: float = 0.2) -> DataFrame:
    """Per language: ``reason`` it cannot be trained, or null."""
    counts = rows.groupBy("review_language", label).agg(F.count("*").alias("n"))
    in_train = F.col("n") - F.floor(F.col("n") * F.lit(test_size) + F.lit(0.5))
    per = counts.withColumn("train", in_train).groupBy("review_language").agg(
        F.sum("n").alias("n_samples"), F.count("*").alias("n_classes"),
        F.min("train").alias("min_train"))
    language = F.col("review_language")

    def why(text: str) -> Column:
        return F.concat(language, F.lit(text))

    return per.select(
        "review_language", "n_samples", "n_classes",
        F.when(~language.isin(supported), F.lit("unsupported_language"))
        .when(F.col("n_classes") < 2, why(": requires at least 2 classes."))
        .when(F.col("min_train") < 2, why(": not enough samples per class after split."))
        .alias("reason"))
