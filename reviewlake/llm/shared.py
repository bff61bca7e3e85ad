"""What several operators of this package use: checkpoints, running totals, blocks of texts, distinct words."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from reviewlake.sources.stage import shared_folder

BLOCK_BYTES = 2 << 20
"""Text that one step of a Python task holds."""

SALTS = 1024
"""Pieces into which ``running_total`` cuts each group, so that a hot group is never one task's work."""


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared checkpoint folder, and read them from there.

    The folder is the session's ``spark.checkpoint.dir``; a local one is made only in local mode where that is unset.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table that is part of the plan itself."""
    names = StructType.fromDDL(schema).names
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{as_fields(schema)}>>")))


def as_fields(schema: str) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


def running_total(df: DataFrame, group: list[str], order: list[str], value: Column, name: str,
                  spread: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the earlier rows of the group, by ``spread`` and then ``order``.

    ``spread`` is a column of 64-bit hashes. Its upper ten bits cut a group into 1,024 pieces; only the totals of
    pieces pass through a window over the group, so a group with a third of all rows is the work of many tasks.
    """
    piece, size = F.col("_piece"), F.col("_size")
    rows = df.withColumn("_piece", F.shiftright(F.col(spread), 54)).withColumn("_size", value)
    inside = (Window.partitionBy(*group, "_piece").orderBy(spread, *order)
              .rowsBetween(Window.unboundedPreceding, -1))
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy(*group, "_piece").agg(F.sum(size).alias("_sum"))
              .select(*[F.col(g).alias(f"_of_{g}") for g in group], piece.alias("_of_piece"),
                      F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")))
    same = piece == F.col("_of_piece")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return (rows.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(starts, same)
            .withColumn(name, (F.col("_start") + F.col("_inside")).cast("long"))
            .drop("_piece", "_size", "_inside", "_start", "_of_piece", *[f"_of_{g}" for g in group]))


def cut(batch: pa.RecordBatch, text: str, block: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``block`` bytes of text; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = (np.cumsum(sizes) - sizes) // block
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def map_blocks(df: DataFrame, schema: str, start: Callable, *args, text: str = "text",
               block: int = BLOCK_BYTES) -> DataFrame:
    """Run ``start(*args)`` once in a task, and the function that it returns on each block of rows.

    That function gets a RecordBatch and returns a list of columns for ``schema``, or None for no rows.
    """
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        step = start(*args)
        for batch in batches:
            for part in cut(batch, text, block):
                columns = step(part)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type)
                         for c, f in zip(columns, fields, strict=True)], schema=fields)

    return df.mapInArrow(run, schema)


class WordTable:
    """Numbers the distinct words of a task's texts; ``add`` is told of new ones, ``clear`` when all are forgotten.

    Words are kept from block to block until there are ``most`` of them, or ``longest`` characters in all, which bounds the
    memory and changes no result.
    """

    def __init__(self, add: Callable[[list], None], clear: Callable[[], None], most: int = 200_000, longest: int = 4 << 20):
        self.index: dict = {}
        self.add, self.clear, self.most, self.longest, self.held = add, clear, most, longest, 0

    def codes(self, words: list) -> np.ndarray:
        if len(self.index) > self.most or self.held > self.longest:
            self.index, self.held = {}, 0
            self.clear()
        index = self.index
        new = [w for w in dict.fromkeys(words) if w not in index]
        if new:
            self.held += sum(map(len, new))
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            self.add(new)
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))


class Pairs:
    """A fixed map from pairs of small numbers to numbers, looked up for whole arrays (-1: absent)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(2 * len(left)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        keys = left.astype(np.int64) << 32 | right
        slots, left_over, self.probes = self.slot(keys), np.arange(len(keys)), 0
        while len(left_over):
            at = (slots[left_over] + self.probes) & (size - 1)
            free = self.keys[at] == -1
            _, first = np.unique(at, return_index=True)
            first = first[free[first]]
            taken = left_over[first]
            self.keys[at[first]], self.values[at[first]] = keys[taken], value[taken]
            left_over = np.delete(left_over, first)
            self.probes += 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = self.slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        mask = len(self.keys) - 1
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)
