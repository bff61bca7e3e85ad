"""Sources interleaved to target weights by Pfair scheduling (native: DataFrame functions only).

A source's documents, in a random order, fill blocks of equal bytes. With weights as whole shares a of N = 2^40, block j of a
source may not start before slot floor(j N / a) and must lie before slot ceil((j + 1) N / a). Earliest deadline first among
the blocks that may start meets every deadline, because the weights sum to one; so at every slot each source is within one
block of its target. Shares are exact to 2^-40, so weights are the targets whatever the number and the sizes of sources. The driver,
which holds one number for each source, deals out the slots of all blocks in portions; the rows find theirs by a join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from reviewlake.llm.shared import keep, running_total

PERIOD = 1 << 40
PORTION = 1_000_000
"""Slots that the driver holds at a time."""
BLOCK = 256 << 10


def whole_shares(weights: dict, period: int) -> dict:
    """Weights as whole numbers of at least one that sum to ``period`` (largest remainders)."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources do not fit into a period of {period} slots")
    total = sum(weights.values())
    free = period - len(weights)
    exact = {s: w / total * period for s, w in weights.items()}
    shares = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (exact[s] - shares[s], str(s)))
    while (over := sum(shares.values()) - period) and free:
        for s in by_rest if over > 0 else reversed(by_rest):
            if over == 0:
                break
            if over > 0 and shares[s] > 1:
                shares[s], over = shares[s] - 1, over - 1
            elif over < 0:
                shares[s], over = shares[s] + 1, over + 1
    return shares


def release(j: int, share: int, period: int) -> int:
    return j * period // share


def deadline(j: int, share: int, period: int) -> int:
    return -(-(j + 1) * period // share)


def block_slots(shares: dict, blocks: dict, period: int) -> Iterator[tuple]:
    """(source, block, slot) of the blocks that are there, by earliest deadline first; slots for which none is released stay empty."""
    waiting = [(0, str(s), 0, s) for s in shares if blocks[s]]
    heapq.heapify(waiting)
    ready: list = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, name, j, s = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(j, shares[s], period), name, j, s))
        _, name, j, s = heapq.heappop(ready)
        yield s, j, slot
        slot += 1
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, (release(j + 1, shares[s], period), name, j + 1, s))


def measured() -> tuple:
    """Size in bytes (16 more than the text's), and a hash that puts a source's documents into a random order."""
    return ((F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long"), F.xxhash64(F.lit("mix"), "doc_id", "text"))


def mix_sources(documents: DataFrame, weights: dict | None = None, temper: float = 0.7, period: int = PERIOD,
                block: int = BLOCK) -> DataFrame:
    """Add to each document ``weight, block, release, deadline, slot, place, in_mix``: where it stands in the mixture.

    ``documents`` has ``doc_id``, ``source`` and ``text``, or instead of the text its ``size`` and ``spread`` (a 64-bit hash),
    as ``measured`` gives them.
    ``weights``: target by source; a source that is not named shares the smallest weight given. Without weights a source
    weighs its bytes to the power ``temper``. Sort by (slot, place) to read the mixture. Every document is placed once,
    none is dropped: ``in_mix`` is true up to the first slot that a source, having run out, leaves empty (up to there the
    targets hold to less than a block); later the remaining sources keep to their releases and deadlines, so to their weights
    among each other. Nulls: a null source is a source by itself, a null text has no bytes. Repeated rows are rows of their own. ``period``
    is the unit of weights: each is a multiple of one part of it. Other columns stay; of clashing names the new column wins. A very long
    document lies whole in the block that it begins in. An empty table gives no rows.
    """
    spark = documents.sparkSession
    rows = documents.drop("weight", "block", "release", "deadline", "slot", "place", "in_mix", "_size_of", "_spread")
    rows = rows.withColumns(dict(zip(("_size_of", "_spread"), measured() if "text" in rows.columns
                                     else (F.col("size"), F.col("spread")), strict=True)))
    totals = {r.source: r.bytes for r in rows.groupBy("source").agg(F.sum("_size_of").alias("bytes")).collect()}
    if not totals:
        return rows.drop("_size_of", "_spread").selectExpr("*", "0D weight", "0L block", "0L release", "0L deadline", "0L slot", "0L place",
                               "true in_mix")
    if weights is None:
        targets = {s: float(b) ** temper for s, b in totals.items()}
    else:
        targets = {s: float(weights.get(s, min(weights.values()))) for s in totals}
    shares = whole_shares(targets, period)
    ends = {s: -(-b // block) for s, b in totals.items()}
    # With one block more for each source: its slot is the first that the source, having run out, leaves empty.
    dealt = block_slots(shares, {s: n + 1 for s, n in ends.items()}, period)
    until = None
    schema = StructType([StructField("p_source", rows.schema["source"].dataType),
                         *[StructField(f"p_{c}", LongType()) for c in ("block", "share", "slot")]])
    fields, portions = to_arrow_schema(schema), []
    while portion := list(islice(dealt, PORTION)):
        if until is None:
            until = next((slot for s, j, slot in portion if j == ends[s]), None)
        columns = zip(*((s, j, shares[s], slot) for s, j, slot in portion), strict=True)
        part = spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields), schema)
        portions.append(part if len(portion) < PORTION and not portions else keep(part))
    plan = reduce(DataFrame.unionAll, portions)
    placed = running_total(rows, ["source"], ["doc_id"], F.col("_size_of"), "place", "_spread")
    placed = placed.withColumn("block", F.expr(f"place div {block}"))
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") == F.col("p_block")))
    # Products of blocks and the period can have more than 64 bits.
    whole = f"cast({period} as decimal(15, 0))"
    return (placed.withColumn("weight", F.col("p_share") / F.lit(float(period)))
            .withColumn("release", F.expr(f"cast(block as decimal(20, 0)) * {whole} div p_share"))
            .withColumn("deadline", F.expr(f"(cast(block + 1 as decimal(20, 0)) * {whole} + p_share - 1) div p_share"))
            .withColumn("slot", F.col("p_slot"))
            .withColumn("in_mix", F.col("slot") < F.lit(until))
            .drop("_size_of", "_spread", "p_source", "p_block", "p_share", "p_slot"))
